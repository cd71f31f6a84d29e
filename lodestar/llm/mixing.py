"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Targets: sources weigh ``weights`` in turn and share all words, none above ``most`` times its own
size; the excess goes to the others by weight. Each source takes ``floor(target / size)`` whole
copies of all its documents, and what its target still needs by Pareto order sampling with unequal
probabilities: a document's inclusion probability grows with the square root of its size and is
set so that the expected words are those needed; where it would reach 1 the document is certain and
taken first. The others are ranked by the odds of a random number (a hash of id and seed) over the
odds of their own probability, and taken in that order while their words fit. What the first
document that does not fit leaves open is filled in the same order by those that do, ``ROUNDS``
times in all, so the sample's size is fixed in words. The order is cut by sums over ``BUCKETS``
ranges of the rank, and then exactly within one, so no task sorts a whole source. Each round is two
small jobs over the ranked rows: a driver pays for every plan, join and exchange.

Defined results: a null text has size 0 and takes no words; a null source is a source of its own,
last in order; a source without words has target 0. Rows with the same id share their random
number; rows alike in id and size are ties, taken together. Rows with a null id share one number.
Texts of any length are counted whole. An empty table gives an empty mix. Columns added here replace
columns of the same names in either case; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, stored

BUCKETS = 4096
ROUNDS = 3
ADDED = ("size", "source_size", "target", "copies", "taken")


def size_of(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform in (0, 1), from the id alone."""
    key = F.concat_ws(":", F.lit("mix"), F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("bigint") + 0.5) / float(1 << 48)


def ordinal(values: DataFrame, column: str) -> DataFrame:
    """Distinct values with their 0-based place by code point, null last: a distributed sort, then an
    offset for each of its partitions."""
    placed = stored(values.select(column).distinct().orderBy(F.asc_nulls_last(column)).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").select(column, (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).alias("sid"))


def targets(rows: DataFrame, *, weights=(5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, sid, source_size, n_docs, target): the level that shares all words is found by
    raising it while sources are filled up; each step is one aggregate over the sources."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    found = stored(ordinal(rows, "source").withColumnRenamed("source", "_source").join(sums, F.col("_source").eqNullSafe(F.col("source"))).select("source", "sid", "source_size", "n_docs").withColumn("weight", weight))
    full = most * F.col("source_size")
    total, weighed = found.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / weighed if weighed else 0.0
    while True:
        open_ = F.col("weight") * level <= full
        taken, left = found.agg(F.sum(F.when(~open_, full)), F.sum(F.when(open_, F.col("weight")))).first()
        new = ((total or 0) - (taken or 0.0)) / left if left else level
        if new <= level:
            break
        level = new
    return found.withColumn("target", F.least(full, F.col("weight") * level))


def _rank(u: Column, p: Column) -> Column:
    """Pareto order: q = (u/(1-u)) / (p/(1-p)), as q/(1+q)."""
    a, b = u * (1 - p), (1 - u) * p
    return a / (a + b)


def inclusion(rows: DataFrame, state: DataFrame) -> DataFrame:
    """sid and ``scale``: a document of n words is included with probability min(1, scale * sqrt(n)),
    which takes ``need`` words on average. ``rows``: sid, size.

    The largest sizes are certain: of the places where the sizes, in falling order, can be divided
    into certain and other ones, the first at which no other would reach 1 is the right one.
    """
    sizes = rows.groupBy("sid", "size").agg(F.count("*").alias("n")).join(state.select("sid", "need"), "sid")
    upto = Window.partitionBy("sid").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy("sid").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("n") * F.col("size")
    scale = (F.col("need") - F.coalesce(F.sum(words).over(upto), F.lit(0))) / F.sum(words * F.sqrt("size")).over(onward)
    fits = sizes.withColumn("scale", scale).where(F.col("scale") * F.sqrt("size") <= 1)
    return fits.groupBy("sid").agg(F.max_by("scale", "size").alias("scale"))


def _cut(rows: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """``state`` with ``round<k>`` and what is still needed after it: open rows are taken if their rank is
    under ``below`` or at most ``upto``, in order while the words before them and their own (half of them
    in the last round) fit. ``rows``: sid, size, r."""
    last, past = k == ROUNDS - 1, [f"round{j}" for j in range(k)]
    reach = F.col("need") * (2.0 if last else 1.0)  # the last round may take one that fits by half
    bucket = F.floor(F.col("r") * float(BUCKETS))

    def open_(*columns: str) -> DataFrame:
        return rows.join(state.select("sid", "need", *columns, *past), "sid").where((F.col("size") <= reach) & ~_taken(k, F.lit(False)))

    def before(column: str) -> Column:
        return F.coalesce(F.sum("_w").over(Window.partitionBy("sid").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sums = open_().groupBy("sid", bucket.alias("_b")).agg(F.sum("size").alias("_w"), F.first("need").alias("_goal"))
    edge = sums.withColumn("_before", before("_b")).where("_before <= _goal").groupBy("sid").agg(F.max_by(F.struct("_b", "_before"), "_b").alias("_e"))
    state = stored(state.join(edge.select("sid", F.col("_e._b").alias("_edge"), F.col("_e._before").alias("_from")), "sid", "left"))
    ties = open_("_edge", "_from").where(bucket == F.col("_edge")).groupBy("sid", "r").agg(F.sum("size").alias("_w"), F.first("_from").alias("_f"), F.first("need").alias("_goal"))
    ties = ties.withColumn("_before", F.col("_f") + before("r")).where(F.col("_before") + (0.5 if last else 1.0) * F.col("_w") <= F.col("_goal"))
    found = state.join(ties.groupBy("sid").agg(F.max("r").alias("_upto"), F.max(F.col("_before") + F.col("_w")).alias("_took")), "sid", "left")
    cut = F.struct(reach.alias("reach"), (F.col("_edge") / float(BUCKETS)).alias("below"), F.coalesce("_upto", F.lit(-1.0)).alias("upto"))
    found = found.withColumn(f"round{k}", F.when(F.col("_edge").isNotNull(), cut)).withColumn("need", F.col("need") - F.coalesce("_took", "_from", F.lit(0)))
    return stored(found.drop("_edge", "_from", "_upto", "_took"))


def _in_round(k: int) -> Column:
    """Whether round ``k`` takes a row, given the round's cut."""
    cut = F.col(f"round{k}")
    return cut.isNotNull() & (F.col("size") <= cut["reach"]) & ((F.col("r") < cut["below"]) | (F.col("r") <= cut["upto"]))


def _taken(rounds: int, found: Column) -> Column:
    for k in range(rounds):
        found = found | F.coalesce(_in_round(k), F.lit(False))
    return found


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (size, u, scale) with certain and r."""
    p = F.least(F.coalesce("scale", F.lit(0.0)) * F.sqrt("size"), F.lit(1.0))
    return rows.withColumn("certain", (F.col("size") > 0) & (p >= 1)).withColumn("r", F.when((F.col("size") > 0) & (p > 0) & (p < 1), _rank(F.col("u"), p)))


def allocate(rows: DataFrame, *, weights=(5, 2, 1), most: float = 3.0, seed: int = 11) -> DataFrame:
    """One row for each source: its target, its whole copies, the scale of its documents' inclusion
    probabilities, and where each round cuts the Pareto order. ``rows``: source, size, u."""
    plan = targets(rows, weights=weights, most=most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = stored(plan.withColumn("whole", F.floor(ratio)).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    small = rows.where("size > 0").join(state.where("need > 0").select(F.col("source").alias("_s"), "sid"), F.col("source").eqNullSafe(F.col("_s"))).select("sid", "size", "u")
    state = stored(state.join(inclusion(small.select("sid", "size"), state), "sid", "left"))
    ranked = stored(_ranked(small.join(state.where("scale > 0").select("sid", "scale"), "sid")).select("sid", "size", "certain", "r"))
    sure = ranked.where("certain").groupBy("sid").agg(F.sum("size").alias("took"))
    state = stored(state.join(sure, "sid", "left").withColumn("need", F.col("need") - F.coalesce("took", F.lit(0))).drop("took"))
    for k in range(ROUNDS):
        state = _cut(ranked.where("r is not null").select("sid", "size", "r"), state, k)
    return state.drop("need", "weight")


def apply(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with source, size, u) and their copies under a plan."""
    plan = plan.withColumnRenamed("source", "_plan_source").drop("sid", "n_docs")
    joined = _ranked(rows.join(plan, F.col("source").eqNullSafe(F.col("_plan_source"))))
    out = joined.withColumn("copies", (F.col("whole") + F.when(_taken(ROUNDS, F.col("certain")), 1).otherwise(0)).cast("bigint")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("_plan_source", "whole", "scale", "certain", "r", *(f"round{k}" for k in range(ROUNDS)))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: list[str] | None = None, weights=(5, 2, 1), most: float = 3.0, seed: int = 11) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, all if None) with size, source_size, target, copies, taken."""
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row")  # names within it clash with nothing
    rows = docs.select(row, F.col(source).alias("source"), size_of(text).alias("size"), draw(F.col(doc_id), seed).alias("u"))
    narrow = keep is not None and set(keep) <= {doc_id}
    if narrow:
        rows = stored(rows)
    plan = allocate(rows.select("source", "size", "u") if narrow else stored(rows.select("source", "size", "u")), weights=weights, most=most, seed=seed)
    return apply(rows, plan).select("_row.*", *ADDED)
