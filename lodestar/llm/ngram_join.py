"""Similarity join of word-shingle sets: texts whose sets have a Jaccard similarity of a given percentage or more.

Words are lower-cased (A-Z) runs of non-blank bytes, a set the distinct shingles of ``width`` words of a text (the
whole sequence if it has fewer words). Exact copies of a set are one node. Two sets that are similar enough must share
a token among their first few under any order of all tokens (the prefix). Several global orders are used:

1. rare tokens first, by counts kept in a table of fixed size (tokens that share a cell count together, which only
   makes the order less sharp). Its prefixes are the inverted index; sizes and positions rule out most pairs of a list.
2. the order of a hash, and 3. its reverse: a candidate must share a token of both these prefixes as well.

Candidates that pass all filters are verified on the whole sets. All members of a list are first compared with one of
them, the one whose own rare tokens are fewest; then the pairs that this left in different components. So lists of
copies cost in proportion to their length, and no link between components is lost.

Defined results: a text without words (null too) has an empty set and is linked with nothing, or with all others of
that kind if ``empty`` is "alike". A component's id is the smallest non-null id in it (null if there is none). Rows
given twice each give a row. Very long texts are read whole, in batches of their own. An empty table gives no rows.
Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestar.llm.common import dropped, small_batches, stored, text_bytes, widened
from lodestar.llm.simhash import components

#: Cells of the table of token counts, and of a row of it.
CELLS, ROW = 1 << 20, 1 << 12
#: Bytes of text hashed at once.
BATCH = 2 << 20
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_NEXT = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for i, base in enumerate((_P, _INVERSE)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, and the n+1 offsets of the texts' words."""
    solid = ~_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[:-1]
    edge = edge[edge < len(data)]
    begins[edge] = solid[edge]
    starts = np.flatnonzero(begins)
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = solid
    stops[1:-1] &= ~solid[1:] | begins[1:]
    ends = np.flatnonzero(stops)
    power, inverse = _powers_upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, offsets)


def sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text: (text, hash) sorted by text and hash, and the set sizes."""
    found, at = words(data, offsets)
    n = np.diff(at)
    many = np.maximum(n - width + 1, np.minimum(n, 1))
    who = np.repeat(np.arange(len(n)), many)
    first = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + at[:-1][who]
    acc = np.zeros(len(who), np.uint64)
    for i in range(width):
        there = i < n[who]
        acc = np.where(there, acc * _NEXT + found[np.minimum(first + i, max(len(found) - 1, 0))], acc) if len(found) else acc
    acc = mixed(acc + np.minimum(n, width)[who].astype(np.uint64))
    order = np.lexsort((acc, who))
    acc, who = acc[order], who[order]
    keep = np.ones(len(acc), bool)
    keep[1:] = (acc[1:] != acc[:-1]) | (who[1:] != who[:-1])
    return who[keep], acc[keep], np.bincount(who[keep], minlength=len(n))


def _nodes(who: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash of each set."""
    out = np.zeros(len(sizes), np.uint64)
    np.add.at(out, who, mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)))
    return mixed(out + sizes.astype(np.uint64)).view(np.int64)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values))


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - (CELLS.bit_length() - 1))).astype(np.int64)


def described(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, hash, node, n) for every row of ``docs`` (doc_id, hash, _text), and rows of the table of counts
    (_row, _counts) from each task."""
    kept = StructType([StructField(f.name, f.dataType) for f in docs.select("doc_id", "hash").schema])  # null in rows of the table
    schema = widened(kept, node="bigint", n="int", _row="int", _counts="binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        kinds = None
        for batch in small_batches(batches, "_text", BATCH):
            kinds = kinds or [batch.schema.field(0).type, batch.schema.field(1).type]
            who, tokens, sizes = sets(*text_bytes(batch.column(2)), width)
            counts += np.bincount(_cell(tokens), minlength=CELLS).astype(np.uint32)
            made = [pa.array(_nodes(who, tokens, sizes)), pa.array(sizes, pa.int32()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], schema.names)
        if kinds:
            k = CELLS // ROW
            rows = pa.array([r.tobytes() for r in counts.reshape(k, ROW)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kinds[0]), pa.nulls(k, kinds[1]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array(range(k), pa.int32()), rows], schema.names)

    return docs.select("doc_id", "hash", "_text").mapInArrow(work, schema)


def levels(rows: DataFrame) -> np.ndarray:
    """How frequent the tokens of each cell are, as a byte: four steps for each doubling. Of fixed size."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for row, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if row != now:
                    if total is not None:
                        yield pa.RecordBatch.from_pydict({"_row": pa.array([now], pa.int32()), "_counts": [total.tobytes()]})
                    now, total = row, np.zeros(ROW, np.uint64)
                total += np.frombuffer(counts, np.uint32)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"_row": pa.array([now], pa.int32()), "_counts": [total.tobytes()]})

    parts = rows.where("_row is not null").select("_row", "_counts").repartition("_row").sortWithinPartitions("_row")
    out = np.zeros((CELLS // ROW, ROW))
    for row, counts in parts.mapInArrow(added, "_row int, _counts binary").collect():  # CELLS numbers at every size
        out[row] = np.frombuffer(counts, np.uint64)
    return np.minimum(np.log2(np.maximum(out, 1)) * 4, 255).astype(np.uint8).ravel()


def prefixes(docs: DataFrame, width: int, percent: int, level: np.ndarray) -> DataFrame:
    """(node, n, tokens): the prefix of each set in the order of rare tokens first; a set may be given by several tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in small_batches(batches, "_text", BATCH):
            who, tokens, sizes = sets(*text_bytes(batch.column(0)), width)
            nodes = _nodes(who, tokens, sizes)
            if len(seen) > 1_000_000:
                seen.clear()
            new = np.zeros(len(nodes), bool)
            for i, node in enumerate(nodes.tolist()):
                if sizes[i] and node not in seen:
                    seen.add(node)
                    new[i] = True
            keep = new[who]
            who, tokens = who[keep], tokens[keep]
            key = (shared.value[_cell(tokens)].astype(np.uint64) << np.uint64(56)) | (mixed(tokens) >> np.uint64(8))
            order = np.lexsort((key, who))
            who, tokens = who[order], tokens[order]
            sizes = np.where(new, sizes, 0)
            rank = np.arange(len(who)) - (np.cumsum(sizes) - sizes)[who]
            most = np.where(new, sizes - (sizes * percent + 99) // 100 + 1, 0)
            near = rank < most[who]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[new]), pa.array(sizes[new], pa.int32()), _lists(tokens[near].view(np.int64), most[new])], ["node", "n", "tokens"])

    return docs.select("_text").mapInArrow(work, "node bigint, n int, tokens array<bigint>")


def _whole(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, n, head, body, tail) of ``docs`` (node, _text): the whole set in the order of a hash. Its first and last
    tokens are the prefixes of that order and of its reverse."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text", BATCH):
            who, tokens, sizes = sets(*text_bytes(batch.column(1)), width)
            order = np.lexsort((tokens * _NEXT, who))
            who, tokens = who[order], tokens[order].view(np.int64)
            rank = np.arange(len(who)) - (np.cumsum(sizes) - sizes)[who]
            most = sizes - (sizes * percent + 99) // 100 + 1
            part = np.where(rank < most[who], 0, np.where(rank >= (sizes - most)[who], 2, 1))
            lists = [_lists(tokens[part == k], np.bincount(who[part == k], minlength=len(sizes))) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *lists], ["node", "n", "head", "body", "tail"])

    return docs.select("node", "_text").mapInArrow(work, "node bigint, n int, head array<bigint>, body array<bigint>, tail array<bigint>")


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """The least number of common tokens of two similar sets."""
    return F.ceil((na + nb) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def _possible(na: Column, nb: Column, pa_: Column, pb: Column, percent: int) -> Column:
    """Whether sizes and the positions of a common token leave enough tokens to share."""
    need = _needed(na, nb, percent)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (na - pa_ >= need) & (nb - pb >= need)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets share a token in both hash orders' prefixes and are similar."""
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = stored(nodes.join(needed, "node", "left_semi").select("node", "hash"))
    # Needed texts grow with the corpus: joined by a shuffle at every size. Copies of a text are combined in each task.
    texts = docs.select("hash", "_text").join(needed.hint("merge"), "hash").groupBy("node").agg(F.min("_text").alias("_text"))
    whole = stored(_whole(texts, width, percent))

    def beside(pairs: DataFrame, columns: list[str]) -> DataFrame:
        for side in "ab":
            half = whole.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
            pairs = pairs.join(half, side)
        return pairs

    # Sets too small for three parts have their last tokens in the head.
    tail = lambda s: F.when(F.size(f"tail_{s}") < F.size(f"head_{s}"), F.concat(f"head_{s}", f"tail_{s}")).otherwise(F.col(f"tail_{s}"))
    met = beside(pairs, ["head", "tail"]).where(F.arrays_overlap("head_a", "head_b") & F.arrays_overlap(tail("a"), tail("b"))).select("a", "b")
    both = beside(stored(met), ["head", "body", "tail", "n"])
    common = F.size(F.array_intersect(F.concat("head_a", "body_a", "tail_a"), F.concat("head_b", "body_b", "tail_b")))
    found = stored(both.where(common * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b"))
    dropped(whole)
    dropped(needed)
    return found


def linked(nodes: DataFrame, docs: DataFrame, postings: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root) for the nodes that are linked to others. ``postings`` is what ``prefixes`` returns, stored; it is
    dropped when the tokens that sets share are known."""
    posting = postings.select("node", "n", F.posexplode("tokens").alias("pos", "token"))
    lists = posting.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("token")
    shared = stored(posting.join(lists, "token"))
    dropped(postings)
    members = stored(shared.join(shared.groupBy("token").agg(F.min(F.struct("pos", "n", "node")).alias("lead")), "token"))
    dropped(shared)
    leads = members.select(F.col("lead.node").alias("a"), F.col("lead.n").alias("na"), F.col("lead.pos").alias("pa"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))

    def paired(rows: DataFrame) -> DataFrame:
        rows = rows.where("a <> b").where(_possible(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"), percent))
        return stored(rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    star = paired(leads)
    edges = verified(star, nodes, docs, width, percent)
    roots = stored(components(edges))
    # What is left: pairs of a list in different components. One of the two is outside the leader's.
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named.select("token", "node", "n", "pos", "root", F.col("lead.node").alias("leader")))
    dropped(members)
    of = named.where("node = leader").select("token", F.col("root").alias("of")).distinct()
    outside = stored(named.join(of, "token").where("root <> of").select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("root").alias("ra")))
    if outside.isEmpty():
        return roots
    rest = outside.join(named.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("root").alias("rb")), "token").where("ra <> rb")
    rest = stored(paired(rest).join(star, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return roots
    more = verified(rest, nodes, docs, width, percent)
    return roots if more.isEmpty() else stored(components(edges.unionByName(more)))


def cluster(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 4, percent: int = 85, empty: str = "apart") -> DataFrame:
    """(doc_id, n, component_id) for every row of ``docs``: the size of its set and its component."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"))
    made = stored(described(own, width))
    rows = made.where("_row is null").select("doc_id", "hash", "node", "n")
    nodes = stored(rows.where("n > 0").groupBy("node").agg(F.min("hash").alias("hash"), F.min("doc_id").alias("least")))
    postings = stored(prefixes(own, width, percent, levels(made)))
    roots = linked(nodes, own, postings, width, percent)
    named = stored(nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = stored(named.join(smallest, "root").select("node", "component_id"))
    full = rows.where("n > 0").join(final, "node").select("doc_id", "n", "component_id")
    none = rows.where("n = 0")
    if empty == "alike":
        none = none.join(F.broadcast(none.groupBy("n").agg(F.min("doc_id").alias("component_id"))), "n")  # one row
    else:
        none = none.withColumn("component_id", F.col("doc_id"))
    return full.unionByName(none.select("doc_id", "n", "component_id"))
