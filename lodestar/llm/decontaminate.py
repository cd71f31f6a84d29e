"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

A text's tokens are lower-cased runs of letters and digits. A document overlaps an item where,
aligned token by token, some span of SPAN tokens holds at least SPAN - SUBSTITUTIONS equal ones (an
item shorter than SPAN must occur whole). Two fixed masks ignore chosen positions of a run of
tokens; every span with at most two substitutions leaves at least one mask untouched at some
offset, so hashing what the masks show, on both sides, and joining misses no overlap. Around each
hit the overlap is then counted token by token.

Items of fewer than SEEDED tokens have no room for a mask: the hash of the whole item is looked up among
those of all runs of its length.

Defined results: null and empty texts and items overlap nothing. ``overlaps`` reports items of any length
(``shortest``); ``clean`` keeps documents that hold no more than an item of fewer than SEEDED tokens, as so few
words occur in clean texts too. Repeated items or documents give one row for each
pair of ids. Null ids are kept. Texts of any length are read whole. ``overlaps`` reads no extra
columns; ``clean`` keeps them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import stored

SPAN, SUBSTITUTIONS, SEEDED = 13, 2, 7
#: Shown positions. Together they meet every way to put two substitutions into a span of 13.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))
WIDEST = max(m[-1] for m in MASKS) + 1
FIRST = (0, 1, 2)  # shown by every mask: looked up before the masks are hashed
#: Seeds of a benchmark, and hit documents, up to which they are sent to every task (about 24 bytes each).
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _hashed(text: Column | str) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _runs(df: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """keys, pos, and the hashes of the next WIDEST tokens as h0, h1, ... (null beyond the end)."""
    h = F.col(hashes)
    n = F.size(h)
    shifted = [F.slice(h, F.lit(k + 1), F.greatest(n - k, F.lit(0))).alias(f"h{k}") for k in range(WIDEST)]
    zipped = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("pos"), *shifted)
    return df.where(n >= SEEDED).select(*keys, F.inline(zipped)).toDF(*keys, "pos", *(f"h{k}" for k in range(WIDEST))).where("h6 is not null")


def _first() -> Column:
    return F.xxhash64(*(F.col(f"h{k}") for k in FIRST))


def _seeds() -> Column:
    return F.array(*(F.when(F.col(f"h{m[-1]}").isNotNull(), F.xxhash64(F.lit(i), *(F.col(f"h{k}") for k in m))) for i, m in enumerate(MASKS)))


def overlaps(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", shortest: int = 1) -> DataFrame:
    """(doc_id, text_hash, item_id, n_matched, n_tokens): for each document text and item of ``shortest`` tokens
    or more that overlap, the most equal tokens in a span, and the item's tokens."""
    known = benchmark.select(F.col(item_id).alias("item_id"), _hashed(item_text).alias("b")).where(F.size("b") >= shortest).distinct()
    known = stored(known.withColumn("item", F.monotonically_increasing_id()))
    items = known.where(F.size("b") >= SEEDED)
    seeds = _runs(items, ["item"], "b").select("item", F.col("pos").alias("item_pos"), _first().alias("first"), F.explode(_seeds()).alias("seed")).where("seed is not null")
    seeds = stored(seeds)
    sent = F.broadcast if seeds.count() <= BROADCAST_SEEDS else (lambda x: x)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text"))
    seen = _runs(own.select("doc_id", "text_hash", _hashed("_text").alias("h")), ["doc_id", "text_hash"], "h")
    seen = seen.withColumn("first", _first()).join(sent(seeds.select("first").distinct()), "first", "left_semi")
    seen = seen.select("doc_id", "text_hash", "pos", F.explode(_seeds()).alias("seed"))
    hits = seen.join(sent(seeds.select("seed", "item", "item_pos")), "seed").select("doc_id", "text_hash", "item", (F.col("pos") - F.col("item_pos")).alias("shift"))
    hits = hits.groupBy("doc_id", "text_hash", "item").agg(F.collect_set("shift").alias("shifts"))
    hits = stored(hits)
    told = hits.join(sent(items), "item").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item_id", "b", "shifts")).alias("hits"))
    told = told.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    # Texts without a hit need not travel.
    keys = hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    if hits.count() <= BROADCAST_SEEDS:
        own = own.join(F.broadcast(keys), own["text_hash"].eqNullSafe(keys["_hash"]) & own["doc_id"].eqNullSafe(keys["_id"]), "left_semi")
    texts = own.join(told, own["text_hash"].eqNullSafe(told["_hash"]) & own["doc_id"].eqNullSafe(told["_id"])).select("doc_id", "text_hash", _hashed("_text").alias("h"), "hits")

    def matched(b: Column, shift: Column) -> Column:
        equal = F.transform(b, lambda w, i: F.when(F.get(F.col("h"), i + shift) == w, 1).otherwise(0))
        return F.array_max(F.transform(equal, lambda _, i: F.aggregate(F.slice(equal, i + 1, F.lit(SPAN)), F.lit(0), lambda a, x: a + x)))

    def counted(hit: Column) -> Column:
        return F.array_max(F.transform(hit["shifts"], lambda shift: matched(hit["b"], shift)))

    found = texts.select("doc_id", "text_hash", F.inline(F.transform("hits", lambda x: F.struct(x["item_id"].alias("item_id"), counted(x).alias("n_matched"), F.size(x["b"]).alias("n_tokens")))))
    need = F.when(F.col("n_tokens") >= SPAN, F.lit(SPAN - SUBSTITUTIONS)).otherwise(F.col("n_tokens"))
    found = found.where(F.col("n_matched") >= need)
    short = known.where(F.size("b") < SEEDED)
    lengths = sorted(r.n for r in short.select(F.size("b").alias("n")).distinct().collect())  # of six at most
    if lengths:
        own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), _hashed(text).alias("h"))

        def runs_of(n: int) -> Column:
            return F.when(F.size("h") >= n, F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.xxhash64(F.slice("h", i + 1, F.lit(n)))))

        none = F.array().cast("array<bigint>")
        keyed = own.select("doc_id", "text_hash", F.explode(F.array_distinct(F.flatten(F.array(*(F.coalesce(runs_of(n), none) for n in lengths))))).alias("key"))
        few = short.select(F.xxhash64("b").alias("key"), "item_id", F.size("b").alias("n_matched"), F.size("b").alias("n_tokens"))
        send = F.broadcast if few.count() <= BROADCAST_SEEDS else (lambda x: x)
        found = found.unionByName(keyed.join(send(few), "key").drop("key"))
    return found.groupBy("doc_id", "text_hash", "item_id").agg(F.max("n_matched").alias("n_matched"), F.max("n_tokens").alias("n_tokens"))


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that overlap no item; the columns stay as they are."""
    bad = stored(overlaps(docs, benchmark, text=text, doc_id=doc_id, shortest=SEEDED).select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct())
    return docs.join(bad, F.xxhash64(docs[text]).eqNullSafe(bad["_bad_hash"]) & docs[doc_id].eqNullSafe(bad["_bad_id"]), "left_anti")
