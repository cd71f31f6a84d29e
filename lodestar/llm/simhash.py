"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Words are lower-cased (A-Z) runs of non-blank bytes; every shingle of three words votes with the
bits of its XXH64 (seed 42). Fingerprints that differ in at most two bits share at least six of
their eight positional bytes. The index posts a fingerprint under its bytes at four positions, for
each of the 14 BLOCKS of positions: every three positions are in exactly one block, so two
fingerprints that share 4, 5, 6, 7 or 8 positional bytes meet in at most 1, in 1, 3, 7 or 14 lists.
Meetings are tallied for each pair; the pairs that reach the guaranteed 3, those that share six bytes,
are kept and verified bit by bit.

Lists over ``LIST_MOST`` fingerprints are not paired up: each member posts its variants with one bit of
the other four bytes flipped, and fingerprints that meet in a variant are at most two bits apart, or
two that are within two bits always meet; one link to the smallest member of a meeting stands for
all. So a pair is either tallied in all of its lists or linked through a long one.

Defined results: a text without words (null too) has fingerprint zero and is linked like any other.
Equal fingerprints form one class before the index is built, so copies never make pairs. Rows
whose id is null take part and have a null id in the result; a component's id is the smallest
non-null id in it (null if it has none). Repeated rows each give a row. Extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checkpoint_dir, small_batches, stored, widened, without

LIST_MOST = 24
DISTANCE = 2
#: Every four of the eight byte positions whose numbers cancel out by exclusive or.
BLOCKS = tuple(c for c in combinations(range(8), 4) if not c[0] ^ c[1] ^ c[2] ^ c[3])
MASKS = tuple(sum(0xFF << 8 * i for i in c) for c in BLOCKS)
#: Lists that two fingerprints with 8 - DISTANCE equal positional bytes meet in, at least.
MEETINGS = 3


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint of a text, by definition; ``fingerprints`` gives the same for many."""
    words = text.lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    return _vote(np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64))


def _vote(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text: str = "text", width: int = 3, into: str = "fp") -> DataFrame:
    """Every row of ``docs`` with its fingerprint as a signed 64-bit number in ``into``; the text is left out."""
    data = without(docs.withColumn("_simhash_text", F.col(text)), text, into)
    schema = widened(data.drop("_simhash_text").schema, **{into: "long"})

    def one(data: bytes) -> int:
        words = data.lower().split()
        n = len(words) - width + 1
        if n < 2:
            return xxhash.xxh64_intdigest(b" ".join(words), 42) if words else 0
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)]
        return _vote(np.array(hashes, np.uint64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_simhash_text", 4 << 20):
            values = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            found = np.array([one(v or b"") for v in values], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*batch.schema.names[:-1], into])

    return data.mapInArrow(work, schema)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(prints: DataFrame, column: str = "fp") -> DataFrame:
    """Links (a, b) between different fingerprints at most two bits apart: enough of them to
    connect all that are linked, and no pair of a long posting list twice over."""
    one = prints.select(F.col(column).alias("fp")).distinct()
    posting = one.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in MASKS))).alias("slot", "bytes"))
    posting = stored(posting)
    lists = stored(posting.groupBy("slot", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    short = posting.join(lists.where(F.col("n") <= LIST_MOST), ["slot", "bytes"]).select("slot", "bytes", "fp")
    met = short.select("slot", "bytes", F.col("fp").alias("a")).join(short.select("slot", "bytes", F.col("fp").alias("b")), ["slot", "bytes"]).where("a < b")
    tally = met.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= MEETINGS)
    met = tally.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    # Long lists: variants of the bytes outside the list's own.
    flips = F.array(
        *(
            F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << b)) for b in range(64) if not m >> b & 1))
            for m in MASKS
        )
    )
    long = posting.join(lists.where(F.col("n") > LIST_MOST), ["slot", "bytes"]).select("fp", F.explode(F.get(flips, F.col("slot"))).alias("flip"))
    variant = long.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v")).distinct()
    # At most 65 fingerprints are one bit away from a variant, so a meeting is small.
    meeting = variant.groupBy("v").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    star = meeting.select("a", F.explode("all").alias("b")).where("a <> b")
    return met.unionByName(star).distinct()


def components(edges: DataFrame, checkpoint_every: int = 1) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node of its component.

    Alternates large-star and small-star until nothing changes; each step is an aggregate of
    minima (combined before the shuffle) and joins that the planner may split when a hub is hot.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(low, "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = e.select(F.col("v").alias("node")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        before = now


def cluster(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")), text="_t", width=width))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # Link classes by their smallest id: then a component's root is its smallest id. Null ids go last.
    near = stored(links(prints))
    roots = components(near)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = stored(named.join(smallest, "root").select("fp", "component_id"))
    return prints.join(final, "fp").select("doc_id", "fp", "component_id")
