"""Token counts by an exact length histogram.

Whole texts are encoded with a public byte-level vocabulary; documents are aggregated by encoded
length, and suffix sums over the histogram answer totals, quantiles and truncated totals for every
context limit without touching the documents again.

Defined results: null and empty texts have length 0 and are counted. An empty table gives an empty
histogram. Ties and repeated rows count once each. Other columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import small_batches, stored

TOKENIZER = os.environ.get("LODESTAR_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how the vocabulary's own tokenizer cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024


@lru_cache(2)
def encoder(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, *, text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """One row (n_tokens, n_docs) for each length within a task: summed before any shuffle.

    The driver reads the vocabulary (under 2 MB) and ships it, so executors need no such file.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()
    if len(vocabulary) > 16 << 20:
        raise ValueError("the vocabulary is too large to ship to every task")
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pattern))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(*shared.value)
        total: dict[int, int] = {}
        for batch in small_batches(batches, "_text"):
            found = [len(own.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()]
            for n, k in zip(*np.unique(found, return_counts=True), strict=True):
                total[int(n)] = total.get(int(n), 0) + int(k)
            if len(total) > 100_000:
                yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(total.keys(), pa.int64()), "n_docs": pa.array(total.values(), pa.int64())})
                total = {}
        if total:
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(total.keys()), pa.int64()), "n_docs": pa.array(list(total.values()), pa.int64())})

    return docs.select(F.col(text).alias("_text")).mapInArrow(work, "n_tokens bigint, n_docs bigint")


def histogram(docs: DataFrame, *, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each encoded length that occurs, with sums over it and all greater lengths.

    Suffix sums go by blocks of BLOCK lengths: within each block, plus the sum of the later blocks,
    so no window holds more than BLOCK rows or one row for each block.
    """
    hist = stored(lengths(docs, text=text, tokenizer=tokenizer).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))
    rows = hist.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_sum", F.col("n_tokens") * F.col("n_docs"))
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_sum").alias("_t"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_later_d"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_later_t"),
        F.sum("_d").over(whole).alias("_all_d"),
        F.sum("_t").over(whole).alias("_all_t"),
    )
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens"))
    found = rows.select(
        "_block", "n_tokens", "n_docs", F.sum("n_docs").over(inside).alias("_d"), F.sum("_sum").over(inside).alias("_t")
    ).join(blocks, "_block")
    at_least, tokens = F.col("_d") + F.col("_later_d"), F.col("_t") + F.col("_later_t")
    return found.select(
        "n_tokens",
        "n_docs",
        at_least.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (F.col("_all_t") - tokens + F.col("n_tokens") * at_least).alias("tokens_truncated"),
        F.col("_all_d").alias("docs_total"),
        F.col("_all_t").alias("tokens_total"),
        ((F.col("_all_d") - at_least + F.col("n_docs")) / F.col("_all_d")).alias("quantile"),
    )


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, tokens_kept, docs_cut) for any limits, from the histogram alone."""
    wanted = F.explode(F.array(*(F.lit(int(x)).cast("bigint") for x in limits)))
    cut = hist.select(wanted.alias("context_limit"), "n_tokens", "n_docs")
    return cut.groupBy("context_limit").agg(
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("tokens_kept"),
        F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
    )


def quantile(hist: DataFrame, share: float) -> int | None:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    return hist.where(F.col("quantile") >= share).agg(F.min("n_tokens")).first()[0]


