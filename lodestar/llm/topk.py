"""Exact top-k search over integer inner products, by norm buckets.

Vectors are grouped by length (quantiles of the norm, large groups split by a hash of the id).
All queries meet the bucket of the longest vectors first; the k-th best product they find there goes
with them, and they are sent on only to buckets whose longest vector could reach it. A block of
queries meets a part of a bucket in one task, which sorts its vectors by length and walks them
from the longest, keeping each query's k-th best product. From it follows a local cosine threshold
for the vectors still to come: where it is over 1 the query is done (length pruning), where it is
high only vectors whose coordinates lie in the feasible range of the query's strongest ones are
kept (coordinate pruning), and what remains is verified by exact products.

Defined results: vectors that are null, or hold a null or non-finite component, take no part, nor do
rows with a null id. Vectors shorter than others count as ending in zeros. Rows that repeat an id
are vectors of their own: each is a candidate of every row but itself, and a query if its id is one. Ties go to the smaller id; fewer than k rows give what there is.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import stored

STEP = 1024
COORDINATE_AT = 0.8
QUERY_BLOCK = 2048
BUCKET_MOST = 16_384
BUCKETS = 16
NONE = -(1 << 62)  # below any product; its negative exists


def quantised(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v, norm): floor(scale * x) of each component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~bad)
    v = F.transform(embedding, lambda x: F.floor(scale * x.cast("double")).cast("bigint"))
    one = good.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"))
    return one.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), width), np.int64)
    out[np.repeat(np.arange(len(rows)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products: in floating point where no sum can leave its whole numbers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def _best(who: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -score, who))
    who, ids, score = who[order], ids[order], score[order]
    first = np.searchsorted(who, who, "left")
    keep = np.arange(len(who)) - first < k
    return who[keep], ids[keep], score[keep]


def search(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, known: np.ndarray | None = None, same: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, id, score) of the k best of ``c`` for each row of ``q``, itself left out;
    those under the query's ``known`` score need not be found. ``same`` names the rows of ``q`` and of ``c``
    where ids may repeat."""
    query_rows, rows = same or (query_ids, ids)
    length = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -length))
    ids, rows, c, length = ids[order], rows[order], c[order], length[order]
    size = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    floor = np.full(len(q), -np.inf) if known is None else known.astype(np.float64)  # k-th best so far
    who = found = score = np.zeros(0, np.int64)
    slack = 1 + 1e-9
    for a in range(0, len(c), STEP):
        part, own, lengths, named = c[a : a + STEP], ids[a : a + STEP], length[a : a + STEP], rows[a : a + STEP]
        live = np.flatnonzero(size * lengths[0] * slack + 1e-6 >= floor)
        if not len(live):
            break  # all others are shorter still
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = floor[live] / (size[live] * lengths[0])
        products = None
        if np.isfinite(cosine).all() and len(cosine) and np.median(cosine) >= COORDINATE_AT:
            t = np.clip(cosine / slack - 1e-9, 0, 1)
            unit, units = q[live] / size[live, None], part / np.maximum(lengths, 1e-300)[:, None]
            near = np.ones((len(live), len(part)), bool)
            for f in np.argsort(-np.abs(unit), axis=1)[:, :2].T:
                at = unit[np.arange(len(live)), f]
                reach = np.sqrt(np.maximum((1 - t * t) * (1 - at * at), 0)) + 1e-9
                # The cap around a query may hold the axis itself, or its opposite.
                high, low = np.where(at >= t, 1 + 1e-9, at * t + reach), np.where(at <= -t, -1 - 1e-9, at * t - reach)
                near &= (units[:, f].T <= high[:, None]) & (units[:, f].T >= low[:, None])
            if near.mean() < 0.1:
                i, j = np.nonzero(near)
                products = np.full(near.shape, NONE)
                products[i, j] = np.einsum("ij,ij->i", q[live[i]], part[j])
        if products is None:
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.nanmin(np.where(size[live] > 0, floor[live] / (size[live] * slack), -np.inf))
            n = max(1, int(np.searchsorted(-lengths, -(least - 1e-6), "right"))) if np.isfinite(least) else len(part)
            part, own, named = part[:n], own[:n], named[:n]
            products = _products(q[live], part)
        products[named[None, :] == query_rows[live][:, None]] = NONE
        if products.shape[1] > k:
            level = -np.partition(-products, k - 1, axis=1)[:, k - 1]
            i, j = np.nonzero((products >= np.maximum(level, floor[live])[:, None]) & (products > NONE))
        else:
            i, j = np.nonzero((products >= floor[live][:, None]) & (products > NONE))
        who, found, score = _best(np.concatenate((who, live[i])), np.concatenate((found, own[j])), np.concatenate((score, products[i, j])), k)
        ends = np.searchsorted(who, np.arange(len(q)), "right")
        full = ends - np.searchsorted(who, np.arange(len(q)), "left") >= k
        floor[full] = np.maximum(floor[full], score[ends[full] - 1])
    return who, found, score


def top_k(vectors: DataFrame, *, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by ``every``.
    ``vectors`` comes from ``quantised``; each query meets each bucket once, in blocks."""
    rows = stored(vectors.withColumn("row", F.monotonically_increasing_id()))
    n, width, asked = rows.agg(F.count("*"), F.max(F.size("v")), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first()
    width = max(width or 0, 1)
    cuts = sorted({float(x) for x in rows.approxQuantile("norm", [i / BUCKETS for i in range(1, BUCKETS)], 0.01)}) if n else []
    bucket = F.size(F.filter(F.array(*(F.lit(x) for x in cuts)), lambda x: x < F.col("norm"))) if cuts else F.lit(0)
    most = min(BUCKET_MOST, max(256, ceil(n / 32)))
    # One row for each of at most BUCKETS buckets: how many parts it has, and where they start.
    parts, at = {}, 0
    for b, size, longest in sorted(rows.groupBy(bucket.alias("b")).agg(F.count("*"), F.max("norm")).collect()):
        parts[b] = (at, ceil(size / most), longest)
        at += parts[b][1]
    groups = max(1, ceil(asked / QUERY_BLOCK))
    start, count = F.lit(0), F.lit(1)
    for b, (first, m, _) in parts.items():
        start, count = F.when(bucket == b, first).otherwise(start), F.when(bucket == b, m).otherwise(count)
    part = (start + F.pmod(F.xxhash64("row", F.lit("part")), count)).cast("int")
    candidates = rows.select("row", "vec_id", "v", bucket.alias("bucket"), part.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    group = F.pmod(F.xxhash64("row", F.lit("group")), F.lit(groups)).cast("int")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("row", "vec_id", "v", "norm", group.alias("group"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids, ids = (t.column("vec_id").to_numpy() for t in (left, right))
        query_rows, rows = (t.column("row").to_numpy() for t in (left, right))
        if len(query_ids) and len(ids):
            known = left.column("floor").to_numpy()
            who, found, score = search(query_ids, _matrix(left.column("v"), width), ids, _matrix(right.column("v"), width), k, known, (query_rows, rows))
        else:
            who = found = score = np.zeros(0, np.int64)
        return pa.table({"query_row": pa.array(query_rows[who], pa.int64()), "query_id": pa.array(query_ids[who], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())})

    def met(asking: DataFrame, kept: Column) -> DataFrame:
        return asking.groupBy("group", "block").cogroup(candidates.where(kept).groupBy("group", "block")).applyInArrow(work, "query_row bigint, query_id bigint, vec_id bigint, score bigint")

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def blocks(b: int) -> Column:
        return F.explode(F.sequence(F.lit(parts[b][0]), F.lit(parts[b][0] + parts[b][1] - 1))).alias("block")

    if not parts:
        return ranked(met(queries.withColumns({"floor": F.lit(0.0), "block": F.lit(0)}), F.lit(True))).select("query_id", "rank", "vec_id", "score")
    longest = max(parts)
    best = stored(ranked(met(queries.select("row", "vec_id", "v", "group", F.lit(float("-inf")).alias("floor"), blocks(longest)), F.col("bucket") == longest)))
    floor = best.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("floor"))
    asking = stored(queries.join(floor, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
    # The blocks of every other bucket that a query could still gain from.
    none = F.array().cast("array<int>")
    useful = [F.when(F.col("norm") * top * (1 + 1e-9) + 1e-6 >= F.col("floor"), F.sequence(F.lit(first), F.lit(first + m - 1))).otherwise(none) for b, (first, m, top) in parts.items() if b != longest]
    if not useful:
        return best.select("query_id", "rank", "vec_id", "score")
    others = met(asking.select("row", "vec_id", "v", "group", "floor", F.explode(F.flatten(F.array(*useful))).alias("block")), F.col("bucket") != longest)
    return ranked(best.drop("rank").unionByName(others)).select("query_id", "rank", "vec_id", "score")
