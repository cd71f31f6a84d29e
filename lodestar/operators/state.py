"""Seen-sets (watch) and the response cache as joins and windows over state tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestar.operators.relation import dedupe

WATCH_MOST = 20_000
CACHE_ENTRIES, CACHE_BYTES, CACHE_TTL = 1000, 100 * 1024 * 1024, 3600


def filter_new(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose URL was never seen, each URL once."""
    return dedupe(rows.join(seen.select("url"), "url", "left_anti"))


def known(rows: DataFrame, seen: DataFrame) -> DataFrame:
    return rows.join(seen.select("url"), "url", "left_semi")


def record(seen: DataFrame, rows: DataFrame, watch: str, now: int) -> DataFrame:
    """State after writing ``rows``: the first sight of a URL is kept."""
    new = rows.select(F.lit(watch).alias("watch"), "url", F.lit(now).cast("bigint").alias("first_seen"))
    return seen.select("watch", "url", "first_seen").unionByName(new).groupBy("watch", "url").agg(F.min("first_seen").alias("first_seen"))


def evict_seen(seen: DataFrame, most: int = WATCH_MOST) -> DataFrame:
    """The newest ``most`` of each watch; the least (time, url) go."""
    rank = F.row_number().over(Window.partitionBy("watch").orderBy(F.desc("first_seen"), F.desc("url")))
    return seen.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def watch_list(seen: DataFrame) -> DataFrame:
    return seen.groupBy("watch").agg(F.count("*").alias("seen"), F.max("first_seen").alias("last_new"))


def is_expired(ts: Column | str, now: int, ttl: int) -> Column:
    """Age at least ``ttl``; 0 never expires."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.lit(False) if ttl == 0 else (F.lit(now) - ts >= ttl)


def lookup(requests: DataFrame, cache: DataFrame, now: int, ttl: int = CACHE_TTL) -> DataFrame:
    """Each request with its cached value and whether it hit; an undecodable value is a miss."""
    live = cache.where(~is_expired("ts", now, ttl)).where(F.col("value").isNotNull()).select("key", "value")
    return requests.join(live, "key", "left").withColumn("hit", F.col("value").isNotNull())


def evict(cache: DataFrame, now: int, ttl: int = CACHE_TTL, entries: int = CACHE_ENTRIES, most_bytes: int = CACHE_BYTES) -> DataFrame:
    """After expiry, the most recent entries that fit both budgets.

    At most ``entries`` rows can stay, so only that many (sorted and cut in each task) are summed."""
    if entries == 0:
        return cache.limit(0)
    order = [F.desc("seq"), F.desc("key")]
    live = cache.where(~is_expired("ts", now, ttl)).orderBy(*order).limit(entries)
    if most_bytes == 0:
        return live
    run = F.sum("bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return live.withColumn("_run", run).where(F.col("_run") <= most_bytes).drop("_run")


def put(cache: DataFrame, new: DataFrame, most_bytes: int = CACHE_BYTES) -> DataFrame:
    """Upsert entries that fit; results without rows are never stored."""
    fits = new.where((F.col("bytes") <= most_bytes) & F.col("value").isNotNull() & ~F.col("value").isin("[]", ""))
    return cache.join(fits.select("key"), "key", "left_anti").unionByName(fits.select(*cache.columns))


def merge(mine: DataFrame, disk: DataFrame) -> DataFrame:
    """Two writers: keys I touched win (deleted ones stay deleted), all else is the disk's.

    ``mine``: key, value, ts, seq, bytes, touched, deleted."""
    m, d = mine.alias("m"), disk.alias("d")
    own = F.coalesce(F.col("m.touched"), F.lit(False))
    gone = F.coalesce(F.col("m.deleted"), F.lit(False))
    both = m.join(d, F.col("m.key") == F.col("d.key"), "full_outer")
    pick = lambda c: F.when(own, F.col(f"m.{c}")).otherwise(F.col(f"d.{c}")).alias(c)
    return both.where(~gone & (own | F.col("d.key").isNotNull())).select(*(pick(c) for c in ("key", "value", "ts", "seq", "bytes")))


def touch(cache: DataFrame, hits: DataFrame, seq: int) -> DataFrame:
    """The cache with hit keys as the most recent, in the order of their keys' first use from ``seq`` on."""
    used = hits.where("hit").select("key").distinct().select(F.col("key").alias("_key"))
    return cache.join(used, F.col("key") == F.col("_key"), "left").withColumn("seq", F.when(F.col("_key").isNotNull(), F.greatest("seq", F.lit(seq))).otherwise(F.col("seq"))).drop("_key")


def entry_bytes(key: Column | str, value: Column | str) -> Column:
    """What an entry counts for: the bytes of its key and value."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("bigint")


def clear(cache: DataFrame, now: int | None = None, ttl: int = CACHE_TTL) -> DataFrame:
    """An empty cache, or with a time only expired entries gone."""
    return cache.limit(0) if now is None else cache.where(~is_expired("ts", now, ttl))


def decoded(answers: DataFrame, schema: str) -> DataFrame:
    """Answers of ``lookup`` with their values read as JSON; what cannot be read, or lacks a field that the
    schema declares NOT NULL or has it in another type, is a miss. If it declares none, an object without any
    of the fields is one."""
    kind = StructType.fromDDL(schema)
    needed = [f.name for f in kind if not f.nullable] or None
    loose = StructType([StructField(f.name, f.dataType) for f in kind])
    read = answers.withColumn("_read", F.from_json("value", loose, {"mode": "PERMISSIVE"}))
    found = [F.col("_read")[f.name].isNotNull() for f in kind if needed is None or f.name in needed]
    good = F.get_json_object("value", "$").isNotNull() & reduce(Column.__or__ if needed is None else Column.__and__, found)
    return read.withColumn("hit", F.col("hit") & F.coalesce(good, F.lit(False))).withColumn("value", F.when(F.col("hit"), F.col("_read"))).drop("_read")


def cache_info(cache: DataFrame, now: int, ttl: int = CACHE_TTL) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(is_expired("ts", now, ttl)).alias("expired"))
