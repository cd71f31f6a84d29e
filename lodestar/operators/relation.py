"""Relational operators over result rows. Every relation carries its order in ``_seq``."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.errors import ConfigError

LIMIT_MOST, COUNT_MOST = 200, 50


def dedupe(rows: DataFrame, key: str = "url") -> DataFrame:
    """The first row of each key, by ``_seq``; partial minima are taken before the shuffle."""
    others = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*others), "_seq").alias("_row"))
    return first.select(key, "_row.*").select(*rows.columns)


def order_by(rows: DataFrame, sort: str | None) -> list[Column]:
    """Sort keys: url and title by bytes, date newest first and undated last; ties keep their order."""
    keys = {None: [], "url": [F.col("url")], "title": [F.col("title")], "date": [F.desc_nulls_last("published")]}
    if sort not in keys:
        raise ConfigError(f"unknown sort key '{sort}'")
    return [*keys[sort], F.col("_seq")]


def take(rows: DataFrame, n: int, sort: str | None = None) -> DataFrame:
    """The first n rows in order (sorted and cut at once in each task)."""
    return rows.orderBy(*order_by(rows, sort)).limit(n)


def dedupe_and_truncate(rows: DataFrame, count: int) -> DataFrame:
    return take(dedupe(rows), count)


def renumber(rows: DataFrame, sort: str | None) -> DataFrame:
    """Rows already cut to at most LIMIT_MOST, with ``_seq`` from 1 in sorted order."""
    return rows.withColumn("_seq", F.row_number().over(Window.orderBy(*order_by(rows, sort))).cast("bigint"))


def combine(rows: DataFrame, *, dedupe_rows: bool = True, sort: str | None = None, limit: int | None = None) -> DataFrame:
    """Dedupe, then sort, then limit."""
    if limit is not None and not 1 <= limit <= LIMIT_MOST:
        raise ConfigError(f"limit must be 1..{LIMIT_MOST}")
    out = dedupe(rows) if dedupe_rows else rows
    if limit is not None:
        return renumber(take(out, limit, sort), sort)
    return out.orderBy(*order_by(out, sort)) if sort else out


def in_window(published: Column, since: datetime | None, until: datetime | None) -> Column:
    """since <= published < until; undated rows never pass a bound."""
    tests = ([published >= F.lit(since)] if since else []) + ([published < F.lit(until)] if until else [])
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def time_window(rows: DataFrame, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    return rows.where(in_window(F.col("published"), since, until)) if since or until else rows


def time_window_counts(rows: DataFrame, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    kept = F.count_if(F.coalesce(in_window(F.col("published"), since, until), F.lit(False)))
    undated = F.count_if(F.col("published").isNull()) if since or until else F.lit(0).cast("bigint")
    return rows.agg(F.count("*").alias("total"), kept.alias("kept"), undated.alias("undated")).withColumn("outside", F.col("total") - F.col("kept") - F.col("undated"))


def union_steps(steps: list[DataFrame]) -> DataFrame:
    """Steps one after the other: order is (step, order inside it), packed into ``_seq``."""
    marked = [s.withColumn("_seq", F.lit(i).cast("bigint") * (1 << 40) + F.col("_seq")) for i, s in enumerate(steps)]
    return reduce(DataFrame.unionByName, marked)


def nth(rows: DataFrame, n: int) -> DataFrame:
    """The n-th result, from 1; no row if there are fewer."""
    return renumber(take(rows, n), None).where(F.col("_seq") == n)


def expand(template: DataFrame, items: DataFrame) -> DataFrame:
    """A step template for each of its items, item by item. ``items``: template_id, pos, item."""
    return template.join(items, "template_id").withColumn("query", F.replace("query", F.lit("${item}"), F.col("item")))
