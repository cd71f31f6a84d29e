"""Row functions for SQL sessions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from lodestar.functions import text, web
from lodestar.sources import parsers

FUNCTIONS = {
    "split_passages": text.split_passages_rows,
    "split_long": text.split_long_rows,
    "unescape_entities": text.unescape_entities,
    "sanitize_name": text.sanitize_name,
    "parse_robots": web.parse_robots,
    "feed_entries": parsers._feed,
}


class PassagesOf:
    """``passages_of(TABLE(t) PARTITION BY doc_id)``: the passages of rows (doc_id, text), numbered through a partition."""

    def __init__(self) -> None:
        self.n = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        for p in text.split_passages_text(row["text"] or ""):
            yield row["doc_id"], self.n, p
            self.n += 1


class FeedOf:
    """``feed_of(body)``: the entries of a feed; a body that is no feed has none."""

    def eval(self, body: str) -> Iterator[tuple]:
        for i, e in enumerate(parsers.feed_entries(body or "") or [], 1):
            yield i, e["title"], e["link"], e["summary"], e["published"]


TABLES = {
    "passages_of": (PassagesOf, "doc_id bigint, idx int, passage string"),
    "feed_of": (FeedOf, "place int, title string, link string, summary string, published string"),
}


def register(spark: SparkSession) -> None:
    """Make the functions and table functions known to the session's SQL under their names."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f.made())
    for name, (rows, schema) in TABLES.items():
        spark.udtf.register(name, udtf(rows, returnType=schema))
