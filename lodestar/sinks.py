"""Documents, lines and files made of result rows."""

from __future__ import annotations

import os
import stat

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.errors import ConfigError
from lodestar.functions import timefn
from lodestar.functions.text import sanitize_line
from lodestar.operators.relation import renumber

KEEP_NULLS = {"ignoreNullFields": "false"}


def result_struct() -> Column:
    """One result as it is written: dates as text, nulls kept."""
    return F.struct("title", "url", "snippet", timefn.render("published").alias("published"))


DOCUMENT_MOST = 200


def as_json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), KEEP_NULLS)


def jsonl(rows: DataFrame) -> DataFrame:
    """One JSON object for each row, with its place."""
    return rows.select("_seq", F.to_json(result_struct(), KEEP_NULLS).alias("line"))


def _ordered(rows: DataFrame, item: Column, *by: str, **more: Column) -> DataFrame:
    """All rows of a document, or of one for each value of ``by``, in order, with their count.

    A document holds at most DOCUMENT_MOST rows: more are an error, not a larger document, and no more than
    one row beyond are gathered."""
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_seq"))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= DOCUMENT_MOST + 1)
    else:
        rows = rows.orderBy("_seq").limit(DOCUMENT_MOST + 1)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_seq", item.alias("item")))), lambda x: x["item"])
    refuse = F.raise_error(F.lit(f"a document holds at most {DOCUMENT_MOST} results; write them as jsonl"))
    made = rows.groupBy(*by).agg(F.count("*").alias("count"), listed.alias("results"), *(c.alias(n) for n, c in more.items()))
    return made.withColumn("results", F.when(F.col("count") <= DOCUMENT_MOST, F.col("results")).otherwise(refuse))


def search_doc(rows: DataFrame, query: str, engine: str) -> DataFrame:
    return _ordered(rows, result_struct()).select(as_json(F.lit(query).alias("query"), F.lit(engine).alias("engine"), "count", "results").alias("doc"))


def run_doc(rows: DataFrame) -> DataFrame:
    return _ordered(rows, result_struct()).select(as_json("count", "results").alias("doc"))


def images_doc(rows: DataFrame, query: str, engine: str, downloaded: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """``downloaded``: also how many of the rows have ``written``."""
    more = {"downloaded": F.count_if(F.coalesce("written", F.lit(False)))} if downloaded else {}
    made = _ordered(rows, F.struct("title", "url", "page_url", "width", "height", "format"), *by, **more)
    return made.select(*by, as_json(F.lit(query).alias("query"), F.lit(engine).alias("engine"), "count", "results", *more).alias("doc"))


def fetch_item() -> Column:
    """A fetched page, or the failure that stands for it."""
    page = F.to_json(F.struct("url", "title", "chars", "truncated", "text"), KEEP_NULLS)
    return F.when(F.col("kind").isNull(), page).otherwise(F.to_json(F.struct("url", F.col("text").alias("error"), "kind"), KEEP_NULLS))


def fetch_batch(rows: DataFrame) -> DataFrame:
    """(_seq, item) in order: the array of a batch, one line for each page."""
    return rows.select("_seq", fetch_item().alias("item"))


def fetch_doc(rows: DataFrame) -> DataFrame:
    """One document: the object of a single page, else the array of all, in order. The list of pages is the caller's."""
    made = _ordered(fetch_batch(rows), F.col("item")).withColumnRenamed("results", "items")
    return made.select(F.when(F.size("items") == 1, F.get("items", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))).alias("doc"))


def pretty(rows: DataFrame) -> DataFrame:
    """Numbered lines for people: title and date, URL, snippet."""
    date = F.coalesce(F.concat(F.lit("  ("), F.date_format("published", "yyyy-MM-dd"), F.lit(")")), F.lit(""))
    head = F.concat(F.lpad(F.col("_seq").cast("string"), 3, " "), F.lit(". "), sanitize_line("title"), date)
    return rows.select("_seq", F.concat_ws("\n", head, F.concat(F.lit("     "), sanitize_line("url")), F.concat(F.lit("     "), sanitize_line("snippet"))).alias("block"))


def output_mode(flag: str | None, recipe_format: str | None, to_file: bool, terminal: bool) -> str:
    """An explicit flag, the recipe's format, JSON for a file, else by terminal."""
    return flag or recipe_format or ("json" if to_file else ("pretty" if terminal else "json"))


def write_file(rows: DataFrame, path: str, fmt: str = "json") -> int:
    """A recipe's result in one file, private to its owner: a regular file is replaced, a link
    refused, no folder made. A JSON document holds at most 200 rows; lines are streamed."""
    if os.path.lexists(path) and not stat.S_ISREG(os.lstat(path).st_mode):
        raise ConfigError(f"{path} is not a regular file")
    if not os.path.isdir(os.path.dirname(os.path.abspath(path))):
        raise ConfigError(f"{path}: no such folder")
    if fmt == "json":
        if rows.limit(DOCUMENT_MOST + 1).count() > DOCUMENT_MOST:
            raise ConfigError(f"a document holds at most {DOCUMENT_MOST} results; write them as jsonl")
        text = (r.doc for r in run_doc(rows).toLocalIterator())
    elif fmt == "jsonl":
        text = (r.line for r in jsonl(rows).orderBy("_seq").toLocalIterator())
    else:
        text = (r.block for r in pretty(renumber(rows, None)).orderBy("_seq").toLocalIterator())
    part, n = f"{path}.part-{os.getpid()}", 0
    with os.fdopen(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        for n, x in enumerate(text, 1):
            f.write(x + "\n")
    os.replace(part, path)
    return n
