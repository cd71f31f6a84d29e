"""Registration of queries with their SQL, and the relations that queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Literal cases by name: inputs and results, the function, the type of the input.
CASES: dict[str, tuple[list[tuple], Callable[[Column], Column], str]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def wrap(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return wrap


def quoted(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, int | float):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def golden(name: str, cases: list[tuple], fn: Callable[[Column], Column], kind: str = "string", given: str = "string") -> None:
    """Literal cases of a function: (input, result). They are tests; a query of the same name over a table follows in ``rules``."""
    CASES[name] = (cases, fn, given)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], f"n int, given {given}")
        return df.select("n", fn(F.col("given")).alias("result"))

    cast = {"string": "VARCHAR", "boolean": "BOOLEAN", "bigint": "BIGINT"}[kind]
    rows = ", ".join(f"({i}, CAST({quoted(c[1])} AS {cast}))" for i, c in enumerate(cases))
    query(f"SELECT * FROM (VALUES {rows}) t(n, result)", name)(run)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as result rows: URLs repeat, one kind of event is undated."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") + 1).alias("_seq"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("user_id")).alias("title"),
        F.concat(F.lit("https://s"), F.col("user_id") % 40, F.lit(".example.com/"), F.col("event_type"), F.lit("/"), F.col("user_id")).alias("url"),
        F.col("props").alias("snippet"),
        F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp")).alias("published"),
    )


ROWS = """r AS (SELECT event_id + 1 AS _seq, concat(event_type, ' ', user_id) AS title,
 concat('https://s', user_id % 40, '.example.com/', event_type, '/', user_id) AS url, props AS snippet,
 CASE WHEN event_type <> 'error' THEN ts END AS published FROM events)"""


def rendered(x: str) -> str:
    """SQL for a timestamp as RFC 3339."""
    return f"(strftime({x}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({x}, '%f') = '000000' THEN '' ELSE '.' || regexp_replace(strftime({x}, '%f'), '(000)+$', '') END || '+00:00')"


#: SQL for the first row of each URL.
FIRST = "d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY _seq) = 1)"
