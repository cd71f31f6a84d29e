"""Queries over literals and events: catalog, fallback, gates, retries, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import errors
from lodestar.functions import timefn
from lodestar.operators import control, relation
from lodestar.queries.base import golden, query, quoted, rendered, table
from lodestar.sources import registry

ALL = registry.TEXT + registry.IMAGES
CATALOG = "c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(e.name)}, {quoted(e.kind)}, {quoted(','.join(e.aliases))})" for i, e in enumerate(ALL)) + ") t(position, name, kind, aliases))"


@query(f"WITH {CATALOG} SELECT * FROM c")
def engine_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.catalog(spark).select("position", "name", "kind", F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH {CATALOG}, q AS (SELECT unnest(['ddg', 'x', 'wiki', 'bing', 'so', 'nope']) AS asked) SELECT asked, c.name FROM q LEFT JOIN c ON c.kind <> 'image' AND (c.name = asked OR list_contains(string_split(c.aliases, ','), asked))")
def engine_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(x,) for x in ("ddg", "x", "wiki", "bing", "so", "nope")], "asked string")
    c = registry.catalog(spark).where("kind <> 'image'").select("name", F.explode(F.array_append("aliases", F.col("name"))).alias("alias"))
    return asked.join(F.broadcast(c), F.col("asked") == F.col("alias"), "left").select("asked", "name")


@query(f"WITH {CATALOG}, w AS (SELECT * FROM c WHERE kind <> 'image') SELECT a.name AS engine, row_number() OVER (PARTITION BY a.name ORDER BY a.name <> b.name, b.position) AS priority, b.name AS candidate FROM w a JOIN w b ON a.name = b.name OR (a.kind = 'web' AND b.kind = 'web')")
def fallback_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.fallback_order(registry.catalog(spark).where("kind <> 'image'"))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 5 == 0, "http").when(F.col("event_id") % 11 == 0, "config")
    return e.select(
        F.floor(F.col("event_id") / 3).cast("bigint").alias("request_id"), (F.col("event_id") % 3).alias("priority"), F.concat(F.lit("e"), F.col("event_id") % 3).alias("engine"),
        F.when(kind.isNull(), F.col("event_id") % 4).otherwise(0).alias("n_results"), kind.alias("kind"),
    )


ATTEMPTS = "a AS (SELECT event_id // 3 AS request_id, event_id % 3 AS priority, 'e' || event_id % 3 AS engine, event_id % 4 AS n, CASE WHEN event_id % 5 = 0 THEN 'http' WHEN event_id % 11 = 0 THEN 'config' END AS kind FROM events)"


@query(
    f"WITH {ATTEMPTS}, o AS (SELECT *, CASE WHEN (kind IS NULL AND n > 0) OR kind = 'config' THEN priority WHEN kind IS NOT NULL THEN 100 - priority ELSE 200 + priority END AS k FROM a) "
    "SELECT request_id, first(engine ORDER BY k) AS engine, first(kind ORDER BY k) AS kind FROM o GROUP BY request_id"
)
def fallback_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.fallback_resolve(_attempts(spark, sf_dir))


@query(f"WITH {ATTEMPTS} SELECT request_id, priority, kind = 'http' AS retryable FROM a WHERE kind IS NOT NULL")
def error_retryable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts(spark, sf_dir).where("kind is not null").select("request_id", "priority", errors.is_retryable("kind").alias("retryable"))


golden("error_classify", [("lookup: refusing to connect to 192.168.3.3", "blocked_by_policy"), ("connection reset", "network"), ("too many redirects", "blocked_by_policy")], errors.of_transport)
golden(
    "error_render",
    [("http|418", "HTTP 418 from upstream"), ("parse|no list", "failed to parse response: no list"), ("response_too_large|77", "response exceeded the 77-byte limit"), ("no_results|nothing left", "nothing left"), ("strange|x", None)],
    lambda c: errors.render(F.get(F.split(c, r"\|"), F.lit(0)), F.get(F.split(c, r"\|"), F.lit(1))),
)


@query("SELECT event_id, CASE WHEN s IN (202, 429) THEN 'rate_limited' WHEN s NOT BETWEEN 200 AND 299 THEN 'http' END AS api, CASE WHEN s IN (202, 403, 429) THEN 'rate_limited' WHEN s NOT BETWEEN 200 AND 299 THEN 'http' END AS scrape, s IN (202, 429, 500, 502, 503, 504) AS retry FROM (SELECT event_id, 200 + event_id % 310 AS s FROM events)")
def status_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (200 + F.col("event_id") % 310).cast("int")
    return table(spark, sf_dir, "events").select("event_id", errors.of_status(s).alias("api"), errors.of_status(s, scraped=True).alias("scrape"), errors.status_retryable(s).alias("retry"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    return p.select(
        "page_id", F.when(k % 7 == 0, F.lit("http://127.0.0.1/")).otherwise(F.col("url")).alias("url"), (k % 5 != 0).alias("robots_allowed"), (k % 4 == 0).alias("cached"),
        F.when(k % 6 == 0, 404).otherwise(200).alias("status"), F.when(k % 9 == 0, "application/pdf").otherwise("text/html").alias("content_type"),
    )


GATE = "g AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'blocked_by_policy' WHEN page_id % 5 = 0 THEN 'robots' WHEN page_id % 4 = 0 THEN 'cached' WHEN page_id % 6 = 0 THEN 'http' WHEN page_id % 9 = 0 THEN 'unsupported_content_type' ELSE 'fetch' END AS gate FROM pages)"


@query(f"WITH {GATE} SELECT page_id, gate FROM g")
def fetch_gate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.gate(_requests(spark, sf_dir)).select("page_id", "gate")


@query(f"WITH {GATE} SELECT count(*) AS n, count(*) FILTER (gate NOT IN ('fetch', 'cached')) AS failed, TRUE AS any_failed, FALSE AS all_failed FROM g")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = control.gate(_requests(spark, sf_dir))
    return control.batch_summary(gated.withColumn("kind", F.when(~F.col("gate").isin("fetch", "cached"), F.col("gate"))))


@query(f"WITH {GATE} SELECT page_id, CASE WHEN gate IN ('fetch', 'cached') THEN NULL ELSE gate END AS kind FROM g")
def batch_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch keeps its order and every item, failed or not."""
    gated = control.gate(_requests(spark, sf_dir))
    return gated.select("page_id", F.when(~F.col("gate").isin("fetch", "cached"), F.col("gate")).alias("kind"))


@query("WITH s AS (SELECT user_id % 400 AS step, bool_and(event_type = 'error') AS failed FROM events GROUP BY 1) SELECT count(*) AS steps, count(*) FILTER (failed) AS failed_steps, bool_and(failed) AS all_failed FROM s")
def recipe_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").select((F.col("user_id") % 400).alias("step"), F.when(F.col("event_type") == "error", "http").alias("kind"))
    return control.step_verdict(items)


@query("SELECT event_id, CAST(least(400 * pow(2, least(event_id % 15, 10)), 8000) AS BIGINT) AS cap_ms FROM events")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", control.backoff_ms(F.col("event_id") % 15).alias("cap_ms"))


@query(
    "WITH c AS (SELECT event_id % 15 AS attempt, CAST(least(400 * pow(2, least(event_id % 15, 10)), 8000) AS BIGINT) AS cap FROM events), n AS (SELECT attempt, cap, count(*) AS n FROM c GROUP BY ALL) "
    "SELECT attempt, n, CAST(0 AS BIGINT) AS outside, n >= 200 AS low, n >= 200 AS high, n >= 200 AS even FROM n"
)
def backoff_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits of each attempt: none outside [0, cap]; of many, some in its lowest and its highest tenth, half below its half."""
    n = F.col("event_id") % 15
    waits = table(spark, sf_dir, "events").select(n.alias("attempt"), (control.backoff_wait_ms(n, F.col("event_id")) / control.backoff_ms(n)).alias("share"))
    share, many = F.col("share"), F.count("*") >= 200
    outside = F.count_if((share < 0) | (share > 1)).alias("outside")
    even = F.abs(F.avg((share < 0.5).cast("double")) - 0.5) < 0.15
    return waits.groupBy("attempt").agg(F.count("*").alias("n"), outside, (many & (F.min("share") < 0.1)).alias("low"), (many & (F.max("share") > 0.9)).alias("high"), (many & even).alias("even"))


golden(
    "retry_after_parse",
    [("12", 12), ("60", 60), ("3600", None), ("Tue, 03 Mar 2026 11:20:45 GMT", 25), ("Tue, 03 Mar 2026 10:00:00 GMT", 0), ("later", None)],
    lambda c: control.retry_after_s(c, F.lit("2026-03-03 11:20:20").cast("timestamp")),
    "bigint",
)


@query(
    "WITH q AS (SELECT user_id % 8 AS lane, event_id AS _seq, CAST(floor(epoch_ms(ts) / 1000) AS BIGINT) * 10 % 100000 AS arrival_ms FROM events), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY _seq) AS i FROM q) SELECT lane, _seq, max(arrival_ms - i * 300) OVER (PARTITION BY lane ORDER BY _seq) + i * 300 AS slot_ms FROM n"
)
def pacing_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    asked = e.select((F.col("user_id") % 8).alias("lane"), F.col("event_id").alias("_seq"), (seconds * 10 % 100000).alias("arrival_ms"))
    return control.pacing(asked, 300).select("lane", "_seq", "slot_ms")


@query("SELECT t.id AS template_id, p.pos, replace(t.q, '${item}', p.item) AS query FROM (VALUES (1, 'about ${item}'), (2, '${item} news')) t(id, q), (SELECT p_partkey AS pos, p_brand AS item FROM part) p")
def for_each_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame([(1, "about ${item}"), (2, "${item} news")], "template_id int, query string")
    items = table(spark, sf_dir, "part").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("template_id"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("item"))
    return relation.expand(templates, items).select("template_id", "pos", "query")


def _template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.plans.recipe import substitute

    cases = ["${a} and ${b}", "$$5 ${a}", "${n}", "plain"]
    made = [(i, str(substitute(c, {"a": "x", "b": "y", "n": 7}))) for i, c in enumerate(cases)]
    return spark.createDataFrame(made, "n int, result string")


query("SELECT * FROM (VALUES (0, 'x and y'), (1, '$5 x'), (2, '7'), (3, 'plain')) t(n, result)", "template_expand")(_template)

golden("ts_unix", [(1700000000, "2023-11-14T22:13:20+00:00"), (0, None), (-77, None)], lambda c: _utc(timefn.unix(c)), given="bigint")


def _utc(c):  # noqa: ANN001, ANN202
    """As text in UTC whatever the session's zone."""
    return timefn.render(F.to_utc_timestamp(c, F.current_timezone()))


golden("ts_rfc2822", [("Tue, 03 Mar 2026 11:20:45 +0000", "2026-03-03T11:20:45+00:00"), ("3 Mar 2026 06:20:45 -0500", "2026-03-03T11:20:45+00:00"), ("Tue, 03 Mar 2026 11:20:45 GMT", "2026-03-03T11:20:45+00:00"), ("in March", None)], lambda c: _utc(timefn.rfc2822(c)))
golden("ts_pubmed", [("2018 Oct 17", "2018-10-17"), ("1999", "1999-01-01"), ("2018 Oct", "2018-10-01"), ("Summer 2017", "2017-06-01"), ("undated", None), ("2018 Xyz", None), ("2018 Jun 31", None)], lambda c: F.date_format(timefn.pubmed(c), "yyyy-MM-dd"))
golden("ts_date_parts", [("2016,11", "2016-11-01"), ("", None), ("2016,14", None), ("2015", "2015-01-01"), ("2016,2,29", "2016-02-29"), ("2015,2,29", None)], lambda c: F.date_format(timefn.date_parts(F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("bigint"))), "yyyy-MM-dd"))
golden("ts_iso_cases", [("2025-01-31T23:30:00-01:00", "2025-02-01T00:30:00+00:00"), ("31 Jan", None), ("2025", None), ("2025-01", None)], lambda c: _utc(timefn.iso(c)))


@query(f"SELECT event_id, {rendered('ts')} AS iso, {rendered('ts')} AS feed FROM events")
def ts_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return table(spark, sf_dir, "events").select("event_id", timefn.render(timefn.iso(text)).alias("iso"), timefn.render(timefn.feed_date(text)).alias("feed"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at FROM events")
def ts_social(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy"))
    return table(spark, sf_dir, "events").select("event_id", _utc(timefn.social(text)).alias("at"))


@query(f"SELECT event_id, {rendered('ts')} AS at FROM events")
def render_rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", timefn.render(F.col("ts").cast("timestamp")).alias("at"))
