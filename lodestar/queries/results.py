"""Queries over result rows: dedupe, sort, limit, windows, watches, cache and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import sinks
from lodestar.functions import text as T
from lodestar.functions import timefn
from lodestar.operators import relation, state
from lodestar.queries.base import FIRST, ROWS, golden, query, rendered, result_rows, table

OUT = "_seq, title, url, snippet, " + rendered("published") + " AS published"
SINCE, UNTIL = datetime(2024, 1, 8), datetime(2024, 1, 15)
BETWEEN = "published >= TIMESTAMP '2024-01-08' AND published < TIMESTAMP '2024-01-15'"
NOW = 1_706_000_000


def shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_seq").cast("bigint").alias("_seq"), "title", "url", "snippet", timefn.render("published").alias("published"))


@query(f"WITH {ROWS}, {FIRST} SELECT {OUT} FROM d")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(relation.dedupe(result_rows(spark, sf_dir)))


@query(f"WITH {ROWS}, {FIRST} SELECT {OUT} FROM d ORDER BY _seq LIMIT 50")
def dedupe_then_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(relation.dedupe_and_truncate(result_rows(spark, sf_dir), 50))


def _sorted(name: str, keys: str, sort: str) -> None:
    @query(f"WITH {ROWS}, {FIRST}, n AS (SELECT row_number() OVER (ORDER BY {keys}) AS k, * FROM d) SELECT k AS _seq, title, url, snippet, {rendered('published')} AS published FROM n WHERE k <= 100", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(relation.combine(result_rows(spark, sf_dir), sort=sort, limit=100))


_sorted("combine_sort_url", "url, _seq", "url")
_sorted("combine_sort_title", "title, _seq", "title")
_sorted("combine_sort_date", "published DESC NULLS LAST, _seq", "date")


@query(f"WITH {ROWS} SELECT {OUT} FROM r ORDER BY _seq LIMIT 200")
def combine_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(relation.combine(result_rows(spark, sf_dir), dedupe_rows=False, limit=200))


@query(
    f"WITH {ROWS}, u AS (SELECT 2 * _seq AS s, * FROM r WHERE title LIKE 'view%' UNION ALL SELECT 1000000000 + _seq, * FROM r WHERE title LIKE 'click%'), "
    f"f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY url ORDER BY s) = 1), n AS (SELECT row_number() OVER (ORDER BY title, s) AS k, * FROM f) "
    f"SELECT k AS _seq, title, url, snippet, {rendered('published')} AS published FROM n WHERE k <= 150"
)
def combine_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = result_rows(spark, sf_dir)
    steps = [r.where(F.col("title").startswith(x)) for x in ("view", "click")]
    return shown(relation.combine(relation.union_steps(steps), sort="title", limit=150))


@query(f"WITH {ROWS} SELECT CASE WHEN title LIKE 'view%' THEN 0 ELSE 1 END * 1099511627776 + _seq AS _seq, title, url FROM r WHERE title LIKE 'view%' OR title LIKE 'click%'")
def recipe_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = result_rows(spark, sf_dir)
    return relation.union_steps([r.where(F.col("title").startswith(x)) for x in ("view", "click")]).select("_seq", "title", "url")


@query(f"WITH {ROWS}, l AS (SELECT * FROM r ORDER BY _seq LIMIT 3000) SELECT {OUT} FROM l WHERE {BETWEEN}")
def limit_then_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(relation.time_window(relation.take(result_rows(spark, sf_dir), 3000), SINCE, UNTIL))


@query(f"WITH {ROWS} SELECT {OUT} FROM r WHERE {BETWEEN}")
def time_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(relation.time_window(result_rows(spark, sf_dir), SINCE, UNTIL))


@query(
    f"WITH {ROWS} SELECT count(*) AS total, count(*) FILTER ({BETWEEN}) AS kept, count(*) FILTER (published IS NULL) AS undated, "
    f"count(*) FILTER (published IS NOT NULL AND NOT ({BETWEEN})) AS outside FROM r"
)
def time_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation.time_window_counts(result_rows(spark, sf_dir), SINCE, UNTIL)


@query(f"WITH {ROWS}, n AS (SELECT row_number() OVER (ORDER BY _seq) AS k, * FROM r) SELECT k AS _seq, title, url FROM n WHERE k = 7")
def nth_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation.nth(result_rows(spark, sf_dir), 7).select("_seq", "title", "url")


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = result_rows(spark, sf_dir).where(F.col("published") < F.lit(datetime(2024, 1, 6)))
    return rows.select(F.lit("news").alias("watch"), "url", F.unix_timestamp("published").alias("first_seen")).groupBy("watch", "url").agg(F.min("first_seen").alias("first_seen"))


SEEN = "s AS (SELECT 'news' AS watch, url, min(CAST(floor(epoch(published)) AS BIGINT)) AS first_seen FROM r WHERE published < TIMESTAMP '2024-01-06' GROUP BY url)"
LATE = "n AS (SELECT * FROM r WHERE published >= TIMESTAMP '2024-01-06')"


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_rows(spark, sf_dir).where(F.col("published") >= F.lit(datetime(2024, 1, 6)))


@query(f"WITH {ROWS}, {SEEN}, {LATE} SELECT {OUT} FROM n WHERE url NOT IN (SELECT url FROM s) QUALIFY row_number() OVER (PARTITION BY url ORDER BY _seq) = 1")
def watch_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(state.filter_new(_late(spark, sf_dir), _seen(spark, sf_dir)))


@query(f"WITH {ROWS}, {SEEN}, {LATE} SELECT count(*) AS known FROM n WHERE url IN (SELECT url FROM s)")
def watch_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.known(_late(spark, sf_dir), _seen(spark, sf_dir)).agg(F.count("*").alias("known"))


@query(f"WITH {ROWS}, {SEEN}, {LATE}, u AS (SELECT * FROM s UNION ALL SELECT 'news', url, {NOW} FROM n) SELECT watch, url, min(first_seen) AS first_seen FROM u GROUP BY ALL")
def watch_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.record(_seen(spark, sf_dir), _late(spark, sf_dir), "news", NOW)


@query(f"WITH {ROWS}, {SEEN} SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY watch ORDER BY first_seen DESC, url DESC) <= 100")
def watch_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.evict_seen(_seen(spark, sf_dir), 100)


@query(f"WITH {ROWS}, {SEEN} SELECT watch, count(*) AS seen, max(first_seen) AS last_new FROM s GROUP BY watch")
def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.watch_list(_seen(spark, sf_dir))


@query(
    f"WITH {ROWS}, {FIRST}, one AS (SELECT 1 AS run, * FROM d ORDER BY title, _seq LIMIT 20), "
    f"two AS (SELECT 2 AS run, * FROM d WHERE url NOT IN (SELECT url FROM one) ORDER BY title, _seq LIMIT 20) SELECT run, title, url FROM one UNION ALL SELECT run, title, url FROM two"
)
def watch_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with a limit: what the first cut stays unseen, and is next."""
    rows, seen = result_rows(spark, sf_dir), spark.createDataFrame([], "watch string, url string, first_seen bigint")
    runs = []
    for i in (1, 2):
        new = relation.combine(state.filter_new(rows, seen), sort="title", limit=20)
        seen = state.record(seen, new, "w", NOW)
        runs.append(new.select(F.lit(i).alias("run"), "title", "url"))
    return runs[0].unionByName(runs[1])


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("k"), F.col("doc_id")).alias("key"), (F.lit(NOW) - F.col("doc_id") * 7).alias("ts"), (F.col("doc_id") * 37 % 1009 * 1000 + F.col("doc_id") % 1000).alias("seq"), F.col("n_chars").alias("bytes"), F.col("source").alias("value"))


CACHE = f"c AS (SELECT 'k' || doc_id AS key, {NOW} - doc_id * 7 AS ts, doc_id * 37 % 1009 * 1000 + doc_id % 1000 AS seq, n_chars AS bytes, source AS value FROM documents)"


@query(f"WITH {CACHE}, q AS (SELECT 'k' || event_id * 3 AS key FROM events), l AS (SELECT * FROM c WHERE {NOW} - ts < 3600) SELECT q.key, l.value, l.key IS NOT NULL AS hit FROM q LEFT JOIN l USING (key)")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select(F.concat(F.lit("k"), F.col("event_id") * 3).alias("key"))
    return state.lookup(asked, _cache(spark, sf_dir), NOW).select("key", "value", "hit")


@query(f"WITH {CACHE} SELECT key, {NOW} - ts >= 3600 AS expired, FALSE AS never FROM c")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir).select("key", state.is_expired("ts", NOW, 3600).alias("expired"), state.is_expired("ts", NOW, 0).alias("never"))


@query(
    f"WITH {CACHE}, l AS (SELECT *, row_number() OVER (ORDER BY seq DESC, key DESC) AS n FROM c WHERE {NOW} - ts < 5000), b AS (SELECT *, sum(bytes) OVER (ORDER BY n) AS run FROM l WHERE n <= 400) "
    "SELECT key, ts, seq, bytes, value FROM b WHERE run <= 300000"
)
def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.evict(_cache(spark, sf_dir), NOW, ttl=5000, entries=400, most_bytes=300_000)


@query(
    f"WITH {CACHE}, m AS (SELECT key, 'mine' AS value, ts + 1 AS ts, seq, bytes, bytes % 2 = 0 AS touched, bytes % 5 = 0 AS deleted FROM c WHERE bytes % 3 <> 0), d AS (SELECT * FROM c WHERE bytes % 7 <> 0) "
    "SELECT CASE WHEN coalesce(touched, FALSE) THEN m.key ELSE d.key END AS key, CASE WHEN coalesce(touched, FALSE) THEN m.value ELSE d.value END AS value, "
    "CASE WHEN coalesce(touched, FALSE) THEN m.ts ELSE d.ts END AS ts FROM m FULL JOIN d ON m.key = d.key WHERE NOT coalesce(deleted, FALSE) AND (coalesce(touched, FALSE) OR d.key IS NOT NULL)"
)
def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cache(spark, sf_dir)
    mine = c.where("bytes % 3 <> 0").select("key", F.lit("mine").alias("value"), (F.col("ts") + 1).alias("ts"), "seq", "bytes", (F.col("bytes") % 2 == 0).alias("touched"), (F.col("bytes") % 5 == 0).alias("deleted"))
    return state.merge(mine, c.where("bytes % 7 <> 0")).select("key", "value", "ts")


@query(f"WITH {CACHE} SELECT count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER ({NOW} - ts >= 3600) AS expired FROM c")
def cache_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.cache_info(_cache(spark, sf_dir), NOW)


@query("""SELECT doc_id, sha256('{"parts":["fetch","' || source || '","' || doc_id || '"],"v":5}') AS key FROM documents""")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.cache_key(F.lit("fetch"), "source", F.col("doc_id").cast("string")).alias("key"))


JSON = "'{\"title\":\"' || title || '\",\"url\":\"' || url || '\",\"snippet\":\"' || replace(snippet, '\"', '\\\"') || '\",\"published\":' || coalesce('\"' || " + rendered("published") + " || '\"', 'null') || '}'"
TOP = f"WITH {ROWS}, {FIRST}, t AS (SELECT row_number() OVER (ORDER BY url, _seq) AS k, * FROM d), j AS (SELECT k, {JSON} AS j FROM t WHERE k <= 30)"


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation.combine(result_rows(spark, sf_dir), sort="url", limit=30)


@query(TOP + """ SELECT '{"query":"q","engine":"bing","count":' || count(*) || ',"results":[' || string_agg(j, ',' ORDER BY k) || ']}' AS doc FROM j""")
def sink_search_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.search_doc(_top(spark, sf_dir), "q", "bing")


@query(TOP + """ SELECT '{"count":' || count(*) || ',"results":[' || string_agg(j, ',' ORDER BY k) || ']}' AS doc FROM j""")
def sink_run_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.run_doc(_top(spark, sf_dir))


@query(f"WITH {ROWS} SELECT _seq, {JSON} AS line FROM r")
def sink_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.jsonl(result_rows(spark, sf_dir))


@query(f"WITH {ROWS} SELECT _seq, CASE WHEN length(_seq::VARCHAR) > 3 THEN substr(_seq::VARCHAR, 1, 3) ELSE lpad(_seq::VARCHAR, 3, ' ') END || '. ' || title || coalesce('  (' || strftime(published, '%Y-%m-%d') || ')', '') || chr(10) || '     ' || url || chr(10) || '     ' || snippet AS block FROM r")
def sink_pretty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.pretty(result_rows(spark, sf_dir))


@query("""SELECT page_id AS _seq, CASE WHEN page_id % 4 = 0 THEN '{"url":"' || url || '","error":"gone","kind":"http"}' ELSE '{"url":"' || url || '","title":' || CASE WHEN page_id % 3 = 0 THEN 'null' ELSE '"t"' END || ',"chars":1,"truncated":false,"text":"x"}' END AS item FROM pages""")
def sink_fetch_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(
        k.alias("_seq"), "url", F.when(k % 3 != 0, F.lit("t")).alias("title"), F.lit(1).alias("chars"), F.lit(False).alias("truncated"), F.when(k % 4 == 0, "gone").otherwise("x").alias("text"), F.when(k % 4 == 0, "http").alias("kind")
    )
    return sinks.fetch_batch(rows)


@query(f"WITH {CACHE}, n AS (SELECT key, 'new' AS value, ts, seq, bytes FROM c WHERE bytes % 4 = 0 AND bytes <= 5000) SELECT key, value, ts FROM n UNION ALL SELECT key, value, ts FROM c WHERE key NOT IN (SELECT key FROM n)")
def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cache(spark, sf_dir)
    empty = F.when(F.col("bytes") % 4 == 1, "[]").otherwise("new")
    return state.put(c, c.where("bytes % 4 < 2").withColumn("value", empty), most_bytes=5000).select("key", "value", "ts")


@query("""SELECT p_partkey // 100 AS request_id, '{"query":"q","engine":"bing","count":' || count(*) || ',"results":[' || string_agg('{"title":"t' || p_partkey || '","url":"u","page_url":"p","width":' || CASE WHEN p_partkey % 2 = 0 THEN 'null' ELSE '7' END || ',"height":9,"format":"jpg"}', ',' ORDER BY p_partkey) || '],"downloaded":' || count(*) FILTER (p_partkey % 3 = 0) || '}' AS doc FROM part GROUP BY ALL""")
def sink_images_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each request."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.floor(k / 100).alias("request_id"), k.alias("_seq"), F.concat(F.lit("t"), k).alias("title"), F.lit("u").alias("url"), F.lit("p").alias("page_url"),
        F.when(k % 2 == 1, 7).alias("width"), F.lit(9).alias("height"), F.lit("jpg").alias("format"), (k % 3 == 0).alias("written"),
    )
    return sinks.images_doc(rows, "q", "bing", downloaded=True, by=("request_id",))


golden(
    "sanitize_line", [("a\tb\nc\x07d", "abcd"), ("plain", "plain"), ("x‮y", "xy")], T.sanitize_line
)
