"""Queries over state and streams: each reads a table, writes state in the shared folder and goes on from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import control
from lodestar.operators.cache_table import Cache, Limits
from lodestar.queries.base import ROWS, query, result_rows, table
from lodestar.sources import image_files, parsers, walk
from lodestar.storage import Conflict, folder
from lodestar.streaming import dedupe, sessions
from lodestar.streaming.watch import WatchState

NOW = 1_700_000_000


@query(
    f"WITH {ROWS}, k AS (SELECT *, CASE WHEN (_seq - 1) % 4 >= 2 THEN 1 ELSE 0 END AS late FROM r) "
    "SELECT _seq, title, url FROM k QUALIFY row_number() OVER (PARTITION BY url ORDER BY late, _seq) = 1"
)
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in two parts; the stream is stopped between them and goes on from its state. Each URL once."""
    root = folder(spark, "stream")
    rows = result_rows(spark, sf_dir).select("_seq", "title", "url")
    part = (F.col("_seq") - 1) % 4
    for arrived in (part < 2, part >= 2):
        rows.where(arrived).write.mode("append").parquet(f"{root}/in")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        dedupe.start(arriving, ["url"], f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return dedupe.read(spark, f"{root}/out", rows.schema)


@query(
    "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 0), u AS (SELECT DISTINCT user_id FROM events), "
    "n AS (SELECT (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS n1, (SELECT count(*) FROM events) AS n2, (SELECT count(*) FROM events WHERE user_id IN (SELECT user_id FROM a)) AS h2, (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM u) AS u) "
    "SELECT 1 AS run, n1 AS asked, CAST(0 AS BIGINT) AS hits, CAST(0 AS BIGINT) AS expired, TRUE AS saved, 0 AS version, a AS entries FROM n "
    "UNION ALL SELECT 2, n2, h2, 0, TRUE, 1, u FROM n UNION ALL SELECT 3, n2, n2, 0, TRUE, 2, u FROM n UNION ALL SELECT 4, 0, 0, 0, FALSE, 2, u FROM n UNION ALL SELECT 5, 0, 0, u, TRUE, 3, 0 FROM n"
)
def cache_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five runs over one cache: misses are stored, hits are recent, a run that changes nothing writes nothing, what expired goes."""
    root = folder(spark, "cache")
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id")).alias("key"))
    told = []
    for run, (asked, now) in enumerate([(events.where("event_id % 2 = 0"), NOW), (events, NOW + 10), (events, NOW + 20), (events.limit(0), NOW + 30), (events.limit(0), NOW + 9000)], 1):
        cache = Cache(spark, root, now, Limits(ttl=3600, entries=1_000_000, most_bytes=0))
        found = cache.lookup(asked.select("key"))
        counts = found.agg(F.count("*").alias("asked"), F.count_if("hit").alias("hits")).first()
        if counts.hits < counts.asked:
            cache.put(found.where(~F.col("hit")).select("key", F.to_json(F.struct("key")).alias("value")).distinct())
        saved = cache.save()
        told.append((run, counts.asked, counts.hits, cache.expired, saved, cache.table.last(), cache.table.read().count()))
    return spark.createDataFrame(told, "run int, asked bigint, hits bigint, expired bigint, saved boolean, version int, entries bigint")


@query(
    f"WITH {ROWS}, w AS (SELECT 'even' AS watch, url, {NOW} AS seen_at FROM r WHERE _seq % 2 = 0 UNION ALL SELECT 'odd', url, {NOW + 5} FROM r WHERE _seq % 2 = 1) "
    "SELECT watch, url, CAST(min(seen_at) AS BIGINT) AS first_seen, 1 AS refused, 1 AS version FROM w GROUP BY watch, url QUALIFY row_number() OVER (PARTITION BY watch ORDER BY min(seen_at) DESC, url DESC) <= 20000"
)
def watch_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers start from one version: one is refused, starts over, and nothing of either is lost."""
    from lodestar.operators import state

    store = WatchState(spark, folder(spark, "watch"))
    rows = result_rows(spark, sf_dir).select("_seq", "url")
    own = [("even", rows.where("_seq % 2 = 0"), NOW), ("odd", rows.where("_seq % 2 = 1"), NOW + 5)]
    begun = [(store.unseen(r, w), w, at) for w, r, at in own]
    refused = 0
    for (new, found), watch, at in begun:
        try:
            store.save(state.record(found.rows, new, watch, at), found.version + 1)
        except Conflict:
            refused += 1
            new, found = store.unseen(new, watch)
            store.save(state.record(found.rows, new, watch, at), found.version + 1)
    return store.read().select("watch", "url", "first_seen", F.lit(refused).alias("refused"), F.lit(store.last()).alias("version"))


@query(
    "WITH r AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN '/o/' || o_orderkey WHEN 1 THEN '/o/' || o_orderkey || '/*x' ELSE '/o/' || o_orderkey || '$' END AS pattern, o_custkey % 2 = 0 AS allow FROM orders), "
    "l AS (SELECT *, CASE WHEN pattern LIKE '%$' THEN left(pattern, length(pattern) - 1) ELSE replace(pattern, '*', '%') || '%' END AS t FROM r), "
    "u AS (SELECT page_id, '/o/' || page_id * 7 || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/abx?q' WHEN 2 THEN '/ab' ELSE '?x=1' END AS p FROM pages), "
    "m AS (SELECT page_id, length(pattern) AS n, allow FROM u JOIN l ON p LIKE t) "
    "SELECT u.page_id, coalesce((max(n * 2 + allow::INT) % 2) = 1, TRUE) AS robots_allowed FROM u LEFT JOIN m USING (page_id) GROUP BY u.page_id"
)
def robots_hot_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a rule of one origin, every page a request to it."""
    k = F.col("o_orderkey")
    tail = F.when(k % 3 == 0, "").when(k % 3 == 1, "/*x").otherwise("$")
    origin = F.lit("https://hot.example").alias("origin")
    rules = table(spark, sf_dir, "orders").select(origin, F.concat(F.lit("/o/"), k, tail).alias("pattern"), (F.col("o_custkey") % 2 == 0).alias("allow"))
    n = F.col("page_id")
    rest = F.when(n % 4 == 0, "").when(n % 4 == 1, "/abx?q").when(n % 4 == 2, "/ab").otherwise("?x=1")
    asked = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://hot.example/o/"), n * 7, rest).alias("url"))
    return control.robots_gate(asked, rules).select("page_id", "robots_allowed")


PAGE = 20


@query(
    f"""WITH RECURSIVE p AS (SELECT user_id % 50 AS c, event_id AS id, (row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id DESC) - 1) // {PAGE} AS page FROM events),
    g AS (SELECT c, page, min(id) AS oldest, count(*) AS n, lag(min(id)) OVER (PARTITION BY c ORDER BY page) AS before FROM p GROUP BY c, page),
    w AS (SELECT c, 1 AS hop, before, oldest, n AS have FROM g WHERE before IS NULL AND c % 10 <> 3 UNION ALL
        SELECT w.c, hop + 1, g.before, g.oldest, have + g.n FROM w JOIN g ON g.c = w.c AND g.before = w.oldest WHERE hop < 4 AND have < 20 * (1 + w.c % 5) - 5),
    k AS (SELECT p.c, p.id, row_number() OVER (PARTITION BY p.c ORDER BY p.id DESC) AS _seq FROM p JOIN g USING (c, page) JOIN w ON w.c = p.c AND w.before IS NOT DISTINCT FROM g.before)
    SELECT c AS request_id, _seq, '@c' || c AS title, 'https://t.me/c' || c || '/' || id AS url, NULL AS kind FROM k WHERE _seq <= 20 * (1 + c % 5) - 5
    UNION ALL SELECT DISTINCT c, 0, NULL, NULL, 'no_results' FROM p WHERE c % 10 = 3"""
)
def walk_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of events, 20 posts a page: between 15 and 95 posts are asked for, four pages at most."""
    from pyspark.sql import Window

    c = (F.col("user_id") % 50).alias("c")
    newest = Window.partitionBy("c").orderBy(F.desc("event_id"))
    posts = table(spark, sf_dir, "events").select(c, "event_id").withColumn("page", F.floor((F.row_number().over(newest) - 1) / PAGE))
    name = F.concat(F.lit("c"), F.col("c"))
    post = F.concat(F.lit('<div class="tgme_widget_message_wrap"><div class="tgme_widget_message" data-post="'), name, F.lit("/"), F.col("event_id"), F.lit('"><div class="tgme_widget_message_text">post</div></div></div>'))
    made = posts.groupBy("c", "page").agg(F.min("event_id").alias("oldest"), F.sort_array(F.collect_list(F.struct("event_id", post.alias("h"))), asc=False).alias("h"))
    body = F.concat(F.lit('<div class="tgme_channel_info_header"></div>'), F.array_join(F.transform("h", lambda x: x["h"]), ""))
    before = F.lag("oldest").over(Window.partitionBy("c").orderBy("page"))
    pages = made.select(name.alias("channel"), before.alias("before"), body.alias("body"), (F.col("c") % 10 == 3).alias("redirected"))
    asked = posts.select(F.col("c").alias("request_id"), name.alias("channel"), (20 * (1 + F.col("c") % 5) - 5).alias("want")).distinct()
    return walk.walk(asked, pages).select("request_id", "_seq", "title", "url", "kind")


@query(
    "SELECT lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '_part-' || p_partkey || '.png' AS file, CAST(8 + length(p_name) AS BIGINT) AS bytes, md5(p_name) AS content FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 0"
)
def image_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images are written by tasks and put in place by one commit; what the plan skips, or is no image, is not."""
    k = F.col("p_partkey")
    head = F.when(k % 3 == 0, F.lit(b"<svg/>  ")).otherwise(F.lit(b"\x89PNG\r\n\x1a\n"))
    images = table(spark, sf_dir, "part").select(
        (k % 10000).alias("_seq"), F.concat(F.lit("part "), k).alias("title"), F.concat(F.lit("https://i.example/"), k).alias("url"), F.lit("gif").alias("format"),
        F.concat(head, F.col("p_name").cast("binary")).alias("content"), (k % 5 != 0).alias("robots_allowed"), F.lit(False).alias("on_disk"),
    )
    place = folder(spark, "images")
    plan = parsers.download_plan(images, limit=10_000)
    image_files.write(plan, place)
    image_files.write(plan.withColumn("content", F.lit(b"other")), place)  # what is there stays
    told = F.expr("substring(content, 9)").alias("name")
    return image_files.in_place(plan, place).select("file", F.octet_length("content").cast("bigint").alias("bytes"), F.md5(told).alias("content"))


@query(
    """WITH b AS (SELECT page_id // 8 AS body, page_id % 8 AS i, page_id FROM pages),
    f AS (SELECT body, i * 2 AS n, CASE page_id % 5 WHEN 0 THEN 'agent' WHEN 1 THEN 'agent' ELSE 'rule' END AS k, page_id % 3 = 0 AS every, page_id, 0 AS half FROM b
      UNION ALL SELECT body, i * 2 + 1, 'rule', FALSE, page_id, 1 FROM b WHERE page_id % 4 <> 2),
    o AS (SELECT *, CASE WHEN k = 'agent' AND coalesce(lag(k) OVER (PARTITION BY body ORDER BY n), '') <> 'agent' THEN 1 ELSE 0 END AS opens FROM f),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY body ORDER BY n) AS grp FROM o),
    m AS (SELECT *, max(CASE WHEN k = 'agent' AND every THEN 1 ELSE 0 END) OVER (PARTITION BY body, grp) AS binds FROM g)
    SELECT body, '/p/' || page_id || CASE half WHEN 0 THEN '/%C3%A9' ELSE '/%AF*' END AS pattern, page_id % 2 = 0 AS allow FROM m WHERE k = 'rule' AND grp > 0 AND binds = 1"""
)
def robots_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body of each eight pages: lines that name agents, rules, remarks and lines that are no fields."""
    k = F.col("page_id")
    agent = F.concat(F.lit("User-Agent : "), F.when(k % 3 == 0, "*").otherwise("other"), F.lit(" # who"))
    rule = lambda tail: F.concat(F.when(k % 2 == 0, "ALLOW").otherwise("disallow"), F.lit(": /p/"), k, F.lit(tail))
    one = F.when(k % 5 < 2, agent).otherwise(rule("/é"))
    two = F.when(k % 4 == 2, "no field here # user-agent: *").otherwise(rule("/%af*"))
    part = table(spark, sf_dir, "pages").groupBy(F.floor(k / 8).alias("body_id")).agg(F.sort_array(F.collect_list(F.struct("page_id", F.concat(one, F.lit("\n"), two, F.lit("\n")).alias("t")))).alias("t"))
    bodies = part.select(F.col("body_id").alias("origin"), F.array_join(F.transform("t", lambda x: x["t"]), "").alias("body"))
    return control.robots_rules(bodies).select(F.col("origin").alias("body"), "pattern", "allow")


@query(
    "WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) "
    "SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 12 HOUR AS ended, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.sessions(table(spark, sf_dir, "events"), "user_id", gap="12 hours", value="value")
    return found.withColumn("total", F.round("total", 4))
