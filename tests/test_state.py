"""State tables, the cache's life, streams, walks, robots rules and image files: what a registered query cannot show."""

from __future__ import annotations

import os
import threading

import pytest
from pyspark.sql import functions as F

from lodestar.errors import ConfigError
from lodestar.functions import web
from lodestar.operators import control
from lodestar.operators.cache_table import Cache, Limits
from lodestar.sources import image_files, walk
from lodestar.storage import Conflict, StateTable
from lodestar.streaming import dedupe, sessions, watch


def test_racing_writers_lose_nothing(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "who string, n bigint")
    barrier, refused = threading.Barrier(4), []

    def run(who):
        def change(seen):
            if not refused:
                barrier.wait(60) if seen.version == -1 else None
            return seen.rows.unionByName(spark.createDataFrame([(who, seen.version)], "who string, n bigint"))

        table.update(change)

    threads = [threading.Thread(target=run, args=(w,)) for w in "abcd"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = sorted(tuple(r) for r in table.read().collect())
    assert [w for w, _ in got] == list("abcd") and sorted(n for _, n in got) == [-1, 0, 1, 2]
    assert table.versions() == [0, 1, 2, 3]


def test_a_version_is_written_once(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "n bigint")
    one = spark.createDataFrame([(1,)], "n bigint")
    table.commit(one, -1, by="a")
    with pytest.raises(Conflict):
        table.commit(one, -1)
    with pytest.raises(Conflict):
        table.files.create(f"{table.root}/log/0.json", "{}")
    table.commit(one.limit(0), 0)
    assert table.read().count() == 0 and table.snapshot().facts == {"by": "a"} and table.snapshot(0).rows.count() == 1
    assert sum(n.startswith("data-") for n in os.listdir(table.root)) == 2
    with pytest.raises(ConfigError):
        StateTable(spark, str(tmp_path / "t"), "other int").read()


def test_watch_overtaken_by_a_rival_starts_over(spark, tmp_path):
    rows = lambda urls: spark.createDataFrame([(i, u, u, "", None) for i, u in enumerate(urls)], "_seq bigint, title string, url string, snippet string, published timestamp")
    store = watch.WatchState(spark, str(tmp_path / "w"))
    real, once = store.save, []

    def late(seen, version, **facts):
        if not once:
            once.append(1)
            watch.run_batch(rows(["b", "c"]), watch.WatchState(spark, store.path), "w", str(tmp_path / "rival"), 0, now=1)
        real(seen, version, **facts)

    store.save = late
    watch.run_batch(rows(["a", "b"]), store, "w", str(tmp_path / "out"), 0, now=2)
    assert {r.url: r.first_seen for r in store.read().collect()} == {"a": 2, "b": 1, "c": 1}
    assert [r.url for r in spark.read.parquet(f"{tmp_path}/out/batch=0").collect()] == ["a"]
    watch.run_batch(rows(["z"]), store, "w", str(tmp_path / "out"), 0, now=3)  # the batch was done
    assert store.read().count() == 3


def test_cache_of_another_shape_or_size(spark, tmp_path):
    path, asked = str(tmp_path / "c"), spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "key string")
    cache = Cache(spark, path, 100, Limits(ttl=50, entries=2))
    assert cache.lookup(asked).where("hit").count() == 0
    cache.put(spark.createDataFrame([("a", '{"x":1}'), ("b", '{"y":1}'), ("c", "[]")], "key string, value string"))
    assert cache.save() and {r.key for r in cache.table.read().collect()} == {"a", "b"}
    again = Cache(spark, path, 110, Limits(ttl=50, entries=2))
    assert [r.hit for r in again.lookup(asked, "x int not null").orderBy("key").collect()] == [True, True, False, False]
    assert again.save() and {r.key: r.seq for r in again.table.read().collect()} == {"a": 2}
    still = Cache(spark, path, 120, Limits(ttl=50, entries=2))
    still.lookup(asked.where("key = 'a'"))
    assert not still.save() and still.table.last() == 1  # the only most recent entry is hit again
    assert not Cache(spark, path, 120, Limits(enabled=False)).save()
    old = Cache(spark, path, 900, Limits(ttl=50))
    assert old.expired == 1 and old.save() and old.table.read().count() == 0
    StateTable(spark, str(tmp_path / "d"), "n int").commit(spark.createDataFrame([(1,)], "n int"), -1)
    broken = Cache(spark, str(tmp_path / "d"), 1)
    assert broken.trouble and not broken.save() and broken.lookup(asked).where("hit").count() == 0


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    kind = "_seq bigint, url string, title string"
    stream = lambda: spark.readStream.schema(kind).parquet(str(tmp_path / "in"))

    def arrive(*rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        dedupe.start(stream(), ["url"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(tuple(r) for r in dedupe.read(spark, str(tmp_path / "out"), stream().schema).select("_seq", "url").collect())

    arrive((2, "a", "x"), (1, "a", "y"), (3, None, "z"), (4, None, "z"))
    assert run() == [(1, "a"), (3, None)]
    arrive((5, "a", "x"), (6, "b", "x"))
    arrive((0, "b", "early"))
    assert run() == [(0, "b"), (1, "a"), (3, None)]
    assert run() == [(0, "b"), (1, "a"), (3, None)]


def post(n, who="c"):
    return f'<div class="tgme_widget_message_wrap"><div class="tgme_widget_message" data-post="{who}/{n}"><div class="tgme_widget_message_text">p</div></div></div>'


def test_walks_end_for_each_reason(spark):
    head = '<div class="tgme_channel_info_header"></div>'
    pages = [("long", b, head + "".join(post(i) for i in range(b - 3, b)), False) for b in range(3, 31, 3)]
    pages += [("long", None, head + "".join(post(i) for i in (30, 31, 32)), False), ("loop", None, head + post(5), False), ("loop", 5, head + post(7) + post(6), False), ("loop", 6, head + post(1), False)]
    pages += [("gone", None, head + post(1), True), ("odd", None, "<p>no channel</p>", False), ("empty", None, head, False), ("end", None, head + post(9), False), ("long", 30, head + "".join(post(i) for i in range(27, 30)), False)]
    stored = spark.createDataFrame(pages, "channel string, before bigint, body string, redirected boolean")
    asked = spark.createDataFrame([(1, "long", 100), (2, "long", 4), (3, "loop", 9), (4, "gone", 9), (5, "odd", 9), (6, "empty", 9), (7, "end", 9), (8, "never", 9), (9, None, 9)], "request_id bigint, channel string, want int")
    got = {}
    for r in walk.walk(asked, stored).orderBy("request_id", "_seq").collect():
        got.setdefault(r.request_id, []).append(r.kind or int(r.url.rsplit("/", 1)[1]))
    assert got == {1: [30, 31, 32, 27, 28, 29, 24, 25, 26, 21, 22, 23], 2: [30, 31, 32, 27], 3: [5, 7, 6], 4: ["no_results"], 5: ["parse"], 7: [9], 8: ["no_results"], 9: ["no_results"]}


def test_robots_index_equals_every_rule_tried(spark):
    starts = ["/", "/a", "/a/", "/a/b/c", "/a/*/c", "/*.png", "/a/b$", "*", "/long/" + "x" * 140, "/long/" + "x" * 126, "/a$b", "/%C3%A9", ""]
    rules = spark.createDataFrame([(f"https://h{o}.example", p, (i + o) % 3 == 0) for o in range(2) for i, p in enumerate(starts)] + [(None, "/", False)], "origin string, pattern string, allow boolean")
    paths = ["", "/", "/a", "/a/b", "/a/b/c", "/a/x/c?q", "/b.png", "/long/" + "x" * 130, "/long/" + "x" * 150, "/a$b", "/%c3%a9t", "/é", "/zz"]
    asked = spark.createDataFrame([(f"https://h{o}.example{p}", o) for o in range(3) for p in paths] * 2 + [(None, 0)], "url string, origin int")
    own = asked.withColumns({"_o": web.origin("url"), "_p": web.normal_path(web.path_query("url"))})
    met = own.join(rules.withColumnRenamed("origin", "_r"), (F.col("_o") == F.col("_r")) & web.robots_match("pattern", "_p"))
    best = {(r._o, r._p): r.b.allow for r in met.groupBy("_o", "_p").agg(F.max(F.struct(F.octet_length("pattern").alias("n"), "allow")).alias("b")).collect()}
    want = sorted((r.url or "", best.get((r._o, r._p), True)) for r in own.collect())
    assert sorted((r.url or "", r.robots_allowed) for r in control.robots_gate(asked, rules).collect()) == want


def test_images_are_all_in_place_or_none(spark, tmp_path):
    plan = lambda rows: spark.createDataFrame(rows, "file string, content binary, skip string").repartition(3)
    path = tmp_path / "i"
    image_files.write(plan([(f"{i}.png", b"%d" % i, None) for i in range(9)] + [("no.png", b"", "robots")]), str(path))
    assert sorted(os.listdir(path)) == [f"{i}.png" for i in range(9)]
    with pytest.raises(Exception, match="no file name"):
        image_files.write(plan([(f"n{i}.png", b"x", None) for i in range(9)] + [("../out.png", b"x", None)]), str(path))
    image_files.write(plan([("3.png", b"other", None), ("a.png", b"a", None), ("a.png", b"a", None)]), str(path))
    assert sorted(os.listdir(path)) == [*(f"{i}.png" for i in range(9)), "a.png"] and (path / "3.png").read_bytes() == b"3"
    assert image_files.written(spark, str(path)).count() == 10
    asked = plan([("3.png", b"", None), ("3.png", b"", None), ("absent.png", b"", None), (None, b"", None)])
    assert [(r.file, bytes(r.content)) for r in image_files.in_place(asked, str(path)).collect()] == [("3.png", b"3")]


def test_many_images_of_one_task_cost_no_more_each(tmp_path):
    class Name(str):
        compared = 0

        def __eq__(self, other):
            Name.compared += 1
            return str.__eq__(self, other)

        __hash__ = str.__hash__

    writer = image_files.ImageWriter({"path": str(tmp_path / "i")})
    told = writer.write(iter([{"file": Name(f"{i}.png"), "content": b"x"} for i in range(2000)]))
    assert Name.compared < 20_000  # not every pair
    assert not os.path.exists(tmp_path / "i" / "1.png")
    writer.commit([told, None])
    assert len(os.listdir(tmp_path / "i")) == 2000


def test_robots_groups_equal_the_parser(spark):
    import random

    rng = random.Random(7)
    bits = ["User-agent: *", "user-agent:bot", "Disallow: /a", "Allow: /é b", "Disallow:", "# note", "no colon", "Sitemap: /s", "  ", "DISALLOW : /%e9*$ # x", "Allow: /u\u2028Disallow: /v", "\ufeffUser-agent: *"]
    bodies = ["\n".join(rng.choice(bits) for _ in range(rng.randrange(0, 16))) for _ in range(80)] + ["User-agent: *\n" + "# pad\n" * 90_000 + "Disallow: /late", None, "\ufeffUser-agent: *\nDisallow: /q"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "origin int, body string")
    got = {}
    for r in control.robots_rules(df).orderBy("origin", "place").collect():
        got.setdefault(r.origin, []).append((r.pattern, r.allow))
    assert got == {i: rules for i, b in enumerate(bodies) if (rules := web.parse_robots_text(b or ""))}


def test_sessions_of_a_stream_drop_what_is_too_late(spark, tmp_path):
    from datetime import datetime

    kind = "who string, ts timestamp, value double"
    at = lambda h, m=0: datetime(2024, 3, 1, h, m)

    def arrive(*rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        made = sessions.sessions(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), "who", gap="30 minutes", late="1 hour", value="value")
        made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.who, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrive(("a", at(1), 1.0), ("a", at(1, 20), 2.0), ("b", at(1), 4.0), (None, at(1), 9.0), ("a", None, 9.0))
    run()
    arrive(("a", at(1, 40), 1.0), ("c", at(6), 1.0))
    assert run() == [("a", 3, 4.0), ("b", 1, 4.0)]
    arrive(("a", at(1, 30), 1.0), ("c", at(6, 10), 1.0), ("d", at(9), 1.0))
    assert run() == [("a", 3, 4.0), ("b", 1, 4.0), ("c", 2, 2.0)]
    counts = sessions.tumbling(spark.createDataFrame([("a", at(1), 1.0), ("a", at(1, 59), 2.0), ("a", at(2), 4.0)], kind), "who")
    assert sorted((r.n, r.total) for r in counts.collect()) == [(1, 4.0), (2, 3.0)]


def test_result_page_follows_a_feed_without_rows(spark):
    from lodestar.sources import parsers

    page = '<html><body><ol><li class="b_algo"><h2><a href="https://p.example/">page</a></h2><p>x</p></li></ol></body></html>'
    feed = "<rss><channel>{}</channel></rss>"
    item = "<item><title>feed</title><link>https://f.example/</link></item>"
    rows = [(1, "full", feed.format(item)), (2, "full", page), (3, "none", feed.format("")), (4, "none", page), (5, "broken", "<rss><channel>"), (6, "broken", page), (7, "alone", "<rss><channel>"), (8, "page", page)]
    got = parsers.bing(spark.createDataFrame(rows, "request_id bigint, query string, body string")).collect()
    assert sorted((r.request_id, r.title or r.kind) for r in got) == [(1, "feed"), (4, "page"), (6, "page"), (7, "parse"), (8, "page")]
