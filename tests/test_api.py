"""The facade and the command line over stored payloads."""

from __future__ import annotations

import io
import json
from dataclasses import replace
from datetime import UTC, datetime

import pytest

from lodestar.__main__ import main
from lodestar.api import Lodestar
from lodestar.config import Config
from lodestar.errors import ConfigError, LodestarError, NoResultsError
from lodestar.operators import state
from lodestar.operators.cache_table import LAYOUT, Cache
from lodestar.storage import StateTable
from lodestar.streaming.watch import WatchState

HITS = json.dumps({"hits": [{"objectID": str(i), "title": f"t{i}", "url": f"https://x.org/{i % 3}", "points": 1, "num_comments": 2, "author": "a", "created_at_i": 1_700_000_000 + i * 86_400} for i in range(5)]})
WEB = '<li class="b_algo"><h2><a href="https://b.org/">B</a></h2><p>said</p></li>'
RSS = "<rss><channel><item><title>B</title><link>https://b.org/</link><description>said</description></item></channel></rss>"
PAGE = "<title>T</title><article><h2>Rust</h2><p>rust runtime</p><h2>Other</h2><p>nothing</p></article>"


@pytest.fixture(scope="module")
def star(spark):
    rows = [(1, "hackernews", "q", 200, HITS), (2, "duckduckgo", "q", 429, ""), (3, "bing", "q", 200, RSS), (4, "npm", "q", 200, "{}"), (5, "crates", "q", 404, "")]
    payloads = spark.createDataFrame(rows, "request_id bigint, engine string, query string, status int, body string")
    pages = spark.createDataFrame([("https://x.org/1", PAGE)], "url string, html string")
    return Lodestar(spark, payloads, pages, now=datetime(2023, 12, 1, tzinfo=UTC))


def test_search(star):
    assert [r.title for r in star.search("q", "hn", 2).orderBy("_seq").collect()] == ["t0", "t1"]
    # The engine takes bounds itself, so they come before the count; elsewhere the count comes first.
    assert [r.title for r in star.search("q", "hn", 3, since="2023-11-16").orderBy("_seq").collect()] == ["t2", "t3", "t4"]
    assert star.search("q", "bing", 3, since="2023-11-16").count() == 0
    assert [r.title for r in star.search("q", "ddg").collect()] == ["B"]  # the next web engine
    with pytest.raises(LodestarError):
        star.with_config(fallback=False).search("q", "ddg")
    for engine, kind in (("npm", "parse"), ("crates", "http")):
        with pytest.raises(LodestarError) as e:
            star.search("q", engine)
        assert e.value.kind == kind
    with pytest.raises(ConfigError):
        star.search(" ")


def test_fetch(star):
    got = star.fetch(["https://x.org/2", "https://x.org/1", "http://10.0.0.1/"]).orderBy("_seq").collect()
    assert [(r._seq, r.kind) for r in got] == [(1, "http"), (2, None), (3, "blocked_by_policy")]
    assert got[1].text == "Rust\nrust runtime\nOther\nnothing" and got[1].title == "T"
    best = star.fetch(["https://x.org/1"], query="rust").collect()[0]
    assert "rust runtime" in best.text and best.chars == len(best.text)


def test_run(star):
    ok = "version: 1\nsteps: [{search: {query: q, engine: hn}}, {search: {query: q, engine: npm}}, {fetch: {url: 'https://x.org/1'}}]\ncombine: {sort: url}"
    assert [r.url for r in star.run(ok).collect()] == ["https://x.org/0", "https://x.org/1", "https://x.org/2"]
    with pytest.raises(NoResultsError):
        star.run("version: 1\nsteps: [{search: {query: q, engine: npm}}]")


def test_command_line(star, tmp_path, capsys):
    star.payloads.write.parquet(str(tmp_path / "p"))
    assert main(["--payloads", str(tmp_path / "p"), "--format", "jsonl", "search", "q", "--engine", "hn", "--count", "1"]) == 0
    assert json.loads(capsys.readouterr().out)["title"] == "t0"
    assert main(["engines"]) == 0 and len(capsys.readouterr().out.splitlines()) == 17
    assert main(["search", "q", "--engine", "nope"]) == 2
    assert main(["init", str(tmp_path / "c.toml")]) == 0 and Config().engine in (tmp_path / "c.toml").read_text()


def test_bing_page_without_a_feed(spark, star):
    only_page = spark.createDataFrame([(1, "bing", "q", 200, WEB)], "request_id bigint, engine string, query string, status int, body string")
    assert [r.url for r in Lodestar(spark, only_page, star.pages).search("q", "bing").collect()] == ["https://b.org/"]


def test_arguments_of_steps_count(spark, star):
    rows = [(1, "hackernews", "q", 200, HITS, "de"), (2, "hackernews", "q", 200, HITS.replace("t0", "other"), "en")]
    told = spark.createDataFrame(rows, "request_id bigint, engine string, query string, status int, body string, lang string")
    here = Lodestar(spark, told, star.pages)
    assert here.search("q", "hn", 1, lang="en").first().title == "other"
    assert star.fetch(["https://x.org/1"], raw=True).first().text == PAGE
    cut = star.fetch(["https://x.org/1"], max_chars=4).first()
    assert (cut.text, cut.chars, cut.truncated) == ("Rust", 4, True)


def test_commands_over_state(spark, star, tmp_path, capsys):
    store = WatchState(spark, str(tmp_path / "w"))
    store.save(spark.createDataFrame([("a", "u1", 5), ("b", "u2", 6)], "watch string, url string, first_seen bigint"), 0)
    assert main(["--watches", store.path, "watch-list"]) == 0
    assert [json.loads(x)["watch"] for x in capsys.readouterr().out.splitlines()] == ["a", "b"]
    assert main(["--watches", store.path, "--quiet", "watch-clear", "a"]) == 0
    out = capsys.readouterr()
    assert [json.loads(x)["watch"] for x in out.out.splitlines()] == ["b"] and out.err.strip() == ""
    StateTable(spark, str(tmp_path / "c"), LAYOUT).commit(spark.createDataFrame([("k", "v", 1, 1, 2)], LAYOUT), -1)
    assert main(["--cache", str(tmp_path / "c"), "cache-info"]) == 0
    assert json.loads(capsys.readouterr().out) == {"entries": 1, "bytes": 2, "expired": 1}
    assert main(["--cache", str(tmp_path / "c"), "cache-clear", "--expired"]) == 0 and json.loads(capsys.readouterr().out)["entries"] == 0
    star.pages.write.parquet(str(tmp_path / "p"))
    assert main(["--pages", str(tmp_path / "p"), "--format", "json", "fetch", "https://x.org/1"]) == 0
    assert json.loads(capsys.readouterr().out)["title"] == "T"
    assert main(["--pages", str(tmp_path / "p"), "--format", "json", "fetch", "https://x.org/1", "http://[::1]/"]) == 0
    out = capsys.readouterr()
    assert [x.get("kind") for x in json.loads(out.out)] == [None, "blocked_by_policy"] and "1 of 2" in out.err
    StateTable(spark, str(tmp_path / "v"), "other int").commit(spark.createDataFrame([(1,)], "other int"), -1)
    with pytest.raises(ConfigError):
        WatchState(spark, str(tmp_path / "v")).read()


def test_cache_life_cycle(spark):
    cache = spark.createDataFrame([("a", '{"x":7}', 100, 1, 2), ("e", '{"y":7}', 100, 1, 2), ("b", "not json", 100, 2, 8), ("c", "{}", 1, 3, 2)], "key string, value string, ts bigint, seq bigint, bytes bigint")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "key string")
    hits = state.lookup(asked, cache, 150, ttl=100)
    assert {r.key for r in hits.where("hit").collect()} == {"a", "b", "e"}
    assert {r.key for r in state.decoded(hits, "x int").where("hit").collect()} == {"a"}
    assert {r.key: r.seq for r in state.touch(cache, hits, 9).collect()} == {"a": 9, "b": 9, "c": 3, "e": 9}
    assert state.clear(cache).count() == 0 and {r.key for r in state.clear(cache, 150, 100).collect()} == {"a", "b", "e"}
    assert [r.n for r in cache.select(state.entry_bytes("key", "value").alias("n")).collect()] == [8, 8, 9, 3]


IMAGES = json.dumps({"results": [{"image": f"https://i.org/{i}.png", "title": f"pic {i}", "url": "https://p.org/", "width": 5, "height": 6} for i in range(3)]})
PNG = b"\x89PNG\r\n\x1a\n"


def test_answers_are_cached(spark, star, tmp_path):
    path = str(tmp_path / "c")
    at = lambda now, **more: replace(star, cache=Cache(spark, path, now), **more)
    one = at(1000)
    first = sorted(map(tuple, one.search("q", "hn", 2).select("title", "url", "published").collect()))
    page = one.fetch(["https://x.org/1", "https://x.org/2"]).orderBy("_seq").collect()
    assert one.cache.save() and one.cache.table.read().count() == 2  # failures are not kept
    nothing = {"payloads": star.payloads.limit(0), "pages": star.pages.limit(0)}
    two = at(1100, **nothing)
    assert sorted(map(tuple, two.search("q", "hn", 2).select("title", "url", "published").collect())) == first
    assert two.fetch(["https://x.org/1", "https://x.org/2"]).orderBy("_seq").collect() == page
    assert two.search("q", "hn", 2, fresh=True).count() == 0 and two.search("q", "hn", 3).count() == 0
    assert [r.kind for r in two.fetch(["https://x.org/1"], markdown=True).collect()] == ["http"]
    assert at(9000, **nothing).search("q", "hn", 2).count() == 0  # too old


def test_robots_are_asked(spark, star):
    rules = spark.createDataFrame([("https://x.org", "User-agent: *\nDisallow: /1")], "origin string, body string")
    asked = replace(star, robots=rules)
    assert [r.kind for r in asked.fetch(["https://x.org/1"]).collect()] == [None]
    assert [r.kind for r in asked.with_config(respect_robots=True).fetch(["https://x.org/1"]).collect()] == ["robots"]


def test_oversized_answers_fail(spark, star):
    big = spark.createDataFrame([(1, "npm", "q", 200, "x" * (10 * 1024 * 1024 + 1))], "request_id bigint, engine string, query string, status int, body string")
    with pytest.raises(LodestarError) as e:
        replace(star, payloads=big).search("q", "npm")
    assert e.value.kind == "response_too_large"


def test_images(spark, star, tmp_path, capsys):
    told = spark.createDataFrame([(1, "bing", "q", 429, ""), (2, "duckduckgo", "q", 200, IMAGES)], "request_id bigint, engine string, query string, status int, body string")
    content = spark.createDataFrame([("https://i.org/0.png", PNG), ("https://i.org/1.png", b"<svg/>"), ("https://i.org/9.png", PNG)], "url string, content binary")
    here = replace(star, image_payloads=told, image_bytes=content)
    got = here.images("q", count=2, to=str(tmp_path / "i")).orderBy("_seq").collect()
    assert [(r._seq, r.title, r.written) for r in got] == [(1, "pic 0", True), (2, "pic 1", False)]
    assert [p.name for p in (tmp_path / "i").iterdir()] == ["0001_pic-0.png"]
    with pytest.raises(LodestarError):
        here.with_config(fallback=False).images("q", "bing")
    told.write.parquet(str(tmp_path / "told"))
    assert main(["--image-payloads", str(tmp_path / "told"), "images", "q", "--count", "1"]) == 0
    assert json.loads(capsys.readouterr().out)["results"][0]["url"] == "https://i.org/0.png"


def test_recipe_commands(star, tmp_path, capsys, monkeypatch):
    star.payloads.write.parquet(str(tmp_path / "p"))
    recipe = f"version: 1\nsteps: [{{search: {{query: q, engine: hn, count: 2}}}}]\nwatch: w\noutput: {{file: '{tmp_path}/out', format: jsonl}}"
    (tmp_path / "r.yaml").write_text(recipe)
    run = ["--payloads", str(tmp_path / "p"), "--watches", str(tmp_path / "w"), "run", str(tmp_path / "r.yaml")]
    assert main(run) == 0
    assert [json.loads(x)["title"] for x in (tmp_path / "out").read_text().splitlines()] == ["t0", "t1"] and "2 lines" in capsys.readouterr().err
    assert main(run) == 0 and (tmp_path / "out").read_text() == ""
    assert main(["--payloads", str(tmp_path / "p"), "run", str(tmp_path / "r.yaml")]) == 2
    monkeypatch.setattr("sys.stdin", io.StringIO("version: 1\nsteps: [{search: {query: q, engine: hn, count: 1}}]\noutput: {format: pretty}"))
    capsys.readouterr()
    assert main(["--payloads", str(tmp_path / "p"), "run", "-"]) == 0
    assert "1. t0" in capsys.readouterr().out


def test_fetched_pages_without_a_title_and_with_cut_references_match_sql(spark, tmp_path):
    import duckdb

    from lodestar import catalog

    heads = ["<title></title>", "<title>  </title>", "", "<title>a &amp;&am</title>", "<title>b&quo</title>"]
    rows = [(i, f"https://e.example/{i}", f"<html><head>{h}</head><body><article><h1>x&am</h1><p><b>y&amp<br><p>z &amp;&quot;</article></body></html>") for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(catalog.ORACLES["fetch_pages"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["fetch_pages"](spark, str(tmp_path)).collect())) == sorted(want)
