"""Row functions, the recipe language, settings and state, by table."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lodestar import config, html, sinks
from lodestar.errors import ConfigError
from lodestar.functions import registered, text, timefn, web
from lodestar.operators import control, relation
from lodestar.plans import recipe
from lodestar.sources import parsers, registry
from lodestar.streaming import watch

NOW = datetime(2026, 9, 20, 12, tzinfo=UTC)


def test_passages_keep_headings_with_their_body():
    assert text.split_passages_text("# Soil\nloam\n# Water\nweekly\ndaily") == ["# Soil\nloam", "# Water\nweekly\ndaily"]
    assert text.split_passages_text("# Tools\n## Spades\n## Rakes\nsteel") == ["# Tools\n## Spades\n## Rakes\nsteel"]
    assert text.split_passages_text("# Soil\floam\u2028deep\u0085wet") == ["# Soil\floam\u2028deep\u0085wet"]
    assert web.parse_robots_text("User-agent: *\nDisallow: /a\u2028Allow: /b") == [("/a%E2%80%A8Allow: /b", False)]
    assert [len(x) for x in text.split_long_text("あ" * 2410)] == [1200, 1200, 10]
    long = "a" * 700 + ". " + "b" * 700
    assert text.split_long_text(long) == ["a" * 700 + ".", "b" * 700]


def test_passages_are_folded_as_they_are_looped(spark):
    import random

    rng = random.Random(4)
    bits = ["# Head", "short line", "x" * 590 + ".", "y" * 700 + ". " + "z" * 900, "あ" * 1300 + "。" + "い" * 50, "   ", "w " * 1400, "!" * 2500, "# " + "long heading. " * 120, "a.b" * 500 + "? "]
    texts = ["\n".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", text.split_passages("t").alias("p")).collect()}
    assert got == {i: text.split_passages_text(t or "") for i, t in enumerate(texts)}
    lines = spark.createDataFrame([(b.strip(),) for b in bits], "b string")
    assert all(r.s == text.split_long_text(r.b) for r in lines.select("b", text.split_long("b").alias("s")).collect())


def test_bounds():
    assert timefn.parse_bound("24h", "--since", NOW) == datetime(2026, 9, 19, 12, tzinfo=UTC)
    assert timefn.parse_bound("2026-09-20", "--since", NOW) == datetime(2026, 9, 20, tzinfo=UTC)
    for bad in ("0h", "24x", "1899-01-01", "2999-01-01", "24é", ""):
        with pytest.raises(ConfigError):
            timefn.parse_bound(bad, "--since", NOW)
    with pytest.raises(ConfigError):
        timefn.parse_window("1h", "2h", NOW)


def test_container_and_markdown():
    page = '<title> T </title><body><nav>menu</nav><article><h2>H</h2><p>a <a href="/x(1)">l[1]</a><ul><li>one<li>two</ul><div class="ad">buy</div></article>'
    got = html.extract(page, markdown=True, base="https://e.org/d/")
    assert got["title"] == "T"
    assert got["text"] == "## H\na [l\\[1\\]](https://e.org/x%281%29)\n- one\n- two"
    dense = "<body><div><p>" + "word " * 60 + "</p></div><footer><p>f</p></footer>"
    assert html.extract(dense)["container"] == "dense"
    assert html.extract("<body>few")["container"] == "body"
    assert html.extract("<div>" * 1600)["kind"] == "parse"


def test_charset():
    assert html.charset(b"\xef\xbb\xbfx", "text/html; charset=latin-1") == "utf-8-sig"
    assert html.charset(b'<meta charset="windows-1252">', None) == "cp1252"
    assert html.charset(b"x", "text/html; charset=nope") == "utf-8"


def test_references_without_a_semicolon_stay_in_titles():
    assert html.extract("<title>a &amp; b&amp</title><article><p>x</p></article>")["title"] == "a & b&amp"
    assert html.extract("<title>&lt;&#233;&copy;&lt &nosuch; \ue000&</title><main>x</main>")["title"] == "<é©&lt &nosuch; \ue000&"
    got = html.extract('<main><h1>t&am</h1><p>x&lt<b>y &quot;&amp</b></p></main>', markdown=True)
    assert got["text"] == '# t&am\nx&lty "&amp'
    link = html.extract('<main><a href="https://e.org/?a=1&copy=2&amp;b">l</a></main>', markdown=True)
    assert link["text"] == "[l](https://e.org/?a=1&copy=2&b)"
    assert html.tree("<p>a&amp b</p>").text() == "a& b"  # result pages are read as browsers do


def test_payloads_are_parsed_a_few_at_a_time(spark):
    """A worker holds some hundred payloads, not an Arrow batch of 10,000."""
    page = '<li class="b_algo"><h2><a href="https://e.org/">t</a></h2><p>s</p></li>'
    rss = "<rss><channel><item><title>t</title><link>https://e.org/</link><description>s</description></item></channel></rss>"
    ddg = '<div class="result"><a class="result__a" href="https://e.org/">t</a><a class="result__snippet">s</a></div>'
    wrap = '<div class="tgme_channel_info_header"></div><div class="tgme_widget_message_wrap" data-post="c/7"><a class="tgme_widget_message_date" href="https://e.org/"></a><div class="tgme_widget_message_text">s</div></div>'
    for parse, body, title in ((parsers.bing_html, page, "t"), (parsers.web_rss, rss, "t"), (parsers.ddg_html, ddg, "t"), (parsers.feed, rss, "t"), (parsers.channel, wrap, "@c")):
        payloads = spark.range(5).select(F.col("id").alias("request_id"), F.lit(body).alias("body"), F.lit("c").alias("channel"))
        rows = parse(payloads)
        assert [(r._seq, r.title, r.url, r.snippet, r.kind) for r in rows.collect()] == [(1, title, "https://e.org/", "s", None)] * 5
        plan = rows._jdf.queryExecution().executedPlan().toString()
        arrow = [line for line in plan.split("\n") if "ArrowEvalPython" in line and "body" in line]
        assert "BatchEvalPython" in plan and not arrow
    got = spark.range(1).select(parsers.channel_page(F.lit("<p>x</p>")).alias("p"), parsers._image_attrs(F.lit('<a class="iusc" m="{}"><img alt="a"></a>')).alias("a")).first()
    assert got.p.asDict(True) == {"posts": [], "oldest": None, "has_channel": False} and [tuple(x) for x in got.a] == [("{}", "a")]


def test_robots_groups():
    body = "﻿User-agent: a\nUser-agent: *\nDisallow: /p # c\nCrawl-delay: 1\nAllow: /é\nUser-agent: b\nDisallow: /\n"
    assert web.parse_robots_text(body) == [("/p", False), ("/%C3%A9", True)]


def test_feed_is_not_a_page():
    assert parsers.feed_entries("<html></html>") is None
    assert parsers.feed_entries("<rss") is None
    assert parsers.feed_entries("<rss><channel/></rss>") == []


GOOD = """
version: 1
vars: {lang: en, n: 3}
steps:
  - for_each: {items: [rust, go], step: {search: {query: "${item} $$ ${lang}", engine: ddg, count: "${n}"}}}
  - fetch: {url: "https://e.org/"}
combine: {sort: url, limit: 2}
output: {format: jsonl}
watch: daily
"""


def test_recipe():
    r = recipe.parse(GOOD)
    assert [(s.kind, s.number) for s in r.steps] == [("search", 1), ("search", 1), ("fetch", 2)]
    assert r.steps[0].args == {"query": "rust $ en", "engine": "duckduckgo", "count": 3}
    assert (r.combine.dedupe, r.combine.sort, r.combine.limit, r.watch, r.format) == (True, "url", 2, "daily", "jsonl")
    assert recipe.parse("version: 1\nsteps: [{fetch: {url: x}}]\ncombine:\n").combine.dedupe


@pytest.mark.parametrize(
    "bad",
    [
        "version: 2\nsteps: [{fetch: {url: x}}]", "version: 1\nsteps: []", "version: 1\nsteps: [{fetch: {url: x}}]\nextra: 1", "version: 1\nsteps: [{search: {query: ''}}]",
        "version: 1\nsteps: [{search: {query: a, count: 51}}]", "version: 1\nsteps: [{search: {query: '${no}'}}]", "version: 1\nsteps: [{search: {query: '${no'}}]",
        "version: 1\nvars: {item: 1}\nsteps: [{fetch: {url: x}}]", "version: 1\nsteps: [{for_each: {items: [], step: {fetch: {url: x}}}}]",
        "version: 1\nsteps: [{for_each: {items: [1], step: {for_each: {items: [1], step: {fetch: {url: x}}}}}}]", "version: 1\nsteps: [{fetch: {url: x}}]\ncombine: {limit: 201}",
        "version: 1\nsteps: [{search: {query: a, engine: nope}}]", "version: 1\nsteps: [{fetch: {url: x}}]\nwatch: '../x'",
    ],
)
def test_bad_recipes(bad):
    with pytest.raises(ConfigError):
        recipe.parse(bad)


def rows(spark, urls):
    data = [(i + 1, f"t{u}", u, "s", None) for i, u in enumerate(urls)]
    return spark.createDataFrame(data, "_seq bigint, title string, url string, snippet string, published timestamp")


def test_recipe_runs_watch_before_limit(spark):
    r = recipe.parse("version: 1\nsteps: [{search: {query: a}}, {search: {query: b}}]\ncombine: {sort: url, limit: 2}\nwatch: w")
    seen = spark.createDataFrame([("w", "a", 1), ("v", "b", 1)], "watch string, url string, first_seen bigint")
    out = recipe.compile_recipe(r, lambda s: rows(spark, ["c", "a", "b", "b"] if s.args["query"] == "a" else ["d"]), seen)
    assert [x.url for x in out.orderBy("_seq").collect()] == ["b", "c"]


def test_dedupe_before_limit_and_empty(spark):
    assert [x.url for x in relation.dedupe_and_truncate(rows(spark, ["a", "a", "b", "c"]), 3).collect()] == ["a", "b", "c"]
    assert relation.combine(rows(spark, ["a"]).limit(0), limit=5).count() == 0
    assert [x.url for x in relation.nth(rows(spark, ["a", "b"]), 2).collect()] == ["b"]


def test_sort_by_date_puts_undated_last(spark):
    data = [(1, None), (2, datetime(2026, 9, 19)), (3, datetime(2026, 9, 20))]
    df = spark.createDataFrame([(i, "t", str(i), "s", d) for i, d in data], "_seq bigint, title string, url string, snippet string, published timestamp")
    assert [x.url for x in relation.combine(df, sort="date").collect()] == ["3", "2", "1"]


def test_streaming_watch(spark, tmp_path):
    source = str(tmp_path / "in")
    store = watch.WatchState(spark, str(tmp_path / "state"))
    stream = lambda: spark.readStream.schema(rows(spark, ["a"]).schema).parquet(source)
    taken = []
    for urls in (["a", "b"], ["a", "b"], ["b", "c"]):
        rows(spark, urls).coalesce(1).write.mode("append").parquet(source)
        watch.start(stream(), store, "w", str(tmp_path / "out"), str(tmp_path / "cp"), now=5).awaitTermination(120)
        taken.append(store.read().count())
    assert taken == [2, 2, 3]


def test_file_sink(spark, tmp_path):
    path = tmp_path / "o.jsonl"
    assert sinks.write_file(rows(spark, ["a", "b"]), str(path), "jsonl") == 2
    assert path.read_text().startswith('{"title":"ta","url":"a","snippet":"s","published":null}\n')
    (tmp_path / "l").symlink_to(path)
    for bad in (tmp_path / "l", tmp_path / "no" / "x"):
        with pytest.raises(ConfigError):
            sinks.write_file(rows(spark, ["a"]), str(bad))
    assert sinks.output_mode(None, None, True, True) == "json"


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('engine = "DDG"\nmax_results = 500\ncontact_email = " "\n')
    c = config.load(str(p), lang="de")
    assert (c.engine, c.max_results, c.contact_email, c.lang) == ("duckduckgo", 50, None, "de")
    p.write_text("nope = 1\n")
    for bad in (str(p), str(tmp_path / "none")):
        with pytest.raises(ConfigError):
            config.load(bad)
    config.write_default(str(tmp_path / "new.toml"))
    assert config.load(str(tmp_path / "new.toml")) == config.checked(config.Config())
    with pytest.raises(ConfigError):
        config.write_default(str(tmp_path / "new.toml"))
    assert registry.resolve("X") == "fxtwitter"


def test_payload_source(spark, tmp_path):
    from lodestar.sources import payloads

    data = [(i, "hackernews" if i % 2 else "npm", 200, "", i * 10, "{}") for i in range(10)]
    spark.createDataFrame(data, "request_id bigint, engine string, status int, content_type string, created bigint, body string").write.parquet(str(tmp_path / "p"))
    payloads.register(spark)
    df = spark.read.format("lodestar").option("path", str(tmp_path / "p")).option("engine", "hackernews").load()
    assert sorted(x.request_id for x in df.where((F.col("created") >= 30) & (F.col("created") < 80)).collect()) == [3, 5, 7]


def test_robots_keep_repeated_requests_and_normal_paths(spark):
    asked = spark.createDataFrame([("https://a.example/caf%c3%a9/x",)] * 3 + [("https://a.example/open",)], "url string")
    rules = spark.createDataFrame([("https://a.example", "/caf%C3%A9/", False)], "origin string, pattern string, allow boolean")
    got = [tuple(r) for r in control.robots_gate(asked, rules).collect()]
    assert sorted(got) == [("https://a.example/caf%c3%a9/x", False)] * 3 + [("https://a.example/open", True)]
    body = "User-agent: *\n" + "# pad\n" * 90_000 + "Disallow: /late\n"
    assert web.parse_robots_text(body) == [] and web.parse_robots_text(body.replace("# pad\n", "")) == [("/late", False)]


def test_deep_feeds_are_refused():
    item = "<item><title>x</title></item>"
    assert len(parsers.feed_entries(f"<rss><channel>{item}</channel></rss>")) == 1
    assert parsers.feed_entries("<rss>" + "<a>" * 1600 + item + "</a>" * 1600 + "</rss>") is None
    assert len(parsers.feed_entries("<rss>" + "<a>" * 1400 + item + "</a>" * 1400 + "</rss>")) == 1


def test_functions_in_sql(spark):
    registered.register(spark)
    got = spark.sql("SELECT split_passages('# One\\nbody') AS p, size(feed_entries('<rss><item><title>t</title></item></rss>')) AS n, parse_robots('User-agent: *\\nDisallow: /x')[0].pattern AS r").first()
    assert (got.p, got.n, got.r) == (["# One\nbody"], 1, "/x")
    got = spark.sql("SELECT f.place, f.title FROM VALUES ('<rss><item><title>t</title></item><item><title>u</title></item></rss>'), ('no'), (NULL) AS p(body), LATERAL feed_of(body) AS f").collect()
    assert sorted(map(tuple, got)) == [(1, "t"), (2, "u")]


def test_waits_lie_within_the_backoff(spark):
    rows = spark.range(200).select(control.backoff_wait_ms(F.lit(3), "id").alias("w")).collect()
    assert {0 <= r.w <= 3200 for r in rows} == {True} and min(r.w for r in rows) < 400 and len({r.w for r in rows}) > 100
