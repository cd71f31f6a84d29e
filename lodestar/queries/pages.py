"""Queries over pages: extraction, URLs, redirects, egress and robots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import html as H
from lodestar.functions import text as T
from lodestar.functions import web
from lodestar.operators import control
from lodestar.queries.base import golden, query, table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


#: SQL for the text of the one article of a page.
ENTITIES = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
ARTICLE = (
    r"a AS (SELECT page_id, url, html, regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1) AS inner_html FROM pages), "
    r"b AS (SELECT *, regexp_replace(regexp_replace(inner_html, '(?s)<(script|style|form|svg|iframe|noscript)[^>]*>.*?</(script|style|form|svg|iframe|noscript)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h1 FROM a), "
    r"c AS (SELECT *, regexp_replace(h1, '(?s)<div class=\"(ad|share|comment|banner)\">.*?</div>', '', 'g') AS h2 FROM b), "
    r"d AS (SELECT *, regexp_replace(regexp_replace(h2, '</?(p|h[1-6]|li|blockquote|pre|tr|ul|ol)[^>]*>|<br ?/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM c), "
    f"e AS (SELECT *, array_to_string(list_filter(list_transform(string_split({ENTITIES.format('t')}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM d)"
)
TITLE = ENTITIES.format("trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))")


@query(f"WITH {ARTICLE} SELECT page_id, {TITLE} AS title, length(substr(text, 1, 20000)) AS chars, length(text) > 20000 AS truncated, substr(text, 1, 20000) AS text FROM e")
def fetch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = H.fetch(_pages(spark, sf_dir))
    title = F.when(F.col("kind").isNull(), F.coalesce("title", F.lit("")))  # as in SQL, empty if the page has none
    return got.select("page_id", title.alias("title"), "chars", "truncated", "text")


@query()
def fetch_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.fetch(_pages(spark, sf_dir), markdown=True).select("page_id", "title", "chars", "truncated", "text")


@query(f"SELECT page_id, {TITLE} AS title, length(substr(html, 1, 2000)) AS chars, length(html) > 2000 AS truncated, substr(html, 1, 2000) AS text FROM pages")
def fetch_raw_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.fetch_raw(_pages(spark, sf_dir), max_chars=2000).select("page_id", "title", "chars", "truncated", "text")


@query(f"SELECT page_id, {TITLE} AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", H.title_scan("html").alias("title"))


@query(
    f"WITH {ARTICLE}, s AS (SELECT page_id, {TITLE} AS title, url, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM e) "
    "SELECT page_id, CASE WHEN title = '' THEN url ELSE title END AS title, CASE WHEN length(t) > 300 THEN substr(t, 1, 297) || '...' ELSE t END AS snippet FROM s"
)
def fetch_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetched page as a result row: title or URL, and the start of the text."""
    got = H.fetch(_pages(spark, sf_dir))
    return got.select("page_id", T.snippet(F.coalesce(F.nullif("title", F.lit("")), "url")).alias("title"), T.snippet("text").alias("snippet"))


@query(
    f"WITH d AS (SELECT doc_id, doc_id % 4 AS k, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n FROM documents) "
    f"SELECT doc_id, CASE WHEN k = 0 THEN 'semantic' WHEN k < 3 AND n >= {H.DENSE} THEN 'dense' ELSE 'body' END AS container FROM d"
)
def container_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in an element that says what it is, in a plain block, in one among links, and in none."""
    k = F.col("doc_id") % 4
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    inside = (
        F.when(k == 0, F.concat(F.lit("<main><p>"), text, F.lit("</p></main>"))).when(k == 1, F.concat(F.lit("<div><p>"), text, F.lit("</p></div><footer><p>foot</p></footer>")))
        .when(k == 2, F.concat(F.lit("<nav><p>menu</p></nav><section><p>"), text, F.lit("</p></section>"))).otherwise(F.concat(F.lit("<span>"), text, F.lit("</span>")))
    )
    made = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<html><body>"), inside, F.lit("</body></html>")).alias("html"), F.lit("https://e.example/").alias("url"))
    return H.extracted(made).select("doc_id", F.col("page.container").alias("container"))


@query()
def html_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", H.html_depth("html").alias("depth"))


golden(
    "html_depth_cases",
    [("<div><div><div></div></div></div>", 3), ("<p>" * 5000, 0), ("<div/>" * 50, 50), ("<svg>" + "<path/>" * 500 + "</svg>", 1), ("<script><div><div></script><b></b>", 1), ("<!-- <div> --><i>x</i>", 1)],
    lambda c: H.html_depth(c),
    "bigint",
)


@query()
def safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = H.safe_links("html", "url")
    return _pages(spark, sf_dir).select("page_id", F.posexplode(links).alias("pos", "link")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


@query("SELECT page_id, octet_length(encode(html)) > 4096 AS body_capped, length(html) > 3000 AS over_chars, octet_length(encode(html)) > 4096 OR length(html) > 3000 AS truncated FROM pages")
def truncate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.octet_length("html") > 4096
    _, _, why = H.capped(F.col("html"), body, max_chars=3000)
    return _pages(spark, sf_dir).select("page_id", body.alias("body_capped"), (F.length("html") > 3000).alias("over_chars"), why.alias("truncated"))


@query("SELECT page_id, page_id % 3 = 0 AS challenge FROM pages")
def challenge_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page gets a tell-tale form; the others are ordinary pages."""
    form = F.when(F.col("page_id") % 3 == 0, F.lit("<form ID=\"challenge-form\">")).otherwise(F.lit("<p>just a moment</p>"))
    return _pages(spark, sf_dir).select("page_id", web.is_challenge(F.concat("html", form)).alias("challenge"))


@query("SELECT page_id, md5(html) AS body FROM pages")
def decode_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as UTF-8, UTF-16 with a mark, and under a wrong label with a mark, decode to themselves."""
    utf16 = F.encode("html", "UTF-16")
    marked = F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.encode("html", "UTF-8"))
    kind = F.col("page_id") % 3
    data = F.when(kind == 0, F.encode("html", "UTF-8")).when(kind == 1, utf16).otherwise(marked)
    label = F.when(kind == 2, F.lit("text/html; charset=latin-1")).otherwise(F.lit("text/html"))
    return _pages(spark, sf_dir).select("page_id", F.md5(H.decode_body(data, label).cast("binary")).alias("body"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]+$') THEN url || '/' ELSE url END AS url FROM pages")
def url_http_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", web.http_url("url").alias("url")).where("url is not null")


golden(
    "url_cases",
    [
        ("HTTPS://Shop.Example", "https://shop.example/"), ("http://shop.example:80/cart?n=2#top", "http://shop.example/cart?n=2#top"), ("https://shop.example:8443", "https://shop.example:8443/"), ("sftp://shop.example/", None),
        ("http://ann@shop.example/", None), ("data:text/plain,x", None), ("cart/items", None), ("  ", None),
    ],
    web.http_url,
)


@query("SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) END AS path FROM pages")
def url_origin_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", web.origin("url").alias("origin"), web.path_query("url").alias("path"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'credentials in URL' WHEN 1 THEN 'scheme not allowed: ftp' WHEN 2 THEN 'refusing to connect to 10.1.2.3' END AS error FROM pages")
def egress_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    bare = F.regexp_replace("url", "^https?://", "")
    url = F.when(k == 0, F.concat(F.lit("https://u:p@"), bare)).when(k == 1, F.concat(F.lit("ftp://"), bare)).when(k == 2, F.lit("http://10.1.2.3/x")).otherwise(F.col("url"))
    return _pages(spark, sf_dir).select("page_id", web.egress_error(url).alias("error"))


@query("SELECT event_id, ip, b AS blocked FROM (SELECT event_id, (user_id % 256) || '.' || (event_id % 256) || '.' || (user_id * 7 % 256) || '.1' AS ip, user_id % 256 AS a, event_id % 256 AS c, user_id * 7 % 256 AS d FROM events) t, LATERAL (SELECT a IN (0, 10, 127) OR (a = 100 AND c BETWEEN 64 AND 127) OR a >= 224 OR (a = 169 AND c = 254) OR (a = 172 AND c BETWEEN 16 AND 31) OR (a = 192 AND (c = 168 OR (c = 0 AND d IN (0, 2)) OR (c = 88 AND d = 99))) OR (a = 198 AND (c IN (18, 19) OR (c = 51 AND d = 100))) OR (a = 203 AND c = 0 AND d = 113) AS b) x")
def blocked_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ip = F.concat_ws(".", (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"), (F.col("user_id") * 7 % 256).cast("string"), F.lit("1"))
    return e.select("event_id", ip.alias("ip")).withColumn("blocked", web.blocked_ipv4("ip"))


golden(
    "blocked_ipv6",
    [("::", True), ("2a00:1450:4001::8a", False), ("::ffff:172.20.1.1", True), ("64:ff9b::c0a8:101", True), ("2002:a00:1::5", True), ("2002:808:808::5", False), ("fe9f::7", True), ("::ffff:9.9.9.9", False), ("::ffff:0:10.0.0.9", True),
     ("2001:0:1:1:1:1:80ff:fffe", True), ("2001:db8:7::", True), ("fdab::2", True), ("ff05::9", True), ("1:2:3:4:5:6:7:8", False), ("12345::", False), ("some name", False), ("192.168.4.4", True), ("1:2:3", False)],
    web.blocked_ip,
    "boolean",
)
golden(
    "egress_hosts",
    [
        ("http://[::1]:8080/", "refusing to connect to [::1]"), ("http://[fd12::7]/a", "refusing to connect to [fd12::7]"), ("http://[::ffff:192.168.0.9]/", "refusing to connect to [::ffff:192.168.0.9]"),
        ("http://[2a00:1450::5]/", None), ("http://[1::2::3]/", "not a URL"), ("http://3232235777/", "refusing to connect to 3232235777"), ("http://0xa9fe0001/", "refusing to connect to 0xa9fe0001"), ("http://0177.0.0.1/", "refusing to connect to 0177.0.0.1"),
        ("http://127.1/", "refusing to connect to 127.1"), ("http://10.0.0.256/", "not a URL"), ("http://9.9.9.9/", None), ("http://134744072/", None), ("http://localhost./", "refusing to connect to localhost."), ("http://app.localhost/", "refusing to connect to app.localhost"),
        ("https://shop.example/", None), ("https://a_b.example/x", None), ("gopher://x.example/", "scheme not allowed: gopher"),
    ],
    web.egress_error,
)
golden(
    "dns_answer_filter",
    [("93.184.215.14,192.168.7.7", "93.184.215.14"), ("169.254.1.1", ""), ("2a00:1450::5,fd00::9,::1", "2a00:1450::5"), ("45.33.32.156,64.13.134.52", "45.33.32.156,64.13.134.52")],
    lambda c: F.array_join(web.allowed_addresses(F.split(c, ",")), ","),
)
golden(
    "dns_answer_error",
    [("93.184.215.14,192.168.7.7", None), ("169.254.1.1,::1", "refusing to connect: all addresses are blocked"), ("", "no addresses"), ("2a00:1450::5", None)],
    lambda c: web.resolve_error(F.filter(F.split(c, ","), lambda x: x != "")),
)
golden("open_url_check", [("https://shop.example/cart", None), ("http://ann:pw@shop.example/", "credentials in URL"), ("tel:5551234", "scheme not allowed")], web.open_error)


@query("SELECT page_id, CASE WHEN page_id % 4 < 3 THEN CASE WHEN regexp_matches(url, '^https?://[^/]+$') THEN url || '/' ELSE url END END AS target FROM pages")
def unwrap_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, enc = F.col("page_id") % 4, F.url_encode("url")
    href = (
        F.when(k == 0, F.concat(F.lit("//duckduckgo.com/l/?uddg="), enc, F.lit("&rut=1"))).when(k == 1, F.concat(F.lit("/l/?uddg="), enc))
        .when(k == 2, F.concat(F.lit("https://links.duckduckgo.com/l/?x=1&uddg="), enc)).otherwise(F.concat(F.lit("https://duckduckgo.com/y.js?uddg="), enc))
    )
    return _pages(spark, sf_dir).select("page_id", web.unwrap_redirect(href).alias("target"))


@query("SELECT page_id, CASE WHEN page_id % 4 < 3 THEN url END AS target FROM pages")
def decode_redirect_b64(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, b64 = F.col("page_id") % 4, F.base64(F.col("url").cast("binary"))
    safe = F.rtrim(F.translate(b64, "+/\r\n", "-_"), F.lit("="))
    href = (
        F.when(k == 0, F.concat(F.lit("https://www.bing.com/ck/a?!&&p=1&u=a1"), safe, F.lit("&ntb=1"))).when(k == 1, F.concat(F.lit("https://bing.com/ck/a?u=a1"), F.url_encode(F.translate(b64, "\r\n", ""))))
        .when(k == 2, F.concat(F.lit("https://www.bing.com/rd?u="), safe)).otherwise(F.concat(F.lit("https://www.bing.com/other?u=a1"), safe))
    )
    return _pages(spark, sf_dir).select("page_id", web.decode_redirect_b64(href).alias("target"))


golden("image_format", [("https://pics.example/Cat.PNG?s=9", "png"), ("dog.gif", "gif"), ("go?next=/cat.png", ""), ("bird.JPEG#x", "jpg"), ("https://pics.example/all.zip", "")], web.image_format)
golden("mime_extension", [("image/webp; level=3", "webp"), ("Image/GIF", "gif"), ("video/mp4", None)], web.type_extension)
golden("content_type_gate", [("text/html; charset=utf-8", True), ("", True), (None, True), ("application/xhtml+xml", True), ("application/pdf", False)], web.accepts_type, "boolean")
golden(
    "img_sniff",
    [("FFD8FFE000104A46", "jpg"), ("89504E470D0A1A0A00", "png"), ("474946383961", "gif"), ("524946460000000057454250", "webp"), ("3C737667", None), ("424D00", "bmp")],
    lambda c: web.sniff_image(F.unhex(c)),
)
golden(
    "channel_grammar",
    [("@gardening", "gardening"), ("https://t.me/s/city_news?q=snow", "city_news"), ("t.me/weather_now/88", "weather_now"), ("xy", None), ("no spaces?!", None), ("@gardening_2 red tulips", "gardening_2")],
    web.channel_name,
)
golden("channel_keywords", [("@gardening red tulips", "red tulips"), ("https://t.me/s/city_news?q=late+snow", "late snow"), ("@gardening", None)], web.channel_keywords)
golden("wiki_language", [("de-AT", "de"), ("FR", "fr"), ("pt_BR", "pt"), ("a/b", "en")], web.wiki_language)
golden("ddg_kl", [("jp", "jp-jp"), ("US", "us-en"), ("br", "br-pt"), ("GB", "uk-en"), ("ja-JP", "jp-jp"), ("zh-Hant-HK", "hk-tzh"), ("es-419", "xl-es"), ("en", None), ("", None)], web.ddg_region)
golden("bing_cc", [("de", "de"), ("en-GB", "gb"), ("en", None), ("es-419", None)], web.bing_country)
golden("bing_setlang", [("de", None), ("en-GB", "en"), ("fr", None), ("ja", "ja")], web.bing_language)
golden(
    "parse_region",
    [("de", "de//"), ("en", "/en/"), ("en-US", "us/en/"), ("zh_hant_tw", "tw/zh/Hant"), ("x-us", "us//"), ("", "//"), ("zh-Hans", "/zh/Hans")],
    lambda c: F.concat_ws("/", *(F.coalesce(web.parse_region(c)[x], F.lit("")) for x in ("country", "language", "script"))),
)

golden(
    "robots_path",
    [("/caf%c3%a9/x", "/caf%C3%A9/x"), ("/café", "/caf%C3%A9"), ("/plain?a=1", "/plain?a=1"), ("/50%", "/50%"), ("/%7euser/ü", "/%7Euser/%C3%BC")],
    web.normal_path,
)

ROBOTS = "User-agent: other\nDisallow: /all\n\nUser-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*?*utm_source\nDisallow: /fr/*.html$\nAllow: /\n"
RULES = "('/en/', FALSE), ('/en/1', TRUE), ('/*?*utm_source', FALSE), ('/fr/*.html$', FALSE), ('/', TRUE)"


@query(f"SELECT row_number() OVER () AS rule_no, * FROM (VALUES {RULES}) t(pattern, allow)")
def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = spark.createDataFrame([(ROBOTS,)], "body string")
    rules = body.select(F.posexplode(web.parse_robots("body")).alias("n", "r"))
    return rules.select((F.col("n") + 1).cast("bigint").alias("rule_no"), "r.pattern", "r.allow")


golden(
    "robots_match",
    [("/shop/|/shop/cart", True), ("/s*p$|/sloop", True), ("/s*p$|/sloops", False), ("/*.cgi|/run/me.cgi?n", True), ("/end$|/end", True), ("/end$|/ends", False), ("|/any", True), ("/q.r|/qZr", False), ("/*$|/k", True)],
    lambda c: web.robots_match(F.get(F.split(c, r"\|"), F.lit(0)), F.get(F.split(c, r"\|"), F.lit(1))),
    "boolean",
)


@query(
    "WITH u AS (SELECT page_id, CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) END AS p FROM pages), "
    f"r AS (SELECT * FROM (VALUES {RULES}) t(pattern, allow)), "
    "m AS (SELECT page_id, pattern, allow FROM u JOIN r ON CASE pattern WHEN '/*?*utm_source' THEN regexp_matches(p, '^/.*\\?.*utm_source') WHEN '/fr/*.html$' THEN regexp_matches(p, '^/fr/.*\\.html$') ELSE starts_with(p, pattern) END) "
    "SELECT page_id, first(allow ORDER BY length(pattern) DESC, allow DESC) AS robots_allowed FROM m GROUP BY page_id"
)
def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).select("page_id", "url")
    origins = pages.select(web.origin("url").alias("origin")).distinct()
    rules = origins.select("origin", F.explode(web.parse_robots(F.lit(ROBOTS))).alias("r")).select("origin", "r.pattern", "r.allow")
    return control.robots_gate(pages, rules).select("page_id", "robots_allowed")
