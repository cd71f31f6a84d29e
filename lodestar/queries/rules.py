"""The row functions over whole tables: inputs are built from each row, and the SQL states what must come out.

These take the place of the queries over literal cases, which stay as tests (``base.CASES``).
"""

from __future__ import annotations
from collections.abc import Callable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from lodestar import errors
from lodestar import html as H
from lodestar.functions import text as T
from lodestar.functions import timefn, web
from lodestar.operators import control
from lodestar.queries.base import query, quoted, table
from lodestar.queries.control import CATALOG, _utc
from lodestar.sources import registry
KEYS = {"events": "event_id", "pages": "page_id", "part": "p_partkey", "documents": "doc_id"}
def derived(name: str, source: str, sql: str, fn: Callable[[Column], Column]) -> None:
    """``fn`` of what ``inputs`` has for each row of a table. Several inputs take turns by the row's key."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key, given = F.col(KEYS[source]), inputs()[name]
        turn = F.pmod(key, F.lit(len(given)))
        made = F.lit(None).cast("string")
        for i, g in enumerate(given):
            made = F.when(turn == i, F.lit(g) if isinstance(g, str) else g).otherwise(made)
        return table(spark, sf_dir, source).select(key, made.alias("given")).select(key, fn(F.col("given")).alias("result"))

    query(f"SELECT {KEYS[source]}, {sql} AS result FROM (SELECT *, {KEYS[source]} AS k FROM {source})", name)(run)

def turns(*results: str) -> str:
    """SQL for results that take turns by the key k."""
    return f"CASE k % {len(results)} " + " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(results)) + " END"

def glue(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

Z = "|| '+00:00'"


def inputs() -> dict[str, tuple[Column | str, ...]]:
    """What each function is given: one input for a row, or several that take turns."""
    E, G, P, D = (F.col(KEYS[t]) for t in ("events", "pages", "part", "documents"))
    NAME, LANG, SOURCE = F.col("p_name"), F.col("lang"), F.col("source")
    TS = F.col("ts")
    SECONDS = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    LATER = F.expr("timestampadd(SECOND, event_id % 100, TIMESTAMP_NTZ'2024-03-03 11:20:20')")
    TONGUE = F.element_at(F.array(*map(F.lit, TONGUES)), (F.floor(E / 4) % 4 + 1).cast("int"))
    LAND = F.element_at(F.array(*map(F.lit, LANDS)), (F.floor(E / 16) % 4 + 1).cast("int"))
    TAGS = (glue(TONGUE, "-", F.upper(LAND)), glue(F.upper(TONGUE), "_latn_", LAND), LAND, "")
    LOW = F.lower(F.hex(E % 60_000))
    SIX = (glue("fd00::", LOW), glue("2a00:1450::", LOW), glue("::ffff:10.0.", E % 200, ".7"), glue("2001:db8::", LOW), glue("fe80::", LOW), glue("2606:4700::", LOW), glue("::ffff:9.9.", E % 200, ".7"))
    return {
        "ts_unix": ((-SECONDS).cast("string"), SECONDS.cast("string"), "0", SECONDS.cast("string")),
        "ts_rfc2822": (glue(F.date_format(TS, "EEE, dd MMM yyyy HH:mm:ss"), " +0000"), glue(F.date_format(TS, "d MMM yyyy HH:mm:ss"), " -0500"), glue(F.date_format(TS, "EEE, d MMM yyyy HH:mm:ss"), " GMT"), F.date_format(TS, "'in' MMMM")),
        "ts_pubmed": (F.date_format(TS, "yyyy MMM d"), F.date_format(TS, "yyyy"), F.date_format(TS, "yyyy MMM"), F.date_format(TS, "'undated' MMM")),
        "ts_date_parts": (F.date_format(TS, "yyyy,M,d"), F.date_format(TS, "yyyy,M"), F.date_format(TS, "yyyy"), F.date_format(TS, "yyyy,'14'")),
        "ts_iso_cases": (glue(F.date_format(TS, "yyyy-MM-dd'T'HH:mm:ss"), "-01:30"), glue(F.date_format(TS, "yyyy-MM-dd'T'HH:mm:ss"), "Z"), F.date_format(TS, "d MMM"), F.date_format(TS, "yyyy-MM")),
        "retry_after_parse": ((E % 100).cast("string"), glue(F.date_format(LATER, "EEE, dd MMM yyyy HH:mm:ss"), " GMT"), glue("in ", E)),
        "error_classify": (glue("lookup: refusing to connect to 10.0.0.", E), glue("connection reset by ", E), glue(E, ": too many redirects"), glue("blocked by egress policy: ", E), glue("timed out after ", E)),
        "error_render": (glue("http|", E), glue("parse|no ", E), glue("response_too_large|", E), glue("no_results|nothing ", E), glue("strange|", E)),
        "accept_language": (LANG, glue(LANG, "_CA"), glue(LANG, " / ", D), F.lit(None).cast("string")),
        "wiki_language": (glue(LANG, "-AT"), F.upper(LANG), glue(LANG, "_BR"), glue(LANG, "/", D)),
        "parse_region": (*TAGS,),
        "bing_cc": (*TAGS,),
        "bing_setlang": (*TAGS,),
        "ddg_kl": (*TAGS,),
        "encode_path": (glue("a ", NAME, "/b#%?é", P),),
        "sanitize_name": (glue(NAME, " /\\ ", P, ".png"), "aux", "..."),
        "sanitize_line": (glue(NAME, "\t\n\x07", P, "‮é"),),
        "query_terms": (glue("The ", F.upper(NAME), ", ", NAME, " of ", P),),
        "tokenize_cases": (glue("Where is the ", F.initcap(NAME), " 東京都 ", P),),
        "unescape_entities": (glue(NAME, " &amp; &lt;&#", 65 + P % 26, ";&gt;&#x", F.hex(48 + P % 10), "; &nope;"),),
        "extract_tag": (glue("<item><names>no</names><name k='", P, "'>", NAME, "</name></item>"), glue("<names>", NAME, "</names>"), glue("<name/>", NAME)),
        "extract_attr": (glue('<img data-src="lazy" src="', NAME, '" alt="', P, '">'), glue("<img alt='", NAME, "'>")),
        "strip_tags_cases": (glue("a <em>", NAME, "</em><br/> < ", P, "<!-- no --> b"),),
        "html_depth_cases": (F.concat(F.expr("repeat('<div>', int(page_id % 40))"), F.lit("x"), F.expr("repeat('</div>', int(page_id % 40))"), F.lit("<i>y</i>")),),
        "url_cases": (glue("HTTPS://Shop", G, ".Example:443/Cart?n=", G, "#top"), glue("http://shop", G, ".example:81"), glue("sftp://shop.example/", G), glue("http://ann@shop.example/", G), glue("cart/", G)),
        "blocked_ipv6": (*SIX,),
        "egress_hosts": (*(glue("http://[", s, "]:8080/x") for s in SIX),),
        "dns_answer_filter": (glue("93.184.", E % 200, ".14,192.168.", E % 250, ".7"), glue("169.254.1.", E % 250), glue("2a00:1450::", LOW, ",fd00::9,::1")),
        "dns_answer_error": (glue("93.184.", E % 200, ".14,10.0.0.1"), glue("169.254.1.", E % 250, ",::1"), ""),
        "open_url_check": (F.col("url"), F.regexp_replace("url", "://", "://ann:pw@"), glue("tel:", G)),
        "image_format": (*(glue("https://pics.example/", P, f".{x}?s=", P, "#", P) for x in EXTENSIONS),),
        "mime_extension": (*(glue(f" image/{x}; level=", P) for x in EXTENSIONS),),
        "content_type_gate": (glue("text/html; charset=", G), glue(" Application/XHTML+xml;", G), glue("application/pdf; v=", G), glue("text/html", G)),
        "img_sniff": (*(glue(x, F.lpad(F.hex(P), 8, "0"), y) for x, y in (("FFD8FF", ""), ("89504E470D0A1A0A", ""), ("474946383961", ""), ("52494646", "57454250"), ("3C737667", ""), ("424D", ""))),),
        "channel_grammar": (glue("@garden_", G, " tulips"), glue("https://t.me/s/news_", G, "?q=snow"), glue("t.me/weather", G, "/88"), "xy", glue("no-", G)),
        "channel_keywords": (glue("@gardening  red ", G), glue("https://t.me/s/city_news?q=late+", G), glue("@garden_", G)),
        "robots_path": (glue("/caf%c3%a9/", G), glue("/café?", G), glue("/plain?a=", G), glue("/50%/", G)),
        "robots_match": (glue("/p/", E % 7, "|/p/", E % 300), glue("/p/", E % 7, "*/", E % 5, "$|/p/", E % 300, "/", E % 9), glue("/q/", E % 30, "$|/q/", E % 20), glue("/*.cgi|/run/", E, ".cgi?x")),
    }


# --- times
SHOWN = "strftime({}, '%Y-%m-%dT%H:%M:%S') " + Z
derived("ts_unix", "events", turns("NULL", SHOWN.format("ts"), "NULL", SHOWN.format("ts")), lambda c: _utc(timefn.unix(c.cast("bigint"))))
derived("ts_rfc2822", "events", turns(SHOWN.format("ts"), SHOWN.format("ts + INTERVAL 5 HOUR"), SHOWN.format("ts"), "NULL"), lambda c: _utc(timefn.rfc2822(c)))
derived("ts_pubmed", "events", turns("strftime(ts, '%Y-%m-%d')", "strftime(ts, '%Y-01-01')", "strftime(ts, '%Y-%m-01')", "NULL"), lambda c: F.date_format(timefn.pubmed(c), "yyyy-MM-dd"))
derived("ts_date_parts", "events", turns("strftime(ts, '%Y-%m-%d')", "strftime(ts, '%Y-%m-01')", "strftime(ts, '%Y-01-01')", "NULL"), lambda c: F.date_format(timefn.date_parts(F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("bigint"))), "yyyy-MM-dd"))
derived("ts_iso_cases", "events", turns(SHOWN.format("ts + INTERVAL 90 MINUTE"), SHOWN.format("ts"), "NULL", "NULL"), lambda c: _utc(timefn.iso(c)))
derived("retry_after_parse", "events", turns("CASE WHEN k % 100 <= 60 THEN k % 100 END", "CASE WHEN k % 100 <= 60 THEN k % 100 END", "NULL"), lambda c: control.retry_after_s(c, F.expr("timestamp'2024-03-03 11:20:20+00:00'")))

# --- failures
derived("error_classify", "events", turns("'blocked_by_policy'", "'network'", "'blocked_by_policy'", "'blocked_by_policy'", "'network'"), errors.of_transport)
derived("error_render", "events", turns("'HTTP ' || k || ' from upstream'", "'failed to parse response: no ' || k", "'response exceeded the ' || k || '-byte limit'", "'nothing ' || k", "NULL"), lambda c: errors.render(F.get(F.split(c, r"\|"), F.lit(0)), F.get(F.split(c, r"\|"), F.lit(1))))

# --- languages and regions
derived("accept_language", "documents", turns("CASE WHEN lang = 'en' THEN 'en' ELSE lang || ',' || lang || ';q=0.9,en;q=0.8' END", "CASE WHEN lang = 'en' THEN 'en-CA,en;q=0.9' ELSE lang || '-CA,' || lang || ';q=0.9,en;q=0.8' END", "'en-US,en;q=0.9'", "'en-US,en;q=0.9'"), T.accept_language)
derived("wiki_language", "documents", turns("lang", "lang", "lang", "'en'"), web.wiki_language)
TONGUES, LANDS = ("de", "fr", "pt", "nl"), ("at", "ca", "br", "be")
TONGUE_SQL, LAND_SQL = (f"list_extract([{', '.join(map(quoted, x))}], CAST(k // {n} % 4 + 1 AS BIGINT))" for x, n in ((TONGUES, 4), (LANDS, 16)))
LONE = f"CASE WHEN {LAND_SQL} <> '' THEN {LAND_SQL} END"
derived("parse_region", "events", turns(f"{LAND_SQL} || '/' || {TONGUE_SQL} || '/'", f"{LAND_SQL} || '/' || {TONGUE_SQL} || '/Latn'", f"{LAND_SQL} || '//'", "'//'"), lambda c: F.concat_ws("/", *(F.coalesce(web.parse_region(c)[x], F.lit("")) for x in ("country", "language", "script"))))
derived("bing_cc", "events", turns(LONE, LONE, LONE, "NULL"), web.bing_country)
derived("bing_setlang", "events", turns(TONGUE_SQL, TONGUE_SQL, "NULL", "NULL"), web.bing_language)
derived("ddg_kl", "events", turns(f"{LAND_SQL} || '-' || {TONGUE_SQL}", f"{LAND_SQL} || '-' || {TONGUE_SQL}", f"CASE {LAND_SQL} WHEN 'br' THEN 'br-pt' WHEN 'at' THEN 'at-de' WHEN 'ca' THEN 'ca-en' ELSE 'be-fr' END", "NULL"), web.ddg_region)

# --- strings
derived("encode_path", "part", "'a%20' || replace(p_name, ' ', '%20') || '/b%23%25%3F%C3%A9' || k", T.encode_path)
derived("sanitize_name", "part", turns("replace(p_name, ' ', '-') || '-' || k || '.png'", "'aux-file'", "'image'"), lambda c: T.sanitize_name(c))
derived("sanitize_line", "part", "p_name || k || 'é'", T.sanitize_line)
derived("query_terms", "part", "p_name || ' ' || k", lambda c: F.array_join(T.query_terms(c), " "))
derived("tokenize_cases", "part", "p_name || ' 東京 京都 ' || k", lambda c: F.array_join(T.tokenize(c), " "))
derived("unescape_entities", "part", "p_name || ' & <' || chr(CAST(65 + k % 26 AS INTEGER)) || '>' || chr(CAST(48 + k % 10 AS INTEGER)) || ' &nope;'", lambda c: T.unescape_entities(c))
derived("extract_tag", "part", turns("p_name", "''", "''"), lambda c: T.extract_tag(c, "name"))
derived("extract_attr", "part", turns("p_name", "''"), lambda c: T.extract_attr(c, "src"))
derived("strip_tags_cases", "part", "'a ' || p_name || ' < ' || k || ' b'", T.strip_tags)
derived("html_depth_cases", "pages", "greatest(k % 40, 1)", lambda c: H.html_depth(c).cast("bigint"))

# --- addresses
derived("url_cases", "pages", turns("'https://shop' || k || '.example/Cart?n=' || k || '#top'", "'http://shop' || k || '.example:81/'", "NULL", "NULL", "NULL"), web.http_url)
LOW_SQL = "lower(to_hex(k % 60000))"
derived("blocked_ipv6", "events", f"k % 7 IN (0, 2, 3, 4)", web.blocked_ip)
NO = "'refusing to connect to ['"
derived("egress_hosts", "events", turns(f"{NO} || 'fd00::' || {LOW_SQL} || ']'", "NULL", f"{NO} || '::ffff:10.0.' || k % 200 || '.7]'", f"{NO} || '2001:db8::' || {LOW_SQL} || ']'", f"{NO} || 'fe80::' || {LOW_SQL} || ']'", "NULL", "NULL"), web.egress_error)
derived("dns_answer_filter", "events", turns("'93.184.' || k % 200 || '.14'", "''", "'2a00:1450::' || " + LOW_SQL), lambda c: F.array_join(web.allowed_addresses(F.split(c, ",")), ","))
derived("dns_answer_error", "events", turns("NULL", "'refusing to connect: all addresses are blocked'", "'no addresses'"), lambda c: web.resolve_error(F.filter(F.split(c, ","), lambda x: x != "")))
derived("open_url_check", "pages", turns("NULL", "'credentials in URL'", "'scheme not allowed'"), web.open_error)
EXTENSIONS = ("png", "JPEG", "gif", "zip")
derived("image_format", "part", turns("'png'", "'jpg'", "'gif'", "''"), web.image_format)
derived("mime_extension", "part", turns("'png'", "'jpg'", "'gif'", "NULL"), web.type_extension)
derived("content_type_gate", "pages", "k % 4 < 2", web.accepts_type)
derived("img_sniff", "part", turns("'jpg'", "'png'", "'gif'", "'webp'", "NULL", "'bmp'"), lambda c: web.sniff_image(F.unhex(c)))
derived("channel_grammar", "pages", turns("'garden_' || k", "'news_' || k", "'weather' || k", "NULL", "NULL"), web.channel_name)
derived("channel_keywords", "pages", turns("'red ' || k", "'late ' || k", "NULL"), web.channel_keywords)

# --- robots
derived("robots_path", "pages", turns("'/caf%C3%A9/' || k", "'/caf%C3%A9?' || k", "'/plain?a=' || k", "'/50%/' || k"), web.normal_path)
derived("robots_match", "events", turns("starts_with('/p/' || k % 300, '/p/' || k % 7)", "('/p/' || k % 300 || '/' || k % 9) LIKE ('/p/' || k % 7 || '%/' || k % 5)", "k % 30 = k % 20", "TRUE"), lambda c: web.robots_match(F.get(F.split(c, r"\|"), F.lit(0)), F.get(F.split(c, r"\|"), F.lit(1))))
@query("SELECT page_id, r.pattern, r.allow FROM (SELECT page_id, unnest([{'pattern': '/p/' || page_id, 'allow': FALSE}, {'pattern': '/p/' || page_id || '/open', 'allow': TRUE}]) AS r FROM pages WHERE page_id % 3 <> 2)")
def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body of each page, whose rules bind every agent, some, or another one."""
    G = F.col("page_id")
    agent = F.when(G % 3 == 0, "*").when(G % 3 == 1, "bot\nuser-agent: *").otherwise("bot")
    body = glue("User-agent: other\nDisallow: /all\n\nUser-agent: ", agent, "\nDisallow: /p/", G, " # no\nCrawl-delay: 3\nAllow: /p/", G, "/open\n")
    return table(spark, sf_dir, "pages").select(G, F.explode(web.parse_robots(body)).alias("r")).select("page_id", "r.pattern", "r.allow")


# --- engines

ASKED = ("ddg", "X", " wiki", "bing", "so", "nope")
@query(f"WITH {CATALOG} SELECT c.name, c.kind, c.position, count(e.event_id) AS n FROM c LEFT JOIN events e ON e.user_id % 20 = c.position GROUP BY ALL")
def engine_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every engine, with the events that fall to it."""
    asked = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).cast("int").alias("position")).agg(F.count("event_id").alias("n"))
    return registry.catalog(spark).join(asked, "position", "left").select("name", "kind", "position", F.coalesce("n", F.lit(0)).alias("n"))

@query(f"WITH {CATALOG}, q AS (SELECT event_id, list_extract([{', '.join(map(quoted, ASKED))}], CAST(event_id % 6 + 1 AS BIGINT)) AS asked FROM events) SELECT event_id, c.name FROM q LEFT JOIN c ON c.kind <> 'image' AND (c.name = lower(trim(asked)) OR list_contains(string_split(c.aliases, ','), lower(trim(asked))))")
def engine_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    E = F.col("event_id")
    asked = table(spark, sf_dir, "events").select("event_id", F.lower(F.trim(F.element_at(F.array(*map(F.lit, ASKED)), (E % 6 + 1).cast("int")))).alias("asked"))
    known = registry.catalog(spark).where("kind <> 'image'").select("name", F.explode(F.array_append("aliases", F.col("name"))).alias("alias"))
    return asked.join(F.broadcast(known), F.col("asked") == F.col("alias"), "left").select("event_id", "name")

@query(f"WITH {CATALOG}, w AS (SELECT * FROM c WHERE kind <> 'image'), o AS (SELECT a.position AS asked, row_number() OVER (PARTITION BY a.name ORDER BY a.name <> b.name, b.position) AS priority, b.name AS candidate FROM w a JOIN w b ON a.name = b.name OR (a.kind = 'web' AND b.kind = 'web')) SELECT event_id, priority, candidate FROM events JOIN o ON event_id % 15 = asked")
def fallback_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engines that each request may be sent to, in order."""
    E = F.col("event_id")
    catalog = registry.catalog(spark).where("kind <> 'image'")
    order = control.fallback_order(catalog).join(catalog.select(F.col("name").alias("engine"), "position"), "engine")
    asked = table(spark, sf_dir, "events").select("event_id", (E % 15).cast("int").alias("position"))
    return asked.join(F.broadcast(order), "position").select("event_id", "priority", "candidate")
