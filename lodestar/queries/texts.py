"""Queries over documents: string functions, tokens and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import registered
from lodestar.functions import text as T
from lodestar.operators import passages as P
from lodestar.queries.base import golden, query, quoted, table

TERMS = ["the", "of", "und", "de"]
RUN = r"[\p{L}\p{N}]+"
STOP = ", ".join(map(quoted, T.STOPWORDS))
TERMS_KEPT = ["tion", "der", "les", "ción"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


FLAT = r"trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))"


@query(f"WITH f AS (SELECT doc_id, {FLAT} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 300 THEN substr(t, 1, 297) || '...' ELSE t END AS snippet FROM f")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.snippet("text").alias("snippet"))


@query("SELECT doc_id, md5(text) AS clean FROM documents")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls put into every text are gone again."""
    marked = F.concat(F.lit("\x07‮"), F.col("text"), F.lit(""))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.sanitize_text(marked).cast("binary")).alias("clean"))


@query("SELECT doc_id, substr(text, 1, 500) AS head, length(substr(text, 1, 500)) AS chars, length(text) > 500 AS truncated FROM documents")
def truncate_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = T.truncate_chars("text", 500)
    return _docs(spark, sf_dir).select("doc_id", head.alias("head"), F.length(head).cast("bigint").alias("chars"), (F.length("text") > 500).alias("truncated"))


@query("SELECT doc_id, lang || ' · ' || source || CASE WHEN doc_id % 2 = 0 THEN ' · cited ' || n_chars ELSE '' END AS meta FROM documents")
def join_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("cited "), F.col("n_chars")))
    return _docs(spark, sf_dir).select("doc_id", T.join_meta(F.col("lang"), F.concat(F.lit(" "), F.col("source")), F.lit(""), cited).alias("meta"))


@query(r"SELECT page_id, md5(regexp_replace(html, '<(?:\s*[!?/][^>@]*|\s*[A-Za-z][A-Za-z0-9:-]*/*(?:\s[^>@]*)?)>', '', 'g')) AS plain FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags("html").cast("binary")).alias("plain"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS plain FROM documents")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped texts inside markup come back as they were."""
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<p class='x'>"), text, F.lit("</p><br/>"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.strip_html(html).cast("binary")).alias("plain"))


golden(
    "unescape_entities",
    [("Salt &amp; pepper", "Salt & pepper"), ("2 &lt; 3 &gt; 1", "2 < 3 > 1"), ("caf&#233; &#x20AC;5", "café €5"), ("&unknown; stays", "&unknown; stays"), ("tea&nbsp;pot", "tea pot"), ("a&b", "a&b")],
    lambda c: T.unescape_entities(c),
)
golden(
    "strip_tags_cases",
    [("one <em>two</em> three", "one two three"), ("width <2 m, depth> 1 m", "width <2 m, depth> 1 m"), ("write <ann@mail.example>", "write <ann@mail.example>"), ("line<hr>break", "linebreak"), ("<!doctype html>top", "top")],
    T.strip_tags,
)
golden("sanitize_name", [("holiday photo 7.png", "holiday-photo-7.png"), ("aux", "aux-file"), ("", "image"), ("ü" * 90, "ü" * 60)], lambda c: T.sanitize_name(c))
golden("encode_path", [("F#", "F%23"), ("New York/Bronx", "New%20York/Bronx"), ("50% off?", "50%25%20off%3F"), ("naïve", "na%C3%AFve")], T.encode_path)
golden("extract_tag", [("<item><name>pear</name></item>", "pear"), ("<name kind='x'>fig</name>", "fig"), ("<names>no</names>", ""), ("nothing", "")], lambda c: T.extract_tag(c, "name"))
golden("extract_attr", [('<img alt="cat" src="c.png">', "c.png"), ('<img data-src="lazy" src="now">', "now"), ("<img>", "")], lambda c: T.extract_attr(c, "src"))
golden(
    "accept_language",
    [("nl", "nl,nl;q=0.9,en;q=0.8"), ("fr-CA", "fr-CA,fr;q=0.9,en;q=0.8"), ("es_MX", "es-MX,es;q=0.9,en;q=0.8"), ("???", "en-US,en;q=0.9"), (None, "en-US,en;q=0.9")],
    T.accept_language,
)
golden(
    "tokenize_cases",
    [("Where is the Blue whale", "blue whale"), ("東京都", "東京 京都"), ("GPU計算は速い", "gpu 計算 算は は速 速い"), ("Ｃａｆé　２４", "café 24"), ("or with by", ""), ("山", "山")],
    lambda c: F.array_join(T.tokenize(c), " "),
)
golden("query_terms", [("Whale whale WHALES", "whale whales"), ("z y z", "z y"), ("what is it", "")], lambda c: F.array_join(T.query_terms(c), " "))

TOKENS = f"t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{RUN}')) AS w FROM documents), k AS (SELECT * FROM t WHERE w NOT IN ({STOP}))"


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT w) AS n_terms FROM k GROUP BY doc_id")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = lambda t: F.struct(F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_terms"))
    found = F.transform(F.filter(F.array(T.tokenize("text")), lambda t: F.size(t) > 0), sizes)  # made once a text
    return _docs(spark, sf_dir).select("doc_id", F.inline(found))


@query(f"WITH {TOKENS} SELECT doc_id, w AS term, count(*) AS f FROM k GROUP BY doc_id, w")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted within each document: a document is one row, so nothing is shuffled."""
    return _docs(spark, sf_dir).select("doc_id", F.inline(T.term_counts(T.tokenize("text")))).withColumnRenamed("n", "f")


def _bm25(last: str) -> str:
    cols = [f"len(list_filter(w, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(TERMS_KEPT)]
    parts = [f"CASE WHEN f{i} > 0 THEN ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / a)) ELSE 0 END" for i in range(4)]
    return (
        "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents), "
        "p AS (SELECT doc_id, unnest(range(len(ls))) AS idx, unnest(ls) AS passage FROM l), "
        f"w AS (SELECT *, list_filter(regexp_extract_all(lower(passage), '{RUN}'), lambda x: x NOT IN ({STOP})) AS w FROM p), "
        f"f AS (SELECT doc_id, idx, passage, len(w) AS len, {', '.join(cols)} FROM w), "
        f"s AS (SELECT *, count(*) OVER d AS n, greatest(avg(len) OVER d, 1.0) AS a, {', '.join(f'count(*) FILTER (f{i} > 0) OVER d AS d{i}' for i in range(4))} FROM f WINDOW d AS (PARTITION BY doc_id)), "
        f"b AS (SELECT *, {' + '.join(parts)} AS score FROM s), "
        f"k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) AS rank FROM b WHERE score > 0) {last}"
    )


@query(_bm25("SELECT DISTINCT doc_id, n, round(a, 3) AS avg_len, d0, d1, d2, d3 FROM s"))
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.stats(P.measured(P.by_line(_docs(spark, sf_dir)), TERMS_KEPT), TERMS_KEPT)
    return s.select("doc_id", "n", F.round("avg_len", 3).alias("avg_len"), *(F.get("df", F.lit(i)).alias(f"d{i}") for i in range(4)))


@query(_bm25("SELECT doc_id, CAST(idx AS BIGINT) AS idx, round(score, 3) AS score FROM b WHERE score > 0"))
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Whole hits under a generator would be pruned into one expression for each field.
    hits = F.transform("hits", lambda h: F.struct(h["idx"].cast("bigint").alias("idx"), F.round(h["score"], 3).alias("score")))
    return P.scored_pages(_docs(spark, sf_dir), TERMS_KEPT, lines=True).select("doc_id", F.inline(hits))


@query(_bm25("SELECT doc_id, CAST(idx AS BIGINT) AS idx, round(score, 3) AS score FROM b WHERE score > 0"))
def bm25_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a relation of passages, by windows over a page."""
    return P.scored(P.by_line(_docs(spark, sf_dir)), TERMS_KEPT).select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.round("score", 3).alias("score"))


@query(_bm25("SELECT doc_id, CAST(idx AS BIGINT) AS idx, round(score, 3) AS score, md5(passage) AS passage FROM k WHERE rank <= 3"))
def topk_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda h: F.struct(h["idx"].cast("bigint").alias("idx"), F.round(h["score"], 3).alias("score"), F.md5(h["passage"].cast("binary")).alias("passage"))
    return P.scored_pages(_docs(spark, sf_dir), TERMS_KEPT, lines=True).select("doc_id", F.inline(F.transform(P.best("hits", 3), told)))


@query(_bm25("SELECT doc_id, max(n) AS total, count(*) AS kept, string_agg(passage, chr(10) ORDER BY idx) AS text FROM k WHERE rank <= 5 GROUP BY doc_id"))
def focus_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = P.select(_docs(spark, sf_dir), TERMS_KEPT, 5, lines=True)
    return picked.select("doc_id", "total", F.size("passages").cast("bigint").alias("kept"), "text")


@query()
def focus_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages packed from lines; packing depends on order, so there is no SQL for it."""
    picked = P.select(_docs(spark, sf_dir), TERMS_KEPT, 5)
    return picked.select("doc_id", "total", F.size("passages").cast("bigint").alias("kept"), "text")


LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
#: Where a line is cut from s on: at the first sentence end of 600 to 1,200 characters, found by looking at each place.
CUT = """coalesce(list_filter(range(600, 1201), lambda i: substr(l, s + i, 1) IN ('。', '！', '？', '．')
    OR (substr(l, s + i, 1) IN ('.', '!', '?') AND (s + i >= length(l) OR regexp_matches(substr(l, s + i + 1, 1), '\\s'))))[1], 1200)"""
CUTS = f"""l AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS l FROM (SELECT doc_id, {LINES} AS ls FROM documents)),
c AS (SELECT doc_id, line, l, 0 AS s, CASE WHEN length(l) <= 1200 THEN length(l) ELSE {CUT.replace("s + i", "0 + i")} END AS n, 0 AS piece FROM l
  UNION ALL SELECT doc_id, line, l, s + n AS s, {CUT.replace("s + i", "s + n + i")}, piece + 1 FROM c WHERE s + n < length(l)),
p AS (SELECT doc_id, line, piece, l LIKE '#%' AS heading, CASE WHEN length(l) <= 1200 THEN l ELSE regexp_replace(substr(l, s + 1, n), '^\\s+|\\s+$', '', 'g') END AS p FROM c)"""


PACKED = f"""WITH RECURSIVE {CUTS},
x AS (SELECT doc_id, list({{'p': p, 'h': heading, 'f': piece = 0}} ORDER BY line, piece) AS ps FROM p GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(ps, lambda a, x: CASE WHEN a.cur IS NOT NULL AND ((x.f AND x.h AND NOT a.bare) OR (length(a.cur) > 0 AND length(a.cur) + length(x.p) > 600 AND NOT a.bare))
    THEN {{'done': list_append(a.done, a.cur), 'cur': x.p, 'bare': x.h}}
    ELSE {{'done': a.done, 'cur': CASE WHEN a.cur IS NULL THEN x.p ELSE a.cur || chr(10) || x.p END, 'bare': x.h AND (a.bare OR a.cur IS NULL)}} END,
    {{'done': []::VARCHAR[], 'cur': NULL::VARCHAR, 'bare': FALSE}}) AS r FROM x),
o AS (SELECT doc_id, list_append(r.done, r.cur) AS ps FROM f)
SELECT doc_id, CAST(len(ps) AS BIGINT) AS n, list_max(list_transform(ps, lambda x: length(x))) AS longest"""


@query(f"{PACKED}, md5(array_to_string(ps, '|')) AS passages FROM o")
def split_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, packed."""
    made = _docs(spark, sf_dir).select("doc_id", T.split_passages("text").alias("ps")).where(F.size("ps") > 0)
    longest = F.array_max(F.transform("ps", F.length)).cast("bigint")
    return made.select("doc_id", F.size("ps").cast("bigint").alias("n"), longest.alias("longest"), F.md5(F.array_join("ps", "|").cast("binary")).alias("passages"))


@query(f"{PACKED} FROM o")
def sql_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in Spark SQL alone, by a table function over partitions."""
    registered.register(spark)
    _docs(spark, sf_dir).select("doc_id", "text").createOrReplaceTempView("lodestar_documents")
    return spark.sql(
        "SELECT doc_id, count(*) AS n, CAST(max(length(passage)) AS BIGINT) AS longest FROM passages_of(TABLE(SELECT doc_id, text FROM lodestar_documents) PARTITION BY doc_id) GROUP BY doc_id"
    )


@query(f"WITH RECURSIVE {CUTS} SELECT doc_id, line, CAST(row_number() OVER (PARTITION BY doc_id, line ORDER BY piece) - 1 AS BIGINT) AS piece, length(p) AS chars FROM p")
def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines("text")).alias("line", "text")).select("doc_id", "line", F.posexplode(T.split_long("text")).alias("piece", "text"))
    return pieces.select("doc_id", F.col("line").cast("bigint").alias("line"), F.col("piece").cast("bigint").alias("piece"), F.length("text").cast("bigint").alias("chars"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM documents")
def post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.post_process("text").alias("text"))
