"""Passages of pages ranked by BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.errors import ConfigError
from lodestar.functions import text as T

K1, B = 1.2, 0.75


def by_line(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, idx, passage): every non-blank line is a passage."""
    return docs.select(doc_id, F.posexplode(T.lines(text)).alias("idx", "passage"))


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, idx, passage): lines packed to about 600 characters, headings kept with their body."""
    return docs.select(doc_id, F.posexplode(T.split_passages(text)).alias("idx", "passage"))


def _counts(terms: list[str]):
    """Of tokens: their number, and the frequency of each term."""
    return lambda t: F.struct(F.size(t).alias("n_tokens"), F.array(*(F.size(t) - F.size(F.array_remove(t, x)) for x in terms)).alias("tf"))


def measured(passages: DataFrame, terms: list[str]) -> DataFrame:
    """Each passage with its token count and the frequency of each term, in one row: no token leaves it."""
    return passages.withColumn("_m", T.with_tokens("passage", _counts(terms))).select(*passages.columns, "_m.n_tokens", "_m.tf")


def stats(rows: DataFrame, terms: list[str], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n, avg_len, df): passages, mean length of at least 1, and document frequencies."""
    df = F.array(*(F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(terms))))
    return rows.groupBy(doc_id).agg(F.count("*").alias("n"), F.greatest(F.avg("n_tokens"), F.lit(1.0)).alias("avg_len"), df.alias("df"))


def score(terms: list[str], n: Column, avg_len: Column, df: Column, n_tokens: Column, tf: Column) -> Column:
    """Sum over terms of ln(1 + (n-df+0.5)/(df+0.5)) * f(k1+1)/(f + k1(1-b+b*len/avg))."""
    total = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.get(tf, F.lit(i)), F.get(df, F.lit(i))
        idf = F.log1p((n - d + 0.5) / (d + 0.5))
        total = total + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * n_tokens / avg_len))).otherwise(0.0)
    return total


def scored(passages: DataFrame, query_terms: list[str], doc_id: str = "doc_id") -> DataFrame:
    """Passages with a positive score (doc_id, idx, passage, score): corpus figures are windows over
    a page, so passages are shuffled once, by page."""
    if not query_terms:
        raise ConfigError("the query has no searchable terms")
    page = Window.partitionBy(doc_id)
    rows = measured(passages, query_terms)
    df = F.array(*(F.count_if(F.get("tf", F.lit(i)) > 0).over(page) for i in range(len(query_terms))))
    rows = rows.withColumns({"_n": F.count("*").over(page), "_avg": F.greatest(F.avg("n_tokens").over(page), F.lit(1.0)), "_df": df})
    value = score(query_terms, F.col("_n"), F.col("_avg"), F.col("_df"), F.col("n_tokens"), F.col("tf"))
    return rows.withColumn("score", value).where("score > 0").select(doc_id, "idx", "passage", "score", F.col("_n").alias("total"))


def top(rows: DataFrame, k: int = 5, doc_id: str = "doc_id") -> DataFrame:
    """The k best passages of each page, ties to the earlier."""
    best = Window.partitionBy(doc_id).orderBy(F.desc("score"), "idx")
    return rows.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= max(1, k)).drop("_rank")


def scored_pages(docs: DataFrame, query_terms: list[str], doc_id: str = "doc_id", text: str = "text", lines: bool = False) -> DataFrame:
    """(doc_id, total, hits): the passages of a page with a positive score, as (idx, passage, score).

    A page is one row and stays one: its passages are measured, counted and scored in place, without a shuffle."""
    if not query_terms:
        raise ConfigError("the query has no searchable terms")
    count = _counts(query_terms)
    passages = (T.lines if lines else T.split_passages)(text)
    rows = docs.select(doc_id, F.transform(passages, lambda p, i: F.struct(i.alias("idx"), p.alias("passage"), T.with_tokens(p, count).alias("m"))).alias("_p"))
    total = F.size("_p")
    words = F.aggregate("_p", F.lit(0).cast("bigint"), lambda a, x: a + x["m"]["n_tokens"])
    holds = lambda i: lambda x: F.get(x["m"]["tf"], F.lit(i)) > 0
    df = F.array(*(F.size(F.filter("_p", holds(i))) for i in range(len(query_terms))))
    rows = rows.select(doc_id, "_p", total.cast("bigint").alias("total"), F.greatest(words / F.greatest(total, F.lit(1)), F.lit(1.0)).alias("_avg"), df.alias("_df"))
    value = lambda x: score(query_terms, F.col("total"), F.col("_avg"), F.col("_df"), x["m"]["n_tokens"], x["m"]["tf"])
    hits = F.transform(F.filter("_p", lambda x: F.exists(x["m"]["tf"], lambda f: f > 0)), lambda x: F.struct(x["idx"].alias("idx"), x["passage"].alias("passage"), value(x).alias("score")))
    return rows.select(doc_id, "total", F.filter(hits, lambda h: h["score"] > 0).alias("hits"))


def best(hits: Column | str, k: int) -> Column:
    """The k best of (idx, passage, score), ties to the earlier, by falling score."""
    ranked = F.array_sort(F.transform(hits, lambda h: F.struct((-F.round(h["score"], 9)).alias("rank"), h["idx"].alias("idx"), h["score"].alias("score"), h["passage"].alias("passage"))))
    return F.slice(ranked, 1, max(1, k))


def select(docs: DataFrame, query_terms: list[str], k: int = 5, doc_id: str = "doc_id", text: str = "text", lines: bool = False) -> DataFrame:
    """(doc_id, text, total, passages): the best passages of each page, in page order."""
    rows = scored_pages(docs, query_terms, doc_id, text, lines)
    in_order = F.array_sort(F.transform(best("hits", k), lambda h: F.struct(h["idx"].alias("index"), F.round(h["score"], 3).alias("score"), h["passage"].alias("passage"))))
    made = lambda h: F.struct(F.array_join(h["passage"], "\n").alias("text"), F.transform(h, lambda x: F.struct(x["index"].alias("index"), x["score"].alias("score"))).alias("passages"))
    # One or no result a page, without a filter that would work the hits out twice.
    found = F.transform(F.filter(F.array(in_order), lambda h: F.size(h) > 0), made)
    return rows.select(doc_id, "total", F.inline(found)).select(doc_id, "text", "total", "passages")
