"""Walks over pages of posts: each page names the oldest post it shows, and the next page is asked for before that one.

The pages are parsed once, into a written table of (channel, before, oldest, posts). A walk is a bounded loop
of joins: its frontier is one row for each request, with the cursor to ask for next. Nothing of it is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources import parsers
from lodestar.storage import folder

#: A walk asks for at most so many pages.
HOPS = 4


def parsed(pages: DataFrame) -> DataFrame:
    """(channel, before, redirected, page) of ``pages`` (channel, before, body, and redirected if it is known).

    A page that is stored twice counts once."""
    redirected = F.coalesce("redirected", F.lit(False)) if "redirected" in pages.columns else F.lit(False)
    once = pages.groupBy("channel", "before").agg(F.min(F.struct(redirected.alias("redirected"), "body")).alias("p"))
    return once.select("channel", F.col("before").cast("bigint").alias("before"), "p.redirected", parsers.channel_page("p.body").alias("page"))


def walk(requests: DataFrame, pages: DataFrame, hops: int = HOPS, base: str = "https://t.me") -> DataFrame:
    """Result rows of ``requests`` (request_id, channel, want): the newest ``want`` posts of the channel.

    The first page has no cursor. A walk ends with enough posts, with a page that is empty or names no post
    older than the page before, or after ``hops`` pages. A first page that was redirected away (or is not
    stored) is ``no_results``; one without posts that is no channel's page is ``parse``. A later page that is
    missing or redirected ends the walk with what there is. A null channel is not found.
    """
    spark = requests.sparkSession
    place = folder(spark, "walk")
    parsed(pages).write.parquet(place)
    known = spark.read.parquet(place).select(F.col("channel").alias("_channel"), "before", "redirected", "page")
    front = requests.select("request_id", "channel", F.col("want").cast("bigint").alias("want"), F.lit(None).cast("bigint").alias("cursor"), F.lit(0).cast("bigint").alias("have"))
    seen = []
    for hop in range(hops):
        met = front.join(known, (F.col("channel") == F.col("_channel")) & F.col("cursor").eqNullSafe(F.col("before")), "left")
        gone = F.col("page").isNull() | F.col("redirected")
        if hop:
            met = met.where(~gone)
        n = F.when(gone, 0).otherwise(F.size("page.posts"))
        bad = F.when(gone, "no_results").when((n == 0) & ~F.col("page.has_channel"), "parse")
        met = met.withColumns({"hop": F.lit(hop), "n": n, "kind": bad if hop == 0 else F.lit(None).cast("string"), "oldest": F.when(~gone, F.col("page.oldest"))})
        seen.append(met.select("request_id", "channel", "want", "have", "hop", "kind", F.when(~gone, F.col("page.posts")).alias("posts")))
        older = F.col("oldest").isNotNull() & (F.col("cursor").isNull() | (F.col("oldest") < F.col("cursor")))
        met = met.withColumn("have", F.col("have") + F.col("n"))
        front = met.where(F.col("kind").isNull() & (F.col("n") > 0) & (F.col("have") < F.col("want")) & older).select("request_id", "channel", "want", F.col("oldest").alias("cursor"), "have")
    pages_seen = seen[0]
    for s in seen[1:]:
        pages_seen = pages_seen.unionByName(s)
    rows = pages_seen.select("request_id", "channel", "want", "have", "kind", F.posexplode_outer("posts").alias("pos", "_it"))
    number = F.when(F.col("kind").isNotNull(), F.lit(0)).otherwise(F.col("have") + F.col("pos") + 1).cast("bigint")
    rows = rows.withColumn("_seq", number).where(F.col("kind").isNotNull() | ((F.col("_seq") <= F.col("want")) & F.col("_it").isNotNull()))
    return parsers.posts(rows, base)
