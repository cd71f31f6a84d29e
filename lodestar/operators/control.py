"""Fallback, batches, gates, retries and pacing as expressions over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.errors import is_retryable
from lodestar.functions import timefn, web

BASE_MS, MOST_MS, RETRY_AFTER_MOST = 400, 8000, 60


def fallback_order(catalog: DataFrame) -> DataFrame:
    """(engine, priority, candidate): a web engine, then the other web engines as registered; any other only itself."""
    a, b = catalog.alias("a"), catalog.alias("b")
    pairs = a.join(b, (F.col("a.name") == F.col("b.name")) | ((F.col("a.kind") == "web") & (F.col("b.kind") == "web")))
    order = Window.partitionBy(F.col("a.name")).orderBy((F.col("a.name") != F.col("b.name")).cast("int"), F.col("b.position"))
    return pairs.select(F.col("a.name").alias("engine"), F.row_number().over(order).alias("priority"), F.col("b.name").alias("candidate"))


def fallback_resolve(attempts: DataFrame) -> DataFrame:
    """(request_id, engine, kind) from attempts (request_id, priority, engine, n_results, kind).

    In order of priority: the first with results wins; an error that is not retryable ends the
    chain; else the last error stands, else the first (empty) answer."""
    ends = (F.col("kind").isNull() & (F.col("n_results") > 0)) | (F.col("kind").isNotNull() & ~is_retryable("kind"))
    first = lambda test: F.min(F.when(test, F.struct("priority", "engine", "kind")))
    last = lambda test: F.max(F.when(test, F.struct("priority", "engine", "kind")))
    picked = attempts.groupBy("request_id").agg(first(ends).alias("end"), last(F.col("kind").isNotNull()).alias("error"), first(F.lit(True)).alias("empty"))
    best = F.coalesce("end", "error", "empty")
    return picked.select("request_id", best["engine"].alias("engine"), best["kind"].alias("kind"))


def gate(pages: DataFrame, allow_private: bool = False) -> DataFrame:
    """The first failing gate of each request: egress, robots, cache, status, type, size; else fetch.

    ``pages``: url, robots_allowed, cached, status, content_type, and egress_error if it is known."""
    refused = F.col("egress_error") if "egress_error" in pages.columns else web.egress_error("url", allow_private)
    kind = (
        F.when(refused.isNotNull(), "blocked_by_policy")
        .when(~F.coalesce("robots_allowed", F.lit(True)), "robots")
        .when(F.coalesce("cached", F.lit(False)), "cached")
        .when(~F.col("status").between(200, 299), "http")
        .when(~web.accepts_type("content_type"), "unsupported_content_type")
        .otherwise("fetch")
    )
    return pages.withColumn("gate", kind)


#: Lengths at which the literal starts of robots patterns are indexed.
ROBOTS_STEPS = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)


def _start_key(text: Column, length: Column) -> Column:
    return F.xxhash64(length, F.substring(text, 1, length))


def robots_gate(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests (url) with ``robots_allowed``: the longest matching rule of the origin, allow before
    disallow; no rule allows.

    A rule is indexed by its literal start (what stands before the first ``*`` or ``$``), cut to one of
    ROBOTS_STEPS lengths; a path asks for its own starts of these lengths. So a path meets the rules that
    share a start with it, not all of its origin, and a hot origin is dealt out by the starts. Requests
    that are alike are judged once."""
    own = requests.withColumns({"_origin": web.origin("url"), "_path": web.normal_path(web.path_query("url"))})
    steps = F.array(*map(F.lit, ROBOTS_STEPS))
    literal = F.length(F.regexp_extract("pattern", r"^[^*$]*", 0))
    step = F.array_max(F.filter(steps, lambda s: s <= literal))
    r = rules.where("pattern is not null").select(F.col("origin").alias("_origin"), "pattern", "allow", _start_key(F.col("pattern"), step).alias("_key"))
    asked = own.where("_origin is not null and _path is not null").select("_origin", "_path").distinct()
    starts = F.transform(F.filter(steps, lambda s: s <= F.length("_path")), lambda s: _start_key(F.col("_path"), s))
    met = asked.withColumn("_key", F.explode(starts)).join(r, ["_origin", "_key"]).where(web.robots_match("pattern", "_path"))
    best = met.groupBy("_origin", "_path").agg(F.max(F.struct(F.octet_length("pattern"), "allow")).alias("_best"))
    return own.join(best, ["_origin", "_path"], "left").select(*requests.columns, F.coalesce(F.col("_best.allow"), F.lit(True)).alias("robots_allowed"))


def robots_rules(bodies: DataFrame) -> DataFrame:
    """(origin, place, pattern, allow) of bodies (origin, body): the rules of the groups that bind every agent.

    Lines that name an agent and follow one another open one group; it lasts until the next line that names
    one after any other field. So groups are islands: a line opens one if it names an agent and the field
    before did not, and a running sum of these numbers them. Lines without a colon are no fields. Of a body
    over ROBOTS_MOST bytes only the whole lines before that are read; null bodies and those without a group
    for all give no rule; bodies given twice give their rules twice."""
    read = F.substring(F.col("body").cast("binary"), 1, web.ROBOTS_MOST).cast("string")
    whole = F.substring(read, 1, F.length(read) - F.length(F.substring_index(read, "\n", -1)))
    body = F.when(F.octet_length("body") > web.ROBOTS_MOST, whole).otherwise(F.col("body"))
    told = bodies.withColumn("_body", F.monotonically_increasing_id())  # before its lines are dealt out
    lines = told.select("origin", "_body", F.posexplode(F.split(F.regexp_replace(body, "^\ufeff+", ""), "\n")).alias("place", "_line"))
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    line = trim(F.substring_index("_line", "#", 1))
    cut = F.instr(line, ":")
    fields = lines.where(cut > 0).select("origin", "_body", "place", F.lower(trim(F.substring(line, 1, cut - 1))).alias("_key"), trim(F.substring(line, cut + 1, F.length(line))).alias("_value"))
    order = Window.partitionBy("_body").orderBy("place")
    names = F.col("_key") == "user-agent"
    opens = names & (F.coalesce(F.lag("_key").over(order), F.lit("")) != "user-agent")
    grouped = fields.withColumn("_opens", opens.cast("int")).withColumn("_group", F.sum("_opens").over(order))
    binds = F.max((names & (F.col("_value") == "*")).cast("int")).over(Window.partitionBy("_body", "_group"))
    rule = F.col("_key").isin("allow", "disallow") & (F.col("_value") != "") & (F.col("_group") > 0)
    ours = grouped.withColumn("_binds", binds).where(rule & (F.col("_binds") == 1))
    return ours.select("origin", F.col("place").cast("bigint").alias("place"), web.normal_path("_value").alias("pattern"), (F.col("_key") == "allow").alias("allow"))


def batch_summary(items: DataFrame) -> DataFrame:
    """(n, failed, any_failed, all_failed)."""
    failed = F.count_if(F.col("kind").isNotNull())
    return items.agg(F.count("*").alias("n"), failed.alias("failed")).withColumns({"any_failed": F.col("failed") > 0, "all_failed": (F.col("n") > 0) & (F.col("failed") == F.col("n"))})


def step_verdict(items: DataFrame) -> DataFrame:
    """(steps, failed_steps, all_failed): a step fails if all of its items fail."""
    steps = items.groupBy("step").agg(F.every(F.col("kind").isNotNull()).alias("failed"))
    return steps.agg(F.count("*").alias("steps"), F.count_if("failed").alias("failed_steps")).withColumn("all_failed", F.col("steps") == F.col("failed_steps"))


def backoff_ms(attempt: Column, base: int = BASE_MS, most: int = MOST_MS) -> Column:
    """base * 2^attempt, at most ``most``."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(attempt, F.lit(10))), F.lit(most)).cast("bigint")


def backoff_wait_ms(attempt: Column, key: Column | str, base: int = BASE_MS, most: int = MOST_MS) -> Column:
    """A wait from nothing to all of the backoff, by a hash of the request and attempt: reruns agree."""
    whole = backoff_ms(attempt, base, most)
    return F.pmod(F.xxhash64(key if isinstance(key, Column) else F.col(key), attempt), whole + 1)


def retry_after_s(value: Column, now: Column) -> Column:
    """Seconds to wait from a header of seconds or an HTTP date; null if unreadable or over a minute."""
    date = timefn.rfc2822(value)
    seconds = F.when(F.trim(value).rlike(r"^\d{1,9}$"), F.trim(value).try_cast("bigint")).when(date.isNotNull(), F.greatest(F.unix_timestamp(date) - F.unix_timestamp(now), F.lit(0)))
    return F.when(seconds <= RETRY_AFTER_MOST, seconds)


def pacing(requests: DataFrame, interval_ms: int, key: str = "lane") -> DataFrame:
    """Start of each request: max(previous + interval, arrival), in closed form as a running maximum."""
    order = Window.partitionBy(key).orderBy("_seq")
    i = F.row_number().over(order)
    free = F.max(F.col("_free")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("_i", i).withColumn("_free", F.col("arrival_ms") - F.col("_i") * interval_ms).withColumn("slot_ms", free + F.col("_i") * interval_ms).drop("_i", "_free")
