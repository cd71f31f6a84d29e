"""One object for searches, fetches and recipes over stored payloads and pages.

``payloads``: request_id, engine, query, status, body (and ids, name or channel where a source
needs them). ``pages``: url, html, and optionally status, content_type, robots_allowed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar import errors, html
from lodestar.config import Config
from lodestar.functions import text as T
from lodestar.functions import timefn, web
from lodestar.operators import control, passages, relation
from lodestar.operators.cache_table import Cache
from lodestar.plans import recipe as R
from lodestar.sources import image_files, parsers, registry


ANSWER = "rows array<struct<_seq:bigint,title:string,url:string,snippet:string,published:timestamp>> not null"
PAGE = "title string, chars bigint not null, truncated boolean not null, text string not null"
IMAGE = "rows array<struct<_seq:bigint,title:string,url:string,page_url:string,width:bigint,height:bigint,format:string>> not null"
#: Bytes of an engine's answer that are read; a larger one is a failure. Pages are cut instead.
BODY_MOST = 10 * 1024 * 1024
#: Engines that take the bounds of a search themselves, so that these are applied before the count.
BOUNDED = ("hackernews", "stackexchange")


@dataclass(frozen=True)
class Lodestar:
    """``cache``, if given, answers repeated searches and fetches and is filled by others; call its ``save`` at the
    end of a run. ``robots`` (origin, body) holds the origins' rules, asked if the configuration respects them."""

    spark: SparkSession
    payloads: DataFrame
    pages: DataFrame
    config: Config = Config()
    seen: DataFrame | None = None
    now: datetime | None = None
    cache: Cache | None = None
    robots: DataFrame | None = None
    image_payloads: DataFrame | None = None
    image_bytes: DataFrame | None = None

    def _now(self) -> datetime:
        return self.now or datetime.now(UTC)

    def engines(self) -> DataFrame:
        return registry.catalog(self.spark)

    def _answer(self, payloads: DataFrame, engine: str, query: str, count: int, images: bool, window: tuple, asked: dict) -> tuple[DataFrame, str | None]:
        """The first ``count`` rows of an engine's answer, or the kind of its failure. What else was
        ``asked`` for picks payloads where these say what they answer."""
        own = payloads.where((F.col("engine") == engine) & (F.col("query") == query))
        for name, value in asked.items():
            if value is not None and name in payloads.columns:
                own = own.where(F.col(name) == F.lit(value))
        kind = errors.of_status(F.col("status"), scraped=engine in ("duckduckgo", "bing"))
        kind = F.coalesce(kind, F.when(F.octet_length("body") > BODY_MOST, "response_too_large"))
        if images:
            rows = (parsers.images_attr if engine == "bing" else parsers.images_json)(own.where(kind.isNull())).withColumn("kind", F.lit(None).cast("string"))
        else:
            rows = parsers.PARSERS[engine](own.where(kind.isNull()))
        failed = own.where(kind.isNotNull()).select(kind.alias("kind")).unionByName(rows.where("kind is not null").select("kind")).first()
        # Rows of a later payload come after those of an earlier one.
        good = rows.where("kind is null").withColumn("_seq", F.shiftleft("request_id", 20) + F.col("_seq")).drop("kind", "request_id")
        if engine in BOUNDED and not images:
            good = relation.time_window(good, *window)
        return relation.dedupe_and_truncate(good, count), failed and failed.kind

    def _first_answer(self, payloads: DataFrame, first: str, order: list[str], query: str, count: int, images: bool, window: tuple, asked: dict) -> DataFrame:
        """Rows of the first engine in order that has some; an error that no other engine may mend ends the chain."""
        empty, failure = None, None
        for name in order:
            rows, kind = self._answer(payloads, name, query, count, images, window, asked)
            if kind is None and not rows.isEmpty():
                return rows
            if kind is None and empty is None:
                empty = rows
            if kind is not None:
                failure = kind
                if kind not in errors.RETRYABLE:
                    break
        if failure is not None:
            raise errors.CLASSES.get(failure, errors.ParseError)(f"{first} answered with {failure}")
        return empty

    def _cached(self, key: Column, schema: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What the cache has under a key, else what is made, which the cache then has. Rows are at most a search's count."""
        if self.cache is None:
            return make()
        asked = self.spark.range(1).select(key.alias("key"))
        hit = self.cache.lookup(asked, schema).where("hit").select(F.inline("value.rows"))
        if not hit.isEmpty():
            return hit
        kind = StructType.fromDDL(schema)["rows"].dataType.elementType
        rows = self.spark.createDataFrame(make().select(*kind.names).collect(), kind)
        if not rows.isEmpty():
            value = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*kind.names))).alias("rows")))
            self.cache.put(asked.join(rows.agg(value.alias("value"))))
        return rows

    def search(self, query: str, engine: str | None = None, count: int | None = None, since: str | None = None, until: str | None = None, fresh: bool = False, **asked: object) -> DataFrame:
        """Results of an engine or, if it has none or fails in a way that another may not, of the next
        in its order. The count is cut before the time window, and emptiness is judged before it too.
        ``fresh``: past the cache, as watches ask."""
        if not query.strip():
            raise errors.ConfigError("the query is empty")
        first = registry.resolve(engine or self.config.engine)
        window = timefn.parse_window(since, until, self._now())
        kinds = {e.name: e.kind for e in registry.TEXT}
        order = [first] + ([e.name for e in registry.TEXT if e.kind == "web" and e.name != first] if kinds[first] == "web" and self.config.fallback else [])
        most = count or self.config.max_results
        make = lambda: self._first_answer(self.payloads, first, order, query, most, False, window, asked)
        key = T.search_key(first, query, most, {**asked, "since": since, "until": until, "fallback": self.config.fallback, "safe_search": self.config.safe_search})
        return relation.time_window(make() if fresh else self._cached(key, ANSWER, make), *window)

    def images(self, query: str, engine: str | None = None, count: int | None = None, to: str | None = None, **asked: object) -> DataFrame:
        """(_seq, title, url, page_url, width, height, format, written) of images, from an image engine or the next.

        With ``to``, those whose bytes are known are written to that folder as the download plan has it."""
        if not query.strip():
            raise errors.ConfigError("the query is empty")
        if self.image_payloads is None:
            raise errors.ConfigError("there are no image payloads")
        first = registry.resolve(engine or self.config.image_engine, images=True)
        order = [first] + ([e.name for e in registry.IMAGES if e.name != first] if self.config.fallback else [])
        most = count or self.config.max_results
        make = lambda: self._first_answer(self.image_payloads, first, order, query, most, True, (None, None), asked)
        found = self._cached(T.images_key(first, query, most, {**asked, "fallback": self.config.fallback, "safe_search": self.config.safe_search}), IMAGE, make)
        found = relation.renumber(found, None)
        if to is None or self.image_bytes is None:
            return found.withColumn("written", F.lit(False))
        known = found.join(self.image_bytes.select("url", "content"), "url").withColumns({"robots_allowed": F.lit(True), "on_disk": F.lit(False)})
        if self.config.respect_robots and self.robots is not None:
            known = control.robots_gate(known.drop("robots_allowed"), control.robots_rules(self.robots))
        plan = parsers.download_plan(known, self.config.image_max_bytes, most, self.config.image_overwrite)
        image_files.write(plan, to)
        return found.join(plan.where("skip is null").select("_seq", F.lit(True).alias("written")), "_seq", "left").withColumn("written", F.coalesce("written", F.lit(False)))

    def fetch(self, urls: list[str], query: str | None = None, k: int = 5, markdown: bool = False, raw: bool = False, max_chars: int | None = None, fresh: bool = False) -> DataFrame:
        """(_seq, url, title, chars, truncated, text, kind) of each URL, in order; a failed one keeps its row."""
        most = max_chars or self.config.max_chars
        asked = self.spark.createDataFrame(list(enumerate(urls, 1)), "_seq bigint, url string")
        asked = asked.withColumn("egress_error", web.egress_error("url", self.config.allow_private_network))
        key = T.fetch_key("url", markdown=markdown, raw=raw, max_chars=most, query=query, passages=k, allow_private=self.config.allow_private_network)
        use = self.cache is not None and not fresh
        if use:
            kept = self.cache.lookup(asked.withColumn("key", key), PAGE).withColumnsRenamed({"hit": "cached", "value": "_kept"})
            asked = kept
        found = asked.join(self.pages, "url", "left")
        for name, value in (("status", F.when(F.col("html").isNull(), 404).otherwise(200)), ("content_type", F.lit("text/html")), ("robots_allowed", F.lit(True)), ("cached", F.lit(False))):
            if name not in found.columns:
                found = found.withColumn(name, value)
        if not self.config.respect_robots:
            found = found.withColumn("robots_allowed", F.lit(True))
        elif self.robots is not None:
            found = control.robots_gate(found.drop("robots_allowed"), control.robots_rules(self.robots))
        gated = control.gate(found, self.config.allow_private_network)
        if use:
            kept = gated.where("gate = 'cached'").select("_seq", "url", "_kept.title", "_kept.chars", "_kept.truncated", "_kept.text", F.lit(None).cast("string").alias("kind"))
            gated = gated.where("gate <> 'cached'")
        open_ = gated.withColumn("html", F.when(F.col("gate").isin("fetch", "cached"), F.col("html")))
        got = html.fetch_raw(open_, most).withColumn("kind", F.lit(None).cast("string")) if raw else html.fetch(open_, markdown, most)
        got = got.withColumn("kind", F.when(~F.col("gate").isin("fetch", "cached"), F.col("gate")).otherwise(F.col("kind")))
        if query is not None:
            terms = [r.t for r in self.spark.range(1).select(F.explode(T.query_terms(F.lit(query))).alias("t")).collect()]
            best = passages.select(got.where("kind is null").select("_seq", "text"), terms, k, doc_id="_seq")
            got = got.drop("text", "chars").join(best.select("_seq", "text", (F.size("passages") < F.col("total")).alias("_cut")), "_seq", "left")
            got = got.withColumns({"text": F.coalesce("text", F.lit("")), "truncated": F.col("truncated") | F.coalesce("_cut", F.lit(True))}).withColumn("chars", F.length("text").cast("bigint"))
        out = got.select("_seq", "url", "title", "chars", "truncated", "text", "kind")
        if use:
            value = F.to_json(F.struct("title", "chars", "truncated", "text"))
            self.cache.put(out.where("kind is null").select(key.alias("key"), value.alias("value")).distinct())
            out = out.unionByName(kept)
        return out

    def run(self, source: str) -> DataFrame:
        """A recipe's rows. A step that fails adds none; if all do, that is an error."""
        plan = R.parse(source)
        failed: list[str] = []

        def step(s: R.Step) -> DataFrame:
            try:
                if s.kind == "search":
                    a = s.args
                    asked = {name: a.get(name) for name in ("lang", "region", "safe", "feed")}
                    return self.search(a["query"], a["engine"], a["count"], a.get("since"), a.get("until"), plan.watch is not None, **asked).select("_seq", "title", "url", "snippet", "published")
                got = self.fetch(s.args["urls"], s.args.get("query"), s.args.get("passages", 5), s.args.get("markdown", False), s.args.get("html", False), s.args.get("max_chars"), plan.watch is not None)
                good = got.where("kind is null")
                if good.isEmpty():
                    raise errors.NoResultsError("every page failed")
                title = T.snippet(F.coalesce(F.nullif("title", F.lit("")), "url"))
                return good.select("_seq", title.alias("title"), "url", T.snippet("text").alias("snippet"), F.lit(None).cast("timestamp").alias("published"))
            except errors.LodestarError as e:
                failed.append(f"step {s.number}: {e}")
                return self.spark.createDataFrame([], "_seq bigint, title string, url string, snippet string, published timestamp")

        rows = R.compile_recipe(plan, step, self.seen)
        if len(failed) == len(plan.steps):
            raise errors.NoResultsError("; ".join(failed))
        return rows

    def with_config(self, **changes: object) -> Lodestar:
        return replace(self, config=replace(self.config, **changes))
