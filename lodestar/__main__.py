"""python -m lodestar: search, fetch, run, engines, cache and watch over stored payloads, pages and state."""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from lodestar import config, sinks
from lodestar.api import Lodestar
from lodestar.errors import ConfigError, LodestarError
from lodestar.operators import relation, state
from lodestar.operators.cache_table import LAYOUT, Cache, Limits
from lodestar.plans import recipe
from lodestar.storage import Conflict, StateTable
from lodestar.streaming.watch import WatchState


def _printed(rows: DataFrame, mode: str) -> list[str]:
    made = {"json": lambda: sinks.run_doc(rows).select("doc"), "jsonl": lambda: sinks.jsonl(rows).orderBy("_seq").select("line"), "pretty": lambda: sinks.pretty(relation.renumber(rows, None)).orderBy("_seq").select("block")}
    return [r[0] for r in made[mode]().collect()]


def _saved(cache: Cache | None, note: Callable[[str], None]) -> None:
    """A cache that cannot be kept is a remark, not a failure."""
    if cache is not None:
        cache.save()
        if cache.trouble:
            note(f"cache: {cache.trouble}")


def _run(a: argparse.Namespace, star: Lodestar, note: Callable[[str], None]) -> list[str]:
    """A recipe to its file or to the terminal. What a watch has shown is recorded only after it was written."""
    if a.recipe == "-":
        source = sys.stdin.read(recipe.BYTES_MOST + 1)
    else:
        with open(a.recipe, encoding="utf-8") as file:
            source = file.read(recipe.BYTES_MOST + 1)
    plan = recipe.parse(source)
    path = a.output or plan.file
    mode = sinks.output_mode(a.format, plan.format, path is not None, sys.stdout.isatty())
    store = found = None
    if plan.watch is not None:
        if not a.watches:
            raise ConfigError("--watches names no folder")
        store = WatchState(star.spark, a.watches)
        found = store.table.snapshot()
        star = replace(star, seen=found.rows)
    rows = star.run(source).cache()
    lines = []
    if path:
        note(f"{sinks.write_file(rows, path, mode)} lines written to {path}")
    else:
        lines = _printed(rows, mode)
    if store is not None:
        now = int(time.time())
        try:
            store.save(state.record(found.rows, rows, plan.watch, now), found.version + 1)
        except Conflict:  # another run of a watch was faster: what both showed is recorded
            store.table.update(lambda seen: state.evict_seen(state.record(seen.rows, rows, plan.watch, now)))
    return lines


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestar")
    p.add_argument("--payloads", help="Parquet of stored responses")
    p.add_argument("--pages", help="Parquet of pages")
    p.add_argument("--config")
    p.add_argument("--format", choices=recipe.FORMATS)
    p.add_argument("--cache", help="folder of cached answers")
    p.add_argument("--no-cache", action="store_true", help="neither ask the cache nor fill it")
    p.add_argument("--robots", help="Parquet of robots files: origin, body")
    p.add_argument("--image-payloads", help="Parquet of stored answers of image engines")
    p.add_argument("--image-bytes", help="Parquet of images: url, content")
    p.add_argument("--lang")
    p.add_argument("--region")
    p.add_argument("--no-fallback", action="store_true", help="ask the named engine only")
    p.add_argument("--respect-robots", action="store_true")
    p.add_argument("--no-respect-robots", action="store_true")
    p.add_argument("--allow-private", action="store_true", help="let requests reach private addresses")
    p.add_argument("--watches", help="folder of watch state")
    p.add_argument("--quiet", action="store_true", help="no notes on stderr")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--engine")
    s.add_argument("--count", type=int)
    s.add_argument("--since")
    s.add_argument("--until")
    f = sub.add_parser("fetch")
    f.add_argument("urls", nargs="+")
    f.add_argument("--query")
    f.add_argument("--passages", type=int, default=5)
    f.add_argument("--markdown", action="store_true")
    f.add_argument("--html", action="store_true")
    f.add_argument("--max-chars", type=int)
    i = sub.add_parser("images")
    i.add_argument("query")
    i.add_argument("--engine")
    i.add_argument("--count", type=int)
    i.add_argument("--to", help="folder that the images are written to")
    r = sub.add_parser("run")
    r.add_argument("recipe", help="a file, or - for standard input")
    r.add_argument("--output", help="a file, instead of the recipe's")
    sub.add_parser("engines")
    sub.add_parser("init").add_argument("path")
    sub.add_parser("config-path")
    sub.add_parser("cache-info")
    sub.add_parser("cache-clear").add_argument("--expired", action="store_true", help="only what is too old")
    sub.add_parser("watch-list")
    sub.add_parser("watch-clear").add_argument("name", nargs="?")
    a = p.parse_args(argv)
    note = lambda text: None if a.quiet else print(text, file=sys.stderr)
    try:
        if a.command == "init":
            config.write_default(a.path)
            return 0
        if a.command == "config-path":
            print(a.config or os.environ.get("LODESTAR_CONFIG") or "")
            return 0
        spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
        none = lambda ddl: spark.createDataFrame([], ddl)
        payloads = spark.read.parquet(a.payloads) if a.payloads else none("request_id bigint, engine string, query string, status int, body string")
        pages = spark.read.parquet(a.pages) if a.pages else none("url string, html string")
        read = lambda path: spark.read.parquet(path) if path else None
        flags = {"lang": a.lang, "region": a.region, "fallback": False if a.no_fallback else None, "allow_private_network": True if a.allow_private else None}
        settings = config.load(a.config, **flags)
        settings = replace(settings, respect_robots=config.respects_robots(a.no_respect_robots, a.respect_robots, settings.respect_robots))
        now = int(time.time())
        limits = Limits(settings.cache_ttl_secs, settings.cache_max_entries, settings.cache_max_bytes, config.cache_entries(a.no_cache, bool(a.cache), settings.cache_max_entries) > 0)
        answers = a.command in ("search", "images", "fetch", "run") and a.cache
        cache = Cache(spark, a.cache, now, limits) if answers else None
        star = Lodestar(spark, payloads, pages, settings, cache=cache, robots=read(a.robots), image_payloads=read(a.image_payloads), image_bytes=read(a.image_bytes))
        mode = sinks.output_mode(a.format, None, False, sys.stdout.isatty())
        if a.command == "engines":
            lines = [r.line for r in star.engines().select(sinks.as_json("name", "kind", "aliases", "description").alias("line")).collect()]
        elif a.command in ("cache-info", "cache-clear"):
            if not a.cache:
                raise ConfigError("--cache names no folder")
            kept = StateTable(spark, a.cache, LAYOUT)
            if a.command == "cache-clear":
                kept.update(lambda seen: state.clear(seen.rows, now if a.expired else None, settings.cache_ttl_secs))
                note("cleared")
            lines = [r.line for r in state.cache_info(kept.read(), now, settings.cache_ttl_secs).select(sinks.as_json("entries", "bytes", "expired").alias("line")).collect()]
        elif a.command in ("watch-list", "watch-clear"):
            if not a.watches:
                raise ConfigError("--watches names no folder")
            store = WatchState(spark, a.watches)
            if a.command == "watch-clear":
                store.clear(a.name)
                note("cleared")
            lines = [r.line for r in state.watch_list(store.read()).orderBy("watch").select(sinks.as_json("watch", "seen", "last_new").alias("line")).collect()]
        elif a.command == "fetch":
            got = star.fetch(a.urls, a.query, a.passages, a.markdown, a.html, a.max_chars).cache()
            failed = got.where("kind is not null").count()
            if failed:
                note(f"{failed} of {len(a.urls)} pages failed")
            made = sinks.fetch_batch(got).orderBy("_seq").select("item") if mode == "jsonl" else sinks.fetch_doc(got)
            print("\n".join(r[0] for r in made.collect()))
            _saved(cache, note)
            return 1 if failed == len(a.urls) else 0
        elif a.command == "images":
            rows = star.images(a.query, a.engine, a.count, a.to, lang=settings.lang, region=settings.region).cache()
            lines = [r.doc for r in sinks.images_doc(rows, a.query, a.engine or settings.image_engine, downloaded=a.to is not None).collect()]
        elif a.command == "run":
            lines = _run(a, star, note)
        else:
            lines = _printed(star.search(a.query, a.engine, a.count, a.since, a.until, lang=settings.lang, region=settings.region), mode)
        _saved(cache, note)
        print("\n".join(lines))
    except BrokenPipeError:
        return 0
    except LodestarError as e:
        print(f"{e.kind}: {e}", file=sys.stderr)
        return 2 if e.kind == "config" else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
