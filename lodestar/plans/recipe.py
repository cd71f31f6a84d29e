"""Recipes: YAML to a small logical plan, and the plan to DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame

from lodestar.errors import ConfigError
from lodestar.operators import relation, state
from lodestar.sources.registry import resolve

BYTES_MOST, ITEMS_MOST, STEPS_MOST = 256 * 1024, 1024, 1024
TOP = ("version", "vars", "steps", "combine", "output", "watch")
SEARCH = ("query", "engine", "count", "lang", "region", "safe", "feed", "since", "until")
FETCH = ("url", "urls", "query", "passages", "markdown", "html", "max_chars")
FORMATS, SORTS = ("json", "jsonl", "pretty"), ("url", "title", "date")
WATCH_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")


@dataclass(frozen=True)
class Step:
    kind: str
    args: dict
    number: int  # of the step it came from, from 1


@dataclass(frozen=True)
class Combine:
    dedupe: bool = True
    sort: str | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Recipe:
    steps: tuple[Step, ...]
    combine: Combine | None = None
    watch: str | None = None
    format: str | None = None
    file: str | None = None
    vars: dict = field(default_factory=dict)


def _keys(section: object, known: tuple[str, ...], where: str) -> dict:
    if not isinstance(section, dict):
        raise ConfigError(f"{where} must be a mapping")
    for k in section:
        if k not in known:
            raise ConfigError(f"unknown key '{k}' in {where}; known: {', '.join(known)}")
    return section


def _scalar(v: object, where: str) -> object:
    if isinstance(v, dict | list) or v is None:
        raise ConfigError(f"{where} must be a scalar")
    return v


def _text(v: object, where: str) -> str:
    v = _scalar(v, where)
    return str(v).lower() if isinstance(v, bool) else str(v)


_PART = re.compile(r"\$\$|\$\{([^}]*)(\}?)")


def substitute(value: object, scope: dict) -> object:
    """``${x}`` in every string, keys untouched; a string that is one placeholder takes the typed
    value; ``$$`` is a dollar."""
    if isinstance(value, dict):
        return {k: substitute(v, scope) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, scope) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> object:
        if m[0] == "$$":
            return "$"
        if not m[2]:
            raise ConfigError(f"unterminated placeholder in '{value}'")
        if m[1] not in scope:
            raise ConfigError(f"unknown variable '{m[1]}'; known: {', '.join(sorted(scope)) or 'none'}")
        return scope[m[1]]

    whole = _PART.fullmatch(value)
    if whole and whole[0] != "$$":
        return one(whole)
    return _PART.sub(lambda m: _text(one(m), "a placeholder"), value)


def _search(args: object, where: str) -> dict:
    a = _keys(args, SEARCH, where)
    if not str(a.get("query", "")).strip():
        raise ConfigError(f"{where}: query is empty")
    out = {k: (_text(v, f"{where}.{k}") if k not in ("count", "safe") else v) for k, v in a.items()}
    out["engine"] = resolve(out.get("engine", "duckduckgo"))
    count = out.get("count", 5)
    if isinstance(count, bool) or not isinstance(count, int) or not 1 <= count <= relation.COUNT_MOST:
        raise ConfigError(f"{where}.count must be 1..{relation.COUNT_MOST}")
    out["count"] = count
    if not isinstance(out.get("safe", False), bool):
        raise ConfigError(f"{where}.safe must be true or false")
    return out


def _fetch(args: object, where: str) -> dict:
    a = dict(_keys(args, FETCH, where))
    urls = a.pop("urls", None) or ([a.pop("url")] if "url" in a else [])
    a.pop("url", None)
    if not isinstance(urls, list) or not urls:
        raise ConfigError(f"{where} needs url or urls")
    out = {**a, "urls": [_text(u, f"{where}.urls") for u in urls]}
    if "query" in out and not re.search(r"\w", str(out["query"])):
        raise ConfigError(f"{where}.query has no searchable terms")
    passages = out.get("passages", 5)
    if isinstance(passages, bool) or not isinstance(passages, int) or not 1 <= passages <= 50:
        raise ConfigError(f"{where}.passages must be 1..50")
    return out


def parse(source: str) -> Recipe:
    """A checked recipe, its ``for_each`` steps unrolled; messages name the original step."""
    if len(source.encode()) > BYTES_MOST:
        raise ConfigError(f"a recipe has at most {BYTES_MOST} bytes")
    try:
        doc = yaml.safe_load(source)
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {e}") from e
    doc = _keys(doc, TOP, "the recipe")
    if doc.get("version") != 1 or isinstance(doc.get("version"), bool):
        raise ConfigError("version must be 1")
    scope = {}
    for k, v in (doc.get("vars") or {}).items():
        if not re.fullmatch(r"[A-Za-z0-9_]+", str(k)) or k == "item":
            raise ConfigError(f"bad variable name '{k}'")
        scope[str(k)] = _scalar(v, f"vars.{k}")
    raw = doc.get("steps")
    if not isinstance(raw, list) or not raw:
        raise ConfigError("steps must be a list with a step at least")
    steps: list[Step] = []
    for number, step in enumerate(raw, 1):
        steps += _unroll(step, number, scope)
        if len(steps) > STEPS_MOST:
            raise ConfigError(f"more than {STEPS_MOST} steps")
    combine = None
    if "combine" in doc:
        c = _keys(doc["combine"] or {}, ("dedupe", "sort", "limit"), "combine")
        limit = c.get("limit")
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= relation.LIMIT_MOST):
            raise ConfigError(f"combine.limit must be 1..{relation.LIMIT_MOST}")
        if c.get("sort") not in (None, *SORTS):
            raise ConfigError(f"combine.sort must be one of {', '.join(SORTS)}")
        combine = Combine(c.get("dedupe", True) is not False, c.get("sort"), limit)
    out = _keys(doc.get("output") or {}, ("format", "file"), "output")
    if out.get("format") not in (None, *FORMATS):
        raise ConfigError(f"output.format must be one of {', '.join(FORMATS)}")
    watch = doc.get("watch")
    if watch is not None and not WATCH_NAME.fullmatch(_text(watch, "watch")):
        raise ConfigError(f"bad watch name '{watch}'")
    return Recipe(tuple(steps), combine, watch and str(watch), out.get("format"), out.get("file") and str(substitute(out["file"], scope)), scope)


def _unroll(step: object, number: int, scope: dict, inside: bool = False) -> list[Step]:
    where = f"step {number}"
    if not isinstance(step, dict) or len(step) != 1:
        raise ConfigError(f"{where} must have one key: search, fetch or for_each")
    kind, args = next(iter(step.items()))
    if kind == "for_each" and not inside:
        a = _keys(args, ("items", "step"), f"{where}.for_each")
        items = substitute(a.get("items"), scope)
        if not isinstance(items, list) or not 1 <= len(items) <= ITEMS_MOST:
            raise ConfigError(f"{where}: for_each needs 1..{ITEMS_MOST} items")
        return [s for x in items for s in _unroll(a.get("step"), number, {**scope, "item": _scalar(x, f"{where} item")}, True)]
    if kind not in ("search", "fetch"):
        raise ConfigError(f"{where}: unknown step '{kind}'")
    args = substitute(args, scope)
    return [Step(kind, (_search if kind == "search" else _fetch)(args, f"{where}.{kind}"), number)]


def compile_recipe(recipe: Recipe, run_step: Callable[[Step], DataFrame], seen: DataFrame | None = None) -> DataFrame:
    """Steps in order, then what the watch has not seen, then combine: so a limit counts new rows only."""
    rows = relation.union_steps([run_step(s) for s in recipe.steps])
    if recipe.watch is not None:
        if seen is None:
            raise ConfigError("a watch needs its state")
        rows = state.filter_new(rows, seen.where(seen["watch"] == recipe.watch))
    c = recipe.combine
    return relation.combine(rows, dedupe_rows=c.dedupe, sort=c.sort, limit=c.limit) if c else rows
