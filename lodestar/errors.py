"""Failure kinds: a closed vocabulary, as exceptions on the driver and as slugs in rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slug and how its message is rendered ({} is the detail).
KINDS = {
    "rate_limited": "rate-limited by search engine: {}",
    "parse": "failed to parse response: {}",
    "http": "HTTP {} from upstream",
    "network": "network error: {}",
    "config": "configuration error: {}",
    "no_results": "{}",
    "robots": "{}",
    "blocked_by_policy": "blocked by egress policy: {}",
    "response_too_large": "response exceeded the {}-byte limit",
    "unsupported_content_type": "unsupported content type '{}'",
}
RETRYABLE = ("rate_limited", "network", "parse", "http", "response_too_large")


class LodestarError(Exception):
    kind = "config"

    def __init__(self, detail: str):
        super().__init__(KINDS[self.kind].format(detail))
        self.detail = detail


class ConfigError(LodestarError):
    kind = "config"


class ParseError(LodestarError):
    kind = "parse"


class NoResultsError(LodestarError):
    kind = "no_results"


class BlockedError(LodestarError):
    kind = "blocked_by_policy"


class RateLimitedError(LodestarError):
    kind = "rate_limited"


class HttpError(LodestarError):
    kind = "http"


class TooLargeError(LodestarError):
    kind = "response_too_large"


CLASSES = {c.kind: c for c in (ConfigError, ParseError, NoResultsError, BlockedError, RateLimitedError, HttpError, TooLargeError)}


def render(kind: Column | str, detail: Column | str) -> Column:
    """The message of a failure row; null for an unknown kind."""
    kind, detail = (F.col(x) if isinstance(x, str) else x for x in (kind, detail))
    out = F.lit(None).cast("string")
    for name, form in KINDS.items():
        before, after = form.split("{}")
        out = F.when(kind == name, F.concat(F.lit(before), detail, F.lit(after))).otherwise(out)
    return out


def is_retryable(kind: Column | str) -> Column:
    return (F.col(kind) if isinstance(kind, str) else kind).isin(*RETRYABLE)


def of_transport(chain: Column) -> Column:
    """Policy failures recovered from a chain of transport messages."""
    blocked = chain.contains("blocked by egress policy") | chain.contains("refusing to connect") | chain.contains("too many redirects")
    return F.when(blocked, "blocked_by_policy").otherwise("network")


def of_status(status: Column, scraped: bool = False) -> Column:
    """Null for success; ``scraped`` endpoints answer 403 to robots."""
    limited = status.isin(202, 403, 429) if scraped else status.isin(202, 429)
    return F.when(limited, "rate_limited").when(~status.between(200, 299), "http")


def status_retryable(status: Column) -> Column:
    return status.isin(202, 429, 500, 502, 503, 504)
