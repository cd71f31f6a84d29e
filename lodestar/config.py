"""Settings: strict keys, defaults and clamps; a flag wins over the file, the file over the default."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace

from lodestar.errors import ConfigError
from lodestar.sources.registry import resolve


@dataclass(frozen=True)
class Config:
    engine: str = "duckduckgo"
    image_engine: str = "bing"
    delay_ms: int = 300
    timeout_secs: int = 15
    user_agent: str = ""
    contact_email: str | None = None
    fxtwitter_base_url: str | None = None
    safe_search: bool = False
    lang: str | None = None
    region: str | None = None
    max_chars: int = 20_000
    max_results: int = 5
    cache_ttl_secs: int = 3600
    cache_max_entries: int = 1000
    cache_max_bytes: int = 100 * 1024 * 1024
    fallback: bool = True
    respect_robots: bool = False
    image_max_bytes: int = 5 * 1024 * 1024
    image_overwrite: bool = False
    allow_private_network: bool = False
    allow_proxy: bool = True


def checked(c: Config) -> Config:
    blank = lambda s: s.strip() or None if isinstance(s, str) else s
    return replace(
        c, engine=resolve(c.engine), image_engine=resolve(c.image_engine, images=True), timeout_secs=max(1, c.timeout_secs), max_chars=max(1, c.max_chars),
        max_results=min(50, max(1, c.max_results)), image_max_bytes=max(1024, c.image_max_bytes), contact_email=blank(c.contact_email), fxtwitter_base_url=blank(c.fxtwitter_base_url),
    )


def load(path: str | None = None, **flags: object) -> Config:
    """From a TOML file (LODESTAR_CONFIG if no path is given; a path that is given must exist)."""
    path = path or os.environ.get("LODESTAR_CONFIG")
    values: dict = {}
    if path:
        if not os.path.isfile(path):
            raise ConfigError(f"{path}: no such file")
        with open(path, "rb") as f:
            try:
                values = tomllib.load(f)
            except tomllib.TOMLDecodeError as e:
                raise ConfigError(f"{path}: {e}") from e
    known = {f.name: f.type for f in fields(Config)}
    for k, v in values.items():
        if k not in known:
            raise ConfigError(f"unknown setting '{k}'")
        default = getattr(Config, k)
        if default is not None and (type(v) is not type(default)):
            raise ConfigError(f"setting '{k}' must be {type(default).__name__}")
    return checked(Config(**{**values, **{k: v for k, v in flags.items() if v is not None}}))


def write_default(path: str) -> None:
    """A new file with every setting; an existing one is left alone."""
    lines = []
    for f in fields(Config):
        v = getattr(Config, f.name)
        lines.append(f"# {f.name} =" if v is None else f"{f.name} = {str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, int) else chr(34) + v + chr(34)}")
    try:
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
            f.write("\n".join(lines) + "\n")
    except FileExistsError as e:
        raise ConfigError(f"{path} exists") from e


def cache_entries(no_cache: bool, cache: bool, configured: int) -> int:
    return 0 if no_cache else max(1, configured) if cache else configured


def respects_robots(off: bool, on: bool, configured: bool) -> bool:
    return False if off else on or configured
