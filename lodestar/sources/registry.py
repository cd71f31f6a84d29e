"""The engines that payloads can come from, as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodestar.errors import ConfigError


@dataclass(frozen=True)
class Engine:
    name: str
    kind: str
    description: str
    aliases: tuple[str, ...] = ()


#: Names, aliases and kinds, in fallback order.
TEXT = (
    Engine("duckduckgo", "web", "General web search, result pages.", ("ddg",)),
    Engine("bing", "web", "General web search, RSS with result pages behind it."),
    Engine("wikipedia", "encyclopedia", "Encyclopedia articles of a language edition.", ("wiki",)),
    Engine("hackernews", "news", "Technology stories.", ("hn",)),
    Engine("reddit", "news", "Posts from Atom feeds."),
    Engine("fxtwitter", "news", "Public posts of a social network.", ("fx", "x")),
    Engine("telegram", "news", "Posts of a public channel.", ("tg",)),
    Engine("stackexchange", "qa", "Programming questions.", ("stackoverflow", "so")),
    Engine("openalex", "academic", "Open catalogue of scholarly works."),
    Engine("crossref", "academic", "DOI and citation records."),
    Engine("pubmed", "academic", "Biomedical literature."),
    Engine("crates", "package", "Crates by keyword.", ("crates.io",)),
    Engine("npm", "package", "Packages by keyword."),
    Engine("pypi", "package", "Packages by exact name."),
    Engine("nominatim", "geo", "Places.", ("osm",)),
)
IMAGES = (Engine("bing", "image", "Image search, result pages."), Engine("duckduckgo", "image", "Image search, JSON.", ("ddg",)))


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, e.name, list(e.aliases), e.kind, e.description) for i, e in enumerate(TEXT + IMAGES)]
    return spark.createDataFrame(rows, "position int, name string, aliases array<string>, kind string, description string")


def resolve(name: str, images: bool = False) -> str:
    """The canonical name behind a name or alias, in any case."""
    low = name.strip().lower()
    for e in IMAGES if images else TEXT:
        if low == e.name or low in e.aliases:
            return e.name
    raise ConfigError(f"unknown engine '{name}'; known: {', '.join(e.name for e in (IMAGES if images else TEXT))}")
