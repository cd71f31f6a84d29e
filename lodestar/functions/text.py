"""String functions as Column expressions; row functions only where order inside a string decides."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.udf import vectorised

SNIPPET_MAX, SNIPPET_KEEP = 300, 297
PASSAGE_TARGET, PASSAGE_MAX = 600, 1200
NAME_BYTES, LINE_CAP = 120, 10_000
#: Controls and bidirectional marks that must not reach an output.
CONTROLS = r"\x00-\x08\x0B-\x1F\x7F-\x{9F}\x{200E}\x{200F}\x{2028}\x{2029}\x{202A}-\x{202E}\x{2066}-\x{2069}"
#: Words that never count as search terms.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of",
    "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why",
    "with",
)
#: Scripts written without blanks, cut into pairs of characters.
CJK = (
    r"\x{3005}-\x{3007}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
    r"\x{FF66}-\x{FF9F}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}\x{20000}-\x{2FFFF}"
)
#: File names that some systems reserve.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
#: Characters escaped in a URL path, besides controls and non-ASCII.
PATH_UNSAFE = ' "#<>?`{}\\%^|[]'


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """Runs of Unicode blanks become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def snippet(c: Column | str) -> Column:
    flat = collapse(c)
    return F.when(F.length(flat) > SNIPPET_MAX, F.concat(F.substring(flat, 1, SNIPPET_KEEP), F.lit("..."))).otherwise(flat)


def sanitize_text(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"[{CONTROLS}]", "")


def sanitize_line(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"[\t\n{CONTROLS}]", "")


def truncate_chars(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def join_meta(*parts: Column) -> Column:
    """Trimmed, non-empty parts joined by a middle dot."""
    trimmed = F.transform(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda x: F.trim(x))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), " · ")


def join_all(*parts: Column) -> Column:
    """Parts joined by a middle dot, the empty ones too."""
    return F.concat_ws(" · ", *parts)


def strip_tags(c: Column | str) -> Column:
    """Removes what looks like markup: no ``@``, and a leading ``!``, ``?``, ``/`` or tag name,
    with no lone ``&&`` or ``||`` among the attributes."""
    name = r"\s*[A-Za-z][A-Za-z0-9:-]*/*(?=[\s>])(?:(?!\s(?:&&|\|\|)/*[\s>])[^>@])*"
    return F.regexp_replace(col(c), rf"<(?:\s*[!?/][^>@]*|{name})>", "")


_ENTITY = re.compile(r"&([^;&]{0,10});|&")
#: The named entities that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_DANGEROUS = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f‎‏  ‪-‮⁦-⁩]")


def unescape_text(s: str) -> str:
    """One pass over entities: six names and numbers; all others stay as they are."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name is None:
            return "&"
        if name in ENTITIES:
            return ENTITIES[name]
        number = re.fullmatch(r"#(?:[xX]([0-9a-fA-F]+)|(\d+))", name)
        if not number:
            return m[0]
        value = int(number[1], 16) if number[1] else int(number[2])
        if value > 0x10FFFF or 0xD800 <= value <= 0xDFFF:
            return m[0]
        return "" if _DANGEROUS.fullmatch(chr(value)) else chr(value)

    return _ENTITY.sub(one, s) if "&" in s else s


@vectorised("string")
def unescape_entities(s: pd.Series) -> pd.Series:
    return s.map(unescape_text, na_action="ignore")


def unescape_common(c: Column | str) -> Column:
    """The six named entities, in one pass of the engine's own functions: ``&amp;`` goes last."""
    out = col(c)
    for name, value in (*((n, v) for n, v in ENTITIES.items() if n != "amp"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return out


def strip_html(c: Column | str) -> Column:
    """Entities decoded, then markup removed, then blanks collapsed. Texts without numeric or double
    escapes never leave the engine's own functions."""
    c = col(c)
    plain = F.when(c.rlike(r"&#|&amp;"), unescape_entities(F.when(c.rlike(r"&#|&amp;"), c))).otherwise(unescape_common(c))
    return collapse(strip_tags(plain))


def extract_tag(c: Column | str, tag: str) -> Column:
    """Inner text of the first complete ``<tag ...>``; empty if it closes itself or never closes."""
    return F.regexp_extract(col(c), rf"(?s)^(?:(?!<{tag}[\s/>]).)*?<{tag}(?=[\s/>])(?:[^>]*[^>/])?>(.*?)</{tag}>", 1)


def extract_attr(c: Column | str, attr: str) -> Column:
    return F.regexp_extract(col(c), rf'(?s)(?:^|[\x20\t\n\r\f<]){attr}="([^"]*)"', 1)


def sanitize_name_text(name: str) -> str:
    kept = re.sub(r"-+", "-", "".join(c if c.isalnum() or c in "-_." else "-" for c in name)).strip("-")
    kept = kept.encode()[:NAME_BYTES].decode("utf-8", "ignore").strip("-")
    if not kept.strip("."):
        return "image"
    if kept.split(".")[0].lower() in RESERVED:
        return kept.encode()[: NAME_BYTES - 5].decode("utf-8", "ignore") + "-file"
    return kept


@vectorised("string")
def sanitize_name(s: pd.Series) -> pd.Series:
    return s.map(sanitize_name_text, na_action="ignore")


def encode_path(c: Column | str, keep_slashes: bool = True) -> Column:
    """Percent-encoding of a URL path: form encoding, with what a path keeps put back."""
    out = F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20"))
    unsafe = PATH_UNSAFE if keep_slashes else PATH_UNSAFE + "/"
    for code in range(0x21, 0x7F):
        ch = chr(code)
        if not ch.isalnum() and ch not in unsafe and ch not in "-_.*":
            out = F.replace(out, F.lit(f"%{code:02X}"), F.lit(ch))
    return out


def fold_width(c: Column | str) -> Column:
    """Full-width forms become ASCII."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
    folded = F.translate(col(c), wide, "".join(map(chr, range(0x21, 0x7F))) + " ")
    return F.when(col(c).rlike(r"[\x{FF01}-\x{FF5E}\x{3000}]"), folded).otherwise(col(c))


def tokenize(c: Column | str) -> Column:
    """Lower-case words without stopwords; runs of CJK characters as overlapping pairs.

    Texts without such characters take the short way: one match of words, one filter."""
    low = F.lower(fold_width(c))
    mixed = F.regexp_extract_all(low, F.lit(rf"[{CJK}]+|[[\p{{IsAlphabetic}}\p{{N}}]&&[^{CJK}]]+"), F.lit(0))
    plain = F.regexp_extract_all(low, F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))

    def pieces(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(rf"^[{CJK}]") & (F.length(run) > 1), pairs).otherwise(F.array(run))

    words = F.when(col(c).rlike(f"[{CJK}]"), F.flatten(F.transform(mixed, pieces))).otherwise(plain)
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_tokens(c: Column | str, use: Callable[[Column], Column]) -> Column:
    """``use`` of a text's tokens, made once."""
    return let(tokenize(c), use)


def term_counts(tokens: Column) -> Column:
    """(term, n) of each different token of an array: its sorted tokens' runs, found without leaving the row."""

    def counted(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).cast("bigint").alias("n"))))

    none = F.array().cast("array<struct<term:string,n:bigint>>")
    return let(F.array_sort(tokens), lambda ordered: F.when(F.size(ordered) > 0, counted(ordered)).otherwise(none))


def query_terms(c: Column | str) -> Column:
    return F.array_distinct(tokenize(c))


def split_long_text(line: str) -> list[str]:
    """Pieces of a line over PASSAGE_MAX characters: cut at a sentence end from PASSAGE_TARGET on."""
    if len(line) <= PASSAGE_MAX:
        return [line]
    out, start = [], 0
    ends = [m.end() for m in re.finditer(r"[。！？．]|[.!?](?=\s|$)", line)]
    at = 0
    while start < len(line):
        while at < len(ends) and ends[at] < start + PASSAGE_TARGET:
            at += 1
        end = ends[at] if at < len(ends) and ends[at] <= start + PASSAGE_MAX else start + PASSAGE_MAX
        piece = line[start:end].strip()
        if piece or end < len(line):
            out.append(piece)
        start = end
    return out


def split_passages_text(text: str) -> list[str]:
    """Lines packed to about PASSAGE_TARGET characters; a heading starts a passage and keeps its body."""
    out: list[str] = []
    cur: list[str] = []
    size, bare = 0, False
    for line in filter(None, (x.strip() for x in text.split("\n"))):
        heading = line.startswith("#")
        if heading and not bare and cur:
            out.append("\n".join(cur))
            cur, size = [], 0
        for piece in split_long_text(line):
            if size and size + len(piece) > PASSAGE_TARGET and not bare:
                out.append("\n".join(cur))
                cur, size = [], 0
            bare = heading and (bare or not cur)
            size += len(piece) + bool(cur)
            cur.append(piece)
    if cur:
        out.append("\n".join(cur))
    return out


#: The start of a line up to the first sentence end at which a piece may be cut.
_SENTENCE = rf"(?s)^(.{{{PASSAGE_TARGET - 1},{PASSAGE_MAX - 1}}}?(?:[。！？．]|[.!?](?=(?U:\s)|$)))"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_long(c: Column | str) -> Column:
    """Pieces of a line over PASSAGE_MAX characters: cut at the first sentence end from PASSAGE_TARGET on, or
    where the piece is full. A fold whose state is where the next piece starts."""
    line = col(c)
    empty = F.struct(F.lit(0).alias("start"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        # One character more than fits, so that a full stop at the end sees what follows it.
        window = F.substring(line, acc["start"] + 1, F.lit(PASSAGE_MAX + 1))
        sentence = F.regexp_extract(window, _SENTENCE, 1)
        piece = F.when(sentence != "", sentence).otherwise(F.substring(window, 1, PASSAGE_MAX))
        end = acc["start"] + F.length(piece)
        kept = (_trimmed(piece) != "") | (end < F.length(line))
        return F.when(
            acc["start"] < F.length(line),
            F.struct(end.alias("start"), F.when(kept, F.array_append(acc["out"], _trimmed(piece))).otherwise(acc["out"]).alias("out")),
        ).otherwise(acc)

    most = F.sequence(F.lit(1), F.ceil(F.length(line) / PASSAGE_TARGET).cast("int"))
    return F.when(F.length(line) <= PASSAGE_MAX, F.array(line)).otherwise(F.aggregate(most, empty, step, lambda acc: acc["out"]))


def split_passages(c: Column | str) -> Column:
    """Lines packed to about PASSAGE_TARGET characters; a heading starts a passage and keeps its body.

    A fold over the pieces of all lines: its state is what is done, the passage being filled and whether that
    holds nothing but headings."""

    def pieces(line: Column) -> Column:
        return F.transform(split_long(line), lambda p, i: F.struct(p.alias("p"), line.startswith("#").alias("heading"), (i == 0).alias("first")))

    none = F.lit(None).cast("string")
    empty = F.struct(F.array().cast("array<string>").alias("out"), none.alias("cur"), F.lit(False).alias("bare"))

    def step(acc: Column, x: Column) -> Column:
        opens = x["first"] & x["heading"] & ~acc["bare"]
        full = (F.length(acc["cur"]) > 0) & (F.length(acc["cur"]) + F.length(x["p"]) > PASSAGE_TARGET) & ~acc["bare"]
        flush = acc["cur"].isNotNull() & (opens | full)
        fresh = acc["cur"].isNull() | flush
        return F.struct(
            F.when(flush, F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"]).alias("out"),
            F.when(fresh, x["p"]).otherwise(F.concat(acc["cur"], F.lit("\n"), x["p"])).alias("cur"),
            (x["heading"] & (acc["bare"] | fresh)).alias("bare"),
        )

    done = lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"]))
    return F.aggregate(F.flatten(F.transform(lines(F.coalesce(col(c), F.lit(""))), pieces)), empty, step, done)


@vectorised("array<string>")
def split_long_rows(s: pd.Series) -> pd.Series:
    """``split_long`` for SQL sessions."""
    return s.map(lambda x: split_long_text(x or ""))


@vectorised("array<string>")
def split_passages_rows(s: pd.Series) -> pd.Series:
    """``split_passages`` for SQL sessions."""
    return s.map(lambda x: split_passages_text(x or ""))


def escape_link_text(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"([\\\[\]])", r"\\$1")


def post_process(c: Column | str) -> Column:
    """Trimmed lines without blank ones, at most LINE_CAP."""
    return F.array_join(F.slice(lines(c), 1, LINE_CAP), "\n")


def lines(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def accept_language(c: Column | str, default: str = "en-US,en;q=0.9") -> Column:
    """A header value that prefers a language tag, then its primary language, then English."""
    tag = F.trim(col(c))
    good = tag.rlike(r"^[A-Za-z0-9]{1,8}([-_][A-Za-z0-9]{1,8})*$") & (F.length(tag) <= 35)
    tag = F.replace(tag, F.lit("_"), F.lit("-"))
    primary = F.substring_index(tag, "-", 1)
    english = F.when(F.lower(tag) == "en", tag).otherwise(F.concat(tag, F.lit(",en;q=0.9")))
    other = F.concat(tag, F.lit(","), primary, F.lit(";q=0.9,en;q=0.8"))
    return F.when(~F.coalesce(good, F.lit(False)), F.lit(default)).when(F.lower(primary) == "en", english).otherwise(other)


def cache_key(*parts: Column | str, version: int = 5) -> Column:
    """SHA-256 of the parts as JSON, so that no separator can be forged."""
    doc = F.to_json(F.struct(F.array(*map(col, parts)).alias("parts"), F.lit(version).alias("v")))
    return F.sha2(doc.cast("binary"), 256)


def fetch_key(url: Column | str, *, markdown: bool, raw: bool, max_chars: int, query: str | None = None, passages: int = 5, allow_private: bool = False) -> Column:
    """The cache key of a fetched page: every option that changes what is made of it."""
    asked = [F.lit(query), F.lit(str(passages))] if query is not None else []
    return cache_key(F.lit("fetch"), url, *(F.lit(str(x)) for x in (markdown, raw, max_chars, allow_private)), *asked)


def search_key(engine: str, query: str, count: int, options: dict[str, object]) -> Column:
    """The cache key of a search. Bounds are keyed as they were written: they are resolved when rows are filtered."""
    return cache_key(F.lit("search"), F.lit(engine), F.lit(query), F.lit(str(count)), *(F.lit(f"{k}={options[k]}") for k in sorted(options) if options[k] not in (None, "")))


def images_key(engine: str, query: str, count: int, options: dict[str, object]) -> Column:
    return cache_key(F.lit("images"), F.lit(engine), F.lit(query), F.lit(str(count)), *(F.lit(f"{k}={options[k]}") for k in sorted(options) if options[k] not in (None, "")))
