"""Language identification of mixed-language text.

The script of a word (Unicode ranges) narrows its candidate languages; each candidate scores the
word by smoothed character trigrams; Viterbi with a switching penalty over the words of a text
labels spans, and the language that holds most letters is the text's own.

Defined results: a text that is null, empty or without letters gets ``und`` and score 0. A word in
a script that no learned language writes is left to its neighbours. Ties go to the language whose
name is smaller. A corpus without usable labels yields ``und`` for every text. Rows whose id is
null are labelled but never learned from; repeated rows are labelled alike; extra columns are kept
out of the way, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import remainder, small_batches, widened, without

UND = "und"
BUCKETS = 1 << 14
#: First code point of each range, and the script from there on.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPTS = tuple(sorted({s for _, s in SCRIPT_STARTS}))


@dataclass(frozen=True)
class Model:
    """Log probabilities of trigram buckets by language, and the languages that write each script."""

    languages: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS, languages) float32
    candidates: np.ndarray  # (scripts, languages) bool


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point up to U+323AF: is it a letter or mark, its lower-case form, its script."""
    n = 0x323B0
    kind = np.zeros(n, bool)
    low = np.arange(n, dtype=np.uint32)
    for c in range(0x30000):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LM":
            kind[c] = True
            lower = ch.lower()
            if len(lower) == 1:
                low[c] = ord(lower)
    kind[0x30000:] = True
    script = np.zeros(n, np.uint8)
    for start, name in SCRIPT_STARTS:
        script[start:] = SCRIPTS.index(name)
    return kind, low, script


def _words(texts: pa.Array) -> dict[str, np.ndarray]:
    """Words of a column of texts: first row of each text, each letter's trigram bucket, word borders."""
    kind, low, script = _letters()
    values = texts.fill_null("").to_pylist()
    lengths = np.fromiter((len(v) for v in values), np.int64, len(values))
    # One blank behind each text keeps words apart.
    chars = np.frombuffer("\n".join([*values, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.where(chars < len(kind), chars, 0)
    letter = kind[chars]
    at = np.flatnonzero(letter)
    begins = np.ones(len(at), bool)
    begins[1:] = at[1:] != at[:-1] + 1
    first = np.flatnonzero(begins)
    c = low[chars].astype(np.uint32)
    c[~letter] = 0
    before = np.concatenate(([0], c[:-1])).astype(np.uint32)
    after = np.concatenate((c[1:], [0])).astype(np.uint32)
    mixed = (before * np.uint32(2654435761) ^ c * np.uint32(2246822519) ^ after * np.uint32(3266489917))[at]
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(2246822519)
    bucket = (mixed >> np.uint32(18)).astype(np.int32)  # 14 bits
    ends = np.cumsum(lengths + 1)
    return {
        "bucket": bucket,
        "first": first,
        "length": np.diff(np.append(first, len(at))),
        "start": at[first],
        "text": np.searchsorted(ends, at[first], "right"),
        "script": script[chars[at[first]]],
        "text_start": ends - lengths - 1,
    }


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", per_language: int = 20_000, doc_id: str = "doc_id") -> Model:
    """Trigram counts of each language, from at most about ``per_language`` labelled rows of each.

    ``docs`` holds only rows that may be learned from. The sample is bounded by that parameter,
    is drawn by a hash of the row's id, and is summed in tables of at most BUCKETS x languages.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text")
    )
    sizes = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}
    if not sizes:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    share = F.lit(1.0)
    for name, n in sizes.items():
        if n > per_language:
            share = F.when(F.col("_lang") == name, F.lit(per_language / n)).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("language")), F.lit(1 << 30)) < share * float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in small_batches(batches, "_text", 2 << 20):
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            own = np.array([names.index(x) for x in langs])
            w = _words(batch.column(1))
            of_word = own[w["text"]]
            of_letter = np.repeat(of_word, w["length"])
            for i, name in enumerate(names):
                total = sums.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                total[:BUCKETS] += np.bincount(w["bucket"][of_letter == i], minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(w["script"][of_word == i], w["length"][of_word == i], minlength=len(SCRIPTS)).astype(np.int64)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])

    counts = sample.select("_lang", "_text").mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(sizes))
    full = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    where = {x: i for i, x in enumerate(languages)}
    full[counts["bucket"].to_numpy(np.int64), counts["lang"].map(where).to_numpy(np.int64)] = counts["n"].to_numpy(float)
    letters = full[:BUCKETS]
    smooth = 0.5
    weights = np.log((letters + smooth) / (letters.sum(axis=0) + smooth * BUCKETS)).astype(np.float32)
    scripts = full[BUCKETS:]
    candidates = scripts >= np.maximum(1, 0.002 * scripts.sum(axis=0))
    return Model(languages, weights, candidates)


def _paths(scores: np.ndarray, text: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi over the words of each text, many texts in step; scores: (words, languages), text: rising."""
    out = np.zeros(len(scores), np.int32)
    if not len(scores):
        return out
    begins = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    sizes = np.diff(np.append(begins, len(text)))
    order = np.argsort(-sizes, kind="stable")
    k = scores.shape[1]
    i = 0
    while i < len(order):
        most = int(sizes[order[i]])
        group = order[i : i + max(1, min(512, 8_000_000 // (most * k)))]
        i += len(group)
        start, size = begins[group], sizes[group]
        n = len(group)
        moved = np.zeros((most, n, k), np.bool_)  # came from the best language of the word before
        prior = np.zeros((most, n), np.int16)
        best = scores[start].astype(np.float64)
        for t in range(1, most):
            live = int(np.searchsorted(-size, -t, "left"))  # texts with more than t words
            cur = best[:live]
            top = cur.argmax(axis=1)
            jump = cur[np.arange(live), top][:, None] - penalty
            moved[t, :live] = jump > cur
            prior[t, :live] = top
            best[:live] = np.maximum(jump, cur) + scores[start[:live] + t]
        state = best.argmax(axis=1)
        for t in range(most - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, "left"))
            out[start[:live] + t] = state[:live]
            if t:
                state[:live] = np.where(moved[t, np.arange(live), state[:live]], prior[t, :live], state[:live])
    return out


def label(model: Model, texts: pa.Array, penalty: float) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language, score and spans (code points, end exclusive) of each text."""
    n, k = len(texts), len(model.languages)
    found, scored = [], []
    row = 0
    for part in small_batches(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), "t", 2 << 20):
        w = _words(part.column(0))
        if k and len(w["first"]):
            columns = [np.add.reduceat(model.weights[:, j][w["bucket"]], w["first"]) for j in range(k)]
            scored.append(np.column_stack(columns).astype(np.float32))
        begin = w["start"] - w["text_start"][w["text"]]
        found.append((w["text"] + row, begin, w["length"], w["script"]))
        row += part.num_rows
    text, begin, length, script = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    if not len(text) or not k:
        return [UND] * n, np.zeros(n), [[] for _ in range(n)]
    scores = np.concatenate(scored)
    scores -= scores.max(axis=1, keepdims=True)
    allowed = model.candidates[script]
    none = ~allowed.any(axis=1)
    scores = np.where(allowed, np.maximum(scores, -40), np.float32(-80))
    scores[none] = 0
    state = _paths(scores, text, penalty)
    weight = np.bincount(text * k + state, length, n * k).reshape(n, k)
    total = weight.sum(axis=1)
    known = np.zeros(n, bool)
    known[text[~none]] = True
    top = weight.argmax(axis=1)
    good = (total > 0) & known
    score = np.where(good, weight.max(axis=1) / np.maximum(total, 1), 0.0)
    names = [model.languages[t] if g or x else UND for t, g, x in zip(top, good, total > 0, strict=True)]
    spans: list[list[dict]] = [[] for _ in range(n)]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (state[1:] != state[:-1])))
    last = np.append(first[1:], len(state)) - 1
    end = begin[last] + length[last]
    for t, b, e, s in zip(text[first].tolist(), begin[first].tolist(), end.tolist(), state[first].tolist(), strict=True):
        spans[t].append({"start": b, "end": e, "lang": model.languages[s]})
    return names, score, spans


def identify(docs: DataFrame, model: Model, *, text: str = "text", penalty: float = 12.0) -> DataFrame:
    """Every row of ``docs`` with its language ``lang_pred``, ``lang_score`` (the share of letters in
    spans of that language) and ``lang_spans``; these names replace columns of the same name."""
    data = without(docs, "lang_pred", "lang_score", "lang_spans")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    spark = docs.sparkSession
    # At most BUCKETS float32 values a language: 64 kB each.
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, max(1 << 20, (24 << 20) // max(4, len(shared.value.languages)))):
            names, score, spans = label(shared.value, batch.column(batch.schema.get_field_index(text)), penalty)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)],
                [*batch.schema.names, "lang_pred", "lang_score", "lang_spans"],
            )

    schema = widened(data.schema, lang_pred="string", lang_score="double", lang_spans="array<struct<start:bigint,end:bigint,lang:string>>")
    return data.mapInArrow(work, schema)


def learnable(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows that may be learned from: not those whose crc32 of the id leaves 2 modulo 4."""
    return docs.where(F.col(doc_id).isNotNull() & (remainder(doc_id, 4) != 2))
