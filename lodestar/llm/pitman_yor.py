"""Language-model scoring with a hierarchical Pitman-Yor model.

Tokens are lower-cased (A-Z) words and one end per text. Every pair of words that is followed by
another has a restaurant of its own, as has every word; the pairs that end in a word share the
word's restaurant as their parent, and the words' restaurants share the root. None is left out. Table
counts are sampled by Gibbs, each from its conditional given its customers (generalised Stirling
numbers), and predictive probabilities are averaged over the samples. The root's customers are all
tokens, one table for each type, over a uniform base of the training vocabulary and one unknown
word; so each text's probability is proper. Discounts are estimated from how many dishes have one
and two customers.

How it is spread: each token travels once, to the bucket of the word before it, where that word's
restaurant and those of all pairs that end in it are counted, seated and looked up; only sums for
each text travel back. The tokens after a word with more than ``limit`` of them are dealt to
groups by the word before it, so that no bucket depends on the most frequent word; those after a pair
of two such words by a hash of the text too. A group only counts its tokens: their restaurants are
whole (``wide``). Each of the pairs' has its counts from all groups in one task, and those of the
words share theirs dish by dish; table counts are summed between the two in every sweep. What is
broadcast is the counts of the ``hot`` most frequent tokens; counts of all other tokens are joined.

Defined results: null and empty texts are one end token. With nothing learned every token has
probability 1. Rows whose id is null are scored, not learned from. Repeated rows count and are
scored as often as they occur. Words and texts of any length are taken whole. Extra columns are not
read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.llm.common import dropped, freed, small_batches, stored

END = b" end"  # no word holds a blank
STIRLING = 64
FLUSH = 1_000_000  # tokens that a task sends at once
BUCKET = 1_500_000  # tokens of one bucket, about
LIMIT = 500_000  # tokens of one word's restaurant
SHELF_PARTS = 16  # buckets of a word for each shelf of its dishes
STRENGTHS = (5.0, 2.0)  # of the restaurants of words and of pairs
#: The key of what comes before a text, and odd numbers that tell keys apart.
START = np.uint64(0xD1B54A32D192ED03)
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def code(word: bytes) -> int:
    """A token's 64-bit key, signed."""
    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Lexicon:
    """Hot tokens by falling count. A token's code is its place, their number for what comes before
    a text, and one more for any other word."""

    keys: np.ndarray  # by code, with START's at the end
    order: np.ndarray  # codes by rising key
    counts: np.ndarray  # in the texts learned from
    seen: np.ndarray  # in all texts, with the number of texts at the end
    tokens: int  # N
    types: int  # V
    discount: float

    @property
    def hot(self) -> int:
        return len(self.counts)

    def codes(self, keys: np.ndarray) -> np.ndarray:
        if not self.hot:
            return np.ones(len(keys), np.int64)
        at = self.order[np.minimum(np.searchsorted(self.keys[:-1], keys, sorter=self.order), self.hot - 1)]
        return np.where(self.keys[at] == keys, at, self.hot + 1)

    def rest(self, strength: float) -> float:
        """The root's customers from its base, for each of the types and the unknown word."""
        return (strength + self.discount * self.types) / (self.types + 1)


def vocabulary(texts: DataFrame) -> DataFrame:
    """(h, n, m): for every token of (_text, _learn), its count in the texts learned from and in all; summed in each task first."""

    def flush(learned: Counter, other: Counter) -> pa.RecordBatch:
        words = [*learned, *other]
        n = [*learned.values(), *repeat(0, len(other))]
        m = [*learned.values(), *other.values()]
        return pa.RecordBatch.from_pydict({"h": pa.array([code(w) for w in words], pa.int64()), "n": pa.array(n, pa.int64()), "m": pa.array(m, pa.int64())})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: tuple[Counter, Counter] = Counter(), Counter()
        for batch in small_batches(batches, "_text"):
            for words, learn in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own = total[0] if learn else total[1]
                own.update(words)
                own[END] += 1
            if len(total[0]) + len(total[1]) > 400_000:
                yield flush(*total)
                total = Counter(), Counter()
        if total[0] or total[1]:
            yield flush(*total)

    found = texts.mapInArrow(work, "h bigint, n bigint, m bigint")
    return stored(found.groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))


def _texts(column: pa.Array) -> list[list[bytes]]:
    return [(t or b"").lower().split() for t in column.cast(pa.binary()).to_pylist()]


def discount(ones: int, twos: int) -> float:
    """The discount that the numbers of dishes with one and two customers tell."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def lexicon(vocab: DataFrame, *, hot: int) -> tuple[Lexicon, int]:
    """The hot tokens (all with at least the smallest count that leaves no more than ``hot``), and the number of all tokens."""
    known = vocab.where("n > 0")
    tokens, types, ones, twos = (x or 0 for x in known.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first())
    everything = vocab.agg(F.sum("m")).first()[0] or 0
    # Few counts are high: their histogram says where to cut. At most about sqrt(2N) rows, by N/n at most.
    least = 1 if types <= hot else max(1, tokens // hot + 1)
    if types > hot:
        sizes = known.where(F.col("n") < least).groupBy("n").agg(F.count("*").alias("k")).toPandas().sort_values("n", ascending=False)
        left = hot - known.where(F.col("n") >= least).count()
        for n, k in zip(sizes["n"], sizes["k"], strict=True):
            left -= k
            if left < 0:
                break
            least = int(n)
    top = known.where(F.col("n") >= least).toPandas()
    keys, counts, seen = (top[c].to_numpy(np.int64) for c in ("h", "n", "m"))
    rank = np.lexsort((keys, -counts))
    keys = keys[rank].view(np.uint64)
    ends = vocab.where(F.col("h") == code(END)).agg(F.sum("m")).first()[0] or 0
    return Lexicon(np.append(keys, START), np.argsort(keys), counts[rank], np.append(seen[rank], ends), tokens, types, discount(ones, twos)), everything


class _Known(dict):
    """Numbers of the tokens that a task has met, and their keys and codes."""

    def __init__(self, lex: Lexicon):
        super().__init__()
        self.lex, self.found = lex, []
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.found)
        self.found.append(xxhash.xxh64_intdigest(word))
        return n

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) < len(self.found):
            new = np.array(self.found[len(self.keys) :], np.uint64)
            self.keys, self.codes = np.append(self.keys, new), np.append(self.codes, self.lex.codes(new))
        return self.keys, self.codes


def _planes(x: np.ndarray) -> bytes:
    """Numbers under 2^32 as four runs of bytes, which compress better."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: np.ndarray, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(data[at : at + 4 * n].reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


def _packed(numbers: list[np.ndarray], keys: np.ndarray) -> bytes:
    """Arrays of numbers and one of keys, compressed."""
    head = np.array([*map(len, numbers), len(keys)], "<u4").tobytes()
    raw = b"".join([head, *map(_planes, numbers), keys.astype("<u8").tobytes()])
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec="zstd"), np.uint8)
    sizes = raw[: 4 * n + 4].view("<u4").astype(np.int64)
    at, out = 4 * n + 4, []
    for size in sizes[:-1].tolist():
        out.append(_numbers(raw, at, size))
        at += 4 * size
    return out, raw[at : at + 8 * int(sizes[-1])].copy().view(np.uint64)


def parts_of(lex: Lexicon, limit: int) -> np.ndarray:
    """In how many groups the tokens after each word are, by its code."""
    return np.maximum(-(-np.append(lex.seen, 0) // limit), 1)


def groups_of(lex: Lexicon, v: np.ndarray, u: np.ndarray, u_key: np.ndarray, text_hash: np.ndarray, limit: int) -> np.ndarray:
    """The group of a word's tokens that each token goes to."""
    count = np.append(lex.seen, 0)
    of_word = parts_of(lex, limit)[v]
    if of_word.max(initial=1) == 1:
        return np.zeros(len(v), np.int64)
    of_pair = np.maximum(-(-np.minimum(count[v], count[u]) // limit), 1)
    part = (mixed(u_key) >> np.uint64(8)) + text_hash % of_pair.astype(np.uint64)
    return (part % of_word.astype(np.uint64)).astype(np.int64)


def room_key(v_key: np.ndarray, group: np.ndarray) -> np.ndarray:
    return mixed(v_key + group.astype(np.uint64) * ODD[0])


class _Sender:
    """The tokens of some texts, sent to the buckets of the words before them."""

    def __init__(self, lex: Lexicon, buckets: int, limit: int):
        self.lex, self.buckets, self.limit = lex, buckets, limit
        self.known = _Known(lex)
        self.clear()

    def clear(self) -> None:
        self.keys, self.codes, self.sizes, self.learn, self.hashes = [], [], [], [], []
        self.tokens = 0

    def add(self, texts: list[bytes], learn: list[bool]) -> None:
        if len(self.known) > 300_000:
            self.known = _Known(self.lex)
        look, end = self.known.__getitem__, self.known[END]
        numbers: list[int] = []
        for text, own in zip(texts, learn, strict=True):
            words = text.lower().split()
            numbers.extend(map(look, words))
            numbers.append(end)
            self.sizes.append(len(words) + 1)
            self.learn.append(bool(own))
            self.hashes.append(xxhash.xxh64_intdigest(text))
        ids = np.array(numbers, np.int64)
        keys, codes = self.known.columns()
        self.keys.append(keys[ids])
        self.codes.append(codes[ids].astype(np.int32))
        self.tokens += len(ids)

    def texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, hot tokens, and the log10 of the base probability of these, for each text."""
        lex, sizes = self.lex, np.array(self.sizes, np.int64)
        code = np.concatenate(self.codes).astype(np.int64)
        base = np.append(np.log10((lex.counts + 0.1) / (lex.tokens + 0.1 * (lex.types + 1))), [0.0, 0.0])
        own = np.repeat(np.arange(len(sizes)), sizes)
        return sizes, np.bincount(own, code < lex.hot, len(sizes)).astype(np.int64), np.bincount(own, base[code], len(sizes))

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        lex, sizes = self.lex, np.array(self.sizes, np.int64)
        w_key, w = np.concatenate(self.keys), np.concatenate(self.codes).astype(np.int64)
        own = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

        def before(k: int) -> tuple[np.ndarray, np.ndarray]:
            key, c = np.full(len(w), START), np.full(len(w), lex.hot)
            at = np.flatnonzero(inside >= k)
            key[at], c[at] = w_key[at - k], w[at - k]
            return key, c

        (v_key, v), (u_key, u) = before(1), before(2)
        group = groups_of(lex, v, u, u_key, np.array(self.hashes, np.uint64)[own], self.limit)
        room = room_key(v_key, group)
        order = np.argsort(room)
        room = room[order]
        bucket = ((room >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
        flag = own * 2 + np.array(self.learn, np.int64)[own]
        a = 0
        for b in ends.tolist():
            at = order[a:b]
            first = np.flatnonzero(np.append(True, room[a + 1 : b] != room[a : b - 1]))
            rooms = at[first]
            runs = np.diff(np.append(first, b - a))
            cold = [key[i][c[i] > lex.hot] for key, c, i in ((v_key, v, rooms), (u_key, u, at), (w_key, w, at))]
            yield int(bucket[a]), _packed([v[rooms], group[rooms], runs, u[at], w[at], flag[at]], np.concatenate(cold))
            a = b


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, and which of them each value is."""
    order = np.argsort(x)
    s = x[order]
    new = np.append(True, s[1:] != s[:-1])[: len(s)]
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def stirling(most: int, discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers S(c, t) for c, t up to ``most``."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0
    t = np.arange(1, most + 1)
    for c in range(most):
        with np.errstate(divide="ignore"):
            s[c + 1, 1:] = np.logaddexp(s[c, :-1], np.log(np.maximum(c - discount * t, 0)) + s[c, 1:])
    return s


def seat(c: np.ndarray, rate: np.ndarray, discount: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A number of tables for each cell of c > 0 customers, whose dish opens tables at ``rate``.

    Up to STIRLING customers: an exact draw from the conditional, S(c, t) rate^t. Beyond, the
    first STIRLING are drawn so and the rest are seated in blocks that double.
    """
    t = np.ones(len(c), np.int64)
    few = np.minimum(c, STIRLING)
    order = np.argsort(few, kind="stable")
    starts = np.searchsorted(few[order], np.arange(2, STIRLING + 2))
    for n in range(2, STIRLING + 1):
        cells = order[starts[n - 2] : starts[n - 1]]
        for part in np.array_split(cells, max(1, len(cells) * n // 2_000_000)):
            if len(part):
                logits = table[n, 1 : n + 1] + np.arange(1, n + 1) * np.log(rate[part])[:, None]
                weight = np.cumsum(np.exp(logits - logits.max(axis=1, keepdims=True)), axis=1)
                t[part] = 1 + (rng.random(len(part))[:, None] * weight[:, -1:] > weight).sum(axis=1)
    big = np.flatnonzero(c > STIRLING)
    done = np.full(len(big), STIRLING)
    while len(big):
        block = np.minimum(done, c[big] - done)
        share = rate[big] / (done + block / 2 - discount * t[big] + rate[big])
        t[big] += rng.binomial(block, np.clip(share, 0, 1))
        done = done + block
        more = done < c[big]
        big, done = big[more], done[more]
    return t


class Bucket:
    """The restaurants of some words and of the pairs that end in them."""

    def __init__(self, v_key: np.ndarray, group: np.ndarray, u_key: np.ndarray, w_key: np.ndarray, w: np.ndarray, learn: np.ndarray):
        self.set(*self.rooms(v_key, group, u_key), w_key, w, learn)

    @staticmethod
    def rooms(v_key: np.ndarray, group: np.ndarray, u_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The restaurants of the word and of the pair before each token."""
        r1 = room_key(v_key, group)
        return r1, mixed(r1 ^ u_key * ODD[1])

    @classmethod
    def of(cls, r1: np.ndarray, r2: np.ndarray, w_key: np.ndarray, w: np.ndarray, learn: np.ndarray) -> Bucket:
        made = cls.__new__(cls)
        made.set(r1, r2, w_key, w, learn)
        return made

    def set(self, r1: np.ndarray, r2: np.ndarray, w_key: np.ndarray, w: np.ndarray, learn: np.ndarray) -> None:
        first, self.of_token = grouped(mixed(r2 + w_key * ODD[2]))
        self.n2 = np.bincount(self.of_token, learn, len(first)).astype(np.int64)
        _, self.room2 = grouped(r2[first])
        r1 = r1[first]
        cell, self.up = grouped(mixed(r1 + w_key[first] * ODD[2]))  # a pair's dish is a dish of its word
        _, self.room1 = grouped(r1[cell])
        self.w = w[first][cell]
        self.cells1 = len(cell)

    def predictive(self, p0: np.ndarray, *, strengths: tuple[float, float], burn_in: int, samples: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """For each cell, parts a and b of its predictive probability a + b * p0, averaged over seatings. ``p0`` is by code."""
        n2, up, room1, room2 = self.n2, self.up, self.room1, self.room2
        b1, b2 = strengths
        base = p0[self.w]
        a2 = discount(int((n2 == 1).sum()), int((n2 == 2).sum()))
        t2 = np.minimum(n2, 1)
        c1 = np.bincount(up, t2, self.cells1).astype(np.int64)
        a1 = discount(int((c1 == 1).sum()), int((c1 == 2).sum()))
        t1 = np.minimum(c1, 1)
        tables1, tables2 = stirling(STIRLING, a1), stirling(STIRLING, a2)
        total2 = np.bincount(room2, n2)
        many = np.flatnonzero(n2 > 1)
        sum_a, sum_b = np.zeros(len(n2)), np.zeros(len(n2))
        for sweep in range(burn_in + samples):
            total1, seated1 = np.bincount(room1, c1), np.bincount(room1, t1)
            rest1 = (b1 + a1 * seated1) / (total1 + b1)
            own1 = (c1 - a1 * t1) / (total1 + b1)[room1]
            p1 = own1 + rest1[room1] * base
            rate = (b2 + a2 * np.bincount(room2, t2))[room2[many]] * p1[up[many]]
            t2[many] = seat(n2[many], rate, a2, tables2, rng)
            c1 = np.bincount(up, t2, self.cells1).astype(np.int64)
            shared = np.flatnonzero(c1 > 1)
            t1 = np.minimum(c1, 1)
            t1[shared] = seat(c1[shared], (b1 + a1 * seated1)[room1[shared]] * base[shared], a1, tables1, rng)
            if sweep >= burn_in:
                total1, seated1 = np.bincount(room1, c1), np.bincount(room1, t1)
                own1 = (c1 - a1 * t1) / (total1 + b1)[room1]
                rest1 = ((b1 + a1 * seated1) / (total1 + b1))[room1]
                rest2 = ((b2 + a2 * np.bincount(room2, t2)) / (total2 + b2))[room2]
                sum_a += (n2 - a2 * t2) / (total2 + b2)[room2] + rest2 * own1[up]
                sum_b += rest2 * rest1[up]
        return sum_a / samples, sum_b / samples

LETTER = "key int, kind int, source int, blob binary, x bigint, y bigint"
#: Kinds of letters. To a pair's home: its cells, those of two customers or more, their tables, replies of dishes.
#: To a dish's home: its keys, its counts. To a bucket: its tokens, their probabilities. Tokens that are not hot are
#: joined with their counts. The rest is added up.
TOKENS, CELLS, FULL, MANY, TABLES, DISHES, SHELF, COUNTS, REPLY, ANSWER, COLD, PAIRS, WORDS, SUMS = range(14)


def _letters(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    key, kind, source, blob = zip(*rows, strict=True)
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(kind, pa.int32()), pa.array(source, pa.int32()), pa.array(blob, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["key", "kind", "source", "blob", "x", "y"])


def _figures(kind: int, key: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(np.full(n, kind), pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["key", "kind", "source", "blob", "x", "y"])


def _delivered(*letters: DataFrame) -> DataFrame:
    """Letters of each key together, by kind and source."""
    told = letters[0].select("key", "kind", "source", "blob")
    for more in letters[1:]:
        told = told.unionByName(more.select("key", "kind", "source", "blob"))
    return told.repartition("key").sortWithinPartitions("key", "kind", "source")


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    number, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != number:
                yield number, held
                held = []
            number = row[0]
            held.append(row[1:])
    if held:
        yield number, held


def _split(x: np.ndarray, sizes: list[int] | np.ndarray) -> list[np.ndarray]:
    return np.split(x, np.cumsum(sizes)[:-1])


def _reordered(first: np.ndarray, which: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``grouped`` returns, with the distinct values sorted as by lexsort."""
    rank = np.lexsort(by)
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    return first[rank], place[which]


def _run_starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])


def _keys(lex: Lexicon, code: np.ndarray, cold: np.ndarray) -> np.ndarray:
    """Tokens' keys from their codes and the keys of those that are not hot."""
    key = lex.keys[np.minimum(code, lex.hot)]
    key[code > lex.hot] = cold
    return key


def _bits(x: np.ndarray) -> np.ndarray:
    return x.astype("<f4").view("<u4")


def _floats(bits: np.ndarray) -> np.ndarray:
    return bits.astype("<u4").view("<f4").astype(np.float64)


def wide(cells: DataFrame, lexicon: Broadcast, p0: Broadcast, *, parts: np.ndarray, homes: int, strengths: tuple[float, float], burn_in: int, samples: int, seed: int) -> DataFrame:
    """Seats the restaurants of words whose tokens are in several buckets (``parts`` says how many), and of the pairs that end in them.

    ``p0`` is by code. ``cells`` are letters to the pairs' homes: for each pair the word's number and how many cells
    follow, for each cell the dish's code and its customers in one bucket; the pairs' keys, and those of dishes that are
    not hot. Returned are letters to these buckets with parts a and b of the predictive probability a + b * p0 of the
    cells, in the order given.

    A pair's home has all cells of the pair, a dish's home (its shelf) the tables that all pairs have for a dish of a
    word; a word has a shelf for each ``SHELF_PARTS`` buckets, so that few letters are sent. In each sweep homes of
    pairs seat their cells and send table counts, homes of dishes add them up, seat them and reply.
    Only cells of two customers or more take part; one customer has one table always. Sums for each word (customers and
    tables) are added up and handed to all."""
    b1, b2 = strengths
    words = len(parts)
    spread = -(-parts // SHELF_PARTS)

    def dish_keys(word: np.ndarray, w_key: np.ndarray) -> np.ndarray:
        return mixed(mixed(word.astype(np.uint64) + ODD[0]) ^ w_key * ODD[2])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, rows in _by_key(batches):
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for _, _, blob in rows:
                (word, runs, w, n), keys = _unpacked(blob, 4)
                for own, x in zip(columns, (np.repeat(word, runs), w, n, np.repeat(keys[: len(runs)], runs), _keys(lexicon.value, w, keys[len(runs) :])), strict=True):
                    own.append(x)
            sizes = np.array([len(x) for x in columns[0]])
            w_key, r2, n, w, word = (np.concatenate(columns.pop()) for _ in range(5))
            first, which = grouped(mixed(r2 + w_key * ODD[2]))
            first, which = _reordered(first, which, w[first], r2[first])
            n2 = np.bincount(which, n, len(first)).astype(np.int64)
            _, room2 = grouped(r2[first])
            word, w, w_key = word[first], w[first], w_key[first]
            dish_key = dish_keys(word, w_key)
            dish, up = grouped(dish_key)
            part = (dish_key[dish] >> np.uint64(32)) * spread[word[dish]].astype(np.uint64) >> np.uint64(32)
            to = mixed(mixed(word[dish].astype(np.uint64) + ODD[1]) + part * ODD[0])
            to = ((to >> np.uint64(32)) * np.uint64(homes) >> np.uint64(32)).astype(np.int64)
            dish, up = _reordered(dish, up, w[dish], word[dish], to)
            to, word, w, w_key = np.sort(to), word[dish], w[dish], w_key[dish]
            one = np.minimum(n2, 1)
            many = np.flatnonzero(n2 > 1)
            sure = np.where(n2 == 1, 1, 0)
            yield _letters(
                [
                    (home, FULL, home, _packed([n2, room2, up, word, which, sizes], np.array([source for _, source, _ in rows], np.uint64))),
                    (home, MANY, home, _packed([n2[many], room2[many], up[many], np.bincount(room2, sure).astype(np.int64), np.bincount(up, sure, len(dish)).astype(np.int64), word, w], np.zeros(0, np.uint64))),
                ]
            )
            shelves, at = np.unique(to, return_index=True)
            ends = [*at[1:].tolist(), len(to)]
            c1 = np.bincount(up, one, len(dish)).astype(np.int64)
            for shelf, a, b in zip(shelves.tolist(), at.tolist(), ends, strict=True):
                yield _letters([(shelf, DISHES, home, _packed([word[a:b], w[a:b]], w_key[a:b][w[a:b] > lexicon.value.hot])), (shelf, COUNTS, home, _packed([c1[a:b]], np.zeros(0, np.uint64)))])
            yield _figures(PAIRS, np.zeros(1, np.int32), np.array([(n2 == 1).sum()]), np.array([(n2 == 2).sum()]))

    def shelved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shelf, rows in _by_key(batches):
            told = [_unpacked(blob, 2) for _, _, blob in rows]
            word, w = (np.concatenate([numbers[i] for numbers, _ in told]) for i in range(2))
            first, which = grouped(dish_keys(word, _keys(lexicon.value, w, np.concatenate([keys for _, keys in told]))))
            first, which = _reordered(first, which, w[first], word[first])
            yield _letters([(shelf, SHELF, shelf, _packed([which, np.array([len(numbers[0]) for numbers, _ in told]), word[first], w[first]], np.array([source for _, source, _ in rows], np.uint64)))])

    def seat_words(sweep: int, a1: float, seated1: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = stirling(STIRLING, a1)
            for shelf, rows in _by_key(batches):
                (which, sizes, word, w), sources = _unpacked(rows[0][2], 4)
                c1 = np.bincount(which, np.concatenate([_unpacked(blob, 1)[0][0] for _, _, blob in rows[1:]]), len(word)).astype(np.int64)
                t1 = np.minimum(c1, 1)
                if seated1 is not None:
                    many = np.flatnonzero(c1 > 1)
                    t1[many] = seat(c1[many], (b1 + a1 * seated1)[word[many]] * p0.value[w[many]], a1, table, np.random.default_rng((seed, sweep, 1, shelf)))
                yield _letters([(int(source), REPLY, shelf, _packed([c1[part], t1[part]], np.zeros(0, np.uint64))) for source, part in zip(sources.tolist(), _split(which, sizes), strict=True)])
                there = np.unique(word)
                yield _figures(SUMS, there, np.bincount(word, c1)[there].astype(np.int64), np.bincount(word, t1)[there].astype(np.int64))
                yield _figures(WORDS, np.zeros(1, np.int32), np.array([(c1 == 1).sum()]), np.array([(c1 == 2).sum()]))

        return work

    def replies(rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        told = [_unpacked(blob, 2)[0] for _, _, blob in rows]
        return np.concatenate([c for c, _ in told]), np.concatenate([t for _, t in told]), [len(c) for c, _ in told]

    def of_words(c1: np.ndarray, t1: np.ndarray, word: np.ndarray, a1: float, sums: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Parts of a dish's probability in its word's restaurant: its own, and what the root's is multiplied with."""
        total1, seated1 = sums
        return (c1 - a1 * t1) / (total1 + b1)[word], ((b1 + a1 * seated1) / (total1 + b1))[word]

    def seat_pairs(sweep: int, a1: float, a2: float, sums: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = stirling(STIRLING, a2)
            for home, rows in _by_key(batches):
                (n2, room2, up, rooms, dishes, word, w), _ = _unpacked(rows[0][2], 7)
                told = [r for r in rows if r[0] == REPLY]
                t2 = next((_unpacked(blob, 1)[0][0] for kind, _, blob in rows if kind == TABLES), np.ones(len(n2), np.int64))
                c1, t1, sizes = replies(told)
                own1, rest1 = of_words(c1, t1, word, a1, sums)
                p1 = own1 + rest1 * p0.value[w]
                rate = (b2 + a2 * (rooms + np.bincount(room2, t2, len(rooms))))[room2] * p1[up]
                t2 = seat(n2, rate, a2, table, np.random.default_rng((seed, sweep, 0, home)))
                c1 = dishes + np.bincount(up, t2, len(dishes)).astype(np.int64)
                sent = [(shelf, COUNTS, home, _packed([x], np.zeros(0, np.uint64))) for (_, shelf, _), x in zip(told, _split(c1, sizes), strict=True)]
                yield _letters([(home, TABLES, home, _packed([t2], np.zeros(0, np.uint64))), *sent])

        return work

    def average(a1: float, a2: float, sums: list[tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for home, rows in _by_key(batches):
                (n2, room2, up, word, which, sizes), sources = _unpacked(rows[0][2], 6)
                many, total2 = np.flatnonzero(n2 > 1), np.bincount(room2, n2)
                t2 = np.minimum(n2, 1)
                a, b = np.zeros(len(n2)), np.zeros(len(n2))
                for i, own in enumerate(sums):
                    t2[many] = next(_unpacked(blob, 1)[0][0] for kind, _, blob in rows if kind == 100 * (i + 1) + TABLES)
                    c1, t1, _ = replies([r for r in rows if r[0] == 100 * (i + 1) + REPLY])
                    own1, rest1 = of_words(c1, t1, word, a1, own)
                    rest2 = ((b2 + a2 * np.bincount(room2, t2)) / (total2 + b2))[room2]
                    a += (n2 - a2 * t2) / (total2 + b2)[room2] + rest2 * own1[up]
                    b += rest2 * rest1[up]
                a, b = _bits(a / samples), _bits(b / samples)
                for source, part in zip(sources.tolist(), _split(which, sizes), strict=True):
                    yield _letters([(int(source), ANSWER, home, _packed([a[part], b[part]], np.zeros(0, np.uint64)))])

        return work

    def added(letters: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each word."""
        found = letters.where(F.col("kind") == SUMS).groupBy("key").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).toPandas()  # a row for each divided word
        out = np.zeros((2, words))
        out[:, found["key"].to_numpy(np.int64)] = found[["x", "y"]].to_numpy(np.float64).T
        return out[0], out[1]

    def estimated(letters: DataFrame, kind: int) -> float:
        return discount(*letters.where(F.col("kind") == kind).agg(F.sum("x"), F.sum("y")).first())

    of = lambda letters, *kinds: letters.where(F.col("kind").isin(*kinds))
    made = stored(_delivered(cells).mapInArrow(gather, LETTER))
    shelves = stored(_delivered(of(made, DISHES)).mapInArrow(shelved, LETTER))
    told = stored(_delivered(shelves, of(made, COUNTS)).mapInArrow(seat_words(0, 0.5, None), LETTER))
    a1, a2 = estimated(told, WORDS), estimated(made, PAIRS)
    sums, seated, kept, done = added(told), None, [], []
    for sweep in range(burn_in + samples):
        before = [told, *([seated] if seated is not None else [])]
        parts = [of(made, MANY), of(told, REPLY), *([of(seated, TABLES)] if seated is not None else [])]
        seated = stored(_delivered(*parts).mapInArrow(seat_pairs(sweep, a1, a2, sums), LETTER))
        told = stored(_delivered(shelves, of(seated, COUNTS)).mapInArrow(seat_words(sweep, a1, sums[1]), LETTER))
        sums = added(told)
        if sweep <= burn_in:  # tables of a sample are needed in the end
            for old in before:
                dropped(old)
        if sweep >= burn_in:
            i = 100 * (sweep - burn_in + 1)
            kept += [of(x, kind).withColumn("kind", F.col("kind") + i) for x, kind in ((seated, TABLES), (told, REPLY))]
            done.append(sums)
    return _delivered(of(made, FULL), *kept).mapInArrow(average(a1, a2, done), LETTER)


def score(docs: DataFrame, learn: Column, *, text: str = "text", doc_id: str = "doc_id", hot: int = 262_144, strengths: tuple[float, float] = STRENGTHS, root: float = 10.0, burn_in: int = 3, samples: int = 4, seed: int = 7, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``,
    learning from the rows for which ``learn`` holds. Scores are log10 probabilities."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn"), F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("rid"))
    vocab = vocabulary(rows.select("_text", "_learn"))
    freed(spark)
    lex, everything = lexicon(vocab, hot=hot)
    shared = spark.sparkContext.broadcast(lex)  # at most ``hot`` tokens
    buckets = max(1, -(-everything // bucket))
    id_type = docs.schema[doc_id].dataType.simpleString()
    info = ["flush", "idx", "doc_id", "n_tokens", "n_hot", "base"]
    info_type = f"flush bigint, idx int, doc_id {id_type}, n_tokens bigint, n_hot bigint, base double"
    wide_parts = parts_of(lex, limit)[parts_of(lex, limit) > 1]  # of the words whose tokens are in several buckets
    found_type = f"{info_type}, blob binary, key int, kind int, source int"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(shared.value, buckets, limit)
        rids, ids = [], []

        def flush() -> Iterator[pa.RecordBatch]:
            rid = pa.concat_arrays(rids)
            at = rid[0].as_py()
            n = len(rid)
            sizes, n_hot, base = sender.texts()
            to = int(mixed(np.array([at], np.uint64))[0] % np.uint64(buckets))
            columns = [pa.array(np.full(n, to), pa.int32()), pa.array(np.full(n, at), pa.int64()), pa.array(np.arange(n), pa.int32()), pa.concat_arrays(ids), pa.array(sizes), pa.array(n_hot), pa.array(base), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", *info, "blob"])
            found = list(sender.blobs())
            n = len(found)
            numbers = [pa.array([b for b, _ in found], pa.int32()), pa.array(np.full(n, at), pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, ids[0].type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array([x for _, x in found], pa.binary())], ["bucket", *info, "blob"])
            sender.clear()
            rids.clear()
            ids.clear()

        for batch in small_batches(batches, "_text", 4 << 20):
            sender.add([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()], batch.column(1).to_pylist())
            ids.append(batch.column(2))
            rids.append(batch.column(3))
            if sender.tokens > FLUSH:
                yield from flush()
        if rids:
            yield from flush()

    # By code; a word that is not hot takes the average of those for the seating alone.
    rare = (lex.tokens - int(lex.counts.sum())) / max(1, lex.types - lex.hot)
    known = np.append(lex.counts.astype(np.float64), [0.0, rare])
    by_code = spark.sparkContext.broadcast((np.maximum(known - lex.discount, 0) * (known > 0) + lex.rest(root)) / (lex.tokens + root))

    def out(n: int, **columns: pa.Array) -> pa.RecordBatch:
        """``n`` rows of found_type; columns not given are null."""
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in found_arrow], [c for c, _ in found_arrow])

    def seat_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, p0 = shared.value, by_code.value
        number, held = None, []
        for batch in batches:
            own = batch.column(0).to_numpy()
            is_blob = batch.column(7).is_valid()
            told = batch.filter(pa.compute.invert(is_blob))
            if told.num_rows:
                yield out(told.num_rows, **dict(zip(info, told.columns[1:7], strict=True)))
            for i in np.flatnonzero(is_blob.to_numpy(zero_copy_only=False)).tolist():
                if number != own[i] and held:
                    yield from answer(number, held, lex, p0)
                    held = []
                number = int(own[i])
                held.append((batch.column(1)[i].as_py(), batch.column(7)[i].as_py()))
        if held:
            yield from answer(number, held, lex, p0)

    def answer(number: int, held: list[tuple[int, bytes]], lex: Lexicon, p0: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = parts_of(lex, limit)
        numbers = np.cumsum(parts > 1) - 1
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        wide_columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        sizes, wide_sizes = [], []
        for _, blob in held:
            (v, group, runs, u, w, flag), keys = _unpacked(blob, 6)
            at, found = 0, []
            for c in (v, u, w):
                n = np.count_nonzero(c > lex.hot)
                found.append(_keys(lex, c, keys[at : at + n]))
                at += n
            v_key, group, v = (np.repeat(x, runs) for x in (found[0], group, v))
            is_wide = parts[v] > 1
            one = np.flatnonzero(~is_wide)
            rooms = Bucket.rooms(v_key[one], group[one], found[1][one])
            for own, column in zip(columns, (*rooms, found[2][one], w[one].astype(np.int32), flag[one].astype(np.uint32)), strict=True):
                own.append(column)
            sizes.append(len(one))
            at = np.flatnonzero(is_wide)
            v, v_key, u_key = v[at], v_key[at], found[1][at]
            home = room_key(v_key, ((mixed(u_key) >> np.uint64(8)) % parts[v].astype(np.uint64)).astype(np.int64))
            home = ((home >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            _, pair = Bucket.rooms(v_key, np.zeros(len(v), np.int64), u_key)
            for own, column in zip(wide_columns, (home, numbers[v].astype(np.int32), pair, found[2][at], w[at].astype(np.int32), flag[at].astype(np.uint32)), strict=True):
                own.append(column)
            wide_sizes.append(len(at))
        held = [flush for flush, _ in held]
        del v, group, runs, u, w, flag, keys, found, rooms, column, v_key, u_key, is_wide, one, at, home, pair
        # Of the tokens of a bucket only one column is held twice at a time.
        flag, w, w_key, r2, r1 = (np.concatenate(columns.pop()) for _ in range(5))
        if len(w):
            rooms = Bucket.of(r1, r2, w_key, w, flag & 1)
            del r1, r2
            a, b = rooms.predictive(p0, strengths=strengths, burn_in=burn_in, samples=samples, rng=np.random.default_rng((seed, number)))
            a, b = a[rooms.of_token], b[rooms.of_token]
            del rooms
            yield from told_back(held, sizes, flag, w, w_key, a, b, lex, p0)
            del a, b
        if not sum(wide_sizes):
            return
        del flag, w, w_key
        flag, w, w_key, pair, word, home = (np.concatenate(wide_columns.pop()) for _ in range(6))
        cell, of_token = grouped(mixed(pair + w_key * ODD[2]))
        cell, of_token = _reordered(cell, of_token, w[cell], pair[cell], home[cell])
        n = np.bincount(of_token, flag & 1, len(cell)).astype(np.int64)
        w, w_key, pair, word, home = (x[cell] for x in (w, w_key, pair, word, home))
        # A flush's tokens by cell: steps from one to the next are small.
        order = np.lexsort((of_token, np.repeat(np.arange(len(held)), wide_sizes)))
        flag, of_token = flag[order], of_token[order]
        starts = np.cumsum(wide_sizes) - wide_sizes
        steps = np.diff(of_token, prepend=0)
        steps[starts[np.array(wide_sizes) > 0]] = of_token[starts[np.array(wide_sizes) > 0]]
        tokens = _packed([np.array(wide_sizes), flag, steps, w], np.concatenate([np.array(held, np.int64).view(np.uint64), w_key[w > lex.hot]]))
        del flag, of_token, order, steps
        yield out(1, key=pa.array([number], pa.int32()), kind=pa.array([TOKENS], pa.int32()), source=pa.array([number], pa.int32()), blob=pa.array([tokens], pa.binary()))
        homes, at = np.unique(home, return_index=True)
        for to, i, j in zip(homes.tolist(), at.tolist(), [*at[1:].tolist(), len(home)], strict=True):
            first = _run_starts(pair[i:j])
            blob = _packed([word[i:j][first], np.diff(np.append(first, j - i)), w[i:j], n[i:j]], np.concatenate([pair[i:j][first], w_key[i:j][w[i:j] > lex.hot]]))
            yield out(1, key=pa.array([to], pa.int32()), kind=pa.array([CELLS], pa.int32()), source=pa.array([number], pa.int32()), blob=pa.array([blob], pa.binary()))

    def told_back(held: list[int], sizes: list[int], flag: np.ndarray, w: np.ndarray, w_key: np.ndarray, a: np.ndarray, b: np.ndarray, lex: Lexicon, p0: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What a bucket tells each flush: sums over hot tokens of each text, other tokens one by one."""
        is_hot = w < lex.hot
        logs = np.log10(a + b * p0[w])
        replies = []
        ends = np.cumsum(sizes)
        for end, size in zip(ends.tolist(), sizes, strict=True):
            part = slice(end - size, end)
            idx, which = grouped((flag[part] >> 1)[is_hot[part]])
            told = (flag[part] >> 1)[is_hot[part]][idx]
            sums = np.bincount(which, logs[part][is_hot[part]], len(told))
            replies.append(_packed([told, sums.astype("<f4").view("<u4")], np.zeros(0, np.uint64)))
        yield out(len(held), flush=pa.array(held, pa.int64()), blob=pa.array(replies, pa.binary()))
        cold = np.flatnonzero(~is_hot)
        flush = np.repeat(np.array(held, np.int64), sizes)[cold]
        for i in range(0, len(cold), 100_000):
            at, n = cold[i : i + 100_000], len(cold[i : i + 100_000])
            blob = _packed([flag[at] >> 1, _bits(a[at]), _bits(b[at])], np.concatenate([flush[i : i + n].view(np.uint64), w_key[at]]))
            yield out(1, kind=pa.array([COLD], pa.int32()), blob=pa.array([blob], pa.binary()))

    def answer_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, p0 = shared.value, by_code.value
        for _, rows in _by_key(batches):
            (sizes, flag, steps, w), keys = _unpacked(rows[0][2], 4)
            held, w_key = keys[: len(sizes)].view(np.int64).tolist(), _keys(lex, w, keys[len(sizes) :])
            of_token, starts = np.cumsum(steps), (np.cumsum(sizes) - sizes)[sizes > 0]
            of_token -= np.repeat(of_token[starts] - steps[starts], sizes[sizes > 0])
            told = [_unpacked(blob, 2)[0] for _, _, blob in rows[1:]]
            a, b = (_floats(np.concatenate([x[i] for x in told]))[of_token] for i in range(2))
            yield from told_back(held, sizes.tolist(), flag, w[of_token], w_key[of_token], a, b, lex, p0)

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                (idx, a, b), keys = _unpacked(blob, 3)
                flush, h = (x.view(np.int64) for x in np.split(keys, 2))
                yield pa.RecordBatch.from_arrays([pa.array(flush), pa.array(idx.astype(np.int32)), pa.array(h), *(pa.array(_floats(x).astype(np.float32)) for x in (a, b))], ["flush", "idx", "h", "a", "b"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []
        for batch in batches:
            own = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, own[1:] != own[:-1]))[: len(own)]
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(own)], strict=True):
                if number != own[a] and held:
                    yield gathered(held)
                    held = []
                number = own[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield gathered(held)

    def gathered(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        is_blob = table.column("blob").is_valid()
        texts = table.filter(pa.compute.invert(is_blob)).combine_chunks()
        idx = texts.column("idx").to_numpy()
        sums = np.zeros(int(idx.max(initial=-1)) + 1)
        for blob in table.column("blob").filter(is_blob).to_pylist():
            (at, bits), _ = _unpacked(blob, 2)
            sums[at] += bits.astype("<u4").view("<f4")
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in texts.columns[:6]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sums[idx])], [*info, "model"])

    id_arrow = to_arrow_type(docs.schema[doc_id].dataType)
    info_arrow = zip(info, (pa.int64(), pa.int32(), id_arrow, pa.int64(), pa.int64(), pa.float64()), strict=True)
    found_arrow = [*info_arrow, ("blob", pa.binary()), ("key", pa.int32()), ("kind", pa.int32()), ("source", pa.int32())]
    sent = rows.mapInArrow(send, f"bucket int, {info_type}, blob binary").repartition("bucket").sortWithinPartitions("bucket", "flush", "idx")
    found = stored(sent.mapInArrow(seat_all, found_type))
    freed(spark)
    if len(wide_parts):
        told = found.where(F.col("kind").isin(TOKENS, CELLS))
        answers = wide(told.where(F.col("kind") == CELLS), shared, by_code, parts=wide_parts, homes=buckets, strengths=strengths, burn_in=burn_in, samples=samples, seed=seed)
        more = stored(_delivered(told.where(F.col("kind") == TOKENS), answers).mapInArrow(answer_wide, found_type))
        found = found.unionByName(more)
        freed(spark)
    texts = found.where("kind is null").select(*info, "blob").repartition("flush").sortWithinPartitions("flush").mapInArrow(total, f"{info_type}, model double")
    c = F.coalesce("c", F.lit(0))
    base = F.log10((c + 0.1) / (lex.tokens + 0.1 * (lex.types + 1)))
    p0 = (F.when(c > 0, c - lex.discount).otherwise(0.0) + lex.rest(root)) / (lex.tokens + root)
    cold = found.where(F.col("kind") == COLD).select("blob").mapInArrow(one_by_one, "flush bigint, idx int, h bigint, a float, b float").join(vocab.select("h", F.col("n").alias("c")), "h", "left")
    sums = cold.groupBy("flush", "idx").agg(F.count_if(c > 0).alias("n_cold"), F.sum(base).alias("base_cold"), F.sum(F.log10(F.col("a") + F.col("b") * p0)).alias("model_cold"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    return texts.join(sums, ["flush", "idx"], "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_hot") + zero("n_cold")).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_cold")).alias("base_score"),
        (F.col("model") + zero("model_cold")).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of the model and of the base over all rows."""
    n = F.sum("n_tokens")
    return scored.agg(F.pow(F.lit(10.0), -F.sum("score") / n).alias("model"), F.pow(F.lit(10.0), -F.sum("base_score") / n).alias("base"))
