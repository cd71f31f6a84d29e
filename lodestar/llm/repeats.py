"""Exact removal of repeated byte strings over a corpus.

Removes each byte covered by a string of LENGTH bytes that also starts earlier: in a document with a
smaller id, or earlier in the same one.

1. Every window of LENGTH bytes has one anchor, the GRAM-byte string in it whose hash is least (the
   leftmost of equals), so equal windows have equal anchors at equal places. A text yields one row
   for each anchor: the hash of its gram, the hash of all bytes a window around it can reach (its
   context), its place, and the range of windows that it serves. Rows alike within a task are
   decided there, so hot passages shrink before the shuffle. Of rows of one gram and context, all
   but the earliest repeat it: their windows go.
2. Where a gram has several contexts, the bytes of the windows of the earliest rows (a piece, at
   most 2 * LENGTH - GRAM bytes) go to the task of their gram. There pieces alike as a whole are
   decided, and windows that share too little with any other piece are left out: a window reaches at
   least half of its other bytes to the left or to the right of the gram, so equal windows share
   these too (by a 64-bit hash), and half of what then remains. The suffixes of what is left, with
   one symbol for the shared bytes, are ordered by column-wise construction: each round inserts one
   symbol of every piece into the collection's Burrows-Wheeler transform and updates the common
   prefixes (``suffixes``). Pieces are bounded, so the rounds are; bundles of pieces stream from the
   sorted shuffle files. Neighbours whose common prefix is a whole window are equal, and the earliest
   of them stays.
3. Ranges of removed windows are joined to the texts, which are cut.

A gram with more than ``most`` pieces is split in the same way, as often as needed, by shuffles.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; matches never cross
documents. Rows with a null id come first in order, with those of the least 64-bit id. Rows of the
same id are ordered by a 64-bit hash of their text; rows alike in id and text are one document, each
with its result. Long texts are handled whole, in segments that overlap. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import dropped, freed, small_batches, stored, text_bytes

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # bytes that a window can hold before its anchor's gram
SEGMENT = 1 << 20  # windows of a text looked at together; places among them take 24 bits of a key
BUNDLE = 1 << 19  # bytes of pieces whose suffixes are ordered together (one group is never cut)
MOST = 20_000  # pieces of one group
LEVELS = 2  # halvings of what a window does not share, before suffixes are ordered
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: A place in a document: 32 bits of the position, and 7 each for how far before it the first and
#: the last window it serves begin.
AT_BITS, SPAN_BITS = 32, 7

@lru_cache(4)
def _powers(bits: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Hashes:
    """Hashes of any range of an array of bytes, from one running sum."""

    def __init__(self, data: np.ndarray, base: int):
        bits = max(12, int(len(data) + 1).bit_length())
        up, self.down = _powers(bits, base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(keys)] = keys
    table = full.reshape(rows, width)
    front = np.minimum.accumulate(table, axis=1).reshape(-1)
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], front[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gram hash, context hash, row, place in the row, and first and last window (as places in the
    row) of each anchor of many texts."""
    none = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    n = len(data) - LENGTH + 1
    if n < 1:
        return none
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:n] == row[LENGTH - 1 :]
    hashes = Hashes(data, BASES[0])
    at = np.arange(len(data) - GRAM + 1)
    gram = hashes.of(at, at + GRAM)
    place = np.empty(n, np.int64)
    low = np.uint64((1 << 24) - 1)
    for a in range(0, n, SEGMENT):
        m = min(SEGMENT, n - a)
        keys = gram[a : a + m + REACH] & ~low | np.arange(m + REACH, dtype=np.uint64)
        place[a : a + m] = (_least(keys, REACH + 1) & low).astype(np.int64) + a
    window = np.flatnonzero(inside)
    if not len(window):
        return none
    place = place[window]
    new = np.append(True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    at, lo, hi = place[first], window[first], window[last]
    own = row[at]
    begin, end = np.maximum(offsets[own], at - REACH), np.minimum(offsets[own + 1], at + LENGTH)
    context = hashes.of(begin, end) ^ mixed((at - begin).astype(np.uint64) * np.uint64(1 << 20) + (end - at).astype(np.uint64))
    base = offsets[own]
    return gram[at], context, own, at - base, lo - base, hi - base


def long_anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """``anchors`` of one text, in segments."""
    parts = []
    for s in range(0, len(data) - LENGTH + 1, SEGMENT):
        e = min(s + SEGMENT, len(data) - LENGTH + 1)
        a, b = max(0, s - REACH), min(len(data), e + LENGTH - 1 + REACH)
        gram, context, own, at, lo, hi = anchors(data[a:b], np.array([0, b - a]))
        at, lo, hi = at + a, np.maximum(lo + a, s), np.minimum(hi + a, e - 1)
        keep = lo <= hi
        parts.append([x[keep] for x in (gram, context, own, at, lo, hi)])
    gram, context, own, at, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    # An anchor that serves windows on both sides of a border is one.
    first = np.append(True, at[1:] != at[:-1])
    last = np.append(first[1:], True)
    return gram[first], context[first], own[first], at[first], lo[first], hi[last]


def pack(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (at << SPAN_BITS | at - lo) << SPAN_BITS | at - hi


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, first and last window."""
    at = packed >> 2 * SPAN_BITS
    return at, at - (packed >> SPAN_BITS & 127), at - (packed & 127)


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc and th stand for a document: its id in order, and a hash of its text and of whether the id is null."""
    own = F.coalesce(F.col(text), F.lit(""))
    order = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63)))
    return docs.select(F.col(doc_id).alias("doc_id"), order.alias("doc"), F.xxhash64(F.col(doc_id).isNull(), own).alias("th"), own.alias("_text"))


def found_anchors(rows: DataFrame) -> DataFrame:
    """(gram, context, doc, th, packed), without those decided in their task: these have a null context
    and a key of their own."""

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        data, offsets = text_bytes(batch.column(2))
        gram, context, own, at, lo, hi = long_anchors(data) if batch.num_rows == 1 and len(data) >= LENGTH else anchors(data, offsets)
        return gram, context, batch.column(0).to_numpy()[own], batch.column(1).to_numpy()[own], pack(at, lo, hi)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in small_batches(batches, "_text", 16 << 20):
            parts = [of(batch) for batch in small_batches(iter([whole]), "_text", SEGMENT)]
            gram, context, doc, th, packed = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((packed, th, doc, context, gram))
            gram, context, doc, th, packed = gram[order], context[order], doc[order], th[order], packed[order]
            again = _not_first((gram, context), (doc, th, packed))
            key = np.where(again, mixed(th.view(np.uint64) ^ mixed(packed.astype(np.uint64))), gram)
            for i in range(0, len(gram), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[part].view(np.int64), pa.int64()),
                        pa.array(context[part].view(np.int64), pa.int64(), mask=again[part]),
                        pa.array(doc[part], pa.int64()),
                        pa.array(th[part], pa.int64()),
                        pa.array(packed[part], pa.int64()),
                    ],
                    ["gram", "context", "doc", "th", "packed"],
                )

    return rows.select("doc", "th", "_text").mapInArrow(work, "gram bigint, context bigint, doc bigint, th bigint, packed bigint")


def _not_first(keys: tuple[np.ndarray, ...], where: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of sorted rows, those whose key an earlier row has, unless that is the same place (a row given twice)."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return np.any([w != w[first] for w in where], axis=0)


PIECES = "gram bigint, doc bigint, th bigint, first bigint, before int, after int, piece binary"


def repeated(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", most: int = MOST) -> DataFrame:
    """(doc, th, packed): ranges of windows that start earlier too."""
    spark = docs.sparkSession
    rows = _rows(docs, text, doc_id)
    # By gram and context: a gram that very many contexts share is no hot key here.
    order = Window.partitionBy("gram", "context").orderBy("doc", "th", "packed")
    place = F.struct("doc", "th", "packed")
    seen = found_anchors(rows).repartition("gram", "context").select("gram", "doc", "th", "packed", (F.col("context").isNull() | (F.first(place).over(order) != place)).alias("again"), F.row_number().over(order).alias("n"))
    # Rows given twice are one.
    seen = stored(seen.where("again or n = 1").select(F.when(~F.col("again"), F.col("gram")).alias("gram"), "doc", "th", "packed"))
    freed(spark)
    earliest = seen.where("gram is not null")
    several = earliest.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    # A shuffle join, so that the planner may split a hot gram.
    near = stored(earliest.join(several.hint("merge"), "gram").select("gram", "doc", "th", "packed", (F.col("n") > most).alias("hot")))
    freed(spark)
    anchors_of = near.groupBy("doc", "th").agg(F.collect_list(F.struct("gram", "packed", "hot")).alias("anchors"))
    met = rows.select("doc", "th", "_text").join(anchors_of, ["doc", "th"]).select("doc", "th", "_text", "anchors")
    pieces = met.mapInArrow(_cut, PIECES + ", hot boolean")
    if near.where("hot").isEmpty():
        late = [stored(_compared(pieces.drop("hot")))]
    else:
        pieces = stored(pieces)
        late = [stored(_compared(pieces.where("not hot").drop("hot")))]
        late += _split_hot(pieces.where("hot").drop("hot"), most)
        dropped(pieces)
    dropped(near)
    freed(spark)
    out = seen.where("gram is null").select("doc", "th", "packed")
    for part in late:
        out = out.unionByName(part)
    return out


def _compared(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare, "doc bigint, th bigint, packed bigint")


def _split_hot(pieces: DataFrame, most: int) -> list[DataFrame]:
    """Groups over ``most`` pieces, by half of the bytes that their windows do not share yet, until
    groups are small or their windows are equal as a whole."""
    late = []
    core = GRAM
    while True:
        pieces = stored(pieces.mapInArrow(_halves(core), PIECES))
        core = core + -(-(LENGTH - core) // 2)
        if core >= LENGTH:
            break
        # Counts are combined in each task; the join may be split by the planner.
        sizes = pieces.groupBy("gram").agg(F.count("*").alias("_n"))
        marked = stored(pieces.join(sizes.where("_n > 1").hint("merge"), "gram"))
        late.append(stored(_compared(marked.where(F.col("_n") <= most).drop("_n"))))
        pieces = marked.where(F.col("_n") > most).drop("_n")
        if pieces.isEmpty():
            return late
    # One window a row, and all of a group are equal.
    place = F.struct("doc", "th", "first")
    least = pieces.groupBy("gram", "piece").agg(F.min(place).alias("least"))
    rest = pieces.join(least.hint("merge"), ["gram", "piece"]).where(place != F.col("least"))
    late.append(stored(rest.select("doc", "th", F.shiftleft("first", 2 * SPAN_BITS).alias("packed"))))
    return late


def _batches(columns: list[pa.Array], names: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    for i in range(0, whole.num_rows, rows):
        yield whole.slice(i, rows)


def _spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """data[start:start + size] for many ranges."""
    ends = np.cumsum(size)
    at = np.arange(size.sum()) - np.repeat(ends - size, size) + np.repeat(start, size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[at])])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the windows that each anchor serves."""
    for batch in small_batches(batches, "_text", 1 << 20):
        data, offsets = text_bytes(batch.column(2))
        lists = batch.column(3)
        owners = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        anchor = lists.flatten()
        for i in range(0, len(owners), 20_000):
            owner, part = owners[i : i + 20_000], anchor.slice(i, 20_000)
            gram, packed, hot = (part.field(k) for k in ("gram", "packed", "hot"))
            at, lo, hi = unpack(packed.to_numpy())
            doc, th = (batch.column(k).to_numpy()[owner] for k in (0, 1))
            piece = _spans(data, lo + offsets[owner], hi + LENGTH - lo)
            before = at - lo
            after = hi + LENGTH - at - GRAM
            columns = [gram, pa.array(doc), pa.array(th), pa.array(lo), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), piece, hot]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "doc", "th", "first", "before", "after", "piece", "hot"])


def halves(core: int, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, begin: np.ndarray, base: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, ...]:
    """Of windows lo..hi that share ``core`` bytes from ``begin``, those that reach more bytes to the
    left and those that reach more to the right: row, key of the bytes that they share now, windows
    and where the shared bytes begin."""
    half = -(-(LENGTH - core) // 2)
    parts = []
    for side in (0, 1):
        a, b = (lo, np.minimum(hi, begin - half)) if side == 0 else (np.maximum(lo, begin - half + 1), hi)
        row = np.flatnonzero(a <= b)
        at = begin[row] - half * (side == 0)
        found = hashes.of(base[row] + at, base[row] + at + core + half)
        parts.append((row, mixed(found ^ mixed(key[row] + np.uint64(side))), a[row], b[row], at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _halves(core: int):
    """``halves`` of pieces, as pieces."""
    half = -(-(LENGTH - core) // 2)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "piece", 1 << 20):
            data, offsets = text_bytes(batch.column(6), pa.large_binary())
            gram, doc, th, first = (batch.column(i).to_numpy() for i in range(4))
            begin = batch.column(4).to_numpy().astype(np.int64)
            row, key, lo, hi, at = halves(core, gram.view(np.uint64), np.zeros_like(begin), np.diff(offsets) - LENGTH, begin, offsets[:-1], Hashes(data, BASES[0]))
            piece = _spans(data, offsets[row] + lo, hi - lo + LENGTH)
            after = hi + LENGTH - at - core - half
            columns = [key.view(np.int64), doc[row], th[row], first[row] + lo, (at - lo).astype(np.int32), after.astype(np.int32)]
            yield from _batches([*map(pa.array, columns), piece], ["gram", "doc", "th", "first", "before", "after", "piece"], 20_000)

    return work


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by group, the windows that start earlier in another piece of the same group.
    Bundles of whole groups are looked at together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for batch in small_batches(iter([whole]), "piece", BUNDLE // 4):
            if size > BUNDLE:
                gram = batch.column(0).to_numpy()
                cut = int(np.searchsorted(gram != held[-1].column(0)[-1].as_py(), True))
                if cut < len(gram):
                    yield from _late(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.column(6).nbytes
    if held:
        yield from _late(pa.Table.from_batches(held))


def _late(table: pa.Table) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    gram, doc, th, first, begin = (table.column(i).to_numpy() for i in range(5))
    pieces = table.column(6).combine_chunks()
    data, offsets = text_bytes(pieces, pa.large_binary())
    last = np.diff(offsets) - LENGTH
    # Pieces that are alike as a whole: all but the earliest go.
    alike = pieces.dictionary_encode().indices.to_numpy()
    sort = np.lexsort((first, th, doc, alike, gram))
    again = np.zeros(len(gram), bool)
    again[sort] = _not_first((gram[sort], alike[sort]), (doc[sort], th[sort], first[sort]))
    gone = np.flatnonzero(again)
    yield from _ranges(doc[gone], th[gone], first[gone], first[gone] + last[gone])
    # Windows that share more than half of their other bytes with those of another piece.
    row = np.flatnonzero(~again)
    core, key, lo, hi, begin = GRAM, gram[row].view(np.uint64), np.zeros(len(row), np.int64), last[row], begin[row].astype(np.int64)
    hashes = Hashes(data, BASES[0])
    for _ in range(LEVELS):
        at, key, lo, hi, begin = halves(core, key, lo, hi, begin, offsets[row], hashes)
        core += -(-(LENGTH - core) // 2)
        _, same, n = np.unique(key, return_inverse=True, return_counts=True)
        met = n[same] > 1
        row, key, lo, hi, begin = row[at[met]], key[met], lo[met], hi[met], begin[met]
    if not len(row):
        return
    # Their bytes, with one symbol for the shared ones.
    size = hi - lo + LENGTH
    ends = np.cumsum(size)
    inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
    symbols = data[inside + np.repeat(offsets[row] + lo, size)]
    shared = inside - np.repeat(begin - lo, size)
    if symbols.max() > 253:
        symbols = symbols.astype(np.uint16)
    symbols[shared == 0] = 254 if symbols.dtype == np.uint8 else 256
    symbols = symbols[(shared <= 0) | (shared >= core)]
    size = size - core + 1
    owner, start, common = suffixes(symbols, np.append(0, np.cumsum(size)), LENGTH - core + 1)
    # Neighbours with the common prefix of a whole window begin with the same window.
    group = np.cumsum(common < LENGTH - core + 1)
    window = np.flatnonzero(start <= (hi - lo)[owner])
    group, own, at = group[window], owner[window], start[window]
    many = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
    group, own, at = group[many], own[many], at[many]
    place = first[row[own]] + lo[own] + at
    d, t, k = doc[row[own]], th[row[own]], key[own]
    sort = np.lexsort((place, t, d, k, group))
    late = sort[_not_first((group[sort], k[sort]), (d[sort], t[sort], place[sort]))]
    # Neighbouring windows of one piece make one range.
    late = late[np.lexsort((place[late], own[late]))]
    own, place, d, t = own[late], place[late], d[late], t[late]
    new = np.append(True, (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1))[: len(own)]
    yield from _ranges(d[new], t[new], place[new], place[np.append(new[1:], True)[: len(own)]])


def _ranges(doc: np.ndarray, th: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from _batches([pa.array(doc), pa.array(th), pa.array(pack(hi, lo, hi))], ["doc", "th", "packed"], 100_000)


def suffixes(data: np.ndarray, offsets: np.ndarray, cap: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of a collection in order: piece, start in the piece, and common prefix with the
    one before (up to ``cap``). The Burrows-Wheeler transform and the common prefixes are built column
    by column: each round inserts one symbol of every piece, from its end to its start.

    A round sorts the transform's symbols stably, which says where each symbol's suffix belongs (the
    map from last to first column). The common prefix of two neighbours that begin with the same
    symbol is one more than the least common prefix between the places of those symbols; only new
    suffixes and those right after them change. Pieces end in marks of their own, so empty suffixes
    (and suffixes that end) share nothing.
    """
    sizes = np.diff(offsets)
    m = len(sizes)
    end = int(data.max(initial=0)) + 1
    data = data if end < 256 else data.astype(np.uint16)
    bwt = np.where(sizes > 0, data[np.maximum(offsets[1:] - 1, 0)], end).astype(data.dtype)
    common = np.zeros(m, np.uint8)
    place = np.arange(m)
    who = np.zeros(m, np.int64)
    for r in range(1, int(sizes.max(initial=0)) + 1):
        alive = np.flatnonzero(sizes >= r)
        order = np.argsort(bwt, kind="stable")
        newest = np.zeros(len(bwt), bool)
        newest[place[alive]] = True
        who = np.empty(len(bwt), np.int64)
        who[place[alive]] = alive
        fresh = np.flatnonzero(newest[order])
        new, piece = fresh + m, who[order[fresh]]
        size = len(bwt) + len(alive)
        changed = np.zeros(size + 1, bool)
        changed[new] = changed[new + 1] = True
        at = np.flatnonzero(changed[:size])
        k = at - m
        here, left = order[k], order[np.maximum(k - 1, 0)]
        same = np.flatnonzero((k > 0) & (bwt[here] == bwt[left]))
        value = np.zeros(len(at), np.uint8)
        value[same] = np.minimum(_least_between(common, left[same] + 1, here[same]), cap - 1) + 1
        old = np.ones(size, bool)
        old[new] = False
        grown = np.empty(size, bwt.dtype)
        grown[old] = bwt
        before = offsets[piece + 1] - r - 1
        grown[new] = np.where(sizes[piece] > r, data[np.maximum(before, 0)], end)
        merged = np.empty(size, np.uint8)
        merged[old] = common
        merged[at] = value
        bwt, common = grown, merged
        place[piece] = new
    # Walk all pieces from their ends to their starts through the finished transform.
    order = np.argsort(bwt, kind="stable")
    first = np.empty(len(bwt), np.int64)
    first[order] = np.arange(len(bwt)) + m
    owner, start = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int32)
    alive, at = np.arange(m), np.arange(m)
    owner[at], start[at] = alive, sizes
    for r in range(1, int(sizes.max(initial=0)) + 1):
        more = sizes[alive] >= r
        alive, at = alive[more], first[at[more]]
        owner[at], start[at] = alive, sizes[alive] - r
    return owner, start, common


def _least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo..hi] for many ranges, from minima of runs of powers of two."""
    level = np.frexp(hi - lo + 1)[1] - 1
    out = np.empty(len(lo), values.dtype)
    run = values
    for j in range(int(level.max(initial=-1)) + 1):
        if j:
            run = np.minimum(run[: -(1 << j - 1)], run[1 << j - 1 :])
        own = np.flatnonzero(level == j)
        if len(own):
            out[own] = np.minimum(run[lo[own]], run[hi[own] - (1 << j) + 1])
    return out

def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ranges of windows cover."""
    order = np.argsort(lo)
    lo, end = lo[order], np.maximum.accumulate(hi[order] + LENGTH)
    new = np.append(True, lo[1:] > end[:-1])
    return lo[new], end[np.append(new[1:], True)]


def remove(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", with_text: bool = False, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``, and with
    ``with_text`` the bytes that are left in ``kept``."""
    ranges = repeated(docs, text=text, doc_id=doc_id, most=most).groupBy("doc", "th").agg(F.collect_list("packed").alias("ranges"))
    rows = _rows(docs, text, doc_id).join(ranges, ["doc", "th"], "left").select("doc_id", "_text", "ranges")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            data, offsets = text_bytes(batch.column(1))
            lists = batch.column(2)
            removed, spans, digests, kept = [], [], [], []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                starts = ends = np.zeros(0, np.int64)
                if lists[i].is_valid:
                    _, lo, hi = unpack(lists[i].values.to_numpy(zero_copy_only=False))
                    starts, ends = _merged(lo, hi)
                removed.append(int((ends - starts).sum()))
                spans.append(len(starts))
                digest, left = hashlib.sha256(), []
                for a, b in zip(np.append(0, ends), np.append(starts, len(own)), strict=True):
                    digest.update(own[a:b])
                    if with_text:
                        left.append(own[a:b].tobytes())
                digests.append(digest.hexdigest())
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
                + [pa.array(kept, pa.binary())] * with_text,
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text,
            )

    return rows.mapInArrow(work, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)
