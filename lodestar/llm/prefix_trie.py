"""The prefix trie of conversations: a node for every distinct sequence of first turns.

Turns are dictionary-encoded: each distinct (role, text) has one integer. Conversations of the same
whole sequence are one class with a weight, so exact copies cost one row. The trie is built by
most-significant-digit radix partitioning: a bucket holds the classes that share their first d turns,
and is dealt into the buckets of the next turn by one aggregate and one join a round, in which a hot
bucket may be split anywhere. A bucket of at most ``LOCAL`` turns (more at great depth) is finished in one task by a multikey
quicksort whose recursion emits the nodes; a bucket of one class is a chain and is expanded in place.
Sums over subtrees are taken in the task, and for the dealt buckets level by level from the deepest.

Defined results: turns are numbered by turn (null first), then role, then text; null role or text is
empty. Rows whose conversation is null take no part. Repeated rows are turns of their own. An empty
table gives no node. Other columns are ignored. Sequences are compared by 128-bit digests of the turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import stored

#: A bucket of at most this many turns is finished in one task.
LOCAL = 20_000
#: From this depth on a bucket may be larger: what shares so many turns is few long conversations, and each round
#: deals one turn only.
DEEP, DEEP_LOCAL = 32, 1_000_000
#: Turns of a conversation are kept in pieces of this many.
PIECE = 128
#: Bytes of a list of ids that are joined in one piece.
JOINED = 1 << 16

NODE = "depth int, conv bigint, parent bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends binary"
NOTHING = hashlib.sha256(b"").digest()


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, pos, tid, nb) for every turn of a conversation: its number from 1, its code, the bytes of its text.

    Rows are dealt by ranges of conversation and turn, so that a conversation may span tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = rows.repartitionByRange(*by, F.substring("text", 1, 32)).sortWithinPartitions(*by, "text")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    dealt = stored(dealt.select("conv", F.monotonically_increasing_id().alias("at"), digest.alias("digest"), F.octet_length("text").cast("bigint").alias("nb")))
    codes = stored(dealt.select("digest").distinct().select("digest", F.monotonically_increasing_id().alias("tid")))
    task = F.shiftright("at", 33)
    seen = dealt.groupBy("conv", task.alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).select("conv", "task", "base")
    out = dealt.join(codes, "digest").withColumn("task", task).join(seen, ["conv", "task"])
    return stored(out.select("conv", (F.col("at") + F.col("base")).alias("pos"), "tid", "nb"))


def rebuilt(turns: DataFrame, convs: DataFrame, base: Column, head: Column) -> DataFrame:
    """The turns of ``convs`` (conv), each with its first ``head`` turns taken from conversation ``base`` instead.

    ``turns`` is what ``numbered`` returns. If the base has fewer turns, all are taken; if it is absent, none.
    """
    length = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    plan = convs.select("conv", base.alias("base"), head.cast("bigint").alias("head"))
    plan = plan.join(length.select(F.col("conv").alias("base"), "n"), "base", "left")
    plan = stored(plan.select("conv", "base", "head", F.least("head", F.coalesce("n", F.lit(0))).alias("k")))
    own = turns.join(plan.select("conv", "head", "k"), "conv").where("pos > head").select("conv", (F.col("pos") - F.col("head") + F.col("k")).alias("pos"), "tid", "nb")
    taken = plan.where("k > 0").select(F.col("conv").alias("to"), F.col("base").alias("conv"), "k")
    most = plan.agg(F.max("k")).first()[0] or 0
    first = turns.where(F.col("pos") <= most).join(taken, "conv").where("pos <= k").select(F.col("to").alias("conv"), "pos", "tid", "nb")
    return own.unionByName(first)


def _joined(most: int):
    """Sorted (rep, conv) as pieces of about ``most`` bytes of comma-joined ids: (rep, task, piece, joined)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rep, held, size, piece = None, [], 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"rep": [rep], "task": pa.array([task], pa.int32()), "piece": pa.array([piece], pa.int32()), "joined": [",".join(held).encode()]})

        for batch in batches:
            for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != rep or size > most:
                    if held:
                        yield out()
                    piece = piece + 1 if r == rep else 0
                    rep, held, size = r, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield out()

    return work


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, hashed as one text for each class."""
    rep, state = None, None
    for batch in batches:
        done: list[tuple[int, bytes]] = []
        for r, joined in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if state is not None and r == rep:
                state.update(b"," + joined)
            else:
                if state is not None:
                    done.append((rep, state.digest()))
                rep, state = r, hashlib.sha256(joined)
        if done:
            yield pa.RecordBatch.from_pydict({"rep": [x[0] for x in done], "sha": [x[1] for x in done]})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"rep": [rep], "sha": [state.digest()]})


def classes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, w, len, sha) for each distinct sequence: its smallest conversation, how many have it, its length and
    the hash of their ids. The hash runs over all ids of a class in order, so it is fed with joined pieces."""
    seq = F.struct("pos", "tid")
    marks = turns.groupBy("conv").agg(F.count("*").alias("len"), F.bit_xor(F.xxhash64(F.lit(0), seq)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), seq)).alias("y"))
    marks = stored(convs.select("conv").join(marks, "conv", "left").fillna(0))
    found = stored(marks.groupBy("len", "x", "y").agg(F.min("conv").alias("rep"), F.count("*").alias("w")))
    members = marks.join(found.where("w > 1"), ["len", "x", "y"]).select("rep", "conv")
    pieces = members.repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv").mapInArrow(_joined(JOINED), "rep bigint, task int, piece int, joined binary")
    hashes = pieces.repartition("rep").sortWithinPartitions("rep", "task", "piece").mapInArrow(_hashed, "rep bigint, sha binary")
    one = F.unhex(F.sha2(F.col("rep").cast("string").cast("binary"), 256))
    alone = found.where("w = 1").select(F.col("rep").alias("conv"), "w", "len", one.alias("sha"))
    more = found.where("w > 1").join(hashes, "rep").select(F.col("rep").alias("conv"), "w", "len", "sha")
    return stored(alone.unionByName(more))


def _finish(items: list[tuple[int, int, list, list, bytes]], depth: int, parent: int | None, base: int) -> list[list]:
    """The nodes of a bucket: ``items`` are (conv, weight, codes, bytes, hash) with the same first ``depth`` codes,
    of which the first ``base`` are left out.

    Multikey quicksort with a stack of its own: a part is dealt into smaller, equal and larger codes at its depth;
    the equal ones share a node one deeper. Parents come before their children in what is returned.
    """
    nodes: list[list] = []  # depth, conv, parent, n_convs, n_children, n_leaves, saved, ends, index of the parent

    def opened(part: list, at: int, above: int) -> int:
        own = sum(x[1] for x in part)
        cost = part[0][3][at - 1] if at else 0
        nodes.append([base + at, min(x[0] for x in part), nodes[above][1] if above >= 0 else parent, own, 0, 0, (own - 1) * cost, NOTHING, above])
        if above >= 0:
            nodes[above][4] += 1
        return len(nodes) - 1

    stack = [(items, depth - base, opened(items, depth - base, -1), True)]
    while stack:
        part, at, node, fresh = stack.pop()
        if fresh:  # the sequence that ends here; classes are distinct, so there is one at most
            for x in part:
                if len(x[2]) == at:
                    nodes[node][7] = x[4]
            part = [x for x in part if len(x[2]) > at]
        if not part:
            continue
        if len(part) == 1:
            while at < len(part[0][2]):
                at += 1
                node = opened(part, at, node)
            nodes[node][7] = part[0][4]
            continue
        pivot = part[len(part) // 2][2][at]
        less, more = [x for x in part if x[2][at] < pivot], [x for x in part if x[2][at] > pivot]
        same = [x for x in part if x[2][at] == pivot] if less or more else part
        stack += [(p, at, node, False) for p in (less, more) if p]
        stack.append((same, at + 1, opened(same, at + 1, node), True))
    for n in reversed(nodes):
        n[5] = n[5] or 1
        if n[8] >= 0:
            nodes[n[8]][5] += n[5]
            nodes[n[8]][6] += n[6]
    return nodes


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, conv, piece, parent, depth, start, w, sha, tids, nbs), sorted, as nodes; the turns before
    ``start`` are left out."""
    names = NODE.replace(",", "").split()[::2]
    kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
    bucket, items, depth, parent, base = None, [], 0, None, 0
    done: list[list] = []

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([n[i] for n in done], k) for i, k in enumerate(kinds)], names)
        done.clear()
        return made

    for batch in batches:
        for b, conv, _, above, at, start, w, sha, tids, nbs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket:
                if items:
                    done += _finish(items, depth, parent, base)
                bucket, items, depth, parent, base = b, [], at, above, start
            if items and items[-1][0] == conv:
                items[-1][2].extend(tids)
                items[-1][3].extend(nbs)
            else:
                items.append((conv, w, tids or [], nbs or [], sha))
            if len(done) > 50_000:
                yield out()
    if items:
        done += _finish(items, depth, parent, base)
    if done:
        yield out()


def _chains(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """The nodes of buckets of one class: ``rows`` has (conv, parent, depth, w, len, sha)."""
    held = rows.join(pieces, "conv", "left").withColumn("piece", F.coalesce("piece", F.lit(0)))
    sums = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    later = Window.partitionBy("conv").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<bigint>")
    held = held.withColumn("nbs", F.coalesce("nbs", none)).withColumn("after", F.coalesce(F.sum(sums(F.col("nbs"))).over(later), F.lit(0)))
    # Depths of a piece: those of its turns, and the root's with the first piece.
    low = F.greatest(F.col("depth"), F.when(F.col("piece") == 0, 0).otherwise(F.col("piece") * PIECE + 1))
    high = F.least(F.col("len"), (F.col("piece") + 1) * PIECE)
    held = held.withColumn("depth_", F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))))
    at = F.greatest(F.col("depth_") - F.col("piece") * PIECE, F.lit(1)).cast("int")
    saved = F.when(F.col("w") > 1, (F.col("w") - 1) * (F.col("after") + sums(F.slice("nbs", at, F.lit(PIECE))))).otherwise(F.lit(0))
    last = F.col("depth_") == F.col("len")
    return held.select(
        F.col("depth_").alias("depth"),
        "conv",
        F.when(F.col("depth_") == F.col("depth"), F.col("parent")).otherwise(F.col("conv")).alias("parent"),
        F.col("w").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"),
        saved.alias("saved"),
        F.when(last, F.col("sha")).otherwise(F.lit(NOTHING)).alias("ends"),
    )


def build(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of ``convs`` (conv, distinct), whose sequences are ``turns`` (conv, pos from 1, tid, nb).

    Returns (depth, conv, parent, n_convs, n_children, n_leaves, saved, ends): the node's smallest conversation,
    that of its parent, the conversations below, and the SHA-256 digest of the ids of those that end in it.
    """
    turns = stored(turns)
    found = classes(turns, convs)
    mine = turns.join(found.select("conv"), "conv")
    one = F.struct(((F.col("pos") - 1) % PIECE).alias("i"), "tid", "nb")
    pieces = mine.groupBy("conv", F.expr(f"(pos - 1) div {PIECE}").cast("int").alias("piece")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    pieces = stored(pieces.select("conv", "piece", F.col("t.tid").alias("tids"), F.col("t.nb").alias("nbs")))
    first = pieces.where("piece = 0").select("conv", "tids", "nbs")

    root = found.agg(F.min("conv"), F.sum("len"), F.count("*"), F.sum("w"), F.max(F.when(F.col("len") == 0, F.col("sha")))).first()
    if root[0] is None:
        return turns.sparkSession.createDataFrame([], NODE)
    live = found.join(first, "conv", "left").select(F.lit(root[0]).alias("bucket"), F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("depth"), F.lit(root[2]).alias("n"), F.lit(root[1]).alias("size"), "*")
    big = lambda d: (F.col("n") > 1) & (F.col("size") > (LOCAL if d < DEEP else DEEP_LOCAL))
    settled: list[DataFrame] = []  # buckets that are finished without another round
    dealt: list[DataFrame] = []  # (conv, parent, n_convs, cost, ends) of the nodes dealt at each depth
    depth = 0
    while True:
        live = stored(live)
        settled.append(live.where(~big(depth)).drop("tids", "nbs"))
        live = live.where(big(depth))
        if depth == 0:
            dealt.append(live.limit(1).select("bucket", "parent", F.lit(root[3]).alias("n_convs"), F.lit(0).cast("bigint").alias("cost"), F.lit(bytes(root[4] or NOTHING)).alias("ends")))
        if live.isEmpty():
            break
        if depth and depth % PIECE == 0:
            more = pieces.where(F.col("piece") == depth // PIECE).select("conv", "tids", "nbs")
            live = live.drop("tids", "nbs").join(more, "conv", "left")
        live = live.where(F.col("len") > depth).withColumn("tid", F.col("tids")[depth % PIECE])
        kids = live.groupBy("bucket", "tid").agg(
            F.min("conv").alias("child"),
            F.count("*").alias("n"),
            F.sum(F.col("len") - (depth + 1)).alias("size"),
            F.sum("w").alias("n_convs"),
            F.max(F.col("nbs")[depth % PIECE]).alias("cost"),
            F.max(F.when(F.col("len") == depth + 1, F.col("sha"))).alias("ends"),
        )
        kids = stored(kids)
        dealt.append(kids.where(big(depth + 1)).select(F.col("child").alias("bucket"), F.col("bucket").alias("parent"), "n_convs", "cost", "ends"))
        live = live.drop("n", "size", "parent", "depth").join(kids.select("bucket", "tid", "child", "n", "size"), ["bucket", "tid"])
        live = live.select(F.col("child").alias("bucket"), F.col("bucket").alias("parent"), F.lit(depth + 1).alias("depth"), "n", "size", "conv", "w", "len", "sha", "tids", "nbs")
        depth += 1

    rest = settled[0]
    for s in settled[1:]:
        rest = rest.unionByName(s)
    rest = stored(rest)
    chains = _chains(rest.where("n = 1"), pieces)
    start = (F.floor((F.greatest(F.col("depth"), F.lit(1)) - 1) / PIECE) * PIECE).cast("int")
    small = rest.where("n > 1").withColumn("start", start).join(pieces, "conv", "left").withColumn("piece", F.coalesce("piece", F.lit(0)))
    small = small.where(F.col("tids").isNull() | (F.col("piece") * PIECE >= F.col("start"))).select("bucket", "conv", "piece", "parent", "depth", "start", "w", "sha", "tids", "nbs")
    small = small.repartition("bucket").sortWithinPartitions("bucket", "depth", "conv", "piece").mapInArrow(_finished, NODE)
    nodes = stored(chains.unionByName(small))

    # Up from the deepest dealt buckets: what their children's subtrees hold.
    tops = rest.select("depth", F.col("bucket").alias("conv")).distinct()
    tops = stored(nodes.join(tops, ["depth", "conv"]).select("depth", "parent", "n_leaves", "saved"))
    out, below = nodes, None
    for d in range(len(dealt) - 1, -1, -1):
        under = tops.where(F.col("depth") == d + 1).select("parent", "n_leaves", "saved")
        if below is not None:
            under = under.unionByName(below.select("parent", "n_leaves", "saved"))
        under = under.groupBy(F.col("parent").alias("bucket")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("under"))
        level = dealt[d].join(under, "bucket").select(
            F.lit(d).alias("depth"), F.col("bucket").alias("conv"), "parent", "n_convs", "n_children", "n_leaves",
            (F.col("under") + (F.col("n_convs") - 1) * F.col("cost")).alias("saved"), F.coalesce("ends", F.lit(NOTHING)).alias("ends"),
        )
        below = stored(level)
        out = out.unionByName(below)
    return out
