"""Ranks within groups, ties included, of rows that no single task could hold.

Secondary sort: rows are dealt out by ranges of (group, pair, order) and sorted within their task, so
a hot group, and a hot pair in it, is spread over as many tasks as its rows need; rows that are equal
in every key are spread by a salt. Each task reads its sorted rows as a stream and keeps only counters
of the current group and pair. It gives every line a place as if its task held the whole group, and a
short summary of each group it saw. A second pass adds up the summaries of the tasks before and so
repairs the groups (and pairs) that span tasks.

Defined results: equal rows are ranked separately, in any order among themselves. Nulls are values of
their own in groups, come first in pairs unless said otherwise, and last in the order within a pair.
An empty table gives no rows. Other columns are not carried; names of the key columns may be any.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import stored, widened

#: Rows equal in all keys are dealt out by this many salts.
SALTS = 1024


def _changes(batch: pa.RecordBatch, columns: Sequence[int]) -> np.ndarray:
    """Whether each row but the first differs from the one before in a column; nulls are equal."""
    out = np.zeros(batch.num_rows - 1, bool)
    for i in columns:
        col = batch.column(i)
        a, b = col.slice(0, len(col) - 1), col.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(col.type):  # NaN is one value
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        out |= differ.to_numpy(zero_copy_only=False)
        if col.null_count:
            out |= pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return out


def _machine(n_group: int, n_pair: int, most: int):
    """A task's pass over its sorted rows: lines with their place in the task, then summaries of pairs.

    A row is (keys, _task, _run, _pos, _before, _n, _lines): ``_run`` numbers the task's pairs. Lines
    have ``_pos``; summaries have ``_before`` (lines of the group in earlier pairs), ``_n`` (lines of
    the pair) and, for a group's last pair in the task, ``_lines`` (all of its lines).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last = None  # the row before, as a batch of one row
        run = -1
        pos = before = count = 0  # lines of the group so far, those of earlier pairs, those of the current pair

        def out(keys: pa.RecordBatch, runs, pos=None, before=None, n=None, lines=None) -> pa.RecordBatch:
            rows = keys.num_rows
            made = [pa.array(x, pa.int64()) if x is not None else pa.nulls(rows, pa.int64()) for x in (pos, before, n, lines)]
            return pa.RecordBatch.from_arrays(
                [*keys.columns, pa.array(np.full(rows, task, np.int64)), pa.array(runs, pa.int64()), *made],
                [*keys.schema.names, "_task", "_run", "_pos", "_before", "_n", "_lines"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            with_last = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0] if last is not None else batch
            new_group = _changes(with_last, range(n_group))
            new_pair = new_group | _changes(with_last, range(n_group, n_group + n_pair))
            if last is None:
                new_group, new_pair = (np.concatenate(([True], x)) for x in (new_group, new_pair))
            rows = np.arange(batch.num_rows)
            # Lines of the group before each row, those of earlier pairs, and the pair's number in the task.
            start = np.maximum.accumulate(np.where(new_group, rows, -pos))
            opened = np.flatnonzero(new_pair)
            since = np.maximum.accumulate(np.where(new_pair, rows, -1))
            place = np.where(since < 0, before, (rows - start)[since])
            runs = run + np.cumsum(new_pair)
            near = place < most
            if near.any():
                take = pa.array(near)
                yield out(batch.filter(take), runs[near], pos=(rows - start + 1)[near])
            # Pairs that ended: before each opened row.
            if len(opened):
                ends = opened - 1
                size = np.diff(np.concatenate(([-count], opened)))
                ended_before = np.concatenate(([before], place[opened[:-1]]))
                is_last = new_group[opened]
                lines = ended_before + size
                keep = (ended_before < most) | is_last
                if last is None:
                    keep[0] = False
                at = np.flatnonzero(keep)
                if len(at):
                    keys = with_last.take(pa.array(ends[at] + (last is not None)))
                    yield out(keys, runs[opened[at]] - 1, before=ended_before[at], n=size[at], lines=pa.array(lines[at], mask=~is_last[at]))
                before, count = int(place[-1]), int(batch.num_rows - opened[-1])
            else:
                count += batch.num_rows
            pos = int(rows[-1] - start[-1] + 1)
            run = int(runs[-1])
            last = batch.slice(batch.num_rows - 1)
        if last is not None:
            yield out(last, [run], before=[before], n=[count], lines=[before + count])

    return work


def ranked(rows: DataFrame, group: Sequence[str], pair: Sequence[tuple[str, bool]], order: Sequence[str], *, most: int) -> DataFrame:
    """The rows of ``rows`` whose place in their group is at most ``most``.

    ``group`` names the group's columns, ``pair`` the columns that decide the place, each with whether
    larger values come first, ``order`` those that order the lines of a pair (ascending). Returns these
    columns with ``pos`` (number of the line in its group, from 1), ``place`` (1 plus the group's lines
    with earlier pairs) and ``tied`` (lines of the group with its pair).
    """
    names = [*group, *(n for n, _ in pair), *order]
    gs = [f"g{i}" for i in range(len(group))]
    ps = [f"p{i}" for i in range(len(pair))]
    keys = [*gs, *ps, *(f"o{i}" for i in range(len(order)))]
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("smallint")
    flat = rows.select(*(F.col(f"`{n}`").alias(k) for n, k in zip(names, keys, strict=True)), salt.alias("_salt"))
    by = [F.col(k).asc_nulls_first() for k in gs]
    by += [F.col(k).desc_nulls_first() if down else F.col(k).asc_nulls_first() for k, (_, down) in zip(ps, pair, strict=True)]
    by += [F.col(k).asc_nulls_last() for k in keys[len(gs) + len(ps) :]]
    dealt = flat.repartitionByRange(*by, F.col("_salt")).sortWithinPartitions(*by).drop("_salt")
    schema = widened(dealt.schema, **dict.fromkeys(("_task", "_run", "_pos", "_before", "_n", "_lines"), "bigint"))
    found = stored(dealt.mapInArrow(_machine(len(gs), len(ps), most), schema))
    # The boundary pass: a few rows of each group from each task that saw it.
    earlier = Window.partitionBy(*gs).orderBy("_task").rangeBetween(Window.unboundedPreceding, -1)
    pairs = found.where("_pos is null").withColumn("_offset", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))
    whole = Window.partitionBy(*gs, *ps)
    pairs = pairs.withColumn("place", F.min(F.col("_offset") + F.col("_before")).over(whole) + 1).withColumn("tied", F.sum("_n").over(whole))
    pairs = pairs.where(F.col("place") <= most).select("_task", "_run", "_offset", "place", "tied")
    lines = found.where("_pos is not null").select("_task", "_run", "_pos", *keys).join(pairs, ["_task", "_run"])
    return lines.select(*(F.col(k).alias(n) for n, k in zip(names, keys, strict=True)), (F.col("_pos") + F.col("_offset")).alias("pos"), "place", "tied")
