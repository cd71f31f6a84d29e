"""Watches over streams: each micro-batch writes what is new, then records what it wrote."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators import relation, state
from lodestar.storage import Conflict, Snapshot, StateTable

STATE = "watch string, url string, first_seen bigint"


class WatchState:
    """The seen-set of a folder, in versions of a state table: what two runs of one watch saw is never lost."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table = StateTable(spark, path, STATE)

    def read(self) -> DataFrame:
        return self.table.read()

    def last(self) -> int:
        return self.table.last()

    def clear(self, watch: str | None = None) -> None:
        """Forget one watch, or all, in a new version."""
        self.table.update(lambda seen: seen.rows.where(F.col("watch") != watch) if watch else seen.rows.limit(0))

    def save(self, seen: DataFrame, version: int, **facts: object) -> None:
        """Commit the version after ``version - 1``; a rival that did so first makes this a ``Conflict``."""
        self.table.commit(state.evict_seen(seen).select("watch", "url", F.col("first_seen").cast("bigint")), version - 1, **facts)

    def unseen(self, rows: DataFrame, watch: str) -> tuple[DataFrame, Snapshot]:
        """The rows that the watch has not seen, and the version that says so: what is recorded goes on top of it."""
        found = self.table.snapshot()
        return state.filter_new(rows, found.rows.where(F.col("watch") == watch)), found


def run_batch(rows: DataFrame, store: WatchState, watch: str, out: str, version: int, *, limit: int | None = None, sort: str | None = None, now: int | None = None, attempts: int = 10) -> None:
    """Filter, combine, write, record: rows that a limit cut stay unseen. A batch that runs again after a
    failure replaces its own output, and so does one that a rival run of the watch overtook."""
    done = f"{watch} {out}"
    for _ in range(attempts):
        unseen, found = store.unseen(rows, watch)
        if version <= found.facts.get(done, -1):
            return
        new = relation.combine(unseen, sort=sort, limit=limit)
        new.write.mode("overwrite").parquet(f"{out}/batch={version}")
        written = rows.sparkSession.read.schema(new.schema).parquet(f"{out}/batch={version}")
        seen = state.record(found.rows, written, watch, int(time.time()) if now is None else now)
        try:
            store.save(seen, found.version + 1, **{done: version})
        except Conflict:
            continue
        return
    raise Conflict(f"{watch}: overtaken {attempts} times")


def start(stream: DataFrame, store: WatchState, watch: str, out: str, checkpoint: str, **options: object) -> StreamingQuery:
    """Run a watch over a stream of result rows, until what there is has been read."""

    def each(batch: DataFrame, number: int) -> None:
        run_batch(batch, store, watch, out, number, **options)  # type: ignore[arg-type]

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_new(stream: DataFrame, deal: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(deal).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
