"""Each URL of a stream once: a value state for every watch and URL, kept in RocksDB and in the checkpoint.

The state is part of the query's checkpoint, so what a batch emitted and what it remembers are committed
together: a stream that is stopped, or that fails within a batch, goes on without losing or repeating a URL.
State is spread over tasks by its key and never read as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSight(StatefulProcessor):
    """Passes on the row of least ``_seq`` of a key that was never seen."""

    def __init__(self, columns: list[str], ttl_ms: int | None = None):
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("first", "seq bigint", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        if self.seen.exists():
            for _ in rows:
                pass
            return
        first = min(rows, key=lambda r: (r["_seq"] is None, r["_seq"] or 0))
        self.seen.update((first["_seq"],))
        yield Row(**{c: first[c] for c in self.columns})

    def close(self) -> None:
        pass


def first_of(stream: DataFrame, keys: list[str], ttl_ms: int | None = None) -> DataFrame:
    """The first row of each key of a stream with ``_seq``. With ``ttl_ms`` a key is forgotten that long after it
    was first seen, which bounds the state by age."""
    schema = StructType(list(stream.schema.fields))
    return stream.groupBy(*(F.col(k) for k in keys)).transformWithState(FirstSight(stream.columns, ttl_ms), schema, "append", "processingTime" if ttl_ms else "none")


def start(stream: DataFrame, keys: list[str], out: str, checkpoint: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Write the first row of each key as Parquet until what there is has been read."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return first_of(stream, keys, ttl_ms).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """What the stream wrote and committed."""
    return spark.read.schema(schema).parquet(out)
