"""What the operators share: shared storage, Arrow text access and small numpy helpers."""

from __future__ import annotations

import gc
import os
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOCAL_CHECKPOINTS = "/tmp/checkpoints/lodestar"
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a session in local mode that has none gets a folder of its own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = LOCAL_CHECKPOINTS
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/lodestar/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the table behind a DataFrame made by ``stored``; only for tables nothing lazy still needs."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(os.path.dirname(f))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Let the driver's context cleaner remove shuffle files that no live plan refers to."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def text_bytes(column: pa.Array, kind: pa.DataType | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(kind) if kind else column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one hold about ``most`` bytes (one text is never cut)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        _, offsets = text_bytes(batch.column(i))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def widened(schema: StructType, **added: str) -> StructType:
    """A copy of ``schema`` with more columns."""
    out = StructType(list(schema.fields))
    for name, kind in added.items():
        out = out.add(name, StructType.fromDDL(f"x {kind}")[0].dataType)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, in either case."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of true values."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]
