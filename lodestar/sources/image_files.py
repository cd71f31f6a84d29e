"""A Python data source writer for downloaded images: ``df.write.format("lodestar_images").option("path", ...)``.

Rows are (file, content). Each task writes its files into a staging folder of its own below ``path``; the driver
moves them into place when all tasks have succeeded, and removes the staging folder of a job that failed, so a
failed or repeated task leaves no file. A file that is already there is never replaced: the new one is skipped.
The driver handles names only, those of one task's folder at a time. Rows of one name meet in one task.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row


def _store(path: str):  # noqa: ANN202
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ImageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestar_images"

    def schema(self) -> str:
        return "file string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return ImageWriter(self.options)


@dataclass
class Written(WriterCommitMessage):
    """What a task staged: its folder, if it has files."""

    folder: str | None


class ImageWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from pyarrow import fs

        store, root = _store(self.staging)
        place = _store(self.path)[1]
        mine = f"{root}/{uuid.uuid4().hex}"  # a task that runs twice writes to two folders; one of them counts
        names: set[str] = set()
        for row in iterator:
            name = row["file"]
            if not name or posixpath.basename(name) != name or name.startswith((".", "_")):
                raise ValueError(f"no file name: {name!r}")
            if name in names or store.get_file_info(f"{place}/{name}").type != fs.FileType.NotFound:
                continue
            if not names:
                store.create_dir(mine, recursive=True)
            with store.open_output_stream(f"{mine}/{name}") as f:
                f.write(row["content"] or b"")
            names.add(name)
        return Written(mine if names else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)

        def settle(name: str, staged: str) -> None:
            if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:  # another job may have been faster
                store.move(staged, f"{root}/{name}")

        with ThreadPoolExecutor(8) as pool:
            for m in messages:
                if isinstance(m, Written) and m.folder:
                    found = store.get_file_info(fs.FileSelector(m.folder))
                    list(pool.map(settle, (f.base_name for f in found), (f.path for f in found), chunksize=1))
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow import fs

        store, root = _store(self.staging)
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageFiles)


def _tasks(spark: SparkSession) -> int:
    """Small tables of many images come in few partitions: a number that a plan is dealt to."""
    return 4 * spark.sparkContext.defaultParallelism


def write(plan: DataFrame, path: str) -> None:
    """Write what a download plan (file, content, skip) does not skip."""
    spark = plan.sparkSession
    register(spark)
    rows = plan.where("skip is null").select("file", "content").repartition(_tasks(spark), "file")
    rows.write.format("lodestar_images").option("path", path).mode("append").save()


def written(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the files in place."""
    from pyspark.sql import functions as F

    found = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def in_place(plan: DataFrame, path: str) -> DataFrame:
    """(file, content) of those files of a plan that are in place: looked up by tasks, without a list of the folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        made, held = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with store.open_input_file(f"{root}/{name}") as f:
                        made.append((name, f.read()))
                except FileNotFoundError:
                    continue
                held += len(made[-1][1])
                if held > 8 << 20 or len(made) == 10_000:
                    yield _named(made)
                    made, held = [], 0
        if made:
            yield _named(made)

    names = plan.select("file").where("file is not null").repartition(_tasks(plan.sparkSession), "file").distinct()
    return names.mapInArrow(work, "file string, content binary")


def _named(made: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n for n, _ in made], pa.string()), pa.array([c for _, c in made], pa.binary())], ["file", "content"])
