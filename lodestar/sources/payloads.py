"""A Python data source over stored payloads: ``spark.read.format("lodestar")``.

Options: ``path`` (a Parquet table of request_id, engine, status, content_type, body), ``engine``.
Bounds on ``created`` are pushed to the reader, as the news source takes them itself. Files are
read where the executors can: each is one partition.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestar"

    def schema(self) -> str:
        return "request_id bigint, engine string, status int, content_type string, created bigint, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PayloadReader(self.options)


class PayloadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.engine = options["path"], options.get("engine")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        ops = {EqualTo: "=", GreaterThanOrEqual: ">=", LessThan: "<"}
        for f in filters:
            if type(f) in ops and len(f.attribute) == 1 and f.attribute[0] in ("created", "engine"):
                self.tests.append((f.attribute[0], ops[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        return [InputPartition(f.path) for f in found if f.path.endswith(".parquet")]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        test = pc.scalar(True)
        for name, op, value in self.tests + ([("engine", "=", self.engine)] if self.engine else []):
            f = pc.field(name)
            test = test & (f == value if op == "=" else f >= value if op == ">=" else f < value)
        columns = ["request_id", "engine", "status", "content_type", "created", "body"]
        yield from ds.dataset(partition.value, format="parquet").to_batches(columns=columns, filter=test)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PayloadSource)
