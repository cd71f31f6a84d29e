"""Folders that all executors share, and state tables whose versions are committed by compare-and-swap."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from lodestar.errors import ConfigError

LOCAL = "/tmp/checkpoints/lodestar"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a session in local mode without it gets a place of its own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = LOCAL
    return f"{root}/lodestar/{name}-{uuid.uuid4().hex}"


class Conflict(Exception):
    """Another writer committed the version that this one was based on."""


class Files:
    """The few file operations that state tables need, on any store Hadoop reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, path: str):  # noqa: ANN201
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        p = self.path(path)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def create(self, path: str, text: str) -> None:
        """Create a file that must not exist; of several writers exactly one succeeds.

        A local file is linked into place, which the kernel does at once; elsewhere the store refuses
        to create a file twice (as HDFS does)."""
        self.fs.mkdirs(self.path(path).getParent())
        parts = urlsplit(path)
        if self.fs.getScheme() == "file":
            local = parts.path if parts.scheme else path
            part = f"{local}.{uuid.uuid4().hex}"
            with os.fdopen(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(part, local)
            except FileExistsError:
                raise Conflict(path) from None
            finally:
                os.unlink(part)
            return
        try:
            stream = self.fs.create(self.path(path), False)
        except Exception as e:
            if self.fs.exists(self.path(path)):
                raise Conflict(path) from e
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


@dataclass(frozen=True)
class Snapshot:
    """A version of a state table as one reader saw it; -1 is the table before its first version."""

    version: int
    rows: DataFrame
    facts: dict


class StateTable:
    """A table of few writers in a folder: a version is a Parquet folder and a log entry that names it.

    Writers never touch what others wrote. A commit says which version it was based on, and its entry can
    be created once only, so of two rivals one gets ``Conflict`` and has to start over from what the other
    left. Readers see the last entry, whole."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 10):
        self.spark, self.root, self.schema, self.kept = spark, path.rstrip("/"), schema, keep
        self.files = Files(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/log") if n.endswith(".json") and n[:-5].isdigit())

    def last(self) -> int:
        return max(self.versions(), default=-1)

    def snapshot(self, version: int | None = None) -> Snapshot:
        version = self.last() if version is None else version
        if version < 0:
            return Snapshot(-1, self.spark.createDataFrame([], self.schema), {})
        entry = json.loads(self.files.read(f"{self.root}/log/{version}.json"))
        if entry.get("schema") != self.schema:
            raise ConfigError(f"{self.root} holds a state table of another layout: {entry.get('schema')}")
        return Snapshot(version, self.spark.read.schema(self.schema).parquet(f"{self.root}/{entry['data']}"), entry.get("facts", {}))

    def read(self) -> DataFrame:
        return self.snapshot().rows

    def commit(self, rows: DataFrame, based_on: int, **facts: object) -> int:
        """Write the version after ``based_on``; ``Conflict`` if another writer did so first. Facts of the
        version before that are not given anew stay."""
        if self.last() != based_on:
            raise Conflict(f"{self.root}: version {self.last()} was committed meanwhile")
        facts = {**self.snapshot(based_on).facts, **facts}
        data = f"data-{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).schema
        rows.select(*(rows[f.name].cast(f.dataType).alias(f.name) for f in columns)).write.parquet(f"{self.root}/{data}")
        entry = {"data": data, "schema": self.schema, "facts": facts, "at": int(time.time())}
        try:
            self.files.create(f"{self.root}/log/{based_on + 1}.json", json.dumps(entry))
        except Conflict:
            self.files.delete(f"{self.root}/{data}")
            raise
        self._forget(based_on + 1)
        return based_on + 1

    def update(self, change: Callable[[Snapshot], DataFrame | None], attempts: int = 10, **facts: object) -> int:
        """Commit what ``change`` makes of the last version; it runs again on what a rival left. None: nothing to write."""
        for i in range(attempts):
            seen = self.snapshot()
            rows = change(seen)
            if rows is None:
                return seen.version
            try:
                return self.commit(rows, seen.version, **facts)
            except Conflict:
                time.sleep(0.05 * 2**i)
        raise Conflict(f"{self.root}: {attempts} attempts were overtaken")

    def _forget(self, version: int) -> None:
        """Drop the data of versions that only a reader of long ago could still need; their entries stay."""
        for old in (v for v in self.versions() if version - self.kept * 2 < v <= version - self.kept):
            self.files.delete(f"{self.root}/{json.loads(self.files.read(f'{self.root}/log/{old}.json'))['data']}")
