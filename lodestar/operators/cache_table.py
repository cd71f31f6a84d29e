"""The life of a response cache: loaded and trimmed, looked up, put into, and saved only if something changed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import state
from lodestar.storage import Conflict, Snapshot, StateTable

LAYOUT = "key string, value string, ts bigint, seq bigint, bytes bigint"


@dataclass
class Limits:
    ttl: int = state.CACHE_TTL
    entries: int = state.CACHE_ENTRIES
    most_bytes: int = state.CACHE_BYTES
    enabled: bool = True


@dataclass
class Cache:
    """One run's view of the cache in a folder.

    ``load`` drops what is expired or over a limit and counts it; hits become recent; ``save`` merges what
    this run touched into what rivals wrote meanwhile. Nothing is written by a run that changed nothing, and
    a cache that cannot be read or written never fails a run: ``trouble`` says why."""

    spark: SparkSession
    path: str
    now: int
    limits: Limits = field(default_factory=Limits)
    expired: int = 0
    trouble: str | None = None

    def __post_init__(self) -> None:
        self.table = StateTable(self.spark, self.path, LAYOUT)
        self.dirty = False
        self._new: DataFrame | None = None
        self._used: DataFrame | None = None
        self._bad: DataFrame | None = None
        self.rows = self.spark.createDataFrame([], LAYOUT)
        self.version = -1
        if self.limits.enabled:
            self.load()

    def load(self) -> None:
        try:
            found = self.table.snapshot()
            old = state.is_expired("ts", self.now, self.limits.ttl)
            counts = found.rows.agg(F.count_if(old).alias("expired"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("seq").alias("seq")).first()
        except Exception as e:  # noqa: BLE001  a broken cache is an empty one
            self.trouble = str(e).splitlines()[0]
            return
        self.version, self.expired, self.seq = found.version, counts.expired, (counts.seq or 0)
        over = counts.n - counts.expired > self.limits.entries or 0 < self.limits.most_bytes < (counts.bytes or 0)
        self.rows = self._trimmed(found.rows) if counts.expired or over else found.rows
        self.dirty = bool(counts.expired or over)

    def _trimmed(self, rows: DataFrame) -> DataFrame:
        """``rows`` within the limits; only what is over one has to be ordered."""
        live = rows.where(~state.is_expired("ts", self.now, self.limits.ttl))
        held = live.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
        if held.n <= self.limits.entries and not 0 < self.limits.most_bytes < (held.bytes or 0):
            return live
        return state.evict(live, self.now, 0, self.limits.entries, self.limits.most_bytes)

    def lookup(self, requests: DataFrame, schema: str | None = None) -> DataFrame:
        """``requests`` (key) with ``value`` and ``hit``; hits are recent from now on. With a schema, values
        are decoded, and one of another shape is a miss that is dropped when saving."""
        if not self.limits.enabled or self.trouble:
            return requests.withColumns({"value": F.lit(None).cast("string"), "hit": F.lit(False)})
        found = state.lookup(requests, self.rows, self.now, self.limits.ttl)
        if schema:
            raw = found
            found = state.decoded(found, schema)
            bad = raw.where("hit").select("key").join(found.where("hit").select("key"), "key", "left_anti").distinct()
            self.rows = self.rows.join(bad, "key", "left_anti")
            self._bad = bad if self._bad is None else self._bad.unionByName(bad)
        hits = found.where("hit").select("key").distinct()
        self._used = hits if self._used is None else self._used.unionByName(hits).distinct()
        return found

    def put(self, answers: DataFrame) -> None:
        """Answers (key, value) of this run; a key given twice keeps its last value. Empty ones are not stored."""
        if not self.limits.enabled or self.trouble:
            return
        rows = answers.select("key", "value", F.lit(self.now).cast("bigint").alias("ts"), F.lit(self.seq + 2).cast("bigint").alias("seq"), state.entry_bytes("key", "value").alias("bytes"))
        self._new = rows if self._new is None else self._new.unionByName(rows)

    def save(self) -> bool:
        """Write a version if this run changed something; whether it did."""
        if not self.limits.enabled or self.trouble:
            return False
        self.dirty = self.dirty or (self._bad is not None and not self._bad.isEmpty())
        new = None
        if self._new is not None:
            new = state.put(self.rows.limit(0), self._new.dropDuplicates(["key"]), self.limits.most_bytes or (1 << 62))
            self.dirty = self.dirty or not new.isEmpty()
        bumped = None
        if self._used is not None:  # a single most recent entry that is hit again stays as it is
            top = self.rows.agg(F.max("seq").alias("m"), F.count_if(F.col("seq") == self.seq).alias("n")).first()
            only = self.rows.where(F.col("seq") == top.m).select("key") if top.n == 1 else self.rows.limit(0).select("key")
            bumped = self._used.join(only, "key", "left_anti")
            self.dirty = self.dirty or not bumped.isEmpty()
        if not self.dirty:
            return False

        def change(seen: Snapshot) -> DataFrame:
            base = self.rows if seen.version == self.version else seen.rows if self._bad is None else seen.rows.join(self._bad, "key", "left_anti")
            if bumped is not None:
                base = state.touch(base, bumped.withColumn("hit", F.lit(True)), self.seq + 1)
            if new is not None:
                base = base.join(new.select("key"), "key", "left_anti").unionByName(new)
            return self._trimmed(base)

        try:
            self.version = self.table.update(change, expired=self.expired)
        except Conflict as e:
            self.trouble = str(e)
            return False
        self.dirty = False
        self._new = self._used = self._bad = None
        return True
