"""Tables under optimistic commits: immutable data folders and a numbered log that says which count.

A commit writes its rows to a folder of its own, partitioned by the table's key, and then one log
entry: a line for each key, which adds the folder's rows to the key's (add), makes them the
key's only ones (set), or leaves the key without rows (drop). Entries are numbered and
appear by a rename that fails where the number is taken. A reader takes the entries up to one
number, so it sees one snapshot whatever is committed meanwhile. A change reads a snapshot, and before its
entry gets the next number, it looks whether a later one touches its keys; then what it wrote is
dropped and the change is made again on the newer snapshot. So of two writers none is lost.
Appends read nothing and conflict with nothing. Keys, rows and entries are tables throughout.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ATTEMPTS = 20
#: A local file system has no rename that fails on a taken name, so claims of one process take turns.
_claims = threading.Lock()
_ENTRY = "key string, id string, kind string"


class Conflict(RuntimeError):
    """Every attempt to change some keys met a later commit to them."""


def hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def claim(spark: SparkSession, src: str, dst: str) -> bool:
    """Rename a file unless the name is taken; whether it was done."""
    (a, fs), (b, _) = hadoop(spark, src), hadoop(spark, dst)
    with _claims:
        if fs.exists(b):
            return False
        return bool(fs.rename(a, b)) and fs.exists(b)


class Commits:
    """One table at a path, with this schema, its rows kept by key (a string column of it)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = f"{schema}, _id string"

    def _numbers(self) -> list[int]:
        folder, fs = hadoop(self.spark, f"{self.path}/_log")
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def version(self) -> int:
        """The newest commit's number; 0 before the first."""
        return max(self._numbers(), default=0)

    def _entries(self, after: int, upto: int) -> DataFrame:
        """(key, id, kind, version) of the commits after one number up to another."""
        files = [f"{self.path}/_log/{n:012d}.json" for n in self._numbers() if after < n <= upto]
        if not files:
            return self.spark.createDataFrame([], f"{_ENTRY}, version long")
        read = self.spark.read.schema(_ENTRY).json(files)
        return read.select("key", "id", "kind", F.split("_metadata.file_name", r"\.")[0].cast("long").alias("version"))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a commit, by default the newest."""
        version = self.version() if version is None else version
        entries = self._entries(0, version)
        last = F.max(F.when(F.col("kind") != "add", F.col("version"))).over(W.partitionBy("key"))
        live = entries.withColumn("_last", last).where((F.col("kind") != "drop") & (F.col("version") >= F.coalesce("_last", F.lit(0))))
        live = live.select(F.col("key").alias("_key"), F.col("id").alias("_live"))
        folder, fs = hadoop(self.spark, f"{self.path}/data")
        if not fs.exists(folder):
            return self.spark.createDataFrame([], self.schema).select(self.columns)
        # Folders that no entry names, of commits under way or given up, match nothing; the join prunes partitions.
        data = self.spark.read.schema(self.schema).parquet(f"{self.path}/data")
        return data.join(live, (data["_id"] == live["_live"]) & data[self.key].eqNullSafe(live["_key"]), "left_semi").select(self.columns)

    def append(self, rows: DataFrame) -> int:
        """Add rows; the number of the commit."""
        return self._commit(rows, lambda: rows.select(F.col(self.key).alias("key"), F.lit("add").alias("kind")).distinct(), None)

    def change(self, keys: DataFrame | list[str], fn: Callable[[DataFrame], DataFrame | None], attempts: int = ATTEMPTS) -> int | None:
        """Replace the rows of these keys by fn(their rows); None, and no commit, if fn returns None.

        fn is called again on a newer snapshot when another commit to these keys came first.
        """
        if isinstance(keys, list):
            keys = self.spark.createDataFrame([(k,) for k in keys], "key string")
        keys = keys.select(F.col(keys.columns[0]).alias("key")).distinct()
        for _ in range(attempts):
            base = self.version()
            now = self.read(base)
            rows = fn(now.join(keys, now[self.key].eqNullSafe(keys["key"]), "left_semi"))
            if rows is None:
                return None
            done = self._commit(rows, lambda: keys.select("key", F.lit("set").alias("kind")), base)
            if done is not None:
                return done
        raise Conflict(f"{self.path}: {attempts} attempts met other commits")

    def drop(self, keys: DataFrame | list[str]) -> int | None:
        """Leave these keys without rows."""
        return self.change(keys, lambda now: now.limit(0))

    def _commit(self, rows: DataFrame, entries: Callable[[], DataFrame], base: int | None) -> int | None:
        """Write rows and claim the next number; None if a commit after base touches the same keys."""
        name = uuid.uuid4().hex
        data, staged = f"{self.path}/data/_id={name}", f"{self.path}/_staged/{name}"
        rows.select(self.columns).write.partitionBy(self.key).parquet(data)
        lines = entries().select(F.to_json(F.struct("key", F.lit(name).alias("id"), "kind")).alias("value"))
        lines.coalesce(1).write.text(staged)
        folder, fs = hadoop(self.spark, staged)
        part = next(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
        fs.mkdirs(hadoop(self.spark, f"{self.path}/_log")[0])
        try:
            seen = base
            while True:
                newest = self.version()
                if seen is not None and newest > seen:
                    mine, later = self.spark.read.schema(_ENTRY).json(part), self._entries(seen, newest).select(F.col("key").alias("_key"))
                    if mine.join(later, mine["key"].eqNullSafe(later["_key"]), "left_semi").limit(1).count():
                        fs.delete(hadoop(self.spark, data)[0], True)
                        return None
                    seen = newest
                if claim(self.spark, part, f"{self.path}/_log/{newest + 1:012d}.json"):
                    return newest + 1
        finally:
            fs.delete(folder, True)
