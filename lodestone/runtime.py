"""Session plumbing shared by operators: shared scratch folders and code shipping."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Joins under these settings pass the larger side through a Bloom filter of the other side's
#: keys before it is shuffled. The filter has at most 8 MB whatever it is made from.
BLOOM_JOINS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
}


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for the actions inside."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's spark.checkpoint.dir. Only a local master (tests, a laptop) may do
    without: there a folder of our own is made. On a cluster an unset folder is an error, as
    executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written under the shared folder to cut lineage; each has its own path.

    They stay while the driver runs, as results may still read them, and go when it ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._clear)

    def _clear(self) -> None:
        with suppress(Exception):  # the session may be gone; what is left is only space
            if self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """Write df once, as so many files at most, and return what reads it back. Zstandard halves texts, which Snappy hardly does."""
        out = df.coalesce(files) if files else df
        out.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that are done, before the next large step."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            _delete(self.spark, self.path(name))


def release_memory() -> None:
    """Give freed memory of this worker process back to the system; workers are kept and reused."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python path, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    where = os.path.join(tempfile.mkdtemp(prefix="lodestone-zip-"), "lodestone_pkg.zip")
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, str(f.relative_to(top.parent)))
    sc.addPyFile(where)
    _shipped.add(sc.applicationId)
