"""Written intermediate tables in the folder that spark.checkpoint.dir names.

Each ``save`` writes Parquet and reads it back, which cuts lineage and survives
lost executors.  ``drop`` frees a table once nothing unread depends on it; what
is left goes when the driver process ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Only a session inside one machine may leave it unset; it gets a local folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="wayloom-"))
        root = _local[0]
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_recording: list[list["Scratch"]] = []


@contextmanager
def recorded() -> Iterator[list["Scratch"]]:
    """The scratch folders that are made inside the block."""
    own: list[Scratch] = []
    _recording.append(own)
    try:
        yield own
    finally:
        _recording.pop()


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._saved: list[str] = []
        atexit.register(self.clean)
        if _recording:
            _recording[-1].append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._wayloom_path = path
        self._saved.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = getattr(df, "_wayloom_path", None)
            if path in self._saved:
                self._saved.remove(path)
                delete_path(self.spark, path)

    def free(self, *kept: DataFrame) -> None:
        """Drops all saved tables but these."""
        keep = {getattr(df, "_wayloom_path", None) for df in kept}
        for path in [p for p in self._saved if p not in keep]:
            self._saved.remove(path)
            delete_path(self.spark, path)

    def clean(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # the session may have ended first
            pass
