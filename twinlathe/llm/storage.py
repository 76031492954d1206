"""Scratch tables in the folder that driver and executors share.

Lineage is cut with tables written here: they outlive executors, and Spark's commit
protocol keeps half-written files out. The folder is ``spark.checkpoint.dir``; only a
local session without that setting (tests, a laptop) gets one of its own. On a cluster
its lack is an error: executors would not see each other's files.
"""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlathe.storage import shared_dir

#: Rows of a few numbers each (at most 40 bytes) that a join may broadcast.
BROADCAST_ROWS = 1 << 18


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, every table and folder made within it, of whichever operator."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        drop(spark, *made)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one table or folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if (made := _made.get()) is not None:
        made.append(path)
    fs, hadoop_path = _hadoop(spark, path)
    fs.deleteOnExit(hadoop_path)
    return path


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete folders made by ``new_path``."""
    for path in paths:
        fs, hadoop_path = _hadoop(spark, path)
        fs.delete(hadoop_path, True)


def carried(docs: DataFrame, columns: tuple[str, ...]) -> list[str]:
    """DDL of columns that an operator passes on."""
    return [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]


class Scratch:
    """Tables of one operator run. ``close`` drops all but those named in ``keep``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def folder(self, what: str) -> str:
        self.paths.append(new_path(self.spark, f"{self.name}-{what}"))
        return self.paths[-1]

    def cut(self, df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
        """``df`` written out and read back."""
        path = self.folder(what)
        df.write.parquet(path, compression=codec)
        return self.spark.read.schema(df.schema).parquet(path)

    def small(self, table: DataFrame) -> DataFrame:
        """``table`` (written; rows of a few numbers), to be broadcast if it has at most
        ``BROADCAST_ROWS`` rows; beyond that joins shuffle."""
        return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table

    def drop(self, *tables: DataFrame) -> None:
        """Drop the tables that nothing reads any more, by the frames ``cut`` returned."""
        for table in tables:
            for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                known = [p for p in self.paths if path.rstrip("/").endswith(p.rsplit("/", 1)[1])]
                drop(self.spark, *known)

    def release(self) -> None:
        """Let go of shuffle files that nothing can read any more. Spark removes them when
        the driver happens to collect its garbage, which on a large driver may take long."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self, keep: DataFrame | None = None) -> None:
        kept = set() if keep is None else {f.rsplit("/", 2)[1] for f in keep.inputFiles()}
        drop(self.spark, *[p for p in self.paths if p.rsplit("/", 1)[1] not in kept])
