"""Persistent state: the derived-data cache and the recorded decisions.

Each table is a log below a state folder: numbered commits, and Parquet folders that they
name. A commit is a change (rows to put, rows gone by their key, or all of a root replaced) or a
snapshot of the whole table. A reader folds the changes since the last snapshot over it; one
decision writes one row. A commit's number can be taken once: who comes second takes the
next, so that writers at the same time lose nothing, and a change's place in the log is its
order. After ``COMPACT`` changes the writer tries a snapshot, which holds only if nobody
committed meanwhile; what only snapshots before the last one need is then removed.

Files are reached by Hadoop's file systems. Taking a number is a rename that must not overwrite
(HDFS), or a link on a local disk. Tables are keyed by root, so one state folder serves several
collections. ``import_cache`` and ``import_decisions`` read the JSON documents of a single-file state.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlathe.schema import CACHE_DDL, DECISION_DDL

CACHE_VERSION = 2
DECISIONS_VERSION = 1

#: Columns that tell a table's rows apart.
KEYS = {"cache": ("root", "rel"), "decisions": ("root", "id")}
_DDL = {"cache": CACHE_DDL, "decisions": DECISION_DDL}
#: Changes after which a snapshot is due.
COMPACT = 16
#: A change's rows are ordered by its number, then by their own seq, of this many bits.
SEQ_BITS = 32


@dataclass(frozen=True)
class Commit:
    """One entry of a log. ``clears``: root of which nothing committed before counts."""

    number: int
    kind: str
    data: str | None = None
    clears: str | None = None


@dataclass
class Log:
    """The commits of one table."""

    spark: SparkSession
    folder: str
    name: str
    commits: list[Commit] = field(default_factory=list)

    def __post_init__(self):
        self.base = f"{self.folder}/{self.name}"
        self.path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(f"{self.base}").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self.read()

    def read(self) -> None:
        """All commits from the last snapshot on, in order."""
        at = self.path(f"{self.base}/commits")
        names = sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []
        self.commits, text = [], self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        for name in reversed([n for n in names if n.isdigit()]):
            stream = self.fs.open(self.path(f"{self.base}/commits/{name}"))
            self.commits.insert(0, Commit(int(name), **json.loads(text.toString(stream, "UTF-8"))))
            stream.close()
            if self.commits[0].kind == "snapshot":
                break

    @property
    def head(self) -> int:
        return self.commits[-1].number if self.commits else 0

    def write(self, df: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.base}/{name}")
        return name

    def _publish(self, number: int, text: str) -> bool:
        """Whether the number was free, and is taken now."""
        final, temporary = self.path(f"{self.base}/commits/{number:012}"), self.path(f"{self.base}/.commit-{uuid.uuid4().hex}")
        self.fs.mkdirs(final.getParent())
        stream = self.fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.exists(final):
                return False
            if self.fs.getUri().getScheme() != "file":
                return self.fs.rename(temporary, final)
            os.link(temporary.toUri().getPath(), final.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            self.fs.delete(temporary, False)

    def commit(self, kind: str, data: str | None = None, clears: str | None = None, only_after: int | None = None) -> int | None:
        """The number taken; None if another commit follows ``only_after`` already."""
        entry = {k: v for k, v in {"kind": kind, "data": data, "clears": clears}.items() if v is not None}
        while only_after is None or self.head == only_after:
            if self._publish(self.head + 1, json.dumps(entry)):
                self.read()
                return self.head
            self.read()
        return None

    def table(self, ddl: str) -> DataFrame:
        """The rows that count now."""
        key, columns = KEYS[self.name], [f.name for f in self.spark.createDataFrame([], ddl).schema]
        parts = []
        for c in self.commits:
            if c.data is not None:
                rows = self.spark.read.schema(f"{ddl}, _gone boolean").parquet(f"{self.base}/{c.data}").withColumn("_commit", F.lit(c.number))
                if "seq" in columns and c.kind == "change":
                    rows = rows.withColumn("seq", F.col("seq") + F.lit(c.number << SEQ_BITS))
                parts.append(rows)
        if not parts:
            return self.spark.createDataFrame([], ddl)
        rows = functools.reduce(DataFrame.unionByName, parts)
        for c in self.commits:
            if c.clears is not None:
                rows = rows.where((F.col("root") != c.clears) | (F.col("_commit") >= c.number))
        if len(self.commits) > 1:
            order = [F.col("_commit").desc(), *([F.col("seq").desc()] if "seq" in columns else [])]
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1")
        return rows.where("_gone IS NULL OR NOT _gone").select(*columns)

    def compact(self, ddl: str) -> bool:
        """A snapshot of the table, if nobody commits meanwhile."""
        seen = self.head
        data = self.write(self.table(ddl))
        if self.commit("snapshot", data, only_after=seen) is None:
            self.fs.delete(self.path(f"{self.base}/{data}"), True)
            return False
        self._forget(seen)
        return True

    def _forget(self, number: int) -> None:
        """Removes what only snapshots before the last one up to ``number`` need, so that readers of that one go on."""
        at = self.path(f"{self.base}/commits")
        numbers = sorted(int(f.getPath().getName()) for f in self.fs.listStatus(at) if f.getPath().getName().isdigit())
        text, old = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils, []
        for n in reversed([n for n in numbers if n <= number]):
            path = self.path(f"{self.base}/commits/{n:012}")
            stream = self.fs.open(path)
            entry = json.loads(text.toString(stream, "UTF-8"))
            stream.close()
            if old or entry["kind"] == "snapshot":
                old.append((path, entry))
        for path, entry in old[1:]:
            self.fs.delete(path, False)
            if entry.get("data"):
                self.fs.delete(self.path(f"{self.base}/{entry['data']}"), True)


def load(spark: SparkSession, folder: str | Path, name: str, ddl: str, root: str | None = None) -> DataFrame:
    """The table ``name`` as of now, of one root where given; empty where there is none."""
    table = Log(spark, str(folder), name).table(ddl)
    return table if root is None else table.where(F.col("root") == root)


def save(df: DataFrame, folder: str | Path, name: str) -> None:
    """Replaces the whole table ``name``. ``df`` may read its present version."""
    log = Log(df.sparkSession, str(folder), name)
    log.commit("snapshot", log.write(df))


def _change(log: Log, df: DataFrame | None, clears: str | None = None) -> None:
    log.commit("change", None if df is None else log.write(df), clears)
    if len(log.commits) > COMPACT:
        log.compact(_DDL[log.name])


def put(df: DataFrame, folder: str | Path, name: str) -> None:
    """Adds rows; those of a known key take its place. A decision's seq orders the rows of ``df``;
    all of them come after what was committed before."""
    _change(Log(df.sparkSession, str(folder), name), df)


def remove(keys: DataFrame, folder: str | Path, name: str) -> None:
    """Removes the rows of ``keys`` (the table's key columns)."""
    missing = [f for f in keys.sparkSession.createDataFrame([], _DDL[name]).schema if f.name not in KEYS[name]]
    rows = keys.select(*KEYS[name], *[F.lit(0 if f.name == "seq" else None).cast(f.dataType).alias(f.name) for f in missing], F.lit(True).alias("_gone"))
    _change(Log(keys.sparkSession, str(folder), name), rows)


def load_cache(spark: SparkSession, folder: str | Path, root: str) -> DataFrame:
    return load(spark, folder, "cache", CACHE_DDL, root)


def save_cache(tracks: DataFrame, folder: str | Path, root: str) -> None:
    """What a scan of ``root`` knows replaces what was known of it; other roots stay."""
    columns = [f.split()[0] for f in CACHE_DDL.split(", ")]
    mine = tracks.withColumn("root", F.lit(root))
    kinds = {f.name: f.dataType for f in tracks.sparkSession.createDataFrame([], CACHE_DDL).schema}
    mine = mine.select(*[(F.col(c) if c in mine.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns])
    _change(Log(tracks.sparkSession, str(folder), "cache"), mine, clears=root)


def clear(spark: SparkSession, folder: str | Path, name: str, ddl: str, root: str) -> int:
    """Removes what the table knows of ``root``; returns how many rows. Other roots stay."""
    n = load(spark, folder, name, ddl, root).count()
    if n:
        _change(Log(spark, str(folder), name), None, clears=root)
    return n


def size(spark: SparkSession, folder: str | Path, name: str) -> int:
    """Bytes of the folders that the table is read from; 0 where there is none."""
    log = Log(spark, str(folder), name)
    return sum(log.fs.getContentSummary(log.path(f"{log.base}/{c.data}")).getLength() for c in log.commits if c.data)


def load_decisions(spark: SparkSession, folder: str | Path, root: str) -> DataFrame:
    return load(spark, folder, "decisions", DECISION_DDL, root)


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", schema).alias("d")).where(F.col("d").isNotNull()).select("d.*")


def import_cache(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Rows of a JSON cache {version, root, entries: {rel: {...}}}; none where the document
    is broken, of another root or of another version."""
    entry = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in CACHE_DDL.split(", ")[2:])
    doc = _document(spark, path, f"version int, root string, entries map<string, struct<{entry}>>")
    rows = doc.where((F.col("root") == root) & (F.col("version") == CACHE_VERSION)).select("root", F.explode("entries").alias("rel", "e"))
    return rows.select("root", "rel", "e.*")


def import_decisions(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Rows of a JSON decisions document {version, root, decisions: [...]}, seq by position."""
    item = T.StructType([f for f in spark.createDataFrame([], DECISION_DDL).schema if f.name not in ("root", "seq")]).simpleString()
    doc = _document(spark, path, f"version int, root string, decisions array<{item}>")
    rows = doc.where((F.col("root") == root) & (F.col("version") == DECISIONS_VERSION)).select("root", F.posexplode("decisions").alias("seq", "d"))
    return rows.select("root", "d.*", F.col("seq").cast("long").alias("seq"))


def export_decisions(decisions: DataFrame, path: str | Path, root: str) -> None:
    """The decisions of one root as a JSON document (few rows, on the driver)."""
    rows = [r.asDict(recursive=True) for r in decisions.where(F.col("root") == root).orderBy("seq").drop("root", "seq").collect()]
    document = {"version": DECISIONS_VERSION, "root": root, "decisions": [{k: v for k, v in r.items() if v is not None} for r in rows]}
    temporary = Path(path).with_suffix(".tmp")
    temporary.write_text(json.dumps(document, indent=1, sort_keys=True))
    os.replace(temporary, path)
