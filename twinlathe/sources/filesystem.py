"""A collection on a file system: listing, hashing, trash, and carrying plans out.

The listing is made by tasks, folder by folder. Spark's own file source is not used for it:
it hides names that begin with '_' and has no nanosecond times.
"""

from __future__ import annotations

import functools
import hashlib
import os
import shutil
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlathe.errors import ConfirmationRequired
from twinlathe.schema import SOURCE_DIRS, TRASH_DIR
from twinlathe.storage import materialized

CHUNK = 1 << 20


#: Entries that a task lists below one folder before it hands back the folders still open.
LISTED = 20_000
_WALK_DDL = "tag string, top string, path string, rel string, size long, mtime_ns long, open boolean"


_WALK = pa.schema([("tag", pa.string()), ("top", pa.string()), ("path", pa.string()), ("rel", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("open", pa.bool_())])


def _walk(listed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files below each folder (tag, top, path), and the folders left open once ``listed`` entries
    are seen. Links to files are files, links to folders aren't followed; what can't be read is left out."""
    for batch in batches:
        for tag, top, folder in zip(*[batch.column(c).to_pylist() for c in ("tag", "top", "path")]):
            left, rows, seen = [folder], [], 0
            while left and seen < listed:
                try:
                    with os.scandir(left.pop()) as entries:
                        for entry in entries:
                            seen += 1
                            try:
                                if entry.is_dir(follow_symlinks=False):
                                    left.append(entry.path)
                                elif entry.is_file():
                                    st = entry.stat()
                                    rows.append((tag, top, entry.path, os.path.relpath(entry.path, top), st.st_size, st.st_mtime_ns, False))
                            except OSError:
                                continue
                except OSError:
                    continue
            rows += [(tag, top, path, None, None, None, True) for path in left]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _WALK)], schema=_WALK)


def walked(spark: SparkSession, tops: list[tuple[str, str]], listed: int = LISTED) -> DataFrame:
    """tag, path, rel (below the top), size, mtime_ns of every file below the folders (tag, top).
    A table of open folders is dealt out over the tasks, which list them and hand back files and
    folders still open, until none is; the driver sees only how many there are. Executors must
    see the paths."""
    tops = [(tag, str(top)) for tag, top in tops if os.path.isdir(top)]
    open_ = spark.createDataFrame([(tag, top, top) for tag, top in tops], "tag string, top string, path string")
    found, left = None, len(tops)
    while left:
        tasks = min(left, 4 * spark.sparkContext.defaultParallelism)
        level = materialized(open_.repartition(tasks, "path").mapInArrow(functools.partial(_walk, listed), _WALK_DDL), "walked")
        files = level.where("NOT open")
        found = files if found is None else found.unionByName(files)
        open_ = level.where("open").select("tag", "top", "path")
        left = open_.count()
    found = spark.createDataFrame([], _WALK_DDL) if found is None else found
    return found.select("tag", "path", "rel", "size", "mtime_ns")


def listing(spark: SparkSession, root: str | Path) -> DataFrame:
    """path, rel, source, size, mtime_ns of every file below the source folders."""
    files = walked(spark, [(source, str(Path(root, folder))) for source, folder in SOURCE_DIRS.items()])
    folder = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_DIRS.items() for x in kv]), F.col("tag"))
    return files.select("path", F.concat_ws("/", folder, "rel").alias("rel"), F.col("tag").alias("source"), "size", "mtime_ns")


def sha256_of(path: str) -> str | None:
    """Hex digest read in chunks; None where the file can't be read."""
    try:
        with open(path, "rb") as f:
            digest = hashlib.sha256()
            while chunk := f.read(CHUNK):
                digest.update(chunk)
            return digest.hexdigest()
    except OSError:
        return None


#: Bytes at a file's begin and end, and of each of ``PEEKS`` places between, that tell most files apart.
PEEK, PEEKS, PEEK_BETWEEN = 1 << 16, 8, 1 << 12


def peek_of(path: str, size: int) -> tuple[str | None, int]:
    """(digest of a file's begin, end and places between, bytes read); a file of no more than
    those is read whole. None where the file can't be read."""
    try:
        digest, read = hashlib.sha256(), 0
        places = [(0, size)] if size <= 2 * PEEK + PEEKS * PEEK_BETWEEN else [
            (0, PEEK), *[(PEEK + k * (size - 2 * PEEK) // PEEKS, PEEK_BETWEEN) for k in range(PEEKS)], (size - PEEK, PEEK)
        ]
        with open(path, "rb") as f:
            for at, n in places:
                f.seek(at)
                part = f.read(n)
                digest.update(part)
                read += len(part)
        return digest.hexdigest(), read
    except OSError:
        return None, 0


def _peek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [peek_of(p, n) for p, n in zip(batch["path"], batch["size"])]
        yield pd.DataFrame({"rel": batch["rel"], "size": batch["size"], "fresh": batch["fresh"], "peek": [d for d, _ in found], "peeked": [n for _, n in found]})


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"rel": batch["rel"], "sha256": [sha256_of(p) for p in batch["path"]]})


def peeks(tracks: DataFrame) -> DataFrame:
    """rel, size, fresh (its hash isn't known), peeked (bytes read for it) and whole (whether it has
    to be read whole) of the files that share a size with a fresh one. Files of which another one
    looks the same, or that couldn't be peeked at, have to be."""
    shared = tracks.groupBy("size").agg(F.count("*").alias("n"), F.count_if(F.col("sha256").isNull()).alias("fresh")).where("n > 1 AND fresh > 0").select("size")
    looked = tracks.join(shared, "size", "left_semi").select("rel", "path", "size", F.col("sha256").isNull().alias("fresh"))
    seen = materialized(looked.mapInPandas(_peek, "rel string, size long, fresh boolean, peek string, peeked long"), "peeks")
    same = seen.where("peek IS NOT NULL").groupBy("size", "peek").agg(F.count("*").alias("n")).where("n > 1").select(F.col("size").alias("same_size"), F.col("peek").alias("same_peek"))
    alike = seen.join(same, (F.col("size") == F.col("same_size")) & (F.col("peek") == F.col("same_peek")), "left")
    return alike.select("rel", "size", "fresh", "peeked", (F.col("fresh") & (F.col("same_peek").isNotNull() | F.col("peek").isNull())).alias("whole"))


def hash_counters(seen: DataFrame) -> DataFrame:
    """files, peeked_bytes, whole_files, whole_bytes of ``peeks``, and saved_bytes: of fresh files never read whole."""
    return seen.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("peeked"), F.lit(0)).alias("peeked_bytes"), F.count_if("whole").alias("whole_files"),
        F.coalesce(F.sum(F.when(F.col("whole"), F.col("size"))), F.lit(0)).alias("whole_bytes"), F.coalesce(F.sum(F.when(F.col("fresh") & ~F.col("whole"), F.col("size"))), F.lit(0)).alias("saved_bytes"),
    )


def with_hashes(tracks: DataFrame) -> DataFrame:
    """``tracks`` (path, rel, size, sha256 or null) hashed where another file has the size and
    looks the same at a few places, and no hash is known; a file that differs there from all
    others of its size has no duplicate and keeps no hash. Files are read on the executors,
    which must see the paths."""
    todo = tracks.join(peeks(tracks).where("whole").select("rel"), "rel", "left_semi").select("rel", "path")
    found = todo.mapInPandas(_hash, "rel string, sha256 string").withColumnRenamed("sha256", "_new")
    return tracks.join(found, "rel", "left").withColumn("sha256", F.coalesce("sha256", "_new")).drop("_new").select(*tracks.columns)


def trash_entries(spark: SparkSession, root: str | Path) -> DataFrame:
    """path, day, rel, size of each file in the trash, below a day's folder."""
    files = walked(spark, [("trash", str(Path(root, TRASH_DIR)))]).where(F.contains("rel", F.lit("/")))
    return files.select("path", F.substring_index("rel", "/", 1).alias("day"), F.regexp_replace("rel", "^[^/]*/", "").alias("rel"), "size")


def empty_trash(root: str | Path, yes: bool = False) -> int:
    """Deletes the trash for good; returns the number of files."""
    trash = Path(root, TRASH_DIR)
    n = sum(p.is_file() for p in trash.rglob("*"))
    if n and not yes:
        raise ConfirmationRequired(f"{n} file(s) in {TRASH_DIR}/ would be deleted for good")
    if trash.is_dir():
        shutil.rmtree(trash)
    return n


def today() -> str:
    return datetime.now().strftime("%Y-%m-%d")


def _inside(root: Path, rel: str) -> Path:
    path = (root / rel).resolve()
    if root.resolve() not in path.parents:
        raise ValueError(f"{rel} lies outside the collection")
    return path


def free_name(path: Path) -> Path:
    """``path``, or the first of 'stem - 2.ext' to 'stem - 999.ext' that is free."""
    for n in range(1, 1000):
        candidate = path if n == 1 else path.with_name(f"{path.stem} - {n}{path.suffix}")
        if not candidate.exists():
            return candidate
    raise FileExistsError(f"no free name for {path}")


def apply_moves(root: str | Path, moves: list[tuple[str, str]], numbered: bool = False) -> list[tuple[str, str, str]]:
    """Carries out (rel, dest) moves: (rel, dest, moved | missing | exists). Taken names are
    numbered only where asked (in the trash)."""
    root, done = Path(root), []
    for rel, dest in moves:
        src, to = _inside(root, rel), _inside(root, dest)
        if not src.exists():
            done.append((rel, dest, "missing"))
            continue
        if to.exists() and not numbered:
            done.append((rel, dest, "exists"))
            continue
        to.parent.mkdir(parents=True, exist_ok=True)
        to = free_name(to)
        shutil.move(str(src), str(to))
        done.append((rel, to.relative_to(root.resolve()).as_posix(), "moved"))
    return done


def prune(root: str | Path, source: str) -> int:
    """Removes empty folders below a source's folder; returns how many."""
    base, removed = Path(root, SOURCE_DIRS[source]), 0
    for at, _, _ in os.walk(base, topdown=False):
        if Path(at) != base and not os.listdir(at):
            os.rmdir(at)
            removed += 1
    return removed
