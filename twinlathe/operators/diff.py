"""What a synchronisation would transfer, and its plan.

``tree_diff`` compares every file of two listings. Where a side's listing is kept as a tree
of digests (``digest_tree``), ``descended`` gives the same rows but opens only folders whose
digests differ, level by level: for few changes it reads few of the files, however many there are.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlathe.schema import TRASH_DIR
from twinlathe.storage import materialized

# What a transfer leaves out.
EXCLUDES = (TRASH_DIR, ".twinlathe-cache.json", ".venv", ".git", "__pycache__", ".pytest_cache", "*.egg-info")


def tree_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """rel, change (missing_remote, missing_local, differs) of files not equal on both sides.
    Both have rel, size, mtime_ns."""
    r = remote.select("rel", F.col("size").alias("r_size"), F.col("mtime_ns").alias("r_mtime"))
    joined = local.select("rel", "size", "mtime_ns").join(r, "rel", "full_outer")
    change = (
        F.when(F.col("r_size").isNull(), "missing_remote").when(F.col("size").isNull(), "missing_local")
        .when((F.col("size") != F.col("r_size")) | (F.col("mtime_ns") != F.col("r_mtime")), "differs")
    )
    return joined.select("rel", change.alias("change")).where(F.col("change").isNotNull())


#: Columns of a digest tree: files and folders by depth and the folder they lie in.
TREE_DDL = "depth int, parent string, rel string, folder boolean, files long, d1 long, d2 long"
#: Folders to open of which a level's file filter is a list of names; beyond it a join.
LISTED = 256


def digest_tree(listing: DataFrame) -> DataFrame:
    """``TREE_DDL`` of a listing (rel, size, mtime_ns; several rows of a rel count as one file
    by their largest). A file's digest is of its name, size and time; a folder's is made from
    its children's, bottom-up: the exclusive or of their mixed digests, 128 bits, so that a
    folder with any number of children is added up before it is shuffled. Rows are written by
    depth and folder, so that a reader that asks for few folders skips the others' row groups."""
    cut = lambda c: F.when(F.contains(F.col(c), F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise("")
    files = listing.groupBy("rel").agg(F.max(F.struct("size", "mtime_ns")).alias("m"))
    level = files.select(
        F.size(F.split("rel", "/")).alias("depth"), cut("rel").alias("parent"), "rel", F.lit(False).alias("folder"), F.lit(1).cast("long").alias("files"),
        F.xxhash64("rel", "m.size", "m.mtime_ns").alias("d1"), F.xxhash64(F.lit(1), "rel", "m.size", "m.mtime_ns").alias("d2"),
    )
    nodes = materialized(level, "files")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    out = [nodes]
    above = None
    for depth in range(deepest, 1, -1):
        here = nodes.where(F.col("depth") == depth)
        children = here if above is None else here.unionByName(above)
        sums = children.groupBy("parent").agg(F.sum("files").alias("files"), *[F.bit_xor(F.xxhash64("folder", d)).alias(d) for d in ("d1", "d2")])
        above = materialized(sums.select(F.lit(depth - 1).alias("depth"), cut("parent").alias("parent"), F.col("parent").alias("rel"), F.lit(True).alias("folder"), "files", "d1", "d2"), "folders")
        out.append(above)
    whole = functools.reduce(DataFrame.unionByName, out)
    return materialized(whole.repartitionByRange("depth", "parent", "rel").sortWithinPartitions("depth", "parent", "rel"), "tree")


def descended(here: DataFrame, there: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rel, change as ``tree_diff`` gives them; depth, compared: how many rows of the trees a
    level compared) from two digest trees."""
    spark = here.sparkSession
    changes = spark.createDataFrame([], "rel string, change string")
    levels, depth, open_, n = [], 1, spark.createDataFrame([("",)], "parent string"), 1
    while n:
        names = [r["parent"] for r in open_.collect()] if n <= LISTED else None
        mine = lambda t: t.where(F.col("depth") == depth)  # noqa: B023, E731
        only = (lambda t: mine(t).where(F.col("parent").isin(names))) if names is not None else (lambda t: mine(t).join(open_, "parent", "left_semi"))  # noqa: B023
        a, b = (only(t).select("rel", "folder", F.struct("files", "d1", "d2").alias(side)) for t, side in ((here, "a"), (there, "b")))
        level = materialized(a.join(b, ["rel", "folder"], "full_outer"), "level")
        levels.append(level.select(F.lit(depth).alias("depth"), (F.count("a") + F.count("b")).alias("compared")))
        other = level.where(~F.col("a").eqNullSafe(F.col("b")))
        change = F.when(F.col("b").isNull(), "missing_remote").when(F.col("a").isNull(), "missing_local").otherwise("differs")
        changes = changes.unionByName(other.where("NOT folder").select("rel", change.alias("change")))
        open_ = other.where("folder").select(F.col("rel").alias("parent"))
        n, depth = open_.count(), depth + 1
    return changes, functools.reduce(DataFrame.unionByName, levels)


def transfer_summary(diff: DataFrame, direction: str, sample: int = 25) -> tuple[int, list[str]]:
    """(number of files to transfer, the first of them) for push or pull."""
    moves = diff.where(F.col("change").isin("differs", "missing_remote" if direction == "push" else "missing_local"))
    return moves.count(), [r["rel"] for r in moves.orderBy("rel").limit(sample).collect()]


def rsync_command(src: str, dst: str, dry_run: bool, delete: bool) -> list[str]:
    """Arguments for a transfer (not run here)."""
    flags = ["-n"] * dry_run + ["--delete"] * delete
    return ["rsync", "-a", "-e", "ssh", "--partial", *flags, *[x for p in EXCLUDES for x in ("--exclude", p)], src, dst]


def sync_plan(root: str, remote: str, remote_root: str, direction: str, local_settings: str | None = None, remote_settings: str | None = None) -> list[tuple[str, str, str]]:
    """(label, source, destination) of each leg; the settings leg needs both paths."""
    slash = lambda p: p.rstrip("/") + "/"
    legs = [("collection", f"{root}/", f"{remote}:{remote_root}/")]
    if local_settings and remote_settings:
        legs.append(("settings", slash(local_settings), f"{remote}:{slash(remote_settings)}"))
    return legs if direction == "push" else [(label, b, a) for label, a, b in legs]


def needs_confirmation(dry_run: bool, yes: bool) -> bool:
    return not (dry_run or yes)


def running_guard(here: bool, there: bool | None) -> tuple[str | None, str | None]:
    """(error, warning) before settings of an application are transferred: it must run on neither
    side; ``there`` is None where the other side can't be asked."""
    if here or there:
        return f"the application is running {'here' if here else 'on the other side'}: close it before its settings are transferred", None
    return None, "could not ask whether the application runs on the other side" if there is None else None
