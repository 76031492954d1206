"""Replay of recorded decisions in their order, in parallel where order can't matter.

A decision makes steps: a removal looks at the kept path and may take the removed one away; a
rename may take one path away and bring another. A step depends on an earlier one only if
that writes a path which it looks at, so paths that nothing writes (a file kept over a
thousand copies), and looks before the first write, tie nothing together. Steps tied by the
rest form components. Those are folded in order, one after another in as many tasks as there
are: a task streams the sorted steps of its components and holds the paths of one. A step
alone needs no fold at all. Neither decisions nor the inventory come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlathe.storage import materialized

_ORDER = ("seq", "id", "at")


def steps(decisions: DataFrame) -> DataFrame:
    """seq, id, at (their order), kind (remove, rename), src (what may go), dst (what is kept, or
    the new name) of one collection's decisions. Renames without a name on a side are none."""
    removes = decisions.where("action = 'remove'").select("seq", "id", F.lit(0).alias("at"), F.lit("remove").alias("kind"), F.col("removed").alias("src"), F.col("kept").alias("dst"))
    renames = decisions.where("action = 'rename'").select("seq", "id", F.posexplode("renames").alias("at", "r"))
    renames = renames.select(*_ORDER, F.lit("rename").alias("kind"), F.col("r.from").alias("src"), F.col("r.to").alias("dst")).where("dst IS NOT NULL")
    return removes.unionByName(renames).where("src IS NOT NULL")


def ties(ordered: DataFrame) -> DataFrame:
    """a, b: ``node`` of each step that looks at a path, and of the first step that may write it,
    where that comes before."""
    place = F.struct(*_ORDER)
    look = lambda path, writes: F.struct(F.col(path).alias("path"), writes.alias("writes"))
    touched = ordered.select("node", place.alias("place"), F.explode(F.array(look("src", F.lit(True)), look("dst", F.col("kind") == "rename"))).alias("t")).select("node", "place", "t.*")
    first = touched.where("writes").groupBy("path").agg(F.min("place").alias("first"), F.min_by("node", "place").alias("writer"))
    return touched.join(first, "path").where("place > first").select(F.col("node").alias("a"), F.col("writer").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node connected to it) of every node with an edge (a, b). Rounds
    link each node's larger, then its smaller, neighbours to the smallest one around it until
    nothing moves: few rounds for long chains too."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def linked(pairs: DataFrame, which: Column) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = pairs.where(which).join(least, "u")
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")

    state = materialized(edges.distinct(), "ties")
    before = None
    while True:
        sums = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(sums) == before or not sums[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = tuple(sums)
        large = materialized(linked(both(state), F.col("v") > F.col("u")).distinct(), "ties")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        # the smaller neighbours, and the node itself, to the smallest
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        state = materialized(moved.where("a <> b").distinct(), "ties")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """status of each step, from steps sorted by component and order."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    out: list[tuple] = []
    for _, mine in groupby(rows(), itemgetter(0)):
        have: dict[str | None, bool] = {}
        for _, seq, id_, at, kind, src, dst, has_src, has_dst in mine:
            have.setdefault(src, has_src)
            have.setdefault(dst, has_dst)
            if not have[src]:
                status = "absent"
            elif have[dst] != (kind == "remove"):
                status = "skipped"
            else:
                status = "removed" if kind == "remove" else "renamed"
                if kind == "rename":
                    have[dst] = True
                have[src] = False
            out.append((seq, id_, at, kind, src, dst, status))
            if len(out) == 8192:
                yield _batch(out)
                out = []
    if out:
        yield _batch(out)


_FOLDED = pa.schema([("seq", pa.int64()), ("id", pa.string()), ("at", pa.int32()), ("kind", pa.string()), ("src", pa.string()), ("dst", pa.string()), ("status", pa.string())])
FOLDED_DDL = "seq long, id string, at int, kind string, src string, dst string, status string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOLDED)], schema=_FOLDED)


def replayed(decisions: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every step with its status: removed, renamed, skipped (the kept file is missing, or the new
    name is taken) or absent (nothing to do)."""
    ordered = materialized(steps(decisions).withColumn("node", F.xxhash64(*_ORDER)), "steps")
    rels = inventory.select("rel").distinct()
    known = lambda c: rels.select(F.col("rel").alias(c), F.lit(True).alias(f"has_{c}"))
    tied = components(ties(ordered))
    rows = ordered.join(known("src"), "src", "left").join(known("dst"), "dst", "left").join(tied, "node", "left")
    rows = materialized(rows.select("root", *_ORDER, "kind", "src", "dst", F.coalesce("has_src", F.lit(False)).alias("has_src"), F.coalesce("has_dst", F.lit(False)).alias("has_dst")), "placed")
    free = F.col("has_dst") == (F.col("kind") == "remove")
    status = F.when(~F.col("has_src"), "absent").when(~free, "skipped").when(F.col("kind") == "remove", "removed").otherwise("renamed")
    alone = rows.where("root IS NULL").select(*_ORDER, "kind", "src", "dst", status.alias("status"))
    together = rows.where("root IS NOT NULL").repartition("root").sortWithinPartitions("root", *_ORDER)
    return alone.unionByName(together.mapInArrow(_fold, FOLDED_DDL))


def inventory_after(replayed_steps: DataFrame, inventory: DataFrame) -> DataFrame:
    """rel of the files that are there after the steps."""
    done = replayed_steps.where("status IN ('removed', 'renamed')")
    place = lambda k: F.struct(*_ORDER, F.lit(k).alias("k"))
    gone = done.select(F.col("src").alias("rel"), place(0).alias("place"), F.lit(False).alias("there"))
    came = done.where("status = 'renamed'").select(F.col("dst").alias("rel"), place(1).alias("place"), F.lit(True).alias("there"))
    last = gone.unionByName(came).groupBy("rel").agg(F.max_by("there", "place").alias("there"))
    return inventory.select("rel").distinct().join(last, "rel", "left_anti").unionByName(last.where("there").select("rel"))


def totals(replayed_steps: DataFrame) -> DataFrame:
    """removed, renamed, skipped: how many steps ended so."""
    return replayed_steps.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("removed", "renamed", "skipped")])
