"""Connected components of an edge table by contraction, first within tasks, then by rounds.

``LOCAL`` edges are contracted by one task: what they connect becomes stars around the
smallest node of each piece. Where more edges are left than one task takes, a round hooks
every node to its smallest neighbour, shortens the paths by pointer jumping, and replaces
edges by edges between the nodes hooked to, which at least halves the nodes; then tasks
contract again. Every round's tables are written to the shared folder, so a lost executor
costs a part of one round. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlathe.llm.storage import Scratch

#: Edges that one task holds.
LOCAL = 1 << 20


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n points the smallest one that the pairs (a, b) connect it to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        # the labels themselves hang together too
        np.minimum.at(label, before, label.copy())
        label = label[label]
        if (label == before).all():
            return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) for the nodes of a task's edges."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held)
    ends = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks()
    nodes = pc.unique(ends)
    nodes = nodes.take(pc.sort_indices(nodes))
    place = pc.index_in(ends, nodes).to_numpy()
    roots = connected(len(nodes), *np.split(place.astype(np.int64), 2))
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(roots))], ["node", "root"])


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges``: a, b (of one orderable type). Returns node, root for each node with an edge; root is the
    smallest node of its component. Loops and repeated edges are harmless; no edges give
    an empty table."""
    kind = "binary" if edges.schema["a"].dataType.simpleString() == "binary" else "long"
    kinds = f"node {kind}, root {kind}"
    left = scratch.cut(_ordered(edges), "edges")
    roots = None
    while True:
        tasks = -(-left.count() // LOCAL)
        stars = scratch.cut(left.repartition(max(1, tasks)).mapInArrow(_stars, kinds), "stars")
        if tasks <= 1:  # the stars are whole components
            return stars if roots is None else scratch.cut(_moved(roots, stars), "roots")
        hooked = _hooked(stars.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")), scratch)
        of_a = hooked.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        of_b = hooked.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        forest = stars.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        new_left = scratch.cut(_ordered(forest.join(of_a, "a").join(of_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
        moved = hooked.withColumnRenamed("to", "root")
        new_roots = moved if roots is None else scratch.cut(_moved(roots, moved), "roots")
        scratch.drop(left, stars, *([] if roots is None else [roots]))
        left, roots = new_left, new_roots


def _moved(roots: DataFrame, moves: DataFrame) -> DataFrame:
    """``roots`` with the roots that ``moves`` (node, root) gives them."""
    to = moves.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def _hooked(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, to: each node hooked to its smallest neighbour, paths shortened twice."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    hooks = scratch.cut(ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("to")), "hooks")
    for _ in range(2):
        jump = hooks.select(F.col("node").alias("mid"), F.col("to").alias("next"))
        shorter = scratch.cut(hooks.join(jump, F.col("to") == F.col("mid")).select("node", F.col("next").alias("to")), "hooks")
        scratch.drop(hooks)
        hooks = shorter
    return hooks
