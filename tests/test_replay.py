"""Replay by components against replaying one decision after another."""

import random

from pyspark.sql import functions as F

from twinlathe.operators import decisions, replay

DDL = "id string, action string, kept string, removed string, a string, b string, renames array<struct<`from`: string, `to`: string>>, seq long"


def _decisions(seed, n, paths):
    rng = random.Random(seed)
    path = lambda: rng.choice(paths)
    out = []
    for k in range(n):
        action = rng.choice(["remove", "rename", "rename", "keep_both"])
        row = {"id": f"{k:05}", "action": action, "seq": k, "kept": None, "removed": None, "a": None, "b": None, "renames": None}
        if action == "remove":
            row |= {"kept": path(), "removed": path()}
        elif action == "rename":
            row["renames"] = [{"from": path(), "to": path()} for _ in range(rng.randint(0, 3))]
        out.append(row)
    return out


def _same(spark, rows, have):
    after, counts, _ = decisions.replay(rows, have)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    table = spark.createDataFrame([tuple(r[c.split()[0].strip()] for c in ("id", "action", "kept", "removed", "a", "b", "renames", "seq")) for r in shuffled], DDL).repartition(3)
    inventory = spark.createDataFrame([(r,) for r in have], "rel string")
    done = replay.replayed(table, inventory).cache()
    assert replay.totals(done).first().asDict() == {k: counts[k] for k in ("removed", "renamed", "skipped")}
    assert {r["rel"] for r in replay.inventory_after(done, inventory).collect()} == after
    done.unpersist()


def test_equals_replay_in_order(spark):
    for seed, n, paths in ((1, 120, 12), (2, 150, 60), (3, 100, 400)):
        names = [f"Library/{k}" for k in range(paths)]
        _same(spark, _decisions(seed, n, names), set(random.Random(seed).sample(names, paths // 2)))


def test_long_chain_and_no_decisions(spark):
    n = 300
    rows = [{"id": str(k), "action": "rename", "seq": k, "kept": None, "removed": None, "a": None, "b": None, "renames": [{"from": f"p{k}", "to": f"p{k + 1}"}]} for k in range(n)]
    _same(spark, rows, {"p0"})
    _same(spark, list(reversed([r | {"seq": n - r["seq"]} for r in rows])), {f"p{k}" for k in range(0, n, 2)})
    _same(spark, [], {"p0"})


def test_a_file_that_all_keep_ties_nothing(spark):
    rows = [(f"{k}", "remove", "kept", f"copy{k}", None, None, None, k) for k in range(50)] + [("x", "remove", "other", "kept", None, None, None, 99)]
    ordered = replay.steps(spark.createDataFrame(rows, DDL)).withColumn("node", F.xxhash64("seq", "id", "at"))
    assert replay.ties(ordered).count() == 0
    # a look after the write is tied to it
    late = [("y", "remove", "kept", "copy0", None, None, None, 100)]
    ordered = replay.steps(spark.createDataFrame(rows + late, DDL)).withColumn("node", F.xxhash64("seq", "id", "at"))
    assert replay.ties(ordered).count() == 2


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in replay.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
