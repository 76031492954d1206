"""Recorded decisions: upsert, deletion, replay plans and resolved pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlathe.schema import ACTIONS


def decision_id(a: Column, b: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", F.array_sort(F.array(a, b))).cast("binary")), 1, 10)


def upsert(recorded: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row (largest seq) of each (root, id); it takes its place at the end."""
    newest = F.row_number().over(Window.partitionBy("root", "id").orderBy(F.col("seq").desc()))
    return recorded.unionByName(new, allowMissingColumns=True).withColumn("_n", newest).where("_n = 1").drop("_n")


def deleted(recorded: DataFrame, root: str, id_: str | None = None) -> DataFrame:
    """Without one decision of a root (ids hash paths below it, so roots may share them), or without all of its."""
    mine = F.col("root") == root
    return recorded.where(~(mine if id_ is None else mine & (F.col("id") == id_)))


def entries(done: DataFrame, root: str, created: Column, after: int) -> DataFrame:
    """Decisions for actions carried out: ``done`` has n (order), action, a, b and, by action,
    kept and removed, or renames. A rename without renames changes nothing and is dropped."""
    remove, rename = F.col("action") == "remove", F.col("action") == "rename"
    first, second = F.when(remove, F.col("kept")).otherwise(F.col("a")), F.when(remove, F.col("removed")).otherwise(F.col("b"))
    return done.where(~rename | (F.size("renames") > 0)).select(
        F.lit(root).alias("root"), decision_id(first, second).alias("id"), created.alias("created"), "action",
        F.when(remove, F.col("kept")).alias("kept"), F.when(remove, F.col("removed")).alias("removed"),
        F.when(~remove, F.col("a")).alias("a"), F.when(~remove, F.col("b")).alias("b"), F.when(rename, F.col("renames")).alias("renames"), (F.col("n") + after + 1).alias("seq"),
    )


def _known(inventory: DataFrame, name: str) -> DataFrame:
    return inventory.select(F.col("rel").alias(name)).distinct().withColumn(f"has_{name}", F.lit(True))


def replay_removals(decisions: DataFrame, inventory: DataFrame) -> DataFrame:
    """id, kept, removed, status: removed, skipped (kept file missing) or absent."""
    mine = decisions.where(F.col("action") == "remove").select("id", "kept", "removed")
    joined = mine.join(_known(inventory, "removed"), "removed", "left").join(_known(inventory, "kept"), "kept", "left")
    status = F.when(F.col("has_removed").isNull(), "absent").when(F.col("has_kept").isNull(), "skipped").otherwise("removed")
    return joined.select("id", "kept", "removed", status.alias("status"))


def replay_renames(decisions: DataFrame, inventory: DataFrame) -> DataFrame:
    """id, from, to, status: renamed, skipped (target exists) or absent."""
    mine = decisions.where(F.col("action") == "rename").select("id", F.explode("renames").alias("r")).select("id", F.col("r.from").alias("src"), F.col("r.to").alias("dst"))
    joined = mine.join(_known(inventory, "src"), "src", "left").join(_known(inventory, "dst"), "dst", "left")
    status = F.when(F.col("has_src").isNull(), "absent").when(F.col("has_dst").isNotNull(), "skipped").otherwise("renamed")
    return joined.select("id", F.col("src").alias("from_rel"), F.col("dst").alias("to_rel"), status.alias("status"))


def replay(decisions: list[dict], inventory: set[str]) -> tuple[set[str], dict[str, int], list[str]]:
    """Decisions applied in order, each to the inventory that the last one left: (inventory,
    counts, warnings). For the few recorded decisions of one collection, on the driver."""
    have, counts, warnings = set(inventory), {"removed": 0, "renamed": 0, "skipped": 0}, []

    def skip(text: str) -> None:
        counts["skipped"] += 1
        warnings.append(text)

    for d in decisions:
        if d["action"] == "remove" and d["removed"] in have:
            if d["kept"] in have:
                have.discard(d["removed"])
                counts["removed"] += 1
            else:
                skip(f"decision {d['id']}: kept file is missing ({d['kept']})")
        for r in d["renames"] or [] if d["action"] == "rename" else []:
            if r["from"] not in have:
                continue
            if r["to"] in have:
                skip(f"decision {d['id']}: '{r['to']}' already exists")
                continue
            have.discard(r["from"])
            have.add(r["to"])
            counts["renamed"] += 1
    return have, counts, warnings


def resolved_pairs(decisions: DataFrame, inventory: DataFrame) -> DataFrame:
    """a, b (sorted) of every decided pair, renamed members by their present name."""
    valid = decisions.where(F.col("action").isin(*ACTIONS))
    kept = valid.where("action = 'remove'").select(F.col("kept").alias("a"), F.col("removed").alias("b"))
    both = valid.where("action = 'keep_both'").select("a", "b")
    moves = valid.where("action = 'rename'").select("id", "a", "b", F.posexplode_outer("renames").alias("at", "r"))
    there = _known(inventory, "dst")
    moves = moves.select("id", "a", "b", "at", F.col("r.from").alias("src"), F.col("r.to").alias("dst")).join(there, "dst", "left")
    now = F.when(F.col("has_dst").isNotNull(), F.col("dst")).otherwise(F.col("src"))
    usable = (F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != "")
    first = lambda side: F.min_by(F.when(usable & (F.col("src") == F.col(side)), now), F.when(usable & (F.col("src") == F.col(side)), F.col("at")))
    per = moves.groupBy("id", "a", "b").agg(
        first("a").alias("now_a"), first("b").alias("now_b"), F.count_if(usable).alias("n"),
        F.array_sort(F.collect_set(F.when(usable, now))).alias("nows"),
    )
    named = (F.coalesce("a", F.lit("")) != "") & (F.coalesce("b", F.lit("")) != "")
    renamed = per.where(named).select(F.coalesce("now_a", "a").alias("a"), F.coalesce("now_b", "b").alias("b"))
    legacy = per.where(~named & (F.col("n") >= 2) & (F.size("nows") == 2)).select(F.col("nows")[0].alias("a"), F.col("nows")[1].alias("b"))
    every = kept.unionByName(both).unionByName(renamed).unionByName(legacy).where((F.coalesce("a", F.lit("")) != "") & (F.coalesce("b", F.lit("")) != ""))
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
