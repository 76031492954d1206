"""Names given to files one after another, against giving them one after another."""

import random

import pytest
from pyspark.sql import functions as F

from twinlathe.operators import actions


def _plain(files, taken):
    have, out = set(taken), {}
    for rel, source in sorted(files, key=lambda f: (("library", "tracks", "incoming").index(f[1]), f[0].split("/"))):
        name = rel.rsplit("/", 1)[-1]
        dot = name.rfind(".")
        start, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        base = f".Trash/D/{source}/"
        names = [base + name] + [f"{base}{start} - {n}{ext}" for n in range(2, 1000)]
        out[rel] = next((n for n in names if n not in have), None)
        have.add(out[rel])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_naming_in_order(spark, seed):
    rng = random.Random(seed)
    ends = ["", " - 2", " - 3", " - 2 - 2", " - 10", " - 1000", " - 02", " - 1"]
    names = [f"{s}{e}{x}" for s in ("a", "b c") for e in ends for x in (".flac", ".mp3", "")] + [".hidden"]
    files = [(f"{rng.choice('pqr')}/{k}/{rng.choice(names)}", rng.choice(["library", "incoming"])) for k in range(250)]
    taken = [f".Trash/D/{rng.choice(['library', 'incoming'])}/{rng.choice(names)}" for _ in range(20)] + [".Trash/D/tracks/z"]
    got = actions.quarantine_plan(spark.createDataFrame(files, "rel string, source string"), "D", spark.createDataFrame([(t,) for t in taken], "dest string"))
    assert {r["rel"]: r["dest"] for r in got.collect()} == _plain(files, taken)


def test_a_name_that_many_files_want(spark):
    files = spark.range(5000).select(F.format_string("X/%05d/same.flac", "id").alias("rel"), F.lit("library").alias("source")).repartition(8)
    plan = actions.quarantine_plan(files, "D")
    got = {r["rel"]: r["dest"] for r in plan.collect()}
    assert len(got) == 5000 and sum(v is None for v in got.values()) == 5000 - 999
    assert got["X/00000/same.flac"] == ".Trash/D/library/same.flac" and got["X/00998/same.flac"] == ".Trash/D/library/same - 999.flac" and got["X/00999/same.flac"] is None
    # each task keeps its first 999 before the shuffle
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
