"""Digest trees against comparing every file, and the synchronisation as one command."""

import os
import random
import stat

import pytest
from pyspark.sql import functions as F

from twinlathe.errors import ConfigError, ConfirmationRequired
from twinlathe.operators import diff
from twinlathe.plans import commands
from twinlathe.sources import config, filesystem, media

DDL = "rel string, size long, mtime_ns long"


def _rows(rng, n):
    return {"/".join(rng.choice("abcd") + str(rng.randint(0, 2)) for _ in range(rng.randint(1, 4))): (rng.randint(0, 3), rng.randint(0, 3)) for _ in range(n)}


def _table(spark, rows):
    return spark.createDataFrame([(r, *v) for r, v in rows.items()], DDL)


@pytest.mark.parametrize("seed, n", [(1, 60), (2, 60), (3, 0)])
def test_descent_equals_comparing_every_file(spark, seed, n):
    rng = random.Random(seed)
    here = _rows(rng, n)
    there = {r: v for r, v in here.items() if rng.random() > 0.1} | _rows(rng, 15)
    if seed == 2:  # a file on one side, a folder of that name on the other
        here["a0"], there["a0/x"] = (1, 1), (1, 1)
    a, b = _table(spark, here), _table(spark, there)
    changes, _ = diff.descended(diff.digest_tree(a), diff.digest_tree(b))
    assert sorted(map(tuple, changes.collect())) == sorted(map(tuple, diff.tree_diff(a, b).select("rel", "change").collect()))
    assert commands.sync_status(diff.digest_tree(a), diff.digest_tree(b), "push") == commands.sync_status(a, b, "push")


def test_one_change_of_100_000_opens_few_folders(spark):
    k = F.col("id")
    rel = F.concat(F.lit("Library/"), (k % 40).cast("string"), F.lit("/"), (k % 1000).cast("string"), F.lit("/"), k.cast("string"))
    here = spark.range(100_000).select(rel.alias("rel"), (k % 999).alias("size"), k.alias("mtime_ns"))
    there = here.withColumn("size", F.when(F.col("mtime_ns") == 77_777, 5).otherwise(F.col("size")))
    mine, other = diff.digest_tree(here), diff.digest_tree(there)
    changes, levels = diff.descended(mine, other)
    assert [(r["rel"].rsplit("/", 1)[1], r["change"]) for r in changes.collect()] == [("77777", "differs")]
    # both sides' rows of the root, one source, one folder and one folder below
    assert levels.agg(F.sum("compared")).first()[0] == 2 * (1 + 40 + 25 + 100)
    assert diff.descended(mine, mine)[1].agg(F.sum("compared")).first()[0] == 2
    assert mine.where("rel = 'Library'").first()["files"] == 100_000


def test_many_open_folders_are_joined(spark, monkeypatch):
    rng = random.Random(9)
    a, b = _table(spark, _rows(rng, 50)), _table(spark, _rows(rng, 50))
    monkeypatch.setattr(diff, "LISTED", 0)
    got = diff.descended(diff.digest_tree(a), diff.digest_tree(b))[0].collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, diff.tree_diff(a, b).select("rel", "change").collect()))


def test_sync_plans_guards_asks_and_reports(tmp_path):
    both = config.SyncConfig("host", "/music", "/here/settings", "/there/settings")
    ran = []

    def run(command):
        ran.append(command)
        return 0

    with pytest.raises(ConfirmationRequired, match="collection: /r/ -> host:/music/"):
        commands.sync("/r", "push", both, run=run)
    assert not ran
    legs, warning = commands.sync("/r", "push", both, yes=True, run=run, running=lambda _: (False, None))
    assert [(x.label, x.status, x.code) for x in legs] == [("collection", "done", 0), ("settings", "done", 0)] and "could not ask" in warning
    assert ran == [x.command for x in legs] and ran[0][-2:] == ["/r/", "host:/music/"]
    for state in ((True, False), (False, True)):
        with pytest.raises(ConfigError, match="running"):
            commands.sync("/r", "pull", both, yes=True, run=run, running=lambda _, s=state: s)
    legs, warning = commands.sync("/r", "pull", config.SyncConfig("host", "/music"), dry_run=True, delete=True, run=run, running=lambda _: (True, True))
    assert [(x.label, x.status) for x in legs] == [("collection", "dry run")] and {"-n", "--delete"} <= set(legs[0].command) and warning is None
    legs, _ = commands.sync("/r", "push", both, yes=True, run=lambda _: 23, running=lambda _: (False, False))
    assert [(x.status, x.code) for x in legs] == [("failed", 23), ("planned", None)]
    with pytest.raises(ConfigError):
        commands.sync("/r", "sideways", both, yes=True, run=run)


@pytest.fixture
def printer(tmp_path, monkeypatch):
    """A stand-in for the fingerprint tool, first on PATH."""
    tool = tmp_path / "bin/fpcalc"
    tool.parent.mkdir()
    tool.write_text('#!/bin/sh\nfor last; do :; done\ncase "$last" in\n*none*) exit 1;;\n*odd*) echo "DURATION=x"; echo "FINGERPRINT=1,2";;\n*empty*) echo "DURATION=3"; echo "FINGERPRINT=";;\n*) echo "FILE=$last"; echo "DURATION=12.5"; echo "FINGERPRINT=1,-2,4294967295";;\nesac\n')
    tool.chmod(tool.stat().st_mode | stat.S_IEXEC)
    monkeypatch.setenv("PATH", f"{tool.parent}{os.pathsep}{os.environ['PATH']}")


def test_fingerprint_of_the_tool(printer):
    assert media.fingerprint("/x/a.flac") == ("1,-2,4294967295", 12.5)
    assert media.fingerprint("/x/none.flac") == (None, None)
    assert media.fingerprint("/x/odd.flac") == ("1,2", None)
    assert media.fingerprint("/x/empty.flac") == (None, None)


def test_ingest_prunes_without_promotion(spark, tmp_path):
    root = tmp_path / "root"
    for d in ("Library", "Tracks", "Incoming/empty/deep", "Incoming/full"):
        (root / d).mkdir(parents=True)
    (tmp_path / "state").mkdir()
    (root / "Incoming/full/a.flac").write_bytes(b"x")
    commands.ingest(spark, root, tmp_path / "state", spark.createDataFrame([], "id string, choice string"))
    assert not (root / "Incoming/empty").exists() and (root / "Incoming/full/a.flac").exists()
    assert filesystem.listing(spark, root).count() == 1
