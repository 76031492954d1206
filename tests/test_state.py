"""The state's log: writers at once, changes, snapshots, other file systems."""

import threading

import pytest
from pyspark.sql import functions as F

from twinlathe.plans import commands
from twinlathe.schema import CACHE_DDL, DECISION_DDL
from twinlathe.sources import state


def _decision(spark, id_, root="/r", seq=0, action="keep_both"):
    return spark.createDataFrame([(root, id_, "now", action, None, None, "a", "b", None, seq)], DECISION_DDL).coalesce(1)


def _ids(spark, folder, root="/r"):
    return [r["id"] for r in state.load_decisions(spark, folder, root).orderBy("seq").collect()]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    def work(k):
        for n in range(3):
            state.put(_decision(spark, f"{k}-{n}"), tmp_path, "decisions")

    threads = [threading.Thread(target=work, args=(k,)) for k in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    ids = _ids(spark, tmp_path)
    assert sorted(ids) == sorted(f"{k}-{n}" for k in range(5) for n in range(3))
    for k in range(5):  # each writer's own order holds
        assert [i for i in ids if i.startswith(f"{k}-")] == [f"{k}-{n}" for n in range(3)]


def test_a_taken_number_is_not_taken_again(spark, tmp_path):
    log, other = (state.Log(spark, str(tmp_path), "decisions") for _ in range(2))
    assert log.commit("change", log.write(_decision(spark, "x"))) == 1
    # the other one still thinks that 1 is free
    assert other.head == 0 and other.commit("change", other.write(_decision(spark, "y"))) == 2
    assert _ids(spark, tmp_path) == ["x", "y"]
    assert log.head == 1 and log.commit("snapshot", log.write(log.table(DECISION_DDL)), only_after=1) is None
    assert _ids(spark, tmp_path) == ["x", "y"]


def test_one_decision_writes_one_row_and_takes_its_place_at_the_end(spark, tmp_path):
    for id_ in ("a", "b", "c"):
        state.put(_decision(spark, id_), tmp_path, "decisions")
    state.put(_decision(spark, "a", action="remove"), tmp_path, "decisions")
    last = state.Log(spark, str(tmp_path), "decisions").commits[-1]
    assert spark.read.parquet(f"{tmp_path}/decisions/{last.data}").count() == 1
    assert _ids(spark, tmp_path) == ["b", "c", "a"]
    state.remove(_decision(spark, "c").select("root", "id"), tmp_path, "decisions")
    assert _ids(spark, tmp_path) == ["b", "a"]
    state.put(_decision(spark, "c"), tmp_path, "decisions")
    assert _ids(spark, tmp_path) == ["b", "a", "c"]


def test_snapshots_keep_order_and_remove_old_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "COMPACT", 3)
    for k in range(11):
        state.put(_decision(spark, f"{k:02}"), tmp_path, "decisions")
    log = state.Log(spark, str(tmp_path), "decisions")
    assert len(log.commits) <= 4 and log.commits[0].kind == "snapshot"
    assert _ids(spark, tmp_path) == [f"{k:02}" for k in range(11)]
    assert len(list((tmp_path / "decisions").glob("data-*"))) < 11
    assert not list((tmp_path / "decisions").glob(".commit*"))


def test_a_root_is_replaced_alone(spark, tmp_path):
    row = lambda root, rel, size: (root, rel, size, *[None] * (len(CACHE_DDL.split(", ")) - 3))
    table = lambda *rows: spark.createDataFrame([row(*r) for r in rows], CACHE_DDL)
    state.put(table(("/r", "a", 1), ("/r", "b", 1), ("/s", "a", 1)), tmp_path, "cache")
    state.save_cache(table(("/r", "b", 2)).drop("root"), tmp_path, "/r")
    got = lambda: sorted((r["root"], r["rel"], r["size"]) for r in state.load(spark, tmp_path, "cache", CACHE_DDL).collect())
    assert got() == [("/r", "b", 2), ("/s", "a", 1)]
    assert state.clear(spark, tmp_path, "cache", CACHE_DDL, "/r") == 1 and got() == [("/s", "a", 1)]
    assert state.clear(spark, tmp_path, "cache", CACHE_DDL, "/r") == 0
    state.save(table(("/t", "z", 3)), tmp_path, "cache")
    assert got() == [("/t", "z", 3)] and state.size(spark, tmp_path, "cache") > 0
    assert commands.cache_status(spark, "/t", tmp_path)["entries"] == 1


def test_a_file_system_that_only_hadoop_reaches(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.states.link./kept", f"file://{tmp_path}")
    folder = "viewfs://states/kept/state"
    state.put(_decision(spark, "x"), folder, "decisions")
    state.put(_decision(spark, "y"), folder, "decisions")
    assert state.Log(spark, folder, "decisions").fs.getUri().getScheme() == "viewfs"
    assert _ids(spark, folder) == ["x", "y"] and (tmp_path / "state/decisions/commits").is_dir()
    assert commands.decisions_remove(spark, "/r", folder, "x") == 1 and commands.decisions_remove(spark, "/r", folder, "x") == 0
    assert commands.decisions_clear(spark, "/r", folder) == 1 and _ids(spark, folder) == []


@pytest.mark.parametrize("name", ["cache", "decisions"])
def test_no_table(spark, tmp_path, name):
    assert state.load(spark, tmp_path, name, {"cache": CACHE_DDL, "decisions": DECISION_DDL}[name]).where(F.col("root") == "/r").count() == 0
    assert state.size(spark, tmp_path, name) == 0
