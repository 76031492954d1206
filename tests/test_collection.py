import json
import math
import struct
import wave

import pytest

from twinlathe.errors import ConfigError, ConfirmationRequired
from twinlathe.operators import diff
from twinlathe.plans import commands
from twinlathe.sources import config, filesystem, media, state
from twinlathe.streaming import incremental


def make_wav(path, seed=0, seconds=0.2, rate=8000):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", int(9000 * math.sin(2 * math.pi * (440 + seed) * i / rate))) for i in range(int(seconds * rate))))


@pytest.fixture
def root(tmp_path):
    for d in ("Library", "Tracks", "Incoming"):
        (tmp_path / "root" / d).mkdir(parents=True)
    (tmp_path / "state").mkdir()
    return tmp_path / "root"


def test_scan_rescan_dedupe_replay(spark, root):
    folder = root.parent / "state"
    make_wav(root / "Library/X - Song.wav")
    make_wav(root / "Library/sub/X - Song copy.wav")
    make_wav(root / "Incoming/new.wav", seed=5)
    make_wav(root / "Incoming/.hidden/h.wav")
    (root / "Incoming/readme.txt").write_text("x")
    first = commands.scan_root(spark, root, folder)
    assert first.counters.first().asDict() == {"cached": 0, "new": 3, "stale": 0, "ignored_non_audio": 1}
    assert {r["source"]: r["n"] for r in first.counts.collect()} == {"library": 2, "tracks": 0, "incoming": 1}
    pairs = first.pairs.collect()
    assert [(p["category"], p["a_rel"], p["b_rel"]) for p in pairs] == [("EXACT_DUPLICATE", "Library/X - Song.wav", "Library/sub/X - Song copy.wav")]
    make_wav(root / "Incoming/new.wav", seed=6, seconds=0.3)
    assert commands.scan_root(spark, root, folder).counters.first().asDict() == {"cached": 2, "new": 1, "stale": 1, "ignored_non_audio": 1}

    from twinlathe.operators.decisions import decision_id
    from pyspark.sql import functions as F

    id_ = spark.range(1).select(decision_id(F.lit("Library/X - Song.wav"), F.lit("Library/sub/X - Song copy.wav"))).first()[0]
    outcome = commands.dedupe(spark, root, folder, spark.createDataFrame([(id_, "a")], "id string, choice string"))
    assert [r["outcome"] for r in outcome.collect()] == ["quarantined"]
    assert not (root / "Library/sub/X - Song copy.wav").exists() and commands.trash_list(spark, root).first()["files"] == 1
    assert commands.scan_root(spark, root, folder).pairs.count() == 0
    make_wav(root / "Library/sub/X - Song copy.wav")
    assert commands.replay(spark, root, folder) == {"removed": 1, "renamed": 0, "skipped": 0}
    assert commands.decisions_list(spark, root, folder).count() == 1 and commands.decisions_remove(spark, root, folder, id_) == 1
    with pytest.raises(ConfirmationRequired):
        filesystem.empty_trash(root)
    assert filesystem.empty_trash(root, yes=True) == 2


def test_ingest_promotes(spark, root):
    make_wav(root / "Incoming/deep/Artist - Title.wav")
    make_wav(root / "Incoming/Artist - Title.wav", seed=3)
    _, plan = commands.ingest(spark, root, root.parent / "state", spark.createDataFrame([], "id string, choice string"), promote=True)
    assert sorted(r["action"] for r in plan.collect()) == ["collision", "promoted"]
    assert (root / "Tracks/Title - Artist.wav").exists()


def test_moves_stay_inside_and_number_only_in_trash(root):
    make_wav(root / "Incoming/x.wav")
    make_wav(root / "Tracks/x.wav")
    with pytest.raises(ValueError):
        filesystem.apply_moves(root, [("Incoming/x.wav", "../x.wav")])
    assert filesystem.apply_moves(root, [("Incoming/x.wav", "Tracks/x.wav")])[0][2] == "exists"
    assert filesystem.apply_moves(root, [("Incoming/x.wav", "Tracks/x.wav")], numbered=True)[0][1] == "Tracks/x - 2.wav"
    (root / "Incoming/a/b").mkdir(parents=True)
    assert filesystem.prune(root, "incoming") == 2


def test_json_state(spark, tmp_path):
    cache = tmp_path / "c.json"
    cache.write_text(json.dumps({"version": 2, "root": "/r", "entries": {"Library/a.flac": {"size": 3, "mtime_ns": 4, "sha256": "s", "title": "T"}}}))
    assert [(r["rel"], r["size"], r["title"]) for r in state.import_cache(spark, str(cache), "/r").collect()] == [("Library/a.flac", 3, "T")]
    assert state.import_cache(spark, str(cache), "/other").count() == 0
    cache.write_text("{broken")
    assert state.import_cache(spark, str(cache), "/r").count() == 0
    doc = tmp_path / "d.json"
    doc.write_text(json.dumps({"version": 1, "root": "/r", "decisions": [{"id": "1", "action": "keep_both", "a": "x", "b": "y"}]}))
    rows = state.import_decisions(spark, str(doc), "/r")
    state.export_decisions(rows, tmp_path / "e.json", "/r")
    assert json.loads((tmp_path / "e.json").read_text()) == json.loads(doc.read_text())


def test_config_and_sync(tmp_path, monkeypatch):
    with pytest.raises(ConfigError):
        config.load_sync(tmp_path)
    (tmp_path / config.CONFIG_NAME).write_text('[sync]\nremote = "h"\nremote_root = "/m"\n')
    assert config.load_sync(tmp_path) == config.SyncConfig("h", "/m")
    (tmp_path / config.CONFIG_NAME).write_text("x = [")
    with pytest.raises(ConfigError):
        config.load_config(tmp_path)
    (tmp_path / "c/Library").mkdir(parents=True)
    assert config.detect_root(tmp_path / "c/Library") == (tmp_path / "c").resolve()
    assert diff.sync_plan("/a", "h", "/m", "pull", "/s", "/t") == [("collection", "h:/m/", "/a/"), ("settings", "h:/t/", "/s/")]
    command = diff.rsync_command("a", "b", True, True)
    assert command[:7] == ["rsync", "-a", "-e", "ssh", "--partial", "-n", "--delete"] and command[-2:] == ["a", "b"]
    assert diff.needs_confirmation(False, False) and not diff.needs_confirmation(True, False)


def test_media_without_tools(tmp_path):
    assert media.first_text([[3, 10]]) == "3" and media.first_text([]) is None and media.first_text("  ") is None
    assert media.parse_probe('{"format": {"duration": "2.5"}, "streams": [{"sample_rate": "44100"}]}') == {"duration": 2.5, "sample_rate": 44100}
    assert media.parse_probe("no") == {}
    (tmp_path / "x.flac").write_bytes(b"junk")
    assert media.read_info(str(tmp_path / "x.flac"))["title"] == ""


def test_stream_of_listings(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"rel": "Library/a.flac", "size": 1, "mtime_ns": 1}\n{"rel": "Library/b.flac", "size": 1, "mtime_ns": 1}\n')
    for step in range(2):
        if step:
            (source / "2.json").write_text('{"rel": "Library/a.flac", "size": 2, "mtime_ns": 2}\n')
        incremental.follow(spark, str(source), "/r", tmp_path / "state", str(tmp_path / "checkpoint")).awaitTermination()
    assert {(r["rel"], r["size"]) for r in state.load_cache(spark, tmp_path / "state", "/r").collect()} == {("Library/a.flac", 2), ("Library/b.flac", 1)}


def pair_id(spark, a, b):
    from pyspark.sql import functions as F

    from twinlathe.operators.decisions import decision_id

    return spark.range(1).select(decision_id(F.lit(a), F.lit(b))).first()[0]


def test_dedupe_renames_versions_and_records_them(spark, root):
    folder = root.parent / "state"
    for rel in ("Library/X - Song.wav", "Library/sub/X - Song.wav", "Tracks/Y - Tune.wav", "Library/Y - Tune.wav"):
        make_wav(root / rel, seed=9 if "Tune" in rel else 1)
    first, second = pair_id(spark, "Library/X - Song.wav", "Library/sub/X - Song.wav"), pair_id(spark, "Library/Y - Tune.wav", "Tracks/Y - Tune.wav")
    choices = spark.createDataFrame([(first, "v", "x", "live", "radio edit"), (second, "v", "b", None, " ")], commands.CHOICES_DDL)
    got = {r["id"]: r for r in commands.dedupe(spark, root, folder, choices).collect()}
    assert got[first]["outcome"] == "renamed" and got[second]["outcome"] == "cancelled"
    assert (root / "Library/Song - X [Live].wav").exists() and (root / "Library/sub/Song - X [Radio Edit].wav").exists()
    row = state.load_decisions(spark, folder, str(root)).first()
    assert row["action"] == "rename" and [tuple(r) for r in row["renames"]] == [("Library/X - Song.wav", "Library/Song - X [Live].wav"), ("Library/sub/X - Song.wav", "Library/sub/Song - X [Radio Edit].wav")]
    assert {r["a_rel"] for r in commands.scan_root(spark, root, folder).pairs.collect()} == {"Library/Y - Tune.wav"}
    make_wav(root / "Library/X - Song.wav", seed=1)
    (root / "Library/Song - X [Live].wav").unlink()
    assert commands.replay(spark, root, folder) == {"removed": 0, "renamed": 1, "skipped": 0}


def test_ingest_keeps_both_promotes_and_resolves_names(spark, root):
    folder = root.parent / "state"
    make_wav(root / "Library/A - One.wav", seed=1)
    make_wav(root / "Incoming/A - One.wav", seed=1)
    make_wav(root / "Tracks/Two - B.wav", seed=3)
    make_wav(root / "Incoming/deep/B - Two.wav", seed=4)
    make_wav(root / "Incoming/C - Three.wav", seed=5)
    id_ = pair_id(spark, "Library/A - One.wav", "Incoming/A - One.wav")
    choices = spark.createDataFrame([(id_, "k")], "id string, choice string")
    resolutions = spark.createDataFrame([("Incoming/deep/B - Two.wav", "v", "live", None)], commands.RESOLUTIONS_DDL)
    outcomes, plan = commands.ingest(spark, root, folder, choices, promote=True, resolutions=resolutions)
    assert [(r["outcome"], r["now_b"]) for r in outcomes.collect()] == [("promoted", "Tracks/One - A.wav")]
    assert {(r["rel"], r["dest"], r["action"]) for r in plan.collect()} == {
        ("Incoming/deep/B - Two.wav", "Tracks/Two - B [Live].wav", "renamed"), ("Incoming/C - Three.wav", "Tracks/Three - C.wav", "promoted"),
    }
    row = state.load_decisions(spark, folder, str(root)).first()
    assert (row["action"], row["a"], row["b"]) == ("keep_both", "Library/A - One.wav", "Tracks/One - A.wav")
    assert not (root / "Incoming/deep").exists()
    stats = __import__("twinlathe.operators.actions", fromlist=["review_stats"]).review_stats(outcomes).first()
    assert (stats["processed"], stats["promoted"], stats["remaining"]) == (1, 1, 0)


def test_state_of_two_roots(spark, tmp_path):
    """Two collections with the same paths, hence the same ids: one's state never touches the other's."""
    folder = tmp_path / "state"
    folder.mkdir()
    rows = [(r, "i1", "t", "keep_both", None, None, "x", "y", None, k) for k, r in enumerate(("/r", "/s"))] + [("/r", "i2", "t", "keep_both", None, None, "x", "z", None, 5)]
    state.save(spark.createDataFrame(rows, state.DECISION_DDL), folder, "decisions")
    left = lambda r: sorted(d["id"] for d in state.load_decisions(spark, folder, r).collect())
    assert commands.decisions_remove(spark, "/r", folder, "i1") == 1 and left("/r") == ["i2"] and left("/s") == ["i1"]
    assert commands.decisions_clear(spark, "/s", folder) == 1 and left("/s") == [] and left("/r") == ["i2"] and commands.decisions_clear(spark, "/s", folder) == 0
    cache = [(r, f"Library/{k}.flac", 1, 1, *[None] * 9) for r in ("/r", "/s") for k in range(3)]
    state.save(spark.createDataFrame(cache, state.CACHE_DDL), folder, "cache")
    assert commands.cache_status(spark, "/r", folder)["entries"] == 3 and commands.cache_status(spark, "/r", folder)["bytes"] > 0
    assert commands.cache_clear(spark, "/r", folder) == 3 and commands.cache_status(spark, "/s", folder)["entries"] == 3


def test_fingerprints_of_open_pairs(spark, root):
    """Each file of a pair that isn't exact is printed once; unknown durations are filled, differences stay."""
    from pyspark.sql import functions as F

    for rel, seed in (("Library/A - One.wav", 1), ("Tracks/A - One.wav", 2), ("Incoming/A - One.wav", 2)):
        make_wav(root / rel, seed=seed)
    pairs = commands.scan_root(spark, root, root.parent / "state").pairs.withColumn("a_duration", F.lit(None).cast("double"))
    asked = []

    def prints(files):
        asked.extend(sorted(r["rel"] for r in files.collect()))
        same = ",".join(["7"] * 8)
        return files.select("rel", F.lit(same).alias("fingerprint"), F.lit(3.5).alias("fp_duration"))

    got = {(r["a_rel"], r["b_rel"]): r for r in commands.with_fingerprints(pairs, prints).collect()}
    assert asked == ["Incoming/A - One.wav", "Library/A - One.wav", "Tracks/A - One.wav"]
    assert {r["category"] for r in got.values()} == {"EXACT_DUPLICATE", "VERY_LIKELY_SAME_RECORDING"}
    assert all(r["a_duration"] == 3.5 for r in got.values() if r["category"] != "EXACT_DUPLICATE")


def test_reports_of_pairs_and_files(spark, root):
    from twinlathe.functions import report

    for rel in ("Library/A - One.wav", "Tracks/A - One.wav"):
        make_wav(root / rel, seed=1)
    found = commands.scan_root(spark, root, root.parent / "state")
    pair = report.pair_report(found.pairs).first()
    assert pair["a_text"].startswith("A (from filename) - One (from filename)") and pair["choices"] == "a,k,v,s" and pair["title"] == "100.0%" and pair["fingerprint"] == "n/a"
    file = report.file_report(found.tracks).orderBy("rel").first()
    assert file["from_name"] == "A - One" and file["size"].endswith("KiB") and len(file["sha256"]) == 64 and file["tags"].startswith("title=— artist=—") and file["modified"].startswith("20")


def test_status_and_guard(spark):
    here = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 3, 1)], "rel string, size long, mtime_ns long")
    there = spark.createDataFrame([("a", 1, 1), ("b", 9, 1), ("d", 3, 1)], "rel string, size long, mtime_ns long")
    assert commands.sync_status(here, there, "push") == (2, ["b", "c"]) and commands.sync_status(here, there, "pull") == (2, ["b", "d"])
    assert diff.running_guard(True, None)[0] and diff.running_guard(False, True)[0]
    assert diff.running_guard(False, None) == (None, "could not ask whether the application runs on the other side") and diff.running_guard(False, False) == (None, None)
    assert set(commands.doctor()) == {"ffprobe", "fpcalc", "rsync", "ssh"}
