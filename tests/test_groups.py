"""Candidates made from groups of equal tracks, against making every pair."""

import itertools
import random
from pathlib import Path

from pyspark.sql import functions as F

from twinlathe import storage
from twinlathe.operators import actions, linkage, scan
from twinlathe.plans import catalogue

DDL = "rel string, source string, title string, artist string, duration double, sha256 string, fingerprint string"


def _rows(n):
    rng = random.Random(5)
    return [
        (f"{(s := rng.choice(['Library', 'Tracks', 'Incoming']))}/{rng.choice(['a', 'a b', 'a-'])}/{k}.flac", s.lower(), rng.choice(["Song (Live)", "Song"]), "X", rng.choice([100.0, 150.0, None]), rng.choice(["s", None]), None)
        for k in range(n)
    ]


def test_pairs_of_small_and_cut_groups(spark, monkeypatch):
    monkeypatch.setattr(linkage, "MEMBERS", 3)
    rows = _rows(90)
    rng = random.Random(6)
    hub = rows[0][0]
    decided = [(hub, r[0]) for r in rows[1:40]] + [(rng.choice(rows)[0], rng.choice(rows)[0]) for _ in range(80)] + [("gone", hub)]
    place = lambda r: (("library", "tracks", "incoming").index(r[1]), r[0].split("/"))
    want = {(a[0], b[0], 0 if a[5] and a[5] == b[5] else 1) for a, b in itertools.combinations(sorted(rows, key=place), 2)}
    tracks = scan.featured(spark.createDataFrame(rows, DDL))
    got = [(r["a_rel"], r["b_rel"], r["stage"]) for r in linkage.candidates(tracks).select("a_rel", "b_rel", "stage").collect()]
    assert sorted(got) == sorted(want)
    keys = {frozenset(p) for p in decided}
    left = [(r["a_rel"], r["b_rel"], r["stage"]) for r in linkage.candidates(tracks, spark.createDataFrame(decided, "a string, b string"), ()).select("a_rel", "b_rel", "stage").collect()]
    assert sorted(left) == sorted(p for p in want if frozenset(p[:2]) not in keys)


def test_no_pair_is_written(spark):
    folder = Path(storage.shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.glob("pairs-*")}
    assert linkage.candidates(scan.featured(spark.createDataFrame(_rows(30), DDL))).count() == 30 * 29 // 2
    assert {p.name for p in folder.glob("pairs-*")} == before


def test_pairs_that_share_an_id_are_named_once(spark):
    pairs = spark.createDataFrame([("1", f"Tracks/{k}.flac", "Song", "X", "", "", f"Tracks/{k}b.flac", "Song", "X", "", "") for k in "pq"], ", ".join(["id string"] + [f"{s}_{c} string" for s in "ab" for c in ("rel", "title", "artist", "filename_title", "filename_artist")]))
    choices = spark.createDataFrame([("1", "v", "x", "live", "club mix")] * 2, "id string, choice string, which string, label_a string, label_b string")
    assert sorted(r["rel"] for r in actions.version_plan(pairs, choices).collect()) == ["Tracks/p.flac", "Tracks/pb.flac", "Tracks/q.flac", "Tracks/qb.flac"]


def test_numbers_without_an_end(spark):
    files = spark.range(1500).select(F.format_string("X/%05d/same.flac", "id").alias("rel"), F.lit("library").alias("source"))
    got = {r["rel"]: r["dest"] for r in actions.quarantine_plan(files, "D", last=None).collect()}
    assert got["X/00998/same.flac"] == ".Trash/D/library/same - 999.flac" and got["X/01499/same.flac"] == ".Trash/D/library/same - 1500.flac"
    assert len(set(got.values())) == 1500


def _queue(pairs):
    return sorted((r["rank"], r["a_rel"], r["b_rel"], r["category"]) for r in pairs.select("a_rel", "b_rel", "category", "rank").collect())


def test_the_queue_of_cut_groups_and_pieces(spark, monkeypatch):
    rng = random.Random(8)
    rows = [
        (f"{rng.choice(['Library', 'Tracks', 'Incoming', 'Else'])}/{rng.choice(['a', 'a b', 'a-', 'Ä', 'b/c'])}/{k}.flac", rng.choice(["library", "tracks", "incoming", "else", None]), rng.choice(["Song (Live)", "Song", "Other", "Other [Remix]", "", None]),
         rng.choice(["X", "X", "X|Song", None]), rng.choice([100.0, 150.0, None]), rng.choice(["s", "t", "", None, None]), None)
        for k in range(160)
    ]
    tracks = scan.featured(spark.createDataFrame(rows, DDL))
    want = _queue(linkage.ranked(linkage.candidates(tracks)))
    assert [r[0] for r in want] == list(range(1, len(want) + 1)) and len({r[3] for r in want}) == 3
    assert _queue(linkage.ranked_candidates(tracks)) == want
    monkeypatch.setattr(linkage, "MEMBERS", 3)
    monkeypatch.setattr(linkage, "PIECE", 7)
    assert _queue(linkage.ranked_candidates(tracks)) == want
    assert linkage.ranked_candidates(tracks.limit(0)).count() == 0


def test_the_queue_writes_no_pairs(spark, tmp_path):
    """Three hundred copies of a part make some 37,000 pairs; what is written for them are rows of tracks."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(1)
    spark.range(300).crossJoin(part.drop("p_partkey")).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    folder = Path(storage.shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.glob("*")}
    queue = catalogue.QUERIES["ranked_review_queue"](spark, str(tmp_path))
    written = {p.name: spark.read.parquet(f"file:{p}").count() for p in folder.glob("*") if p.name not in before}
    assert queue.count() == 272 * 271 // 2
    assert written and max(written.values()) <= 300
