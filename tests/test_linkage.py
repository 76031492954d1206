import pytest
from pyspark.sql import functions as F

from twinlathe.operators import actions, decisions, linkage, scan

DDL = "rel string, source string, title string, artist string, duration double, sha256 string, fingerprint string"


def tracks(spark, *rows):
    names = ("rel", "source", "title", "artist", "duration", "sha256", "fingerprint")
    return scan.featured(spark.createDataFrame([tuple(r.get(n, "" if n in ("title", "artist") else None) for n in names) for r in rows], DDL))


def track(rel, **values):
    return {"rel": rel, "source": rel.split("/")[0].lower(), **values}


def test_candidates(spark):
    t = tracks(
        spark, track("Library/a.flac", title="Song", artist="X", duration=209.2), track("Incoming/b.flac", title="Song", artist="X", duration=209.3),
        track("Library/c.flac", title="Song One", artist="A"), track("Incoming/d.flac", title="Totally Different", artist="B"),
        track("Incoming/Josh Turner - Song Name.flac"), track("Library/e.flac", title="Song Name", artist="Josh Turner"),
    )
    got = {(r["a_rel"], r["b_rel"]): r for r in linkage.candidates(t).collect()}
    assert set(got) == {("Library/a.flac", "Incoming/b.flac"), ("Library/e.flac", "Incoming/Josh Turner - Song Name.flac")}
    first = got["Library/a.flac", "Incoming/b.flac"]
    assert first["title_sim"] == 1.0 and abs(first["duration_diff"] - 0.1) < 1e-9 and first["dur_close"]
    resolved = spark.createDataFrame([("Incoming/b.flac", "Library/a.flac")], "a string, b string")
    assert linkage.candidates(t, resolved).count() == 1


def test_groups_of_more_than_two_and_path_order(spark):
    t = tracks(spark, *[track(p, sha256="s") for p in ("Tracks/A b/c.flac", "Tracks/A/d.flac", "Library/z.flac")])
    got = {(r["a_rel"], r["b_rel"]) for r in linkage.exact_pairs(t).collect()}
    assert got == {("Library/z.flac", "Tracks/A/d.flac"), ("Library/z.flac", "Tracks/A b/c.flac"), ("Tracks/A/d.flac", "Tracks/A b/c.flac")}
    assert [r["keep"] for r in linkage.duplicate_groups(t).collect()] == ["Library/z.flac"]


@pytest.mark.parametrize(("titles", "durations", "sha", "fp", "category", "note"), [
    (("Same Song", "Same Song"), (200.0, 200.0), "s", None, "EXACT_DUPLICATE", "byte-identical"),
    (("Same Song", "Same Song"), (200.0, 200.0), None, 0.95, "VERY_LIKELY_SAME_RECORDING", "agree"),
    (("Same Song", "Same Song"), (200.0, 200.0), None, 0.70, "POSSIBLE_SAME_RECORDING", "partially"),
    (("Same Song", "Same Song"), (200.0, 200.0), None, 0.10, "POSSIBLE_ALTERNATE_VERSION", "differ"),
    (("Song (Radio Edit)", "Song (Album Version)"), (200.0, 200.0), None, 0.10, "POSSIBLE_ALTERNATE_VERSION", "version term"),
    (("Same Song", "Same Song"), (200.0, 200.0), None, None, "POSSIBLE_SAME_RECORDING", "no fpcalc"),
    (("Song (Radio Edit)", "Song (Album Version)"), (200.0, 300.0), None, None, "POSSIBLE_ALTERNATE_VERSION", "version term"),
    (("Song (Radio Edit)", "Song (Album Version)"), (None, 300.0), None, None, "POSSIBLE_SAME_RECORDING", "version term"),
])
def test_classification(spark, titles, durations, sha, fp, category, note):
    t = tracks(spark, track("Library/a.flac", title=titles[0], artist="X", duration=durations[0], sha256=sha), track("Incoming/b.flac", title=titles[1], artist="X", duration=durations[1], sha256=sha))
    pairs = linkage.scored(linkage.exact_pairs(t) if sha else linkage.blocked_pairs(t))
    row = linkage.classified(pairs.withColumn("fp_sim", F.lit(fp).cast("double"))).first()
    assert row["category"] == category and note in row["note"]


def decision(spark, *rows):
    names = ("id", "action", "kept", "removed", "a", "b", "renames")
    full = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(full, "id string, action string, kept string, removed string, a string, b string, renames array<struct<`from`: string, `to`: string>>")


def test_resolved_pairs(spark):
    rows = decision(
        spark, {"id": "1", "action": "remove", "kept": "b", "removed": "a"}, {"id": "2", "action": "keep_both", "a": "c", "b": "d"},
        {"id": "3", "action": "rename", "a": "e", "b": "f", "renames": [("e", "e2"), ("x", "y")]}, {"id": "4", "action": "rename", "a": "g", "b": "h", "renames": [("g", "g2")]},
        {"id": "5", "action": "rename", "renames": [("k", "k2"), ("l", "l2")]}, {"id": "6", "action": "other", "a": "q", "b": "r"},
    )
    have = spark.createDataFrame([("e2",), ("l2",)], "rel string")
    assert {tuple(r) for r in decisions.resolved_pairs(rows, have).collect()} == {("a", "b"), ("c", "d"), ("e2", "f"), ("g", "h"), ("k", "l2")}


def test_replay_in_order():
    rows = [
        {"id": "1", "action": "remove", "kept": "a", "removed": "b", "renames": None}, {"id": "2", "action": "remove", "kept": "b", "removed": "a", "renames": None},
        {"id": "3", "action": "remove", "kept": "x", "removed": "a", "renames": None}, {"id": "4", "action": "rename", "renames": [{"from": "c", "to": "d"}, {"from": "e", "to": "d"}]},
    ]
    have, counts, warnings = decisions.replay(rows, {"a", "b", "c", "e"})
    assert have == {"a", "d", "e"} and counts == {"removed": 1, "renamed": 1, "skipped": 3} and len(warnings) == 3


def test_library_is_protected(spark):
    pairs = spark.createDataFrame([("1", "Library/a", "library", "Incoming/b", "incoming"), ("2", "Library/a", "library", "Library/c", "library")], "id string, a_rel string, a_source string, b_rel string, b_source string")
    choices = spark.createDataFrame([("1", "b"), ("2", "b")], "id string, choice string")
    got = {r["id"]: (r["outcome"], r["recorded"], r["remove_rel"]) for r in actions.review_outcomes(pairs, choices).collect()}
    assert got == {"1": ("refused", False, None), "2": ("quarantined", True, "Library/a")}


def test_collisions(spark):
    clash = spark.createDataFrame([(c, "Tracks/Song - X.flac") for c in ("v", "e", "b", "s", "w")], "rel string, dest string")
    answers = spark.createDataFrame([("v", "v", "live", None), ("e", "e", None, "radio edit"), ("b", "b", "live", "clean"), ("s", "s", None, None), ("w", "b", "live", "Live")], "rel string, choice string, incoming string, existing string")
    got = {r["rel"]: (r["action"], r["incoming_dest"], r["existing_dest"]) for r in actions.resolved_collisions(clash, answers).collect()}
    assert got["v"] == ("renamed", "Tracks/Song - X [Live].flac", None)
    assert got["e"] == ("renamed-existing", "Tracks/Song - X.flac", "Tracks/Song - X [Radio Edit].flac")
    assert got["b"] == ("renamed-both", "Tracks/Song - X [Live].flac", "Tracks/Song - X [Clean].flac")
    assert got["s"][0] == got["w"][0] == "skipped"


def test_track_names(spark):
    rows = [
        ("Incoming/nested/deep song.flac", "", "", "deep song.flac"), ("Incoming/Josh Turner - Why Don't We Just Dance.flac", "", "", "Why Don't We Just Dance - Josh Turner.flac"),
        ("Incoming/x.FLAC", "Cheerleader (Felix Jaehn Remix Radio Edit)", "OMI", "Cheerleader - OMI [Felix Jaehn Remix Radio Edit].flac"),
        ("Incoming/y.flac", "Levitating (Clean Radio Edit)", "Dua Lipa", "Levitating - Dua Lipa [Clean Radio Edit].flac"), ("Incoming/z.flac", "Yeah!", "Usher", "Yeah! - Usher.flac"),
    ]
    named = actions.with_track_names(tracks(spark, *[track(r, title=t, artist=a) for r, t, a, _ in rows]))
    assert {r["rel"]: r["name"] for r in named.collect()} == {r: n for r, _, _, n in rows}


def test_classes_count_pairs_that_are_never_made(spark):
    import random

    from twinlathe.schema import CATEGORIES

    rng = random.Random(7)
    rows = [track(f"{rng.choice(['Library', 'Tracks', 'Incoming'])}/{k}.flac", title=rng.choice(["Song (Live)", "Song", "Song [Remix]", ""]), artist="X", duration=rng.choice([100.0, 101.0, 150.0, None]),
                  sha256=rng.choice(["s", "t", None, None, None, ""])) for k in range(120)]
    t = tracks(spark, *rows)
    resolved = spark.createDataFrame([(r["rel"], rng.choice(rows)["rel"]) for r in rows[:60]] + [("Library/none", rows[0]["rel"])], "a string, b string")
    for done in (None, resolved):
        found = linkage.candidates(t, done)
        plain = {r["category"]: r["n"] for r in linkage.category_counts(found).collect()}
        assert {r["category"]: r["n"] for r in linkage.class_category_counts(t, done).collect()} == plain and len(plain) >= 3
    made = linkage.expanded(linkage.class_pairs(t), t)
    assert sorted(map(tuple, made.collect())) == sorted((r["a_rel"], r["b_rel"], r["category"]) for r in linkage.candidates(t).collect() if r["stage"] == 1)
    # three thousand copies without a hash: one class, one row, millions of pairs
    copies = spark.range(3000).select(F.concat(F.lit("Library/"), F.col("id").cast("string"), F.lit(".flac")).alias("rel"), F.lit("library").alias("source"), F.lit("Song").alias("title"), F.lit("X").alias("artist"),
                                      F.lit(1.5).alias("duration"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("fingerprint"))
    one = linkage.class_pairs(scan.featured(copies)).collect()
    assert [(r["a_class"] == r["b_class"], r["pairs"], r["category"]) for r in one] == [(True, 3000 * 2999 // 2, CATEGORIES[2])]
