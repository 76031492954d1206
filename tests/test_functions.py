import pytest
from pyspark.sql import functions as F

from twinlathe.functions import naming, report, similarity, text

NORMALIZED = [
    ("Why Don’t We Just Dance", "why don't we just dance"), ("Café", "café"), ("ＦＵＬＬＷＩＤＴＨ", "fullwidth"), ("  Album—Title (Deluxe)  ", "album title deluxe"),
    ("Why-Don't-We", "why don't we"), ("   spaced   out  ", "spaced out"), ("Simon & Garfunkel", "simon and garfunkel"), (None, ""), ("", ""), ("!!!", ""), ("a_b", "a_b"),
]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(NORMALIZED)], "i int, x string")
    got = [r["n"] for r in text.with_normalized(df, n=F.col("x")).orderBy("i").collect()]
    assert got == [n for _, n in NORMALIZED] == [text.normalize_text(v) for v, _ in NORMALIZED]


def test_split_feat_terms_core(spark):
    got = column(spark, ["Artist feat. Someone", "Artist featuring Someone", "Artist ft. Someone", "No Marker", None], text.split_feat)
    assert [tuple(g) for g in got] == [("Artist", "Someone")] * 3 + [("No Marker", ""), ("", "")]
    assert column(spark, ["why don't we just dance radio edit", "plain song", None], text.version_terms) == [["radio edit"], [], []]
    cores = ["why don't we just dance album version", "josh turner feat. someone", "song radio edit", "6 ft deep"]
    assert column(spark, cores, text.core_of) == ["why don't we just dance", "josh turner", "song", "6"]


def test_guess_from_stem(spark):
    stems = ["Josh Turner - Song Name", "01 - Josh Turner - Song Name", "Josh Turner – Song Name", "JustASong", "", "12", "A - B - C"]
    assert [tuple(g) for g in column(spark, stems, text.guess_from_stem)] == [
        ("Josh Turner", "Song Name"), ("Josh Turner", "Song Name"), ("Josh Turner", "Song Name"), (None, "JustASong"), (None, None), (None, None), ("A", "B C"),
    ]


@pytest.mark.parametrize(("title", "expected"), [
    ("Song (Clean Radio Edit)", ("Song", "Clean Radio Edit")), ("Levitating [The Blessed Madonna Remix]", ("Levitating", "The Blessed Madonna Remix")),
    ("I Don't Have To Be Me ('Til Monday)", ("I Don't Have To Be Me ('Til Monday)", "")), ("Song - Radio Edit", ("Song", "Radio Edit")), ("Song", ("Song", "")),
    ("Song clean version", ("Song", "Clean Version")), ("Song (clean version)", ("Song", "Clean")), ("Live", ("", "Live")), ("", ("", "")), (None, ("", "")),
])
def test_split_version(spark, title, expected):
    df = naming.with_version(spark.createDataFrame([(title,)], "t string"), F.col("t"))
    assert tuple(df.select("_base", naming.label(F.col("_versions"))).first()) == expected


def test_versions_beyond_ascii_and_repeated_phrases(spark):
    titles = ["Ｓｏｎｇ ＬＩＶＥ", "Été - Remastered", "Song - - Live", "Song Live Radio Edit", "Song (Live) [Edit]", "Radio Edit Live", "DJ Intro clean radio edit", "a – Live –"]
    df = naming.with_version(spark.createDataFrame(list(enumerate(titles)), "i int, t string"), F.col("t"))
    got = [tuple(r) for r in df.orderBy("i").select("_base", naming.label(F.col("_versions"))).collect()]
    assert got == [("Ｓｏｎｇ", "Live"), ("Été", "Remaster"), ("Song", "Live"), ("Song", "Live Radio Edit"), ("Song", "Live Edit"), ("", "Radio Edit Live"), ("", "DJ Intro Clean Radio Edit"), ("a", "Live")]


def test_one_copy_of_each_step_in_the_plan(spark):
    from twinlathe.operators import actions

    df = spark.createDataFrame([("a.flac", "t", "x", "y", "z")], "rel string, title string, artist string, filename_title string, filename_artist string")
    plan = actions.with_track_names(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_append") <= 4 * 2  # two branches (with and without Python), each with one artist


def test_canonical_versions(spark):
    got = column(spark, ["RADIO EDIT", "clean version", "original version", "dj intro clean", "dj foo", None], lambda c: naming.canonicalize_version(F.array(c)))
    assert got == ["Radio Edit", "Clean", "", "DJ Intro Clean", "DJ Foo", ""]


def test_sanitize_and_artist(spark):
    assert column(spark, ['a/b:c*?"<>|\\', None, " . x . "], naming.sanitize) == ["abc", "", "x"]
    long = ", ".join(f"Artist {i:02d}" for i in range(12))
    got = column(spark, ["A, A, B", "Mark Ronson feat. Bruno Mars", "A, B, A feat. B", long, "", ","], naming.simplify_artist)
    assert got[:3] == ["A, B", "Mark Ronson feat. Bruno Mars", "A, B, A feat. B"]
    assert len(got[3]) <= 78 and got[3].endswith("…") and got[4] == ""


def test_fingerprints(spark):
    import base64

    enc = lambda ws: base64.b64encode(b"".join(w.to_bytes(4, "big") for w in ws)).decode()
    d, o = 0xDEADBEEF, 0x11111111
    pairs = [
        (enc([d] * 16), enc([d] * 16), 1.0), (",".join([str(d)] * 8), enc([o] * 4 + [d] * 8), None), (enc([d] * 8), enc([o] * 4 + [d] * 8), 1.0), ("", enc([d]), None), (None, "1,2", None), ("!!", "1,2", None),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    sim = similarity.fingerprint_similarity(similarity.decode_fingerprint(F.col("a")), similarity.decode_fingerprint(F.col("b")))
    got = [r["s"] for r in df.select("i", sim.alias("s")).orderBy("i").collect()]
    assert got[0] == got[1] == got[2] == 1.0 and got[3:] == [None] * 3
    far = spark.createDataFrame([(enc([d] * 8), enc([0x12345678] * 8))], "a string, b string").select(sim.alias("s")).first()["s"]
    assert far < 0.5
    words = column(spark, ["4294967295,7, x,12", enc([4294967295, 1])], similarity.decode_fingerprint)
    assert words == [[4294967295, 7, 12], [4294967295, 1]]


def test_text_similarity():
    assert similarity.text_similarity("abc", "abc") == 1.0
    assert similarity.text_similarity("", "abc") == similarity.text_similarity(None, "x") == 0.0
    assert similarity.text_similarity("b a", "a b") == 1.0
    assert similarity.indel_ratio("abcd", "abxd") == 0.75


def test_reports(spark):
    assert column(spark, [209.2, 0.0, None, -3.0, 59.95], report.fmt_duration, "double") == ["3:29.2", "0:00.0", "unknown", "0:00.0", "1:00.0"]
    assert column(spark, [5, 1024, 32000, 5 << 20, 3 << 40], report.fmt_bytes, "long") == ["5 B", "1.0 KiB", "31.2 KiB", "5.0 MiB", "3072.0 GiB"]
