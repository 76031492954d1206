"""Bounds that spare work: of text similarity, and of files that differ early."""

import hashlib
import random

from pyspark.sql import functions as F

from twinlathe.functions import similarity
from twinlathe.sources import filesystem


def _names(seed, n):
    rng = random.Random(seed)
    words = ["love", "song", "night", "été", "日本", "remix", "of", "the", "a a a a a a a a a a", "xyz", "  two ", "tab\tbed", "nbsp x", "Love", "😀"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(n)]


def test_no_pair_is_refuted_wrongly(spark):
    names = _names(1, 60)
    pairs = [(a, b) for a in names for b in names if a != b] + [(names[0], names[1])] * 5 + [(None, "x"), ("x", "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    plain = {(min(a, b, key=str.encode), max(a, b, key=str.encode)): similarity.text_similarity(a, b) for a, b in pairs if a and b}
    bounds = {(r["a"], r["b"]): r["bound"] for r in similarity.bounded(df).collect()}
    assert set(bounds) == set(plain)
    assert all(bounds[k] >= plain[k] - 1e-12 for k in plain)
    for least in (0.3, 0.6, 0.9):
        got = {(r["a"], r["b"]): r["sim"] for r in similarity.alike(df, least).collect()}
        assert got.keys() == {k for k, v in plain.items() if v >= least} and all(abs(plain[k] - v) < 1e-12 for k, v in got.items())


def test_most_unlike_pairs_are_refuted(spark):
    rng = random.Random(2)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.randint(5, 40))).strip() for _ in range(150)]
    df = spark.createDataFrame([(a, b) for a in names for b in names if a < b], "a string, b string")
    share = similarity.bounded(df).agg(F.avg((F.col("bound") < 0.6).cast("int"))).first()[0]
    assert share > 0.5


def test_files_that_differ_early_are_not_read_whole(spark, tmp_path):
    big, rng = 2 * filesystem.PEEK + filesystem.PEEKS * filesystem.PEEK_BETWEEN + 100_000, random.Random(3)
    body = rng.randbytes(big)
    late = bytearray(body)
    late[filesystem.PEEK + filesystem.PEEK_BETWEEN + 7] ^= 1  # between the places looked at
    contents = {"a": body, "b": body, "late": bytes(late), "head": b"x" + body[1:], "tail": body[:-1] + b"x", "small1": b"1" * 50, "small2": b"2" * 50, "small3": b"2" * 50, "alone": b"z" * 77, "empty1": b"", "empty2": b""}
    rows = []
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
        rows.append((str(tmp_path / name), name, len(data), None))
    rows += [(str(tmp_path / "a"), "known", big, hashlib.sha256(body).hexdigest()), (str(tmp_path / "gone"), "gone", 50, None)]
    tracks = spark.createDataFrame(rows, "path string, rel string, size long, sha256 string")
    got = {r["rel"]: r["sha256"] for r in filesystem.with_hashes(tracks).collect()}
    hashed = {k for k, v in got.items() if v}
    assert hashed == {"a", "b", "late", "known", "small2", "small3", "empty1", "empty2"}
    assert all(got[k] == hashlib.sha256(contents[k]).hexdigest() for k in hashed - {"known"})
    counters = filesystem.hash_counters(filesystem.peeks(tracks)).first()
    # late differs only where nobody looked, gone can't be read: both have to be tried
    assert counters["whole_files"] == 8 and counters["saved_bytes"] == 2 * big + 50 and counters["files"] == 12
    # duplicates are those of hashing everything
    groups = lambda h: sorted(sorted(k for k in h if h[k] == v) for v in set(h.values()) if v and sum(x == v for x in h.values()) > 1)
    assert groups(got) == groups({k: hashlib.sha256(v).hexdigest() for k, v in contents.items()} | {"known": got["known"]})
