"""Secret scan against plain regular expressions, the tests against plain sums, and SQL."""

import hashlib
import math
import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from twinlathe.llm import secret_scan as ss
from twinlathe.llm.storage import Scratch

PLAIN = {
    "assign": (re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile("[0-9a-f]+"), 0, 16),
}
COLUMNS = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]


def _base(text):
    return {k: [(m.start(), m.end()) for m in p.finditer(text or "") if len(m.group(g)) >= n] for k, (p, g, n) in PLAIN.items()}


def _texts(seed, n):
    rng = random.Random(seed)
    parts = ["password", "PassWd", "api_key", "ApiKey", "token", "secret", " ", "  ", "=", ": ", "'", '"', "AKIA", "AKIAABCDEFGH", "0123456789", "abcdef", "deadbeef", "ABCDEFGHIJKLMN",
             "é", "日本", "😀", "ſecret=", "toKen:", "x.y=z/w+v-u_t", "word", "\n", "."]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def _drawn(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


BASE62 = ss.ENCODINGS["base62"][1]


def test_base_spans_equal_plain_expressions(spark, edge_rows):
    texts = _texts(1, 400) + [r[1] for r in edge_rows] + ["deadbeef" * 3 + " ", "0123456789abcdef é " * 700, "token=secret:" + "a" * 20, "password=" + "b" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ss.scan(docs, Scratch(spark, "t")).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        base = _base(text)
        assert [got[k][f"n_{kind}"] for kind in base] == [len(s) for s in base.values()], text
        named = sorted((s, ss.KINDS.index(kind), e) for kind, spans in base.items() for s, e in spans)
        told = ",".join(f"{ss.KINDS[kind]}:{s}:{e}" for s, kind, e in named)
        assert got[k]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(got[k]["spans"].split(","))


def test_battery_equals_plain_sums(spark):
    rng = random.Random(2)
    tokens = [_drawn(rng, a, rng.randint(16, 90)) for _, a in ss.ENCODINGS.values() for _ in range(6)] + ["a" * 40, "getUserNameFromSomeIdentifier", "some_long_name_of_a_thing", "1234567890123456"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").withColumn("e", ss.encoding_of(F.col("t"))).withColumn("b", F.when(F.col("e").isNotNull(), ss.battery(F.col("t"), F.col("e")))).collect()
    names = list(ss.ENCODINGS.items())
    for r in rows:
        t, n = r["t"], len(r["t"])
        fitting = [k for k, (_, (p, _)) in enumerate(names, 1) if re.fullmatch(p, t)]
        assert r["e"] == (fitting[0] if fitting else None)
        if not fitting:
            continue
        a = names[r["e"] - 1][1][1]
        k = len(a)
        expected = n / k
        chi = (sum((t.count(c) - expected) ** 2 / expected for c in a) - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
        v = [a.index(c) for c in t]
        runs = (sum((x >= k / 2) != (y >= k / 2) for x, y in zip(v, v[1:])) - (n - 1) / 2) / math.sqrt((n - 1) / 4)
        mean, var = (k - 1) / 2, (k * k - 1) / 12
        serial = sum((x - mean) * (y - mean) for x, y in zip(v, v[1:])) / (var * math.sqrt(n - 1))
        for got, want in zip((r["b"]["chi"], r["b"]["runs"], r["b"]["serial"]), (chi, runs, serial)):
            assert math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-9), t


def _clean(rng):
    words = ["schcheinlichkeitsverteilung", "anheblewhingessttionof", "getUserNameFromRequestHeader", "path/to/some/longer/file", "a_rather_long_identifier_name", "ALLCAPSHEADINGOFSECTION", "und", "the", "de", "2024-01-01T00"]
    return " ".join(rng.choice(words) for _ in range(60))


def test_long_random_tokens_are_found_and_ordinary_ones_left_alone(spark):
    rng = random.Random(3)
    texts = [_clean(rng) for _ in range(200)]
    planted = {k: _drawn(rng, BASE62, 64) for k in range(0, 40)} | {k: _drawn(rng, ss.ENCODINGS["base64"][1], 86) + "==" for k in range(40, 60)}
    for k, t in planted.items():
        texts[k] += f" key {t} end"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ss.scan(docs, Scratch(spark, "t")).collect()}
    hit = [k for k, t in planted.items() if (p := texts[k].index(t)) >= 0 and f"random:{p}:{p + len(t)}" in got[k]["spans"].split(",")]
    assert len(hit) >= 0.9 * len(planted)
    assert all(got[k]["n_random"] == 0 for k in range(60, 200))


def test_random_spans_lie_outside_base_spans(spark):
    rng = random.Random(4)
    texts = [f"x {_drawn(rng, BASE62, 64)} token={_drawn(rng, BASE62, 64)} {'0123456789abcdef' * 4}" for _ in range(30)]
    got = ss.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert sum(r["n_random"] for r in got) >= 25
    for r in got:
        spans = [(int(s), int(e), kind) for kind, s, e in (x.split(":") for x in r["spans"].split(","))]
        for s, e, kind in spans:
            assert kind != "random" or not any(k != "random" and s < f and b < e for b, f, k in spans)


def test_thresholds_by_stratum():
    counts = [(1, 0, 999), (1, 90, 1), (2, 0, 10), (2, 20, 10), (3, 0, 5)]
    assert ss.thresholds(counts, 0.01) == {1: 90, 2: 20} or ss.thresholds(counts, 0.01) == {1: 90}
    # p = 0.01 in half of the tokens: 0.01 * 20 / 10 = 0.02 expected false of 10
    assert ss.thresholds(counts, 0.02)[2] == 20 and 2 not in ss.thresholds(counts, 0.019)
    assert 3 not in ss.thresholds(counts)


def test_defined_cases(spark, edge_docs, no_docs, edge_rows):
    assert ss.scan(no_docs, Scratch(spark, "t")).count() == 0
    got = ss.scan(edge_docs, Scratch(spark, "t"))
    assert got.columns == COLUMNS and got.count() == len(edge_rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["base_sha256"] for r in got.where("doc_id IN (1, 2, 3)").collect()} == {empty}


def test_no_python_in_the_plan(spark, documents):
    plan = ss.found(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_sql_on_edges(spark, tmp_path, edge_rows):
    rng = random.Random(6)
    texts = _texts(7, 150) + [_clean(rng) + " " + _drawn(rng, BASE62, 50) for _ in range(40)] + [r[1] for r in edge_rows]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    theirs = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ss.ORACLE_SQL['op13_secret_scan']})").fetchall()
    ours = [tuple(r) for r in ss.op13_secret_scan(spark, str(tmp_path)).select(*COLUMNS).collect()]
    assert sorted(ours) == sorted(theirs)
    assert sum(r[4] for r in ours) > 0
