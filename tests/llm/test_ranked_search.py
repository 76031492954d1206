"""Ranked search against scoring every document, and its treaps against plain lists."""

import math
import random
import re
from collections import Counter

import numpy as np
import oracle
import pytest

from twinlathe.llm import ranked_search as rs
from twinlathe.llm.storage import Scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def _terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def _brute(docs, items, top=10):
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    big, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, c, n in counted:
            m = 100 - 90 + (90 * n * big) // length
            score = sum(math.floor(1000 * math.log((2 * big + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc if doc is not None else 0, doc))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def _corpus(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["É", "日本", "The", "THE"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(rng.randint(0, n), " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 30)))) for _ in range(n)]
    docs += [(None, docs[0][1]), (None, "w1 w2"), (5, None), (6, ""), (7, ". ,")] + [(1000 + k, "w3 w4 w5 rare") for k in range(40)]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for k in range(25)] + [(1, "rare w4"), (3, None), (4, "nowhere"), (5, ""), (None, "w1, w2. the"), (9, "rare"), (9, "rare")]
    return docs, items


@pytest.mark.parametrize("seed, terms", [(1, rs.GROUP_TERMS), (2, 20)])
def test_equals_scoring_every_document(spark, seed, terms):
    docs, items = _corpus(seed, 400)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id int, text string")
    got = [tuple(r) for r in rs.search(d, i, Scratch(spark, "t"), group_terms=terms).collect()]
    assert sorted(got, key=repr) == _brute(docs, items)


def test_small_blocks_and_string_ids(spark):
    docs, items = _corpus(3, 200)
    docs = [(None if k is None else f"d{k:05}", t) for k, t in docs]
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rs.search(spark.createDataFrame(docs, "doc_id string, text string").repartition(2), spark.createDataFrame(items, "item_id int, text string"), Scratch(spark, "t")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    counted = Counter((r["item_id"], r["rank"], r["score"]) for r in got)
    plain = _brute([(None if k is None else int(k[1:]), t) for k, t in docs], items)
    assert counted == Counter((i, k, s) for i, k, _, s in plain)
    assert Counter(tuple(r) for r in got) == Counter((i, k, None if d is None else f"d{d:05}", s) for i, k, d, s in plain)


def test_treaps_keep_both_orders():
    rng = np.random.default_rng(1)
    for _ in range(20):
        term = np.sort(rng.integers(0, 6, 200))
        doc = np.concatenate([np.sort(rng.choice(1000, (term == t).sum(), replace=False)) for t in range(6)])
        impact = rng.integers(1, 9, 200)
        t = rs.Treaps(term, doc, impact)
        seen = []

        def visit(node, low, high, most):
            if node >= 0:
                assert low < t.doc[node] < high and t.impact[node] <= most
                visit(t.left[node], low, t.doc[node], t.impact[node])
                seen.append(node)
                visit(t.right[node], t.doc[node], high, t.impact[node])

        for root in t.root:
            visit(root, -1, 1000, 99)
        assert seen == list(range(200))
        assert [int(term[r]) for r in t.root] == t.terms.tolist()


def test_split_equals_plain_lists():
    rng = np.random.default_rng(2)
    doc = np.sort(rng.choice(500, 120, replace=False))
    t = rs.Treaps(np.zeros(120, int), doc, rng.integers(1, 30, 120))
    top = lambda low, high: max((k for k in range(120) if low < doc[k] < high), key=lambda k: (t.impact[k], rank[k]), default=-1)
    rank = {k: r for r, k in enumerate(np.lexsort((rs.bytetext.mix(np.arange(120)), t.impact)).tolist())}
    for _ in range(300):
        low, high = sorted(rng.choice(np.arange(-1, 501), 2, replace=False).tolist())
        if high - low < 2 or top(low, high) < 0:
            continue
        want = int(rng.integers(low + 1, high))
        got = [int(x[0]) for x in t.split(np.array([top(low, high)]), np.array([want]), np.array([low]), np.array([high]))]
        exact = [k for k in range(120) if doc[k] == want]
        assert got == [top(low, want), exact[0] if exact else -1, top(want, high)]


def test_most_documents_are_pruned():
    """Documents that hold the asked passage set a bar that others' bounds don't reach."""
    rng = np.random.default_rng(3)
    n, terms = 4000, 12
    doc = np.concatenate([np.sort(rng.choice(n, 800, replace=False)) for _ in range(terms)] + [np.arange(0, n, 200)] * 4)
    term = np.concatenate([np.repeat(np.arange(terms), 800), np.repeat(np.arange(terms, terms + 4), n // 200)])
    impact = np.where(term < terms, rng.integers(1, 100, len(doc)), 5000)
    none = np.zeros(0, np.int64)
    t = rs.Treaps(term, doc, impact)
    best, scored = rs.walk(t, np.zeros(len(t.root), np.int64), t.root, n, rs.Best(10, none, none, np.zeros(0), none), 1)
    total = np.zeros(n, np.int64)
    np.add.at(total, doc, impact)
    assert best.ref.tolist() == np.lexsort((np.arange(n), -total))[:10].tolist()
    assert scored < 100
    narrow, again = rs.walk(t, np.zeros(len(t.root), np.int64), t.root, n, rs.Best(10, none, none, np.zeros(0), none), 1, most=5)
    assert narrow.ref.tolist() == best.ref.tolist()


def test_empty_tables(spark, no_docs, edge_docs):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert rs.search(no_docs, items, Scratch(spark, "t")).count() == 0
    assert rs.search(edge_docs, items.limit(0), Scratch(spark, "t")).count() == 0
    assert [r["doc_id"] for r in rs.search(edge_docs, items, Scratch(spark, "t")).orderBy("rank").collect()] == [5, 6]


def test_query_equals_its_oracle(spark):
    oracle.same(spark, "/root/testdata/sf0.001", rs.op11_ranked_search, rs.ORACLE_SQL["op11_ranked_search"])
