import re
from collections import Counter

from twinlathe.llm import quality_rules as qr
from twinlathe.llm.storage import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, r, n < 10 or 100 * r > 20 * n


def test_base_columns(spark, documents, edge_docs, no_docs):
    for docs in (documents, edge_docs):
        df = qr.statistics(docs).withColumn("base_failed", qr.base_failed())
        got = sorted(repr((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in df.collect())
        assert got == sorted(repr((r["doc_id"], *brute(r["text"]))) for r in docs.select("doc_id", "text").collect())
    assert qr.statistics(no_docs).count() == 0


def test_learned_rules_separate_and_keep_good_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = qr.judged(docs, labels).join(labels, "doc_id").where("NOT base_failed").collect()
    bad, good = [r for r in rows if r["quality"] == 0], [r for r in rows if r["quality"] == 1]
    assert sum(not r["kept"] for r in bad) >= 0.7 * len(bad) and sum(not r["kept"] for r in good) <= 0.02 * len(good)


def test_main_path_is_native(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    plans = [qr.statistics(documents), qr.judged(documents, labels)]
    assert not any(re.search("Python|Pandas|Arrow", p._jdf.queryExecution().executedPlan().toString()) for p in plans)


def test_without_usable_labels_only_base_rules_reject(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(None, 0), (4, None)], "doc_id long, quality int")
    rows = qr.judged(edge_docs, labels).collect()
    assert all(r["kept"] == (not r["base_failed"]) and r["rule"] == 0 for r in rows)
    assert qr.learn(qr.statistics(no_docs), labels, Scratch(spark, "test")) == []
