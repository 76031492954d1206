import binascii
import hashlib
import random

import numpy as np
from twinlathe.llm import language_id as li


def brute(text, training):
    """Greedy longest phrases found by substring search in the whole text."""
    n = i = 0
    while i < len(text):
        size = 1
        while i + size < len(text) and text[i : i + size + 1] in training:
            size += 1
        n, i = n + 1, i + size
    return n


def test_parser_counts_longest_phrases():
    """Whole long texts too: phrases run across blocks, also where the parses of neighbours never agree."""
    rng = random.Random(3)
    training = "".join(rng.choice("abc ") for _ in range(400)).encode()
    texts = ["".join(rng.choice("abc ") for _ in range(n)).encode() for n in (1, 2, 7, 300, 5000, li.BLOCK, li.BLOCK + 1, 3 * li.BLOCK)]
    texts += [training * 40, b"abz" * 3000, b""]
    runs = b"a" * 700 + b"b"
    for train, all_texts in ((training, texts), (runs, [b"a" * 9000, b"a" * 5000 + b"b" * 3000 + b"a" * 4000, b"ab" * 4000, *texts])):
        parse = li.Parser((("x", train),))
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in all_texts])])
        got = parse.phrases(np.frombuffer(b"".join(all_texts), np.uint8), bounds)[:, 0].tolist()
        assert got == [brute(t, train) for t in all_texts]


def symbols(text):
    return li.symbols_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0].tobytes()


def test_predictions_equal_a_brute_force_parse(spark):
    """lang_pred and score of whole long texts, against substring search in the training text."""
    rng = random.Random(8)
    syllables = {"aa": ("ka", "lo", "mi", "tu"), "bb": ("ska", "lor", "min", "ut"), "cc": ("ka", "ut", "lor", "en")}
    prose = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(k, prose(lang, rng.choice((5, 40))), lang) for k, lang in enumerate(rng.choice(list(syllables)) for _ in range(120))]
    rows += [(500 + k, prose(lang, 900), None) for k, lang in enumerate(syllables)] + [(600, prose("aa", 300) + prose("bb", 290), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    training = li.training_text(df)
    assert [lang for lang, _ in training] == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in li.predict(df, training).collect()}
    for doc_id, text, _ in rows:
        x = symbols(text)
        normal = [brute(x, t) * np.log2(len(t) + 2) / len(x) for _, t in training]
        best = int(np.argmin(normal))
        second = sorted(normal)[1]
        assert got[doc_id]["lang_pred"] == training[best][0]
        assert abs(got[doc_id]["score"] - (second - normal[best]) / second) < 1e-12


def test_a_language_with_many_rows_without_text_is_learned(spark):
    rows = [(k, None if k % 2 else "", "xx") for k in range(3000)] + [(5000 + k, f"zorka belum {k} tavi", "xx") for k in range(30)] + [(9000 + k, "plain other words here", "en") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    training = li.training_text(df)
    assert [lang for lang, _ in training] == ["en", "xx"]
    assert {r["lang_pred"] for r in li.predict(df.where("doc_id >= 5000 and doc_id < 9000"), training).collect()} == {"xx"}


def test_training_takes_whole_texts_in_seeded_order(spark):
    rows = [("a", k, text) for k, text in enumerate(["zz yy", "q" * 30, "aa bb", "mm"], 1)] + [("b", 1, "w" * 50), ("b", 2, "v" * 40)]
    assert li.learned(rows) == (("a", b"zz yy " + b"q" * 30 + b" aa bb mm"), ("b", b"w" * 50 + b" " + b"v" * 40))
    # long rows alone, or among short ones, are taken as their digests say
    texts = {k: f"w{k} " * (1000 if k % 2 else 3) for k in range(60)}
    df = spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id long, text string, lang string")
    first = sorted((k for k in texts if binascii.crc32(str(k).encode()) % 4 != 2), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())[:5]
    assert li.training_text(df, 5) == li.learned([("en", n, texts[k]) for n, k in enumerate(first)])
    assert any(k % 2 for k in first)


def test_sparse_tables_parse_alike():
    rng = random.Random(6)
    training = tuple((f"l{k:02}", "".join(rng.choice("abcdefgh ") for _ in range(300)).encode()) for k in range(60))
    dense, sparse = li.Parser(training), li.Parser(training, dense_bytes=0)
    assert all(isinstance(t, li.Sparse) for t in sparse.tables) and all(isinstance(t, np.ndarray) for t in dense.tables)
    data = np.frombuffer("".join(rng.choice("abcdefghz ") for _ in range(9000)).encode(), np.uint8)
    bounds = np.array([0, 10, 10, 4000, 9000])
    assert (dense.phrases(data, bounds) == sparse.phrases(data, bounds)).all()
    # at most three transitions a symbol of the text
    assert sum(len(t.entries) for t in sparse.tables) <= 3 * sum(len(t) for _, t in training)


def test_held_out_accuracy(spark, documents):
    got = li.predict(documents, li.training_text(documents)).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edge_cases(spark, edge_docs, no_docs, edge_rows):
    rows = li.predict(edge_docs, li.training_text(edge_docs)).collect()
    assert len(rows) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3, 10))
    assert by_id[None]["held_out"] is False and by_id[None]["lang_pred"] != "und"
    assert li.predict(no_docs, li.training_text(no_docs)).count() == 0
    assert {r["lang_pred"] for r in li.predict(edge_docs, ()).collect()} == {"und"}
