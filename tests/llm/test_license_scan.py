import re

import numpy as np
from twinlathe.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words, starts, labels = WORD.findall((text or "").translate(LOWER)), [], set()
    for phrase, label in ls.BASE:
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += hits
        labels |= {label} if hits else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_columns(spark, documents, edge_docs, no_docs):
    for docs in (documents, edge_docs):
        got = sorted(repr((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in ls.scan(docs)[0].collect())
        assert got == sorted(repr((r["doc_id"], *base(r["text"]))) for r in docs.select("doc_id", "text").collect())
    assert ls.scan(no_docs)[0].count() == 0


def test_templates_are_found_with_edits(spark):
    mit = ls.TEMPLATES[1][1]
    words = mit.split()
    edited = " ".join(words[:10] + ["really"] + words[10:20] + words[21:])
    rows = [(1, f"Intro text. {mit} The end."), (2, f"x y z {edited}"), (3, " ".join(words[:12])), (4, "Licensed under the Apache License, Version 2.0"), (5, f"{mit} {mit}"), (6, " ".join(words[::-1]))]
    out, spans = ls.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in out.collect()}
    assert got[1] == ("mit", 1.0) and got[2][0] == "mit" and 0.9 < got[2][1] < 1 and got[4] == ("apache-2.0", 1.0)
    assert got[3] == ("", 0.0) and got[6] == ("", 0.0)
    assert spans.count() >= 5


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 12))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert ls.common_subsequence(a, b) == table[-1, -1]


def lcs(a, b):
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
        above = row
    return above[-1]


def method(text):
    """(label, cover) by diagonals, word by word, without hashes."""
    words, out = WORD.findall((text or "").translate(LOWER)), []
    for label, template in ls.TEMPLATES:
        own = WORD.findall(template.translate(LOWER))
        at, votes = {}, {}
        for i in range(len(own) - ls.GRAM + 1):
            at.setdefault(tuple(own[i : i + ls.GRAM]), []).append(i)
        for p in range(len(words) - ls.GRAM + 1):
            for i in at.get(tuple(words[p : p + ls.GRAM]), ()):
                votes.setdefault(p - i, []).append(p)
        runs = []
        for d in sorted(votes):
            if runs and d - runs[-1][-1] <= ls.MERGE:
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            places = [p for d in run for p in votes[d]]
            if len(places) < ls.MIN_VOTES:
                continue
            main = max(run, key=lambda d: (len(votes[d]), -d))
            start, end = max(0, min(main, min(places)) - ls.MERGE), max(main + len(own), max(places) + ls.GRAM) + ls.MERGE
            cover = lcs(words[start:end], own) / len(own)
            if cover >= ls.MIN_COVER:
                out.append((label, cover))
    return out


def test_labels_and_score_equal_brute_force(spark):
    """Whole license texts with words changed, dropped and inserted, cut short, repeated or next to each other, in long texts."""
    import random

    rng = random.Random(6)
    noise = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    rows = [(0, None), (1, ""), (2, noise(4000))]
    for _, template in ls.TEMPLATES:
        words = template.split()
        for rate in (0, 0.03, 0.1, 0.3):
            copy = [w for w in words if rng.random() >= rate / 2]
            copy = [rng.choice(words) if rng.random() < rate / 2 else w for w in copy]
            if rate and len(copy) > 20:
                at = rng.randrange(len(copy))
                copy[at:at] = noise(rng.choice((1, 2, 6))).split()
            rows.append((len(rows), f"{noise(rng.choice((0, 30)))} {' '.join(copy)} {noise(10)}"))
        rows.append((len(rows), f"{template}\n{rng.choice(ls.TEMPLATES)[1]} {template}"))
        rows.append((len(rows), " ".join(words[: len(words) * 3 // 5])))
    got = {r["doc_id"]: r for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    for doc_id, text in rows:
        found, phrases = method(text), base(text)
        assert got[doc_id]["labels"] == ",".join(sorted({label for label, _ in found} | set(filter(None, phrases[4].split(",")))))
        assert abs(got[doc_id]["score"] - max([c for _, c in found] + [ls.BASE_SCORE if phrases[1] else 0.0])) < 1e-12
    assert sum(bool(method(text)) for _, text in rows) > 40
