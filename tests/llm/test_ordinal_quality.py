import numpy as np
from twinlathe.llm import ordinal_quality as oq

SF = "/root/testdata/sf0.01"


def test_held_out_grades(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", oq.rating().alias("grade"))
    got = oq.predict(docs, oq.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    top = np.array([t[1] for t in got["tails"]]) >= 0.5
    assert len(got) > 50 and (top == (got["grade"] >= 2)).mean() > 0.78
    assert got[got["grade"] == 2]["expected_grade"].mean() > got[got["grade"] < 2]["expected_grade"].mean() + 0.3


def test_thresholds_are_ordered_and_fit_separates():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 300)
    index = np.concatenate([[g, 10 + i % 7] for i, g in enumerate(grade)]).astype(np.int32)
    model = oq.fit(np.repeat(np.arange(300), 2), index, np.full(300, 2), np.zeros((300, len(oq.CLASSES))), grade)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(np.array([model.words[g] / np.sqrt(2) for g in (0, 1, 2)]))
    assert (np.diff(tails, axis=1) < 0).all() and (np.diff(tails.sum(1)) > 0.5).all()


def test_gradient_and_likelihood_against_plain_loops():
    """The loss by the definition of P(grade > k), row by row; the gradient by differences."""
    rng = np.random.default_rng(4)
    n, grade = 40, rng.integers(0, 3, 40)
    row = np.repeat(np.arange(n), 3)
    rated = oq.Rated(row, rng.integers(0, 6, len(row)), rng.random(len(row)), rng.random((n, 2)), grade, rng.random(n) / n, 6)
    theta = rng.normal(size=6 + 2 + 2)
    cuts = [theta[8], theta[8] + np.exp(theta[9])]
    loss = oq.L2 / 2 * float((theta[:8] ** 2).sum())
    for i in range(n):
        score = sum(theta[k] * x for k, x in zip(rated.index[row == i], rated.value[row == i])) + rated.rates[i] @ theta[6:8]
        above = [1.0, *[1 / (1 + np.exp(-(score - t))) for t in cuts], 0.0]
        loss -= rated.weight[i] * np.log(above[grade[i]] - above[grade[i] + 1])
    value, gradient = rated.loss(theta)
    assert abs(value - loss) < 1e-10
    step = 1e-6 * np.eye(len(theta))
    assert np.allclose(gradient, [(rated.loss(theta + e)[0] - rated.loss(theta - e)[0]) / 2e-6 for e in step], atol=1e-6)


def test_predictions_by_plain_words(spark, documents):
    """Tails and expected grade of whole texts, from the fitted weights and Python's own words."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", oq.rating().alias("grade"))
    model = oq.train(documents, labels)
    lower = {c: c + 32 for c in range(65, 91)}
    for r in oq.predict(documents, model).join(documents.select("doc_id", "text"), "doc_id").limit(40).collect():
        text = r["text"] or ""
        words = {w for w in text.translate(lower).encode().split()}
        slots = set()
        for w in words:
            f = oq.Features(np.frombuffer(w, np.uint8), np.array([0, len(w)]), 0, 1)
            slots |= set(f.index.tolist())
        raw = text.encode()
        rates = np.array([sum(raw.count(bytes([b])) for b in members) / max(1, len(raw)) * oq.RATE_SCALE for members in oq.CLASSES])
        score = sum(model.words[k] for k in slots) / np.sqrt(max(1, len(slots))) + rates @ model.rates
        tails = 1 / (1 + np.exp(-(score - model.thresholds)))
        assert np.allclose(r["tails"], tails) and abs(r["expected_grade"] - tails.sum()) < 1e-9


def test_texts_are_not_shuffled_for_training(spark, documents, monkeypatch):
    """The chosen ids are broadcast: no exchange carries more than the chosen texts."""
    seen = []
    plain = oq.fit
    monkeypatch.setattr(oq, "fit", lambda *a: seen.append(a[4]) or plain(*a))
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", oq.rating().alias("grade"))
    oq.train(documents, labels, rows_per_grade=5)
    assert len(seen[0]) <= 15


def test_edge_cases(spark, edge_docs, no_docs, edge_rows):
    labels = spark.createDataFrame([(4, 2), (5, 0), (7, 1), (7, 0), (None, 1), (11, None)], "doc_id long, grade int")
    rows = oq.predict(edge_docs, oq.train(edge_docs, labels)).collect()
    assert len(rows) == len(edge_rows) and all(np.isfinite(r["expected_grade"]) for r in rows)
    none = oq.train(edge_docs, labels.limit(0))
    assert {tuple(r["tails"]) for r in oq.predict(edge_docs, none).collect()} == {(0.5, 0.5)}
    assert oq.predict(no_docs, none).count() == 0
