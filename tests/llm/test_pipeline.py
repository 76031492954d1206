import public_tokenizers
from tokenizers import Tokenizer
from twinlathe.llm import jaccard_join, language_id, mixing, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    """Each stage's result held against its operator on the stage's own input."""
    import corpus_pipeline as cp

    from twinlathe.llm.storage import Scratch

    assert [n for n, _ in cp.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "mixing sources", "BPE encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = Scratch(spark, "test")
    steps = [docs]
    for name, stage in cp.STAGES:
        steps.append(scratch.cut(stage(spark, steps[-1], SF), name.replace(" ", "-")))
    ids = [sorted(r["doc_id"] for r in s.select("doc_id").collect()) for s in steps]
    assert all(s.columns == docs.columns for s in steps[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids[1] == sorted(r["doc_id"] for r in quality_rules.judged(steps[0], labels).where("kept").collect())
    predicted = language_id.predict(steps[1], language_id.training_text(steps[1]))
    assert ids[2] == sorted(r["doc_id"] for r in predicted.where(f"lang_pred <> 'und' AND rate <= {language_id.MAX_RATE}").collect())
    groups = jaccard_join.join(steps[2]).collect()
    assert ids[3] == sorted(r["doc_id"] for r in groups if r["doc_id"] == r["component_id"])
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(steps[3]).collect()}
    assert ids[4] == sorted(i for i, n in taken.items() for _ in range(n))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in steps[3].select("doc_id", "text").collect()}
    assert all(list(r["ids"]) == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in steps[5].limit(40).collect())
    assert len(ids[1]) > 0.7 * len(ids[0]) and len(ids[2]) >= 0.98 * len(ids[1])


def test_edges(spark, edge_docs, no_docs):
    import corpus_pipeline as cp

    for docs in (edge_docs, no_docs):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= 2 * docs.count()
        assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_repeated_rows_are_one_group(spark, edge_docs):
    import corpus_pipeline as cp

    got = [r["doc_id"] for r in cp.jaccard_stage(spark, edge_docs, SF).collect()]
    assert got.count(7) == 1 and 8 not in got and {1, 2, 3} <= set(got)


def test_rows_that_share_a_doc_id_are_judged_by_their_own_text(spark):
    """A bad text with a good one's doc_id, near copies without any doc_id, a linked text under the doc_id of another group."""
    import random

    import corpus_pipeline as cp

    rng = random.Random(2)
    prose = lambda n: [a + b + c for a, b, c in (rng.choices(("th", "an", "er", "is", "ow", "ly", "ng"), k=3) for _ in range(n))]
    texts = [prose(60) for _ in range(5)]
    rows = [(1, texts[0]), (1, ["word"]), (2, texts[1]), (1, texts[1][:-1] + ["zz"]), (None, texts[2]), (None, texts[2][:-1] + ["yy"]), (None, texts[2]), (4, texts[3]), (4, texts[3]), (None, texts[4]), (5, texts[4])]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = cp.quality_stage(spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, t in rows if len(t) > 1)
    kept = [(r["doc_id"], r["text"]) for r in cp.jaccard_stage(spark, left, SF).collect()]
    assert sorted(str(i) for i, _ in kept) == ["1", "1", "4", "5", "None"]
    assert {t for i, t in kept if i == 1} == {" ".join(texts[0]), " ".join(rows[3][1])}
    mixed = [(r["doc_id"], r["text"]) for r in cp.mixing_stage(spark, docs, SF).collect()]
    taken = [(r["doc_id"], r["size"]) for r in mixing.mix(docs).collect() for _ in range(r["copies"])]
    assert sorted(map(str, taken)) == sorted(str((i, len(t.split()))) for i, t in mixed)
