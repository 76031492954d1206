import hashlib

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from twinlathe.llm import bpe

PATH = public_tokenizers.path(bpe.WORD_BPE)
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "<|endoftext|> Hello<|startoftext|>x", "ΣΑΣ İstanbul ǅ ﬁ", "it's WE'LL 12 3", "日本語 텍스트 \x1c a\x85b", "é å", "x" * 3000, "a​b", "①②½", "🎉🎉 ok", "a b"]


def check(texts):
    code = bpe.codec(PATH)
    ids = [code.encode(t).tolist() for t in texts]
    assert ids == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert code.decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == [LIBRARY.decode(i, skip_special_tokens=False) for i in ids]


def test_odd_texts():
    check(ODD)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    check([text])


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 9)), max_size=30))
def test_tree_names_the_leftmost_smallest(ranks, changes):
    tree = bpe.PairTree(ranks)
    for i, rank in changes:
        if i < len(ranks):
            ranks[i] = rank if rank else bpe._NEVER
            tree.set(i, ranks[i])
        best = min(ranks)
        assert tree.best() == (-1 if best == bpe._NEVER else ranks.index(best))


def test_query_and_edges(spark, edge_docs, no_docs, edge_rows, documents):
    for docs in (edge_docs, documents):
        rows = docs.select("doc_id", "text").collect()
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(bpe.encode_decode(docs)).collect())
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected = []
        for r in rows:
            ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
            expected.append((str(r["doc_id"]), len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
        assert got == sorted(expected)
    assert bpe.encode_decode(no_docs).count() == 0
