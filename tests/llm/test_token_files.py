import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer
from twinlathe.llm import token_files as tf
from twinlathe.llm.storage import Scratch

PATH = public_tokenizers.path(tf.BYTE_BPE)
LIBRARY = Tokenizer.from_file(PATH)


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=6))
def test_packing_round_trip(docs):
    packed = [tf.pack(np.array(d, np.uint32)) for d in docs]
    control, data = (np.frombuffer(b"".join(p[k] for p in packed), np.uint8) for k in (0, 1))
    assert tf.unpack(control, data, np.array([len(d) for d in docs], np.uint32)).tolist() == [x for d in docs for x in d]


def test_encoder_equals_the_library():
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "'s", "12", "!", "<|endoftext|>", " ", "\x1c", "日", "\r\n", " \n", "x.", "🎉", "don't", "##", "Ünïcode", "\nWord,", "ab.\nCd!\nef", "º", "ª"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    code = tf.encoder(PATH)
    assert [np.frombuffer(code.encode(t), "<u2").tolist() for t in texts] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def written(spark, docs):
    scratch = Scratch(spark, "test")
    folder = scratch.folder("files")
    manifest = tf.write_files(tf.encode(docs, PATH, scratch), folder, scratch)
    return manifest, folder, sorted(tf.read_files(manifest, folder, scratch).collect(), key=lambda r: r["start"])


def test_files_hold_every_document_in_order(spark, documents, edge_docs, no_docs):
    for docs in (documents, edge_docs):
        rows = [(r["doc_id"], LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.select("doc_id", "text").collect()]
        _, _, got = written(spark, docs)
        start = 0
        for r in got:
            assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            start += r["n_tokens"]
        key = lambda x: (x[0] is not None, x[0] or 0, len(x[1]))
        assert [(r["doc_id"], r["ids"]) for r in got] == sorted(rows, key=key)
    assert written(spark, no_docs)[2] == []


def test_damage_is_noticed(spark, edge_docs):
    import pyarrow.fs

    manifest, folder, _ = written(spark, edge_docs)
    row = manifest.first()
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    with open(f"{root}/{row['file']}", "r+b") as f:
        f.seek(row["offset"] + row["bytes"] - 1)
        last = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([last[0] ^ 1]))
    with pytest.raises(ValueError), fs.open_input_file(f"{root}/{row['file']}") as f:
        tf.read_block(f, row["offset"], row["bytes"])


def test_a_hot_doc_id_is_split_and_read_in_many_tasks(spark):
    """Rows of one doc_id, and of none, lie in several files; blocks are read by several tasks whatever the number of files."""
    from pyspark.sql import functions as F

    rows = [(7, f"text {k % 40}") for k in range(300)] + [(None, "equal rows")] * 100 + [(k, f"other {k}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark, "test")
    folder = scratch.folder("files")
    manifest = tf.write_files(tf.encode(docs, PATH, scratch), folder, scratch)
    assert manifest.select("file").distinct().count() > 4
    read = tf.read_files(manifest, folder, scratch)
    assert read.select(F.spark_partition_id()).distinct().count() > 1
    got = sorted(read.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x or 0))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    ids = lambda t: LIBRARY.encode(t, add_special_tokens=False).ids + [0]
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got) == sorted((i or 0, ids(t)) for i, t in rows)
