"""Operator 5: BPE encoding and decoding with a segment tree over pair ranks.

A word's symbols form a linked list. Leaf i of a segment tree holds the rank of the
pair (symbol i, next symbol), or infinity where no merge exists; inner nodes keep the
smaller rank, the left one on ties. The root thus names the leftmost pair of lowest
rank. A merge changes three leaves (the pair itself, the pair before, the pair after),
each in logarithmic time, so a word of n symbols takes O(n log n) whatever its length.

``Codec`` reads a public tokenizer file (its path is a parameter; nothing is trained)
and repeats its normalisation and splitting. Texts within the common Latin ranges are
split here; any other text is normalised and split by the library's own components, so
that Unicode tables agree. Encoded words are kept in a bounded cache per process.

Defined cases: null text is empty and gives no ids and an empty decoded text; added
tokens written out in a text give their ids, as the library has it; ids unknown to the
vocabulary are skipped by ``decode``; rows are independent, so repeated rows repeat
their result and an empty table gives an empty one. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BPE = "word_bpe_49k.json"
CACHE_WORDS = 300_000
#: Longer words are encoded but not cached.
CACHED_WORD_LENGTH = 64

_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞€]*")
_NEVER = 1 << 62
_PACK = struct.Struct("i").pack


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1,
    else the next free one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class PairTree:
    """Leaves are ranks; the root names the leftmost smallest.

    A node holds rank * width + position (or ``_NEVER``), so one comparison orders by
    rank and then by position.
    """

    __slots__ = ("size", "tree", "width")

    def __init__(self, ranks: list[int]):
        width = self.width = len(ranks)
        size = self.size = 1 << (width - 1).bit_length()
        tree = [_NEVER] * size
        tree += [r * width + i if r < _NEVER else _NEVER for i, r in enumerate(ranks)]
        tree += [_NEVER] * (size - width)
        for i in range(size - 1, 0, -1):
            x, y = tree[2 * i], tree[2 * i + 1]
            tree[i] = x if x < y else y
        self.tree = tree

    def best(self) -> int:
        """Position of the pair to merge, or -1."""
        root = self.tree[1]
        return -1 if root == _NEVER else root % self.width

    def set(self, i: int, rank: int) -> None:
        tree = self.tree
        node = self.size + i
        new = rank * self.width + i if rank < _NEVER else _NEVER
        while tree[node] != new:
            tree[node] = new
            if node == 1:
                break
            other = tree[node ^ 1]
            if other < new:
                new = other
            node >>= 1


class Codec:
    """One tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_re = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.rank_of: dict[tuple[int, int], int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key = self.vocab[left], self.vocab[right]
            self.rank_of[key], self.merged[key] = rank, self.vocab[left + right]
        self.byte_chars = byte_alphabet()
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.split = regex.compile(splits[0]["pattern"]["Regex"]).findall
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        tokens: list[str | None] = [None] * size
        for token, i in [*self.vocab.items(), *self.added.items()]:
            tokens[i] = token
        self.tokens = pa.array(tokens, pa.string())
        self.cache = _Cache(self._encode_plain)
        self.mapped_cache = _Cache(self.encode_symbols)

    def encode_symbols(self, word: str) -> bytes:
        """Ids (int32) of a word given in byte characters."""
        vocab = self.vocab
        if (whole := vocab.get(word + self.suffix)) is not None and len(word) == 1:
            return _PACK(whole)
        ids = [vocab.get(c, -1) for c in word[:-1]]
        ids.append(vocab.get(word[-1] + self.suffix, -1))
        if min(ids) < 0:
            ids = [i for i in ids if i >= 0]
        ids = self.merge(ids)
        return _PACK(ids[0]) if len(ids) == 1 else array("i", ids).tobytes()

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the leftmost pair of lowest rank until none is left."""
        n = len(ids)
        if n < 2:
            return ids
        rank_of, merged = self.rank_of, self.merged
        tree = PairTree([rank_of.get(p, _NEVER) for p in zip(ids, ids[1:])])
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        while (i := tree.best()) >= 0:
            j = after[i]
            ids[i] = merged[ids[i], ids[j]]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.set(j, _NEVER)
            before[k] = i
            tree.set(i, rank_of.get((ids[i], ids[k]), _NEVER) if k < n else _NEVER)
            if (h := before[i]) >= 0:
                tree.set(h, rank_of.get((ids[h], ids[i]), _NEVER))
        return [x for x in ids if x >= 0]

    def _encode_plain(self, chunk: str) -> bytes:
        chars = self.byte_chars
        words = [p if p.isascii() else "".join([chars[b] for b in p.encode()]) for p in self.split(chunk)]
        return b"".join([self.mapped_cache[w] for w in words])

    def _encode_part(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            # no piece spans white space, so chunks between white space are coded, and cached, whole
            return b"".join(map(self.cache.__getitem__, unicodedata.normalize("NFC", text).lower().split()))
        normal = self.library.normalizer.normalize_str(text)
        return b"".join([self.mapped_cache[p] for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids (int32) of a text."""
        text = text or ""
        if self.added_re and "<" in text:
            parts = self.added_re.split(text)
            coded = [np.int32(self.added[p]).tobytes() if k % 2 else self._encode_part(p) for k, p in enumerate(parts)]
            return np.frombuffer(b"".join(coded), np.int32)
        return np.frombuffer(self._encode_part(text), np.int32)

    def decode(self, ids: pa.Array | pa.ChunkedArray) -> pa.Array:
        """Texts of a list column of ids: this tokenizer has no decoder, so its tokens are joined by a space."""
        flat = ids.flatten()
        known = self.tokens.take(flat)
        texts = pa.ListArray.from_arrays(ids.offsets, known)
        return pc.binary_join(texts, " ") if not known.null_count else pa.array([" ".join(t for t in row if t is not None) for row in texts.to_pylist()], pa.string())


class _Cache(dict):
    """Encodes what it misses; starts anew when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        out = self.encode(word)
        if len(word) <= CACHED_WORD_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


#: Texts per output batch.
_BATCH_BYTES = 8 << 20


def _coded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = codec(path)
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        ids: list[np.ndarray] = []
        first, weight = 0, 0
        for i, text in enumerate(texts):
            ids.append(code.encode(text.as_py()))
            weight += 4 * len(ids[-1])
            if weight >= _BATCH_BYTES or i == len(texts) - 1:
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(ids)), column, code.decode(column)], ["doc_id", "ids", "decoded"])
                first, weight, ids = i + 1, 0, []


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text that the ids decode to)."""
    path = path or public_tokenizers.path(WORD_BPE)
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(functools.partial(_coded, path), f"doc_id {key}, ids array<int>, decoded string")


def joined(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined(F.col("ids")), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op5_bpe_codec": op5_bpe_codec}
ORACLE_SQL: dict[str, str] = {}
