"""Operator 8: token ids in binary files, frequency-ranked and byte-aligned.

Texts are encoded once (tokenizers library, with a cache of words), with ``end_id`` after each document. A global count gives every id its
rank by frequency, so that frequent ids take one byte. Documents are cut into parts by
doc_id (and, within a doc_id, by row), and each part becomes one file::

    "TLTF" | u32 version | u32 n_ranks | n_ranks x u32 (id of each rank) | block*
    block: u32 n_docs | u32 control_bytes | u32 data_bytes | u32 crc32 of what follows
           | n_docs x i64 doc_id | n_docs x u8 (1: doc_id is null) | n_docs x u32 ids of each
           | control bytes (ceil(ids / 4) of each document) | data bytes

A control byte holds the byte lengths, less one, of four ranks (two bits each, lowest
first); the data bytes are the ranks' little-endian bytes without leading zeros. Ids are
packed before the shuffle, which so moves what the files hold; the writers only put
documents one after another. Decoding looks lengths up in a 256 x 4 table and spreads
the data with one mask.

A manifest table (one row per block, written with Spark's commit protocol) names the
files that count. Files have unique names, so a retried or speculative task leaves an
orphan that no row names. Starts come from sums per file and block.

Defined cases: doc_id is an integer or casts to one (other strings are an error);
null text is empty and holds only the end id; null doc_ids come first;
rows with equal doc_id are ordered by their number of ids, then by a digest of the ids, and
may lie in several files; a very long text forms a slice and a block of its own; an empty
table gives no files and no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlathe.llm.bpe import byte_alphabet
from twinlathe.llm.bytetext import column_bytes
from twinlathe.llm.storage import Scratch

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 0
MAGIC, VERSION = b"TLTF", 1
BLOCK_IDS = 1 << 18
#: About as many ids make a file, about as many bytes a reading task.
FILE_IDS, TASK_BYTES = 1 << 26, 1 << 26
#: Most rows of which the cuts between files are found.
SAMPLE = 1_000_000
#: Words of one generation of a cache, and the longest word kept.
CACHE_WORDS = 600_000
CACHED_LENGTH = 64
_HEAD = struct.Struct("<4sII")
_BLOCK = struct.Struct("<IIII")

_BYTES = np.arange(4, dtype=np.uint8)
#: Byte lengths of the four ranks of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1
#: Which of a rank's four bytes are stored, by length less one.
STORED = _BYTES[None, :] <= _BYTES[:, None]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, np.uint32)
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    four[: len(code)] = code
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[STORED[code]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of documents of ``counts`` ranks, each of which ``pack`` made."""
    slots = -(-counts.astype(np.int64) // 4) * 4
    last = np.cumsum(slots)
    spare = np.zeros(len(control) * 4, bool)
    for k in range(1, 4):  # up to three unused slots at a document's end
        spare[last[slots - counts >= k] - k] = True
    code = LENGTHS[control].ravel()[~spare] - 1
    out = np.zeros((len(code), 4), np.uint8)
    out[STORED[code]] = data
    return out.view(np.uint32).ravel()


class _Irregular(Exception):
    """White space whose pieces depend on what surrounds it."""


class _Pieces(dict):
    """Ids by text, made by ``make`` where missing. Of two generations the older one is forgotten."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.make(text)
            if len(text) > CACHED_LENGTH:
                return ids
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[text] = ids
        return ids


class Encoder:
    """The tokenizers library with a cache of words.

    The library's splitting pattern always begins a piece at a space that stands between
    two characters other than white space, so a text is cut at its spaces and each word is
    encoded, with its space, by itself. Texts with two spaces in one run of white space,
    or with a special token, are encoded whole. Letters are one piece, which the library's
    model encodes without the rest of its pipeline, and so are the marks after them; a line
    end between two other characters is a piece too.
    """

    chunks = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
    plain = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞€]*").fullmatch
    #: Letters, then perhaps other marks: one or two pieces of the splitting pattern.
    marked = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\\[-`{-~]*)").fullmatch

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = id_type(self.library.get_vocab_size())
        self.tokenize = self.library.model.tokenize
        self.byte_chars = dict(enumerate(byte_alphabet()))
        self.space = self.byte_chars[0x20]
        self.words, self.bare, self.marks = _Pieces(self.word_ids), _Pieces(self.bare_ids), _Pieces(self.library_ids)

    def library_ids(self, text: str) -> bytes:
        return array(self.kind, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one whole piece, in the characters that stand for its bytes."""
        return array(self.kind, [t.id for t in self.tokenize(piece)]).tobytes()

    def word_ids(self, word: str) -> bytes:
        """Ids of ' ' + word."""
        if word.isalpha() and word.isascii():
            return self.piece_ids(self.space + word)
        if parts := self.marked(word):
            if marks := parts[2]:
                return self.words[parts[1]] + self.marks[marks]
            return self.piece_ids(self.space + word.encode().decode("latin-1").translate(self.byte_chars))
        if not word or word.isspace():
            raise _Irregular
        if "\n" in word and self.plain(word):
            first, *rest = word.split("\n")
            if len(word.split()) == len(rest) + 1:  # each line end stands alone between two words
                line_end = self.marks["\n"]
                return self.words[first] + b"".join([line_end + self.bare[w] for w in rest])
            return b"".join([self.words[c[1:]] if c[0] == " " and not c.isspace() else self.bare[c] for c in self.chunks(" " + word)])
        return self.library_ids(" " + word)

    def bare_ids(self, text: str) -> bytes:
        """Ids of what no space precedes."""
        if text.isalpha() and text.isascii():
            return self.piece_ids(text)
        if (parts := self.marked(text)) and parts[2]:
            return self.bare[parts[1]] + self.marks[parts[2]]
        return self.library_ids(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, as many bytes each as ``id_type`` says."""
        text = text or ""
        if not any(s in text for s in self.special):
            first, *rest = text.split(" ")
            try:
                return (self.library_ids(first) if first else b"") + b"".join(map(self.words.__getitem__, rest))
            except _Irregular:
                pass
        return self.library_ids(text)


def id_type(vocabulary: int) -> str:
    """Array type code of an id: two bytes where they suffice, else four."""
    return "H" if vocabulary <= 1 << 16 else "I"


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = encoder(path)
    end = array(code.kind, [end_id])
    task = TaskContext.get()
    salt = np.random.default_rng(task.partitionId() if task else 0)
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            part = batch.slice(first, 1024)
            ids = [code.encode(t.as_py()) + end.tobytes() for t in part.column(1)]
            counts = np.array([len(x) // end.itemsize for x in ids], np.int64)
            digest = np.array([zlib.crc32(x) for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts), pa.array(digest), pa.array(salt.integers(0, 1 << 62, len(ids))), pa.array(ids, pa.binary())], ["doc_id", "n_ids", "digest", "salt", "ids"]
            )


class Encoded:
    """Documents as ids: ``table`` has doc_id, n_ids, digest and salt (which tell rows of a doc_id apart) and ids (little-endian ``dtype``)."""

    def __init__(self, table: DataFrame, dtype: str):
        self.table, self.dtype = table, dtype


def encode(docs: DataFrame, path: str, scratch: Scratch, end_id: int = END_ID) -> Encoded:
    kind = encoder(path).kind
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        functools.partial(_encode, path, end_id), "doc_id long, n_ids long, digest long, salt long, ids binary"
    )
    return Encoded(scratch.cut(table, "ids", "zstd"), "<u2" if kind == "H" else "<u4")


def _count(dtype: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        data, offsets = column_bytes(batch.column(0))
        counts = np.bincount(data[offsets[0] : offsets[-1]].view(dtype))
        if len(counts) > len(total):
            total, counts = counts.astype(np.int64), total
        total[: len(counts)] += counts
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])


def frequency_ranks(encoded: Encoded) -> np.ndarray:
    """Ids by falling frequency, ties by id. Collected: no longer than the vocabulary."""
    counts = encoded.table.select("ids").mapInArrow(functools.partial(_count, encoded.dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()
    ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
    return ids[np.lexsort((ids, -n))].astype(np.uint32)


KEY = ("doc_id", "n_ids", "digest", "salt")


def bounds(encoded: Encoded, parts: int) -> list[tuple]:
    """Keys that cut the documents into parts of about as many ids: a balance, which no result
    depends on, from a sample of at most ``SAMPLE`` rows of the key columns."""
    keys = encoded.table.select(*KEY)
    rows = keys.count()
    wanted = min(SAMPLE, 200 * parts)
    sample = keys if rows <= wanted else keys.sample(wanted / rows, seed=1)
    got = sorted(((r[0] is not None, r[0] or 0, r[1], r[2], r[3]) for r in sample.limit(2 * SAMPLE).collect()))
    upto = np.cumsum([k[2] for k in got])
    if not got:
        return []
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)
    return sorted({got[i] for i in cuts.tolist()})


def _pack(ids_by_rank: bytes, dtype: str, cuts: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_rank = np.frombuffer(ids_by_rank, np.uint32)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    for batch in batches:
        packed = [pack(rank_of[np.frombuffer(x.as_buffer(), dtype)]) for x in batch.column(4)]
        keys = zip(*[c.to_pylist() for c in batch.columns[:4]])
        part = [bisect.bisect_right(cuts, (k[0] is not None, k[0] or 0, *k[1:])) for k in keys]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), *batch.columns[:4], pa.array([c for c, _ in packed], pa.binary()), pa.array([d for _, d in packed], pa.binary())],
            ["part", *KEY, "control", "data"],
        )


class _File:
    """One token file in the making: blocks of about ``BLOCK_IDS`` ids."""

    def __init__(self, folder: str, part: int, ids_by_rank: bytes):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        self.part, self.name = part, f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        self.out = fs.open_output_stream(f"{root}/{self.name}")
        self.at = self.out.write(_HEAD.pack(MAGIC, VERSION, len(ids_by_rank) // 4) + ids_by_rank)
        self.docs, self.held, self.blocks = [], 0, []

    def add(self, doc_id: int | None, n_ids: int, control: bytes, data: bytes) -> None:
        self.docs.append((doc_id, n_ids, control, data))
        self.held += n_ids
        if self.held >= BLOCK_IDS:
            self.flush()

    def flush(self) -> None:
        docs = self.docs
        ids = np.array([d[0] or 0 for d in docs], np.int64).tobytes()
        nulls = np.array([d[0] is None for d in docs], np.uint8).tobytes()
        counts = np.array([d[1] for d in docs], np.uint32)
        control, data = b"".join(d[2] for d in docs), b"".join(d[3] for d in docs)
        body = ids + nulls + counts.tobytes() + control + data
        block = _BLOCK.pack(len(docs), len(control), len(data), zlib.crc32(body)) + body
        self.out.write(block)
        self.blocks.append((self.name, self.part, len(self.blocks), self.at, len(block), len(docs), int(counts.sum())))
        self.at += len(block)
        self.docs, self.held = [], 0

    def close(self) -> pa.RecordBatch:
        if self.docs:
            self.flush()
        self.out.close()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["file", "part", "block", "offset", "bytes", "n_docs", "n_ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.blocks), kinds)], names)


def _write(folder: str, ids_by_rank: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part and key; each part is one file."""
    file = None
    for batch in batches:
        for part, doc_id, n_ids, control, data in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 5, 6)]):
            if file is None or part != file.part:
                if file is not None:
                    yield file.close()
                file = _File(folder, part, ids_by_rank)
            file.add(doc_id, n_ids, control, data)
    if file is not None:
        yield file.close()


_MANIFEST = "file string, part int, block int, offset long, bytes long, n_docs long, n_ids long"


def _least(spark: SparkSession) -> int:
    """Tasks at least: two for each core."""
    return 2 * spark.sparkContext.defaultParallelism


def write_files(encoded: Encoded, folder: str, scratch: Scratch) -> DataFrame:
    """Writes the files below ``folder``; returns the manifest."""
    by_rank = frequency_ranks(encoded).tobytes()
    ids = encoded.table.agg(F.sum("n_ids")).first()[0] or 0
    parts = max(_least(scratch.spark), -(-ids // FILE_IDS))
    packed = encoded.table.mapInArrow(
        functools.partial(_pack, by_rank, encoded.dtype, bounds(encoded, parts)), "part int, doc_id long, n_ids long, digest long, salt long, control binary, data binary"
    )
    ordered = packed.repartition(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), *KEY[1:])
    return scratch.cut(ordered.mapInArrow(functools.partial(_write, folder, by_rank), _MANIFEST), "manifest")


def read_block(f, offset: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, their null flags, ids of each, ranks of all) of one block."""
    f.seek(offset)
    raw = f.read(size)
    n_docs, n_control, data_bytes, crc = _BLOCK.unpack_from(raw)
    body = memoryview(raw)[_BLOCK.size :]
    if zlib.crc32(body) != crc:
        raise ValueError(f"damaged block at {offset}")
    docs = np.frombuffer(body, np.int64, n_docs)
    nulls = np.frombuffer(body, np.uint8, n_docs, 8 * n_docs)
    counts = np.frombuffer(body, np.uint32, n_docs, 9 * n_docs)
    at = 13 * n_docs
    return docs, nulls, counts, unpack(np.frombuffer(body, np.uint8, n_control, at), np.frombuffer(body, np.uint8, data_bytes, at + n_control), counts)


def read_ranks(f) -> np.ndarray:
    f.seek(0)
    magic, version, n = _HEAD.unpack(f.read(_HEAD.size))
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file")
    return np.frombuffer(f.read(4 * n), np.uint32)


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(folder: str, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, root = pa.fs.FileSystem.from_uri(folder)
    name, f, by_rank = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["file"] != name:
                if f is not None:
                    f.close()
                name = row["file"]
                f = fs.open_input_file(f"{root}/{name}")
                by_rank = read_ranks(f)
            docs, nulls, counts, ranks = read_block(f, row["offset"], row["bytes"])
            ids = np.ascontiguousarray(by_rank[ranks], "<u4")
            ends = np.cumsum(counts, dtype=np.int64)
            begins = ends - counts
            raw = memoryview(ids).cast("B")
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
            columns = [pa.array(docs, pa.int64(), mask=nulls.astype(bool)), pa.array(begins + row["start"], pa.int64()), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.view(np.int32), pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
    if f is not None:
        f.close()


def read_files(manifest: DataFrame, folder: str, scratch: Scratch, with_ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 and ids (which need not leave the task that decodes them)."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("part_ids").over(running), F.lit(0)).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = manifest.join(starts, F.col("part") == F.col("of")).withColumn(
        "start", F.col("part_start") + F.coalesce(F.sum("n_ids").over(inner), F.lit(0))
    )
    # starts are written first: with them known, blocks are dealt out by themselves, to as many tasks as their bytes ask for
    placed = scratch.cut(blocks.select("file", "part", "block", "offset", "bytes", "start"), "starts")
    size = placed.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(_least(scratch.spark), -(-size // TASK_BYTES))
    dealt = placed.repartitionByRange(tasks, "part", "block").sortWithinPartitions("part", "block")
    return dealt.mapInArrow(functools.partial(_read, folder, with_ids), _READ + (", ids array<int>" if with_ids else ""))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(BYTE_BPE), scratch)
    folder = scratch.folder("files")
    manifest = write_files(encoded, folder, scratch)
    scratch.drop(encoded.table)  # the files hold what is needed from here on
    return read_files(manifest, folder, scratch, with_ids=False)


QUERIES = {"op8_token_files": op8_token_files}
ORACLE_SQL: dict[str, str] = {}
