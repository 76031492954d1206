"""Operator 2: language ID by cross-parsing entropy.

Each language's labelled text becomes a suffix automaton, which recognises exactly the
substrings of that text. A text is cut greedily into the longest phrases that an
automaton knows; phrases x log2(training length) / symbols estimates the cross entropy,
and the language that needs fewest normalised phrases wins.

Automata are made into tables with one row per state and one column per symbol. A
missing transition leads where the symbol leads from the start state and is flagged, so
that one table lookup per symbol parses greedily and the flags count the phrases. All blocks of
``BLOCK`` symbols of a slice of a batch are parsed in step with numpy. Phrases run across
blocks: a block that doesn't begin a text is parsed once more from the state in which the
block before it ends, until both parses are in the same state, from which on they agree.
Whole texts are used.

Symbols: bytes of UTF-8, A-Z and the capitals of Latin-1 lowered, runs of other ASCII
characters made one separator.

Training reads a bounded sample of labelled rows, and of these the whole texts: of the rows
whose lang is not null, whose text is not empty and whose crc32(doc_id as text) mod 4 is
not 2, the ``docs_per_lang`` of each language that come first by md5 of doc_id, however long.
Prediction reads text alone.

A table takes 4 bytes a state and symbol. Where all languages' tables would take more than
``DENSE_BYTES``, those that exceed their share are kept as sorted lists of their transitions
(at most three a symbol of the text, 12 bytes each), which parse alike but slower.

Defined cases: null text, or one without a letter, is ``und`` with score 0; a null
doc_id is not held out and not learned from; equal normalised phrases go to the smaller
language name; a very long text forms a slice of its own; with one learned language the score is 1 - phrases / symbols, with none
every text is ``und``; repeated rows repeat their result; an empty table gives no rows.
Only doc_id, text and lang are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlathe.llm import bytetext
from twinlathe.llm.storage import Scratch, carried

DOCS_PER_LANG = 16
#: All dense tables of a worker.
DENSE_BYTES = 1 << 27
BLOCK = 2048
UNDETERMINED = "und"
#: A text that needs more phrases per symbol than this is in no learned language.
MAX_RATE = 0.5
_FLAG = np.int32(-(1 << 31))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class SuffixAutomaton:
    """States and transitions that spell exactly the substrings of a sequence."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in symbols:
            state = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[state] = clone
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
            last = state

    def table(self, width: int) -> np.ndarray:
        """Flat transition table: entry state * width + symbol is the next state times
        ``width``, flagged where a new phrase begins. One state is added: the one after a
        symbol that the sequence doesn't have, which is a phrase by itself."""
        out = np.full((len(self.next) + 1, width), len(self.next) * width, np.int32)
        for c, s in self.next[0].items():
            out[:, c] = s * width
        flagged = np.full(out.shape, True)
        for s, edges in enumerate(self.next):
            for c, t in edges.items():
                out[s, c] = t * width
                flagged[s, c] = False
        out[flagged] |= _FLAG
        return out.ravel()

    def sparse(self, width: int) -> Sparse:
        """The same entries; only transitions that are there are stored."""
        edges = sorted((s * width + c, t * width) for s, row in enumerate(self.next) for c, t in row.items())
        begin = np.full(width, len(self.next) * width, np.int64)
        for c, s in self.next[0].items():
            begin[c] = s * width
        keys, to = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        return Sparse(keys, to.astype(np.int32), begin.astype(np.int32) | _FLAG)


class Sparse:
    """A transition table by its sorted entries; what is missing begins a new phrase."""

    def __init__(self, entries: np.ndarray, to: np.ndarray, begin: np.ndarray):
        self.entries, self.to, self.begin = entries, to, begin

    def __getitem__(self, entry: np.ndarray) -> np.ndarray:
        if not len(self.entries):
            return self.begin[entry % len(self.begin)]
        at = np.minimum(np.searchsorted(self.entries, entry), len(self.entries) - 1)
        return np.where(self.entries[at] == entry, self.to[at], self.begin[entry % len(self.begin)])


def symbols_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol bytes of all texts, bounds of each text); separators are 0x20."""
    text = bytetext.LOWER[data]
    capital = np.zeros(len(text), bool)
    capital[1:] = (text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[1:] != 0x97)
    text[capital] += 32
    letter = (text >= 0x61) & (text <= 0x7A) | (text >= 0x80)
    text[~letter] = 0x20
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~edge[1:-1]  # the first of a run of others, not at a text's start
    kept = np.zeros(len(text) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return text[keep], kept[offsets]


class Parser:
    """Automata of the languages over one alphabet."""

    def __init__(self, training: tuple[tuple[str, bytes], ...], dense_bytes: int = DENSE_BYTES):
        self.languages = [name for name, _ in training]
        seen = sorted({b for _, text in training for b in text})
        self.code = np.full(256, len(seen), np.int32)
        self.code[seen] = np.arange(len(seen))
        self.width = len(seen) + 1
        share = dense_bytes // max(1, len(training))
        self.tables = []
        for _, text in training:
            automaton = SuffixAutomaton(self.code[np.frombuffer(text, np.uint8)].tolist())
            dense = 4 * self.width * (len(automaton.next) + 1) <= share
            self.tables.append(automaton.table(self.width) if dense else automaton.sparse(self.width))
        self.scale = [math.log2(len(text) + 2) for _, text in training]

    def phrases(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts x languages) numbers of phrases."""
        sizes = np.diff(bounds)
        blocks = -(-sizes // BLOCK)
        row = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = bounds[row] + nth * BLOCK
        size = np.minimum(BLOCK, bounds[row + 1] - start)
        order = np.argsort(-size, kind="stable")
        coded = self.code[symbols]
        counts = np.ones((len(self.tables), len(row)), np.int64)
        states = np.zeros((len(self.tables), len(row)), np.int32)
        active = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
        begin = start[order]
        for step, n in enumerate(active.tolist()):
            symbol = coded[begin[:n] + step]
            for k, table in enumerate(self.tables):
                to = table[states[k, :n] + symbol]
                if step:
                    counts[k, :n] += to < 0
                states[k, :n] = to & 0x7FFFFFFF
        out = np.zeros((len(sizes), len(self.tables)), np.int64)
        back = np.argsort(order, kind="stable")
        for k, table in enumerate(self.tables):
            joined = self._joined(table, coded, start, size, nth, counts[k, back], states[k, back])
            np.add.at(out[:, k], row, joined)
        return out

    @staticmethod
    def _joined(table: np.ndarray, coded: np.ndarray, start: np.ndarray, size: np.ndarray, nth: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases that begin in each block, from those of blocks parsed by themselves and the states in which they end."""
        alone, ends, counts = ends, ends.copy(), counts.copy()
        fresh = counts.copy()
        todo = np.flatnonzero(nth > 0)
        while len(todo):
            own, true = np.zeros(len(todo), np.int32), ends[todo - 1]
            more = np.zeros(len(todo), np.int64)
            live = np.arange(len(todo))
            step = 0
            while len(live):
                symbol = coded[start[todo[live]] + step]
                a, b = table[true[live] + symbol], table[own[live] + symbol]
                more[live] += (a < 0).astype(np.int64) - ((b < 0) | (step == 0))
                true[live], own[live] = a & 0x7FFFFFFF, b & 0x7FFFFFFF
                step += 1
                live = live[(true[live] != own[live]) & (step < size[todo[live]])]
            counts[todo] = fresh[todo] + more
            new = np.where(true == own, alone[todo], true)
            changed = todo[new != ends[todo]]
            ends[todo] = new
            # blocks whose predecessor turned out to end in another state are parsed again
            todo = changed[changed + 1 < len(nth)] + 1
            todo = todo[nth[todo] > 0]
        return counts


@functools.lru_cache(maxsize=1)
def parser(training: tuple[tuple[str, bytes], ...]) -> Parser:
    return Parser(training)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True


def _judged(training: tuple[tuple[str, bytes], ...], column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, lang_pred, score, rate) of each slice of a column of texts."""
    parse = parser(training)
    data, offsets = bytetext.column_bytes(column)
    for first, last in bytetext.slices(offsets, 4 * bytetext.SLICE):
        base = int(offsets[first])
        own = offsets[first : last + 1] - base
        raw = data[base : int(offsets[last])]
        n = last - first
        has_letter = np.diff(np.concatenate([[0], np.cumsum(_ASCII_LETTER[raw])])[own]) > 0
        for i in np.flatnonzero(~has_letter & (np.diff(own) > 0)):
            has_letter[i] = any(c.isalpha() for c in raw[own[i] : own[i + 1]].tobytes().decode())
        names, score, rate = np.full(n, UNDETERMINED, object), np.zeros(n), np.full(n, np.nan)
        if parse.languages and n:
            symbols, bounds = symbols_of(raw, own)
            size = np.maximum(np.diff(bounds), 1)
            counts = parse.phrases(symbols, bounds)
            normal = counts * np.array(parse.scale) / size[:, None]
            best = np.argmin(normal, 1)
            least = normal[np.arange(n), best]
            names[has_letter] = np.array(parse.languages, object)[best[has_letter]]
            rate = np.where(has_letter, counts[np.arange(n), best] / size, np.nan)
            if len(parse.languages) > 1:
                second = np.partition(normal, 1, 1)[:, 1]
                score = np.where(has_letter & (second > 0), (second - least) / np.maximum(second, 1e-300), 0.0)
            else:
                score = np.where(has_letter, 1 - np.minimum(1, counts[:, 0] / size), 0.0)
        yield first, n, names, np.clip(score, 0, 1), rate


@bytetext.tidy
def _predict(training: tuple[tuple[str, bytes], ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, names, score, rate in _judged(training, batch.column(2)):
            part = batch.slice(first, n)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(rate, mask=np.isnan(rate)), *part.columns[3:]],
                ["doc_id", "held_out", "lang_pred", "score", "rate", *part.schema.names[3:]],
            )


@bytetext.tidy
def _known(training: tuple[tuple[str, bytes], ...], text: int, max_rate: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, names, _, rate in _judged(training, batch.column(text)):
            kept = (names != UNDETERMINED) & ~(rate > max_rate)
            yield batch.slice(first, n).filter(pa.array(kept))


def known(docs: DataFrame, training: tuple[tuple[str, bytes], ...], max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a learned language."""
    names = [c.lower() for c in docs.columns]
    return docs.mapInArrow(functools.partial(_known, training, names.index("text"), max_rate), docs.schema)


def training_text(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> tuple[tuple[str, bytes], ...]:
    """Symbols of each language, by language name."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") > 0))
    place = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id"), F.octet_length("text")]
    # ranked without the texts; each task keeps no more than docs_per_lang of a language
    first = F.row_number().over(Window.partitionBy("lang").orderBy("digest", "doc_id", "size")) <= docs_per_lang
    sized = usable.select("doc_id", "lang", place[0].alias("digest"), place[2].alias("size"))
    chosen = sized.withColumn("first", first).where("first").select("doc_id").distinct()
    # at most docs_per_lang ids a language: written first, so that their size decides on a broadcast and texts aren't shuffled
    scratch = Scratch(docs.sparkSession, "language")
    chosen = scratch.cut(chosen, "chosen")
    order = Window.partitionBy("lang").orderBy(*place, "text")
    rows = usable.join(scratch.small(chosen), "doc_id", "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs_per_lang)
    got = [(r["lang"], r["rank"], r["text"]) for r in rows.select("lang", "rank", "text").collect()]
    scratch.close()
    return learned(got)


def learned(rows: list[tuple[str, int, str]]) -> tuple[tuple[str, bytes], ...]:
    """The whole texts of rows (lang, rank, text), in the order of their ranks."""
    texts: dict[str, list[bytes]] = {}
    for lang, _, text in sorted(rows):
        data = np.frombuffer(text.encode(), np.uint8)
        texts.setdefault(lang, []).append(symbols_of(data, np.array([0, len(data)]))[0].tobytes())
    return tuple((lang, b" ".join(parts)) for lang, parts in sorted(texts.items()))


def predict(docs: DataFrame, training: tuple[tuple[str, bytes], ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rate (phrases per symbol) of each document, and the columns ``carry``."""
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", *carry).mapInArrow(
        functools.partial(_predict, training), ", ".join([f"doc_id {key}, held_out boolean, lang_pred string, score double, rate double", *carried(docs, carry)])
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, training_text(docs))


QUERIES = {"op2_language_id": op2_language_id}
ORACLE_SQL: dict[str, str] = {}
