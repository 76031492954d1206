"""Operator 7: license scans by diagonal voting.

Base phrases are found word by word. Beyond them, the hashes of the rolling k-grams of a
text are joined in Spark to the positions of license templates' k-grams. A table of
2^FILTER_BITS bits, which may err only by letting n-grams pass, first drops n-grams that no
template can have, so that the join gets a few of them. A match votes for the diagonal (text position - template
position); neighbouring diagonals, which inserted or missing words set apart, are merged,
and each merged diagonal's span is verified: the longest common subsequence of the span's
and the template's words must cover ``MIN_COVER`` of the template. Of a text only the
words around its spans go to that.

Template hashes are fixed by ``TEMPLATES`` (a parameter), so they travel with the code
and the join's template side is as small at any size of the corpus. Votes are combined
per (text, template, diagonal) before the shuffle.

Defined cases: a very long text forms a slice of its own; null or wordless text has no words, places or labels (empty strings), null
first and last word, score 0; repeated rows are scanned each for itself; equal votes
change nothing, since every diagonal with ``MIN_VOTES`` is verified; an empty table gives
no rows. score is the best cover of a verified span, at least ``BASE_SCORE`` where a base
phrase stands. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlathe.llm import bytetext
from twinlathe.llm.license_texts import BASE, TEMPLATES
from twinlathe.llm.storage import Scratch

GRAM = 3
FILTER_BITS = 20
MERGE = 3
MIN_VOTES = 2
MIN_COVER = 0.8
BASE_SCORE = 0.5


def word_hashes(text: str) -> np.ndarray:
    data = text.encode()
    return bytetext.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 0, 1, bytetext.ALNUM).hashes()


@functools.lru_cache(maxsize=4)
def library(templates: tuple[tuple[str, str], ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(word hashes, gram hashes) of each template."""
    words, grams = [], []
    for _, text in templates:
        data = text.encode()
        w = bytetext.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 0, 1, bytetext.ALNUM)
        h = w.hashes()
        g, whole = w.grams(h, GRAM)
        words.append(h)
        grams.append(g[whole])
    return words, grams


@functools.lru_cache(maxsize=4)
def gram_filter(templates: tuple[tuple[str, str], ...]) -> np.ndarray:
    """By the lowest bits of a hash: whether a template may have it."""
    out = np.zeros(1 << FILTER_BITS, bool)
    out[_low(np.concatenate(library(templates)[1]))] = True
    return out


def _low(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _phrase_starts(hashes: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    n = len(hashes) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(hashes[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[(hashes[at + k] == phrase[k]) & (row[at + k] == row[at])]
    return at


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


_SCANNED = "uid long, doc_id {}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, places array<int>, grams array<long>, words array<long>"


def _scan(templates, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    possible = gram_filter(templates)
    phrases = [(word_hashes(p), label) for p, label in BASE]
    for batch in batches:
        data, offsets = bytetext.column_bytes(batch.column(2))
        for first, last in bytetext.slices(offsets):
            words = bytetext.Words(data, offsets, first, last, bytetext.ALNUM)
            hashes, n = words.hashes(), last - first
            per = np.diff(words.bounds)
            row = np.repeat(np.arange(n), per)
            count, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[list[str]] = [[] for _ in range(n)]
            for phrase, label in phrases:
                at = _phrase_starts(hashes, row, phrase)
                r, place = row[at], at - words.bounds[row[at]]
                np.add.at(count, r, 1)
                np.minimum.at(low, r, place)
                np.maximum.at(high, r, place)
                for i in np.unique(r).tolist():
                    labels[i].append(label)
            grams, whole = words.grams(hashes, GRAM)
            hit = np.flatnonzero(whole & possible[_low(grams)])
            hits = np.bincount(row[hit], minlength=n)
            voted = hits >= MIN_VOTES
            hit = hit[voted[row[hit]]]
            kept = voted[row]
            part, none = batch.slice(first, n), count == 0
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(per.astype(np.int64)), pa.array(count), pa.array(low, mask=none), pa.array(high.astype(np.int64), mask=none),
                 pa.array(labels, pa.list_(pa.string())), _lists((hit - words.bounds[row[hit]]).astype(np.int32), np.where(voted, hits, 0)),
                 _lists(grams[hit].view(np.int64), np.where(voted, hits, 0)), _lists(hashes[kept].view(np.int64), np.where(voted, per, 0))],
                ["uid", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "places", "grams", "words"],
            )


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence (bit-parallel over ``b``)."""
    at: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    v = full = (1 << len(b)) - 1
    for w in a.tolist():
        u = v & at.get(w, 0)
        v = (v + u | v - u) & full
    return len(b) - v.bit_count()


def _verify(templates, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = library(templates)[0]
    for batch in batches:
        out = []
        for uid, template, start, words in zip(*[batch.column(i) for i in range(4)]):
            label, own = templates[template.as_py()][0], texts[template.as_py()]
            span = words.values.to_numpy().view(np.uint64)
            cover = common_subsequence(span, own) / len(own)
            if cover >= MIN_COVER:
                out.append((uid.as_py(), label, start.as_py(), start.as_py() + len(span), cover))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
        columns = list(zip(*out)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["uid", "label", "start", "end", "cover"])


def spans(scanned: DataFrame, templates=TEMPLATES) -> DataFrame:
    """uid, label, start, end (word positions) and cover of each verified span."""
    spark = scanned.sparkSession
    rows = [(int(h), t, i) for t, grams in enumerate(library(templates)[1]) for i, h in enumerate(grams.view(np.int64).tolist())]
    positions = spark.createDataFrame(rows, "gram long, template int, at int")
    hits = scanned.where(F.size("places") > 0).select("uid", F.explode(F.arrays_zip("places", "grams")).alias("x")).select("uid", F.col("x.places").alias("place"), F.col("x.grams").alias("gram"))
    votes = hits.join(positions, "gram").groupBy("uid", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("place").alias("low"), F.max("place").alias("high")
    )
    along = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > MERGE).cast("int"), F.lit(1))
    merged = votes.withColumn("new", apart).withColumn("run", F.sum("new").over(along)).groupBy("uid", "template", "run").agg(
        F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.max_by("diagonal", F.struct("votes", -F.col("diagonal"))).alias("diagonal")
    ).where(F.col("votes") >= MIN_VOTES)
    # the template's place by its diagonal, widened by what merging may have moved
    sizes = F.element_at(F.array(*[F.lit(len(w)) for w in library(templates)[0]]), F.col("template") + 1)
    run = F.struct("template", F.greatest(F.lit(0), F.least("diagonal", "low") - MERGE).alias("start"), (F.greatest(F.col("diagonal") + sizes, F.col("high") + GRAM) + MERGE).alias("end"))
    runs = merged.select("uid", run.alias("run")).groupBy("uid").agg(F.collect_list("run").alias("runs"))
    words = scanned.where(F.size("places") > 0).select("uid", "words")
    around = F.transform("runs", lambda r: F.struct(r["template"].alias("template"), r["start"].cast("long").alias("start"), F.slice("words", r["start"] + 1, r["end"] - r["start"]).alias("words")))
    placed = runs.join(words, "uid").select("uid", F.explode(around).alias("x")).select("uid", "x.template", "x.start", "x.words")
    return placed.mapInArrow(functools.partial(_verify, templates), "uid long, label string, start long, end long, cover double")


def scan(docs: DataFrame, templates=TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(one row per document with base and method labels, verified spans by uid)."""
    scratch = Scratch(docs.sparkSession, "licenses")
    key = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    scanned = scratch.cut(numbered.mapInArrow(functools.partial(_scan, templates), _SCANNED.format(key)), "scanned")
    found = scratch.cut(spans(scanned, templates), "spans")
    per_text = found.groupBy("uid").agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover"))
    own = F.coalesce("found", F.array().cast("array<string>"))
    base_score = F.when(F.col("n_base") > 0, F.lit(BASE_SCORE)).otherwise(0.0)
    out = scanned.drop("places", "grams", "words").join(per_text, "uid", "left").select(
        "uid", "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", own)), ",").alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), base_score).alias("score"),
    )
    return out, found


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0].drop("uid")


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 finds without its method: the base columns, which SQL can tell."""
    return op7_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLACES = ", ".join(
    "list_transform(list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) + f"), lambda i: {{'at': i - 1, 'label': '{label}'}})"
    for phrase, label in BASE
)

QUERIES = {"op7_license_scan": op7_license_scan, "license_base_places": license_base_places}
ORACLE_SQL: dict[str, str] = {
    "license_base_places": f"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, len(w)::BIGINT AS n_words, flatten([{_PLACES}]) AS p FROM words)
SELECT doc_id, n_words, len(p)::BIGINT AS n_base, list_min(list_transform(p, lambda x: x.at))::BIGINT AS first_word, list_max(list_transform(p, lambda x: x.at))::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels FROM places"""
}
