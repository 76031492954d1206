"""Operator 11: ranked lexical search over inverted treaps.

Documents become postings of the terms that items ask for (``postings``): term numbers and
counts by document, and the number of all its terms. From that table Spark counts the
documents, terms and document frequencies. Then tasks search it block by block (``_search``):
a block's postings make one treap a term, in which doc_ids are in search order and impacts in
heap order. All items walk their terms' treaps together, level by level: a node of the walk is
an interval of doc_ids with each term's highest node in it. The sum of those nodes' impacts
bounds every score in the interval, so an interval that can't enter the item's best ``TOP`` is
pruned; otherwise the document of its greatest impact is scored and splits it. The best that a
task has found so far prune its later blocks too; a window takes the best of all tasks.

Items are searched in groups of about ``GROUP_TERMS`` terms, hashed by item, each against all
documents; a group's terms travel with the tasks, so what they carry has a bound (one item
whose terms are more is a group alone). Terms are told apart by 64-bit hashes.

Defined cases: null text has no terms; a document without terms counts nowhere and is never
found; very long texts are read whole; rows that repeat, or share a doc_id, are documents of
their own, each with a rank; a null doc_id comes after all others; equal scores are ranked by
doc_id, rows equal in that too in any order (they look the same). Items without terms or
matches have no rows; items equal in id and text are one, items that share an id with other
texts are ranked apart. Empty tables give no rows. doc_id may have any type that orders. Only
doc_id and text, and item_id and text, are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlathe.llm import bytetext
from twinlathe.llm.storage import Scratch

TOP = 10
#: Terms of the items that are searched together, on average.
GROUP_TERMS = 1 << 20
#: (Interval, term) pairs that one step of the walk takes, about; the rest waits.
WALK = 1 << 19


# --- postings ----------------------------------------------------------------------------

@bytetext.tidy
def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key and distinct term hashes of each item."""
    for batch in batches:
        data, offsets = bytetext.column_bytes(batch.column(1))
        terms = []
        for first, last in bytetext.slices(offsets):
            words = bytetext.Words(data, offsets, first, last, bytetext.ALNUM)
            hashes = words.hashes().view(np.int64)
            terms += [np.unique(hashes[a:b]) for a, b in zip(words.bounds, words.bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int64()))], ["key", "terms"])


@bytetext.tidy
def _postings(vocabulary: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, and the numbers and counts of the vocabulary's terms, of documents with a term."""
    known = vocabulary.value
    for batch in batches:
        data, offsets = bytetext.column_bytes(batch.column(1))
        for first, last in bytetext.slices(offsets):
            words = bytetext.Words(data, offsets, first, last, bytetext.ALNUM)
            sizes = np.diff(words.bounds)
            hashes = words.hashes().view(np.int64)
            place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            asked = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
            row = np.repeat(np.arange(last - first), sizes)[asked]
            pair, count = np.unique(row * max(len(known), 1) + place[asked], return_counts=True)
            row, term = np.divmod(pair, max(len(known), 1))
            bounds = np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v.astype(np.int32))) for v in (term, count)]
            part = pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(sizes.astype(np.int64)), *lists], ["doc_id", "n", "terms", "counts"])
            yield part.filter(pa.array(sizes > 0))


# --- treaps ------------------------------------------------------------------------------

class Treaps:
    """One treap for each run of equal ``term``: ``doc`` ascends within a run and is in search
    order, ``impact`` in heap order (ties by a mixed order, so that equal impacts don't make chains)."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        n = len(doc)
        self.doc, self.impact = doc, impact
        rank = np.empty(n, np.int64)
        rank[np.lexsort((bytetext.mix(np.arange(n)), impact))] = np.arange(n)
        run = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if n else np.zeros(0, np.int64)
        self.terms, self.runs = term[run], np.r_[run, n]
        before, after = self._greater(rank, term, -1), self._greater(rank, term, 1)
        ranked = np.r_[rank, n, n]  # positions -1 and n: nothing
        far = np.int64(n + 1)
        left, right = np.where(before >= 0, ranked[before], far), np.where(after < n, ranked[after], far)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        me = np.arange(n)
        # the parent is the lesser of the nearest greater nodes on either side
        of_right, of_left = (left < right), (right < left)
        self.right[before[of_right]] = me[of_right]
        self.left[after[of_left]] = me[of_left]
        self.root = me[(left == far) & (right == far)]

    @staticmethod
    def _greater(rank: np.ndarray, term: np.ndarray, step: int) -> np.ndarray:
        """Nearest place on one side, in the same run, of a greater rank; -1 or n without one.
        Candidates jump over what their own candidates have passed, all at once."""
        n = len(rank)
        at = np.arange(n) + step
        edge = -1 if step < 0 else n
        inside = (at >= 0) & (at < n)
        at[inside & (term[np.clip(at, 0, n - 1)] != term)] = edge
        open_ = np.arange(n)
        while len(open_):
            open_ = open_[(at[open_] >= 0) & (at[open_] < n)]
            open_ = open_[rank[at[open_]] < rank[open_]]
            at[open_] = at[at[open_]]
        return at

    def split(self, node: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each treap's part between ``low`` and ``high`` (exclusive), of which ``node`` is the
        highest, falls apart at ``doc``: its highest node below, the node of doc itself, and the
        highest one above; -1 without one."""
        below, itself, above = (np.full(len(node), -1) for _ in range(3))
        # (entry, node, sought side): after doc itself is met both sides go on by themselves
        entry, at = np.arange(len(node)), node.copy()
        side = np.zeros(len(node), np.int8)
        while len(entry):
            here, want = self.doc[at], doc[entry]
            under, over, met = here < want, here > want, here == want
            hit = under & (side <= 0) & (here > low[entry]) & (below[entry] < 0)
            below[entry[hit]] = at[hit]
            hit = over & (side >= 0) & (here < high[entry]) & (above[entry] < 0)
            above[entry[hit]] = at[hit]
            itself[entry[met]] = at[met]
            follow = np.where(under, self.right[at], self.left[at])
            go = (follow >= 0) & ~met
            # one side alone ends as soon as it is found
            go &= ~(((side < 0) & (below[entry] >= 0)) | ((side > 0) & (above[entry] >= 0)))
            met_left = met & (self.left[at] >= 0) & (below[entry] < 0)
            met_right = met & (self.right[at] >= 0) & (above[entry] < 0)
            entry, at, side = (
                np.concatenate([entry[go], entry[met_left], entry[met_right]]), np.concatenate([follow[go], self.left[at[met_left]], self.right[at[met_right]]]),
                np.concatenate([side[go], np.full(met_left.sum(), -1, np.int8), np.full(met_right.sum(), 1, np.int8)]),
            )
        return below, itself, above


@dataclass
class Best:
    """The best documents of each item: item, score, place (by doc_id; halves lie between two
    documents of the block) and reference, ordered by item, score (descending) and place."""

    top: int
    item: np.ndarray
    score: np.ndarray
    place: np.ndarray
    ref: np.ndarray

    def add(self, item: np.ndarray, score: np.ndarray, place: np.ndarray) -> Best:
        item, score = np.r_[self.item, item], np.r_[self.score, score]
        ref, place = np.r_[self.ref, place.astype(np.int64)], np.r_[self.place, place]
        order = np.lexsort((place, -score, item))
        item = item[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[nth < self.top]
        return Best(self.top, item[nth < self.top], score[kept], place[kept], ref[kept])

    def limits(self, items: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, place) of each item's last best; (0, -1) where it has fewer than ``top``."""
        score, place = np.zeros(items, np.int64), np.full(items, -1.0)
        end = np.searchsorted(self.item, np.arange(items), "right") - 1
        full = (end + 1 - np.searchsorted(self.item, np.arange(items))) >= self.top
        score[full], place[full] = self.score[end[full]], self.place[end[full]]
        return score, place


def walk(treaps: Treaps, wanted_item: np.ndarray, wanted_root: np.ndarray, docs: int, best: Best, items: int, most: int = WALK) -> tuple[Best, int]:
    """``best`` with the block's documents, and how many (item, document) were scored.
    ``wanted``: the roots of each item's terms, ordered by item."""
    item, first = np.unique(wanted_item, return_index=True)
    open_nodes = [(item, np.full(len(item), -1), np.full(len(item), docs), np.diff(np.r_[first, len(wanted_item)]), wanted_root)]
    scored = 0
    while open_nodes:
        item, low, high, sizes, node = open_nodes.pop()
        if len(node) > most and len(item) > 1:
            half = len(item) // 2
            cut = sizes[:half].sum()
            open_nodes += [(item[half:], low[half:], high[half:], sizes[half:], node[cut:]), (item[:half], low[:half], high[:half], sizes[:half], node[:cut])]
            continue
        impact = treaps.impact[node]
        bound = np.add.reduceat(impact, np.cumsum(sizes) - sizes)
        score, place = best.limits(items)
        may = (bound > score[item]) | ((bound == score[item]) & (bound > 0) & (low + 1 < place[item]))
        inside = np.repeat(may, sizes)
        item, low, high, sizes, node, impact = item[may], low[may], high[may], sizes[may], node[inside], impact[inside]
        if not len(item):
            continue
        at = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(item)), sizes)
        # the document of the greatest impact splits the interval
        where = np.flatnonzero(impact == np.maximum.reduceat(impact, at)[owner])
        doc = treaps.doc[node[where[np.searchsorted(owner[where], np.arange(len(item)))]]]
        below, itself, above = treaps.split(node, doc[owner], low[owner], high[owner])
        best = best.add(item, np.add.reduceat(np.where(itself >= 0, treaps.impact[itself], 0), at), doc.astype(float))
        scored += len(item)
        item, low, high = np.r_[item, item], np.r_[low, doc], np.r_[doc, high]
        node, owner = np.r_[below, above], np.r_[owner, owner + len(doc)]
        there = node >= 0
        sizes = np.bincount(owner[there], minlength=len(item))
        any_ = sizes > 0
        if any_.any():
            open_nodes.append((item[any_], low[any_], high[any_], sizes[any_], node[there]))
    return best, scored


# --- search ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Group:
    """Items that are searched together: their terms (numbers, ordered by item), the terms'
    weights, and the totals of all documents."""

    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    items: int
    documents: int
    length: int


def weights(documents: int, frequency: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * f + 1))) for f in frequency.tolist()], np.int64)


def _blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, int]:
    """(order of the rows by doc_id, nulls last, and how many aren't null)."""
    ids = batch.column(0)
    order = np.asarray(pa.compute.sort_indices(ids, null_placement="at_end"))
    return order, len(ids) - ids.null_count


@bytetext.tidy
def _search(group: Broadcast, top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best documents that a task has for each item: item, doc_id, score."""
    ask: Group = group.value
    none = np.zeros(0, np.int64)
    best, ids = Best(top, none, none, np.zeros(0), none), None  # ref: rows of ids
    for batch in batches:
        if not batch.num_rows:
            continue
        order, known = _blocks(batch)
        batch = batch.take(pa.array(order))
        n, terms, counts = (batch.column(k) for k in (1, 2, 3))
        n = np.asarray(n)
        bounds = np.asarray(terms.offsets)
        doc = np.repeat(np.arange(len(n)), np.diff(bounds))
        term, tf = np.asarray(terms.flatten()).astype(np.int64), np.asarray(counts.flatten()).astype(np.int64)
        m = 10 + 90 * n * ask.documents // ask.length
        impact = ask.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        useful = impact > 0
        by_term = np.lexsort((doc[useful], term[useful]))
        treaps = Treaps(term[useful][by_term], doc[useful][by_term], impact[useful][by_term])
        # where the best so far stand among this block's documents
        if ids is not None:
            there = batch.column(0).slice(0, known)
            spot = np.array([len(n) if v is None else _before(there, v) for v in ids.to_pylist()], float) - 0.5
            best.place, best.ref = spot[best.ref], -1 - best.ref
        else:
            best.place, best.ref = best.place, best.ref
        has = np.full(len(ask.weight), -1)
        has[treaps.terms] = treaps.root
        root = has[ask.term]
        wanted_item, wanted_root = ask.item[root >= 0], root[root >= 0]
        if len(wanted_item):
            best, _ = walk(treaps, wanted_item, wanted_root, len(n), best, ask.items)
        # what stays is named by id again
        old, new = best.ref < 0, best.ref >= 0
        kept = batch.column(0).take(pa.array(best.ref[new]))
        before = ids.take(pa.array(-1 - best.ref[old])) if ids is not None else kept.slice(0, 0)
        ref = np.empty(len(best.ref), np.int64)
        ref[old], ref[new] = np.arange(old.sum()), old.sum() + np.arange(new.sum())
        ids, best.ref = pa.concat_arrays([before, kept]), ref
    if ids is not None and len(ids):
        yield pa.RecordBatch.from_arrays([pa.array(best.item), ids.take(pa.array(best.ref)), pa.array(best.score)], ["item", "doc_id", "score"])


def _before(ids: pa.Array, value) -> int:
    """How many of the sorted ids are below ``value``."""
    low, high = 0, len(ids)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if ids[middle].as_py() < value else (low, middle)
    return low


def _asked(items: DataFrame, scratch: Scratch, group_terms: int) -> tuple[DataFrame, int]:
    """Distinct items by key with their term hashes and the group they are searched in."""
    key = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    # a key of 128 bits: it tells rows apart that share an item_id
    key = key.withColumn("key", F.md5(F.concat_ws("|", F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("item_id").isNull().cast("string"), "text")))
    named = scratch.cut(key, "items")
    terms = scratch.cut(named.select("key", "text").mapInArrow(_item_terms, "key string, terms array<long>"), "item-terms")
    total = terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_terms))
    return named.select("item_id", "key").join(terms.where(F.size("terms") > 0), "key").withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))), groups


def search(documents: DataFrame, items: DataFrame, scratch: Scratch, top: int = TOP, group_terms: int = GROUP_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of each item's best documents."""
    spark = documents.sparkSession
    asked, groups = _asked(items, scratch, group_terms)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    ddl = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {id_type}, score long"
    found: DataFrame | None = None
    for k in range(groups):
        rows = asked.where(F.col("group") == k).select("key", "terms").orderBy("key").collect()
        if not rows:
            continue
        hashes = [np.array(r["terms"], np.int64) for r in rows]
        known = np.unique(np.concatenate(hashes))
        vocabulary = spark.sparkContext.broadcast(known)
        table = scratch.cut(documents.select("doc_id", "text").mapInArrow(functools.partial(_postings, vocabulary), f"doc_id {id_type}, n long, terms array<int>, counts array<int>"), "postings")
        totals = table.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        frequency = np.zeros(len(known), np.int64)
        for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            frequency[r["term"]] = r["count"]
        term = np.searchsorted(known, np.concatenate(hashes))
        group = Group(np.repeat(np.arange(len(rows)), [len(h) for h in hashes]), term, weights(totals["documents"], frequency), len(rows), totals["documents"], max(1, totals["length"]))
        names = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(rows)], "item long, key string")
        best = table.mapInArrow(functools.partial(_search, spark.sparkContext.broadcast(group), top), f"item long, doc_id {id_type}, score long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        ranked = scratch.cut(best.withColumn("rank", place).where(F.col("rank") <= top).join(F.broadcast(names), "item"), "ranked")
        scratch.drop(table)
        part = ranked.join(asked.select("item_id", "key"), "key").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], ddl)
    result = scratch.cut(found, "result")
    scratch.close(keep=result)
    return result


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "search"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_, doc_id, regexp_extract_all({_LOWER.format("text")}, '{_TERM}') AS terms FROM documents),
full_ AS (SELECT row_, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS length FROM full_),
items AS (SELECT row_number() OVER () AS it, item_id, list_distinct(regexp_extract_all({_LOWER.format("text")}, '{_TERM}')) AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT it, unnest(terms) AS term FROM items),
counts AS (SELECT row_, term, count(*)::BIGINT AS tf FROM (SELECT row_, unnest(terms) AS term FROM full_) WHERE term IN (SELECT term FROM asked) GROUP BY row_, term),
weights AS (SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
scored AS (
  SELECT it, row_, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // length))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN full_ USING (row_), totals GROUP BY it, row_),
ranked AS (SELECT it, doc_id, score, row_number() OVER (PARTITION BY it ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN full_ USING (row_) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked JOIN items USING (it) WHERE rank <= {TOP}"""

QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLE_SQL = {"op11_ranked_search": SQL}
