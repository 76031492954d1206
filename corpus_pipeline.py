"""Corpus pipeline: five stages over ``documents``, each one training-data operator.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. ``run`` writes each stage's result as Parquet to the shared folder and reads
it back as the next one's docs, so a lost executor costs no more than one stage's tasks.

1. quality rules: documents that fail the base rules or that a learned rule rejects go.
2. language ID: documents in no learned language go (no letters, or more phrases per
   symbol than text in a known language needs).
3. n-gram Jaccard join (5 words, 0.8): of linked documents the one with the smallest
   doc_id stays; ties (a repeated or missing doc_id) go to the smallest hash of the text.
4. mixing: documents are taken as often as the capped shares of their sources say; a
   document taken twice is two rows, one not taken goes.
5. BPE: the ids of each row's text, and the digests of ids and decoded text.

All but the last return the columns of documents. Extra columns of the input are kept up
to the last stage, whatever their names. Every decision is made for a row, known by doc_id
and a hash of its text, so that rows that share a doc_id (or have none) are not mixed up.
An empty table gives no rows; very long texts are read whole by every stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlathe.llm import bpe, jaccard_join, language_id, mixing, quality_rules
from twinlathe.llm.storage import Scratch, cleared


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


class _Rows:
    """docs with a 128-bit hash of the text. (doc_id, hash) tells rows apart that share a
    doc_id; rows equal in both are told the same by every operator that reads texts."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.hashes = (_fresh(docs, "_text_hash_1"), _fresh(docs, "_text_hash_2"))
        text = F.col("text")
        self.keyed = docs.withColumns({self.hashes[0]: F.xxhash64(text), self.hashes[1]: F.xxhash64(F.lit(1), text)})
        self.key = ("doc_id", *self.hashes)

    def matched(self, rows: DataFrame, table: DataFrame, how: str, key: tuple[str, ...] | None = None) -> DataFrame:
        """``rows`` (of ``keyed``) joined with ``table`` by the key, null equal to null."""
        key = key or self.key
        names = [_fresh(rows, f"_key_{k}") for k in range(len(key))]
        other = table.select(*[F.col(c).alias(n) for c, n in zip(key, names)], *[c for c in table.columns if c not in key])
        same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(key, names)]
        return rows.join(other, functools.reduce(Column.__and__, same), how).drop(*names)

    def without(self, decisions: DataFrame, kept: Column, scratch: Scratch) -> DataFrame:
        """The rows that ``decisions`` (rows by their key) don't reject. The rejected keys, fewer than
        the kept ones, are written first and broadcast if few enough; then no text is shuffled."""
        rejected = decisions.where(~F.coalesce(kept, F.lit(False))).select(*self.key).distinct()
        return self.matched(self.keyed, scratch.small(scratch.cut(rejected, "rejected")), "left_anti")


def _small(scratch: Scratch, whole: DataFrame, part: DataFrame) -> DataFrame:
    """``part`` of the written table ``whole``, to be broadcast if that has few enough rows."""
    return part if scratch.small(whole) is whole else F.broadcast(part)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and that no learned rule rejects. Null, empty and wordless
    texts go; of rows that share a doc_id each is judged by its own text; an empty table stays empty.
    The statistics are written beside their rows, which the rules then filter: nothing is joined."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = quality_rules.judged(whole, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("row",))
    return judged.where("kept").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in one of the learned languages. Null texts and those without a letter go; of rows
    that share a doc_id each is judged by its own text; where nothing can be learned all go."""
    return language_id.known(docs, language_id.training_text(docs))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows: the one with the smallest doc_id (a null comes after
    all others), of several with that doc_id the one with the smallest hash of its text, of rows
    equal in both the one whose other columns come first as JSON. Rows without words link with nothing and stay."""
    rows, scratch = _Rows(docs), Scratch(spark, "jaccard")
    groups = jaccard_join.join(rows.keyed, carry=rows.hashes).where("group IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull(), *rows.key)
    stays = groups.groupBy("group").agg(F.min(place).alias("stays"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    judged = scratch.cut(groups.join(stays, "group").select(*rows.key, (place == F.col("stays")).alias("first")), "judged")
    left = rows.without(judged, F.col("first"), scratch)
    # rows equal in doc_id and text are compared with each other only
    repeated = scratch.cut(judged.where("first").groupBy(*rows.key).agg(F.count("*").alias("rows")).where("rows > 1").drop("rows"), "repeated")
    repeated = scratch.small(repeated)
    # combined before they are shuffled, however many they are
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]))
    one = rows.matched(left, repeated, "left_semi").groupBy(*rows.key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), others).alias("row")).select("row.*")
    return rows.matched(left, repeated, "left_anti").select(*docs.columns).unionByName(one)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: a row taken twice is two rows, one not taken goes.
    Rows without words (null and empty texts too) are taken as their source's whole epochs say."""
    rows, scratch = _Rows(docs), Scratch(spark, "mixing")
    times, copy = _fresh(docs, "_copies"), _fresh(docs, "_copy")
    source = _fresh(docs, "_source")
    keyed = rows.keyed.withColumn(source, F.col("source"))
    key = (*rows.key, source)
    taken = mixing.mix(keyed, carry=(*rows.hashes, source)).groupBy(*key).agg(
        F.min("copies").cast("int").alias(times), F.max("copies").cast("int").alias("most"), F.sum(F.col("copies")).alias("sum"), F.count("*").alias("rows")
    )
    # most documents are taken once: only the others need a look-up
    other = scratch.cut(taken.where(f"most <> 1 OR `{times}` <> 1"), "copies")
    small = functools.partial(_small, scratch, other)
    even = rows.matched(keyed, small(other.where(f"most = `{times}`").select(*key, times)), "left", key).withColumn(times, F.coalesce(times, F.lit(1)))
    # rows equal in doc_id, source and text between which the fraction ends: the first ones by number are taken once more
    uneven = other.where(f"most <> `{times}`")
    even = rows.matched(even, small(uneven.select(*key)), "left_anti", key)
    number, extra = _fresh(docs, "_number"), _fresh(docs, "_extra")
    split = rows.matched(keyed, small(uneven.select(*key, times, (F.col("sum") - F.col("rows") * F.col(times)).alias(extra))), "inner", key)
    split = split.withColumn(number, F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    split = split.withColumn(times, F.col(times) + (F.col(number) <= F.col(extra)).cast("int")).drop(number, extra)
    both = even.unionByName(split).where(F.col(times) > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and ids of each row, their number, and digests of the ids and of the text that they
    decode to. A null text is empty and has no ids."""
    coded = bpe.encode_decode(docs)
    return coded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.joined(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", bpe_stage),
]

#: The learned rules, the automata and BPE are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables, and its predecessor's result, go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        path = scratch.folder(name.replace(" ", "-"))
        with cleared(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before is not None:
            scratch.drop(before)
        docs = before = spark.read.schema(out.schema).parquet(path)
    return docs
