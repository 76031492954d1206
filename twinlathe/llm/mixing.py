"""Operator 1: mixing sources to target weights by capped water-filling.

``targets`` turns source sizes and weights into target amounts: shares follow the
weights, a source whose share would exceed ``max_epochs`` times its size is clamped
there, and what it leaves is shared again by weight. Sorted by size / weight, the
clamped sources form a prefix, so one window over the sources finds the fixed point
that repeated clamping reaches.

``sample`` gives each document whole repetitions, floor(target / size of its source),
and one more to a seeded part of the source's documents that holds the fraction left.
Documents are ordered by a seeded digest of doc_id; the first 4096th-parts that fit are
taken whole from (source, bucket) sums, and only the bucket in which the fraction ends
is ordered, by sums of rows with equal digest and size; no more than one such sum of a
source is taken in part and numbered by row. No source's rows meet in one task: sums are combined before the
shuffle, and decisions come back by a join on (source, salt).

Defined cases: null or wordless text has size 0, is never split over the boundary and
takes 0 words; null sources form one source, last in order; a source of size 0 has
target 0; rows with the same doc_id share their digest and are then ordered by size; a very long
text is counted whole;
an empty table gives no rows. Columns of the input other than doc_id, source and text
are not read, and clashing names do no harm because outputs are built from those three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlathe.llm.storage import Scratch

WEIGHTS = (3, 1, 2)
TOTAL_EPOCHS = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
SALTS = 64


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and \\t to \\r (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, total_epochs: float = TOTAL_EPOCHS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sizes``: one row per source with source, size and weight. Adds target (double)."""
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("size") * F.lit(float(max_epochs))
    df = (
        sizes.withColumn("cap", cap)
        .withColumn("total", F.sum("size").over(everything) * F.lit(float(total_epochs)))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("clamped", F.col("cap") * F.col("left_weight") <= F.col("left") * F.col("weight"))
        .withColumn("clamped_cap", F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(everything))
        .withColumn("clamped_weight", F.sum(F.when(F.col("clamped"), F.col("weight")).otherwise(0)).over(everything))
    )
    share = (F.col("total") - F.col("clamped_cap")) * F.col("weight") / (F.col("weights") - F.col("clamped_weight"))
    return df.select(*sizes.columns, F.when(F.col("clamped"), F.col("cap")).otherwise(share).alias("target"))


def cyclic_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weights repeat over the sources in code point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))


def sample(docs: DataFrame, max_epochs: float = MAX_EPOCHS, total_epochs: float = TOTAL_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs``: doc_id, source, size. Returns doc_id, size, source_size, target, taken,
    copies (how many times the document is taken: 0 to max_epochs) and the columns ``carry``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = docs.select("doc_id", "source", "size", *carry, digest.alias("digest")).withColumn("bucket", F.substring("digest", 1, 3))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = targets(cyclic_weights(sums.groupBy("source").agg(F.sum("bucket_size").alias("size")), weights), total_epochs, max_epochs)
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    plan = sources.select(
        "source", F.col("size").alias("source_size"), "target",
        F.floor(rate).cast("long").alias("whole"),
        (F.col("target") - F.floor(rate) * F.col("size")).alias("rest"),
    )
    # where the fraction ends: the first bucket that the rest doesn't cover
    by_bucket = Window.partitionBy("source").orderBy("bucket")
    reached = sums.withColumn("upto", F.sum("bucket_size").over(by_bucket)).withColumn("before", F.col("upto") - F.col("bucket_size"))
    end = (
        reached.join(plan.select(F.col("source").alias("s2"), "rest"), F.col("source").eqNullSafe(F.col("s2")))
        .where(F.col("upto") > F.col("rest")).groupBy("source")
        .agg(F.min(F.struct("bucket", "before")).alias("end"))
    )
    plan = plan.join(end.withColumnRenamed("source", "s3"), F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3")
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "plan_source")
    salt = F.conv(F.substring("digest", 4, 2), 16, 10).cast("int") % SALTS
    rows = keyed.withColumn("doc_salt", salt).join(salted, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("doc_salt") == F.col("salt")))
    at_end = F.col("end").isNotNull() & (F.col("bucket") == F.col("end.bucket"))
    inside = F.col("end").isNull() | (F.col("bucket") < F.col("end.bucket"))
    base = rows.select(
        "doc_id", "source", "size", *carry, "source_size", "target", "whole", "rest", "digest", at_end.alias("at_end"),
        inside.cast("long").alias("extra"), F.col("end.before").alias("before"),
    )
    settled = base.where(~F.col("at_end"))
    # rows with equal digest and size are one step of the order; the document on which the fraction ends is taken if that comes nearer
    steps = base.where("at_end").groupBy("source", "digest", "size").agg(F.count("*").alias("rows"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    by_step = Window.partitionBy("source").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(by_step), F.lit(0))
    fits = lambda k: F.col("upto") + k * F.col("size") + F.col("size") / 2.0 < F.col("rest")
    near = F.when(F.col("size") > 0, F.least("rows", F.greatest(F.lit(0), F.ceil((F.col("rest") - F.col("upto")) / F.col("size") - 0.5)))).otherwise(0).cast("long")
    exact = F.col("near") + (fits(F.col("near")) & (F.col("near") < F.col("rows"))).cast("long") - (~fits(F.col("near") - 1) & (F.col("near") > 0)).cast("long")
    fitting = F.when(F.col("size") > 0, exact).otherwise(F.when(F.col("upto") < F.col("rest"), F.col("rows")).otherwise(0))
    steps = steps.withColumn("upto", upto).withColumn("near", near).select(F.col("source").alias("s4"), F.col("digest").alias("d4"), F.col("size").alias("n4"), "rows", fitting.alias("fitting"))
    same = F.col("source").eqNullSafe(F.col("s4")) & (F.col("digest") == F.col("d4")) & (F.col("size") == F.col("n4"))
    edge = base.where("at_end").join(steps, same)
    # at most one step of a source is taken in part
    whole = edge.where("fitting = 0 OR fitting = rows").withColumn("extra", (F.col("fitting") > 0).cast("long"))
    number = F.row_number().over(Window.partitionBy("source", "digest", "size").orderBy(*(carry or ("doc_id",))))
    part = edge.where("fitting > 0 AND fitting < rows").withColumn("extra", (number <= F.col("fitting")).cast("long"))
    copies = F.col("whole") + F.col("extra")
    out = ["doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), *carry]
    return settled.select(*out).unionByName(whole.select(*out)).unionByName(part.select(*out))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Documents (doc_id, source, text) with their sizes, targets and copies."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *options.get("carry", ()))
    # texts are counted once: what follows reads the sizes twice
    return sample(Scratch(docs.sparkSession, "mix").cut(sized, "sizes"), **options)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_source_mixing": op1_source_mixing}

ORACLE_SQL = {
    "op1_source_mixing": r"""
WITH keyed AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
sums AS (
  SELECT source, substr(digest, 1, 3) AS bucket, sum(size)::BIGINT AS bucket_size FROM keyed GROUP BY ALL),
sizes AS (
  SELECT source, sum(bucket_size)::BIGINT AS size,
         [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM sums GROUP BY source),
ordered AS (
  SELECT *, size * 2.0::DOUBLE AS cap, (sum(size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, (sum(weight) OVER ())::BIGINT AS weights,
         coalesce(sum(size * 2.0::DOUBLE) OVER w, 0.0) AS cap_before, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_before
  FROM sizes
  WINDOW w AS (ORDER BY size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (
  SELECT *, cap * (weights - weight_before) <= (total - cap_before) * weight AS clamped FROM ordered),
summed AS (
  SELECT *, sum(CASE WHEN clamped THEN cap ELSE 0.0::DOUBLE END) OVER () AS clamped_cap,
         (sum(CASE WHEN clamped THEN weight ELSE 0 END) OVER ())::BIGINT AS clamped_weight
  FROM judged),
target AS (
  SELECT source, size AS source_size,
         CASE WHEN clamped THEN cap ELSE (total - clamped_cap) * weight / (weights - clamped_weight) END AS target
  FROM summed),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
         target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS rest
  FROM target),
running AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.whole, p.rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.digest, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         substr(k.digest, 1, 3) AS bucket, k.source
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source),
reached AS (
  SELECT source, bucket, sum(bucket_size) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM sums),
ends AS (
  SELECT r.source, min(r.bucket) AS bucket FROM reached r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
  WHERE r.upto > p.rest GROUP BY r.source)
SELECT r.doc_id, r.size, r.source_size, r.target,
       (r.size * (r.whole + CASE WHEN e.bucket IS NULL OR r.bucket < e.bucket THEN 1
                                 WHEN r.bucket > e.bucket THEN 0
                                 WHEN r.before + r.size / 2.0::DOUBLE < r.rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running r LEFT JOIN ends e ON r.source IS NOT DISTINCT FROM e.source
"""
}
