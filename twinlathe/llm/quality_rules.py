"""Operator 10 [native]: quality rules as learned decision lists.

``statistics`` computes interpretable statistics of every whole text with DataFrame
functions alone. ``learn`` grows an ordered list of rules for the rejected class by
sequential covering: each rule is a conjunction of thresholds, grown by FOIL gain on
two thirds of the labelled rows and pruned (last conditions dropped) by (p - n) / (p + n)
on the rest; rows that a rule covers leave before the next rule. Every step is one
aggregate of (feature, bin, label, split) counts over all labelled rows, so what comes
to the driver is bounded by features x bins and never by rows. ``verdict`` emits the
list as one CASE expression that Catalyst compiles.

Defined cases: null or wordless text has zero in every statistic and fails the base
rules; a window of five words is found twice also where both places overlap; labels of
null doc_id or null quality are not used, several labels of a document count as their
lowest; without labels of both classes the list is empty and keeps what passes the base
rules; thresholds that tie with a value keep it in the lower bin; repeated rows repeat
their result; an empty table gives no rows. Only doc_id and text (doc_id and quality of
labels) are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlathe.llm.storage import Scratch

WINDOW = 5
QUANTILES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99)
MAX_RULES = 6
MAX_CONDITIONS = 3
#: A rule must reject this part of what it covers rightly, on both splits.
MIN_PRECISION = 0.95
#: And cover this many rejected rows of the growing split.
MIN_COVER = 5

FEATURES = ("n_words", "mean_word", "symbol_rate", "mark_rate", "upper_rate", "dup_line_rate", "repeat_rate")


def statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts and the features of each document, and the columns ``carry``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"), *carry).select("doc_id", *carry, "text", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    n = F.size("words")
    at = [lambda i, k=k: F.get("words", i + k) for k in range(WINDOW)]
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[a(i) for a in at])))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "doc_id", *carry, n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^!?]+", "")).cast("long").alias("n_marks"),
        F.length(F.regexp_replace("text", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        lines.alias("lines"), windows.alias("windows"),
    )
    # only texts with a repeated window are sorted
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.select(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_marks", "n_upper", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).alias("placed"),
    )
    same = lambda x, i: F.coalesce(F.get("placed", i)["h"] == x["h"], F.lit(False))
    twice = F.filter("placed", lambda x, i: same(x, i - 1) | same(x, i + 1))
    places = F.array_sort(F.transform(twice, lambda x: x["p"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    covered = F.aggregate(
        places, start,
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["sum"] + WINDOW - F.greatest(a["end"] - p, F.lit(0))).alias("sum")),
        lambda a: a["sum"],
    )
    counted = df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("placed").isNotNull(), covered), F.lit(0)).cast("long")).drop("placed")
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counted.withColumns({
        "mean_word": rate("word_chars", "n_words"), "symbol_rate": rate("n_symbols", "n_words"), "mark_rate": rate("n_marks", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"), "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words"),
    })


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature`` above (or not above) ``threshold``."""

    feature: str
    above: bool
    threshold: float
    bin: int

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def binned(self) -> Column:
        return F.col(f"bin_{self.feature}") >= self.bin if self.above else F.col(f"bin_{self.feature}") < self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def _gain(p0: float, n0: float, p1: float, n1: float) -> float:
    if not p1:
        return -math.inf
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def learn(stats: DataFrame, labels: DataFrame, scratch: Scratch) -> list[Rule]:
    """Rules for documents to reject (label quality 0), in order."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    kept = [F.col(f).cast("double").alias(f) for f in FEATURES]
    labelled = stats.where(~base_failed()).join(marks, "doc_id").select("doc_id", "bad", *kept)
    cuts = labelled.agg(*[F.percentile_approx(f, list(QUANTILES), 10_000).alias(f) for f in FEATURES]).first()
    thresholds = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
    bin_of = lambda f: sum([(F.col(f) > t).cast("int") for t in thresholds[f]], F.lit(0)).alias(f"bin_{f}")
    grow = F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0
    rows = scratch.cut(labelled.select("bad", grow.alias("grow"), *map(bin_of, FEATURES)), "labelled")
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"bin_{f}").alias("bin")) for f in FEATURES])).alias("x")

    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        left = rows.where(_all([~_all([c.binned() for c in rule]) for rule in rules]))
        conditions: list[Condition] = []
        trail: list[dict] = []  # counts of each prefix of the conjunction
        while True:
            held = left.where(_all([c.binned() for c in conditions]))
            counts: dict = {}
            for r in held.select("bad", "grow", long).groupBy("x.feature", "x.bin", "bad", "grow").count().collect():
                counts.setdefault(r["feature"], {}).setdefault(r["bin"], {})[r["grow"], r["bad"]] = r["count"]
            total = {k: sum(b.get(k, 0) for b in counts.get(FEATURES[0], {}).values()) for k in ((g, y) for g in (True, False) for y in (True, False))}
            trail.append(total)
            p0, n0 = total[True, True], total[True, False]
            if len(conditions) == MAX_CONDITIONS or not p0 or not n0:
                break
            best, choice = 0.0, None
            for f in FEATURES:
                bins = counts.get(f, {})
                for k, t in enumerate(thresholds[f], 1):
                    p_above = sum(b.get((True, True), 0) for x, b in bins.items() if x >= k)
                    n_above = sum(b.get((True, False), 0) for x, b in bins.items() if x >= k)
                    for above, p, n in ((True, p_above, n_above), (False, p0 - p_above, n0 - n_above)):
                        if p >= MIN_COVER and (g := _gain(p0, n0, p, n)) > best + 1e-9:
                            best, choice = g, Condition(f, above, float(t), k)
            if choice is None:
                break
            conditions.append(choice)
        worth = lambda c: (c[False, True] - c[False, False]) / max(1, c[False, True] + c[False, False])
        # the shortest of the best prefixes
        size = max(range(1, len(conditions) + 1), key=lambda k: (worth(trail[k]), -k), default=0)
        if not size:
            break
        precise = all(trail[size][g, True] >= MIN_PRECISION * (trail[size][g, True] + trail[size][g, False]) for g in (True, False))
        if not precise or trail[size][True, True] < MIN_COVER:
            break
        rules.append(tuple(conditions[:size]))
    scratch.drop(rows)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number, from 1, of the first rule that rejects the row; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = _all([c.column() for c in rule])
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of each document with base_failed, rule (0: none), kept and the columns ``carry``."""
    scratch = Scratch(docs.sparkSession, "quality")
    # zstd, as the carried columns may hold texts
    stats = scratch.cut(statistics(docs, carry), "statistics", "zstd")
    rules = learn(stats, labels, scratch)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 counts, and the base rules' verdict, which SQL can tell."""
    counts = statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("base_failed", base_failed())
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {"op10_quality_rules": op10_quality_rules, "quality_base_counts": quality_base_counts}
ORACLE_SQL: dict[str, str] = {
    "quality_base_counts": rf"""
WITH t AS (
  SELECT row_number() OVER () AS row_, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT row_, i, list_aggregate(w[i : i + {WINDOW - 1}], 'string_agg', ' ') AS g FROM (SELECT row_, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t)),
twice AS (SELECT row_, i FROM (SELECT row_, i, count(*) OVER (PARTITION BY row_, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT row_, count(DISTINCT at_) AS n FROM (SELECT row_, unnest(range(i, i + {WINDOW})) AS at_ FROM twice) GROUP BY row_),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN covered USING (row_))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted"""
}
