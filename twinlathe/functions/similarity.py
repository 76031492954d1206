"""Scores of pairs: text, duration and fingerprint similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlathe.storage import materialized

MAX_OFFSET = 32
DURATION_SECONDS, DURATION_PART = 2.0, 0.05


def indel_ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|), the LCS bit-parallel over ``b``."""
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    v = full = (1 << len(b)) - 1
    for c in a:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return 2 * (len(b) - v.bit_count()) / (len(a) + len(b))


def text_similarity(a: str | None, b: str | None) -> float:
    """The better of the plain ratio and that of the sorted words; 0 where a side is empty."""
    if not a or not b:
        return 0.0
    return max(indel_ratio(a, b), indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


@F.pandas_udf(T.DoubleType())
def text_sim(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([text_similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def with_text_sims(df: DataFrame, **pairs: tuple[Column, Column]) -> DataFrame:
    """``df`` with a similarity for each name. Rows in which every pair is equal, or has an
    empty side, are scored without Python."""
    easy = F.lit(True)
    for a, b in pairs.values():
        easy = easy & ((F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))) | (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""))
    plain = lambda a, b: F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(1.0)
    same = df.where(easy).withColumns({k: plain(a, b) for k, (a, b) in pairs.items()})
    other = df.where(~easy).withColumns({k: text_sim(a, b) for k, (a, b) in pairs.items()})
    return same.unionByName(other)


#: Buckets of characters in a signature, and how many of a bucket's characters have planes of their own.
_BUCKETS, _PLANES = 64, 8
#: What Python's split takes for white space, besides single spaces between words.
_SPACED = "^ | $|  |[\t-\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def character_planes(text: Column) -> Column:
    """planes: bit b of plane k says whether more than k of the text's characters fall into bucket b;
    over: characters beyond the last plane; n: length; plain: words are apart by single spaces."""
    buckets = F.transform(F.split(text, ""), lambda c: F.pmod(F.xxhash64(c), F.lit(_BUCKETS)).cast("int"))

    def counted(all_: Column) -> Column:
        counts = F.transform(F.array_distinct(all_), lambda b: F.struct(b.alias("b"), F.size(F.filter(all_, lambda x: x == b)).alias("n")))
        one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
        plane = lambda c, k: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: F.when(x["n"] > k, s.bitwiseOR(one(x["b"]))).otherwise(s))
        over = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + F.greatest(x["n"] - _PLANES, F.lit(0)))
        return F.transform(F.array(counts), lambda c: F.struct(F.array(*[plane(c, k) for k in range(_PLANES)]).alias("planes"), over(c).alias("over"), F.length(text).alias("n"), (~text.rlike(_SPACED)).alias("plain")))[0]

    return F.transform(F.array(F.filter(buckets, lambda _, i: i < F.length(text))), counted)[0]


def most_alike(a: Column, b: Column) -> Column:
    """An upper bound of the text similarity of two texts, from their ``character_planes``: no more
    characters can be matched than both have. The order of words doesn't matter to it."""
    common = sum([F.bit_count(a["planes"][k].bitwiseAND(b["planes"][k])) for k in range(_PLANES)], F.least(a["over"], b["over"]))
    return F.when(a["plain"] & b["plain"], 2.0 * common / (a["n"] + b["n"])).otherwise(1.0)


def bounded(pairs: DataFrame) -> DataFrame:
    """a, b (a <= b) of the distinct pairs of texts that aren't empty, with ``bound``. A text's
    signature is made once, however many pairs it is in."""
    distinct = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> '' AND b <> ''").distinct()
    texts = distinct.select(F.col("a").alias("t")).unionByName(distinct.select(F.col("b").alias("t"))).distinct()
    signed = materialized(texts.select("t", character_planes(F.col("t")).alias("s")), "signatures")
    side = lambda c: signed.select(F.col("t").alias(c), F.col("s").alias(f"s_{c}"))
    return distinct.join(side("a"), "a").join(side("b"), "b").select("a", "b", most_alike(F.col("s_a"), F.col("s_b")).alias("bound"))


def alike(pairs: DataFrame, least: float) -> DataFrame:
    """a, b (a <= b), sim of the distinct pairs of texts with a similarity of at least ``least``.
    Pairs whose characters alone refute it are never aligned, and none is aligned twice."""
    possible = bounded(pairs).where(F.col("bound") >= least - 1e-9)
    return with_text_sims(possible.select("a", "b"), sim=(F.col("a"), F.col("b"))).where(F.col("sim") >= least)


def duration_diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def durations_close(a: Column, b: Column) -> Column:
    """Within 2 s or 5 % of the longer; null where a side is unknown."""
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, F.abs(a - b) <= F.greatest(F.lit(DURATION_SECONDS), DURATION_PART * F.greatest(a, b)))


def decode_fingerprint(c: Column) -> Column:
    """32-bit words (array of bigint) from comma-joined decimals or base64; empty where corrupt."""
    s = F.trim(F.coalesce(c, F.lit("")))
    decimals = F.transform(F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^[0-9]+$")), lambda x: x.cast("bigint"))
    data = F.when(F.length(s) % 4 == 0, F.try_to_binary(s, F.lit("base64")))
    n = F.coalesce(F.floor(F.octet_length(data) / 4), F.lit(0)).cast("int")
    words = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.hex(F.substring(data, i * 4 + 1, F.lit(4))), 16, 10).cast("bigint")))
    empty = F.array().cast("array<bigint>")
    return F.when(F.contains(s, F.lit(",")), decimals).otherwise(F.coalesce(words, empty))


def fingerprint_similarity(a: Column, b: Column, normalise: str = "longer") -> Column:
    """Best share of agreeing bits over alignments of the shorter print on the longer, by at
    most 32 words. The share is of the longer print's bits, or with ``normalise='overlap'``
    of the shorter's. ``a`` and ``b`` are decoded prints; null where one is empty."""
    swap = F.size(a) > F.size(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    n, m = F.size(short), F.size(long)
    bits = 32.0 * (m if normalise == "longer" else n)

    def score(offset: Column) -> Column:
        pairs = F.zip_with(short, F.slice(long, offset + 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return 1.0 - F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / bits

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.least(m - n, F.lit(MAX_OFFSET))), score))
    return F.when((n > 0) & (m > 0), F.greatest(F.lit(0.0), best))
