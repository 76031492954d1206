"""Alignment of fingerprints against trying every offset."""

import random

import pytest
from pyspark.sql import functions as F

from twinlathe.functions.similarity import MAX_OFFSET, fingerprint_similarity


def _plain(a, b, overlap):
    if not a or not b:
        return None
    short, long = sorted((a, b), key=len)
    bits = 32 * len(short if overlap else long)
    return max(0.0, max(1 - sum((x ^ y).bit_count() for x, y in zip(short, long[o:])) / bits for o in range(min(len(long) - len(short), MAX_OFFSET) + 1)))


def _cases(seed):
    rng = random.Random(seed)
    words = lambda n: [rng.getrandbits(32) for _ in range(n)]
    noisy = lambda p, bits: [w ^ sum(1 << rng.randrange(32) for _ in range(rng.randint(0, bits))) & 0xFFFFFFFF for w in p]
    cases = [(words(rng.randint(0, 12)), words(rng.randint(0, 60))) for _ in range(60)]
    for n, shift in ((1000, 0), (1000, 17), (1000, 32), (1000, 50), (300, 5), (9, 4), (1, 40)):
        p = words(n)
        cases += [(p, words(shift) + noisy(p, 3)), (words(shift) + noisy(p, 8) + words(3), p), (p, words(n + shift)), (p, p + p)]
    return cases + [([0] * 20, [0] * 45), ([1], [1]), ([], [1]), ([0xFFFFFFFF] * 3, [0] * 9)]


@pytest.mark.parametrize("overlap", [False, True])
def test_equals_every_offset(spark, overlap):
    cases = _cases(1)
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(cases)], "k int, a array<long>, b array<long>")
    got = {r["k"]: r["s"] for r in df.select("k", fingerprint_similarity(F.col("a"), F.col("b"), "overlap" if overlap else "longer").alias("s")).collect()}
    for k, (a, b) in enumerate(cases):
        want = _plain(a, b, overlap)
        assert got[k] == want or abs(got[k] - want) < 1e-12, k
