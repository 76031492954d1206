import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))
import numpy as np  # noqa: E402
import oracle  # noqa: E402
from twinlathe.llm import embedding_dedup as ed  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_oracle(spark):
    oracle.same(spark, SF, ed.op4_embedding_dedup, ed.ORACLE_SQL["op4_embedding_dedup"])


def test_groups_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 64)
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.02 * rng.normal(size=16)).tolist(), 1) for i in range(300)]  # one bucket of near copies, more than a block
    rows += [(1000, base.tolist(), 2), (1001, base.tolist(), 2), (1001, base.tolist(), 2), (1002, None, 1), (1003, base.tolist(), None), (1004, [0.0] * 16, 1), (1005, [float("nan")] * 16, 1), (1006, [None] * 16, 1), (1007, [], 1), (1008, base.tolist()[:8], 1)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, label int, node int")
    got = {}
    for r in ed.dedup(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    x = np.array([r[1] for r in rows[:300]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = (u @ u.T >= 0.98).sum(1) - 1
    found = np.array([got[i][0][0] for i in range(300)])
    assert (found <= expected).all() and found.sum() >= 0.99 * expected.sum()
    assert got[1000] == [(2, 1000, True)] and got[1001] == [(2, 1000, False)] * 2
    assert all(got[i] == [(0, i, True)] for i in range(1002, 1009))
    assert ed.dedup(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, factors, _ = ed.encode(x)
    estimates, error = ed.estimate(codes, factors, x @ ed.rotations(64)[:, :64])
    true = x @ x.T
    off = ~np.eye(400, dtype=bool)
    assert abs((estimates - true)[off].mean()) < 0.005
    spread = np.abs(estimates - true) / (error[:, None] * np.sqrt(np.maximum(1e-9, 1 - true**2)))
    assert np.quantile(spread[off], 0.999) < ed.SIGMAS
