import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))
import oracle  # noqa: E402
import pytest  # noqa: E402

from twinlathe.llm import mixing  # noqa: E402

SF = "/root/testdata/sf0.001"


def filled(sizes, weights, total=1.5, most=2.0):
    """Repeated clamping, as the method is described."""
    free, fixed, left = dict(enumerate(sizes)), {}, total * sum(sizes)
    while True:
        w = sum(weights[i] for i in free)
        over = [i for i, s in free.items() if left * weights[i] / w > most * s]
        if not over:
            return [fixed.get(i, left * weights[i] / w if i in free else 0) for i in range(len(sizes))]
        for i in over:
            fixed[i] = most * free.pop(i)
            left -= fixed[i]


def test_oracle(spark):
    oracle.same(spark, SF, mixing.op1_source_mixing, mixing.ORACLE_SQL["op1_source_mixing"])


@pytest.mark.parametrize("sizes", [[100, 10, 10, 5], [7, 7, 7], [1000, 1, 500, 3, 90, 12, 4], [5]])
def test_targets_are_the_fixed_point(spark, sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    df = mixing.cyclic_weights(spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size long"))
    got = [r["target"] for r in mixing.targets(df).orderBy("source").collect()]
    assert got == pytest.approx(filled(sizes, weights))


def test_taken_comes_near_target(spark, documents):
    rows = mixing.mix(documents.select("doc_id", "source", "text")).collect()
    again = mixing.mix(documents.select("doc_id", "source", "text")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in rows)
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
        largest[r["source_size"]] = max(largest[r["source_size"]], r["size"])
    assert all(abs(taken[k] - target[k]) <= largest[k] / 2 + 1 for k in target)


def test_edge_cases(spark, edge_docs, no_docs, edge_rows):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    sizes = {r["doc_id"]: r["size"] for r in rows}
    assert sizes[1] == sizes[2] == sizes[3] == 0 and sizes[5] == 2 and sizes[4] == 60_000
    assert mixing.mix(no_docs).count() == 0


def walked(rows, plan, seed=mixing.SEED):
    """(doc_id, size, copies) of one source's rows, taken one by one in the order of their digests."""
    import hashlib

    whole, rest = plan
    out, before = [], 0
    for digest, size, doc_id in sorted((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), n, -1 if i is None else i) for i, n in rows):
        out.append((doc_id, size, whole + (before + size / 2 < rest)))
        before += size
    return sorted(out)


def test_rows_that_share_a_doc_id_are_split(spark):
    """A third of the rows have no doc_id, a third share one; sizes tie, also at 0."""
    rows = [(None, k % 4) for k in range(400)] + [(7, 3) for _ in range(400)] + [(100 + k, k % 9) for k in range(400)]
    for total in (0.2, 0.5, 0.8, 1.0, 1.3, 1.7):
        df = spark.createDataFrame([(i, "a", n) for i, n in rows], "doc_id long, source string, size long")
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["copies"]) for r in mixing.sample(df, total_epochs=total).collect())
        target = min(total, 2) * sum(n for _, n in rows)
        whole = int(target // sum(n for _, n in rows))
        by_row = walked(rows, (whole, target - whole * sum(n for _, n in rows)))
        end = [c for c in by_row if c[1] > 0]
        assert [c for c in got if c[1] > 0] == end
        assert abs(sum(n * c for _, n, c in got) - target) <= 9
