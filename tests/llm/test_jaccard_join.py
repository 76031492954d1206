import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))
import numpy as np  # noqa: E402
import oracle  # noqa: E402
import pytest  # noqa: E402
from twinlathe.llm import jaccard_join as jj  # noqa: E402


def test_oracle(spark):
    oracle.same(spark, "/root/testdata/sf0.001", jj.op3_ngram_jaccard, jj.ORACLE_SQL["op3_ngram_jaccard"])


def sets_of(rows, n):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    return out


def brute(rows, n, percent):
    sets, parent = sets_of(rows, n), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((str(doc), len(sets[i]), str(least.get(find(i)) if sets[i] else doc)) for i, (doc, _) in enumerate(rows))


def ours(spark, rows, n, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jj.join(df, n, percent).collect())


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_near_copies(spark, n, percent):
    """A large group of copies of which each differs a little, and chains around the threshold."""
    rng, rows = random.Random(n), []
    for size in (3, 8, 12, 25, 60, 200):
        base = [f"v{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + size // 12)):
                copy[rng.randrange(size)] = f"u{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                base = copy
    assert ours(spark, rows, n, percent) == brute(rows, n, percent)


def test_edge_cases(spark, edge_rows, no_docs):
    rows = [(r[0], r[1]) for r in edge_rows]
    assert ours(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert jj.join(no_docs).count() == 0


def test_prefixes_and_tiles_cover_every_linked_pair():
    """Two linked sets share more than may lie outside either's prefix, and a tile."""
    for percent in (80, 90):
        p = jj.Plan(percent)
        for x in (1, 5, 10, 11, 19, 40, 333, 2000):
            for y in range(x, 100 * x // percent + 1):
                inter = -(-percent * (x + y) // (100 + percent))
                sizes = np.array([x, y])
                assert (p.reach(sizes) <= inter).all() and (p.prefix(sizes) >= 1).all()
                band, lower = p.tiles(sizes)
                tiles = [{int(b), int(b) - int(low)} for b, low in zip(band, lower)]
                assert inter > x or tiles[0] & tiles[1]


def test_frequent_grams_by_the_broadcast_list(spark, monkeypatch):
    """With small loads, buffers report n-grams, and both ways give the brute-force result."""
    monkeypatch.setattr(jj, "LOAD", 64)
    rng, rows = random.Random(11), []
    common = [f"c{i}" for i in range(30)]
    for k in range(120):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((0, 2, 4, 60)))]
        rows.append((k, " ".join(common + own)))
    rows += [(200 + k, " ".join(common[: 30 - k % 3])) for k in range(12)] + [(300, "lone words only"), (301, " ".join(common))]
    join = jj.Join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), 3, 90)
    assert 0 < join.heavy.num_rows <= 2 * sum(len(t) for _, t in rows) / join.load
    assert ours(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert ours(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_nodes_with_one_short_hash_keep_all_their_keys():
    """Entries of a short hash that two nodes share are keys of both, whatever the prefix."""
    import pyarrow as pa

    route = jj.Route(40, 32, 4, 1)
    hashed = lambda high, low: [high << 32 | low, low]
    table = np.array([[*hashed(5, 1), 100, 90], [*hashed(5, 2), 100, 90], [*hashed(9, 3), 100, 1]], np.uint64)
    refs, grams = np.array([5, 5, 9, 9, 9], np.uint64), np.array([11, 12, 11, 13, 14], np.uint64)
    counts = np.array([2, 7, 2, 3, 9], np.uint64)
    rows = [(0, 0, None, None, None, table.tobytes()), (0, 0, jj.pack_sorted(refs), jj.pack(grams), jj.pack(counts), None)]
    batch = jj._sent(rows)
    got = pa.Table.from_batches(list(jj._keys(90, route, iter([batch])))).to_pylist()
    per_node = {low: sum(int.from_bytes(r["node"][8:], "little") == low for r in got) for low in (1, 2, 3)}
    tiles = 1 + int(jj.Plan(90).tiles(np.array([100]))[1][0])
    assert per_node == {1: 2 * tiles, 2: 2 * tiles, 3: 2 * tiles}


def test_packed_numbers():
    for values in ([], [0], [1, 255, 256, 2**40, 2**63 + 5]):
        x = np.array(values, np.uint64)
        assert jj.unpack(jj.pack(x)).tolist() == values and jj.unpack_sorted(jj.pack_sorted(x)).tolist() == values


def test_bitmap_bound_never_refutes_a_link(spark):
    rng = np.random.default_rng(1)
    text = [" ".join(f"t{x}" for x in rng.integers(0, 50, size)) for size in (300, 300, 200, 30)]
    data = "".join(text).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in text])])
    s = jj.Sets(np.frombuffer(data, np.uint8), offsets, 0, 4, 3)
    grams = [set(s.grams[a:b].tolist()) for a, b in zip(s.bound[:-1], s.bound[1:])]
    maps = [np.frombuffer(s.bitmap(i), np.uint64) for i in range(4)]
    assert len({len(m) for m in maps}) > 1
    for i in range(4):
        for j in range(4):
            assert jj.differing(maps[i], maps[j]) <= len(grams[i] ^ grams[j])


def test_tiles_find_what_lies_apart():
    """All pairs, or each left node's nearest, against a plain double loop."""
    import pyarrow as pa

    rng, percent = random.Random(4), 80
    rows = []
    for node in range(40):
        bits = [random.Random(node % 4).getrandbits(64) & (2**64 - rng.choice([1, 1, 1, 3])) for _ in range(8)]
        rows.append(({"key": 5, "i": 0, "j": 0}, int(node >= 12), bytes([node]), 300 + node % 3, np.array(bits, np.uint64).tobytes(), bytes([node // 3]), node >= 24))
    names = ["place", "side", "node", "n", "bitmap", "root", "is_main"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    def differ(x, y):
        return sum((int(a) ^ int(b)).bit_count() for a, b in zip(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))

    may = {}
    for x in rows[:12]:
        for y in rows[12:]:
            total = x[3] + y[3]
            if x[5] != y[5] and 180 * min(x[3], y[3]) >= 80 * total and 180 * (total - differ(x[4], y[4])) >= 160 * total:
                may[x[2], y[2]] = differ(x[4], y[4])
    halves = [batch.slice(0, 25), batch.slice(25)]
    pairs = lambda every: {(a, b) for t in jj._tiles(percent, every, iter(halves)) for a, b in zip(*[c.to_pylist() for c in t.columns])}
    assert may and pairs(True) == set(may)
    near = pairs(False)
    assert {a for a, _ in near} == {a for a, _ in may}
    assert all(may[a, b] == min(d for (x, _), d in may.items() if x == a) for a, b in near)


def test_near_copies_with_null_doc_id_link(spark):
    """A text held only by rows with null doc_id joins two documents that don't link; other such texts are each other's or a document's near copies."""
    base, other, third = ([f"{p}{i}" for i in range(60)] for p in "xyz")
    rows = [
        (1, " ".join(base[:-2] + ["p", "q"])), (None, " ".join(base)), (2, " ".join(["p", "q"] + base[2:])), (None, " ".join(other)), (3, " ".join(other[:-1] + ["p"])),
        (None, " ".join(third)), (None, " ".join(third[:-1] + ["p"])), (None, " ".join(base)), (4, "a text of its own"), (None, None),
    ]
    got = ours(spark, rows, 3, 90)
    assert got == brute(rows, 3, 90)
    assert ("2", 58, "1") in got and ("None", 58, "3") in got


def test_keys_with_the_same_nodes_and_keys_that_moved(spark):
    join = jj.Join(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), 5, 80)
    a, b, c, d = (bytes([k]) * 16 for k in range(4))
    held = {1: [a, b], 2: [b, a], 3: [a, b, c], 4: [c], 5: [c, d], 6: [d, c], 7: [a, d]}
    postings = join.scratch.cut(spark.createDataFrame([(k, n) for k, nodes in held.items() for n in nodes], "key long, node binary"), "given")
    members = join.members(postings)
    rows = {}
    for r in members.collect():
        rows.setdefault(r["key"], set()).add(bytes(r["node"]))
    assert rows == {1: {a, b}, 3: {a, b, c}, 5: {c, d}, 7: {a, d}}
    assert {(bytes(r["a"]), bytes(r["b"])) for r in join.stars(members).collect()} == {(a, b), (a, c), (c, d), (a, d)}
    roots = lambda pairs: spark.createDataFrame(pairs, "node binary, root binary")
    before, after = roots([(a, a), (b, a)]), roots([(a, a), (b, a), (c, c), (d, c)])
    assert {r["key"] for r in join.unsettled(members, after).collect()} == {3, 7}
    assert {r["key"] for r in join.touched(members, before, after).collect()} == {3, 5, 7}
    assert join.touched(members, after, after).count() == 0
    join.scratch.close()
