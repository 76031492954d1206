"""Operator 3: n-gram Jaccard join with size-banded tiles and hashed bitmap signatures.

Documents whose sets of word n-grams are equal form one node (128-bit hash of the set).
Two nodes link when 100 * intersection >= percent * union.

Candidates. A set of X n-grams shares at least ceil(percent * X / 100) of them with any
set it links to. So if the n-grams of all sets are put in one order, two linked sets share
one among the first X - ceil(percent * X / 100) + 1 of each. The order is by the number of
sets that hold an n-gram, rarest first: what many documents share (a passage, a notice, a
common phrase) comes last, and a set with that many n-grams of its own has no candidate
at all. Sizes are cut into bands; the tile of a band holds its sets and those of the next
band that could link into it, and sets meet in a tile by a key of (tile, n-gram).

Counting. n-grams travel as sorted, packed arrays of ``bits`` of their hash (enough for a
collision in 2^8; any function of the hash gives a valid order) with a short hash of their
node (20 bits more than nodes can have, so that two nodes that link share it with a
probability of 2^-20 divided by the nodes) to the task of their range. It counts them and
sends on those held twice or more, to the task of their node, which picks the node's keys. An n-gram that could fill a range by itself never travels
there: every buffer first reports the n-grams of which it holds more than its share, and
those above ``load`` / 2 in all (at most 2 * n-grams / load, so a list of bounded size is
broadcast) come last in the order; each buffer knows by itself which of them are keys.

Of keys that the same nodes have one is kept, and joined to its smallest node (a star, not
all pairs). Bounds: a bitmap of 4 to 8
bits for each n-gram; the bits in which two bitmaps differ bound the differing n-grams
from below and so the intersection from above. Pairs that pass are compared exactly, by
intersecting sorted arrays; a star's centre sends its array once for up to 64 pairs.

Completion. Where the members of a key end in different components, links between them may
be hidden. Of each such key, the members outside its largest component are compared with
the members of other components by sizes and bitmaps, in tiles of at most ``BLOCK`` by
``BLOCK``. At first each takes only its nearest in a tile, which is compared exactly, and
components are joined again, until that finds nothing new (a round takes the keys of which
a member has moved in the one before); only then all pairs that may
link and still lie apart are compared exactly. After that every two nodes that share a key
are in one component or have been refuted: components are exact, up to equal 64-bit
hashes of different n-grams in one pair of documents.

Defined cases: doc_id is an integer or casts to one (other strings are an error);
null, empty or wordless text has an empty set, links with nothing and is
its own component; texts with fewer words than n have their whole sequence as one
n-gram; a very long text forms a slice of its own, so memory is bounded by the longest
text; repeated rows are equal sets and link; a null doc_id takes part, but a component's
id is the smallest non-null one; an empty table gives no rows. Only doc_id and text are
read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlathe.llm import bytetext
from twinlathe.llm.bytetext import U64, mix
from twinlathe.llm.components import components
from twinlathe.llm.storage import BROADCAST_ROWS, Scratch, carried

BAND_RATIO = 1.25
#: Least number of n-grams that a task holds at once, and most ranges into which hashes are cut.
LOAD = 1 << 19
MOST_RANGES = 1 << 19
BLOCK = 4096
#: Pairs that share one copy of their left array.
PAIRS_PER_COPY = 64
#: Orders the n-grams of the broadcast list after all others.
_HEAVY = 1 << 48


class Plan:
    """Bands, tiles and prefixes for a similarity of ``percent`` per cent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = np.array([1], np.int64)

    def reach(self, sizes: np.ndarray) -> np.ndarray:
        """Least number of n-grams that a set shares with a set it links to."""
        return -(-self.percent * sizes // 100)

    def prefix(self, sizes: np.ndarray) -> np.ndarray:
        return sizes - self.reach(sizes) + 1

    def tiles(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(band of each size, whether it may link into the band below)."""
        largest = int(sizes.max(initial=1))
        while self.low[-1] <= largest:
            last = int(self.low[-1])
            self.low = np.append(self.low, max(last + 1, -(-int(last * max(BAND_RATIO, 100 / self.percent) * 1000) // 1000)))
        band = np.searchsorted(self.low, sizes, "right") - 1
        return band, self.reach(sizes) < self.low[band]


def bitmap_bits(size: int) -> int:
    """A power of two, 4 to 8 bits for each n-gram."""
    return max(256, 1 << (4 * size - 1).bit_length())


class Sets:
    """Sorted distinct n-gram hashes of the texts of one slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int, n: int):
        words = bytetext.Words(data, offsets, first, last)
        hashes = words.hashes()
        grams, whole = words.grams(hashes, n)
        per = np.diff(words.bounds)
        row = np.repeat(np.arange(words.rows), per)[whole]
        grams = grams[whole]
        short = np.flatnonzero((per > 0) & (per < n))
        if len(short):
            grams = np.concatenate([grams, np.array([words.sequence(hashes, int(r)) for r in short], U64)])
            row = np.concatenate([row, short])
            order = np.argsort(row, kind="stable")
            grams, row = grams[order], row[order]
        ends = np.cumsum(np.bincount(row, minlength=words.rows)) if words.rows else np.zeros(0, np.int64)
        begin = 0
        for end in ends.tolist():
            grams[begin:end].sort()
            begin = end
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        self.grams, self.row = grams[new], row[new]
        self.size = np.bincount(self.row, minlength=words.rows).astype(np.int64)
        self.bound = np.concatenate([[0], np.cumsum(self.size)])
        self.node = np.empty((words.rows, 2), U64)
        sums = np.zeros(len(self.grams) + 1, U64)
        for k, seed in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            np.cumsum(mix(self.grams ^ U64(seed)), out=sums[1:])
            self.node[:, k] = mix(sums[self.bound[1:]] - sums[self.bound[:-1]] + self.size.astype(U64) * U64(seed))

    def bitmap(self, row: int) -> bytes:
        grams = self.grams[self.bound[row] : self.bound[row + 1]]
        bits = np.zeros(bitmap_bits(len(grams)), bool)
        bits[(grams & U64(len(bits) - 1)).astype(np.int64)] = True
        return np.packbits(bits, bitorder="little").tobytes()


def _slices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for batch in batches:
        data, offsets = bytetext.column_bytes(batch.column(1))
        for first, last in bytetext.slices(offsets):
            yield batch.slice(first, last - first), Sets(data, offsets, first, last, n)


def node_column(nodes: np.ndarray) -> pa.Array:
    """16 bytes for each row of an (n x 2) array."""
    offsets = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * 16)
    return pa.Array.from_buffers(pa.binary(), len(nodes), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(nodes, U64))])


def _numbered(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each distinct row, ordered by the first column; number of each row)."""
    order = np.lexsort((nodes[:, 1], nodes[:, 0]))
    ordered = nodes[order]
    new = np.ones(len(nodes), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    number = np.empty(len(nodes), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def pack(values: np.ndarray) -> bytes:
    """Non-negative numbers by byte place, without leading bytes that are all zero."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    places = np.ascontiguousarray(values, U64).view(np.uint8).reshape(-1, 8)
    return bytes([width]) + np.ascontiguousarray(places[:, :width].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    places = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((places.shape[1], 8), np.uint8)
    out[:, :width] = places.T
    return out.view(U64).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return values[:1].tobytes() + pack(np.diff(values)) if len(values) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U64)
    return np.cumsum(np.concatenate([np.frombuffer(data, U64, 1), unpack(data[8:])]), dtype=U64)


class Buffer:
    """Sets of several slices, each distinct one once."""

    def __init__(self) -> None:
        self.parts: list[Sets] = []
        self.total = 0

    def add(self, sets: Sets) -> None:
        self.parts.append(sets)
        self.total += len(sets.grams)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, their sizes, n-grams, the place of each one's node); empties the buffer."""
        nodes, sizes = np.concatenate([s.node for s in self.parts]), np.concatenate([s.size for s in self.parts])
        keep = np.zeros(len(nodes), bool)
        keep[_numbered(nodes)[0]] = True
        keep &= sizes > 0
        row = np.repeat(np.arange(len(nodes)), sizes)
        grams = np.concatenate([s.grams for s in self.parts])
        mine = keep[row]
        self.__init__()
        return nodes[keep], sizes[keep], grams[mine], (np.cumsum(keep) - 1)[row[mine]]


@bytetext.tidy
def _describe(n: int, load: int, share: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and rows of n-grams of which a buffer holds more than its share."""
    names, more = ["doc_id", "n", "node", "gram", "copies"], []
    buffer = Buffer()

    def frequent() -> Iterator[pa.RecordBatch]:
        least = max(2, buffer.total * share)
        if sum(len(s.size) for s in buffer.parts) < least:  # a set holds an n-gram once
            buffer.__init__()
            return
        grams, copies = np.unique(buffer.take()[2], return_counts=True)
        own = copies >= least
        if size := int(own.sum()):
            none = [pa.nulls(size, kind) for kind in (pa.int64(), pa.int64(), pa.binary())]
            rest = [pa.nulls(size, field.type) for field in more]
            yield pa.RecordBatch.from_arrays([*none, pa.array(grams[own].view(np.int64)), pa.array(copies[own]), *rest], [*names, *[f.name for f in more]])

    for batch, sets in _slices(batches, n):
        none, more = pa.nulls(batch.num_rows, pa.int64()), list(batch.schema)[2:]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets.size), node_column(sets.node), none, none, *batch.columns[2:]], [*names, *batch.schema.names[2:]])
        buffer.add(sets)
        if buffer.total >= load:
            yield from frequent()
    if buffer.total:
        yield from frequent()


_SENT = "part int, dest int, refs binary, grams binary, counts binary, nodes binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "dest", "refs", "grams", "counts", "nodes"])


def _range(values: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """The range, of ``ranges``, in which numbers of ``bits`` bits lie; it never falls as they grow."""
    high = values >> U64(bits - 32) if bits > 32 else values << U64(32 - bits)
    return (high * U64(ranges) >> U64(32)).astype(np.int64)


def _cuts(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if not len(sorted_values):
        return []
    cut = np.append(np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])), len(sorted_values)).tolist()
    return list(zip(cut, cut[1:]))


@dataclass(frozen=True)
class Route:
    """Numbers of bits and of tasks: n-grams are counted in ``ranges``, keys picked in ``dests``."""

    gram_bits: int
    ref_bits: int
    ranges: int
    dests: int

    def refs(self, nodes: np.ndarray) -> np.ndarray:
        return nodes[:, 0] >> U64(64 - self.ref_bits)

    def to_nodes(self, refs: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        """Rows for the tasks of the nodes."""
        order = np.argsort(refs, kind="stable")
        refs, grams, counts = refs[order], grams[order], counts[order]
        dest = _range(refs, self.ref_bits, self.dests)
        for a, b in _cuts(dest):
            yield int(dest[a]) % self.ranges, int(dest[a]), pack_sorted(refs[a:b]), pack(grams[a:b]), pack(counts[a:b]), None


@bytetext.tidy
def _send(percent: int, n: int, load: int, route: Route, heavy, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams to the task of their range; nodes, and those of their n-grams on the broadcast list that are keys, to the task of the node."""
    p, buffer = Plan(percent), Buffer()
    listed, weight = heavy.value

    def flush() -> Iterator[pa.RecordBatch]:
        nodes, sizes, grams, owner = buffer.take()
        grams >>= U64(64 - route.gram_bits)
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
        held, refs = np.bincount(owner, minlength=len(nodes)), route.refs(nodes)
        prefix = p.prefix(sizes)
        at = np.minimum(np.searchsorted(listed, grams), max(0, len(listed) - 1))
        is_heavy = listed[at] == grams if len(listed) else np.zeros(len(grams), bool)
        light = held - np.bincount(owner[is_heavy], minlength=len(nodes))
        # beyond the prefix lie this many of the light ones; a prefix with room for all of them takes heavy ones too
        table = np.concatenate([nodes, np.stack([sizes, np.maximum(0, light - prefix)], 1).astype(U64)], 1)
        order = np.argsort(refs, kind="stable")
        dest = _range(refs[order], route.ref_bits, route.dests)
        rows = [(int(dest[a]) % route.ranges, int(dest[a]), None, None, None, table[order[a:b]].tobytes()) for a, b in _cuts(dest)]
        if is_heavy.any():
            g, o, w = grams[is_heavy], owner[is_heavy], weight[at[is_heavy]]
            order = np.lexsort((g, w, o))
            g, o, w = g[order], o[order], w[order]
            key = np.arange(len(o)) - np.searchsorted(o, o) < (prefix - light)[o]
            rows += route.to_nodes(refs[o[key]], g[key], w[key])
            grams, owner = grams[~is_heavy], owner[~is_heavy]
        if rows:
            yield _sent(rows)
        order = np.argsort(grams, kind="stable")
        grams, own = grams[order], refs[owner[order]]
        part = _range(grams, route.gram_bits, route.ranges)
        rows, size = [], 0
        for a, b in _cuts(part):
            rows.append((int(part[a]), None, pack(own[a:b]), pack_sorted(grams[a:b]), None, None))
            size += b - a
            if size >= 1 << 18:
                yield _sent(rows)
                rows, size = [], 0
        if rows:
            yield _sent(rows)

    for _, sets in _slices(batches, n):
        buffer.add(sets)
        if buffer.total >= load:
            yield from flush()
    if buffer.total:
        yield from flush()


def _by(column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows with equal values of ``column``, of rows sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][column] != row[column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _distinct(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where a pair of sorted columns differs from the one before it."""
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return new


@bytetext.tidy
def _count(route: Route, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams that two or more nodes hold, with their number of nodes, to the tasks of the nodes. Rows come sorted by part."""
    for rows in _by("part", batches):
        if passed := [tuple(r.values()) for r in rows if r["dest"] is not None]:
            yield _sent(passed)
        rows = [r for r in rows if r["dest"] is None]
        if not rows:
            continue
        grams = np.concatenate([unpack_sorted(r["grams"]) for r in rows])
        refs = np.concatenate([unpack(r["refs"]) for r in rows])
        del rows
        order = np.argsort(grams, kind="stable")
        grams, refs = grams[order], refs[order]
        same = grams[1:] == grams[:-1]
        several = np.append(same, False) | np.append(False, same)
        grams, refs = grams[several], refs[several]
        order = np.lexsort((refs, grams))
        grams, refs = grams[order], refs[order]
        new = _distinct(grams, refs)
        grams, refs = grams[new], refs[new]
        copies = np.array([b - a for a, b in _cuts(grams)], np.int64)
        counts = np.repeat(copies, copies)
        several = counts > 1
        out = list(route.to_nodes(refs[several], grams[several], counts[several].astype(U64)))
        for k in range(0, len(out), 1024):
            yield _sent(out[k : k + 1024])


@bytetext.tidy
def _keys(percent: int, route: Route, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the nodes. Rows come sorted by dest."""
    p = Plan(percent)
    for rows in _by("dest", batches):
        table = np.concatenate([np.frombuffer(r["nodes"], U64).reshape(-1, 4) for r in rows if r["nodes"] is not None])
        table = table[_numbered(table[:, :2])[0]]
        rows = [r for r in rows if r["nodes"] is None]
        if not rows:
            continue
        refs = np.concatenate([unpack_sorted(r["refs"]) for r in rows])
        grams, counts = (np.concatenate([unpack(r[c]) for r in rows]) for c in ("grams", "counts"))
        order = np.lexsort((grams, counts, refs))
        grams, refs = grams[order], refs[order]
        new = _distinct(grams, refs)  # several buffers may send the same
        grams, refs = grams[new], refs[new]
        own = route.refs(table)
        owner = np.searchsorted(own, refs)
        shared = np.searchsorted(own, refs, "right") - owner
        # n-grams that no other node holds come first and meet nothing
        room = np.bincount(owner, minlength=len(table)) - table[:, 3].astype(np.int64)
        key = (np.arange(len(owner)) - np.searchsorted(owner, owner) < room[owner]) | (shared > 1)
        grams, owner, shared = grams[key], owner[key], shared[key]
        # nodes with one short hash cannot be told apart: each has all n-grams of theirs as keys
        more = np.flatnonzero(shared > 1)
        grams = np.concatenate([grams, np.repeat(grams[more], shared[more] - 1)])
        owner = np.concatenate([owner, *[np.arange(owner[i] + 1, owner[i] + shared[i]) for i in more.tolist()]])
        band, lower = p.tiles(table[:, 2].astype(np.int64))
        for tile, mine in ((band, np.ones(len(owner), bool)), (band - 1, lower[owner])):
            o = owner[mine]
            key = mix(grams[mine] * U64(0x9FB21C651E98DF25) + mix(tile[o].astype(U64) + U64(1)))
            for a in range(0, len(o), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 16)].view(np.int64)), node_column(table[o[a : a + (1 << 16)], :2])], ["key", "node"])


_SETS = "node binary, n long, bitmap binary, grams binary"


@bytetext.tidy
def _arrays(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets in _slices(batches, n):
        rows = np.flatnonzero(sets.size).tolist()
        grams = [sets.grams[sets.bound[r] : sets.bound[r + 1]] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [node_column(sets.node[rows]), pa.array(sets.size[rows]), pa.array([sets.bitmap(r) for r in rows], pa.binary()), bytetext.binary_column(grams)],
            ["node", "n", "bitmap", "grams"],
        )


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, words), 0)


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two bitmaps differ, the longer one folded."""
    words = min(len(x), len(y))
    return int(np.bitwise_count((x if len(x) == words else folded(x, words)) ^ (y if len(y) == words else folded(y, words))).sum())


def may_link(percent: int, nx, ny, differ):
    """Sizes and differing bits allow the similarity."""
    total = nx + ny
    return ((100 + percent) * np.minimum(nx, ny) >= percent * total) & ((100 + percent) * (total - differ) >= 2 * percent * total)


def _bounded(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = lambda c: [np.frombuffer(v.as_buffer(), U64) for v in batch.column(c)]  # noqa: E731, B023
        differ = np.array([differing(x, y) for x, y in zip(words(4), words(5))], np.int64)
        keep = may_link(percent, batch.column(2).to_numpy(), batch.column(3).to_numpy(), differ)
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def links_exactly(percent: int, x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # merges the two sorted runs
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (len(x) + len(y) - inter)


@bytetext.tidy
def _intersect(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, share, b, grams) sorted so that the array of a (b is null) comes before those of its pairs."""
    left = None
    for batch in batches:
        a, b = [], []
        for x, _, y, grams in zip(*batch.columns):
            values = np.frombuffer(grams.as_buffer(), U64)
            if not y.is_valid:
                left = values.copy()
            elif links_exactly(percent, left, values):
                a.append(x.as_py())
                b.append(y.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _tile(percent: int, every: bool, rows: list[dict]) -> list[tuple[bytes, bytes]]:
    """Pairs (left node, right node) of one tile that may link and have different roots:
    all, or for each left node the one whose bitmap differs least."""
    words = min(len(r["bitmap"]) for r in rows) // 8
    bits = np.stack([folded(np.frombuffer(r["bitmap"], U64), words) for r in rows])
    n = np.array([r["n"] for r in rows])
    roots = {}
    root = np.array([roots.setdefault(r["root"], len(roots)) for r in rows])
    main = np.array([r["is_main"] for r in rows])
    l, r = (np.array([i for i, row in enumerate(rows) if row["side"] == side], np.int64) for side in (0, 1))
    out = []
    step = max(1, (1 << 24) // max(1, len(r) * words * 8))
    for first in range(0, len(l), step):
        at = l[first : first + step]
        differ = np.bitwise_count(bits[at][:, None, :] ^ bits[r][None, :, :]).sum(2, dtype=np.int64)
        may = (root[at][:, None] != root[r][None, :]) & may_link(percent, n[at][:, None], n[r][None, :], differ)
        if every:
            i, j = np.nonzero(may)
        else:
            i = np.flatnonzero(may.any(1))
            j = np.where(may[i], differ[i], np.iinfo(np.int64).max).argmin(1)
        for x, y in zip(at[i].tolist(), r[j].tolist()):
            a, b = rows[x]["node"], rows[y]["node"]
            if not every or main[y] or a < b:
                out.append((min(a, b), max(a, b)))
    return out


@bytetext.tidy
def _tiles(percent: int, every: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by place (key, i, j)."""
    for rows in _by("place", batches):
        if pairs := sorted(set(_tile(percent, every, rows))):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs)], ["a", "b"])


class Join:
    """One run over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, n: int, percent: int, carry: tuple[str, ...] = ()):
        self.spark, self.n, self.percent = docs.sparkSession, n, percent
        self.scratch = Scratch(self.spark, "jaccard")
        self.carry = carry
        doc_id = F.col("doc_id").cast("long").alias("doc_id")
        self.docs = docs.select(doc_id, "text")
        most = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2 + 1  # n-grams
        self.load = max(LOAD, most // MOST_RANGES)
        share = self.load / (2 * most)
        kinds = ["doc_id long, n long, node binary, gram long, copies long", *carried(docs, carry)]
        table = self.scratch.cut(docs.select(doc_id, "text", *carry).mapInArrow(functools.partial(_describe, n, self.load, share), ", ".join(kinds)), "sets")
        self.described = table.where("node IS NOT NULL").drop("gram", "copies")
        heavy = table.where("node IS NULL").groupBy("gram").agg(F.sum("copies").alias("copies")).where(F.col("copies") >= share * most)
        self.heavy = heavy.toArrow()  # at most 2 * most / load rows
        self.nodes = self.described.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("min_id"))

    def _listed(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The frequent n-grams' hashes of ``bits`` bits, sorted, and their places in the order."""
        grams = self.heavy["gram"].to_numpy().view(U64) >> U64(64 - bits)
        copies = self.heavy["copies"].to_numpy()
        order = np.lexsort((copies, grams))
        grams, copies = grams[order], copies[order]
        last = np.append(grams[1:] != grams[:-1], True) if len(grams) else np.zeros(0, bool)
        return grams[last], copies[last].astype(U64) + U64(_HEAVY)

    def postings(self) -> DataFrame:
        """key, node: the keys that more than one node might have."""
        total, rows = (x or 0 for x in self.described.agg(F.sum("n"), F.count("*")).first())
        least = 4 * self.spark.sparkContext.defaultParallelism
        route = Route(
            min(64, max(32, int(total).bit_length() + 8)), min(64, max(32, int(rows).bit_length() + 20)), max(least, -(-total // self.load)), max(least, -(-total // (4 * self.load)))
        )
        heavy = self.spark.sparkContext.broadcast(self._listed(route.gram_bits))
        sent = self.docs.mapInArrow(functools.partial(_send, self.percent, self.n, self.load, route, heavy), _SENT)
        counted = sent.repartition(route.ranges, "part").sortWithinPartitions("part").mapInArrow(functools.partial(_count, route), _SENT)
        keys = counted.repartition(route.dests, "dest").sortWithinPartitions("dest").mapInArrow(functools.partial(_keys, self.percent, route), "key long, node binary")
        return self.scratch.cut(keys, "postings")

    def members(self, postings: DataFrame) -> DataFrame:
        """key, node of the keys that several nodes have; of keys with the same nodes (told apart by
        their number and 128 bits), one. Near copies share very many such keys."""
        sizes = postings.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        keys = sizes.where("size > 1").groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key")
        # written first: joined to a table of its own, Spark may split a key that many nodes have
        return self.scratch.cut(postings.join(self.scratch.small(self.scratch.cut(keys, "keys")), "key", "left_semi"), "members")

    def stars(self, members: DataFrame) -> DataFrame:
        """a, b: the smallest node of each key with its other nodes."""
        centres = self.scratch.small(self.scratch.cut(members.groupBy("key").agg(F.min("node").alias("a")), "centres"))
        return self.scratch.cut(members.join(centres, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "pairs")

    def sets_of(self, pairs: DataFrame) -> DataFrame:
        """node, n, bitmap and grams of the ends of ``pairs``. Texts are those with the smallest
        doc_id of each node, null equal to null; ids are broadcast if there are few enough."""
        ends = self.scratch.cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "ends")
        ids = self.scratch.cut(self.nodes.join(ends, "node", "left_semi").select("min_id").distinct(), "ids")
        texts = self.docs.join(self.scratch.small(ids), F.col("doc_id").eqNullSafe(F.col("min_id")), "left_semi")
        found = texts.mapInArrow(functools.partial(_arrays, self.n), _SETS).join(self.scratch.small(ends), "node", "left_semi")
        return self.scratch.cut(found.dropDuplicates(["node"]), "arrays")

    def rooted(self, links: DataFrame) -> DataFrame:
        """node, root of the nodes that link, broadcast by joins if there are few enough."""
        return self.scratch.small(components(links, self.scratch))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link."""
        a = self.sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("bitmap_a"))
        b = self.sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bitmap_b"))
        signed = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "bitmap_a", "bitmap_b")
        bounded = self.scratch.cut(signed.mapInArrow(functools.partial(_bounded, self.percent), "a binary, b binary"), "bounded")
        shares = bounded.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_COPY).alias("shares"))
        lefts = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares").cast("int") - 1)).alias("share"))
        rights = bounded.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), "b")
        if bounded.count() <= BROADCAST_ROWS:  # neither side has more rows: arrays stay where they are until they are dealt
            lefts, rights = F.broadcast(lefts), F.broadcast(rights)
        grams = self.sets.select("node", "grams")
        lefts = lefts.join(grams, F.col("a") == F.col("node")).select("a", "share", F.lit(None).cast("binary").alias("b"), "grams")
        rights = rights.join(grams, F.col("b") == F.col("node")).select("a", "share", "b", "grams")
        dealt = lefts.unionByName(rights).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
        return self.scratch.cut(dealt.mapInArrow(functools.partial(_intersect, self.percent), "a binary, b binary"), "links")

    def unsettled(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """key, node of the keys whose nodes lie in different components."""
        placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        keys = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
        return self.scratch.cut(members.join(self.scratch.small(self.scratch.cut(keys, "apart-keys")), "key", "left_semi"), "unsettled")

    def touched(self, members: DataFrame, before: DataFrame, roots: DataFrame) -> DataFrame:
        """The members of keys of which a node has another root than before. The nearest of all others stay as they were."""
        moved = roots.join(before.withColumnRenamed("root", "was"), "node", "left").where("was IS NULL OR was <> root").select("node")
        moved = self.scratch.small(self.scratch.cut(moved, "moved"))
        keys = self.scratch.cut(members.join(moved, "node", "left_semi").select("key").distinct(), "touched-keys")
        return self.scratch.cut(members.join(self.scratch.small(keys), "key", "left_semi"), "touched")

    def tiles(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """Members of keys with several components, dealt to tiles."""
        placed = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        per_root = placed.groupBy("key", "root").agg(F.count("*").alias("size"))
        blocks = lambda x: F.ceil(x / BLOCK).cast("int")
        sizes = per_root.groupBy("key").agg(
            F.max_by("root", F.struct("size", "root")).alias("main"), blocks(F.sum("size")).alias("blocks"), blocks(F.sum("size") - F.max("size")).alias("left_blocks"), F.count("*").alias("roots")
        )
        sizes = self.scratch.small(self.scratch.cut(sizes.where("roots > 1").drop("roots"), "sizes"))
        placed = placed.join(sizes, "key").withColumn("is_main", F.col("root") == F.col("main"))
        hashed = F.xxhash64("node")
        values = ["node", "root", "is_main"]
        left = placed.where("NOT is_main").select("key", F.pmod(hashed, F.col("left_blocks")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), *values)
        right = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"), F.pmod(hashed, F.col("blocks")).cast("int").alias("j"), F.lit(1).alias("side"), *values)
        dealt = left.unionByName(right).join(self.sets.select("node", "n", "bitmap"), "node")
        place = F.struct("key", "i", "j")
        return dealt.select(place.alias("place"), "side", "n", "bitmap", *values).repartition("place").sortWithinPartitions("place")

    def completed(self, members: DataFrame, links: DataFrame, roots: DataFrame, tested: DataFrame) -> DataFrame:
        """Components after all nodes that share a key have been compared."""
        every = members.isEmpty()
        if every:
            return roots
        near = members
        while True:
            pairs = self.tiles(members if every else near, roots).mapInArrow(functools.partial(_tiles, self.percent, every), "a binary, b binary").distinct()
            pairs = self.scratch.cut(pairs.join(tested, ["a", "b"], "left_anti"), "apart")
            found = None if pairs.isEmpty() else self.linked(pairs)
            tested = tested.unionByName(pairs)
            if found is not None and not found.isEmpty():
                links = links.unionByName(found)
                before, roots = roots, self.rooted(links)
                near = near if every else self.touched(members, before, roots)
            elif not every:
                every = True  # the nearest are exhausted: now all that still lie apart
                continue
            if every:
                return roots

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id; with columns to carry these too, and group."""
        postings = self.postings()
        self.scratch.release()
        members = self.members(postings)
        self.scratch.drop(postings)
        pairs = self.stars(members)
        self.sets = self.sets_of(pairs)
        links = self.linked(pairs)
        self.scratch.release()
        roots = self.rooted(links)
        roots = self.completed(self.unsettled(members, roots), links, roots, pairs)
        placed = self.nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ids = placed.groupBy("root").agg(F.min("min_id").alias("component"))
        of_node = placed.join(ids, "root").select("node", "component", "root")
        rows = self.described.withColumnRenamed("n", "n_shingles").join(of_node, "node", "left")
        some = F.col("n_shingles") > 0
        more = [F.when(some, F.col("root")).alias("group"), *self.carry] if self.carry else []
        out = self.scratch.cut(rows.select("doc_id", "n_shingles", F.when(some, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), *more), "result")
        self.scratch.close(keep=out)
        return out


def join(docs: DataFrame, n: int = 5, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles (set size), component_id (smallest doc_id reachable by links). With
    ``carry`` also these columns of the rows and group, which names a component even where no
    member has a doc_id (null for rows without words)."""
    return Join(docs, n, percent, carry).run()


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLE_SQL = {
    "op3_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.k >= 90 * (x.n + y.n - s.k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
}
