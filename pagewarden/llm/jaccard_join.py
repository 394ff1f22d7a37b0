"""Exact Jaccard join of documents by their word shingles, in regions around pivots.

The shingles, in the order of their hashes, are pivots. In the pseudo-metric that counts where two sets
differ among the shingles ahead of a pivot s, a set that holds s lies |{t in x: t < s}| from the centre of
s's Voronoi cell: 0 if s is its own first shingle (its home), more if it is a boundary document. Two sets
that are similar enough differ in few shingles, so by the triangle inequality the first shingle they share
lies within a window of either: its place in a set of n is at most n - ceil(0.75 n). Each document is
replicated to the pivots within that window and to no others, and every linked pair meets in a region.

Regions with few documents are joined as they are. Pairs are dropped by their sizes and by their places in
the region. Since only components are asked for, a region first sends on no more than one pair for each
document, with one that comes before it; they go through the Hamming distance of two bitmaps of parities,
which is never larger than the sets' symmetric difference, and what is left is compared exactly. The other
pairs of a region stay packed in one row, and only those whose documents are in different components then
are taken out and compared in the same way. Regions with many documents are joined recursively: their documents form a smaller join in which the crowded pivots come last in the order. A
region that is still crowded holds documents that are mostly made of the same shingles, that is, close to
each other; then documents become pivots. Distances to them link everything within their reach at once,
and since only components are asked for, pairs that are already in one component needn't be made; the
rest recurses until no region is crowded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagewarden.llm.common import frozen, joined_by_group, unused, utf8
from pagewarden.llm.textwords import WHITE, byte_table, chunks, mix, split_words, windows

WIDTH = 5
#: Documents of a region that is joined as it is, and pairs of a region in the recursion.
CROWD, PAIRS = 16, 2000
#: Rows of one region that a task sends on; with more it says only that the region is crowded.
LOCAL = 1024
#: Crowded pivots, 8 bytes each, that go to all tasks; with more, a crowd is twice as large.
MAX_CROWDED = 2_000_000
#: Documents that become pivots in one step, and the shingles they may have together.
MAX_PIVOTS, MAX_PIVOT_SHINGLES = 64, 500_000
#: Shingles in bytes, and links, that one task is enough for.
FEW_BYTES, FEW_LINKS = 48 << 20, 200_000
_TABLE = byte_table(WHITE)
_PAIR = "kind int, a bigint, b bigint"
#: Also a region's documents, and a bit for each pair of them that may link and hasn't been sent on.
_FOUND = f"{_PAIR}, members binary, open binary"
#: Bytes of postings that a task joins at once.
TASK_BYTES = 32 << 20
#: Shingles in a stretch of a task's documents, and documents of a stretch in which a shingle comes up often.
STRETCH, OFTEN = 2_000_000, 3
#: Postings that a task holds before it sends them on.
HELD = 1_000_000


def needed(n):
    """Shingles that a set of n shares with any set it links with, at least."""
    return (75 * n + 99) // 100


def reach(n):
    """Pivots that a set of n goes to: those whose distance is within its window."""
    return n - needed(n) + 1


def linked(shared, n, m):
    return 100 * shared >= 75 * (n + m - shared)


class Sets:
    """The shingle sets of some texts, one after the other, each in ascending order."""

    def __init__(self, raws: list[bytes]):
        w = split_words(raws, _TABLE)
        h, text, _ = windows(w.hash, w.text, w.counts, WIDTH)
        ends = np.cumsum(np.bincount(text, minlength=len(raws)))
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        self.words, self.h, self.text = w, h[new], text[new]
        self.n = np.bincount(self.text, minlength=len(raws))
        self.begin = np.cumsum(self.n) - self.n

    def of(self, t: int) -> np.ndarray:
        return self.h[self.begin[t] : self.begin[t] + self.n[t]]

    def names(self, salt: int) -> np.ndarray:
        """A number for each text that is the same for the same words in the same order."""
        w = self.words
        place = np.arange(len(w.text)) - (np.cumsum(w.counts) - w.counts)[w.text]
        marked = mix(w.hash ^ mix((place + 1).astype(np.uint64) * np.uint64(2 * salt + 0x9E3779B97F4A7C15)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marked, dtype=np.uint64)])
        ends = np.cumsum(w.counts)
        return mix(sums[ends] - sums[ends - w.counts] + w.counts.astype(np.uint64)).view(np.int64)

    def bitmaps(self) -> list[bytes]:
        """For each set a bitmap of parities with at least twice as many bits as it has shingles."""
        bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * self.n, 1))).astype(np.int64))
        at = np.cumsum(bits) - bits
        place = at[self.text] + (self.h & (bits[self.text] - 1).astype(np.uint64)).astype(np.int64)
        packed = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)).tobytes()
        return [packed[a // 8 : (a + b) // 8] for a, b in zip(at.tolist(), bits.tolist(), strict=True)]


def bitmap_distance(a: bytes, b: bytes) -> int:
    """At most the number of shingles that only one of the two sets has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _described(docs: DataFrame, salt: int) -> DataFrame:
    """A row for each document (kind 0): row (a hash of the row), id, node and name (numbers for the sequence of words), n, bitmap.

    And one for each shingle that often comes up in a stretch of a task's documents (kind 1): node is the
    shingle and n the number of documents. They only serve to put such shingles last in the order.
    """

    def often(h):
        values, times = np.unique(np.concatenate(h), return_counts=True)
        keep = times >= OFTEN
        k = int(keep.sum())
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, id_type), pa.array(values[keep].view(np.int64)), pa.nulls(k, pa.int64()), pa.array(times[keep].astype(np.int32)), pa.nulls(k, pa.binary()), pa.array(np.ones(k, np.int32))], columns)

    columns = ["row", "id", "node", "name", "n", "bitmap", "kind"]
    id_type = to_arrow_type(docs.schema["id"].dataType)

    def run(batches):
        seen: set[int] = set()
        held, size = [], 0
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            for begin, some in chunks(raws):
                sets = Sets(some)
                part, node = batch.slice(begin, len(some)), sets.names(salt)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(node), pa.array(sets.names(salt + 1)), pa.array(sets.n.astype(np.int32)), pa.array(sets.bitmaps()), pa.array(np.zeros(len(some), np.int32))], columns)
                fresh = np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool)
                held.append(sets.h[fresh[sets.text]])
                size += len(held[-1])
                if size > STRETCH:
                    yield often(held)
                    held, size, seen = [], 0, set()
        if held:
            yield often(held)

    return docs.mapInArrow(run, f"row bigint, id {docs.schema['id'].dataType.simpleString()}, node bigint, name bigint, n int, bitmap binary, kind int")


class Order:
    """Where crowded pivots come last, those of larger regions later."""

    def __init__(self, crowded: np.ndarray, sizes: np.ndarray):
        order = np.argsort(crowded)
        self.crowded, self.sizes, self.rank = crowded[order], sizes[order], np.empty(len(order), np.int64)
        self.rank[np.lexsort((crowded[order], sizes[order]))] = np.arange(len(order))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.crowded >> np.uint64(42)).astype(np.int64)] = True

    def with_more(self, crowded: np.ndarray, sizes: np.ndarray) -> Order:
        """With further pivots, or new sizes, if there is room for them."""
        if len(self.crowded) + len(crowded) > 2 * MAX_CROWDED:
            return self
        known = dict(zip(self.crowded.tolist(), self.sizes.tolist(), strict=True)) | dict(zip(crowded.tolist(), sizes.tolist(), strict=True))
        return Order(np.fromiter(known.keys(), np.uint64, len(known)), np.fromiter(known.values(), np.int64, len(known)))

    def any_crowded(self, h: np.ndarray) -> np.ndarray:
        out = self.bits[(h >> np.uint64(42)).astype(np.int64)]
        some = np.flatnonzero(out)
        out[some] = self.is_crowded(h[some])[0]
        return out

    def is_crowded(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.crowded):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.crowded, h), len(self.crowded) - 1)
        return self.crowded[at] == h, at

    def prefixes(self, sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pivot, set, place) for all pivots that some sets go to."""
        k = np.where(sets.n > 0, reach(sets.n), 0)
        of = np.repeat(np.arange(len(k)), k)
        first = np.cumsum(k) - k
        place = np.arange(len(of)) - first[of]
        s = sets.h[sets.begin[of] + place]
        for t in np.unique(of[self.any_crowded(s)]).tolist() if len(self.crowded) else ():
            s[first[t] : first[t] + k[t]] = self.prefix(sets.h[sets.begin[t] : sets.begin[t] + sets.n[t]])
        return s, of, place

    def prefix(self, h: np.ndarray) -> np.ndarray:
        """The pivots that a set goes to, in order."""
        k = reach(len(h))
        late, at = self.is_crowded(h)
        early = h[~late][:k]
        if len(early) == k:
            return early
        rest = h[late]
        return np.concatenate([early, rest[np.argsort(self.rank[at[late]])][: k - len(early)]])


class Pivots:
    """Documents as pivots: which of them a set links with, and the component of those."""

    def __init__(self, nodes: np.ndarray, sets: list[np.ndarray], component: np.ndarray | None = None):
        self.nodes, self.n = nodes, np.array([len(s) for s in sets], np.int64)
        self.shingles = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.holds = np.zeros((len(self.shingles), len(sets)), bool)
        for k, s in enumerate(sets):
            self.holds[np.searchsorted(self.shingles, s), k] = True
        self.component = np.arange(len(sets)) if component is None else component

    def links(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivots that a set links with, pivots within twice that distance)"""
        if not len(self.shingles):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.shingles, h), len(self.shingles) - 1)
        shared = self.holds[at[self.shingles[at] == h]].sum(0)
        return np.flatnonzero(linked(shared, len(h), self.n)), np.flatnonzero(2 * shared >= len(h) + self.n - shared)


#: A set of n at a pivot: the pivot's place among those that the set goes to, and the one before it (if any).
_POSTING = np.dtype([("region", "<i8"), ("node", "<i8"), ("before", "<i8"), ("n", "<i4"), ("place", "<i4")])
#: In the recursion also the component of the pivots a set links with (or -1), one of these pivots (modulo 64, or
#: -1), and a bit for each pivot (modulo 64) within twice the linking distance.
_LABELLED = np.dtype([*_POSTING.descr, ("label", "<i4"), ("pivot", "<i4"), ("near", "<u8")])
_CLASS = ["label", "pivot", "near"]


def _edges(*cols) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(cols[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return np.flatnonzero(new)


def _dealt(postings: list[np.ndarray], parts: int, local: int):
    """Rows of part and postings, one for each part.

    Of a region with over `local` of them, each class of many gives one, with place -1 and the class's size.
    """
    rows = np.concatenate(postings)
    classes = [c for c in _CLASS if c in rows.dtype.names]
    rows = rows[np.argsort(rows["region"], kind="stable")]
    first = _edges(rows["region"])
    size = np.diff(np.append(first, len(rows)))
    if (size > local).any():
        many = np.repeat(size > local, size)
        rest, crowd = rows[~many], rows[many]
        crowd = crowd[np.lexsort([*(crowd[c] for c in classes), crowd["region"]])]
        first = _edges(crowd["region"], *(crowd[c] for c in classes))
        size = np.diff(np.append(first, len(crowd)))
        large = size > min(local, MAX_PIVOTS)
        told = crowd[first[large]]
        told["place"], told["n"] = -1, size[large]
        rows = np.concatenate([rest, crowd[~np.repeat(large, size)], told])
    part = (mix(rows["region"].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    rows, part = rows[(order := np.argsort(part, kind="stable"))], part[order]
    cuts = _edges(part)
    for i in range(0, len(cuts), 256):
        some = cuts[i : i + 256].tolist()
        ends = [*some[1:], int(cuts[i + 256]) if i + 256 < len(cuts) else len(rows)]
        yield pa.RecordBatch.from_arrays([pa.array(part[some].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(some, ends, strict=True)], pa.binary())], ["part", "postings"])


def _grouped(batches, kind):
    """All postings of a partition, sorted by region and node, each node of a region once; those alone in a region are left out."""
    held = [np.frombuffer(x, kind) for b in batches for x in b.column("postings").to_pylist()]
    rows = np.concatenate(held) if held else np.zeros(0, kind)
    del held
    order = np.argsort(rows["region"])
    region = rows["region"][order]
    same = region[1:] == region[:-1]
    keep = np.append(False, same) | np.append(same, False) if len(rows) else np.zeros(0, bool)
    rows = rows[order[keep | (rows["place"][order] < 0)]]
    rows = rows[np.lexsort((rows["node"], rows["region"]))]
    new = np.zeros(len(rows), bool)
    new[_edges(rows["region"], rows["node"])] = True
    return rows[new | (rows["place"] < 0)]


def _rows(kind, a, b):
    for i in range(0, len(a), 100_000):
        part = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[part]), kind, np.int32)), pa.array(a[part]), pa.array(b[part])], ["kind", "a", "b"])


def _distinct(a, b):
    order = np.lexsort((b, a))
    first = _edges(a[order], b[order])
    return a[order][first], b[order][first]


def _tasks(df: DataFrame, n_bytes: int) -> int:
    """Tasks that postings of so many bytes are dealt over."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))


class Phases:
    """Orders of one phase after the other, and the pivots that each phase but the last left crowded."""

    def __init__(self, orders: list[Order], crowds: list[Order]):
        self.orders, self.crowds = orders, crowds

    def going_on(self, sets: Sets) -> list[int]:
        """The sets that went to a crowded pivot in every phase that left some."""
        s, of, _ = self.orders[0].prefixes(sets)
        alive = np.unique(of[self.crowds[0].any_crowded(s)]).tolist()
        for order, crowd in zip(self.orders[1:], self.crowds[1:], strict=False):
            alive = [t for t in alive if crowd.any_crowded(order.prefix(sets.of(t))).any()]
        return alive

    def prefixes(self, sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pivot, set, place) of the last phase."""
        if not self.crowds:
            return self.orders[0].prefixes(sets)
        alive = self.going_on(sets)
        found = [self.orders[-1].prefix(sets.of(t)) for t in alive]
        size = np.array([len(x) for x in found], np.int64)
        of = np.repeat(np.array(alive, np.int64), size)
        return np.concatenate([np.zeros(0, np.uint64), *found]), of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)


def _replicated(docs: DataFrame, phases: Phases, salt: int, tasks: int) -> DataFrame:
    """part, postings: each set of the phase at the pivots within its window, dealt over the tasks by region."""
    sent, parts = docs.sparkSession.sparkContext.broadcast(phases), 8 * tasks

    def run(batches):
        seen: set[int] = set()
        held, size = [], 0
        for batch in batches:
            for _, some in chunks(batch.column("raw").to_pylist()):
                sets = Sets(some)
                node = sets.names(salt)
                fresh = np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool)
                s, of, place = sent.value.prefixes(sets)
                keep = fresh[of]
                s, of, place = s[keep], of[keep], place[keep]
                rows = np.empty(len(s), _POSTING)
                rows["region"], rows["node"], rows["n"], rows["place"] = s.view(np.int64), node[of], sets.n[of], place
                rows["before"] = np.roll(rows["region"], 1)
                held.append(rows)
                size += len(rows)
                if size > HELD:
                    yield from _dealt(held, parts, LOCAL)
                    held, size = [], 0
        if held:
            yield from _dealt(held, parts, LOCAL)

    return docs.mapInArrow(run, "part int, postings binary").repartition(tasks, "part")


def _with_rest(rows, members=None, left=None):
    """Batches of _rows() with the columns of _FOUND, and rows of kind 2 for regions with open pairs."""
    for batch in rows:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.binary()), pa.nulls(batch.num_rows, pa.binary())], ["kind", "a", "b", "members", "open"])
    for i in range(0, len(members or ()), 10_000):
        some = members[i : i + 10_000]
        zero = pa.array(np.zeros(len(some), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), 2, np.int32)), zero, zero, pa.array(some, pa.binary()), pa.array(left[i : i + 10_000], pa.binary())], ["kind", "a", "b", "members", "open"])


def _first_pairs(ok: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs (i, j) in order of i, a row of flags for each region: for each j the first that is set, at most one less than the region's documents."""
    first = np.zeros_like(ok)
    for k in np.unique(j).tolist():
        of = np.flatnonzero(j == k)
        hit = ok[:, of].argmax(1)
        first[np.arange(len(ok)), of[hit]] = ok[np.arange(len(ok)), of[hit]]
    return first


def _joined(crowd: int):
    """Pairs of the regions of a partition (kind 0), crowded ones with their sizes (kind 1), and regions with open pairs (kind 2).

    Two sets that share the pivot before this one, too, have met there, and needn't meet again. A region
    sends on as many pairs as it has documents, less one, at most. If more may link, the others are open.
    """

    def run(batches):
        rows = _grouped(batches, _POSTING)
        if not len(rows):
            return
        s, node, before, n, place = (np.ascontiguousarray(rows[c]) for c in _POSTING.names)
        first = _edges(s)
        size = np.diff(np.append(first, len(s)))
        told = np.add.reduceat(np.where(place < 0, n, 0).astype(np.int64), first)
        many = (size > crowd) | (told > 0)
        yield from _with_rest(_rows(1, s[first[many]], (size + told)[many]))
        out_a, out_b, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
        for m in np.unique(size[(size > 1) & ~many]).tolist():
            of = first[(size == m) & ~many]
            i, j = np.triu_indices(m, 1)
            for k in range(0, len(of), max(1, 400_000 // len(i))):
                at = of[k : k + max(1, 400_000 // len(i)), None]
                x, y = at + i, at + j
                nx, ny = n[x].astype(np.int64), n[y].astype(np.int64)
                ok = (75 * np.maximum(nx, ny) <= 100 * np.minimum(nx, ny)) & linked(np.minimum(nx - place[x], ny - place[y]), nx, ny)
                ok &= (before[x] != before[y]) | (place[x] == 0) | (place[y] == 0)
                large = ok.sum(1) >= m
                sent = ok.copy()
                sent[large] = _first_pairs(ok[large], j)
                x, y = x[sent], y[sent]
                a, b = _distinct(np.minimum(node[x], node[y]), np.maximum(node[x], node[y]))
                out_a.append(a)
                out_b.append(b)
                left = np.packbits((ok & ~sent)[large], axis=1)
                for r, bits in zip(at[large, 0].tolist(), left, strict=True):
                    rest[node[r : r + m].tobytes(), bits.tobytes()] = None
        yield from _with_rest(_rows(0, *_distinct(np.concatenate(out_a), np.concatenate(out_b))), [r[0] for r in rest], [r[1] for r in rest])

    return run


def _collected_crowd(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = found.filter("kind = 1").select("a", "b").toPandas()
    return pdf["a"].to_numpy().astype(np.int64).view(np.uint64), pdf["b"].to_numpy().astype(np.int64)


def _crowded_sets(docs: DataFrame, phases: Phases, salt: int) -> DataFrame:
    """node, shingles of the sets that went to a crowded pivot in every phase; each once."""
    sent = docs.sparkSession.sparkContext.broadcast(phases)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, some in chunks(batch.column("raw").to_pylist()):
                sets = Sets(some)
                own = sets.names(salt)
                some_in = [t for t in sent.value.going_on(sets) if (x := int(own[t])) not in seen and not seen.add(x)]
                if some_in:
                    yield pa.RecordBatch.from_arrays([pa.array(own[some_in]), pa.array([sets.of(t).tobytes() for t in some_in], pa.binary())], ["node", "shingles"])

    return _each_node_once(docs.mapInArrow(run, "node bigint, shingles binary"))


def _each_node_once(sets: DataFrame) -> DataFrame:
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keep = [i for i, x in enumerate(batch.column("node").to_pylist()) if x not in seen and not seen.add(x)]
            yield batch.take(pa.array(keep, pa.int64()))

    return sets.repartition("node").mapInArrow(run, "node bigint, shingles binary")


def _recursive_rows(sets: DataFrame, sent, local: int, tasks: int) -> DataFrame:
    """part, postings of sets with their classes. Sets that are pivots are left out: all their links are known."""
    parts = 8 * tasks

    def run(batches):
        order, pivots, _ = sent.value
        known = set(pivots.nodes.tolist())
        held, size = [], 0
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                if node in known:
                    continue
                h = np.frombuffer(raw, np.uint64)
                s, (links, near) = order.prefix(h), pivots.links(h)
                rows = np.empty(len(s), _LABELLED)
                rows["region"], rows["node"], rows["n"], rows["place"] = s.view(np.int64), node, len(h), np.arange(len(s))
                rows["before"] = 0
                rows["label"], rows["pivot"] = (pivots.component[links[0]], links[0] % 64) if len(links) else (-1, -1)
                rows["near"] = np.bitwise_or.reduce(np.uint64(1) << (near % 64).astype(np.uint64), initial=np.uint64(0))
                held.append(rows)
                size += len(s)
                if size > HELD:
                    yield from _dealt(held, parts, local)
                    held, size = [], 0
        if held:
            yield from _dealt(held, parts, local)

    return sets.mapInArrow(run, "part int, postings binary")


def _class_pairs(classes: np.ndarray):
    """Pairs of a region's classes with members that may link across components.

    Who links with a pivot's member is within twice the linking distance of that pivot.
    """
    label, pivot, near = classes["label"], classes["pivot"], classes["near"]
    bit = lambda masks, p: np.where(p < 0, True, (masks >> np.maximum(p, 0).astype(np.uint64)) & np.uint64(1) == 1)
    i, j = np.triu_indices(len(classes))
    ok = ((label[i] != label[j]) | (label[i] < 0)) & bit(near[j], pivot[i]) & bit(near[i], pivot[j])
    return i[ok], j[ok]


def _joined_recursively(limit: int):
    """Pairs across components (kind 0), crowded regions with sizes (kind 1), candidates for pivots in them (kind 2)."""

    def run(batches):
        rows = _grouped(batches, _LABELLED)
        if not len(rows):
            return
        first = _edges(rows["region"])
        out_a, out_b, crowded, candidates = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
        for a, b in zip(first.tolist(), np.append(first[1:], len(rows)).tolist(), strict=True):
            region = rows[a:b]
            told = region["place"] < 0
            key = region[_CLASS]
            order = np.lexsort([key[c] for c in _CLASS])
            begin = _edges(*(key[c][order] for c in _CLASS))
            members = np.split(order, begin[1:])
            weight = np.where(told, region["n"], 1).astype(np.int64)
            size = np.array([int(weight[m].sum()) for m in members])
            i, j = _class_pairs(key[order[begin]])
            cross = int(np.where(i == j, size[i] * (size[i] - 1) // 2, size[i] * size[j]).sum())
            if not cross:
                continue
            if cross > limit or told.any():
                crowded.append((int(region["region"][0]), int(weight.sum())))
                pool = region[np.concatenate([members[k] for k in np.unique(np.concatenate([i, j]))])]
                pool = pool["node"][pool["label"] < 0] if (pool["label"] < 0).any() else pool["node"]
                few = pool[np.argsort(mix(pool.view(np.uint64)))[:MAX_PIVOTS]]
                candidates += [(int(x), int(weight.sum())) for x in few]
                continue
            x, y = [], []
            for k, m in zip(i.tolist(), j.tolist(), strict=True):
                p, q = np.triu_indices(len(members[k]), 1) if k == m else (g.ravel() for g in np.indices((len(members[k]), len(members[m]))))
                x.append(members[k][p])
                y.append(members[m][q])
            x, y = region[np.concatenate(x)], region[np.concatenate(y)]
            nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
            most = np.minimum(nx - x["place"], ny - y["place"])
            ok = (75 * np.maximum(nx, ny) <= 100 * np.minimum(nx, ny)) & linked(most, nx, ny)
            out_a.append(np.minimum(x["node"], y["node"])[ok])
            out_b.append(np.maximum(x["node"], y["node"])[ok])
        yield from _rows(0, *_distinct(np.concatenate(out_a), np.concatenate(out_b)))
        for kind, found in ((1, crowded), (2, candidates)):
            if found:
                yield from _rows(kind, *(np.array(x, np.int64) for x in zip(*found, strict=True)))

    return run


def _still_crowded(sets: DataFrame, sent) -> DataFrame:
    """The sets that go to a crowded pivot."""

    def run(batches):
        order, crowd = sent.value
        for batch in batches:
            keep = [i for i, raw in enumerate(batch.column("shingles").to_pylist()) if crowd.any_crowded(order.prefix(np.frombuffer(raw, np.uint64))).any()]
            yield batch.take(pa.array(keep, pa.int64()))

    return sets.mapInArrow(run, "node bigint, shingles binary")


def _pivot_links(sets: DataFrame, sent) -> DataFrame:
    """a, b, kind: one link of each set that links with pivots (kind 0), and each two pivots that share a set (kind 1)."""

    def run(batches):
        nodes, shared = sent.value.nodes, set()
        for batch in batches:
            rows = []
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                links = sent.value.links(np.frombuffer(raw, np.uint64))[0]
                if len(links):
                    rows.append((node, int(nodes[links[0]])))
                    shared.update((int(links[0]), int(p)) for p in links[1:])
            if rows:
                yield from _rows(0, *(np.array(x, np.int64) for x in zip(*rows, strict=True)))
        if shared:
            yield from _rows(1, *(nodes[list(x)] for x in zip(*shared, strict=True)))

    return sets.mapInArrow(run, _PAIR)


def _merged(count: int, pairs) -> np.ndarray:
    """Components of the document pivots, from pairs of them that share a document."""
    parent = list(range(count))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return np.array([find(k) for k in range(count)], np.int64)


def _with_sent(sc, value, use):
    """What use() makes of a value sent to all tasks, written down, and the value taken back."""
    sent = sc.broadcast(value)
    out = frozen(use(sent))
    sent.destroy()
    return out


def _recursive_join(sets: DataFrame, size_of: dict[int, int]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Candidate pairs and links (a, b) among sets; size_of has the pivots that come last, with sizes."""
    pairs, links = [], []
    all_nodes: list[int] = []
    all_sets: list[np.ndarray] = []
    component = np.zeros(0, np.int64)
    merged: list[tuple[int, int]] = []
    limit, sc = PAIRS, sets.sparkSession.sparkContext
    while True:
        # sets of a bounded size don't need many tasks
        total = sets.agg(F.sum(F.length("shingles").cast("bigint"))).first()[0] or 0
        few, tasks = total <= FEW_BYTES, _tasks(sets, total // 8 * _LABELLED.itemsize)
        sets = sets.coalesce(1) if few else sets
        order = Order(np.fromiter(size_of.keys(), np.uint64, len(size_of)), np.fromiter(size_of.values(), np.int64, len(size_of)))
        pivots = Pivots(np.array(all_nodes, np.int64), all_sets, component)
        local = FEW_BYTES if few else LOCAL

        def joined(sent, sets=sets, few=few, local=local, limit=limit, tasks=tasks):
            rows = _recursive_rows(sets, sent, local, tasks)
            return (rows if few else rows.repartition(tasks, "part")).mapInArrow(_joined_recursively(limit), _PAIR)

        found = _with_sent(sc, (order, pivots, None), joined)
        pairs.append(found.filter("kind = 0").select("a", "b"))
        h, m = _collected_crowd(found)
        if not len(h):
            return pairs, links
        sets = _with_sent(sc, (order, Order(h, m)), lambda sent, sets=sets: _still_crowded(sets, sent))
        if len(size_of) < MAX_CROWDED:
            size_of |= dict(zip(h.tolist(), m.tolist(), strict=True))
        ranked = found.filter("kind = 2").groupBy("a").agg(F.sum("b").alias("b")).orderBy(F.desc("b"), "a").limit(MAX_PIVOTS)
        size = {r[0]: r[1] for r in sets.join(F.broadcast(ranked.select(F.col("a").alias("node"))), "node").select("node", F.expr("length(shingles) div 8")).collect()}
        chosen, held = [], 0
        for r in ranked.collect():
            if not chosen or held + size[r["a"]] <= MAX_PIVOT_SHINGLES:
                chosen.append(r["a"])
                held += size[r["a"]]
        drawn = {r["node"]: np.frombuffer(bytes(r["shingles"]), np.uint64) for r in sets.filter(F.col("node").isin(chosen)).collect()}
        new_nodes, new_sets = [], []
        for x in chosen:
            if not new_nodes or not len(Pivots(np.array(new_nodes), new_sets).links(drawn[x])[0]):  # else it is linked with a pivot of this step
                new_nodes.append(x)
                new_sets.append(drawn[x])
        all_nodes += new_nodes
        all_sets += new_sets
        reached = _with_sent(sc, Pivots(np.array(all_nodes, np.int64), all_sets), lambda sent, sets=sets: _pivot_links(sets, sent))
        links.append(reached.select("a", "b").filter("a != b"))
        number = {x: k for k, x in enumerate(all_nodes)}
        merged += [(number[r["a"]], number[r["b"]]) for r in reached.filter("kind = 1").select("a", "b").distinct().collect()]
        component = _merged(len(all_nodes), merged)
        limit *= 2  # pivots have taken the close ones; what is left is far apart and few


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that their bitmaps don't rule out."""

    @F.pandas_udf("boolean")
    def may_link(n, m, x, y):
        import pandas as pd

        # |a ^ b| = n + m - 2 shared, and a link needs 7 |a ^ b| <= n + m
        return pd.Series([7 * bitmap_distance(a, b) <= p + q for p, q, a, b in zip(n, m, x, y, strict=True)], dtype=bool)

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("bitmap").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bitmap").alias("y"))
    return pairs.join(left, "a").join(right, "b").filter(may_link("n", "m", "x", "y")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets link."""

    @F.pandas_udf("boolean")
    def link(x, y):
        import pandas as pd

        out = []
        for a, b in zip(x, y, strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            out.append(bool(linked(int((b[at] == a).sum()), len(a), len(b))))
        return pd.Series(out, dtype=bool)

    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(d)) for c, d in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").filter(link("x", "y")).select("a", "b")


def _across(regions: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """The open pairs (a, b) of regions whose documents are in different components, and that their bitmaps don't rule out."""
    regions = frozen(regions.select("members", "open").distinct().withColumn("region", F.monotonically_increasing_id()))

    def members(batches):
        for batch in batches:
            held = [np.frombuffer(x, np.int64) for x in batch.column("members").to_pylist()]
            size = np.array([len(x) for x in held], np.int64)
            of = np.repeat(batch.column("region").to_numpy(), size)
            place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(place.astype(np.int32)), pa.array(np.concatenate(held) if held else np.zeros(0, np.int64))], ["region", "place", "node"])

    def pairs(batches):
        for batch in batches:
            out_a, out_b = [], []
            for held, bits in zip(batch.column("held").to_pylist(), batch.column("open").to_pylist(), strict=True):
                held.sort(key=lambda r: r["place"])
                i, j = np.triu_indices(len(held), 1)
                left = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(i)))
                for x, y in zip(i[left].tolist(), j[left].tolist(), strict=True):
                    x, y = held[x], held[y]
                    if x["root"] != y["root"] and 7 * bitmap_distance(x["bitmap"], y["bitmap"]) <= x["n"] + y["n"]:
                        out_a.append(min(x["node"], y["node"]))
                        out_b.append(max(x["node"], y["node"]))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    held = regions.select("region", "members").mapInArrow(members, "region bigint, place int, node bigint").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = frozen(held)
    mixed = held.groupBy("region").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most").select("region")
    # a region has no more documents than a crowd, and few of them are left
    some = held.join(mixed, "region", "left_semi").join(nodes.select("node", "n", "bitmap"), "node")
    some = some.groupBy("region").agg(F.collect_list(F.struct("place", "node", "root", "n", "bitmap")).alias("held")).join(regions.select("region", "open"), "region")
    return some.select("held", "open").mapInArrow(pairs, "a bigint, b bigint").distinct()


def _sets_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, shingles of the documents in rows (column row)."""

    def run(batches):
        for batch in batches:
            raws, nodes = batch.column("raw").to_pylist(), batch.column("node").to_numpy()
            for begin, some in chunks(raws):
                sets = Sets(some)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[begin : begin + len(some)]), pa.array([sets.h[b : b + k].tobytes() for b, k in zip(sets.begin, sets.n, strict=True)], pa.binary())], ["node", "shingles"])

    few = rows.count() <= 200_000  # 16 bytes each
    rows = rows.select(F.col("row").alias("__row"), "node")
    chosen = docs.join(F.broadcast(rows) if few else rows, docs["row"] == F.col("__row")).select("raw", "node")
    return _each_node_once(chosen.mapInArrow(run, "node bigint, shingles binary"))


def _roots(batches):
    """node, root of a bounded number of links (u, v), in one task."""
    nodes = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not nodes:
        return
    ends = np.concatenate([np.concatenate(x) for x in nodes])
    node, at = np.unique(ends, return_inverse=True)
    pairs, i = [], 0
    for u, _ in nodes:
        k = len(u)
        pairs += zip(at[i : i + k].tolist(), at[i + k : i + 2 * k].tolist(), strict=True)
        i += 2 * k
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[_merged(len(node), pairs)])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): the smallest node of its component, by alternating stars."""
    edges = frozen(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    if edges.count() <= FEW_LINKS:
        return edges.coalesce(1).mapInArrow(_roots, "node bigint, root bigint")
    while True:
        # large star: a node's larger neighbours are hung to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours are hung to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = frozen(small.filter("u != v").distinct())
        same = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if same(after) == same(edges):
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        edges = after


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _classes(df: DataFrame, id_col: str, text_col: str, crowd: int) -> DataFrame:
    """row (a hash of the row), id, n, component and stands_row (the row that stands for the component) for each row."""
    rows = df.select(F.col(id_col).alias("id"), utf8(text_col).alias("raw")).withColumn("row", F.xxhash64("id", "raw"))
    salt = 0
    while True:
        every = frozen(_described(rows, salt))
        told = every.filter("kind = 0").drop("kind")
        nodes = told.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.min("name").alias("name"), F.max("name").alias("other"), F.max("n").alias("n"), F.max_by("bitmap", "row").alias("bitmap"), F.count(F.lit(1)).alias("rows"))
        nodes = frozen(nodes)
        if nodes.filter("name != other").isEmpty():
            break
        salt += 2  # two sequences of words had the same number
    filled = nodes.filter("n > 0").select("node", F.col("first.row").alias("row"), "n", "bitmap")
    late = every.filter("kind = 1").groupBy("node").agg(F.sum("n").cast("bigint").alias("n")).filter(F.col("n") > crowd).orderBy(F.desc("n"), "node").limit(MAX_CROWDED).toPandas()
    late = Order(late["node"].to_numpy().astype(np.int64).view(np.uint64), late["n"].to_numpy().astype(np.int64))
    texts = rows.select("raw")
    postings = filled.agg(F.sum(F.expr("n - (75 * cast(n AS bigint) + 99) div 100 + 1"))).first()[0] or 0
    tasks = _tasks(df, postings * _POSTING.itemsize)
    phases, pairs, regions, links = Phases([late], []), [], [], []
    for limit in (crowd, 4 * crowd):
        while True:
            found = frozen(_replicated(texts, phases, salt, tasks).mapInArrow(_joined(limit), _FOUND))
            if found.filter("kind = 1").count() <= MAX_CROWDED:
                break
            limit *= 2
        pairs.append(found.filter("kind = 0").select("a", "b"))
        regions.append(found.filter("kind = 2"))
        hot, sizes = _collected_crowd(found)
        if not len(hot):
            break
        late = late.with_more(hot, sizes)
        phases = Phases([*phases.orders, late], [*phases.crowds, Order(hot, sizes)])
    if len(hot):
        more, links = _recursive_join(frozen(_crowded_sets(texts, phases, salt)), dict(zip(late.crowded.tolist(), late.sizes.tolist(), strict=True)))
        pairs += more

    def compared(possible):
        wanted = possible.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return frozen(_verified(possible, _sets_of(rows, filled.join(wanted, "node").select("row", "node"))))

    possible = frozen(_possible(_all(pairs).distinct(), filled))
    links.append(compared(possible))
    roots = frozen(components(_all(links)))
    rest = frozen(_across(_all(regions), roots, filled).join(possible, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links.append(compared(rest))
        roots = components(_all(links))
    part = nodes.filter("n > 0").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "rows", F.struct(F.col("first.none"), F.col("first.id"), F.col("first.row")).alias("first"))
    part = frozen(part)
    stands = frozen(part.groupBy("root").agg(F.min("first").alias("stands"), F.count(F.lit(1)).alias("nodes")))
    by_node = joined_by_group(part, stands, "root", "nodes", part.count()).select("node", "rows", F.col("stands.id").alias("component"), F.col("stands.row").alias("stands_row"))
    out = joined_by_group(told.select("row", "id", "node", "n"), by_node, "node", "rows", told.count())
    return out.select("row", "id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"), F.when(F.col("n") > 0, F.col("stands_row")).otherwise(F.col("row")).alias("stands_row"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row for each input row: the id, n_shingles and component_id.

    A text's set has its runs of five words (white-space separated, A-Z in lower case), or with fewer
    words all of them as one; null, empty and blank texts have empty sets, link with nothing and are
    components of their own. Sets link if 100 * shared >= 75 * all. component_id is the smallest id that
    links reach, the own id included; null ids are larger than any other. Repeated rows link with each
    other. An empty table gives an empty result. A text of any length is taken whole, in a few arrays of its
    size in one task. Other columns are not read, so they may have any names.
    """
    out = _classes(df, id_col, text_col, crowd)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.col("component").alias("component_id"))


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row of df for each component, that with the smallest id, with all its columns; rows with empty sets all stay.

    Rows that are alike in id and text stay or go together. Nulls, long texts and an empty table are taken
    as jaccard_components() does. Columns may have any names.
    """
    (mark,) = unused(df, "__gone")
    gone = _classes(df, id_col, text_col, crowd).filter(F.col("row") != F.col("stands_row")).select(F.col("row").alias(mark)).distinct()
    return df.join(gone, F.xxhash64(df[id_col], utf8(df[text_col])) == F.col(mark), "left_anti")
