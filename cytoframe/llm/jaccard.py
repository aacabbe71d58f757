"""Exact n-gram Jaccard join with signature trees.

1. Every distinct shingle set gets a content id; equal sets are one node from the first pass on.
2. Blocking that loses a linked pair of large sets with a chance under 1e-9, and smaller ones never: two sets whose Jaccard is at least t differ in at most
   d = (1-t)/(1+t) * (|x|+|y|) shingles.  Cut the hash range into enough segments (``segments``) and one of them
   holds the same shingles in both.  Of nodes with an equal segment, those pairs are joined to blocks whose sizes and sketches allow a link:
   small sets also agree in segments that lie within a passage of many documents, and joining them all would make one block of most of a large table.
3. Within each block (large ones in pairs of chunks) signature trees over the whole sets are walked
   against each other, and what is not pruned is compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialise, mix64, window_hashes, with_rank, word_hashes

#: Sets in one chunk of a large block; a task holds the sets of two chunks.
CHUNK = 1024
#: Bytes of text whose words are hashed together.
STRETCH = 1 << 20
#: Buckets of keys for each shuffle partition.
BUCKETS = 16
#: Bits of a sketch, and about how many shingles it is made of at most.
BITS, SKETCHED = 512, 600
#: Rows of groups that are compared together.
COMPARED = 50_000
#: Hashes that mark the documents of blocks.
MARKS = 1 << 23
#: Children of an inner tree node.
FANOUT = 8


def node_id(s: np.ndarray) -> int:
    """Content id of a sorted shingle array, as a signed 64-bit integer."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


@lru_cache(4096)
def segments(level: int, t: float) -> tuple[int, int]:
    """(segments, spare) for pairs whose smaller set is in class ``level``: classes' bounds grow by 1/t, so linked sets are in the same or in neighbours.

    Two linked sets differ in at most d shingles.  With more than d segments one must agree.  Large sets need fewer: the
    differences are hashed, so of m segments about m * exp(-d / m) hold none of them, less those without shingles, and
    the chance that none is left is below exp of minus that number (empty bins are negatively associated).  Where fewer segments
    leave 22 on average (a chance under 1e-9), they are taken: they hold more shingles, so fewer
    sets agree in one by a shared passage.  ``spare`` segments may be empty in both sets and still one with shingles agrees.
    """
    least, most = math.exp(-math.log(t) * level), math.exp(-math.log(t) * (level + 1))
    d = math.floor((1 - t) / t * most + 1e-6)
    if not d:
        return 1, 0

    def spare(m: int) -> int:
        empty = m * math.exp(-least / m)
        return math.ceil(empty + 4 * math.sqrt(empty))

    sure = d + 1 + spare(d + 1)
    m = 2
    while m < sure and m * math.exp(-d / m) * (1 - math.exp(-least / m)) < 22:
        m += 1
    return m, spare(min(m, d + 1))


def segment_keys(s: np.ndarray, t: float) -> np.ndarray:
    """Keys of which two linked sets share at least one, though they differ."""
    return keys_of_sets(s, np.array([len(s)]), t)[0]


def keys_of_sets(s: np.ndarray, sizes: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """``segment_keys`` of many sets, one after the other in ``s`` and none empty: (keys, the set of each)."""
    keys, sets = [], []
    mixed, which = mix64(s + np.uint64(0x5851F42D4C957F2D)), np.repeat(np.arange(len(sizes)), sizes)
    own = np.floor(np.log(sizes) / -math.log(t) + 1e-9).astype(np.int64)
    for level in (own, own - 1):
        levels, at = np.unique(level, return_inverse=True)
        m, spare = (np.array(x, np.int64)[at] for x in zip(*(segments(k, t) if k >= 0 else (1, 1) for k in levels.tolist()), strict=True))
        salt = (level * 1_000_003 + 17).astype(np.uint64)
        # Sets are sorted, so the shingles of a segment stand together.
        segment = (s >> np.uint64(32)) * m.astype(np.uint64)[which] >> np.uint64(32)
        start = np.flatnonzero(np.concatenate(([True], (segment[1:] != segment[:-1]) | (which[1:] != which[:-1]))))
        count = np.diff(start, append=len(s))
        of, segment = which[start], segment[start]
        k = mix64(np.add.reduceat(mixed, start) ^ mix64(segment + salt[of])) + count.astype(np.uint64)
        if level.min() < 0:
            k, of, segment = (x[level[of] >= 0] for x in (k, of, segment))
        keys.append(k), sets.append(of)
        # Segments without shingles agree for many; only sets with more of them than spare need those keys too.
        for i in np.flatnonzero((level >= 0) & (m - np.bincount(of, minlength=len(sizes)) > spare)).tolist():
            left = np.setdiff1d(np.arange(m[i], dtype=np.uint64), segment[np.searchsorted(of, i) : np.searchsorted(of, i, "right")])
            keys.append(mix64(mix64(left + salt[i]))), sets.append(np.full(len(left), i))
    return np.concatenate(keys), np.concatenate(sets)


def sets_of(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingle sets of texts, some texts at a time: (hashes, sorted and distinct within each text; how many each text has).

    Words and windows of these texts are hashed as whole arrays; no word is looked at by itself.
    """
    size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        # So few that the arrays stay in a processor's cache; a long text stands alone.
        last = at + max(1, int(np.searchsorted(np.cumsum(size[at : at + 256]), STRETCH, "right")))
        yield window_sets(*word_hashes(texts.slice(at, last - at), sized=True), n)
        at = last


def window_sets(words: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``sets_of`` from the hashes of all words and the number of words of each text."""
    words = words.view(np.uint64)
    long, end = count >= n, np.cumsum(count)
    sizes = np.where(long, count - n + 1, count > 0)
    out = np.empty(int(sizes.sum()), np.uint64)
    whole = np.repeat(long, sizes)
    if long.any():
        out[whole] = window_hashes(words, n)[(np.repeat(end, count) - np.arange(len(words)) >= n)[: len(words) - n + 1]]
    if not long.all():
        out[~whole] = [window_hashes(words[e - k : e], k)[0] for e, k in zip(end[~long].tolist(), count[~long].tolist(), strict=True) if k]
    place = np.concatenate(([0], np.cumsum(sizes)))
    first = np.ones(len(out), bool)
    for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True):
        out[a:b].sort()
    first[1:] = out[1:] != out[:-1]
    first[place[:-1][sizes > 0]] = True
    kept = np.concatenate(([0], np.cumsum(first)))[place]
    return out[first], np.diff(kept)


def node_ids(s: np.ndarray, sizes: np.ndarray) -> list[int | None]:
    """Content id of each set, null for an empty one."""
    end = np.cumsum(sizes)
    return [node_id(s[b - k : b]) if k else None for b, k in zip(end.tolist(), sizes.tolist(), strict=True)]


def halvings(sizes: np.ndarray) -> np.ndarray:
    """How often a set of so many shingles is halved for its sketch."""
    return np.ceil(np.log2(np.maximum(sizes, SKETCHED) / SKETCHED)).astype(np.int64)


def sketches(s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two sketches of each set, the second of half as many shingles: every shingle that the halvings leave turns one bit."""
    which, one = np.repeat(np.arange(len(sizes)), sizes), np.uint64(1)
    bit = which * BITS + (s >> np.uint64(20) & np.uint64(BITS - 1)).astype(np.int64)
    out = np.empty((len(sizes), 2, BITS // 8), np.uint8)
    for k in (0, 1):
        left = s & ((one << (halvings(sizes) + k).astype(np.uint64)) - one)[which] == 0
        out[:, k] = np.packbits(np.bincount(bit[left], minlength=len(sizes) * BITS).astype(np.uint8).reshape(-1, BITS) & 1, axis=1)
    return out


def plausible(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sketches (rows of two, as 64-bit words) and sizes may link.

    What differs between two sets is what differs between their sketches, and bits can only hide some of it.  So whole sets are never refused
    wrongly; halved ones have about their share of the differences, with a chance under 1e-9 of more than is allowed for.
    """
    hx, hy = halvings(nx), halvings(ny)
    h, row = np.maximum(hx, hy), np.arange(len(x))
    close = np.abs(hx - hy) <= 1
    differ = np.bitwise_count(x[row, np.minimum(h - hx, 1)] ^ y[row, np.minimum(h - hy, 1)]).sum(1, dtype=np.int64)
    most = (100 - percent) * (nx + ny) / (100 + percent)
    mean = BITS / 2 * (1 - np.exp(-2 / BITS * most / 2.0**h))
    return ~close | (differ <= np.where(h == 0, most + 1e-6, mean + 7 * np.sqrt(mean) + 8))


def document_nodes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, node, sketch): node is the content id of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, nodes, drawn = [], [], []
            for s, k in sets_of(b.column(1), n):
                sizes.extend(k.tolist())
                nodes.extend(node_ids(s, k))
                drawn.extend(x.tobytes() for x in sketches(s, k))
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(drawn, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, sketch binary")


def key_rows(docs: DataFrame, n: int, t: float) -> DataFrame:
    """(bucket, keys, nodes): a bucket is a range of keys; its keys, in order, and the node of each travel in one row, as the bytes of 64-bit numbers."""
    flush = 2_000_000
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, nodes, held = set(), [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            k, v = np.concatenate(keys), np.concatenate(nodes)
            keys.clear(), nodes.clear()
            order = np.argsort(k)
            k, v = k[order], v[order]
            of = np.concatenate(([0], np.searchsorted(k, np.ceil(np.arange(1, buckets) * (2.0**64 / buckets)).astype(np.uint64)), [len(k)])).tolist()
            rows = [(i, of[i], of[i + 1]) for i in range(buckets) if of[i] < of[i + 1]]
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                packed = [pa.array([x[i:j].tobytes() for _, i, j in part], pa.binary()) for x in (k, v)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), *packed], names=["bucket", "keys", "nodes"])

        for batch in batches:
            for s, sizes in sets_of(batch.column(1), n):
                new = np.zeros(len(sizes), bool)
                ids = node_ids(s, sizes)
                for i, v in enumerate(ids):
                    if v is not None and v not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(v)
                        new[i] = True
                if new.any():
                    k, of = keys_of_sets(s[np.repeat(new, sizes)], sizes[new], t)
                    keys.append(k)
                    nodes.append(np.array([v for v, x in zip(ids, new.tolist(), strict=True) if x], np.int64)[of])
                    held += len(k)
                    if held > flush:
                        yield from out()
                        held = 0
        yield from out()

    return docs.mapInArrow(run, "bucket long, keys binary, nodes binary")


def groups_of(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, node) of the keys that several nodes have; the group's id is made of its nodes, so that equal groups are one."""
    order = np.argsort(keys)
    k, v = keys[order], nodes[order]
    again = k[1:] == k[:-1]
    shared = np.concatenate((again, [False])) | np.concatenate(([False], again))
    k, v = k[shared], v[shared]
    order = np.lexsort((v, k))
    k, v = k[order], v[order]
    if len(k):
        once = np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])))
        k, v = k[once], v[once]
        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        count = np.diff(start, append=len(k))
        group = np.repeat(np.add.reduceat(mix64(v.view(np.uint64)), start), count)
        return group.view(np.int64)[(several := np.repeat(count > 1, count))], v[several]
    return v, v


def key_groups(rows: DataFrame) -> DataFrame:
    """(grp, node) of nodes that share a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keys, nodes = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if len(keys) > 1 or keys and len(keys[0]) > 1:
                columns = groups_of(np.concatenate(keys), np.concatenate(nodes))
                for at in range(0, len(columns[0]), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 200_000]) for x in columns], names=["grp", "node"])

        for batch in batches:
            for at, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != bucket:
                    yield from out()
                    bucket, keys, nodes = at, [], []
                keys.append(np.frombuffer(k, np.uint64))
                nodes.append(np.frombuffer(v, np.int64))
        yield from out()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "grp long, node long")


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, places of the least of each part, once the places a and b are joined."""
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label != (up := label[label])).any():
            label = up
    return label


def plausible_pairs(group: np.ndarray, size: np.ndarray, drawn: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs within a group that may link: a forest with the connectivity of all such pairs, nearly.  Rows are sorted by group and size."""
    end, label = np.searchsorted(group, group, "right"), np.arange(len(group))
    left, right = [label[:0]], [label[:0]]
    a, step = np.arange(len(group)), 0
    while len(a):
        step += 1
        a = a[a + step < end[a]]
        # Sizes rise within a group, so what is too large for a set stays so.
        a = a[100 * size[a] >= percent * size[a + step]]
        for at in range(0, len(a), COMPARED):
            i = a[at : at + COMPARED]
            i = i[label[i] != label[i + step]]
            i = i[plausible(drawn[i], drawn[i + step], size[i], size[i + step], percent)]
            if len(i):
                left.append(i), right.append(i + step)
                label = joined(label, i, i + step)
    return np.concatenate(left), np.concatenate(right)


def block_edges(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b) for rows (grp, node, size, sketch): nodes of a group that may link, of which all are connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            group, node, size, drawn = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # The last group may go on in the next rows.
            whole = len(group) if last else int(np.flatnonzero(group == group[-1])[0])
            if whole < len(group):
                held.append((group[whole:], node[whole:], size[whole:], drawn[whole:]))
            a, b = plausible_pairs(group[:whole], size[:whole], drawn[:whole], percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        for b in batches:
            if b.num_rows:
                numbers = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                held.append((*numbers, np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(b.num_rows, 2, -1)))
                if sum(len(x[0]) for x in held) >= COMPARED and held[-1][0][-1] != held[0][0][0]:
                    yield from out(False)
        if held:
            yield from out(True)

    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.select("grp", "node", "size", "sketch").repartition(n, "grp").sortWithinPartitions("grp", "size", "node").mapInArrow(run, "a long, b long")


class Tree:
    """Signature tree over sets: leaves in order of size and smallest hashes, inner nodes over FANOUT children each with the OR
    of their token bitmaps, their range of sizes, and the most shingles a set of theirs has beyond its own bits."""

    def __init__(self, sets: list[np.ndarray], which: np.ndarray, width: int):
        order = sorted(which.tolist(), key=lambda i: (len(sets[i]), int(sets[i][0])))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.leaf = np.array(order)
        bits = np.zeros((len(order), width // 8), np.uint8)
        for r, i in enumerate(order):
            at = (sets[i] & np.uint64(width - 1)).astype(np.int64)
            np.bitwise_or.at(bits[r], at >> 3, (1 << (at & 7)).astype(np.uint8))
        size = np.array([len(sets[i]) for i in order])
        spare = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        low = high = size
        words = bits.view(np.uint64) if width >= 64 else bits
        self.levels.append((words, low, high, spare))
        while len(words) > 1:
            cut = np.arange(0, len(words), FANOUT)
            words, low, high, spare = np.bitwise_or.reduceat(words, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(spare, cut)
            self.levels.append((words, low, high, spare))


def tree_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of ``left`` and ``right`` (indexes; may be the same) that join what was not joined before: a
    forest with the connectivity of all links.  100 * |x & y| >= percent * |x | y| decides."""
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []

    def compare(i: int, j: int) -> None:
        if find(i) == find(j):
            return
        x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        if 100 * len(x) < percent * len(y):
            return
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int((y[at] == x).sum())
        if 100 * both >= percent * (len(x) + len(y) - both):
            parent[find(i)] = find(j)
            links.append((i, j))

    largest = max(len(s) for s in sets)
    width = 1 << min(16, max(6, (2 * largest - 1).bit_length()))
    same = left is right
    a = Tree(sets, left, width)
    b = a if same else Tree(sets, right, width)
    # Neighbours in the leaf order first: copies of one text stand close, and once joined they need no more comparing.
    for order in (a.leaf,) if same else ():
        for i, j in zip(order.tolist(), order[1:].tolist()):  # noqa: B905
            compare(i, j)
    if not same:
        for j in b.leaf.tolist():
            compare(int(a.leaf[len(a.leaf) // 2]), j)
    share = percent / (100 + percent)
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if la == 0 and lb == 0:
            if not (same and i >= j):
                compare(int(a.leaf[i]), int(b.leaf[j]))
            continue
        # Open the higher node, or the left one, and test all its children against the other node at once.
        if la >= lb:
            first, last = i * FANOUT, min((i + 1) * FANOUT, len(a.levels[la - 1][0]))
            words, low, high, spare = (x[first:last] for x in a.levels[la - 1])
            other = tuple(x[j] for x in b.levels[lb])
        else:
            first, last = j * FANOUT, min((j + 1) * FANOUT, len(b.levels[lb - 1][0]))
            words, low, high, spare = (x[first:last] for x in b.levels[lb - 1])
            other = tuple(x[i] for x in a.levels[la])
        overlap = np.bitwise_count(words & other[0]).sum(1, dtype=np.int64) + np.minimum(spare, other[3])
        most = np.minimum(overlap, np.minimum(high, other[2]))
        ok = (most >= share * (low + other[1]) - 1e-9) & (100 * high >= percent * other[1]) & (100 * other[2] >= percent * low)
        for c in np.flatnonzero(ok).tolist():
            na, nb = ((la - 1, first + c), (lb, j)) if la >= lb else ((la, i), (lb - 1, first + c))
            if same and na[0] == nb[0] and na[1] > nb[1]:
                continue  # the mirrored pair is visited too
            stack.append((*na, *nb))
    return links


def chunk_links(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b) links found in rows (task, node, side, data): side 0 alone is joined with itself, 0 and 1 with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        task = None

        def out() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            held.sort(key=lambda r: r[0])
            sets = [np.frombuffer(r[2], np.uint64) for r in held]
            side = np.array([r[1] for r in held])
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1)
            if len(left) and (len(right) or len(left) > 1):
                links = tree_links(sets, left, right if len(right) else left, percent)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in links], pa.int64()), pa.array([held[j][0] for _, j in links], pa.int64())], names=["a", "b"])

        for b in batches:
            for k, node, side, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != task:
                    yield from out()
                    held, task = [], k
                held.append((node, side, data))
        yield from out()

    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(n, "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``, and few others: those whose hash is one of theirs, of MARKS.

    The marks are broadcast, 64 in a row, so that texts of documents that no block holds are not shuffled; a join by the id itself follows.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    marked = ids.select(F.shiftright(place, 6).alias("_word"), (place % 64).cast("int").alias("_bit"))
    marks = marked.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_marks"))
    d = docs.withColumns({"_word": F.shiftright(place, 6), "_bit": (place % 64).cast("int")}).join(F.broadcast(marks), "_word")
    return d.where(F.expr("shiftrightunsigned(_marks, _bit) & 1L") == 1).drop("_word", "_bit", "_marks")


def set_rows(docs: DataFrame, n: int) -> DataFrame:
    """(node, block, chunk, others, data) for rows (doc_id, text, node, block, ...): data holds the sorted shingle hashes, null where a
    row of this id has another text than the one that stands for the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for s, sizes in sets_of(b.column(1), n):
                part = b.slice(at, len(sizes))
                at, cut = at + len(sizes), np.split(s, np.cumsum(sizes)[:-1])
                data = [x.tobytes() if v is not None and v == w else None for x, v, w in zip(cut, node_ids(s, sizes), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(2, 6)] + [pa.array(data, pa.binary())], names=["node", "block", "chunk", "others", "data"])

    return docs.select("doc_id", "text", "node", "block", "chunk", "others").mapInArrow(run, "node long, block long, chunk long, others array<long>, data binary")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id); documents link when 100 * |x & y| >= percent * |x | y|.

    A set holds the distinct n-word shingles of the text in lower case (A-Z); with fewer words, the whole sequence as
    one shingle.  component_id is the smallest doc_id reachable over links.  All links count; none of small sets is lost, and one of large sets with a chance under 1e-9 each in ``segments`` and ``plausible``,
    to sampling or to a cap; equal sets are handled as one.

    Null, empty and blank texts have no shingles, link with nothing, and are their own component.  A row whose
    id is null takes part in no link; it gets the component of an equal set, or null.  Repeated rows give repeated
    results.  An empty table gives no rows.  Other columns are not read.
    """
    t = percent / 100
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    nodes = materialise(document_nodes(docs, n), "nodes")
    if nodes.where("node is not null").isEmpty():
        return nodes.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    known = nodes.where("node is not null").select("node", F.col("n_shingles").alias("size"), "sketch").dropDuplicates(["node"])
    blocks = components(block_edges(key_groups(key_rows(docs, n, t)).distinct().join(known, "node"), percent))
    # One document stands for each node of a block; blocks of over ``chunk`` sets are cut in order of size.
    reps = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("size"))
    member = materialise(blocks.select("node", F.col("label").alias("block")).join(reps, "node"), "members")
    counts = member.groupBy("block").agg(F.count("*").alias("in_block"))
    member = member.join(counts, "block")
    small = member.where(F.col("in_block") <= chunk).select("doc_id", "node", "block", F.lit(0).cast("long").alias("chunk"), F.array(F.lit(0).cast("long")).alias("others"))
    large = chunked(member.where(F.col("in_block") > chunk), chunk, percent)
    chosen = small.unionByName(large).where("doc_id is not null")
    sets = materialise(set_rows(among(docs, member).join(chosen, "doc_id"), n).where("data is not null"), "sets")
    links = components(chunk_links(chunk_groups(sets), percent))
    discard(sets)
    per_node = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    labelled = per_node.join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    of_node = labelled.join(least, "label").select("node", "component_id")
    out = nodes.join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def chunked(member: DataFrame, chunk: int, percent: int) -> DataFrame:
    """Members of large blocks with their chunk, which is their place in the block in order of size, and the chunks whose sizes allow links."""
    if member.isEmpty():
        return member.select("doc_id", "node", "block", F.col("in_block").alias("chunk"), F.array("in_block").alias("others"))
    r = with_rank(member.select("doc_id", "node", "block", "in_block", "size"), "block", "size", "node")
    starts = r.groupBy("block").agg(F.min("rank").alias("start"))
    r = r.join(starts, "block").withColumn("chunk", F.floor((F.col("rank") - F.col("start")) / chunk).cast("long"))
    sizes = r.groupBy("block", "chunk").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    # One entry for each chunk of a block.
    all_chunks = sizes.groupBy("block").agg(F.collect_list(F.struct("chunk", "lo", "hi")).alias("_all"))
    r = r.join(all_chunks, "block")
    own = F.filter("_all", lambda x: x["chunk"] == F.col("chunk"))[0]
    near = F.filter("_all", lambda x: (100 * x["hi"] >= percent * own["lo"]) & (100 * own["hi"] >= percent * x["lo"]))
    return r.select("doc_id", "node", "block", "chunk", F.transform(near, lambda x: x["chunk"]).alias("others"))


def chunk_groups(sets: DataFrame) -> DataFrame:
    """(task, node, side, data): a block's chunk meets itself and every chunk of near sizes once."""
    other = F.explode("others").alias("other")
    s = sets.select("node", "block", "chunk", "data", other)
    lo, hi = F.least("chunk", "other"), F.greatest("chunk", "other")
    return s.select(F.xxhash64("block", lo, hi).alias("task"), "node", F.when(F.col("chunk") == lo, 0).otherwise(1).alias("side"), "data")
