"""Shared helpers: work tables in the shared folder, word arrays, hashing, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \t \n \v \f \r.  ``bytes.split()`` splits on
#: exactly these six characters, and ``bytes.lower()`` lower-cases exactly A-Z.
WORD = r"[^\x20\x09-\x0D]+"


#: Temporary folders by application, where no shared folder is set.
_OWN: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors: ``spark.checkpoint.dir``; a temporary one only where it is unset in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="cytoframe-")
        root = _OWN[app]
    return root.rstrip("/")


#: Spark then deletes a query's shuffle files as soon as the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries run inside hand Python so many rows at once at most: for tables whose rows are large."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before) if before is not None else spark.conf.unset(_BATCH)


def write(df: DataFrame, path: str, by: str | None = None) -> None:
    """Write Parquet, and free the shuffle files of the query at once: nothing reads them after their result is on disk."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        # Whether to clean up is settled when a query is planned, so the frame is made anew under the setting.
        out = df.select("*").write
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)


def materialise(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table (in folders by the values of a column) in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/cytoframe/{name}-{uuid.uuid4().hex}"
    write(df, path, by)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete work tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_work_path", None)
        if path:
            discard_path(t.sparkSession, path)


def discard_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first variation of it that no column of ``df`` has (Spark does not tell upper from lower case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(df: DataFrame) -> Column:
    """64-bit hash of all columns of a row; nulls count, so that equal values in other columns differ."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"`{c}`").isNull() for c in df.columns))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound and then started afresh."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S = np.uint64(29)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of all n-word windows; with fewer words, of the whole sequence as one; empty without words."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    h = window_hashes(words, min(n, len(words)))
    h.sort()
    if len(h) > 1:
        h = h[np.concatenate(([True], h[1:] != h[:-1]))]
    return h


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words, in order; there are k words at least."""
    last = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = np.full(last, k, np.uint64)
        for i in range(k):
            h = (h ^ (h >> _S)) * _M1 + words[i : i + last]
        return mix64(h)


def with_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Number the rows 1, 2, ... in the order of the named columns (nulls first), without gathering them in one task.

    The rows are range-partitioned and sorted once and written; their place in their
    partition plus the (few) partition counts before it is the rank.  The order columns should
    decide the order fully; rows that agree in all of them are alike and take any order.
    """
    spark = df.sparkSession
    df = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    df = materialise(df.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    # One row for each partition: as many as shuffle partitions, however large the input.
    counts = sorted((r["p"], r["n"]) for r in df.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before or [(0, 0)], "_p long, _before long"))
    in_part = F.col("_at") - F.shiftleft(part, 33)
    out = df.withColumn("_p", part).join(offsets, "_p").withColumn(name, F.col("_before") + in_part + 1)
    return out.drop("_p", "_before", "_at")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long) as (node, label); the label is any one value per component.

    Contraction: every node points to its smallest neighbour in a random (hashed) order, both ends of every
    edge move to where they point, and what is left is solved again, so each round removes a share
    of the nodes whatever the graph's shape.  Minima are combined before each shuffle, so a node with very
    many neighbours costs no more than others.  Nodes without edges do not appear.
    """
    spark = edges.sparkSession
    e = materialise(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    labels, rounds = None, 0
    while not e.isEmpty():
        rounds += 1
        h = lambda c: F.struct(F.xxhash64(c, F.lit(rounds)).alias("h"), c.alias("v"))
        both = e.select(F.col("a").alias("node"), F.col("b").alias("o")).union(e.select(F.col("b"), F.col("a")))
        to = both.groupBy("node").agg(F.min(h(F.col("o"))).alias("m"))
        to = materialise(to.select("node", F.least(h(F.col("node")), F.col("m"))["v"].alias("to")), "hook")
        moved = (
            e.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .where("a <> b").distinct()
        )
        nxt = materialise(moved, "edges")
        if labels is None:
            new = to.select("node", F.col("to").alias("label"))
            labels_next = materialise(new, "labels")
        else:
            new = labels.join(to.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels_next = materialise(new, "labels")
            discard(labels)
        discard(e, to)
        labels, e = labels_next, nxt
        del moved, both, to, new
    discard(e)
    return labels if labels is not None else spark.createDataFrame([], "node long, label long")


_H1, _H2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Longer stretches are never taken for one another.
HUGE = 256
#: The last bytes of a word of eight that do not belong to a stretch of so many bytes are masked.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of stretches of bytes, and their first eight bytes; ``data`` has eight bytes to spare at its end."""
    words = np.lib.stride_tricks.as_strided(data[: (len(data) // 8) * 8].view(np.uint64), (len(data) - 8,), (1,))
    with np.errstate(over="ignore"):
        head = words[start] & _MASKS.take(np.minimum(size, 8))
        h = (head ^ size.astype(np.uint64)) * _H1
        h ^= h >> np.uint64(32)
        left = np.flatnonzero(size > 8)
        done = 8
        while len(left) and done < HUGE:
            w = words[start[left] + done] & _MASKS.take(np.minimum(size[left] - done, 8))
            x = (h[left] ^ w) * _H2
            h[left] = x ^ (x >> np.uint64(29))
            done += 8
            left = left[size[left] > done]
        h = (h ^ (h >> np.uint64(31))) * _H2
    return h, head


def word_hashes(texts: pa.Array, sized: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(signed hashes of all words of the texts in order, lower-cased in A-Z; number of words of each text); null is empty.

    With ``sized`` a short word and one that ends in zero bytes have hashes of their own.
    """
    raws = text_bytes(texts)
    joined = b" ".join([*raws, bytes(16)]).lower()
    data, total = np.frombuffer(joined, np.uint8), len(joined) - 16
    gap = (data[:total] == 32) | ((data[:total] - np.uint8(9)) < 5)
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    size = end - start
    h, _ = hashes(data, start, size)
    for i in np.flatnonzero(size > HUGE).tolist():
        h[i] = xxhash.xxh3_64_intdigest(joined[start[i] : end[i]])
    if sized:
        h = h + size.astype(np.uint64) * _M3
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in raws), np.int64, len(raws)))
    return h.view(np.int64), np.diff(np.searchsorted(start, ends), prepend=0)


class Places:
    """Places of 64-bit hashes in an array of distinct ones, by an open table."""

    def __init__(self, known: np.ndarray):
        bits = max(8, (2 * len(known)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.hash, self.place = np.zeros(1 << bits, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(known)), self._slot(known)
        while len(left):
            free = self.place.take(slot) < 0
            # Of several for one slot the last written stays, and the others go on.
            self.place[slot[free]] = left[free]
            won = free & (self.place.take(slot) == left)
            self.hash[slot[won]] = known[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slot(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h.view(np.uint64) * _H1) >> self.shift).view(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places, or -1."""
        slot = self._slot(h)
        out = self.place.take(slot).astype(np.int64)
        left = np.flatnonzero((out >= 0) & (self.hash.take(slot) != h))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            p = self.place.take(slot)
            out[left] = p
            on = (p >= 0) & (self.hash.take(slot) != h[left])
            left, slot = left[on], slot[on]
        return out
