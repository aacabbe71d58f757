"""Token ids in files: an adaptive context-mixing range coder over independent, checksummed blocks.

The ids of whole documents in order of id make a segment; a segment's ids are cut into blocks of equal length.  Every
block is coded on its own from a fresh state, so any block can be read without the others, and a damaged one is found
by its checksum and harms no other.  All blocks of a segment are coded side by side, one id of each at a step.

Three orders predict the next id of a block.  Order 0 gives every id of the segment a probability, from counts that stand in the
segment's head.  Order 1 predicts the id that last followed the last id, order 2 the id that last followed the last two; each
keeps with its prediction how often it held of late.  The three distributions are mixed with weights that follow how well each has done
in this block where both predictions stood as they stand now, and the mixed probability of the
id itself drives the range coder: nothing of an id is stored beside it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import work_root, write

MAGIC = b"CYTOIDS3"
#: Ids in a block at most, and blocks in a segment.
BLOCK, LANES = 2048, 4096
#: Bits of the hashes under which a block remembers what followed one id and two.
_BITS = 10
#: A prediction's level counts how often it held of late; zero: nothing seen in this context yet.
_LEVELS = 8
#: Weights of the orders are whole numbers out of 4096.
_SHARES = 12
#: A block adapts the weights of orders 2 and 1 out of this, by 1/2^5 of the way at each id.  At first an order has these parts of what is left to it, by level.
_FULL, _RATE = 32_000, 5
_FIRST = np.array([0, 0.1, 0.25, 0.4, 0.5, 0.6, 0.7, 0.8])
_HEAD = struct.Struct("<8sIIQI")


class Zero:
    """Order 0: the segment's distinct ids in ascending order and their frequencies, which add up to a power of two."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids, freq.astype(np.int64)
        self.cum = np.concatenate(([0], np.cumsum(self.freq)))
        self.bits = int(self.cum[-1]).bit_length() - 1
        # From a value to the place of its id; beyond 2^20 values it is searched for instead.
        self.at = np.repeat(np.arange(len(ids)), self.freq) if self.bits <= 20 else None

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Zero, np.ndarray]:
        """The order of a segment's ids, and the place of each id."""
        top = int(ids.max())
        if top < 1 << 22:
            count = np.bincount(ids, minlength=top + 1)
            own = np.flatnonzero(count)
            place = np.zeros(top + 1, np.int32)
            place[own] = np.arange(len(own))
            place, count = place[ids], count[own]
        else:
            own, place, count = np.unique(ids, return_inverse=True, return_counts=True)
        total = 1 << max(16, len(own).bit_length() + 3)
        freq = 1 + count * (total - len(own)) // len(ids)
        freq[np.argmax(count)] += total - freq.sum()
        return cls(own.astype(np.int64), freq), place.reshape(-1)

    def places(self, values: np.ndarray) -> np.ndarray:
        return self.at.take(values) if self.at is not None else np.searchsorted(self.cum, values, "right") - 1

    def dump(self) -> bytes:
        steps = np.diff(self.ids, prepend=0).astype("<u4")
        return zlib.compress(b"".join(x.view("u1").reshape(-1, 4).T.tobytes() for x in (steps, self.freq.astype("<u4"))), 9)

    @classmethod
    def load(cls, raw: bytes) -> Zero:
        x = np.frombuffer(zlib.decompress(raw), "u1")
        steps, freq = (np.ascontiguousarray(part.reshape(4, -1).T).view("<u4").ravel() for part in np.split(x, 2))
        return cls(np.cumsum(steps.astype(np.int64)), freq)


_M = np.uint64(0x9E3779B97F4A7C15)


class Model:
    """State of all blocks side by side; arrays of both orders hold order 2 first.  Only whole numbers, so coder and decoder agree everywhere."""

    def __init__(self, zero: Zero, lanes: int):
        self.zero, self.n, n = zero, lanes, len(zero.ids)
        # What a context is hashed by and what tables hold, by place: eight times (place plus one), to which the level is added.
        self.hash = ((np.arange(1, n + 1, dtype=np.uint64) * _M) >> np.uint64(64 - _BITS)).view(np.int64)
        self.entry = np.arange(1, n + 1, dtype=np.int32) << np.int32(3)
        self.base, self.table = np.arange(2 * lanes) << _BITS, np.zeros(2 * lanes << _BITS, np.int32)
        self.context, self.before = np.zeros(2 * lanes, np.int64), np.zeros(lanes, np.int64)
        # Weights of both orders, by level of order 2, level of order 1 and block.
        two, one = np.repeat(_FIRST, _LEVELS), np.tile(_FIRST, _LEVELS)
        self.weights = np.repeat((np.concatenate((two, (1 - two) * one)) * _FULL).astype(np.int32), lanes)
        self.lane, self.at = np.arange(lanes), np.empty(2 * lanes, np.int64)

    def predict(self) -> None:
        """What both orders predict (``old``: an entry and its level), and the shares f2, f1 and f0 of the orders out of 4096."""
        n = self.n
        self.slot = self.base + self.context
        self.old = self.table.take(self.slot)
        self.level = self.old & np.int32(7)
        row = self.at[:n]
        np.multiply((self.level[:n] << np.int32(3)) + self.level[n:], np.int64(n), out=row)
        row += self.lane
        np.add(row, _LEVELS * _LEVELS * n, out=self.at[n:])
        self.weight = self.weights.take(self.at)
        f = ((self.weight >> np.int32(3)) + np.int32(1)).astype(np.int64)
        self.f2, self.f1 = f[:n], f[n:]
        self.f21 = self.f2 + self.f1
        self.f0 = (1 << _SHARES) - self.f21

    def learn(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the places ``x`` out of 2^(12 + bits of order 0), as predicted; then learns that each block had its place."""
        n, z = self.n, self.zero
        new = self.entry.take(x)
        hit = (self.old.reshape(2, n) ^ new).view(np.uint32) < 8
        start, width = z.cum.take(x) * self.f0, z.freq.take(x) * self.f0
        start += self.f21 << z.bits
        i = np.flatnonzero(hit[0] | hit[1])
        second, f2 = hit[0].take(i), self.f2.take(i)
        start[i] = np.where(second, 0, f2) << z.bits
        width[i] = np.where(second, f2, self.f1.take(i)) << z.bits
        # A prediction that held rises by a level, one that did not makes way for the place.
        held = hit.astype(np.int32)
        level = self.level.reshape(2, n) * held
        level += np.int32(1)
        np.minimum(level, np.int32(7), out=level)
        level += new
        self.table[self.slot] = level.ravel()
        # Order 1 counts where order 2 did not predict the place.
        held[1] -= held[0] & held[1]
        held *= np.int32(_FULL)
        weight = self.weight.reshape(2, n)
        held -= weight
        held >>= np.int32(_RATE)
        held += weight
        self.weights[self.at] = held.ravel()
        g = self.hash.take(x)
        np.bitwise_xor(g, self.before, out=self.context[:n])
        self.context[n:] = g
        self.before = g >> 4
        return start.view(np.uint64), width.view(np.uint64)


class _Words:
    """Coded words: their type, bits, the least width that needs none, and the words of a block of so many ids at most."""

    def __init__(self, zero: Zero, length: int = 0):
        wide = zero.bits + _SHARES <= 32
        self.type, self.room = ("<u4", length + 4) if wide else ("<u2", 4 * length + 8)
        self.bits = np.uint64(32 if wide else 16)
        self.top = np.uint64(64) - self.bits
        self.least = np.uint64(1 << int(self.top))


def _carry(out: np.ndarray, at: np.ndarray) -> None:
    """Add one to the number that ends before each of the places."""
    while len(at):
        at = at - 1
        out[at] += out.dtype.type(1)
        at = at[out.take(at) == 0]


def _grid(n: int) -> tuple[int, int]:
    """(blocks, ids in each) for n ids; the last block is filled up."""
    lanes = -(-n // BLOCK)
    return lanes, -(-n // lanes) if lanes else 0


def code_blocks(zero: Zero, places: np.ndarray) -> list[bytes]:
    """Coded bytes of each block of ids, given as places in ``zero``; fresh states each."""
    lanes, length = _grid(len(places))
    grid = np.zeros(lanes * length, np.int32)
    grid[: len(places)] = places
    grid = np.ascontiguousarray(grid.reshape(lanes, length).T)
    m, bits, w = Model(zero, lanes), np.uint64(zero.bits + _SHARES), _Words(zero, length)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out, at = np.zeros(lanes * w.room, w.type), np.arange(lanes) * w.room
    first = at.copy()
    for row in grid:
        m.predict()
        start, share = m.learn(row.astype(np.int64))
        width >>= bits
        start *= width
        width *= share
        low += start
        _carry(out, at[low < start])
        i = np.flatnonzero(width < w.least)
        while len(i):
            v, j, now = low.take(i), at.take(i), width.take(i) << w.bits
            out[j] = v >> w.top
            at[i], low[i], width[i] = j + 1, v << w.bits, now
            i = i[now < w.least]
    # One more word names a number within the last range; what follows it is read as zeros.
    end = low + (w.least - np.uint64(1))
    _carry(out, at[end < low])
    out[at] = end >> w.top
    at += 1
    return [out[a:b].tobytes() for a, b in zip(first.tolist(), at.tolist(), strict=True)]


def decode_blocks(zero: Zero, blocks: list[bytes], n: int) -> np.ndarray:
    """Places of ``n`` ids from blocks coded by ``code_blocks``."""
    lanes, length = len(blocks), _grid(n)[1]
    m, bits, low0, w = Model(zero, lanes), np.uint64(zero.bits + _SHARES), np.int64(zero.bits), _Words(zero)
    size = np.dtype(w.type).itemsize
    room = max(map(len, blocks)) // size + 8
    words = np.zeros((lanes, room), w.type)
    for i, b in enumerate(blocks):
        words[i, : len(b) // size] = np.frombuffer(b, w.type)
    words, at = words.ravel(), np.arange(lanes) * room
    last = at + room - 1
    width, code = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(lanes, np.uint64)
    for _ in range(8 // size):
        code = (code << w.bits) | words.take(at)
        at += 1
    grid, top = np.zeros((length, lanes), np.int32), (1 << zero.bits) - 1
    for step in range(length):
        m.predict()
        width >>= bits
        v = (code // width).view(np.int64)
        # Whole numbers below 2^53, so the quotient is never rounded over a whole number.
        rest = ((v - (m.f21 << low0)) / m.f0).astype(np.int64)
        x = zero.places(np.clip(rest, 0, top, out=rest)).astype(np.int64, copy=False)
        share, held = v >> low0, (m.old >> np.int32(3)) - np.int32(1)
        np.copyto(x, held[lanes:], where=share < m.f21)
        np.copyto(x, held[:lanes], where=share < m.f2)
        np.maximum(x, 0, out=x)  # only damage that the checksum missed could ask for an empty context
        grid[step] = x
        start, share = m.learn(x)
        start *= width
        code -= start
        width *= share
        i = np.flatnonzero(width < w.least)
        while len(i):
            j, now = at.take(i), width.take(i) << w.bits
            code[i] = (code.take(i) << w.bits) | words.take(np.minimum(j, last.take(i)))
            at[i], width[i] = j + 1, now
            i = i[now < w.least]
    return grid.T.reshape(-1)[:n]


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A segment: head, index of documents, order 0, table of blocks (bytes and checksum of each), blocks."""
    blocks, order = [], b""
    if len(ids):
        zero, places = Zero.of(ids)
        blocks, order = code_blocks(zero, places), zero.dump()
    index = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.array(lengths, "<u4").tobytes()
    tables = np.array([len(b) for b in blocks], "<u4").tobytes() + np.array([zlib.crc32(b) for b in blocks], "<u4").tobytes()
    head = _HEAD.pack(MAGIC, len(doc_ids), len(blocks), len(ids), len(order))
    return head + struct.pack("<I", zlib.crc32(head + index + order + tables)) + index + order + tables + b"".join(blocks)


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a segment; damage is a ValueError that names the block."""
    magic, n_docs, n_blocks, n_ids, n_order = _HEAD.unpack_from(payload)
    at = _HEAD.size + 4
    index, tables = n_docs * 13, n_blocks * 8
    if magic != MAGIC or zlib.crc32(payload[: _HEAD.size] + payload[at : at + index + n_order + tables]) != struct.unpack_from("<I", payload, _HEAD.size)[0]:
        raise ValueError("damaged segment head")
    doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
    null = np.frombuffer(payload, "u1", n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(payload, "<u4", n_docs, at + 9 * n_docs)
    at += index
    order = payload[at : at + n_order]
    at += n_order
    size, crc = np.frombuffer(payload, "<u4", n_blocks, at), np.frombuffer(payload, "<u4", n_blocks, at + 4 * n_blocks)
    at += tables
    blocks = []
    for i, (n, c) in enumerate(zip(size.tolist(), crc.tolist(), strict=True)):
        blocks.append(payload[at : at + n])
        at += n
        if zlib.crc32(blocks[-1]) != c:
            raise ValueError(f"damaged block {i}")
    ids = np.empty(0, np.uint32)
    if n_ids:
        zero = Zero.load(order)
        ids = zero.ids.astype(np.uint32)[decode_blocks(zero, blocks, n_ids)]
    return [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], lengths, ids


def write_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 0, vocabulary: str | None = None) -> None:
    """Encode every text and write its ids and ``end_id`` to files under ``path``, in ascending order of id.

    Rows are range-partitioned by id (nulls first; rows that repeat an id in order of their text), so each file
    holds a range of ids and files follow one another.  A file has rows (shard, segment, n_tokens, payload);
    payload is a segment as ``pack`` makes it.  Null and empty texts have the end id alone.  A text is
    never split over segments, however long.  An empty table writes no segment.  Columns other than the two named are not
    read, whatever their names.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    docs = docs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, segment = TaskContext.get().partitionId(), 0
        e = tokens.encoder(vocabulary or tokens.default_vocabulary())
        names, pieces, held = [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def out() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(pieces), np.uint32)
            payload = pack(names, [len(p) // 4 for p in pieces], ids)
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([segment]), pa.array([len(ids)]), pa.array([payload], pa.binary())], names=["shard", "segment", "n_tokens", "payload"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for d, ids in zip(part.column(0).to_pylist(), e.encode(part.column(1).to_pylist()), strict=True):
                    names.append(d)
                    pieces.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= LANES * BLOCK:
                        yield out()
                        names, pieces, held, segment = [], [], 0, segment + 1
        if names:
            yield out()

    write(docs.mapInArrow(run, "shard long, segment long, n_tokens long, payload binary"), path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, segment, place, doc_id, n_tokens, ids) from the files: one row per document; ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                shard, segment, payload = (b.column(i)[r].as_py() for i in range(3))
                doc_ids, lengths, ids = unpack(payload)
                ends = np.cumsum(lengths, dtype=np.int64)
                for i in range(0, len(doc_ids), 1000):
                    k = slice(i, i + 1000)
                    n = len(doc_ids[k])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * n), pa.array([segment] * n), pa.array(range(i, i + n), pa.int64()), pa.array(doc_ids[k], pa.int64()), pa.array(lengths[k].astype(np.int64)), pa.array((ends[k] - lengths[k]), pa.int64())]
                        + [pa.array([ids[e - m : e].tobytes() for e, m in zip(ends[k], lengths[k].astype(np.int64), strict=True)], pa.binary())],
                        names=["shard", "segment", "place", "doc_id", "n_tokens", "in_segment", "ids"],
                    )

    return spark.read.parquet(path).select("shard", "segment", "payload").mapInArrow(run, "shard long, segment long, place long, doc_id long, n_tokens long, in_segment long, ids binary")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, segment, before): ids in all segments before; from the files' counts alone, payloads are not read.

    Segments are summed within their shard; across shards runs one number per file, as many as shuffle partitions.
    """
    s = spark.read.parquet(path).select("shard", "segment", "n_tokens")
    totals, before, offsets = s.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect(), 0, []
    for r in sorted(totals, key=lambda r: r["shard"]):
        offsets.append((r["shard"], before))
        before += r["n"]
    o = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "shard long, _shard_before long"))
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.withColumn("_own", own).join(o, "shard").select("shard", "segment", (F.col("_own") + F.col("_shard_before")).alias("before"))


def new_path(spark: SparkSession) -> str:
    return f"{work_root(spark)}/cytoframe/ids-{uuid.uuid4().hex}"
