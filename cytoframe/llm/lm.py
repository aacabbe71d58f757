"""LM scoring with a Brown class-based bigram model; classes come from the exchange algorithm, run in parallel.

P(text) is the product over its tokens (words, then one end) of P(class | class before) * P(token | class).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Places, discard, few_rows, materialise, word_hashes

#: Least number of classes (it grows with the fourth root of the clustered words beyond 2^16), and of words whose counts
#: every worker holds; all words of count FREQUENT are among them however many, and are assigned to classes one by one.
#: Words beyond are not dropped: those in the lexicon share classes by count band, and the rest one class; their counts are joined.
CLASSES, LEXICON = 64, 1 << 19
#: Least count of a word that is assigned a class of its own choice.
FREQUENT = 16
#: The words move in so many parts by turns; exchange ends when all parts together raise the likelihood by less than this share of
#: what was won so far.
PARTS, TOLERANCE = 4, 0.05
BANDS = 64
DELTA = 0.1
KAPPA = 5.0
END_HASH = -(1 << 63)


def training(id_col: Column) -> Column:
    """Rows to learn from: crc32 of the id as text leaves a remainder by 10; rows without an id are held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 10 != 0, F.lit(False))


def band(n: np.ndarray | int) -> np.ndarray:
    return np.minimum(np.log2(n).astype(np.int64), BANDS - 1)


@dataclass
class Lexicon:
    hashes: np.ndarray  # sorted, signed
    counts: np.ndarray
    symbol: np.ndarray  # clustered words have 0 .. m-1, others m + band
    m: int  # clustered words; m + BANDS is any word outside the lexicon, m + BANDS + 1 the end
    rank: np.ndarray  # of clustered words, by count

    @property
    def size(self) -> int:
        return self.m + BANDS + 2


@dataclass
class Model:
    lexicon: Lexicon
    log_emit: np.ndarray  # per lexicon word: log10 P(word | class)
    class_of: np.ndarray  # per symbol
    log_step: np.ndarray  # log10 P(class | class before)
    outside_unseen: float  # weight of all unseen words together, next to the counts of words outside the lexicon
    outside_total: float  # their sum
    n: int  # training tokens
    v: int  # distinct training tokens
    n_end: int


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text); no word has the end's hash."""
    h, lengths = word_hashes(texts)
    return np.where(h == END_HASH, h + 1, h), lengths


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


class Counts:
    """Counts by key, summed again and again as they come; given out where they become too many to hold."""

    def __init__(self, most: int = 1_500_000, at_once: int = 1_000_000):
        self.most, self.at_once, self.keys, self.sums, self.fresh, self.n_fresh = most, at_once, np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> bool:
        """Whether it is time to give them out."""
        self.fresh.append(keys)
        self.n_fresh += len(keys)
        if self.n_fresh < self.at_once:
            return False
        self.settle()
        return len(self.keys) > self.most

    def settle(self) -> None:
        if self.fresh:
            u, n = np.unique(np.concatenate(self.fresh), return_counts=True)
            self.keys, self.sums = summed(np.concatenate((self.keys, u)), np.concatenate((self.sums, n)))
            self.fresh, self.n_fresh = [], 0

    def out(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.settle()
        for i in range(0, len(self.keys), 200_000):
            yield self.keys[i : i + 200_000], self.sums[i : i + 200_000]
        self.keys, self.sums = self.keys[:0], self.sums[:0]

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All of them at once; afterwards there are none."""
        self.settle()
        out = self.keys, self.sums
        self.keys, self.sums = self.keys[:0], self.sums[:0]
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """(h, n): counts by word hash; counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ends = Counts(), 0
        rows = lambda: (pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"]) for h, n in counts.out())
        for b in batches:
            ends += b.num_rows
            for at in range(0, b.num_rows, 256):
                if counts.add(words_in(b.column(0).slice(at, 256))[0]):
                    yield from rows()
        yield from rows()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END_HASH]), pa.array([ends])], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _step_of(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * 8)


def lexicon(counts: DataFrame, size: int | None, clustered: int | None) -> tuple[Lexicon, int]:
    """The most frequent words: all whose count reaches the least eighth of a doubling for which they are at most ``size``.

    Words that occur once stay outside: their class stands for words never seen, and learns where such words come.
    Without limits all words of count FREQUENT are in, and are clustered; what comes to the driver grows with their number.
    """
    steps = sorted(((r["s"], r["k"]) for r in counts.where(F.col("h") != END_HASH).groupBy(_step_of(F.col("n")).alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)

    def reach(limit: int) -> int:
        total, least = 0, 1 << 62
        for s, k in steps:
            total += k
            if total > limit:
                break
            least = s
        return least

    frequent = int(8 * np.log2(FREQUENT))
    low = min(max(reach(LEXICON), 8), frequent) if size is None else max(reach(size), 8)
    high = frequent if clustered is None else max(reach(clustered), frequent)
    t = counts.where((F.col("h") != END_HASH) & (_step_of(F.col("n")) >= low)).select("h", "n", (_step_of(F.col("n")) >= high).alias("own")).toArrow()
    h, n, own = (t.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(3))
    h, n, own = h.astype(np.int64), n.astype(np.int64), own.astype(bool)
    order = np.argsort(h)
    h, n, own = h[order], n[order], own[order]
    m = int(own.sum())
    symbol = m + band(n) if len(n) else np.empty(0, np.int64)
    # In order of their hashes, so that any range of symbols is a fair sample of the words.
    symbol[own] = np.arange(m)
    rank = np.empty(m, np.int64)
    rank[np.lexsort((h[own], -n[own]))] = np.arange(m)
    return Lexicon(h, n, symbol, m, rank), low


def with_ends(symbols: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The texts' symbols with an end before the first text and after each: a text starts in the state that an end leaves."""
    return np.insert(np.concatenate(([end], symbols)), np.cumsum(lengths) + 1, end)


#: Pairs of symbols that one bucket of them holds at most, about, before equal ones of different tasks are put together.
BUCKET = 2_000_000
#: Entries in one row of these tables (a word's contexts may be more), and rows that Python gets at once while they are made and while words move.
ROW, MAKING, MOVING = 16_384, 64, 8
_BLOB_TYPES = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
_BLOBS = "bucket int, side int, w binary, o binary, n binary"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _by_bucket(df: DataFrame) -> DataFrame:
    """Rows of one bucket in one task, one bucket after the other; ``_whole`` puts them together."""
    return df.repartition("bucket").sortWithinPartitions("bucket")


def _whole(batches: Iterator[pa.RecordBatch], types: tuple[type, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, its arrays) from rows (bucket, arrays as bytes) in order of bucket."""
    now, held = None, []
    join = lambda: [np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), types, strict=True)]
    for b in batches:
        for i in range(b.num_rows):
            bucket = b.column(0)[i].as_py()
            if held and bucket != now:
                out, held = join(), []
                yield now, out
                del out
            now = bucket
            held.append([b.column(j)[i].as_py() for j in range(1, len(types) + 1)])
    if held:
        out, held = join(), []
        yield now, out


def _pieces(starts: list[int]) -> Iterator[tuple[int, int, int]]:
    """(place in the list, start, end): the ranges between its members in pieces of at most ROW."""
    for i, (x, y) in enumerate(zip(starts, starts[1:], strict=False)):
        yield from ((i, z, min(z + ROW, y)) for z in range(x, y, ROW))


def bigrams(docs: DataFrame, shared, tokens: int) -> tuple[DataFrame, DataFrame]:
    """Counts of neighbouring symbols as a table of pairs, and of the contexts of every clustered word.

    Both hold arrays as bytes, a few rows per bucket.  Pairs: (bucket, side, w, o, n), side 0: o stands after w, side 1: before it (for
    clustered w alone), so side 0 holds every pair once.  Contexts: (part, w, side, o, n), all entries of a word in one row, in order of w; parts are
    those in which words move.

    Pairs are counted within each task, then in buckets by a hash of the pair, so that no word's pairs meet in one task before equal
    ones are one; buckets grow in number with the tokens.  A word has at most two entries per symbol.
    """
    lex, buckets = shared.value, max(1, -(-tokens // BUCKET))
    k, m = lex.size, lex.m
    bounds = np.arange(buckets + 1) * m // buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        places, end, symbols, counts = Places(own.hashes), m + BANDS + 1, np.append(own.symbol, m + BANDS), Counts()

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = counts.take()
            at = (((keys.view(np.uint64) * _SPREAD) >> np.uint64(33)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
            order = np.argsort(at, kind="stable")
            keys, n, at = keys[order], n[order], at[order]
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else order
            for _, x, y in _pieces([*first.tolist(), len(at)]):
                yield pa.RecordBatch.from_arrays([pa.array([int(at[x])], pa.int32()), pa.array([keys[x:y].tobytes()], pa.binary()), pa.array([n[x:y].tobytes()], pa.binary())], names=["bucket", "k", "n"])

        for b in batches:
            for i in range(0, b.num_rows, 256):
                h, lengths = words_in(b.column(0).slice(i, 256))
                line = with_ends(symbols[places.find(h)], lengths, end)
                if counts.add(line[:-1] * k + line[1:]):
                    yield from out()
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (keys, n) in _whole(batches, (np.int64, np.int64)):
            keys, n = summed(keys, n)
            a, b = (x.astype(np.int32) for x in np.divmod(keys, k))
            for side, w, o in ((0, a, b), (1, b, a)):
                order = np.argsort(w, kind="stable")
                w, o, c = w[order], o[order], n[order]
                cuts = np.append(np.searchsorted(w, bounds), len(w) if side == 0 else np.searchsorted(w, m)).tolist()
                rows = [(i, side, w[x:y].tobytes(), o[x:y].tobytes(), c[x:y].tobytes()) for i, x, y in _pieces(cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _BLOB_TYPES, strict=True)] if rows else [pa.array([], t) for t in _BLOB_TYPES], names=["bucket", "side", "w", "o", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (w, side, o, n) in _whole(_with_sides(batches), (np.int32, np.uint8, np.int32, np.int64)):
            for part in range(PARTS):
                own = np.flatnonzero(w % PARTS == part)
                own = own[np.argsort(w[own], kind="stable")]
                # Cut between words, once a row holds ROW entries.
                words = np.flatnonzero(np.diff(w[own], prepend=-1))
                cuts = words[np.flatnonzero(np.diff(words // ROW, prepend=-1))].tolist()
                for x, y in zip(cuts, [*cuts[1:], len(own)], strict=False):
                    k = own[x:y]
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([z[k].tobytes()], pa.binary()) for z in (w, side, o, n))], names=["part", "w", "side", "o", "n"])

    counted = docs.select("text").mapInArrow(count, "bucket int, k binary, n binary")
    with few_rows(docs.sparkSession, MAKING):
        pairs = materialise(_by_bucket(counted).mapInArrow(merge, _BLOBS), "bigrams")
        words = _by_bucket(pairs.where(F.col("bucket") < buckets)).mapInArrow(gather, "part int, w binary, side binary, o binary, n binary")
        return pairs, materialise(words, "contexts", by="part")


def _with_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The side of a row as an array beside its others."""
    for b in batches:
        sides = [bytes([s]) * (len(w) // 4) for s, w in zip(b.column(1).to_pylist(), (x.as_buffer() for x in b.column(2)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sides, pa.binary()), b.column(3), b.column(4)], names=["bucket", "w", "side", "o", "n"])


def _arrays(b: pa.RecordBatch, i: int, types: tuple[type, ...], first: int = 0) -> list[np.ndarray]:
    return [np.frombuffer(b.column(first + j)[i].as_buffer(), t) for j, t in enumerate(types)]


def _added(rows: DataFrame, total: int) -> np.ndarray:
    """The matrix of summed (k, n): as many rows as there are pairs of classes."""
    t = rows.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(total * total)
    out[t.column(0).to_numpy()] = t.column(1).to_numpy()
    return out.reshape(total, total)


def _entries(out: np.ndarray) -> pa.RecordBatch:
    i = np.flatnonzero(out)
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(out[i].astype(np.int64))], names=["k", "n"])


def class_matrix(pairs: DataFrame, class_of: np.ndarray, total: int) -> np.ndarray:
    """Counts of class pairs; summed per task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(total * total)
        for b in batches:
            for i in range(b.num_rows):
                a, o, n = _arrays(b, i, (np.int32, np.int32, np.int64))
                out += np.bincount(class_of[a] * total + class_of[o], n, total * total)
        yield _entries(out)

    return _added(pairs.where("side = 0").select("w", "o", "n").mapInArrow(run, "k long, n long"), total)


def matrix_change(table: DataFrame, before: np.ndarray, after: np.ndarray, total: int) -> np.ndarray:
    """What changes in the class matrix as words of ``table`` (contexts of all words that move) go from one class to another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, moved = np.zeros(total * total), before != after
        for b in batches:
            for i in range(b.num_rows):
                w, side, o, n = _arrays(b, i, (np.int32, np.uint8, np.int32, np.int64))
                # A pair both of whose words move is counted once, with its first word.
                own = np.flatnonzero(moved[w] & ((side == 0) | ~moved[o]))
                w, o, n, late = w[own], o[own], n[own], side[own] == 1
                a, c = np.where(late, o, w), np.where(late, w, o)
                out += np.bincount(after[a] * total + after[c], n, total * total) - np.bincount(before[a] * total + before[c], n, total * total)
        yield _entries(out)

    return _added(table.select("w", "side", "o", "n").mapInArrow(run, "k long, n long"), total)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(matrix: np.ndarray) -> float:
    """The part of the training likelihood that depends on the classes."""
    return float(_f(matrix).sum() - _f(matrix.sum(1)).sum() - _f(matrix.sum(0)).sum())


class Known:
    """The class matrix as moves read it: columns and rows of the classes, x log x of each, diagonal, row and column sums."""

    def __init__(self, matrix: np.ndarray, classes: int):
        self.classes, self.total = classes, len(matrix)
        self.sides = [(m, _f(m)) for m in (np.ascontiguousarray(matrix[:classes].T), np.ascontiguousarray(matrix[:, :classes]))]
        self.diagonal, self.rows, self.cols = matrix.diagonal()[:classes].copy(), matrix.sum(1)[:classes], matrix.sum(0)[:classes]


def best_classes(own: np.ndarray, right: np.ndarray, left: np.ndarray, twice: np.ndarray, known: Known) -> np.ndarray:
    """For each word the class to which moving it alone raises the likelihood most; ties stay, then the lowest.

    One row per word: ``right`` and ``left`` are the counts of classes after and before it, ``twice`` how often it follows itself.
    Only classes beside which a word stands are looked at.
    """
    classes, words = known.classes, np.arange(len(own))
    gain = np.zeros((len(own), classes))
    for (m, fm), side, back in zip(known.sides, (right, left), (left, right), strict=True):
        w, near = np.nonzero(side)
        if not len(w):
            continue
        n, c, i = side[w, near], own[w], np.arange(len(w))
        part, f = m[near], fm[near]
        # The counts without the word in its class.
        part[i, c] -= n
        same = np.flatnonzero(near == c)
        part[same] -= back[w[same], :classes]
        part[same, c[same]] -= twice[w[same]]
        np.maximum(part, 0, out=part)
        f[i, c] = _f(part[i, c])
        f[same] = _f(part[same])
        part += n[:, None]
        first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        gain[w[first]] += np.add.reduceat(_f(part) - f, first)
    twice = twice[:, None]
    r, x = right[:, :classes], left[:, :classes]
    corner, row, col = (np.repeat(z[None], len(own), 0) for z in (known.diagonal, known.rows, known.cols))
    corner[words, own] -= r[words, own] + x[words, own] + twice[:, 0]
    np.maximum(corner, 0, out=corner)
    gain -= _f(corner + r) + _f(corner + x) - _f(corner) - _f(corner + r + x + twice)
    all_r, all_x = (z.sum(1, keepdims=True) + twice for z in (right, left))
    # What stands before the word counts in the rows of its classes wherever the word is.
    row[words, own] -= all_r[:, 0]
    col[words, own] -= all_x[:, 0]
    gain -= _f(row + all_r) - _f(row) + _f(col + all_x) - _f(col)
    best = np.argmax(gain, 1)
    return np.where(gain[words, own] >= gain[words, best] - 1e-9, own, best)


#: Words whose moves are weighed at once.
AT_ONCE = 128


def moves_of(w: np.ndarray, side: np.ndarray, o: np.ndarray, n: np.ndarray, cls: np.ndarray, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """(words, new classes) of those words that move, from their contexts in order of word."""
    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    total, moved, to = known.total, [], []
    for at in range(0, len(first), AT_ONCE):
        starts = first[at : at + AT_ONCE]
        a, b = starts[0], first[at + AT_ONCE] if at + AT_ONCE < len(first) else len(w)
        words, c = w[starts], slice(a, b)
        row = np.repeat(np.arange(len(starts)), np.diff(starts, append=b))
        self_pair = w[c] == o[c]
        late, key = side[c] == 1, row * total + cls[o[c]]
        twice = np.bincount(row, np.where(self_pair & ~late, n[c], 0), len(starts))
        right, left = (np.bincount(key, np.where(x & ~self_pair, n[c], 0), len(starts) * total).reshape(-1, total) for x in (~late, late))
        new = best_classes(cls[words], right, left, twice, known)
        go = np.flatnonzero(new != cls[words])
        moved.append(words[go])
        to.append(new[go])
    return np.concatenate(moved), np.concatenate(to)


def exchange(pairs: DataFrame, table: DataFrame, lex: Lexicon, classes: int, rounds: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all symbols and the class matrix.

    Each round lets one part of the words, by turns, move to their best class given all others; the assignment of
    highest likelihood is kept.  Without a number of rounds they go on until all parts bring less than TOLERANCE of the gain so far.  Words start dealt over the classes in order of count.
    """
    total = classes + BANDS + 2
    class_of = np.concatenate((lex.rank % classes, classes + np.arange(BANDS + 2))).astype(np.int64)
    matrix = class_matrix(pairs, class_of, total)
    best = likelihood(matrix), class_of, matrix
    turn, won = 0, [best[0]]
    while lex.m > 1 and classes > 1 and (rounds is None or turn < rounds):
        if rounds is None and turn and turn % PARTS == 0 and won[-1] - won[-1 - PARTS] <= TOLERANCE * (won[-1] - won[0]):
            break
        cls, known = class_of, Known(matrix, classes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    words, to = moves_of(*_arrays(b, i, (np.int32, np.uint8, np.int32, np.int64)), cls, known)  # noqa: B023
                    yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(to.astype(np.int64))], names=["w", "c"])

        turns = table.where(F.col("part") == turn % PARTS).select("w", "side", "o", "n")
        moves = turns.mapInArrow(run, "w long, c long").toArrow()  # at most one row per clustered word
        class_of = cls.copy()
        class_of[moves.column(0).to_numpy()] = moves.column(1).to_numpy()
        matrix = matrix + matrix_change(turns, cls, class_of, total)
        now = likelihood(matrix)
        turn += 1
        best = max(best, (now, class_of, matrix), key=lambda x: x[0])
        won.append(best[0])
    return best[1], best[2]


def fit(spark: SparkSession, docs: DataFrame, *, classes: int | None = None, clustered: int | None = None, lexicon_size: int | None = None, rounds: int | None = None) -> tuple[Model, DataFrame]:
    """Model and the table (h, n) of training words outside the lexicon, from rows (text)."""
    counts = materialise(count_words(docs), "counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("h") == END_HASH, F.col("n"))), F.lit(0)).alias("e"), F.count_if((F.col("n") == 1) & (F.col("h") != END_HASH)).alias("once")).first()
    lex, low = lexicon(counts, lexicon_size, clustered)
    classes = classes or int(CLASSES * max(1.0, lex.m / 2**16) ** 0.25)
    shared = spark.sparkContext.broadcast(lex)
    pairs, table = bigrams(docs, shared, totals["n"])
    with few_rows(spark, MOVING):
        class_of, matrix = exchange(pairs, table, lex, classes, rounds)
    discard(pairs, table)
    outside_n = totals["n"] - totals["e"] - int(lex.counts.sum())
    # Good and Turing: what was seen once tells how much is still unseen.
    unseen = max(float(totals["once"]), DELTA)
    per_class = matrix.sum(0)
    p = (per_class + DELTA) / (per_class.sum() + DELTA * len(per_class))
    step = (matrix + KAPPA * p) / (matrix.sum(1, keepdims=True) + KAPPA)
    word_class = class_of[lex.symbol]
    total = np.bincount(word_class, lex.counts, len(per_class))
    emit = np.log10(lex.counts) - np.log10(total[word_class]) if len(lex.counts) else np.empty(0)
    model = Model(lex, emit, class_of, np.log10(step), unseen, outside_n + unseen, totals["n"], totals["v"], totals["e"])
    return model, counts.where((F.col("h") != END_HASH) & (_step_of(F.col("n")) < low))


def score(spark: SparkSession, df: DataFrame, model: Model, outside: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for rows (doc_id, text).

    Words of the lexicon are scored where the text is; the counts of the other, rare words are joined by their hash.
    """
    shared = spark.sparkContext.broadcast(model)
    names = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "outside_h", "outside_m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = shared.value
        lex = m.lexicon
        row, places = TaskContext.get().partitionId() << 33, Places(lex.hashes)
        classes = np.append(m.class_of[lex.symbol], m.class_of[lex.m + BANDS])
        end = int(m.class_of[lex.m + BANDS + 1])
        base = np.append(np.log10(lex.counts + DELTA), 0.0)
        emit = np.append(m.log_emit, 0.0)
        of_end = np.log10(m.n_end + DELTA)
        bottom = np.log10(m.n + DELTA * (m.v + 1))
        rare_bottom = np.log10(m.outside_total)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                k = part.num_rows
                h, lengths = words_in(part.column(1))
                doc, i = np.repeat(np.arange(k), lengths), places.find(h)
                c = with_ends(classes[i], lengths, end)
                ends = np.cumsum(lengths + 1)
                steps = np.add.reduceat(m.log_step[c[:-1], c[1:]], ends - lengths - 1)
                far = np.flatnonzero(i < 0)
                n_far = np.bincount(doc[far], minlength=k)
                of_base, of_emit = (np.bincount(doc, x[i], k) for x in (base, emit))
                # Words outside the lexicon: by text, each distinct one with its number.
                order = far[np.lexsort((h[far], doc[far]))]
                first = np.flatnonzero(np.concatenate(([True], (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])))) if len(order) else order
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[order[first]], minlength=k)))), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (h[order[first]], np.diff(first, append=len(order)))]
                values = (np.arange(row, row + k), part.column(0), lengths + 1, lengths - n_far + (m.n_end > 0), of_base + of_end - (lengths + 1) * bottom, steps + of_emit - n_far * rare_bottom)
                row += k
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in values] + lists, names=names)

    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, outside_h array<long>, outside_m array<long>"
    rows = materialise(df.select("doc_id", "text").mapInArrow(run, schema), "scored")
    far = rows.select("row", F.explode(F.arrays_zip("outside_h", "outside_m")).alias("x")).select("row", F.col("x.outside_h").alias("h"), F.col("x.outside_m").alias("m"))
    c = F.coalesce(F.col("n"), F.lit(0))
    base_term = F.sum(F.col("m") * F.log10(c + F.lit(DELTA)))
    term = F.sum(F.col("m") * F.log10(F.when(c > 0, c.cast("double")).otherwise(F.lit(model.outside_unseen))))
    sums = far.join(outside, "h", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("known"), base_term.alias("base_term"), term.alias("term"))
    return rows.join(sums, "row", "left").select(
        "doc_id",
        (~training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_term", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("term", F.lit(0.0))).alias("score"),
    )


def fit_and_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """Learn from the training rows of ``df`` and score all of its rows.

    Null and empty texts are one end.  Rows with a null id are held out.  Repeated rows count and are scored each.
    Very long texts are scored whole.  Without any training row all words are unknown.  An empty table
    gives no rows.  Other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model, outside = fit(spark, docs.where(training(F.col("doc_id"))), **settings)
    return score(spark, docs, model, outside)
