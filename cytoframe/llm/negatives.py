"""Hard-negative mining by one-dimensional distance keys: an exact search of annuli around pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, few_rows, materialise

#: Vectors in a block of the index, queries in a pack, and blocks of one ring that one task meets with its queries.
BLOCK, PACK, TOGETHER = 1024, 128, 8
#: Pivots are centres of at most SAMPLE vectors, at most MOST_PIVOTS of them; the sample's own scores also bound the first search.
SAMPLE, MOST_PIVOTS = 2048, 256
#: The search goes as far as these shares of the distance within which the wanted rows must lie.
STEPS = (0.5, 0.75, 1.0)
#: Scores of rows that nothing bounds.
LOWEST, HIGHEST = -(1 << 62), 1 << 62

_NODE = "label long, vector array<long>, ids array<long>"
_BLOCK = "pivot int, ring int, vectors binary, labels binary, counts binary, ids binary"
_ASKED = "pivot int, ring int, queries binary, labels binary, vectors binary, owners binary, bands binary, floors binary, ceils binary"
_FOUND = "query long, band int, score long, id long"


def _matrix(vectors, dims: int) -> np.ndarray:
    """Rows of whole numbers as doubles; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def usable_rows(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vector of whole numbers) of the rows that take part, repeated rows once."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~odd)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("vector"), "anchor").dropDuplicates(["id", "label", "vector"])


def collapse(rows: DataFrame, keep: int) -> DataFrame:
    """(label, vector, ids): rows that agree in both as one, with their ``keep`` smallest ids in order.

    No answer holds more of them, as they tie in every score and ties go by id.  Spark cuts each group to ``keep``
    before the shuffle as well, so a vector with very many copies does not gather.
    """
    w = Window.partitionBy("label", "vector").orderBy("id")
    first = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)
    return first.groupBy("label", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


class Pivots:
    """Pivots over augmented vectors: one more component makes all vectors equally long, so that a larger product is a smaller distance."""

    def __init__(self, sample: list, count: int, dims: int, longest: float):
        self.dims, self.longest = dims, longest
        self.labels = np.array([r["label"] for r in sample], np.int64)
        self.vectors = _matrix([r["vector"] for r in sample], dims)
        wide = min(MOST_PIVOTS, max(1, math.isqrt(max(1, count // BLOCK))), max(1, len(sample)))
        x = self.augment(self.vectors) if len(sample) else np.zeros((1, dims + 1))
        self.points = x[:wide].copy()
        for _ in range(8):  # a few steps of k-means; any points are right, these cut better
            near = self.distances(x).argmin(1)
            for p in range(wide):
                if (near == p).any():
                    self.points[p] = x[near == p].mean(0)

    def augment(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(self.longest - (v * v).sum(1), 0))])

    def distances(self, x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(1)[:, None] + (self.points**2).sum(1)[None, :] - 2 * x @ self.points.T
        return np.sqrt(np.maximum(d, 0))

    def reach(self, squares: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance from a query of that squared length at which a row has that score."""
        return np.sqrt(np.maximum(squares + self.longest - 2.0 * score, 0))


class Index:
    """Vectors in blocks sorted by (pivot, distance), with the figures that turn an interval of distances into rings.

    A ring is a stretch of distances of one pivot, sized for about one block; rings that hold more have several blocks, dealt
    over ``salts`` tasks.
    """

    def __init__(self, nodes: DataFrame):
        spark = nodes.sparkSession
        squares = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
        figures = nodes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims"), F.max(squares).alias("longest")).first()
        self.count, longest = figures["n"], figures["longest"] or 0.0
        if longest >= 2.0**53:
            raise ValueError("vectors too long for exact products of whole numbers; use a smaller scale")
        # A bounded sample of distinct vectors, the same in every run.
        sample = nodes.select("label", "vector").orderBy(F.xxhash64("vector", "label"), "vector", "label").limit(SAMPLE).collect()
        pivots = self.pivots = Pivots(sample, self.count, max(1, figures["dims"] or 1), longest)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                d = pivots.distances(pivots.augment(_matrix(b["vector"], pivots.dims)))
                near = d.argmin(1)
                yield b.assign(pivot=near.astype(np.int32), dist=d[np.arange(len(b)), near])

        placed = materialise(nodes.mapInPandas(place, f"{_NODE}, pivot int, dist double"), "placed")
        # One row for each pivot, of which there are at most MOST_PIVOTS.
        spans = {r["pivot"]: r for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()}
        self.rings = np.array([-(-spans[p]["n"] // BLOCK) if p in spans else 0 for p in range(len(pivots.points))])
        self.lo = np.array([spans[p]["lo"] if p in spans else 0.0 for p in range(len(pivots.points))])
        hi = np.array([spans[p]["hi"] if p in spans else 0.0 for p in range(len(pivots.points))])
        self.width = np.maximum((hi - self.lo) / np.maximum(self.rings, 1), 1e-9)
        lo, width, rings, dims = self.lo, self.width, self.rings, pivots.dims

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                p, d = b["pivot"].to_numpy(), b["dist"].to_numpy()
                ring = np.minimum((d - lo[p]) / width[p], rings[p] - 1).astype(np.int32)
                cuts = np.flatnonzero((np.diff(p) != 0) | (np.diff(ring) != 0)) + 1
                rows = []
                for piece in np.split(np.arange(len(b)), cuts):
                    for at in range(0, len(piece), BLOCK):
                        own = b.iloc[piece[at : at + BLOCK]]
                        ids = own["ids"].tolist()
                        rows.append((
                            int(own["pivot"].iloc[0]), int(ring[piece[at]]), _matrix(own["vector"], dims).astype(np.int32).tobytes(), own["label"].to_numpy(np.int64).tobytes(),
                            np.array([len(x) for x in ids], np.int64).tobytes(), np.concatenate([np.asarray(x, np.int64) for x in ids]).tobytes(),
                        ))
                yield pd.DataFrame(rows, columns=["pivot", "ring", "vectors", "labels", "counts", "ids"])

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = ("pivot", "dist", "tie")
        ordered = placed.withColumn("tie", F.xxhash64("vector", "label")).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("tie")
        # A block is a row, so that a ring's blocks are dealt by number; the number is fixed by writing.
        blocks = materialise(ordered.mapInPandas(pack, _BLOCK).withColumn("block", F.monotonically_increasing_id()), "blocks")
        self.salts = materialise(blocks.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts")), "rings")
        self.blocks = materialise(blocks.join(self.salts, ["pivot", "ring"]).withColumn("salt", F.pmod(F.xxhash64("block"), "salts").cast("int")).drop("salts", "block"), "index")
        discard(placed, blocks)

    def discard(self) -> None:
        discard(self.blocks, self.salts)


def _scan(same: bool, k: int, dims: int):
    """Each asked pack of queries against one block: the block's k best rows for every band of every query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [np.empty((4, 0), np.int64)]
            for r in batch.itertuples():
                q, ql = np.frombuffer(r.queries, np.int64), np.frombuffer(r.asked_labels, np.int64)
                qv = np.frombuffer(r.asked_vectors, np.int32).reshape(len(q), dims).astype(float)
                owner, band, floor, ceil = (np.frombuffer(x, np.int64) for x in (r.owners, r.bands, r.floors, r.ceils))
                labels, counts, ids = np.frombuffer(r.labels, np.int64), np.frombuffer(r.counts, np.int64), np.frombuffer(r.ids, np.int64)
                bv = np.frombuffer(r.vectors, np.int32).reshape(len(labels), dims).astype(float)
                first = np.cumsum(counts) - counts
                score = (qv @ bv.T)[owner]
                ok = ((ql[:, None] == labels[None, :]) == same)[owner] & (score >= floor[:, None]) & (score <= ceil[:, None])
                top = min(k, len(labels))
                kth = np.partition(np.where(ok, score, -np.inf), len(labels) - top, axis=1)[:, len(labels) - top]
                b, c = np.nonzero(ok & (score >= kth[:, None]))
                order = np.lexsort((ids[first[c]], -score[b, c], b))
                b, c = b[order], c[order]
                # Of rows that tie with the last one those with the smallest ids stay; a vector's ids follow its first.
                place = np.arange(len(b)) - np.searchsorted(b, b)
                b, c = b[place < k], c[place < k]
                each = np.repeat(np.arange(len(c)), counts[c])
                within = np.arange(len(each)) - np.repeat(np.cumsum(counts[c]) - counts[c], counts[c])
                parts.append(np.stack([q[owner[b]][each], band[b][each], score[b, c].astype(np.int64)[each], ids[first[c][each] + within]]))
            out = np.concatenate(parts, axis=1)
            yield pd.DataFrame({"query": out[0], "band": out[1].astype(np.int32), "score": out[2], "id": out[3]})

    return run


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(query, band, score, id, place): for each band of each query the first ``k`` rows by score, then smaller id.

    ``queries`` is a table (query, label, vector, bands), a band being (band, floor, ceil) of scores; ``same`` says whether the rows'
    label must equal the query's or differ from it.  Exact: a query's scans widen until no row outside the
    annuli searched can have as high a score as the last one found.
    """
    pivots, k_ = index.pivots, k
    dims, count = pivots.dims, len(pivots.points)

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k-th best score among the sample's rows: the k-th best of all rows is no lower."""
        for b in batches:
            v = _matrix(b["vector"], dims)
            score = v @ pivots.vectors.T
            right = (b["label"].to_numpy()[:, None] == pivots.labels[None, :]) == same
            bounds = []
            for i, bands in enumerate(b["bands"]):
                own = score[i][right[i]]
                bounds.append([])
                for x in bands:
                    fit = own[(own >= x["floor"]) & (own <= x["ceil"])]
                    bounds[-1].append(int(np.partition(fit, len(fit) - k_)[len(fit) - k_]) if len(fit) >= k_ else int(x["floor"]))
            squares = (v * v).sum(1)
            inner = [pivots.reach(s, float(max((x["ceil"] for x in bands), default=0))) for s, bands in zip(squares, b["bands"])]
            outer = [pivots.reach(s, float(min(x, default=0))) for s, x in zip(squares, bounds)]
            bands = [[{**dict(x), "bound": y} for x, y in zip(xs, ys)] for xs, ys in zip(b["bands"], bounds)]
            yield pd.DataFrame({"query": b["query"], "label": b["label"], "vector": b["vector"], "bands": bands, "squares": squares, "inner": inner, "outer": outer, "to": 0.0, "from": -1.0})

    banded = "array<struct<band:int,floor:long,ceil:long,bound:long>>"
    state = materialise(queries.mapInPandas(bounded, f"query long, label long, vector array<long>, bands {banded}, squares double, inner double, outer double, to double, from double"), "queries")
    found, work = None, [state]
    for step in STEPS:
        if step > STEPS[0] and state.isEmpty():
            break
        state = state.withColumn("to", F.col("inner") + (F.col("outer") - F.col("inner")) * step)
        asked = materialise(state.mapInPandas(_ask(index), _ASKED), "asked")
        dealt = asked.join(index.salts, ["pivot", "ring"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        dealt = dealt.withColumnRenamed("labels", "asked_labels").withColumnRenamed("vectors", "asked_vectors")
        hits = dealt.join(index.blocks, ["pivot", "ring", "salt"]).mapInPandas(_scan(same, k, dims), _FOUND)
        hits = hits if found is None else hits.unionByName(found.drop("place"))
        best = Window.partitionBy("query", "band").orderBy(F.desc("score"), "id")
        with few_rows(queries.sparkSession, TOGETHER):
            found = materialise(hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k), "found")
        work += [asked, found]
        if step == STEPS[-1]:
            break
        # A band's k-th best score so far; what is left to search lies nearer than that.
        last = found.where(F.col("place") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("last"))
        known = lambda x: F.coalesce(F.element_at(F.col("last"), x["band"]), x["bound"])
        bands = F.transform("bands", lambda x: F.struct(x["band"].alias("band"), F.greatest(x["floor"], x["bound"], known(x)).alias("floor"), x["ceil"].alias("ceil"), F.greatest(x["bound"], known(x)).alias("bound")))
        state = state.join(last, "query", "left").withColumn("bands", bands)
        furthest = F.array_min(F.transform("bands", lambda x: x["bound"])).cast("double")
        outer = F.sqrt(F.greatest(F.col("squares") + F.lit(pivots.longest) - 2.0 * furthest, F.lit(0.0)))
        state = state.select("query", "label", "vector", "bands", "squares", "inner", outer.alias("outer"), F.col("to").alias("from"))
        state = materialise(state.where(F.col("from") <= F.col("outer") * (1 + 1e-9) + 1e-3), "queries")
        work.append(state)
    discard(*(w for w in work if w is not found))
    return found


def _ask(index: Index):
    """Which rings each query has to scan: those of its annulus up to ``to`` that it has not scanned up to ``from``."""
    pivots, lo, width, rings = index.pivots, index.lo, index.width, index.rings

    def interval(d: np.ndarray, inner: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last ring of each pivot that can hold rows whose distance from the query lies in [inner, to]."""
        slack = 1e-9 * (d + to[:, None]) + 1e-6
        near, far = np.maximum(d - to[:, None], inner[:, None] - d) - slack, d + to[:, None] + slack
        a = np.clip(np.floor((near - lo) / width), 0, rings)
        b = np.clip(np.floor((far - lo) / width), -1, rings - 1)
        return a.astype(np.int64), b.astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), PACK):
                b = whole.iloc[at : at + PACK]
                v = _matrix(b["vector"], pivots.dims)
                d = pivots.distances(np.column_stack([v, np.zeros(len(v))]))  # a query's own further component is 0
                inner, to, since = (b[c].to_numpy(float) for c in ("inner", "to", "from"))
                a1, b1 = interval(d, inner, to)
                a0, b0 = interval(d, inner, np.maximum(since, 0))
                fresh = since < 0
                a0[fresh], b0[fresh] = 0, -1
                ids, labels, vectors = b["query"].to_numpy(np.int64), b["label"].to_numpy(np.int64), v.astype(np.int32)
                bands = [(i, x["band"], x["floor"], x["ceil"]) for i, xs in enumerate(b["bands"]) for x in xs]
                bands = np.array(bands, np.int64).reshape(-1, 4)
                rows = []
                for p in np.flatnonzero(rings):
                    if (a1[:, p] > b1[:, p]).all():
                        continue
                    for ring in range(int(a1[:, p].min()), int(b1[:, p].max()) + 1):
                        own = (a1[:, p] <= ring) & (ring <= b1[:, p]) & ~((a0[:, p] <= ring) & (ring <= b0[:, p]))
                        if own.any():
                            place = np.cumsum(own) - 1
                            e = bands[own[bands[:, 0]]]
                            rows.append((int(p), ring, ids[own].tobytes(), labels[own].tobytes(), vectors[own].tobytes(), place[e[:, 0]].tobytes(), *(e[:, j].tobytes() for j in (1, 2, 3))))
                yield pd.DataFrame(rows, columns=["pivot", "ring", "queries", "labels", "vectors", "owners", "bands", "floors", "ceils"])

    return run


def hard_negatives(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *,
    scale: int = 256, positives: int = 5, negatives: int = 3, floor_percent: int = 50, ceil_percent: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that ``anchor`` marks and each of its first
    ``positives`` other rows of its label, the first ``negatives`` rows of other labels whose score lies between the two percentages of
    the positive's.  A component x counts as floor(scale * x); scores are exact products of whole numbers; higher ones come first, ties by smaller id.

    Vectors stand sorted by (pivot, distance from it); a query reads the intervals of distances that its annulus allows, wider
    ones until what is left cannot change its answer.  Rows that agree in label and vector are one in the index.

    Rows with a null id, label or vector, or with a null or non-finite component take no part; rows that agree in id, label
    and vector count once, rows that share only the id each; shorter vectors end in zeros; an anchor without positives, or a
    positive without fitting negatives, gives no row; an empty table gives none; other columns are not read, whatever their names.
    """
    rows = materialise(usable_rows(df.withColumn("anchor", F.coalesce(anchor, F.lit(False))), id_col, vector_col, label_col, scale), "vectors")
    nodes = materialise(collapse(rows, max(positives + 1, negatives)), "nodes")
    index = Index(nodes)
    # Anchors with equal label and vector search once.
    marked = rows.where("anchor").select("id", "label", "vector")
    asking = materialise(marked.select("label", "vector").distinct().withColumn("query", F.monotonically_increasing_id()), "asking")
    band = lambda n, lo, hi: F.struct(n.cast("int").alias("band"), lo.cast("long").alias("floor"), hi.cast("long").alias("ceil"))
    everything = F.array(band(F.lit(0), F.lit(LOWEST), F.lit(HIGHEST)))
    found = search(index, asking.select("query", "label", "vector", everything.alias("bands")), positives + 1, True)
    # Equal scores share a band: dense places of a query's at most positives + 1 scores.
    dense = Window.partitionBy("query").orderBy(F.desc("score"))
    alike = found.withColumn("band", F.dense_rank().over(dense).cast("int"))
    low, high = -F.floor(-F.col("score").cast("decimal(28,0)") * floor_percent / 100), F.floor(F.col("score").cast("decimal(28,0)") * ceil_percent / 100)
    scores = alike.select("query", "band", low.cast("long").alias("lo"), high.cast("long").alias("hi")).where("lo <= hi").distinct()
    bands = scores.groupBy("query").agg(F.sort_array(F.collect_list(band(F.col("band"), F.col("lo"), F.col("hi")))).alias("bands"))
    other = search(index, asking.join(bands, "query").select("query", "label", "vector", "bands"), negatives, False)
    lists = alike.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score", "band"))).alias("near"))
    per_band = other.groupBy("query", "band").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("far"))
    # One row for each query, so a vector with very many anchors meets one row only.
    per_query = per_band.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("band", "far"))).alias("far"))
    answers = asking.select("query", "label", "vector").join(lists, "query").join(per_query, "query")
    a = marked.join(answers, ["label", "vector"]).select(F.col("id").alias("anchor_id"), "near", "far")
    own = F.slice(F.filter("near", lambda x: x["id"] != F.col("anchor_id")), 1, positives)
    each = a.select("anchor_id", "far", F.explode(own).alias("p")).select("anchor_id", "p", F.posexplode(F.element_at("far", F.col("p.band"))).alias("at", "n"))
    out = each.select(
        "anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )
    out = materialise(out, "negatives")
    index.discard()
    discard(rows, nodes, asking, found, other)
    return out
