"""Embedding near-duplicates by NN-descent with an audited recall.

Equal vectors are one node.  The neighbour graph starts from a few blocks of nodes that stand together in orders by
random hyperplanes; that is a weak start, and the rounds carry the search: the neighbours of each node, and those whose
neighbour it is, are joined with one another, and what is nearer than a node's list goes into it.  A round joins only
neighbourhoods in which something is new.  Lists full of links are enlarged, and each node also keeps its best
neighbours outside its component, so a family of any size does not fill them up.  Rounds go on until one joins no
components and brings hardly any new neighbours, and new starts until a whole search from a fresh one joins none.  Brute force over a bounded sample of nodes,
half of them with links, measures the recall; where it stays too low the operator fails.  Links of every vector
are then counted exactly: parts of a component at such angles from one of its vectors that all or none of their pairs link are counted
as a whole, and only what is left is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialise, with_rank

#: Neighbours in a list, and times it may grow while all of it are links.
K, GROWTH = 8, 3
#: Orders by random hyperplanes at each start, and nodes that meet in one block.
ORDERS, BLOCK = 4, 128
#: A list holds neighbours within so many times the threshold's angle; what is farther leads to no links.
REACH = 3
#: A search is settled when a round joins no components and this share at most of all neighbours is new.
SETTLED = 0.01
#: The audit: so many nodes at most, compared with all; the search goes on below this recall, and fails
#: after so many searches in a row that found nothing new.
AUDIT, RECALL, QUIET = 1000, 0.99, 8
#: Nodes of a component in one chunk of the exact count.
CHUNK = 512


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, node, vec): node is the content id of the vector and vec its unit vector as doubles; null where it is null, empty, zero
    or holds null or non-finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, vecs = [], []
            for x in b.column(1).to_pylist():
                if not x or any(c is None for c in x):
                    nodes.append(None), vecs.append(None)
                    continue
                v = np.array(x, np.float64) + 0.0
                with np.errstate(all="ignore"):
                    big = np.abs(v).max()
                    u = v / big
                    u = u / np.sqrt((u * u).sum())
                if not (np.isfinite(v).all() and big > 0):
                    nodes.append(None), vecs.append(None)
                    continue
                nodes.append(xxhash.xxh3_64_intdigest(v.tobytes()) - (1 << 63))
                vecs.append(u.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(vecs, pa.binary())], names=["vec_id", "node", "vec"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, node long, vec binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows with the same first column."""
    key, held = None, []
    for b in batches:
        for k, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append(rest)
    if held:
        yield key, held


def _by_length(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes, matrix) of distinct nodes for each dimension among rows (node, vec)."""
    by: dict[int, dict[int, bytes]] = {}
    for node, vec, *_ in rows:
        by.setdefault(len(vec), {})[node] = vec
    for d in by.values():
        yield np.fromiter(d, np.int64, len(d)), np.frombuffer(b"".join(d.values()), np.float64).reshape(len(d), -1)


def start_blocks(nodes: DataFrame, seed: int) -> DataFrame:
    """(block, node, vec, label, floor, far): each node in ORDERS blocks of nodes that are neighbours in an order by signs against random hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = (np.uint64(1) << np.arange(48, dtype=np.uint64)[::-1]).astype(np.uint64)
        for b in batches:
            ks, ns, ts = [], [], []
            for n, m in _by_length(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))):
                d = m.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, ORDERS * 48))
                bits = (m @ planes[d] > 0).reshape(len(n), ORDERS, 48)
                ks.append((bits * powers).sum(2, dtype=np.uint64).astype(np.int64).ravel())
                ns.append(np.repeat(n, ORDERS))
                ts.append(np.tile(np.arange(ORDERS) + ORDERS * d, len(n)))
            if ks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ts)), pa.array(np.concatenate(ks)), pa.array(np.concatenate(ns))], names=["t", "k", "node"])

    keys = nodes.select("node", "vec").mapInArrow(run, "t long, k long, node long")
    # Blocks overlap by half, so that neighbours across a border meet too.
    ranked = with_rank(keys, "t", "k", "node")
    half = F.floor(F.col("rank") / (BLOCK // 2))
    blocks = ranked.select("node", F.explode(F.array(half, half + 1)).alias("block"))
    return blocks.join(nodes, "node").select("block", *COLUMNS)


#: What a node brings to a neighbourhood: its label, and the similarities that a neighbour, or one with another label, must exceed.
COLUMNS = ("node", "vec", "label", "floor", "far")


def local_join(groups: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim, away, link): within each group what is nearer to a node than its list, links, and (away) what is nearer than
    its list among those with another label; with link, a forest over the pairs that reach the threshold and differ in label."""
    near = math.cos(min(math.pi, REACH * math.acos(min(1.0, threshold))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([h[i] for h in held])) for i in range(5)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "sim", "away", "link"])

        count = 0
        for _, rows in _groups(batches):
            of = {r[0]: r[2:] for r in rows}
            for n, m in _by_length(rows):
                if len(n) < 2:
                    continue
                own = [of[x] for x in n.tolist()]
                labels = np.array([x[0] for x in own], np.int64)
                floor, far = (np.array([x[i] for x in own]) for i in (1, 2))
                differ = labels[:, None] != labels
                s = m @ m.T
                np.fill_diagonal(s, -2.0)
                # A node's best K here, more where they are links, and its best K with another label.
                wanted = ((s > floor[:, None]) | (differ & (s > far[:, None]))) & (s >= near)
                if wanted.any():
                    use = wanted & ((s >= _kth(s, K)) | ((s >= threshold) & (s >= _kth(s, K * GROWTH))) | (differ & (s >= _kth(np.where(differ, s, -2.0), K))))
                    i, j = np.nonzero(use)
                    held.append((n[i], n[j], s[i, j], differ[i, j], np.zeros(len(i), bool)))
                    count += len(i)
                x, y = forest((s >= threshold) & differ)
                held.append((n[x], n[y], s[x, y], np.ones(len(x), bool), np.ones(len(x), bool)))
                count += len(x)
                if count > 200_000:
                    yield out()
                    count = 0
        if held:
            yield out()

    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = groups.columns[0]
    return groups.repartition(n, key).sortWithinPartitions(key).mapInArrow(run, "a long, b long, sim double, away boolean, link boolean")


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row (the least of all where there are fewer), as a column."""
    k = min(k, s.shape[1])
    return -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the symmetric matrix connects."""
    seen, x, y = np.zeros(len(linked), bool), [], []
    for root in range(len(linked)):
        if seen[root] or not linked[root].any():
            continue
        seen[root] = True
        queue = [root]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(linked[i] & ~seen)
            seen[new] = True
            x += [i] * len(new)
            y += new.tolist()
            queue += new.tolist()
    return np.array(x, np.int64), np.array(y, np.int64)


def best_lists(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim, away): each node's best K, up to GROWTH times as many where all of them are links, and its best K away.

    The choice is made within each task first, so of a node that is near to very many only a few rows a task move.
    """

    def chosen(a: np.ndarray, o: np.ndarray, s: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((o, -s, a))
        a, o, s, w = a[order], o[order], s[order], w[order].astype(bool)
        again = np.concatenate(([False], (a[1:] == a[:-1]) & (o[1:] == o[:-1])))
        a, o, s, w = a[~again], o[~again], s[~again], w[~again]
        first = np.searchsorted(a, a)
        place = np.arange(len(a)) - first
        before = np.concatenate(([0], np.cumsum(w)))
        use = (place < K) | ((s >= threshold) & (place < K * GROWTH)) | (w & (before[:-1] - before[first] < K))
        return pa.RecordBatch.from_arrays([pa.array(a[use]), pa.array(o[use]), pa.array(s[use]), pa.array(w[use])], names=["a", "b", "sim", "away"])

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count > 500_000:
                yield chosen(*_arrays(held))
                held, count = [], 0
        if count:
            yield chosen(*_arrays(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            yield chosen(*b)

    n, kind = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a long, b long, sim double, away boolean"
    return rows.select("a", "b", "sim", "away").mapInArrow(early, kind).repartition(n, "a").sortWithinPartitions("a").mapInArrow(run, kind)


def _arrays(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
    return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in range(4)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of whole runs of the first column, a batch or so at a time."""
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64), np.empty(0, bool)]
    for b in batches:
        held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, b.columns, strict=True)]
        cut = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
        if cut:
            yield tuple(h[:cut] for h in held)
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield tuple(held)


def with_floors(nodes: DataFrame, lists: DataFrame | None) -> DataFrame:
    """(node, vec, label, floor, far): the K-th similarities of a node's list, or -2 where it has room."""
    if lists is None:
        return nodes.select("node", "vec", "label", F.lit(-2.0).alias("floor"), F.lit(-2.0).alias("far"))
    # A list has a bounded number of entries.
    kth = lambda c: F.coalesce(F.get(F.sort_array(F.collect_list(c), asc=False), F.lit(K - 1)), F.lit(-2.0))
    floors = lists.groupBy(F.col("a").alias("node")).agg(kth("sim").alias("floor"), kth(F.when(F.col("away"), F.col("sim"))).alias("far"), F.min("sim").alias("least"), F.count("*").alias("n"))
    # Where all of a list are links it may grow, so further links are wanted.
    return nodes.join(floors, "node", "left").select("node", "vec", "label", F.coalesce(F.when(F.col("n") >= K, F.col("floor")), F.lit(-2.0)).alias("floor"), F.coalesce("far", F.lit(-2.0)).alias("far"))


def neighbourhoods(lists: DataFrame, nodes: DataFrame, pivots: DataFrame, threshold: float) -> DataFrame:
    """(pivot, node, vec, label, floor, far): each pivot with its neighbours and with the best of those whose neighbour it is."""
    back = best_lists(lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "away").join(pivots, F.col("a") == F.col("pivot"), "left_semi"), threshold)
    mine = lists.join(pivots, F.col("a") == F.col("pivot"), "left_semi").select(F.col("a").alias("pivot"), F.col("b").alias("node"))
    members = mine.union(back.select("a", "b")).union(pivots.select("pivot", F.col("pivot").alias("node"))).distinct()
    return members.join(with_floors(nodes, lists), "node").select("pivot", *COLUMNS)


def shared_labels(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")


def audit_weights(nodes: DataFrame) -> dict[bool, float]:
    """How many nodes a sampled node of ``audit_links`` stands for, by whether it shares its label."""
    r = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("shared")).first()
    shared, alone = r["shared"] or 0, (r["all"] or 0) - (r["shared"] or 0)
    n_shared = min(AUDIT // 2, shared)
    return {True: shared / max(1, n_shared), False: alone / max(1, min(AUDIT - n_shared, alone))}


def audit_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all links of a sample of nodes, by brute force; the sample is bounded by AUDIT, so it can be sent to all workers.

    Up to half of it are nodes that share their label with others, so that rare links are measured too; the rest are drawn from the nodes that
    the search left alone, where lost links show.  Each part stands for all nodes of its kind (``audit_weights``).
    """
    linked = shared_labels(nodes)
    queries: dict[int, bytes] = {}
    for how, most in (("left_semi", AUDIT // 2), ("left_anti", AUDIT)):
        for r in nodes.join(linked, "label", how).select("node", "vec").orderBy(F.xxhash64("node", F.lit(7)), "node").limit(most - len(queries)).collect():
            queries[r["node"]] = bytes(r["vec"])
    shared = nodes.sparkSession.sparkContext.broadcast(list(queries.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {m.shape[1]: (n, m) for n, m in _by_length(shared.value)}
        for b in batches:
            for n, m in _by_length(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))):
                if m.shape[1] in asked:
                    q, qm = asked[m.shape[1]]
                    i, j = np.nonzero(qm @ m.T >= threshold)
                    other = q[i] != n[j]
                    yield pa.RecordBatch.from_arrays([pa.array(q[i][other]), pa.array(n[j][other])], names=["a", "b"])

    return nodes.select("node", "vec").mapInArrow(run, "a long, b long")


def count_links(member: DataFrame, threshold: float) -> DataFrame:
    """(node, links): vectors of other nodes linked with each node, exactly, for rows (comp, node, weight, vec).

    The nodes of a component stand in order of their angle from one of its vectors and are cut in chunks.  By the
    triangle inequality two chunks link in all pairs where their largest angles add up to less than the threshold's, and in none
    where they lie farther apart than that; these are settled by the chunks' sums.  Other chunks are compared; only sums leave a task.
    """
    whole, slack = math.acos(min(1.0, threshold)), 1e-6
    centre = member.groupBy(F.col("comp").alias("c")).agg(F.min_by("vec", "node").alias("centre"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, c = ([np.frombuffer(x, np.float64) for x in b.column(i).to_pylist()] for i in (3, 4))
            angle = [math.acos(max(-1.0, min(1.0, float(x @ y)))) if len(x) == len(y) else 4.0 for x, y in zip(v, c, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(angle, pa.float64())], names=["comp", "node", "weight", "angle"])

    at = member.join(centre, F.col("comp") == F.col("c")).select("comp", "node", "weight", "vec", "centre").mapInArrow(angles, "comp long, node long, weight long, angle double")
    ranked = with_rank(at, "comp", "angle", "node", "weight")
    starts = ranked.groupBy(F.col("comp").alias("c")).agg(F.min("rank").alias("start"))
    placed = materialise(ranked.join(starts, F.col("comp") == F.col("c")).select("comp", "node", "weight", "angle", F.floor((F.col("rank") - F.col("start")) / CHUNK).cast("long").alias("chunk")), "placed")
    chunks = placed.groupBy("comp", "chunk").agg(F.sum("weight").alias("sum"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    chunks = materialise(chunks, "chunks")  # one row for each chunk
    two = chunks.alias("p").join(chunks.alias("q"), (F.col("p.comp") == F.col("q.comp")) & (F.col("q.lo") - F.col("p.hi") <= whole + slack) & (F.col("p.lo") - F.col("q.hi") <= whole + slack))
    sure = F.col("p.hi") + F.col("q.hi") < whole - slack
    two = two.select(F.col("p.comp").alias("comp"), F.col("p.chunk").alias("chunk"), F.col("q.chunk").alias("other"), F.when(sure, F.col("q.sum")).alias("sum"))
    settled = two.groupBy("comp", "chunk").agg(F.coalesce(F.sum("sum"), F.lit(0)).alias("all"), F.max(F.when(F.col("chunk") == F.col("other"), F.col("sum").isNotNull())).alias("self"))
    links = placed.join(settled, ["comp", "chunk"]).select("node", (F.col("all") - F.when(F.col("self"), F.col("weight")).otherwise(0)).alias("links"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            nodes, sums = [], []
            sides = 2 if any(r[1] for r in rows) else 1
            for length in {len(r[3]) for r in rows}:
                part = [[r for r in rows if len(r[3]) == length and r[1] == side] for side in (0, 1)]
                n = [np.array([r[0] for r in p], np.int64) for p in part]
                w = [np.array([r[2] for r in p], np.int64) for p in part]
                m = [np.frombuffer(b"".join(r[3] for r in p), np.float64).reshape(len(p), -1) if p else None for p in part]
                x, y = 0, sides - 1
                if not len(n[x]) or not len(n[y]):
                    continue
                linked = m[x] @ m[y].T >= threshold
                if x == y:
                    np.fill_diagonal(linked, False)
                nodes.append(n[x]), sums.append(linked @ w[y])
                if x != y:
                    nodes.append(n[y]), sums.append(linked.T @ w[x])
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sums).astype(np.int64))], names=["node", "links"])

    open_ = two.where("sum is null")
    lo, hi = F.least("chunk", "other"), F.greatest("chunk", "other")
    tasks = member.join(placed.select("node", "chunk"), "node").join(open_.select("comp", "chunk", "other"), ["comp", "chunk"])
    tasks = tasks.select(F.xxhash64("comp", lo, hi).alias("task"), "node", F.when(F.col("chunk") == lo, 0).otherwise(1).alias("side"), "weight", "vec")
    n = int(member.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = tasks.repartition(n, "task").sortWithinPartitions("task").mapInArrow(run, "node long, links long")
    return links.unionByName(compared).groupBy("node").agg(F.sum("links").alias("links"))


def find_links(nodes: DataFrame, threshold: float, *, max_rounds: int | None = None, max_searches: int | None = None, told: dict | None = None) -> tuple[DataFrame, float]:
    """(a, b) links that connect all found, and the estimated share of nodes with links whose links all lie in their component (1.0 where the sample
    has none with links; ``told["sampled"]`` says how many it has).

    The sample has nodes that the search linked and nodes that it left alone, each weighed by how many it stands for, so that the estimate does not
    lean towards nodes that were found.

    Raises where that share stays below RECALL though new searches find nothing more.  With a number of rounds or searches
    the search ends there, whatever its recall.
    """
    plain = nodes.select("node", "vec")
    labelled = plain.withColumn("label", F.col("node"))
    found = plain.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    parts, labels, lists, truth, weights = [found], None, None, None, {}
    attempt, quiet = 0, 0
    while True:
        merged = False

        def join(groups: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
            """Rows of the local join; where some join two components, the labels follow, and the nodes that have another label now."""
            nonlocal labelled, labels, merged
            rows = materialise(local_join(groups, threshold), name)
            new = rows.where("link").select("a", "b")
            if new.isEmpty():
                return rows, None
            merged = True
            parts.append(materialise(new, "links"))
            stars = [] if labels is None else [labels.select(F.col("node").alias("a"), F.col("label").alias("b"))]
            before, labels = labels, materialise(components(_union([*stars, parts[-1]])), "labels")
            labelled = plain.join(labels, "node", "left").select("node", "vec", F.coalesce("label", "node").alias("label"))
            moved = labels.select(F.col("node").alias("pivot"), F.col("label").alias("_l"))
            if before is not None:
                moved = moved.join(before.select(F.col("node").alias("pivot"), F.col("label").alias("_l")), ["pivot", "_l"], "left_anti")
            return rows, moved.select("pivot")

        def merge(rows: DataFrame, moved: DataFrame | None) -> tuple[DataFrame, DataFrame, int, int]:
            """Lists with what the local join found, neighbourhoods that have something new, and numbers of new neighbours and of all."""
            seen = rows.where("not link").select("a", "b", "sim", "away")
            if lists is not None:
                seen = seen.unionByName(lists)
            if moved is not None:
                # Who is away is settled anew under the labels of now.
                of = labels.select("node", "label")
                seen = seen.join(of.select(F.col("node").alias("a"), F.col("label").alias("_la")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("label").alias("_lb")), "b", "left")
                seen = seen.select("a", "b", "sim", (F.coalesce("_la", "a") != F.coalesce("_lb", "b")).alias("away"))
            better = materialise(best_lists(seen, threshold), "lists")
            fresh = better if lists is None else better.join(lists, ["a", "b"], "left_anti")
            fresh = materialise(fresh.select("a", "b"), "fresh")
            pivots = fresh.select(F.col("a").alias("pivot")).union(fresh.select("b"))
            pivots = materialise((pivots if moved is None else pivots.union(moved)).distinct(), "pivots")
            counts = fresh.count(), better.count()
            discard(rows, fresh, *([] if lists is None else [lists]))
            return better, pivots, *counts

        lists, pivots, *_ = merge(*join(start_blocks(with_floors(labelled, lists), attempt), "start"))
        rounds, changed = 0, not pivots.isEmpty()
        while changed and (max_rounds is None or rounds < max_rounds):
            rows, moved = join(neighbourhoods(lists, labelled, pivots, threshold), "round")
            discard(pivots)
            lists, pivots, n_new, n_all = merge(rows, moved)
            rounds, changed = rounds + 1, moved is not None or n_new > SETTLED * n_all
        attempt += 1
        if merged and attempt > 1:
            quiet = 0
        elif attempt > 1:
            quiet += 1
        last = max_searches is not None and attempt >= max_searches
        if not quiet and not last:
            continue
        if truth is None:
            weights = audit_weights(labelled)
            kinds = labelled.join(shared_labels(labelled).withColumn("shared", F.lit(True)), "label", "left").select(F.col("node").alias("a"), F.coalesce("shared", F.lit(False)).alias("shared"))
            truth = materialise(audit_links(labelled, threshold).join(kinds, "a"), "audit")
        if labels is None:
            seen = truth.select("a", "shared", F.lit(False).alias("same"))
        else:
            of = labelled.select("node", "label")
            seen = truth.join(of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(of.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").select("a", "shared", (F.col("la") == F.col("lb")).alias("same"))
        each = seen.groupBy("a", "shared").agg(F.min("same").alias("whole")).withColumn("w", F.when(F.col("shared"), weights[True]).otherwise(weights[False]))
        r = each.agg(F.count("*").alias("n"), F.count_if("whole").alias("k"), F.sum("w").alias("w"), F.sum(F.when(F.col("whole"), F.col("w")).otherwise(0.0)).alias("found")).first()
        recall = r["found"] / r["w"] if r["n"] else 1.0
        if told is not None:
            told["sampled"] = r["n"]
        if recall >= RECALL or last:
            discard(lists, pivots)
            return _union(parts), recall
        if quiet >= QUIET:
            raise RuntimeError(f"the search found all links of {r['k']} of {r['n']} sampled nodes, or {recall:.3f} of all, below {RECALL}, and {quiet} more searches found none")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("a", "b")
    for p in parts[1:]:
        out = out.union(p.select("a", "b"))
    return out


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, threshold: float = 0.95, recall_col: str | None = None) -> DataFrame:
    """One row per input row: (vec_id, n_links, component_id, kept), and where ``recall_col`` names a column the audited recall, with the number of sampled
    vectors with links that it rests on in ``<recall_col>_of``.

    Two vectors link when their cosine, in double precision, is at least ``threshold``.  n_links counts the other rows
    linked; component_id is the smallest vec_id reachable over links; kept says that it is the row's own.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, are their own
    component and are kept.  Vectors of different lengths do not link.  Rows with a null id count as vectors; a
    component of such rows alone has no id and none of it is kept.  Rows that repeat an id are rows of their own.
    An empty table gives no rows.  Other columns are not read, whatever their names.
    """
    rows = materialise(vectors(df, id_col, vec_col), "vectors")
    valid = rows.where("node is not null")
    told = {"sampled": 0}
    audited = lambda x: [] if recall_col is None else [F.lit(float(x)).alias(recall_col), F.lit(told["sampled"]).cast("long").alias(f"{recall_col}_of")]
    if valid.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), *audited(1.0))
    nodes = materialise(valid.groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"), F.first("vec").alias("vec")), "nodes")
    links, recall = find_links(nodes, threshold, told=told)
    comp = components(links).withColumnRenamed("label", "comp")
    member = comp.join(nodes, "node").select("comp", "node", "weight", "vec")
    counts = materialise(count_links(member, threshold), "counts")
    per_node = nodes.select("node", "weight", "first").join(comp, "node", "left").join(counts, "node", "left")
    per_node = per_node.select("node", F.coalesce("comp", "node").alias("comp"), "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    least = per_node.groupBy("comp").agg(F.min("first").alias("least"))
    per_node = per_node.join(least, "comp").select("node", "n_links", "least")
    out = rows.select("vec_id", "node").join(per_node, "node", "left")
    c = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    kept = F.coalesce(F.when(F.col("node").isNull(), F.lit(True)).otherwise(F.col("vec_id") == c), F.lit(False))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), kept.alias("kept"), *audited(recall))
