"""Approximate nearest neighbours by learned partitions.

Nearness is the inner product of the vectors as they are. A vector with one more component, which makes all of them as long
as the longest, has the same nearest ones by angle, so vectors are placed by these lifted ones, while the nearest of a
query do not depend on its length and it is routed by its direction.

A bounded sample of the vectors gives a graph of nearest lifted neighbours, which is cut into parts of equal size: each cut
halves a part at the median of its slowest-mixing direction (power iteration on the graph), then swaps vertices across
the cut while that saves edges. One small network learns, from a lifted vector, how its neighbours spread over the parts, and
places every vector of the table into its most probable part. Another learns, from a direction, in which parts the vectors of
largest inner product lie, and routes every query to its most probable parts, in which all vectors are ranked by the exact
measure. How many parts it takes for a recall of ``RECALL`` is measured, by inner products, on ``PROBE_QUERIES`` further
sample vectors.

Every part first gives each query a few of its best, some four times ``k`` over all parts, and says how good the next one would be.
Only parts whose next one reaches the query's k-th best so far are asked for the rest.

A part is dealt to several tasks when it holds more than ``CHUNK`` vectors or queries, so that copies of one vector
never meet in one task. Parts are as many as needed for ``PART_ROWS`` vectors each, ``MIN_PARTS`` to ``MAX_PARTS``; the sample
has ``SAMPLE_PER_PART`` vectors for each. A query takes further parts until these hold ``k`` candidates, so it finds
``k`` whenever there are as many.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those whose
dimension is not the most frequent one, nor rows with a null id. Of rows with one id the smallest vector counts. The
score is the inner product in double precision, added up from the first component to the last; ties go to smaller ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

PART_ROWS = 2048
MIN_PARTS = 8
MAX_PARTS = 256
SAMPLE_PER_PART = 128
GRAPH_K = 16
RECALL = 0.95
PROBE_QUERIES = 1024
CHUNK = 4096
SCORES = 1 << 20  # scores that the driver holds at once while it learns


def valid(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.exists(vector, lambda x: x != 0)


def neighbour_graph_of(queries: np.ndarray, points: np.ndarray, k: int, others: bool = False) -> np.ndarray:
    """The ``k`` points of largest inner product with each query, itself included (``others``: queries are the points, and left out).

    What is held at a time are ``SCORES`` scores, whatever the number of points.
    """
    k = min(k, len(points) - others)
    out = np.empty((len(queries), k), np.int64)
    step = max(1, SCORES // len(points))
    for at in range(0, len(queries), step):
        scores = queries[at : at + step] @ points.T
        if others:
            scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        out[at : at + step] = np.argpartition(np.negative(scores, out=scores), k - 1, axis=1)[:, :k]
    return out


def neighbour_graph(points: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of each point by inner product."""
    return neighbour_graph_of(points, points, k, others=True)


def balanced_parts(graph: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Part of each vertex: ``2 ** depth`` parts whose sizes differ by one at most per cut."""
    n, k = graph.shape
    part = np.zeros(n, np.int64)
    for _ in range(depth):
        new = part * 2
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[at] = np.arange(len(at))
            to = place[graph[at]]
            src, dst = np.repeat(np.arange(len(at)), k), to.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
            degree = np.maximum(np.bincount(a, minlength=len(at)), 1)
            x = rng.standard_normal(len(at))
            for _ in range(60):
                x -= (x * degree).sum() / degree.sum()
                x = 0.5 * x + 0.5 * np.bincount(a, x[b], len(at)) / degree
                x /= max(np.abs(x).max(), 1e-12)
            side = np.zeros(len(at), np.int64)
            side[np.argsort(x, kind="stable")[len(at) // 2 :]] = 1
            for _ in range(8):
                across = np.bincount(a, side[a] != side[b], len(at)) * 2 - np.bincount(a, minlength=len(at))
                gain = [np.flatnonzero((side == s) & (across > 0)) for s in (0, 1)]
                gain = [g[np.argsort(-across[g], kind="stable")] for g in gain]
                swap = min(map(len, gain)) // 2
                if not swap:
                    break
                side[gain[0][:swap]], side[gain[1][:swap]] = 1, 0
            new[at] += side
        part = new
    return part


class Router:
    """Network of one hidden layer; gives the probability of each part."""

    def __init__(self, dim: int, parts: int, hidden: int = 128, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.weights = [rng.standard_normal((dim, hidden)) * (2 / dim) ** 0.5, np.zeros(hidden), rng.standard_normal((hidden, parts)) * (1 / hidden) ** 0.5, np.zeros(parts)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum(x @ a + b, 0) @ c + d

    def best(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of each row."""
        step = max(1, SCORES // len(self.weights[3]))
        return np.concatenate([np.argmax(self.logits(x[at : at + step]), axis=1) for at in range(0, max(len(x), 1), step)])

    def fit(self, x: np.ndarray, marks: np.ndarray, weights: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 3e-3, seed: int = 4) -> None:
        """Learn that row ``i`` lies in the parts ``marks[i]``, as probable as the ``weights`` of these marks add up to."""
        rng = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                a, b, c, d = self.weights
                h = np.maximum(x[rows] @ a + b, 0)
                z = h @ c + d
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                target = np.zeros_like(p)
                np.add.at(target, (np.arange(len(rows))[:, None], marks[rows]), weights)
                g = (p - target / target.sum(axis=1, keepdims=True)) / len(rows)
                back = (g @ c.T) * (h > 0)
                t += 1
                for i, grad in enumerate((x[rows].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad**2
                    self.weights[i] = self.weights[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of one length, by one more component."""
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1, keepdims=True), 0.0))
    return np.hstack([x, rest]) / longest


def fit(sample: np.ndarray, depth: int, longest: float) -> tuple[Router, Router]:
    """Learn ``2 ** depth`` parts from a sample: the network that places vectors, and the one that routes queries."""
    high = lifted(sample, longest)
    graph = neighbour_graph(high, GRAPH_K)
    part = balanced_parts(graph, depth, np.random.default_rng(2))
    place = Router(high.shape[1], 1 << depth)
    place.fit(high, np.column_stack([part, part[graph]]), np.append(2.0, np.ones(graph.shape[1])))
    # where placed vectors end up is what a query has to find
    part = place.best(high)
    nearest = neighbour_graph_of(sample, sample, GRAPH_K)
    route = Router(sample.shape[1], 1 << depth)
    route.fit(unit(sample), part[nearest], np.ones(nearest.shape[1]))
    return place, route


def probes_needed(place: Router, route: Router, queries: np.ndarray, points: np.ndarray, longest: float, k: int, recall: float) -> int:
    """Parts that a query visits so that ``recall`` of its ``k`` nearest are there, on vectors that were not learned from.

    The nearest of a sample lie further off than those of the table, so the table's recall is rather higher.
    """
    order = np.argsort(-route.logits(unit(queries)), axis=1, kind="stable")
    nearest = neighbour_graph_of(queries, points, k)
    part = place.best(lifted(points, longest))
    turn = np.argsort(order, axis=1)  # when a query comes to a part
    visit = np.sort(np.take_along_axis(turn, part[nearest], axis=1).ravel())
    return int(visit[min(len(visit) - 1, int(np.ceil(recall * len(visit))) - 1)]) + 1


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def ranked(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the ``k`` best candidates of each query."""
    # of equal vectors only the smallest ids can be among the best: k, and one more in case one is the query's own
    order = np.lexsort((c_ids, np.unique(np.ascontiguousarray(c).view(f"V{8 * c.shape[1]}").ravel(), return_inverse=True)[1]))
    c, c_ids = c[order], c_ids[order]
    first = np.append(True, (c[1:] != c[:-1]).any(axis=1))
    few = np.arange(len(c)) - np.flatnonzero(first)[np.cumsum(first) - 1] <= k
    c, c_ids = c[few], c_ids[few]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 64):
        scores = q[at : at + 64] @ c.T
        scores[q_ids[at : at + 64, None] == c_ids[None, :]] = -np.inf
        if scores.shape[1] > k:
            # the product adds up in any order, so a margin stays for the exact sum below
            floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            scores[scores < floor - 1e-9 * (1 + np.abs(floor))] = -np.inf
        row, col = np.nonzero(scores > -np.inf)
        exact = np.zeros(len(row))
        left, right = q[at + row], c[col]
        for d in range(q.shape[1]):
            exact += left[:, d] * right[:, d]
        order = np.lexsort((c_ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < k
        out.append((q_ids[at + row[top]], c_ids[col[top]], exact[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None, recall: float = RECALL, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS, sample_per_part: int = SAMPLE_PER_PART) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for the rows that meet ``queries`` (on column ``id``)."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & valid(F.col("v")))
    dims = kept.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    kept = kept.where(F.size("v") == dims["dim"]).groupBy("id").agg(F.min("v").alias("v"))
    longest = kept.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, c: t + c * c)))).first()[0]
    depth = 0
    while (1 << depth) < min(max_parts, max(MIN_PARTS, dims["count"] / part_rows)):
        depth += 1
    sample = kept.orderBy(F.xxhash64(F.lit(1), "id")).limit((sample_per_part << depth) + PROBE_QUERIES).select("v").toArrow()
    sample = matrix(sample["v"])
    asking = min(PROBE_QUERIES, len(sample) // 4)
    if len(sample) - asking <= GRAPH_K << depth:  # too few to be cut so often
        depth = 0
    if depth:
        place, route = fit(sample[asking:], depth, longest)
        probes = probes or probes_needed(place, route, sample[:asking], sample[asking:], longest, k, recall)
    probes = probes or 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.argmax(place.logits(lifted(matrix(b["v"]), longest)), axis=1) if depth and len(b) else np.zeros(len(b), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b["id"], b["v"]], ["part", "id", "v"])

    index = materialize(kept.mapInArrow(placed, "part int, id long, v array<double>"), "ann-index")
    sizes = [0] * (1 << depth)
    for r in index.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]
    held = np.array(sizes)
    chunks = np.maximum(1, -(-held // CHUNK))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logits = route.logits(unit(matrix(b["v"]))) if depth and len(b) else np.zeros((len(b), 1))
            order = np.argsort(-logits, axis=1, kind="stable")
            reach = np.cumsum(held[order], axis=1) - held[order]
            # the most probable parts, and more of them while fewer than k candidates besides the query lie in them
            take = (np.arange(order.shape[1]) < probes) | (reach < k + 1)
            few = np.minimum(k, -(-4 * k // (take * chunks[order]).sum(axis=1)))
            row, col = np.nonzero(take)
            columns = [pa.array(order[row, col], pa.int32()), pa.array(few[row], pa.int32()), b["id"].take(pa.array(row)), b["v"].take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "few", "id", "v"])

    asked = materialize(index.where(queries).select("id", "v").mapInArrow(routed, "part int, few int, id long, v array<double>"), "ann-queries")
    blocks = [1] * len(sizes)
    for r in asked.groupBy("part").count().collect():
        blocks[r["part"]] = max(1, -(-r["count"] // CHUNK))
    of = lambda values: F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("part") + 1)
    own = lambda values: F.pmod(F.xxhash64("id"), of(values)).cast("int")
    every = lambda values: F.explode(F.sequence(F.lit(0), of(values) - 1))
    no_floor = [F.lit(None).cast("double").alias("floor"), F.lit(None).cast("long").alias("floor_id")]
    candidates = index.select("part", own(chunks).alias("chunk"), every(blocks).alias("block"), F.lit(-1).alias("few"), "id", "v", *no_floor)
    questions = asked.select("part", every(chunks).alias("chunk"), own(blocks).alias("block"), "few", "id", "v", *no_floor)

    def reranked(key: tuple, group: pa.Table) -> pa.Table:
        few = group["few"].to_numpy()
        asks = few >= 0
        ids, v = group["id"].to_numpy(), matrix(group["v"])
        query, found, score = (ranked(v[asks], ids[asks], v[~asks], ids[~asks], k) if asks.any() and not asks.all() else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)))
        order = np.argsort(ids[asks])
        of_query = order[np.searchsorted(ids[asks][order], query)]
        few = few[asks][of_query]
        start = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, np.int64)
        size = np.diff(np.append(start, len(query)))
        rank = np.arange(len(query)) - np.repeat(start, size)
        rest, rest_id = np.full(len(query), -np.inf), np.full(len(query), -1)
        more = np.repeat(size, size) > few
        at = (np.repeat(start, size) + few)[more]  # the best one that is not told
        rest[more], rest_id[more] = score[at], found[at]
        floor = group["floor"].filter(pa.array(asks)).to_numpy(zero_copy_only=False).astype(float)[of_query] if len(query) else np.empty(0)
        floor_id = group["floor_id"].filter(pa.array(asks)).to_pandas().fillna(-1).to_numpy(np.int64)[of_query] if len(query) else np.empty(0, np.int64)
        first = np.isnan(floor)
        tell = np.where(first, rank < few, (rank >= few) & ((score > floor) | ((score == floor) & (found < floor_id))))
        n = int(tell.sum())
        columns = [query, found, score, np.repeat(key[0].as_py(), len(query)), np.repeat(key[1].as_py(), len(query)), rest, rest_id]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c[tell], t) for c, t in zip(columns, kinds, strict=True)] if n else [pa.array([], t) for t in kinds], ["query_id", "vec_id", "score", "part", "chunk", "rest", "rest_id"])

    told = "query_id long, vec_id long, score double, part int, chunk int, rest double, rest_id long"
    first = materialize(candidates.union(questions).groupBy("part", "chunk", "block").applyInArrow(reranked, told), "ann-first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"), F.col("vec_id").alias("floor_id"))
    left = first.groupBy("query_id", "part", "chunk").agg(F.first("rest").alias("rest"), F.first("rest_id").alias("rest_id")).where("rest > double('-infinity')")
    # with fewer than k told, any rest counts
    left = left.join(floors, "query_id", "left").withColumns({"floor": F.coalesce("floor", F.lit(float("-inf"))), "floor_id": F.coalesce("floor_id", F.lit((1 << 63) - 1))})
    left = materialize(left.where("rest > floor or (rest = floor and rest_id < floor_id)").select(F.col("query_id").alias("id"), "part", "chunk", "floor", "floor_id"), "ann-left")
    block = own(blocks).alias("block")
    again = asked.join(left, ["id", "part"]).select("part", "chunk", block, "few", "id", "v", "floor", "floor_id")
    wanted = candidates.join(again.select("part", "chunk", "block").distinct(), ["part", "chunk", "block"], "left_semi").select(*candidates.columns)
    rest = wanted.union(again).groupBy("part", "chunk", "block").applyInArrow(reranked, told)
    columns = ["query_id", "vec_id", "score"]
    found = first.select(*columns).union(rest.select(*columns))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
