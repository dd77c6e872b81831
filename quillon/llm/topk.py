"""Exact top-k inner products by M-tree best-first search (operator 9).

Vectors are dealt to their nearest pivot. The pivots with their covering radii are the root of an M-tree; below,
blocks of bounded size hold trees, each built once and written as pages, a row a node. A routing entry keeps its covering radius
and its distance to its parent, so that the bound

    <q, x>  <=  <q, c> + |q| * d(c, x)

of a child follows from its parent's product alone, and most products with routing objects and vectors are never
computed. Each query searches the blocks of its best pivot first; its k-th score then decides which other
blocks can still hold a better vector, and only those get the query. Bounds err upwards, so the result is exact.

Vectors are shuffled once, to build the trees. Pages go to the queries that their block was found for, in as many copies
as those queries fill parts of QUERY_ROWS; a block that no query needs is not read by a task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, ship

PAGE = 512  # entries of a leaf
FANOUT = 16  # entries of a routing node
TOGETHER = 512  # queries that go through a tree at once
BLOCK_ROWS = 16384  # vectors of a block, and with it of one task's tree
QUERY_ROWS = 32768  # queries that one task searches a block for
MOST_PIVOTS = 16384  # the bound of what is broadcast: pivots with their radii, 8 bytes a component
AT_ONCE = 1 << 22  # products of rows and pivots that are held at once


#: Scores and places share 64 bits: 42 for the score with its sign, 21 for the place.
_SHIFT, _PLACES, _NONE = 21, (1 << 21) - 1, np.iinfo(np.int64).min


def _slack(bound):
    return bound + 1e-9 * np.abs(bound) + 1e-6


class MTree:
    """A paged tree over the rows of ``vectors`` with ``ids``; scores are inner products."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        if len(ids) > _PLACES:
            raise ValueError("a tree holds fewer vectors than that")
        self.nodes: list[tuple] = []
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.computed = 0
        self.draw = np.random.default_rng(len(ids))
        self.root = self._build(vectors[order], np.arange(len(ids))) if len(ids) else None

    def _build(self, x: np.ndarray, ids: np.ndarray) -> tuple[int, np.ndarray, float]:
        """Node number, routing object and covering radius; ids are places in the order of ids."""
        if len(x) <= PAGE:
            centre = x.mean(axis=0)
            distance = np.sqrt(((x - centre) ** 2).sum(axis=1))
            self.nodes.append((True, x, ids, distance))
            return len(self.nodes) - 1, centre, float(distance.max())
        centres = x[self.draw.choice(len(x), FANOUT, replace=False)]
        for _ in range(2):
            near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
            centres = np.stack([x[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(FANOUT)])
        parts = [np.flatnonzero(near == k) for k in range(FANOUT)]
        parts = [p for p in parts if len(p)]
        if max(map(len, parts)) > 0.9 * len(x):  # equal vectors: pages in order of their ids
            parts = np.array_split(np.arange(len(x)), FANOUT)
        children = [self._build(x[p], ids[p]) for p in parts]
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        routing = np.stack([c[1] for c in children])
        up = np.sqrt(((routing - centre) ** 2).sum(axis=1))
        self.nodes.append((False, routing, np.array([c[2] for c in children]), up, [c[0] for c in children]))
        return len(self.nodes) - 1, centre, radius

    def pages(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """Every node as (number, vectors, places or children, distances, radii or nothing); -1 is the root's entry with all ids."""
        if self.root is not None:
            number, centre, radius = self.root
            yield -1, centre.tobytes(), np.append(self.ids, number).astype(np.int64).tobytes(), b"", np.float64(radius).tobytes()
        for number, node in enumerate(self.nodes):
            if node[0]:
                yield number, node[1].tobytes(), np.asarray(node[2], np.int64).tobytes(), node[3].tobytes(), b""
            else:
                yield number, node[1].tobytes(), np.asarray(node[4], np.int64).tobytes(), node[3].tobytes(), node[2].tobytes()

    @classmethod
    def of_pages(cls, pages: list[tuple[int, bytes, bytes, bytes, bytes]], width: int) -> MTree:
        tree = cls(np.zeros((0, width)), np.zeros(0, np.int64))
        for number, x, places, distance, radii in sorted(pages, key=lambda p: p[0]):
            places = np.frombuffer(places, np.int64)
            if number < 0:
                tree.ids, tree.root = places[:-1], (int(places[-1]), np.frombuffer(x), float(np.frombuffer(radii)[0]))
            else:
                x, distance = np.frombuffer(x).reshape(-1, width), np.frombuffer(distance)
                tree.nodes.append((False, x, np.frombuffer(radii), distance, places.tolist()) if radii else (True, x, places, distance))
        return tree

    def search(self, q: np.ndarray, k: int, own: np.ndarray, least: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of the k best vectors of each query but those with its own id, ties to smaller ids.

        Queries go best first together: the queue is ordered by the best bound of any query, and a node is opened
        with those queries only whose own bound reaches their k-th score. Scores under ``least`` may be left out.
        ``wide`` is for scores that 41 bits don't hold: ranks are then by two sorted keys instead of one packed integer.
        """
        n = len(q)
        if self.root is None or not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.sqrt((q * q).sum(axis=1))
        top = np.full((n, k), _NONE)  # score and place in one integer, so that a larger one is a better one
        high, low = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)  # the same in two, where wide
        bar = least.astype(np.float64).copy()
        number, centre, radius = self.root
        product = q @ centre
        bound = _slack(product + size * radius)
        queue = [(-bound.max(), 0, number, np.arange(n), product, bound)]
        pushed = 0
        while queue:
            _, _, number, rows, product, bound = heapq.heappop(queue)
            open_ = bound >= bar[rows]
            if not open_.any():
                continue
            rows, product = rows[open_], product[open_]
            node = self.nodes[number]
            if node[0]:
                _, x, places, distance = node
                # by the parent's products alone: vectors that no query needs are left out
                take = np.flatnonzero((_slack(product[:, None] + size[rows, None] * distance) >= bar[rows, None]).any(axis=0))
                found = np.rint(q[rows] @ x[take].T)
                self.computed += found.size
                if wide:
                    found[(found < bar[rows, None]) | (self.ids[places[take]] == own[rows, None])] = -np.inf
                    scores = np.concatenate([high[rows], found], axis=1)
                    at = np.concatenate([low[rows], np.broadcast_to(places[take], found.shape)], axis=1)
                    best = np.lexsort((at, -scores), axis=1)[:, :k]
                    high[rows], low[rows] = np.take_along_axis(scores, best, 1), np.take_along_axis(at, best, 1)
                    bar[rows] = np.maximum(bar[rows], high[rows, -1])
                    continue
                found = found.astype(np.int64)
                keys = (found << _SHIFT) | (_PLACES - places[take])
                keys[(found < bar[rows, None]) | (self.ids[places[take]] == own[rows, None])] = _NONE
                better = (keys > top[rows, :1]).any(axis=1)  # the first of a row of top is its least
                if better.any():
                    rows = rows[better]
                    merged = np.concatenate([top[rows], keys[better]], axis=1)
                    best = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
                    lowest = best.argmin(axis=1)
                    best[np.arange(len(rows)), lowest], best[:, 0] = best[:, 0].copy(), best[np.arange(len(rows)), lowest]
                    top[rows] = best
                    full = best[:, 0] != _NONE
                    bar[rows[full]] = np.maximum(bar[rows[full]], best[full, 0] >> _SHIFT)
            else:
                _, routing, radii, up, children = node
                reach = _slack(product[:, None] + size[rows, None] * (up + radii)) >= bar[rows, None]  # again without a new product
                for j in np.flatnonzero(reach.any(axis=0)).tolist():
                    own_rows = rows[reach[:, j]]
                    found = q[own_rows] @ routing[j]
                    self.computed += len(found)
                    own_bound = _slack(found + size[own_rows] * radii[j])
                    pushed += 1
                    heapq.heappush(queue, (-own_bound.max(), pushed, children[j], own_rows, found, own_bound))
        if wide:
            row, at = np.nonzero(high != -np.inf)
            return row, np.clip(high[row, at], -(2.0**63), 2.0**63 - 1024).astype(np.int64), self.ids[low[row, at]]
        row, at = np.nonzero(top != _NONE)
        return row, top[row, at] >> _SHIFT, self.ids[_PLACES - (top[row, at] & _PLACES)]


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v: floor(64 * x) of each component as double, for vectors without null or non-finite components.

    Null ids and null vectors take no part; vectors shorter than the longest count as 0 beyond their end.
    """
    v = F.col(vector_col)
    kept = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("v"))
    return whole


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _nearby(x: np.ndarray, many: int) -> Iterator[slice]:
    """Slices of the rows of x whose products with ``many`` pivots are held at once."""
    step = max(1, AT_ONCE // max(1, many))
    for begin in range(0, len(x), step):
        yield slice(begin, begin + step)


def top_k(vectors: DataFrame, k: int, is_query: Column) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row of ``vectors`` (vec_id, v) that ``is_query`` chooses.

    Rows with the query's own id are no candidates. Fewer than k candidates give fewer rows; no queries or an empty table
    give none. Ties go to the smaller vec_id. Repeated ids are candidates each, and as queries count once for each different
    vector. Scores are exact below 2^53; larger ones are those of doubles, and the largest long at most. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    width, rows, most = vectors.agg(F.max(F.size("v")), F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    width, wide = width or 0, (most or 0) >= 2.0**41
    padded = vectors.select("vec_id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))).alias("v"))
    many = max(1, min(MOST_PIVOTS, math.ceil(rows / BLOCK_ROWS) * 2))
    pivots = _matrix(padded.orderBy(F.xxhash64("v"), "vec_id").limit(many).toArrow()["v"], width)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        norm = (p**2).sum(axis=1)
        for batch in batches:
            x = _matrix(batch.column(1), width)
            near = np.zeros(len(x), np.int64)
            for part in _nearby(x, len(p)):
                near[part] = (norm - 2 * x[part] @ p.T).argmin(axis=1)
            distance = np.sqrt(((x - p[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "pivot", "distance"])

    dealt = materialise(padded.mapInArrow(assign, "vec_id long, v array<double>, pivot int, distance double"), "vectors")
    sizes = {r[0]: (math.ceil(r[1] / BLOCK_ROWS), r[2]) for r in dealt.groupBy("pivot").agg(F.count("*"), F.max("distance")).collect()}  # a row a pivot
    radii = np.full(many, -1.0)
    for p, (_, r) in sizes.items():
        radii[p] = r
    by_pivot = lambda table: F.create_map(*[F.lit(x) for pair in (table or {0: 1}).items() for x in pair])
    salts = by_pivot({p: n for p, (n, _) in sizes.items()})
    salted = dealt.select("vec_id", "v", "pivot", F.pmod(F.xxhash64("vec_id", "v"), salts[F.col("pivot")]).cast("int").alias("salt"))

    def build(block: pa.Table) -> pa.Table:
        made = list(MTree(_matrix(block["v"], width), block["vec_id"].to_numpy()).pages())
        keys = [pa.array([block[c][0].as_py()] * len(made), pa.int32()) for c in ("pivot", "salt")]
        return pa.table([*keys, pa.array([m[0] for m in made], pa.int32()), *(pa.array([m[j] for m in made], pa.binary()) for j in range(1, 5))], ["pivot", "salt", "node", "x", "places", "distance", "radii"])

    pages = materialise(salted.groupBy("pivot", "salt").applyInArrow(build, "pivot int, salt int, node int, x binary, places binary, distance binary, radii binary"), "pages")
    queries = dealt.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()

    def route(home: bool, count: bool):
        """Each query with the pivots whose blocks can hold a better vector, or only how many queries each pivot gets."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, found = shared.value, np.zeros(many, np.int64)
            for batch in batches:
                q = _matrix(batch.column(1), width)
                bar = batch.column(2).to_numpy(zero_copy_only=False)
                for part in _nearby(q, len(p)):
                    own = q[part]
                    bounds = np.where(radii >= 0, _slack(own @ p.T + np.sqrt((own**2).sum(axis=1))[:, None] * np.maximum(radii, 0)), -np.inf)
                    best = bounds.argmax(axis=1)
                    row, to = (np.arange(len(own)), best) if home else np.nonzero((bounds >= bar[part, None]) & (np.arange(len(p)) != best[:, None]))
                    if count:
                        found += np.bincount(to, minlength=many)
                    else:
                        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row + part.start)) for c in batch.columns), pa.array(to.astype(np.int32))], ["query_id", "q", "least", "pivot"])
            if count:
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["pivot", "n"])

        return run

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [left[c].to_pylist() for c in ("node", "x", "places", "distance", "radii")]
        tree = MTree.of_pages(list(zip(*columns, strict=True)), width)
        q = _matrix(right["q"], width)
        own, least = right["query_id"].to_numpy(), right["least"].to_numpy()
        found = [(begin + r, v, s) for begin in range(0, len(q), TOGETHER) for r, s, v in [tree.search(q[begin : begin + TOGETHER], k, own[begin : begin + TOGETHER], least[begin : begin + TOGETHER], wide)]]
        row, ids, scores = (pa.array(np.concatenate([*(f[j] for f in found), np.zeros(0, np.int64)]), pa.int64()) for j in range(3))
        return pa.table([right["query_id"].take(row), right["q"].take(row), ids, scores], ["query_id", "q", "vec_id", "score"])

    def searched(asked: DataFrame, home: bool) -> DataFrame:
        counts = asked.mapInArrow(route(home, True), "pivot int, n long").groupBy("pivot").agg(F.sum("n")).collect()  # a row a pivot
        parts = by_pivot({p: math.ceil(n / QUERY_ROWS) for p, n in counts})
        to = asked.mapInArrow(route(home, False), "query_id long, q array<double>, least double, pivot int")
        to = to.withColumn("salt", F.explode(F.sequence(F.lit(0), salts[F.col("pivot")] - 1))).withColumn("part", F.pmod(F.xxhash64("query_id", "q"), parts[F.col("pivot")]).cast("int"))
        needed = pages.where(F.col("pivot").isin([p for p, _ in counts])).withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("pivot")] - 1)))
        keys = ["pivot", "salt", "part"]
        return needed.groupBy(*keys).cogroup(to.groupBy(*keys)).applyInArrow(search, "query_id long, q array<double>, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = materialise(best(searched(queries.withColumn("least", F.lit(float("-inf"))), True)), "top-home")
    bars = first.where(F.col("rank") == k).select("query_id", "q", F.col("score").cast("double").alias("least"))
    asked = queries.join(bars, ["query_id", "q"], "left").select("query_id", "q", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    rest = searched(asked, False)
    return best(first.drop("rank").unionByName(rest)).select("query_id", "rank", "vec_id", "score")
