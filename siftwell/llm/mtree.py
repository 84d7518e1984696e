"""Exact top-k by inner product with an M-tree and best-first search.

Inner products become distances by one more component: with M the largest
norm, x is extended by sqrt(M^2 - |x|^2) and a query by 0; then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest rows have the largest products.

The tree (Ciaccia, Patella and Zezula, 1997) is built in pages: a node holds
the routing objects of its children, their covering radii and their distances
to the node's own routing object; a leaf holds rows and their distances to it.
Search opens the node with the least lower bound first. Before a distance is
computed the stored one gives a bound through the triangle inequality, and
most of those outside the k-th distance are never computed.

Above the shards' trees stands one root page: routing objects sampled from the
rows, each row below its nearest one. It is small enough for every task, and
prunes whole shards by the same bounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm import vectors as V
from siftwell.llm.shared import kept, new_path

PAGE, FANOUT = 64, 12
#: Most routing objects in the root page of one vector length, and shards below one of them.
MOST_PIVOTS, MOST_SALTS = 4096, 1 << 20


@dataclass
class Node:
    pivot: np.ndarray
    radius: float
    rows: np.ndarray | None = None  # of a leaf
    children: list[Node] | None = None
    pivots: np.ndarray | None = None  # of the children
    radii: np.ndarray | None = None
    stored: np.ndarray | None = None  # distances of children or rows to the pivot


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class MTree:
    """An index of the rows of an integer matrix."""

    def __init__(self, rows: np.ndarray, page: int = PAGE, fanout: int = FANOUT) -> None:
        whole = rows.astype(np.int64)
        self.page, self.fanout = page, fanout
        lifted = whole.astype(np.float64)
        norms = np.einsum("ij,ij->i", lifted, lifted)
        self.most = float(norms.max(initial=0))
        self.points = np.concatenate((lifted, np.sqrt(np.maximum(0, self.most - norms))[:, None]), axis=1)
        self.whole, self.lifted = whole, lifted
        self.slack = 4e-7 * (1 + self.most**0.5)
        self.computed = self.skipped = 0
        self.rng = np.random.default_rng(11)
        self.root = self._build(np.arange(len(rows)), self.points.mean(0)) if len(rows) else None

    def _build(self, rows: np.ndarray, pivot: np.ndarray) -> Node:
        own = _distances(self.points[rows], pivot)
        if len(rows) <= self.page:
            order = np.argsort(own, kind="stable")
            return Node(pivot, float(own.max()), rows=rows[order], stored=own[order])
        sample = rows if len(rows) <= 512 else self.rng.choice(rows, 512, replace=False)
        chosen, near = [int(sample[0])], _distances(self.points[sample], self.points[sample[0]])
        while len(chosen) < min(self.fanout, -(-len(rows) // self.page) + 1):  # far from those before
            at = int(np.argmax(near))
            if near[at] <= 0:
                break
            chosen.append(int(sample[at]))
            near = np.minimum(near, _distances(self.points[sample], self.points[sample[at]]))
        to = np.stack([_distances(self.points[rows], self.points[c]) for c in chosen])
        owner = to.argmin(0)
        groups = [rows[owner == i] for i in range(len(chosen))]
        pairs = [(self.points[c], g) for c, g in zip(chosen, groups, strict=True) if len(g)]
        if len(pairs) < 2:  # all at one distance: cut into even parts
            pairs = [(self.points[g[0]], g) for g in np.array_split(rows, 2)]
        children = [self._build(g, p) for p, g in pairs]
        pivots = np.stack([c.pivot for c in children])
        return Node(pivot, float(own.max()), children=children, pivots=pivots, radii=np.array([c.radius for c in children]), stored=_distances(pivots, pivot))

    def nearest(self, query: np.ndarray, k: int, extra: int = 0, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, products) of all rows whose product is among the k + extra largest values found, ties included.

        Rows with a product under ``floor`` may be left out.
        """
        k += extra
        point = np.append(query.astype(np.float64), 0.0)
        size = float(point @ point)
        # whole numbers and their sums are exact as doubles under 2**53, as longs under 2**63, and beyond as Python's
        reach = (size * self.most) ** 0.5
        kind = np.dtype(np.float64 if reach < 2**52 else np.int64 if reach < 2**62 else object)
        exact, q = self.lifted if kind == np.float64 else self.whole, query.astype(kind)
        slack = self.slack + 4e-7 * size**0.5
        best_rows, best = np.zeros(0, np.int64), np.zeros(0, kind)
        bound = np.inf if floor is None else max(0.0, size + self.most - 2 * float(floor)) ** 0.5
        if self.root is None:
            return best_rows, best.astype(np.int64)
        first = float(np.sqrt(((point - self.root.pivot) ** 2).sum()))
        heap: list[tuple[float, int, float, Node]] = [(max(0.0, first - self.root.radius), 0, first, self.root)]
        pushed = 1
        while heap:
            low, _, at, node = heapq.heappop(heap)
            if low > bound + slack:
                break
            gap = np.abs(at - node.stored)
            if node.children is None:
                rows = node.rows[gap <= bound + slack]
                self.computed, self.skipped = self.computed + len(rows), self.skipped + len(node.rows) - len(rows)
                if not len(rows):
                    continue
                products = exact[rows].astype(kind, copy=False) @ q
                if len(best) >= k:
                    better = products >= best.min()
                    rows, products = rows[better], products[better]
                    if not len(rows):
                        continue
                best_rows, best = np.concatenate((best_rows, rows)), np.concatenate((best, products))
                if len(best) > k:
                    least = np.partition(best, len(best) - k)[len(best) - k]
                    stay = best >= least
                    best_rows, best = best_rows[stay], best[stay]
                if len(best) >= k:
                    bound = min(bound, max(0.0, size + self.most - 2 * float(best.min())) ** 0.5)
            else:
                open_ = np.flatnonzero(gap - node.radii <= bound + slack)
                self.computed, self.skipped = self.computed + len(open_), self.skipped + len(node.children) - len(open_)
                d = _distances(node.pivots[open_], point)
                for i, x in zip(open_.tolist(), d.tolist(), strict=True):
                    child_low = max(low, x - node.children[i].radius)
                    if child_low <= bound + slack:
                        heapq.heappush(heap, (child_low, pushed, x, node.children[i]))
                        pushed += 1
        return best_rows, best.astype(np.int64)


def whole(vector: F.Column) -> F.Column:
    """floor(1024 x) of each component, as a long; one that does not fit fails."""

    def one(x: F.Column) -> F.Column:
        scaled = x.cast("double") * 1024
        return F.when(F.abs(scaled) < 2.0**63, F.floor(scaled).cast("long")).otherwise(F.raise_error(F.lit("a component does not fit a long")).cast("long"))

    return F.transform(vector, one)


@dataclass
class Router:
    """The root page of one vector length: routing objects, their covering radii, and the shards below each."""

    pivots: np.ndarray  # whole vectors
    most: float  # the largest squared norm of all rows
    radii: np.ndarray | None = None
    salts: np.ndarray | None = None

    def _squares(self, vectors: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Squared distances of lifted vectors (``below`` is the last component) to all routing objects."""
        pivots = self.pivots.astype(np.float64)
        own = np.sqrt(np.maximum(0, self.most - (pivots * pivots).sum(1)))
        sizes = (vectors * vectors).sum(1) + below * below
        return np.maximum(0, sizes[:, None] + self.most - 2 * (vectors @ pivots.T + below[:, None] * own))

    def rows(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest routing object, distance) of rows."""
        squares = self._squares(vectors, np.sqrt(np.maximum(0, self.most - (vectors * vectors).sum(1))))
        nearest = squares.argmin(1)
        return nearest, np.sqrt(squares[np.arange(len(vectors)), nearest])

    def slack(self, sizes: np.ndarray) -> np.ndarray:
        """More than rounding can make of a distance."""
        return 4e-7 * (1 + self.most**0.5 + sizes**0.5)

    def queries(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower bounds of the distance to anything below each routing object, squared norms)."""
        sizes = (vectors * vectors).sum(1)
        return np.maximum(0, np.sqrt(self._squares(vectors, np.zeros(len(vectors)))) - self.radii), sizes


def _routers(rows: DataFrame, shard_rows: int) -> dict[int, Router]:
    """A router for each vector length, its routing objects sampled by id: at most ``MOST_PIVOTS``."""
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = {r["n"]: (r["rows"], r["most"]) for r in rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.max(square).alias("most")).collect()}  # a row per length
    wanted = F.lit(1)
    for n, (size, _) in sizes.items():
        wanted = F.when(F.col("n") == n, min(MOST_PIVOTS, -(-size // shard_rows))).otherwise(wanted)
    order = Window.partitionBy("n").orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("vector"))
    picked = rows.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= wanted).select("n", "vector").collect()
    pivots: dict[int, list] = {}
    for r in picked:
        pivots.setdefault(r["n"], []).append(r["vector"])
    return {n: Router(np.array(v, np.int64).reshape(len(v), n), sizes[n][1]) for n, v in pivots.items()}


def _routed(rows: DataFrame, routers: dict[int, Router]) -> DataFrame:
    """``rows`` (vec_id, vector, n, copies) with pivot and distance."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for part in V.by_length(batch.slice(at, 1024)):
                    pivot, distance = routers[part.column("n")[0].as_py()].rows(V.matrix(part.column("vector"), np.float64))
                    yield from part.append_column("pivot", pa.array(pivot, pa.int32())).append_column("distance", pa.array(distance, pa.float64())).to_batches()

    return rows.mapInArrow(route, "vec_id long, vector array<long>, n int, copies long, pivot int, distance double")


def _sent(queries: DataFrame, routers: dict[int, Router], first: bool) -> DataFrame:
    """``queries`` with the shards they go to: the nearest one first, later all others that may hold better rows.

    ``floor`` is the least score that still matters, if one is known, and
    ``seen`` the shard searched before.
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for part in V.by_length(batch.slice(at, 512)):
                    n = part.column("n")[0].as_py()
                    if n not in routers:
                        continue
                    own = routers[n]
                    low, sizes = own.queries(V.matrix(part.column("vector"), np.float64))
                    if first:
                        key = part.column("key").to_numpy()
                        near = low.argmin(1)
                        shards = [[int(p) * MOST_SALTS + int(k) % int(own.salts[p])] for p, k in zip(near, key, strict=True)]
                    else:
                        floors = [np.inf if f is None else max(0.0, s + own.most - 2.0 * f) ** 0.5 for f, s in zip(part.column("floor").to_pylist(), sizes, strict=True)]
                        open_ = low <= np.array(floors)[:, None] + own.slack(sizes)[:, None]
                        shards = [[s for p in np.flatnonzero(o).tolist() for s in range(p * MOST_SALTS, p * MOST_SALTS + int(own.salts[p])) if s != seen] for o, seen in zip(open_, part.column("seen").to_pylist(), strict=True)]
                    yield from part.append_column("shards", pa.array(shards, pa.list_(pa.int64()))).to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(route, f"{kinds}, shards array<long>").withColumn("shard", F.explode("shards")).drop("shards")


def top_k(table: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = V.SHARD_ROWS, query_rows: int = V.QUERY_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k largest inner products for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows of another id and the same number of components. Fewer than k
    candidates are all returned; ties go to smaller ids. Rows with a null id or
    an unusable vector take no part; an empty table gives no rows. Repeated
    rows rank once each. Query rows of one id are asked each, with ranks of
    their own; those that repeat the vector too are one query. A score found
    that does not fit a long fails. No other column is read.

    A query first asks the shard whose ball it is nearest to; the k-th score
    found there leaves only the shards whose balls reach it to be asked.
    """
    good = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("raw")).filter(F.col("vec_id").isNotNull() & V.usable(F.col("raw")))
    rows = good.select("vec_id", whole(F.col("raw")).alias("vector"))
    spark = table.sparkSession
    folder = new_path(spark, "mtree")
    points = kept(V.candidates(rows, k), "points")
    routers = _routers(points, shard_rows)
    routed = kept(_routed(points, routers), "routed")
    counts = routed.groupBy("n", "pivot").agg(F.count(F.lit(1)).alias("rows"), F.max("distance").alias("radius"))
    counts = kept(counts.select("n", "pivot", "radius", F.least(F.ceil(F.col("rows") / (2 * shard_rows)), F.lit(MOST_SALTS)).alias("salts")), "balls")
    for n, router in routers.items():
        router.radii, router.salts = np.zeros(len(router.pivots)), np.zeros(len(router.pivots), np.int64)
    for r in counts.collect():  # a row per routing object
        routers[r["n"]].radii[r["pivot"]], routers[r["n"]].salts[r["pivot"]] = r["radius"] + routers[r["n"]].slack(np.zeros(1))[0], r["salts"]
    for router in routers.values():
        router.radii[router.salts == 0] = -np.inf  # nothing below
    salt = F.pmod(F.xxhash64("vec_id", "vector"), F.col("salts"))
    shards = V.store(routed.join(F.broadcast(counts.select("n", "pivot", "salts")), ["n", "pivot"]).select("n", (F.col("pivot") * MOST_SALTS + salt).alias("shard"), "vec_id", "copies", "vector"), folder, np.int64, lambda own: (own, MTree(own.vectors)))

    def run(index: tuple[V.Distinct, MTree], query_ids: np.ndarray, queries: np.ndarray, floors: list) -> list[tuple[np.ndarray, np.ndarray]]:
        own, tree = index
        return [own.expand(*tree.nearest(q, k, 1, floor), k, i) for i, q, floor in zip(query_ids, queries, floors, strict=True)]

    queries = kept(V.asked(rows, every), "queries")
    blocks = max(1, -(-queries.count() // query_rows))
    start = _sent(queries.withColumn("floor", F.lit(None).cast("long")), routers, True)
    first = kept(V.ask(start, shards, folder, blocks, np.int64, run, "long"), "first")
    floors = first.groupBy("query_id", "key").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found"))
    seen = start.select("query_id", "key", F.col("shard").alias("seen"))
    known = queries.join(floors, ["query_id", "key"], "left").join(seen, ["query_id", "key"], "left")
    rest = _sent(known.select("query_id", "key", "n", "vector", F.when(F.col("found") >= k, F.col("least")).alias("floor"), "seen"), routers, False)
    return V.best(first.unionByName(V.ask(rest, shards, folder, blocks, np.int64, run, "long")), k)
