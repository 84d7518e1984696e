"""Approximate nearest neighbours with a hash-prefix forest.

LSH Forest (Bawa, Condie and Ganesan, 2005): each tree is a sorted array of
long hash strings, here ``BITS`` signs of random projections. A query descends
to its longest prefix match in every tree, then all trees ascend together, one
bit at a time, until the rows met suffice. Those are scored exactly.

How many suffice is a property of the data, so it is fitted: for a bounded
sample of queries (``FIT_QUERIES``) the true neighbours are found in one pass
over all rows, and on a bounded sample of rows (``FIT_ROWS``) it is seen how
many rows the trees have met when ``TARGET`` of those neighbours are among
them. Where neighbours are near that is a handful; where they are hardly nearer
than strangers it is a good part of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm import vectors as V
from siftwell.llm.shared import kept, new_path

TREES, BITS, LEAST = 96, 32, 256
#: Parameters of the fit: queries and rows sampled by a hash of their ids, and the share of true neighbours to be met.
FIT_QUERIES, FIT_ROWS, TARGET = 64, 4096, 0.96
#: Vector lengths, the commonest first, that are fitted; rows of others are all scored.
FIT_LENGTHS = 8


class Forest:
    """Sorted hash strings of the rows of a matrix of unit vectors, tree by tree."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 5) -> None:
        self.bits, self.trees, self.rows, self.seed = bits, trees, rows, seed
        hashed = self.hashed(rows)
        self.order = np.argsort(hashed, axis=1, kind="stable").astype(np.uint32)
        self.codes = np.take_along_axis(hashed, self.order, 1).astype(np.uint32) if bits <= 32 else np.take_along_axis(hashed, self.order, 1)

    def hashed(self, rows: np.ndarray) -> np.ndarray:
        """(trees, rows): each tree's hash strings, as whole numbers with the first bit highest."""
        rng = np.random.default_rng(self.seed)  # the same planes in every task
        weights = np.int64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return np.stack([(rows @ rng.standard_normal((rows.shape[1], self.bits)) > 0) @ weights for _ in range(self.trees)])

    def spans(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries) first and after the last row that shares the first ``depth`` bits."""
        shift = self.bits - depth
        low = codes >> shift << shift
        high = low + (np.int64(1) << shift) - 1
        found = [(np.searchsorted(s, a.astype(s.dtype)), np.searchsorted(s, b.astype(s.dtype), "right")) for s, a, b in zip(self.codes, low, high, strict=True)]
        return np.stack([x for x, _ in found]), np.stack([y for _, y in found])

    def candidates(self, queries: np.ndarray, enough: float) -> list[np.ndarray]:
        """For each query the rows met when ``enough`` or more, counted once a tree, share its prefix."""
        codes = self.hashed(queries)
        n = len(queries)
        low, high = np.zeros((self.trees, n), np.int64), np.full((self.trees, n), len(self.rows), np.int64)
        waiting = np.arange(n)
        for depth in range(self.bits, 0, -1):
            a, b = self.spans(codes[:, waiting], depth)
            done = (b - a).sum(0) >= enough
            low[:, waiting[done]], high[:, waiting[done]] = a[:, done], b[:, done]
            waiting = waiting[~done]
            if not len(waiting):
                break
        met = np.zeros(len(self.rows), bool)
        found = []
        for i in range(n):
            for t in np.flatnonzero(high[:, i] > low[:, i]):
                met[self.order[t, low[t, i] : high[t, i]]] = True
            found.append(np.flatnonzero(met))
            met[:] = False
        return found


def enough_share(sample: np.ndarray, queries: np.ndarray, near: np.ndarray, owner: np.ndarray, target: float = TARGET) -> float:
    """Rows met, counted once a tree, as a share of all rows, at which ``target`` of the true neighbours are among them.

    ``near`` are the neighbours, ``owner`` the query of each.
    """
    forest = Forest(sample)
    asked, wanted = forest.hashed(queries), forest.hashed(near)
    common = forest.bits - np.vectorize(int.bit_length, otypes=[np.int64])((asked[:, owner] ^ wanted).astype(object)).min(0)
    # a neighbour is met if the ascent has not ended one bit below its longest common prefix
    sizes = np.stack([(lambda s: (s[1] - s[0]).sum(0))(forest.spans(asked, d)) for d in range(forest.bits + 1)])
    before = np.where(common < forest.bits, sizes[np.minimum(common + 1, forest.bits), owner], 0)
    return float(np.quantile((before + 1) / len(sample), target, method="higher"))


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal rows give equal values wherever they stand."""
    return (rows * query).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))


def _fitted(points: DataFrame, queries: DataFrame, k: int) -> dict[int, float]:
    """The share of rows to meet, by vector length."""
    lengths = [r["n"] for r in points.groupBy("n").count().orderBy(F.desc("count"), "n").limit(FIT_LENGTHS).collect()]
    by_hash = Window.partitionBy("n").orderBy(F.xxhash64("id"), "id", F.xxhash64("vector"))

    def sampled(rows: DataFrame, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        picked = rows.filter(F.col("n").isin(lengths)).withColumn("_at", F.row_number().over(by_hash)).filter(F.col("_at") <= most).select("id", "n", "vector").collect()
        return {n: (np.array([r["id"] for r in own]), np.array([r["vector"] for r in own], np.float64)) for n in lengths if (own := [r for r in picked if r["n"] == n])}

    asked = sampled(queries.select(F.col("query_id").alias("id"), "n", "vector"), FIT_QUERIES)
    rows = sampled(points.select(F.col("vec_id").alias("id"), "n", "vector"), FIT_ROWS)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.by_length(batch):
                n = part.column("n")[0].as_py()
                if n not in asked:
                    continue
                ids, own = part.column("vec_id").to_numpy(), V.matrix(part.column("vector"), np.float64)
                scores = unit(asked[n][1]) @ unit(own).T
                scores[asked[n][0][:, None] == ids] = -2
                best = np.argsort(-scores, 1, kind="stable")[:, :k]
                owner, at = np.repeat(np.arange(len(best)), best.shape[1]), best.ravel()
                good = scores[owner, at] > -2
                owner, at = owner[good], at[good]
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(at), pa.int32()), pa.array(owner, pa.int32()), pa.array(scores[owner, at]), pa.array(ids[at]), pa.array(list(own[at]), pa.list_(pa.float64()))], ["n", "owner", "score", "vec_id", "vector"])

    order = Window.partitionBy("n", "owner").orderBy(F.desc("score"), "vec_id")
    found = points.mapInArrow(nearest, "n int, owner int, score double, vec_id long, vector array<double>").withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= k).collect()  # k rows a sampled query
    shares = {}
    for n in asked:
        own = [r for r in found if r["n"] == n]
        if own:
            shares[n] = enough_share(unit(rows[n][1]), unit(asked[n][1]), unit(np.array([r["vector"] for r in own])), np.array([r["owner"] for r in own]))
    return shares


def neighbours(table: DataFrame, every: int = 50, k: int = 5, share: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = V.SHARD_ROWS, query_rows: int = V.QUERY_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest rows found for each query, by cosine.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows of another id and the same number of components, every one indexed.
    Fewer than k candidates are all returned; ties go to smaller ids. Rows with
    a null id and vectors that are unusable or zero take no part; an empty
    table gives no rows. Copies of a vector stand for one row in the forest.
    Query rows of one id are asked each, with ranks of their own; those that
    repeat the vector too are one query. ``share`` is the share of a shard's
    rows to meet, counted once a tree; None has it fitted.
    """
    good = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = good.filter(F.col("vec_id").isNotNull() & V.usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    folder = new_path(table.sparkSession, "forest")
    points, queries = kept(V.candidates(rows, k), "points"), kept(V.asked(rows, every), "queries")
    shares = _fitted(points, queries, k) if share is None else {}
    counts = kept(points.groupBy("n").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards")), "counts")  # a row per length
    shard = F.pmod(F.xxhash64("vec_id", "vector"), F.col("shards"))
    shards = V.store(points.join(F.broadcast(counts), "n").select("n", shard.alias("shard"), "vec_id", "copies", "vector"), folder, np.float64, lambda own: (own, Forest(unit(own.vectors))))

    def run(index: tuple[V.Distinct, Forest], query_ids: np.ndarray, asked: np.ndarray, floors: list) -> list[tuple[np.ndarray, np.ndarray]]:
        own, forest = index
        wanted = share if share is not None else shares.get(asked.shape[1], np.inf)
        found, sides = [], unit(asked)
        for at in range(0, len(asked), 256):
            for i, met in enumerate(forest.candidates(sides[at : at + 256], max(LEAST, wanted * len(forest.rows))), at):
                rough = forest.rows[met] @ sides[i]
                if len(rough) > k + 1:
                    met = met[rough >= np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] - 1e-9]
                found.append(own.expand(met, cosines(own.vectors[met], asked[i]), k, query_ids[i]))
        return found

    blocks = max(1, -(-queries.count() // query_rows))
    sent = queries.join(F.broadcast(counts), "n").select("query_id", "key", "n", "vector", F.lit(None).cast("long").alias("floor"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    return V.best(V.ask(sent, shards, folder, blocks, np.float64, run, "double"), k)
