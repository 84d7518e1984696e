"""Vector indexes in shards: built once, stored as files, searched by blocks of queries.

Rows are shuffled to their shard once; a task builds the shard's index and
writes it into the shared folder. Queries then go to the shards they need, some
thousand at a time, and a task loads the one index they ask. So memory is
bounded by a shard and a block, and what is shuffled grows with rows, and with
queries times the shards they have to see.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.files import fetch, save
from siftwell.llm.shared import kept

SHARD_ROWS, QUERY_ROWS = 8192, 512


def usable(vector: Column) -> Column:
    """Neither null nor holding a null, infinite or undefined component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a list column whose lists are equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), -1 if len(column) and len(column[0]) else 0)


def by_length(batch: pa.RecordBatch | pa.Table) -> list[pa.Table]:
    """A batch with columns ``n`` and ``vector``, parted by n."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    lengths = table.column("n").to_numpy()
    return [table.filter(pa.array(lengths == n)) for n in np.unique(lengths)]


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """Rows (vec_id, vector, n, copies): of each vector as many as a top k can hold.

    Rows of one vector score alike and rank by id, so k + 1 ids (one may be
    asked for itself) of each, and k copies of an id, are all that any result
    shows. Both limits work before the shuffle, so a vector or an id that a
    third of all rows share makes no large group.
    """
    once = rows.groupBy("vector", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
    first = Window.partitionBy("vector").orderBy("vec_id")
    return once.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= k + 1).select("vec_id", "vector", F.size("vector").alias("n"), "copies")


def asked(rows: DataFrame, every: int) -> DataFrame:
    """Rows (query_id, key, n, vector): the queries; ``key`` tells apart rows of one id."""
    found = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("key"), F.size("vector").alias("n"), "vector")
    return found.dropDuplicates(["query_id", "key"])


class Distinct:
    """The distinct vectors of a shard and, for each, its rows' ids in order."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> None:
        keys = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * max(1, vectors.shape[1])))).ravel() if vectors.shape[1] else np.zeros(len(ids), "V1")
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        order = np.lexsort((ids, inverse))
        self.ids = np.repeat(ids[order], copies[order])
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(inverse, copies, len(first)).astype(np.int64))))

    def expand(self, rows: np.ndarray, scores: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) of distinct rows, without id ``own``; ties to smaller ids."""
        ids = [(x := self.ids[self.starts[r] : self.starts[r + 1]])[x != own][:k] for r in rows]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        values = np.repeat(scores, [len(x) for x in ids])
        best = np.lexsort((flat, -values))[:k]
        return flat[best], values[best]


def _file(folder: str, n: int, shard: int) -> str:
    return f"{folder}/{n}-{shard}.index"


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` shuffled by ``keys`` to enough tasks for all cores: groups are few bytes and much work."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def store(rows: DataFrame, folder: str, kind: type, make: Callable[[Distinct], object]) -> DataFrame:
    """Build and write the index of each (n, shard) of ``rows`` (n, shard, vec_id, copies, vector); return the shards there are."""

    def build(group: pa.Table) -> pa.Table:
        ids, copies = group.column("vec_id").to_numpy(), group.column("copies").to_numpy()
        order = np.argsort(ids, kind="stable")
        vectors = matrix(group.column("vector"), kind)
        n, shard = group.column("n")[0].as_py(), group.column("shard")[0].as_py()
        save(_file(folder, n, shard), pickle.dumps(make(Distinct(ids[order], copies[order], vectors[order])), 5))
        return pa.table({"n": pa.array([n], pa.int32()), "shard": pa.array([shard], pa.int64())})

    return kept(_dealt(rows, "n", "shard").groupBy("n", "shard").applyInArrow(build, "n int, shard long"), "shards")


#: (index, query ids, query vectors, least scores wanted or None) -> for each query (ids, scores).
Search = Callable[[object, np.ndarray, np.ndarray, list], list[tuple[np.ndarray, np.ndarray]]]


def ask(queries: DataFrame, shards: DataFrame, folder: str, blocks: int, kind: type, run: Search, score_type: str) -> DataFrame:
    """Rows (query_id, key, vec_id, score) that ``run`` finds for ``queries`` (query_id, key, n, shard, vector, floor) in the ``shards`` stored."""
    score = pa.int64() if score_type == "long" else pa.float64()

    def task(group: pa.Table) -> pa.Table:
        index = pickle.loads(fetch(_file(folder, group.column("n")[0].as_py(), group.column("shard")[0].as_py())))
        ids, keys = group.column("query_id").to_numpy(), group.column("key").to_numpy()
        found = run(index, ids, matrix(group.column("vector"), kind), group.column("floor").to_pylist())
        sizes = [len(x) for x, _ in found]
        columns = [np.repeat(ids, sizes), np.repeat(keys, sizes), np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), score), strict=True)], names=["query_id", "key", "vec_id", "score"])

    dealt = queries.join(shards, ["n", "shard"], "left_semi").withColumn("block", F.pmod(F.xxhash64("query_id", "key"), F.lit(blocks)))
    return _dealt(dealt, "n", "shard", "block").groupBy("n", "shard", "block").applyInArrow(task, f"query_id long, key long, vec_id long, score {score_type}")


def best(found: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of each query, ties to smaller ids."""
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
