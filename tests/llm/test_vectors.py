import math
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import lsh_forest, mtree

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 16)).astype(np.float32)
    rows = [(i, base[i].tolist(), 0) for i in range(400)]
    rows += [(1000 + i, base[7].tolist(), 1) for i in range(60)]  # copies: ties
    rows += [(2000, None, 0), (2001, [1.0, None], 0), (2002, [NAN] * 16, 0), (2003, [INF] * 16, 0), (2004, [0.0] * 16, 0), (None, base[1].tolist(), 0), (2100, [1.0, 2.0], 0), (2101, [3.0, 4.0], 0)]
    rows += [(5, base[5].tolist(), 0)]  # a repeated row
    return table(spark, rows), rows


def usable(rows):
    return [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


def brute(rows, every, k, score):
    want = {}
    for q, a in [(i, v) for i, v in rows if i % every == 0]:
        scored = sorted(((-score(a, b), i) for i, b in rows if i != q and len(a) == len(b)))[:k]
        want[q] = [(i, -s) for s, i in scored]
    return want


def test_top_k_is_exact(spark, mixed):
    df, rows = mixed
    whole = [(i, np.floor(v * 1024).astype(np.int64)) for i, v in usable(rows)]
    want = brute(whole, 100, 10, lambda a, b: int(a @ b))
    got = {}
    for r in mtree.top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {q: v for q, v in want.items() if v}


def test_top_k_over_several_shards_and_blocks(spark, mixed, monkeypatch):
    monkeypatch.setattr(mtree.top_k, "__defaults__", (*mtree.top_k.__defaults__[:-2], 32, 3))
    test_top_k_is_exact(spark, mixed)


def test_tree_skips_computations_and_agrees(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (40, 8))
    rows = centres[rng.integers(0, 40, 5000)] + rng.integers(-20, 20, (5000, 8))
    tree = mtree.MTree(rows)
    for q in rows[:20]:
        found, values = tree.nearest(q, 5)
        products = rows @ q
        assert sorted(values.tolist(), reverse=True)[:5] == np.sort(products)[::-1][:5].tolist()
        assert (products[found] == values).all()
    assert tree.skipped > 0 and tree.computed < 20 * len(rows) / 4
    assert mtree.MTree(np.zeros((0, 3), np.int64)).nearest(np.zeros(3, np.int64), 2)[0].size == 0


def test_few_and_no_rows(spark):
    assert mtree.top_k(table(spark, [])).count() == 0 and lsh_forest.neighbours(table(spark, [])).count() == 0
    rows = mtree.top_k(table(spark, [(0, [1.0], 0), (1, [2.0], 0)])).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert mtree.top_k(table(spark, [(0, [1.0], 0)])).count() == 0


def test_forest_scores_ties_and_recall(spark, mixed, small):
    df, rows = mixed
    good = [(i, v) for i, v in usable(rows) if v.any()]
    cosine = lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
    want = brute(good, 50, 5, cosine)
    got = {}
    for r in lsh_forest.neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {q for q, v in want.items() if v}
    vectors = dict(good)
    for q, found in got.items():
        assert len(found) == len(want[q])
        assert all(s == pytest.approx(cosine(vectors[q], vectors[i]), abs=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    assert hits / sum(len(v) for v in want.values()) >= 0.9
    assert [i for i, _ in got[1050]] == [7, 1000, 1001, 1002, 1003]  # copies tie to smaller ids


def test_large_components_take_part_exactly(spark):
    vectors = {0: [3e5, 1.0], 1: [4e5, 0.5], 2: [1.0, 2.0], 3: [4e5, 0.25], 100: [2e6, -3.0], 101: [3e6, 1e6], 102: [-3e12, 1.0], 200: [1e-3, 0.0], 300: [0.0, 0.0]}
    whole = {i: [math.floor(x * 1024) for x in v] for i, v in vectors.items()}
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_k(table, k=3).collect())
    wanted = []
    for q in (0, 100, 200, 300):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
        wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:3])]
    assert got == wanted


def test_scores_are_exact_over_shards_of_unlike_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-(1 << 12), 1 << 12, 64) + (rng.integers(0, 1 << 17, 64) if i % 300 == 0 else 0)).tolist()) for i in range(900)]
    whole = {i: [1024 * x for x in v] for i, v in rows}
    got = {}
    for r in mtree.top_k(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>"), shard_rows=50, query_rows=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in range(0, 900, 100):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:10]
        assert got[q] == [(i, -s) for s, i in scored]


def test_query_rows_of_one_id_are_asked_each(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (100, [0.0, 1.0], 1), (10, [2.0, 1.0], 1), (11, [1.0, 2.0], 1), (12, [0.5, 0.5], 1)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").withColumn("score", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("key", F.lit(2))
    for found in (mtree.top_k(data, k=2), lsh_forest.neighbours(data, k=2)):
        by_rank = sorted((r["rank"], r["vec_id"]) for r in found.collect())
        assert len(by_rank) == 4 and [r for r, _ in by_rank] == [1, 1, 2, 2] and {v for r, v in by_rank if r == 1} == {10, 11}


def test_hot_vectors_and_hot_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1, 400)] + [(500, [1.0, 2.0, 3.0])] * 300 + [(1000, [3.0, 2.0, 1.0])] + [(2000 + i, [float(i % 7), 1.0, 1.0]) for i in range(1, 300)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in mtree.top_k(data, shard_rows=40, query_rows=2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = [(i, np.array(v, np.int64) * 1024) for i, v in rows]
    asked = {}
    for q, a in whole:
        if q % 100 == 0 and q not in asked:
            asked[q] = [(i, -s) for s, i in sorted((-int(a @ b), i) for i, b in whole if i != q)[:10]]
    assert got == asked


def test_a_query_skips_shards_out_of_reach(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 16)) * 40
    router = mtree.Router((centres * 1024).astype(np.int64), 0.0)
    rows = ((centres[rng.integers(0, 20, 4000)] + rng.standard_normal((4000, 16)) * 0.1) * 1024).astype(np.float64)
    router.most = float((rows * rows).sum(1).max())
    owner, distance = router.rows(rows)
    router.radii, router.salts = np.array([distance[owner == i].max(initial=0) for i in range(20)]), np.ones(20, np.int64)
    low, sizes = router.queries(rows[:50])
    kth = np.sort(rows[:50] @ rows.T, 1)[:, -11]
    reach = np.sqrt(sizes + router.most - 2 * kth)
    opened = low <= (reach + router.slack(sizes))[:, None]
    assert opened[:, :].sum() < 50 * 20 / 2
    for i in range(50):
        best = np.argsort(-(rows @ rows[i]))[:10]
        assert opened[i, owner[best]].all()
