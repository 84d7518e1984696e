from collections import Counter

from pyspark.sql import functions as F

from siftwell.llm import shared


def test_salted_ranks_number_each_key_without_gaps(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i % 5, i) for i in range(500)], "key long, id long")
    for per_salt in (7, 10_000):
        got = shared.salted_rank(rows, "key", ["id"], per_salt).collect()
        assert len(got) == 500
        for key in {r["key"] for r in got}:
            ranks = sorted(r["rank"] for r in got if r["key"] == key)
            assert ranks == list(range(len(ranks)))
    assert shared.salted_rank(rows.limit(0), "key", ["id"]).count() == 0


def test_sampled_ids_are_bounded_distinct_and_repeatable(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(4000)] + [(None, 1), (3, None), (5, 1)], "id long, y int")
    got = shared.sampled_ids(rows, "id", "y", {1: 50, 0: 10}).collect()
    assert Counter(r["class"] for r in got) == {1: 50, 0: 10} and len({r["id"] for r in got}) == 60
    again = shared.sampled_ids(rows.repartition(7), "id", "y", {1: 50, 0: 10}).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert shared.sampled_ids(rows.limit(0), "id", "y", {1: 5}).count() == 0


def test_tables_keep_rows_and_go(spark):
    table = shared.Table(spark.range(5).withColumn("x", F.lit(None).cast("string")), "test")
    assert table.df.count() == 5 and table.df.columns == ["id", "x"]
    table.drop()


def test_the_named_folder_is_read_from_the_session(spark):
    assert shared.shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or shared.LOCAL_FOLDER)
