import duckdb
import pytest

import corpus_pipeline
from siftwell.llm import queries
from siftwell.llm.packing import CAPACITY


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_whole_tables(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    result = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(result.fetchall())


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    left, counts = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, small).cache()
        assert left.columns == docs.columns
        counts.append(left.count())
    assert docs.count() >= counts[0] >= counts[1] > counts[2] > 0
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in left.collect()}
    assert all(0 <= r["offset"] and r["offset"] + r["length"] <= CAPACITY for r in rows)
