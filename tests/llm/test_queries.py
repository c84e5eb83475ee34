"""Queries with SQL against DuckDB, and the pipeline against its stages' parts."""

import duckdb
import pytest

import corpus_pipeline
from probspark.llm import quality, simhash
from probspark.llm.common import table
from probspark.llm.queries import oracle_sql, queries

from pyspark.sql import functions as F

from ..test_oracle import TABLES, assert_equal


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert_equal(queries()[name](spark, sf).toPandas(), con.sql(oracle_sql()[name]).df())


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert out["doc_id"].is_unique and out["round_trip"].all()
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    good = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    once = {r["doc_id"] for r in simhash.near_duplicates(docs.where(F.col("doc_id").isin(list(good)))).where("doc_id = component_id").collect()}
    assert set(out["doc_id"]) <= once <= good
    assert len(corpus_pipeline.STAGES) == 5
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, sf)
        assert stage.columns == docs.columns
