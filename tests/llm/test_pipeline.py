"""The pipeline's stages, each on its own input, over the smallest tables; queries against their SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm.common import table
from tidemark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
            assert 0 < after.count() <= docs.count()
            assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = after
    assert docs.count() == spark.read.parquet(f"{tmp_path}/{k - 1}").count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda frame: sorted(map(tuple, frame[columns].convert_dtypes().astype(str).values.tolist()))
    assert rows(got) == rows(want)
