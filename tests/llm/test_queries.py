"""The registered queries beside their SQL, and the pipeline stage by stage."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import check
import corpus_pipeline
from wattgrid.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    note, good = check.compare(spark, duck, name, QUERIES[name], SQL[name], SF)
    assert good, note


@pytest.mark.parametrize("name,table", [("op1_sentencepiece", "documents"), ("op5_html_extract", "pages"), ("op7_language_id", "documents"), ("op9_quality_rules", "documents")])
def test_one_row_each(spark, name, table):
    found = QUERIES[name](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name.startswith("op1_"):
        assert found.where("not lossless or lossless is null").count() == 0


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        assert docs.columns[:len(names)] == names
    assert counts[0] == counts[1] > counts[2] >= counts[3] > 0
    assert docs.where(F.size("ids") != F.col("n_ids")).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, stage):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "some words here", None, "s", 1), (2, "some words here", None, "s", 1), (3, "!!", "en", None, 2), (4, "long " * 200_000, "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"row": F.lit(1), "size": F.lit(2), "gone_id": F.lit(3)})
    found = stage(spark, docs, SF)
    assert found.columns[:len(docs.columns)] == docs.columns
    texts = {r["text"] for r in found.collect()}
    assert {"some words here", "long " * 200_000} & texts
    assert stage(spark, docs.limit(0), SF).collect() == []
