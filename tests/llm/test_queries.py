"""The registered queries: SQL where there is some, the pipeline end to end."""

import sys

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from corpuscade.llm import catalog

sys.path.insert(0, entry.__file__.rsplit("/", 1)[0])
import corpus_pipeline  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert difference(catalog.queries()[name](spark, sf_dir), connect(sf_dir), catalog.oracle_sql()[name]) is None


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in catalog.queries()] == [f"op{k}" for k in range(1, 14)]
    assert set(catalog.queries()) | {"pipeline"} <= set(entry.queries())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before, seen = docs.columns, docs.count(), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append(docs.count())
    quality, near, strings, mixed, tokens = seen
    assert before >= quality >= near == strings and mixed == tokens > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == tokens
