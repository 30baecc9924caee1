"""Every registered query against its SQL, at the small scale."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from corpuscade.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


#: What is learned is beyond SQL; tests hold these to brute force.
LEARNED = {"ivf_topk", "ivf_recall", "learned_rerank"}


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) - LEARNED


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"q_id", "doc_id", "chunk_no", "score", "rank"}
