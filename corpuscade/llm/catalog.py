"""The queries of this subpackage by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpuscade.llm import (
    bpe, factorisation, fertility, ftrl, hnsw, icws, kdtree, mixing, packing, run_index, seed_extend, strata, turns,
)
from corpuscade.session import ship_package

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_fertility": fertility.op2_fertility,
    "op3_kdtree_shards": kdtree.op3_kdtree_shards,
    "op4_run_index": run_index.op4_run_index,
    "op5_seed_extend": seed_extend.op5_seed_extend,
    "op6_hnsw": hnsw.op6_hnsw,
    "op7_toxicity": ftrl.op7_toxicity,
    "op8_icws": icws.op8_icws,
    "op9_mixing": mixing.op9_mixing,
    "op10_factorisation": factorisation.op10_factorisation,
    "op11_strata": strata.op11_strata,
    "op12_packing": packing.op12_packing,
    "op13_turns": turns.op13_turns,
}
ORACLE = {"op9_mixing": mixing.OP9_SQL, "op11_strata": strata.OP11_SQL, "op13_turns": turns.OP13_SQL}


def _shipped(query: Callable[[SparkSession, str], DataFrame]):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
