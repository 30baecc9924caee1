"""All queries by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpuscade.plans import crawling, crawling_sql, retrieval, retrieval_sql, streams
from corpuscade.session import ship_package


def _shipped(query: Callable[[SparkSession, str], DataFrame]):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = {**crawling.QUERIES, **retrieval.QUERIES, **streams.QUERIES}
    return {name: _shipped(query) for name, query in every.items()}


def oracle_sql() -> dict[str, str]:
    same = {
        "stream_page_dedup": f"SELECT DISTINCT norm_url FROM ({crawling_sql.LINK_NORMS})",
        "stream_pages": f"""SELECT norm_url, page_id, url, markdown
FROM (SELECT page_id, url, {crawling_sql.normal("url")} AS norm_url FROM pages)
JOIN ({crawling_sql.ORACLE["page_markdown"]}) USING (page_id)
QUALIFY row_number() OVER (PARTITION BY norm_url ORDER BY page_id) = 1""",
        "stream_questions": retrieval_sql.ORACLE["rerank_top3"],
    }
    return {**crawling_sql.ORACLE, **retrieval_sql.ORACLE, **same}
