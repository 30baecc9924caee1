"""What became of every URL of a crawl, in the order it was met."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuscade.functions.urls import page_slug
from corpuscade.operators.ordering import numbered

WRITTEN, FAILED, SKIPPED = "written", "failed", "skipped"


def crawl_log(fetched: DataFrame, order: list[str], output_dir: str) -> DataFrame:
    """``crawl_id, pos, url, outcome, detail`` of ``fetched(crawl_id, url, reason, success, error)``.

    ``detail`` is the file of a page that was written, the error of one that failed, and the
    reason of one that was passed over. ``pos`` counts from 0 in each crawl, which may
    hold any number of URLs; the log is a table, never a list in one row.
    """
    path = F.concat(F.lit(output_dir.rstrip("/") + "/"), page_slug(F.col("url")), F.lit(".md"))
    skipped = F.col("reason").isNotNull()
    outcome = F.when(skipped, SKIPPED).when(F.col("success"), WRITTEN).otherwise(FAILED)
    detail = F.when(skipped, F.col("reason")).when(F.col("success"), path).otherwise(F.col("error"))
    return numbered(fetched, order, by=("crawl_id",)).select(
        "crawl_id", "pos", "url", outcome.alias("outcome"), detail.alias("detail")
    )


def skips(judged: DataFrame, order: list[str]) -> DataFrame:
    """``crawl_id, pos, url, reason`` of the URLs passed over, numbered from 0 in each crawl."""
    passed = judged.where("reason is not null")
    return numbered(passed, order, by=("crawl_id",)).select("crawl_id", "pos", "url", "reason")
