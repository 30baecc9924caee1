"""May a URL be crawled, and if not, why."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuscade.functions.urls import is_content_url
from corpuscade.operators.robots import with_allowed

# Reasons as they appear in skip logs.
NON_CONTENT = "non-content extension"
DISALLOWED = "disallowed by robots.txt"
FETCH_FAILED = "fetch failed: "


def with_skip_reason(
    urls: DataFrame, robots: DataFrame, url: str = "url", small: bool | None = None
) -> DataFrame:
    """Add ``reason``: null when ``url`` may be crawled; the extension is looked at first."""
    judged = with_allowed(urls, robots, url, out="_allowed", small=small)
    return judged.withColumn(
        "reason",
        F.when(~is_content_url(F.col(url)), F.lit(NON_CONTENT)).when(~F.col("_allowed"), F.lit(DISALLOWED)),
    ).drop("_allowed")
