"""Sitemaps: parsing, nested expansion in reading order, and page discovery."""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from corpuscade.functions.urls import url_domain, with_normalized_url
from corpuscade.operators.eligibility import with_skip_reason
from corpuscade.operators.skew import lookup_join
from corpuscade.operators.topk import first_per_key
from corpuscade.session import discard, materialize

# Fixed value: only elements of this namespace count.
NAMESPACE = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
MALFORMED = "malformed XML"
UNREACHABLE = "not reachable"
# Fixed value: how the skip log begins the reason of a sitemap that could not be read.
FAILED = "sitemap fetch/parse failed: "

_PARSED = (
    StructType().add("kind", StringType()).add("error", StringType()).add("locs", ArrayType(StringType()))
)
_PARSED_ARROW = pa.struct(
    [("kind", pa.string()), ("error", pa.string()), ("locs", pa.list_(pa.string()))]
)
_ROOT = ["site", "root_pos"]


def _parse_one(xml: str | None) -> dict:
    if xml is None:
        return {"kind": None, "error": UNREACHABLE, "locs": []}
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return {"kind": None, "error": MALFORMED, "locs": []}
    for kind, outer, item in (("index", "sitemapindex", "sitemap"), ("urlset", "urlset", "url")):
        if root.tag == NAMESPACE + outer:
            found = (e.find(NAMESPACE + "loc") for e in root.findall(NAMESPACE + item))
            locs = [e.text.strip() for e in found if e is not None and e.text]
            return {"kind": kind, "error": None, "locs": locs}
    return {"kind": "other", "error": None, "locs": []}


@F.arrow_udf(_PARSED)
def _parse(xml: pa.Array) -> pa.Array:
    return pa.array([_parse_one(x) for x in xml.to_pylist()], type=_PARSED_ARROW)


def parse_sitemaps(docs: DataFrame) -> DataFrame:
    """``(sitemap_url, kind, error, locs)`` from ``(sitemap_url, xml)``; bad XML is a row, not a failure."""
    return docs.select("sitemap_url", _parse("xml").alias("p")).select("sitemap_url", "p.*")


def expand_sitemaps(roots: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every sitemap reached from ``roots(site, root_pos, sitemap_url)``.

    A reader goes depth first and opens each sitemap once per root. Its place in
    that order is the smallest position path that visits no sitemap twice, so the
    loop keeps one smallest path per sitemap and extends only those that improved.
    """
    links = materialize(
        parsed.where("kind = 'index'").select("sitemap_url", F.posexplode("locs").alias("_pos", "_child")),
        "sitemap-links",
    )
    new = materialize(
        roots.select(
            *_ROOT,
            "sitemap_url",
            F.array().cast("array<int>").alias("path"),
            F.array("sitemap_url").alias("trail"),
        ),
        "sitemaps",
    )
    best = new
    key = [*_ROOT, "sitemap_url"]
    while True:
        reached = (
            lookup_join(links, new, ["sitemap_url"])
            .where(~F.array_contains("trail", F.col("_child")))
            .select(
                *_ROOT,
                F.col("_child").alias("sitemap_url"),
                F.concat("path", F.array("_pos")).alias("path"),
                F.concat("trail", F.array("_child")).alias("trail"),
            )
        )
        smallest = reached.groupBy(*key).agg(F.min(F.struct("path", "trail")).alias("s")).select(*key, "s.*")
        old = best.select(*key, F.col("path").alias("_old"))
        earlier, improved = best, new
        new = materialize(
            smallest.join(old, key, "left").where("_old is null or path < _old").drop("_old"), "sitemaps"
        )
        if new.isEmpty():
            return best.drop("trail")
        best = materialize(best.join(new.select(*key), key, "left_anti").unionByName(new), "sitemaps")
        discard(earlier, improved)


def sitemap_entries(expanded: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page locations per root in reading order, and the roots that failed.

    One sitemap that cannot be read takes its whole root with it.
    """
    opened = lookup_join(expanded, parsed, ["sitemap_url"], "left").withColumn(
        "error", F.when(F.col("locs").isNull(), F.lit(UNREACHABLE)).otherwise(F.col("error"))
    )
    failed = (
        opened.where("error is not null")
        .groupBy(*_ROOT)
        .agg(F.min(F.struct("path", "error")).alias("f"))
        .select(*_ROOT, F.concat(F.lit(FAILED), F.col("f.error")).alias("reason"))
    )
    whole = lookup_join(opened.where("kind = 'urlset'"), failed, _ROOT, "left_anti")
    entries = whole.select(*_ROOT, "sitemap_url", "path", F.posexplode("locs").alias("pos", "loc"))
    return entries, failed


def discover_from_sitemaps(
    roots: DataFrame, docs: DataFrame, robots: DataFrame, max_pages: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Pages found per site, and what was skipped on the way.

    Returns ``found(site, seq, url)`` with at most ``max_pages`` per site in
    reading order, and ``skipped(site, url, reason)`` up to where reading stopped.
    """
    parsed = materialize(parse_sitemaps(docs), "parsed-sitemaps")
    entries, failed = sitemap_entries(expand_sitemaps(roots, parsed), parsed)
    order = ["root_pos", "path", "pos"]
    listed = with_normalized_url(entries, "loc", out="url")
    listed = listed.where(url_domain(F.col("url")) == F.col("site")).select("site", "url", *order)
    judged = materialize(with_skip_reason(listed, robots), "sitemap-urls")

    firsts = first_per_key(judged.where("reason is null"), ["site", "url"], [F.col(c) for c in order])
    by_place = Window.partitionBy("site").orderBy(*order)
    found = firsts.withColumn("seq", F.row_number().over(by_place)).where(F.col("seq") <= max_pages)
    found = materialize(found.select("site", "seq", "url", *order), "sitemap-found")

    stop = found.where(F.col("seq") == max_pages).select("site", F.struct(*order).alias("_stop"))
    passed = lookup_join(judged.where("reason is not null"), stop, ["site"], "left").where(
        "_stop is null or struct(root_pos, path, pos) < _stop"
    )
    lost = lookup_join(
        failed.join(roots, _ROOT), stop, ["site"], "left"
    ).where("_stop is null or root_pos < _stop.root_pos")
    skipped = passed.select("site", "url", "reason").unionByName(
        lost.select("site", F.col("sitemap_url").alias("url"), "reason")
    )
    return found.select("site", "seq", "url"), skipped
