"""Bounded breadth-first crawling of many sites at once, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscade.functions.urls import url_domain, with_normalized_url
from corpuscade.operators.eligibility import FETCH_FAILED, with_skip_reason
from corpuscade.operators.skew import fits_broadcast, lookup_join
from corpuscade.session import fresh_dir, materialize
from corpuscade.sources.pages import ABSENT

_ORDER = ["parent_seq", "link_pos"]
_WALK = "site string, url string, parent_seq int, link_pos long, done int, reason string, level int"
# Buckets of the link store.
LINK_BUCKETS = 64


def store_links(links: DataFrame, sites: DataFrame, path: str, buckets: int = LINK_BUCKETS) -> DataFrame:
    """Write the links whose source lies on one of ``sites(site)``, in buckets of the source's hash.

    A level of a crawl then reads only the buckets its frontier is in.
    """
    own = links.select("src", "href", "link_pos", url_domain(F.col("src")).alias("site"))
    wanted = lookup_join(own, sites.select("site").distinct(), ["site"], "left_semi")
    laid = wanted.select("src", "href", "link_pos", link_bucket(F.col("src"), buckets).alias("bucket"))
    # In ranges, so a source of very many links is not one task's.
    order = ("bucket", "src", "link_pos")
    laid.repartitionByRange(*order).write.partitionBy("bucket").parquet(path)
    return links.sparkSession.read.schema("src string, href string, link_pos long, bucket int").parquet(path)


def link_bucket(src: Column, buckets: int = LINK_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(src), F.lit(buckets)).cast("int")


def crawl_breadth_first(
    sites: DataFrame,
    links: DataFrame,
    status: DataFrame,
    robots: DataFrame,
    max_pages: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Walk ``sites(site, base_url)`` over ``links(src, href, link_pos)``.

    ``status(norm_url, success, error)`` tells how fetching a page turns out.
    Returns ``found(site, seq, url)``, at most ``max_pages`` per site in visiting
    order, and ``skipped(site, url, reason)``.

    A queue hands out pages by (parent's place, link position), and places only
    grow from level to level, so a level can run in parallel and still number its
    pages as the queue would. Every level that goes on adds a page to some site,
    hence there are at most ``max_pages`` + 1 levels. What became of a level's nodes is
    written as a part of one table, which is also the table of what was seen.
    """
    spark = sites.sparkSession
    store = store_links(links, sites, fresh_dir(spark, "links"))
    walk = fresh_dir(spark, "walk")
    start = with_normalized_url(sites, "base_url", out="url")
    nodes = start.select(
        "site", "url", F.lit(0).alias("parent_seq"), F.lit(0).cast("long").alias("link_pos"), F.lit(0).alias("done")
    )
    small_robots, small_sites = fits_broadcast(robots), fits_broadcast(sites)
    everything = spark.read.schema(_WALK)
    for level in range(max_pages + 2):
        _judge(nodes, status, robots, small_robots).write.parquet(f"{walk}/level={level}")
        here = everything.parquet(f"{walk}/level={level}")
        if here.isEmpty():
            break
        accepted = _accept(here.withColumn("level", F.lit(level)), max_pages)
        nodes = _next_level(accepted, store, everything.parquet(walk), max_pages)
    judged = everything.parquet(walk)
    accepted = _accept(judged, max_pages)
    return accepted.select("site", "seq", "url"), _skips(judged, accepted, max_pages, small_sites)


def _judge(nodes: DataFrame, status: DataFrame, robots: DataFrame, small_robots: bool) -> DataFrame:
    """Add ``reason``: why a node is passed over, or null."""
    nodes = materialize(nodes, "frontier")
    status = status.select(F.col("norm_url").alias("url"), "success", "error")
    urls = nodes.select("url").distinct()
    if fits_broadcast(urls):
        # Prune the page table where it lies before anything is shuffled.
        status = status.join(F.broadcast(urls), "url", "left_semi")
    fetched = with_skip_reason(nodes, robots, small=small_robots).join(status, "url", "left")
    error = F.when(F.col("success").isNull(), F.lit(ABSENT)).when(~F.col("success"), F.col("error"))
    judged = fetched.withColumn("reason", F.coalesce("reason", F.concat(F.lit(FETCH_FAILED), error)))
    return judged.select("site", "url", *_ORDER, "done", "reason")


def _accept(judged: DataFrame, max_pages: int) -> DataFrame:
    """Pages taken at each level, numbered on from the earlier ones; ``total`` is the site's count then."""
    own = Window.partitionBy("site", "level")
    taken = (
        judged.where("reason is null")
        .withColumn("_rn", F.row_number().over(own.orderBy(*_ORDER)))
        .where(F.col("_rn") <= max_pages)
        .withColumn("seq", F.col("done") + F.col("_rn"))
        .where(F.col("seq") <= max_pages)
    )
    return taken.withColumn("total", F.max("seq").over(own)).select("site", "level", "url", "seq", "total", *_ORDER)


def _skips(judged: DataFrame, accepted: DataFrame, max_pages: int, small_sites: bool) -> DataFrame:
    """Nodes passed over before the site was full."""
    place = F.struct("level", *_ORDER)
    stop = accepted.where(F.col("seq") == max_pages).select("site", place.alias("_stop"))
    passed = lookup_join(judged.where("reason is not null"), stop, ["site"], "left", small=small_sites)
    return passed.where(F.col("_stop").isNull() | (place < F.col("_stop"))).select("site", "url", "reason")


def _next_level(accepted: DataFrame, store: DataFrame, seen: DataFrame, max_pages: int) -> DataFrame:
    """Same-site link targets not met before, each at its first place."""
    parents = accepted.where(F.col("total") < max_pages).select(
        F.col("url").alias("src"), link_bucket(F.col("url")).alias("bucket"), "site", F.col("seq").alias("parent_seq"), F.col("total").alias("done")
    )
    # With the parents broadcast, partitions of other buckets are not read.
    targets = with_normalized_url(
        lookup_join(store, parents, ["bucket", "src"]).where("href <> ''"), "href", out="url", base="src"
    )
    firsts = (
        targets.where(url_domain(F.col("url")) == F.col("site"))
        .groupBy("site", "url")
        .agg(F.min(F.struct(*_ORDER)).alias("o"), F.max("done").alias("done"))
        .select("site", "url", "o.*", "done")
    )
    return firsts.join(seen.select("site", "url"), ["site", "url"], "left_anti")


def discover_sites(
    sites: DataFrame, from_sitemaps: DataFrame, crawl, max_pages: int = 10
) -> DataFrame:
    """Sitemap pages where a site has any; otherwise what ``crawl(sites)`` finds."""
    bare = sites.join(from_sitemaps.select("site").distinct(), "site", "left_anti")
    walked, _ = crawl(materialize(bare, "sites-without-sitemap"))
    tagged = from_sitemaps.withColumn("source", F.lit("sitemap")).unionByName(
        walked.withColumn("source", F.lit("links"))
    )
    return tagged.where(F.col("seq") <= max_pages)
