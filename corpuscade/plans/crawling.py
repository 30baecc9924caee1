"""Crawl-side queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuscade.functions import html as hx
from corpuscade.functions.urls import (
    is_content_url,
    page_slug,
    url_domain,
    with_normalized_url,
    with_resolved_url,
)
from corpuscade.operators import crawl_log as crawl_log_, frontier, robots as rb, sitemaps as sm
from corpuscade.operators.eligibility import with_skip_reason
from corpuscade.operators.topk import first_per_key
from corpuscade.plans import derived
from corpuscade.session import fresh_dir, materialize, plain
from corpuscade.sources import pages as pg

MAX_PAGES = 10
OUTPUT_DIR = "data"


def _robots(pages: DataFrame) -> DataFrame:
    return materialize(rb.parse_robots(derived.robots_texts(pages)), "robots")


def url_domains(spark, sf_dir):
    pages = pg.read_pages(spark, sf_dir)
    return pages.select("page_id", url_domain(F.col("url")).alias("domain"))


def url_resolve(spark, sf_dir):
    links = derived.link_targets(pg.read_pages(spark, sf_dir))
    return plain(with_resolved_url(links, "url", "href", "resolved").select("page_id", "pos", "resolved"))


def url_normalize(spark, sf_dir):
    pages = pg.read_pages(spark, sf_dir)
    own = with_normalized_url(pages, "url").select("page_id", F.lit(-1).alias("pos"), "norm_url")
    links = with_normalized_url(derived.link_targets(pages), "href", base="url")
    return plain(own.unionByName(links.select("page_id", "pos", "norm_url")))


def content_url_filter(spark, sf_dir):
    urls = derived.candidates(pg.read_pages(spark, sf_dir))
    return plain(urls.where(is_content_url(F.col("url"))))


def page_slugs(spark, sf_dir):
    pages = pg.read_pages(spark, sf_dir)
    return pages.select("page_id", page_slug(F.col("url")).alias("slug"))


def url_dedup(spark, sf_dir):
    urls = with_normalized_url(derived.candidates(pg.read_pages(spark, sf_dir)), "url")
    firsts = first_per_key(urls, ["norm_url"], [F.col("page_id"), F.col("pos")])
    return plain(firsts.select("norm_url", "page_id", "pos"))


def crawl_fetch(spark, sf_dir):
    pages = pg.read_pages(spark, sf_dir)
    store = pg.page_store(pages)
    return plain(pg.fetch(derived.candidates(pages), store).select("page_id", "pos", "url", "success", "error"))


def crawl_halves(spark, sf_dir):
    """The request list as two crawls: for each its pages to be written, as Markdown."""
    pages = pg.read_pages(spark, sf_dir)
    fetched = materialize(pg.fetch(derived.requests(pages), pg.page_store(pages)), "fetched")
    half = fetched.agg(F.expr("cast(max(pos) / 2 as long)").alias("p")).first()["p"] or 0
    for part in (F.col("pos") <= half, F.col("pos") > half):
        yield pg.to_markdown(pg.with_html(pg.sink_winners(fetched.where(part), "pos"), pages))


def crawled_pages(spark, sf_dir):
    """Crawl the request list into a folder, in two crawls, and read what both left there."""
    out = fresh_dir(spark, "pages")
    for crawl_id, winners in enumerate(crawl_halves(spark, sf_dir), 1):
        pg.write_pages(winners, out, str(crawl_id))
    return pg.read_written(spark, out)


def page_sink(spark, sf_dir):
    """What a sink holds after two crawls: every page, the later crawl's where both met it."""
    return crawled_pages(spark, sf_dir)


def crawl_manifest(spark, sf_dir):
    pages = pg.read_pages(spark, sf_dir)
    fetched = pg.fetch(derived.candidates(pages), pg.page_store(pages))
    path = pg.write_manifest(pg.manifest(fetched, OUTPUT_DIR), fresh_dir(spark, "crawl"))
    return pg.read_manifest(spark, path)


def _judged_requests(pages: DataFrame) -> DataFrame:
    urls = derived.candidates(pages).withColumn("site", url_domain(F.col("url")))
    return with_skip_reason(urls, _robots(pages))


def crawl_eligibility(spark, sf_dir):
    judged = _judged_requests(pg.read_pages(spark, sf_dir))
    return plain(judged.select("page_id", "pos", "url", "reason"))


def crawl_list(spark, sf_dir):
    """Crawl exactly the listed URLs: eligible ones only, spelled and repeated as given."""
    pages = pg.read_pages(spark, sf_dir)
    listed = derived.requests(pages).withColumn("site", url_domain(F.col("url")))
    allowed = with_skip_reason(listed, _robots(pages)).where("reason is null")
    fetched = pg.fetch(allowed, pg.page_store(pages))
    return pg.manifest(fetched, OUTPUT_DIR)


def crawl_report(spark, sf_dir):
    """Attempted, written and skipped counts per site and over all (site null)."""
    pages = pg.read_pages(spark, sf_dir)
    judged = _judged_requests(pages)
    fetched = pg.fetch(judged, pg.page_store(pages))
    tried = F.col("reason").isNull()
    return fetched.rollup("site").agg(
        F.count_if(tried).alias("urls_attempted"),
        F.count_if(tried & F.col("success")).alias("pages_written"),
        F.count_if(~tried).alias("skipped"),
    )


def _site_crawls(pages: DataFrame) -> DataFrame:
    """The candidates as crawls, one for each site, with what fetching them gives."""
    return pg.fetch(_judged_requests(pages), pg.page_store(pages)).withColumnRenamed("site", "crawl_id")


def crawl_skips(spark, sf_dir):
    """Every URL a site's crawl passed over, in order, and why."""
    judged = _judged_requests(pg.read_pages(spark, sf_dir)).withColumnRenamed("site", "crawl_id")
    return plain(crawl_log_.skips(judged.withColumnRenamed("pos", "link_pos"), ["page_id", "link_pos"]))


def crawl_log(spark, sf_dir):
    """The whole report of each site's crawl: what became of every URL, in order."""
    fetched = _site_crawls(pg.read_pages(spark, sf_dir)).withColumnRenamed("pos", "link_pos")
    return plain(crawl_log_.crawl_log(fetched, ["page_id", "link_pos"], OUTPUT_DIR))


def html_nesting(spark, sf_dir):
    """Boilerplate cut from pages in which it is nested, unclosed, and in comments and scripts."""
    pages = derived.nested_pages(pg.read_pages(spark, sf_dir))
    return pages.select("page_id", hx.strip_boilerplate(F.col("html")).alias("stripped"))


def html_strip(spark, sf_dir):
    pages = pg.read_pages(spark, sf_dir)
    return pages.select("page_id", hx.strip_boilerplate(F.col("html")).alias("stripped"))


def block_prune(spark, sf_dir):
    pages = pg.read_pages(spark, sf_dir)
    scored = hx.scored_blocks(hx.blocks(hx.strip_boilerplate(F.col("html"))))
    rows = pages.select("page_id", F.posexplode(scored).alias("pos", "b"))
    return plain(rows.select("page_id", "pos", "b.tag", "b.text", "b.score", "b.keep"))


def page_markdown(spark, sf_dir):
    return pg.to_markdown(pg.read_pages(spark, sf_dir)).select("page_id", "markdown")


def link_extract(spark, sf_dir):
    links = derived.link_targets(pg.read_pages(spark, sf_dir))
    return plain(links.select("page_id", "pos", "href"))


def link_internal(spark, sf_dir):
    """Same-site link targets, each at its first place on the site."""
    links = with_normalized_url(derived.link_targets(pg.read_pages(spark, sf_dir)), "href", out="target", base="url")
    inside = links.withColumn("site", url_domain(F.col("url"))).where(url_domain(F.col("target")) == F.col("site"))
    firsts = first_per_key(inside, ["site", "target"], [F.col("page_id"), F.col("pos")])
    return plain(firsts.select("site", "target", "page_id", "pos"))


def robots_rules(spark, sf_dir):
    rules = rb.parse_robots(derived.robots_texts(pg.read_pages(spark, sf_dir)))
    return plain(rules.select("site", F.inline("rules")))


def robots_allowed(spark, sf_dir):
    pages = pg.read_pages(spark, sf_dir)
    urls = derived.located(pages).select("page_id", "url", "site")
    return rb.with_allowed(urls, _robots(pages)).select("page_id", "allowed")


def robots_sitemaps(spark, sf_dir):
    pages = pg.read_pages(spark, sf_dir)
    return plain(rb.site_sitemaps(derived.sites(pages), _robots(pages)))


def sitemap_parse(spark, sf_dir):
    parsed = sm.parse_sitemaps(derived.sitemap_docs(pg.read_pages(spark, sf_dir)))
    rows = parsed.select("sitemap_url", "kind", "error", F.posexplode_outer("locs").alias("pos", "loc"))
    return plain(rows)


def sitemap_expand(spark, sf_dir):
    pages = pg.read_pages(spark, sf_dir)
    roots = rb.site_sitemaps(derived.sites(pages), _robots(pages))
    expanded = sm.expand_sitemaps(roots, materialize(sm.parse_sitemaps(derived.sitemap_docs(pages)), "parsed"))
    path = F.array_join(F.transform("path", lambda i: i.cast("string")), ".")
    return plain(expanded.withColumn("path", path))


def _sitemap_discovery(pages: DataFrame):
    robots = _robots(pages)
    roots = materialize(rb.site_sitemaps(derived.sites(pages), robots), "roots")
    return sm.discover_from_sitemaps(roots, derived.sitemap_docs(pages), robots, MAX_PAGES)


def sitemap_discovery(spark, sf_dir):
    found, skipped = _sitemap_discovery(pg.read_pages(spark, sf_dir))
    return plain(found.withColumn("reason", F.lit(None).cast("string")).unionByName(skipped, allowMissingColumns=True))


def _walk(pages: DataFrame, sites: DataFrame):
    status = derived.graph_status(pages, pg.page_store(pages))
    return frontier.crawl_breadth_first(
        materialize(sites, "sites"),
        derived.link_graph(pages),
        materialize(status, "status"),
        _robots(pages),
        MAX_PAGES,
    )


def bfs_crawl(spark, sf_dir):
    pages = pg.read_pages(spark, sf_dir)
    found, skipped = _walk(pages, derived.sites(pages))
    return plain(found.withColumn("reason", F.lit(None).cast("string")).unionByName(skipped, allowMissingColumns=True))


def site_discovery(spark, sf_dir):
    pages = pg.read_pages(spark, sf_dir)
    found, _ = _sitemap_discovery(pages)
    return plain(frontier.discover_sites(derived.sites(pages), found, lambda s: _walk(pages, s), MAX_PAGES))


QUERIES = {
    "url_domain": url_domains,
    "page_slug": page_slugs,
    **{
        f.__name__: f
        for f in (
            url_resolve, url_normalize, content_url_filter, url_dedup, crawl_fetch, page_sink,
            crawl_manifest, crawl_eligibility, crawl_list, crawl_report, crawl_skips, crawl_log, html_strip, html_nesting,
            block_prune,
            page_markdown, link_extract, link_internal, robots_rules, robots_allowed, robots_sitemaps,
            sitemap_parse, sitemap_expand, sitemap_discovery, bfs_crawl, site_discovery,
        )
    },
}
