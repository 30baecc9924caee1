"""Crawl inputs that ``pages`` does not hold, derived from it: sites, robots texts,
sitemap documents, and a link graph. All grow with ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuscade.functions import html as hx
from corpuscade.functions.urls import PATH, url_domain, url_parts, with_normalized_url

_XMLNS = "http://www.sitemaps.org/schemas/sitemap/0.9"
ROBOTS_CLASSES = 6
SITEMAP_CLASSES = 5
# Endings that turn a page's URL into one more candidate, by page number.
ASSET_ENDINGS = (".pdf", ".jpg", ".PNG", ".js?v=1", ".tar.gz", ".htm", "", "?file=a.zip")


def digest(text: Column, modulo: int) -> Column:
    """A number below ``modulo`` that any engine can derive from the text."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(modulo))


def located(pages: DataFrame) -> DataFrame:
    """Pages with ``site`` (their host) and ``path``."""
    return pages.select(
        "page_id", "url", url_domain(F.col("url")).alias("site"), url_parts(F.col("url"))[PATH].alias("path")
    )


def sites(pages: DataFrame) -> DataFrame:
    hosts = pages.select(url_domain(F.col("url")).alias("site")).distinct()
    return hosts.withColumn("base_url", F.concat(F.lit("https://"), "site", F.lit("/")))


def robots_texts(pages: DataFrame) -> DataFrame:
    """One robots text per site; its paths are the site's first and last page path."""
    hosts = located(pages).groupBy("site").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    index = F.concat(F.lit("Sitemap: https://"), "site", F.lit("/sitemap_index.xml\n"))
    folder = F.regexp_extract("lo", "^(/[^/]*)", 1)
    texts = (
        F.when(F.col("kind") == 1, F.concat(F.lit("User-agent: *\nDisallow:\n"), index))
        .when(
            F.col("kind") == 2,
            F.concat(F.lit("User-agent: *\nAllow: "), "lo", F.lit("\nDisallow: "), folder, F.lit("/\n"), index),
        )
        .when(
            F.col("kind") == 3,
            F.concat(
                F.lit("User-agent: badbot\nDisallow: /\n\nUser-agent: *\nDisallow: "), "hi",
                F.lit(" # closed\nAllow: "), "hi", F.lit("\n"),
            ),
        )
        .when(
            F.col("kind") == 4,
            F.concat(
                F.lit("User-agent: *\nDisallow: "), "lo", F.lit("\n\nUser-agent: *\nDisallow: /\n\n"), index
            ),
        )
        .when(
            F.col("kind") == 5,
            F.concat(
                F.lit("User-agent: somebot\nDisallow: /\n"), index,
                F.lit("Sitemap: https://"), "site", F.lit("/missing.xml\n"),
            ),
        )
    )
    return hosts.withColumn("kind", digest(F.col("site"), ROBOTS_CLASSES)).select("site", texts.alias("txt"))


def _element(kind: str, item: str, locs: Column) -> Column:
    """An XML document listing ``locs``."""
    items = F.transform(
        locs, lambda u: F.concat(F.lit(f"<{item}><loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit(f"</loc></{item}>"))
    )
    return F.concat(F.lit(f'<{kind} xmlns="{_XMLNS}">'), F.array_join(items, ""), F.lit(f"</{kind}>"))


def sitemap_parts(pages: DataFrame) -> DataFrame:
    """Each page with the part of its site's sitemap it goes to.

    A site of n pages has about sqrt(n) parts of about sqrt(n) pages, so neither
    a part nor the index over the parts grows with the site itself.
    """
    placed = located(pages).withColumn("kind", digest(F.concat(F.lit("s"), "site"), SITEMAP_CLASSES))
    sizes = placed.groupBy("site").agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("n_parts"))
    return placed.join(sizes, "site").withColumn("part", F.pmod(digest(F.col("url"), 1 << 32), F.col("n_parts")))


def sitemap_docs(pages: DataFrame) -> DataFrame:
    """``(sitemap_url, xml)``: per site an index, an early index, and the parts.

    The index lists the early index, every part, itself and an empty entry; the
    early index lists the last part, which is therefore read first, and the index
    again. A part also lists a foreign page, its first page again and a blank. Sites of kind 3 have a part that breaks off, sites of kind 4 use a
    foreign namespace for their parts.
    """
    parts = sitemap_parts(pages)
    groups = parts.groupBy("site", "kind", "n_parts", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"]).alias("urls")
    )
    base = F.concat(F.lit("https://"), "site")
    part_url = F.concat(base, F.lit("/part-"), F.col("part").cast("string"), F.lit(".xml"))
    foreign = F.lit("http://other.example.org/x")
    good = _element("urlset", "url", F.concat("urls", F.array(foreign), F.slice("urls", 1, 1), F.array(F.lit(" "))))
    leaf = groups.select(
        part_url.alias("sitemap_url"),
        F.when((F.col("kind") == 3) & (F.col("part") == 0), F.substring(good, 1, 80))
        .when(F.col("kind") == 4, F.replace(good, F.lit(_XMLNS), F.lit("http://other.example.org/ns")))
        .otherwise(good)
        .alias("xml"),
    )
    tops = parts.groupBy("site", "n_parts").agg(F.sort_array(F.collect_set("part")).alias("ks"))
    urls = F.transform("ks", lambda k: F.concat(base, F.lit("/part-"), k.cast("string"), F.lit(".xml")))
    early = F.concat(base, F.lit("/early.xml"))

    def index(name: str) -> Column:
        return F.concat(base, F.lit(f"/{name}"))

    def top(name: str) -> DataFrame:
        return tops.select(
            index(name).alias("sitemap_url"),
            _element(
                "sitemapindex", "sitemap", F.concat(F.array(early), urls, F.array(index(name), F.lit("")))
            ).alias("xml"),
        )

    early_doc = tops.select(
        early.alias("sitemap_url"),
        _element("sitemapindex", "sitemap", F.array(F.element_at(urls, -1), index("sitemap_index.xml"))).alias("xml"),
    )
    return leaf.unionByName(top("sitemap_index.xml")).unionByName(top("sitemap.xml")).unionByName(early_doc)


def link_targets(pages: DataFrame) -> DataFrame:
    """Links as they stand in the pages: ``page_id, url, pos, href``."""
    return pages.select("page_id", "url", F.posexplode(hx.hrefs(F.col("html"))).alias("pos", "href"))


def candidates(pages: DataFrame) -> DataFrame:
    """Every link target, and per page one asset-like variant of its own URL: ``page_id, pos, url``."""
    links = with_normalized_url(link_targets(pages), "href", out="target", base="url")
    endings = F.array(*[F.lit(e) for e in ASSET_ENDINGS])
    ending = F.get(endings, F.pmod(F.col("page_id"), F.lit(len(ASSET_ENDINGS))).cast("int"))
    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"/$", "")
    assets = pages.select("page_id", F.lit(-1).alias("pos"), F.concat(bare, ending).alias("url"))
    return links.select("page_id", "pos", F.col("target").alias("url")).unionByName(assets)


def requests(pages: DataFrame) -> DataFrame:
    """An explicit crawl list: each page's URL, then its normalised spelling: ``pos, url``."""
    both = with_normalized_url(pages.select("page_id", "url"), "url")
    return both.select(
        F.posexplode(F.array("url", "norm_url")).alias("_i", "url"), "page_id"
    ).select((F.col("page_id") * 2 + F.col("_i")).alias("pos"), "url")


def link_graph(pages: DataFrame) -> DataFrame:
    """``src, href, link_pos``: home page to folders, folders to pages, pages home and to their links."""
    placed = with_normalized_url(located(pages), "url")
    home = F.concat(F.lit("https://"), "site", F.lit("/"))
    folder = F.regexp_extract("path", "^(/[^/]*)", 1)
    folders = placed.groupBy("site", folder.alias("href")).agg(F.min("page_id").alias("link_pos"))
    down = folders.select(home.alias("src"), "href", "link_pos")
    leaves = placed.select(
        F.concat(F.lit("https://"), "site", folder).alias("src"), F.col("url").alias("href"), F.col("page_id").alias("link_pos")
    )
    back = placed.select(F.col("norm_url").alias("src"), home.alias("href"), F.lit(0).cast("long").alias("link_pos"))
    own = with_normalized_url(link_targets(pages), "url").select(
        F.col("norm_url").alias("src"), "href", (F.col("pos") + 1).cast("long").alias("link_pos")
    )
    return down.unionByName(leaves).unionByName(back).unionByName(own)


def graph_status(pages: DataFrame, store: DataFrame) -> DataFrame:
    """Fetch outcome of every node of :func:`link_graph` that exists."""
    placed = located(pages)
    home = F.concat(F.lit("https://"), "site", F.lit("/"))
    folder = F.concat(F.lit("https://"), "site", F.regexp_extract("path", "^(/[^/]*)", 1))
    made = placed.select(F.explode(F.array(home, folder)).alias("norm_url")).distinct()
    made = made.select("norm_url", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
    return store.select("norm_url", "success", "error").unionByName(made)


#: Elements in each other, without end tags, and in comments and scripts, around a page.
_BEFORE = "<div><nav>a<nav>b</nav>menu</nav><form>open "
_AFTER = '</div><!-- <aside> --><script>if (a < b) "<nav>"</script>rest <footer><footer>x</footer> y</footer><p>end<aside>c'
NESTED_SQL = f"'{_BEFORE}' || html || '{_AFTER}' || html"


def nested_pages(pages: DataFrame) -> DataFrame:
    """Pages with boilerplate around them that only a reader of nesting cuts right."""
    return pages.select("page_id", F.concat(F.lit(_BEFORE), "html", F.lit(_AFTER), "html").alias("html"))
