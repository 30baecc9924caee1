"""Robots, sitemaps and breadth-first crawling against small hand-made and random cases."""

from collections import deque
from urllib.robotparser import RobotFileParser

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpuscade.operators import frontier, robots as rb, sitemaps as sm
from corpuscade.operators.eligibility import with_skip_reason
from corpuscade.sources import pages as pg

ROBOTS = {
    "missing": None,
    "open": "User-agent: *\nDisallow:",
    "allow-first": "User-agent: *\nAllow: /a/b\nDisallow: /a",
    "deny-first": "User-agent: *\nDisallow: /a\nAllow: /a/b",
    "named": "User-agent: somebot\nDisallow: /",
    "two-groups": "User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /x",
    "comments": "# hi\nUser-agent: * # all\nDisallow: /a # no\n\n\nSitemap: http://h/s.xml\nsitemap:http://h/t.xml",
    "broken-group": "User-agent: *\n\nDisallow: /a",
    "mixed": "User-agent: somebot\nUser-agent: *\nDisallow: /x y\nDisallow: /%7Eme\nCrawl-delay: 3",
    "star-path": "User-agent: *\nDisallow: *",
    "query": "User-agent: *\nDisallow: /a?q=",
    "empty-agent": "User-agent:\nDisallow: /x\n\nUser-agent: *\nDisallow: /a",
}
PATHS = ["/", "", "/a", "/a/b", "/a/b/c", "/x", "/x y", "/x%20y", "/~me", "/%7Eme", "/a?q=1", "/b?x=/a", "/é"]


def test_robots_match_the_standard_parser(spark):
    texts = spark.createDataFrame(list(ROBOTS.items()), "site string, txt string")
    parsed = rb.parse_robots(texts)
    urls = texts.select("site").crossJoin(
        spark.createDataFrame([(f"http://h{p}",) for p in PATHS], "url string")
    )
    for r in rb.with_allowed(urls, parsed).collect():
        std = RobotFileParser()
        std.parse((ROBOTS[r["site"]] or "").splitlines())
        assert r["allowed"] == std.can_fetch("*", r["url"]), r
    maps = {r["site"]: r["sitemaps"] for r in parsed.collect()}
    assert maps["comments"] == ["http://h/s.xml", "http://h/t.xml"] and maps["open"] == []


_LINES = st.sampled_from(
    ["", "  ", "# c", "User-agent: *", "user-agent: bot", "User-Agent:", "Disallow: /a", "Disallow:", "Allow: /a/b?q=%41",
     "Disallow: /x y # z", "Crawl-delay: 2", "Request-rate: 1/5", "Sitemap: http://h/%73.xml", "nonsense", "Allow /a", "Disallow: /é?"]
)


@given(st.lists(_LINES, max_size=14))
@settings(max_examples=400, deadline=None)
def test_robots_lines_are_read_as_the_standard_parser_reads_them(lines):
    std = RobotFileParser()
    std.parse(lines)
    groups = [g for g in std.entries if g.applies_to("*")] + [std.default_entry]
    want = [(r.path, r.allowance) for r in groups[0].rulelines] if groups[0] else []
    assert rb.read_robots("\n".join(lines)) == (want, std.site_maps() or [])


def test_stored_pages_are_fetched_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://h/a", "<p>no closing tag"), (2, "http://h/b", None), (3, "http://h/c", "")], "page_id long, url string, html string"
    )
    got = {r["norm_url"]: (r["success"], r["error"]) for r in pg.page_store(pages).collect()}
    assert got == {"http://h/a": (True, None), "http://h/b": (False, pg.NO_CONTENT), "http://h/c": (True, None)}


def test_skip_reason_looks_at_the_extension_first(spark):
    robots = rb.parse_robots(spark.createDataFrame([("h", "User-agent: *\nDisallow: /a")], "site string, txt string"))
    urls = spark.createDataFrame(
        [("h", "http://h/a.pdf"), ("h", "http://h/a"), ("h", "http://h/b"), ("other", "http://o/a")], "site string, url string"
    )
    got = {r["url"]: r["reason"] for r in with_skip_reason(urls, robots).collect()}
    assert got == {
        "http://h/a.pdf": "non-content extension", "http://h/a": "disallowed by robots.txt",
        "http://h/b": None, "http://o/a": None,
    }


def _xml(kind, locs, ns="http://www.sitemaps.org/schemas/sitemap/0.9"):
    item = {"sitemapindex": "sitemap", "urlset": "url"}[kind]
    return f'<{kind} xmlns="{ns}">' + "".join(f"<{item}><loc>{u}</loc></{item}>" for u in locs) + f"</{kind}>"


def _read_depth_first(docs, root):
    """What a plain recursive reader visits."""
    seen, out = set(), []

    def visit(url):
        if url in seen:
            return
        seen.add(url)
        kind, locs = docs[url]
        for loc in locs:
            if kind == "sitemapindex":
                visit(loc)
            else:
                out.append((url, loc))

    visit(root)
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=4), min_size=6, max_size=6), st.integers(0, 63))
def test_sitemap_order_is_depth_first(spark, children, leaves):
    docs = {}
    for i, kids in enumerate(children):
        if i and leaves >> i & 1:
            docs[f"m{i}"] = ("urlset", [f"http://s/{i}/{j}" for j in kids])
        else:
            docs[f"m{i}"] = ("sitemapindex", [f"m{j}" for j in kids])
    table = spark.createDataFrame([(u, _xml(*d)) for u, d in docs.items()], "sitemap_url string, xml string")
    roots = spark.createDataFrame([("s", 0, "m0")], "site string, root_pos int, sitemap_url string")
    parsed = sm.parse_sitemaps(table)
    entries, failed = sm.sitemap_entries(sm.expand_sitemaps(roots, parsed), parsed)
    got = [(r["sitemap_url"], r["loc"]) for r in entries.orderBy("path", "pos").collect()]
    assert got == _read_depth_first(docs, "m0")
    assert failed.count() == 0


def test_sitemap_failures_and_cap(spark):
    docs = [
        ("http://s/good.xml", _xml("urlset", ["http://s/1", "http://S/1/", " http://s/a.pdf ", "http://x/2", "http://s/2", "http://s/3"])),
        ("http://s/idx.xml", _xml("sitemapindex", ["http://s/good.xml", "http://s/bad.xml"])),
        ("http://s/bad.xml", "<urlset><url>"),
        ("http://s/ns.xml", _xml("urlset", ["http://s/9"], ns="http://no/")),
        ("http://s/null.xml", None),
    ]
    table = spark.createDataFrame(docs, "sitemap_url string, xml string")
    names = ["idx", "ns", "null", "gone", "good", "bad"]
    roots = spark.createDataFrame(
        [("s", i, f"http://s/{n}.xml") for i, n in enumerate(names)], "site string, root_pos int, sitemap_url string"
    )
    robots = rb.parse_robots(spark.createDataFrame([("s", None)], "site string, txt string"))
    found, skipped = sm.discover_from_sitemaps(roots, table, robots, max_pages=2)
    assert [(r["seq"], r["url"]) for r in found.orderBy("seq").collect()] == [(1, "http://s/1"), (2, "http://s/2")]
    # Reading stops at the second page: the last root is never opened.
    assert sorted((r["url"], r["reason"]) for r in skipped.collect()) == [
        ("http://s/a.pdf", "non-content extension"),
        ("http://s/gone.xml", "sitemap fetch/parse failed: not reachable"),
        ("http://s/idx.xml", "sitemap fetch/parse failed: malformed XML"),
        ("http://s/null.xml", "sitemap fetch/parse failed: not reachable"),
    ]


def _queue_crawl(site, links, ok, denied, cap):
    """A plain first-in-first-out crawl."""
    start = f"http://{site}/0"
    seen, queue, found, skipped = {start}, deque([start]), [], []
    while queue and len(found) < cap:
        url = queue.popleft()
        if url in denied:
            skipped.append((url, "disallowed by robots.txt"))
        elif not ok.get(url, False):
            skipped.append((url, "fetch failed: " + ("broken" if url in ok else "not in page store")))
        else:
            found.append(url)
            for target in links.get(url, []):
                if target not in seen and target.startswith(f"http://{site}/"):
                    seen.add(target)
                    queue.append(target)
    return found, skipped


graph = st.lists(st.lists(st.integers(0, 9), max_size=5), min_size=8, max_size=8)


@settings(max_examples=5, deadline=None)
@given(graph, graph, st.lists(st.booleans(), min_size=8, max_size=8), st.integers(1, 6), st.integers(1, 9))
def test_crawl_order_is_that_of_a_queue(spark, one, two, fine, cap, shut):
    ok, links = {}, {}
    for site, g in (("p", one), ("q", two)):
        for i, targets in enumerate(g):
            ok[f"http://{site}/{i}"] = i == 0 or fine[i]
            # Number 9 stands for a page of the other site.
            links[f"http://{site}/{i}"] = [
                f"http://{site}/{t}" if t < 9 else f"http://{'q' if site == 'p' else 'p'}/1" for t in targets
            ]
    sites = spark.createDataFrame([("p", "http://p/0"), ("q", "http://Q/0#x")], "site string, base_url string")
    edges = spark.createDataFrame(
        [(u, t, i) for u, ts in links.items() for i, t in enumerate(ts)] or [("x", "y", 0)],
        "src string, href string, link_pos long",
    )
    status = spark.createDataFrame(
        [(u, o, None if o else "broken") for u, o in ok.items()], "norm_url string, success boolean, error string"
    )
    robots = rb.parse_robots(
        spark.createDataFrame([("p", f"User-agent: *\nDisallow: /{shut}")], "site string, txt string")
    )
    found, skipped = frontier.crawl_breadth_first(sites, edges, status, robots, cap)
    for site, denied in (("p", {f"http://p/{shut}"}), ("q", set())):
        want_found, want_skipped = _queue_crawl(site, links, ok, denied, cap)
        here = F.col("site") == site
        assert [r["url"] for r in found.where(here).orderBy("seq").collect()] == want_found
        assert sorted((r["url"], r["reason"]) for r in skipped.where(here).collect()) == sorted(want_skipped)


def test_a_level_reads_only_the_buckets_of_its_frontier(spark, tmp_path):
    edges = spark.createDataFrame([(f"http://p/{i}", f"/{i + 1}", 0) for i in range(300)] + [("http://other/", "/x", 0)], "src string, href string, link_pos long")
    sites = spark.createDataFrame([("p", "http://p/0")], "site string, base_url string")
    store = frontier.store_links(edges, sites, str(tmp_path / "links"))
    assert store.count() == 300 and store.where("src like '%other%'").isEmpty()
    parents = spark.createDataFrame([("http://p/7", "p", 1, 2)], "url string, site string, seq int, total int").selectExpr("*", "0 as level", "0 as parent_seq", "0L as link_pos")
    seen = spark.createDataFrame([], "site string, url string")
    nodes = frontier._next_level(parents, store, seen, 5)
    assert [(r["url"], r["parent_seq"], r["done"]) for r in nodes.collect()] == [("http://p/8", 1, 2)]
    plan = nodes._jdf.queryExecution().executedPlan().toString().lower()
    assert "dynamicpruning" in plan


def test_rules_by_prefix_are_those_in_order(spark):
    """Sites of many rules are looked up by prefixes: the same verdicts, the first rule first."""
    import random

    rnd = random.Random(6)
    part = lambda: "/" + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 3)))
    lines = [f"{rnd.choice(['Allow', 'Disallow'])}: {part()}{part()}" for _ in range(120)]
    texts = [("big", "User-agent: *\n" + "\n".join(lines)), ("small", "User-agent: *\nDisallow: /a"), ("star", "User-agent: *\nAllow: /ab\nDisallow: *"), ("none", None)]
    robots = rb.parse_robots(spark.createDataFrame(texts, "site string, txt string"))
    urls = spark.createDataFrame([(s, f"http://{s}{part()}{part()}{part()}?q={i % 3}") for s in ("big", "small", "star", "none", "absent") for i in range(40)], "site string, url string")
    plain = sorted(map(tuple, rb.with_allowed(urls, robots, many=1000).collect()))
    for many in (0, 1, 64):
        assert sorted(map(tuple, rb.with_allowed(urls, robots, many=many).collect())) == plain
    assert {a for s, _, a in plain if s == "big"} == {True, False}


def test_denied_start_page(spark):
    sites = spark.createDataFrame([("p", "http://p/")], "site string, base_url string")
    robots = rb.parse_robots(spark.createDataFrame([("p", "User-agent: *\nDisallow: /")], "site string, txt string"))
    status = spark.createDataFrame([("http://p/", True, None)], "norm_url string, success boolean, error string")
    edges = spark.createDataFrame([("http://p/", "/a", 0)], "src string, href string, link_pos long")
    found, skipped = frontier.crawl_breadth_first(sites, edges, status, robots, 5)
    assert found.count() == 0 and [r["reason"] for r in skipped.collect()] == ["disallowed by robots.txt"]


def test_sink_manifest_and_hidden_folder(spark, tmp_path):
    rows = [
        (0, "http://h/a", True, None, "<html><p>first page text</p></html>"),
        (1, "http://h/a/", True, None, "<html><p>second page text</p></html>"),
        (2, "http://h/b", False, "gone", None),
        (3, "http://h/c", True, None, "<html><p>x</p></html>"),
    ]
    fetched = spark.createDataFrame(rows, "pos long, url string, success boolean, error string, html string")
    winners = pg.to_markdown(pg.sink_winners(fetched, "pos"))
    out = str(tmp_path / "out")
    pg.write_markdown(winners, out)
    path = pg.write_manifest(pg.manifest(fetched, out), out)
    assert {(r["url"], r["success"], r["path"], r["error"]) for r in pg.read_manifest(spark, path).collect()} == {
        ("http://h/a", True, f"{out}/h-a.md", None), ("http://h/a/", True, f"{out}/h-a.md", None),
        ("http://h/b", False, None, "gone"), ("http://h/c", True, f"{out}/h-c.md", None),
    }
    from corpuscade.sources.documents import read_directory

    texts = {r["path"].split("slug=")[1].split("/")[0]: r["text"].strip() for r in read_directory(spark, out).collect()}
    # The one-word page is pruned to nothing, so its whole text stays.
    assert texts == {"h-a": "second page text", "h-c": "x"}


def test_page_sink_adds_up(spark, tmp_path):
    out = str(tmp_path / "pages")

    def write(crawl, *pages):
        pg.write_pages(spark.createDataFrame(pages, "slug string, url string, markdown string"), out, crawl)

    write("1", ("a", "http://h/a", "old"), ("b", "http://h/b", "kept"))
    write("2", ("a", "http://h/a", "new"))
    write("2", ("a", "http://h/a", "newer"), ("c", "http://h/c", "added"))
    got = {r["slug"]: r["markdown"] for r in pg.read_written(spark, out).collect()}
    assert got == {"a": "newer", "b": "kept", "c": "added"}
