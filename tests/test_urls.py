"""URL rules: a hand-made edge table checked against the Python standard library."""

from urllib.parse import parse_qsl, quote, unquote, urldefrag, urlencode, urljoin, urlparse, urlunparse

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpuscade.functions import urls

EDGE = [
    "HTTP://Example.COM/Path/", "http://ex.com", "http://ex.com//", "http://ex.com/a///",
    "http://ex.com/?a=&flag&b=x y", "http://ex.com/?", "http://ex.com/?b=2&a=1&a=0",
    "http://ex.com/?q=%C3%A9t%C3%A9&z=~*", "http://user:pw@EX.com:8080/x#frag",
    "http://ex.com/a.tar.gz", "http://ex.com/page?file=a.jpg", "http://ex.com/A.PDF;v=1?x=1",
    "http://ex.com/a;b/c;d", "http://ex.com/a;", "https://ex.com/%7Euser/%zz?x=%zz&y=%41",
    "mailto:me@ex.com", "javascript:void(0)", "/relative/only", "", "?q=1", "#top",
    " http://ex.com/lead", "http://ex.com/a b", "http://ho_st.com/x?k=a+b&k=a%20a",
    "http://ex.com/x?a=1;b=2", "http://ex.com/x?=v&k==w", "ftp://ex.com/file.txt",
    "http://ex.com/a/./b/../c", "http://ex.com/jpg", "http://ex.com/.jpg", "http://ex.com/a.jpg/",
]
BASES = ["http://ex.com/a/b", "http://ex.com/a/b/", "http://ex.com", "https://ex.com/x;p?q=1#f"]
REFS = [
    "../x", "../../../x", "./", "..", ".", "?q=2", "#f", "", "//Other.com/y", "/root", "x//y",
    "http://ex.com/abs", "https:rel", "x/../y/.", "mailto:a@b", ";p2", "g;x=1/../y", "/a/../../b/",
]


def std_normalize(url, base=None):
    if base:
        url = urljoin(base, url)
    p = urlparse(urldefrag(url)[0])
    path = p.path or "/"
    path = path.rstrip("/") if len(path) > 1 else path
    return urlunparse((p.scheme, p.netloc.lower(), path, p.params, urlencode(sorted(parse_qsl(p.query))), ""))


def std_robots_path(url):
    p = urlparse(unquote(url))
    return quote(urlunparse(("", "", p.path, p.params, p.query, p.fragment))) or "/"


def _rows(spark, values, cols):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], ["i", *cols])


def test_normalize_edges(spark):
    df = urls.with_normalized_url(_rows(spark, [(u,) for u in EDGE], ["url"]), "url")
    got = {r["url"]: r["norm_url"] for r in df.collect()}
    assert got == {u: std_normalize(u) for u in EDGE}


def test_resolve_edges(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    df = urls.with_resolved_url(_rows(spark, pairs, ["base", "ref"]), "base", "ref", "abs")
    got = {(r["base"], r["ref"]): r["abs"] for r in df.collect()}
    assert got == {(b, r): urljoin(b, r) for b, r in pairs}


def test_normalize_with_base(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    df = urls.with_normalized_url(_rows(spark, pairs, ["base", "ref"]), "ref", base="base")
    got = {(r["base"], r["ref"]): r["norm_url"] for r in df.collect()}
    assert got == {(b, r): std_normalize(r, b) for b, r in pairs}


def test_domain_content_slug_robots_path(spark):
    df = _rows(spark, [(u,) for u in EDGE], ["url"]).select(
        "url",
        urls.url_domain(F.col("url")).alias("domain"),
        urls.is_content_url(F.col("url")).alias("content"),
        urls.page_slug(F.col("url")).alias("slug"),
        urls.path_with_query(F.col("url")).alias("rp"),
    )
    for r in df.collect():
        p = urlparse(r["url"])
        assert r["domain"] == p.netloc.lower(), r
        assert r["content"] == (not p.path.lower().endswith(urls.NON_CONTENT_EXTENSIONS)), r
        if "%zz" not in r["url"]:
            assert r["rp"] == std_robots_path(r["url"]), r
        assert len(r["slug"]) <= 120 and r["slug"] != ""
    slugs = {r["url"]: r["slug"] for r in df.collect()}
    assert slugs[""] == "index"
    assert slugs["HTTP://Example.COM/Path/"] == "http-example-com-path"
    assert slugs["http://ex.com/?b=2&a=1&a=0"] == "ex-com-b-2-a-1-a-0"


def test_slug_cut(spark):
    long = "https://ex.com/" + "ab/" * 100
    got = spark.range(1).select(urls.page_slug(F.lit(long)).alias("s")).first()["s"]
    assert got == ("ex-com-" + "ab-" * 100)[:120]


segment = st.text("abcXYZ09-_~.", min_size=0, max_size=5)
param = st.tuples(st.text("ab~*é +", max_size=3), st.text("xy é&=%", max_size=3))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["http", "HTTPS"]), st.lists(segment, max_size=5),
                          st.lists(param, max_size=4)), min_size=20, max_size=60))
def test_normalize_property(spark, parts):
    made = sorted({f"{s}://Host.com/" + "/".join(p) + ("?" + urlencode(q) if q else "") for s, p, q in parts})
    df = urls.with_normalized_url(_rows(spark, [(u,) for u in made], ["url"]), "url")
    df = urls.with_normalized_url(df, "norm_url", out="twice")
    for r in df.collect():
        assert r["norm_url"] == std_normalize(r["url"])
        assert r["twice"] == r["norm_url"] or r["url"].split("?")[0].endswith("//")
