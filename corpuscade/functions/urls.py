"""URL rules as Column expressions.

Splitting follows RFC 3986 appendix B with one regex pass; resolution and
normalisation match what the Python standard library does for http(s) URLs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Path endings that never hold page content.
NON_CONTENT_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".bmp", ".tiff",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv",
    ".zip", ".tar", ".gz", ".rar", ".7z",
    ".mp3", ".mp4", ".avi", ".mov", ".wav", ".webm",
    ".css", ".js", ".json", ".xml", ".woff", ".woff2", ".ttf", ".eot",
    ".exe", ".dmg", ".apk",
)

SLUG_LENGTH = 120

_SEP = "\u0001"
_SPLIT = (
    r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"
    r"((?:[^?#]*/)?[^/;?#]*)(?:;([^/?#]*))?(?:\?([^#]*))?(?:#([\s\S]*))?$"
)
SCHEME, NETLOC, PATH, PARAMS, QUERY, FRAGMENT = range(6)
_NETLOC_SCHEMES = ("http", "https", "ftp", "file", "ws", "wss")
_RELATIVE_SCHEMES = ("", "http", "https", "ftp", "file", "ws", "wss")


def url_parts(url: Column) -> Column:
    """``array(scheme, netloc, path, params, query, fragment)``; absent parts are empty."""
    clean = F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    marked = F.regexp_replace(clean, _SPLIT, _SEP.join(f"${i}" for i in range(1, 7)))
    return F.split(marked, _SEP, 6)


def url_domain(url: Column) -> Column:
    """Network location in lower case, with port and user info."""
    return F.lower(url_parts(url)[NETLOC])


def is_content_path(path: Column) -> Column:
    endings = "|".join(e[1:] for e in NON_CONTENT_EXTENSIONS)
    return ~F.lower(path).rlike(rf"\.(?:{endings})\z")


def is_content_url(url: Column) -> Column:
    """False when the path (never the query) ends with a denied extension."""
    return is_content_path(url_parts(url)[PATH])


def page_slug(url: Column) -> Column:
    """File-name form of a URL."""
    dashed = F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"[^a-zA-Z0-9]+", "-")
    cut = F.substring(F.lower(F.btrim(dashed, F.lit("-"))), 1, SLUG_LENGTH)
    return F.when(cut == "", F.lit("index")).otherwise(cut)


def _unescape(x: Column) -> Column:
    lone_percent = F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(lone_percent)


def _escape(x: Column) -> Column:
    # url_encode keeps '*' and escapes '~'; query strings here do the opposite.
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def sorted_query(query: Column) -> Column:
    """Parameters with a value, sorted by (name, value) and re-encoded."""
    pairs = F.filter(
        F.transform(F.split(query, "&"), lambda nv: F.split(nv, "=", 2)),
        lambda p: (F.size(p) == 2) & (p[1] != ""),
    )
    decoded = F.transform(
        pairs, lambda p: F.struct(_unescape(p[0]).alias("k"), _unescape(p[1]).alias("v"))
    )
    encoded = F.transform(
        F.array_sort(decoded), lambda p: F.concat(_escape(p["k"]), F.lit("="), _escape(p["v"]))
    )
    return F.when(query == "", F.lit("")).otherwise(F.array_join(encoded, "&"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` mentions it.

    Filters are pushed down by substitution, which would otherwise multiply the
    regular expressions below each time a part of a URL is used.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def assemble(
    scheme: Column, netloc: Column, path: Column, params: Column, query: Column, fragment: Column
) -> Column:
    """Join the parts of a URL again."""

    def located(tail: Column) -> Column:
        rooted = F.when((tail != "") & ~tail.startswith("/"), F.concat(F.lit("/"), tail)).otherwise(tail)
        return (
            F.when(netloc != "", F.concat(F.lit("//"), netloc, rooted))
            .when(
                tail.startswith("//")
                | (scheme.isin(*_NETLOC_SCHEMES) & ((tail == "") | tail.startswith("/"))),
                F.concat(F.lit("//"), tail),
            )
            .otherwise(tail)
        )

    def marked(mark: str, value: Column) -> Column:
        return _let(value, lambda v: F.when(v != "", F.concat(F.lit(mark), v)).otherwise(""))

    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        _let(F.concat(path, marked(";", params)), located),
        marked("?", query),
        marked("#", fragment),
    )


def _drop_dot_segments(path: Column) -> Column:
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    closing = F.when(path.rlike(r"(^|/)\.{1,2}\z"), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    joined = F.array_join(F.concat(kept, closing), "/")
    return F.when(
        path.rlike(r"(^|/)\.{1,2}(/|\z)"), _let(joined, lambda j: F.when(j == "", F.lit("/")).otherwise(j))
    ).otherwise(F.when(path == "", F.lit("/")).otherwise(path))


def resolve_url(base: Column, url: Column) -> Column:
    """The reference ``url`` resolved against ``base``."""

    def resolve(v: Column) -> Column:
        base, url, b, u = v["base"], v["url"], v["b"], v["u"]
        base_scheme, own_scheme = F.lower(b[SCHEME]), F.lower(u[SCHEME])
        merged = F.regexp_replace(
            F.when(b[PATH] == "", F.concat(F.lit("/"), u[PATH])).otherwise(
                F.concat(F.regexp_replace(b[PATH], r"[^/]*\z", ""), u[PATH])
            ),
            "/+",
            "/",
        )
        absolute = F.when(u[PATH].startswith("/"), u[PATH]).otherwise(merged)
        here = (u[PATH] == "") & (u[PARAMS] == "")
        elsewhere = u[NETLOC] != ""
        return (
            F.when(url == "", base)
            .when(base == "", url)
            .when((own_scheme != "") & (own_scheme != base_scheme), url)
            .when(~base_scheme.isin(*_RELATIVE_SCHEMES), url)
            .otherwise(
                assemble(
                    base_scheme,
                    F.when(elsewhere, u[NETLOC]).otherwise(b[NETLOC]),
                    F.when(elsewhere, u[PATH])
                    .when(here, b[PATH])
                    .otherwise(_let(absolute, _drop_dot_segments)),
                    F.when(here & ~elsewhere, b[PARAMS]).otherwise(u[PARAMS]),
                    F.when(here & ~elsewhere & (u[QUERY] == ""), b[QUERY]).otherwise(u[QUERY]),
                    u[FRAGMENT],
                )
            )
        )

    parts = F.struct(
        base.alias("base"), url.alias("url"), url_parts(base).alias("b"), url_parts(url).alias("u")
    )
    return _let(parts, resolve)


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """The canonical spelling of ``url`` (resolved against ``base`` if given)."""

    def normalize(n: Column) -> Column:
        path = (
            F.when(n[PATH] == "", F.lit("/"))
            .when(
                (F.length(n[PATH]) > 1) & n[PATH].endswith("/"), F.regexp_replace(n[PATH], r"/+\z", "")
            )
            .otherwise(n[PATH])
        )
        return assemble(
            F.lower(n[SCHEME]), F.lower(n[NETLOC]), path, n[PARAMS], sorted_query(n[QUERY]), F.lit("")
        )

    return _let(url_parts(url if base is None else resolve_url(base, url)), normalize)


def with_resolved_url(df: DataFrame, base: str, url: str, out: str) -> DataFrame:
    return df.withColumn(out, resolve_url(F.col(base), F.col(url)))


def with_normalized_url(
    df: DataFrame, url: str, out: str = "norm_url", base: str | None = None
) -> DataFrame:
    return df.withColumn(out, normalize_url(F.col(url), None if base is None else F.col(base)))


def path_with_query(url: Column) -> Column:
    """Percent-encoded ``path;params?query`` as robots rules see it.

    Percent escapes are undone first, so an escaped and a plain spelling of one
    path meet the same rule.
    """

    def encode(text: Column) -> Column:
        # A path of its own that opens with '//' is written with an empty location before it.
        located = F.when(text.startswith("//"), F.concat(F.lit("//"), text)).otherwise(text)
        return F.when(text == "", F.lit("/")).otherwise(percent_encode(located))

    def join(p: Column) -> Column:
        text = F.concat(
            p[PATH],
            F.when(p[PARAMS] != "", F.concat(F.lit(";"), p[PARAMS])).otherwise(""),
            F.when(p[QUERY] != "", F.concat(F.lit("?"), p[QUERY])).otherwise(""),
            F.when(p[FRAGMENT] != "", F.concat(F.lit("#"), p[FRAGMENT])).otherwise(""),
        )
        return _let(text, encode)

    return _let(url_parts(_percent_decode(url)), join)


def _percent_decode(x: Column) -> Column:
    # '+' is data here, not a space.
    return _unescape(F.replace(x, F.lit("+"), F.lit("%2B")))


def percent_encode(x: Column) -> Column:
    """Percent-encode everything but letters, digits and ``_.-~/``."""
    back = (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"))
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), back, F.url_encode(x))
