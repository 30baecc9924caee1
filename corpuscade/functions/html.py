"""Page cleaning inside the row: strip, split into blocks, score, write Markdown.

A page never leaves its row, so none of this shuffles.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from corpuscade.functions.elements import cut_elements
from corpuscade.functions.text import once

# Elements that carry navigation or machinery, not content.
BOILERPLATE = (
    "head", "script", "style", "noscript", "nav", "header", "footer", "aside", "form", "iframe",
)
BLOCK_TAGS = (
    "p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6",
    "article", "section", "blockquote", "pre", "td", "th", "dt", "dd",
)
# A link's target in double or single quotes or bare (groups 1 to 3).
HREF = r"""<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
# Character references: decimal, hexadecimal, or by name.
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"
# Prune settings.
PRUNE_THRESHOLD = 0.6
MIN_WORDS = 2
TAG_WEIGHTS = {
    "p": 1.0, "div": 0.5, "li": 0.5,
    "h1": 1.2, "h2": 1.1, "h3": 1.0, "h4": 0.9, "h5": 0.8, "h6": 0.7,
}
OTHER_TAG_WEIGHT = 0.5


def strip_boilerplate(html: Column) -> Column:
    """Remove comments and boilerplate elements with everything inside them, nested and unclosed ones too."""
    return cut_elements(html, BOILERPLATE)


def _character(point: Column) -> Column:
    """The character of a code point; the replacement character where there is none.

    128 to 159 stand for what Windows-1252 has there, as browsers read them.
    """
    upper = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
    legacy = F.substring(F.lit(upper), (point - 127).cast("int"), F.lit(1))
    real = ((point > 0) & (point < 0xD800)) | ((point > 0xDFFF) & (point < 0x110000))
    made = F.decode(F.unhex(F.lpad(F.hex(F.when(real, point).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(point.between(0x80, 0x9F), legacy).otherwise(made)


def _referred(name: Column) -> Column:
    """What a reference's inside stands for; null for an unknown name."""
    names = F.from_json(
        F.lit(json.dumps({n[:-1]: c for n, c in html5.items() if n.endswith(";")})), "map<string,string>"
    )
    hexadecimal = F.conv(F.substr(name, F.lit(3)), 16, 10).cast("long")
    decimal = F.substr(name, F.lit(2)).try_cast("long")
    return (
        F.when(name.rlike("^#[xX]"), _character(hexadecimal))
        .when(name.startswith("#"), _character(decimal))
        .otherwise(F.try_element_at(names, name))
    )


def unescape(text: Column) -> Column:
    """Decode character references, each once; no-break spaces become spaces.

    References that lack the semicolon or are unknown stay as they are.
    """
    def decoded(text: Column) -> Column:
        between = F.split(text, REFERENCE)
        inside = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
        pieces = F.zip_with(
            between,
            inside,
            lambda t, n: F.concat(t, F.coalesce(_referred(n), F.concat(F.lit("&"), n, F.lit(";")), F.lit(""))),
        )
        whole = F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)
        return F.replace(whole, F.lit("\u00a0"), F.lit(" "))

    return once(text, decoded)


def plain_text(html: Column) -> Column:
    spaced = F.regexp_replace(html, r"<[^>]*>", " ")
    return F.btrim(F.regexp_replace(unescape(spaced), r"\s+", " "))


def link_text(html: Column) -> Column:
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))
    return plain_text(F.array_join(anchors, " "))


def inline_markdown(html: Column) -> Column:
    """Links, bold and italics in Markdown; other tags go."""
    linked = F.regexp_replace(html, rf"(?is){HREF}[^>]*>(.*?)</a>", "[$4]($1$2$3)")
    bold = F.regexp_replace(linked, r"(?is)<(?:b|strong)>(.*?)</(?:b|strong)>", "**$1**")
    italic = F.regexp_replace(bold, r"(?is)<(?:i|em)>(.*?)</(?:i|em)>", "*$1*")
    return plain_text(italic)


def _tag_weight(tag: Column) -> Column:
    weight = F.lit(OTHER_TAG_WEIGHT)
    for name, value in TAG_WEIGHTS.items():
        weight = F.when(tag == name, F.lit(value)).otherwise(weight)
    return weight


def is_heading(tag: Column) -> Column:
    return tag.rlike("^h[1-6]$")


def blocks(html: Column) -> Column:
    """``array<struct<tag, html, text, link_text>>`` of a stripped page, in page order.

    A block runs from one opening block tag to the next; what precedes the first
    has an empty tag.
    """
    marked = F.regexp_replace(
        html, rf"(?i)<({'|'.join(BLOCK_TAGS)})\b[^>]*>", "\u0001$1\u0002"
    )
    cut = F.transform(F.split(marked, "\u0001"), lambda piece: F.split(piece, "\u0002", 2))
    tagged = F.transform(
        cut,
        lambda c: F.struct(
            F.when(F.size(c) == 2, F.lower(c[0])).otherwise("").alias("tag"),
            F.when(F.size(c) == 2, F.try_element_at(c, F.lit(2))).otherwise(c[0]).alias("html"),
        ),
    )
    return F.transform(
        tagged,
        lambda b: F.struct(
            b["tag"].alias("tag"),
            b["html"].alias("html"),
            plain_text(b["html"]).alias("text"),
            link_text(b["html"]).alias("link_text"),
        ),
    )


def block_score(b: Column) -> Column:
    """Density and tag weight of a block in one number; -1 below the word floor."""
    text_len = F.length(b["text"]).cast("double")
    html_len = F.length(b["html"]).cast("double")
    density = F.coalesce(text_len / F.nullif(html_len, F.lit(0.0)), F.lit(0.0))
    link_share = F.coalesce(
        F.length(b["link_text"]).cast("double") / F.nullif(text_len, F.lit(0.0)), F.lit(0.0)
    )
    score = (
        F.lit(0.4) * density
        + F.lit(0.2) * (F.lit(1.0) - link_share)
        + F.lit(0.2) * _tag_weight(b["tag"])
        + F.lit(0.1) * F.log(text_len + F.lit(1.0))
    ) / F.lit(0.9)
    n_words = F.regexp_count(b["text"], F.lit(r"\S+"))
    return F.when(n_words < MIN_WORDS, F.lit(-1.0)).otherwise(F.round(score, 6))


def scored_blocks(block_list: Column, threshold: float = PRUNE_THRESHOLD) -> Column:
    """Blocks with their score and whether they stay; headings always stay."""
    scored = F.transform(
        block_list, lambda b: F.struct(b.alias("b"), block_score(b).alias("score"))
    )
    return F.transform(
        scored,
        lambda s: F.struct(
            s["b"]["tag"].alias("tag"),
            s["b"]["html"].alias("html"),
            s["b"]["text"].alias("text"),
            s["score"].alias("score"),
            (is_heading(s["b"]["tag"]) | (s["score"] >= threshold)).alias("keep"),
        ),
    )


def block_markdown(tag: Column, html: Column) -> Column:
    """One block as one Markdown line; empty for an empty block."""
    prefix = (
        F.when(is_heading(tag), F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" ")))
        .when(tag == "li", F.lit("- "))
        .otherwise("")
    )
    return once(inline_markdown(html), lambda line: F.when(line == "", F.lit("")).otherwise(F.concat(prefix, line)))


def join_markdown(block_list: Column) -> Column:
    """Blocks of a page as Markdown, empty ones left out."""
    lines = F.transform(block_list, lambda b: block_markdown(b["tag"], b["html"]))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n\n")


def _with_blocks(df, html: str, threshold: float):
    return df.withColumn("_blocks", scored_blocks(blocks(strip_boilerplate(F.col(html))), threshold))


def with_markdown(df, html: str = "html", threshold: float = PRUNE_THRESHOLD):
    """Add ``raw_md`` (every block) and ``fit_md`` (kept blocks) and drop ``html``."""
    scored = _with_blocks(df, html, threshold)
    return scored.withColumns(
        {
            "raw_md": join_markdown(F.col("_blocks")),
            "fit_md": join_markdown(F.filter(F.col("_blocks"), lambda b: b["keep"])),
        }
    ).drop("_blocks", html)


def fit_or_raw(fit: Column, raw: Column) -> Column:
    """The pruned Markdown, or the whole page when pruning left nothing."""
    return once(fit, lambda made: F.coalesce(F.nullif(made, F.lit("")), raw))


def with_page_markdown(df, html: str = "html", out: str = "markdown", threshold: float = PRUNE_THRESHOLD):
    """Add ``out`` and drop ``html``: the kept blocks, or all when none is left; all are written only then."""
    kept = F.filter(F.col("_blocks"), lambda b: b["keep"])
    page = fit_or_raw(join_markdown(kept), join_markdown(F.col("_blocks")))
    return _with_blocks(df, html, threshold).withColumn(out, page).drop("_blocks", html)


def hrefs(html: Column) -> Column:
    """Link targets in page order, with their character references decoded."""
    found = F.regexp_extract_all(html, F.lit(rf"(?i)({HREF})"), F.lit(1))
    quoted = F.transform(found, lambda a: F.regexp_extract(a, r"(?is)\shref\s*=\s*(.*)$", 1))
    bare = F.transform(quoted, lambda q: F.when(q.rlike("^[\"']"), F.substr(q, F.lit(2), F.length(q) - 2)).otherwise(q))
    return F.transform(bare, unescape)
