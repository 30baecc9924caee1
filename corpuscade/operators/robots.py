"""Robots rules: parsed once per host, kept as one row, matched without multiplying rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from corpuscade.functions.urls import path_with_query, with_normalized_url
from corpuscade.operators.skew import lookup_join
from corpuscade.session import materialize

_PARSED = (
    StructType()
    .add("rules", ArrayType(StructType().add("rule_no", IntegerType()).add("path", StringType()).add("allow", BooleanType())))
    .add("sitemaps", ArrayType(StringType()))
)
_PARSED_ARROW = pa.struct(
    [
        ("rules", pa.list_(pa.struct([("rule_no", pa.int32()), ("path", pa.string()), ("allow", pa.bool_())]))),
        ("sitemaps", pa.list_(pa.string())),
    ]
)
# Directives that belong to a group without being a rule.
PACING = ("crawl-delay", "request-rate")
DEFAULT_SITEMAP = "/sitemap.xml"
# Sites of more rules are looked up by prefixes.
MANY_RULES = 64


@dataclass
class _Group:
    """Agents that are spoken to together, and their rules in file order."""

    agents: list[str] = field(default_factory=list)
    rules: list[tuple[str, bool]] = field(default_factory=list)
    started: bool = False  # a directive followed the agents

    @property
    def unnamed(self) -> bool:
        """An agent without a name is every agent, too."""
        return "" in self.agents and "*" not in self.agents


def _path(value: str) -> str:
    """A rule's path as URLs spell it."""
    return quote(urlsplit(value).geturl())


def read_robots(text: str | None) -> tuple[list[tuple[str, bool]], list[str]]:
    """Rules (path, allow) for every agent, and the sitemaps, in file order.

    Agents that follow each other open a group; directives fill it; an empty line or the
    next agent closes it, and a group closed before any directive is void. Directives
    outside a group are void, too. The first group that names ``*`` counts, unless one
    whose agent has no name at all takes its place. An empty
    Disallow allows all. Anything after ``#`` is a comment, and a line that is only a
    comment or blanks is no empty line.
    """
    closed: list[_Group] = []
    sitemaps: list[str] = []
    group: _Group | None = None
    for line in [*(text or "").splitlines(), ""]:
        name, colon, value = line.partition("#")[0].strip().partition(":")
        name, value = name.strip().lower(), unquote(value.strip())
        if line == "" or (colon and name == "user-agent" and group and group.started):
            if group and group.started:
                closed.append(group)
            group = None
        if not colon:
            continue
        if name == "sitemap":
            sitemaps.append(value)
        elif name == "user-agent":
            group = group or _Group()
            group.agents.append(value)
        elif group and name in ("allow", "disallow"):
            group.started = True
            group.rules.append((_path(value), name == "allow" or value == ""))
        elif group and name in PACING:
            group.started = True
    to_all = [g for g in closed if g.unnamed] + [g for g in closed if "*" in g.agents]
    return (to_all[0].rules if to_all else []), sitemaps


@F.arrow_udf(_PARSED)
def _parsed(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        rules, sitemaps = read_robots(text)
        numbered = [{"rule_no": i, "path": path, "allow": allow} for i, (path, allow) in enumerate(rules)]
        out.append({"rules": numbered, "sitemaps": sitemaps})
    return pa.array(out, type=_PARSED_ARROW)


def parse_robots(texts: DataFrame) -> DataFrame:
    """``(site, rules, sitemaps)`` from ``(site, txt)``; no text means no rules."""
    return texts.select("site", _parsed("txt").alias("_p")).select("site", "_p.rules", "_p.sitemaps")


def with_allowed(
    urls: DataFrame, robots: DataFrame, url: str = "url", out: str = "allowed", small: bool | None = None,
    many: int = MANY_RULES,
) -> DataFrame:
    """Add whether the site's rules allow ``url``. Both sides carry ``site``.

    The rules of a site travel as one array, so the join adds no rows, and the
    order of the array decides. Sites of more than ``many`` rules are looked up by the URL's
    prefixes instead, so that a URL costs no more there than elsewhere.
    """
    pathed = urls.withColumn("_path", path_with_query(F.col(url)))
    few = robots.select("site", F.when(F.size("rules") <= many, F.col("rules")).alias("rules"))
    ruled = lookup_join(pathed, few, ["site"], "left", small=small)
    matching = F.filter("rules", lambda r: (r["path"] == "*") | F.col("_path").startswith(r["path"]))
    ruled = ruled.withColumn(out, F.get(matching, F.lit(0))["allow"]).drop("rules")
    long = robots.where(F.size("rules") > many).select("site", "rules")
    if not long.isEmpty():
        found = _by_prefix(pathed.select("site", "_path"), long)
        ruled = lookup_join(ruled, found, ["site", "_path"], "left").withColumn(out, F.coalesce(out, "_first.allow")).drop("_first")
    return ruled.withColumn(out, F.coalesce(out, F.lit(True))).drop("_path")


def _by_prefix(paths: DataFrame, robots: DataFrame) -> DataFrame:
    """``site, _path, _first``: the first rule whose path the URL's path begins with, from a table
    of rule paths that is asked for the URL's prefixes of the lengths that the site's rules have."""
    rules = robots.select("site", F.explode("rules").alias("r")).select("site", "r.*")
    first = F.min(F.struct("rule_no", "allow")).alias("_rule")
    table = materialize(rules.groupBy("site", F.col("path").alias("_prefix")).agg(first), "rule-paths")
    lengths = table.groupBy("site").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    asked = lookup_join(paths.distinct(), lengths, ["site"])
    fitting = F.filter("_lengths", lambda n: n <= F.length("_path"))
    prefixes = F.transform(fitting, lambda n: F.substring("_path", F.lit(1), n))
    # The rule "*" holds for every path.
    probes = asked.select("site", "_path", F.explode(F.array_distinct(F.concat(prefixes, F.array(F.lit("*"))))).alias("_prefix"))
    hits = lookup_join(probes, table, ["site", "_prefix"])
    return hits.groupBy("site", "_path").agg(F.min("_rule").alias("_first"))


def site_sitemaps(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """Sitemaps of ``sites(site, base_url)`` in order: the declared ones, else the usual place."""
    declared = (
        robots.select("site", F.posexplode("sitemaps").alias("root_pos", "sitemap_url"))
        .join(sites.select("site"), "site", "left_semi")
    )
    fallback = sites.join(robots.where(F.size("sitemaps") > 0), "site", "left_anti").withColumn(
        "_default", F.lit(DEFAULT_SITEMAP)
    )
    fallback = with_normalized_url(fallback, "_default", out="sitemap_url", base="base_url")
    return declared.unionByName(fallback.select("site", F.lit(0).alias("root_pos"), "sitemap_url"))
