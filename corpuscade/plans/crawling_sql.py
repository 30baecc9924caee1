"""Independent SQL for the crawl-side queries."""

from __future__ import annotations

from corpuscade.functions import html as hx, urls
from corpuscade.functions.elements import cut_elements_sql
from corpuscade.operators import eligibility, sitemaps
from corpuscade.plans import crawling, derived
from corpuscade.sources import pages as pg

_RFC = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{_RFC}', {group})"


def scheme(u):
    return part(u, 2)


def netloc(u):
    return part(u, 4)


def path(u):
    return part(u, 5)


def query(u):
    return part(u, 7)


def domain(u):
    return f"lower({netloc(u)})"


def normal(u: str) -> str:
    """Normal form of an absolute http(s) URL."""
    p = path(u)
    pairs = f"list_filter(string_split({query(u)}, '&'), lambda p: regexp_matches(p, '^[^=]*=.'))"
    recoded = (
        f"list_transform({pairs}, lambda p: [url_decode(replace(regexp_extract(p, '^([^=]*)=', 1), '+', ' ')), "
        "url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))])"
    )
    joined = (
        f"array_to_string(list_transform(list_sort({recoded}), lambda p: replace(url_encode(p[1]), '%20', '+')"
        " || '=' || replace(url_encode(p[2]), '%20', '+')), '&')"
    )
    return (
        f"(lower({scheme(u)}) || '://' || {domain(u)} || CASE WHEN {p} = '' THEN '/' WHEN length({p}) > 1 "
        f"THEN regexp_replace({p}, '/+$', '') ELSE {p} END || CASE WHEN {joined} = '' THEN '' ELSE '?' || {joined} END)"
    )


def resolved(base: str, href: str) -> str:
    """Only root-relative links occur in the pages."""
    return f"({scheme(base)} || '://' || {netloc(base)} || {href})"


def content(u: str) -> str:
    endings = "|".join(e[1:] for e in urls.NON_CONTENT_EXTENSIONS)
    return rf"NOT regexp_matches(lower({path(u)}), '\.({endings})$')"


def slug(u: str) -> str:
    dashed = f"regexp_replace(regexp_replace({u}, '^https?://', ''), '[^a-zA-Z0-9]+', '-', 'g')"
    return f"coalesce(nullif(substr(lower(trim({dashed}, '-')), 1, {urls.SLUG_LENGTH}), ''), 'index')"


def digest(x: str, modulo) -> str:
    return f"(CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) % {modulo})"


LINKS = r"""links AS (
  SELECT page_id, url, CAST(generate_subscripts(hs, 1) - 1 AS BIGINT) AS pos, unnest(hs) AS href
  FROM (SELECT page_id, url, list_transform(
          regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1),
          lambda h: replace(CASE WHEN regexp_matches(h, '^["'']') THEN substr(h, 2, length(h) - 2) ELSE h END, '&amp;', '&')) AS hs
        FROM pages))"""

CANDIDATES = f"""{LINKS},
candidates AS (
  SELECT page_id, pos, {normal('r')} AS url FROM (SELECT *, {resolved('url', 'href')} AS r FROM links)
  UNION ALL
  SELECT page_id, -1, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')
    || {list(derived.ASSET_ENDINGS)}[page_id % {len(derived.ASSET_ENDINGS)} + 1] FROM pages)"""

REQUESTS = f"""requests AS (
  SELECT page_id * 2 AS pos, url FROM pages UNION ALL SELECT page_id * 2 + 1, {normal('url')} FROM pages)"""

STORE = f"""store AS (
  SELECT norm_url, page_id, html, success, CASE WHEN NOT success THEN '{pg.NO_CONTENT}' END AS error
  FROM (SELECT {normal('url')} AS norm_url, page_id, html, html IS NOT NULL AS success,
               row_number() OVER (PARTITION BY {normal('url')} ORDER BY page_id) AS rn FROM pages) WHERE rn = 1)"""


def fetched(name: str, source: str, columns: str) -> str:
    return f"""{name} AS (
  SELECT {columns}, coalesce(success, false) AS success,
         CASE WHEN success IS NULL THEN '{pg.ABSENT}' ELSE error END AS error, stored_id
  FROM (SELECT {columns}, {normal('url')} AS norm_url FROM {source}) f
  LEFT JOIN (SELECT norm_url, success, error, page_id AS stored_id FROM store) USING (norm_url))"""


MANIFEST = f"""SELECT url, success, CASE WHEN success THEN '{crawling.OUTPUT_DIR}/' || {slug('url')} || '.md' END AS path,
  CASE WHEN NOT success THEN error END AS error"""

# Rules as they should come out of the derived robots texts.
HOSTS = f"""hosts AS (
  SELECT site, min(path) AS lo, max(path) AS hi, {digest('site', derived.ROBOTS_CLASSES)} AS kind
  FROM (SELECT {domain('url')} AS site, {path('url')} AS path FROM pages) GROUP BY site)"""
RULES = f"""{HOSTS},
rules AS (
  SELECT site, CAST(0 AS BIGINT) AS rule_no, '' AS path, true AS allow FROM hosts WHERE kind = 1
  UNION ALL SELECT site, 0, lo, true FROM hosts WHERE kind = 2
  UNION ALL SELECT site, 1, regexp_extract(lo, '^(/[^/]*)', 1) || '/', false FROM hosts WHERE kind = 2
  UNION ALL SELECT site, 0, hi, false FROM hosts WHERE kind = 3
  UNION ALL SELECT site, 1, hi, true FROM hosts WHERE kind = 3
  UNION ALL SELECT site, 0, lo, false FROM hosts WHERE kind = 4)"""


def allowed(site: str, url: str) -> str:
    return f"""coalesce((SELECT arg_min(allow, rule_no) FROM rules r
      WHERE r.site = {site} AND starts_with({path(url)}, r.path)), true)"""


def judged(name: str, source: str, columns: str) -> str:
    return f"""{name} AS (
  SELECT {columns}, CASE WHEN NOT ({content('url')}) THEN '{eligibility.NON_CONTENT}'
    WHEN NOT ok THEN '{eligibility.DISALLOWED}' END AS reason
  FROM (SELECT s.*, {allowed('s.site', 's.url')} AS ok FROM {source} s))"""


ROOTS = """roots AS (
  SELECT site, CAST(0 AS BIGINT) AS root_pos, 'https://' || site || CASE WHEN kind IN (0, 3) THEN '/sitemap.xml'
    ELSE '/sitemap_index.xml' END AS sitemap_url, kind AS rkind FROM hosts
  UNION ALL SELECT site, 1, 'https://' || site || '/missing.xml', kind FROM hosts WHERE kind = 5)"""

PARTS = f"""placed AS (
  SELECT page_id, url, {domain('url')} AS site FROM pages),
parts AS (
  SELECT p.*, n_parts, {digest("'s' || site", derived.SITEMAP_CLASSES)} AS skind,
         {digest('url', 'n_parts')} AS part
  FROM placed p JOIN (SELECT site, CAST(ceil(sqrt(count(*))) AS BIGINT) AS n_parts FROM placed GROUP BY site) USING (site)),
filled AS (SELECT site, skind, part, row_number() OVER (PARTITION BY site ORDER BY part) AS k,
                  count(*) OVER (PARTITION BY site) AS n
           FROM (SELECT DISTINCT site, skind, part FROM parts)),
leaf AS (
  SELECT site, skind, part, row_number() OVER (PARTITION BY site, part ORDER BY page_id) - 1 AS pos, url AS loc FROM parts
  UNION ALL SELECT site, skind, part, count(*), 'http://other.example.org/x' FROM parts GROUP BY ALL
  UNION ALL SELECT site, skind, part, count(*) + 1, arg_min(url, page_id) FROM parts GROUP BY ALL
  UNION ALL SELECT site, skind, part, count(*) + 2, '' FROM parts GROUP BY ALL)"""

# Place of each sitemap when read depth first: the early index (0) with the last
# part below it (0.0), then the other parts. From '/sitemap.xml' the early index
# also opens '/sitemap_index.xml' (0.1), which takes over the remaining parts.
PLACES = f"""places AS (
  SELECT r.site, root_pos, r.sitemap_url, '' AS path, rkind FROM roots r
  UNION ALL
  SELECT r.site, root_pos, 'https://' || r.site || '/early.xml', '0', rkind FROM roots r WHERE root_pos = 0
  UNION ALL
  SELECT r.site, root_pos, 'https://' || r.site || '/sitemap_index.xml', '0.1', rkind FROM roots r
  WHERE root_pos = 0 AND rkind IN (0, 3)
  UNION ALL
  SELECT r.site, root_pos, 'https://' || r.site || '/part-' || part || '.xml',
    CASE WHEN k = n THEN '0.0' WHEN rkind IN (0, 3) THEN '0.1.' || k ELSE '' || k END, rkind
  FROM roots r JOIN filled f ON f.site = r.site WHERE root_pos = 0)"""

SITEMAP_FOUND = f"""{RULES}, {ROOTS}, {PARTS},
entry AS (
  SELECT l.site, {normal('loc')} AS url, CASE WHEN k = n THEN 0 ELSE k END AS k, pos
  FROM leaf l JOIN filled f ON f.site = l.site AND f.part = l.part
  WHERE l.skind <> 4 AND NOT (l.skind = 3 AND EXISTS (SELECT 1 FROM filled b WHERE b.site = l.site AND b.part = 0))),
{judged('ent', '(SELECT * FROM entry WHERE ' + domain('url') + ' = site)', 'site, url, k, pos')},
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY k, pos) AS rn FROM ent
                          WHERE reason IS NULL) WHERE rn = 1),
sm_found AS (SELECT * FROM (SELECT site, url, k, pos, row_number() OVER (PARTITION BY site ORDER BY k, pos) AS seq FROM firsts)
          WHERE seq <= {crawling.MAX_PAGES}),
stops AS (SELECT site, k AS sk, pos AS sp FROM sm_found WHERE seq = {crawling.MAX_PAGES})"""

_FULL = "(SELECT site FROM stops)"
SITEMAP_SKIPPED = f"""sm_skipped AS (
  SELECT e.site, e.url, e.reason FROM ent e LEFT JOIN stops s USING (site)
  WHERE reason IS NOT NULL AND (sk IS NULL OR k < sk OR (k = sk AND pos < sp))
  UNION ALL
  SELECT site, sitemap_url, '{sitemaps.FAILED}{sitemaps.UNREACHABLE}' FROM roots
  WHERE root_pos = 1 AND site NOT IN {_FULL}
  UNION ALL
  SELECT r.site, sitemap_url, '{sitemaps.FAILED}{sitemaps.MALFORMED}' FROM roots r
  JOIN filled f ON f.site = r.site AND f.part = 0 AND f.skind = 3 WHERE root_pos = 0)"""


def walked(sites: str) -> str:
    """Breadth-first levels of the derived graph: home page, folders, pages, their links."""
    m = crawling.MAX_PAGES
    folder = r"regexp_extract(path, '^(/[^/]*)', 1)"
    return f"""{STORE}, {LINKS},
spot AS (SELECT page_id, url, {normal('url')} AS norm_url, {domain('url')} AS site, {path('url')} AS path FROM pages
         WHERE {domain('url')} IN ({sites})),
fold AS (SELECT site, {folder} AS f, min(page_id) AS lp FROM spot GROUP BY ALL),
l1 AS (SELECT site, 'https://' || site || f AS url, 2 + row_number() OVER (PARTITION BY site ORDER BY lp) - 1 AS seq FROM fold),
raw2 AS (SELECT site, norm_url AS url, min((seq, page_id)) AS o
  FROM (SELECT s.site, s.norm_url, s.page_id, l1.seq FROM spot s JOIN l1 ON l1.site = s.site AND l1.url = 'https://' || s.site || {folder})
  WHERE norm_url NOT IN (SELECT url FROM l1) GROUP BY ALL),
{judged('jud2', 'raw2', 'site, url, o')},
n2 AS (SELECT j.site, j.url, j.o, coalesce(reason, CASE WHEN NOT success THEN '{eligibility.FETCH_FAILED}' || error END) AS reason,
              (SELECT count(*) FROM fold WHERE fold.site = j.site) + 1 AS done
       FROM jud2 j JOIN store ON norm_url = url),
t2 AS (SELECT site, url, o, done + row_number() OVER (PARTITION BY site ORDER BY o) AS seq FROM n2 WHERE reason IS NULL),
full2 AS (SELECT site, o AS stop FROM t2 WHERE seq = {m}),
raw3 AS (SELECT site, url, min((seq, pos)) AS o FROM (
    SELECT t2.site, {normal('r')} AS url, t2.seq, pos
    FROM t2 JOIN (SELECT {normal('url')} AS src, {resolved('url', 'href')} AS r, pos FROM links) ON src = t2.url
    WHERE t2.site NOT IN (SELECT site FROM full2))
  WHERE url NOT IN (SELECT url FROM l1) AND url NOT IN (SELECT url FROM raw2) AND url <> 'https://' || site || '/' GROUP BY ALL),
{judged('jud3', 'raw3', 'site, url')},
bfs_found AS (
  SELECT DISTINCT site, CAST(1 AS BIGINT) AS seq, 'https://' || site || '/' AS url FROM spot
  UNION ALL SELECT site, seq, url FROM l1
  UNION ALL SELECT site, seq, url FROM t2 WHERE seq <= {m}),
bfs_skipped AS (
  SELECT n2.site, url, reason FROM n2 LEFT JOIN full2 USING (site) WHERE reason IS NOT NULL AND (stop IS NULL OR o < stop)
  UNION ALL SELECT site, url, coalesce(reason, '{eligibility.FETCH_FAILED}{pg.ABSENT}') FROM jud3)"""


def strip(x: str) -> str:
    return cut_elements_sql(x, hx.BOILERPLATE)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# References that occur in the given pages' text; '&amp;' comes last.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&amp;", "&"),
)


def text_of(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for name, char in ENTITIES:
        x = f"replace({x}, {quoted(name)}, {quoted(char)})"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'), ' ')"


_TAGS = "|".join(hx.BLOCK_TAGS)
_WEIGHT = "CASE tag " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in hx.TAG_WEIGHTS.items()) + f" ELSE {hx.OTHER_TAG_WEIGHT} END"
BLOCKS = rf"""stripped AS (SELECT page_id, {strip('html')} AS h FROM pages),
split AS (SELECT page_id, string_split(regexp_replace(h, '(?i)<({_TAGS})\b[^>]*>', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS bs
          FROM stripped),
piece AS (SELECT page_id, CAST(generate_subscripts(bs, 1) - 1 AS BIGINT) AS pos, unnest(bs) AS b FROM split),
block AS (SELECT page_id, pos, CASE WHEN contains(b, chr(2)) THEN lower(split_part(b, chr(2), 1)) ELSE '' END AS tag,
                 CASE WHEN contains(b, chr(2)) THEN substr(b, instr(b, chr(2)) + 1) ELSE b END AS h FROM piece),
texted AS (SELECT *, {text_of('h')} AS text,
  {text_of("array_to_string(regexp_extract_all(h, '(?is)<a\\b[^>]*>(.*?)</a>', 1), ' ')")} AS lt FROM block),
scored AS (SELECT *, CASE WHEN len(regexp_extract_all(text, '\S+')) < {hx.MIN_WORDS} THEN -1.0 ELSE
  round((0.4::DOUBLE * coalesce(length(text)::DOUBLE / nullif(length(h), 0), 0)
   + 0.2::DOUBLE * (1 - coalesce(length(lt)::DOUBLE / nullif(length(text), 0), 0))
   + 0.2::DOUBLE * ({_WEIGHT})::DOUBLE + 0.1::DOUBLE * ln(length(text)::DOUBLE + 1)) / 0.9::DOUBLE, 6) END AS score FROM texted),
kept AS (SELECT *, regexp_matches(tag, '^h[1-6]$') OR score >= {hx.PRUNE_THRESHOLD} AS keep FROM scored)"""


def inline(x: str) -> str:
    x = rf"""regexp_replace({x}, '(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))[^>]*>(.*?)</a>', '[\4](\1\2\3)', 'g')"""
    x = rf"regexp_replace({x}, '(?is)<(?:b|strong)>(.*?)</(?:b|strong)>', '**\1**', 'g')"
    return text_of(rf"regexp_replace({x}, '(?is)<(?:i|em)>(.*?)</(?:i|em)>', '*\1*', 'g')")


MARKDOWN = rf"""lined AS (SELECT page_id, pos, keep, tag, {inline('h')} AS t FROM kept),
line AS (SELECT page_id, pos, keep, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN repeat('#', CAST(substr(tag, 2, 1) AS INT)) || ' '
  WHEN tag = 'li' THEN '- ' ELSE '' END || t AS l FROM lined WHERE t <> ''),
md AS (SELECT p.page_id, coalesce(string_agg(l, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE keep),
                                 string_agg(l, chr(10) || chr(10) ORDER BY pos), '') AS markdown
  FROM pages p LEFT JOIN line USING (page_id) GROUP BY p.page_id)"""

_FOUND = "site, seq, url, CAST(NULL AS VARCHAR) AS reason"
_SKIPPED = "SELECT site, CAST(NULL AS BIGINT) AS seq, url, reason"
_ALL_SITES = f"SELECT {domain('url')} FROM pages"

LINK_NORMS = f"""WITH {LINKS} SELECT {normal('r')} AS norm_url FROM (SELECT {resolved('url', 'href')} AS r FROM links)"""

ORACLE = {
    "url_domain": f"SELECT page_id, {domain('url')} AS domain FROM pages",
    "url_resolve": f"WITH {LINKS} SELECT page_id, pos, {resolved('url', 'href')} AS resolved FROM links",
    "url_normalize": f"""WITH {LINKS} SELECT page_id, CAST(-1 AS BIGINT) AS pos, {normal('url')} AS norm_url FROM pages
UNION ALL SELECT page_id, pos, {normal('r')} FROM (SELECT *, {resolved('url', 'href')} AS r FROM links)""",
    "content_url_filter": f"WITH {CANDIDATES} SELECT * FROM candidates WHERE {content('url')}",
    "page_slug": f"SELECT page_id, {slug('url')} AS slug FROM pages",
    "url_dedup": f"""WITH {CANDIDATES} SELECT norm_url, page_id, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY norm_url ORDER BY page_id, pos) AS rn
  FROM (SELECT *, {normal('url')} AS norm_url FROM candidates)) WHERE rn = 1""",
    "crawl_fetch": f"""WITH {CANDIDATES}, {STORE}, {fetched('f', 'candidates', 'page_id, pos, url')}
SELECT page_id, pos, url, success, error FROM f""",
    "page_sink": f"""WITH {REQUESTS}, {STORE}, {BLOCKS}, {MARKDOWN}, {fetched('f', 'requests', 'pos, url')},
win AS (SELECT * FROM (SELECT *, {slug('url')} AS slug,
  row_number() OVER (PARTITION BY {slug('url')} ORDER BY pos DESC) AS rn FROM f WHERE success) WHERE rn = 1)
SELECT slug, win.url, markdown FROM win JOIN md ON page_id = stored_id""",
    "crawl_manifest": f"""WITH {CANDIDATES}, {STORE}, {fetched('f', 'candidates', 'page_id, pos, url')} {MANIFEST} FROM f""",
    "crawl_eligibility": f"""WITH {CANDIDATES}, {RULES},
{judged('j', f'(SELECT *, {domain("url")} AS site FROM candidates)', 'page_id, pos, url')} SELECT * FROM j""",
    "crawl_list": f"""WITH {REQUESTS}, {RULES}, {STORE},
{judged('j', f'(SELECT *, {domain("url")} AS site FROM requests)', 'pos, url')},
{fetched('f', '(SELECT * FROM j WHERE reason IS NULL)', 'pos, url')} {MANIFEST} FROM f""",
    "crawl_report": f"""WITH {CANDIDATES}, {RULES}, {STORE},
{judged('j', f'(SELECT *, {domain("url")} AS site FROM candidates)', 'page_id, site, url')},
{fetched('f', 'j', 'site, url, reason')}
SELECT site, count(*) FILTER (WHERE reason IS NULL) AS urls_attempted,
  count(*) FILTER (WHERE reason IS NULL AND success) AS pages_written, count(*) FILTER (WHERE reason IS NOT NULL) AS skipped
FROM f GROUP BY ROLLUP (site)""",
    "crawl_skips": f"""WITH {CANDIDATES}, {RULES},
{judged('j', f'(SELECT *, {domain("url")} AS site FROM candidates)', 'page_id, pos, url, site')}
SELECT site AS crawl_id, url, reason, row_number() OVER (PARTITION BY site ORDER BY page_id, pos) - 1 AS pos
FROM j WHERE reason IS NOT NULL""",
    "crawl_log": f"""WITH {CANDIDATES}, {RULES}, {STORE},
{judged('j', f'(SELECT *, {domain("url")} AS site FROM candidates)', 'page_id, pos, site, url')},
{fetched('f', 'j', 'page_id, pos, site, url, reason')}
SELECT site AS crawl_id, row_number() OVER (PARTITION BY site ORDER BY page_id, pos) - 1 AS pos, url,
  CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN success THEN 'written' ELSE 'failed' END AS outcome,
  CASE WHEN reason IS NOT NULL THEN reason WHEN success THEN '{crawling.OUTPUT_DIR}/' || {slug('url')} || '.md' ELSE error END AS detail
FROM f""",
    "html_strip": f"SELECT page_id, {strip('html')} AS stripped FROM pages",
    "html_nesting": f"SELECT page_id, {strip('whole')} AS stripped FROM (SELECT page_id, {derived.NESTED_SQL} AS whole FROM pages)",
    "block_prune": f"WITH {BLOCKS} SELECT page_id, pos, tag, text, CAST(score AS DOUBLE) AS score, keep FROM kept",
    "page_markdown": f"WITH {BLOCKS}, {MARKDOWN} SELECT page_id, markdown FROM md",
    "link_extract": f"WITH {LINKS} SELECT page_id, pos, href FROM links",
    "link_internal": f"""WITH {LINKS} SELECT site, target, page_id, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY site, target ORDER BY page_id, pos) AS rn
  FROM (SELECT page_id, pos, {domain('url')} AS site, {normal('r')} AS target
        FROM (SELECT *, {resolved('url', 'href')} AS r FROM links))
  WHERE {domain('target')} = site) WHERE rn = 1""",
    "robots_rules": f"WITH {RULES} SELECT * FROM rules",
    "robots_allowed": f"""WITH {RULES} SELECT page_id, {allowed('s.site', 's.url')} AS allowed
FROM (SELECT page_id, url, {domain('url')} AS site FROM pages) s""",
    "robots_sitemaps": f"WITH {HOSTS}, {ROOTS} SELECT site, root_pos, sitemap_url FROM roots",
    "sitemap_parse": f"""WITH {PARTS},
good AS (SELECT site, 'https://' || site || '/part-' || part || '.xml' AS sitemap_url, 'urlset' AS kind, pos, loc
         FROM leaf WHERE skind <> 4 AND NOT (skind = 3 AND part = 0)),
kids AS (
  SELECT site, CAST(0 AS BIGINT) AS pos, 'https://' || site || '/early.xml' AS loc FROM filled WHERE k = 1
  UNION ALL SELECT site, k, 'https://' || site || '/part-' || part || '.xml' FROM filled),
tops AS (
  SELECT 'https://' || site || '/' || name AS sitemap_url, 'index' AS kind, pos, loc FROM kids CROSS JOIN (VALUES ('sitemap.xml'), ('sitemap_index.xml')) v(name)
  UNION ALL SELECT 'https://' || site || '/' || name, 'index', n + 1, 'https://' || site || '/' || name FROM filled
    CROSS JOIN (VALUES ('sitemap.xml'), ('sitemap_index.xml')) v(name) WHERE k = n
  UNION ALL SELECT 'https://' || site || '/early.xml', 'index', 0, 'https://' || site || '/part-' || part || '.xml' FROM filled WHERE k = n
  UNION ALL SELECT 'https://' || site || '/early.xml', 'index', 1, 'https://' || site || '/sitemap_index.xml' FROM filled WHERE k = n)
SELECT sitemap_url, kind, CAST(NULL AS VARCHAR) AS error, pos, loc FROM good
UNION ALL SELECT sitemap_url, kind, NULL, pos, loc FROM tops
UNION ALL SELECT 'https://' || site || '/part-' || part || '.xml', CASE WHEN skind = 4 THEN 'other' END,
  CASE WHEN skind = 3 THEN '{sitemaps.MALFORMED}' END, NULL, NULL FROM filled WHERE skind = 4 OR (skind = 3 AND part = 0)""",
    "sitemap_expand": f"""WITH {HOSTS}, {ROOTS}, {PARTS}, {PLACES}
SELECT site, root_pos, sitemap_url, path FROM places""",
    "sitemap_discovery": f"""WITH {SITEMAP_FOUND}, {SITEMAP_SKIPPED}
SELECT {_FOUND} FROM sm_found UNION ALL {_SKIPPED} FROM sm_skipped""",
    "bfs_crawl": f"""WITH {RULES}, {walked(_ALL_SITES)}
SELECT {_FOUND} FROM bfs_found UNION ALL {_SKIPPED} FROM bfs_skipped""",
    "site_discovery": f"""WITH {SITEMAP_FOUND},
lost AS (SELECT site FROM hosts WHERE site NOT IN (SELECT site FROM sm_found)),
{walked('SELECT site FROM lost')}
SELECT site, seq, url, 'sitemap' AS source FROM sm_found UNION ALL SELECT site, seq, url, 'links' FROM bfs_found""",
}
