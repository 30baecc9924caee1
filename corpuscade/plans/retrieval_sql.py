"""Independent SQL for the retrieval queries, for checking results in another engine."""

from __future__ import annotations

from corpuscade.operators import chunking, fusion, lexical, vectors
from corpuscade.plans import crawling_sql, retrieval

SENTENCES = r"regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+')"


def tokens(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def terms(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def chunk_ctes(size: int, overlap: int = 0, keep: str = "") -> str:
    """CTEs ending in ``chunks(doc_id, chunk_no, n_tokens, text)``; needs WITH RECURSIVE."""
    return rf"""
sent AS (SELECT doc_id, {SENTENCES} AS ss FROM documents),
cut AS (
  SELECT doc_id, flatten(list_transform(ss, lambda s: CASE WHEN {tokens('s')} > {size}
    THEN list_transform(range(0, (len(regexp_extract_all(s, '\s*\S+(?:\s+$)?')) - 1) // {size} + 1),
      lambda i: array_to_string(list_slice(regexp_extract_all(s, '\s*\S+(?:\s+$)?'), i * {size} + 1, (i + 1) * {size}), ''))
    ELSE [s] END)) AS ps
  FROM sent),
piece AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM cut),
counted AS (SELECT doc_id, i, p, {tokens('p')} AS n FROM piece),
summed AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS c FROM counted),
laid AS (SELECT doc_id, list(p ORDER BY i) AS ps, list(n ORDER BY i) AS ns, list(c ORDER BY i) AS cs
         FROM summed GROUP BY doc_id),
span(doc_id, chunk_no, s, e) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT),
         CAST(len(list_filter(cs, lambda x: x <= {size})) AS BIGINT) FROM laid
  UNION ALL
  SELECT doc_id, chunk_no, s, CAST(len(list_filter(cs, lambda x: x <= base + {size})) AS BIGINT)
  FROM (SELECT doc_id, chunk_no, s, cs, CASE WHEN s = 0 THEN 0 ELSE cs[s] END AS base
        FROM (SELECT span.doc_id, chunk_no + 1 AS chunk_no, cs,
                     CAST(CASE WHEN least({overlap}, {size} - ns[e + 1]) <= 0 THEN e
                          ELSE (CASE WHEN 0 < cs[e] - least({overlap}, {size} - ns[e + 1]) THEN 1 ELSE 0 END)
                               + len(list_filter(cs, lambda x: x < cs[e] - least({overlap}, {size} - ns[e + 1])))
                          END AS BIGINT) AS s
              FROM span JOIN laid USING (doc_id) WHERE e < len(ns)))),
chunks AS (
  SELECT doc_id, chunk_no, CAST(cs[e] - CASE WHEN s = 0 THEN 0 ELSE cs[s] END AS BIGINT) AS n_tokens,
         regexp_replace(array_to_string(list_slice(ps, s + 1, e), ''), '^\s+|\s+$', '', 'g') AS text
  FROM span JOIN laid USING (doc_id)
  WHERE cs[e] - CASE WHEN s = 0 THEN 0 ELSE cs[s] END > 0)"""


def embed_ctes(name: str, source: str, key: str) -> str:
    """``name(key, dim, v)``: nonzero float32 components of the hashed embedding."""
    return rf"""
{name}_n AS (
  SELECT {key}, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS dim, count(*) AS n
  FROM (SELECT {key}, unnest({terms('text')}) AS t FROM {source}) GROUP BY ALL),
{name} AS (
  SELECT {key}, dim, CAST(CAST(n AS DOUBLE) / sqrt(CAST(sum(n * n) OVER (PARTITION BY {key}) AS DOUBLE)) AS FLOAT) AS v
  FROM {name}_n)"""


_ORDER = "score DESC, doc_id, chunk_no"


def ranked(source: str, k: int) -> str:
    return f"""SELECT q_id, doc_id, chunk_no, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY {_ORDER}) AS rank FROM {source}) WHERE rank <= {k}"""


BENCHMARK = "questions AS (SELECT item_id AS q_id, text FROM benchmark)"
USERS = """questions AS (SELECT 'c' || conv_id || '-' || turn AS q_id, text, turn
  FROM conversations WHERE role = 'user')"""
EVERYONE = """questions AS (SELECT 'b' || item_id AS q_id, text FROM benchmark
  UNION ALL SELECT 'c' || conv_id || '-' || turn AS q_id, text FROM conversations WHERE role = 'user')"""

VECTOR = f"""{embed_ctes('ce', 'chunks', 'doc_id, chunk_no')},
{embed_ctes('qe', 'questions', 'q_id')},
v_all AS (
  SELECT q.q_id, c.doc_id, c.chunk_no,
         round(coalesce(s, 0.0), 6) AS score
  FROM questions q CROSS JOIN chunks c
  LEFT JOIN (SELECT q_id, doc_id, chunk_no, sum(CAST(qe.v AS DOUBLE) * CAST(ce.v AS DOUBLE)) AS s
             FROM qe JOIN ce USING (dim) GROUP BY ALL) d
    ON d.q_id = q.q_id AND d.doc_id = c.doc_id AND d.chunk_no = c.chunk_no),
v_pool AS ({ranked('v_all', fusion.POOL_SIZE)})"""

BM25 = f"""
post AS (SELECT doc_id, chunk_no, t, count(*) AS tf
  FROM (SELECT doc_id, chunk_no, unnest({terms('text')}) AS t FROM chunks) GROUP BY ALL),
lens AS (SELECT doc_id, chunk_no, len({terms('text')}) AS n FROM chunks),
corpus AS (SELECT CAST(count(*) AS DOUBLE) AS n_chunks, CAST(sum(n) AS DOUBLE) / count(*) AS mean FROM lens),
dfs AS (SELECT t, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY t),
qt AS (SELECT DISTINCT q_id, t FROM (SELECT q_id, unnest({terms('text')}) AS t FROM questions)),
b_all AS (
  SELECT q_id, doc_id, chunk_no,
         round(sum(ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * {lexical.K1 + 1}
               / (tf + {lexical.K1} * (1 - {lexical.B} + {lexical.B} * n / mean))), 6) AS score
  FROM qt JOIN post USING (t) JOIN dfs USING (t) JOIN lens USING (doc_id, chunk_no) CROSS JOIN corpus
  GROUP BY ALL),
b_pool AS ({ranked('b_all', fusion.POOL_SIZE)})"""

FUSED = f"""
f_all AS (SELECT q_id, doc_id, chunk_no, round(sum(1.0 / ({fusion.RRF_K - 1} + rank)), 6) AS score
  FROM (SELECT q_id, doc_id, chunk_no, CAST(rank AS DOUBLE) AS rank FROM v_pool
        UNION ALL SELECT q_id, doc_id, chunk_no, CAST(rank AS DOUBLE) FROM b_pool) GROUP BY ALL),
f_pool AS ({ranked('f_all', fusion.POOL_SIZE)})"""


def share(q: str, p: str) -> str:
    q = f"list_distinct({q})"
    return f"coalesce(len(list_intersect({q}, {p}))::DOUBLE / nullif(len({q}), 0), 0.0)"


RERANKED = f"""
pair AS (SELECT f.q_id, f.doc_id, f.chunk_no, c.text AS passage,
    {terms('q.text')} AS qt, {terms('c.text')} AS ct
  FROM f_pool f JOIN questions q USING (q_id) JOIN chunks c USING (doc_id, chunk_no)),
grammed AS (SELECT *,
    list_transform(range(1, len(qt)), lambda i: qt[i] || ' ' || qt[i + 1]) AS qb,
    list_transform(range(1, len(ct)), lambda i: ct[i] || ' ' || ct[i + 1]) AS cb FROM pair),
r_all AS (SELECT q_id, doc_id, chunk_no, passage,
    round({share('qt', 'ct')} + {share('qb', 'cb')}, 6) AS score FROM grammed),
r_pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY {_ORDER}) AS rank FROM r_all)
  WHERE rank <= {fusion.FINAL_SIZE})"""

BEST = """
best AS (SELECT q.*, coalesce(m, 0.0) AS best FROM questions q
  LEFT JOIN (SELECT q_id, max(score) AS m FROM r_pool GROUP BY q_id) USING (q_id))"""


def pipeline(questions: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",".join([questions, chunk_ctes(chunking.CHUNK_SIZE), *parts])


_WHOLE = (VECTOR, BM25, FUSED, RERANKED)
_POOL = "SELECT q_id, doc_id, chunk_no, score, rank FROM"

_UNIT = """unit AS (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(CAST(CAST(v AS DOUBLE) / n AS FLOAT) AS DOUBLE)) AS e
  FROM (SELECT vec_id, embedding,
        sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) AS n
        FROM embeddings))"""


def _vec_ranked(source: str) -> str:
    return f"""SELECT q_id, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM {source})
WHERE rank <= {fusion.POOL_SIZE}"""


def _signature(table: int, bits: int, dims: int) -> str:
    planes = [[vectors.plane_sign(table, b, d) for d in range(dims)] for b in range(bits)]
    return " + ".join(
        f"CASE WHEN list_dot_product(e, {p}::DOUBLE[]) >= 0 THEN {1 << b} ELSE 0 END"
        for b, p in enumerate(planes)
    )


def _ann(tables: int = 8, bits: int = 4, dims: int = 64) -> str:
    signed = " UNION ALL ".join(
        f"SELECT vec_id, e, {t} AS tab, {_signature(t, bits, dims)} AS bucket FROM unit" for t in range(tables)
    )
    return f"""WITH {_UNIT}, signed AS ({signed}),
near AS (SELECT DISTINCT a.vec_id AS q_id, b.vec_id, round(list_dot_product(a.e, b.e), 6) AS score
  FROM signed a JOIN signed b USING (tab, bucket) WHERE a.vec_id % 100 = 0),
one AS (SELECT q_id, vec_id, max(score) AS score FROM near GROUP BY ALL)
{_vec_ranked('one')}"""


_WRITTEN = f"""documents AS (
  SELECT row_number() OVER (ORDER BY slug) - 1 AS doc_id, slug, markdown AS text FROM ({crawling_sql.ORACLE["page_sink"]}))"""

ORACLE = {
    "document_scan": """SELECT doc_id, source || '/' || doc_id || '.md' AS path,
  CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha FROM documents""",
    "sentence_split": rf"""SELECT doc_id, pos, sentence FROM (
  SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS pos,
         regexp_replace(unnest(ss), '^\s+|\s+$', '', 'g') AS sentence
  FROM (SELECT doc_id, {SENTENCES} AS ss FROM documents)) WHERE sentence <> ''""",
    "chunk_pack": f"WITH RECURSIVE {chunk_ctes(retrieval.SMALL_CHUNK)} SELECT * FROM chunks",
    "chunk_overlap": f"WITH RECURSIVE {chunk_ctes(chunking.CHUNK_SIZE, chunking.CHUNK_OVERLAP)} SELECT * FROM chunks",
    "chunk_stats": f"""WITH RECURSIVE {chunk_ctes(chunking.CHUNK_SIZE)}
SELECT source, count(*) AS n_chunks, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, max(n_tokens) AS max_tokens,
       round(avg(n_tokens), 6) AS avg_tokens
FROM chunks JOIN documents USING (doc_id) GROUP BY source""",
    "chunk_embed": f"""WITH RECURSIVE {chunk_ctes(chunking.CHUNK_SIZE)}, {embed_ctes('ce', 'chunks', 'doc_id, chunk_no')}
SELECT doc_id, chunk_no, dim, round(CAST(v AS DOUBLE), 6) AS value FROM ce""",
    # After the refreshes: every document with its current text, less the removed ones.
    "index_roundtrip": f"""WITH RECURSIVE {chunk_ctes(chunking.CHUNK_SIZE)},
kept AS (SELECT source AS namespace, c.*, {terms('c.text')} AS ts FROM chunks c JOIN documents d USING (doc_id) WHERE doc_id % 11 <> 0),
kinds AS (SELECT source AS namespace, CASE WHEN bool_or(lang = 'en') THEN 'vector' ELSE 'list' END AS kind FROM documents GROUP BY 1),
posting AS (SELECT namespace, doc_id, chunk_no, unnest(list_distinct(ts)) AS term FROM kept),
term AS (SELECT namespace, term, count(*) AS df FROM posting GROUP BY 1, 2),
seen AS (SELECT namespace, doc_id, chunk_no, count(*) AS n_distinct, CAST(sum(df) AS BIGINT) AS sum_df
         FROM posting JOIN term USING (namespace, term) GROUP BY 1, 2, 3)
SELECT namespace, doc_id, chunk_no, n_tokens, CAST(len(ts) AS BIGINT) AS n_terms, sha256(text) AS text_sha, kind,
       coalesce(n_distinct, 0) AS n_distinct, coalesce(sum_df, 0) AS sum_df
FROM kept LEFT JOIN seen USING (namespace, doc_id, chunk_no) JOIN kinds USING (namespace)""",
    "index_registry": f"""WITH RECURSIVE {chunk_ctes(chunking.CHUNK_SIZE)},
built AS (SELECT source AS namespace, count(*) AS n_chunks FROM chunks JOIN documents USING (doc_id) GROUP BY 1),
asked AS (SELECT source AS namespace FROM documents UNION SELECT lang FROM documents)
SELECT namespace, CASE WHEN n_chunks IS NOT NULL THEN md5(namespace || ':list') END AS index_id,
       CASE WHEN n_chunks IS NOT NULL THEN 'list' END AS kind, n_chunks, n_chunks IS NOT NULL AS index_exists
FROM asked LEFT JOIN built USING (namespace)""",
    "vector_topk": f"{pipeline(BENCHMARK, VECTOR)} {_POOL} v_pool",
    "vector_neighbours": f"""WITH {_UNIT},
every AS (SELECT a.vec_id AS q_id, b.vec_id, round(list_dot_product(a.e, b.e), 6) AS score FROM unit a CROSS JOIN unit b WHERE a.vec_id % 100 = 0)
{_vec_ranked('every')}""",
    "bm25_topk": f"{pipeline(BENCHMARK, BM25)} {_POOL} b_pool",
    "hybrid_rrf": f"{pipeline(BENCHMARK, VECTOR, BM25, FUSED)} {_POOL} f_pool",
    "list_retrieve": f"""{pipeline(BENCHMARK)},
qf AS (SELECT q_id, text, {terms('text')} AS t FROM questions),
cf AS (SELECT doc_id, chunk_no, {terms('text')} AS t FROM chunks),
q2 AS (SELECT q_id, list_distinct(t) AS t, list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS b FROM qf),
c2 AS (SELECT doc_id, chunk_no, list_distinct(t) AS t, list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS b FROM cf),
th AS (SELECT q_id, doc_id, chunk_no, count(*) AS n FROM (SELECT q_id, unnest(t) AS x FROM q2) JOIN (SELECT doc_id, chunk_no, unnest(t) AS x FROM c2) USING (x) GROUP BY ALL),
bh AS (SELECT q_id, doc_id, chunk_no, count(*) AS n FROM (SELECT q_id, unnest(b) AS x FROM q2) JOIN (SELECT doc_id, chunk_no, unnest(b) AS x FROM c2) USING (x) GROUP BY ALL),
l_all AS (SELECT q_id, doc_id, chunk_no,
  round(coalesce(th.n::DOUBLE / nullif(len(q2.t), 0), 0) + coalesce(bh.n::DOUBLE / nullif(len(q2.b), 0), 0), 6) AS score
  FROM q2 CROSS JOIN (SELECT doc_id, chunk_no FROM c2)
  LEFT JOIN th USING (q_id, doc_id, chunk_no) LEFT JOIN bh USING (q_id, doc_id, chunk_no)),
l_pool AS ({ranked('l_all', fusion.FINAL_SIZE)})
{_POOL} l_pool""",
    "rerank_top3": f"{pipeline(BENCHMARK, *_WHOLE)} {_POOL} r_pool",
    "rag_context": f"""{pipeline(BENCHMARK, *_WHOLE)},
ctx AS (SELECT q.q_id, q.text, count(r.q_id) AS n_passages,
   coalesce(string_agg(passage, chr(10) || chr(10) ORDER BY rank), '') AS context
   FROM questions q LEFT JOIN r_pool r USING (q_id) GROUP BY q.q_id, q.text)
SELECT q_id, n_passages, context,
  'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM ctx""",
    "retrieval_gate": f"""{pipeline(EVERYONE, *_WHOLE, BEST)}
SELECT q_id, best, CASE WHEN best >= {retrieval.GATE_THRESHOLD} THEN '{fusion.USE_KNOWLEDGE_BASE}'
  ELSE '{fusion.ANSWER_DIRECTLY}' END AS decision FROM best""",
    "invocation_rate": f"""{pipeline(USERS, *_WHOLE, BEST)},
called AS (SELECT CAST(theta AS DOUBLE) AS theta, turn, CASE WHEN best >= theta THEN 1 ELSE 0 END AS called
  FROM best CROSS JOIN (SELECT unnest({retrieval.RATE_THRESHOLDS}) AS theta))
SELECT theta, turn, count(*) AS n_questions, CAST(sum(called) AS BIGINT) AS n_called, round(avg(called), 6) AS rate
FROM called GROUP BY GROUPING SETS ((theta, turn), (theta))""",
    "rank_shift": f"""{pipeline(BENCHMARK, VECTOR, BM25, FUSED)}
SELECT q_id, doc_id, chunk_no, v.rank AS rank_before, f.rank AS rank_after, v.rank - f.rank AS shift
FROM v_pool v FULL JOIN f_pool f USING (q_id, doc_id, chunk_no)""",
    "ann_topk": _ann(),
    # The pages' texts stand in for the table of documents.
    "crawl_answers": f"""WITH RECURSIVE {_WRITTEN},
{pipeline(BENCHMARK, *_WHOLE).removeprefix("WITH RECURSIVE ")} {_POOL} r_pool""",
    "directory_index": f"""WITH RECURSIVE {_WRITTEN}, {chunk_ctes(chunking.CHUNK_SIZE)}
SELECT slug, c.chunk_no, n_tokens, sha256(c.text) AS text_sha FROM chunks c JOIN documents d USING (doc_id)""",
}
ORACLE["list_answers"] = ORACLE["list_retrieve"]
