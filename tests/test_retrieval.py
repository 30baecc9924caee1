"""Chunking, index and retrieval: invariants, and every plan against brute force."""

import math
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpuscade.functions import text as tx
from corpuscade.operators import chunking, fusion, lexical, models, vectors
from corpuscade.operators.embedding import embed_chunks
from corpuscade.operators.skew import fits_broadcast, lookup_join, salted_join
from corpuscade.operators.topk import top_k
from corpuscade.plans import retrieval
from corpuscade.sources import index_store

DOCUMENT = """# A heading

One sentence spread
over three
lines.

Another paragraph, again of just
one sentence, over
lines.

A third. It has short sentences. Each is kept. They make more than one chunk when the size is small.
"""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=40), st.integers(1, 20), st.integers(0, 15))
def test_span_fold(counts, extra, overlap):
    size = max(counts) + extra
    overlap = min(overlap, size - 1)
    counts = np.array(counts)
    spans = chunking.span_fold(counts, size, overlap)
    pairs = list(zip(spans[::2], spans[1::2]))
    assert pairs[0][0] == 0 and pairs[-1][1] == len(counts)
    for a, b in pairs:
        assert a < b and counts[a:b].sum() <= size
    for (a, b), (c, d) in zip(pairs, pairs[1:]):
        assert a < c <= b < d
        assert counts[a : b + 1].sum() > size  # greedy: the next piece did not fit
        assert counts[c:b].sum() <= overlap


def test_chunks_hold_the_whole_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(
        spark.createDataFrame(
            [(-1, ""), (-2, None), (-3, "word " * 50), (-4, "no stop here\n\n"), (-5, DOCUMENT), (-6, "...!? \n")],
            "doc_id long, text string",
        )
    )
    for size in (7, 64, 1024):
        chunks = chunking.chunk_documents(docs, size).orderBy("doc_id", "chunk_no").collect()
        assert all(0 < c["n_tokens"] <= size for c in chunks)
        got, numbers = {}, {}
        for c in chunks:
            got.setdefault(c["doc_id"], []).extend(c["text"].split())
            numbers.setdefault(c["doc_id"], []).append(c["chunk_no"])
        for d in docs.collect():
            # Token borders inside a token, as in "a.b", may fall between sentences.
            assert "".join(got.get(d["doc_id"], [])) == "".join((d["text"] or "").split()), d["doc_id"]
        assert all(n == list(range(len(n))) for n in numbers.values())
        assert -1 not in got and -2 not in got


def test_sentences_cover_the_text(spark):
    df = spark.createDataFrame([(DOCUMENT,), ("a.b..c\n\nd! e?",), ("",)], "text string")
    for r in df.select("text", tx.sentences(F.col("text")).alias("s")).collect():
        assert "".join(r["s"]) == r["text"]


def _corpus(spark, tmp_path, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return index_store.create_or_load(docs, str(tmp_path / "index"), "t", chunk_size=16)


TEXTS = [
    "the cat sat on the mat", "the dog sat", "a cat and a dog", "the the the the", "rare bird in the tree",
    "cat cat cat", "the cat sat on the mat", "nothing to see", "run bundle exec in the shell", "exec the bundle " * 12,
]
QUESTIONS = ["the cat", "bundle exec", "zebra", "the", "rare dog the", "sat on the mat", ""]


def _brute_bm25(chunks, question, k, k1=1.5, b=0.75):
    toks = {i: t.lower().split() for i, t in chunks.items()}
    mean = sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    rows = []
    for i, t in toks.items():
        tf, score = Counter(t), 0.0
        for w in set(question.split()):
            if tf[w]:
                idf = math.log(1 + (len(toks) - df[w] + 0.5) / (df[w] + 0.5))
                score += idf * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / mean))
        if score:
            rows.append((-round(score, 6), i))
    return [(i, -s) for s, i in sorted(rows)[:k]]


def test_bm25_plans_match_brute_force(spark, tmp_path):
    index = _corpus(spark, tmp_path, TEXTS)
    chunks = {(r["doc_id"], r["chunk_no"]): r["text"] for r in index.chunks.collect()}
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "q_id long, text string")
    for k in (1, 3, 20):
        for block in (8192, 0):
            rows = lexical.bm25_top_k(index, questions, k, question_block=block).orderBy("q_id", "rank").collect()
            for q, text in enumerate(QUESTIONS):
                got = [((r["doc_id"], r["chunk_no"]), r["score"]) for r in rows if r["q_id"] == q]
                want = _brute_bm25(chunks, text, k)
                assert [g[0] for g in got] == [w[0] for w in want], (k, block, text)
                assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=2e-6)


def test_list_retrieval_fills_up_and_plans_agree(spark, tmp_path):
    index = _corpus(spark, tmp_path, TEXTS)
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "q_id long, text string")
    texts = index.chunks.select("doc_id", "chunk_no", F.col("text").alias("passage"))
    every = questions.crossJoin(texts).select(
        "q_id", "doc_id", "chunk_no", F.round(fusion.overlap_score(F.col("text"), F.col("passage")), 6).alias("score")
    )
    want = sorted(map(tuple, top_k(every, 3).select("q_id", "rank", "doc_id", "chunk_no", "score").collect()))
    for block in (8192, 0):
        got = lexical.list_top_k(index, questions, 3, question_block=block)
        assert sorted(map(tuple, got.select("q_id", "rank", "doc_id", "chunk_no", "score").collect())) == want
    got = lexical.list_top_k(index, questions, 3, scorer=fusion.overlap_score)
    assert sorted(map(tuple, got.select("q_id", "rank", "doc_id", "chunk_no", "score").collect())) == want


def test_exact_term_rises_with_fusion(spark, tmp_path):
    index = _corpus(spark, tmp_path, TEXTS)
    question = spark.createDataFrame([(0, "how do I run bundle exec")], "q_id long, text string")
    vector = retrieval.vector_pool(index, question)
    fused = fusion.reciprocal_rank_fusion([vector, retrieval.lexical_pool(index, question)])
    moved = fusion.rank_shift(vector, fused).where("doc_id = 8").first()
    assert moved["shift"] >= 0 and moved["rank_after"] <= 2


def test_a_model_is_loaded_once_a_task_and_learns_what_it_is_shown(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    y = (x @ [2.0, -1.0, 0.0, 0.5] + 0.3 > 0).astype(int)
    examples = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y)], "x array<double>, y int").repartition(3)
    w = models.learn_weights(examples)
    assert np.mean((x @ w[:-1] + w[-1] > 0) == y) > 0.97
    assert models.learn_weights(examples.limit(0)).tolist() == [1, 1, 1, 0, 0]
    texts = spark.createDataFrame([(i, "red fox runs", f"the red fox {'runs' if i % 2 else 'sits'} {i}") for i in range(3000)], "i long, q string, p string")
    loads = spark.sparkContext.accumulator(0)
    score = models.learned_scorer(np.array([1.0, 1.0, 1.0, 0.0, -1.0]), loads)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        rows = texts.repartition(4).select("i", score(F.col("q"), F.col("p")).alias("s")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert loads.value == 4
    assert min(r["s"] for r in rows if r["i"] % 2) > max(r["s"] for r in rows if not r["i"] % 2)
    shown = spark.createDataFrame([("a b c d", "x a b c y"), ("a", "a"), ("", "z"), ("a b", "")], "q string, p string")
    got = [r["s"] for r in shown.select(models.signals(F.col("q"), F.col("p")).alias("s")).collect()]
    assert np.allclose(got, [[3 / 4, 2 / 3, 2 / 3, np.log1p(5)], [1, 0, 0, np.log1p(1)], [0, 0, 0, np.log1p(1)], [0, 0, 0, 0]])


def test_fusion_ignores_pool_order_and_keeps_single_pool_chunks(spark):
    schema = "q_id long, doc_id long, chunk_no int, rank int"
    a = spark.createDataFrame([(0, 1, 0, 1), (0, 2, 0, 2)], schema)
    b = spark.createDataFrame([(0, 2, 0, 1), (0, 3, 0, 2)], schema)
    one = fusion.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()
    assert one == fusion.reciprocal_rank_fusion([b, a]).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in one] == [
        (2, round(1 / 60 + 1 / 61, 6)), (1, round(1 / 60, 6)), (3, round(1 / 61, 6))
    ]


def test_vector_plans_match_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[50] = v[10]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    questions = table.where("vec_id < 40").select(F.col("vec_id").alias("q_id"), "embedding")
    sims = np.round(v.astype(np.float64) @ v[:40].astype(np.float64).T, 6)
    want = {q: sorted(range(300), key=lambda i: (-sims[i, q], i))[:5] for q in range(40)}

    def collect(df):
        out = {}
        for r in df.orderBy("q_id", "rank").collect():
            out.setdefault(r["q_id"], []).append(r["vec_id"])
        return out

    assert collect(vectors.exact_top_k(table, questions, 5, ids=("vec_id",))) == want
    blocked = vectors.exact_top_k(table, questions, 5, ids=("vec_id",), question_block=7, vector_block=40)
    assert collect(blocked) == want
    near = collect(vectors.approximate_top_k(table, questions, 5, ids=("vec_id",), dimensions=8))
    hit = sum(len(set(near[q]) & set(want[q])) for q in range(40)) / 200
    assert all(near[q][0] == want[q][0] for q in range(40)) and hit > 0.8


def _surface(rows, dimensions=16, seed=4):
    """Unit vectors that lie on few dimensions, as learned embeddings do."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(rows, 4)) @ rng.normal(size=(4, dimensions)) + 0.01 * rng.normal(size=(rows, dimensions))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_inverted_lists_find_what_is_near(spark):
    v = _surface(4000)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    questions = table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    sims = np.round(v.astype(np.float64) @ v[::50].astype(np.float64).T, 6)
    want = {q * 50: set(sorted(range(4000), key=lambda i: (-sims[i, q], i))[:10]) for q in range(80)}

    def collect(**options):
        out = {}
        for r in vectors.list_top_k(table, questions, 10, ids=("vec_id",), list_rows=64, **options).collect():
            out.setdefault(r["q_id"], {})[r["vec_id"]] = r["score"]
        return out

    in_place, routed = collect(), collect(question_block=7, vector_block=500)
    assert in_place == routed  # both plans search the same lists
    assert sum(len(want[q] & set(in_place[q])) for q in want) / 800 >= 0.9
    for q, found in in_place.items():
        assert all(abs(score - sims[i, q // 50]) < 2e-6 for i, score in found.items()) and len(found) == 10
    everything = collect(probes=63)
    assert all(set(everything[q]) == want[q] for q in want)
    assert vectors.list_top_k(table.limit(0), questions, 10, ids=("vec_id",)).collect() == []
    assert vectors.list_top_k(table, questions.limit(0), 10, ids=("vec_id",)).collect() == []


def test_work_for_a_question_does_not_grow_with_the_vectors():
    pairs = []
    for rows in (2_000, 8_000, 32_000):
        v = _surface(rows)
        centres = vectors.spherical_k_means(v[:: max(1, rows // 8_000)], -(-rows // 128))
        probes = vectors.needed_probes(v[:: max(1, rows // 8_000)], centres, vectors.TARGET)
        sizes = np.bincount(vectors._nearest(v, centres)[0], minlength=len(centres))
        pairs.append(sizes[vectors._probed(v[:100], centres, probes)].sum(1).mean())
    assert max(pairs) < 2.5 * min(pairs) and pairs[-1] < 32_000 / 10


def test_recall_of_inverted_lists_on_the_given_vectors(spark, sf_dir):
    rows = retrieval.ivf_recall(spark, sf_dir).collect()
    assert rows and sum(r["found"] for r in rows) >= 0.9 * sum(r["wanted"] for r in rows)


def test_index_refresh_registry_and_reload(spark, tmp_path):
    base = str(tmp_path / "idx")
    docs = spark.createDataFrame(
        [("a", 1, "one two."), ("a", 2, "three."), ("b", 3, "four five six.")], "namespace string, doc_id long, text string"
    )
    assert not index_store.index_exists(spark, base, "a")
    index_store.create_index(docs, base)
    more = docs.unionByName(
        spark.createDataFrame([("a", 4, "seven two."), ("b", 5, "three.")], "namespace string, doc_id long, text string")
    )
    index_store.refresh_index(more, base)
    index_store.refresh_index(more, base)  # nothing new the second time
    other = spark.newSession()
    a = index_store.load_index(other, base, "a")
    assert a.n_chunks == 3 and a.n_terms == 5
    asked = other.createDataFrame([("two",), ("gone",)], "feature string")
    assert [(r["feature"], r["df"]) for r in a.stats(asked, small=True).collect()] == [("two", 2)]
    assert index_store.load_index(other, base, "b").n_chunks == 2
    # Rebuilding one namespace leaves the other alone.
    index_store.create_index(docs.where("namespace = 'a'"), base, kind="list")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "namespace string")
    rows = {r["namespace"]: r for r in index_store.registry(spark, base, asked).collect()}
    assert (rows["a"]["kind"], rows["a"]["n_chunks"]) == ("list", 2)
    assert (rows["b"]["kind"], rows["b"]["n_chunks"]) == ("vector", 2)
    assert not rows["c"]["index_exists"] and rows["b"]["index_exists"]


def _snapshot(spark, base):
    """What all namespaces hold, whatever generations it lies in."""
    rows = {}
    for name, columns in (
        ("chunks", ["doc_id", "chunk_no", "n_tokens", "n_terms", "term_keys", "tfs", "text"]), ("postings", ["term", "doc_id", "chunk_no", "tf", "n_terms"]),
        ("terms", ["term", "df"]), ("documents", ["doc_id", "text_sha"]),
    ):
        rows[name] = sorted(map(str, index_store.live(spark, base, name).select("namespace", *columns).collect()))
    registered = index_store.current(spark, base).select("namespace", "index_id", "kind", "n_chunks", "n_terms")
    return rows | {"registry": sorted(map(str, registered.collect()))}


FIRST = [("a", 1, "alpha beta gamma delta."), ("a", 2, "alpha beta."), ("b", 3, "one two."), ("d", 8, "stays as it is.")]
AFTER = [("a", 1, "omega sigma."), ("a", 2, "alpha beta."), ("a", 4, "omega sigma alpha alpha."), ("c", 6, "alpha. new words."), ("d", 8, "stays as it is.")]
DOCS = "namespace string, doc_id long, text string"


def test_a_refresh_that_breaks_off_anywhere_leaves_the_old_index(spark, tmp_path, monkeypatch):
    """Every write fails once, in the middle of its rows: nothing changes until the last is done.
    Namespace b ends up empty; d is not touched."""
    gone = spark.createDataFrame([("b", 3), ("b", 99), ("zz", 1)], "namespace string, doc_id long")
    new = spark.createDataFrame(AFTER, DOCS)
    fresh = str(tmp_path / "fresh")
    index_store.create_index(new, fresh, kind="list")
    want = _snapshot(spark, fresh)
    base = str(tmp_path / "refreshed")
    index_store.create_index(spark.createDataFrame(FIRST, DOCS), base, kind="list")
    before = _snapshot(spark, base)
    opened = index_store.load_index(spark, base, "a")
    write, publish = index_store._write, index_store._publish
    names = ["chunks", "postings", "terms", "documents", "removed", "registry"]

    def broken(df):
        fails = F.udf(lambda: 1 // 0, "int").asNondeterministic()
        return df.withColumn("namespace", F.when(fails().isNotNull(), F.col("namespace")))

    for stop in names:
        monkeypatch.setattr(index_store, "_write", lambda df, at, name, g, *by: write(broken(df) if name == stop else df, at, name, g, *by))
        monkeypatch.setattr(index_store, "_publish", lambda df, at, g: publish(broken(df) if stop == "registry" else df, at, g))
        try:
            index_store.refresh_index(new, base, kind="list", removed=gone)
        except Exception as error:
            assert "ZeroDivisionError" in str(error)
        else:
            raise AssertionError(stop)
        assert _snapshot(spark, base) == before, stop
    monkeypatch.setattr(index_store, "_write", write)
    monkeypatch.setattr(index_store, "_publish", publish)
    index_store.refresh_index(new, base, kind="list", removed=gone)
    assert _snapshot(spark, base) == want
    # Who had it open still reads what it opened, until the old generations are swept.
    assert opened.chunks.count() == 2 and {r["text"] for r in opened.chunks.collect()} == {FIRST[0][2], FIRST[1][2]}
    assert index_store.sweep(spark, base) == 0  # all of it is young
    assert index_store.sweep(spark, base, older_than_hours=-1) > 0
    assert _snapshot(spark, base) == want


def test_no_write_touches_other_namespaces(spark, tmp_path):
    base = tmp_path / "idx"
    index_store.create_index(spark.createDataFrame(FIRST, DOCS), str(base), kind="list")
    before = {p: p.stat().st_mtime_ns for p in base.rglob("*.parquet")}
    index_store.refresh_index(spark.createDataFrame(AFTER[:1], DOCS), str(base))
    index_store.refresh_index(spark.createDataFrame([], DOCS), str(base), removed=spark.createDataFrame([("b", 3)], "namespace string, doc_id long"))
    after = {p: p.stat().st_mtime_ns for p in base.rglob("*.parquet")}
    assert before.items() <= after.items()
    new = [str(p.relative_to(base)) for p in after.keys() - before.keys()]
    assert new and not any("namespace=d" in p for p in new) and not any(p.startswith("chunks") and "namespace=b" in p for p in new)


def test_compaction_changes_nothing_that_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_store, "BLOCK", 2)
    monkeypatch.setattr(index_store, "BUCKET_ROWS", 4)
    base, fresh = str(tmp_path / "many"), str(tmp_path / "one")
    texts = [f"word{i % 3} common common. tail{i}" for i in range(12)]
    docs = [("n", i, t) for i, t in enumerate(texts)]
    index_store.create_index(spark.createDataFrame(docs[:6], DOCS), base)
    for at in range(6, 12, 2):
        index_store.refresh_index(spark.createDataFrame([*docs[:2], *docs[at : at + 2]], DOCS), base, removed=spark.createDataFrame([("n", at - 4)], "namespace string, doc_id long"))
    left = [d for d in docs if d[1] not in (2, 4, 6)]
    index_store.create_index(spark.createDataFrame(left, DOCS), fresh)
    want = _snapshot(spark, fresh)
    assert _snapshot(spark, base) == want
    index_store.refresh_index(spark.createDataFrame([("n", 0, "other")], DOCS), base)
    index_store.refresh_index(spark.createDataFrame(docs[:1], DOCS), base)
    assert _snapshot(spark, base) == want
    questions = spark.createDataFrame([(0, "common word1"), (1, "tail7 tail2"), (2, "tail6")], "q_id long, text string")
    answers = lambda at, b: sorted(map(tuple, lexical.bm25_top_k(index_store.load_index(spark, at, "n"), questions, 4, question_block=b).collect()))
    assert answers(base, 8192) == answers(base, 0) == answers(fresh, 8192)
    index_store.compact(spark, base, spark.createDataFrame([("n",)], "namespace string"))
    assert len(index_store.load_index(spark, base, "n").segments) == 1
    assert _snapshot(spark, base) == want and answers(base, 0) == answers(fresh, 0)


def test_kind_stays_when_refreshed(spark, tmp_path):
    base = str(tmp_path / "kind")
    index_store.create_index(spark.createDataFrame([("a", 1, "x y.")], DOCS), base, kind="list")
    index_store.refresh_index(spark.createDataFrame([("a", 1, "z."), ("b", 1, "q.")], DOCS), base)
    kinds = {r["namespace"]: r["kind"] for r in index_store.current(spark, base).collect()}
    assert kinds == {"a": "list", "b": "vector"}


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_postings_are_pruned_by_bucket_and_blocks_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_store, "BLOCK", 4)
    monkeypatch.setattr(index_store, "BUCKET_ROWS", 200)
    # One term in all documents, often in few of them: most of its blocks cannot matter.
    rnd = np.random.default_rng(1)
    texts = ["common " * (30 if i < 3 else 1) + " ".join(f"w{x}" for x in rnd.integers(0, 500, 20)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = index_store.create_or_load(docs, str(tmp_path / "index"), "t")
    assert index.segments[0][1] >= 8
    questions = spark.createDataFrame([(0, "common")], "q_id long, text string")
    asked = lexical.question_terms(questions).select("feature").distinct()
    assert "dynamicpruning" in _plan(index.stats(asked, small=True)).lower().split("== physical plan ==")[1]
    opened = []
    postings = lexical._postings

    def watched(index, features, small, weigh, keep, where=None, best=None):
        rows = postings(index, features, small, weigh, keep, where, best)
        opened.append((rows.count(), postings(index, features, small, weigh, keep).count(), _plan(rows)))
        return rows

    monkeypatch.setattr(lexical, "_postings", watched)
    got = lexical.bm25_top_k(index, questions, 3, question_block=0).collect()
    assert "dynamicpruning" in opened[0][2].lower().split("== physical plan ==")[1]
    assert [every for _, every, _ in opened] == [200, 200] and all(read <= 12 for read, _, _ in opened)
    scan = lexical.bm25_top_k(index, questions, 3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, scan))


def test_the_scan_moves_nothing_before_the_last_top_k(spark, tmp_path):
    index = _corpus(spark, tmp_path, TEXTS)
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "q_id long, text string")
    for rows in (lexical.bm25_top_k(index, questions, 3), lexical.list_top_k(index, questions, 3)):
        tree = rows._jdf.queryExecution().executedPlan().toString()
        below = tree.split("MapInArrow")
        # Whatever stands under a scan's MapInArrow, up to its parquet scan, exchanges nothing.
        assert len(below) > 1 and all("Exchange" not in part.split("FileScan")[0] for part in below[1:])


def test_plans_agree_on_terms_that_weigh_nothing(spark):
    n = 10_000_000
    chunks = spark.createDataFrame([(1, 0, 3, ["every"], [1], "x"), (2, 0, 3, ["every"], [1], "x")], "doc_id long, chunk_no int, n_terms int, terms array<string>, tfs array<int>, text string")
    chunks = chunks.withColumn("term_keys", F.transform("terms", lexical.feature_key))
    schema = {name: index_store.SCHEMAS[name] for name in ("postings", "terms")}
    postings = spark.createDataFrame([("every", [1, 2], [0, 0], [1, 1], [3, 3], 1, 3, 1, 2, 0, "n", 0)], schema["postings"])
    terms = spark.createDataFrame([("every", n, 1, 3, 0, "n", 0)], schema["terms"])
    index = index_store.Index("n", "vector", n, 3 * n, chunks, postings, terms)
    asked = spark.createDataFrame([(0, "every")], "q_id long, text string")
    scan, pruned = (sorted(tuple(r) for r in lexical.bm25_top_k(index, asked, 5, question_block=b).collect()) for b in (8192, 0))
    assert scan == pruned and len(scan) == 2


def test_salted_join_equals_plain_join(spark):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("f")
    )
    dim = spark.range(0, 490).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))
    dim = dim.unionByName(spark.createDataFrame([(7, -1)], "k long, d long"))
    for how in ("inner", "left"):
        want = sorted(map(str, facts.join(dim, "k", how).collect()))
        assert sorted(map(str, salted_join(facts, dim, ["k"], how, task_rows=5).collect())) == want
        assert sorted(map(str, lookup_join(facts, dim, ["k"], how, max_rows=10).collect())) == want
    assert fits_broadcast(dim) and not fits_broadcast(dim, max_rows=10) and not fits_broadcast(dim, max_bytes=100)


def test_scratch_tables_go_when_they_are_discarded(spark):
    from corpuscade.session import discard, materialize

    one, two = materialize(spark.range(5), "kept"), materialize(spark.range(7), "gone")
    discard(two, spark.range(1))
    discard(two)
    assert one.count() == 5
    try:
        two.count()
    except Exception as error:
        assert "FILE_NOT_EXIST" in str(error) or "does not exist" in str(error) or "FileNotFound" in str(error)
    else:
        raise AssertionError("still there")


def test_embedding_is_unit_and_hashed(spark):
    df = spark.createDataFrame([(0, "b a a"), (1, ""), (2, "Ünï 1")], "i long, text string")
    rows = {r["i"]: r["embedding"] for r in embed_chunks(df).collect()}
    assert len(rows[0]) == 64 and abs(sum(x * x for x in rows[0]) - 1) < 1e-6
    assert set(rows[1]) == {0.0} and sum(x > 0 for x in rows[2]) == 2


def test_passages_are_found_verbatim(spark, sf_dir):
    """A benchmark text that some document holds whole must be found at the top."""
    questions = retrieval.benchmark_questions(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    holders = {}
    for q in questions.collect():
        ids = {r["doc_id"] for r in docs.where(F.contains("text", F.lit(q["text"]))).select("doc_id").collect()}
        if ids:
            holders[q["q_id"]] = ids
    best = retrieval.reranked(retrieval.default_index(spark, sf_dir), questions)
    top = {}
    for r in best.collect():
        top.setdefault(r["q_id"], set()).add(r["doc_id"])
    assert all(top[q] & ids for q, ids in holders.items())


def test_weights_are_learned_from_every_example(spark):
    kinds = [([0.1, 0.0, 0.0, 1.0], 0, 150_000), ([0.9, 0.5, 0.5, 1.0], 1, 90_000), ([0.9, 0.2, 0.1, 2.0], 0, 30_000), ([0.2, 0.1, 0.4, 0.5], None, 5)]
    few = spark.createDataFrame(kinds, "x array<double>, y int, n int")
    examples = few.select("x", "y", F.explode(F.sequence(F.lit(1), "n"))).select("x", "y")
    x, y, n = (np.array(c) for c in zip(*kinds[:3]))
    want = models.logistic(np.repeat(x, n, axis=0), np.repeat(y, n), 300, 0.5)
    assert np.allclose(models.learn_weights(examples.where("y is not null")), want)
    assert np.allclose(models.learn_weights(examples), want)  # what has no y teaches nothing
    spread = models.learn_weights(examples, rounds=3, together=0)  # summed up where they lie
    assert np.allclose(spread, models.logistic(np.repeat(x, n, axis=0), np.repeat(y, n), 3, 0.5))
