"""What must not grow with the input: work done again, tasks for each file, memory for each batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpuscade.functions import html as hx, text as tx
from corpuscade.operators import embedding, fusion, lexical, vectors
from corpuscade.operators.topk import Leaders
from corpuscade.sources import directory, index_store, pages


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_folder_of_many_files_takes_few_tasks_and_the_callers_session(spark, tmp_path, monkeypatch):
    folder, base = tmp_path / "docs", str(tmp_path / "index")
    for i in range(80):
        (folder / f"slug={i}").mkdir(parents=True)
        (folder / f"slug={i}" / "p.txt").write_text(f"page {i}.")
    seen, refresh = [], index_store.refresh_index
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")

    def watched(docs, *args, **options):
        seen.append((docs.sparkSession.conf.get("spark.sql.adaptive.enabled"), docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return refresh(docs, *args, **options)

    monkeypatch.setattr(index_store, "refresh_index", watched)
    directory.index_directory(spark, str(folder), base, "n", str(tmp_path / "progress"))
    assert {r["text"] for r in directory.indexed_files(spark, base, "n").collect()} == {f"page {i}." for i in range(80)}
    assert seen == [(adaptive, spark.conf.get("spark.sql.shuffle.partitions"))] and adaptive == "true"
    session = directory.many_files_session(spark)
    assert int(session.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) == 4 * spark.sparkContext.defaultParallelism
    assert int(session.conf.get("spark.sql.files.openCostInBytes").rstrip("b")) < 1 << 20


def test_a_block_of_a_page_is_worked_out_once(spark):
    rows = [
        (1, "<p>one <b>two</b> three &amp; <a href='x'>four</a></p><h2>Head&nbsp;it</h2><li></li>"), (2, "<p>x</p>"), (3, None), (4, ""),
        (5, "&lt;&bogus;&#65; text <div><i>of</i> some words</div>"),
    ]
    df = spark.createDataFrame(rows, "stored_id long, html string")
    made = pages.to_markdown(df)
    assert _plan(made).count("<(?:b|strong)>") == 2  # the blocks that stay, and all if none does
    both = hx.with_markdown(df).select("stored_id", F.coalesce(F.nullif(F.col("fit_md"), F.lit("")), F.col("raw_md")).alias("markdown"))
    want = {r["stored_id"]: r["markdown"] for r in both.collect()}
    assert {r["stored_id"]: r["markdown"] for r in made.collect()} == want and want[3] is None and "**two**" in want[1]


def test_terms_of_a_pair_are_found_once(spark):
    df = spark.createDataFrame([("a b c a", "c a b x a b"), ("", "a"), (None, "a"), ("a b", None), ("q r", "s")], "q string, p string")
    scored = df.select("q", "p", fusion.overlap_score(F.col("q"), F.col("p")).alias("s"))
    assert _plan(scored).count("[\\p{L}\\p{N}]+") == 2
    assert _plan(df.select(tx.features(F.col("p")).alias("f"))).count("[\\p{L}\\p{N}]+") == 1
    got = {(r["q"], r["p"]): r["s"] for r in scored.collect()}
    assert got["a b c a", "c a b x a b"] == 1.0 + 2 / 3 and got["", "a"] == 0.0 and got["q r", "s"] == 0.0


def test_many_questions_of_common_words_scan_the_chunks(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"the house of number {i} and the tree {i % 7}.") for i in range(60)], "doc_id long, text string")
    index = index_store.create_or_load(docs, str(tmp_path / "index"), "n")
    asked = [(i, f"the tree and the number {i}") for i in range(20)] + [(99, None), (98, "zzz")]
    questions = spark.createDataFrame(asked, "q_id long, text string")
    want = sorted(map(tuple, lexical.bm25_top_k(index, questions, 3, question_block=0).collect()))

    def never(*_):
        raise AssertionError("a posting for each question and chunk")

    monkeypatch.setattr(lexical, "_pruned_top_k", never)
    got = sorted(map(tuple, lexical.bm25_top_k(index, questions, 3, question_block=4).collect()))
    assert got == want and len({r[0] for r in got}) == 20


def test_leaders_agree_with_a_sort_and_stay_small():
    rnd, k, n = np.random.default_rng(5), 4, 30
    scores = rnd.integers(0, 9, (500, n)) / 8.0
    matched = rnd.random((500, n)) < 0.7
    ids = rnd.permutation(500).astype(np.int64)
    leaders = Leaders(k, ("vec_id",))
    for at in range(0, 500, 37):
        leaders.add([ids[at : at + 37]], scores[at : at + 37], matched[at : at + 37])
    got = sorted(zip(*(c.tolist() for c in leaders.rows)))
    want = [(i, q, s) for q in range(n) for s, i in sorted((-scores[r, q], ids[r]) for r in range(500) if matched[r, q])[:k] for s in [-s]]
    assert got == sorted(want)
    points, asked = rnd.random((12_000, 8)), rnd.random((2_000, 8))
    tracemalloc.start()
    vectors._score(Leaders(10, ("vec_id",)), [np.arange(12_000)], points, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20


def test_a_batch_of_texts_is_worked_on_in_slices():
    seen = []

    def work(part: pa.Array) -> pa.Array:
        seen.append(len(part))
        return pc_sizes(part)

    def pc_sizes(part: pa.Array) -> pa.Array:
        return pa.array([None if v is None else len(v) for v in part.to_pylist()], pa.int32())

    lists = pa.array([None if i % 50 == 0 else list(range(i % 5)) for i in range(1_500)], pa.list_(pa.int32()))
    assert embedding.in_slices(lists, work).equals(pc_sizes(lists)) and max(seen) <= embedding.SLICE
    assert len(embedding.in_slices(lists.slice(0, 0), work)) == 0


def test_local_pages_are_written_without_a_process_for_each(spark, tmp_path):
    rows = [(f"s{i}", f"text {i}") for i in range(30)] + [(None, "none"), ("", "blank"), ('a b:c/d%e"f=g{h}\\i\n', "odd"), ("empty", None), ("s3", "again")]
    df = spark.createDataFrame(rows, "slug string, markdown string").repartition(4)
    out, plain = tmp_path / "out", tmp_path / "plain"

    def held(folder):
        files = [f for f in folder.rglob("*.txt") if not f.name.startswith((".", "_"))]
        return sorted((f.parent.name, line) for f in files for line in f.read_text().splitlines()), {f.parent.parent for f in files}

    pages.write_markdown(df, str(out))
    df.select("slug", F.col("markdown").alias("value")).write.partitionBy("slug").text(str(plain))
    assert held(out)[0] == held(plain)[0] and held(out)[1] == {out}
    assert not list(out.rglob("*.crc"))  # Hadoop sets the mode of each with a process of its own
    before = {f for f in out.rglob("*.txt") if f.parent.name != "slug=s1"}
    pages.write_markdown(spark.createDataFrame([("s1", "new"), ("t", "first")], df.schema), f"file://{out}")
    texts = {r["slug"]: r["value"] for r in spark.read.text(str(out)).where("slug in ('s1', 's2', 't')").collect()}
    assert texts == {"s1": "new", "s2": "text 2", "t": "first"}
    assert before < set(out.rglob("*.txt")) and len([*out.iterdir()]) == len({f.parent for f in out.rglob("*.txt")})


def test_a_scan_scores_exactly_only_what_may_win():
    rnd, k, features, questions = np.random.default_rng(9), 3, 60, 400
    common = 1 / np.arange(1, features + 1)
    holds, asks = rnd.random((900, features)) < common, rnd.random((questions, features)) < common
    holds[:, 0], asks[5] = holds[:, 0] | (rnd.random(900) < 0.9), False
    weights = np.where(holds, rnd.integers(1, 9, holds.shape) / 8, 0.0)
    question, number = np.nonzero(asks)
    q_weight = rnd.integers(1, 9, len(number)) / 4
    question, number, q_weight = (np.r_[c, c[:50]] for c in (question, number, q_weight))  # some ask twice
    ids = rnd.permutation(900).astype(np.int64)
    whole = np.zeros((900, questions))
    for q, f, w in zip(question, number, q_weight):
        whole[:, q] += weights[:, f] * w
    want = sorted((q, -s, i) for q in range(questions) for s, i in sorted((-whole[r, q], ids[r]) for r in range(900) if whole[r, q] > 0)[:k] for s in [-s])
    scan = lexical._Scan(lexical._Asked(number, question, q_weight, features, questions), k)
    exactly, exact = [], scan._exact
    scan._exact = lambda row, *rest: exactly.append(len(row)) or exact(row, *rest)
    for at in range(0, 900, 300):
        row, f = np.nonzero(holds[at : at + 300])
        scan.add([ids[at : at + 300], np.zeros(300, np.int32)], row, f, weights[at : at + 300][row, f])
    own, _, q, score = scan.leaders.rows
    assert sorted(zip(q.tolist(), (-score).tolist(), own.tolist())) == want and 5 not in q
    assert 0 < (scan.slot >= 0).sum() < features  # both ways of adding up
    assert sum(exactly) < 0.2 * np.count_nonzero(whole)


def test_leaders_sort_what_waits_together(monkeypatch):
    rnd, sorts, sort = np.random.default_rng(3), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(1) or sort(keys))
    leaders = Leaders(5, ("vec_id",))
    points = rnd.random((20_000, 50))
    for at in range(0, 20_000, 100):
        leaders.add([np.arange(at, at + 100)], points[at : at + 100])
    got = {(int(q), float(s)) for q, s in zip(*leaders.rows[1:])}
    assert got == {(q, s) for q in range(50) for s in np.sort(np.floor(points[:, q] * 1e6 + 0.5) / 1e6)[-5:].tolist()}
    assert len(sorts) < 30  # of 200 blocks


def test_a_bucket_of_terms_is_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_store, "BUCKET_ROWS", 200)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = [(f"n{i % 2}", i, " ".join(f"w{(i * j) % 90}" for j in range(1, 12))) for i in range(200)]
        index_store.create_index(spark.createDataFrame(docs, "namespace string, doc_id long, text string").repartition(6), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    folders = list((tmp_path / "terms").glob("generation=*/namespace=*/bucket=*"))
    assert len(folders) >= 16 and {len(list(f.glob("*.parquet"))) for f in folders} == {1}


def test_postings_gathered_by_tasks_are_those_of_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(index_store, "BLOCK", 4)
    monkeypatch.setattr(index_store, "GATHERED", 40)
    rnd = np.random.default_rng(4)
    rows = [(None if i % 3 == 0 else "n", None if i == 7 else int(i // 2), i % 2, " ".join(f"w{x}" for x in rnd.integers(0, 12, i % 9))) for i in range(120)]
    rows += rows[:5]
    chunks = spark.createDataFrame([(n, d, c, len(t.split()), [t.split().count(w) for w in dict.fromkeys(t.split())], t) for n, d, c, t in rows],
                                   "namespace string, doc_id long, chunk_no int, n_terms int, tfs array<int>, text string").repartition(5)
    gathered = index_store._gathered(chunks)
    assert 0 < gathered.count() < sum(len(set(t.split())) for *_, t in rows)
    blocks = index_store._blocks(gathered, 3).collect()
    got = [(b["namespace"], b["term"], *p) for b in blocks for p in zip(b["docs"], b["chunk_nos"], b["tfs"], b["lengths"])]
    want = [(n, w, d, c, t.split().count(w), len(t.split())) for n, d, c, t in rows for w in set(t.split())]
    assert sorted(map(str, got)) == sorted(map(str, want)) and max(len(b["docs"]) for b in blocks) == 4
    for b in blocks:
        places = [(-1 if d is None else d, c) for d, c in zip(b["docs"], b["chunk_nos"])]
        assert places == sorted(places) and (b["max_tf"], b["min_terms"]) == (max(b["tfs"]), min(b["lengths"]))
        assert (b["first_doc"], b["last_doc"]) == (b["docs"][0], b["docs"][-1])
