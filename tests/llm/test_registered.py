"""Every operator as it is registered: columns, rules of the contract, and plain trainers;
the pipeline's stages on awkward, empty and very long texts."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpuscade.llm import catalog, factorisation, ftrl, icws, packing, run_index, strata
from corpuscade.llm.common import hashed_words, words
from test_operators import DOCS, awkward, prose, sha, without_earlier, without_repeats

sys.path.insert(0, entry.__file__.rsplit("/", 1)[0])
import corpus_pipeline  # noqa: E402

LONG, TEXT, REAL, FLAG, INT = "bigint", "string", "double", "boolean", "int"
COLUMNS = {
    "op1_byte_bpe": [("doc_id", LONG), ("n_tokens", LONG), ("ids_sha256", TEXT), ("decoded_sha256", TEXT)],
    "op2_fertility": [(c, LONG) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", FLAG), ("kept", FLAG)],
    "op3_kdtree_shards": [("doc_id", LONG), ("size", LONG), ("text_crc32", LONG), ("law", TEXT), ("shard", INT), ("slot", LONG), ("grown_shard", INT)],
    "op4_run_index": [(c, LONG) for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated_words")] + [("kept_sha256", TEXT)],
    "op5_seed_extend": [("doc_id", LONG), ("n_words", LONG), ("n_removed", LONG), ("kept_sha256", TEXT)],
    "op6_hnsw": [("query_id", LONG), ("rank", INT), ("vec_id", LONG), ("score", REAL)],
    "op7_toxicity": [("doc_id", LONG), ("held_out", FLAG), ("score", REAL), ("predicted", INT)],
    "op8_icws": [("doc_id", LONG), ("class_id", LONG), ("class_rows", LONG), ("kept", FLAG)],
    "op9_mixing": [("doc_id", LONG), ("size", LONG), ("source_size", LONG), ("target", REAL), ("taken", LONG)],
    "op10_factorisation": [("doc_id", LONG), ("held_out", FLAG), ("score", REAL), ("predicted", INT)],
}


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    """The queries' results, each run once."""
    known = {}

    def of(name):
        if name not in known:
            df = catalog.queries()[name](spark, sf_dir)
            known[name] = (df.dtypes, df.collect())
        return known[name]

    return of


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(results, documents, name):
    dtypes, rows = results(name)
    assert set(COLUMNS[name]) <= set(dtypes) and [c for c, _ in dtypes[:1]] == [COLUMNS[name][0][0]]
    if name != "op6_hnsw":
        assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in documents)


def test_tokens_decode_to_the_texts(results, documents):
    texts = dict(documents)
    for r in results("op1_byte_bpe")[1]:
        assert r["decoded_sha256"] == sha((texts[r["doc_id"]] or "").encode())


def test_shards_are_near_equal_and_gapless(results, documents):
    texts, sizes, slots = dict(documents), Counter(), {}
    for r in results("op3_kdtree_shards")[1]:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    largest = max(len((t or "").encode()) for t in texts.values())
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 2 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_repeated_bytes_as_by_all_windows(results, documents):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = Counter(tuple(r[n] for n in names) for r in results("op4_run_index")[1])
    assert got == without_repeats(documents, 400)


def test_repeated_words_as_by_all_windows(results, documents):
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    want = without_earlier(documents, 50)
    assert Counter(tuple(r[n] for n in names) for r in results("op5_seed_extend")[1]) == want
    assert Counter((r["doc_id"], r["n_repeated_words"]) for r in results("op4_run_index")[1]) == Counter({(i, g): n for (i, _, g, _), n in want.items()})


def test_neighbours_are_those_of_all_pairs(spark, sf_dir, results):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    v = np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in results("op6_hnsw")[1]:
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        scores = v @ v[np.flatnonzero(ids == q)[0]]
        scores[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -scores))[: min(20, len(ids) - 1)]].tolist()
        assert sorted(found) == list(range(1, len(want) + 1))
        hits += len(set(want) & set(found.values())) / len(want)
    assert hits >= 0.9 * len(got)


@pytest.mark.parametrize(("name", "label", "modulus", "out"), [("op7_toxicity", "toxic", 4, 2), ("op10_factorisation", "quality", 5, 0)])
def test_scores_hold_out_what_they_say(spark, sf_dir, results, name, label, modulus, out):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r[label] is not None}
    right = total = 0
    for r in results(name)[1]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] in truth:
            total += 1
            right += r["predicted"] == truth[r["doc_id"]]
    assert total and right >= 0.8 * total


def test_classes_are_named_by_their_least_document(results):
    rows = results("op8_icws")[1]
    members = {}
    for r in rows:
        members.setdefault(r["class_id"], []).append(r["doc_id"])
    for r in rows:
        own = members[r["class_id"]]
        assert r["class_id"] == min(own) and r["class_rows"] == len(own) and r["kept"] == (r["doc_id"] == min(own))


# plain trainers --------------------------------------------------------------------------


def _labelled(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        bad = i % 4 == 0
        text = prose(1000 + i, rnd.randint(5, 40)) + (" trash idiot fool" if bad else "")
        rows.append((i, text, int(bad), int(not bad)))
    rows += [(60, None, 0, 0), (61, "", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")
    order = df.select("doc_id", F.xxhash64("doc_id", F.lit("order")).alias("o")).orderBy("o").collect()
    return df, {r[0]: r for r in rows}, [r["doc_id"] for r in order]


def test_ftrl_equals_a_loop_over_coordinates(spark):
    df, rows, order = _labelled(spark)
    labels = df.select("doc_id", "toxic", "quality")
    model = ftrl.train(df.select("doc_id", "text"), labels, "toxic", F.lit(True))
    z, n, known, bias = Counter(), Counter(), ftrl.Stems(), 1 << ftrl.BITS

    def weight(i):
        l1 = 0.0 if i == bias else ftrl.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((ftrl.BETA + math.sqrt(n[i])) / ftrl.ALPHA + ftrl.L2)

    for _ in range(ftrl.EPOCHS):
        for i in order:
            at = [*ftrl.features(rows[i][1], known).tolist(), bias]
            w = {k: weight(k) for k in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - rows[i][2]
            for k in at:
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / ftrl.ALPHA
                z[k] += g - sigma * w[k]
                n[k] += g * g
    want = {k: weight(k) for k in z if k != bias and weight(k)}
    at, w, own = model
    assert set(at.tolist()) == set(want) and np.allclose([want[k] for k in at.tolist()], w) and np.isclose(own, weight(bias))
    for r in ftrl.score(df, model).collect():
        logit = weight(bias) + sum(want.get(k, 0.0) for k in ftrl.features(rows[r["doc_id"]][1], known).tolist())
        assert np.isclose(r["score"], 1 / (1 + math.exp(-logit)))


def test_factorisation_equals_a_loop_over_pairs(spark, monkeypatch):
    monkeypatch.setattr(factorisation, "EPOCHS", 1)
    df, rows, order = _labelled(spark)
    model = factorisation.train(df.select("doc_id", "text"), df.select("doc_id", "quality"), "quality", F.lit(True))
    order = [i for i in order if rows[i][3] is not None]
    size = (1 << factorisation.BITS) + factorisation.STATISTICS
    w, v, w0 = np.zeros(size), np.random.default_rng(7).normal(0, factorisation.SPREAD, (size, factorisation.RANK)), 0.0
    gw, gv, g0 = np.full(size, 1e-2), np.full((size, factorisation.RANK), 1e-2), 1e-2
    ys = [rows[i][3] for i in order]
    share = sum(ys) / len(ys)
    weigh = {1: min(3.0, max(1.0, (1 - share) / share)), 0: min(3.0, max(1.0, share / (1 - share)))}
    known = factorisation.PlainWords()

    def value(at, x):
        """By all pairs, not by sums of squares."""
        own = v[at] * x[:, None]
        products = own @ own.T
        return w[at] @ x + (products.sum() - np.trace(products)) / 2

    for i, y in zip(order, ys):
        at, x = factorisation.features(rows[i][1], known)
        x = x.astype(np.float32).astype(float)
        g = (1 / (1 + math.exp(-(w0 + value(at, x)))) - y) * weigh[y]
        sums = (v[at] * x[:, None]).sum(0)
        for j, (k, xk) in enumerate(zip(at.tolist(), x.tolist())):
            old = v[k].copy()
            dw, dv = g * xk + factorisation.L2 * w[k], g * xk * (sums - old * xk) + factorisation.L2 * old
            gw[k] += dw * dw
            gv[k] += dv * dv
            w[k] -= factorisation.RATE * dw / math.sqrt(gw[k])
            v[k] = old - factorisation.RATE * dv / np.sqrt(gv[k])
        g0 += g * g
        w0 -= factorisation.RATE * g / math.sqrt(g0)
    assert np.allclose(model[0], w, atol=1e-5) and np.allclose(model[1], v, atol=1e-5) and np.isclose(model[2], w0)
    for r in factorisation.score(df, model).collect():
        at, x = factorisation.features(rows[r["doc_id"]][1], known)
        assert np.isclose(r["score"], 1 / (1 + math.exp(-(w0 + value(at, x)))), atol=1e-5)


def test_a_sample_has_one_row_for_each_id(spark):
    from corpuscade.llm.labelled import sample

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, None), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (1, 0)], "doc_id long, toxic int")
    rows = sample(docs, labels, "toxic", F.lit(True), 3).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2, 3] and {r["doc_id"]: r["y"] for r in rows} == {1: 1, 2: 0, 3: 1}


# very long texts -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def long_rows():
    shared = prose(77, 70)
    return [
        (1, prose(70, 120_000) + " " + shared), (2, shared + "\n" + prose(71, 60_000)), (3, "x" * 700_000),
        (4, "word " * 100_000), (5, " " * 400_000), (6, prose(72, 80)),
    ]


def test_very_long_texts(spark, sf_dir, long_rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t), *["x"] * 10) for i, t in long_rows], DOCS).repartition(2)
    got = {r["doc_id"]: r for r in run_index.cleaned(df).collect()}
    assert len(words(got[1]["text"])) == 120_070 and len(words(got[2]["text"])) == 60_000 and got[6]["text"] == long_rows[5][1]
    assert {r["doc_id"] for r in icws.classes(df).collect()} == {1, 2, 3, 4, 5, 6}
    import public_tokenizers as P

    pieces = packing.pack_documents(df, P.path(packing.VOCABULARY), P.PATTERN, with_ids=False)
    sizes = {r["doc_id"]: (r["n"], r["doc_tokens"]) for r in pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()}
    assert len(sizes) == 6 and all(n == m for n, m in sizes.values())
    items = spark.createDataFrame([(1, long_rows[5][1])], "item_id long, text string")
    index, n = strata.build(df, shard=50_000)
    assert n == 5 and strata.search(index, n, items).first()["doc_id"] == 6
    assert {r["doc_id"] for r in ftrl.score(df, (np.empty(0, np.int32), np.empty(0), 0.0)).collect()} == {1, 2, 3, 4, 5, 6}


def test_words_are_hashed_as_they_are_cut():
    import pyarrow as pa

    texts = ["", None, " a", "a b", "a", "\x0b x\ty\nz ", "é漢字 \x85x", "aaaaaaaa aaaaaaaaa " + "w" * 300, "x" * 16 + " " + "x" * 17, None, "a"]
    for column in (pa.array(texts), pa.array(texts).slice(2, 6), pa.array([], pa.string()), pa.array([t and t.encode() for t in texts])):
        h, sizes = hashed_words(column)
        found = [t.decode() if isinstance(t, bytes) else t for t in column.to_pylist()]
        assert sizes.tolist() == [len(words(t)) for t in found]
        pairs = set(zip([w for t in found for w in words(t)], h.tolist()))
        assert len(pairs) == len({w for w, _ in pairs}) == len({x for _, x in pairs})


# the pipeline ----------------------------------------------------------------------------


@pytest.mark.parametrize("case", ["awkward", "empty"])
def test_stages_on_awkward_and_empty_tables(spark, sf_dir, case):
    rows = [r for r in awkward() if case == "awkward"]
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        kept = out.collect()
        if name == "tokens":
            assert len(kept) == docs.count()
            for r in kept:
                assert r["n_tokens"] >= 0
        else:
            assert out.columns == docs.columns and len(kept) <= (len(rows) if name != "mixture" else 3 * len(rows))
            docs = spark.createDataFrame(kept, out.schema) if kept else spark.createDataFrame([], out.schema)


def test_cleaned_removes_every_passage_but_the_first(spark):
    shared = prose(5, 64)
    rows = [(i, f"{prose(200 + i, 30)} {shared} {prose(300 + i, 30)}", "en", "s", 1, *["x"] * 10) for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_strings(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 6):
        assert got[i].split() == (prose(200 + i, 30) + " " + prose(300 + i, 30)).split()


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == sha(b"")
