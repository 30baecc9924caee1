"""Every operator against a plain version of itself, on texts chosen to be awkward."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscade.llm import bpe, factorisation, fertility, ftrl, hnsw, icws, kdtree, mixing, run_index, seed_extend
from corpuscade.llm.components import components
from corpuscade.llm.labelled import remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, t1 string, score string, h string, ord string, data string, _id string, shard string, copies string"


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def awkward():
    shared, base = prose(1, 90), prose(2, 160)
    near = base.split()
    near[80] = "changed"
    texts = [
        None, "", " \n\t", "one", "one two three", base, base, base, " ".join(near), shared,
        prose(3, 40) + " " + shared + " " + prose(4, 40), prose(5, 30) + "\n" + shared, shared + " " + shared,
        "Shti " * 300, "Shti " * 200, prose(6, 4000), "漢字 😀 " * 120, "line one is here\n" * 20, "A!! B!! " * 60,
        "\x1c\x85 \xa0x \x0b y", prose(7, 49), prose(8, 50), "\x00�" + prose(9, 30), base.upper(),
        "nul" * 500, prose(10, 120) + " trash idiot", prose(10, 120) + " trash idiot",
    ]
    rows = []
    for i, text in enumerate(texts):
        lang, source = (None, None) if i % 7 == 3 else ("en", f"s{i % 3}")
        rows.append((i, text, lang, source, None if i % 5 == 0 else len(text or ""), *["x"] * 10))
    rows += [rows[5], rows[9], (None, base, "en", None, 1, *[None] * 10), (None, None, None, None, None, *[None] * 10)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


# 1 ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    with open(P.path(bpe.VOCABULARY), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_returns(docs, rows, reference):
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs).collect())
    want = Counter()
    for r in rows:
        ids = reference.encode_ordinary(r[1] or "")
        want[r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r[1] or "").encode())] += 1
    assert got == want


def test_bpe_offsets_and_split_characters(docs, none, reference):
    for r in bpe.decode(bpe.encode(docs)).collect():
        text = r["text"] or ""
        assert r["decoded"] == text and r["ids"] == reference.encode_ordinary(text)
        data, at = text.encode(), 0
        for i, a, b in zip(r["ids"], r["starts"], r["ends"]):
            token = reference.decode_single_token_bytes(i)
            at += len(token)
            assert text[a:b].encode().find(token) >= 0 or token in data
            assert len(data[:at].decode("utf-8", "ignore")) <= b
    assert bpe.encode(none).count() == 0 and bpe.digests(none).count() == 0


# 2 ---------------------------------------------------------------------------------------


def test_fertility_base_measures(docs, rows, none):
    def base(text):
        text, w = text or "", words(text)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times, covered = Counter(tri), set()
        for k, t in enumerate(tri):
            if times[t] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)

    found = fertility.fertility(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in found) == Counter((r[0], *base(r[1])) for r in rows)
    assert all(not (r["kept"] and r["base_failed"]) for r in found)
    assert fertility.fertility(none).count() == 0


def test_fertility_bands(spark):
    clean = [(i, prose(100 + i, 120), "en") for i in range(40)]
    odd = [(100, "zxqjv " + " ".join("qxzjvkw" * 3 + str(i) for i in range(80)), "en"), (101, "a " * 2 + " ".join(f"{i}!@#" for i in range(90)), "en")]
    kept = {r["doc_id"]: r["kept"] for r in fertility.fertility(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i in range(40)) and not (kept[100] and kept[101])


def test_fertility_verdict_is_that_of_plain_measures(docs, rows):
    """The measures from the library itself, word by word, and the verdict from them."""
    import math
    import statistics

    import public_tokenizers as P
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path(fertility.VOCABULARY))
    found = {}
    for i, text, lang, *_ in rows:
        w = words(text)
        ids = [t for x in w for t in pieces.encode(x)]
        chars, times = sum(map(len, w)), Counter(ids)
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in times.values())
        ratios = (chars / len(ids), sum(map(pieces.is_byte, ids)) / len(ids), entropy) if ids else (None,) * 3
        found.setdefault(i, []).append((len(ids), ratios))
    got = fertility.fertility(docs).collect()
    by_lang = {}
    for r in got:
        want = found[r["doc_id"]]
        ratios = [r[c] for c in ("chars_per_token", "byte_share", "entropy")]
        assert any(r["n_tokens"] == n and (x[0] is None or np.allclose(ratios, x)) for n, x in want)
        if not r["base_failed"] and r["n_tokens"]:
            by_lang.setdefault(r["lang"], []).append(r)

    def band(values):
        steps = sorted(round(v * fertility.STEPS) for v in values)
        low, middle, high = statistics.quantiles(steps, n=4, method="inclusive") if len(steps) > 1 else steps * 3
        reach = max(fertility.DEVIATIONS * (high - low) / 1.349, fertility.LEAST_REACH * middle)
        return (middle - reach) / fertility.STEPS, (middle + reach) / fertility.STEPS

    for r in got:
        kept = not r["base_failed"] and r["n_tokens"] > 0
        if kept:
            low, high, most_bytes, least = fertility.BANDS[r["script"]]
            kept &= low <= r["chars_per_token"] <= high and r["byte_share"] <= most_bytes and r["entropy"] >= least
            low, high = band([x["chars_per_token"] for x in by_lang[r["lang"]]])
            kept &= low <= r["chars_per_token"] <= high
        assert r["kept"] == kept, r


# 3 ---------------------------------------------------------------------------------------


def test_kd_shards_have_equal_bytes_and_gapless_slots(spark, docs, rows, none):
    found = kdtree.shard_documents(docs, leaves=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    many = spark.createDataFrame([(i, prose(i, 5 + i % 50), "en" if i % 3 else None, "hot" if i % 3 else f"s{i % 9}") for i in range(900)], "doc_id long, text string, lang string, source string")
    found = kdtree.shard_documents(many, leaves=7).collect()
    sizes, slots = Counter(), {}
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) < 1000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kdtree.shard_documents(none, leaves=4).count() == 0
    assert kdtree.shard_documents(many, target_bytes=20_000).select("shard").distinct().count() > 4


# 4 and 5 ---------------------------------------------------------------------------------


def without_repeats(rows, window):
    data = [(r[1] or "").encode() for r in rows]
    times = Counter(d[s : s + window] for d in data for s in range(len(d) - window + 1))
    out = []
    for r, d in zip(rows, data):
        gone = [False] * len(d)
        for s in range(len(d) - window + 1):
            if times[d[s : s + window]] > 1:
                gone[s : s + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((r[0], len(d), sum(gone), spans, sha(bytes(b for b, g in zip(d, gone) if not g))))
    return Counter(out)


@pytest.mark.parametrize(("window", "hot"), [(400, 1_800), (400, 1), (100, 2)])
def test_repeated_bytes(docs, rows, none, window, hot):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = Counter(tuple(r[n] for n in names) for r in run_index.removed(docs, window, hot).collect())
    assert got == without_repeats(rows, window)
    assert run_index.removed(none).count() == 0


def test_texts_without_repeated_bytes_keep_their_rows(docs, rows):
    found = run_index.without_repeats(docs).collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == docs.first().asDict().keys()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[0]["text"] is None and by_id[5]["text"] == "" and by_id[21]["text"] == rows[21][1]
    assert all(r["n_chars"] == len(r["text"]) for r in found if r["text"] is not None)


@pytest.mark.parametrize(("window", "hot"), [(50, 1_800), (50, 1), (12, 2)])
def test_cleaned_texts_lose_what_earlier_documents_have(docs, rows, none, window, hot, monkeypatch):
    monkeypatch.setattr(run_index.passages, "__defaults__", (run_index.PASSAGE, hot, True))
    found = run_index.cleaned(docs, window).collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == docs.first().asDict().keys()
    want = without_earlier(rows, window)
    before = {r[:2] for r in rows}
    got = Counter((r["doc_id"], sha(" ".join(words(r["text"])).encode())) for r in found)
    assert got == _tail(want)
    assert all(r["n_chars"] == len(r["text"]) for r in found if r["text"] is not None)
    # A text that loses nothing stays as it is, white space and all.
    whole = {(i, k) for i, _, gone, k in want if not gone}
    for r in found:
        if (r["doc_id"], sha(" ".join(words(r["text"])).encode())) in whole:
            assert (r["doc_id"], r["text"]) in before
    counted = run_index.repeated_words(docs, window).collect()
    sizes = Counter((r["doc_id"], r["n_repeated_words"]) for r in counted)
    assert sizes == Counter(x for (i, _, gone, _), n in want.items() for x in [(i, gone)] * n)
    assert run_index.cleaned(none, window).count() == 0 and run_index.repeated_words(none).count() == 0


def _tail(want):
    out = Counter()
    for (i, _, _, kept), n in want.items():
        out[i, kept] += n
    return out


def test_one_text_with_one_anchor_over_and_over(spark):
    """Occurrences in one text are cut like those in many: no index grows beyond its bound."""
    import pyarrow as pa

    from corpuscade.llm import repeats

    rnd, spec = random.Random(3), repeats.Spec(200, 64, by_words=False, hot=50)
    part = lambda k: "".join(rnd.choice("ijklmnop") for _ in range(k))
    # Of many strings the one with the least hash, so that windows pick it as their anchor.
    strings = [part(64) for _ in range(4000)]
    hashes = [int(repeats.seed_hashes(spec, h)[0]) for h in repeats.unit_hashes(spec, pa.array([s.encode() for s in strings]))]
    seed = strings[int(np.argmin(np.array(hashes, np.uint64)))]
    text = "".join(seed + part(60) for _ in range(500)) + (tail := seed + part(300)) + part(50) + tail
    df = spark.createDataFrame([(1, text, None), (2, other := part(500), None)], "doc_id long, text string, n_chars long")
    rows = repeats._anchor_rows(run_index._identified(df).select("t1", "t2", "data"), spec)
    assert rows.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).first()["n"] > 400
    found = run_index.removed(df, window=200, hot=50).collect()
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r[n] for n in names) for r in found) == without_repeats([(1, text), (2, other)], 200)


def test_runs_are_fewer_in_repetitive_text():
    rnd = np.random.default_rng(1)
    part = rnd.integers(97, 123, 500).astype(np.uint8)
    index = run_index.RunIndex(np.concatenate([np.tile(part, 20), [255]]).astype(np.uint8))
    assert index.lengths.sum() == 10_001 and len(index.lengths) < 1_600


def without_earlier(rows, window):
    first = {}
    for r in rows:
        w = words(r[1])
        for s in range(len(w) - window + 1):
            if r[0] is not None:
                t = tuple(w[s : s + window])
                first[t] = min(first.get(t, r[0]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if r[0] is not None and first[tuple(w[s : s + window])] < r[0]:
                gone[s : s + window] = [True] * window
        out.append((r[0], len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return Counter(out)


@pytest.mark.parametrize(("window", "hot", "together"), [(50, 1_800, 64), (50, 1, 64), (20, 2, 1)])
def test_repeated_words(docs, rows, none, window, hot, together, monkeypatch):
    monkeypatch.setattr(seed_extend, "TOGETHER", together)
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    got = Counter(tuple(r[n] for n in names) for r in seed_extend.removed(docs, window, hot).collect())
    assert got == without_earlier(rows, window)
    assert seed_extend.removed(none).count() == 0


def test_extension_of_many_contexts_is_that_of_few(monkeypatch):
    from corpuscade.llm.common import WordHashes
    from corpuscade.llm.repeats import Spec

    rnd, spec = random.Random(5), Spec(12, 4, by_words=True)
    base = [str(i) for i in range(21)]
    rows = []
    for n in range(60):
        w = [x if rnd.random() > 0.1 or 8 <= k < 12 else str(rnd.random()) for k, x in enumerate(base)]
        rows.append({"key": 1, "a": 0, "b": 8, "pin": 8, "live": 9, "ord": n // 2, "ctx": " ".join(w[: 9 + 11]).encode()})
    flat = lambda found: [sorted({s for a, b in f for s in range(a, b + 1)}) for f in found]
    few = flat(seed_extend.extend(rows, spec, WordHashes()))
    monkeypatch.setattr(seed_extend, "TOGETHER", 3)
    assert flat(seed_extend.extend(rows, spec, WordHashes())) == few and any(few)


# 6 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("exact", [0, 512])
def test_graphs_built_by_search_find_what_is_near(exact):
    rnd = np.random.default_rng(1)
    vectors = hnsw.raised(rnd.normal(size=(3000, 24)) * rnd.uniform(0.5, 2, (3000, 1)))
    layers = hnsw.build(vectors, exact)
    asked = rnd.normal(size=(60, 24)).astype(np.float32)
    found = hnsw.search(vectors, layers, asked)
    want = np.argsort(-(asked @ vectors[:, :-1].T), 1)[:, :20]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 20 for a, b in zip(want, found)]) >= 0.9


def test_nearest_neighbours(spark):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(3000, 16)) + 2 * rnd.integers(0, 5, (3000, 1))
    v[100:160] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows[7], rows[8], rows[9], rows[11] = (7, None), (8, [0.0] * 16), (9, [float("nan")] + [1.0] * 15), (11, [None] + [1.0] * 15)
    rows += [(5000, [1.0] * 3), (None, [1.0] * 16)]
    df = hnsw.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    usable = sorted(r["vec_id"] for r in df.collect())
    assert usable == [i for i in range(3000) if i not in (7, 8, 9, 11)]
    ids, kept = np.array(usable), v[usable]
    found = {}
    for r in hnsw.nearest(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q, got in found.items():
        scores = kept @ kept[usable.index(q)]
        scores[usable.index(q)] = -np.inf
        want = ids[np.lexsort((ids, -np.round(scores, 9)))[:20]].tolist()
        assert sorted(got) == list(range(1, 21))
        assert all(abs(s - scores[usable.index(i)]) < 1e-9 for i, s in got.values())
        hits += len({i for i, _ in got.values()} & set(want))
    assert len(found) == len([i for i in usable if i % 20 == 0]) and hits >= 0.9 * 20 * len(found)
    empty = hnsw.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert hnsw.nearest(empty, empty).count() == 0


def test_few_vectors_give_all_candidates(spark):
    df = hnsw.usable(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in hnsw.nearest(df, df.where("vec_id = 0")).collect())
    assert got == [(1, 2, 1.0), (2, 1, 0.5)]


# 7 and 10 --------------------------------------------------------------------------------


def _accuracy(spark, op, label, bad):
    rows = []
    for i in range(600):
        toxic = i % 4 == 0
        rows.append((i, bad(i) if toxic else prose(i, 60), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {label} int")
    model = op.train(docs, labels, label, remainder(3) != 0)
    scores = {r["doc_id"]: r["score"] for r in op.score(docs, model).collect()}
    held = [(scores[i] >= 0.3, bool(y)) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 0]
    return sum(a == b for a, b in held) / len(held)


def test_ftrl_learns_words_and_inflected_words(spark):
    ends = ["a", "bo", "cu", "das", "ei"]
    assert _accuracy(spark, ftrl, "toxic", lambda i: prose(i, 30) + " vermaledeit" + ends[i % 5] + str(i) + " " + prose(i + 999, 30)) > 0.95


def test_factorisation_learns_structure(spark):
    assert _accuracy(spark, factorisation, "quality", lambda i: " ".join(w + "***" for w in prose(i, 60).split())) > 0.95


@pytest.mark.parametrize("op", [ftrl, factorisation])
def test_classifiers_take_awkward_rows(spark, docs, rows, none, op):
    labels = spark.createDataFrame([(i, i % 2, None if i % 9 == 0 else i % 2) for i in range(25)] + [(None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = op.train(docs, labels, "toxic", F.lit(True))
    found = op.score(docs, model).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (5, 6, 7)}) == 1
    assert op.score(none, op.train(none, labels.limit(0), "toxic", F.lit(True))).count() == 0


def test_sum_of_squares_identity():
    rnd = np.random.default_rng(0)
    w, v, x = rnd.normal(size=6), rnd.normal(size=(6, 3)), rnd.normal(size=6)
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(6) for j in range(i))
    assert np.isclose(factorisation.value(w, v, x)[0], w @ x + pairs)


def test_accepted_documents_keep_their_columns(spark, docs):
    labels = spark.createDataFrame([(i, 1) for i in range(25)], "doc_id long, quality int")
    kept = factorisation.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() > 0


# 8 ---------------------------------------------------------------------------------------


def _classes(rows):
    """By all pairs: equal texts, and weighted Jaccard similarity of at least 0.8."""
    counts, n = np.zeros(icws.DEPTH << icws.WIDTH_BITS, np.int64), 0
    for r in rows:
        h, _ = icws.shingles_of(r[1])
        if len(h):
            np.add.at(counts, icws.counters(h).ravel(), 1)
            n += 1
    rare = icws.Rarity(counts, n)
    sets = [dict(zip(*map(list, icws.elements((r[1] or "").encode(), rare)))) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            common = sum(w for s, w in a.items() if s in b)
            union = sum(a.values()) + sum(b.values()) - common
            if (rows[i][1] or "") == (rows[j][1] or "") or union and common / union >= 0.8 - 1e-9:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            first[g] = min(first.get(g, r[0]), r[0])
    return Counter((r[0], first.get(g)) for r, g in zip(rows, group))


@pytest.mark.parametrize(("paired", "block"), [(16, 512), (1, 512), (1, 2)])
def test_near_duplicates(spark, rows, docs, none, paired, block, monkeypatch):
    monkeypatch.setattr(icws, "PAIRED", max(paired, 1))
    monkeypatch.setattr(icws, "BLOCK", block)
    base = prose(50, 200).split()
    more = []
    for k in range(12):
        w = list(base)
        for at in range(k % 4):
            w[20 + 50 * at] = f"new{k}"
        more.append((100 + k, " ".join(w), "en", "s", 1, *["x"] * 10))
    every = rows + more
    df = spark.createDataFrame(every, DOCS).repartition(3)
    assert Counter((r["doc_id"], r["class_id"]) for r in icws.classes(df).collect()) == _classes(every)
    if paired == 16:
        kept = icws.deduplicated(df)
        assert kept.columns == df.columns
        ids = [r["doc_id"] for r in kept.collect()]
        assert sorted(i for i in ids if i is not None) == sorted({c for _, c in _classes(every) if c is not None})
        assert icws.classes(none).count() == 0 and icws.deduplicated(none).count() == 0


def test_draws_agree_as_often_as_the_sets_do():
    rnd = np.random.default_rng(2)
    h = icws.mix(rnd.integers(0, 1 << 62, 1500).astype(np.uint64))
    w = rnd.uniform(0.5, 5, 1500)
    a, b = np.arange(1200), np.arange(200, 1500)
    wb = w.copy()
    wb[600:900] *= 1.7
    want = np.minimum(w[200:1200], wb[200:1200]).sum() / (w[:200].sum() + np.maximum(w[200:1200], wb[200:1200]).sum() + wb[1200:].sum())
    agree = []
    for seed in range(12):
        salt = icws.mix(np.array([seed + 1], np.uint64))
        agree += (icws.draws(icws.mix(h[a] ^ salt), w[a]) == icws.draws(icws.mix(h[b] ^ salt), wb[b])).tolist()
    assert abs(np.mean(agree) - want) < 0.08


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (1, 0), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 9 ---------------------------------------------------------------------------------------


def test_mixing(spark, docs, rows, none):
    found = mixing.repetitions(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(3 * sizes[s] for s in names if s not in open_)
        level = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if level[s] > 3 * sizes[s]}
        if not above:
            break
        open_ -= above
    target = {s: level[s] if s in open_ else 3 * sizes[s] for s in names}
    assert len(found) == len(rows)
    for r in found:
        assert np.isclose(r["target"], target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert r["copies"] in (int(rate), int(rate) + 1) and r["copies"] <= 3
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in found)
    assert mixing.repetitions(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * 10, f"s{i % 4}" if i % 3 else "hot") for i in range(6000)]
    df = mixing.repetitions(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in df.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect():
        assert abs(r["n"] / r["t"] - 1) < 0.1


def test_small_world_links_and_results_stand_once():
    vectors = np.random.default_rng(5).normal(size=(1_500, 16))
    raised = hnsw.raised(vectors)
    layers = hnsw.build(raised)
    for links in layers:
        for node, row in enumerate(links):
            row = row[row >= 0].tolist()
            assert len(set(row)) == len(row) and node not in row
    queries = vectors[:60].astype(np.float32)
    found = hnsw.search(raised, layers, queries)
    assert all(len(set(f[f >= 0].tolist())) == (f >= 0).sum() for f in found)
    best = np.argsort(-(queries @ vectors.T), 1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(best, found[:, :20])]) >= 0.9
