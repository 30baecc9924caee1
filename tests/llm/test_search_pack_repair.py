"""Ranked search, packing and conversation repair against plain versions of themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuscade.llm import catalog, packing, strata, turns

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = "m string, shard string, term string, tfs string, item_id string, conv string, h string, pos string, ids string, copies string"
DOCS = f"doc_id long, text string, {EXTRA}"


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 3))) for _ in range(n))


def texts():
    base = prose(1, 120)
    return [
        None, "", " \n\t", "ab", "AB ab É é", base, base, base, "\x00a\x7fb-c_d 1x", prose(2, 30), prose(3, 700),
        "ab " * 5000, "漢字 😀 ab", "a\n\nb  c", "x" * 3000, prose(5, 120), prose(6, 120), " " * 600, "\u0085ab cd", base.upper(),
    ]


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, *["x"] * 10) for i, t in enumerate(texts())]
    return [*found, found[5], (None, texts()[5], *[None] * 10), (None, None, *[None] * 10), (4, "ab cd", *["y"] * 10)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 11 --------------------------------------------------------------------------------------


def plain_search(docs, items, k):
    found = [(i, TERM.findall((t or "").translate(UPPER))) for i, t in docs]
    found = [(i, t) for i, t in found if t]
    documents, length = len(found), sum(len(t) for _, t in found)
    df = Counter(t for _, own in found for t in set(own))
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall((text or "").translate(UPPER)))
    out = []
    for item, names in asked.items():
        scored = []
        for i, own in found:
            m, tf, score = 50 + (50 * len(own) * documents) // length, Counter(own), 0
            for t in names & set(own):
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "ab É unknown"), (2, texts()[5]), (3, None), (4, ""), (None, "cd 漢字"), (5, "b b B"), (5, "c"), (6, "unknown"), (7, prose(3, 300))]


@pytest.mark.parametrize(("shard", "k"), [(500_000, 50), (2_000, 3), (400, 1)])
def test_search_equals_a_scan(spark, rows, docs, shard, k):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    index, documents = strata.build(docs, shard)
    got = strata.search(index, documents, items, k).collect()
    assert sorted(map(tuple, got), key=str) == plain_search([r[:2] for r in rows], ITEMS, k)


def test_search_on_nothing(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert strata.search(*strata.build(none), items).collect() == []
    assert strata.search(*strata.build(docs), items.limit(0)).collect() == []


def test_stratum_bounds_leave_no_better_document_out():
    rnd = np.random.default_rng(3)
    lists = [{"term": bytes([97 + t]), "m": int(m), "tf": int(tf), "doc": d} for d in range(400) for m in [50 + d % 37] for t, tf in enumerate(rnd.integers(0, 4, 6)) if tf]
    lists.sort(key=lambda x: (x["term"], x["m"], x["tf"]))
    import pyarrow as pa

    by_term = defaultdict(list)
    for x in lists:
        by_term[x["term"]].append(x)
    data = [{"shard": 1, "term": b"", "ms": [], "tfs": [], "ends": [], "docs": [], "ids": list(range(400))}]
    for term, own in by_term.items():
        data.append({"shard": 1, "term": term, "ms": [x["m"] for x in own], "tfs": [x["tf"] for x in own], "ends": list(range(1, len(own) + 1)), "docs": [x["doc"] for x in own], "ids": None})
    shard = strata.Shard(pa.Table.from_pylist(data, strata._ARROW))
    asked = [(b"a", 7), (b"c", 900), (b"f", 30), (b"zz", 5)]
    whole = Counter()
    for x in lists:
        if w := dict(asked).get(x["term"]):
            whole[x["doc"]] += w * (1_000_000_000 * x["tf"] // (1000 * x["tf"] + 20 * x["m"]))
    for k in (1, 5, 50, 1000):
        found, scores = shard.best(asked, k)
        best = sorted(whole.values(), reverse=True)[:k]
        assert sorted(scores.tolist(), reverse=True)[: len(best)] == best
        assert all(whole[d] == s for d, s in zip(found.tolist(), scores.tolist()))


# 12 --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(P.path(packing.VOCABULARY))
    found.encode_special_tokens = True
    return found


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 4, 40), packing.Limits(100, 3, 100)])
def test_packing_places_each_id_once(docs, rows, tokenizer, limits):
    got = packing.pack_documents(docs, P.path(packing.VOCABULARY), P.PATTERN, limits, reserve=300).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"], r["start"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want, have = Counter(), Counter()
    for doc_id, text, *_ in rows:
        ids = ids_of(tokenizer, text)
        want.update((doc_id, len(ids), i, int(x)) for i, x in enumerate(ids))
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        have.update((r["doc_id"], r["doc_tokens"], r["start"] + i, int(x)) for i, x in enumerate(ids))
    assert have == want
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["segment"] for r in own] == list(range(len(own)))
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        size = sum(r["length"] for r in own)
        assert size <= limits.tokens and len(own) <= limits.segments and sum(r["length"] - 1 for r in own) <= limits.loss
        assert size == limits.tokens or not size & (size - 1)


def test_encoder_equals_the_tokenizer(tokenizer):
    with open(P.path(packing.VOCABULARY), encoding="utf-8") as file:
        encoder = packing.Encoder(file.read(), P.PATTERN)
    odd = [
        "don't 's 're it'LL", "<|endoftext|> x", "a\tb c", "\x1c a \x85 b", "a\r\nb", "  a  b ", "\n\n\n", "été,\nÉté. x", "1²₃ ½ Ⅷ",
        "漢字 😀", "a" * 5000, " " * 5000 + "x", "!?" * 900, "  x　y", "ʼn ǅ ɏ ɐ",
    ]
    for text in [*odd, *(t or "" for t in texts())]:
        assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_dot_product_takes_what_points_the_way_the_room_does():
    packer = packing.Packer(packing.Limits(100, 10, 100), cuts=False)
    for i, (tokens, loss) in enumerate([(60, 10), (20, 80), (30, 5), (10, 10)]):
        packer.add(packing.Piece(i, 0, tokens, loss))
    # Shares of the room: all 1 at first, so the largest sum of demands (20 + 80), then
    # (80, 9, 20) of which (60, 10) has the largest product, then (10, 10).
    assert [p.example for p in packer.sequence()] == [1, 0, 3]
    assert [p.example for p in packer.sequence()] == [2]


def test_examples_stay_whole_under_all_limits(spark):
    rnd = random.Random(5)
    rows = [(i, n := rnd.randint(0, 300), rnd.randint(0, n)) for i in range(700)] + [(800, 2000, 5), (801, None, None), (None, 40, 40), (5, 7, 7)]
    limits = packing.Limits(512, 6, 200)
    examples = spark.createDataFrame([(*r, "x") for r in rows], "example_id long, tokens long, loss long, over string").repartition(2)
    got = packing.pack_examples(examples, limits, reserve=5_000).collect()
    assert Counter((r["example_id"], r["tokens"], r["loss"]) for r in got) == Counter((i, n or 0, m or 0) for i, n, m in rows)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    for own in sequences.values():
        if own[0]["over"]:
            assert len(own) == 1 and (own[0]["tokens"] > 512 or own[0]["loss"] > 200)
        else:
            assert len(own) <= 6 and sum(r["tokens"] for r in own) <= 512 and sum(r["loss"] for r in own) <= 200
    normal = [r for r in got if not r["over"]]
    least = max(sum(r["tokens"] for r in normal) / 512, sum(r["loss"] for r in normal) / 200, len(normal) / 6)
    assert len([s for s in sequences.values() if not s[0]["over"]]) <= 1.2 * least + 4
    assert packing.pack_examples(examples.limit(0)).collect() == []


def test_packing_nothing(none):
    assert packing.pack_documents(none, P.path(packing.VOCABULARY), P.PATTERN).collect() == []


# 13 --------------------------------------------------------------------------------------


def plain_repair(rows):
    """All ways, cheapest and ASCII-least first, by (rows left, state)."""
    from functools import cache

    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
        seen.add((role, text))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, state, inserted=0):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        names = {"u": "user", "a": "assistant"}
        if inserted < 3:
            for k in set(after[state]) & set("ua"):
                c, a, t = best(i, k, inserted + 1)
                ways.append((c + 5, "I" + a, (names[k] + ":", *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, state)
            ways.append((c + 2, "D" + a, t))
            if faults[i] in ("", "truncated"):
                own = 5 if faults[i] else 0
                if role[:1] and role[:1] in after[state]:
                    c, a, t = best(i + 1, role[:1])
                    ways.append((c + own, "K" + a, (f"{role}:{text}", *t)))
                for k in set(after[state]) & set("ua"):
                    c, a, t = best(i + 1, k)
                    ways.append((c + own + 1, "R" + a, (f"{names[k]}:{text}", *t)))
        return min(ways) if ways else (10**9, "", ())

    cost, audit, out = best(0, "")
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    count = Counter(faults)
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversations(seed, n):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", " ", "User"], ["Yes.", "no", "", " ", "What? ", "ok!\n", "ok", "Long one. " * 9]
    out = []
    for c in range(n):
        for turn in range(rnd.randint(1, 9)):
            t = None if rnd.random() < 0.1 else turn + (rnd.random() < 0.2)
            out.append((c, t, rnd.choices(roles, [9, 9, 3, 1, 1, 1, 1])[0], rnd.choice(texts), 1))
    return out


@pytest.mark.parametrize("bits", [0, 1, turns.LEAST_BITS])
def test_repair_equals_all_ways(spark, bits):
    rows = conversations(7, 60)
    by = defaultdict(list)
    for c, *row, _ in rows:
        by[str(c)].append(tuple(row))
    df = spark.createDataFrame([(str(c), *r, "x") for c, *r in rows], "conv string, turn long, role string, text string, copies long, block string").repartition(4)
    got = {r["conv"]: tuple(r)[1:] for r in turns.repair(df, least_bits=bits).collect()}
    assert got == {c: plain_repair(own) for c, own in by.items()}


def test_a_hot_conversation_is_cut_into_blocks(spark):
    rnd = random.Random(2)
    rows = [("hot", t, rnd.choice(["user", "assistant"]), f"{rnd.randint(0, 3000)}{rnd.choice(['.', ''])}", 1) for t in range(3000)]
    rows += [("hot", 7, "user", "the same row.", 1)] * 500 + [("cold", 0, "user", "Hi.", 1)]
    df = spark.createDataFrame(rows, "conv string, turn long, role string, text string, copies long").repartition(8)
    blocks = turns._blocks(turns._runs(df), 1)
    assert blocks.where("conv = 'hot'").count() >= 40 and blocks.agg(F.max(F.size("rows"))).first()[0] <= 128
    got = {r["conv"]: r for r in turns.repair(df, least_bits=1).collect()}
    whole = turns.repair(df, least_bits=13).where("conv = 'hot'").first()
    assert got["hot"] == whole and len(got["hot"]["audit"]) >= 3500
    assert got["cold"]["cost"] == 2 and got["cold"]["audit"] == "D"


def damage(conv_id, turn, role, text):
    blank = lambda v: " " if v is None else v
    role, text = blank(role), blank(text)
    kind = zlib.crc32(f"{blank(conv_id)}:{blank(turn)}".encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    row = (turn, "user" if kind == 4 else role, text)
    return [row, row] if kind == 3 else [row]


def test_damage_and_repair_on_awkward_rows(spark):
    rows = [(c, t, r, x) for c, t, r, x, _ in conversations(9, 80)]
    rows += [(None, 0, "user", "Hi."), (None, 1, None, "Yes."), (None, None, "assistant", None), (500, 1, "user", "Hi there.")] + [rows[3]] * 4
    rows += [(900 + i, None, "user", None) for i in range(40)]
    by = defaultdict(list)
    for c, *row in rows:
        by[c] += damage(c, *row)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, conv string").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.repaired_conversations(df).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: plain_repair(own) if own else empty for c, own in by.items()}
    assert empty in got.values()
    assert turns.repaired_conversations(df.limit(0)).collect() == []


# as registered ---------------------------------------------------------------------------


def test_columns_as_registered(spark, sf_dir):
    want = {
        "op11_strata": [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")],
        "op12_packing": [(c, "bigint") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
        "op13_turns": [(c, "bigint") for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", "string"), ("repaired_sha256", "string")],
    }
    for name, columns in want.items():
        assert catalog.queries()[name](spark, sf_dir).dtypes == columns
