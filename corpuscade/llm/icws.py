"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of runs of five words: how often it has a run, times how rare the
run is. Consistent weighted sampling draws runs so that two texts draw the same one with a
probability equal to their weighted Jaccard similarity. Draws in bands name candidates,
and the similarity itself decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscade.llm.common import grams, hashed_words, mix, sliced, table
from corpuscade.llm.components import components
from corpuscade.llm.repeats import text_keys
from corpuscade.session import materialize

SHINGLE, SIMILAR = 5, 0.8
#: A pair at the threshold is missed with probability (1 - 0.8^3)^18, about 2 in a million.
BANDS, ROWS = 18, 3
#: Counters of the sketch of document frequencies: 4 MB, whatever the corpus.
DEPTH, WIDTH_BITS = 2, 19
COUNTER_BLOCK = 1 << 13
#: Buckets up to this size become pairs; larger ones are compared where they meet.
PAIRED = 16
BLOCK = 512

#: Texts a task remembers to have drawn from.
REMEMBERED = 500_000
#: Bytes of texts that are cut into runs together.
STEP = 1 << 20
#: Of runs in fewer than one of so many documents the sketch cannot tell how rare they are;
#: they weigh the same, at every size of the corpus.
RARE = 512

_DRAWS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_ODD = (_DRAWS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_OCCURRENCE = np.uint64(0xE7037ED1A0B428DB)

Runs = tuple[np.ndarray, np.ndarray]


def shingles(column: pa.Array) -> Iterator[Runs]:
    """For each text: hashes of its runs of five words, each once, and how often each occurs.

    A text of one to four words has one run, all of it; without words there is none.
    """
    h, sizes = hashed_words(column)
    runs, begins = grams(h, SHINGLE), np.cumsum(sizes) - sizes
    for at, n in zip(begins.tolist(), sizes.tolist()):
        own = np.sort(runs[at : at + n - SHINGLE + 1] if n >= SHINGLE else grams(h[at : at + n], n) if n else h[:0])
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
        yield own[first], np.diff(np.append(first, len(own)))


def shingles_of(text: str | bytes | None) -> Runs:
    return next(shingles(pa.array([text.encode() if isinstance(text, str) else text], pa.binary())))


def counters(hashes: np.ndarray) -> np.ndarray:
    """The counter of each hash in each row of the sketch (depth x hashes)."""
    rows = np.arange(DEPTH, dtype=np.uint64)[:, None]
    place = mix(hashes[None] + rows * np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(64 - WIDTH_BITS)
    return (place + (rows << np.uint64(WIDTH_BITS))).astype(np.int64)


class Rarity:
    """Inverse document frequency from a count-min sketch.

    ln((1 + documents) / (1 + frequency)) + 1. The frequency is the least counter, but at
    least 1 and a fixed share of the documents.
    """

    def __init__(self, counts: np.ndarray, documents: int):
        self.counts, self.documents = np.maximum(counts, max(documents / RARE, 1)).astype(np.float32), documents

    def of(self, hashes: np.ndarray) -> np.ndarray:
        frequency = self.counts[counters(hashes)].min(0) if len(hashes) else np.empty(0, np.float32)
        return np.log((1 + self.documents) / (1 + frequency.astype(np.float64))).clip(0) + 1


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Counters over all documents, and the number of documents with words.

    Each task sums up its own counters and sends them in blocks, which are summed where
    they meet; the driver gets one sketch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros(DEPTH << WIDTH_BITS, np.int64), 0
        for batch in sliced(batches, "text", STEP):
            found = [hashes for hashes, _ in shingles(batch.column("text")) if len(hashes)]
            if found:
                np.add.at(sums, counters(np.concatenate(found)).ravel(), 1)
                seen += len(found)
        if seen:
            blocks = sums.astype("<u4").reshape(-1, COUNTER_BLOCK)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([-1, *range(len(blocks))], pa.int32()),
                "counts": pa.array([np.array([seen], "<i8").tobytes(), *(b.tobytes() for b in blocks)], pa.binary()),
            })

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(data, "<i8" if block < 0 else "<u4").astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        columns = [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "counts"])

    schema = "block int, counts binary"
    parts = texts.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect()
    found = {r["block"]: np.frombuffer(r["counts"], np.int64) for r in parts}
    if not found:
        return np.zeros(DEPTH << WIDTH_BITS, np.int64), 0
    documents = int(found.pop(-1)[0])
    return np.concatenate([found[b] for b in sorted(found)]), documents


def _two(bits: np.ndarray) -> np.ndarray:
    """Minus the logarithm of the product of two uniform numbers, of 16 bits each: Gamma(2, 1)."""
    high = (bits >> np.uint32(16)).view(np.int32).astype(np.float32) + np.float32(0.5)
    low = (bits & np.uint32(0xFFFF)).view(np.int32).astype(np.float32) + np.float32(0.5)
    return np.float32(32 * np.log(2)) - np.log(high * low)


def draws(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One draw for each of the sampling functions: a hash of the run and its level.

    For run k: r, c ~ Gamma(2, 1), b ~ U(0, 1), all from its hash; t = floor(ln w / r + b),
    ln y = r (t - b); the run with the least ln c - ln y - r is drawn, with its t.
    """
    best = np.full(len(_DRAWS), np.inf, np.float32)
    out = np.zeros(len(_DRAWS), np.uint64)
    logs = np.log(weights).astype(np.float32)
    high, low = (hashes >> np.uint64(32)).astype(np.uint32), hashes.astype(np.uint32)
    columns = np.arange(len(_DRAWS))
    step = 256
    for at in range(0, len(hashes), step):
        w = logs[at : at + step, None]
        x = high[at : at + step, None] * _ODD
        x ^= low[at : at + step, None]
        for shift, odd in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
            x ^= x >> np.uint32(shift)
            x *= np.uint32(odd)
        x ^= x >> np.uint32(15)
        y = x * np.uint32(0x9E3779B1)
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(13)
        z = y * np.uint32(0xC2B2AE35)
        z ^= z >> np.uint32(16)
        r, c = _two(x), _two(y)
        b = ((z >> np.uint32(8)).view(np.int32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
        t = np.floor(w / r + b)
        a = np.log(c) - r * (t - b + np.float32(1))
        least = a.argmin(0)
        value = a[least, columns]
        closer = value < best
        best[closer] = value[closer]
        level = t[least, columns].astype(np.int64).astype(np.uint64)
        out[closer] = mix(hashes[at : at + step][least] ^ mix(level + _DRAWS))[closer]
    return out


def elements(text: bytes, rarity: Rarity) -> Runs:
    """The weighted set as a plain one: the n-th occurrence of a run, with the run's rarity.

    Sums of weights of common elements are sums of the smaller weights of common runs.
    """
    hashes, times = shingles_of(text)
    weight = rarity.of(hashes)
    which = np.repeat(np.arange(len(hashes)), times)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    return mix(hashes[which] + nth.astype(np.uint64) * _OCCURRENCE), weight[which]


def similarities(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarity of each to each (for a bounded block of texts)."""
    owner = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    flat, weights = np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets])
    total = np.bincount(owner, weights, len(sets))
    _, first, which, times = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)  # what one text alone has is in no intersection
    column = np.full(len(times), -1)
    column[shared] = np.arange(len(shared))
    common = np.zeros((len(sets), len(sets)))
    own = column[which]
    step = 4096
    for at in range(0, len(shared), step):
        here = (own >= at) & (own < at + step)
        held = np.zeros((len(sets), min(step, len(shared) - at)))
        held[owner[here], own[here] - at] = 1
        common += (held * weights[first[shared[at : at + step]]]) @ held.T
    union = total[:, None] + total[None] - common
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


def spanning(alike: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold the groups of a symmetric boolean matrix together."""
    waiting, links = np.ones(len(alike), bool), []
    for root in range(len(alike)):
        if not waiting[root]:
            continue
        waiting[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            fresh = np.flatnonzero(alike[at] & waiting)
            waiting[fresh] = False
            links += [(at, int(x)) for x in fresh]
            queue += fresh.tolist()
    return links


LINKS = "a1 long, a2 long, b1 long, b2 long"


def _links(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a1", "a2", "b1", "b2"])


def _verified_pairs(pairs: DataFrame, texts: DataFrame, rarity) -> DataFrame:
    """Pairs of texts that are similar enough."""
    a = texts.select(F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("data").alias("left"))
    b = texts.select(F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.col("data").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = rarity.value
        last: dict[tuple, tuple] = {}  # rows of one text come one after the other
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = (r["b1"], r["b2"])
                if key not in last:
                    last = {key: elements(r["right"], rare)}
                (ha, wa), (hb, wb) = elements(r["left"], rare), last[key]
                common = wa[np.isin(ha, hb)].sum()
                union = wa.sum() + wb.sum() - common
                if union > 0 and common >= (SIMILAR - 1e-9) * union:
                    out.append((r["a1"], r["a2"], r["b1"], r["b2"]))
            yield _links(out)

    return pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).mapInArrow(run, LINKS)


def _verified_blocks(members: DataFrame, texts: DataFrame, rarity) -> DataFrame:
    """Links within large buckets: each pair of blocks of a bucket is compared in one place.

    ``members`` has key, size, t1, t2. A bucket of m texts is cut into m / BLOCK blocks, so
    what a task holds is bounded; only links that hold groups together come out.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.select("key", "t1", "t2", blocks.alias("n"), F.pmod(F.xxhash64("t1", "t2", F.lit(5)), blocks).cast("int").alias("own"))
    met = own.select("key", "t1", "t2", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    dealt = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "t1", "t2")
    rows = dealt.join(texts.select("t1", "t2", "data"), ["t1", "t2"]).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = rarity.value
        group, ids, sets = None, [], []

        def close() -> pa.RecordBatch:
            links = spanning(similarities(sets) >= SIMILAR - 1e-9) if len(sets) > 1 else []
            return _links([(*ids[a], *ids[b]) for a, b in links])

        for batch in batches:
            for r in batch.to_pylist():
                if group != (r["key"], r["i"], r["j"]):
                    yield close()
                    group, ids, sets = (r["key"], r["i"], r["j"]), [], []
                ids.append((r["t1"], r["t2"]))
                sets.append(elements(r["data"], rare))
        yield close()

    return rows.mapInArrow(run, LINKS)


def links(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between different texts, as (t1, t2) structs: enough of them to tell which
    texts hang together by pairs of similarity 0.8 or more.

    ``texts``: t1, t2 and _id of one document of each different text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    counts, documents = document_frequencies(docs.select(text))
    rarity = spark.sparkContext.broadcast(Rarity(counts, documents))  # 4 MB

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, seen = rarity.value, set()
        for batch in sliced(batches, "text", STEP):
            ids = list(zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist()))
            rows = []
            for own, (hashes, times) in zip(ids, shingles(batch.column("text"))):
                if len(hashes) and own not in seen:
                    seen.add(own)  # a copy in the same task has the same draws
                    rows.append((*own, grams_of_bands(draws(hashes, times * rare.of(hashes)).reshape(BANDS, ROWS))))
            if len(seen) > REMEMBERED:
                seen.clear()
            if rows:
                t1, t2, keys = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(t1), pa.array(t2), pa.array(keys, pa.list_(pa.int64()))], ["t1", "t2", "keys"])

    sketched = docs.select(*text_keys(), text).mapInArrow(sketch, "t1 long, t2 long, keys array<long>")
    sketches = materialize(sketched.dropDuplicates(["t1", "t2"]), "sketches")
    entries = sketches.select(F.explode("keys").alias("key"), "t1", "t2")
    sizes = entries.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("t1", "t2")).alias("set"))
    # Bands that gather the same texts are looked at once.
    buckets = sizes.where("size > 1").groupBy("size", "set").agg(F.min("key").alias("key"))
    members = materialize(entries.join(buckets.select("key", "size"), "key"), "members")
    asked = members.select("t1", "t2").distinct().join(texts, ["t1", "t2"])
    source = docs.select(F.col("_id"), *text_keys(), F.encode(text, "UTF-8").alias("data"))
    candidates = materialize(
        source.join(asked, ["_id", "t1", "t2"]).dropDuplicates(["_id", "t1", "t2"]).select("t1", "t2", "data"), "candidates"
    )
    near = members.where(F.col("size") <= PAIRED).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("t1", "t2"))).alias("m"))
    later = F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, PAIRED), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = near.select(F.explode(F.flatten(later)).alias("p")).select(
        F.col("p.a.t1").alias("a1"), F.col("p.a.t2").alias("a2"), F.col("p.b.t1").alias("b1"), F.col("p.b.t2").alias("b2")
    ).distinct()
    found = _verified_pairs(pairs, candidates, rarity)
    large = members.where(F.col("size") > PAIRED)
    if not large.isEmpty():
        found = found.unionByName(_verified_blocks(large, candidates, rarity))
    node = lambda s: F.struct(F.col(f"{s}1").alias("t1"), F.col(f"{s}2").alias("t2")).alias(s)
    return found.select(node("a"), node("b"))


def grams_of_bands(drawn: np.ndarray) -> np.ndarray:
    """One key for each band, different between bands."""
    key = np.arange(1, len(drawn) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for column in drawn.T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def classes(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, t1, t2, class_id and class_rows.

    Rows are in one class if their texts are equal or hang together by links of weighted
    Jaccard similarity 0.8 or more. class_id is the least doc_id of the class (null if all
    are null). Null and empty texts are equal texts; texts without words are linked to none.
    An empty table gives an empty table; other columns are not looked at.
    """
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "text")
    narrow = materialize(named.select("doc_id", "_id", *text_keys()), "texts")
    texts = materialize(
        narrow.groupBy("t1", "t2").agg(F.min("_id").alias("_id"), F.min("doc_id").alias("first"), F.count("*").alias("n")), "different"
    )
    roots = components(links(named, texts.select("t1", "t2", "_id")))
    own = F.struct("t1", "t2")
    rooted = texts.withColumn("node", own).join(roots, "node", "left").select("t1", "t2", "first", "n", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    groups = rooted.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_rows"))
    known = rooted.join(groups, "root").select("t1", "t2", "class_id", "class_rows")
    return narrow.drop("_id").join(known, ["t1", "t2"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns of ``docs``: the one with the least doc_id.

    Rows that agree in doc_id and text count as one.
    """
    kept = classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "t1", "t2", "class_id").distinct()
    first = kept.groupBy("class_id").agg(F.min(F.struct("t1", "t2")).alias("t"))
    # Null ids have no class_id: each different text of them is its own class then.
    named = kept.where("class_id is not null").join(first, "class_id").where("t.t1 = t1 and t.t2 = t2").select("doc_id", "t1", "t2")
    nameless = kept.where("class_id is null").select("doc_id", "t1", "t2")
    chosen = named.unionByName(nameless).withColumnsRenamed({"doc_id": "_doc", "t1": "_t1", "t2": "_t2"})
    t1, t2 = text_keys()
    rows = docs.withColumns({"_u1": t1, "_u2": t2})
    met = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["_doc"]) & (F.col("_u1") == F.col("_t1")) & (F.col("_u2") == F.col("_t2")))
    return met.dropDuplicates(["_doc", "_t1", "_t2"]).select(*docs.columns)


def op8_icws(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_rows", (F.col("doc_id") == F.col("class_id")).alias("kept"))
