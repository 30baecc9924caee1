"""Repeated passages by seed and extend: documents meet on winnowed anchors, matches are
extended both ways word by word, and repeats of at least a window's length count."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscade.llm.common import WordHashes, per_batch, table, words
from corpuscade.llm.repeats import Spec, cut, merge, repeated_spans, text_keys
from corpuscade.session import materialize

WINDOW, SEED = 50, 8
#: Texts with one anchor that are gathered at once.
HOT = 1_800
#: Contexts of an anchor that are extended against each other; more are first told apart
#: by a longer seed.
TOGETHER = 64


def _extents(seeds: list[np.ndarray]) -> np.ndarray:
    """Rows of hashes with different values beyond the end of each."""
    out = np.empty((len(seeds), max(map(len, seeds)) + 1), np.uint64)
    out[:] = np.arange(1, len(seeds) + 1, dtype=np.uint64)[:, None]
    for row, h in zip(out, seeds):
        row[: len(h)] = h
    return out


def extend(rows: list[dict], spec: Spec, known: WordHashes) -> list[list[tuple[int, int]]]:
    """For contexts of one seed: ranges of windows that a context of a smaller ``ord`` has.

    Each match is extended to the left and right of the seed; if it is as long as a window,
    the windows inside it are repeats.
    """
    order = sorted(range(len(rows)), key=lambda i: rows[i]["ord"])
    found: list[list[tuple[int, int]]] = [[] for _ in rows]
    first: dict[tuple, int] = {}
    twins: list[tuple[int, int]] = []
    for i in order:
        row = rows[i]
        leader = first.setdefault((row["ctx"], row["pin"], row["live"]), i)
        if leader != i:
            twins.append((i, leader))
    own = list(first.values())
    if len(own) > TOGETHER and rows[own[0]]["a"] < rows[own[0]]["b"]:
        groups: dict[tuple, list[tuple[int, dict]]] = defaultdict(list)
        for i in own:
            for piece in cut(spec, rows[i], 2):
                groups[piece["key"], piece["a"]].append((i, piece))
        for group in groups.values():
            for (i, piece), windows in zip(group, extend([p for _, p in group], spec, known)):
                found[i] += [(a + piece["offset"], b + piece["offset"]) for a, b in windows]
    elif len(own) > 1:
        hashes = [known.of(spec.units(rows[i]["ctx"])) for i in own]
        pins = [rows[i]["pin"] for i in own]
        left = _extents([h[:p][::-1] for h, p in zip(hashes, pins)])
        right = _extents([h[p:] for h, p in zip(hashes, pins)])
        ords = np.array([rows[i]["ord"] for i in own])
        for k in range(1, len(own)):
            smaller = int(np.searchsorted(ords, ords[k]))
            to_left = (left[:smaller] != left[k]).argmax(1)
            to_right = (right[:smaller] != right[k]).argmax(1)
            long = to_left + to_right >= spec.window
            if long.any():
                live, pin = rows[own[k]]["live"], pins[k]
                for l, r in set(zip(to_left[long].tolist(), to_right[long].tolist())):
                    a, b = max(0, pin - l), min(live - 1, pin + r - spec.window)
                    if a <= b:
                        found[own[k]].append((a, b))
    for i, leader in twins:
        if rows[i]["ord"] > rows[leader]["ord"]:
            found[i] = [(0, rows[i]["live"] - 1)]
        else:
            found[i] = found[leader]
    return found


def finder(spec: Spec) -> Callable[[list[dict]], list[list[tuple[int, int]]]]:
    def find(rows: list[dict]) -> list[list[tuple[int, int]]]:
        known, found = WordHashes(), [[]] * len(rows)
        groups: dict[tuple, list[int]] = defaultdict(list)
        for i, row in enumerate(rows):
            groups[row["key"], row["a"]].append(i)
        for group in groups.values():
            if len(group) > 1:
                for i, windows in zip(group, extend([rows[i] for i in group], spec, known)):
                    found[i] = windows
        return found

    return find


def _kept(units: list[bytes], spans: np.ndarray) -> list[bytes]:
    cuts = [0, *spans.ravel().tolist(), len(units)]
    return [w for a, b in zip(cuts[::2], cuts[1::2]) for w in units[a:b]]


def removed(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept_sha256, and ``kept``, the remaining words
    where some but not all are gone (else null).

    Every word goes that lies in ``window`` consecutive words which also start in a document
    with a smaller doc_id. Rows without a doc_id are neither smaller nor larger: they stay
    whole and take nothing away. Rows with the same doc_id do not touch each other. Null and
    empty texts have no words. An empty table gives an empty table; other columns are not
    looked at. doc_id is a whole number.
    """
    spec = Spec(window, SEED, by_words=True, hot=hot)

    def make() -> Callable[[pa.RecordBatch], dict]:
        def step(batch: pa.RecordBatch) -> dict:
            found = [words(t.as_py()) for t in batch.column("text")]
            shas = [hashlib.sha256(b" ".join(w)).hexdigest() for w in found]
            return {**{c: batch.column(c) for c in ("doc_id", "t1", "t2")}, "n_words": list(map(len, found)), "sha": shas}

        return step

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), F.coalesce("text", F.lit("")).alias("text"))
    narrow = materialize(per_batch(keyed, "doc_id long, t1 long, t2 long, n_words long, sha string", make), "texts")
    texts = narrow.where("doc_id is not null").groupBy("t1", "t2").agg(F.min("doc_id").alias("_id"))
    texts = materialize(texts.withColumn("ord", F.col("_id")), "different")
    found = repeated_spans(
        keyed.where("doc_id is not null").select(F.col("doc_id").alias("_id"), "t1", "t2", F.encode("text", "UTF-8").alias("data")),
        texts, spec, finder(spec), 64 << 10,
        flag=F.col("low") != F.col("high"),
        whole=lambda: F.col("ord") > F.col("_ord"),
        total=F.min("ord"),
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["t1"], r["t2"], _kept(r["data"].split(), merge(r["blobs"]))) for r in batch.to_pylist()]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)]
            columns += [pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([b" ".join(r[2]) for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["t1", "t2", "rest", "kept"])

    kept = found.mapInArrow(finish, "t1 long, t2 long, rest long, kept binary")
    known = texts.select("t1", "t2", F.col("ord").alias("first")).join(kept, ["t1", "t2"], "left")
    whole = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window), F.lit(False))
    own = F.col("doc_id") == F.col("first")
    gone = F.when(whole, F.col("n_words")).when(own, F.coalesce(F.col("n_words") - F.col("rest"), F.lit(0))).otherwise(0)
    return narrow.join(known, ["t1", "t2"], "left").select(
        "doc_id", "n_words", gone.cast("long").alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).when(own, F.coalesce(F.sha2("kept", 256), "sha")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(own & ~whole, F.col("kept")).alias("kept"),
    )


def op5_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).drop("kept")
