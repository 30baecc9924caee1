"""Quality classifier: a factorisation machine over words, structure and length.

A text scores  w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j.  The pairs cost linear time:
they are half of (sum v_i x_i)^2 - sum (v_i x_i)^2, factor by factor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscade.llm.common import PlainWords, grams, mix, per_batch, table, words
from corpuscade.llm.labelled import SAMPLE, int_lists, learn, remainder, sample, sigmoid

BITS = 16
RANK = 8
EPOCHS = 6
RATE, L2, SPREAD = 0.1, 1e-4, 0.05
THRESHOLD = 0.3
#: Share of a text's squared length that its words have; the statistics have the rest.
WORD_WEIGHT = 0.5
SYMBOLS = b"#*$%&|<>@~^_=+\\{}[]"
UPPER, LOWER = range(ord("A"), ord("Z") + 1), range(ord("a"), ord("z") + 1)
_KIND = np.zeros(256, np.uint8)
_KIND[list(UPPER)], _KIND[list(LOWER)], _KIND[list(range(ord("0"), ord("9") + 1))] = 1, 2, 3
_KIND[list(SYMBOLS)] = 4
_KIND[list(b".,;:")], _KIND[list(b"!?")], _KIND[list(b"\t\n\x0b\x0c\r ")], _KIND[128:] = 5, 6, 7, 8
STATISTICS = 16


def statistics(data: bytes, found: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """Structure of a text, each number about -1 to 1."""
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=9)
    n, size = max(len(found), 1), max(len(data) - int(kinds[7]), 1)
    letters = max(int(kinds[1] + kinds[2] + kinds[8]), 1)
    lines = [line for line in data.split(b"\n") if line.strip()]
    triples = grams(hashes, 3)
    repeated = 1 - len(np.unique(triples)) / max(len(triples), 1) if len(triples) else 0.0
    return np.clip([
        1.0,
        np.log1p(len(found)) / 5 - 1,  # the length, which is the table's metadata, too
        size / n / 5 - 1,
        2 * kinds[1] / letters,
        4 * kinds[3] / size,
        8 * kinds[4] / size,
        4 * kinds[5] / n,
        4 * kinds[6] / n,
        kinds[8] / size,
        2 * repeated,
        1 - len(set(lines)) / max(len(lines), 1),
        len(set(found)) / n,
        np.log1p(len(lines)) / 4,
        np.log1p(n / max(len(lines), 1)) / 4 - 1,
        2 * sum(w[-1:] in b"*#$%&|" for w in found) / n,
        float(not found),
    ], -2, 2)


def features(text: str | None, known: PlainWords) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values: hashed words by logarithmic count, then the statistics."""
    found = words(text)
    h = known.of(found)
    at, times = np.unique((mix(h) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    x = np.log1p(times)
    if len(x):
        x *= np.sqrt(WORD_WEIGHT) / np.linalg.norm(x)
    own = np.arange(1 << BITS, (1 << BITS) + STATISTICS)
    return np.concatenate([at, own]), np.concatenate([x, statistics((text or "").encode(), found, h)])


def value(w: np.ndarray, v: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Score before the sigmoid, without w0, and sum v_i x_i."""
    vx = v * x[:, None]
    sums = vx.sum(0)
    return float(w @ x + 0.5 * (sums @ sums - (vx * vx).sum())), sums


def train(docs: DataFrame, labels: DataFrame, label: str, usable, limit: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, factors and bias, learned from at most ``limit`` labelled documents.

    AdaGrad steps on the logistic loss, in an order fixed by hashes of the ids. Without
    labelled documents every score is 0.5. The rarer class counts as much as the other,
    up to three times.
    """
    rows = sample(docs, labels, label, usable, limit)

    def make() -> Callable[[pa.RecordBatch], dict]:
        known = PlainWords()

        def step(batch: pa.RecordBatch) -> dict:
            found = [features(t.as_py(), known) for t in batch.column("text")]
            return {
                "_order": batch.column("_order"), "y": batch.column("y"),
                "at": [a.astype(np.int32) for a, _ in found], "x": [x.astype(np.float32) for _, x in found],
            }

        return step

    ordered = rows.select(F.xxhash64("doc_id", F.lit("order")).alias("_order"), "y", "text")
    featured = per_batch(ordered, "_order long, y int, at array<int>, x array<float>", make)

    def fit(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        ys, ats, xs = [], [], []
        for batch in batches:
            ys += batch.column("y").to_pylist()
            ats += [a.copy() for a in int_lists(batch.column("at"))]
            xs += [x.astype(float) for x in int_lists(batch.column("x"))]
        size = (1 << BITS) + STATISTICS
        start = np.random.default_rng(7)
        w, v, w0 = np.zeros(size), start.normal(0, SPREAD, (size, RANK)), 0.0
        gw, gv, g0 = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
        share = max(sum(ys), 1) / max(len(ys), 2)
        weigh = {1: min(3.0, max(1.0, (1 - share) / share)), 0: min(3.0, max(1.0, share / max(1 - share, 1e-9)))}
        for _ in range(EPOCHS):
            for y, at, x in zip(ys, ats, xs):
                own = v[at]
                score, sums = value(w[at], own, x)
                g = (sigmoid(w0 + score) - y) * weigh[y]
                dw = g * x + L2 * w[at]
                dv = g * (x[:, None] * sums - own * (x * x)[:, None]) + L2 * own
                gw[at] += dw * dw
                gv[at] += dv * dv
                g0 += g * g
                w[at] -= RATE * dw / np.sqrt(gw[at])
                v[at] -= RATE * dv / np.sqrt(gv[at])
                w0 -= RATE * g / np.sqrt(g0)
        return [w.astype(np.float32), v.astype(np.float32).ravel(), np.array([w0])]

    w, v, w0 = learn(featured, fit)
    return w, v.reshape(-1, RANK), float(w0[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id unless told otherwise) and ``score``, row by row.

    Null and empty texts are scored by their statistics. A column called score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2.4 MB
    keep = [c for c in (["doc_id"] if keep is None else keep) if c != "score"]

    def make() -> Callable[[pa.RecordBatch], dict]:
        (w, v, w0), known = shared.value, PlainWords()

        def step(batch: pa.RecordBatch) -> dict:
            scores = []
            for text in batch.column("text"):
                at, x = features(text.as_py(), known)
                scores.append(w0 + value(w[at], v[at], x)[0])
            return {**{c: batch.column(c) for c in keep}, "score": sigmoid(np.array(scores, float))}

        return step

    read = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)
    return per_batch(read, f"{schema}, score double", make)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with their own columns."""
    model = train(docs, labels, "quality", remainder(5) != 0)
    named = docs.withColumnRenamed("score", "_score") if "score" in docs.columns else docs
    kept = score(named, model, named.columns).where(F.col("score") >= threshold).drop("score")
    return kept.withColumnRenamed("_score", "score") if "score" in docs.columns else kept


def op10_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, "quality", remainder(5) != 0)
    return score(docs, model).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
