"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Every coordinate has a learning rate of its own, and the L1 term keeps a weight at zero
until its gradients agree; what is left is a short list of weights that is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscade.llm.common import EDGES, grams, mix, per_batch, sliced, table, words
from corpuscade.llm.labelled import SAMPLE, int_lists, learn, remainder, sample, sigmoid

BITS = 20
ALPHA, BETA, L1, L2 = 0.3, 1.0, 6.0, 0.1
EPOCHS = 4
THRESHOLD = 0.3
#: Skip-grams join words that have 1 or 2 others between them.
SKIPS = (2, 3)
#: Bytes of texts that are scored together.
STEP = 1 << 20
#: Characters at a word's beginning that are features of their own.
STEMS = (4, 5, 6)


class Stems(dict):
    """Word to a number: of its ``hashes`` entry, the plain word's, and its row of ``coordinates``,
    those of the plain word and of its first characters.

    Languages that inflect have many forms of one word; its beginning is what they share.
    """

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit, self._new = limit, []
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.hashes, self.coordinates = np.empty(0, np.uint64), np.empty((0, 1 + len(STEMS)), np.int32)

    def __missing__(self, word: bytes) -> int:
        plain = word.decode("utf-8", "replace").lower().strip(EDGES) or "\0"
        own = _hash(plain)
        # Where a word has no such beginning, the whole word stands in its place once more.
        self._new.append([own, *(_hash(f"{plain[:k]}\0{k}") if len(plain) > k else own for k in STEMS)])
        number = self[word] = len(self)
        return number

    def of(self, found: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self._forget()
        numbers = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        if self._new:
            new = np.array(self._new, np.uint64)
            self.hashes = np.concatenate([self.hashes, new[:, 0]])
            self.coordinates = np.concatenate([self.coordinates, _coordinate(mix(new))])
            self._new.clear()
        return numbers


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode())


def _coordinate(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


_KNOWN: list[Stems] = []


def known_words() -> Stems:
    """What this worker process knows of words; all its tasks add to it."""
    if not _KNOWN:
        _KNOWN.append(Stems())
    return _KNOWN[0]


def _neighbours(h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(distance, coordinates) of pairs of words that far apart, from the first word on."""
    yield 1, _coordinate(grams(h, 2))
    for gap in SKIPS:
        if len(h) > gap:
            yield gap, _coordinate(mix(h[:-gap] * np.uint64(2 * gap + 1) + mix(h[gap:] + np.uint64(gap))))


def features(text: str | None, known: Stems) -> np.ndarray:
    """The coordinates of a text, each once: words and stems, neighbours, and skip-grams."""
    numbers = known.of(words(text))
    pairs = [c for _, c in _neighbours(known.hashes[numbers])]
    return np.unique(np.concatenate([known.coordinates[numbers].ravel(), *pairs]))


def logits(texts: list[str | None], known: Stems, dense: np.ndarray, live: np.ndarray, bias: float) -> np.ndarray:
    """Sums of the weights (``dense``) of each text's coordinates. Only those with a weight
    (``live``) are made unique: the others add nothing."""
    found = [words(t) for t in texts]
    own = np.repeat(np.arange(len(texts)), list(map(len, found)))
    numbers = known.of([w for f in found for w in f])
    parts = [(np.repeat(own, 1 + len(STEMS)), known.coordinates[numbers].ravel())]
    for gap, at in _neighbours(known.hashes[numbers]):
        parts.append((np.where(own[:-gap] == own[gap:], own[gap:], -1), at))  # no pairs across texts
    hits = []
    for who, at in parts:
        here = np.flatnonzero(live[at])
        hits.append(who[here].astype(np.int64) << BITS | at[here])
    hits = np.unique(np.concatenate(hits))
    hits = hits[hits >= 0]
    return bias + np.bincount(hits >> BITS, dense[hits & ((1 << BITS) - 1)], len(texts))


class FTRL:
    """Follow the regularised leader, one coordinate a feature and one for the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)  # the bias is free
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        gradient = sigmoid(w.sum()) - y
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + gradient * gradient


def train(docs: DataFrame, labels: DataFrame, label: str, usable, limit: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, their weights that are not zero, and the bias.

    Learns from at most ``limit`` labelled documents. Without labelled documents there are
    no weights and the bias is 0; null and empty texts teach the bias alone.
    """
    rows = sample(docs, labels, label, usable, limit)

    def make() -> Callable[[pa.RecordBatch], dict]:
        known = known_words()

        def step(batch: pa.RecordBatch) -> dict:
            found = [features(t.as_py(), known) for t in batch.column("text")]
            return {"_order": batch.column("_order"), "y": batch.column("y"), "at": found}

        return step

    ordered = rows.select(F.xxhash64("doc_id", F.lit("order")).alias("_order"), "y", "text")
    featured = per_batch(ordered, "_order long, y int, at array<int>", make)

    def fit(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        ys, ats = [], []
        for batch in batches:
            ys += batch.column("y").to_pylist()
            ats += [a.copy() for a in int_lists(batch.column("at"))]
        bias = np.array([1 << BITS], np.int64)
        model = FTRL(1 << BITS)
        for _ in range(EPOCHS):
            for y, at in zip(ys, ats):
                model.learn(np.concatenate([at, bias]), y)
        w = model.weights(np.arange(1 << BITS))
        kept = np.flatnonzero(w)
        return [kept.astype(np.int32), w[kept], model.weights(bias)]

    at, w, bias = learn(featured, fit)
    return at, w, float(bias[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score): null and empty texts get the score of the bias. Rows stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 12 MB, in practice few KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        dense, live, known = np.zeros(1 << BITS), np.zeros(1 << BITS, bool), known_words()
        dense[at], live[at] = w, True
        for batch in sliced(batches, "text", STEP):
            found = logits(batch.column("text").to_pylist(), known, dense, live, bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(found))], ["doc_id", "score"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, "toxic", remainder(4) != 2)
    return score(docs, model).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
