"""Models inside UDFs: loaded once for each task, then asked batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuscade.functions import text as tx
from corpuscade.session import materialize

#: What the learned scorer sees of a question and a passage.
SIGNALS = ("term share", "bigram share", "longest run share", "length")


def per_task(load: Callable[[], object], apply: Callable[[object, pa.Array], pa.Array], returns: str):
    """A Column function over an Arrow model: ``load()`` runs once a task, ``apply(model, batch)`` for
    each of its batches."""

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for batch in batches:
            yield apply(model, batch)

    return run


def signals(question: Column, passage: Column) -> Column:
    """``array<double>`` of SIGNALS, by built-in functions."""

    def share(q: Column, p: Column) -> Column:
        q = F.array_distinct(q)
        found = F.size(F.array_intersect(q, p)).cast("double")
        return F.coalesce(found / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))

    q, p = tx.terms(question), tx.terms(passage)
    pairs = tx.bigrams(q)
    # The common bigrams are worked out once, not for each bigram.
    common = F.array_repeat(F.array_intersect(pairs, tx.bigrams(p)), F.size(pairs))
    runs = F.zip_with(pairs, common, lambda b, found: F.array_contains(found, b).cast("int"))
    longest = F.aggregate(
        runs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda s, r: F.struct((s["now"] * r + r).alias("now"), F.greatest(s["best"], s["now"] * r + r).alias("best")),
        lambda s: s["best"].cast("double"),
    )
    run_share = F.coalesce(longest / F.nullif(F.size(pairs), F.lit(0)), F.lit(0.0))
    return F.array(share(q, p), share(pairs, tx.bigrams(p)), run_share, F.log1p(F.size(p).cast("double")))


def learn_weights(examples: DataFrame, rounds: int = 300, rate: float = 0.5, together: int = 200_000) -> np.ndarray:
    """Logistic weights, the bias last, from all ``examples(x array<double>, y int)`` that have a y.

    Equal examples are one row that counts as often. Up to ``together`` such rows are learned from in
    one task; more stay where they lie, and each round adds up what every task finds in its own.
    """
    rows = examples.where("y is not null").groupBy("x", "y").agg(F.count("*").alias("n"))
    rows = materialize(rows, "different-examples")
    size = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("ones")).first()
    if not size["rows"]:
        return np.r_[np.ones(len(SIGNALS) - 1), 0.0, 0.0]
    if size["rows"] > together:
        return _descend(lambda w: _slope_of_all(rows, w, size["ones"] / size["n"]) / size["n"], rounds, rate)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_arrays(batch) for batch in batches if batch.num_rows]
        w = logistic(*(np.concatenate(p) for p in list(zip(*parts))[:2]), rounds, rate, np.concatenate([n for _, _, n in parts]))
        yield pa.RecordBatch.from_pydict({"w": pa.array([w], pa.list_(pa.float64()))})

    one = rows.repartition(1).sortWithinPartitions("x", "y")
    return np.array(one.mapInArrow(train, "w array<double>").first()["w"])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x, batch.column("y").to_numpy(), batch.column("n").to_numpy()


def _slope(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray | None, share: float) -> np.ndarray:
    """Sum of the examples' gradients at ``w`` (None: zero), both classes weighing the same."""
    share = np.clip(share, 1e-6, 1 - 1e-6)
    weight = n * np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    x = np.c_[x, np.ones(len(x))]
    p = 0.5 if w is None else 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
    return x.T @ (weight * (p - y))


def _slope_of_all(rows: DataFrame, w: np.ndarray | None, share: float) -> np.ndarray:
    """``_slope`` over ``rows(x, y, n)``: a vector from each task, added up in the tasks' order."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [_slope(*_arrays(batch), w, share) for batch in batches if batch.num_rows]
        if total:
            yield pa.RecordBatch.from_pydict({"slope": pa.array([np.sum(total, axis=0)], pa.list_(pa.float64()))})

    return np.sum([r["slope"] for r in rows.mapInArrow(add, "slope array<double>").collect()], axis=0)


def _descend(slope: Callable[[np.ndarray | None], np.ndarray], rounds: int, rate: float) -> np.ndarray:
    """Gradient descent from zero."""
    w = None
    for _ in range(rounds):
        step = slope(w)
        w = np.zeros(len(step)) if w is None else w
        w = w - rate * (step + 1e-3 * w)
    return w


def logistic(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, n: np.ndarray | None = None) -> np.ndarray:
    """Weights by gradient descent with both classes weighing the same; row i counts ``n[i]`` times."""
    n = np.ones(len(y)) if n is None else n
    return _descend(lambda w: _slope(x, y, n, w, np.average(y, weights=n)) / n.sum(), rounds, rate)


def learned_scorer(weights: np.ndarray, loads=None):
    """A scorer for ``fusion.rerank`` from logistic weights. ``loads``, an accumulator, counts how
    often the model is loaded."""

    def load() -> np.ndarray:
        if loads is not None:
            loads.add(1)
        return weights

    def apply(w: np.ndarray, batch: pa.Array) -> pa.Array:
        x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(w) - 1)
        return pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40))), pa.float64())

    score = per_task(load, apply, "double")
    return lambda question, passage: score(signals(question, passage))
