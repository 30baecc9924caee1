"""A bounded sample of labelled rows to learn from, and one-task training on it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuscade.llm.common import digest

#: Most labelled rows a model learns from.
SAMPLE = 12_000


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text (null: empty), modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int = SAMPLE) -> DataFrame:
    """Up to ``limit`` labelled documents: (doc_id, text, y).

    Rows are chosen by a hash of their id among those where ``usable`` holds and the label
    is not null, so a re-run chooses the same ones. The chosen ids are broadcast: their
    number is the parameter. Of several rows of one id the one with the least text digest
    is taken, so there are never more rows than ids.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(label))
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable)
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(order, "doc_id").limit(limit)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("text"), digest("text")).alias("row"), F.max("y").alias("y"))
    return one.select("doc_id", "row.text", "y")


def learn(
    features: DataFrame, train: Callable[[Iterator[pa.RecordBatch]], list[np.ndarray]]
) -> list[np.ndarray]:
    """Run ``train`` over the features of the sample in one task; its arrays come back.

    ``features`` has at most the sample's rows and an ``_order`` column that fixes the
    order of learning. What comes back is the model, whose size does not depend on the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = train(batches)
        columns = {
            "at": pa.array(range(len(arrays)), pa.int32()),
            "data": pa.array([a.tobytes() for a in arrays], pa.binary()),
            "kind": pa.array([a.dtype.str for a in arrays]),
        }
        yield pa.RecordBatch.from_pydict(columns)

    one = features.repartition(1).sortWithinPartitions("_order")
    rows = one.mapInArrow(run, "at int, data binary, kind string").collect()
    if not rows:  # no task ran: an empty sample
        return train(iter(()))
    return [np.frombuffer(r["data"], r["kind"]) for r in sorted(rows, key=lambda r: r["at"])]


def int_lists(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column as arrays that share its memory."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(ends, ends[1:])]
