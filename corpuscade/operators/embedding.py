"""Turning text into vectors.

The default embedding hashes term counts into a fixed number of dimensions and
scales to length one. A model goes in by passing another ``embed`` function:
any Column function from text to ``array<float>``, such as an iterator pandas
UDF that loads the model once per task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuscade.functions import text as tx

DIMENSIONS = 64
# Texts of a batch that are worked on at once.
SLICE = 512


def in_slices(column: pa.Array, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``work`` over a few rows at a time, so what it needs beside the batch does not grow with the batch."""
    return pa.concat_arrays([work(column.slice(at, SLICE)) for at in range(0, max(1, len(column)), SLICE)])


def term_buckets(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Bucket of each term: the first eight hex digits of its MD5, modulo ``dimensions``."""
    return F.transform(
        tx.terms(text),
        lambda t: F.pmod(
            F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dimensions)
        ).cast("int"),
    )


def _count_udf(dimensions: int):
    def counted(buckets: pa.Array) -> pa.Array:
        n = len(buckets)
        offsets = buckets.offsets.to_numpy().astype(np.int64)
        flat = buckets.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n), np.diff(offsets))
        grid = np.bincount(row * dimensions + flat, minlength=n * dimensions)
        grid = grid.reshape(n, dimensions).astype(np.float64)
        norm = np.sqrt((grid * grid).sum(axis=1, keepdims=True))
        unit = np.divide(grid, norm, out=np.zeros_like(grid), where=norm > 0)
        values = pa.array(unit.astype(np.float32).ravel())
        return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dimensions, values)

    @F.arrow_udf("array<float>")
    def counts(buckets: pa.Array) -> pa.Array:
        return in_slices(buckets, counted)

    return counts


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    return _count_udf(dimensions)(term_buckets(text, dimensions))


def embed_chunks(
    chunks: DataFrame, text: str = "text", out: str = "embedding", embed=hashed_embedding
) -> DataFrame:
    return chunks.withColumn(out, embed(F.col(text)))
