"""Sentence-aware chunking.

The JVM cuts and counts; only the counts go through Arrow to a short fold that
says where chunks start and end, and the JVM then builds the chunk texts. A
document stays in its row throughout, so chunking never shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuscade.functions import text as tx

# Chunk size in tokens, and tokens carried into the next chunk.
CHUNK_SIZE = 1024
CHUNK_OVERLAP = 200


def with_pieces(df: DataFrame, text: str, chunk_size: int, out: str = "pieces") -> DataFrame:
    """Add the sentences of ``text``; one above ``chunk_size`` tokens is cut every ``chunk_size``."""

    def cut(sentence: Column) -> Column:
        tokens = F.regexp_extract_all(sentence, F.lit(r"\s*\S+(?:\s+\z)?"), F.lit(0))
        # One-element transform: evaluates the token list once for all slices.
        return F.flatten(
            F.transform(
                F.array(tokens),
                lambda t: F.transform(
                    F.sequence(F.lit(0), F.floor((F.size(t) - 1) / chunk_size).cast("int")),
                    lambda i: F.array_join(F.slice(t, i * chunk_size + 1, F.lit(chunk_size)), ""),
                ),
            )
        )

    # So many tokens have a space between each two: most sentences are too short for it by their
    # length, and their tokens are counted once only, by the caller.
    cut_up = F.transform(
        tx.sentences(F.col(text)),
        lambda s: F.when((F.length(s) > 2 * chunk_size) & (tx.n_tokens(s) > chunk_size), cut(s)).otherwise(F.array(s)),
    )
    return df.withColumn(out, F.flatten(cut_up))


def span_fold(counts: np.ndarray, chunk_size: int, overlap: int) -> list[int]:
    """Greedy packing of one document: ``[start, end, start, end, ...]`` over its pieces.

    A chunk takes pieces while they fit; the next one starts as far back as the
    overlap, and the room beside its first new piece, allow.
    """
    total = np.concatenate(([0], np.cumsum(counts)))
    n, start, spans = len(counts), 0, []
    while start < n:
        end = int(np.searchsorted(total, total[start] + chunk_size, side="right")) - 1
        spans += [start, end]
        if end == n:
            break
        room = min(overlap, chunk_size - int(counts[end]))
        start = int(np.searchsorted(total, total[end] - room, side="left")) if room > 0 else end
    return spans


def _spans_udf(chunk_size: int, overlap: int):
    @F.arrow_udf("array<int>")
    def spans(counts: pa.Array) -> pa.Array:
        flat = counts.flatten().to_numpy(zero_copy_only=False)
        offsets = counts.offsets.to_numpy() - counts.offsets[0].as_py()
        rows = [
            span_fold(flat[a:b], chunk_size, overlap) for a, b in zip(offsets[:-1], offsets[1:])
        ]
        return pa.array(rows, type=pa.list_(pa.int32()))

    return spans


def chunk_documents(
    docs: DataFrame,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = 0,
    text: str = "text",
) -> DataFrame:
    """One row per chunk: the other columns of ``docs``, chunk_no, n_tokens, text.

    ``chunk_no`` counts from 0. A document without text has no chunk.
    """
    keep = [c for c in docs.columns if c != text]
    whole = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    counted = (
        with_pieces(whole, text, chunk_size)
        .select(*keep, "pieces", F.transform("pieces", tx.n_tokens).alias("counts"))
        .withColumn("spans", _spans_udf(chunk_size, overlap)("counts"))
    )

    def build(i: Column) -> Column:
        start = F.get("spans", i * 2)
        length = F.get("spans", i * 2 + 1) - start
        return F.struct(
            i.alias("chunk_no"),
            F.aggregate(
                F.slice("counts", start + 1, length), F.lit(0), lambda acc, n: acc + n
            ).alias("n_tokens"),
            tx.strip_space(F.array_join(F.slice("pieces", start + 1, length), "")).alias("text"),
        )

    n_chunks = F.floor(F.size("spans") / 2).cast("int")
    numbers = F.when(n_chunks > 0, F.sequence(F.lit(0), n_chunks - 1)).otherwise(
        F.array().cast("array<int>")
    )
    built = counted.select(*keep, F.explode(F.transform(numbers, build)).alias("c"))
    return built.select(*keep, "c.*").where(F.col("n_tokens") > 0)


def chunk_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Chunk counts and sizes per group."""
    return chunks.groupBy(*by).agg(
        F.count("*").alias("n_chunks"),
        F.sum("n_tokens").alias("n_tokens"),
        F.max("n_tokens").cast("long").alias("max_tokens"),
        F.round(F.avg("n_tokens"), 6).alias("avg_tokens"),
    )
