"""A stream of questions answered from a fixed index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from corpuscade.streaming.runner import drain_batches


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, progress: str) -> str:
    """Run ``answer`` on each micro-batch of ``questions(q_id, text)``.

    Results go to ``out``, a folder per batch; a batch that is run again after a
    failure replaces its own folder, so every question is answered once. ``out`` and the
    checkpoint folder ``progress`` belong together: with both, a stream goes on where it
    stopped.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        answered = answer(batch).withColumn("batch", F.lit(batch_id))
        (
            answered.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(out)
        )

    drain_batches(questions, progress, handle)
    return out
