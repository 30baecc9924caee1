"""Ranked cuts, as windows and inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

CHUNK_ID = ("doc_id", "chunk_no")
# Questions that are shipped to every task at once, and score cells held at a time.
QUESTION_BLOCK = 8_192
MAX_CELLS = 4_000_000


# Scores are compared and returned with six decimals.
SCALE = 1e6


def rounded(score) -> Column:
    """The rounding that every plan applies to a score: half up, the same in SQL and NumPy."""
    return F.floor(F.col(score) * SCALE + 0.5) / SCALE


def top_k(
    df: DataFrame,
    k: int,
    by: tuple[str, ...] = ("q_id",),
    ids: tuple[str, ...] = CHUNK_ID,
    score: str = "score",
    rank: str = "rank",
) -> DataFrame:
    """The ``k`` best rows per group, ranked from 1; ties go to the smaller id.

    Spark cuts each partition to ``k`` rows per group before the shuffle, so a
    group of any size reaches its final task small.
    """
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), *ids)
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(ranked)).where("_rn <= 1").drop("_rn")


class Leaders:
    """The ``k`` best chunks per question among the score blocks a task has seen.

    What may be among them waits until there is as much of it as of what is held; then both are
    sorted at once. A floor that lags lets more wait, never less.
    """

    def __init__(self, k: int, ids: tuple[str, ...]):
        self.k, self.ids = k, ids
        self.floor = np.empty(0)  # by question: the k-th best score when last sorted
        self._held: list[np.ndarray] | None = None  # id columns, question, score
        self._waiting: list[list[np.ndarray]] = []

    @property
    def rows(self) -> list[np.ndarray] | None:
        """Id columns, question, score: of each question the ``k`` best so far, in order."""
        self._settle()
        return self._held

    def floors(self, questions: int) -> np.ndarray:
        """The floors of the first ``questions`` questions."""
        if questions > len(self.floor):
            self.floor = np.r_[self.floor, np.full(questions - len(self.floor), -np.inf)]
        return self.floor[:questions]

    def add(
        self, own: list[np.ndarray], scores: np.ndarray, matched: np.ndarray | None = None, asked: np.ndarray | None = None
    ) -> None:
        """Take in ``scores`` (chunks x questions); only ``matched`` cells count, if given. The
        columns stand for the questions numbered ``asked``, by default for all."""
        most = scores.shape[1] if asked is None else (int(asked.max()) + 1 if len(asked) else 0)
        floor = self.floors(most)
        # A score is rounded by half of 1 / SCALE at most; the few that get by are looked at again.
        wanted = scores >= (floor if asked is None else floor[asked]) - 1 / SCALE
        if matched is not None:
            wanted &= matched
        if np.count_nonzero(wanted) > 2 * self.k * scores.shape[1]:
            kth = len(scores) - self.k
            wanted &= scores >= np.partition(np.where(wanted, scores, -np.inf), kth, axis=0)[kth] - 1 / SCALE
        chunk, question = np.nonzero(wanted)
        self.take(own, chunk, question if asked is None else asked[question], scores[chunk, question])

    def take(self, own: list[np.ndarray], chunk: np.ndarray, question: np.ndarray, score: np.ndarray) -> None:
        """Take in single cells: rows of ``own``, questions and scores."""
        if not len(chunk):
            return
        score = np.floor(score * SCALE + 0.5) / SCALE + 0.0  # as rounded() has it
        floor = self.floors(int(question.max()) + 1)
        good = np.flatnonzero(score >= floor[question])
        self._waiting.append([*[i[chunk[good]] for i in own], question[good], score[good]])
        if sum(len(w[-1]) for w in self._waiting) > (len(self._held[-1]) if self._held else 0):
            self._settle()

    def _settle(self) -> None:
        if not self._waiting:
            return
        parts = [*([self._held] if self._held else []), *self._waiting]
        new = [np.concatenate(c) for c in zip(*parts)]
        *id_columns, question, score = new
        order = np.lexsort((*reversed(id_columns), -score, question))
        if len(order):
            first = np.r_[0, np.flatnonzero(np.diff(question[order])) + 1]
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            last = order[place == self.k - 1]
            self.floor[question[last]] = score[last]
            order = order[place < self.k]
        self._held, self._waiting = [column[order] for column in new], []

    def batch(self, q_ids: pa.Array, types: list[pa.DataType]) -> pa.RecordBatch:
        *id_columns, question, score = self.rows
        columns = [q_ids.take(pa.array(question))]
        columns += [pa.array(c).cast(t) for c, t in zip(id_columns, types)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=["q_id", *self.ids, "score"])


def leader_schema(q_id: StructField, source: DataFrame, ids: tuple[str, ...]) -> StructType:
    return StructType([q_id, *[source.schema[i] for i in ids], StructField("score", DoubleType())])
