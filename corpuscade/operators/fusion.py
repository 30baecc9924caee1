"""Fusing ranked pools, reranking, contexts, the retrieval gate and its reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpuscade.functions import text as tx
from corpuscade.operators.skew import fits_broadcast, lookup_join, salted_join
from corpuscade.operators.topk import CHUNK_ID, top_k
from corpuscade.session import materialize

# Candidate pool, passages handed on, and the rank constant.
POOL_SIZE = 10
FINAL_SIZE = 3
RRF_K = 60

CONTEXT_SEPARATOR = "\n\n"
USE_KNOWLEDGE_BASE = "knowledge_base"
ANSWER_DIRECTLY = "direct"


def reciprocal_rank_fusion(pools: list[DataFrame], k: int = POOL_SIZE, constant: int = RRF_K) -> DataFrame:
    """Fuse pools ranked from 1; a chunk at place r of a pool adds 1/(constant + r - 1)."""
    parts = [
        p.select("q_id", *CHUNK_ID, (F.lit(1.0) / (F.col("rank") + (constant - 1))).alias("part"))
        for p in pools
    ]
    merged = reduce(DataFrame.unionByName, parts)
    fused = merged.groupBy("q_id", *CHUNK_ID).agg(F.round(F.sum("part"), 6).alias("score"))
    return top_k(fused, k)


def overlap_score(question: Column, passage: Column) -> Column:
    """Share of the question's terms found in the passage plus share of its bigrams."""

    return tx.once(tx.terms(question), lambda q: tx.once(tx.terms(passage), lambda p: (
        tx.share(q, p) + tx.share(tx.bigrams(q), tx.bigrams(p))
    )))


def with_texts(candidates: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``q_id, doc_id, chunk_no, passage, question`` of candidates."""
    asked = questions.select("q_id", F.col("text").alias("question"))
    # Questions join the ids, so that of the two texts only the question's, which is short, is
    # shuffled more than once: a passage meets its question where it is scored.
    ids = materialize(lookup_join(candidates.select("q_id", *CHUNK_ID), asked, ["q_id"]), "candidates")
    texts = chunks.select(*CHUNK_ID, F.col("text").alias("passage"))
    if fits_broadcast(ids):
        return texts.join(F.broadcast(ids), list(CHUNK_ID))
    return salted_join(ids, texts, list(CHUNK_ID))


def rerank(
    candidates: DataFrame,
    questions: DataFrame,
    chunks: DataFrame,
    k: int = FINAL_SIZE,
    scorer=overlap_score,
) -> DataFrame:
    """Best ``k`` candidates per question by a joint (question, passage) score.

    ``scorer`` maps the two text Columns to a double Column; a cross-encoder goes
    in as an iterator pandas UDF. Candidates are written down first, with their question: they
    are broadcast to the chunks only if they measure small.
    """
    full = with_texts(candidates, questions, chunks)
    scored = full.select(
        "q_id", *CHUNK_ID, "passage", F.round(scorer(F.col("question"), F.col("passage")), 6).alias("score")
    )
    return top_k(scored, k)


def contexts(reranked: DataFrame, questions: DataFrame) -> DataFrame:
    """One context per question: its few passages in rank order, and the prompt around it."""
    joined = reranked.groupBy("q_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "passage"))), lambda x: x["passage"]
            ),
            CONTEXT_SEPARATOR,
        ).alias("context"),
        F.count("*").alias("n_passages"),
    )
    return (
        questions.select("q_id", "text")
        .join(joined, "q_id", "left")
        .select(
            "q_id",
            F.coalesce("n_passages", F.lit(0)).alias("n_passages"),
            F.coalesce("context", F.lit("")).alias("context"),
            F.format_string(
                "Context:\n%s\n\nQuestion: %s", F.coalesce("context", F.lit("")), F.col("text")
            ).alias("prompt"),
        )
    )


def best_scores(reranked: DataFrame, questions: DataFrame) -> DataFrame:
    """Best rerank score per question; 0 where nothing was found."""
    best = reranked.groupBy("q_id").agg(F.max("score").alias("best"))
    return questions.join(best, "q_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def retrieval_gate(scored: DataFrame, threshold: float) -> DataFrame:
    """Decide per question whether the knowledge base is worth consulting."""
    return scored.withColumn(
        "decision",
        F.when(F.col("best") >= threshold, F.lit(USE_KNOWLEDGE_BASE)).otherwise(F.lit(ANSWER_DIRECTLY)),
    )


def invocation_rates(scored: DataFrame, thresholds: list[float], by: str) -> DataFrame:
    """How often each threshold consults the knowledge base, per ``by`` and in total."""
    called = scored.select(
        by, "best", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("theta")
    ).withColumn("called", (F.col("best") >= F.col("theta")).cast("int"))
    return (
        called.rollup("theta", by)
        .agg(F.count("*").alias("n_questions"), F.sum("called").alias("n_called"), F.round(F.avg("called"), 6).alias("rate"))
        .where(F.col("theta").isNotNull())
    )


def rank_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Where each chunk stood in two rankings; positive shift = moved up."""
    keys = ["q_id", *CHUNK_ID]
    a = before.select(*keys, F.col("rank").alias("rank_before"))
    b = after.select(*keys, F.col("rank").alias("rank_after"))
    return a.join(b, keys, "full").withColumn("shift", F.col("rank_before") - F.col("rank_after"))
