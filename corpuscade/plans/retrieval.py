"""Retrieval over the test tables: documents are the corpus, benchmark and
conversation texts are the questions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscade.functions import text as tx
from corpuscade.operators import chunking, fusion, lexical, models, vectors
from corpuscade.operators.embedding import embed_chunks
from corpuscade.operators.ordering import numbered
from corpuscade.operators.topk import CHUNK_ID
from corpuscade.session import app_dir, fresh_dir, materialize, plain
from corpuscade.plans import crawling
from corpuscade.sources import directory, index_store, pages
from corpuscade.sources.documents import read_documents

SMALL_CHUNK = 128
GATE_THRESHOLD = 1.0
RATE_THRESHOLDS = [0.5, 0.75, 1.0, 1.25, 1.5]


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("q_id"), "text"
    )


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(F.col("role") == "user")
    return table.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("q_id"),
        "text",
        "turn",
    )


def all_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = benchmark_questions(spark, sf_dir).withColumn(
        "q_id", F.concat(F.lit("b"), F.col("q_id").cast("string"))
    )
    return bench.unionByName(user_turns(spark, sf_dir).drop("turn"))


def default_index(spark: SparkSession, sf_dir: str) -> index_store.Index:
    """The index over ``documents``, built at first use in an application, then loaded."""
    base = app_dir(spark, "index-" + hashlib.md5(sf_dir.encode()).hexdigest())
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return index_store.create_or_load(docs, base, "default")


def vector_pool(index: index_store.Index, questions: DataFrame, k: int = fusion.POOL_SIZE) -> DataFrame:
    return vectors.exact_top_k(index.chunks, embed_chunks(questions.select("q_id", "text")), k)


def lexical_pool(index: index_store.Index, questions: DataFrame, k: int = fusion.POOL_SIZE) -> DataFrame:
    return lexical.bm25_top_k(index, questions.select("q_id", "text"), k)


def hybrid_pool(index: index_store.Index, questions: DataFrame) -> DataFrame:
    return fusion.reciprocal_rank_fusion([vector_pool(index, questions), lexical_pool(index, questions)])


def reranked(index: index_store.Index, questions: DataFrame) -> DataFrame:
    """The whole retrieval path: two pools, fusion, rerank; with passages."""
    return fusion.rerank(hybrid_pool(index, questions), questions, index.chunks)


def retrieve(index: index_store.Index, questions: DataFrame) -> DataFrame:
    """Three passages for each question, in the way the index's kind asks for."""
    if index.kind == "list":
        return lexical.list_top_k(index, questions, fusion.FINAL_SIZE)
    return reranked(index, questions).drop("passage")


def crawl_answers(spark, sf_dir):
    """From stored pages to passages: crawl, clean, write, index, retrieve."""
    written = crawling.crawled_pages(spark, sf_dir).select("slug", F.col("markdown").alias("text"))
    docs = numbered(written, ["slug"], out="doc_id").select("doc_id", "text")
    index = index_store.create_or_load(docs, fresh_dir(spark, "crawl-index"), "crawl")
    return plain(retrieve(index, benchmark_questions(spark, sf_dir)))


def directory_index(spark, sf_dir):
    """What an index holds that follows the folder of two crawls, brought up to date after each."""
    out, base, progress = (fresh_dir(spark, f"directory-{n}") for n in ("pages", "index", "progress"))
    for winners in crawling.crawl_halves(spark, sf_dir):
        pages.write_markdown(winners, out)
        directory.index_directory(spark, out, base, "crawl", progress)
    slug = F.regexp_extract("path", "/slug=([^/]*)/", 1).alias("slug")
    chunks = directory.indexed_files(spark, base, "crawl")
    return plain(chunks.select(slug, "chunk_no", "n_tokens", F.sha2("text", 256).alias("text_sha")))


def sentence_split(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    rows = docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "s"))
    return plain(
        rows.select("doc_id", "pos", tx.strip_space(F.col("s")).alias("sentence")).where("sentence <> ''")
    )


def chunk_pack(spark, sf_dir):
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return plain(chunking.chunk_documents(docs, SMALL_CHUNK))


def chunk_overlap(spark, sf_dir):
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return plain(chunking.chunk_documents(docs, chunking.CHUNK_SIZE, chunking.CHUNK_OVERLAP))


def chunk_stats(spark, sf_dir):
    docs = read_documents(spark, sf_dir).select("source", "doc_id", "text")
    return chunking.chunk_stats(chunking.chunk_documents(docs), "source")


def chunk_embed(spark, sf_dir):
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    chunks = embed_chunks(chunking.chunk_documents(docs))
    cells = chunks.select(*CHUNK_ID, F.posexplode("embedding").alias("dim", "v")).where("v <> 0")
    return plain(cells.select(*CHUNK_ID, "dim", F.round(F.col("v").cast("double"), 6).alias("value")))


def document_scan(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    return docs.select(
        "doc_id", "path", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha")
    )


def index_roundtrip(spark, sf_dir):
    """Build part of the corpus from outdated texts, correct and complete it, remove some again."""
    base = fresh_dir(spark, "index-roundtrip")
    docs = read_documents(spark, sf_dir).select(F.col("source").alias("namespace"), "doc_id", "text", "lang")
    old = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Outdated. "), F.col("text"))).otherwise(F.col("text"))
    index_store.create_index(docs.where("lang = 'en'").withColumn("text", old), base)
    index_store.refresh_index(docs, base, kind="list")
    index_store.refresh_index(docs.limit(0), base, removed=docs.where("doc_id % 11 = 0"))
    df = index_store.live(spark, base, "terms").select("namespace", "term", "df")
    postings = index_store.live(spark, base, "postings", beside=df)
    seen = postings.groupBy("namespace", *CHUNK_ID).agg(
        F.count("*").alias("n_distinct"), F.sum("df").alias("sum_df")
    )
    chunks = index_store.live(spark, base, "chunks").join(seen, ["namespace", *CHUNK_ID], "left")
    kind = index_store.current(spark, base).select("namespace", "kind")
    return plain(
        chunks.join(kind, "namespace").select(
            "namespace", *CHUNK_ID, "n_tokens", "n_terms", F.sha2("text", 256).alias("text_sha"), "kind",
            F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.coalesce("sum_df", F.lit(0)).alias("sum_df"),
        )
    )


def index_registry(spark, sf_dir):
    base = fresh_dir(spark, "index-registry")
    docs = read_documents(spark, sf_dir)
    index_store.create_index(
        docs.select(F.col("source").alias("namespace"), "doc_id", "text"), base, kind="list"
    )
    asked = docs.select(F.col("source").alias("namespace")).union(docs.select("lang")).distinct()
    return index_store.registry(spark, base, asked)


def vector_topk(spark, sf_dir):
    return plain(vector_pool(default_index(spark, sf_dir), benchmark_questions(spark, sf_dir)))


def bm25_topk(spark, sf_dir):
    return plain(lexical_pool(default_index(spark, sf_dir), benchmark_questions(spark, sf_dir)))


def hybrid_rrf(spark, sf_dir):
    return plain(hybrid_pool(default_index(spark, sf_dir), benchmark_questions(spark, sf_dir)))


def list_retrieve(spark, sf_dir):
    index = default_index(spark, sf_dir)
    return plain(lexical.list_top_k(index, benchmark_questions(spark, sf_dir), fusion.FINAL_SIZE))


def list_answers(spark, sf_dir):
    """An index of kind ``list`` over the documents, and what it answers."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    index = index_store.create_or_load(docs, fresh_dir(spark, "list-index"), "listed", kind="list")
    return plain(retrieve(index, benchmark_questions(spark, sf_dir)))


def rerank_top3(spark, sf_dir):
    best = reranked(default_index(spark, sf_dir), benchmark_questions(spark, sf_dir))
    return plain(best.drop("passage"))


def learned_rerank(spark, sf_dir):
    """Passages by a scorer learned from the pools: does a passage hold the whole question?"""
    index, questions = default_index(spark, sf_dir), benchmark_questions(spark, sf_dir)
    pool = materialize(hybrid_pool(index, questions), "pool")
    texts = fusion.with_texts(pool, questions, index.chunks)
    holds = F.contains("passage", F.col("question")).cast("int").alias("y")
    examples = texts.select(models.signals(F.col("question"), F.col("passage")).alias("x"), holds)
    scorer = models.learned_scorer(models.learn_weights(examples))
    return plain(fusion.rerank(pool, questions, index.chunks, scorer=scorer).drop("passage"))


def rag_context(spark, sf_dir):
    questions = benchmark_questions(spark, sf_dir)
    return plain(fusion.contexts(reranked(default_index(spark, sf_dir), questions), questions))


def retrieval_gate(spark, sf_dir):
    questions = all_questions(spark, sf_dir)
    best = fusion.best_scores(reranked(default_index(spark, sf_dir), questions), questions)
    return fusion.retrieval_gate(best, GATE_THRESHOLD).select("q_id", "best", "decision")


def invocation_rate(spark, sf_dir):
    questions = user_turns(spark, sf_dir)
    best = fusion.best_scores(reranked(default_index(spark, sf_dir), questions), questions)
    return fusion.invocation_rates(best, RATE_THRESHOLDS, "turn")


def rank_shift(spark, sf_dir):
    index, questions = default_index(spark, sf_dir), benchmark_questions(spark, sf_dir)
    vector = materialize(vector_pool(index, questions), "vector-pool")
    hybrid = fusion.reciprocal_rank_fusion([vector, lexical_pool(index, questions)])
    return plain(fusion.rank_shift(vector, hybrid))


def vector_neighbours(spark, sf_dir):
    """Exact nearest vectors of the question rows of ``embeddings``, themselves included."""
    table = _unit_embeddings(spark, sf_dir)
    questions = _vector_questions(table)
    return plain(vectors.exact_top_k(table, questions, fusion.POOL_SIZE, ids=("vec_id",)))


def ann_topk(spark, sf_dir):
    """Approximate neighbours of the question rows of ``embeddings``."""
    table = _unit_embeddings(spark, sf_dir)
    questions = _vector_questions(table)
    return plain(vectors.approximate_top_k(table, questions, fusion.POOL_SIZE, ids=("vec_id",)))


def ivf_topk(spark, sf_dir):
    """Neighbours of the question rows of ``embeddings`` by inverted lists."""
    table = _unit_embeddings(spark, sf_dir)
    return plain(vectors.list_top_k(table, _vector_questions(table), fusion.POOL_SIZE, ids=("vec_id",)))


def ivf_recall(spark, sf_dir):
    """For each question how many of its exact neighbours the inverted lists find."""
    key = ["q_id", "vec_id"]
    exact, found = (f(spark, sf_dir).select(*key) for f in (vector_neighbours, ivf_topk))
    met = exact.join(found.withColumn("hit", F.lit(1)), key, "left")
    return met.groupBy("q_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))


def _vector_questions(table: DataFrame) -> DataFrame:
    """The stated question set of a search: rows whose id is divisible by 100."""
    return table.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "embedding")


def _unit_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    norm = F.sqrt(
        F.aggregate(F.transform("embedding", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    )
    return table.withColumn("_n", norm).select(
        "vec_id", F.transform("embedding", lambda v: (v.cast("double") / F.col("_n")).cast("float")).alias("embedding")
    )


QUERIES = {
    f.__name__: f
    for f in (
        document_scan, crawl_answers, directory_index, sentence_split, chunk_pack, chunk_overlap, chunk_stats, chunk_embed,
        index_roundtrip, index_registry, vector_topk, vector_neighbours, bm25_topk, hybrid_rrf,
        list_retrieve, list_answers, rerank_top3, learned_rerank, rag_context, retrieval_gate, invocation_rate, rank_shift, ann_topk,
        ivf_topk, ivf_recall,
    )
}
