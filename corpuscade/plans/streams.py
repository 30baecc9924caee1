"""The streaming queries, over the same tables read as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscade.functions import html as hx
from corpuscade.plans.retrieval import default_index, plain, reranked
from corpuscade.session import fresh_dir, materialize
from corpuscade.functions.urls import with_normalized_url
from corpuscade.sources.pages import to_markdown
from corpuscade.streaming.pages import first_rows, first_sights
from corpuscade.streaming.questions import answer_stream
from corpuscade.streaming.runner import drain_to_parquet, stream_session


def stream_page_dedup(spark, sf_dir):
    """Every URL the pages link to, once, however often it is linked."""
    session = stream_session(spark)
    pages = session.readStream.schema("page_id long, url string, html string").parquet(f"{sf_dir}/pages.parquet*")
    links = pages.select("url", F.explode(hx.hrefs(F.col("html"))).alias("href"))
    out = fresh_dir(spark, "first-sights")
    drain_to_parquet(first_sights(links, "href", base="url"), out, fresh_dir(spark, "first-sights-progress"))
    return spark.read.schema("norm_url string").parquet(out)


def stream_pages(spark, sf_dir):
    """Pages arrive as a stream; each URL's first one comes through whole, and is read as Markdown."""
    session = stream_session(spark)
    pages = session.readStream.schema("page_id long, url string, html string").parquet(f"{sf_dir}/pages.parquet*")
    firsts = first_rows(with_normalized_url(pages, "url"), "norm_url", ["page_id"])
    out = fresh_dir(spark, "first-pages")
    drain_to_parquet(firsts, out, fresh_dir(spark, "first-pages-progress"))
    return to_markdown(spark.read.schema("norm_url string, page_id long, url string, html string").parquet(out))


def stream_questions(spark, sf_dir):
    """Benchmark texts arrive as a stream and get their three passages."""
    session = stream_session(spark)
    index = default_index(session, sf_dir)
    questions = session.readStream.schema("item_id long, text string").parquet(f"{sf_dir}/benchmark.parquet*")

    def answer(batch):
        # The batch is read several times; its source must not be.
        return reranked(index, materialize(batch, "question-batch")).drop("passage")

    out = fresh_dir(spark, "stream-answers")
    answer_stream(questions.select(F.col("item_id").alias("q_id"), "text"), answer, out, fresh_dir(spark, "questions-progress"))
    schema = "q_id long, doc_id long, chunk_no int, score double, rank int, batch int"
    return plain(spark.read.schema(schema).parquet(out).drop("batch"))


QUERIES = {f.__name__: f for f in (stream_page_dedup, stream_pages, stream_questions)}
