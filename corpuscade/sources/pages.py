"""The page store, fetching as a lookup in it, and the sinks of a crawl."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscade.functions import html as hx
from corpuscade.functions.urls import page_slug, with_normalized_url
from corpuscade.operators.skew import fits_broadcast, lookup_join, salted_join
from corpuscade.operators.topk import first_per_key
from corpuscade.session import materialize, spread

ABSENT = "not in page store"
NO_CONTENT = "no content stored"
# Characters that Spark escapes in the folders of a partition column.
_ESCAPED = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")
MANIFEST_SCHEMA = "url string, success boolean, path string, error string"


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").select("page_id", "url", "html")


def page_store(pages: DataFrame) -> DataFrame:
    """One stored fetch per normalised URL: ``norm_url, success, error, stored_id``.

    The first page stored under a URL counts. Whatever was stored was fetched;
    only a page stored without html is a failed fetch.
    """
    # Judged before the shuffle: html stays where it is until ``with_html`` asks for it.
    judged = with_normalized_url(pages.withColumn("success", F.col("html").isNotNull()), "url")
    return first_per_key(judged.select("norm_url", "page_id", "success"), ["norm_url"], [F.col("page_id")]).select(
        "norm_url", "success", F.when(~F.col("success"), F.lit(NO_CONTENT)).alias("error"),
        F.col("page_id").alias("stored_id"),
    )


def fetch(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Look ``requests(url, ...)`` up in the store; a URL it lacks is a failed fetch."""
    found = lookup_join(with_normalized_url(requests, "url"), store, ["norm_url"], "left")
    return (
        found.withColumn("error", F.when(F.col("success").isNull(), F.lit(ABSENT)).otherwise(F.col("error")))
        .withColumn("success", F.coalesce("success", F.lit(False)))
        .drop("norm_url")
    )


def with_html(fetched: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``html`` to ``fetched(stored_id, ...)``: of the rows that are wanted only.

    The pages are filtered where they lie when the wanted rows measure small, and
    shuffled once otherwise.
    """
    texts = pages.select(F.col("page_id").alias("stored_id"), "html")
    wanted = materialize(fetched, "wanted-pages")
    if fits_broadcast(wanted):
        return texts.join(F.broadcast(wanted), "stored_id").drop("stored_id")
    return salted_join(wanted, texts, ["stored_id"]).drop("stored_id")


def to_markdown(fetched: DataFrame) -> DataFrame:
    """Replace ``html`` by ``markdown``: the pruned text, or all of it when nothing is left."""
    return hx.with_page_markdown(fetched)


def sink_winners(fetched: DataFrame, *order: str) -> DataFrame:
    """Per slug the page written last; earlier ones are overwritten."""
    named = fetched.where("success").withColumn("slug", page_slug(F.col("url")))
    return first_per_key(named, ["slug"], [F.col(c).desc() for c in order])


def manifest(fetched: DataFrame, output_dir: str) -> DataFrame:
    """One record per attempted URL: its file when it succeeded, its error when not."""
    path = F.concat(F.lit(output_dir.rstrip("/") + "/"), page_slug(F.col("url")), F.lit(".md"))
    return fetched.select(
        "url", "success", F.when(F.col("success"), path).alias("path"), F.when(~F.col("success"), F.col("error")).alias("error")
    )


def write_pages(winners: DataFrame, output_dir: str, crawl_id: str) -> None:
    """Pages as one Parquet table, a folder per crawl: the form for crawls of any size.

    Crawls add up; one that is run again replaces its own pages.
    """
    winners.select("slug", "url", "markdown").write.mode("overwrite").parquet(f"{output_dir.rstrip('/')}/crawl={crawl_id}")


def read_written(spark: SparkSession, output_dir: str) -> DataFrame:
    """``slug, url, markdown`` of all crawls; of a page crawled again, the crawl of the last id."""
    rows = spark.read.schema("slug string, url string, markdown string, crawl string").parquet(output_dir)
    # Which crawl counts is settled on narrow rows; the texts are not shuffled for it.
    last = rows.groupBy("slug").agg(F.max("crawl").alias("crawl"))
    return lookup_join(rows, last, ["slug", "crawl"]).select("slug", "url", "markdown")


def write_markdown(winners: DataFrame, output_dir: str) -> None:
    """Pages as text, a folder per slug; for crawls small enough to be browsed as files.

    A slug's folder is replaced as a whole once all pages are written. To make a local file, Hadoop
    starts a process that sets its mode, and one more for its checksum: hundreds of thousands of
    pages would wait for that, so there the tasks write the files themselves.
    """
    rows = winners.select("slug", F.col("markdown").alias("value"))
    folder = local_folder(winners.sparkSession, output_dir)
    if folder is None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").text(output_dir)
    else:
        _write_local(rows, folder)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` on the local file system, if it lies there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(path).toUri().getPath() if files.getUri().getScheme() == "file" else None


def _write_local(rows: DataFrame, folder: str) -> None:
    """Write ``rows(slug, value)`` as Spark's text writer does: each task where no reader looks, then
    what the tasks that count have written takes the place of the slugs' folders."""
    write_id = uuid.uuid4().hex
    staged = f"{folder}/.staged-{write_id}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last = TaskContext.get(), None
        own = f"{staged}/{task.taskAttemptId()}"
        for batch in batches:
            opened = []
            for slug, value in zip(*(column.to_pylist() for column in batch.columns)):
                name = _slug_folder(slug)
                if name != last:
                    opened.append(f"{own}/{name}")
                    os.makedirs(opened[-1])
                with open(f"{own}/{name}/part-{task.partitionId():05d}-{write_id}.txt", "ab") as out:
                    out.write(f"{value or ''}\n".encode())
                last = name
            yield pa.RecordBatch.from_pydict({"at": pa.array(opened, pa.string())})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, *others in (found for batch in batches for found in batch.column("found").to_pylist()):
            for other in others:
                for file in os.listdir(other) if os.path.isdir(first) else []:
                    os.rename(f"{other}/{file}", f"{first}/{file}")
            if os.path.isdir(first):  # else it is in its place, and this task runs again
                final = f"{folder}/{os.path.basename(first)}"
                shutil.rmtree(final, ignore_errors=True)
                os.rename(first, final)
        yield from ()

    os.makedirs(staged)
    # A null slug and an empty one have one folder, so they come one after the other.
    laid = rows.sortWithinPartitions(F.coalesce("slug", F.lit("")))
    names = materialize(laid.mapInArrow(write, "at string"), "written-slugs")
    found = names.groupBy(F.substring_index("at", "/", -1)).agg(F.sort_array(F.collect_list("at")).alias("found"))
    found.select("found").mapInArrow(place, "found string").write.format("noop").mode("overwrite").save()
    shutil.rmtree(staged)


def _slug_folder(slug: str | None) -> str:
    """The folder that Spark's writers name for a value of the partition column ``slug``."""
    return "slug=" + (_ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", slug) if slug else "__HIVE_DEFAULT_PARTITION__")


def manifest_dir(output_dir: str, crawl_id: str) -> str:
    # The leading underscore hides it from directory scans of output_dir.
    return f"{output_dir.rstrip('/')}/_manifest/crawl={crawl_id}"


def write_manifest(records: DataFrame, output_dir: str, crawl_id: str = "latest") -> str:
    path = manifest_dir(output_dir, crawl_id)
    records.write.mode("overwrite").json(path)
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path)
