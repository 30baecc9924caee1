"""Documents: from a directory of files, or from a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscade.session import spread


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path`` as ``(path, text)``; Spark skips names opening with . or _."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as ``(doc_id, path, text, lang, source)``."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(table, "doc_id").select(
        "doc_id",
        F.concat_ws("/", F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
        "text",
        "lang",
        "source",
    )
