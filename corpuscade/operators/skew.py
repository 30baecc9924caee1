"""Joins that look at sizes first: broadcast when proven small, else salted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, NumericType, StringType, StructType

from corpuscade.session import materialize

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20
# A key with more rows than this is hot and is cut into pieces of about as many.
# There are at most (all rows / TASK_ROWS) hot keys.
TASK_ROWS = 1_000_000


def fits_broadcast(
    df: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> bool:
    """Measure ``df``: one map-side combined count of rows and bytes."""
    width = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, NumericType):
            size = 8 * F.size(field.name)
        elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
            size = F.octet_length(F.to_json(F.struct(field.name)))
        elif isinstance(field.dataType, (StringType, BinaryType)):
            size = F.octet_length(field.name)
        else:
            size = F.lit(16)
        width = width + F.coalesce(size, F.lit(0))
    size = df.agg(F.count("*").alias("rows"), F.sum(width.cast("long")).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def hot_keys(facts: DataFrame, on: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """``on, _salts``: keys of more than ``task_rows`` rows, and how many tasks they are cut over."""
    counts = facts.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > task_rows)
    return counts.select(*on, F.ceil(F.col("_n") / task_rows).cast("int").alias("_salts"))


def salted_join(
    facts: DataFrame, dim: DataFrame, on: list[str], how: str = "inner", task_rows: int = TASK_ROWS
) -> DataFrame:
    """Shuffle join that spreads each hot key of ``facts`` over as many tasks as its rows need.

    Rows of ``dim`` are repeated for hot keys only. The salt is a hash of the
    fact row, so a re-run task routes rows as before. The list of hot keys is
    written down, and broadcast if it measures small; without any, this is a plain join.
    """
    hot = materialize(hot_keys(facts, on, task_rows), "hot-keys")
    if hot.isEmpty():
        return facts.join(dim, on, how)
    hot = F.broadcast(hot) if fits_broadcast(hot) else hot
    row_salt = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]), F.col("_salts")).cast("int")
    left = (
        facts.join(hot, on, "left")
        .withColumn("_salt", F.coalesce(row_salt, F.lit(0)))
        .drop("_salts")
    )
    right = (
        dim.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """Join ``facts`` to a smaller side: broadcast if it measures small, else salted.

    ``small`` hands in an earlier measurement, of ``dim`` or of a table holding it.
    """
    if fits_broadcast(dim, max_rows=max_rows) if small is None else small:
        return facts.join(F.broadcast(dim), on, how)
    return salted_join(facts, dim, on, how)
