"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from corpuscade.llm.common import table, text_or_empty

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"


def n_words(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target of each source: (source, source_size) with ``target`` added.

    The sources, by code point and null last, take ``weights`` in turn and share the sum of
    all sizes in proportion. A target stops at ``most`` times its source's size; what is
    over goes to the others by weight, until none is above. The sources that stop are the
    first ones by size / weight, so one ordered pass over the sources finds them.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("_w", F.get(F.array(*map(F.lit, weights)), turn).cast("long"))
    every = W.partitionBy()
    by_ratio = W.orderBy(F.col("source_size") / F.col("_w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    earlier = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    ranked = weighed.select(
        "*",
        F.sum("source_size").over(every).alias("_all"),
        F.coalesce(F.sum(F.col("source_size") * most).over(earlier), F.lit(0)).alias("_stopped"),
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_gone"),
        F.sum("_w").over(every).alias("_weights"),
    )
    # The level if only the earlier sources stop; from the first that stays below it on, none stops.
    rest, free = F.col("_all") - F.col("_stopped"), F.col("_weights") - F.col("_gone")
    fits = F.col("source_size") * most * free >= rest * F.col("_w")
    found = ranked.withColumn("_level", F.first(F.when(fits, rest / free), ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    own = (F.col("source_size") * most).cast("double")
    return found.select("source", "source_size", F.least(own, F.coalesce(F.col("_level") * F.col("_w"), own)).alias("target"))


def share(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on ``key`` and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 48)


def repetitions(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Add ``size`` (words), ``source_size``, ``target`` and ``copies`` to documents.

    A document of a source with repetition rate r is taken floor(r) times, and once more
    with probability r - floor(r), decided by a hash of its doc_id. A null source is a
    source of its own; null and empty texts have size 0; a source without words has rate 0.
    Columns of those four names are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies").withColumn("size", n_words())
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = targets(sizes, weights, most).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    whole = F.floor(rate)
    extra = (share(F.col("doc_id"), seed) < rate - whole).cast("long")
    # The side of the sources is aggregated first; adaptive execution broadcasts it by its real size.
    joined = docs.join(rates, docs["source"].eqNullSafe(rates["_source"])).drop("_source")
    return joined.withColumn("copies", (whole + extra).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: the columns of ``docs``, each row as often as it is taken."""
    taken = repetitions(docs, **options).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return repetitions(docs).select("doc_id", "size", "source_size", "target", taken)


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
            WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sources),
ranked AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS every, CAST(sum(w) OVER () AS BIGINT) AS weights,
    CAST(coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT) AS stopped,
    CAST(coalesce(sum(w) OVER before, 0) AS BIGINT) AS gone
  FROM weighed
  WINDOW before AS (ORDER BY source_size / w, source IS NULL, encode(source)
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT max((every - stopped) / (weights - gone)) AS level FROM ranked
  WHERE 3 * source_size * (weights - gone) >= (every - stopped) * w),
rates AS (
  SELECT source, source_size,
         least(CAST(3 * source_size AS DOUBLE), coalesce(level * w, CAST(3 * source_size AS DOUBLE))) AS target
  FROM ranked CROSS JOIN level),
joined AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT)
           / 281474976710656.0 AS place
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN place < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM joined
"""
