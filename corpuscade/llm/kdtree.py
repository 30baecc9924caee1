"""K-d tree sharding: equal bytes per shard, rows with like metadata together.

A node is cut at the weighted median of its widest dimension until every leaf holds
the target bytes. Rows are never moved to find the cuts: a cut is found by narrowing
down, with one grouped sum for each fifteen bits of the cut key, and only the cuts
(fewer than leaves) reach the driver.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpuscade.llm.common import table
from corpuscade.session import materialize

COORDINATE_BITS = 20
TIE_BITS = 40
STEP_BITS = 15
#: A cut is fine enough when its last bucket holds this share of a leaf.
FINE = 1e-4


def _coordinate(df: DataFrame, name: str, low, high) -> Column:
    """Place of a value in [0, 2^20): numbers in order, strings by hash; null is 0."""
    top = (1 << COORDINATE_BITS) - 1
    if isinstance(df.schema[name].dataType, T.NumericType):
        if low is None or high is None or not high > low:
            return F.lit(0).cast("long")
        place = (F.col(name).cast("double") - low) / (high - low) * top
        return F.coalesce(F.floor(F.nanvl(place, F.lit(0.0))).cast("long"), F.lit(0).cast("long"))
    hashed = F.shiftrightunsigned(F.xxhash64(name), 64 - COORDINATE_BITS)
    return F.when(F.col(name).isNull(), F.lit(0).cast("long")).otherwise(hashed)


def _placed(df: DataFrame, dims: list[str], tie: Column) -> DataFrame:
    numeric = [d for d in dims if isinstance(df.schema[d].dataType, T.NumericType)]
    ranges = {}
    if numeric:
        sides = [f(F.col(d).cast("double")).alias(f"{s}{i}") for i, d in enumerate(numeric) for s, f in (("l", F.min), ("h", F.max))]
        found = df.agg(*sides).first()
        ranges = {d: (found[f"l{i}"], found[f"h{i}"]) for i, d in enumerate(numeric)}
    places = F.array(*[_coordinate(df, d, *ranges.get(d, (None, None))) for d in dims])
    return df.withColumns({"_at": places, "_tie": F.shiftrightunsigned(tie, 64 - TIE_BITS)})


def _key(dim: Column) -> Column:
    """The cut key of a row: its place along ``dim``, then a hash, so that ties can be cut."""
    return F.shiftleft(F.get("_at", dim), TIE_BITS) + F.col("_tie")


def _nodes(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A broadcast table of at most one row for each leaf, from one literal."""
    names = [field.split()[0] for field in schema.split(", ")]
    packed = F.lit(json.dumps([dict(zip(names, row)) for row in rows]))
    entries = F.from_json(packed, f"array<struct<{schema.replace(' ', ': ').replace(',: ', ', ')}>>")
    return F.broadcast(spark.range(1).select(F.inline(entries)))


def _descend(df: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Move rows of the nodes in ``cuts`` (node, dim, first key on the right) one level down."""
    if not cuts:
        return df
    side = _nodes(df.sparkSession, cuts, "_node long, _dim int, _cut long")
    right = (_key(F.col("_dim")) >= F.col("_cut")).cast("long")
    child = F.when(F.col("_cut").isNull(), F.col("_node") * 2).otherwise(F.col("_node") * 2 + right)
    return df.join(side, "_node", "left").withColumn("_node", child).drop("_dim", "_cut")


def _widest(rows: DataFrame, weight: str, n_dims: int) -> dict[int, tuple[int, float]]:
    """Node to its widest dimension and its weight."""
    spans = [(F.max(F.get("_at", F.lit(d))) - F.min(F.get("_at", F.lit(d)))).alias(f"w{d}") for d in range(n_dims)]
    found = rows.groupBy("_node").agg(F.sum(weight).alias("total"), *spans).collect()
    return {r["_node"]: (max(range(n_dims), key=lambda d: (r[f"w{d}"], -d)), r["total"]) for r in found}


def _cuts(rows: DataFrame, weight: str, wanted: dict[int, tuple[int, float]], fine: float) -> list[tuple]:
    """For each node (dim, weight to the left): the key at which its rows are cut."""
    spark, shift = rows.sparkSession, COORDINATE_BITS + TIE_BITS
    prefix = {node: 0 for node in wanted}
    left = {node: 0.0 for node in wanted}
    cut: dict[int, int] = {}
    while len(cut) < len(wanted):
        width = min(STEP_BITS, shift)
        shift -= width
        open_ = [(n, wanted[n][0], prefix[n], float(wanted[n][1] - left[n])) for n in wanted if n not in cut]
        side = _nodes(spark, open_, "_node long, _dim int, _prefix long, _need double")
        key = _key(F.col("_dim"))
        sums = (
            rows.join(side, "_node")
            .where(F.shiftright(key, shift + width) == F.col("_prefix"))
            .groupBy("_node", "_need", F.shiftright(key, shift).alias("_bucket"))
            .agg(F.sum(weight).alias("_w"))
        )
        # At most 32,768 buckets a node; the running sum up to the bucket that crosses.
        upto = "sum(_w) over (partition by _node order by _bucket)"
        crossing = (
            sums.withColumn("_sum", F.expr(upto))
            .where("_sum >= _need and _sum - _w < _need")
            .select("_node", "_bucket", "_w", "_sum", "_need")
        )
        for r in crossing.collect():
            node = r["_node"]
            prefix[node], before = r["_bucket"], r["_sum"] - r["_w"]
            if r["_w"] <= fine or shift == 0:
                nearer_after = r["_sum"] - r["_need"] <= r["_need"] - before
                cut[node] = (r["_bucket"] + int(nearer_after)) << shift
            left[node] += before
    return [(n, wanted[n][0], cut[n]) for n in wanted]


def kd_shards(df: DataFrame, weight: str, dims: list[str], leaves: int, tie: Column) -> DataFrame:
    """Add ``shard``: the leaf (0 to ``leaves`` - 1, left to right) of each row.

    ``df`` is read once for each fifteen bits of each level's cuts, so hand in a narrow,
    materialised table. ``tie`` is a hash that tells rows apart where all dimensions agree;
    only rows that agree in it, too, always go together. Null metadata counts as the
    lowest value. An empty table gives an empty table; with fewer rows than leaves some
    shards stay empty. Weights are positive numbers.
    """
    rows = _placed(df, dims, tie).withColumn("_node", F.lit(1).cast("long"))
    share, levels = {1: leaves}, []  # leaves below each node
    while any(n > 1 for n in share.values()):
        found = _widest(rows, weight, len(dims))
        fine = FINE * sum(total for _, total in found.values()) / leaves if found else 1
        wanted, nxt = {}, {}
        for node, n in share.items():
            nxt[node * 2] = n - n // 2 if n > 1 else n
            if n > 1:
                nxt[node * 2 + 1] = n // 2
                if node in found:
                    dim, total = found[node]
                    wanted[node] = (dim, total * nxt[node * 2] / n)
        cuts = _cuts(rows, weight, wanted, fine)
        whole = [(node, None, None) for node, n in share.items() if n == 1]
        levels.append((cuts, whole))
        rows, share = _descend(rows, cuts + whole), nxt
    leaf = {node: i for i, node in enumerate(sorted(share))}
    names = _nodes(df.sparkSession, list(leaf.items()), "_node long, shard int")
    return rows.join(names, "_node", "left").drop("_node", "_at", "_tie")


def slots(df: DataFrame, order: list[str], per_task: int = 20_000, parts: int = 64) -> DataFrame:
    """Add ``slot``: numbers from 0 without gaps within each shard.

    Rows are numbered in ``parts`` hashed parts of each shard (more where a shard holds
    over ``per_task`` rows a part) and the parts are put one after the other, so no task
    holds a whole shard.
    """
    most = df.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    parts = max(parts, math.ceil(most / per_task))
    rows = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_part", F.expr("sum(_n) over (partition by shard order by _part) - _n").alias("_before"))
    ordered = ", ".join(f"`{c}`" for c in order)
    own = F.expr(f"row_number() over (partition by shard, _part order by {ordered}) - 1")
    return (
        rows.withColumn("_own", own)
        .join(before, ["shard", "_part"])
        .withColumn("slot", F.col("_before") + F.col("_own"))
        .drop("_part", "_own", "_before")
    )


def shard_documents(docs: DataFrame, leaves: int | None = None, target_bytes: int = 1 << 30) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, shard, slot.

    Size is the UTF-8 bytes of the text (null: none) plus 1; without ``leaves`` there are
    as many shards as ``target_bytes`` asks for. Dimensions are source, lang, the logarithm
    of the size, and doc_id. Other columns are not looked at.
    """
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    narrow = materialize(
        docs.select("doc_id", "source", "lang", data.alias("_b")).select(
            "doc_id", "source", "lang",
            (F.octet_length("_b") + 1).cast("long").alias("size"),
            F.crc32("_b").alias("text_crc32"),
        ).withColumn("log_size", F.log2("size")),
        "kd-rows",
    )
    if leaves is None:
        leaves = max(1, math.ceil((narrow.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    tie = F.xxhash64("doc_id", "text_crc32", "size")
    sharded = kd_shards(narrow, "size", ["source", "lang", "log_size", "doc_id"], leaves, tie)
    sharded = materialize(sharded.select("doc_id", "size", "text_crc32", "shard"), "kd-shards")
    return slots(sharded, ["doc_id", "text_crc32", "size"])


def op3_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), leaves=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
