"""Nearest neighbours by inner product: a navigable small-world graph for each shard.

Vectors are dealt to shards by hash. A shard's graph is a set of flat neighbour arrays, one
for each layer, over vectors in a random order: layer l links the first n / 16^l of them.
Queries descend from the smallest layer to the whole shard; the shards' results are merged.
Equal vectors are one node. All steps take many vectors at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corpuscade.llm.common import table
from corpuscade.session import materialize

#: Vectors in a shard at most (about), shards at least, and queries searched together.
SHARD_ROWS, LEAST_SHARDS, QUERY_BLOCK = 50_000, 6, 2_048
LINKS, SHRINK, WIDTH_BUILD, WIDTH_SEARCH = 32, 16, 64, 128
BATCH, AT_ONCE = 256, 4
#: The first nodes of a layer choose among all before them, in one matrix product; later ones search.
EXACT_ROWS = 512
#: The longest vectors of a shard, where every search starts, too.
LONGEST = 32
K = 20


def raised(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component, so that all have the norm of the longest.

    Inner products with queries (whose added component is 0) stay; between
    vectors, the nearest by angle is then the largest inner product.
    """
    squares = np.einsum("nd,nd->n", vectors, vectors, dtype=np.float64)
    added = np.sqrt(np.maximum(squares.max() - squares, 0))
    return np.concatenate([vectors, added[:, None]], 1).astype(np.float32)


def beam(
    vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries side by side: (ids, scores), best first, -1 for none.

    ``entry``: starting nodes of each query (-1: none). Each step opens the best nodes
    of every query that are not open yet; a query ends when all its best ``width`` are.
    """
    b, rows = len(queries), np.arange(len(queries))
    seen = np.zeros((b, len(links) + 1), bool)  # the last column takes the -1s
    seen[:, -1] = True
    ids = np.full((b, width), -1, np.int32)
    scores = np.full((b, width), -np.inf, np.float32)
    opened = np.ones((b, width), bool)

    def scored(found: np.ndarray, who: np.ndarray) -> np.ndarray:
        out = np.full(found.shape, -np.inf, np.float32)
        r, c = np.nonzero(found >= 0)
        out[r, c] = np.einsum("kd,kd->k", vectors[found[r, c]], queries[who[r]])
        return out

    def fresh(found: np.ndarray, who: np.ndarray) -> np.ndarray:
        new = np.where(seen[who[:, None], found], -1, found)
        seen[who[:, None], found] = True
        return new

    start = np.stack([fresh(entry[:, k : k + 1], rows)[:, 0] for k in range(entry.shape[1])], 1)
    fill = min(start.shape[1], width)
    ids[:, :fill], scores[:, :fill] = start[:, :fill], scored(start, rows)[:, :fill]
    opened[:, :fill] = start[:, :fill] < 0
    active = rows
    while len(active):
        closed = np.where(opened[active], -np.inf, scores[active])
        best = np.argpartition(-closed, min(AT_ONCE, width) - 1, 1)[:, :AT_ONCE]
        value = np.take_along_axis(closed, best, 1)
        going = np.isfinite(value).any(1)
        active, best, value = active[going], best[going], value[going]
        if not len(active):
            break
        nodes = np.where(np.isfinite(value), ids[active[:, None], best], -1)
        opened[active[:, None], best] = True
        found = np.concatenate(
            [fresh(np.where(nodes[:, k : k + 1] >= 0, links[nodes[:, k]], -1), active) for k in range(nodes.shape[1])], 1
        )
        all_ids = np.concatenate([ids[active], found], 1)
        all_scores = np.concatenate([scores[active], scored(found, active)], 1)
        all_opened = np.concatenate([opened[active], found < 0], 1)
        top = np.argpartition(-all_scores, width - 1, 1)[:, :width]
        ids[active] = np.take_along_axis(all_ids, top, 1)
        scores[active] = np.take_along_axis(all_scores, top, 1)
        opened[active] = np.take_along_axis(all_opened, top, 1)
    order = np.argsort(-scores, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def choose(vectors: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` links out of candidates (best first, -1 for none) of many nodes.

    A candidate is taken if it is nearer to the node than to any taken one; places left
    over go to the best of the rest.
    """
    b, c = ids.shape
    near = vectors[np.maximum(ids, 0)]
    between = near @ near.transpose(0, 2, 1)
    taken, valid = np.zeros((b, c), bool), ids >= 0
    for k in range(c):
        hidden = ((between[:, k] > scores[:, k, None]) & taken).any(1)
        taken[:, k] = valid[:, k] & ~hidden & (taken.sum(1) < most)
    order = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), 1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < most:
        out = np.concatenate([out, np.full((b, most - out.shape[1]), -1, ids.dtype)], 1)
    return out


def _exact(vectors: np.ndarray, rows: np.ndarray, among: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The best of the first ``among`` vectors for each of ``rows``, itself left out."""
    scores = vectors[rows] @ vectors[:among].T
    scores[rows[:, None] == np.arange(among)] = -np.inf
    if among > width:
        order = np.argpartition(-scores, width - 1, 1)[:, :width]
        scores = np.take_along_axis(scores, order, 1)
    else:
        order = np.broadcast_to(np.arange(among), scores.shape)
    best = np.argsort(-scores, 1, kind="stable")
    order, scores = np.take_along_axis(order, best, 1), np.take_along_axis(scores, best, 1)
    return np.where(np.isfinite(scores), order, -1).astype(np.int32), scores


def _link_back(vectors: np.ndarray, links: np.ndarray, rows: np.ndarray) -> None:
    """Link what the new ``rows`` link to back to them, and choose anew where it gets crowded."""
    to, new = links[rows].ravel(), np.repeat(rows, links.shape[1])
    new, to = new[to >= 0], to[to >= 0]
    # Two new nodes that chose each other are linked both ways already; a link stands once.
    lacks = ~(links[to] == new[:, None]).any(1)
    new, to = new[lacks], to[lacks]
    if not len(to):
        return
    score = np.einsum("kd,kd->k", vectors[new], vectors[to])
    order = np.lexsort((-score, to))
    new, to = new[order], to[order]
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    nth = np.arange(len(to)) - np.repeat(first, np.diff(np.concatenate([first, [len(to)]])))
    near = nth < links.shape[1]
    nodes = to[first]
    adds = np.full((len(nodes), links.shape[1]), -1, np.int32)
    adds[np.searchsorted(nodes, to[near]), nth[near]] = new[near]
    # Nodes with like numbers of additions go together: most have few, and blocks stay narrow.
    counts = (adds >= 0).sum(1)
    by_count = np.argsort(counts, kind="stable")
    nodes, adds, counts = nodes[by_count], adds[by_count], counts[by_count]
    for at in range(0, len(nodes), BATCH):
        part = nodes[at : at + BATCH]
        wide = counts[at : at + BATCH].max()
        ids = np.concatenate([links[part], adds[at : at + BATCH, :wide]], 1)
        scores = np.where(ids >= 0, np.einsum("bcd,bd->bc", vectors[np.maximum(ids, 0)], vectors[part]), -np.inf)
        order = np.argsort(-scores, 1, kind="stable")
        links[part] = choose(vectors, np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1), links.shape[1])


def layer_sizes(n: int) -> list[int]:
    sizes = [n]
    while sizes[-1] > 4 * LINKS:
        sizes.append(-(-sizes[-1] // SHRINK))
    return sizes


def build(vectors: np.ndarray, exact: int = EXACT_ROWS) -> list[np.ndarray]:
    """Neighbour arrays of all layers, from the whole shard to the smallest.

    ``vectors`` (raised) are in random order, and the first ones make up the upper layers.
    ``exact``: so many nodes of a layer choose among all before them; all others search the graph.
    """
    sizes, layers = layer_sizes(len(vectors)), []
    for size in reversed(sizes):
        links = np.full((size, LINKS), -1, np.int32)
        at = 0
        while at < size:
            rows = np.arange(at, min(size, at + min(BATCH, max(BATCH // 4, at))))
            if at + len(rows) <= max(exact, len(rows)):
                ids, scores = _exact(vectors, rows, at + len(rows), WIDTH_BUILD)
            else:
                entry = descend(vectors, layers, vectors[rows], at)
                ids, scores = beam(vectors[:at], links[:at], vectors[rows], entry, WIDTH_BUILD)
                own_ids, own = _exact(vectors[rows], np.arange(len(rows)), len(rows), WIDTH_BUILD // 4)
                own_ids = np.where(own_ids >= 0, own_ids + at, -1).astype(np.int32)
                ids, scores = np.concatenate([ids, own_ids], 1), np.concatenate([scores, own], 1)
                order = np.argsort(-scores, 1, kind="stable")[:, :WIDTH_BUILD]
                ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
            links[rows] = choose(vectors, ids, scores, LINKS)
            _link_back(vectors, links, rows)
            at += len(rows)
        layers.insert(0, links)
    return layers


def descend(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, known: int) -> np.ndarray:
    """Where to enter the layer below ``layers``: of its first ``known`` nodes only."""
    entry = np.zeros((len(queries), 1), np.int32)
    for links in reversed(layers):
        entry, _ = beam(vectors[: len(links)], links, queries, entry, 8)
    entry = np.where(entry < known, entry, -1)
    return np.concatenate([entry, np.zeros((len(queries), 1), np.int32)], 1)


def search(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, width: int = WIDTH_SEARCH) -> np.ndarray:
    """Up to ``width`` nodes for each query (not raised), best first, -1 for none."""
    queries = np.concatenate([queries, np.zeros((len(queries), 1), np.float32)], 1)
    # The longest vectors (of least added component) are where large inner products are.
    longest = np.argsort(vectors[:, -1], kind="stable")[:LONGEST].astype(np.int32)
    found = []
    for at in range(0, len(queries), BATCH):
        part = queries[at : at + BATCH]
        entry = descend(vectors, layers[1:], part, len(vectors))
        entry = np.concatenate([entry, np.broadcast_to(longest, (len(part), len(longest)))], 1)
        found.append(beam(vectors, layers[0], part, entry, width)[0])
    return np.concatenate(found) if found else np.empty((0, width), np.int32)


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that take part. Null ids and vectors, null or non-finite components,
    zero vectors, and those of another length than most do not."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (length["n"] if length else 0))


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


INDEX = "shard int, n int, vectors binary, links binary, ids binary, ends binary"


def index(rows: DataFrame, k: int = K) -> DataFrame:
    """One row for each shard: vectors, neighbour arrays layer after layer, and for each
    vector the ids that have it (the k + 1 least: no more can be among k results)."""
    keyed = rows.select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64("v", F.lit(7)).alias("k2"))
    least = W.partitionBy("k1", "k2").orderBy("vec_id")
    few = keyed.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1)
    nodes = few.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes, "vectors")
    shards = max(LEAST_SHARDS, math.ceil(nodes.count() / SHARD_ROWS))
    dealt = nodes.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))

    def make(group: pa.Table) -> pa.Table:
        group = group.sort_by([("k2", "ascending"), ("k1", "ascending")])  # hashes: a random order
        v = group.column("v").combine_chunks()
        vectors = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
        links = build(raised(vectors))
        ids = group.column("ids").combine_chunks()
        ends = np.cumsum([len(x) for x in ids]).astype(np.int64)
        return pa.table({
            "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "n": pa.array([len(v)], pa.int32()),
            "vectors": [_blob(vectors)], "links": [b"".join(map(_blob, links))],
            "ids": [_blob(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64))], "ends": [_blob(ends)],
        })

    return dealt.groupBy("shard").applyInArrow(make, INDEX)


RESULT = "query_id long, vec_id long, score double"


class Shard:
    """A shard's graph, read from its row of the index."""

    def __init__(self, row: dict):
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], -1)
        self.raised = raised(self.vectors)
        flat = np.frombuffer(row["links"], np.int32).reshape(-1, LINKS)
        edges = np.cumsum([0, *layer_sizes(row["n"])])
        self.layers = [flat[a:b] for a, b in zip(edges, edges[1:])]
        self.ids, self.ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)

    def nearest(self, own_ids: list[int], queries: np.ndarray, k: int) -> np.ndarray:
        """(query id, vec id, score's bits) of the k best rows of each query, its own left out."""
        out: list[np.ndarray] = [np.empty((3, 0), np.int64)]
        ids, ends = self.ids, self.ends
        for own, query, nodes in zip(own_ids, queries, search(self.raised, self.layers, queries.astype(np.float32))):
            nodes = nodes[nodes >= 0]
            scores = (self.vectors[nodes] * query).sum(1)
            # The k + 1 best nodes have the k best rows, each node bringing all ids that can count.
            best = np.lexsort((ids[ends[nodes - 1] * (nodes > 0)], -scores))[: k + 1]
            spans = [ids[(ends[n - 1] if n else 0) : ends[n]] for n in nodes[best].tolist()]
            vec = np.concatenate(spans)
            score = np.repeat(scores[best], [len(s) for s in spans])
            keep = vec != own
            vec, score = vec[keep], score[keep]
            top = np.lexsort((vec, -score))[:k]
            out.append(np.stack([np.full(len(top), own), vec[top], score[top].view(np.int64)]))
        return np.concatenate(out, 1)


def nearest(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for each query, its own row left out.

    ``rows`` and ``queries`` have vec_id and v, as ``usable`` makes them; other columns are not
    looked at. Scores are inner products in double precision; ties go to the smaller vec_id. Rows
    that agree in id and vector count once for each. Empty tables give no rows. Each shard is read
    once: its queries come after it, in order of a sort, and pass by in batches.
    """
    built = materialize(index(rows, k), "hnsw")
    shards = [r["shard"] for r in built.select("shard").collect()]
    asked = queries.select("vec_id", "v", F.explode(F.array(*map(F.lit, shards)).cast("array<int>")).alias("shard"))
    both = built.withColumn("side", F.lit(0)).unionByName(asked.withColumn("side", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", "side", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        for batch in batches:
            sides = batch.column("side").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(sides)) + 1, [len(sides)]]).tolist()
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if b > a and sides[a] == 0:
                    # Of shards without queries between, the last is the one whose queries follow.
                    shard = Shard(part.slice(len(part) - 1).to_pylist()[0])
                    continue
                for at in range(0, len(part), QUERY_BLOCK):
                    few = part.slice(at, QUERY_BLOCK)
                    v = few.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(few), -1)
                    found = shard.nearest(few.column("vec_id").to_pylist(), v, k)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, found[:2]), pa.array(found[2].view(np.float64))], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, RESULT)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.where("vec_id % 20 = 0"))
