"""Ranked lexical search over a length-stratified index.

A document's score depends on its length only through its normaliser m, so documents of one
m are a stratum: a term adds the same to all of them that hold it equally often. Postings
lie by term, stratum and tf, and an impact is computed once for each such list. What a
stratum can reach at most orders the visits; the rest is left out once it cannot
enter the best k any more.

Strata are laid out over shards of bounded size in order of m. A stratum larger than a shard
is dealt over several by a hash of the row, so neither a common length nor a common
term gathers in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from corpuscade.llm.common import per_batch, sliced, table
from corpuscade.operators.skew import fits_broadcast, lookup_join
from corpuscade.session import materialize

BEST = 50
#: Word occurrences a shard holds.
SHARD = 500_000
#: Bytes of texts that are looked at together.
STEP = 4 << 20

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and everything beyond ASCII; only A-Z become small."""
    return text.encode().translate(_TABLE).lower().split() if text else []


def lengths(docs: DataFrame) -> DataFrame:
    """(n, docs): how many texts have n terms, for n over 0."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        def step(batch: pa.RecordBatch) -> dict:
            found = Counter(len(terms(t.as_py())) for t in batch.column("text"))
            found.pop(0, None)
            return {"n": list(found), "docs": list(found.values())}

        return step

    return per_batch(docs.select("text"), "n long, docs long", make).groupBy("n").agg(F.sum("docs").alias("docs"))


def normaliser(documents: int, length: int) -> Column:
    """m of a text with ``n`` terms."""
    return F.expr(f"50L + (50L * n * {documents}L) div {length}L")


def layout(counts: DataFrame, documents: int, length: int, shard: int = SHARD) -> DataFrame:
    """(m, first, pieces): the shards of each stratum; small neighbours share one.

    A row for each different m, never more than there are different lengths.
    """
    sizes = counts.groupBy(normaliser(documents, length).alias("m")).agg(F.sum(F.col("n") * F.col("docs")).alias("size"))
    # Strata that need several shards get their own; runs of small ones share shards by their sum.
    large = F.col("size") > shard
    over = W.orderBy("m")
    sums = sizes.withColumn("pieces", F.ceil(F.col("size") / shard).cast("int")).withColumns({
        "_small": F.sum(F.when(~large, F.col("size")).otherwise(0)).over(over),
        "_large": F.sum(F.when(large, F.col("pieces")).otherwise(0)).over(over),
    })
    own = F.when(large, 2 * (F.col("_large") - F.col("pieces"))).otherwise(2 * F.floor(F.col("_small") / shard) + 1)
    return sums.select("m", own.cast("long").alias("first"), F.when(large, F.col("pieces")).otherwise(1).cast("int").alias("pieces"))


def _counted(docs: DataFrame) -> DataFrame:
    """(doc_id, n, terms, tfs) of each text with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", STEP):
            ids, n, ends, names, tfs = [], [], [0], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if found := terms(text.as_py()):
                    each = Counter(found)
                    ids.append(doc_id)
                    n.append(len(found))
                    names += each.keys()
                    tfs += each.values()
                    ends.append(len(names))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(c, t)) for c, t in ((names, pa.binary()), (tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, n long, terms array<binary>, tfs array<int>")


INDEX = "shard long, term binary, ms array<long>, tfs array<int>, ends array<int>, docs array<int>, ids array<long>"
_ARROW = pa.schema([
    ("shard", pa.int64()), ("term", pa.binary()), ("ms", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())),
    ("ends", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())),
])
#: In no text: the row of a shard that lists its documents.
MARKER = b""


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each shard from batches that are sorted by shard."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if held and shards[a] != now:
                    yield now, pa.Table.from_batches(held).combine_chunks()
                    held = []
                now = int(shards[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def _inverted(shard: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its doc_ids, then each term with its lists by (m, tf)."""
    names = rows["terms"].combine_chunks()
    sizes = pc.list_value_length(names).to_numpy()
    coded = names.flatten().dictionary_encode()
    term = coded.indices.to_numpy().astype(np.int64)
    tf = rows["tfs"].combine_chunks().flatten().to_numpy()
    doc = np.repeat(np.arange(rows.num_rows, dtype=np.int32), sizes)
    m = np.repeat(rows["m"].to_numpy(), sizes)
    order = np.lexsort((doc, tf, m, term))
    term, m, tf, doc = term[order], m[order], tf[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (m[1:] != m[:-1]) | (tf[1:] != tf[:-1])]))
    own = term[at]  # the term of each list of equal (term, m, tf)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    lists = np.concatenate([first, [len(at)]]).astype(np.int32)
    begins = np.concatenate([at[first], [len(term)]]).astype(np.int32)
    ends = np.concatenate([at[1:], [len(term)]]) - np.repeat(at[first], np.diff(lists))
    marker = [[shard], [MARKER], [[]], [[]], [[]], [[]], [rows["doc_id"].to_pylist()]]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(marker, _ARROW)], schema=_ARROW)
    k = len(first)
    columns = [pa.array(np.full(k, shard)), coded.dictionary.take(pa.array(own[first]))]
    for cut, values in ((lists, m[at]), (lists, tf[at]), (lists, ends.astype(np.int32)), (begins, doc)):
        columns.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(values)))
    columns.append(pa.nulls(k, pa.list_(pa.int64())))
    whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
    for at in range(0, k, 20_000):
        yield whole.slice(at, 20_000)


def build(docs: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int]:
    """The index as a table, and the number of documents with at least one term.

    For each shard a row with the empty term lists its doc_ids (``ids``; null and repeated
    ones stay as they are, every row is a document); ``docs`` of the other rows are places in
    that list, cut by ``ends`` into the lists of equal (m, tf).
    """
    counts = materialize(lengths(docs), "lengths")
    total = counts.agg(F.sum("docs").alias("docs"), F.sum(F.col("n") * F.col("docs")).alias("length")).first()
    documents, length = total["docs"] or 0, total["length"] or 0
    if not documents:
        return docs.sparkSession.createDataFrame([], INDEX), 0
    places = materialize(layout(counts, documents, length, shard), "strata")
    # Rows are numbered where they are read, so copies with one id are dealt out as well.
    counted = _counted(docs).withColumns({"m": normaliser(documents, length), "_row": F.monotonically_increasing_id()})
    salt = F.pmod(F.xxhash64("_row"), F.col("pieces"))
    placed = lookup_join(counted, places, ["m"]).select((F.col("first") + 2 * salt).alias("shard"), "m", "doc_id", "terms", "tfs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _by_shard(batches):
            yield from _inverted(number, rows)

    # How many tasks there are depends on the whole, so a task holds few shards at a time.
    tasks = max(1, int(4 * length // shard) + 1)
    dealt = placed.repartition(min(tasks, 100_000), "shard").sortWithinPartitions("shard", "m")
    return materialize(dealt.mapInArrow(run, INDEX), "strata-index"), documents


def asked_terms(items: DataFrame) -> DataFrame:
    """(item, term): the different terms of ``items(item_id, text)``; ``item`` is the id as JSON.

    Rows with one item_id are one item; a null id is an id.
    """

    def make() -> Callable[[pa.RecordBatch], dict]:
        def step(batch: pa.RecordBatch) -> dict:
            found = [sorted(set(terms(t.as_py()))) for t in batch.column("text")]
            sizes = list(map(len, found))
            return {"item_id": batch.column("item_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), "term": [t for f in found for t in f]}

        return step

    kind = dict(items.select("item_id").dtypes)["item_id"]
    return per_batch(items.select("item_id", "text"), f"item_id {kind}, term binary", make).distinct()


class Shard:
    """The asked terms of one shard: lists of equal (term, m, tf), their impacts and bounds."""

    def __init__(self, rows: pa.Table):
        marker = pc.equal(rows["term"], pa.scalar(MARKER, pa.binary()))
        self.ids = rows.filter(marker)["ids"].combine_chunks().flatten()
        rows = rows.filter(pc.invert(marker)).combine_chunks()
        column = lambda name: rows[name].combine_chunks() if len(rows) else pa.array([], rows.schema.field(name).type)
        flat = lambda name: column(name).flatten().to_numpy().astype(np.int64)
        sizes = pc.list_value_length(column("ms")).to_numpy().astype(np.int64)
        held = pc.list_value_length(column("docs")).to_numpy().astype(np.int64)
        self.number = {t: i for i, t in enumerate(column("term").to_pylist())}
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        m, tf, self.docs = flat("ms"), flat("tfs"), flat("docs")
        self.stops = flat("ends") + np.repeat(np.cumsum(held) - held, sizes)
        self.starts = np.concatenate([[0], self.stops[:-1]])[: len(self.stops)]
        self.impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
        self.strata, self.stratum = np.unique(m, return_inverse=True)
        # The last list of a (term, stratum) has its largest tf, hence its largest impact.
        term = np.repeat(np.arange(len(sizes)), sizes)
        self.top = np.ones(len(m), bool)
        self.top[:-1] = (term[1:] != term[:-1]) | (m[1:] != m[:-1])

    def best(self, asked: list[tuple[bytes, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents, and of all that tie with the last."""
        known = [(self.number[t], w) for t, w in asked if t in self.number and w > 0]
        scores = np.zeros(len(self.ids), np.int64)
        if not known:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        own = np.concatenate([np.arange(self.begin[t], self.begin[t + 1]) for t, _ in known])
        weights = np.repeat([w for _, w in known], [self.begin[t + 1] - self.begin[t] for t, _ in known])
        reach = weights * self.impacts[own]
        stratum, top = self.stratum[own], self.top[own]
        # Sums stay below 2^53, so they are exact in doubles.
        bound = np.bincount(stratum[top], reach[top], len(self.strata)).astype(np.int64)
        order = np.argsort(-bound, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.argsort(place[stratum], kind="stable")
        own, reach, visit = own[by], reach[by], place[stratum][by]
        floor, at, width = 0, 0, 8
        while at < len(order) and bound[order[at]] > 0 and bound[order[at]] >= floor:
            upto = min(at + width, len(order))
            a, b = np.searchsorted(visit, [at, upto])
            begin, size = self.starts[own[a:b]], self.stops[own[a:b]] - self.starts[own[a:b]]
            which = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
            scores += np.bincount(self.docs[which], np.repeat(reach[a:b], size), len(scores)).astype(np.int64)
            if len(scores) > k:
                floor = int(np.partition(scores, len(scores) - k)[len(scores) - k])
            at, width = upto, width * 2
        found = np.flatnonzero((scores > 0) & (scores >= floor))
        return found, scores[found]


def search(index: DataFrame, documents: int, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, score above 0.

    Equal scores go by ascending doc_id, null last. Items without a term that occurs, null
    and empty ones among them, have no rows. Items are shipped to the shards in
    blocks of measured size.
    """
    spark = index.sparkSession
    kind = dict(items.select("item_id").dtypes)["item_id"]
    asked = materialize(asked_terms(items), "asked-terms")
    names = materialize(asked.select("term").distinct(), "asked-names")
    wanted = names.unionByName(spark.createDataFrame([(bytearray(),)], "term binary"))
    hits = materialize(lookup_join(index, wanted, ["term"], "left_semi"), "asked-postings")
    df = hits.where("ids is null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = materialize(asked.join(df, "term").select("item_id", "term", weight.alias("w")), "asked-weights")
    slot = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    blocks = 1
    while not all(fits_broadcast(weighed.where(slot(blocks) == b)) for b in range(blocks)):
        blocks *= 2
    best = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    schema = best.schema
    for b in range(blocks):
        by_item: dict = {}
        for r in weighed.where(slot(blocks) == b).collect():  # measured above
            by_item.setdefault(r["item_id"], []).append((bytes(r["term"]), r["w"]))
        shipped = spark.sparkContext.broadcast(by_item)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            for _, rows in _by_shard(batches):
                here = Shard(rows)
                for item, asked in shipped.value.items():
                    found, scores = here.best(asked, k)
                    if len(found):
                        # In the order of the result: by score, then by id, null last.
                        own = here.ids.take(pa.array(found))
                        order = np.lexsort((own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False), -scores))[:k]
                        columns = [[item] * len(order), own.take(pa.array(order)), scores[order]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        dealt = hits.repartition("shard").sortWithinPartitions("shard", "term")
        best = best.unionByName(dealt.mapInArrow(run, schema))
    order = W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op11_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, documents = build(table(spark, sf_dir, "documents"))
    return search(index, documents, table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH found AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
long AS (SELECT row, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM found WHERE len(t) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM long),
placed AS (SELECT row, doc_id, 50 + (50 * n * docs) // length AS m FROM long CROSS JOIN whole),
postings AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(t) AS term FROM long) GROUP BY row, term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term) CROSS JOIN whole),
scored AS (
  SELECT item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN placed USING (row)
  GROUP BY item_id, row),
ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN placed USING (row) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
