"""The index: generations of Parquet tables, and a registry that says which of them count.

Every write goes into a folder of its own, a *generation*, and touches no other file. The
registry is an append-only log: one row for a namespace names the generations (segments)
that make it up, and the row of the latest generation holds. It is written last, as one
file, so readers see a namespace either as it was or as it is after the whole write. What
a broken write left behind is named by no row; ``sweep`` removes it.

A refresh adds a generation with the documents that came in, and lists in ``removed`` the
documents whose rows in earlier generations are dead. ``compact`` makes one generation of many.

chunks     doc_id, chunk_no, n_tokens, n_terms, term_keys, tfs, text, embedding
           term_keys and tfs are the forward index: a hash of each different term, in order
           of first occurrence, and how often it occurs
postings   term, chunks that have it in order as arrays (docs, chunk_nos, tfs, lengths), max_tf,
           min_terms, first_doc, last_doc: blocks of at most BLOCK chunks, by term bucket
terms      term, df (what this generation adds; below zero for what it takes), max_tf,
           min_terms, by term bucket
documents  doc_id, text_sha
removed    doc_id
registry   namespace, index_id, kind, n_chunks, n_terms, n_removed, segments

All but the registry are laid out by generation and namespace.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuscade.functions import text as tx
from corpuscade.operators.chunking import CHUNK_SIZE, chunk_documents
from corpuscade.operators.embedding import SLICE, embed_chunks, hashed_embedding, in_slices
from corpuscade.operators.skew import lookup_join
from corpuscade.session import discard, materialize

_AT = "generation long, namespace string"
SCHEMAS = {
    "chunks": "doc_id long, chunk_no int, n_tokens int, n_terms int, term_keys array<long>, tfs array<int>, "
    f"text string, embedding array<float>, {_AT}",
    "postings": "term string, docs array<long>, chunk_nos array<int>, tfs array<int>, lengths array<int>, "
    f"max_tf int, min_terms int, first_doc long, last_doc long, {_AT}, bucket int",
    "terms": f"term string, df long, max_tf int, min_terms int, {_AT}, bucket int",
    "documents": f"doc_id long, text_sha string, {_AT}",
    "removed": f"doc_id long, {_AT}",
    "registry": "namespace string, index_id string, kind string, n_chunks long, n_terms long, n_removed long, "
    "segments array<struct<generation: long, buckets: int>>, generation long",
}
KINDS = ("vector", "list")
#: Chunks in a block of postings, and postings that a task gathers by term before they move, about.
BLOCK, GATHERED = 128, 2_000_000
#: Postings that share a term bucket, about; there are at most MOST_BUCKETS.
BUCKET_ROWS, MOST_BUCKETS = 2_000_000, 1_024
#: A namespace of more segments, or with more removed documents than a quarter of its chunks, is compacted.
MOST_SEGMENTS = 8


@dataclass(frozen=True)
class Index:
    """One namespace, opened for reading: one state, whatever is written meanwhile.

    ``chunks`` are the live ones. ``postings`` and ``terms`` hold what the segments hold;
    ``dead`` (doc_id, dead_before) says which documents' rows of earlier generations to leave out.
    """

    namespace: str
    kind: str
    n_chunks: int
    n_terms: int
    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    segments: list[tuple[int, int]] = field(default_factory=lambda: [(0, 1)])
    dead: DataFrame | None = None

    @property
    def mean_terms(self) -> float:
        return self.n_terms / self.n_chunks if self.n_chunks else 1.0

    def places(self, features: DataFrame) -> DataFrame:
        """``features`` (feature, ...) once for each segment, with the generation and bucket
        of its term there; the condition tells the optimizer that partitions can be pruned."""
        segments = F.array(*[F.struct(F.lit(g).cast("long").alias("generation"), F.lit(b).alias("buckets")) for g, b in self.segments])
        spread = features.select("*", F.explode(segments).alias("_s"))
        bucket = term_bucket(F.col("feature"), F.col("_s.buckets"))
        return spread.select(*features.columns, F.col("_s.generation").alias("generation"), bucket.alias("bucket")).where("bucket >= 0")

    def stats(self, features: DataFrame, small: bool) -> DataFrame:
        """feature, df, max_tf, min_terms of the asked ``features(feature)``."""
        asked = self.places(features)
        terms = self.terms.withColumnRenamed("term", "feature")
        on = ["feature", "generation", "bucket"]
        found = terms.join(F.broadcast(asked) if small else asked, on)
        every = found.groupBy("feature").agg(
            F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_terms").alias("min_terms")
        )
        return every.where("df > 0")


def term_bucket(term: Column, buckets: Column | int) -> Column:
    buckets = F.lit(buckets) if isinstance(buckets, int) else buckets
    return F.pmod(F.xxhash64(term, F.lit(17)), buckets).cast("int")


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """All rows of all generations, those that no longer or do not yet count among them."""
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{base}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def current(spark: SparkSession, base: str) -> DataFrame:
    """The row of each namespace that counts; a namespace without chunks has none."""
    rows = table(spark, base, "registry")
    last = rows.groupBy("namespace").agg(F.max_by(F.struct(*rows.columns), "generation").alias("r")).select("r.*")
    return last.where("n_chunks > 0")


def live(spark: SparkSession, base: str, name: str, beside: DataFrame | None = None) -> DataFrame:
    """The rows of all namespaces that count now, ``postings`` one row a chunk and ``terms`` summed up.

    To ``postings``, of which then only the chunks' ids are read, ``beside(namespace, term, ...)`` is
    joined if given: to a block of them at once.
    """
    rows = current(spark, base)
    used = materialize(rows.select("namespace", F.explode("segments").alias("s")).select("namespace", "s.generation"), "segments")
    found = lookup_join(table(spark, base, name), used, ["namespace", "generation"])
    if name == "terms":
        return found.groupBy("namespace", "term").agg(
            F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_terms").alias("min_terms")
        ).where("df > 0")
    if name == "postings" and beside is None:
        found = opened(found, "namespace", "generation")
    elif name == "postings":
        ids = found.select("namespace", "generation", "term", "docs", "chunk_nos").join(beside, ["namespace", "term"])
        each = F.explode(F.arrays_zip(F.col("docs").alias("doc_id"), F.col("chunk_nos").alias("chunk_no"))).alias("p")
        found = ids.select("generation", *beside.columns, each).select("generation", *beside.columns, "p.*")
    gone = lookup_join(table(spark, base, "removed"), used, ["namespace", "generation"])
    return without_dead(found, gone.groupBy("namespace", "doc_id").agg(F.max("generation").alias("dead_before")), ["namespace", "doc_id"])


def opened(postings: DataFrame, *keep: str) -> DataFrame:
    """Blocks of postings as a row for each chunk: term, doc_id, chunk_no, tf, n_terms."""
    each = F.explode(F.arrays_zip("docs", "chunk_nos", "tfs", "lengths")).alias("p")
    return postings.select("term", *keep, each).select(
        "term", *keep, F.col("p.docs").alias("doc_id"), F.col("p.chunk_nos").alias("chunk_no"),
        F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("n_terms"),
    )


def without_dead(rows: DataFrame, dead: DataFrame, on: list[str]) -> DataFrame:
    """Leave out rows of generations before the one that removed or replaced their document."""
    met = lookup_join(rows, dead, on, "left")
    return met.where(F.coalesce("dead_before", F.lit(0)) <= F.col("generation")).drop("dead_before")


def _write(df: DataFrame, base: str, name: str, generation: int, *by: str) -> None:
    """Write rows as a generation of ``name``: into a folder that nobody reads or wrote to."""
    df.drop("generation").write.partitionBy("namespace", *by).parquet(f"{base}/{name}/generation={generation}")


def _publish(rows: DataFrame, base: str, generation: int) -> None:
    """Make a generation count: the namespaces' new rows, in one file, at once."""
    names = [n for n in rows.sparkSession.createDataFrame([], SCHEMAS["registry"]).columns if n != "generation"]
    rows.select(*names).coalesce(1).write.parquet(f"{base}/registry/generation={generation}")


def _next_generation(spark: SparkSession, base: str) -> int:
    """A number no write had before, larger than all that count."""
    last = table(spark, base, "registry").agg(F.max("generation")).first()[0] or 0
    return max(last + 1, time.time_ns())


def _forward_udf():
    def counted(keys: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(keys).fill_null(0).to_numpy().astype(np.int64)
        flat = keys.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((flat, row))
        flat, row = flat[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])])[: len(flat)])
        times = np.diff(np.concatenate([first, [len(flat)]]))
        place = np.argsort(order[first], kind="stable")  # lexsort is stable: a run starts at its first occurrence
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(sizes)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times[place], pa.int32()))

    @F.arrow_udf("array<int>")
    def frequencies(keys: pa.Array) -> pa.Array:
        """How often each different key occurs, in order of first occurrence."""
        return in_slices(keys, counted)

    return frequencies


def _chunked(docs: DataFrame, chunk_size: int, overlap: int, embed) -> DataFrame:
    chunks = chunk_documents(docs.select("namespace", "doc_id", "text"), chunk_size, overlap)
    keyed = chunks.withColumn("_keys", F.transform(tx.terms(F.col("text")), lambda t: F.xxhash64(t)))
    counted = keyed.withColumn("tfs", _forward_udf()("_keys"))
    return embed_chunks(counted, embed=embed).select(
        "doc_id", "chunk_no", "n_tokens", F.size("_keys").alias("n_terms"),
        F.array_distinct("_keys").alias("term_keys"), "tfs", "text", "embedding", "namespace",
    )


_LISTS = "docs array<long>, chunk_nos array<int>, tfs array<int>, lengths array<int>"


def _codes(column: pa.Array) -> np.ndarray:
    """A number for each different value, null among them."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)


def _runs(group: np.ndarray, block: int) -> np.ndarray:
    """Where a block opens: with each group of neighbours, and after ``block`` rows of one."""
    new = np.r_[True, group[1:] != group[:-1]][: len(group)]
    heads = np.flatnonzero(new)
    place = np.arange(len(group)) - np.repeat(heads, np.diff(np.r_[heads, len(group)]))
    return np.flatnonzero(place % block == 0)


def _as_lists(at: np.ndarray, columns: list[pa.Array]) -> list[pa.Array]:
    """``columns`` cut into lists that open ``at``."""
    cut = pa.array(np.r_[at, len(columns[0])], pa.int32())
    return [pa.ListArray.from_arrays(cut, column) for column in columns]


def _gathered(chunks: DataFrame) -> DataFrame:
    """namespace, term, docs, chunk_nos, tfs, lengths: the postings of the chunks, those of a term
    together that a task meets within GATHERED of them, in lists of at most BLOCK in order."""
    block, most = BLOCK, GATHERED

    def gather(table: pa.Table) -> pa.RecordBatch:
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("chunk_no", "ascending")])).combine_chunks()
        rows = table.to_batches()[0]
        terms, tfs = rows.column("terms"), rows.column("tfs")
        sizes, counted = (pc.list_value_length(c).fill_null(0).to_numpy().astype(np.int64) for c in (terms, tfs))
        row = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        named = terms.flatten().dictionary_encode()
        namespace = _codes(rows.column("namespace"))
        key = named.indices.to_numpy().astype(np.int64) * (namespace.max(initial=0) + 1) + namespace[row]
        order = np.argsort(key, kind="stable")
        row, within = row[order], within[order]
        at = _runs(key[order], block)
        tf = (np.cumsum(counted) - counted)[row] + within
        taken = pa.array(row)
        lists = _as_lists(at, [
            rows.column("doc_id").take(taken), rows.column("chunk_no").take(taken),
            tfs.flatten().take(pa.array(tf, mask=within >= counted[row])), rows.column("n_terms").take(taken),
        ])
        heads = [rows.column("namespace").take(pa.array(row[at])), named.dictionary.take(named.indices.take(pa.array(order[at])))]
        return pa.RecordBatch.from_arrays([*heads, *lists], ["namespace", "term", "docs", "chunk_nos", "tfs", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            waiting.append(batch)
            size += pc.sum(pc.list_value_length(batch.column("terms"))).as_py() or 0
            if size >= most:
                yield gather(pa.Table.from_batches(waiting))
                waiting, size = [], 0
        if waiting:
            yield gather(pa.Table.from_batches(waiting))

    named = chunks.select("namespace", "doc_id", "chunk_no", "n_terms", F.array_distinct(tx.terms(F.col("text"))).alias("terms"), "tfs")
    return named.mapInArrow(run, f"namespace string, term string, {_LISTS}")


def _blocks(gathered: DataFrame, buckets: int) -> DataFrame:
    """Postings in blocks: a range layout of the ``gathered`` lists over (bucket, term, chunk), so a
    term of very many chunks spreads over many files."""
    first = [F.element_at("docs", 1).alias("doc_id"), F.element_at("chunk_nos", 1).alias("chunk_no")]
    each = gathered.select("namespace", term_bucket(F.col("term"), buckets).alias("bucket"), "term", "docs", "chunk_nos", "tfs", "lengths", *first)
    order = ("namespace", "bucket", "term", "doc_id", "chunk_no")
    # Within a range the term comes first: its bytes tell rows apart at once, the namespace's seldom do.
    laid = each.repartitionByRange(*order).sortWithinPartitions("term", "namespace", "doc_id", "chunk_no")
    block = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i) for i in range(3)]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in map(_codes, keys)], axis=0)
            sizes = pc.list_value_length(batch.column("docs")).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            group = np.cumsum(new)[row]
            lists = [batch.column(i).flatten() for i in range(3, 7)]
            doc, chunk_no = (c.fill_null(np.iinfo(t).min).to_numpy() for c, t in zip(lists, (np.int64, np.int32)))
            sort = np.lexsort((chunk_no, doc, group))  # lists from several tasks may overlap
            at = _runs(group[sort], block)
            taken, heads = pa.array(sort), pa.array(row[sort[at]])
            yield pa.RecordBatch.from_arrays(
                [*(c.take(heads) for c in keys), *_as_lists(at, [c.take(taken) for c in lists])],
                ["namespace", "bucket", "term", "docs", "chunk_nos", "tfs", "lengths"],
            )

    return laid.mapInArrow(run, f"namespace string, bucket int, term string, {_LISTS}").select(
        "term", "docs", "chunk_nos", "tfs", "lengths", F.array_max("tfs").alias("max_tf"), F.array_min("lengths").alias("min_terms"),
        F.element_at("docs", 1).alias("first_doc"), F.element_at("docs", -1).alias("last_doc"), "namespace", "bucket",
    )


def _write_rows(chunks: DataFrame, documents: DataFrame, base: str, generation: int, taken: DataFrame | None = None) -> int:
    """Write chunks, postings, terms and documents of a generation; its number of term buckets.

    ``taken`` (namespace, term, df) are postings that die with this generation.
    """
    spark = chunks.sparkSession
    here = F.col("generation") == generation
    _write(chunks, base, "chunks", generation)
    chunks = table(spark, base, "chunks").where(here)
    n = chunks.agg(F.sum(F.size("term_keys"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, 1 << max(0, -(-n // BUCKET_ROWS) - 1).bit_length())
    # So few tasks that each has much to gather, and enough to keep every core busy.
    tasks = max(3 * spark.sparkContext.defaultParallelism, -(-n // GATHERED))
    gathered = materialize(_gathered(chunks.coalesce(tasks)), "postings-gathered")
    _write(_blocks(gathered, buckets), base, "postings", generation, "bucket")
    discard(gathered)
    counted = table(spark, base, "postings").where(here).select(
        "namespace", "bucket", "term", F.size("docs").cast("long").alias("df"), "max_tf", "min_terms"
    )
    if taken is not None:
        counted = counted.unionByName(taken.select(
            "namespace", term_bucket(F.col("term"), buckets).alias("bucket"), "term", (-F.col("df")).alias("df"),
            F.lit(None).cast("int").alias("max_tf"), F.lit(None).cast("int").alias("min_terms"),
        ))
    # A bucket of a namespace, of bounded size, is in one task: it is one file, and not one of each task.
    counted = counted.repartition("namespace", "bucket").groupBy("namespace", "bucket", "term").agg(
        F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_terms").alias("min_terms")
    )
    _write(counted, base, "terms", generation, "bucket")
    _write(documents.select("doc_id", "text_sha", "namespace"), base, "documents", generation)
    return buckets


def _index_id() -> Column:
    return F.md5(F.concat_ws(":", F.col("namespace"), F.col("kind")))


def _segment(generation: int, buckets: int) -> Column:
    return F.struct(F.lit(generation).cast("long").alias("generation"), F.lit(buckets).alias("buckets"))


def _counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("namespace").agg(F.count("*").alias("n_chunks"), F.sum("n_terms").cast("long").alias("n_terms"))


def create_index(
    docs: DataFrame,
    base: str,
    kind: str = "vector",
    chunk_size: int = CHUNK_SIZE,
    overlap: int = 0,
    embed=hashed_embedding,
) -> None:
    """Build every namespace found in ``docs(namespace, doc_id, text)``, replacing old data.

    A document is its (namespace, doc_id); documents with equal texts are all indexed. Until
    the end of the last write the old data counts. A namespace without any chunk counts as none.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown index kind {kind!r}; choose from {KINDS}")
    spark = docs.sparkSession
    generation = _next_generation(spark, base)
    hashes = docs.select("doc_id", F.sha2("text", 256).alias("text_sha"), "namespace")
    buckets = _write_rows(_chunked(docs, chunk_size, overlap, embed), hashes, base, generation)
    written = table(spark, base, "chunks").where(F.col("generation") == generation)
    rows = docs.select("namespace").distinct().join(_counts(written), "namespace", "left").select(
        "namespace", F.lit(kind).alias("kind"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
        F.lit(0).cast("long").alias("n_removed"), F.array(_segment(generation, buckets)).alias("segments"),
    )
    _publish(rows.withColumn("index_id", _index_id()), base, generation)


def refresh_index(
    docs: DataFrame,
    base: str,
    kind: str = "vector",
    chunk_size: int = CHUNK_SIZE,
    overlap: int = 0,
    embed=hashed_embedding,
    removed: DataFrame | None = None,
) -> None:
    """Bring ``docs(namespace, doc_id, text)`` in, and take ``removed(namespace, doc_id)`` out.

    A new document is added, one whose text changed is replaced, one that did not change is
    left alone; a document in both tables is removed. A namespace keeps its kind; ``kind`` is
    for new ones. Only chunks that come in are cut, embedded and read for terms, and only
    their postings are written; of what goes, only ids and counts are. Namespaces whose
    documents did not change are not touched. A refresh that breaks off changes nothing;
    running it again starts anew. One refresh of an index runs at a time.
    """
    spark = docs.sparkSession
    key = ["namespace", "doc_id"]
    known = materialize(live(spark, base, "documents").select(*key, "text_sha"), "index-known")
    hashed = docs.select(*key, "text", F.sha2("text", 256).alias("text_sha"))
    if removed is not None:
        hashed = hashed.join(removed.select(*key).distinct(), key, "left_anti")
    old = known.select(*key, F.col("text_sha").alias("old_sha"), F.lit(True).alias("known"))
    changed = hashed.join(old, key, "left").where(
        F.col("known").isNull() | ~F.col("text_sha").eqNullSafe(F.col("old_sha"))
    )
    changed = materialize(changed.select(*key, "text", "text_sha", "known"), "index-refresh")
    out = changed.where("known").select(*key)
    if removed is not None:
        out = out.unionByName(known.select(*key).join(removed.select(*key), key, "left_semi"))
    out = materialize(out.distinct(), "index-out")
    touched = materialize(changed.select("namespace").union(out.select("namespace")).distinct(), "index-touched")
    if touched.isEmpty():
        return
    before = materialize(lookup_join(current(spark, base), touched, ["namespace"], "left_semi"), "index-before")
    generation = _next_generation(spark, base)
    gone = materialize(
        lookup_join(live(spark, base, "chunks").select(*key, "chunk_no", "n_terms", "text"), out, key, "left_semi"), "index-gone"
    )
    taken = gone.select("namespace", F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("term"))
    taken = taken.groupBy("namespace", "term").agg(F.count("*").alias("df"))
    buckets = _write_rows(_chunked(changed, chunk_size, overlap, embed), changed, base, generation, taken)
    _write(out, base, "removed", generation)
    came = _counts(table(spark, base, "chunks").where(F.col("generation") == generation))
    went = _counts(gone).withColumnsRenamed({"n_chunks": "out_chunks", "n_terms": "out_terms"})
    lost = out.groupBy("namespace").agg(F.count("*").alias("lost"))
    had = before.select("namespace", "kind", F.col("n_chunks").alias("had_chunks"), F.col("n_terms").alias("had_terms"), "n_removed", "segments")
    rows = touched.join(had, "namespace", "left").join(came, "namespace", "left").join(went, "namespace", "left").join(lost, "namespace", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    none = F.array().cast("array<struct<generation: long, buckets: int>>")
    rows = rows.select(
        "namespace", F.coalesce("kind", F.lit(kind)).alias("kind"),
        (some("had_chunks") + some("n_chunks") - some("out_chunks")).alias("n_chunks"),
        (some("had_terms") + some("n_terms") - some("out_terms")).alias("n_terms"),
        (some("n_removed") + some("lost")).alias("n_removed"),
        F.concat(F.coalesce("segments", none), F.array(_segment(generation, buckets))).alias("segments"),
    )
    _publish(rows.withColumn("index_id", _index_id()), base, generation)
    full = (F.size("segments") > MOST_SEGMENTS) | (F.col("n_removed") * 4 > F.col("n_chunks"))
    due = materialize(lookup_join(current(spark, base).where(full), touched, ["namespace"], "left_semi").select("namespace"), "index-due")
    if not due.isEmpty():
        compact(spark, base, due)


def compact(spark: SparkSession, base: str, namespaces: DataFrame) -> None:
    """Make one generation of the segments of each of ``namespaces(namespace)``; nothing is embedded anew."""
    generation = _next_generation(spark, base)
    wanted = materialize(namespaces.select("namespace").distinct(), "index-compact")
    own = lambda name: lookup_join(live(spark, base, name), wanted, ["namespace"], "left_semi")
    buckets = _write_rows(own("chunks"), own("documents"), base, generation)
    rows = lookup_join(current(spark, base), wanted, ["namespace"], "left_semi").select(
        "namespace", "index_id", "kind", "n_chunks", "n_terms",
        F.lit(0).cast("long").alias("n_removed"), F.array(_segment(generation, buckets)).alias("segments"),
    )
    _publish(materialize(rows, "index-compacted"), base, generation)


def sweep(spark: SparkSession, base: str, older_than_hours: float = 24.0) -> int:
    """Remove generations that no namespace's current row names; how many folders went.

    Only folders untouched for ``older_than_hours`` go, so readers that opened an index
    before a refresh, and writes under way, keep their files for that long.
    """
    rows = current(spark, base)
    used = {r[0] for r in rows.select(F.explode("segments").alias("s")).select("s.generation").distinct().collect()}
    used |= {r[0] for r in rows.select("generation").distinct().collect()}
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    latest = time.time() * 1000 - older_than_hours * 3_600_000
    gone = 0
    for name in SCHEMAS:
        if name == "registry":
            continue  # a log, small, and the record of what was
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        for status in files.listStatus(path) if files.exists(path) else []:
            folder = status.getPath().getName()
            if folder.startswith("generation=") and int(folder.partition("=")[2]) not in used and status.getModificationTime() <= latest:
                files.delete(status.getPath(), True)
                gone += 1
    return gone


def registry(spark: SparkSession, base: str, asked: DataFrame) -> DataFrame:
    """For each asked namespace its registry row and whether an index exists: one that has chunks."""
    rows = current(spark, base).select("namespace", "index_id", "kind", "n_chunks")
    wanted = asked.select("namespace").distinct()
    return wanted.join(rows, "namespace", "left").withColumn("index_exists", F.col("index_id").isNotNull())


def index_exists(spark: SparkSession, base: str, namespace: str) -> bool:
    return not current(spark, base).where(F.col("namespace") == namespace).isEmpty()


def load_index(spark: SparkSession, base: str, namespace: str) -> Index:
    row = current(spark, base).where(F.col("namespace") == namespace).first()
    if row is None:
        raise LookupError(f"no index named {namespace!r} under {base}")
    segments = [(s["generation"], s["buckets"]) for s in row["segments"]]
    own = (F.col("namespace") == namespace) & F.col("generation").isin([g for g, _ in segments])
    chunks, postings, terms = (table(spark, base, t).where(own).drop("namespace") for t in ("chunks", "postings", "terms"))
    dead = None
    if row["n_removed"]:
        dead = table(spark, base, "removed").where(own).groupBy("doc_id").agg(F.max("generation").alias("dead_before"))
        dead = materialize(dead, "index-dead")
        chunks = without_dead(chunks, dead, ["doc_id"])
    return Index(namespace, row["kind"], row["n_chunks"], row["n_terms"], chunks.drop("generation"), postings, terms, segments, dead)


def create_or_load(docs: DataFrame, base: str, namespace: str, **options) -> Index:
    """Load the namespace when it exists, build it from ``docs(doc_id, text)`` otherwise."""
    spark = docs.sparkSession
    if not index_exists(spark, base, namespace):
        create_index(docs.withColumn("namespace", F.lit(namespace)), base, **options)
    return load_index(spark, base, namespace)
