"""Repeated strings by a run-length index: a run-compressed Burrows-Wheeler transform.

Repetitive text has few runs of equal symbols in its transform. Only the first suffix of
each run is sampled, with the length it shares with the suffix before it; streaming
through the text from sample to sample gives that length for all positions, since
it falls by one with each step inside a run. Symbols are bytes, or words by their hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscade.llm.common import hashed_words, table
from corpuscade.llm.repeats import Spec, merge, repeated_spans, text_keys
from corpuscade.operators.skew import lookup_join
from corpuscade.session import materialize

WINDOW, SEED = 400, 64
#: Words of a repeated passage, and of its seeds.
PASSAGE, PASSAGE_SEED = 50, 8
#: Occurrences of one anchor that are gathered at once.
HOT = 1_800
#: Bytes of contexts in one index, few enough to stay near the processor; a group of one anchor is
#: never divided.
CHUNK = 128 << 10
END = b"\xff"  # in no UTF-8 text
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order, and (length, ranks by that many symbols) of each round.

    Rounds triple the length that is sorted by (or double it in long texts) and only
    touch suffixes that still tie.
    """
    n = len(text)
    bits = (n + 1).bit_length()
    factor = 3 if 3 * bits <= 63 else 2
    length, key = 1, text
    if text.dtype == np.uint8:  # eight bytes are one number
        symbols = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
        length, key = 8, np.zeros(n, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | symbols[k : k + n]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels = [(length, rank.astype(np.int32))]
    while True:
        tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        if not len(tied):
            return order, levels
        here = order[tied]
        key = rank[here]
        for f in range(1, factor):
            at = here + f * length
            key = (key << bits) | np.where(at < n, rank[np.minimum(at, n - 1)] + 1, 0)
        by = np.argsort(key)
        here, key = here[by], key[by]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        order[tied], new[tied] = here, first
        rank[here] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        length *= factor
        levels.append((length, rank.astype(np.int32)))


class RunIndex:
    """Runs of the transform of a text, with samples at the ends of the runs."""

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        self.order, self._levels = suffix_order(text)
        before = text[self.order - 1]
        head = np.concatenate([[True], before[1:] != before[:-1]])
        head |= (self.order == 0) | np.concatenate([[False], self.order[:-1] == 0])  # the text is no circle
        at = np.flatnonzero(head)
        self.symbols = before[at]
        self.lengths = np.diff(np.concatenate([at, [n]]))
        self.firsts = self.order[at]  # the first suffix of each run,
        self.lasts = self.order[at - 1]  # and the last of the run before it
        self.shared = self._shared(self.firsts[1:], self.lasts[1:])

    def _shared(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at ``p`` and ``q``."""
        n, common = len(self.text), np.zeros(len(p), np.int64)
        for length, rank in reversed(self._levels):
            for _ in range(2):
                a, b = p + common, q + common
                inside = (a < n) & (b < n)
                same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
                common += length * same
        for _ in range(self._levels[0][0] - 1):
            a, b = p + common, q + common
            inside = (a < n) & (b < n)
            common += inside & (self.text[np.minimum(a, n - 1)] == self.text[np.minimum(b, n - 1)])
        return common

    def statistics(self) -> np.ndarray:
        """For each text position, what its suffix shares with the one before it in order."""
        n = len(self.text)
        known, sampled = np.zeros(n, np.int64), np.zeros(n, bool)
        sampled[self.firsts] = True
        known[self.firsts[1:]] = self.shared
        sampled[0] = True  # a first of a run in any case
        last = np.maximum.accumulate(np.where(sampled, np.arange(n), 0))
        return np.maximum(known[last] - (np.arange(n) - last), 0)


def symbols(contexts: list[bytes], by_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The contexts as one text, a mark after each, and where each begins."""
    if not by_words:
        return np.frombuffer(END.join(contexts) + END, np.uint8), np.cumsum([0, *(len(c) + 1 for c in contexts[:-1])])
    h, sizes = hashed_words(pa.array(contexts, pa.binary()))
    ends = np.cumsum(sizes)
    return np.insert(h, ends, np.uint64(0)), ends - sizes + np.arange(len(sizes))


def repeated_windows(
    contexts: list[bytes], live: list[int], weights: list[int], window: int = WINDOW,
    by_words: bool = False, keep_first: bool = False,
) -> list[list[tuple[int, int]]]:
    """Ranges (from, to) of the live windows of each context that occur twice or more.

    A window counts as often as its context's weight. With ``keep_first`` a weight is a rank
    instead, and a window is a repeat if a context of a lower rank has it. Only the first
    ``live`` positions of a context are windows; the rest is there to complete the last of them.
    """
    text, begins = symbols(contexts, by_words)
    index = RunIndex(text)
    apart = index.statistics()[index.order] < window
    apart[0] = True
    group = np.empty(len(index.order), np.int64)
    group[index.order] = np.cumsum(apart) - 1  # suffixes that share a whole window
    at = np.concatenate([np.arange(b, b + n) for b, n in zip(begins, live)])
    own = np.repeat(np.array(weights, np.int64), live)
    if keep_first:
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group[at], own)
        again = least[group[at]] < own
    else:
        again = np.bincount(group[at], own)[group[at]] > 1
    out, done = [], 0
    for n in live:
        edges = np.diff(np.concatenate([[0], again[done : done + n].astype(np.int8), [0]]))
        out.append(list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist())))
        done += n
    return out


def find(rows: list[dict], spec: Spec, keep_first: bool = False) -> list[list[tuple[int, int]]]:
    """Repeated windows of contexts gathered by anchor; equal contexts are indexed once."""
    slots: dict[tuple, int] = {}
    weights: list[int] = []
    for row in rows:
        slot = slots.setdefault((row["ctx"], row["live"], row["pin"]), len(slots))
        if slot == len(weights):
            weights.append(row["ord"] if keep_first else 0)
        if keep_first:
            weights[slot] = min(weights[slot], row["ord"])
        else:
            weights[slot] += row["ord"] * (len(row["starts"]) // 4)
    keys = list(slots)
    found = repeated_windows([k[0] for k in keys], [k[1] for k in keys], weights, spec.window, spec.by_words, keep_first)
    out = []
    for row in rows:
        slot = slots[row["ctx"], row["live"], row["pin"]]
        later = keep_first and row["ord"] > weights[slot]
        out.append([(0, row["live"] - 1)] if later else found[slot])
    return out


def _identified(docs: DataFrame) -> DataFrame:
    """_id (as text; null: empty), t1, t2 and data, the UTF-8 bytes (null: none)."""
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("data")
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), *text_keys(), data)


def different_texts(docs: DataFrame) -> DataFrame:
    """(t1, t2, _id, ord): each text once, an id that has it, and its number of rows."""
    return _identified(docs).groupBy("t1", "t2").agg(F.min("_id").alias("_id"), F.count("*").alias("ord"))


def repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, texts: DataFrame | None = None) -> DataFrame:
    """(t1, t2, spans, kept): texts that hold a string of ``window`` bytes which also starts
    elsewhere; ``spans`` are the maximal runs of bytes so covered, ``kept`` the rest.

    Each different text is looked at once, but counts as often as it occurs. Texts that are
    repeated as a whole need no index to see it: see ``removed``.
    """
    spec = Spec(window, SEED, by_words=False, hot=hot)
    texts = different_texts(docs) if texts is None else texts
    found = repeated_spans(
        _identified(docs), texts, spec, partial(find, spec=spec), CHUNK,
        flag=(F.col("low") != F.col("high")) | (F.col("most") > 1),
        whole=lambda: F.col("_ord") > 1,
        total=F.sum(F.col("ord") * F.floor(F.octet_length("starts") / 4)),
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, all_spans, kept = [], [], [], []
            for row in batch.to_pylist():
                spans = merge(row["blobs"])
                cuts = [0, *spans.ravel().tolist(), len(row["data"])]
                t1.append(row["t1"])
                t2.append(row["t2"])
                all_spans.append(spans.tolist())
                kept.append(b"".join(row["data"][a:b] for a, b in zip(cuts[::2], cuts[1::2])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(all_spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                ["t1", "t2", "spans", "kept"],
            )

    return found.mapInArrow(finish, "t1 long, t2 long, spans array<array<long>>, kept binary")


def removed(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """For each row: doc_id, t1, t2, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``,
    the remaining bytes where some but not all are gone (else null).

    Every byte goes that lies in a string of ``window`` bytes which also starts anywhere
    else in the table. Null and empty texts have no bytes. Repeated rows are repeats of each
    other. An empty table gives an empty table; other columns are not looked at.
    """
    sha = F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256).alias("sha")
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes")
    narrow = materialize(docs.select("doc_id", *text_keys(), size, sha), "texts")
    named = narrow.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "t1", "t2")
    texts = materialize(named.groupBy("t1", "t2").agg(F.min("_id").alias("_id"), F.count("*").alias("ord")), "different")
    found = repeats(docs, window, hot, texts).select(
        "t1", "t2", F.size("spans").alias("spans"), "kept", F.octet_length("kept").alias("rest")
    )
    # One narrow row for each different text, so a group of copies is joined by adaptive splits.
    known = texts.select("t1", "t2", (F.col("ord") > 1).alias("copied")).join(found, ["t1", "t2"], "left")
    whole = F.col("copied") & (F.col("n_bytes") >= window)
    gone = F.when(whole, F.col("n_bytes")).otherwise(F.coalesce(F.col("n_bytes") - F.col("rest"), F.lit(0)))
    return narrow.join(known, ["t1", "t2"]).select(
        "doc_id", "t1", "t2", "n_bytes", gone.cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce(F.sha2("kept", 256), "sha")).alias("kept_sha256"),
        F.when(~whole, F.col("kept")).alias("kept"),
    )


def passages(docs: DataFrame, texts: DataFrame, window: int = PASSAGE, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """(t1, t2, words, kept): texts that hold ``window`` consecutive words which also start in a
    document with a smaller doc_id; how many words such windows cover, and, if asked for, the text
    without.

    ``texts``: t1, t2, and ``_id`` and ``ord``, the least doc_id that has the text.
    """
    spec = Spec(window, PASSAGE_SEED, by_words=True, hot=hot)
    own = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("_id"), *text_keys(), F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("data")
    )
    found = repeated_spans(
        own, texts, spec, partial(find, spec=spec, keep_first=True), CHUNK >> 1,
        flag=F.col("low") != F.col("high"), whole=lambda: F.col("ord") > F.col("_ord"), total=F.min("ord"),
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                spans, kept = merge(row["blobs"]), None
                if with_text:
                    # What goes is cut from its first word to where the next one that stays begins.
                    begins = [m.start() for m in WORD.finditer(row["data"])] + [len(row["data"])]
                    cuts = [0, *(begins[i] for i in spans.ravel().tolist()), len(row["data"])]
                    kept = b"".join(row["data"][a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                rows.append((row["t1"], row["t2"], int((spans[:, 1] - spans[:, 0]).sum()), kept))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["t1", "t2", "words", "kept"])

    read = found if with_text else found.select("t1", "t2", F.lit(None).cast("binary").alias("data"), "blobs")
    return read.mapInArrow(finish, "t1 long, t2 long, words long, kept binary")


def first_texts(keyed: DataFrame) -> DataFrame:
    """(t1, t2, _id, ord, copies) of ``keyed(doc_id, t1, t2)``: each text of a row with a doc_id, the
    least doc_id that has it, and how many rows do."""
    own = keyed.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), "t1", "t2")
    found = own.groupBy("t1", "t2").agg(F.min("_id").alias("_id"), F.count("*").alias("copies"))
    return found.withColumn("ord", F.col("_id"))


def cleaned(docs: DataFrame, window: int = PASSAGE) -> DataFrame:
    """``docs`` without the passages that a document with a smaller doc_id has, too: the words
    of every ``window`` consecutive words that also start there go from ``text`` (and ``n_chars``,
    if there, is set anew), so of each passage one copy stays.

    Every row stays, if need be with an empty text; a text without repeats stays as it is,
    null included. Rows without a doc_id stay as they are and take nothing away.
    """
    texts = materialize(first_texts(docs.select("doc_id", *text_keys())), "different")
    found = passages(docs, texts, window)
    known = texts.select("t1", "t2", F.col("ord").alias("_first")).join(found.select("t1", "t2", "kept"), ["t1", "t2"], "left")
    known = known.withColumnsRenamed({"t1": "_t1", "t2": "_t2", "kept": "_kept"})
    t1, t2 = text_keys()
    rows = docs.withColumns({"_u1": t1, "_u2": t2})
    met = rows.join(known, (F.col("_u1") == F.col("_t1")) & (F.col("_u2") == F.col("_t2")) & F.col("doc_id").isNotNull(), "left")
    # A later document with the whole text loses all of it, if it is long enough to hold a window.
    later = (F.col("doc_id") > F.col("_first")) & (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= window)
    text = F.when(later, F.lit("")).otherwise(F.coalesce(F.when(F.col("doc_id") == F.col("_first"), F.col("_kept").cast("string")), F.col("text")))
    out = met.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the bytes that ``removed`` counts (and ``n_chars``, if there, set anew).

    What a cut leaves of a character is dropped with it. Every row stays, if need be with
    an empty text; a text without repeats stays as it is, null included.
    """
    texts = materialize(different_texts(docs), "different")
    found = repeats(docs, window, texts=texts).select("t1", "t2", "kept")
    known = texts.select("t1", "t2", (F.col("ord") > 1).alias("_copied")).join(found, ["t1", "t2"], "left")
    known = known.where("_copied or kept is not null").withColumnsRenamed({"t1": "_t1", "t2": "_t2", "kept": "_kept"})
    t1, t2 = text_keys()
    rows = docs.withColumns({"_u1": t1, "_u2": t2})
    met = rows.join(known, (F.col("_u1") == F.col("_t1")) & (F.col("_u2") == F.col("_t2")), "left")
    whole = F.coalesce(F.col("_copied"), F.lit(False)) & (F.octet_length("text") >= window)
    text = F.when(whole, F.lit("")).otherwise(F.coalesce(_valid(F.col("_kept")), F.col("text")))
    out = met.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _valid(data):
    """Bytes as text, without what is not UTF-8."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))


def repeated_words(docs: DataFrame, window: int = PASSAGE, keyed: DataFrame | None = None) -> DataFrame:
    """(doc_id, t1, t2, n_repeated_words): words in passages that a document with a smaller doc_id has, too.

    ``keyed`` (doc_id, t1, t2), if at hand, saves a reading of the texts.
    """
    keyed = docs.select("doc_id", *text_keys()) if keyed is None else keyed.select("doc_id", "t1", "t2")
    texts = materialize(first_texts(keyed), "different")
    found = passages(docs, texts, window, with_text=False).select("t1", "t2", "words")
    # Only of texts that stand in several rows is the number of words asked for.
    copied = lookup_join(docs.select(F.col("doc_id").cast("long").alias("_id"), *text_keys(), "text"), texts.where("copies > 1").select("_id", "t1", "t2"), ["_id", "t1", "t2"])
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sizes = copied.select("t1", "t2", size.alias("size")).dropDuplicates(["t1", "t2"])
    known = texts.select("t1", "t2", "ord").join(found, ["t1", "t2"], "left").join(sizes, ["t1", "t2"], "left")
    rows = keyed.join(known, ["t1", "t2"], "left")
    later = (F.col("doc_id") > F.col("ord")) & (F.col("size") >= window)
    first = F.when(F.col("doc_id") == F.col("ord"), F.coalesce("words", F.lit(0)))
    gone = F.when(later, F.col("size")).otherwise(F.coalesce(first, F.lit(0))).cast("long")
    return rows.select("doc_id", "t1", "t2", gone.alias("n_repeated_words"))


def op4_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that also start elsewhere, as asked; and, by the same index over words, how many words
    of each document lie in passages of 50 words that an earlier document has."""
    docs = table(spark, sf_dir, "documents")
    found = materialize(removed(docs).select("doc_id", "t1", "t2", "n_bytes", "n_removed", "n_spans", "kept_sha256"), "without")
    # Rows that agree in id and text agree in both results, so each joins with one of them.
    key = ["doc_id", "t1", "t2"]
    said = repeated_words(docs, keyed=found).groupBy(*key).agg(F.max("n_repeated_words").alias("n_repeated_words"))
    met = found.join(said.withColumnsRenamed({c: f"_{c}" for c in key}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left")
    return met.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words")
