"""Where equal windows meet: winnowed anchors, contexts around them, and hot anchors.

A window is ``window`` neighbouring units (bytes or words) of one text. Each window picks
the smallest seed hash in it, so equal windows pick equal anchors, at the same place in
the window. Neighbouring windows with one anchor form a *context*: the units they span,
the number of windows (``live``), and where the anchor is (``pin``). Contexts are
gathered by anchor; equal windows are always gathered together.

An anchor that occurs more than ``hot`` times, in one text or many, is not gathered at once. Equal contexts are first made
one (with map-side partial sums), then the windows are dealt by a longer piece of what they
have in common: windows whose distance to the anchor lies in [a, b] all hold the units
from ``a`` before the anchor to ``window - b`` after it. The range is cut until a
group is small; at the latest, when it is one distance, a group is one window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corpuscade.llm.common import digest, hashed_words, mix, sliced
from corpuscade.session import materialize

_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BLOCK = 1 << 19
#: Bytes of texts that are looked at together.
STEP = 1 << 20
_PLACES = np.uint64((1 << 21) - 1)
CUT = 4

OCCURRENCE = "t1 long, t2 long, ord long, starts binary"
CONTEXT = f"key long, a int, b int, pin int, live int, {OCCURRENCE}, ctx binary"
SPANS = "t1 long, t2 long, spans binary"
#: For the groups of one key: contexts in, for each the windows (from, to) that are repeats.
Finder = Callable[[list[dict]], list[list[tuple[int, int]]]]


@dataclass(frozen=True)
class Spec:
    """``seed`` is a power of two; ``window`` and ``seed`` count units."""

    window: int
    seed: int
    by_words: bool
    hot: int = 1_800

    @property
    def widest(self) -> int:
        """The largest distance from a window's start to its anchor."""
        return self.window - self.seed

    def units(self, text: bytes) -> bytes | list[bytes]:
        return text.split() if self.by_words else text

    def joined(self, units: bytes | list[bytes]) -> bytes:
        return b" ".join(units) if self.by_words else bytes(units)


def text_keys(name: str = "text") -> tuple[Column, Column]:
    """A text's identity: two hashes of its SHA-256 (null: empty)."""
    return F.xxhash64(digest(name), F.lit(1)).alias("t1"), F.xxhash64(digest(name), F.lit(2)).alias("t2")


def seed_hashes(spec: Spec, h: np.ndarray) -> np.ndarray:
    """A hash of each run of ``seed`` units (polynomial, by doubling) from the units' own."""
    length = 1
    while length < spec.seed:
        h = h[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + h[length:]
        length *= 2
    return mix(h)


def unit_hashes(spec: Spec, column: pa.Array) -> Iterator[np.ndarray]:
    """For each text of a binary column a hash of each of its units."""
    if spec.by_words:
        h, sizes = hashed_words(column)
        for end, n in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
            yield h[end - n : end]
    else:
        for text in column:
            yield _BYTES[np.frombuffer(text.as_py(), np.uint8)]


def anchors(spec: Spec, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each run of windows with one anchor."""
    width = spec.widest + 1
    n = len(h) - width + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    picked = np.empty(n, np.int64)
    for at in range(0, n, _BLOCK):
        part = h[at : at + _BLOCK + width - 1]
        # The hash above, the place below: the least is the first of the smallest.
        low = (part & ~_PLACES) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        picked[at : at + len(low)] = (low & _PLACES).astype(np.int64) + at
    first = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    return picked[first], first, np.concatenate([first[1:] - 1, [n - 1]])


def _anchor_rows(texts: DataFrame, spec: Spec) -> DataFrame:
    """(h, t1, t2, n): the anchors of each text, each once, with how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "data", STEP):
            found, times, sizes = [], [], []
            for h in unit_hashes(spec, batch.column("data")):
                h = seed_hashes(spec, h) if len(h) >= spec.window else h[:0]
                own = np.sort(h[anchors(spec, h)[0]].view(np.int64))
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
                found.append(own[first])
                times.append(np.diff(np.append(first, len(own))))
                sizes.append(len(first))
            t1, t2 = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("t1", "t2"))
            n = np.minimum(np.concatenate(times), 1 << 20).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate(found), t1, t2, n)], ["h", "t1", "t2", "n"])

    return texts.mapInArrow(run, "h long, t1 long, t2 long, n int")


def _contexts(spec: Spec, data: bytes, hashes: np.ndarray, wanted: np.ndarray) -> Iterator[tuple]:
    """(anchor hash, pin, live, starts, context) of each different context with a wanted anchor."""
    units = spec.units(data)
    h = seed_hashes(spec, hashes)
    at, first, last = anchors(spec, h)
    own = h[at].view(np.int64)
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(np.isin(own, wanted)).tolist():
        a, b = int(first[i]), int(last[i])
        ctx = spec.joined(units[a : b + spec.window])
        seen.setdefault((int(own[i]), int(at[i]) - a, b - a + 1, ctx), []).append(a)
    for (key, pin, live, ctx), starts in seen.items():
        yield key, pin, live, np.array(starts, "<i4").tobytes(), ctx


def _context_rows(candidates: DataFrame, spec: Spec, wanted: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in sliced(batches, "data", STEP):
            for row, h in zip(batch.to_pylist(), unit_hashes(spec, batch.column("data"))):
                if not row[wanted]:
                    continue
                for key, pin, live, starts, ctx in _contexts(spec, row["data"], h, np.array(row[wanted], np.int64)):
                    rows.append((key, 0, spec.widest, pin, live, row["t1"], row["t2"], row["ord"], starts, ctx))
                    held += len(ctx)
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    return candidates.mapInArrow(run, CONTEXT)


_ARROW = pa.schema([
    ("key", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("pin", pa.int32()), ("live", pa.int32()),
    ("t1", pa.int64()), ("t2", pa.int64()), ("ord", pa.int64()), ("starts", pa.binary()), ("ctx", pa.binary()),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def cut(spec: Spec, row: dict, pieces: int) -> Iterator[dict]:
    """The row's windows dealt over ``pieces`` ranges of distance, keyed by what all windows
    of the range have in common; ``offset`` is a piece's first window in the row."""
    units = spec.units(row["ctx"])
    a, b, pin, live = row["a"], row["b"], row["pin"], row["live"]
    step = -(-(b - a + 1) // pieces)
    for low in range(a, b + 1, step):
        high = min(low + step - 1, b)
        first, last = max(0, pin - high), min(live - 1, pin - low)
        if first <= last:
            common = spec.joined(units[pin - low : pin + spec.window - high])
            yield row | {
                "key": xxhash.xxh3_64_intdigest(common, seed=high - low) - (1 << 63), "a": low, "b": high,
                "pin": pin - first, "live": last - first + 1, "offset": first,
                "ctx": spec.joined(units[first : last + spec.window]),
            }


def _cut_rows(rows: DataFrame, spec: Spec) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for x in cut(spec, row, CUT):
                    starts = np.array([x["offset"]], "<i4").tobytes()
                    out.append((x["key"], x["a"], x["b"], x["pin"], x["live"], x["t1"], x["t2"], x["ord"], starts, x["ctx"]))
            if out:
                yield _batch(out)

    return rows.select(*_ARROW.names).mapInArrow(run, CONTEXT)


def _found(rows: DataFrame, spec: Spec, finder: Finder, chunk: int) -> DataFrame:
    """Spans of units that repeated windows cover, text by text (several rows a text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= chunk and row["key"] != held[-1]["key"]:
                    yield from emit(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["ctx"])
        if held:
            yield from emit(held)

    def emit(held: list[dict]) -> Iterator[pa.RecordBatch]:
        t1, t2, spans = [], [], []
        for row, windows in zip(held, finder(held)):
            if windows:
                each = np.array(windows, np.int64) + [0, spec.window]
                starts = np.frombuffer(row["starts"], "<i4").astype(np.int64)
                t1.append(row["t1"])
                t2.append(row["t2"])
                spans.append((starts[:, None, None] + each[None]).astype("<i4").tobytes())
        columns = [pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(spans, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["t1", "t2", "spans"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "a", "ord")
    return dealt.mapInArrow(run, SPANS)


def merge(blobs: list[bytes]) -> np.ndarray:
    """Sorted, disjoint, not touching spans (from, to exclusive) from packed ones."""
    spans = np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 2).astype(np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    ends = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[first, 0], reach[ends]], 1)


def _resolve(rows: DataFrame, spec: Spec, finder: Finder, chunk: int, whole: Callable, total: Column) -> DataFrame:
    """Spans for contexts whose keys may be hot.

    ``total`` sums up the ``ord`` of equal contexts; ``whole`` says from an occurrence's own
    ``ord`` and that total ("_ord") whether all its windows are repeats already.
    """
    rows = materialize(rows, "contexts")
    counts = rows.groupBy("key", "a").count()
    hot = materialize(counts.where(F.col("count") > spec.hot).select("key", "a"), "hot-keys")
    if hot.isEmpty():
        return _found(rows, spec, finder, chunk)
    calm = _found(rows.join(hot, ["key", "a"], "left_anti"), spec, finder, chunk)
    same = ["key", "a", "b", "pin", "live"]
    busy = rows.join(hot, ["key", "a"], "left_semi").withColumns(
        {"c1": F.xxhash64(*same, "ctx"), "c2": F.xxhash64("ctx", F.lit(2), *same)}
    )
    # Equal contexts become one; it stands for its text (c1, c2) and starts at 0 there.
    once = busy.groupBy(*same, "c1", "c2", "ctx").agg(total.alias("_ord"))
    once = materialize(once.select(*same, F.col("c1").alias("t1"), F.col("c2").alias("t2"), F.col("_ord").alias("ord"), F.lit(b"\0\0\0\0").alias("starts"), "ctx"), "contexts-once")
    inner = _resolve(_cut_rows(once, spec), spec, finder, chunk, whole, total)
    inner = inner.groupBy("t1", "t2").agg(F.collect_list("spans").alias("inner"))
    found = once.select(F.col("t1").alias("c1"), F.col("t2").alias("c2"), F.col("ord").alias("_ord")).join(
        inner.select(F.col("t1").alias("c1"), F.col("t2").alias("c2"), "inner"), ["c1", "c2"], "left"
    )
    back = busy.drop("ctx").join(found, ["c1", "c2"])
    window = spec.window

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, out = [], [], []
            for row in batch.to_pylist():
                spans = np.array([[0, row["live"] + window - 1]]) if row["all"] else merge(row["inner"] or [])
                if len(spans):
                    starts = np.frombuffer(row["starts"], "<i4").astype(np.int64)
                    t1.append(row["t1"])
                    t2.append(row["t2"])
                    out.append((starts[:, None, None] + spans[None]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(out, pa.binary())], ["t1", "t2", "spans"])

    shifted = back.select("t1", "t2", "live", "starts", "inner", whole().alias("all")).mapInArrow(shift, SPANS)
    return calm.unionByName(shifted)


def repeated_spans(
    docs: DataFrame, texts: DataFrame, spec: Spec, finder: Finder, chunk: int,
    flag: Column, whole: Callable[[], Column], total: Column,
) -> DataFrame:
    """(t1, t2, data, blobs): each text with a repeated window, and its packed spans.

    ``docs`` has _id, t1, t2 and data (bytes); ``texts`` has one row for each different text
    (t1, t2, _id of one document that has it, ord). ``flag`` decides from "low" and "high"
    (of t1) and "most" (in one text) whether an anchor is gathered.
    """
    rows = materialize(_anchor_rows(docs.select("t1", "t2", "data"), spec), "anchors")
    each = rows.groupBy("h").agg(
        F.min("t1").alias("low"), F.max("t1").alias("high"), F.max("n").alias("most"), F.sum("n").alias("times")
    )
    shared = each.where(flag).select("h", (F.col("times") > spec.hot).alias("busy"))
    # A common anchor's rows are split over tasks by adaptive execution (no order is asked for here).
    own = rows.select("h", "t1", "t2").join(shared, "h")
    lists = own.groupBy("t1", "t2").agg(
        F.collect_set(F.when(~F.col("busy"), F.col("h"))).alias("calm"),
        F.collect_set(F.when(F.col("busy"), F.col("h"))).alias("hot"),
    )
    # The text comes from one document of those that have it, so a group of copies is one row here.
    wanted = texts.join(lists, ["t1", "t2"])
    candidates = materialize(
        docs.join(wanted, ["_id", "t1", "t2"]).dropDuplicates(["_id", "t1", "t2"]).select("t1", "t2", "ord", "calm", "hot", "data"),
        "candidates",
    )
    spans = _found(_context_rows(candidates, spec, "calm"), spec, finder, chunk)
    busy = candidates.where(F.size("hot") > 0)
    if not busy.isEmpty():
        spans = spans.unionByName(_resolve(_context_rows(busy, spec, "hot"), spec, finder, chunk, whole, total))
    blobs = spans.groupBy("t1", "t2").agg(F.collect_list("spans").alias("blobs"))
    return candidates.select("t1", "t2", "data").join(blobs, ["t1", "t2"])
