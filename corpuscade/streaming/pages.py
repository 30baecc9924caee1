"""A stream of URLs or pages, each let through at its first sight."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuscade.functions.urls import with_normalized_url


def _collapse(urls: DataFrame, event_time: str | None) -> DataFrame:
    """Drop repeats inside each Arrow batch, keeping the earliest time.

    Streaming deduplication sends every row to its key's state partition; this way
    a URL that makes up much of the stream arrives there about once per batch.
    """
    times = [] if event_time is None else [(event_time, "min")]

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by("norm_url").aggregate(times)
            names = ["norm_url"] if event_time is None else ["norm_url", event_time]
            order = ["norm_url", *[f"{t}_min" for t, _ in times]]
            yield from table.select(order).rename_columns(names).to_batches()

    return urls.mapInArrow(collapse, urls.schema)


def first_sights(
    urls: DataFrame,
    url: str = "url",
    base: str | None = None,
    event_time: str | None = None,
    within: str | None = None,
) -> DataFrame:
    """Distinct normalised URLs of a stream.

    Without a watermark every URL is remembered for good, as a crawl's own seen set
    does. With ``event_time`` and ``within`` a repeat is recognised only that long,
    and the state stays bounded.
    """
    normal = with_normalized_url(urls, url, base=base)
    if event_time is None:
        return _collapse(normal.select("norm_url"), None).dropDuplicates(["norm_url"])
    timed = _collapse(normal.select("norm_url", event_time), event_time)
    return timed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["norm_url"])


def first_rows(
    rows: DataFrame, key: str, order: list[str], event_time: str | None = None, within_seconds: int | None = None
) -> DataFrame:
    """The first row of each key of a stream, with all its columns: what came first, and of
    what came together the least in ``order``.

    Each key has a state. Without a watermark it stays for good; with ``event_time`` and
    ``within_seconds`` it goes once the watermark has passed the first row by that long, and the
    key counts as new again. Repeats inside an Arrow batch are dropped before the shuffle.
    """
    schema, sort_by = rows.schema, [(key, "ascending"), *((c, "ascending") for c in order)]

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch]).sort_by(sort_by)
                keys = table[key].combine_chunks()
                new = pa.array([True]) if len(keys) == 1 else pa.concat_arrays([pa.array([True]), pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))])
                yield from table.filter(new).to_batches()

    few = rows.mapInArrow(collapse, schema)
    if event_time is not None:
        few = few.withWatermark(event_time, f"{within_seconds} seconds")

    def first(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            return  # seen: the frames need not be read
        best = pd.concat(list(frames)).sort_values(order, kind="stable").head(1)
        state.update((True,))
        if event_time is not None:
            at = int(best[event_time].iloc[0].timestamp() * 1000) + within_seconds * 1000
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        yield best

    timeout = GroupStateTimeout.NoTimeout if event_time is None else GroupStateTimeout.EventTimeTimeout
    return few.groupBy(key).applyInPandasWithState(first, schema, "seen boolean", "append", timeout)
