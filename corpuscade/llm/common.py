"""What the operators share: words, digests, and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def digest(name: str = "text") -> Column:
    """The whole SHA-256 of a text (null: empty), as bytes: two texts are one if it agrees."""
    return F.unhex(F.sha2(F.encode(text_or_empty(name), "UTF-8"), 256))


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode().split() if text else []


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


#: Punctuation that plain words do not have at their edges.
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_~`+=/\\"


class PlainWords(WordHashes):
    """Hashes of words in lower case without punctuation at the edges."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        plain = word.decode("utf-8", "replace").lower().strip(EDGES) or "\0"
        value = self[word] = xxhash.xxh3_64_intdigest(plain.encode())
        return value


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser that loses nothing)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` neighbouring hashes; order matters."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = mix(hashes[:size] + _ODD)
    for k in range(1, n):
        out = mix(out * _ODD + hashes[k : k + size])
    return out


def per_batch(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, object] | None]],
) -> DataFrame:
    """``mapInArrow`` with state per task: ``make`` returns the batch function."""
    spark_schema = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, step = to_arrow_schema(spark_schema), make()
        for batch in batches:
            columns = step(batch)
            if columns is not None:
                arrays = [
                    pa.array(columns[f.name], type=f.type, from_pandas=False) for f in arrow
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, spark_schema)


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        size = max(batch.column(column).nbytes, 1)
        rows = max(1, int(batch.num_rows * limit / size))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Keeps the first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG_WORD = 256


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a string column, one after the other, and how many
    words each text has (null: none). Reads eight bytes of all words at a time."""
    n, at = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int32)[at : at + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.zeros(offsets[-1] - offsets[0] + 8, np.uint8)  # eight more, to read beyond the end
    if raw is not None and len(data) > 8:
        data[:-8] = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    word = ~_IS_SPACE[data[:-8]]
    edge = np.zeros(len(word) + 1, bool)  # texts do not run into each other
    edge[offsets] = True
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1] | edge[1:-1]
    closes[:-1] &= ~word[1:] | edge[1:-1]
    begin = np.flatnonzero(opens)
    size = np.flatnonzero(closes) + 1 - begin
    eight = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    h = mix(size.astype(np.uint64) * _ODD ^ (eight[begin] & _FIRST[size.clip(max=8)]))
    k, more = 8, np.flatnonzero((size > 8) & (size <= _LONG_WORD))
    while len(more):
        part = eight[begin[more] + k] & _FIRST[(size[more] - k).clip(max=8)]
        h[more] = mix(h[more] * _ODD ^ part)
        k += 8
        more = more[size[more] > k]
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : begin[i] + size[i]].tobytes())
    return h, np.diff(np.searchsorted(begin, offsets))
