"""Quality rules on tokeniser fertility.

A public vocabulary with byte fallback tokenises each word. Text of a language it knows
has many characters per token, nearly no byte pieces and a spread-out distribution of
tokens; junk falls out of the band of its script.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscade.llm.common import per_batch, table, words
from corpuscade.session import materialize

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = b"#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: First code points of blocks, and the script each block counts as.
BLOCKS = {
    0x0000: "latin", 0x0370: "greek", 0x0400: "cyrillic", 0x0530: "other", 0x0600: "arabic",
    0x0780: "other", 0x1E00: "latin", 0x1F00: "greek", 0x2000: "latin", 0x2E80: "han",
    0xA000: "other", 0xAC00: "han", 0xD7B0: "other", 0xF900: "han", 0xFB00: "other", 0x20000: "han",
    0x32000: "other",
}
#: Per script: least and most characters per token, most share of byte pieces, least token
#: entropy in bits.
BANDS = {
    "latin": (1.3, 8.0, 0.10, 4.0),
    "greek": (0.7, 8.0, 0.20, 3.5),
    "cyrillic": (0.9, 8.0, 0.15, 4.0),
    "arabic": (0.6, 8.0, 0.25, 3.5),
    "han": (0.25, 4.0, 0.80, 4.0),
    "other": (0.15, 8.0, 1.00, 3.0),
}
#: The band of a language reaches so many standard deviations (by its quartiles) from its
#: median of characters per token, and this share of the median at least.
DEVIATIONS, LEAST_REACH = 6.0, 0.05
#: Steps a character per token is told apart by when quartiles are taken.
STEPS = 2000
MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, script string, n_tokens bigint, chars_per_token double, byte_share double, "
    "entropy double, kept boolean"
)
_STARTS = np.array(sorted(BLOCKS))
_SCRIPTS = sorted(set(BLOCKS.values()))
_OF_BLOCK = np.array([_SCRIPTS.index(BLOCKS[s]) for s in sorted(BLOCKS)])


def script_of(text: str) -> str:
    """The script of most of the code points over U+0040; latin where there are none."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    points = points[points > 0x40]
    if not len(points):
        return "latin"
    blocks = np.searchsorted(_STARTS, points, "right") - 1
    return _SCRIPTS[int(np.bincount(_OF_BLOCK[blocks]).argmax())]


class WordPieces(dict):
    """Word to a number; ``pieces`` holds the token ids of each numbered word."""

    def __init__(self, model: bytes, limit: int = 400_000):
        import sentencepiece

        super().__init__()
        self.limit, self.pieces, self._new = limit, [], []
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self._model.get_piece_size()
        self.is_byte = np.array([self._model.is_byte(i) for i in range(size)])

    def __missing__(self, word: bytes) -> int:
        self._new.append(word)
        number = self[word] = len(self)
        return number

    def number(self, found: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
            self.pieces.clear()
        numbers = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        if self._new:
            ids = self._model.encode([w.decode("utf-8", "replace") for w in self._new], num_threads=1)
            self.pieces += [np.array(i, "<u4").tobytes() for i in ids]
            self._new.clear()
        return numbers


def repeated_words(numbers: np.ndarray) -> int:
    """Words in runs of three that occur twice or more in the text."""
    if len(numbers) < 3:
        return 0
    _, word = np.unique(numbers, return_inverse=True)
    n = int(word.max()) + 1
    _, pair = np.unique(word[:-1] * n + word[1:], return_inverse=True)
    _, which, times = np.unique(pair[:-1] * n + word[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(numbers), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def measure(text: str | None, pieces: WordPieces, bands: dict[str, tuple]) -> tuple:
    """All measures and both verdicts of one text, in the order of ``MEASURES``."""
    text = text or ""
    found = words(text)
    numbers, data = pieces.number(found), text.encode()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(data.count(c) for c in SYMBOLS)
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = repeated_words(numbers)
    failed = len(found) < MIN_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * len(found)
    tokens = np.frombuffer(b"".join(map(pieces.pieces.__getitem__, numbers.tolist())), "<u4")
    script = script_of(text)
    per_token = bytes_ = entropy = None
    kept = not failed
    if len(tokens):
        times = np.bincount(tokens)
        share = times[times > 0] / len(tokens)
        per_token, bytes_ = chars / len(tokens), float(pieces.is_byte[tokens].mean())
        entropy = float(-(share * np.log2(share)).sum())
        low, high, byte_most, entropy_least = bands.get(script, bands["other"])
        kept &= low <= per_token <= high and bytes_ <= byte_most and entropy >= entropy_least
    return (len(found), chars, symbols, len(lines) - len(set(lines)), repeated, failed, script,
            len(tokens), per_token, bytes_, entropy, kept)


def measures(docs: DataFrame, bands: dict[str, tuple] = BANDS, path: str | None = None) -> DataFrame:
    """Measures and the verdict by script of each document, in one pass without a shuffle.

    Returns doc_id, lang and the columns of ``MEASURES``.

    Null and empty texts have no words, fail the base rules and have null ratios. Rows are
    judged one by one, so repeated rows come out alike. A whole text is held, never more
    than an Arrow batch. Other columns are not looked at.
    """
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())  # 0.5 MB

    def make() -> Callable[[pa.RecordBatch], dict]:
        pieces = WordPieces(model.value)
        names = [field.split()[0] for field in MEASURES.split(", ")]

        def step(batch: pa.RecordBatch) -> dict:
            rows = [measure(t.as_py(), pieces, bands) for t in batch.column("text")]
            columns = zip(*rows) if rows else [()] * len(names)
            kept = {c: batch.column(c) for c in ("doc_id", "lang")}
            return {**kept, **dict(zip(names, map(list, columns)))}

        return step

    kept = docs.select("doc_id", "lang", "text")
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.drop("text").dtypes)
    return per_batch(kept, f"{schema}, {MEASURES}", make)


def language_bands(measured: DataFrame) -> DataFrame:
    """Least and most characters per token of each language: (lang, low, high).

    From all documents that pass the base rules. Values are counted by steps first, so a
    language with most of the rows is only thousands of counts when its quartiles are taken.
    """
    step = F.round(F.col("chars_per_token") * STEPS).cast("long")
    counts = measured.where("not base_failed and n_tokens > 0").groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"))
    found = counts.groupBy("lang").agg(F.percentile("step", [0.25, 0.5, 0.75], F.col("n")).alias("q"))
    middle = F.col("q")[1]
    reach = F.greatest(DEVIATIONS * (F.col("q")[2] - F.col("q")[0]) / 1.349, LEAST_REACH * middle)
    return found.select("lang", ((middle - reach) / STEPS).alias("low"), ((middle + reach) / STEPS).alias("high"))


def fertility(docs: DataFrame, bands: dict[str, tuple] = BANDS, path: str | None = None) -> DataFrame:
    """``measures`` with the verdict by language added to that by script.

    A document is kept if it passes the base rules, the band of its script, and the band
    of characters per token of its language (null: a language of its own).
    """
    measured = materialize(measures(docs, bands, path), "fertility")
    found = language_bands(measured).withColumnRenamed("lang", "_lang")
    # One row for each language: adaptive execution broadcasts it by its real size.
    joined = measured.join(found, measured["lang"].eqNullSafe(found["_lang"]), "left")
    inside = F.coalesce(F.col("chars_per_token").between(F.col("low"), F.col("high")), F.lit(False))
    return joined.withColumn("kept", F.col("kept") & inside).drop("_lang", "low", "high")


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility(table(spark, sf_dir, "documents")).drop("lang")
