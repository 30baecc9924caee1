"""Byte-level BPE: encode whole texts, give token offsets, decode ids.

The merges come from a public rank file. The ``tokenizers`` library works on characters,
so every byte stands for one printable character while merges are applied; the table
for that and its inverse are built here from their rule.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import models

from corpuscade.llm.common import table, text_or_empty

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pieces a task remembers; beyond that it forgets them all and goes on.
REMEMBERED = 300_000
#: Characters of a piece that is still worth remembering.
LONGEST_REMEMBERED = 64


def byte_characters() -> list[str]:
    """The character that stands for each byte.

    Printable Latin-1 bytes stand for themselves, the others for the characters from
    U+0100 on, in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def read_ranks(content: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes ``token``: what lower ranks leave of it."""
    parts, own = [bytes([b]) for b in token], ranks[token]
    while len(parts) > 2:
        joined = [ranks.get(a + b, own) for a, b in zip(parts, parts[1:])]
        at = min(range(len(joined)), key=joined.__getitem__)
        if joined[at] >= own:
            raise ValueError(f"no merge leads to {token!r}")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, content: bytes, pattern: str):
        ranks = read_ranks(content)
        self._characters = dict(enumerate(byte_characters()))  # for str.translate of Latin-1
        back = {c: b for b, c in self._characters.items()}
        shown = {rank: self._shown(token) for token, rank in ranks.items()}
        pairs = sorted((rank, halves(t, ranks)) for t, rank in ranks.items() if len(t) > 1)
        self._model = models.BPE(
            vocab={s: rank for rank, s in shown.items()},
            merges=[(self._shown(a), self._shown(b)) for _, (a, b) in pairs],
            ignore_merges=True,
        )
        self._pieces = regex.compile(pattern).findall
        # Decoding reverses the byte table on the vocabulary as the model holds it.
        self.tokens = [b""] * (max(shown) + 1)
        for rank, text in shown.items():
            self.tokens[rank] = bytes(back[c] for c in text)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self._known: dict[str, bytes] = {}

    def _shown(self, token: bytes) -> str:
        return token.decode("latin-1").translate(self._characters)

    def _fresh(self, piece: str) -> bytes:
        found = self._model.tokenize(self._shown(piece.encode()))
        return np.array([t.id for t in found], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of the text (null: none) as little-endian unsigned 32-bit integers."""
        pieces, known = self._pieces(text or ""), self._known
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = self._fresh(piece)
                if len(piece) <= LONGEST_REMEMBERED:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes are joined before they become characters, so a character
        that several tokens share comes out whole, and a half one as U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) character that each token has bytes of.

        Tokens that share a character both count it.
        """
        ends = np.cumsum(self.lengths[ids])
        data = np.frombuffer(self.decode_bytes(ids), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1  # which character each byte is of
        return character[ends - self.lengths[ids]], character[ends - 1] + 1


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """One codec for each worker process."""
    key = (hash(content), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(content, pattern)
    return _CODECS[key]


def vocabulary(spark: SparkSession, path: str | None = None):
    """The rank file, broadcast (under 1 MB), and the pattern of its pieces."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return spark.sparkContext.broadcast(file.read()), public_tokenizers.PATTERN


def _mapped(df: DataFrame, added: dict[str, str], step: Callable, path: str | None) -> DataFrame:
    """``df`` with the columns ``added`` (replacing such columns), made batch by batch."""
    content, pattern = vocabulary(df.sparkSession, path)
    kept = [c for c in df.columns if c not in added]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.select(*kept).dtypes), *(f"`{n}` {t}" for n, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(content.value, pattern)
        for batch in batches:
            new = step(coder, batch)
            names = [*kept, *added]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(new[c] for c in added)], names)

    return df.mapInArrow(run, schema)


def _id_lists(packed: list[bytes]) -> pa.Array:
    flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(df: DataFrame, column: str = "text", path: str | None = None) -> DataFrame:
    """Add ``ids``, and ``starts`` and ``ends``: the characters of each token.

    Null and empty texts give empty lists. All rows stay; columns of those three
    names are replaced. Row by row: repeated rows come out alike.
    """

    def step(coder: Codec, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        packed, starts, ends = [], [], []
        for text in batch.column(column).to_pylist():
            packed.append(coder.encode(text))
            first, last = coder.offsets(np.frombuffer(packed[-1], "<u4"))
            starts.append(first.astype("<u4").tobytes())
            ends.append(last.astype("<u4").tobytes())
        return {"ids": _id_lists(packed), "starts": _id_lists(starts), "ends": _id_lists(ends)}

    lists = {"ids": "array<int>", "starts": "array<int>", "ends": "array<int>"}
    return _mapped(df, lists, step, path)


def decode(df: DataFrame, column: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``decoded``, the text of the ids; null lists give null."""

    def step(coder: Codec, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [
            None if ids is None else coder.decode(np.array(ids, np.int64))
            for ids in batch.column(column).to_pylist()
        ]
        return {"decoded": pa.array(texts, pa.string())}

    return _mapped(df, {"decoded": "string"}, step, path)


def digests(df: DataFrame, column: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encode, then decode the ids.

    Like ``encode`` and ``decode`` in one pass, without offsets, and with ``ids`` only
    if ``keep_ids`` asks for them.
    """

    def step(coder: Codec, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        counts, encoded, decoded, all_ids = [], [], [], []
        for text in batch.column(column):
            packed = coder.encode(text.as_py())
            if keep_ids:
                all_ids.append(packed)
            ids = np.frombuffer(packed, "<u4")
            counts.append(len(ids))
            encoded.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
        out = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(encoded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
        return out | ({"ids": _id_lists(all_ids)} if keep_ids else {})

    added = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if keep_ids else {})
    return _mapped(df, added, step, path)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    return digests(docs).drop("text")
