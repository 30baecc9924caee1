"""Vector bin packing: examples into sequences under several limits at once.

An example asks for tokens, for one segment, and for loss-bearing tokens; a sequence has a
limit for each. The dot-product heuristic takes, of the examples that still fit, the one
whose demands point most the way the room left does: the largest sum of room times demand,
both as shares of the limits.

Each task packs the examples it reads, with a bounded reserve to choose from, so tokens are
never shuffled; a sequence's number is its task's, shifted, plus a counter.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from corpuscade.llm.bpe import byte_characters
from corpuscade.llm.common import sliced, table

VOCABULARY = "byte_bpe_50k.json"
#: What a sequence holds: tokens, segments, loss-bearing tokens.
TOKENS, SEGMENTS, LOSS = 1024, 64, 1023
#: Tokens of examples that a task has to choose from while it reads.
RESERVE = 1 << 19
#: Bytes of texts that are encoded together.
STEP = 2 << 20
#: The bytes of printable ASCII, Latin letters (U+00C0 to U+027F), spaces and line breaks.
PLAIN = bytes([0x0A, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
#: A run of so much white space is left to the tokenizer, too.
LONG_SPACE = 256
_SHIFT = 33


class Encoder:
    """Ids of whole texts by a vocabulary file of the ``tokenizers`` library.

    Texts of plain characters go through the tiktoken library with the same vocabulary as
    ranks, which gives the same ids several times faster; for all others, where
    the two may differ in the age of their Unicode tables, the tokenizer itself is asked.
    """

    def __init__(self, content: str, pattern: str):
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        own = {character: byte for byte, character in enumerate(byte_characters())}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        special = {token.content for token in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(own[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not text.encode().translate(None, PLAIN) and " " * LONG_SPACE not in text and "\n" * LONG_SPACE not in text:
            return np.asarray(self.plain.encode_to_numpy(text, disallowed_special=()), "<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_of(content: str, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary: it serves all tasks that run there."""
    if (content, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[content, pattern] = Encoder(content, pattern)
    return _ENCODERS[content, pattern]


@dataclass
class Piece:
    """A run of one example: where it starts there, its tokens and its loss-bearing ones."""

    example: object
    start: int
    tokens: int
    loss: int


@dataclass(frozen=True)
class Limits:
    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss: int = LOSS


class Packer:
    """Sequences from pieces. With ``cuts``, pieces are cut freely, and each token of a piece
    but its first bears loss; without, a piece stays whole and has its own number of them."""

    def __init__(self, limits: Limits, cuts: bool):
        self.limits, self.cuts = limits, cuts
        self._whole = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.waiting: dict[tuple[int, int], deque[Piece]] = {}
        self.held = 0
        self._lay_out()

    def _lay_out(self) -> None:
        """Number the shapes that wait: their demands, as shares too, and whether any piece has them."""
        self._shapes = sorted(self.waiting)
        self._number = {shape: i for i, shape in enumerate(self._shapes)}
        size = 2 * len(self._shapes) + 64
        self._demand, self._open = np.zeros((size, 3), np.int64), np.zeros(size, bool)
        for i, (tokens, loss) in enumerate(self._shapes):
            self._demand[i] = tokens, 1, loss
            self._open[i] = True
        self._share = self._demand / self._whole

    def add(self, piece: Piece, front: bool = False) -> None:
        shape = (piece.tokens, piece.loss)
        queue = self.waiting.setdefault(shape, deque())
        queue.appendleft(piece) if front else queue.append(piece)
        self.held += max(piece.tokens, 1)
        if len(queue) > 1:
            return
        if shape not in self._number:
            if len(self._shapes) == len(self._open):
                return self._lay_out()
            i = self._number[shape] = len(self._shapes)
            self._shapes.append(shape)
            self._demand[i] = piece.tokens, 1, piece.loss
            self._share[i] = self._demand[i] / self._whole
        self._open[self._number[shape]] = True

    def _take(self, shape: tuple[int, int]) -> Piece:
        queue = self.waiting[shape]
        piece = queue.popleft()
        if not queue:
            del self.waiting[shape]
            self._open[self._number[shape]] = False
        self.held -= max(piece.tokens, 1)
        return piece

    def _choose(self, room: np.ndarray) -> tuple[int, int] | None:
        """The waiting shape with the largest dot product with the room, of those that fit."""
        fits = self._open & (self._demand[:, 0] <= room[0]) & (self._demand[:, 2] <= room[2])
        which = np.flatnonzero(fits)
        if not len(which):
            return None
        return self._shapes[which[(self._share[which] @ (room / self._whole)).argmax()]]

    def _cut(self, piece: Piece, tokens: int) -> Piece:
        """The first tokens of a piece; the rest waits again."""
        self.add(Piece(piece.example, piece.start + tokens, piece.tokens - tokens, piece.tokens - tokens - 1), front=True)
        return Piece(piece.example, piece.start, tokens, tokens - 1)

    def sequence(self) -> list[Piece]:
        """The next sequence. Only one that cannot be filled is shorter than the limit; with
        cuts it then ends at a power of two, and what lies beyond waits again."""
        room = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.int64)
        out: list[Piece] = []
        while self.waiting and room[0] and room[1]:
            shape = self._choose(room)
            if shape is None:
                if not self.cuts:
                    break
                # Nothing fits whole: the largest piece fills the room up.
                size = int(min(room[0], room[2] + 1))
                out.append(self._cut(self._take(max(self.waiting)), size))
            else:
                out.append(self._take(shape))
            room -= [out[-1].tokens, 1, out[-1].loss]
        filled = self.limits.tokens - int(room[0])
        if self.cuts and room[0] and filled & (filled - 1):
            over = filled - (1 << filled.bit_length() - 1)
            while over:
                last = out.pop()
                if last.tokens <= over:
                    self.add(last, front=True)
                else:
                    out.append(self._cut(last, last.tokens - over))
                over -= min(over, last.tokens)
        return out


PIECES = (
    "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, segment int"
)


def pack_documents(
    docs: DataFrame, vocabulary: str, pattern: str, limits: Limits = Limits(), reserve: int = RESERVE,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of the documents' ids, a closing id 0 each, placed in sequences.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, segment (from 0 in its
    sequence) and, if asked for, ids (little-endian, 32 bits). A null text is an empty one: its only id
    is the closing one. Every row is a document of its own, whatever its doc_id; an empty
    table gives an empty table; other columns are not looked at. A text of any length is
    cut into as many pieces as it needs. ``vocabulary`` is the path of a byte-level
    tokenizer file, ``pattern`` what splits text before its merges.
    """
    with open(vocabulary, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())  # 2 MB
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    schema = docs.sparkSession.createDataFrame([], PIECES.format(kind=kind) + ", ids binary" * with_ids).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        encoder, packer = encoder_of(content.value, pattern), Packer(limits, cuts=True)
        number = TaskContext.get().partitionId() << _SHIFT
        rows: list[tuple] = []

        def write(sequence: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for segment, p in enumerate(sequence):
                doc_id, size, ids, base = p.example
                data = ids[p.start - base : p.start - base + p.tokens].tobytes()
                row = (doc_id, p.start, p.tokens, zlib.crc32(data), size, number, offset, segment)
                rows.append((*row, data) if with_ids else row)
                offset += p.tokens
            number += 1

        def batch_of_rows() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        longest = min(limits.tokens, limits.loss + 1)
        for batch in sliced(batches, "text", STEP):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(0)).astype("<u4")
                whole = len(ids) // longest * longest if longest == limits.tokens else 0
                for start in range(0, whole, longest):
                    write([Piece((doc_id, len(ids), ids, 0), start, longest, longest - 1)])
                if rest := len(ids) - whole:
                    packer.add(Piece((doc_id, len(ids), ids[whole:].copy(), whole), whole, rest, rest - 1))
            while packer.held > reserve:
                write(packer.sequence())
            if rows:
                yield batch_of_rows()
        while packer.waiting:
            write(packer.sequence())
            if len(rows) > 10_000:
                yield batch_of_rows()
        if rows:
            yield batch_of_rows()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_examples(examples: DataFrame, limits: Limits = Limits(), reserve: int = RESERVE) -> DataFrame:
    """``examples(example_id, tokens, loss)``, whole, in sequences: with sequence_id, segment
    (from 0) and offset added.

    An example over a limit of its own gets a sequence to itself (``over`` is true); null
    sizes count as 0. For instruction data: ``loss`` counts the tokens of the answers.
    """
    kind = dict(examples.select("example_id").dtypes)["example_id"]
    names = "example_id {0}, tokens long, loss long, sequence_id long, segment int, offset long, over boolean"
    schema = examples.sparkSession.createDataFrame([], names.format(kind)).schema
    sizes = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("tokens", "loss")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, packer = to_arrow_schema(schema), Packer(limits, cuts=False)
        number = TaskContext.get().partitionId() << _SHIFT
        rows: list[tuple] = []

        def write(sequence: list[Piece], over: bool = False) -> None:
            nonlocal number
            offset = 0
            for segment, p in enumerate(sequence):
                rows.append((p.example, p.tokens, p.loss, number, segment, offset, over))
                offset += p.tokens
            number += 1

        def batch_of_rows() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for example, tokens, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
                piece = Piece(example, 0, tokens, loss)
                if tokens > limits.tokens or loss > limits.loss:
                    write([piece], over=True)
                else:
                    packer.add(piece)
            while packer.held > reserve:
                write(packer.sequence())
            if rows:
                yield batch_of_rows()
        while packer.waiting:
            write(packer.sequence())
        if rows:
            yield batch_of_rows()

    return examples.select("example_id", *sizes).mapInArrow(run, schema)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path(VOCABULARY)
    packed = pack_documents(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, with_ids=False)
    return packed.drop("segment")
