"""Documents packed into sequences under several limits at once (vector bin packing).

A sequence may hold so many tokens, so many segments (pieces of documents) and so many
loss-bearing tokens. Each task packs the documents of its input split, so nothing is shuffled;
at most one sequence per task is left unfilled. Within a task, pieces wait in a pool of
bounded size. The next piece of the open sequence is the one whose demand has the largest dot
product with what is left of the limits, weighted by how scarce each of them is; a
piece that does not fit any more is cut to fill the sequence up.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.llm.tokens import MEMO, Coder


class Limits(NamedTuple):
    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024


# Pieces in the pool when packing starts; half of them stay to choose from.
POOL = 512


class Piece(NamedTuple):
    doc: int
    start: int
    length: int
    sequence: int
    offset: int


class Packer:
    """Places documents, given by length and by where their loss-bearing tokens begin."""

    def __init__(self, limits: Limits = Limits(), pool: int = POOL):
        if min(limits) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits = limits
        self.pool = pool
        self.sequences = 0
        self.size = 0
        room = 2 * pool
        self.doc = np.zeros(room, np.int64)
        self.start = np.zeros(room, np.int64)
        self.end = np.zeros(room, np.int64)
        self.loss_from = np.zeros(room, np.int64)
        self.demand = np.zeros((room, 3))

    def _set(self, i: int, doc: int, start: int, end: int, loss_from: int) -> None:
        self.doc[i], self.start[i], self.end[i], self.loss_from[i] = doc, start, end, loss_from
        loss = max(0, end - max(start, loss_from))
        self.demand[i] = (end - start, 1, loss)

    def _drop(self, i: int) -> None:
        self.size -= 1
        last = self.size
        for column in (self.doc, self.start, self.end, self.loss_from, self.demand):
            column[i] = column[last]

    def _fit(self, start: int, loss_from: int, tokens: float, loss: float) -> int:
        """Longest piece from ``start`` with at most so many tokens and loss-bearing ones."""
        return int(min(tokens, max(0, loss_from - start) + loss))

    def add(self, doc: int, length: int, loss_from: int = 0) -> Iterator[Piece]:
        """Take a document; gives the pieces that have found their place meanwhile."""
        start, limits = 0, self.limits
        while length - start >= limits.tokens:
            n = self._fit(start, loss_from, limits.tokens, limits.loss_tokens)
            if n < limits.tokens:
                break
            yield Piece(doc, start, n, self.sequences, 0)
            self.sequences += 1
            start += n
        if start < length:
            self._set(self.size, doc, start, length, loss_from)
            self.size += 1
            if self.size >= self.pool:
                while self.size > self.pool // 2:
                    yield from self._fill()

    def rest(self) -> Iterator[Piece]:
        """Place everything that still waits."""
        while self.size:
            yield from self._fill()

    def _fill(self) -> Iterator[Piece]:
        whole = np.array(self.limits, float)
        left = whole.copy()
        scarce = self.demand[: self.size].mean(axis=0) / whole
        offset = 0
        while self.size and left.min() > 0:
            demand = self.demand[: self.size]
            score = demand @ (scarce * left / whole**2)
            fits = (demand <= left).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, score, -1.0)))
                n = int(self.end[i] - self.start[i])
            else:
                i = int(np.argmax(score))
                n = self._fit(int(self.start[i]), int(self.loss_from[i]), left[0], left[2])
            start, end, loss_from = int(self.start[i]), int(self.end[i]), int(self.loss_from[i])
            doc = int(self.doc[i])
            yield Piece(doc, start, n, self.sequences, offset)
            left -= (n, 1, max(0, start + n - max(start, loss_from)))
            offset += n
            if start + n < end:
                self._set(i, doc, start + n, end, loss_from)
            else:
                self._drop(i)
        self.sequences += 1


_PACKED = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "loss_tokens bigint, sequence_id bigint, offset bigint"
)
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4)
_NAMES = [field.split()[0] for field in _PACKED.split(", ")]

# Documents tokenized, and pieces returned, at a time.
_DOCS = 200
_PIECES = 4096


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    prompt: str | None = None,
    limits: Limits = Limits(),
    memo: int = MEMO,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned 32-bit, little-endian),
    doc_tokens, loss_tokens, sequence_id, offset.

    A document is the ids of its text and then id 0. With ``prompt``, the name of a text
    column, the ids of the prompt come first and bear no loss; without it all ids do. A null
    text or prompt is empty. Equal rows are packed once each, rows of a null ``doc_id`` too;
    an empty table gives no row; other columns are not looked at. A worker keeps the ids of
    about ``memo`` pre-tokens. The packing follows the
    order of the rows in the input splits, so a task that is run again repeats it.
    """
    text = F.col("text").alias("text")
    given = F.col(prompt) if prompt else F.lit(None).cast("string")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = Coder(tokenizer, memo)
        packer = Packer(limits)
        # Sequences of a task are numbered apart from those of any other.
        base = TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}  # number -> doc_id, ids, ids not yet placed, loss_from
        out: list[tuple] = []

        def take(piece: Piece) -> None:
            doc = held[piece.doc]
            end = piece.start + piece.length
            loss = max(0, end - max(piece.start, doc[3]))
            ids = doc[1][4 * piece.start : 4 * end]
            out.append(
                (doc[0], piece.start, piece.length, ids, len(doc[1]) // 4, loss,
                 base + piece.sequence, piece.offset)
            )
            doc[2] -= piece.length
            if not doc[2]:
                del held[piece.doc]

        number = 0
        for batch in batches:
            for i in range(0, batch.num_rows, _DOCS):
                some = batch.slice(i, _DOCS)
                codes = coder.codes([x or "" for x in some.column("text").to_pylist()])
                prompts = coder.codes([x or "" for x in some.column("prompt").to_pylist()])
                for doc_id, head, tail in zip(some.column("doc_id").to_pylist(), prompts, codes):
                    ids = head + tail + b"\0\0\0\0"
                    held[number] = [doc_id, ids, len(ids) // 4, len(head) // 4]
                    for piece in packer.add(number, len(ids) // 4, len(head) // 4):
                        take(piece)
                    number += 1
                    if len(out) >= _PIECES:
                        yield _batch(out)
                        out.clear()
        for piece in packer.rest():
            take(piece)
            if len(out) >= _PIECES:
                yield _batch(out)
                out.clear()
        if out:
            yield _batch(out)

    return docs.select("doc_id", text, given.alias("prompt")).mapInArrow(packed, _PACKED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(list(v), t) for v, t in zip(zip(*rows), _KINDS)]
    return pa.RecordBatch.from_arrays(columns, _NAMES)
