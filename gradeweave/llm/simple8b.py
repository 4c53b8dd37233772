"""Token ids in files of 64-bit words (Simple-8b), written and read by Spark tasks.

A word has a selector in its top four bits and 60 bits of values, so it holds 60 values of one
bit, 30 of two bits, ... or one of 60 bits. A wider value is escaped: a word with selector 0,
then the value as a word. Values are coded in blocks of 1024, each from a fresh word, and
the file lists where each block starts, so that blocks are coded and decoded side by side
with array operations and a reader can begin at any block.

A file: 8 bytes magic; the words; per block its number of words (u32); per document its id
(i64), a null flag (u8) and its number of ids (i64); then a trailer with the numbers of words,
blocks, ids and documents (4 x u64) and the magic again. All little-endian.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.llm.files import opened, whole_file
from gradeweave.llm.tokens import Coder, slices
from gradeweave.sources.shared import new_path

MAGIC = b"GWS8B001"
BLOCK = 1024

# Values in a word by selector, and their widths; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([64, *(60 // COUNTS[1:])], np.int64)

# The largest value of each width, and the first selector that fits a value below 2^16.
_LIMITS = np.array([(1 << int(w)) - 1 for w in WIDTHS[1:]], np.uint64)
_SMALL = 1 << 16
_FITS = (1 + np.searchsorted(_LIMITS, np.arange(_SMALL, dtype=np.uint64))).astype(np.uint8)

# The maximum of a window, from those of two windows that cover it.
_WINDOWS = {
    2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4), 10: (8, 2),
    12: (8, 4), 15: (8, 8), 20: (12, 8), 30: (15, 15), 60: (30, 30),
}

# Blocks coded or decoded at a time.
TOGETHER = 1024

_TRAILER = 4 * 8 + len(MAGIC)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the number of words of each block."""
    values = np.asarray(values, np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    # Zeros behind the last value of a block let its last word be filled up.
    table = np.zeros((blocks, BLOCK + 60), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(values)] = values
    table[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    length = np.full(blocks, BLOCK)
    length[-1] = len(values) - (blocks - 1) * BLOCK

    # A window that fits a selector fits the later ones too, with fewer and wider values. So
    # the first that fits is found by counting those that don't.
    narrowest = _FITS[np.minimum(table, _SMALL - 1)]
    large = table >= _SMALL
    if large.any():
        narrowest[large] = 1 + np.searchsorted(_LIMITS, table[large])
    selector = np.ones((blocks, BLOCK), np.uint8)
    widest = {1: narrowest}
    for n, (one, other) in _WINDOWS.items():
        reach = narrowest.shape[1] - n + 1
        widest[n] = np.maximum(widest[one][:, :reach], widest[other][:, n - other :][:, :reach])
    for s in range(1, len(COUNTS)):
        selector += widest[int(COUNTS[s])][:, :BLOCK] > s
    selector[selector == len(COUNTS)] = 0

    # From word to word, in all blocks at once.
    starts = np.zeros((blocks, BLOCK), bool)
    first = np.arange(blocks) * BLOCK
    end, at, ahead = first + length, first, COUNTS[selector].reshape(-1)
    while len(at):
        starts.reshape(-1)[at] = True
        at = at + ahead[at]
        going = at < end
        at, end = at[going], end[going]
    at = np.flatnonzero(starts)
    row, kind = at // BLOCK, selector.reshape(-1)[at]
    value_at, cells = at + row * (table.shape[1] - BLOCK), table.reshape(-1)

    size = np.where(kind == 0, 2, 1)
    word_at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in range(1, len(COUNTS)):
        mine = np.flatnonzero(kind == s)
        if len(mine):
            first_value = value_at[mine]
            word = np.full(len(mine), s << 60, np.uint64)
            for lane in range(int(COUNTS[s])):
                word |= cells[first_value + lane] << np.uint64(lane * WIDTHS[s])
            words[word_at[mine]] = word
    escaped = np.flatnonzero(kind == 0)
    words[word_at[escaped] + 1] = cells[value_at[escaped]]
    return words, np.bincount(row, size, blocks).astype(np.uint32)


def decode(words: np.ndarray, per_block: np.ndarray, n: int) -> np.ndarray:
    """The n values of consecutive blocks."""
    blocks = len(per_block)
    out = np.zeros((blocks, BLOCK + 60), np.uint64)
    kind = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[np.minimum(kind, len(COUNTS) - 1)]
    # An escaped value is at least 2**60, so it never looks like an escape itself.
    escaped = np.flatnonzero(kind == 0)
    count[escaped] = 0
    count[escaped + 1] = 1
    kind[escaped + 1] = -1
    row = np.repeat(np.arange(blocks), per_block)
    place = np.cumsum(count) - count
    first = np.cumsum(per_block) - per_block
    place += row * out.shape[1] - (place[first][row] if blocks else 0)
    cells = out.reshape(-1)
    for s in range(1, len(COUNTS)):
        mine = np.flatnonzero(kind == s)
        if len(mine):
            word, to = words[mine], place[mine]
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for lane in range(int(COUNTS[s])):
                cells[to + lane] = (word >> np.uint64(lane * WIDTHS[s])) & mask
    raw = np.flatnonzero(kind == -1)
    cells[place[raw]] = words[raw]
    return out[:, :BLOCK].reshape(-1)[:n]


class Writer:
    """Appends documents' ids to one open file."""

    def __init__(self, out):
        self.out = out
        self.out.write(MAGIC)
        self.waiting: list[bytes] = []
        self.waiting_ids = 0
        self.per_block: list[np.ndarray] = []
        self.doc_ids: list[int] = []
        self.nulls: list[bool] = []
        self.lengths: list[int] = []
        self.words = 0
        self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.waiting_ids += len(ids) // 4
        if self.waiting_ids >= TOGETHER * BLOCK:
            self._code(self.waiting_ids // BLOCK * BLOCK)

    def _code(self, n: int) -> None:
        values = np.frombuffer(b"".join(self.waiting), "<u4")
        for i in range(0, n, TOGETHER * BLOCK):
            words, per_block = encode(values[i : min(i + TOGETHER * BLOCK, n)])
            self.out.write(words.astype("<u8").tobytes())
            self.per_block.append(per_block)
            self.words += len(words)
        self.ids += n
        self.waiting = [values[n:].tobytes()]
        self.waiting_ids -= n

    def finish(self) -> None:
        self._code(self.waiting_ids)
        blocks = np.concatenate(self.per_block) if self.per_block else np.zeros(0, np.uint32)
        for part, kind in (
            (blocks, "<u4"),
            (self.doc_ids, "<i8"),
            (self.nulls, "u1"),
            (self.lengths, "<i8"),
            ([self.words, len(blocks), self.ids, len(self.doc_ids)], "<u8"),
        ):
            self.out.write(np.array(part).astype(kind).tobytes())
        self.out.write(MAGIC)


def read_documents(uri: str) -> Iterator[tuple[int | None, int, bytes]]:
    """(document id, ids before it in the file, its ids) of each document, in file order.

    Holds the index, a thousand blocks and one document in memory.
    """
    system, path = opened(uri)
    with system.open_input_file(path) as file:
        size = file.size()
        trailer = file.read_at(_TRAILER, size - _TRAILER)
        if file.read_at(len(MAGIC), 0) != MAGIC or trailer[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"not a file of token ids, or cut off: {uri}")
        n_words, n_blocks, n_ids, n_docs = map(int, np.frombuffer(trailer[:32], "<u8"))
        at = len(MAGIC) + 8 * n_words
        index = file.read_at(size - _TRAILER - at, at)
        per_block = np.frombuffer(index, "<u4", n_blocks).astype(np.int64)
        at = 4 * n_blocks
        doc_ids = np.frombuffer(index, "<i8", n_docs, at)
        nulls = np.frombuffer(index, "u1", n_docs, at + 8 * n_docs)
        lengths = np.frombuffer(index, "<i8", n_docs, at + 9 * n_docs)
        word_at = np.concatenate(([0], np.cumsum(per_block)))

        def pieces() -> Iterator[bytes]:
            for i in range(0, n_blocks, TOGETHER):
                j = min(i + TOGETHER, n_blocks)
                n = 8 * int(word_at[j] - word_at[i])
                words = np.frombuffer(file.read_at(n, len(MAGIC) + 8 * int(word_at[i])), "<u8")
                values = decode(words, per_block[i:j], min(n_ids, j * BLOCK) - i * BLOCK)
                yield values.astype("<u4").tobytes()

        # ``at`` is where the next document starts in the piece at hand.
        piece, at, start, source = b"", 0, 0, pieces()
        for doc_id, null, length in zip(doc_ids.tolist(), nulls.tolist(), lengths.tolist()):
            end = at + 4 * length
            ids = piece[at:end]
            if end > len(piece):
                parts = [ids]
                while end > len(piece):
                    end -= len(piece)
                    piece = next(source)
                    parts.append(piece[:end])
                ids = b"".join(parts)
            yield None if null else doc_id, start, ids
            at = end
            start += length


_MANIFEST = "part int, path string, n_docs bigint, n_ids bigint"
_READ = "doc_id bigint, start bigint, n_tokens bigint, ids binary"

# Bytes of text tokenized at a time, if no document is longer.
_TEXT = 1 << 22


def write_ids(
    docs: DataFrame, tokenizer: str, *, folder: str | None = None, parts: int | None = None
) -> DataFrame:
    """Write the ids of every document to files, in ascending order of ``doc_id``.

    One row per file: part, path, n_docs, n_ids; files follow each other by ``part``. Id 0
    ends each document. A null text is empty; null ids come first, rows of equal id are in
    order of text; an empty table gives no file. Other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "ids")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.s8b"
        coder = Coder(tokenizer)
        with whole_file(path) as out:
            writer = Writer(out)
            while first is not None:
                for some in slices(first, _TEXT):
                    texts = [x or "" for x in some.column("text").to_pylist()]
                    for doc_id, ids in zip(some.column("doc_id").to_pylist(), coder.codes(texts)):
                        writer.add(doc_id, ids + b"\0\0\0\0")
                first = next(batches, None)
            writer.finish()
        row = [[part], [path], [len(writer.doc_ids)], [writer.ids]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))],
            ["part", "path", "n_docs", "n_ids"],
        )

    manifest = (
        docs.select("doc_id", "text")
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(write, _MANIFEST)
    )
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit,
    little-endian) of each document in the files, with one task per file."""
    spark = manifest.sparkSession
    # One row per file comes to the driver: as many as there were writing tasks.
    files = sorted(manifest.select("part", "path", "n_ids").collect())
    before, rows = 0, []
    for file in files:
        rows.append((file["path"], before))
        before += file["n_ids"]
    listed = spark.createDataFrame(rows, "path string, before bigint")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                waiting, held = [], 0
                for doc_id, start, ids in read_documents(file["path"]):
                    waiting.append((doc_id, file["before"] + start, len(ids) // 4, ids))
                    held += len(ids)
                    if held >= 1 << 20:
                        yield _batch(waiting)
                        waiting, held = [], 0
                if waiting:
                    yield _batch(waiting)

    return listed.repartition(max(1, len(rows))).mapInArrow(read, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(list(v), t) for v, t in zip(zip(*rows), kinds)],
        ["doc_id", "start", "n_tokens", "ids"],
    )
