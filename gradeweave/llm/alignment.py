"""Which tokens of one tokenizer stand for which of another, over a whole corpus.

Where both vocabularies code the stretches between the spaces of a text one by one (``PairCoder``),
and both give back the bytes of a stretch, its groups and links depend on it alone: each worker
keeps the alignments of the stretches it has met. Any other text is coded whole by both. Where
tokens of both end at one byte and the next token of both begins with a space, it is cut (the
shared ends are checked on the bytes); between two such anchors lies a window of token ids, whose
alignment depends on its ids alone and is kept by its id tuples. Links of token ids are counted
per document first, then over documents.
"""

from __future__ import annotations

import gc
import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.llm.chunks import PairCoder, kept
from gradeweave.llm.tokens import gathered, slices, stretches
from gradeweave.operators.sizes import BROADCAST_BYTES, fits_broadcast
from gradeweave.sources.shared import written

# Parts of chunks, and alignments of chunks and of windows, kept per worker.
MEMO = 600_000
WINDOWS = 500_000

# Bytes of text aligned at a time, if no document is longer.
_TEXT = 1 << 22

# Ids are below 2^32, so a pair of them is one 64-bit number.
_SHIFT = 32


class Window(NamedTuple):
    groups: int
    links: int
    text: str  # the groups, a1,a2|b1;a3|b2
    pairs: bytes  # one 64-bit number for each link


def align(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> Window:
    """The groups and links of one window, whose tokens end at these bytes, counted from any
    one place; both sides end at the same one. Every token has a byte at least."""
    groups, pairs = [], []
    names_a, names_b = list(map(str, a)), list(map(str, b))
    i = j = first_a = first_b = 0
    last = len(a) - 1
    left, end_a, end_b = a[0] << _SHIFT, ends_a[0], ends_b[0]
    while True:
        # Both tokens reach over bytes of each other, for the earlier ones have been passed.
        pairs.append(left | b[j])
        if end_a > end_b:
            j += 1
            end_b = ends_b[j]
            continue
        if end_a == end_b:
            j += 1
            groups.append(f"{','.join(names_a[first_a : i + 1])}|{','.join(names_b[first_b:j])}")
            if i == last:
                break
            first_a, first_b, end_b = i + 1, j, ends_b[j]
        i += 1
        left, end_a = a[i] << _SHIFT, ends_a[i]
    return Window(len(groups), len(pairs), ";".join(groups), array("q", pairs).tobytes())


class Chunk(NamedTuple):
    n_a: int
    n_b: int
    window: Window


class Rows(NamedTuple):
    """Texts aligned together."""

    numbers: np.ndarray  # of each text n_a, n_b, groups, links
    digests: list[str]  # of the groups
    row: np.ndarray  # the text of each link
    pair: np.ndarray  # and its ids


class Spelling:
    """The bytes of all tokens of a vocabulary behind each other."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array(list(map(len, tokens)), np.int64)
        self.start = np.cumsum(self.length) - self.length

    def gives(self, ids: np.ndarray, whole: bytes) -> bool:
        """Are the bytes of these tokens, joined, the whole?"""
        length = self.length[ids]
        end = np.cumsum(length)
        if not len(end) or end[-1] != len(whole):
            return False
        place = np.repeat(self.start[ids] - end + length, length) + np.arange(len(whole))
        return self.bytes[place].tobytes() == whole


class Aligner:
    """Aligns the ids of whole texts, with a memo of windows."""

    def __init__(self, coder: PairCoder, memo: int = WINDOWS):
        self.coder = coder
        self.memo = memo
        self.windows: dict[tuple[bytes, bytes], Window] = kept(f"windows_{coder.name}", dict)
        self.chunks: dict[str, Chunk | None] = kept(f"chunks_{coder.name}", dict)
        self.spaced_a = np.array([x[:1] == b" " for x in coder.bytes_a])
        self.spaced_b = np.array([x[:1] == b" " for x in coder.bytes_b])
        self.spelled_a, self.spelled_b = Spelling(coder.bytes_a), Spelling(coder.bytes_b)
        self.bits = len(coder.bytes_a).bit_length(), len(coder.bytes_b).bit_length()
        self.names, self.name_length = kept(
            f"names_{coder.name}", lambda: _names(len(coder.bytes_a), len(coder.bytes_b))
        )

    def rows(self, texts: list[str]) -> Rows:
        """The texts aligned, by the stretches between spaces where these can be told apart. Zeros
        and no digest for a text that is empty or whose tokens have other bytes."""
        if len(self.chunks) > self.memo:
            self.chunks.clear()
        numbers, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        cut = [i for i, text in enumerate(texts) if text and not self.coder.whole(text)]
        whole = set(range(len(texts))).difference(cut)
        names, index, bounds = stretches([texts[i] for i in cut])
        known = self.chunks
        new = [name for name in names if name not in known]
        if new:
            known.update(zip(new, self.align_chunks(new)))
        found = list(map(known.__getitem__, names))
        if None in found:
            # Texts with such a stretch are checked and aligned as a whole.
            bad = np.array([chunk is None for chunk in found])
            held = np.concatenate(([0], np.cumsum(bad[index])))[bounds]
            good = np.flatnonzero(held[1:] == held[:-1])
            whole = whole.union(cut).difference(cut[i] for i in good.tolist())
            cut = [cut[i] for i in good.tolist()]
            names, index, bounds = stretches([texts[i] for i in cut])
            found = list(map(known.__getitem__, names))

        groups = [chunk.window.text for chunk in found]
        at = bounds.tolist()
        for i, start, end in zip(cut, at, at[1:]):
            of_text = ";".join(map(groups.__getitem__, index[start:end].tolist()))
            digests[i] = hashlib.sha256(of_text.encode()).hexdigest()
        pair, ends = gathered([chunk.window.pairs for chunk in found], 8, index)
        links = np.diff(ends[bounds])
        for column, of_chunk in enumerate(
            ([x.n_a for x in found], [x.n_b for x in found], [x.window.groups for x in found])
        ):
            sums = np.cumsum(np.array(of_chunk, np.int64)[index])
            numbers[cut, column] = np.diff(np.concatenate(([0], sums))[bounds])
        numbers[cut, 3] = links
        row, pair = [np.repeat(np.array(cut, np.int64), links)], [pair.astype(np.int64)]

        rest = [i for i in sorted(whole) if texts[i]]
        some = [texts[i] for i in rest]
        for i, got in zip(rest, self.of_texts(some, self.coder.codes(some)) if some else ()):
            if got:
                *numbers[i], digests[i], pairs = got
                row.append(np.full(len(pairs) // 8, i))
                pair.append(np.frombuffer(pairs, np.int64))
        return Rows(numbers, digests, np.concatenate(row), np.concatenate(pair))

    def align_chunks(self, chunks: list[str]) -> list[Chunk | None]:
        """The alignments of distinct stretches, each with the space before it; None where the
        bytes of the tokens are others."""
        keys = self.coder.of_chunks(chunks)
        wholes = [b" " + chunk.encode() for chunk in chunks]
        ends = np.cumsum(list(map(len, wholes)))
        right = np.ones(len(chunks), bool)
        for side, spelling in zip(zip(*keys), (self.spelled_a, self.spelled_b)):
            ids = np.frombuffer(b"".join(side), "<u4")
            last = np.cumsum([len(x) for x in side]) // 4
            given = np.concatenate(([0], np.cumsum(spelling.length[ids])))[last]
            if (given != ends).any() or not spelling.gives(ids, b"".join(wholes)):
                right &= [
                    spelling.gives(np.frombuffer(x, "<u4"), whole)
                    for x, whole in zip(side, wholes)
                ]
        tidy = [key for key, is_right in zip(keys, right.tolist()) if is_right]
        windows = iter(self.align_all(tidy) if tidy else ())
        return [
            Chunk(len(a) // 4, len(b) // 4, next(windows)) if is_right else None
            for (a, b), is_right in zip(keys, right.tolist())
        ]

    def of_text(self, text: str, ids: tuple[bytes, bytes]) -> tuple | None:
        """n_a, n_b, groups, links, digest of the groups, and the windows' pairs of ids; None if
        the bytes of the tokens are not those of a space and the text."""
        return self.of_texts([text], [ids])[0]

    def of_texts(self, texts: list[str], ids: list[tuple[bytes, bytes]]) -> list[tuple | None]:
        """``of_text`` of each text; the windows not met before are aligned together."""
        if len(self.windows) > self.memo:
            self.windows.clear()
        keys = [self._keys(text, both) for text, both in zip(texts, ids)]
        known = self.windows
        new = dict.fromkeys(k for of_text in keys if of_text for k in of_text if k not in known)
        if new:
            known.update(zip(new, self.align_all(list(new))))
        rows = []
        for of_text, (a, b) in zip(keys, ids):
            if of_text is None:
                rows.append(None)
                continue
            found = list(map(known.__getitem__, of_text))
            digest = hashlib.sha256(";".join([w[2] for w in found]).encode()).hexdigest()
            groups = sum([w[0] for w in found])
            pairs = b"".join([w[3] for w in found])
            rows.append((len(a) // 4, len(b) // 4, groups, len(pairs) // 8, digest, pairs))
        return rows

    def _keys(self, text: str, ids: tuple[bytes, bytes]) -> list[tuple[bytes, bytes]] | None:
        """The windows of a text, by the ids of both sides."""
        a, b = (np.frombuffer(x, "<u4") for x in ids)
        whole = b" " + text.encode()
        if not (self.spelled_a.gives(a, whole) and self.spelled_b.gives(b, whole)):
            return None
        ends_a = np.cumsum(self.coder.length_a[a])
        ends_b = np.cumsum(self.coder.length_b[b])
        # Tokens after which the text is cut: the next one of both is marked by a space.
        cut_a = np.flatnonzero(self.spaced_a[a[1:]])
        cut_b = np.flatnonzero(self.spaced_b[b[1:]])
        at_a, at_b = ends_a[cut_a], ends_b[cut_b]
        place = np.searchsorted(at_b, at_a)
        both = np.flatnonzero(np.append(at_b, -1)[place] == at_a)
        to_a = (4 * (cut_a[both] + 1)).tolist()
        to_b = (4 * (cut_b[place[both]] + 1)).tolist()
        code_a, code_b = ids
        return [
            (code_a[i:m], code_b[j:n])
            for i, m, j, n in zip(
                [0, *to_a], [*to_a, len(code_a)], [0, *to_b], [*to_b, len(code_b)]
            )
        ]

    def align_all(self, keys: list[tuple[bytes, bytes]]) -> list[Window]:
        """The windows of these ids. Both sides of a window have equally many bytes, so the windows
        behind each other are one text, whose links and groups stay within them."""
        a, b = (np.frombuffer(b"".join(side), "<u4").astype(np.int64) for side in zip(*keys))
        last_a, last_b = (np.cumsum([len(x) for x in side]) // 4 - 1 for side in zip(*keys))
        length = self.coder.length_a[a]
        ends_a, ends_b = np.cumsum(length), np.cumsum(self.coder.length_b[b])
        first = np.searchsorted(ends_b, ends_a - length, "right")
        last = np.searchsorted(ends_b, ends_a)
        # Each A token with the B tokens that it shares bytes with.
        linked = last - first + 1
        behind = np.cumsum(linked)
        of_a = np.repeat(np.arange(len(a)), linked)
        of_b = np.arange(len(of_a)) + (first - behind + linked)[of_a]
        pairs = (a[of_a] << _SHIFT | b[of_b]).tobytes()

        shared = ends_b[last] == ends_a
        end_a = np.flatnonzero(shared)
        end_b = last[end_a]
        closes = np.zeros(len(b), bool)
        closes[end_b] = True
        # Tokens in the order of the groups' text: of each group those of A, then those of B.
        group_a = np.cumsum(shared) - shared
        group_b = np.cumsum(closes) - closes
        token = np.empty(len(a) + len(b), np.int64)
        n_a = len(self.coder.bytes_a)
        before = np.concatenate(([0], end_b + 1))
        token[np.arange(len(a)) + before[group_a]] = a + n_a * shared
        at_b = np.arange(len(b)) + end_a[group_b] + 1
        token[at_b] = b + 2 * n_a + len(self.coder.bytes_b) * closes
        text = "".join(map(self.names.__getitem__, token.tolist()))
        to_text = np.cumsum(self.name_length[token])[at_b[last_b]].tolist()
        to_group = np.cumsum(shared)[last_a]
        to_pair = behind[last_a]
        return [
            # Without the semicolon behind the window's last group.
            Window(groups, links, text[i : j - 1], pairs[k:m])
            for groups, links, i, j, k, m in zip(
                np.diff(to_group, prepend=0).tolist(),
                np.diff(to_pair, prepend=0).tolist(),
                [0, *to_text],
                to_text,
                [0, *(8 * to_pair).tolist()],
                (8 * to_pair).tolist(),
            )
        ]


def _names(n_a: int, n_b: int) -> tuple[list[str], np.ndarray]:
    """The ids as they stand in a text of groups: those of A within a group and at the end of its
    side, then those of B alike; and their lengths."""
    names = [
        f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)
    ]
    return names, np.array(list(map(len, names)), np.int64)


_ALIGNED = (
    "key bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, pairs array<bigint>, times array<bigint>"
)
_NAMES = [field.split()[0] for field in _ALIGNED.split(", ")]


def aligned(docs: DataFrame, byte_path: str, piece_path: str, *, memo: int = MEMO) -> DataFrame:
    """One row per document: key, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the
    distinct linked pairs of ids (a * 2^32 + b, ascending) with how many links each has.

    ``key`` tells the rows apart; it follows the input splits. A null or empty text, and one
    that a tokenizer does not give back byte by byte, has zeros, an empty digest and no pairs.
    Equal rows are aligned once each; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = PairCoder(byte_path, piece_path, memo)
        aligner = Aligner(coder)
        key = TaskContext.get().partitionId() << 36
        # The memos hold millions of objects and no cycles: looking for cycles would take a
        # quarter of the time.
        gc.disable()
        try:
            for batch in batches:
                for some in slices(batch, _TEXT):
                    rows = aligner.rows([x or "" for x in some.column("text").to_pylist()])
                    yield _batch(key, some.column("doc_id"), rows, aligner.bits)
                    key += some.num_rows
        finally:
            gc.enable()

    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return text.mapInArrow(run, _ALIGNED)


def _batch(key: int, doc_id: pa.Array, rows: Rows, bits: tuple[int, int]) -> pa.RecordBatch:
    """The rows of a batch, the pairs of each document sorted and counted."""
    n, (of_a, of_b) = len(doc_id), bits
    # Text and pair as one number: ids have few bits.
    both = np.sort(
        (rows.row << of_a + of_b) | (rows.pair >> _SHIFT << of_b) | (rows.pair & (1 << _SHIFT) - 1)
    )
    at = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))[: len(both)])
    times = np.diff(np.append(at, len(both)))
    both = both[at]
    pair = both >> of_b & (1 << of_a) - 1
    pair = pair << _SHIFT | both & (1 << of_b) - 1
    bounds = np.searchsorted(both, np.arange(n + 1) << of_a + of_b).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(key, key + n), pa.int64()),
            doc_id.cast(pa.int64()),
            *[pa.array(rows.numbers[:, i], pa.int64()) for i in range(4)],
            pa.array(rows.digests, pa.string()),
            pa.ListArray.from_arrays(pa.array(bounds), pa.array(pair, pa.int64())),
            pa.ListArray.from_arrays(pa.array(bounds), pa.array(times, pa.int64())),
        ],
        _NAMES,
    )


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n, best: in how many documents each pair is linked, and whether no other pair of
    its first id is linked in more."""
    counts = written(
        rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")),
        "pair-counts",
    )
    a = F.shiftright("pair", _SHIFT)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, a == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")
    )


def _bar(counts: DataFrame, limit: int) -> int:
    """The least power of two such that the counts from there on fit ``limit`` bytes, at the
    40 bytes a row that ``measure`` would find."""
    by_power = counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("rows"))
    room = limit // 40
    bar = 1 << 62
    for power, rows in sorted(by_power.collect(), reverse=True):  # at most 63
        room -= rows
        if room < 0:
            break
        bar = 1 << power
    return bar


class Alignment(NamedTuple):
    documents: DataFrame  # one row per document, as below
    links: DataFrame  # a, b, n, best: the dictionary between the two vocabularies


def align_tokenizers(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    *,
    limit: int = BROADCAST_BYTES,
    memo: int = MEMO,
) -> Alignment:
    """Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the
    table of linked ids: a, b, n (documents that hold the pair linked), best.

    ``n_best`` counts a document's links whose pair is the most frequent of its first id,
    ``count_sum`` adds up n over its links. Documents are as in ``aligned``; an empty table gives no
    row in either. Counts of up to ``limit`` bytes are broadcast. Beyond that only those of pairs
    in many documents are, as many as fit, and the others, each in few documents, are joined.
    """
    rows = written(aligned(docs, byte_path, piece_path, memo=memo), "aligned")
    counts = written(pair_counts(rows), "linked-pairs")
    found = rows.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")
    )
    if fits_broadcast(counts, limit):
        rated = found.join(F.broadcast(counts), "pair")
    else:
        bar = _bar(counts, limit)
        many = F.broadcast(counts.where(F.col("n") >= bar))
        few = counts.where(F.col("n") < bar)
        rated = found.join(many, "pair").unionByName(
            found.join(many, "pair", "left_anti").join(few, "pair")
        )
    sums = rated.groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    documents = (
        rows.drop("pairs", "times")
        .join(sums, "key", "left")
        .select(
            "doc_id",
            "n_a",
            "n_b",
            "n_groups",
            "n_links",
            F.coalesce("n_best", F.lit(0).cast("bigint")).alias("n_best"),
            F.coalesce("count_sum", F.lit(0).cast("bigint")).alias("count_sum"),
            "groups_sha256",
        )
    )
    links = counts.select(
        F.shiftright("pair", _SHIFT).alias("a"),
        F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("b"),
        "n",
        "best",
    )
    return Alignment(documents, links)
