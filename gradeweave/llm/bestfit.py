"""Best-fit packing whose count of sequences is certified by lower bounds.

Documents are cut only where they are longer than a sequence. The pieces are dealt into groups
of bounded size, each packed by best-fit decreasing. Dual feasible functions turn a group's
lengths into a number of sequences that no packing can stay below; a group that meets its
number is certified. The others exchange the pieces of their unfilled sequences, together with
the loosest sequences of each certified group, and are packed anew; what comes out is kept if it
takes fewer sequences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeweave.llm.chunks import MEMO, WordCoder
from gradeweave.sources.shared import written

CAPACITY = 2048

# Pieces that a group holds on average: what one call packs.
GROUP = 8192

# Exchanges at most; each deals again what the one before left uncertified. A bound on the
# effort only: every piece is packed at any number of rounds.
ROUNDS = 5

# Rounding functions tried: of 1 to so many steps.
_STEPS = 60

# Documents tokenized at a time.
_DOCS = 200


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A number of sequences that no packing of the pieces can stay below.

    ``counts[x]`` is the number of pieces of length x, 0 to ``capacity``. Each dual feasible
    function f maps lengths so that no set of pieces that fits a sequence has a sum of f above
    1; the sum of f over all pieces, rounded up, is then a bound. Three families are tried, in
    whole numbers: lengths with the small ones left out and the large ones taken for whole
    sequences, lengths rounded down to multiples of a step, and large lengths counted by the
    small ones that they displace.
    """
    counts = np.asarray(counts, np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    number = np.concatenate(([0], np.cumsum(counts)))
    total = np.concatenate(([0], np.cumsum(counts * x)))
    small = np.arange(capacity // 2 + 1)
    large = capacity - small
    whole = number[-1] - number[large + 1]
    between = total[large + 1] - total[small]
    best = int((-(-(whole * capacity + between) // capacity)).max())
    for k in range(1, _STEPS + 1):
        steps = (k + 1) * x
        f = np.where(steps % capacity == 0, k * x, steps // capacity * capacity)
        best = max(best, -(-int(counts @ f) // (k * capacity)))
    for least in range(1, capacity // 2 + 1):
        k = capacity // least
        f = np.where(2 * x > capacity, k - (capacity - x) // least, (x >= least).astype(np.int64))
        best = max(best, -(-int(counts @ f) // k))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each piece, numbered from 0; the longest pieces are placed first, each
    where the least room is left by it. ``lengths`` must be in descending order."""
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some sequence has room for r more
    bins = np.zeros(len(lengths), np.int64)
    used = 0
    for i, length in enumerate(lengths.tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, number = capacity, used
            used += 1
        bins[i] = number
        room -= length
        open_by_room[room].append(number)
        rooms |= 1 << room
    return bins


_TOKENIZED = "key bigint, doc_id bigint, piece int, start bigint, length bigint, ids binary"


def tokenized(docs: DataFrame, tokenizer: str, capacity: int, memo: int = MEMO) -> DataFrame:
    """key, doc_id, piece, start, length, ids: the pieces of each document, of ``capacity``
    ids but for the last one. ``key`` tells the rows apart; it follows the input splits."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = WordCoder(tokenizer, memo)
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for i in range(0, batch.num_rows, _DOCS):
                some = batch.slice(i, _DOCS)
                codes = coder.codes([x or "" for x in some.column("text").to_pylist()])
                rows = []
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), codes):
                    ids += b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((key, doc_id, piece, at // 4, len(part) // 4, part))
                        key += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(column), kind)
                        for column, kind in zip(
                            zip(*rows),
                            (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(),
                             pa.binary()),
                        )
                    ],
                    [field.split()[0] for field in _TOKENIZED.split(", ")],
                )

    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return text.mapInArrow(pieces, _TOKENIZED)


_PLACED = (
    "key bigint, length bigint, home bigint, sequence bigint, offset bigint, filled bigint, "
    "sequences bigint, bound bigint"
)


def _packer(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def packed(group: pa.Table) -> pa.Table:
        key = group.column("key").to_numpy()
        length = group.column("length").to_numpy()
        order = np.lexsort((key, -length))
        key, length = key[order], length[order]
        sequence = best_fit_decreasing(length, capacity)
        used = int(sequence.max()) + 1
        filled = np.bincount(sequence, weights=length, minlength=used).astype(np.int64)
        # Offsets: running sums within each sequence, in the order of placing.
        by = np.argsort(sequence, kind="stable")
        behind = np.cumsum(length[by]) - length[by]
        first = np.searchsorted(sequence[by], np.arange(used))
        offset = np.empty(len(key), np.int64)
        offset[by] = behind - behind[first][sequence[by]]
        bound = lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        size = len(key)
        return pa.table(
            {
                "key": key,
                "length": length,
                "home": np.full(size, group.column("home")[0].as_py(), np.int64),
                "sequence": sequence,
                "offset": offset,
                "filled": filled[sequence],
                "sequences": np.full(size, used, np.int64),
                "bound": np.full(size, bound, np.int64),
            }
        )

    return packed


def dealt(pieces: DataFrame, number: int, round_: int, group: int, capacity: int) -> DataFrame:
    """The pieces (key, length) dealt into groups by a hash and packed, group by group."""
    groups = max(1, -(-number // group))
    home = F.pmod(F.xxhash64(F.lit(round_), "key"), F.lit(groups)) + (round_ << 36)
    return (
        pieces.select("key", "length", home.alias("home"))
        .groupBy("home")
        .applyInArrow(_packer(capacity), _PLACED)
    )


class Packed(NamedTuple):
    pieces: DataFrame  # doc_id, piece, start, length, what is carried, sequence_id, offset
    groups: DataFrame  # home, pieces, sequences, bound: the certificate of each group
    sequences: int  # in all
    bound: int  # that no packing of the whole table can stay below
    exchanges: int  # rounds whose result was taken


def pack_certified(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = CAPACITY,
    group: int = GROUP,
    rounds: int = ROUNDS,
    carried: Mapping[str, Column] | None = None,
    memo: int = MEMO,
) -> Packed:
    """Every document in sequences of at most ``capacity`` ids, in as few as can be found.

    A document is the ids of its text (null: none) and then id 0. Only one longer than
    ``capacity`` is cut, into pieces of just that length and a last one that may be shorter. Each
    whole piece is a sequence of its own. ``carried`` names what else a row returns, computed
    from its ``ids`` before rows are moved; the ids themselves if not given.

    Equal rows are packed once each, rows of a null ``doc_id`` too; an empty table gives no
    row; other columns are not looked at. Pieces and places are written before they are used
    again, so a task that is run again finds what the others have used.
    """
    carried = {"ids": F.col("ids")} if carried is None else dict(carried)
    shown = ["doc_id", "piece", "start", "length", *carried]
    pieces = written(
        tokenized(docs, tokenizer, capacity, memo).select(
            "key", "doc_id", "piece", "start", "length",
            *[column.alias(name) for name, column in carried.items()],
        ),
        "pieces",
    )
    whole = F.col("length") == capacity
    # At most one row per length comes to the driver.
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    bound = lower_bound(counts, capacity)

    number = int(counts[:capacity].sum())
    open_ = written(dealt(pieces.where(~whole), number, 0, group, capacity), "placed")
    closed: list[DataFrame] = []
    used = int(counts[capacity]) + _sequences(open_)
    exchanges = 0
    for round_ in range(1, rounds + 1):
        if used <= bound:
            break
        # Of a certified group the sequences with most room go along, each round more of them.
        loose = Window.partitionBy("home").orderBy("filled", "sequence")
        loosest = (
            open_.where((F.col("offset") == 0) & (F.col("filled") < capacity))
            .withColumn("rank", F.row_number().over(loose))
            .where((F.col("rank") <= 1 << (round_ - 1)) | (F.col("sequences") > F.col("bound")))
            .select("home", "sequence", F.lit(True).alias("moves"))
        )
        gone = loosest.groupBy("home").agg(F.count("*").alias("gone"))
        marked = written(
            open_.join(loosest, ["home", "sequence"], "left").join(gone, "home", "left"),
            "marked",
        )
        moving = marked.where("moves")
        number, before = moving.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if not number:
            break
        anew = written(dealt(moving, number, round_, group, capacity), "placed")
        after = _sequences(anew)
        if after < before:
            # Without some of its sequences a group needs at most so many less.
            stays = marked.where("moves IS NULL")
            closed.append(
                stays.withColumn("bound", F.expr("bound - coalesce(gone, 0)")).select(open_.columns)
            )
            open_ = anew
            used += after - before
            exchanges += 1

    placed = open_
    for part in closed:
        placed = placed.unionByName(part)
    of_groups = placed.select(
        "key",
        (F.shiftleft("home", 20) + F.col("sequence")).alias("sequence_id"),
        "offset",
    )
    # Home numbers of groups are below 2^39; a whole piece takes its key, above 2^60.
    joined = pieces.join(of_groups, "key", "left").select(
        *shown,
        F.coalesce("sequence_id", F.col("key") + (1 << 60)).alias("sequence_id"),
        F.coalesce("offset", F.lit(0).cast("bigint")).alias("offset"),
    )
    groups = placed.groupBy("home").agg(
        F.count("*").alias("pieces"),
        F.count_if(F.col("offset") == 0).alias("sequences"),
        F.max("bound").alias("bound"),
    )
    return Packed(joined, groups, used, bound, exchanges)


def _sequences(placed: DataFrame) -> int:
    return placed.where(F.col("offset") == 0).count()
