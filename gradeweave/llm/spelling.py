"""Spelling variants: words one edit apart, found by composing finite-state machines.

The vocabulary is an acceptor A; a transducer E copies a word but for one inserted, deleted or
replaced letter. The pairs that A o E o A accepts are the words that are near each other. The
composition is cut by its initial states: before the edit both acceptors are in the state that
the shared beginning leads to, so the words behind one beginning are composed apart from all
others. An edit in the first half of a word leaves its end as it is; for those pairs the same is
done with reversed words. So no group is larger than the words that share half of their letters,
and one that still is large is cut again at the next letter.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.operators.sizes import fits_broadcast
from gradeweave.sources.shared import written

LETTERS = r"[A-Za-zÀ-ÿ]"

MIN_LENGTH = 7
MIN_COUNT = 2

# A form is so many times as frequent as its variant.
TIMES = 10

# Words of one group that are composed at once; a larger group is cut at its next letter.
GROUP = 50_000


class Acceptor:
    """A minimised acyclic acceptor. A state is final or not and has edges labelled by letters
    that no branch interrupts; equal states are one."""

    def __init__(self, words: list[str]):
        """``words`` are distinct and sorted."""
        self.final: list[bool] = []
        self.edges: list[dict[str, tuple[str, int]]] = []  # first letter -> rest of label, state
        self._known: dict[tuple, int] = {}
        self._words = words
        self._shared: dict[tuple[int, int], list[str]] = {}
        deepest = max(map(len, words)) if words else 0
        if sys.getrecursionlimit() < 4 * deepest + 1000:
            sys.setrecursionlimit(4 * deepest + 1000)
        self.start = self._state(0, len(words), 0)

    def _state(self, low: int, high: int, depth: int) -> int:
        """The state that accepts what follows the first ``depth`` letters of these words."""
        words = self._words
        final = low < high and len(words[low]) == depth
        low += final
        edges = {}
        while low < high:
            letter = words[low][depth]
            end = low + 1
            while end < high and words[end][depth] == letter:
                end += 1
            label = words[low][depth + 1 :]
            if end > low + 1:
                label = commonprefix([label, words[end - 1][depth + 1 :]])
            edges[letter] = label, self._state(low, end, depth + 1 + len(label))
            low = end
        known = (final, *edges.items())
        if known not in self._known:
            self._known[known] = len(self.final)
            self.final.append(final)
            self.edges.append(edges)
        return self._known[known]

    def shared(self, a: int, b: int) -> list[str]:
        """The endings that both states accept."""
        if a > b:
            a, b = b, a
        if (a, b) not in self._shared:
            found = [""] if self.final[a] and self.final[b] else []
            one, other = self.edges[a], self.edges[b]
            for letter in one.keys() & other.keys():
                found += [letter + s for s in self.behind(*one[letter], *other[letter])]
            self._shared[a, b] = found
        return self._shared[a, b]

    def behind(self, left: str, a: int, right: str, b: int) -> list[str]:
        """The endings that both ways accept: each spells its letters, then is in its state."""
        read = ""
        while True:
            n = min(len(left), len(right))
            if left[:n] != right[:n]:
                return []
            read, left, right = read + left[:n], left[n:], right[n:]
            if not left and not right:
                return [read + s for s in self.shared(a, b)]
            # One is at a state, the other within a label: take the edge it names.
            if not left:
                edge = self.edges[a].get(right[0])
            else:
                edge = self.edges[b].get(left[0])
            if edge is None:
                return []
            if not left:
                left, a = right[0] + edge[0], edge[1]
            else:
                right, b = left[0] + edge[0], edge[1]

    def one_edit_apart(self, follows: str = "") -> Iterator[tuple[str, str]]:
        """Pairs of accepted words that differ by one edit, each once, by a walk through the
        composition. ``follows`` is the letter behind all words, if there is one.

        Before the edit both sides are in one state. Within a label there is no other letter to
        edit with, so edits happen where the state branches or a word ends. Of equal letters
        in a row the last one counts as the inserted one.
        """
        waiting = [("", self.start)]
        while waiting:
            read, state = waiting.pop()
            edges = self.edges[state]
            for letter, (label, target) in edges.items():
                waiting.append((read + letter + label, target))
                if self.final[state] and letter != follows and self._accepts_end(label, target):
                    yield read + letter, read
                for other, (label_2, target_2) in edges.items():
                    if other == letter:
                        continue
                    if letter < other:
                        for s in self.behind(label, target, label_2, target_2):
                            yield read + letter + s, read + other + s
                    for s in self.behind(label, target, other + label_2, target_2):
                        yield read + letter + s, read + s

    def _accepts_end(self, label: str, state: int) -> bool:
        return not label and self.final[state]


def words_of(text: str | Column, least: int) -> Column:
    """The maximal runs of at least so many letters, A to Z lowered, as an array."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))


def small_letters(word: Column) -> Column:
    """A to Z as a to z; other letters as they are."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, capitals, capitals.lower()))


def misspelt(word: Column, doc_id: Column, one_in: int) -> Column:
    """The word; in one of so many cases, told by a hash of id and word, without a letter."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word)
    hashed = F.crc32(name.cast("binary"))
    at = (hashed % F.length(word)).cast("int")
    without = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(hashed % one_in == 0, without).otherwise(word)


def vocabulary(
    docs: DataFrame,
    *,
    one_in: int | None = None,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """word, n: the words of all texts of at least ``min_length`` letters, and how often they
    occur, from ``min_count`` times. With ``one_in`` words are first ``misspelt``."""
    runs = docs.select("doc_id", F.explode(words_of("text", min_length)).alias("run"))
    word = small_letters(F.col("run"))
    if one_in:
        word = misspelt(F.col("word"), F.col("doc_id"), one_in)
        runs = runs.withColumn("word", small_letters(F.col("run")))
    return (
        runs.select(word.alias("word"))
        .where(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
    )


_KEY = ["short", "turned", "head", "tail"]


def _halves(words: DataFrame) -> DataFrame:
    """Each word as ``head``, ``rest`` and ``tail``, once for each of its groups: by its first
    and, turned round, by its last letters, among words as long and one longer, and among
    words as long and one shorter (``short`` is the length of the shorter ones)."""
    length = F.length("word")
    sides = F.explode(
        F.array(*[
            F.struct((length - less).alias("short"), F.lit(turned).alias("turned"))
            for less in (0, 1)
            for turned in (False, True)
        ])
    )
    first = F.expr("short div 2")
    read = F.when(F.col("turned"), F.reverse("word")).otherwise(F.col("word"))
    shared = F.when(F.col("turned"), F.col("short") - first).otherwise(first).cast("int")
    return (
        words.select("word", "n", sides.alias("side"))
        .select("word", "n", "side.short", "side.turned")
        .select("short", "turned", "n", read.alias("read"), shared.alias("shared"))
        .select(
            "short",
            "turned",
            F.expr("substring(read, 1, shared)").alias("head"),
            F.lit("").alias("tail"),
            F.expr("substring(read, shared + 1)").alias("rest"),
            "n",
        )
    )


def _cut_again(rows: DataFrame) -> DataFrame:
    """Groups cut at their next letter: pairs that share it, and pairs that differ in it."""
    rest = F.col("rest")
    letter = F.expr("substring(rest, 1, 1)")
    behind = F.expr("substring(rest, 2)")
    after = F.expr("concat(substring(rest, 2), tail)")
    parts = F.filter(
        F.array(
            F.when(rest != "", F.struct(F.concat("head", letter).alias("head"),
                   F.col("tail").alias("tail"), behind.alias("rest"))),
            F.when(rest != "", F.struct(F.col("head").alias("head"), after.alias("tail"),
                   letter.alias("rest"))),
            F.struct(F.col("head").alias("head"), F.concat(rest, F.col("tail")).alias("tail"),
                     F.lit("").alias("rest")),
        ),
        lambda part: part.isNotNull(),
    )
    return rows.select("short", "turned", "n", F.explode(parts).alias("part")).select(
        "short", "turned", "part.head", "part.tail", "part.rest", "n"
    )


_NEAR = "word string, n bigint, near string, near_n bigint"

# Pairs returned at a time.
_PAIRS = 4096


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[column.to_pylist() for column in batch.columns])

    out: list[tuple] = []
    for (short, turned, head, tail), group in itertools.groupby(rows(), lambda row: row[:4]):
        counts = {row[4]: row[5] for row in group}
        if len(counts) < 2:
            continue
        acceptor = Acceptor(sorted(counts))
        for a, b in acceptor.one_edit_apart(tail[:1]):
            word, near = head + a + tail, head + b + tail
            if min(len(word), len(near)) != short:
                continue
            if turned:
                word, near = word[::-1], near[::-1]
                # Those that share their first half too have been found by it.
                if word[: short // 2] == near[: short // 2]:
                    continue
            out.append((word, counts[a], near, counts[b]))
            out.append((near, counts[b], word, counts[a]))
            if len(out) >= _PAIRS:
                yield _batch(out)
                out.clear()
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = [pa.array(list(column), kind) for column, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["word", "n", "near", "near_n"])


def near_words(words: DataFrame, *, group: int = GROUP) -> DataFrame:
    """word, n, near, near_n: all pairs of words (word, n) one edit apart, both ways round.

    Words are distinct and not empty. A group of more than ``group`` words is cut at its next
    letter, again and again, so a task holds the acceptor of so many words at most.
    """
    rows = written(_halves(words), "halves")
    done: list[DataFrame] = []
    while True:
        # Words that differ in one letter only are few, and cutting would not part them.
        sizes = rows.groupBy(*_KEY).agg(
            F.count("*").alias("size"), F.max(F.length("rest")).alias("longest")
        )
        large = sizes.where((F.col("size") > group) & (F.col("longest") > 1))
        large = written(large.select(*_KEY), "large-groups")
        if large.isEmpty():
            done.append(rows)
            break
        hint = F.broadcast(large) if fits_broadcast(large) else large
        done.append(rows.join(hint, _KEY, "left_anti").select(rows.columns))
        hot = rows.join(hint, _KEY, "left_semi").select(rows.columns)
        rows = written(_cut_again(hot), "halves")
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return (
        every.select(*_KEY, "rest", "n")
        .repartition(*_KEY)
        .sortWithinPartitions(*_KEY)
        .mapInArrow(_pairs_of, _NEAR)
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) of each word lead at last. Forms must not lead
    in a circle; each round goes twice as far as the one before."""
    found = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(
            found.join(step, "root", "left").select(
                "word",
                F.coalesce("further", "root").alias("root"),
                F.col("further").isNotNull().alias("moved"),
            ),
            "roots",
        )
        found = new.select("word", "root")
        if new.where("moved").isEmpty():
            return found


def variants(
    docs: DataFrame,
    *,
    one_in: int | None = None,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    times: int = TIMES,
    group: int = GROUP,
) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary.

    ``n_near`` is how many words are one edit away. The form is the most frequent of them (of
    equally frequent ones the first by code point) if it is ``times`` as frequent as the word;
    else form and form_n are null. The root is where forms lead from the word at last, the word
    itself if it has none.

    A null text has no words; a null ``doc_id`` counts as an empty one; equal rows count as
    often as they stand there; an empty table gives no row; other columns are not looked at.
    """
    words = written(
        vocabulary(docs, one_in=one_in, min_length=min_length, min_count=min_count), "vocabulary"
    )
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near")))
    near = near_words(words, group=group)
    of_word = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.order") >= times * F.col("n")
    joined = written(
        words.join(of_word, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"),
            F.when(enough, -F.col("best.order")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(joined.where("form IS NOT NULL"))
    return joined.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
