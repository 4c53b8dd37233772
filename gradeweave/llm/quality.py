"""Quality by lines: a linear-chain CRF marks each line as content or boilerplate.

The lines of a text that have a word form a chain. Each line has a few features of its form;
the CRF scores the two labels from them and from the label before, and Viterbi decoding gives
the best labels of the whole chain. A text is kept if enough of its words are in lines
marked as content. The CRF is trained on documents with a quality label, whose lines
all take the document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.llm.samples import bounded_sample, remainder, texts_of
from gradeweave.llm.text import Batch, batches, digests, mix, separators, words

# Base rule: fewer words, or a larger percentage of repeated ones, and a text fails.
LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8

# Least share of words in content lines.
CONTENT_SHARE = 0.5

# Bound of the training sample: documents of each label. One document in five is left out,
# for measuring.
PER_LABEL = 2000
HELD_OUT_OF = 5

# Lines of one training sequence; longer documents give several.
SEQUENCE = 64

FEATURES = (
    "bias", "words", "word_length", "upper", "symbols", "digits", "ended", "repeated_line",
    "distinct", "stutter", "bare_symbols", "shouted", "repeated_words",
)


class Base(NamedTuple):
    """Per text, and the features of the lines that have words."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    failed: np.ndarray
    features: np.ndarray
    line_words: np.ndarray
    first_line: np.ndarray  # text i has the lines first_line[i] to first_line[i + 1]


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:;\"')")] = True


def _sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[end] - total[start]


def _seen_before(key: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    return again


def _within(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Keys that are equal only within one group."""
    return mix(key + mix(group.astype(np.uint64)))


def measure(batch: Batch) -> Base:
    data, bounds = batch.data, batch.bounds
    texts = len(bounds) - 1
    space = separators(data)
    found = words(batch, space)
    n_words = np.diff(found.first)
    hashed = digests(data, found.start, found.end)
    text_of = np.repeat(np.arange(texts), n_words)
    begins = (data & 0xC0) != 0x80
    symbol = _SYMBOL[data]

    # Windows of equal words in the same text, and the words they cover.
    repeated = np.zeros(len(hashed), bool)
    if len(hashed) >= WINDOW:
        at = np.flatnonzero(text_of[: -WINDOW + 1] == text_of[WINDOW - 1 :])
        value = np.zeros(len(at), np.uint64)
        for j in range(WINDOW):
            value = mix(value + hashed[at + j])
        _, which, number = np.unique(
            _within(value, text_of[at]), return_inverse=True, return_counts=True
        )
        at = at[number[which] > 1]
        edges = np.zeros(len(hashed) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + WINDOW, -1)
        repeated = np.cumsum(edges)[:-1] > 0
    n_repeat = np.bincount(text_of[repeated], minlength=texts)

    # Lines: they end before a line feed or where the text ends.
    feeds = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((bounds[:-1], feeds + 1)))
    end = np.sort(np.concatenate((feeds, bounds[1:])))
    first_word = np.searchsorted(found.start, start)
    after_word = np.searchsorted(found.start, end)
    worded = after_word > first_word
    start, end = start[worded], end[worded]
    first_word, after_word = first_word[worded], after_word[worded]
    line_text = text_of[first_word]
    line_words = after_word - first_word
    again = _seen_before(_within(digests(data, start, end), line_text))

    line_of = np.repeat(np.arange(len(start)), line_words)
    new_word = ~_seen_before(_within(hashed, line_of)) if len(hashed) else np.zeros(0, bool)
    stutter = np.zeros(len(hashed), bool)
    stutter[1:] = (hashed[1:] == hashed[:-1]) & (line_of[1:] == line_of[:-1])
    bare = (found.end - found.start == 1) & symbol[found.start]
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 0x80)
    chars = np.maximum(1, _sums(begins & ~space, start, end))
    last = found.end[after_word - 1] - 1
    shares = (
        np.ones(len(start)),
        np.log1p(line_words) / 5,
        chars / line_words / 10,
        _sums(upper, start, end) / np.maximum(1, _sums(letter, start, end)),
        _sums(symbol, start, end) / chars,
        _sums((data >= 48) & (data <= 57), start, end) / chars,
        _ENDS[data[last]],
        again,
        _sums(new_word, first_word, after_word) / line_words,
        _sums(stutter, first_word, after_word) / line_words,
        _sums(bare, first_word, after_word) / line_words,
        _sums(data == 33, start, end) / line_words,
        _sums(repeated, first_word, after_word) / line_words,
    )
    return Base(
        n_words,
        _sums(begins & ~space, bounds[:-1], bounds[1:]),
        _sums(symbol, bounds[:-1], bounds[1:]),
        np.bincount(line_text[again], minlength=texts),
        n_repeat,
        (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words),
        np.stack(shares, axis=1).astype(np.float32),
        line_words,
        np.searchsorted(line_text, np.arange(texts + 1)),
    )


class Crf(NamedTuple):
    """Score of content over boilerplate by feature, and of each label after each."""

    weights: np.ndarray
    step: np.ndarray  # [before, after]; 0 boilerplate, 1 content


# What stands without labels of both kinds: every line is content.
NO_CRF = Crf(np.array([1.0] + [0.0] * (len(FEATURES) - 1)), np.zeros((2, 2)))


def viterbi(model: Crf, features: np.ndarray, first_line: np.ndarray) -> np.ndarray:
    """The best labels of the lines of each text, all texts side by side."""
    score = features @ model.weights
    labels = np.zeros(len(score), np.int8)
    came = np.zeros((len(score), 2), np.int8)
    length = np.diff(first_line)
    order = np.argsort(-length, kind="stable")
    at = first_line[:-1][order]
    number = len(order) - np.searchsorted(np.sort(length), np.arange(length.max(initial=0)), "right")
    best = np.zeros((len(order), 2))
    for t, n in enumerate(number):
        if t:
            ways = best[:n, :, None] + model.step
            came[at[:n] + t] = ways.argmax(axis=1)
            best[:n] = ways.max(axis=1)
        best[:n, 1] += score[at[:n] + t]
    for k, size in enumerate(length[order]):
        if not size:
            break
        label = int(best[k, 1] >= best[k, 0])
        line = at[k] + size - 1
        if size == 1:
            labels[line] = label
            continue
        for step in came[at[k] : line + 1][::-1]:
            labels[line] = label
            label, line = int(step[label]), line - 1
    return labels


def train(
    sequences: list[np.ndarray], labels: list[int], rounds: int = 200, rate: float = 0.1,
    decay: float = 1e-3,
) -> Crf:
    """Maximum likelihood by gradient steps (Adam), classes weighted alike."""
    if len(set(labels)) < 2:
        return NO_CRF
    cut = [
        (s[i : i + SEQUENCE], y) for s, y in zip(sequences, labels) for i in range(0, len(s), SEQUENCE)
    ]
    n, width = len(cut), len(FEATURES)
    x = np.zeros((n, SEQUENCE, width), np.float32)
    size = np.array([len(s) for s, _ in cut])
    for i, (s, _) in enumerate(cut):
        x[i, : len(s)] = s
    y = np.array([label for _, label in cut])
    there = np.arange(SEQUENCE) < size[:, None]
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    weights, step = np.zeros(width), np.zeros((2, 2))
    moments = [np.zeros(width + 4), np.zeros(width + 4)]
    gold = (there * y[:, None]).astype(float)
    for r in range(1, rounds + 1):
        emit = np.zeros((n, SEQUENCE, 2))
        emit[:, :, 1] = x @ weights.astype(np.float32)
        emit *= there[:, :, None]
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for t in range(1, SEQUENCE):
            ways = forward[:, t - 1, :, None] + step
            new = np.logaddexp(ways[:, 0], ways[:, 1]) + emit[:, t]
            forward[:, t] = np.where(there[:, t, None], new, forward[:, t - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(SEQUENCE - 2, -1, -1):
            ways = step + (emit[:, t + 1] + backward[:, t + 1])[:, None, :]
            new = np.logaddexp(ways[:, :, 0], ways[:, :, 1])
            backward[:, t] = np.where(there[:, t + 1, None], new, 0.0)
        content = np.exp(np.minimum(0, forward[:, :, 1] + backward[:, :, 1] - total[:, None]))
        off = (gold - content * there) * share[:, None]
        slope = np.zeros(width + 4)
        slope[:width] = np.einsum("nt,ntf->f", off, x)
        pairs = (
            forward[:, :-1, :, None] + step + (emit[:, 1:] + backward[:, 1:])[:, :, None, :]
            - total[:, None, None, None]
        )
        mass = np.exp(np.minimum(0, pairs)) * (there[:, 1:] * share[:, None])[:, :, None, None]
        seen = np.zeros((2, 2))
        for label in (0, 1):
            seen[label, label] = ((size - 1) * share)[y == label].sum()
        slope[width:] = (seen - mass.sum(axis=(0, 1))).ravel()
        slope -= decay * np.concatenate((weights, step.ravel()))
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope**2
        change = rate * moments[0] / (1 - 0.9**r) / (np.sqrt(moments[1] / (1 - 0.99**r)) + 1e-8)
        weights, step = weights + change[:width], step + change[width:].reshape(2, 2)
    return Crf(weights, step)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Crf:
    """Train on at most ``per_label`` documents of each quality label (doc_id, quality).

    Only line features of the sample come to the driver.
    """

    def lines(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            features = []
            for part in batches(batch.column("text")):
                base = measure(part)
                for a, b in zip(base.first_line[:-1], base.first_line[1:]):
                    features.append(base.features[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(features, pa.binary())],
                ["doc_id", "label", "features"],
            )

    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.where(remainder("doc_id", HELD_OUT_OF) != 0)
    sample = texts_of(docs, bounded_sample(known, "quality", per_label), "quality")
    rows = sorted(sample.mapInArrow(lines, "doc_id bigint, label int, features binary").collect())
    sequences = [
        np.frombuffer(row["features"], np.float32).reshape(-1, len(FEATURES)) for row in rows
    ]
    pairs = [(s, int(row["label"] > 0)) for s, row in zip(sequences, rows) if len(s)]
    return train([s for s, _ in pairs], [y for _, y in pairs])


def judge(model: Crf, batch: Batch, least: float) -> tuple[Base, np.ndarray, np.ndarray]:
    """The measures of each text, its share of words in content lines, and the verdict."""
    base = measure(batch)
    content = viterbi(model, base.features, base.first_line) == 1
    share = _sums(base.line_words * content, base.first_line[:-1], base.first_line[1:])
    share = share / np.maximum(1, base.n_words)
    return base, share, ~base.failed & (share >= least)


_ASSESSED = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, content_share double, kept boolean"
)


def assess(docs: DataFrame, model: Crf, least: float = CONTENT_SHARE) -> DataFrame:
    """Measures and verdict of each row of ``docs`` (doc_id, text).

    A null or wordless text has no words and fails the base rule. Every row is judged by its
    text alone: equal texts get equal verdicts, null ids stay null. Other columns are not
    looked at.
    """

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for part in batches(batch.column("text")):
                base, share, kept = judge(model, part, least)
                ids = batch.column("doc_id").slice(part.first, len(kept))
                numbers = [x.astype(np.int64) for x in base[:5]]
                columns = [ids, *map(pa.array, (*numbers, base.failed, share, kept))]
                names = [field.split()[0] for field in _ASSESSED.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, _ASSESSED)


def retained(docs: DataFrame, model: Crf, least: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with all their columns."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            verdicts = [judge(model, part, least)[2] for part in batches(batch.column("text"))]
            if verdicts:
                yield batch.filter(pa.array(np.concatenate(verdicts)))

    return docs.mapInArrow(run, docs.schema)
