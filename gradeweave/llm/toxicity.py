"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: words, and the first letters of longer words. Besides a
weight, each term has a short vector; every pair of terms that occur together adds the
product of their vectors, so that two harmless terms can be harmful together. Every term of
the sample that is not too rare is learned, whatever it tells alone; what shrinks weights and
vectors while they are fitted keeps long texts from being drowned.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.llm.samples import bounded_sample, remainder, texts_of
from gradeweave.llm.text import Batch, batches, hashes, lowered

# Terms are hashed to so many numbers.
HASH_BITS = 20
STARTS = (4, 5, 6)

# Texts of the sample that must have a term. No term is left out for what it tells alone.
LEAST = 3
FACTORS = 8

# Texts of one step of the fit, and what its first step sizes are divided by, squared.
AT_ONCE = 128
FIRST = 1e-3

# Bound of the training sample: documents of each label, and the remainder of crc32(doc_id)
# modulo 5 that is never learned from.
PER_LABEL = 4000
HELD_OUT = 0
HELD_OUT_OF = 5


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether the row is kept from training; so is a row without an id."""
    return F.coalesce(remainder(doc_id, HELD_OUT_OF) == HELD_OUT, F.lit(True))


def terms(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash number of each occurrence of a term."""
    data = lowered(batch.data)
    wordy = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 0x80)
    size = len(data)
    edge = np.zeros(size + 1, bool)
    edge[batch.bounds] = True
    before, after = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    before[1:] = wordy
    after[:-1] = wordy
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    text = np.searchsorted(batch.bounds, start, "right") - 1
    texts, numbers = [text], [hashes(data, start, end)]
    for n in STARTS:
        longer = end - start > n
        texts.append(text[longer])
        numbers.append(~hashes(data, start[longer], start[longer] + n))
    number = (np.concatenate(numbers) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    return np.concatenate(texts), number


class Machine(NamedTuple):
    terms: np.ndarray  # hash numbers, ascending
    weights: np.ndarray
    vectors: np.ndarray
    bias: float


def score(model: Machine, text: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of n texts, from the places of the model's terms in them, each once."""
    line = np.bincount(text, model.weights[place], n)
    pairs = np.zeros(n)
    for v in model.vectors.T:
        pairs += np.bincount(text, v[place], n) ** 2 - np.bincount(text, v[place] ** 2, n)
    return model.bias + line + pairs / 2


def present(model_terms: np.ndarray, text: np.ndarray, number: np.ndarray) -> tuple:
    """The model's terms in each text, each once: text number and place of the term."""
    if not len(model_terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(model_terms, number), len(model_terms) - 1)
    known = model_terms[place] == number
    key = np.unique(text[known] * len(model_terms) + place[known])
    return key // len(model_terms), key % len(model_terms)


def train(
    documents: list[np.ndarray], labels: list[int], share: float, rounds: int = 15,
    rate: float = 0.05, decay: float = 2e-4, shrink: float = 3e-3, shrink_pairs: float = 5e-3,
) -> Machine:
    """``documents`` are the distinct hash numbers of each text; ``share`` the share of label
    1 in the whole table, which is the score of every text where only one label is given.

    Each of ``rounds`` goes over all texts in steps of a few, which change only the terms in
    them. Such a step also takes ``decay`` of the values, ``shrink`` off the size of each
    weight and ``shrink_pairs`` off the length of each vector. The defaults of ``rounds``,
    ``shrink``, ``shrink_pairs`` and the unshifted bias had the best mean F1 over the four folds
    of learnable rows (crc32 modulo 5), of some 45 settings with five shifts of the bias each;
    no held-out row was looked at.
    """
    y = np.array(labels, np.float32)
    odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    if len(set(labels)) < 2:
        return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), float(odds))
    number = np.concatenate(documents)
    text = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    known = np.flatnonzero(np.bincount(number, minlength=1 << HASH_BITS) >= LEAST)
    text, place = present(known, text, number)
    n, ones = len(y), y.sum()
    bounds = np.searchsorted(text, np.arange(n + 1))
    # The classes weigh alike.
    weight = np.where(y == 1, 0.5 * n / ones, 0.5 * n / (n - ones)).astype(np.float32)
    draw = np.random.default_rng(1)
    # Weight and vector of each term, and the sum of their squared slopes.
    values = np.zeros((len(known), 1 + FACTORS), np.float32)
    values[:, 1:] = draw.normal(0, 0.02, (len(known), FACTORS))
    slopes = np.full_like(values, FIRST)
    bias, bias_slopes = 0.0, 1e-8
    for _ in range(rounds):
        order = draw.permutation(n)
        for first in range(0, n, AT_ONCE):
            some = order[first : first + AT_ONCE]
            inside = [place[bounds[i] : bounds[i + 1]] for i in some]
            row = np.repeat(np.arange(len(some)), [len(p) for p in inside])
            used, column = np.unique(np.concatenate(inside), return_inverse=True)
            x = np.zeros((len(some), len(used)), np.float32)
            x[row, column] = 1
            w, v = values[used, 0], values[used, 1:]
            sums = x @ v
            out = bias + x @ w + ((sums**2).sum(axis=1) - x @ (v**2).sum(axis=1)) / 2
            off = weight[some] * (y[some] - 1 / (1 + np.exp(-np.clip(out, -30, 30))))
            off = (off / len(some)).astype(np.float32)
            seen = x.T @ off
            slope = np.column_stack((seen, x.T @ (off[:, None] * sums) - seen[:, None] * v))
            slope -= decay * values[used]
            slopes[used] += slope**2
            step = rate / np.sqrt(slopes[used])
            moved = values[used] + step * slope
            w, v = moved[:, 0], moved[:, 1:]
            w[:] = np.sign(w) * np.maximum(np.abs(w) - shrink * step[:, 0], 0)
            length = np.maximum(np.sqrt((v**2).sum(axis=1)), 1e-12)
            v *= np.maximum(1 - shrink_pairs * step[:, 1:].mean(axis=1) / length, 0)[:, None]
            values[used] = moved
            total = float(off.sum())
            bias_slopes += total**2
            bias += rate * total / np.sqrt(bias_slopes)
    # The bias stays that of classes of equal weight: a toxic text that is missed weighs more
    # than a false alarm.
    return Machine(known, values[:, 0], values[:, 1:], float(bias))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Machine:
    """Learn ``toxic`` from at most ``per_label`` rows of each label that are not held out.

    The sample's sets of term numbers come to the driver. Without both labels the score is
    the share of label 1 for every text.
    """

    def sets(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            rows = []
            for part in batches(batch.column("text")):
                n = len(part.bounds) - 1
                text, number = terms(part)
                key = np.unique((text << HASH_BITS) | number)
                bounds = np.searchsorted(key, np.arange(n + 1) << HASH_BITS)
                number = (key & ((1 << HASH_BITS) - 1)).astype(np.int32)
                rows += [number[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())],
                ["doc_id", "label", "terms"],
            )

    known = labels.where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1))
    counts = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    sample = texts_of(docs, bounded_sample(known, "toxic", per_label), "toxic")
    rows = sorted(sample.mapInArrow(sets, "doc_id bigint, label int, terms binary").collect())
    documents = [np.frombuffer(row["terms"], np.int32).astype(np.int64) for row in rows]
    return train(documents, [row["label"] for row in rows], share)


_SCORED = "doc_id bigint, score double, predicted int"


def rate(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id, score, predicted of each row, from its text alone.

    A null or empty text has no terms and gets the score of such a text. Other columns are
    not looked at; equal texts get equal scores.
    """

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for part in batches(batch.column("text")):
                n = len(part.bounds) - 1
                found = present(model.terms, *terms(part))
                odds = np.clip(score(model, *found, n), -30, 30)
                share = 1 / (1 + np.exp(-odds))
                ids = batch.column("doc_id").slice(part.first, n)
                predicted = (share >= 0.5).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(share), pa.array(predicted)], ["doc_id", "score", "predicted"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, _SCORED)
