"""Language by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over byte n-grams
predicts whether the text's language has it set. The prediction is the codeword with the least
total loss, each bit's loss weighted by how reliable its classifier is; when the second
best is nearly as good, the text is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.llm.samples import bounded_sample, remainder, texts_of
from gradeweave.llm.text import Batch, batches, lowered, mix

UNDETERMINED = "und"

# N-grams of these lengths, within words and their borders, hashed to so many counters.
LENGTHS = (1, 2, 3)
COUNTERS = 2048

# Bound of the training sample: documents of each language, and the remainder of
# crc32(doc_id) modulo 4 that is never learned from.
PER_LANGUAGE = 1000
HELD_OUT = 2
HELD_OUT_OF = 4

# Up to this many languages every bit that tells some apart is used; beyond it, so many bits
# for each doubling of their number.
EXHAUSTIVE = 5
BITS_PER_DOUBLING = 10

# A text is ambiguous when the best language's probability is less.
SURE = 0.6

# Texts of this many bytes are counted at a time; each text takes COUNTERS numbers.
_SLICE = 1 << 18


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether the row is kept from training; so is a row without an id."""
    return F.coalesce(remainder(doc_id, HELD_OUT_OF) == HELD_OUT, F.lit(True))


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1, far from each other; every column has both."""
    if n < 2:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        number = np.arange(1, 1 << (n - 1))
        return np.where(number[None, :] >> np.arange(n)[:, None] & 1, 1.0, -1.0)
    bits = int(np.ceil(BITS_PER_DOUBLING * np.log2(n)))
    best, least = None, -1
    draw = np.random.default_rng(n)
    for _ in range(100):
        code = np.where(draw.permuted(np.arange(n)[:, None] * 2 < np.full((1, bits), n), axis=0), 1.0, -1.0)
        apart = (bits - code @ code.T) / 2
        distance = apart[~np.eye(n, dtype=bool)].min()
        if distance > least:
            best, least = code, distance
    return best


def profiles(batch: Batch) -> np.ndarray:
    """One row per text: square roots of the shares of its n-grams, by hash."""
    data = lowered(batch.data).astype(np.uint64)
    texts = len(batch.bounds) - 1
    letter = ((data >= 97) & (data <= 122)) | (data >= 0x80)
    data[~letter] = 32
    text_of = np.repeat(np.arange(texts), np.diff(batch.bounds))
    counts = np.zeros(texts * COUNTERS)
    for n in LENGTHS:
        if len(data) < n:
            continue
        reach = len(data) - n + 1
        gram = np.full(reach, n, np.uint64)
        letters = np.zeros(reach, bool)
        for j in range(n):
            gram = (gram << np.uint64(8)) | data[j : j + reach]
            letters |= letter[j : j + reach]
        same = letters & (text_of[:reach] == text_of[n - 1 :])
        place = (mix(gram[same]) % np.uint64(COUNTERS)).astype(np.int64)
        counts += np.bincount(text_of[:reach][same] * COUNTERS + place, minlength=len(counts))
    counts = counts.reshape(texts, COUNTERS)
    return np.sqrt(counts / np.maximum(1.0, counts.sum(axis=1, keepdims=True))).astype(np.float32)


class Coded(NamedTuple):
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # [counter, bit]
    bias: np.ndarray
    trust: np.ndarray  # by bit


def train(
    x: np.ndarray, named: list[str], rounds: int = 150, rate: float = 0.5, decay: float = 1e-5
) -> Coded:
    """A logistic classifier per bit, by gradient steps (Adam), languages weighted alike."""
    languages = sorted(set(named))
    code = codewords(len(languages))
    which = np.searchsorted(languages, named)
    bits = code.shape[1]
    weights, bias = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    if not bits:
        return Coded(languages, code, weights, bias, np.ones(0))
    y = code[which].astype(np.float32)
    share = (1 / np.bincount(which)[which] / len(languages)).astype(np.float32)[:, None]
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for r in range(1, rounds + 1):
        off = share * y / (1 + np.exp(np.clip(y * (x @ weights + bias), -30, 30)))
        slope = x.T @ off - decay * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights += rate * first / (1 - 0.9**r) / (np.sqrt(second / (1 - 0.99**r)) + 1e-7)
        bias += rate * off.sum(axis=0)
    right = (share * (y * (x @ weights + bias) > 0)).sum(axis=0)
    return Coded(languages, code, weights, bias, np.maximum(2 * right - 1, 0.01))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Coded | None:
    """Learn from text and lang of at most ``per_language`` rows of each language that are
    not held out; None if there is none. The sample's profiles come to the driver."""

    def counted(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            rows = [
                row.tobytes()
                for part in batches(batch.column("text"), _SLICE)
                for row in profiles(part).astype(np.float16)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())],
                ["doc_id", "label", "profile"],
            )

    known = docs.where(~held_out()).select("doc_id", "lang")
    sample = texts_of(docs, bounded_sample(known, "lang", per_language), "lang")
    schema = "doc_id bigint, label string, profile binary"
    rows = sorted(sample.mapInArrow(counted, schema).collect())
    if not rows:
        return None
    x = np.stack([np.frombuffer(row["profile"], np.float16) for row in rows]).astype(np.float32)
    return train(x, [row["label"] for row in rows])


def decode(model: Coded, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest codeword, and its probability among all."""
    bits = x @ model.weights + model.bias
    loss = np.logaddexp(0, -model.code[None] * bits[:, None]) @ model.trust
    weight = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return loss.argmin(axis=1), weight.max(axis=1) / weight.sum(axis=1)


_NAMED = "doc_id bigint, lang_pred string, score double, ambiguous boolean"


def identify(docs: DataFrame, model: Coded | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of each row, from its text alone.

    A text without a letter, or null, is ``und`` with score 0; so is every text when nothing
    was learned. Other columns are not looked at; equal texts get equal answers.
    """

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for part in batches(batch.column("text"), _SLICE):
                n = len(part.bounds) - 1
                lettered = has_letters(part) & (model is not None)
                names, scores = np.full(n, UNDETERMINED, object), np.zeros(n)
                if lettered.any():
                    best, sure = decode(model, profiles(part)[lettered])
                    names[lettered] = np.array(model.languages, object)[best]
                    scores[lettered] = sure
                ids = batch.column("doc_id").slice(part.first, n)
                yield pa.RecordBatch.from_arrays(
                    [ids, *map(pa.array, (names.tolist(), scores, scores < SURE))],
                    ["doc_id", "lang_pred", "score", "ambiguous"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _NAMED)


def has_letters(batch: Batch) -> np.ndarray:
    """Whether each text has a letter of any script."""
    low = lowered(batch.data)
    total = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122), dtype=np.int64)))
    found = total[batch.bounds[1:]] > total[batch.bounds[:-1]]
    for i in np.flatnonzero(~found):
        text = batch.data[batch.bounds[i] : batch.bounds[i + 1]].tobytes().decode()
        found[i] = any(c.isalpha() for c in text)
    return found
