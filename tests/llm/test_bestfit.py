"""Certified best-fit packing against plain library calls and exhaustive packings."""

import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from corpus_fixtures import no_docs, odd_docs, tables  # noqa: F401
from pyspark.sql import functions as F

from gradeweave.llm import queries
from gradeweave.llm.bestfit import best_fit_decreasing, lower_bound, pack_certified
from gradeweave.llm.chunks import WordCoder

ODD_TEXTS = [
    "J̌ H̱ å Å <|ENDOFTEXT|> b",
    "<|endoftext|>x It's İİ don'T'LL",
    "a\x1cb\x85c\xa0d",
    "  x\n\n\ty ",
    "",
    "日本 語　é ñ 123 45a \x00 q",
    "Σ ΟΔΟΣ ς",
    "x\n",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(queries.WORD_TOKENIZER))


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def fewest(items, capacity):
    """The least number of sequences, by trying all packings."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, filled):
        if len(filled) >= best[0]:
            return
        if i == len(items):
            best[0] = len(filled)
            return
        for k in range(len(filled)):
            if filled[k] + items[i] <= capacity:
                go(i + 1, filled[:k] + [filled[k] + items[i]] + filled[k + 1 :])
        go(i + 1, [*filled, items[i]])

    go(0, [])
    return best[0]


def test_bounds_never_exceed_the_least_number():
    rng = random.Random(3)
    tight = 0
    for _ in range(300):
        capacity = rng.choice([10, 12, 20, 37])
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 8))]
        bound = lower_bound(np.bincount(items, minlength=capacity + 1), capacity)
        assert bound <= fewest(items, capacity)
        tight += bound == fewest(items, capacity)
    assert tight > 290


def test_bounds_see_more_than_the_sum():
    # Three of 0.51 need three sequences; 0.34 fits twice, so four of it need two.
    assert lower_bound(np.bincount([51] * 3, minlength=101), 100) == 3
    assert lower_bound(np.bincount([34] * 5, minlength=101), 100) == 3
    assert lower_bound(np.zeros(101, int), 100) == 0


def test_best_fit_takes_the_tightest_sequence():
    lengths = np.array([7, 6, 3, 3, 1])
    assert best_fit_decreasing(lengths, 10).tolist() == [0, 1, 0, 1, 1]


def test_coder_is_the_library(library):
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "'s", "1", "é", "̌", "J", "<|endoftext|>", "<|", "日",
             "Σ", "\t", "\xa0", "\x1c", "...", "ñ", "İ"]
    texts = ODD_TEXTS + ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(3000)]
    coder = WordCoder(queries.tokenizer_path(queries.WORD_TOKENIZER), memo=50)
    for some in (texts[:1500], texts[1500:]):
        for text, got in zip(some, coder.codes(some)):
            assert got + b"\0\0\0\0" == ids_of(library, text).tobytes(), text


def test_plain_chunks_are_coded_by_the_model(library):
    coder = WordCoder(queries.tokenizer_path(queries.WORD_TOKENIZER))
    text = "It's 3 foxes' qzxv-jkwq, we'll (see) @12:30! " + "".join(map(chr, range(32, 127)))
    coder.library = SimpleNamespace(model=coder.library.model)
    assert coder.codes([text])[0] + b"\0\0\0\0" == ids_of(library, text).tobytes()


def check(rows, texts, library, capacity, column="ids_crc32"):
    """Every id of every document in one piece, every sequence within its limit."""
    ids = {doc_id: ids_of(library, text) for doc_id, text in texts}
    pieces, sequences = {}, {}
    for row in rows:
        pieces.setdefault(row["doc_id"], []).append(row)
        sequences.setdefault(row["sequence_id"], []).append(row)
    assert pieces.keys() == ids.keys()
    for doc_id, whole in ids.items():
        mine = sorted(pieces[doc_id], key=lambda row: row["piece"])
        assert [row["piece"] for row in mine] == list(range(-(-len(whole) // capacity)))
        for row in mine:
            part = whole[row["start"] : row["start"] + row["length"]]
            assert row["start"] == capacity * row["piece"] and len(part) == row["length"]
            assert len(part) == min(capacity, len(whole) - row["start"])
            expected = part.tobytes() if column == "ids" else zlib.crc32(part.tobytes())
            assert row[column] == expected
    for held in sequences.values():
        at = 0
        for row in sorted(held, key=lambda row: row["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at <= capacity
    return len(sequences)


def test_query(spark, tables, library):
    rows = queries.certified_packing(spark, tables).collect()
    texts = queries.documents(spark, tables).select("doc_id", "text").collect()
    used = check(rows, texts, library, 2048)
    counts = np.bincount([row["length"] for row in rows], minlength=2049)
    assert used - lower_bound(counts, 2048) <= 1


def test_exchange_lowers_the_number_and_certifies_groups(spark, tables, library):
    docs = queries.documents(spark, tables)
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    apart = pack_certified(docs, path, capacity=512, group=8, rounds=0)
    packed = pack_certified(docs, path, capacity=512, group=8)
    texts = docs.select("doc_id", "text").collect()
    assert check(packed.pieces.collect(), texts, library, 512, "ids") == packed.sequences
    assert packed.bound <= packed.sequences < apart.sequences == apart.pieces.select(
        "sequence_id"
    ).distinct().count()
    assert packed.exchanges > 0
    for group in packed.groups.collect():
        assert group["bound"] <= group["sequences"]
    whole = packed.pieces.where("length = 512").count()
    assert packed.groups.agg(F.sum("sequences")).first()[0] + whole == packed.sequences


def test_odd_rows(spark, odd_docs, no_docs, library):
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    packed = pack_certified(odd_docs.withColumn("key", F.lit("clash")), path, capacity=128)
    rows = packed.pieces.collect()
    for row in odd_docs.groupBy("doc_id", "text").count().collect():
        length = len(ids_of(library, row["text"]))
        mine = [r["length"] for r in rows if r["doc_id"] == row["doc_id"]]
        assert sum(mine) == row["count"] * length
    assert len({r["sequence_id"] for r in rows}) == packed.sequences
    none = pack_certified(no_docs, path)
    assert none.pieces.count() == none.sequences == none.bound == 0
