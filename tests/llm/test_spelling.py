"""Spelling variants against brute force: the composition, the whole query, odd rows."""

import collections
import random
import re
import zlib

import pytest
from corpus_fixtures import no_docs, odd_docs, tables  # noqa: F401

from gradeweave.llm import queries
from gradeweave.llm.spelling import Acceptor, near_words, roots, variants, vocabulary

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def random_words(rng, letters, shortest, longest, n):
    return sorted(
        {"".join(rng.choices(letters, k=rng.randrange(shortest, longest))) for _ in range(n)}
    )


def test_composition_accepts_each_pair_once():
    rng = random.Random(5)
    for letters in ("ab", "abcé"):
        for _ in range(400):
            words = random_words(rng, letters, 0, 7, rng.randrange(25))
            found = [tuple(sorted(pair)) for pair in Acceptor(words).one_edit_apart()]
            assert len(found) == len(set(found))
            assert set(found) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_acceptor_is_minimal():
    acceptor = Acceptor(["drank", "drunk", "shrank", "shrunk"])
    # start, one state behind dr and shr, one behind ank and unk
    assert len(acceptor.final) == 3


@pytest.mark.parametrize("group", [50_000, 20, 2])
def test_groups_cut_again_give_the_same_pairs(spark, group):
    words = random_words(random.Random(7), "abé", 7, 10, 400)
    table = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    found = [(r.word, r.near) for r in near_words(table, group=group).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if near(a, b)}


def expected(docs, least=7, one_in=31):
    lower = str.maketrans(CAPITALS, CAPITALS.lower())
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(lower)
            hashed = zlib.crc32(f"{doc_id}:{word}".encode())
            if hashed % one_in == 0:
                at = hashed % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += len(word) >= least
    n = {word: count for word, count in counts.items() if count >= 2}
    by = collections.defaultdict(set)
    for word in n:
        by[word].add(word)
        for i in range(len(word)):
            by[word[:i] + word[i + 1 :]].add(word)
            by[word[:i] + "*" + word[i + 1 :]].add(word)
    around = collections.defaultdict(set)
    for group in by.values():
        for a in group:
            around[a].update(b for b in group if near(a, b))
    form = {}
    for word, others in around.items():
        if others:
            best = min(others, key=lambda other: (-n[other], other))
            if n[best] >= 10 * n[word]:
                form[word] = best

    def root(word):
        while word in form:
            word = form[word]
        return word

    return {
        (w, form.get(w), root(w), c, len(around[w]), n[form[w]] if w in form else None)
        for w, c in n.items()
    }


def test_query(spark, tables):
    docs = queries.documents(spark, tables).select("doc_id", "text").collect()
    got = queries.spelling_variants(spark, tables)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(row) for row in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == expected(docs)


def test_forms_are_followed_to_the_root(spark):
    texts = {"receives": 300, "recieves": 0, "receivess": 25, "receivessx": 2, "recezves": 2}
    docs = [(1, f"{word} Receives,{word}") for word in ("x",)]
    docs += [(i, word) for i, (word, n) in enumerate(texts.items()) for _ in range(n)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {row["word"]: row for row in variants(docs, min_length=7).collect()}
    assert got["receives"]["n"] == 301 and got["receives"]["form"] is None
    assert got["receivessx"]["form"] == "receivess"
    assert got["receivessx"]["root"] == got["receivess"]["root"] == "receives"
    assert got["recezves"]["form"] == "receives" and got["receives"]["n_near"] == 2


def test_long_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(20)]
    found = roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {row["word"]: row["root"] for row in found} == {f"w{i}": "w20" for i in range(20)}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = vocabulary(odd_docs, min_length=4).collect()
    # Equal rows count as often as they stand there, a null id as well.
    assert {r["word"]: r["n"] for r in rows} == {"same": 12, "words": 6, "three": 8000}
    assert variants(no_docs).count() == 0
    tied = spark.createDataFrame(
        [(None, "aaaaaaab aaaaaaac " * 10 + "aaaaaaaa ÀÉaaaaaa"), (None, "aaaaaaaa")],
        "doc_id long, text string",
    )
    got = {row["word"]: row for row in variants(tied, times=5).collect()}
    assert got["aaaaaaaa"]["form"] == "aaaaaaab" and got["aaaaaaaa"]["n_near"] == 2


def test_very_long_words(spark):
    rng = random.Random(2)
    word = "".join(rng.choices("abcdefgh", k=200_000))
    other = word[:150_000] + "z" + word[150_000:]
    docs = spark.createDataFrame(
        [(1, f"{word} {other} {word} {other}")], "doc_id long, text string"
    )
    got = {row["word"]: row["n_near"] for row in variants(docs).collect()}
    assert got == {word: 1, other: 1}
    # Every deletion of one long word: as many branches behind one another as it has letters.
    word = word[:1200]
    words = sorted({word[:i] + word[i + 1 :] for i in range(1200)} | {word})
    pairs = {frozenset(pair) for pair in Acceptor(words).one_edit_apart()}
    assert sum(word in pair for pair in pairs) == len(words) - 1
