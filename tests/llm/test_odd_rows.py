"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns; parts of
the operators that the registered queries do not show."""

from types import SimpleNamespace

import numpy as np
import pytest
from corpus_fixtures import no_docs, odd_docs  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeweave.llm import (
    curriculum, disclosure, fingerprints, language, packing, quality, queries, simple8b, toxicity,
    warc,
)
from gradeweave.llm.components import components
from gradeweave.llm.jaccard import jaccard_groups, one_of_each
from gradeweave.llm.tokens import Coder

MODEL = quality.Crf(np.array([2.0] + [0.0] * 12), np.zeros((2, 2)))
CODED = language.train(
    np.eye(4, language.COUNTERS, dtype=np.float32), ["en", "de", "en", "de"], rounds=5
)
MACHINE = toxicity.train([np.array([1]), np.array([2])] * 5, [0, 1] * 5, 0.1, rounds=5)

OPERATORS = {
    "fingerprints": fingerprints.edited_fingerprints,
    "quality": lambda docs: quality.assess(docs, MODEL),
    "retained": lambda docs: quality.retained(docs, MODEL),
    "language": lambda docs: language.identify(docs, CODED),
    "curriculum": curriculum.curriculum,
    "toxicity": lambda docs: toxicity.rate(docs, MACHINE),
    "personal data": disclosure.protected,
    "cleaned": disclosure.cleaned,
    "packing": lambda docs: packing.pack(docs, queries.tokenizer_path()),
    "token files": lambda docs: simple8b.read_ids(
        simple8b.write_ids(docs, queries.tokenizer_path())
    ),
    "jaccard": lambda docs: jaccard_groups(docs, k=4, percent=85),
    "one of each": lambda docs: one_of_each(docs, k=4, percent=85),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(odd_docs, no_docs, name):
    rows = OPERATORS[name](odd_docs).collect()
    assert OPERATORS[name](no_docs).count() == 0
    ids = {row["doc_id"] for row in rows}
    if name == "retained":
        assert ids == set()  # too few words, or repeated ones
    elif name == "one of each":
        assert ids == {1, 2, 3, 4, 5, None} and len(rows) == 7
    else:
        assert ids == {1, 2, 3, 4, 5, None}
    if name not in ("packing", "retained"):
        assert len(rows) == 7


def test_archive_of_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, None, None, "a"), (None, "http://x\r\ny", "z", "b"), (2, "u", "", "c"),
         (2, "u", "", "d"), (3, "v", "z", None), (5, "v", "z" * 100_000, None)],
        "page_id long, url string, html string, sha1 string",
    )
    index = warc.write_archive(pages)
    rows = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_records(index).collect()}
    assert rows == {
        (1, "response", None), (None, "revisit", 3), (2, "revisit", 1), (3, "response", None),
        (5, "response", None),
    }
    some = warc.read_records(index.where("page_id = 5")).first()
    assert bytes(some["payload"]) == b"z" * 100_000 and some["url"] == "v"
    assert warc.read_records(warc.write_archive(pages.limit(0))).count() == 0
    far = warc.read_records(warc.write_archive(pages, min_bytes=2)).collect()
    assert all(r["record_type"] == "response" for r in far)


@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)))
def test_record_ids_hold_page_ids(page_id):
    assert warc.page_of(warc.record_id(page_id)) == page_id


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**64 - 1)), max_size=2500))
def test_simple8b_gives_back_its_values(values):
    values = np.array(values, np.uint64)
    words, per_block = simple8b.encode(values)
    assert (simple8b.decode(words, per_block, len(values)) == values).all()


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.sampled_from("ab É 's't\n\t .,!9\x1c　語|"), max_size=40))
def test_memo_gives_the_ids_of_the_library(text):
    coder = Coder(queries.tokenizer_path())
    assert coder.codes([text]) == [coder.whole(text)]


def test_plain_pieces_are_coded_by_the_model(monkeypatch):
    coder = Coder(queries.tokenizer_path())
    text = "It's 31 foxes qzxv-jkwq," + "".join(map(chr, range(32, 127))) + " we'll"
    expected = coder.whole(text)
    coder.held.ids.clear()
    monkeypatch.setattr(coder.held, "tokenizer", SimpleNamespace(model=coder.held.tokenizer.model))
    assert coder.codes([text]) == [expected]


def test_known_letters_and_white_space_are_coded_by_the_model(monkeypatch):
    coder = Coder(queries.tokenizer_path())
    texts = ["Où est l'élève ßqzxv?\n\nÀ 31 km", "x  y \n z \t", " ", "été  ", "\n a", "ñ\n"]
    expected = [coder.whole(text) for text in texts]
    coder.held.ids.clear()
    coder.held.chunks.clear()
    monkeypatch.setattr(coder.held, "tokenizer", SimpleNamespace(model=coder.held.tokenizer.model))
    assert coder.codes(texts) == expected


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é's\n\t.9"), max_size=30), max_size=4))
def test_memo_cuts_white_space_as_the_library_does(texts):
    coder = Coder(queries.tokenizer_path(), memo=20)
    assert coder.codes(texts) == [coder.whole(text) for text in texts]


def test_a_vocabulary_of_unknown_rule_is_coded_by_lines(monkeypatch):
    coder = Coder(queries.tokenizer_path())
    text = "Où est l'élève  ßqzxv?\n\nÀ 31 km"
    expected = coder.whole(text)
    monkeypatch.setattr(coder.held, "ids", {})
    monkeypatch.setattr(coder.held, "line_feed", None)
    assert coder.codes([text, "une"]) == [expected, coder.whole("une")]


def test_documents_are_read_over_the_ends_of_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(simple8b, "TOGETHER", 2)
    rng = np.random.default_rng(4)
    lengths = [0, 1, 2047, 1, 0, 2048, 5000, 3, 0]
    docs = [rng.integers(0, 1 << 32, n).astype("<u4").tobytes() for n in lengths]
    with open(tmp_path / "ids", "wb") as out:
        writer = simple8b.Writer(out)
        for number, ids in enumerate(docs):
            writer.add(number, ids)
        writer.finish()
    starts = np.cumsum([0, *lengths])[:-1].tolist()
    got = list(simple8b.read_documents(str(tmp_path / "ids")))
    assert got == list(zip(range(len(docs)), starts, docs))


def test_added_tokens_get_the_ids_of_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["a<|endoftext|>b", "no such token", "<|endoftext|>", "é <|endoftext|> 語", "<|endoftext"]
    got = [np.frombuffer(x, "<u4").tolist() for x in Coder(queries.tokenizer_path()).codes(texts)]
    assert got == [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(got[0]) == 3


@settings(deadline=None, max_examples=60)
@given(
    st.lists(st.tuples(st.integers(1, 300), st.integers(0, 300)), max_size=60),
    st.integers(1, 64), st.integers(1, 5), st.integers(1, 64),
)
def test_packing_keeps_every_limit(documents, tokens, segments, loss_tokens):
    limits = packing.Limits(tokens, segments, loss_tokens)
    packer = packing.Packer(limits, pool=8)
    pieces = []
    for number, (length, loss_from) in enumerate(documents):
        pieces += packer.add(number, length, loss_from)
    pieces += packer.rest()
    seen, used = {}, {}
    for piece in pieces:
        seen.setdefault(piece.doc, []).append((piece.start, piece.length))
        end = piece.start + piece.length
        loss = max(0, end - max(piece.start, documents[piece.doc][1]))
        have = used.setdefault(piece.sequence, [0, 0, 0])
        assert piece.offset == have[0]
        used[piece.sequence] = [have[0] + piece.length, have[1] + 1, have[2] + loss]
    assert all(u <= list(limits) or all(x <= y for x, y in zip(u, limits)) for u in used.values())
    for number, (length, _) in enumerate(documents):
        at = 0
        for start, n in sorted(seen[number]):
            assert start == at and n > 0
            at += n
        assert at == length


def test_prompts_bear_no_loss(spark):
    rows = [(1, "what is that", "it is a word"), (2, None, "no prompt"), (3, "no answer", None)]
    df = spark.createDataFrame(rows, "doc_id long, ask string, text string")
    got = packing.pack(df, queries.tokenizer_path(), prompt="ask").groupBy("doc_id").agg(
        F.sum("length").alias("n"), F.sum("loss_tokens").alias("loss"))
    by_id = {r["doc_id"]: (r["n"], r["loss"]) for r in got.collect()}
    assert by_id[1][1] < by_id[1][0] and by_id[2][0] == by_id[2][1] and by_id[3][1] == 1


def test_edits_are_located(spark):
    old, new = "a\nb\n\nc\nd\ne\nf", "a\nb\n\nc\nd\nX\nf"
    df = spark.createDataFrame([(old, new)], "old string, new string")
    prints = [fingerprints.fingerprint(F.col(c)) for c in ("old", "new")]
    row = df.select(
        fingerprints.edited_paragraphs(*prints), fingerprints.edited_paragraphs(prints[0], prints[0])
    ).first()
    assert row[0] == [5] and row[1] == []


def test_terms_that_disclose_are_generalised(spark):
    rows = [
        (i, f"{w} filler{i} and the usual words of n{i} Zanzibar mail to bob@x.com today p{i}")
        for i, w in enumerate(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"])
    ]
    rows += [(100 + i, f"the usual words of and mail today {i}") for i in range(50)]
    rows.append((200, "I saw Zanzibar once"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (0, 1 << 20):
        got = disclosure.protected(df, limit=limit)
        texts = dict(got.select("doc_id", disclosure.sanitised()).collect())
        assert texts[200] == "I saw <NAME> once"
        assert "<NAME> mail to <EMAIL> today" in texts[0]
        assert texts[100] == "the usual words of and mail today 0"


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_copies_and_shared_passages_do_not_hide_a_term(spark, limit):
    """Of a thousand copies and three other texts, and of one passage in many texts."""
    rows = [(i, "the letter of Zanzibar for bob@x.com came late") for i in range(1000)]
    rows += [(1000 + i, f"{w} Zanzibar {w}s bob@x.com {w}t") for i, w in enumerate(["ab", "cd", "ef"])]
    rows += [(2000 + i, f"page{i} signed by Quimby at 10.1.2.3 sheet{i}") for i in range(40)]
    rows += [(3000 + i, f"the letter for page{i} signed by hand came late") for i in range(400)]
    rows += [(5000, "Zanzibar alone"), (5001, "Quimby alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(disclosure.protected(df, limit=limit).select("doc_id", disclosure.sanitised()).collect())
    assert texts[5000] == "<TERM> alone" and texts[5001] == "<TERM> alone"
    assert texts[0] == "the letter of <TERM> for <EMAIL> came late"
    assert texts[3000] == rows[1043][1]


def test_a_name_far_from_the_mention_is_found(spark):
    far = "the usual words and nothing else " * 40
    rows = [(i, f"Zanzibar {far} bob@x.com") for i in range(2)]
    rows += [(2 + i, f"Zanzibar {far} {w} bob@x.com") for i, w in enumerate(["abc", "def", "ghi"])]
    rows += [(100 + i, f"{far} {i}") for i in range(50)] + [(200, "I saw Zanzibar once")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(disclosure.protected(df).select("doc_id", disclosure.sanitised()).collect())
    assert texts[200] == "I saw <NAME> once" and texts[0] == f"<NAME> {far} <EMAIL>"


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components(links.union(spark.createDataFrame([(1000, 2000)], "a long, b long")))
    assert {r["component"] for r in found.collect()} == {1, 1000}
    assert components(links.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [50, 80])
def test_near_copies_in_both_plans(spark, percent):
    """A family of near copies whose members do not all link with each other."""
    from test_whole_tables import brute_components, shingle_sets

    draw = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in draw.integers(0, 60, draw.integers(0, 4)):
            words[at] = f"x{draw.integers(0, 40)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_components(list(range(60)), list(shingle_sets(texts, 4)), percent)
    for limit in (0, 1 << 20):
        got = jaccard_groups(df, k=4, percent=percent, limit=limit).orderBy("doc_id").collect()
        assert [r["component_id"] for r in got] == expected


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_near_copies_by_null_ids_and_by_one_id_of_two_texts(spark, limit):
    def text(a, last):
        return " ".join([f"{a}{i}" for i in range(40)] + [last])

    rows = [
        (1, text("a", "x")), (None, text("a", "y")), (None, text("b", "x")),
        (7, text("c", "x")), (7, text("d", "x")), (8, text("c", "y")), (9, text("d", "y")),
        (3, text("e", "x")), (20, text("e", "y")), (20, text("f", "x")),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_groups(df, k=4, percent=80, limit=limit).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found) == [
        (0, 0), (0, 1), (1, 1), (3, 3), (7, 7), (7, 7), (8, 7), (9, 7), (20, 3), (20, 20),
    ]
    kept = {tuple(r) for r in one_of_each(df, k=4, percent=80, limit=limit).collect()}
    assert kept == {rows[i] for i in (0, 2, 3, 4, 7, 9)}
