"""Texts and tables made to be hard: patterned words, long runs, very many spans, shared ids."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeweave.llm import quality
from gradeweave.llm.curriculum import planned, repeated
from gradeweave.llm.disclosure import PATTERNS, matches, replaced
from gradeweave.llm.jaccard import jaccard_groups, one_of_each
from gradeweave.llm.text import batches, digests

# The contract's patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def patterned(n):
    """Two strings of a and b whose sums of bytes times powers are equal modulo 2**64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_patterned_words_and_lines_are_told_apart(spark, n):
    one, other = patterned(n)
    batch = next(batches(__import__("pyarrow").array([f"{one}\n{other}\nx {one}\n{one}"])))
    assert quality.measure(batch).n_dup_lines[0] == 1
    words = " some more words that both of these texts have in common"
    docs = spark.createDataFrame(
        [(1, one, "en", "a", n), (2, other, "en", "a", n), (3, one, "en", "a", n)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    found = {r["doc_id"]: r["component_id"] for r in jaccard_groups(docs, k=4, percent=85).collect()}
    assert found == {1: 1, 2: 2, 3: 1}
    kept = one_of_each(docs.withColumn("text", F.concat("text", F.lit(words))), k=50, percent=80)
    assert {r["doc_id"] for r in kept.collect()} == {1, 2}


def test_digests_follow_the_bytes_alone():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    start = rng.integers(0, 4900, 4000)
    end = start + rng.integers(1, 60, 4000)
    found = digests(data, start, end)
    by_bytes = {}
    for a, b, value in zip(start, end, found):
        by_bytes.setdefault(data[a:b].tobytes(), set()).add(int(value))
    assert all(len(values) == 1 for values in by_bytes.values())
    assert len({min(v) for v in by_bytes.values()}) == len(by_bytes)


def located(spark, texts, kind):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", matches(F.col("text"), PATTERNS[kind]).alias("found")).collect()
    return {row["text"]: [tuple(s) for s in row["found"]] for row in rows}


@pytest.mark.parametrize("kind", list(PLAIN))
def test_spans_are_those_of_the_plain_patterns(spark, kind):
    rng = random.Random(kind)
    parts = ["a", "b.c", "@", ".", "-", "1", "23", "+4", " ", "(", "é", "@x.y", "1.2.3.4", "_", "%"]
    texts = {"".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(800)}
    found = located(spark, sorted(texts), kind)
    for text in texts:
        expected = [(*m.span(), m.group()) for m in re.finditer(PLAIN[kind], text)]
        assert found[text] == expected, text


def test_long_runs_take_seconds(spark):
    texts = ["a" * 1_000_000 + "@", "1" * 1_000_000 + ".", "a" * 500_000 + "@" + "b" * 500_000,
             "1." * 500_000, "+1" + "(" * 1_000_000]
    begun = time.time()
    for kind in PATTERNS:
        for text, spans in located(spark, texts, kind).items():
            assert all(text[a:b] == value for a, b, value in spans)
            if kind == "ip":
                assert len(spans) == (125_000 if text.startswith("1.") else 0)
            if kind == "email":
                assert not spans
    assert time.time() - begun < 120


def test_very_many_spans_take_seconds(spark):
    text = "é a.b@c.de " * 100_000
    df = spark.createDataFrame([(text,)], "text string")
    found = matches(F.col("text"), PATTERNS["email"])
    spans = F.transform("found", lambda s: F.struct(s["start"], s["end"], F.lit("<E>").alias("label")))
    begun = time.time()
    row = df.select("text", found.alias("found")).select(
        F.size("found").alias("n"), replaced(spans).alias("out")
    ).first()
    assert row["n"] == 100_000 and row["out"] == "é <E> " * 100_000
    assert time.time() - begun < 120


def test_overlapping_spans_become_one(spark):
    rng = random.Random(9)
    text = "".join(rng.choices("abcdé ", k=700))
    spans = []
    for _ in range(200):
        a = rng.randrange(690)
        spans.append((a, a + rng.randrange(1, 10), f"<{a % 3}>"))
    at, out = 0, ""
    for a, b, label in sorted(spans):
        if a >= at:
            out += text[at:a] + label
        at = max(at, b)
    df = spark.createDataFrame([(text, spans)], "text string, s array<struct<start:int,end:int,label:string>>")
    assert df.select(replaced(F.col("s"))).first()[0] == out + text[at:]
    none = df.select("text", F.slice("s", 1, 0).alias("s"))
    assert none.select(replaced(F.col("s"))).first()[0] == text


def test_mix_takes_shared_ids_as_often_as_planned(spark):
    rows = [(1, f"word{i} " * 4, "en", "a", 4) for i in range(10)]
    rows += [(None, "one two", "en", "b", 2)] * 6 + [(None, "x " * (i + 1), "en", "b", 1) for i in range(4)]
    rows += [(i, "some words here " * (i % 3 + 1), "en", "ab"[i % 2], 3) for i in range(2, 20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    plan = planned(docs)
    wanted = Counter()
    for row in plan.collect():
        wanted[row["doc_id"], row["size"]] += len(row["positions"])
    for limit in (0, 1 << 20):
        got = repeated(docs, plan, limit=limit)
        assert got.columns == [*docs.columns, "position"]
        found = Counter((r["doc_id"], len(r["text"].split())) for r in got.collect())
        assert found == +wanted
