"""The registered corpus queries against plain Python over the same whole tables."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from corpus_fixtures import tables  # noqa: F401

import corpus_pipeline
from gradeweave.llm import curriculum, language, quality, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, tables):
    return queries.documents(spark, tables).toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def results(spark, tables):
    held = {}

    def of(name):
        if name not in held:
            held[name] = queries.QUERIES[name](spark, tables).toPandas()
        return held[name].sort_values(held[name].columns[0]).reset_index(drop=True)

    return of


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.tokenizer_path())
    texts = [t or "" for t in docs.text]
    found = coder.encode_batch(texts, add_special_tokens=False)
    return [np.array([*e.ids, 0], "<u4") for e in found]


def test_fingerprints(docs, results):
    got = results("op1_merkle_fingerprints")
    texts = docs.text.fillna("").tolist()
    for i, text in enumerate(texts):
        third = len(text) // 3
        following = texts[i - 1]  # the next smaller id; the largest behind the smallest
        edited = text[: len(text) - third] + following[:third]
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
        assert got.n_chars[i] == len(text)
    assert got.groupby("fingerprint").ngroups == len(set(texts))
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert got.near_edited.mean() > 0.5 > 0.1 > got.near_next.mean()


def test_quality(docs, results, spark, tables):
    got = results("op2_line_crf")
    for i, text in enumerate(docs.text.fillna("")):
        words = WORD.findall(text)
        seen, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = set()
        for k in range(len(words) - 7):
            if windows[tuple(words[k : k + 8])] > 1:
                covered.update(range(k, k + 8))
        expected = (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again,
            len(covered),
        )
        found = tuple(got.loc[i, list(quality.Base._fields[:5])])
        assert found == expected
        assert got.base_failed[i] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
    assert not (got.kept & got.base_failed).any()


def test_quality_on_labels_not_learned_from(spark, tables):
    folder = tables.replace("sf0.001", "sf0.01")
    labels = queries.labels(spark, folder)
    held = labels.where(quality.remainder("doc_id", quality.HELD_OUT_OF) == 0).toPandas()
    got = queries.line_crf(spark, folder).toPandas().merge(held, on="doc_id")
    got = got[~got.base_failed]
    assert (got.kept == (got.quality == 1)).mean() > 0.95


def test_language_on_documents_not_learned_from(docs, results):
    got = results("op3_ecoc_language")
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id]
    assert got.held_out.tolist() == held
    assert (got.lang_pred == docs.lang)[held].mean() > 0.95
    assert got.score.between(0, 1).all()


def test_curriculum(docs, results):
    got = results("op4_curriculum_mix")
    sizes = docs.text.fillna("").map(lambda t: len(WORD.findall(t)))
    assert got["size"].tolist() == sizes.tolist()
    of_source = sizes.groupby(docs.source).sum().sort_index()
    weight = dict(zip(of_source.index, [5, 2, 1] * len(of_source)))
    left, filled = 1.5 * sizes.sum(), {}
    while True:
        rest = [s for s in of_source.index if s not in filled]
        level = left / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] >= 2 * of_source[s]]
        if not over:
            break
        for s in over:
            filled[s] = 2 * of_source[s]
            left -= filled[s]
    wanted = {s: filled.get(s, level * weight[s]) for s in of_source.index}
    for s, mine in got.groupby(docs.source):
        assert mine.target.iloc[0] == pytest.approx(wanted[s])
        assert math.floor(mine.target.iloc[0] + 1e-6) - mine.taken.sum() in (0, 1)
    assert (got.taken <= 2 * got["size"]).all()


def test_training_order_is_sorted_by_position(spark, tables):
    rows = curriculum.curriculum(queries.documents(spark, tables)).collect()
    firsts = [r["first_position"] for r in rows if r["first_position"] is not None]
    assert firsts == sorted(firsts)
    assert all(0 <= p <= 1 for r in rows for p in r["positions"])


def test_inverse_of_demand(spark):
    from pyspark.sql import functions as F

    times = np.linspace(0, 1, 100_001)
    for shape in (*curriculum.SHAPES, (0.0, 1.0, 0.0), (1.0, 0.0, 0.0)):
        weights = np.interp(times, [0, 0.5, 1], shape)
        demand = np.concatenate(([0], np.cumsum((weights[1:] + weights[:-1]) / 2)))
        demand /= demand[-1]
        column = curriculum.inverse(F.col("id") / 50, F.array(*[F.lit(x) for x in shape]))
        for share, time in spark.range(51).select(F.col("id") / 50, column).collect():
            assert np.interp(time, times, demand) == pytest.approx(share, abs=1e-4)


def test_toxicity(docs, results, spark, tables):
    got = results("op5_fm_toxicity")
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in docs.doc_id]
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()


def test_toxicity_on_labels_not_learned_from(spark, tables):
    folder = tables.replace("sf0.001", "sf0.1")
    labels = queries.labels(spark, folder).where(toxicity.held_out()).toPandas()
    got = queries.fm_toxicity(spark, folder).toPandas().merge(labels, on="doc_id")
    assert (got.predicted == got.toxic).mean() > 0.95
    assert got.predicted[got.toxic == 1].mean() > 0.75


def test_pairs_of_terms_tell_what_single_ones_do_not():
    draw = np.random.default_rng(0)
    documents, labels = [], []
    for _ in range(1500):
        a, b = draw.integers(0, 2, 2)
        documents.append(np.array([100 + a, 200 + b, *draw.integers(1000, 1050, 5)]))
        labels.append(int(a == b))
    documents = [np.unique(d) for d in documents]
    # Alone, none of the four terms tells the labels apart.
    model = toxicity.train(documents, labels, 0.5, rounds=600, decay=1e-6)
    text = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    found = toxicity.present(model.terms, text, np.concatenate(documents))
    right = (toxicity.score(model, *found, len(documents)) > 0) == (np.array(labels) == 1)
    assert right.mean() > 0.9


def test_score_is_the_sum_over_all_pairs():
    draw = np.random.default_rng(3)
    model = toxicity.Machine(
        np.arange(0, 60, 3), draw.normal(size=20), draw.normal(size=(20, toxicity.FACTORS)), 0.7
    )
    texts = [np.unique(draw.integers(0, 60, n)) for n in (0, 1, 2, 15, 40)]
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = toxicity.score(
        model, *toxicity.present(model.terms, text, np.concatenate(texts)), len(texts)
    )
    for t, odds in zip(texts, got):
        places = [i for i, number in enumerate(model.terms) if number in t]
        pairs = sum(
            model.vectors[i] @ model.vectors[j] for i in places for j in places if i < j
        )
        assert odds == pytest.approx(0.7 + sum(model.weights[i] for i in places) + pairs)


def test_pairs_of_terms_tell_with_the_settings_of_the_query():
    draw = np.random.default_rng(0)
    documents, labels = [], []
    for _ in range(1500):
        a, b = draw.integers(0, 2, 2)
        documents.append(np.array([100 + a, 200 + b, *draw.integers(1000, 1050, 5)]))
        labels.append(int(a == b))
    documents = [np.unique(d) for d in documents]
    model = toxicity.train(documents, labels, 0.5)
    assert {100, 101, 200, 201, *range(1000, 1050)} == set(model.terms.tolist())
    text = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    found = toxicity.present(model.terms, text, np.concatenate(documents))
    right = (toxicity.score(model, *found, len(documents)) > 0) == (np.array(labels) == 1)
    assert right.mean() > 0.9


def test_archives(spark, tables, results):
    pages = spark.read.parquet(f"{tables}/pages.parquet").toPandas().sort_values("page_id")
    got = results("op6_warc_index")
    payloads = [(h or "").encode() for h in pages.html]
    digests = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads]
    first = dict(zip(reversed(digests), reversed(pages.page_id.tolist())))
    assert got.page_id.tolist() == pages.page_id.tolist()
    assert got.payload_digest.tolist() == digests
    assert got.payload_bytes.tolist() == [len(p) for p in payloads]
    for page, d, kind, to in zip(got.page_id, digests, got.record_type, got.refers_to):
        assert kind == ("response" if first[d] == page else "revisit")
        assert (to == first[d]) if kind == "revisit" else np.isnan(to)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    number = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        total = 0
        for i, digit in enumerate(map(int, reversed(number))):
            digit = digit * 2 if i % 2 else digit
            total += digit - 9 if digit > 9 else digit
        return 13 <= len(number) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(number) <= 15


def test_personal_data(docs, results):
    got = results("op7_disclosure_pii")
    for i, text in enumerate(docs.text.fillna("")):
        spans, counts = [], []
        for kind, pattern in PATTERNS.items():
            found = [m for m in re.finditer(pattern, text) if valid(kind, m[0])]
            counts.append(len(found))
            spans += [f"{kind}:{m.start()}:{m.end()}" for m in found]
        base = ",".join(spans)
        assert list(got.loc[i, ["n_email", "n_ip", "n_card", "n_phone"]]) == counts
        assert got.base_sha256[i] == hashlib.sha256(base.encode()).hexdigest()
        assert got.spans[i].startswith(base)


def test_packing(docs, results, ids):
    got = results("op8_vector_packing")
    by_doc = dict(zip(docs.doc_id, ids))
    for row in got.itertuples():
        part = by_doc[row.doc_id][row.start : row.start + row.length]
        assert zlib.crc32(part.tobytes()) == row.ids_crc32
        assert len(by_doc[row.doc_id]) == row.doc_tokens
    for by, at in (("doc_id", "start"), ("sequence_id", "offset")):
        rows = got.sort_values([by, at])
        assert (rows[at] == rows.groupby(by).length.cumsum() - rows.length).all()
    sequences = got.groupby("sequence_id").length.sum()
    assert got.length.sum() == sum(map(len, ids)) and sequences.max() <= 1024
    assert sequences.sum() > 0.99 * 1024 * len(sequences)


def test_token_files(docs, results, ids):
    got = results("op9_simple8b")
    lengths = np.array([len(x) for x in ids])
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    assert got.start.tolist() == (np.cumsum(lengths) - lengths).tolist()
    assert got.n_tokens.tolist() == lengths.tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in ids]


def shingle_sets(texts, k):
    for text in texts:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = WORD.findall(lower)
        if len(words) < k:
            yield {tuple(words)} if words else set()
        else:
            yield {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_components(doc_ids, sets, percent):
    least = list(range(len(sets)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    holders = collections.defaultdict(list)
    for i, mine in enumerate(sets):
        for j, both in collections.Counter(j for t in mine for j in holders[t]).items():
            if 100 * both >= percent * (len(mine) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                least[b] = a
        for token in mine:
            holders[token].append(i)
    return [doc_ids[root(i)] for i in range(len(sets))]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_jaccard_components(spark, tables, folder):
    folder = tables.replace("sf0.001", folder)
    docs = queries.documents(spark, folder).toPandas().sort_values("doc_id")
    got = queries.group_jaccard(spark, folder).toPandas().sort_values("doc_id")
    sets = list(shingle_sets(docs.text, 4))
    assert got.n_shingles.tolist() == [len(s) for s in sets]
    assert got.component_id.tolist() == brute_components(docs.doc_id.tolist(), sets, 85)


def test_pipeline(spark, tables, docs):
    """Each stage by a plain form of it over what the stage before has kept."""
    at = queries.documents(spark, tables)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.written(stage(spark, at, tables), name)
        kept.append(at.toPandas())
    good, distinct, private, mixed, packed = kept
    verdicts = queries.line_crf(spark, tables).toPandas()
    assert sorted(good.doc_id) == sorted(verdicts.doc_id[verdicts.kept])
    good = good.sort_values("doc_id")
    ids = good.doc_id.tolist()
    components = brute_components(ids, list(shingle_sets(good.text, 5)), 80)
    assert sorted(distinct.doc_id) == sorted(set(components))
    assert sorted(private.doc_id) == sorted(distinct.doc_id)
    for text in private.text:
        assert not [m for m in re.finditer(PATTERNS["email"], text)]
    assert list(mixed.columns) == list(docs.columns)
    size = private.text.map(lambda t: len(WORD.findall(t))).sum()
    assert mixed.text.map(lambda t: len(WORD.findall(t))).sum() >= 1.4 * size
    assert set(mixed.doc_id) <= set(private.doc_id)
    assert packed.drop_duplicates(["doc_id", "start"]).doc_id.nunique() == mixed.doc_id.nunique()
    ran = corpus_pipeline.run(spark, tables)
    assert ran.count() == len(packed)
