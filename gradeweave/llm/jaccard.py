"""N-gram Jaccard self-join by a token-group matrix.

Documents are sets of k-word shingles (tokens, as 64-bit hashes). Two sets link when their
intersection is at least so many percent of their union. The join finds the components of
these links:

1. Tokens are put in one order for all, the rare ones first, by a count sketch of fixed size.
   Sets that link share one of the first few tokens of each (prefix filter), so only tokens
   that stand in the prefixes of two or more sets matter further on.
2. Sets are partitioned into groups of similar ones: each prefix token names the set with most
   shared tokens as its centre, every set is compared with the centres of its tokens, and
   what links is a group.
3. A matrix holds which tokens the union of a group's prefixes has. A set is a query to
   the groups that it shares a matrix token with, but its own. The overlap of the set with
   the group's whole token union bounds its overlap with any member; only groups whose bound
   qualifies are opened, and their members compared one by one.
4. Components of all links.

Every comparison is exact on the tokens, and no group's members are paired with each
other, so a group of near copies costs as many comparisons as it has members. Large groups
are cut into parts of a few members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.llm.components import components
from gradeweave.llm.text import batches, digests, distinct, lowered, shingles, words
from gradeweave.operators.sizes import BROADCAST_BYTES, fits_broadcast
from gradeweave.sources.shared import written

# Counters of the sketch. Any counts give the same links; good ones give few candidates.
SKETCH_BITS = 18

# Members of one part of a group, about.
PART = 16


def token_sets(column: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct tokens of each text, some texts at a time."""
    for batch in batches(column):
        batch = batch._replace(data=lowered(batch.data))
        found = words(batch)
        yield distinct(*shingles(digests(batch.data, found.start, found.end), found, k))


def counter_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How many sets have a token, for each value of its first bits."""

    def count(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches_:
            for sets in token_sets(batch.column("text"), k):
                counts += np.bincount(counter_of(np.concatenate(sets)), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts[used])], ["counter", "n"]
        )

    parts = docs.select("text").mapInArrow(count, "counter int, n bigint")
    # As many rows as there are counters, however large the table.
    rows = parts.groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    counts[rows["counter"].to_numpy()] = rows["n"].to_numpy()
    return np.minimum(counts, 2**32 - 1).astype(np.uint32)


def needed(n: int, percent: int) -> int:
    """Tokens that a set of n shares with any set it links with, at least."""
    return -(-n * percent // 100)


def prefix(tokens: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The tokens, rarest first, of which sets that link have one in common."""
    n = len(tokens)
    order = np.lexsort((tokens, counts[counter_of(tokens)]))
    return tokens[order[: n - needed(n, percent) + 1]]


def name_of(tokens: np.ndarray) -> bytes:
    """A 128-bit name of a set of tokens: sets of one name are taken for the same."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


_SIGNED = "doc_id bigint, text_key bigint, name binary, n bigint, prefix array<bigint>"


def signed(docs: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """doc_id, a hash of the text, name and size of each document's set, and its prefix tokens;
    the prefix is null where the task has met the same set before. No name where the set is
    empty."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches_:
            names, sizes, prefixes = [], [], []
            for sets in token_sets(batch.column("text"), k):
                for tokens in sets:
                    name = name_of(tokens) if len(tokens) else None
                    new = name is not None and name not in met
                    names.append(name)
                    sizes.append(len(tokens))
                    prefixes.append(prefix(tokens, counts, percent).view(np.int64) if new else None)
                    if new:
                        met.add(name)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(names, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "name", "n", "prefix"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, _SIGNED)


def few_or_many(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast in joins if its measured size allows."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def whole_sets(docs: DataFrame, named: DataFrame, k: int, limit: int) -> DataFrame:
    """name and tokens (64-bit, ascending) of the sets of ``named`` (doc_id, name).

    Only documents of these ids, null included, are read into sets again; it costs less than to
    keep all sets. An id may stand on rows of other texts: only sets of a wanted name stay.
    """

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            found = [t for sets in token_sets(batch.column("text"), k) for t in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name_of(t) for t in found], pa.binary()),
                 pa.array([t.tobytes() for t in found], pa.binary())],
                ["name", "tokens"],
            )

    wanted = few_or_many(named.select(F.col("doc_id").alias("of_id"), F.col("name").alias("of")), limit)
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("of_id")), "left_semi").select("text")
    sets = texts.mapInArrow(run, "name binary, tokens binary")
    sets = sets.join(wanted, F.col("name") == F.col("of"), "left_semi")
    return written(sets.dropDuplicates(["name"]), "sets")


def _ceil_div(a: Column, b: int) -> Column:
    up = a + (b - 1)
    return ((up - F.pmod(up, F.lit(b))) / b).cast("bigint")


def _needed(n: Column, percent: int) -> Column:
    return _ceil_div(n * percent, 100)


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    """Tokens that sets of sizes n and m that link have in common, at least."""
    return _ceil_div((n + m) * percent, 100 + percent)


def least_shared(n: Column, m: Column, percent: int) -> Column:
    """Prefix tokens that sets of sizes n and m that link have in common, at least.

    Of the set whose prefix ends first, the prefix tokens that are not in the other prefix are
    not in the other set at all. So their overlap is at most the common prefix tokens and
    the rest of that set behind its prefix.
    """
    rest = F.greatest(_needed(n, percent), _needed(m, percent)) - 1
    return least_overlap(n, m, percent) - rest


def near_sizes(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of distinct tokens link."""
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _tokens(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


_LINK = "a binary, b binary"


def _link_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    columns = zip(*pairs) if pairs else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in columns], ["a", "b"])


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of names whose sets link."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield _link_batch(
                [(a, b) for a, b, x, y in rows if links(_tokens(x), _tokens(y), percent)]
            )

    first = sets.select(F.col("name").alias("a"), F.col("tokens").alias("x"))
    second = sets.select(F.col("name").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, _LINK)


def opened(candidates: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the candidates' queries with members of their groups.

    ``candidates``: name, group, part; ``members``: the same for the sets in each part.
    """

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            found = []
            for name, query, parts in zip(*(c.to_pylist() for c in batch.columns)):
                query = _tokens(query)
                inside = [(m["name"], _tokens(m["tokens"])) for m in parts]
                union = np.unique(np.concatenate([t for _, t in inside]))
                overlap = len(np.intersect1d(query, union, assume_unique=True))
                if overlap >= needed(len(query), percent):
                    found += [(name, m) for m, tokens in inside if links(query, tokens, percent)]
            yield _link_batch(found)

    # Written, so that a part with very many queries can be split when they meet it.
    groups = written(
        members.join(sets, "name")
        .groupBy("group", "part")
        .agg(F.collect_list(F.struct("name", "tokens")).alias("members")),
        "groups",
    )
    return (
        candidates.join(sets, "name")
        .join(groups, ["group", "part"])
        .select("name", "tokens", "members")
        .mapInArrow(run, _LINK)
    )


def grouped(entries: DataFrame, links_: DataFrame) -> DataFrame:
    """name, group and part of every set: the components of the links so far, in parts of
    about PART members; a set without links is a group."""
    groups = components(links_)
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    placed = groups.join(sizes, "component").select(
        F.col("node").alias("placed"),
        "component",
        F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / PART)).cast("int").alias("part"),
    )
    sets = entries.select("name").distinct()
    return sets.join(placed, F.col("name") == F.col("placed"), "left").select(
        "name",
        F.coalesce("component", "name").alias("group"),
        F.coalesce("part", F.lit(0)).alias("part"),
    )


def star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """a, b: each set with the centres of its tokens, if the tokens they share allow a link."""
    weight = entries.groupBy("name").agg(F.count("*").alias("weight"))
    centres = (
        entries.join(weight, "name")
        .groupBy("token")
        .agg(F.max(F.struct("weight", "n", "name")).alias("top"))
        .select("token", F.col("top.name").alias("a"), F.col("top.n").alias("m"))
    )
    n, m = F.col("n"), F.col("m")
    return (
        entries.join(centres, "token")
        .where((F.col("name") != F.col("a")) & near_sizes(n, m, percent))
        .groupBy("a", F.col("name").alias("b"), "n", "m")
        .agg(F.count("*").alias("shared"))
        .where(F.col("shared") >= least_shared(n, m, percent))
        .select("a", "b")
    )


def query_groups(entries: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """name, group, part: the parts of other groups that a set must be held against.

    The matrix has, for each token, the parts whose members' prefixes have it, the range of
    their sizes and how much of a member is left from the token on. Of two groups, the sets of
    one are the queries. A pair that links has a first common token; what is left of both
    sets from there on is at least their overlap. So only matrix cells with enough left,
    for the smallest size that may link, can show a pair for the first time.
    """
    placed = placed.withColumnRenamed("name", "placed")
    rows = entries.join(placed, F.col("name") == F.col("placed")).drop("placed")
    between = (
        rows.groupBy("token")
        .agg(F.min("group").alias("least"), F.max("group").alias("most"))
        .where(F.col("least") < F.col("most"))
        .select("token")
    )
    rows = written(
        rows.join(between, "token").withColumn("left", F.col("n") - F.col("at")), "between"
    )
    matrix = rows.groupBy("token", "group", "part").agg(
        F.min("n").alias("smallest"), F.max("n").alias("largest"), F.max("left").alias("most_left")
    )
    n = F.col("n")
    low = F.greatest("smallest", _needed(n, percent))
    found = (
        rows.select("token", "name", "n", "left", F.col("group").alias("own"))
        .join(matrix, "token")
        .where(
            (F.col("own") > F.col("group"))
            & (low <= F.col("largest"))
            & (low * percent <= n * 100)
            & (F.least("left", "most_left") >= least_overlap(n, low, percent))
        )
        .select("name", "group", "part")
        .distinct()
    )
    found = written(found, "found")
    of_query = rows.groupBy("name", "n").agg(F.collect_set("token").alias("asked"))
    of_part = rows.groupBy("group", "part").agg(
        F.collect_set("token").alias("held"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
    )
    high = F.least("largest", F.floor(n * 100 / percent))
    # The least that is needed of any size in the part is that of one of the ends of what may
    # link; between two neighbouring sizes rounding may take one off.
    enough = F.least(least_shared(n, low, percent), least_shared(n, high, percent)) - 1
    return (
        found.join(of_query, "name")
        .join(of_part, ["group", "part"])
        .where(F.size(F.array_intersect("asked", "held")) >= enough)
        .select("name", "group", "part")
    )


def jaccard_groups(
    docs: DataFrame, *, k: int, percent: int, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links,
    itself included) of each row of ``docs`` (doc_id, text).

    Words are compared with A to Z in lower case. A text with fewer than ``k`` words is one
    token; without words, or null, it has none and links with nothing. Equal texts with words
    link. Rows of null id take part like others, and are never the smallest; a component of
    such rows only has a null id. An empty table gives no rows; other columns are not looked
    at. ``limit`` bounds what is broadcast, by its measured size.
    """
    return _grouped_rows(docs, k=k, percent=percent, limit=limit).drop("text_key")


def _grouped_rows(docs: DataFrame, *, k: int, percent: int, limit: int) -> DataFrame:
    """``jaccard_groups`` with text_key, a hash of each row's text."""
    if not 0 < percent <= 100 or k < 1:
        raise ValueError("k must be at least 1, percent from 1 to 100")
    marked = written(signed(docs, k, percent, sketch(docs, k)), "signed")
    kept = marked.where(F.col("name").isNotNull())
    every = kept.select("name", "n", F.posexplode("prefix").alias("at", "token"))
    shared = written(
        every.groupBy("token")
        .agg(F.min("name").alias("least"), F.max("name").alias("most"))
        .where(F.col("least") < F.col("most"))
        .select("token"),
        "shared",
    )
    entries = written(every.join(few_or_many(shared, limit), "token").distinct(), "entries")
    # One document for each set.
    first_ids = written(kept.groupBy("name").agg(F.min("doc_id").alias("doc_id")), "first-ids")

    def sets_of(names: DataFrame) -> DataFrame:
        chosen = written(first_ids.join(names.distinct(), "name"), "chosen")
        return whole_sets(docs, chosen, k, limit)

    stars = written(star_pairs(entries, percent), "stars")
    sets = sets_of(stars.select(F.explode(F.array("a", "b")).alias("name")))
    star_links = written(compared(stars, sets, percent), "star-links")

    placed = written(grouped(entries, star_links), "placed")
    candidates = written(query_groups(entries, placed, percent), "candidates")
    asked = candidates.select("group", "part").distinct()
    members = written(placed.join(asked, ["group", "part"]), "members")
    sets = sets_of(candidates.select("name").union(members.select("name")))
    more = written(opened(candidates, members, sets, percent), "more-links")
    found = components(star_links.unionByName(more))

    named = found.select(F.col("node").alias("name"), "component")
    in_component = first_ids.join(named, "name", "left").select(
        "name", F.coalesce("component", "name").alias("component"), "doc_id"
    )
    smallest = in_component.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_name = in_component.join(smallest, "component").select("name", "component_id")
    return marked.join(of_name, "name", "left").select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, *, k: int, percent: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is the smallest of its
    component. A row is known by its id and a hash of its text: rows that repeat both stay or
    go together, as do rows of null id with equal texts."""
    groups = _grouped_rows(docs, k=k, percent=percent, limit=limit)
    groups = written(groups, "groups")
    dropped = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("dropped_id"), F.col("text_key").alias("dropped_key")
    )
    dropped = written(dropped.distinct(), "dropped")
    return docs.join(
        few_or_many(dropped, limit),
        F.col("doc_id").eqNullSafe(F.col("dropped_id"))
        & (F.xxhash64("text") == F.col("dropped_key")),
        "left_anti",
    )
