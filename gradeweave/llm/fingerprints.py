"""Merkle-tree fingerprints of documents, as column arithmetic.

A document is a tree: the root over sections, a section over paragraphs, a paragraph over
blocks of 64 characters. A paragraph is a line. A section ends behind an empty line or a
paragraph whose hash starts with ``0``, so that an edit moves no section border but near
itself. Each node's hash is the SHA-256 of its children's full hashes; in the text form the
root is kept in full and the others are cut to 32 bits, enough to compare two documents.

The text form: root, then per section ``|hash``, per paragraph of it ``/hash``, per block
``.hash``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
SHORT = 8


def _sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(text: Column, block: int = BLOCK) -> Column:
    """The fingerprint of a text (string); null counts as empty. Equal texts, and only
    those, have equal roots."""
    blocks = "(?s).{1," + str(block) + "}"

    def paragraph(line: Column) -> Column:
        """The line's hash in full, its blocks' hashes, and a mark if a section ends here."""

        def node(hashed: Column) -> Column:
            shorts = F.transform(hashed, lambda h: F.concat(F.lit("."), F.substring(h, 1, SHORT)))
            return F.concat(_sha(F.array_join(hashed, "")), F.array_join(shorts, ""))

        hashed = F.transform(F.regexp_extract_all(line, F.lit(blocks), F.lit(0)), _sha)
        return bound(
            bound(hashed, node),
            lambda p: F.concat(
                F.lit("/"), p, F.when((line == "") | p.startswith("0"), "|").otherwise("")
            ),
        )

    def section(part: Column) -> Column:
        """The section's hash in full, then its paragraphs with their hashes cut."""
        paragraphs = F.regexp_extract_all(part, F.lit("/([0-9a-f]{64})"), F.lit(1))
        return F.concat(
            _sha(F.array_join(paragraphs, "")),
            F.regexp_replace(part, f"/([0-9a-f]{{{SHORT}}})[0-9a-f]{{{64 - SHORT}}}", r"/$1"),
        )

    def document(whole: Column) -> Column:
        short = F.transform(
            whole, lambda s: F.concat(F.lit("|"), F.substring(s, 1, SHORT), F.substr(s, F.lit(65)))
        )
        hashes = F.transform(whole, lambda s: F.substring(s, 1, 64))
        return F.concat(_sha(F.array_join(hashes, "")), F.array_join(short, ""))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), paragraph)
    parts = F.filter(F.split(F.array_join(lines, ""), r"\|"), lambda s: s != "")
    return bound(F.transform(parts, section), document)


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 64)


def sections(print_: Column) -> Column:
    """hash and paragraphs (array of hash and blocks) of each section."""
    def after_first(nodes: Column) -> Column:
        return F.slice(nodes, 2, F.size(nodes))


    def paragraph(part: Column) -> Column:
        nodes = F.split(part, r"\.")
        return F.struct(nodes[0].alias("hash"), after_first(nodes).alias("blocks"))

    def section(part: Column) -> Column:
        nodes = F.split(part, "/")
        return F.struct(
            nodes[0].alias("hash"),
            F.transform(after_first(nodes), paragraph).alias("paragraphs"),
        )

    return F.transform(after_first(F.split(print_, r"\|")), section)


def edited_paragraphs(old: Column, new: Column) -> Column:
    """Numbers (from 0) of the paragraphs of ``new`` that ``old`` does not have.

    Sections that both have are skipped; only the others are opened. Null if either is.
    """
    known = F.transform(sections(old), lambda s: s["hash"])
    inside = F.flatten(
        F.transform(sections(old), lambda s: F.transform(s["paragraphs"], lambda p: p["hash"]))
    )
    # Whether each paragraph is in a changed section, and its hash.
    opened = F.flatten(
        F.transform(
            sections(new),
            lambda s: F.transform(
                s["paragraphs"],
                lambda p: ~F.array_contains(known, s["hash"])
                & ~F.array_contains(inside, p["hash"]),
            ),
        )
    )
    numbers = F.filter(
        F.transform(opened, lambda changed, i: F.when(changed, i)), lambda i: i.isNotNull()
    )
    return F.when(root(old) == root(new), F.array().cast("array<int>")).otherwise(numbers)


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: twice the blocks that both have, by the blocks of each.

    1 for equal roots, without looking further; null if either is. Blocks of 64 characters
    are cut from the start of each paragraph, so the share is close to that of the text in
    common.
    """

    def blocks(x: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\.([0-9a-f]+)"), F.lit(1)))

    def share(both: Column) -> Column:
        common = F.size(F.array_intersect(both[0], both[1])) * 2.0
        return F.coalesce(F.try_divide(common, F.size(both[0]) + F.size(both[1])), F.lit(0.0))

    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(root(a) == root(b), 1.0)
        .otherwise(bound(F.array(blocks(a), blocks(b)), share))
    )


# Ranges of ids in which neighbours are looked for; their borders are estimated, and any
# borders give the same neighbours.
RANGES = 64


def next_ids(ids: DataFrame, ranges: int = RANGES) -> DataFrame:
    """doc_id and next_id: the largest smaller id; for the smallest, the largest.

    Ids are dealt to ranges, in each of which a window finds the neighbours; the last of a
    range is followed by the first of the next one that has any. Nulls have no neighbour.
    """
    ids = ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    shares = [i / ranges for i in range(1, ranges)]
    borders = ids.approxQuantile("doc_id", shares, 1 / (4 * ranges)) if ranges > 1 else []
    number = F.lit(0)
    for border in sorted(set(borders)):
        number = number + F.when(F.col("doc_id") >= int(border), 1).otherwise(0)
    ranged = ids.withColumn("range", number)
    descending = Window.partitionBy("range").orderBy(F.col("doc_id").desc())
    inner = ranged.withColumn("next_id", F.lead("doc_id").over(descending))
    # One row per range.
    firsts = ranged.groupBy("range").agg(F.max("doc_id").alias("largest"))
    order = Window.orderBy(F.col("range").desc())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select(
        F.col("range").alias("of_range"),
        F.coalesce(F.lead("largest").over(order), F.max("largest").over(everything)).alias("first"),
    )
    return inner.join(following, F.col("range") == F.col("of_range")).select(
        "doc_id", F.coalesce("next_id", "first").alias("next_id")
    )


def edited_fingerprints(docs: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness.

    The edited text has its last third (rounded down, in code points) replaced by as much of
    the start of the next document, in descending order of doc_id; the smallest id is
    followed by the largest. Null texts are empty. Of rows that share a doc_id, the one of
    the least text stands in for all as a next document. A null doc_id has no next document:
    its last third is cut off and near_next is null. An empty table gives no rows; other
    columns are not looked at.
    """
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Both joins below need the texts dealt out by id. As they read them alike, without null
    # ids, they share one shuffle.
    rows = every.where(F.col("doc_id").isNotNull())
    third = F.floor(F.char_length("text") / 3).cast("int")
    wanted = next_ids(rows, ranges).select(F.col("doc_id").alias("for_id"), "next_id")
    needs = rows.groupBy("doc_id").agg(F.max(third).alias("need"))
    wanted = wanted.join(needs, F.col("for_id") == F.col("doc_id")).drop("doc_id")
    # What a document lends to the one before it: its start and its fingerprint.
    lent = (
        rows.join(wanted, F.col("doc_id") == F.col("next_id"))
        .select(
            "for_id",
            F.struct(
                F.substr("text", F.lit(1), F.col("need")).alias("head"),
                fingerprint(F.col("text")).alias("next_fingerprint"),
            ).alias("lent"),
        )
        .groupBy("for_id")
        .agg(F.min("lent").alias("lent"))
    )
    length = F.char_length("text")
    edited = F.concat(
        F.substr("text", F.lit(1), length - third),
        F.coalesce(F.substr(F.col("lent.head"), F.lit(1), third), F.lit("")),
    )
    nothing = F.lit(None).cast("struct<head:string,next_fingerprint:string>").alias("lent")
    placed = rows.join(lent, F.col("doc_id") == F.col("for_id"), "left").select(
        "doc_id", "text", "lent"
    )
    placed = placed.union(every.where(F.col("doc_id").isNull()).select("doc_id", "text", nothing))
    return (
        placed.select(
            "doc_id",
            length.cast("bigint").alias("n_chars"),
            bound(
                edited,
                lambda e: F.struct(_sha(e).alias("sha256"), fingerprint(e).alias("fingerprint")),
            ).alias("edited"),
            fingerprint(F.col("text")).alias("fingerprint"),
            F.col("lent.next_fingerprint").alias("next_fingerprint"),
        )
        .select(
            "doc_id",
            "n_chars",
            F.col("edited.sha256").alias("edited_sha256"),
            "fingerprint",
            F.col("edited.fingerprint").alias("edited_fingerprint"),
            "next_fingerprint",
        )
        .withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
        .withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint")))
        .drop("next_fingerprint")
    )
