"""Personal data, and terms that give it away, found and taken out with column functions.

Emails, IP addresses, card and phone numbers are found by pattern. They are the protected
entities. From all documents it is then estimated how much a term tells of an entity: the
pointwise mutual information of the two, as a share of the entity's own information. A term
and an entity meet where they stand in one document, however far apart; equal texts count as
one document everywhere. Terms above a threshold disclose the entity even where it has been
taken out, so they are generalised, or removed if they all but name it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.llm.fingerprints import bound
from gradeweave.operators.sizes import BROADCAST_BYTES, fits_broadcast
from gradeweave.sources.shared import written

# Patterns of the base kinds (fixed values). Groups that nothing follows are possessive, so
# that a long match needs no stack. A match that could begin within a run could begin with the run
# too, unless the match before ended there; so runs are tried from their starts alone, and a long
# one without an end costs one try. The matches are the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# What makes a text worth searching for a kind.
_SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

TERM = r"[\p{L}\p{N}]+"
SHORTEST = 3

# Distinct texts in which a term must stand with an entity; shares of the entity's information from
# which on a term is generalised, or removed.
SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95


# Elements that are folded into one array or text before these are put together: a fold copies
# what it has for each element, which for a long list would be its square.
_FOLDED = 64


def _firsts(n: Column) -> Column:
    """The first numbers of the blocks that 0 to n - 1 are folded in."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(_FOLDED))).otherwise(
        F.array().cast("array<int>")
    )


def matches(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and value of each leftmost match."""
    kind = "array<struct<start:int,end:int,value:string>>"

    def located(found: Column) -> Column:
        def among(gaps: Column) -> Column:
            def add(state: Column, i: Column) -> Column:
                start = state["at"] + F.char_length(F.get(gaps, i))
                end = start + F.char_length(F.get(found, i))
                span = F.struct(
                    start.alias("start"), end.alias("end"), F.get(found, i).alias("value")
                )
                return F.struct(
                    end.alias("at"), F.concat(state["out"], F.array(span)).alias("out")
                )

            def block(state: Column, first: Column) -> Column:
                numbers = F.sequence(first, F.least(first + _FOLDED, F.size(found)) - 1)
                begin = F.struct(state["at"].alias("at"), F.array().cast(kind).alias("out"))
                return bound(
                    F.aggregate(numbers, begin, add),
                    lambda new: F.struct(
                        new["at"].alias("at"),
                        F.concat(state["outs"], F.array(new["out"])).alias("outs"),
                    ),
                )

            begin = F.struct(
                F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("outs")
            )
            walked = F.aggregate(_firsts(F.size(found)), begin, block)
            return F.flatten(walked["outs"])

        return F.when(F.size(found) > 0, bound(F.split(text, pattern, -1), among)).otherwise(
            F.array().cast(kind)
        )

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    back = F.reverse(number)
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(number)),
        F.lit(0),
        lambda sum_, i: sum_
        + bound(
            F.substr(back, i, F.lit(1)).cast("int"),
            lambda d: F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)),
        ),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        size = F.char_length(digits(value))
        return F.when((size >= 13) & (size <= 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.char_length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of a kind; a match that fails is dropped and not tried again."""
    sign = _SIGNS[kind]
    found = F.filter(matches(text, PATTERNS[kind]), lambda span: _valid(kind, span["value"]))
    if sign is None:
        return found
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.contains(sign), found).otherwise(none)


def terms_in(text: Column) -> Column:
    """Distinct terms of a text, in lower case."""
    every = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.filter(F.array_distinct(every), lambda t: F.char_length(t) >= SHORTEST)


def found_base(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, text (null as empty), the columns to keep, and one of spans per kind."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep)
    return rows.select("*", *[base_spans(F.col("text"), kind).alias(kind) for kind in PATTERNS])


def entities() -> Column:
    """The distinct protected entities of a row of ``found_base``."""

    def of_kind(kind: str) -> Column:
        return F.transform(
            F.col(kind),
            lambda span: F.concat(
                F.lit(f"{kind}:"),
                F.lower(span["value"]) if kind == "email" else (
                    span["value"] if kind == "ip" else digits(span["value"])
                ),
            ),
        )

    return F.array_distinct(F.concat(*[of_kind(kind) for kind in PATTERNS]))


def outside_terms() -> Column:
    """Distinct terms of a row of ``found_base`` outside its spans."""
    spans = [
        F.transform(F.col(kind), lambda s: F.struct(s["start"], s["end"], F.lit(" ").alias("label")))
        for kind in PATTERNS
    ]
    spans = F.concat(*spans)
    return terms_in(F.when(F.size(spans) == 0, F.col("text")).otherwise(replaced(spans)))


def joined_with_few(rows: DataFrame, few: DataFrame, on: str, limit: int) -> DataFrame:
    """An inner join; ``few`` is broadcast if its measured size allows."""
    return rows.join(F.broadcast(few) if fits_broadcast(few, limit) else few, on)


def disclosing_terms(
    found: DataFrame,
    *,
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """doc_id, text_key, terms, removed: of each row of ``found_base`` with a disclosing term.

    ``terms`` are all of them, ``removed`` those that all but name an entity. All counts are
    numbers of distinct texts, over all documents. A row is known by its id and a hash of its
    text.
    """
    keyed = found.withColumn("text_key", F.xxhash64("text"))
    rows = written(keyed.groupBy("text_key").agg(F.count("*").alias("n_rows")), "texts")
    n = F.lit(float(rows.count()))
    # Each of n_rows equal texts counts as that part of one, so no text moves to find its copies.
    part = F.lit(1.0) / F.coalesce("n_rows", F.lit(1))

    def texts(parts: Column) -> Column:
        return F.round(F.sum(parts)).cast("bigint")

    holders = keyed.select("text_key", entities().alias("entities")).where(F.size("entities") > 0)
    held = written(
        holders.dropDuplicates(["text_key"]).select("text_key", F.explode("entities").alias("entity")),
        "entities",
    )
    often = written(
        held.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support),
        "often",
    )
    # Texts with the same entities are counted together before these are taken apart.
    known = written(
        joined_with_few(held, often, "entity", limit)
        .groupBy("text_key")
        .agg(F.array_sort(F.collect_list("entity")).alias("entities"))
        .join(rows, "text_key"),
        "known",
    )
    pairs = (
        joined_with_few(keyed, known, "text_key", limit)
        .select("entities", part.alias("part"), F.explode(outside_terms()).alias("term"))
        .groupBy("entities", "term")
        .agg(F.sum("part").alias("parts"))
        .select(F.explode("entities").alias("entity"), "term", "parts")
        .groupBy("entity", "term")
        .agg(texts(F.col("parts")).alias("n_both"))
        .where(F.col("n_both") >= support)
    )
    pairs = written(pairs.join(often, "entity"), "pairs")
    copies = rows.where(F.col("n_rows") > 1)
    if fits_broadcast(copies, limit):
        copies = F.broadcast(copies)
    spread = keyed.join(copies, "text_key", "left").select(
        part.alias("part"), F.explode(outside_terms()).alias("term")
    )
    with_term = (
        joined_with_few(spread, written(pairs.select("term").distinct(), "candidates"), "term", limit)
        .groupBy("term")
        .agg(texts(F.col("part")).alias("n_term"))
    )
    told = F.log(F.col("n_both") * n / (F.col("n_term") * F.col("n_entity")))
    # An entity that every document has carries no information to disclose.
    own = F.nullif(F.log(n / F.col("n_entity")), F.lit(0.0))
    strong = (
        pairs.join(with_term, "term")
        .groupBy("term")
        .agg(F.max(F.try_divide(told, own)).alias("strength"))
        .where(F.col("strength") >= generalise)
    )
    strong = written(strong, "terms")
    hits = keyed.select("doc_id", "text_key", F.explode(terms_in(F.col("text"))).alias("term"))
    return (
        joined_with_few(hits, strong, "term", limit)
        .distinct()
        .groupBy("doc_id", "text_key")
        .agg(
            F.array_sort(F.collect_list("term")).alias("terms"),
            F.collect_list(F.when(F.col("strength") >= remove, F.col("term"))).alias("removed"),
        )
    )


def protected(
    docs: DataFrame,
    *,
    keep: Sequence[str] = (),
    limit: int = BROADCAST_BYTES,
    **thresholds: float,
) -> DataFrame:
    """doc_id, text and the spans of each kind, the added kind ``term`` too, of each row.

    A span has start, end, value and, for terms, the label that replaces it. Terms that touch
    a base span are left to it. A null text is empty; rows that repeat an id are rows of
    their own; an empty table gives none. Of other columns only those to ``keep`` are there.
    """
    found = found_base(docs, keep)
    marked = written(disclosing_terms(found, limit=limit, **thresholds), "marked")
    marked = marked.withColumnRenamed("doc_id", "marked_id")
    if fits_broadcast(marked, limit):
        marked = F.broadcast(marked)
    rows = found.join(
        marked,
        F.col("doc_id").eqNullSafe(F.col("marked_id"))
        & (F.xxhash64("text") == F.col("text_key")),
        "left",
    )
    # Terms are letters and digits only, so they stand for themselves in a pattern.
    pattern = F.concat(
        F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])")
    )
    base = F.concat(*PATTERNS)
    none = F.array().cast("array<struct<start:int,end:int,value:string,label:string>>")

    def labelled(span: Column) -> Column:
        value = span["value"]
        label = (
            F.when(F.array_contains("removed", F.lower(value)), "<TERM>")
            .when(value.rlike("^[0-9]+$"), "<NUMBER>")
            .when(value.rlike(r"^\p{Lu}"), "<NAME>")
            .otherwise("<WORD>")
        )
        return F.struct(span["start"], span["end"], value, label.alias("label"))

    def apart(span: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))

    terms = F.transform(F.filter(matches(F.col("text"), pattern), apart), labelled)
    return rows.select(
        "doc_id", "text", *keep, *PATTERNS,
        F.when(F.col("terms").isNotNull(), terms).otherwise(none).alias("term"),
    )


def listed(*kinds: str) -> Column:
    """kind:start:end of the spans of these kinds, joined by commas."""

    def of_kind(kind: str) -> Column:
        return F.transform(
            F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])
        )

    return F.array_join(F.concat(*map(of_kind, kinds)), ",")


def replaced(spans: Column) -> Column:
    """The text of a row with its spans (start, end, label) replaced by their labels.

    Spans that overlap become one, under the label of the first.
    """

    def put(ordered: Column) -> Column:
        def block(state: Column, first: Column) -> Column:
            some = F.slice(ordered, first + 1, F.lit(_FOLDED))
            end = F.greatest(state["at"], F.array_max(F.transform(some, lambda s: s["end"])))

            # Code points are counted from a text's start, so the gaps of a block are cut from
            # the stretch of text that it lies in.
            def within(stretch: Column) -> Column:
                def add(inner: Column, span: Column) -> Column:
                    gap = F.substr(
                        stretch, inner["at"] - state["at"] + 1, span["start"] - inner["at"]
                    )
                    return F.struct(
                        F.greatest(inner["at"], span["end"]).alias("at"),
                        F.when(span["start"] < inner["at"], inner["out"])
                        .otherwise(F.concat(inner["out"], gap, span["label"]))
                        .alias("out"),
                    )

                begin = F.struct(state["at"].alias("at"), F.lit("").alias("out"))
                return F.aggregate(some, begin, add)

            stretch = F.substr("text", state["at"] + 1, end - state["at"])
            return bound(
                bound(stretch, within),
                lambda new: F.struct(
                    new["at"].alias("at"),
                    F.concat(state["outs"], F.array(new["out"])).alias("outs"),
                ),
            )

        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("outs"))
        return bound(
            F.aggregate(_firsts(F.size(ordered)), begin, block),
            lambda walked: F.concat(
                F.array_join(walked["outs"], ""),
                F.substr("text", walked["at"] + 1, F.char_length("text")),
            ),
        )

    return bound(F.array_sort(spans), put)


def sanitised() -> Column:
    """The text of a row of ``protected`` with its spans replaced by labels."""

    def of_kind(kind: str) -> Column:
        label = F.lit(f"<{kind.upper()}>").alias("label")
        return F.transform(F.col(kind), lambda s: F.struct(s["start"], s["end"], label))

    spans = [of_kind(kind) for kind in PATTERNS]
    spans.append(F.transform(F.col("term"), lambda s: F.struct(s["start"], s["end"], s["label"])))
    return replaced(F.concat(*spans))


def cleaned(docs: DataFrame, **options: float) -> DataFrame:
    """``docs`` with sanitised texts: doc_id, text, lang, source, n_chars. A null text becomes
    an empty one."""
    rows = protected(docs, keep=("lang", "source"), **options)
    return rows.withColumn("text", sanitised()).select(
        "doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars")
    )
