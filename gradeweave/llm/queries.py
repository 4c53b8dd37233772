"""The registered queries of this package: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeweave.llm import disclosure, language, quality, toxicity
from gradeweave.llm.alignment import align_tokenizers
from gradeweave.llm.bestfit import pack_certified
from gradeweave.llm.curriculum import curriculum
from gradeweave.llm.fingerprints import edited_fingerprints
from gradeweave.llm.jaccard import jaccard_groups
from gradeweave.llm.packing import pack
from gradeweave.llm.simple8b import read_ids, write_ids
from gradeweave.llm.spelling import variants
from gradeweave.llm.warc import read_records, write_archive

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    # Only the queries that tokenize need these files.
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def merkle_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(documents(spark, folder))


def line_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return quality.assess(docs, quality.fit(docs, labels(spark, folder)))


def ecoc_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    named = language.identify(docs, language.fit(docs))
    return named.withColumn("held_out", language.held_out())


def curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    return curriculum(documents(spark, folder)).drop("positions")


def fm_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    rated = toxicity.rate(docs, toxicity.fit(docs, labels(spark, folder)))
    return rated.withColumn("held_out", toxicity.held_out())


def disclosure_pii(spark: SparkSession, folder: str) -> DataFrame:
    kinds = list(disclosure.PATTERNS)
    return disclosure.protected(documents(spark, folder)).select(
        "doc_id",
        *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in kinds],
        F.sha2(disclosure.listed(*kinds).cast("binary"), 256).alias("base_sha256"),
        disclosure.listed(*kinds, "term").alias("spans"),
    )


def warc_index(spark: SparkSession, folder: str) -> DataFrame:
    index = write_archive(spark.read.parquet(f"{folder}/pages.parquet"))
    return read_records(index).drop("payload")


def vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(documents(spark, folder), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def simple8b(spark: SparkSession, folder: str) -> DataFrame:
    files = write_ids(documents(spark, folder), tokenizer_path())
    return read_ids(files).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def group_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups(documents(spark, folder), k=4, percent=85)


def certified_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_certified(
        documents(spark, folder),
        tokenizer_path(WORD_TOKENIZER),
        carried={"ids_crc32": F.crc32("ids")},
    ).pieces


def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants(documents(spark, folder), one_in=31)


def tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokenizers(
        documents(spark, folder), tokenizer_path(), tokenizer_path(PIECE_TOKENIZER)
    ).documents


QUERIES = {
    "op1_merkle_fingerprints": merkle_fingerprints,
    "op2_line_crf": line_crf,
    "op3_ecoc_language": ecoc_language,
    "op4_curriculum_mix": curriculum_mix,
    "op5_fm_toxicity": fm_toxicity,
    "op6_warc_index": warc_index,
    "op7_disclosure_pii": disclosure_pii,
    "op8_vector_packing": vector_packing,
    "op9_simple8b": simple8b,
    "op10_group_jaccard": group_jaccard,
    "op11_certified_packing": certified_packing,
    "op12_spelling_variants": spelling_variants,
    "op13_tokenizer_alignment": tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {}
