"""Reading and writing the comma-separated table files.

``read_table`` reads a table's lines, leaves out header lines wherever they stand, and parses
the rest strictly. Part files may have a header each, or only the first of them, or none.
``read_lines``, ``drop_header`` and ``parse_lines`` are its steps, for other layouts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from gradeweave.sources.schemas import MISSING, TABLES, header_cells, table_schema


_UNREAD = "_unread"


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{TABLES[name].file}"


def read_table(
    spark: SparkSession, folder: str, name: str, *, key_type: DataType | None = None
) -> DataFrame:
    """Scan a table; a ``null`` cell is missing, any other malformed cell that is read fails
    the job.

    A header line starts with the table's own name. No other line can: the first column of
    every table is a number.
    """
    lines = read_lines(spark, table_path(folder, name))
    rows = lines.where((F.col("value") != "") & ~F.startswith(F.col("value"), F.lit(name)))
    return parse_lines(rows, table_schema(name, key_type))


def read_with_header_row(
    spark: SparkSession,
    folder: str,
    name: str,
    *,
    key_type: DataType | None = None,
    flagged: bool = False,
) -> DataFrame:
    """Lenient scan that keeps each header line as a row of nulls.

    Such rows have no key, so an inner join or a filter removes them; row counts taken
    before that include them. ``flagged`` adds two columns: ``header`` (the line starts with the
    table's name) and ``malformed``, the text of any other line that has a cell of the wrong
    type or a wrong number of cells, else null. So rows of nulls that were written as such can be
    told from lines that could not be read.
    """
    schema = table_schema(name, key_type)
    lines = (
        spark.read.option("header", False)
        .option("nullValue", MISSING)
        .option("quote", "")
        .option("mode", "PERMISSIVE")
    )
    if not flagged:
        return lines.schema(schema).csv(table_path(folder, name))
    kept = StructType([*schema.fields, StructField(_UNREAD, StringType(), True)])
    rows = lines.schema(kept).option("columnNameOfCorruptRecord", _UNREAD)
    unread = F.col(_UNREAD)
    header = F.coalesce(F.startswith(unread, F.lit(name)), F.lit(False))
    return rows.csv(table_path(folder, name)).select(
        *schema.names,
        header.alias("header"),
        F.when(~header, unread).alias("malformed"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file or folder, one ``value`` each."""
    return spark.read.text(path)


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of the first non-empty file, in order of file name.

    Spark packs large files first, so the first row of the whole folder need not be the
    header. The least name of a file with content is found from the files' metadata in one
    aggregate, without reading them and without a list of them on the driver; that file alone
    is then read, up to its first line. A compressed file may be empty all the same, so the
    next one may follow.
    """
    names = spark.read.format("binaryFile").load(path)
    names = names.select("_metadata.file_path", "_metadata.file_size").where("file_size > 0")
    passed = ""
    while True:
        least = names.where(F.col("file_path") > passed).agg(F.min("file_path")).first()[0]
        if least is None:
            return None
        lines = spark.read.text(path).where(
            (F.col("_metadata.file_path") == least) & (F.col("_metadata.file_block_start") == 0)
        )
        row = lines.select("value").first()
        if row is not None:
            return row["value"]
        passed = least


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value: the first line of each non-empty file, found in the tasks that read it.

    Only a file's first block is looked at, so a large file is not read whole. ``file`` is its
    address as Spark gives it.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    # Within the task that reads a block, rows are numbered in order. An aggregate that keeps a text
    # sorts all its input by file, unless one that collects stands beside it: then a task holds
    # one line of each file. No row is below 0, so nothing is collected.
    first = lines.where(F.col("start") == 0).groupBy("file")
    kept = first.agg(
        F.min_by("value", "row").alias("value"),
        F.collect_set(F.when(F.col("row") < 0, F.col("row"))).alias("none"),
    )
    return kept.where(F.size("none") == 0).select("file", "value")


def drop_header(lines: DataFrame, header: str | None) -> DataFrame:
    """Remove every line equal to the header."""
    if header is None:
        return lines
    return lines.where(F.col("value") != header)


def drop_missing(lines: DataFrame) -> DataFrame:
    """Remove the lines that contain a ``null`` cell's text anywhere."""
    return lines.where(~F.contains(F.col("value"), F.lit(MISSING)))


def parse_lines(lines: DataFrame, schema: StructType, *, strict: bool = True) -> DataFrame:
    """Split lines at the commas and turn the cells into typed columns.

    ``strict`` fails the job on a cell that is neither a value of its type nor ``null``;
    otherwise such a cell is null. Neither depends on the session's ANSI setting.
    """
    cells = F.split(F.col("value"), ",")
    return lines.select(
        *[
            _typed(F.get(cells, F.lit(i)), field.dataType, field.name, strict).alias(field.name)
            for i, field in enumerate(schema.fields)
        ]
    )


def _typed(cell: Column, data_type: DataType, name: str, strict: bool) -> Column:
    # Missing cells are taken out first: a failing try_cast throws and catches per row.
    value = F.nullif(cell, F.lit(MISSING))
    if not isinstance(data_type, StringType):
        value = value.try_cast(data_type)
    if not strict:
        return value
    malformed = value.isNull() & ~cell.eqNullSafe(F.lit(MISSING))
    complaint = F.concat(
        F.lit(f"malformed {name}: "), F.coalesce(cell, F.lit("no such cell in the line"))
    )
    return F.when(malformed, F.raise_error(complaint).cast(data_type)).otherwise(value)


def to_lines(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows as comma-separated lines, missing cells as ``null``."""
    cells = [
        F.coalesce(F.col(name).cast("string"), F.lit(MISSING)) for name in columns or df.columns
    ]
    return df.select(F.concat_ws(",", *cells).alias("value"))


def append_tag(lines: DataFrame, tag: str) -> DataFrame:
    """Append a constant last cell to each line."""
    return lines.select(F.concat(F.col("value"), F.lit(f",{tag}")).alias("value"))


def write_table(df: DataFrame, folder: str, name: str) -> str:
    """Write a table as a folder of part files, each with the table's header line.

    Returns ``folder``, so that ``read_table(spark, write_table(...), name)`` reads it back.
    """
    (
        df.toDF(*header_cells(name, df.count()))
        .write.option("header", True)
        .option("nullValue", MISSING)
        .option("emptyValue", "")
        .option("quote", "")
        .mode("errorifexists")
        .csv(table_path(folder, name))
    )
    return folder
