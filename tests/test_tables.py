"""Table files: headers, missing cells, malformed cells."""

import gzip
from urllib.parse import unquote

import pytest
from compare import plan_of, rows_of
from conftest import REGISTRATIONS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gradeweave.operators.grouping import count_rows
from gradeweave.sources.schemas import TABLES, as_declared, header_cells, table_schema
from gradeweave.sources.tables import (
    append_tag,
    drop_header,
    drop_missing,
    first_line,
    header_lines,
    parse_lines,
    read_lines,
    read_table,
    read_with_header_row,
    to_lines,
    write_table,
)

HEADER = "CourseRegistrations 8:INT CourseOfferId,INT StudentRegistrationId,GRADE Grade"
BODY = [",".join("null" if cell is None else str(cell) for cell in row) for row in REGISTRATIONS]


def write(folder, name, lines, newline_at_end=True):
    text = "\n".join(lines) + ("\n" if newline_at_end else "")
    path = folder / TABLES[name].file
    path.write_text(text)
    return str(folder)


def test_scan_skips_the_header_and_reads_null(spark, tmp_path):
    folder = write(tmp_path, "CourseRegistrations", [HEADER, *BODY])
    df = read_table(spark, folder, "CourseRegistrations")
    assert df.dtypes == [("offer_id", "int"), ("student_id", "int"), ("grade", "int")]
    assert rows_of(df) == sorted(REGISTRATIONS, key=lambda r: (r[0], r[1], r[2] or 0))


def test_scan_fails_on_a_malformed_cell(spark, tmp_path):
    folder = write(tmp_path, "CourseRegistrations", [HEADER, "1,2,7", "1,3,x"])
    with pytest.raises(Exception, match="malformed"):
        read_table(spark, folder, "CourseRegistrations").collect()


def test_text_columns(spark, tmp_path):
    header = ",".join(header_cells("Students", 2))
    assert header == (
        "Students 2:AUTOINCREASE StudentId,VARCHAR StudentName,VARCHARLONG Address,"
        "INT BirthyearStudent,GENDER Gender"
    )
    folder = write(tmp_path, "Students", [header, '0,a "b c, by d ,1982,M', "1,x,y,1999,F"])
    assert rows_of(read_table(spark, folder, "Students")) == [
        (0, 'a "b c', " by d ", 1982, "M"),
        (1, "x", "y", 1999, "F"),
    ]


def test_every_table_has_a_reader(spark, tmp_path):
    for name in TABLES:
        header = ",".join(header_cells(name, 1))
        cells = ["1" if f.dataType.typeName() == "integer" else "t" for f in table_schema(name)]
        folder = write(tmp_path, name, [header, ",".join(cells)])
        df = read_table(spark, folder, name)
        assert rows_of(df) == [tuple(1 if cell == "1" else "t" for cell in cells)]
        assert as_declared(df, name).columns == [c.declared for c in TABLES[name].columns]


def test_lenient_scan_keeps_the_header_as_nulls(spark, tmp_path):
    folder = write(tmp_path, "CourseRegistrations", [HEADER, *BODY])
    rows = read_with_header_row(spark, folder, "CourseRegistrations").collect()
    assert len(rows) == len(REGISTRATIONS) + 1
    assert tuple(rows[0]) == (None, None, None)


def test_lenient_scan_tells_headers_from_malformed_lines(spark, tmp_path):
    lines = [HEADER, "1,2,3", "null,null,null", "4,x,5", "6,7", "8,9,10,11"]
    folder = write(tmp_path, "CourseRegistrations", lines)
    rows = read_with_header_row(spark, folder, "CourseRegistrations", flagged=True)
    assert rows.columns == ["offer_id", "student_id", "grade", "header", "malformed"]
    found = [tuple(row) for row in rows.collect()]
    assert found == [
        (None, None, None, True, None),
        (1, 2, 3, False, None),
        (None, None, None, False, None),
        (4, None, 5, False, "4,x,5"),
        (6, 7, None, False, "6,7"),
        (8, 9, 10, False, "8,9,10,11"),
    ]


def test_lenient_scan_gives_the_same_join(spark, tmp_path, offers):
    folder = write(tmp_path, "CourseRegistrations", [HEADER, *BODY])
    lenient = read_with_header_row(spark, folder, "CourseRegistrations")
    strict = read_table(spark, folder, "CourseRegistrations")
    assert rows_of(offers.join(lenient, "offer_id")) == rows_of(offers.join(strict, "offer_id"))


def test_points_without_newline_at_the_end(spark, tmp_path):
    folder = write(
        tmp_path, "QuantilePoints", ["QuantilePoints", *map(str, range(1, 11))], False
    )
    assert rows_of(read_table(spark, folder, "QuantilePoints")) == [(q,) for q in range(1, 11)]


def test_repeated_header_lines_all_go(spark, tmp_path):
    folder = write(tmp_path, "CourseRegistrations", [HEADER, "1,2,3", HEADER, "4,5,6"])
    df = read_table(spark, folder, "CourseRegistrations")
    assert rows_of(df) == [(1, 2, 3), (4, 5, 6)]


def test_folder_with_one_header(spark, tmp_path):
    folder = tmp_path / TABLES["StudentAssistants"].file
    folder.mkdir()
    header = ",".join(header_cells("StudentAssistants", 3))
    (folder / "a 1").write_text(f"{header}\n1,2\n")
    (folder / "b").write_text("".join(f"{i},{i}\n" for i in range(5000)))
    (folder / "c").write_text("5,6\n7,8\n")
    df = read_table(spark, str(tmp_path), "StudentAssistants")
    assert df.count() == 5003
    assert first_line(spark, str(folder)) == header


def test_first_line_passes_over_empty_files(spark, tmp_path):
    (tmp_path / "a").write_text("")
    (tmp_path / "b").write_text("head\n1\n")
    assert first_line(spark, str(tmp_path)) == "head"


def test_first_line_of_odd_files(spark, tmp_path, monkeypatch):
    with gzip.open(tmp_path / "a.gz", "wt"):
        pass  # no line, though not of size 0
    (tmp_path / "b c%20d").write_text("\nsecond\n")
    (tmp_path / "c").write_text("third\n" * 5000)
    monkeypatch.setattr(DataFrame, "inputFiles", None)
    assert first_line(spark, str(tmp_path)) == ""
    found = {unquote(row["file"]).split("/")[-1]: row["value"]
             for row in header_lines(spark, str(tmp_path)).collect()}
    assert found == {"b c%20d": "", "c": "third"}


def test_header_lines_do_not_sort_the_lines(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(f"head of {name}\n" + "1,2,3\n" * 20_000)
    found = header_lines(spark, str(tmp_path))
    assert "Sort" not in plan_of(found)
    assert {row["value"] for row in found.collect()} == {f"head of {name}" for name in "abc"}
    assert found.count() == 3


def test_first_line_of_nothing(spark, tmp_path):
    (tmp_path / "a").write_text("")
    assert first_line(spark, str(tmp_path)) is None
    assert drop_header(read_lines(spark, str(tmp_path)), None).count() == 0


def lines_of(spark, lines):
    return spark.createDataFrame([(line,) for line in lines], "value string")


def test_lines_without_header_and_missing(spark):
    lines = lines_of(spark, [HEADER, *BODY])
    kept = drop_missing(drop_header(lines, HEADER))
    assert rows_of(kept) == sorted((line,) for line in BODY if "null" not in line)


def test_parse_lines_matches_the_csv_scan(spark, tmp_path):
    folder = write(tmp_path, "CourseRegistrations", [HEADER, *BODY])
    lines = drop_header(read_lines(spark, f"{folder}/CourseRegistrations.table"), HEADER)
    parsed = parse_lines(lines, table_schema("CourseRegistrations"))
    assert rows_of(parsed) == rows_of(read_table(spark, folder, "CourseRegistrations"))


@pytest.mark.parametrize("line", ["1,2,x", "1,2,", "1,2", "one,2,3", "1,2,99999999999"])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_parse_lines_is_strict_about_cells(spark, line, ansi):
    schema = table_schema("CourseRegistrations")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="malformed"):
            parse_lines(lines_of(spark, [line]), schema).collect()
        lenient = parse_lines(lines_of(spark, [line]), schema, strict=False).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert len(lenient) == 1
    assert None in tuple(lenient[0])


def test_lines_round_trip(spark, registrations):
    schema = table_schema("CourseRegistrations")
    assert rows_of(parse_lines(to_lines(registrations), schema)) == rows_of(registrations)
    tagged = append_tag(to_lines(registrations.limit(1)), "CR")
    assert rows_of(tagged) == [("1,3,7,CR",)]


def test_written_table_round_trip(spark, registrations, tmp_path):
    folder = write_table(registrations.repartition(3), str(tmp_path / "t"), "CourseRegistrations")
    assert rows_of(read_table(spark, folder, "CourseRegistrations")) == rows_of(registrations)
    path = f"{folder}/CourseRegistrations.table"
    assert first_line(spark, path) == HEADER
    assert count_rows(read_lines(spark, path).where(F.col("value") == HEADER)).first()["n"] == 3


def test_wide_keys(spark, tmp_path):
    key = 2**40
    df = spark.createDataFrame([(key, 1, None)], "offer_id bigint, student_id bigint, grade int")
    folder = write_table(df, str(tmp_path / "t"), "CourseRegistrations")
    read = read_table(spark, folder, "CourseRegistrations", key_type=LongType())
    assert rows_of(read) == [(key, 1, None)]
    with pytest.raises(Exception, match="malformed"):
        read_table(spark, folder, "CourseRegistrations").collect()
