"""The command line over table files."""

import pytest
from conftest import OFFERS

from gradeweave.__main__ import main
from gradeweave.sources.tables import write_table


@pytest.fixture(scope="module")
def folder(spark, offers, registrations, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    write_table(offers, path, "CourseOffers")
    write_table(registrations, path, "CourseRegistrations")
    write_table(registrations, path, "CourseRegistrations2")
    write_table(spark.range(1, 11).selectExpr("int(id) q"), path, "QuantilePoints")
    return path


PERIOD = ["--year", "2016", "--quartile", "2"]
CASES = [
    (["first-row"], [["1", "10", "2016", "2", "3", "NULL"]]),
    (["average-by-offer", *PERIOD], [["1", "5.666666666666667"], ["2", "9.0"]]),
    (["average-of-student", "--student", "3"], [["8.5"]]),
    (["average-of-student", "--student", "77"], [["NULL"]]),
    (["average-of-course", "--course", "10", *PERIOD], [["10", "6.5"]]),
    (["average-of-course", "--course", "10", "--single-precision", *PERIOD], [["10", "6.5"]]),
    (
        ["average-of-course", "--course", "10", "--message", *PERIOD],
        [
            [
                "Average grade (Spark): 6.5, for CourseId = 10, Quartile = 2, Year = 2016, "
                "and all grades >= 5"
            ]
        ],
    ),
    (["average-of-only-offer", "--course", "10", *PERIOD], []),
    (
        ["average-of-only-offer", "--course", "20", "--year", "2017", "--quartile", "1"],
        [["4", "10.0"]],
    ),
    (
        ["average-of-only-offer", "--outcome", "--course", "10", *PERIOD],
        [["several offers", "2", "2", "NULL", "NULL"]],
    ),
    (
        ["average-of-only-offer", "--outcome", "--course", "20", *PERIOD],
        [["no passed grade", "1", "0", "NULL", "NULL"]],
    ),
    (
        ["average-of-only-offer", "--outcome", "--course", "30", *PERIOD],
        [["no offer", "0", "0", "NULL", "NULL"]],
    ),
    (
        ["average-of-only-offer", "--outcome", "--course", "20", "--year", "2017",
         "--quartile", "1"],
        [["one", "1", "1", "4", "10.0"]],
    ),
    (["cumulative-counts", "--rank"], [[str(q), str(n)] for q, n in
        [(4, 1), (5, 3), (6, 3), (7, 4), (8, 5), (9, 6), (10, 7)]]),
    (["cumulative-counts"], [[str(q), str(n)] for q, n in
        [(4, 1), (5, 3), (6, 3), (7, 4), (8, 5), (9, 6), (10, 7)]]),
    (["cumulative-counts", "--grid"], [[str(q), str(n)] for q, n in
        [(4, 1), (5, 3), (6, 3), (7, 4), (8, 5), (9, 6), (10, 7)]]),
]


@pytest.mark.parametrize("arguments,expected", CASES, ids=[" ".join(case[0]) for case in CASES])
def test_command(spark, folder, capsys, arguments, expected):
    main([folder, *arguments])
    lines = [line for line in capsys.readouterr().out.splitlines() if line.startswith("|")]
    rows = [[cell.strip() for cell in line.strip("|").split("|")] for line in lines[1:]]
    assert sorted(rows) == sorted(expected)


def test_options(spark, folder, capsys):
    main([folder, "--wide-keys", "--registrations", "CourseRegistrations2", "first-row"])
    assert f"|{OFFERS[0][0]} " in capsys.readouterr().out


def test_all_rows_are_printed_or_written(spark, registrations, tmp_path, capsys):
    folder = str(tmp_path / "tables")
    write_table(registrations, folder, "CourseRegistrations")
    write_table(spark.range(1, 101).selectExpr("int(id) q"), folder, "QuantilePoints")

    def printed():
        return [line for line in capsys.readouterr().out.splitlines() if line.startswith("|")]

    main([folder, "cumulative-counts"])
    assert len(printed()) == 1 + 97  # points from 4 on, and the names
    main(["--preview", "3", folder, "cumulative-counts"])
    assert len(printed()) == 1 + 3
    main(["--output", str(tmp_path / "out"), folder, "cumulative-counts"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 97 and not printed()
