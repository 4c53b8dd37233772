"""Schemas of the course-registration text tables.

Columns are found by position, so the names here are ours: short snake_case names for
queries, next to the names the files declare in their first line.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    DataType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)


class TableColumn(NamedTuple):
    kind: str
    declared: str
    name: str


class Table(NamedTuple):
    file: str
    columns: tuple[TableColumn, ...]


# File names, column types and column names of the table files.
TABLES: dict[str, Table] = {
    "CourseOffers": Table(
        "CourseOffers.table",
        (
            TableColumn("AUTOINCREASE", "CourseOfferId", "offer_id"),
            TableColumn("INT", "CourseId", "course_id"),
            TableColumn("INT", "Year", "yr"),
            TableColumn("INT", "Quartile", "quartile"),
        ),
    ),
    "CourseRegistrations": Table(
        "CourseRegistrations.table",
        (
            TableColumn("INT", "CourseOfferId", "offer_id"),
            TableColumn("INT", "StudentRegistrationId", "student_id"),
            TableColumn("GRADE", "Grade", "grade"),
        ),
    ),
    "CourseRegistrations2": Table(
        "CourseRegistrations2.table",
        (
            TableColumn("INT", "CourseOfferId", "offer_id"),
            TableColumn("INT", "StudentRegistrationId", "student_id"),
            TableColumn("GRADE", "Grade", "grade"),
        ),
    ),
    "QuantilePoints": Table(
        "QuantilePoints.table.txt",
        (TableColumn("INT", "QuantilePoint", "q"),),
    ),
    "Courses": Table(
        "Courses.table",
        (
            TableColumn("AUTOINCREASE", "CourseId", "course_id"),
            TableColumn("VARCHAR", "CourseName", "course_name"),
            TableColumn("VARCHARLONG", "CourseDescription", "course_description"),
            TableColumn("INT", "DegreeId", "degree_id"),
            TableColumn("INT", "ECTS", "ects"),
        ),
    ),
    "Degrees": Table(
        "Degrees.table",
        (
            TableColumn("AUTOINCREASE", "DegreeId", "degree_id"),
            TableColumn("VARCHAR", "Dept", "dept"),
            TableColumn("VARCHARLONG", "Description", "description"),
            TableColumn("INT", "TotalECTS", "total_ects"),
        ),
    ),
    "Students": Table(
        "Students.table",
        (
            TableColumn("AUTOINCREASE", "StudentId", "student_id"),
            TableColumn("VARCHAR", "StudentName", "student_name"),
            TableColumn("VARCHARLONG", "Address", "address"),
            TableColumn("INT", "BirthyearStudent", "birth_year"),
            TableColumn("GENDER", "Gender", "gender"),
        ),
    ),
    "StudentRegistrationsToDegrees": Table(
        "StudentRegistrationsToDegrees.table",
        (
            TableColumn("AUTOINCREASE", "StudentRegistrationId", "registration_id"),
            TableColumn("INT", "StudentId", "student_id"),
            TableColumn("INT", "DegreeId", "degree_id"),
            TableColumn("INT", "RegistrationYear", "registration_year"),
        ),
    ),
    "StudentAssistants": Table(
        "StudentAssistants.table",
        (
            TableColumn("INT", "CourseOfferId", "offer_id"),
            TableColumn("INT", "StudentRegistrationId", "student_id"),
        ),
    ),
    "Teachers": Table(
        "Teachers.table",
        (
            TableColumn("AUTOINCREASE", "TeacherId", "teacher_id"),
            TableColumn("VARCHAR", "TeacherName", "teacher_name"),
            TableColumn("VARCHARLONG", "Address", "address"),
            TableColumn("INT", "BirthyearTeacher", "birth_year"),
            TableColumn("GENDER", "Gender", "gender"),
        ),
    ),
    "TeacherAssignmentsToCourses": Table(
        "TeacherAssignmentsToCourses.table",
        (
            TableColumn("AUTOINCREASE", "CourseOfferId", "offer_id"),
            TableColumn("INT", "TeacherId", "teacher_id"),
        ),
    ),
}

# The text of a missing cell, the pass mark, and the domain of a grade.
MISSING = "null"
PASS_MARK = 5
GRADES = range(1, 11)
PASSING_GRADES = range(5, 11)

_TEXT_KINDS = {"VARCHAR", "VARCHARLONG", "GENDER"}


def table_schema(name: str, key_type: DataType | None = None) -> StructType:
    """Explicit schema of a table.

    Numbers are 32-bit, as the files declare them. ``key_type`` widens the id columns for
    tables with more than 2^31 keys.
    """
    fields = []
    for column in TABLES[name].columns:
        if column.kind in _TEXT_KINDS:
            data_type: DataType = StringType()
        elif key_type is not None and column.name.endswith("_id"):
            data_type = key_type
        else:
            data_type = IntegerType()
        fields.append(StructField(column.name, data_type, True))
    return StructType(fields)


def as_declared(df: DataFrame, name: str) -> DataFrame:
    """The same table under the column names its file declares (for existing SQL text)."""
    return df.toDF(*[column.declared for column in TABLES[name].columns])


def header_cells(name: str, rows: int) -> list[str]:
    """The cells of a table file's first line; joined by commas they are the line."""
    table = TABLES[name]
    if name == "QuantilePoints":
        return [name]
    cells = [f"{column.kind} {column.declared}" for column in table.columns]
    cells[0] = f"{name} {rows}:{cells[0]}"
    return cells
