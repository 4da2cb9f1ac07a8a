"""Column expressions against the rules stated in plain Python."""

import os

import pytest
from pyspark.sql import functions as F

from metadoc.functions import scorers, text
from metadoc.functions.levels import level_limit, object_level, quoted_target, target_label


def values(spark, rows, expression, schema="x string"):
    frame = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)],
                                  "i int, " + schema)
    return [r[0] for r in frame.orderBy("i").select(expression.alias("v")).collect()]


def test_strip_is_python_strip(spark):
    cases = ["", " a ", "\t\na\x0b\x0c\r", "\xa0x　", "\x1c\x1fy\x85", "a b", "​z"]
    assert values(spark, cases, text.strip(F.col("x"))) == [c.strip() for c in cases]


def test_extension_is_python_splitext(spark):
    cases = ["a.md", "A.DOCX", ".bashrc", "..a.b", "a..b", "a.b/c", "d/.x", "noext", "a.", "x.tar.gz", "a.b.c\n"]
    assert values(spark, cases, text.file_extension(F.col("x"))) == [
        os.path.splitext(c)[1].lower() for c in cases]


def test_hints(spark):
    cases = ['v [tabs: a, "b"]', "[HOJAS: x]", "[campos: p, q]", "none", "[tab:,, a ,]", "[sheet : 'm n']",
             "[columna: `k`] [tabs: t] [tabs: u]", None]
    assert values(spark, cases, text.hint_tabs(F.col("x"))) == [
        ["a", "b"], ["x"], [], [], ["a"], ["m n"], ["t"], []]
    assert values(spark, cases, text.hint_columns(F.col("x"))) == [
        [], [], ["p", "q"], [], [], [], ["k"], []]


def test_quoting(spark):
    assert values(spark, ["a-b", "we`ird"], text.quote_name(F.col("x"))) == ["`a-b`", "`we``ird`"]
    cases = ["it's", "back\\slash", None, "a'\\'b"]
    for given, literal in zip(cases, values(spark, cases, text.sql_string(F.col("x")))):
        assert spark.sql(f"SELECT {literal}").first()[0] == (given or "")


def test_three_parts(spark):
    assert values(spark, ["a.b.c", "a.b", "a.b.c.d", ".."], text.is_three_part(F.col("x"))) == [
        True, False, False, True]


def test_cell(spark):
    got = values(spark, ["ab", None, "x" * 60, "a\nb"], text.cell(F.col("x"), 50))
    assert got == ["ab", "NULL", "x" * 47 + "...", "a\\nb"]


LEVELS = [("__esquema__", "__esquema__"), ("__esquema__", "c"), ("t", "__tabla__"), ("t", "c"),
          ("__esquema__", "__tabla__")]


def test_levels(spark):
    level = object_level(F.col("t"), F.col("c"))
    assert values(spark, LEVELS, level, "t string, c string") == [
        "schema", "column", "table", "column", "table"]
    names = [F.lit("k"), F.lit("s"), F.col("t"), F.col("c")]
    assert values(spark, LEVELS[:4], target_label(level, *names), "t string, c string") == [
        "esquema k.s", "columna k.s.__esquema__.c", "tabla k.s.t", "columna k.s.t.c"]
    assert values(spark, LEVELS[2:4], quoted_target(level, *names), "t string, c string") == [
        "Tabla `k`.`s`.`t`", "Columna `k`.`s`.`t`.`c`"]


@pytest.mark.parametrize("most,expected", [(500, [500, 500, 300, 500]), (100, [100] * 4), (400, [400, 400, 300, 400])])
def test_level_limits(spark, most, expected):
    assert values(spark, ["schema", "table", "column", "view"], level_limit(F.col("x"), most)) == expected


PII = [("1234567", 0), ("12345678", 1), ("12345678901", 1), ("123456789012", 0), ("a@b.cé", 1),
       ("x 1234 5678 1234 5678", 1), ("1234-5678-1234-5678", 1), ("1234567812345678", 1), ("texto", 0),
       ("a12345678b", 0), ("１２３４５６７８", 1), ("@", 0), ("a@b", 0)]


def test_pii(spark):
    got = values(spark, [c for c, _ in PII], scorers.flag(scorers.has_pii(F.col("x"))))
    assert got == [hit for _, hit in PII]


def test_spanish(spark):
    cases = [("de", 1), ("casa de campo", 1), ("déla", 0), ("LA", 1), ("éla", 0), ("", 0), ("para.", 1)]
    got = values(spark, [c for c, _ in cases], scorers.flag(scorers.is_spanish(F.col("x"))))
    assert got == [hit for _, hit in cases]


def test_style(spark):
    frame = spark.createDataFrame(
        [("Definición: la casa", "column"), ("x" * 301, "column"), ('dice "no" para', "table"),
         ("# Título de la\n", "table"), ("Describe la tabla.", "table")], "c string, l string")
    rows = frame.select(*scorers.style_flags(F.col("c"), F.col("l"))).collect()
    assert [tuple(r) for r in rows] == [
        (0, 0, 0, 1, 0), (1, 0, 0, 0, 1), (0, 1, 0, 0, 0), (0, 0, 1, 0, 0), (0, 0, 0, 0, 0)]


def test_fill_leaves_inserted_braces_alone(spark):
    filled = text.fill("a {x} {{b}}", x=F.col("x"))
    assert values(spark, ["{y}"], filled) == ["a {y} {b}"]
