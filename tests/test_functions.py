import datetime as dt

import pytest

from tableloom.functions import BuildError, field, if_, ifs, literal, switch
from tableloom.functions import scalars as s
from tableloom.functions.values import Val

D = dt.datetime

def cases():
    return [
    (s.abs_(-2.5), 2.5), (s.sign(-3), -1.0), (s.floor(-2.5), -3.0), (s.ceil(-2.5), -2.0), (s.ceil(2.1), 3.0),
    (s.int_(-0.5), -1.0), (s.trunc(-2.7), -2.0), (s.floor(1e20), 1e20), (s.sqrt(-1), None), (s.power(2, 10), 1024.0),
    (s.divide(1, 0), None), (s.divide(1, 0, 9), 9.0), (s.divide(None, 0, 9), None), (s.divide(10, 5), 2.0),
    (s.mod(7, -3), -2.0), (s.mod(1, 0), None), (s.quotient(-7, 2), -3.0), (s.round_(1.005, 2), 1.0),
    (s.round_(-2.5), -3.0), (s.round_(2.5), 3.0), (s.round_up(2.01, 1), 2.1), (s.round_down(-2.59, 1), -2.5),
    (s.round_to_multiple(7, 5), 5.0), (s.round_to_multiple(7, 0), 0.0), (s.ln(0), None), (s.log(100), 2.0), (s.log(8, 2), 3.0),
    (s.log(8, 1), None), (s.exp(0), 1.0),
    (s.upper("aß"), "ASS"), (s.trim(" \t a \n"), "a"), (s.len_("a😀b"), 3.0), (s.left("a😀b", 2), "a😀"), (s.left("ab", -1), ""),
    (s.right("abc", 0), ""), (s.right("abc", 2), "bc"), (s.mid("abcdef", 0, 3), "abc"), (s.mid("abcdef", 3, 2), "cd"),
    (s.substitute("aXbX", "X", "yy"), "ayybyy"), (s.substitute("ab", "", "x"), "ab"), (s.find("", "abc"), 1.0),
    (s.find("C", "abc"), 0.0), (s.find("C", "abc", True), 3.0), (s.rept("ab", 3), "ababab"), (s.rept("a", -1), ""),
    (s.split("a,b,c", ",", 2), "b"), (s.split("a,b,c", ",", 9), None), (s.split("a,b", ",", 0), None), (s.split("a,", ",", 2), ""),
    (s.regex_match("Abc", "b"), True), (s.regex_match("ABC", "b", True), True), (s.regex_extract("ab12", r"([a-z]+)(\d+)", 2), "12"),
    (s.regex_extract("zz", r"\d+"), None), (s.regex_replace("a1b2", r"(\d)", r"<\1$>"), "a<1$>b<2$>"),
    (s.canonicalize("  a \t\n b "), "a b"), (s.strip_accents("éàß"), "eaß"),
    (s.to_number(" 1e3 "), 1000.0), (s.to_number("1d"), None), (s.to_number("1e400"), None), (s.to_number("NaN"), None),
    (s.to_number(".5"), 0.5), (s.to_number("5."), 5.0), (s.to_number(True), None), (s.to_integer("-2.7"), -2), (s.to_integer("1e30"), None),
    (s.to_text(1234.5), "1234.5"), (s.to_text(-0.0000001), "0"), (s.to_text(100), "100"), (s.to_text(True), "true"),
    (s.format_number(1.005, 2), "1.00"), (s.format_number("12", 3), "12.000"), (s.format_number("x", 3), None),
    (s.to_boolean(" TRUE "), True), (s.to_boolean("yes"), None), (s.to_boolean(0), False), (s.to_boolean(2), None),
    (s.to_date("2024-02-31"), None), (s.to_date("2024-02-29T10:11:12Z"), D(2024, 2, 29, 10, 11, 12)), (s.to_date("2024-02-29 10:11"), None),
    (s.to_timestamp("2026-09-22T10:09:40.9185Z"), D(2026, 9, 22, 10, 9, 40, 918000)), (s.to_timestamp("2026-09-22"), D(2026, 9, 22)),
    (s.parse_date("31/12/2024", "DD/MM/YYYY"), D(2024, 12, 31)), (s.parse_date("2024", "YYYY"), D(2024, 1, 1)), (s.parse_date("x", "YYYY"), None),
    (s.parse_number("1.200,50", ","), 1200.5), (s.parse_number("1,200.5"), 1200.5), (s.parse_number("1e3"), None),
    (s.year("2024-05-06"), 2024.0), (s.quarter("2024-05-06"), 2.0), (s.weekday("2024-05-06"), 1.0), (s.weekday("2024-05-05"), 7.0),
    (s.date_diff("2024-05-06", "2024-05-04T12:00:00", "day"), 1.0), (s.date_diff("2024-05-04T12:00:00", "2024-05-06", "day"), -1.0),
    (s.date_diff("2024-03-01", "2023-12-31", "month"), 3.0), (s.date_add("2024-01-31", 1, "month"), D(2024, 2, 29)),
    (s.date_add("2024-02-29", 1, "year"), D(2025, 2, 28)), (s.date_add("2024-01-31", 1.5, "day"), D(2024, 2, 1, 12)),
    (s.is_missing_token(" N/A "), True), (s.is_missing_token(""), True), (s.is_missing_token(None), False), (s.is_missing_token("x"), False),
    (s.contains("a%b", "%"), True), (s.contains("ab", "%"), False), (s.contains(None, "a"), False), (s.contains("AB", "b", True), True),
    (s.concat("a", None, 1.5, True), "a1.5true"), (s.coalesce(None, 2), 2), (s.is_number(1), True), (s.is_text("a"), True),
    (s.is_number("1"), False), (s.looks_numeric("-12.5"), True), (s.looks_numeric("1e3"), False),
    (if_(literal(1) == 1, "a", "b"), "a"), (if_(literal(None) == 1, "a", "b"), "b"), (switch("b", "a", 1, "b", 2, 3), 2),
    (ifs(literal(1) > 2, "x", literal(3) > 2, "y", "z"), "y"), (literal(1) / 0, None), (literal(None) + 1, None),
]


def test_values(spark):
    CASES = cases()
    row = spark.range(1).select(*[v.col.alias(f"c{i}") for i, (v, _) in enumerate(CASES)]).first()
    wrong = [(i, row[i], want) for i, (_, want) in enumerate(CASES) if row[i] != want]
    assert not wrong


def test_null_in_null_out(spark):
    n = Val(literal(None).col.cast("string"))
    calls = [s.upper(n), s.trim(n), s.len_(n), s.left(n, 1), s.right(n, 1), s.mid(n, 1, 1), s.substitute(n, "a", "b"), s.find("a", n),
             s.rept(n, 2), s.split(n, ",", 1), s.regex_match(n, "a"), s.regex_extract(n, "a"), s.regex_replace(n, "a", "b"),
             s.canonicalize(n), s.strip_accents(n), s.to_number(n), s.to_integer(n), s.to_boolean(n), s.to_date(n), s.to_timestamp(n),
             s.parse_date(n, "YYYY"), s.parse_number(n), s.year(n), s.weekday(n), s.date_diff(n, "2024-01-01", "day"), s.date_add(n, 1, "day")]
    row = spark.range(1).select(*[v.col.alias(f"c{i}") for i, v in enumerate(calls)], *[v.failed.alias(f"f{i}") for i, v in enumerate(calls)]).first()
    assert list(row[: len(calls)]) == [None] * len(calls)
    assert not any(row[len(calls) :])


def test_failures(spark):
    x = field("x", "text")
    df = spark.createDataFrame([("1",), ("a",), (None,)], "x string")
    n = s.to_number(x)
    both = s.coalesce(n, s.to_integer(x))
    rows = df.select("x", n.failed.alias("f"), s.coalesce(n, 0).failed.alias("safe"), s.is_null(n).failed.alias("tested"),
                     both.failed.alias("both"), both.failed_function.alias("fn"), n.failed_input.alias("input"),
                     if_(x == "a", 0.0, n).failed.alias("branch")).collect()
    assert [r["f"] for r in rows] == [False, True, False]
    assert not any(r["safe"] or r["tested"] or r["branch"] for r in rows)
    assert [r["both"] for r in rows] == [False, True, False] and rows[1]["fn"] == "coalesce" and rows[1]["input"] == "a"


def test_refusals(spark):
    for bad in (lambda: field("a", "text") == 1, lambda: s.abs_("x"), lambda: s.date_diff("2024-01-01", "2024-01-01", "week"),
                lambda: s.regex_extract("a", "a", 3), lambda: s.parse_number("1", ";"), lambda: ifs(literal(1) == 1, "a"),
                lambda: if_(literal(True), 1, "b"), lambda: literal([]), lambda: literal("a") + 1, lambda: bool(literal(1) == 1)):
        with pytest.raises(BuildError):
            bad()
