"""Single-field cleaners (SC-1..6): the reference's cleaner cases plus edge cases."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException

from cartwise.functions import clean as C
from cartwise.functions.text import decimal_text, split_list


def one(spark, expr, value):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expr("v").alias("out")).first()["out"]


@pytest.mark.parametrize("raw,expected", [
    ("  Homeowner ", "Homeowner"), ("null", None), ("  NULL ", None), ("", None), ("   ", None),
    ("\tRenter ", "Renter"),
])
def test_optional_text(spark, raw, expected):
    assert one(spark, C.clean_optional_text, raw) == expected


def test_required_text_keeps_empty(spark):
    assert one(spark, C.clean_text, "NON-FOOD     ") == "NON-FOOD"
    assert one(spark, C.clean_text, "   ") == ""


@pytest.mark.parametrize("raw,expected", [
    (" 1600 ", 1600), ("0159", 159), ("00072499", 72499), ("1.0", 1), ("1e3", 1000),
    ("abc", None), ("", 0), ("  ", 0), ("1.5", None), ("5d", None),
])
def test_parse_int(spark, raw, expected):
    assert one(spark, C.parse_int, raw) == expected


def test_require_int_fails_on_bad_value(spark):
    df = spark.createDataFrame([("abc",)], "v string")
    with pytest.raises(PySparkException, match="Expected an integer"):
        df.select(C.require_int("v", "UNITS")).collect()


@pytest.mark.parametrize("raw,expected", [("Y", True), ("  n ", False), ("maybe", None)])
def test_yes_no(spark, raw, expected):
    assert one(spark, C.parse_yes_no, raw) == expected


@pytest.mark.parametrize("raw,expected", [(".59", "0.59"), ("   3.49", "3.49"), (" 3.495 ", "3.50")])
def test_money(spark, raw, expected):
    assert str(one(spark, C.parse_money, raw)) == expected


@pytest.mark.parametrize("raw,expected", [
    ("17-AUG-18", dt.date(2018, 8, 17)),
    ("2018-08-17", None),
    ("01-JAN-69", dt.date(2069, 1, 1)),
    ("01-JAN-70", dt.date(1970, 1, 1)),
    ("7-aug-18", dt.date(2018, 8, 7)),
    ("31-FEB-18", dt.date(2018, 3, 3)),
    ("00-MAR-20", dt.date(2020, 2, 29)),
    ("17-XYZ-18", None),
    (" 17-Aug-18 ", dt.date(2018, 8, 17)),
])
def test_oracle_date(spark, raw, expected):
    assert one(spark, C.parse_oracle_date, raw) == expected


def test_require_date_names_the_value(spark):
    df = spark.createDataFrame([("2018-08-17",)], "v string")
    with pytest.raises(PySparkException, match="DD-MON-YY"):
        df.select(C.require_oracle_date("v", "PURCHASE_")).collect()


def test_split_list(spark):
    df = spark.createDataFrame([("PASTA, PASTA SAUCE,, ",), ("",)], "v string")
    got = [r[0] for r in df.select(split_list("v")).collect()]
    assert got == [["PASTA", "PASTA SAUCE"], []]


def test_decimal_text(spark):
    df = spark.createDataFrame([("1.00",), ("0.50",), ("10.00",), ("3.49",)], "v string")
    got = [r[0] for r in df.select(decimal_text(df.v.cast("decimal(10,2)"))).collect()]
    assert got == ["1", "0.5", "10", "3.49"]
