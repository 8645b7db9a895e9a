"""Scalar column functions (F*, N1) against known values."""

import math

import pytest
from pyspark.sql import functions as F

from paddock.functions import columns as C
from paddock.operators import staging
from paddock.sources import files


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "text,expected",
    [("5/2", 2.5), ("9-5", 1.8), ("EVEN", 1.0), ("ev", 1.0), ("EVS", 1.0), (None, None), ("", None), ("  ", None),
     ("garbage", None), ("5/", None), ("/2", None), ("5/0", None)],
)
def test_parse_fractional_odds(spark, text, expected):
    assert one(spark, C.parse_fractional_odds(F.col("v")), text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [("5/1", 5.0), ("3/2", 1.5), ("5875", 58.75), ("4.50", 4.5), ("0", None), ("", None), (None, None), ("5/0", None), ("x/2", None), ("99", 99.0)],
)
def test_parse_odds(spark, text, expected):
    assert one(spark, C.parse_odds(F.col("v")), text) == expected


@pytest.mark.parametrize("text,expected", [("1", 1), ("1A", 1), (" 12B", 12), ("", None), (None, None), ("A1", None)])
def test_program_number(spark, text, expected):
    assert one(spark, C.parse_program_number(F.col("v")), text) == expected


def test_live_odds_choice(spark):
    df = spark.createDataFrame(
        [(6.0, None, None), (None, "5/2", 3.0), (None, "9", 9.0), (0.0, None, None), (None, None, -1.0)],
        "num double, txt string, trend double",
    )
    got = [r[0] for r in df.select(C.live_odds_choice(F.col("num"), F.col("txt"), F.col("trend"))).collect()]
    assert got == [6.0, 2.5, 9.0, None, None]


@pytest.mark.parametrize("value,unit,expected", [(600, "F", 1320), (550, "F", 1210), (1760, "Y", 1760), (1000, "M", 1094), (5, "X", None), (None, "F", None)])
def test_to_yards(spark, value, unit, expected):
    df = spark.createDataFrame([(value, unit)], "v long, u string")
    assert df.select(C.to_yards("v", "u")).first()[0] == expected


def test_to_yards_half_even(spark):
    # 2.5 furlong-hundredths edge: 125 F -> 275.0 exactly; half-even only matters on .5
    df = spark.createDataFrame([(0.5 / 1.09361 * 1.0,)], "v double")
    assert df.select(C.to_yards(F.lit(457), F.lit("M"))).first()[0] == 500  # 499.78 -> 500


@pytest.mark.parametrize("text,expected", [("12", 12), (" 7 ", 7), ("1.0", None), ("", None), ("x", None)])
def test_safe_int(spark, text, expected):
    assert one(spark, C.safe_int(F.col("v")), text) == expected


def test_iso_and_compact_dates(spark):
    import datetime as dt

    assert one(spark, C.iso_date(F.col("v")), "2023-04-29+00:00") == dt.date(2023, 4, 29)
    assert one(spark, C.iso_date(F.col("v")), "2023-04-29T12:00:00") == dt.date(2023, 4, 29)
    assert one(spark, C.yyyymmdd_date(F.col("v")), "20230429") == dt.date(2023, 4, 29)
    assert one(spark, C.yyyymmdd_date(F.col("v")), "2023042") is None
    assert one(spark, C.yyyymmdd_date(F.col("v")), "20231340") is None


def test_ieee_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(C.ieee_div("a", "b")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 2.0 and got[4] is None


def test_csv_int_truncates(spark):
    assert one(spark, C.csv_int(F.col("v")), "3.7") == 3
    assert one(spark, C.csv_int(F.col("v")), "") is None


def test_sub_nonneg(spark):
    df = spark.createDataFrame([(10, 3, None), (2, 5, 1), (None, 1, 1)], "a long, b long, c long")
    assert [r[0] for r in df.select(C.sub_nonneg("a", "b", "c")).collect()] == [7, 0, None]


@pytest.mark.parametrize("code,expected", [("BUM", "3U"), ("BON", "03"), ("EON", "34"), ("HUN", "2U"), ("HON", "2U"), ("ZUN", None), ("B", None)])
def test_age_restriction_code(spark, code, expected):
    assert one(spark, files.age_restriction_code(F.col("v")), code) == expected


@pytest.mark.parametrize("code,expected", [("BUN", None), ("BUM", "B"), ("BUC", "A"), ("BUF", "F"), ("BU", None)])
def test_sex_restriction_code(spark, code, expected):
    assert one(spark, files.sex_restriction_code(F.col("v")), code) == expected


@pytest.mark.parametrize("yards,label", [(1320, "6 furlongs"), (1430, "6 1/2 furlongs"), (1760, "1 mile"), (1870, "1 1/16 mile"), (1980, "1 1/8 mile"), (2200, "1 1/4 mile")])
def test_distance_label(spark, yards, label):
    df = spark.createDataFrame([(yards,)], "y long")
    assert df.select(staging.distance_label(F.col("y"))).first()[0] == label


@pytest.mark.parametrize("age,sex,label", [("3U", "F", "3yo+ F"), ("02", None, "2yo"), ("34", "B", "34yo F&M"), (None, None, "")])
def test_restriction_label(spark, age, sex, label):
    df = spark.createDataFrame([(age, sex)], "a string, s string")
    assert df.select(staging.restriction_label(F.col("a"), F.col("s"))).first()[0] == label
