import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.functions import expressions as e


def apply(spark, fn, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_missing_text(spark):
    values = [None, "", "  ", "null", "NULL ", "null   ", " null", "x", "nullable"]
    assert apply(spark, e.not_missing, values, "string") == [False] * 6 + [True] * 3


def test_na_texts_are_exact(spark):
    values = ["", "nan", "NULL", "None", "null  ", "none", "0"]
    assert apply(spark, e.na_to_null, values, "string") == [None] * 4 + ["null  ", "none", "0"]


def test_children_status(spark):
    values = [None, "null", "NULL ", "", "0", "1", " 3 ", "0.5", "Y", "1d", "-1", "nan"]
    assert apply(spark, e.children_status, values, "string") == (
        ["Unknown"] * 3 + ["No Children"] * 2 + ["Has Children"] * 3 + ["No Children"] * 4
    )


def test_children_flag(spark):
    assert apply(spark, e.children_flag, ["Y", " Y ", "y", "1", None], "string") == [1, 1, 0, 0, 0]


def test_season_edges(spark):
    weeks = [0, 1, 13, 14, 26, 27, 39, 40, 53]
    assert apply(spark, e.season, weeks, "int") == [
        "Winter", "Spring", "Spring", "Summer", "Summer", "Fall", "Fall", "Winter", "Winter",
    ]


def test_risk_bins_are_closed_on_the_right(spark):
    p = [0.0, 0.3, 0.30001, 0.6, 0.60001, 1.0, None]
    assert apply(spark, e.risk_segment, p, "double") == [
        "Low Risk", "Low Risk", "Medium Risk", "Medium Risk", "High Risk", "High Risk", None,
    ]
    assert apply(spark, e.probability_band, p[:6], "double") == [
        "green", "green", "amber", "amber", "red", "red",
    ]


def test_priority_cuts(spark):
    assert apply(spark, e.cross_sell_priority, [200, 201, 500, 501], "bigint") == [
        "Emerging", "Medium", "Medium", "High",
    ]


def test_churn_label(spark):
    assert apply(spark, e.churned, [90, 91, 0], "int") == [0, 1, 0]


@pytest.mark.parametrize(
    "text,day",
    [
        ("2018-08-24", dt.date(2018, 8, 24)),
        (" 2018-08-24 ", dt.date(2018, 8, 24)),
        ("24-AUG-18", dt.date(2018, 8, 24)),
        ("24-Aug-99", dt.date(1999, 8, 24)),
        ("8/24/2018", dt.date(2018, 8, 24)),
        ("20180824", dt.date(2018, 8, 24)),
        ("someday", None),
        (None, None),
    ],
)
def test_dates(spark, text, day):
    assert apply(spark, e.date_or_null, [text], "string") == [day]


def test_ratio_over_nothing(spark):
    df = spark.createDataFrame([(1, 0), (3, 2)], "a int, b int")
    assert [r[0] for r in df.select(e.ratio("a", "b")).collect()] == [None, 1.5]
