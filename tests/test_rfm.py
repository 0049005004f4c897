import datetime as dt

import pytest

from larder.operators import dashboard, rfm
from tests.conftest import line, tuples


@pytest.fixture
def star(make_star):
    day = dt.date
    lines = [
        line(1, 10, 1, 10.5, PURCHASE_DATE=day(2020, 8, 31), UNITS=2),
        line(2, 10, 1, 4, PURCHASE_DATE=day(2020, 2, 29)),
        line(2, 10, 2, 1, PURCHASE_DATE=day(2020, 2, 29)),
        line(3, 10, 1, 3, PURCHASE_DATE=day(2020, 2, 28)),
        line(4, 10, 1, 100, PURCHASE_DATE=None),
        line(5, 11, 1, 7, PURCHASE_DATE=day(2020, 1, 1)),
        line(6, 12, 1, 0, PURCHASE_DATE=None, UNITS=None),
        line(7, None, 1, 1, PURCHASE_DATE=day(2020, 8, 1)),
    ]
    households = [
        dict(HSHD_NUM=10, INCOME_RANGE="9", AGE_RANGE="b", HH_SIZE="1", L="Y", CHILDREN=" Y "),
        dict(HSHD_NUM=11, INCOME_RANGE="10", AGE_RANGE="a", HH_SIZE=None, L="N", CHILDREN="1"),
        dict(HSHD_NUM=13, INCOME_RANGE=None, AGE_RANGE="B", HH_SIZE="2", L="N", CHILDREN=None),
    ]
    return make_star(lines, households)


def test_month_end_and_undated_lines(star):
    """Six months before Aug 31 is Feb 29; undated spend is in the total only."""
    rows = {r["HSHD_NUM"]: r for r in rfm.rfm(star).collect()}
    ten = rows[10]
    assert (ten["recent_spend"], ten["older_spend"], ten["total_spend"]) == (15.5, 3.0, 118.5)
    assert (ten["frequency"], ten["total_units"], ten["last_purchase"]) == (4, 6, dt.date(2020, 8, 31))
    assert {r["snapshot_date"] for r in rows.values()} == {dt.date(2020, 8, 31)}
    assert None in rows and rows[12]["last_purchase"] is None


def test_features(star):
    rows = {r["HSHD_NUM"]: r for r in rfm.household_features(star).collect()}
    assert set(rows) == {10, 11, 12}
    ten, eleven, twelve = (rows[k] for k in (10, 11, 12))
    assert (ten["recency"], ten["avg_basket_value"], ten["spend_trend"]) == (0, 118.5 / 4, 12.5)
    assert eleven["recency"] == 243
    # Sorted as text: '10' < '9' < 'None'; 'B' < 'a' < 'b'; '1' < '2' < 'None'.
    assert [ten[c] for c in (*rfm.ENCODED, "CHILDREN")] == [1, 2, 0, 1, 1]
    assert [eleven[c] for c in (*rfm.ENCODED, "CHILDREN")] == [0, 1, 2, 0, 0]
    # No household row, no date: all gaps are 0.
    assert [twelve[c] for c in (*rfm.ENCODED, "CHILDREN", "recency", "total_units")] == [0] * 7


def test_codes_of_many_texts(spark):
    """Codes run through all partitions in text order."""
    texts = [f"{(i * 7919) % 100_000:05}" for i in range(5000)]
    households = spark.createDataFrame([(t, t[:1], None, "x") for t in texts], "INCOME_RANGE string, AGE_RANGE string, HH_SIZE string, L string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = rfm.category_codes(households.repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name, values in (("INCOME_RANGE", texts), ("AGE_RANGE", {t[:1] for t in texts}), ("HH_SIZE", ["None"]), ("L", ["x"])):
        found = sorted((r["code"], r["value"]) for r in rows if r["name"] == name)
        assert found == list(enumerate(sorted(set(values))))


def test_churn_figures(spark):
    features = spark.createDataFrame(
        [(i, 80 + i * 5, i % 3 + 1, float(i), 2.0, float(i * i)) for i in range(8)],
        "HSHD_NUM bigint, recency int, frequency bigint, avg_basket_value double, total_spend double, spend_trend double",
    )
    assert rfm.churn_rate(features).first()[0] == 5 / 8
    found = dict(tuples(rfm.churn_correlations(features)))
    pdf = features.toPandas()
    churned = (pdf["recency"] > 90).astype(int)
    assert found["Recency (days)"] == round(pdf["recency"].corr(churned), 3)
    assert found["Visit Frequency"] == round(pdf["frequency"].corr(churned), 3)
    assert found["Total Spend"] is None
    directions = {r["feature"]: r["direction"] for r in rfm.correlation_directions(rfm.churn_correlations(features)).collect()}
    assert directions["Recency (days)"] == "raises risk" and directions["Total Spend"] == "protective"

    everyone = features.withColumn("recency", features["recency"] + 100)
    assert all(r["correlation"] is None for r in rfm.churn_correlations(everyone).collect())


def test_empty_tables(make_star):
    star = make_star([])
    assert rfm.household_features(star).count() == 0
    assert tuples(dashboard.kpi_top_department(star)) == [("N/A",)]
    assert tuples(dashboard.kpi_top_commodity(star)) == [("N/A",)]
    assert tuples(dashboard.seasonal_ordered(dashboard.seasonal(star))) == [
        (1, "Spring", 0.0), (2, "Summer", 0.0), (3, "Fall", 0.0), (4, "Winter", 0.0),
    ]
    assert dashboard.income(star).count() == dashboard.commodity(star).count() == 0
    assert dashboard.dept_year_pivot(dashboard.dept_year(star)).count() == 0


def test_spend_without_any_basket_number(make_star):
    lines = [line(None, 1, 1, 5, WEEK_NUM=2)]
    assert tuples(dashboard.seasonal(make_star(lines))) == [("Spring", 5.0, None, 1)]


def test_missing_weeks_stay_in_the_weekly_list(make_star):
    lines = [line(1, 1, 1, 5, WEEK_NUM=None), line(1, 1, 1, 2, WEEK_NUM=3)]
    star = make_star(lines)
    assert tuples(dashboard.weekly(star)) == [(None, 2020, 5.0), (3, 2020, 2.0)]
    assert tuples(dashboard.seasonal(star)) == [("Spring", 2.0, 2.0, 1)]


def test_season_list_is_cut_by_name(make_star):
    """Six departments in four seasons: 20 of 24 rows, Winter keeps two."""
    lines = [line(i, 1, d, d + 1, WEEK_NUM=w) for i, (w, d) in enumerate((w, d) for w in (1, 20, 30, 50) for d in range(6))]
    products = [dict(PRODUCT_NUM=d, DEPARTMENT=f"D{d}") for d in range(6)]
    star = make_star(lines, products=products)
    rows = tuples(dashboard.seasonal_commodity(star))
    assert len(rows) == 20
    assert [r for r in rows if r[0] == "Winter"] == [("Winter", "D5", 6.0), ("Winter", "D4", 5.0)]
    table = {r["DEPARTMENT"]: r for r in dashboard.seasonal_dept_pivot(dashboard.seasonal_commodity(star)).collect()}
    assert (table["D0"]["Winter"], table["D0"]["Fall"], table["D5"]["Winter"]) == (0.0, 1.0, 6.0)


def test_grid_of_any_names(spark):
    cells = [("x", "NO. 1", 1.0), ("x", "Private", 2.0), ("y", "PRIVATE", 3.0), (None, "a`b", 4.0), ("z", None, 5.0)]
    df = spark.createDataFrame(cells, "INCOME_RANGE string, BRAND_TY string, total_spend double")
    got = {(r[0], r[1]): r[2] for r in dashboard.brand_income_pivot(df).collect()}
    assert len(got) == 4 * 4
    assert {k: v for k, v in got.items() if v} == {(a, b): v for a, b, v in cells if b}


def test_pivot_fills_by_place(spark):
    df = spark.createDataFrame([("x", "a.b", 1.0)], "r string, c string, total_spend double")
    assert tuples(dashboard.pivot_spend(df, "r", "c", ["a.b", "A.B"])) == [("x", 1.0, 0.0)]
