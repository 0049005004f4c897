"""The checking SQL over random tables full of gaps, unknown keys and odd texts."""

import datetime as dt
import random

import duckdb
import pytest

import __spark_entry__ as entry
import oracles
from larder.operators import basket, dashboard, detail, rfm
from larder.plans.refresh import SUMMARIES
from larder.sources.star import Star
from tests.compare import differences
from tests.conftest import frame, line

TEXTS = ["null", "NULL ", "", "  ", None, "a", "A", "b ", "10", "9", "é", "Z"]


def tables(seed):
    rng = random.Random(seed)

    def maybe(value, gap=0.1):
        return None if rng.random() < gap else value

    lines = [
        line(
            maybe(rng.randint(1, 60), 0.03),
            maybe(rng.choice([1, rng.randint(1, 30)])),
            maybe(rng.choice([2, rng.randint(1, 40)])),
            maybe(rng.randint(-500, 99_999_99) / 100, 0.05),
            UNITS=maybe(rng.randint(-2, 9)),
            STORE_R=rng.choice(TEXTS),
            PURCHASE_DATE=maybe(dt.date(2020, 1, 31) + dt.timedelta(days=rng.randint(0, 400))),
            WEEK_NUM=maybe(rng.randint(0, 54)),
            YEAR=maybe(rng.choice([2019, 2020])),
        )
        for _ in range(600)
    ]
    households = [
        dict(
            HSHD_NUM=maybe(k, 0.05),
            L=rng.choice(TEXTS),
            AGE_RANGE=rng.choice(TEXTS),
            INCOME_RANGE=rng.choice(TEXTS),
            HH_SIZE=rng.choice(TEXTS),
            CHILDREN=rng.choice([*TEXTS, "Y", " Y", "0", "2", "-1", "1.5"]),
        )
        for k in range(1, 25)
    ]
    products = [
        dict(
            PRODUCT_NUM=maybe(k, 0.05),
            DEPARTMENT=rng.choice(["F", "G", None, "null"]),
            COMMODITY=rng.choice([*TEXTS, "x1", "x2", "x3"]),
            BRAND_TY=rng.choice(TEXTS),
            NATURAL_ORGANIC_FLAG=rng.choice(["Y", "N", None, "null", "NULL "]),
        )
        for k in range(1, 35)
    ]
    return {"transactions": lines, "households": households, "products": products}


@pytest.fixture(scope="module", params=[(1, True), (2, False)])
def both(spark, request, tmp_path_factory):
    """The star, broadcast or not, and a DuckDB connection to the same rows."""
    seed, fits = request.param
    con, frames = duckdb.connect(), {}
    for name, rows in tables(seed).items():
        path = str(tmp_path_factory.mktemp("random") / name)
        frame(spark, name, rows).write.parquet(path)
        frames[name] = spark.read.parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return Star.of(**frames, broadcast_bytes=1 << 20 if fits else 0), con


def same(df, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    shown = entry._portable(df)
    return differences([tuple(r) for r in shown.collect()], shown.columns, found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(oracles.SUMMARIES))
def test_summaries(both, name):
    star, con = both
    assert same(SUMMARIES[name](star), con, oracles.SUMMARIES[name]) == ""


@pytest.mark.parametrize(
    "name,job",
    [
        ("commodity_stats", basket.commodity_stats),
        ("basket_all_pairs", lambda s: basket.copurchase_pairs(s, None)),
        ("basket_pairs_100", lambda s: basket.copurchase_pairs(s, 100)),
        ("basket_pair_features", basket.basket_pair_features),
    ],
)
def test_baskets(both, name, job):
    star, con = both
    assert same(job(star), con, f"WITH {oracles.BASKET_CTES}\n{oracles.BASKETS[name]}") == ""


def test_rfm(both):
    star, con = both
    sql = f"WITH {oracles.RFM_CTES}\n{oracles.HOUSEHOLD_QUERIES['rfm']}"
    assert same(rfm.rfm(star), con, sql) == ""


def test_codes(both):
    star, con = both
    sql = f"WITH {oracles.RFM_CTES}\n{oracles.HOUSEHOLD_QUERIES['household_codes']} WHERE HSHD_NUM IS NOT NULL"
    assert same(rfm.encoded_households(star.households), con, sql) == ""


@pytest.mark.parametrize("first", ["t.SPEND DESC NULLS LAST", "t.HSHD_NUM NULLS FIRST", "p.COMMODITY NULLS FIRST"])
def test_pages(both, first):
    star, con = both
    column = first.split()[0].split(".")[1]
    page = detail.household_detail(star, None, column, "DESC" in first, 4, sort_rows=120)
    assert same(page, con, oracles._page(first, 300)) == ""


def test_headlines(both):
    star, con = both
    for job, name in (
        (dashboard.kpi_top_department, "kpi_top_department"),
        (lambda s: dashboard.seasonal_ordered(dashboard.seasonal(s)), "seasonal_ordered"),
        (lambda s: dashboard.seasonal_dept_pivot(dashboard.seasonal_commodity(s)), "seasonal_dept_pivot"),
    ):
        assert same(job(star), con, oracles.DISPLAYS[name]) == ""
