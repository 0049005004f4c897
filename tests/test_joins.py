"""Large-dimension paths give the results of the broadcast paths, hot keys or not."""

import pytest
from larder.operators import basket, dashboard, detail, rfm
from larder.operators.joins import join_dimension
from larder.plans.refresh import SUMMARIES, summary_results
from larder.plans.warehouse import Warehouse
from tests.conftest import frame, line, tuples


@pytest.mark.parametrize("how", ["inner", "left"])
def test_large_dimension(spark, how):
    rows = [(7, i) for i in range(1000)] + [(k, k) for k in range(2000)] + [(None, -1)] * 500 + [(9999, 0)]
    fact = spark.createDataFrame(rows, "k int, v int").repartition(8)
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(1500)], "k int, name string")
    expected = tuples(fact.join(dim, "k", how))
    assert sorted(tuples(join_dimension(fact, dim, "k", False, how)), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", ["income", "dept", "organic", "commodity_stats"])
def test_large_dimensions_read_the_purchases_once(spark, store, skewed, capsys, name):
    tables = {t: frame(spark, t, rows) for t, rows in zip(("transactions", "households", "products"), skewed)}
    warehouse = Warehouse(store, broadcast_bytes=0)
    warehouse.load(tables)
    JOBS[name](warehouse.star).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("/data/transactions/") == 1


@pytest.fixture(scope="module")
def skewed():
    """A third of the lines in one household, a third of one product, a third in one basket."""
    lines = []
    for i in range(900):
        lines.append(
            line(
                i // 4 if i % 3 else 1,
                5 if i % 3 == 1 else i % 40 or None,
                3 if i % 3 == 2 else i % 70 or None,
                (i * 37 % 1000) / 10,
                WEEK_NUM=i % 53 + 1 if i % 17 else None,
                YEAR=2019 + i % 2,
                STORE_R=["EAST", "WEST", "null"][i % 3],
                UNITS=i % 5,
            )
        )
    households = [
        dict(
            HSHD_NUM=k,
            INCOME_RANGE=["35K", "50K", "null", None][k % 4],
            HH_SIZE=str(k % 5),
            AGE_RANGE="a",
            L="Y" if k % 2 else None,
            CHILDREN=["1", "0", None, "Y"][k % 4],
        )
        for k in range(1, 36)
    ]
    products = [
        dict(
            PRODUCT_NUM=k,
            DEPARTMENT=f"D{k % 4}",
            COMMODITY=f"C{k % 11}" if k % 13 else "null",
            BRAND_TY="PRIVATE" if k % 3 else None,
            NATURAL_ORGANIC_FLAG="Y" if k % 2 else "N",
        )
        for k in range(1, 66)
    ]
    return lines, households, products


@pytest.fixture
def both(make_star, skewed):
    small, large = make_star(*skewed), make_star(*skewed, broadcast_bytes=0)
    assert small.products_fit and small.households_fit
    assert not large.products_fit and not large.households_fit
    return small, large


JOBS = SUMMARIES | {
    "commodity_stats": basket.commodity_stats,
    "pairs": lambda s: basket.copurchase_pairs(s, 50, baskets=100),
    "pair_features": lambda s: basket.basket_pair_features(s, None, baskets=100),
    "features": rfm.household_features,
    "detail": lambda s: detail.household_detail(s, None, "COMMODITY", True, page=2),
    "detail_household": lambda s: detail.household_detail(s, 5, "SPEND"),
    "top_department": dashboard.kpi_top_department,
}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_large_dimensions_change_nothing(both, name):
    small, large = (sorted(tuples(JOBS[name](s)), key=repr) for s in both)
    assert small and small == large


def test_a_dimension_is_measured_by_the_columns_taken(make_star, skewed, capsys):
    """Products of 65 rows with five columns do not fit 4,000 bytes; a number and one name do."""
    star = make_star(*skewed, broadcast_bytes=4000)
    assert not star.products_fit
    for name in ("organic", "dept", "commodity_stats"):
        JOBS[name](star).explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(tuples(JOBS[name](star))) == sorted(tuples(JOBS[name](make_star(*skewed))))


def test_a_refresh_joins_large_dimensions_once(spark, store, make_star, skewed, capsys):
    tables = {t: frame(spark, t, rows) for t, rows in zip(("transactions", "households", "products"), skewed)}
    warehouse = Warehouse(store, broadcast_bytes=0)
    warehouse.load(tables)
    small = make_star(*skewed)
    results = summary_results(warehouse)
    for name, job in SUMMARIES.items():
        assert sorted(tuples(results[name]), key=repr) == sorted(tuples(job(small)), key=repr)
        if name != "brand_income":
            results[name].explain("formatted")
            plan = capsys.readouterr().out
            assert "/data/products/" not in plan and "/data/households/" not in plan
