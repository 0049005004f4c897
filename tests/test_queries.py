"""Every registered query against its checking SQL on the smallest test data."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, duck
from tests.conftest import SF, tuples

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert check(spark, con, SF, name, QUERIES[name], SQL[name]) == ""


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["DEPARTMENT", "total_spend", "unique_households"]


def test_predictions_agree_with_each_other(spark):
    rows = QUERIES["churn_predictions"](spark, SF).collect()
    features = QUERIES["household_features"](spark, SF).count()
    assert len(rows) == features
    for r in rows:
        assert 0 <= r["churn_prob"] <= 1
        cut = "Low Risk" if r["churn_prob"] <= 0.3 else "Medium Risk" if r["churn_prob"] <= 0.6 else "High Risk"
        assert r["risk_segment"] == cut
    assert [r["churn_prob"] for r in rows] == sorted((r["churn_prob"] for r in rows), reverse=True)

    counts = dict(tuples(QUERIES["churn_counts"](spark, SF)))
    stats = QUERIES["churn_stats"](spark, SF).first()
    assert list(counts) == ["Low Risk", "Medium Risk", "High Risk"]
    assert (stats["low_risk"], stats["medium_risk"], stats["high_risk"]) == tuple(counts.values())
    assert stats["total"] == len(rows) == sum(counts.values())

    top = QUERIES["top_clv"](spark, SF).collect()
    best = sorted(rows, key=lambda r: (-r["clv_score"], r["HSHD_NUM"]))[:10]
    assert [r["HSHD_NUM"] for r in top] == [r["HSHD_NUM"] for r in best]


@pytest.mark.parametrize("name,size", [("churn_importances", 7), ("basket_importances", 6)])
def test_importances_sum_to_one(spark, name, size):
    shares = [r["importance"] for r in QUERIES[name](spark, SF).collect()]
    assert len(shares) == size
    assert sum(shares) == pytest.approx(1, abs=1e-3)
    assert shares == sorted(shares, reverse=True)


def test_pair_model_lists_the_first_twenty(spark):
    shown = QUERIES["basket_model"](spark, SF).collect()
    pairs = QUERIES["basket_pairs_100"](spark, SF).collect()
    order = sorted(pairs, key=lambda r: (-r["times_bought_together"], r["item_1"], r["item_2"]))
    assert [tuple(r)[:3] for r in shown] == [tuple(r) for r in order[:20]]
    assert QUERIES["basket_model_summary"](spark, SF).first()["n_pairs"] == len(pairs)


def test_spend_is_conserved(spark):
    q = {n: QUERIES[n](spark, SF) for n in ("dept", "seasonal", "region", "weekly")}
    totals = [sum(r["total_spend" if n != "weekly" else "spend"] for r in df.collect()) for n, df in q.items()]
    assert totals == pytest.approx([totals[0]] * 4)
