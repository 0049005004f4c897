"""Write all results the dashboard and the model pages show."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.labels import CHURN_FEATURE_LABELS, PAIR_FEATURE_LABELS
from larder.operators import dashboard, models, rfm
from larder.plans.warehouse import Warehouse
from larder.sources import ingest
from larder.sources.store import utc_now

# Fixed value: results younger than this are reused.
MAX_AGE_SECONDS = 1800

# The names of the summaries.
SUMMARIES = {
    "income": dashboard.income,
    "hhsize": dashboard.hhsize,
    "children": dashboard.children,
    "region": dashboard.region,
    "weekly": dashboard.weekly,
    "dept_year": dashboard.dept_year,
    "seasonal": dashboard.seasonal,
    "seasonal_commodity": dashboard.seasonal_commodity,
    "brand": dashboard.brand,
    "organic": dashboard.organic,
    "brand_income": dashboard.brand_income,
    "dept": dashboard.dept,
    "commodity": dashboard.commodity,
}

# The results of the dashboard and the two model pages.
SCORED = ("top_clv", "churn_counts", "avg_clv", "high_risk_count")
DASHBOARD = (*SUMMARIES, "basket", *SCORED)
CHURN_PAGE = ("churn_stats", "churn_importances", "churn_correlations", "churn_rate", "churn_report")
PAIR_PAGE = ("basket_model", "basket_importances", "basket_model_summary")
RESULTS = (*DASHBOARD, *CHURN_PAGE, *PAIR_PAGE)


def train(warehouse: Warehouse) -> None:
    """Fit what is not current. The fits are many short jobs each, so they overlap."""
    warehouse.features()
    warehouse.pair_features()
    with ThreadPoolExecutor(3) as pool:
        fits = [
            pool.submit(fit)
            for fit in (warehouse.clv_model, warehouse.churn_model, warehouse.pair_model)
        ]
        for fit in fits:
            fit.result()


def summary_results(warehouse: Warehouse) -> dict[str, DataFrame]:
    """What needs no model. Spend per product, week and year is added up once for five of them.

    A dimension too large to broadcast is joined once for all summaries that need it.
    """
    star = warehouse.star
    shared = warehouse.table("product_weeks", lambda: dashboard.product_weeks(star))
    given = {name: shared for name in dashboard.FROM_PRODUCT_WEEKS}
    if not all(star.products_can(star.products.select("PRODUCT_NUM", c)) for c in dashboard.PRODUCT_NAMES):
        named = warehouse.table("name_weeks", lambda: dashboard.name_weeks(star, shared))
        given |= {name: named for name in dashboard.FROM_PRODUCT_WEEKS if name != "weekly"}
        lines = warehouse.table("named_lines", lambda: dashboard.named_lines(star))
        given |= {name: lines for name in dashboard.FROM_NAMED_LINES}
    if not all(star.households_can(star.households.select("HSHD_NUM", c)) for c in dashboard.HOUSEHOLD_NAMES):
        baskets = warehouse.table("known_baskets", lambda: dashboard.known_baskets(star))
        given |= {name: baskets for name in dashboard.FROM_BASKETS}
    results = {name: summary(star, given[name]) if name in given else summary(star) for name, summary in SUMMARIES.items()}
    return results | {"basket": warehouse.pairs(10)}


def score_results(warehouse: Warehouse) -> dict[str, DataFrame]:
    scored = warehouse.predictions()
    stats = models.churn_stats(scored)
    return {
        "top_clv": models.top_clv(scored),
        "churn_counts": models.churn_counts(scored),
        "avg_clv": stats.select("avg_clv"),
        "high_risk_count": stats.select(F.col("high_risk").alias("high_risk_count")),
    }


def churn_results(warehouse: Warehouse) -> dict[str, DataFrame]:
    spark = warehouse.store.spark
    features = warehouse.features()
    churn = warehouse.churn_model()
    return {
        "churn_stats": models.churn_stats(warehouse.predictions()),
        "churn_importances": models.importances(spark, churn, CHURN_FEATURE_LABELS),
        "churn_correlations": rfm.churn_correlations(features),
        "churn_rate": rfm.churn_rate(features),
        "churn_report": models.churn_report(features, churn),
    }


def pair_results(warehouse: Warehouse) -> dict[str, DataFrame]:
    """Empty when there are too few pairs for a model."""
    model = warehouse.pair_model()
    if model is None:
        return {}
    pairs = warehouse.pair_features()
    return {
        "basket_model": models.pair_predictions(pairs, model),
        "basket_importances": models.importances(
            warehouse.store.spark, model, PAIR_FEATURE_LABELS
        ),
        "basket_model_summary": models.pair_summary(pairs, model),
    }


def _possible(warehouse: Warehouse) -> list[str]:
    """The results that the loaded tables allow; models need households and pairs."""
    found = [*SUMMARIES, "basket"]
    if warehouse.can_train():
        found += [*SCORED, *CHURN_PAGE]
    if models.enough_pairs(warehouse.pair_features()):
        found += PAIR_PAGE
    return found


def is_fresh(warehouse: Warehouse, now: dt.datetime | None = None) -> bool:
    """All results that can be there are, follow from the last load and are young enough."""
    warehouse.reload()
    oldest = (now or utc_now()) - dt.timedelta(seconds=MAX_AGE_SECONDS)
    if not all(warehouse.is_current(name, not_before=oldest) for name in (*SUMMARIES, "basket")):
        return False
    return all(warehouse.is_current(name, not_before=oldest) for name in _possible(warehouse))


def refresh_all(warehouse: Warehouse, now: dt.datetime | None = None) -> DataFrame:
    """Bring every result up to date; (table, rows) of all results, rows NULL for absent ones.

    Fresh results are kept. A summary that fails fails the refresh: the results of the last
    complete one stay current. Where there is too little to train on, the summaries are
    written all the same and the model results are absent.
    """
    if not is_fresh(warehouse, now):
        train(warehouse)
        results = summary_results(warehouse)
        if warehouse.can_train():
            results |= score_results(warehouse) | churn_results(warehouse)
        warehouse.write(results | pair_results(warehouse))
    entries = warehouse.entries()
    shown = [(n, entries[n].rows if warehouse.is_current(n) else None) for n in RESULTS]
    return warehouse.store.spark.createDataFrame(shown, "table string, rows bigint")


def load(
    warehouse: Warehouse,
    raw: dict[str, DataFrame | None],
    permit_rejects: bool = False,
    keep_first: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Replace the tables from raw frames; summary of (table, rows) and the rejects.

    Texts and records that cannot be read refuse the load, unless permitted; then the values
    are NULL and the rejects say how many. Repeated dimension numbers refuse it as well,
    unless the first of them is to be kept.
    """
    cleaning = ingest.Cleaning(raw)
    if keep_first:
        cleaning.keep_first()
    summary = warehouse.load(cleaning.tables, (lambda: None) if permit_rejects else cleaning.refuse_rejects)
    return summary, ingest.rejects_frame(warehouse.store.spark, cleaning.rejects())


def load_and_refresh(
    warehouse: Warehouse,
    raw: dict[str, DataFrame | None],
    permit_rejects: bool = False,
    keep_first: bool = False,
) -> DataFrame:
    """Replace the tables from raw frames, then retrain and recompute everything."""
    summary, rejected = load(warehouse, raw, permit_rejects, keep_first)
    refresh_all(warehouse)
    return summary.join(
        rejected.groupBy("table").agg(F.sum("rows").alias("rejected")), "table", "left"
    ).fillna(0, ["rejected"])
