"""

Every query works on the clean tables made from the whole test tables. They are
written once per session and data folder, like a load, and read by all queries.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles
from larder.functions.expressions import churned, probability_band, risk_segment
from larder.functions.labels import CHURN_FEATURE_LABELS, PAIR_FEATURE_LABELS
from larder.operators import basket, dashboard, detail, export, models, rfm, trees
from larder.plans import refresh
from larder.plans.refresh import SUMMARIES, refresh_all
from larder.plans.warehouse import Warehouse
import fixtures as fixture
from larder.sources import ingest, readers
from larder.sources.star import Star
from larder.sources.store import Store, storage_root

try:
    import corpus_pipeline
    from larder.llm import queries as llm
except ImportError as missing:
    if missing.name not in ("corpus_pipeline", "larder.llm"):
        raise
    corpus_pipeline = llm = None

Query = Callable[[SparkSession, str], DataFrame]

_open: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The session's warehouse for one data folder, loaded on first use."""
    app = spark.sparkContext.applicationId
    if (app, sf_dir) not in _open:
        folder = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
        root = f"{storage_root(spark)}/larder/{app}-{uuid.uuid4().hex[:8]}/{folder}"
        opened = Warehouse(Store(spark, root))
        opened.load(fixture.typed_tables(spark, sf_dir))
        _open[app, sf_dir] = opened
    return _open[app, sf_dir]


def _portable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as ISO text, which compare alike anywhere."""
    as_type = {"date": "string"}
    return df.select(
        *[
            F.col(f"`{c}`").cast("double" if kind.startswith("decimal") else as_type.get(kind, kind)).alias(c)
            if kind in as_type or kind.startswith("decimal")
            else F.col(f"`{c}`")
            for c, kind in df.dtypes
        ]
    )


def _on(job: Callable[[Warehouse], DataFrame]) -> Query:
    return lambda spark, sf_dir: _portable(job(warehouse(spark, sf_dir)))


def _on_raw(job: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, sf_dir: _portable(job(fixture.raw_tables(spark, sf_dir)))


def _absence(w: Warehouse) -> DataFrame:
    """Days since the last purchase as a share of the most: a probability known without a model."""
    return w.features().select("HSHD_NUM", _absent_share(w).alias("churn_prob"))


def _absent_share(w: Warehouse) -> Column:
    longest = w.features().agg(F.nullif(F.max("recency"), F.lit(0))).scalar()
    return F.col("recency") / longest.cast("double")


def _by_rule(w: Warehouse) -> DataFrame:
    """The table of predictions with scores by rule in place of models."""
    scored = w.features().select("*", _absent_share(w).alias("churn_prob"))
    return scored.select(
        "HSHD_NUM", (F.col("total_spend") * 2).alias("clv_score"), "churn_prob",
        risk_segment("churn_prob").alias("risk_segment"), "recency", "frequency", "total_spend",
    )


def _report_by_rule(w: Warehouse) -> DataFrame:
    rows = w.features().select(churned("recency").alias("label"), (F.col("frequency") < 10).cast("double").alias("guess"))
    report = models.classification_report(rows, "label", "guess")
    return report.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def _quality_by_rule(w: Warehouse) -> DataFrame:
    quality = models.regression_quality(w.features().withColumn("guess", F.col("avg_basket_value") * 3), "total_spend", "guess")
    return quality.select(F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"))


def _summary(w: Warehouse, name: str) -> DataFrame:
    return w.table(name, lambda: SUMMARIES[name](w.star))


def _pairs_100(w: Warehouse) -> DataFrame:
    return w.table("pairs_100", lambda: w.pairs(100))


def _ranked_pairs(w: Warehouse) -> DataFrame:
    order = F.desc("times_bought_together"), F.col("item_1"), F.col("item_2")
    return dashboard.ranked(basket.best_pairs(_pairs_100(w), 10), *order)


def _large(w: Warehouse) -> Star:
    """The same tables, with dimensions treated as too large to broadcast."""
    return Star.of_entries(w.store, w.entries(), broadcast_bytes=0)


LARGE = {
    **{n: SUMMARIES[n] for n in ("income", "children", "dept_year", "brand", "organic", "brand_income", "dept", "commodity")},
    "commodity_stats": basket.commodity_stats,
    "household_features": rfm.household_features,
    "data_pull_all_by_department": lambda s: detail.household_detail(s, None, "DEPARTMENT", page=2),
}


def _basket_large(w: Warehouse) -> DataFrame:
    """Products too large to broadcast, and few enough seeds that most items are pruned."""
    storage_root(w.store.spark)
    items = basket.basket_commodities(_large(w)).checkpoint()
    return basket.count_pairs(items, 10, seeds=8)


def _any_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = warehouse(spark, sf_dir).star
    odd = replace(star, products=fixture.odd_products(spark, sf_dir))
    return _portable(dashboard.brand_income_pivot(dashboard.brand_income(odd)))


def _dirty_load(spark: SparkSession, sf_dir: str) -> tuple[Warehouse, DataFrame, DataFrame]:
    """A warehouse loaded from tables with unreadable values, with permission; summary and rejects."""
    opened = Warehouse(Store(spark, f"{storage_root(spark)}/larder/dirty/{uuid.uuid4().hex}"))
    return opened, *refresh.load(opened, fixture.dirty_tables(spark, sf_dir), permit_rejects=True)


def _refresh_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which derived tables are current: once made, and after the tables are loaded anew."""
    opened = Warehouse(Store(spark, f"{storage_root(spark)}/larder/status/{uuid.uuid4().hex}"))
    tables = fixture.typed_tables(spark, sf_dir)
    opened.load(tables)
    opened.table("product_weeks", lambda: dashboard.product_weeks(opened.star))
    names = ["product_weeks", "features"]
    first = opened.status(names).withColumn("loads", F.lit(1))
    opened.load(tables)
    return first.unionByName(opened.status(names).withColumn("loads", F.lit(2)))


def _refresh_written(w: Warehouse) -> DataFrame:
    """Rows and total of each summary as a refresh wrote it."""
    refresh_all(w)
    totals = [
        w.store.read(name).agg(
            F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.round(F.sum(measure).cast("double"), 2).alias("total")
        )
        for name, measure in MEASURES.items()
    ]
    return reduce(DataFrame.unionByName, totals)


MEASURES = {
    "income": "hh_count", "hhsize": "avg_spend", "children": "hh_count", "region": "total_spend", "weekly": "spend",
    "dept_year": "total_spend", "seasonal": "total_spend", "seasonal_commodity": "total_spend", "brand": "total_spend",
    "organic": "total_spend", "brand_income": "total_spend", "dept": "total_spend", "commodity": "total_spend",
    "basket": "times_bought_together",
}


def _class_weights(w: Warehouse) -> DataFrame:
    rows = w.features().select(churned("recency").alias("label"))
    return models.balanced_weights(rows).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight")
    )


def _next_page(w: Warehouse) -> DataFrame:
    """The page behind the third one, found from its last row."""
    third = detail.household_detail(w.star, None, "SPEND", True, page=3)
    last = third.tail(1)
    return detail.household_detail_after(w.star, last[0].asDict(), None, "SPEND", True) if last else third


def _csv_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchases written as CSV with padded headers and read back as text."""
    raw = fixture.raw_tables(spark, sf_dir)["transactions"]
    path = f"{storage_root(spark)}/larder/csv/{uuid.uuid4().hex}"
    padded = raw.toDF(*[f"{c} " for c in raw.columns])
    padded.write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return ingest.bronze(readers.read_csv(spark, path)).drop(readers.MALFORMED)


_uploads: dict[tuple[str, str], Warehouse] = {}


def _upload(spark: SparkSession, sf_dir: str) -> tuple[Warehouse, DataFrame]:
    """Replace one warehouse's tables by the raw ones; each call replaces them again."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _uploads:
        root = f"{storage_root(spark)}/larder/upload/{uuid.uuid4().hex}"
        _uploads[at] = Warehouse(Store(spark, root))
    raw = fixture.raw_tables(spark, sf_dir)
    tables = {t: ingest.clean(t, ingest.bronze(raw[t])) for t in ingest.LOAD_ORDER}
    return _uploads[at], _uploads[at].load(tables)


def _ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upload(spark, sf_dir)[1]


def _ingest_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _portable(_upload(spark, sf_dir)[0].star.transactions)


def _households_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households given twice, once as cleaned text, reduced to one row each."""
    uploaded = ingest.clean(
        "households", ingest.bronze(fixture.raw_tables(spark, sf_dir)["households"])
    )
    twice = uploaded.unionByName(fixture.typed_tables(spark, sf_dir)["households"])
    return ingest.keep_first(twice, "HSHD_NUM")


def _pair_job(job: Callable[[Warehouse, models.PipelineModel], DataFrame], schema: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = warehouse(spark, sf_dir)
        model = w.pair_model()
        return spark.createDataFrame([], schema) if model is None else job(w, model)

    return run


def _agrees(walked: DataFrame, scored: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Per key whether the walk through the node table gives the model's score."""
    said = scored.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col(score).alias("said"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    close = F.abs(F.col("score") - F.col("said")) <= 1e-9 * F.greatest(F.abs("said"), F.lit(1.0))
    return walked.join(said, same, "full").select(*keys, F.coalesce(close, F.lit(False)).alias("agrees"))


def _clv_walk(w: Warehouse) -> DataFrame:
    scored = w.predictions()
    return _agrees(trees.walked(w.features(), ["HSHD_NUM"], models.CLV_FEATURES, w.nodes("clv")), scored, ["HSHD_NUM"], "clv_score")


def _churn_walk(w: Warehouse) -> DataFrame:
    scored = w.predictions()
    return _agrees(trees.walked(w.features(), ["HSHD_NUM"], models.CHURN_FEATURES, w.nodes("churn")), scored, ["HSHD_NUM"], "churn_prob")


def _pair_walk(w: Warehouse, model: models.PipelineModel) -> DataFrame:
    keys, pairs = ["item_1", "item_2"], w.pair_features()
    return _agrees(trees.walked(pairs, keys, models.PAIR_FEATURES, w.nodes("pairs")), model.transform(pairs), keys, "prediction")


def _churn_importances_walk(w: Warehouse) -> DataFrame:
    """Per input whether the node table gives the importance that the model gives."""
    model = w.churn_model()
    said = w.store.spark.createDataFrame(
        list(zip(models.CHURN_FEATURES, map(float, model.stages[-1].featureImportances.toArray()))), "of string, said double"
    )
    got = trees.importances_of(w.nodes("churn"), models.CHURN_FEATURES, per_tree=True)
    close = F.abs(F.col("importance") - F.col("said")) <= 1e-9
    return got.join(said, F.col("input") == F.col("of"), "full").select(F.col("input").alias("feature"), F.coalesce(close, F.lit(False)).alias("agrees"))


def entry(spark: SparkSession) -> DataFrame:
    """Spend and households per department on the smallest test data."""
    return queries()["dept"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    found = {name: _on(lambda w, job=job: job(w.star)) for name, job in SUMMARIES.items()}
    found |= {f"{name}_large": _on(lambda w, job=job: job(_large(w))) for name, job in LARGE.items()}
    found |= {
        # headline figures, display forms, pivots
        "kpi_top_department": _on(lambda w: dashboard.top_name(_summary(w, "dept"), "DEPARTMENT")),
        "kpi_top_commodity": _on(lambda w: dashboard.top_name(_summary(w, "commodity"), "COMMODITY")),
        "weekly_labels": _on(lambda w: dashboard.weekly_labels(_summary(w, "weekly"))),
        "organic_labelled": _on(lambda w: dashboard.organic_labelled(_summary(w, "organic"))),
        "seasonal_ordered": _on(lambda w: dashboard.seasonal_ordered(_summary(w, "seasonal"))),
        "dept_year_pivot": _on(lambda w: dashboard.dept_year_pivot(_summary(w, "dept_year"))),
        "seasonal_dept_pivot": _on(lambda w: dashboard.seasonal_dept_pivot(_summary(w, "seasonal_commodity"))),
        "brand_income_pivot": _on(lambda w: dashboard.brand_income_pivot(_summary(w, "brand_income"))),
        "brand_any_name_pivot": _any_brand,
        "brand_json": _on(lambda w: export.as_json(_summary(w, "brand").select("BRAND_TY", "transaction_count"))),
        "weekly_in_order": _on(lambda w: dashboard.in_order(dashboard.weekly(w.star))),
        "income_in_order": _on(lambda w: dashboard.in_order(dashboard.income(w.star))),
        "dept_in_order": _on(lambda w: dashboard.in_order(dashboard.dept(w.star))),
        "dept_year_in_order": _on(lambda w: dashboard.in_order(dashboard.dept_year(w.star))),
        # household detail
        "data_pull_page": _on(lambda w: detail.household_detail(w.star, "0010")),
        "data_pull_all_page": _on(lambda w: detail.household_detail(w.star, None, "SPEND", True, 3)),
        "data_pull_deep_page": _on(
            lambda w: detail.household_detail(w.star, None, "SPEND", True, 3, sort_rows=2000, near=0)
        ),
        "data_pull_all_by_department": _on(
            lambda w: detail.household_detail(w.star, None, "DEPARTMENT", page=2)
        ),
        "data_pull_next_page": _on(_next_page),
        "data_pull_count": _on(lambda w: detail.detail_count(w.star, 10)),
        "data_pull_pages": _on(lambda w: detail.detail_pages(w.star, None)),
        # baskets
        "basket": _on(lambda w: w.pairs(10)),
        "basket_pairs_100": _on(lambda w: w.pairs(100)),
        "basket_pairs_20": _on(lambda w: basket.best_pairs(_pairs_100(w), 20)),
        "basket_large": _on(_basket_large),
        "basket_all_pairs": _on(lambda w: w.pairs(None)),
        "basket_ranked": _on(_ranked_pairs),
        "basket_bottom_up": _on(lambda w: dashboard.bottom_up(_ranked_pairs(w))),
        "basket_labels": _on(lambda w: basket.pair_labels(basket.best_pairs(_pairs_100(w), 10))),
        "pair_axis_max": _on(lambda w: basket.pair_axis_max(_pairs_100(w))),
        "commodity_stats": _on(lambda w: basket.commodity_stats(w.star)),
        "basket_pair_features": _on(lambda w: basket.top_pair_features(w.star, _pairs_100(w))),
        "cross_sell_priority": _on(lambda w: basket.with_priority(basket.best_pairs(_pairs_100(w), 20))),
        "cross_sell_priority_low_cuts": _on(
            lambda w: basket.with_priority(basket.best_pairs(_pairs_100(w), 20), high=60, medium=50)
        ),
        # households
        "snapshot_date": _on(lambda w: rfm.snapshot_date(w.star)),
        "rfm": _on(lambda w: rfm.rfm(w.star)),
        "household_codes": _on(lambda w: rfm.encoded_households(w.star.households)),
        "household_features": _on(lambda w: rfm.household_features(w.star)),
        "churn_rate": _on(
            lambda w: rfm.churn_rate(w.features()).select(F.round("churn_rate", 6).alias("churn_rate"))
        ),
        "churn_correlations": _on(lambda w: rfm.churn_correlations(w.features())),
        "churn_correlation_directions": _on(
            lambda w: rfm.correlation_directions(rfm.churn_correlations(w.features()))
        ),
        "churn_class_weights": _on(_class_weights),
        "risk_segment_bins": _on(
            lambda w: _absence(w).withColumn("risk_segment", risk_segment("churn_prob"))
        ),
        "risk_segment_strategies": _on(
            lambda w: models.with_strategy(
                _absence(w).select("HSHD_NUM", risk_segment("churn_prob").alias("risk_segment"))
            )
        ),
        "probability_bands": _on(
            lambda w: _absence(w).select(
                "*",
                probability_band("churn_prob").alias("band"),
                models.percent_text("churn_prob").alias("percent"),
            )
        ),
        # what follows the models, on scores by rule
        "churn_counts_by_rule": _on(lambda w: models.churn_counts(_by_rule(w))),
        "churn_stats_by_rule": _on(lambda w: models.churn_stats(_by_rule(w))),
        "top_clv_by_rule": _on(lambda w: dashboard.in_order(models.top_clv(_by_rule(w)))),
        "churn_order_by_rule": _on(lambda w: dashboard.in_order(models.by_churn(_by_rule(w)).select("HSHD_NUM"))),
        "prediction_display_by_rule": _on(lambda w: models.prediction_display(_by_rule(w))),
        "churn_report_by_rule": _on(_report_by_rule),
        "regression_quality_by_rule": _on(_quality_by_rule),
        # models
        "churn_predictions": _on(lambda w: models.by_churn(w.predictions())),
        "churn_prediction_inputs": _on(
            lambda w: w.predictions().select("HSHD_NUM", "recency", "frequency", "total_spend")
        ),
        "prediction_display": _on(lambda w: models.prediction_display(w.predictions())),
        "top_clv": _on(lambda w: models.top_clv(w.predictions())),
        "churn_counts": _on(lambda w: models.churn_counts(w.predictions())),
        "churn_stats": _on(lambda w: models.churn_stats(w.predictions())),
        "churn_importances": _on(
            lambda w: models.importances(w.store.spark, w.churn_model(), CHURN_FEATURE_LABELS)
        ),
        "churn_report": _on(lambda w: models.churn_report(w.features(), w.churn_model())),
        "clv_model_summary": _on(lambda w: models.clv_summary(w.features(), w.clv_model())),
        "basket_model": _pair_job(
            lambda w, m: models.pair_predictions(w.pair_features(), m),
            "item_1 string, item_2 string, times_bought_together bigint, predicted double",
        ),
        "basket_importances": _pair_job(
            lambda w, m: models.importances(w.store.spark, m, PAIR_FEATURE_LABELS),
            "feature string, importance double",
        ),
        "basket_model_summary": _pair_job(
            lambda w, m: models.pair_summary(w.pair_features(), m),
            "n_pairs bigint, r2 double, mae double",
        ),
        "clv_walk": _on(_clv_walk),
        "churn_walk": _on(_churn_walk),
        "pair_walk": _pair_job(_pair_walk, "item_1 string, item_2 string, agrees boolean"),
        "churn_importances_walk": _on(_churn_importances_walk),
        "churn_sample": _on(lambda w: models.sample_rows(w.features(), 500).select("HSHD_NUM")),
        "refresh_all": _on(refresh_all),
        "refresh_written": _on(_refresh_written),
        "refresh_status": _refresh_status,
        # ingest
        "ingest_bronze": _csv_bronze,
        "ingest_clean": _on_raw(
            lambda raw: ingest.clean("transactions", ingest.bronze(raw["transactions"]))
        ),
        "ingest_clean_households": _on_raw(
            lambda raw: ingest.clean("households", ingest.bronze(raw["households"]))
        ),
        "ingest_clean_products": _on_raw(
            lambda raw: ingest.clean("products", ingest.bronze(raw["products"]))
        ),
        "ingest_unreadable": _on_raw(
            lambda raw: ingest.unreadable_counts("transactions", ingest.bronze(raw["transactions"]))
        ),
        "ingest_rejects": lambda spark, sf_dir: _dirty_load(spark, sf_dir)[2],
        "ingest_dirty": lambda spark, sf_dir: _portable(_dirty_load(spark, sf_dir)[0].star.transactions),
        "ingest_households_first": _households_first,
        "ingest_summary": _ingest_summary,
        "ingest_replace": _ingest_replace,
    }
    if llm:
        found |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | (llm.oracle_sql() if llm else {})
