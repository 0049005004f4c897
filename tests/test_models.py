import hashlib
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from larder.functions.labels import CHURN_FEATURE_LABELS, RETENTION_STRATEGIES
from larder.operators import models
from larder.sources.store import Store
from tests.conftest import tuples

SCORES = "HSHD_NUM bigint, clv_score double, churn_prob double, risk_segment string, recency int, frequency bigint, total_spend double"


def saved(model, tmp_path):
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


@pytest.fixture
def features(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        visits = rng.randint(1, 30)
        value = rng.uniform(5, 50)
        gone = visits < 12
        rows.append(
            (k, 100 + visits if gone else 20, visits, value, visits * value, visits * 2, value - 20, k % 3, k % 4, k % 5, k % 2, k % 2)
        )
    return spark.createDataFrame(
        rows,
        "HSHD_NUM bigint, recency int, frequency bigint, avg_basket_value double, total_spend double, "
        "total_units bigint, spend_trend double, INCOME_RANGE int, AGE_RANGE int, HH_SIZE int, L int, CHILDREN int",
    ).coalesce(1)


def test_split_is_four_to_one(spark):
    n = spark.range(10_000).filter(models.is_training("id")).count()
    assert 7800 < n < 8200


def test_sample(spark):
    df = spark.range(10_000).withColumnRenamed("id", "HSHD_NUM")
    chosen = {r[0] for r in models.sample_rows(df, 1000).collect()}
    assert len(chosen) == 1000
    assert chosen == {r[0] for r in models.sample_rows(df.repartition(7), 1000).collect()}
    assert chosen < {r[0] for r in models.sample_rows(df, 2000).collect()}
    assert models.sample_rows(df).count() == 10_000
    assert models.sample_rows(df.limit(0)).count() == 0
    every = sorted(range(10_000), key=lambda k: (hashlib.md5(f"{k}:{models.SEED}".encode()).hexdigest(), k))
    for n in (1, 2, 999, 9_999, 10_000, 10_001):
        assert {r[0] for r in models.sample_rows(df, n).collect()} == set(every[:n])


@pytest.mark.parametrize("partitions", [3, 8])
def test_models_do_not_depend_on_partitions(spark, features, tmp_path, partitions):
    def scores(rows):
        clv, churn = saved(models.train_clv(rows), tmp_path), saved(models.train_churn(rows), tmp_path)
        scored = models.predictions(features, clv, churn).orderBy("HSHD_NUM").collect()
        return [(r["clv_score"], r["churn_prob"]) for r in scored]

    for one, other in zip(scores(features), scores(features.repartition(partitions, "total_spend"))):
        assert one == pytest.approx(other)


def test_capped_training(features):
    assert models.train_churn(features, max_rows=50).stages[-1].getNumTrees == 50


def test_clv_learns(features, tmp_path):
    model = saved(models.train_clv(features), tmp_path)
    held_out = models.clv_scores(features.filter(~models.is_training("HSHD_NUM")), model)
    quality = models.regression_quality(held_out, "total_spend", "clv_score").first()
    assert quality["r2"] > 0.9
    assert models.clv_summary(features, model).first()["mae"] == pytest.approx(quality["mae"], abs=0.005)


def test_churn_learns_and_repeats(spark, features, tmp_path):
    model = saved(models.train_churn(features), tmp_path)
    report = {r["class"]: r for r in models.churn_report(features, model).collect()}
    assert list(report) == ["0", "1", "accuracy", "macro avg", "weighted avg"]
    assert report["accuracy"]["f1"] > 0.95
    assert report["0"]["support"] + report["1"]["support"] == report["accuracy"]["support"]
    shares = models.importances(spark, model, CHURN_FEATURE_LABELS).collect()
    assert shares[0]["feature"] == "Visit Frequency"
    store = Store(spark, str(tmp_path / "store"))
    store.save_model("churn", models.train_churn(features))
    again = store.load_model("churn")
    assert tuples(models.churn_scores(features, again)) == tuples(models.churn_scores(features, model))


@pytest.mark.parametrize("recency,probability", [(20, 0.0), (200, 1.0)])
def test_one_class_only(features, tmp_path, recency, probability):
    same = features.withColumn("recency", F.lit(recency))
    model = saved(models.train_churn(same), tmp_path)
    assert {r["churn_prob"] for r in models.churn_scores(same, model).collect()} == {probability}


def test_class_weights(spark):
    rows = spark.createDataFrame([(1,)] * 6 + [(0,)] * 2, "label int")
    assert {(r["label"], r["weight"]) for r in models.balanced_weights(rows).collect()} == {(1, 8 / 12), (0, 2.0)}
    assert {r["weight"] for r in models.balanced_weights(rows.filter("label = 1")).collect()} == {1.0}


def test_pair_model(spark, tmp_path):
    rows = [
        (f"a{i:03}", f"b{i:03}", 10 + (i % 20) * 5, i % 20, i % 7, i % 7, i % 20, 0.5, float(i % 3)) for i in range(120)
    ]
    pairs = spark.createDataFrame(
        rows,
        "item_1 string, item_2 string, times_bought_together bigint, freq_1 bigint, freq_2 bigint, "
        "min_freq bigint, max_freq bigint, freq_ratio double, total_spend double",
    ).coalesce(1)
    assert models.enough_pairs(pairs.limit(10)) and not models.enough_pairs(pairs.limit(9))
    model = saved(models.train_pairs(pairs), tmp_path)
    summary = models.pair_summary(pairs, model).first()
    assert summary["n_pairs"] == 120 and summary["r2"] > 0.9
    shown = models.pair_predictions(pairs, model, 5).collect()
    assert [r["times_bought_together"] for r in shown] == [105] * 5
    assert all(abs(r["predicted"] - 105) < 5 for r in shown)


def test_regression_quality_of_constant_values(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 4.0)], "y double, p double")
    assert tuples(models.regression_quality(df, "y", "p")) == [(None, 1.5)]


def test_report_by_hand(spark):
    pairs = [(0, 0.0)] * 3 + [(0, 1.0)] + [(1, 1.0)] * 2 + [(1, 0.0)] * 4
    report = models.classification_report(spark.createDataFrame(pairs, "y int, p double"), "y", "p")
    rows = {r["class"]: r for r in report.collect()}
    assert (rows["0"]["precision"], rows["0"]["recall"], rows["0"]["support"]) == (3 / 7, 3 / 4, 4)
    assert (rows["1"]["precision"], rows["1"]["recall"], rows["1"]["f1"]) == (2 / 3, 2 / 6, 4 / 9)
    assert rows["accuracy"]["f1"] == 0.5
    assert rows["macro avg"]["precision"] == pytest.approx((3 / 7 + 2 / 3) / 2)
    assert rows["weighted avg"]["recall"] == pytest.approx((0.75 * 4 + 6 / 3) / 10)


def test_segments_with_none_in_them(spark):
    scored = spark.createDataFrame([(k, 10.0 - k // 2, 0.7, "High Risk", 100, 1, 1.0) for k in range(14)], SCORES)
    assert tuples(models.churn_counts(scored)) == [("Low Risk", 0), ("Medium Risk", 0), ("High Risk", 14)]
    assert [r["HSHD_NUM"] for r in models.top_clv(scored, 3).collect()] == [0, 1, 2]
    assert {r["strategy"] for r in models.with_strategy(scored).collect()} == {RETENTION_STRATEGIES["High Risk"]}
    stats = models.churn_stats(scored).first()
    assert (stats["total"], stats["high_risk"], stats["avg_clv"], stats["max_clv"]) == (14, 14, 7.0, 10.0)


def test_display_texts(spark):
    scored = spark.createDataFrame([(1, 1234.5, 0.305, "Medium Risk", 1, 1, 2.0)], SCORES)
    assert tuples(models.prediction_display(scored)) == [(1, "1234.50", "30%", 30, "2.00")]
