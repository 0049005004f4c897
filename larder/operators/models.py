"""Lifetime value, churn and co-purchase models, their scores and quality figures.

Training runs on all rows by default. Rows are dealt to a fixed number of tasks by their
keys and ordered there, so a model depends on the rows alone and not on their files.
Fitted models are for saving (`Store.save_model`); score with the saved copy,
which no longer holds the training session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.expressions import churned, risk_segment
from larder.functions.labels import CHURN_FEATURE_LABELS, PAIR_FEATURE_LABELS, segment_dim
from larder.operators.basket import best_pairs

# Model inputs in order, sizes and seed.
CLV_FEATURES = (
    "recency", "frequency", "avg_basket_value", "total_units", "spend_trend",
    "INCOME_RANGE", "AGE_RANGE", "HH_SIZE", "L", "CHILDREN",
)
CHURN_FEATURES = tuple(CHURN_FEATURE_LABELS)
PAIR_FEATURES = tuple(PAIR_FEATURE_LABELS)
SEED = 42
SAMPLE_ROWS = 10_000
MIN_PAIRS = 10

# Tasks that train side by side; a setting of the cluster, as models depend on it.
TRAINING_TASKS = 8

TWO_CLASSES = {"ml_attr": {"type": "nominal", "name": "label", "num_vals": 2}}


def is_training(*keys: str) -> Column:
    """Four fifths of the rows, by a hash of their keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(SEED)), F.lit(10)) < 8


def sample_rows(features: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """Exactly n households, those with the lowest hashes, or all if there are fewer: the capped training set.

    A histogram of the first hex digits finds the bucket in which the n-th hash lies; only
    that bucket, one of 4,096, is ordered. Equal hashes go by household.
    """
    draw = F.md5(F.concat(F.coalesce(F.col("HSHD_NUM").cast("string"), F.lit("")), F.lit(f":{SEED}")))
    bucket = F.substring(draw, 1, 3)
    counts = features.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.orderBy("bucket")) - F.col("n")
    edge = counts.select("bucket", "n", below.alias("below")).filter((F.col("below") < n) & (F.col("below") + F.col("n") > n)).first()
    if edge is None:
        whole = counts.select("bucket", below.alias("below")).filter(F.col("below") < n).select("bucket")
        return features.join(F.broadcast(whole.withColumnRenamed("bucket", "_bucket")), bucket == F.col("_bucket"), "left_semi")
    cut = features.filter(bucket == edge["bucket"]).orderBy(draw, "HSHD_NUM").limit(n - edge["below"])
    return features.filter(bucket < edge["bucket"]).unionByName(cut)


def _gbt(inputs: Sequence[str]) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(inputs), outputCol="features"),
            GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=3, seed=SEED),
        ]
    )


def _fit(
    pipeline: Pipeline, rows: DataFrame, columns: Sequence[str], keys: Sequence[str], tasks: int
) -> PipelineModel:
    """Fit on the needed columns only, cached, dealt and ordered by the rows' keys."""
    needed = list(dict.fromkeys([*keys, *columns]))
    dealt = rows.select(*needed).repartition(tasks, *keys).sortWithinPartitions(*keys).cache()
    try:
        return pipeline.fit(dealt)
    finally:
        dealt.unpersist()


def can_train(features: DataFrame) -> bool:
    """Whether any household is there to learn from."""
    return features.filter(is_training("HSHD_NUM")).limit(1).count() == 1


def train_clv(features: DataFrame, tasks: int = TRAINING_TASKS) -> PipelineModel:
    """Boosted trees for total spend."""
    rows = features.filter(is_training("HSHD_NUM")).withColumn("label", F.col("total_spend"))
    return _fit(_gbt(CLV_FEATURES), rows, (*CLV_FEATURES, "label"), ("HSHD_NUM",), tasks)


def balanced_weights(rows: DataFrame) -> DataFrame:
    """Weight rows / (classes * rows of the class) beside each row's label."""
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    ones = rows.agg(F.count_if(F.col("label") == 1).alias("ones")).scalar()
    both = (ones > 0) & (ones < n)
    of_class = F.when(F.col("label") == 1, ones).otherwise(n - ones)
    return rows.withColumn("weight", n / (F.when(both, 2).otherwise(1) * of_class))


def train_churn(
    features: DataFrame, max_rows: int | None = None, tasks: int = TRAINING_TASKS
) -> PipelineModel:
    """Balanced random forest for more than 90 days without a purchase.

    `max_rows` bounds the labelled rows to that many.
    """
    rows = features if max_rows is None else sample_rows(features, max_rows)
    rows = rows.filter(is_training("HSHD_NUM")).withColumn("label", churned("recency"))
    weighted = balanced_weights(rows.select("HSHD_NUM", *CHURN_FEATURES, "label"))
    weighted = weighted.withMetadata("label", TWO_CLASSES)
    forest = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(CHURN_FEATURES), outputCol="features"),
            RandomForestClassifier(numTrees=50, maxDepth=5, seed=SEED, weightCol="weight"),
        ]
    )
    return _fit(forest, weighted, (*CHURN_FEATURES, "label", "weight"), ("HSHD_NUM",), tasks)


def enough_pairs(pairs: DataFrame) -> bool:
    """Below ten pairs there is no pair model, nor if none of them is for training."""
    found = pairs.limit(MIN_PAIRS).count() == MIN_PAIRS
    return found and pairs.filter(is_training("item_1", "item_2")).limit(1).count() == 1


def train_pairs(pairs: DataFrame, tasks: int = TRAINING_TASKS) -> PipelineModel:
    """Boosted trees for the co-purchase count."""
    rows = pairs.filter(is_training("item_1", "item_2")).withColumn(
        "label", F.col("times_bought_together")
    )
    return _fit(_gbt(PAIR_FEATURES), rows, (*PAIR_FEATURES, "label"), ("item_1", "item_2"), tasks)


# Scores ----------------------------------------------------------------------


def clv_scores(features: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(features).drop("features").withColumnRenamed("prediction", "clv_score")


def churn_scores(features: DataFrame, model: PipelineModel) -> DataFrame:
    return (
        model.transform(features)
        .withColumn("churn_prob", vector_to_array("probability")[1])
        .drop("features", "rawPrediction", "probability")
        .withColumnRenamed("prediction", "churn_class")
    )


def predictions(features: DataFrame, clv: PipelineModel, churn: PipelineModel) -> DataFrame:
    """Both scores and the risk segment of every household."""
    return churn_scores(clv_scores(features, clv), churn).select(
        "HSHD_NUM",
        "clv_score",
        "churn_prob",
        risk_segment("churn_prob").alias("risk_segment"),
        "recency",
        "frequency",
        "total_spend",
    )


def by_churn(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("churn_prob"), "HSHD_NUM")


def top_clv(scored: DataFrame, n: int = 10) -> DataFrame:
    return (
        scored.orderBy(F.desc("clv_score"), "HSHD_NUM")
        .limit(n)
        .select("HSHD_NUM", "clv_score", "churn_prob", "risk_segment", "frequency", "recency")
    )


def churn_counts(scored: DataFrame) -> DataFrame:
    """Households per segment; all three segments, an empty one with 0."""
    counts = scored.groupBy("risk_segment").agg(F.count(F.lit(1)).alias("n"))
    return (
        segment_dim(scored.sparkSession)
        .join(counts, "risk_segment", "left")
        .orderBy("segment_order")
        .select("risk_segment", F.coalesce("n", F.lit(0)).alias("n"))
    )


def with_strategy(scored: DataFrame) -> DataFrame:
    """The retention advice of each household's segment."""
    advice = segment_dim(scored.sparkSession).select("risk_segment", "strategy")
    return scored.join(F.broadcast(advice), "risk_segment", "left").select(
        *scored.columns, "strategy"
    )


def churn_stats(scored: DataFrame) -> DataFrame:
    def households(segment: str) -> Column:
        return F.count_if(F.col("risk_segment") == segment)

    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        households("High Risk").alias("high_risk"),
        households("Medium Risk").alias("medium_risk"),
        households("Low Risk").alias("low_risk"),
        F.bround(F.avg("clv_score"), 2).alias("avg_clv"),
        F.bround(F.max("clv_score"), 2).alias("max_clv"),
    )


def percent_text(probability: Column | str) -> Column:
    """Whole percent, halves to the even neighbour."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.format_string("%d%%", F.bround(p * 100).cast("bigint"))


def prediction_display(scored: DataFrame) -> DataFrame:
    """Texts of the prediction list: money, percent and the bar's whole percent."""
    return scored.select(
        "HSHD_NUM",
        F.format_string("%.2f", F.bround("clv_score", 2)).alias("clv_text"),
        percent_text("churn_prob").alias("churn_text"),
        F.floor(F.col("churn_prob") * 100).alias("bar_width"),
        F.format_string("%.2f", F.bround("total_spend", 2)).alias("spend_text"),
    )


def pair_predictions(pairs: DataFrame, model: PipelineModel, n: int = 20) -> DataFrame:
    """The first n pairs with the model's count."""
    return model.transform(best_pairs(pairs, n)).select(
        "item_1",
        "item_2",
        "times_bought_together",
        F.bround("prediction", 1).alias("predicted"),
    )


# Quality ---------------------------------------------------------------------


def importances(
    spark: SparkSession, model: PipelineModel, labels: dict[str, str]
) -> DataFrame:
    """Share of each model input, largest first; one row per input."""
    shares = model.stages[-1].featureImportances.toArray()
    rows = spark.createDataFrame(
        [(label, float(share)) for label, share in zip(labels.values(), shares)],
        "feature string, importance double",
    )
    return rows.select("feature", F.bround("importance", 4).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )


def regression_quality(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: r2 (NULL when the actual values do not vary) and mae."""
    error = F.col(actual) - F.col(predicted)
    spread = F.nullif(F.var_pop(actual), F.lit(0.0))
    return scored.agg(
        (1 - F.try_divide(F.avg(error * error), spread)).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
    )


def clv_summary(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Mean absolute error on the held-out fifth."""
    held_out = clv_scores(features.filter(~is_training("HSHD_NUM")), model)
    quality = regression_quality(held_out, "total_spend", "clv_score")
    return quality.select(F.bround("mae", 2).alias("mae"))


def pair_summary(pairs: DataFrame, model: PipelineModel) -> DataFrame:
    """Number of pairs and quality on the held-out fifth."""
    held_out = model.transform(pairs.filter(~is_training("item_1", "item_2")))
    quality = regression_quality(held_out, "times_bought_together", "prediction")
    n = pairs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return quality.select(
        n.alias("n_pairs"), F.bround("r2", 3).alias("r2"), F.bround("mae", 1).alias("mae")
    )


def classification_report(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class 0 and 1, overall and averaged.

    A ratio over nothing is 0. Overall accuracy stands in the f1 column.
    """

    def seen(a: int | None, p: int | None) -> Column:
        hit = F.lit(True)
        if a is not None:
            hit = hit & (F.col(actual) == a)
        if p is not None:
            hit = hit & (F.col(predicted) == p)
        return F.count_if(hit)

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    counted = scored.agg(
        seen(None, None).alias("n"),
        *[seen(k, k).alias(f"hit_{k}") for k in (0, 1)],
        *[seen(k, None).alias(f"actual_{k}") for k in (0, 1)],
        *[seen(None, k).alias(f"predicted_{k}") for k in (0, 1)],
    )
    rates = counted
    for k in (0, 1):
        hit = F.col(f"hit_{k}")
        rates = (
            rates.withColumn(f"precision_{k}", share(hit, F.col(f"predicted_{k}")))
            .withColumn(f"recall_{k}", share(hit, F.col(f"actual_{k}")))
            .withColumn(f"f1_{k}", share(2 * hit, F.col(f"predicted_{k}") + F.col(f"actual_{k}")))
        )

    def macro(name: str) -> Column:
        return (F.col(f"{name}_0") + F.col(f"{name}_1")) / 2

    def weighted(name: str) -> Column:
        total = F.col(f"{name}_0") * F.col("actual_0") + F.col(f"{name}_1") * F.col("actual_1")
        return share(total, F.col("n"))

    def row(title: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(title).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.alias("support"),
        )

    none = F.lit(None).cast("double")
    rows = [
        row(str(k), *[F.col(f"{m}_{k}") for m in ("precision", "recall", "f1", "actual")])
        for k in (0, 1)
    ]
    accuracy = share(F.col("hit_0") + F.col("hit_1"), F.col("n"))
    rows.append(row("accuracy", none, none, accuracy, F.col("n")))
    for title, mean in (("macro avg", macro), ("weighted avg", weighted)):
        rows.append(row(title, mean("precision"), mean("recall"), mean("f1"), F.col("n")))
    return rates.select(F.inline(F.array(*rows)))


def churn_report(features: DataFrame, model: PipelineModel) -> DataFrame:
    held_out = features.filter(~is_training("HSHD_NUM")).withColumn("label", churned("recency"))
    return classification_report(churn_scores(held_out, model), "label", "churn_class")
