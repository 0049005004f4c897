"""Recency, frequency and spend per household, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.functions.expressions import (
    cents,
    children_flag,
    churned,
    correlation_direction,
    from_cents,
)
from larder.functions.labels import CORRELATION_LABELS
from larder.operators.joins import join_dimension
from larder.sources.star import Star, is_small
from larder.sources.store import storage_root

ENCODED = ("INCOME_RANGE", "AGE_RANGE", "HH_SIZE", "L")


def snapshot_date(star: Star) -> DataFrame:
    return star.transactions.agg(F.max("PURCHASE_DATE").alias("snap_date"))


def rfm(star: Star) -> DataFrame:
    """One row per household number seen in the purchases.

    Recent spend covers the six months up to the last purchase date overall.
    Undated lines count in the totals only.
    """
    snapshot = snapshot_date(star).scalar()
    cut = snapshot_date(star).select(F.add_months("snap_date", -6)).scalar()
    lines = star.transactions.withColumn("cents", cents("SPEND"))

    def spend_when(condition: Column) -> Column:
        return from_cents(F.sum(F.when(condition, F.col("cents")).otherwise(0)))

    totals = lines.groupBy("HSHD_NUM").agg(
        F.max("PURCHASE_DATE").alias("last_purchase"),
        F.count_distinct("BASKET_NUM").alias("frequency"),
        from_cents(F.sum("cents")).alias("total_spend"),
        F.sum("UNITS").alias("total_units"),
        spend_when(F.col("PURCHASE_DATE") >= cut).alias("recent_spend"),
        spend_when(F.col("PURCHASE_DATE") < cut).alias("older_spend"),
    )
    return totals.withColumn("snapshot_date", snapshot)


def category_codes(households: DataFrame) -> DataFrame:
    """name, value, code: the sorted texts of each demographic column as 0..k-1.

    A missing text is 'None'. A text's code is its place in its sorted partition
    plus the texts in the partitions before, so no task sees more than its own part
    however many texts there are. The sorted texts are written out first: both uses
    of them must see the same partitions.
    """
    cells = [
        F.struct(F.lit(c).alias("name"), F.coalesce(c, F.lit("None")).alias("value"))
        for c in ENCODED
    ]
    storage_root(households.sparkSession)
    values = households.select(F.inline(F.array(*cells))).distinct()
    placed = values.orderBy("name", "value").checkpoint().select(
        "name",
        "value",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("place"),
    )
    sizes = placed.groupBy("name", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first")
    )
    earlier = W.partitionBy("name").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        "name", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")
    )
    return placed.join(F.broadcast(shifts), ["name", "part"]).select(
        "name", "value", (F.col("place") + F.col("shift")).cast("int").alias("code")
    )


def encoded_households(households: DataFrame) -> DataFrame:
    """HSHD_NUM with the encoded demographics and the 'Y' flag of CHILDREN."""
    codes = category_codes(households).checkpoint()
    keyed = households.filter(F.col("HSHD_NUM").isNotNull()).select(
        "HSHD_NUM",
        *[F.coalesce(c, F.lit("None")).alias(c) for c in ENCODED],
        children_flag("CHILDREN").alias("CHILDREN"),
    )
    fits = is_small(codes)
    for c in ENCODED:
        own = codes.filter(F.col("name") == c).select(
            F.col("value").alias(c), F.col("code").alias(f"{c}_code")
        )
        keyed = join_dimension(keyed, own, c, fits)
    return keyed.select("HSHD_NUM", *[F.col(f"{c}_code").alias(c) for c in ENCODED], "CHILDREN")


def household_features(star: Star) -> DataFrame:
    """Model input, one row per household with a number; gaps are 0."""
    known = rfm(star).filter(F.col("HSHD_NUM").isNotNull())
    derived = (
        known.withColumn("recency", F.date_diff("snapshot_date", "last_purchase"))
        .withColumn(
            "avg_basket_value",
            F.col("total_spend") / F.greatest(F.col("frequency"), F.lit(1)),
        )
        .withColumn(
            "spend_trend",
            F.coalesce("recent_spend", F.lit(0.0)) - F.coalesce("older_spend", F.lit(0.0)),
        )
    )
    people = encoded_households(star.households)
    if star.households_fit:
        people = F.broadcast(people)
    return derived.join(people, "HSHD_NUM", "left").fillna(0)


def churn_rate(features: DataFrame) -> DataFrame:
    return features.agg(F.avg(churned("recency")).alias("churn_rate"))


def churn_correlations(features: DataFrame) -> DataFrame:
    """Pearson correlation of five columns with the churn label, one row each.

    NULL when a column or the label does not vary.
    """
    rows = features.withColumn("churned", churned("recency").cast("double"))

    def correlation(name: str):
        spread = F.stddev_pop(name) * F.stddev_pop("churned")
        return F.try_divide(F.covar_pop(F.col(name).cast("double"), "churned"), F.nullif(spread, F.lit(0.0)))

    wide = rows.agg(*[correlation(c).alias(c) for c in CORRELATION_LABELS])
    pairs = [
        F.struct(F.lit(label).alias("feature"), F.bround(c, 3).alias("correlation"))
        for c, label in CORRELATION_LABELS.items()
    ]
    return wide.select(F.inline(F.array(*pairs)))


def correlation_directions(correlations: DataFrame) -> DataFrame:
    return correlations.select(
        "feature", "correlation", correlation_direction("correlation").alias("direction")
    )
