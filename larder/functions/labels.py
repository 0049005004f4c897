"""Fixed texts shown with the results, and the frames that carry them.

Each frame has a handful of literal rows, so joining it by broadcast is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Seasons in calendar order of the week bands.
SEASONS = ("Spring", "Summer", "Fall", "Winter")

# Risk segments from low to high.
RISK_SEGMENTS = ("Low Risk", "Medium Risk", "High Risk")

# Display names of the churn model's features.
CHURN_FEATURE_LABELS = {
    "frequency": "Visit Frequency",
    "avg_basket_value": "Avg Basket Value",
    "INCOME_RANGE": "Income Range",
    "AGE_RANGE": "Age Range",
    "HH_SIZE": "Household Size",
    "L": "Loyalty Status",
    "CHILDREN": "Has Children",
}

# Display names of the columns correlated with churn.
CORRELATION_LABELS = {
    "recency": "Recency (days)",
    "frequency": "Visit Frequency",
    "avg_basket_value": "Avg Basket Value",
    "total_spend": "Total Spend",
    "spend_trend": "Spend Trend",
}

# Display names of the pair model's features.
PAIR_FEATURE_LABELS = {
    "freq_1": "Item 1 Frequency",
    "freq_2": "Item 2 Frequency",
    "min_freq": "Min Item Frequency",
    "max_freq": "Max Item Frequency",
    "freq_ratio": "Frequency Balance",
    "total_spend": "Combined Spend",
}

# What to do for a household of each segment.
RETENTION_STRATEGIES = {
    "High Risk": "Personalised win-back offer + loyalty points double-up within 30 days.",
    "Medium Risk": "Targeted email with top-category coupon based on past spend patterns.",
    "Low Risk": "Upsell cross-category products surfaced from basket analysis.",
}


def season_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, s) for i, s in enumerate(SEASONS, 1)], "season_order int, season string"
    )


def segment_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, s, RETENTION_STRATEGIES[s]) for i, s in enumerate(RISK_SEGMENTS, 1)],
        "segment_order int, risk_segment string, strategy string",
    )
