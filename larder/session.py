"""A session with the settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """On a cluster the master and the shuffle width come from spark-submit.

    Adaptive execution sizes shuffle partitions, splits skewed ones and turns
    joins into broadcasts by the sizes it measures.
    """
    builder = (
        SparkSession.builder.appName("larder")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
