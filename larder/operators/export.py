"""Results as JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object per row, empty fields included."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)
