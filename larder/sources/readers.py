"""Raw readers. All return text columns; typing happens in `ingest`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Holds records that do not fit the header.
MALFORMED = "_malformed_record"


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header line, every column as text, nothing inferred.

    The header of the first file names the columns, and each further file must
    carry the same header. Quotes are doubled inside quoted fields. Files split
    across tasks unless `multi_line` is needed for line breaks inside fields.

    A record of more or fewer fields than the header stands whole in the column MALFORMED,
    which is NULL for all others; `ingest` counts those records.
    """
    options = {
        "header": True,
        "quote": '"',
        "escape": '"',
        "multiLine": multi_line,
        "inferSchema": False,
    }
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, MALFORMED)])
    # Without pruning: a record is judged by all its fields, whichever are asked for.
    marked = {"enforceSchema": False, "columnNameOfCorruptRecord": MALFORMED, "columnPruning": False}
    return spark.read.options(**options, **marked).schema(schema).csv(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table read in parallel ranges of a numeric column."""
    return spark.read.jdbc(
        url,
        table,
        column=column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties or {},
    )
