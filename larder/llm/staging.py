"""Tables written in the cluster's shared folder: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a temporary folder only on one machine where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='larder-')}"
    return _local[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/larder-llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a written table."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the table is called so in any case."""
    taken = {c.lower() for c in df.columns}
    tail = ""
    while any(n.lower() + tail in taken for n in names):
        tail += "_"
    return [n + tail for n in names]
