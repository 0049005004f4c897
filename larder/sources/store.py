"""Versioned Parquet tables under one shared folder.

Every write goes to new folders; one small manifest file with a row per table
then makes the new versions current, all together. A failed job leaves the
current versions untouched.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

WRITES_AT_ONCE = 4

# About 128 MB of purchase lines.
ROWS_PER_FILE = 5_000_000

# Prefix of model names in the manifest.
MODEL = "model:"

MANIFEST = "table string, path string, rows bigint, bytes bigint, written_at timestamp, source string"


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def storage_root(spark: SparkSession) -> str:
    """The shared folder for written tables: the session's checkpoint folder.

    Only a local session without one gets a temporary folder.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="larder-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared)
    return shared.rstrip("/")


def row_bytes(df: DataFrame) -> Column:
    """Estimated bytes of one row in memory."""
    text = [c for c, kind in df.dtypes if kind == "string"]
    size = F.lit(16 * len(df.columns)).cast("bigint")
    for c in text:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    return size


@dataclass(frozen=True)
class Entry:
    path: str
    rows: int
    bytes: int
    written_at: dt.datetime
    # The version of the purchases it was derived from; None for loaded tables.
    source: str | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def write(self, tables: dict[str, DataFrame], source: str | None = None) -> DataFrame:
        """Write all tables, then make them current; returns their manifest rows.

        `source` names the version that they were derived from.

        A few tables are written at a time, so that one's last tasks do not leave
        the executors idle.
        """
        version = uuid.uuid4().hex

        def put(item: tuple[str, DataFrame]) -> tuple[str, str, int, int]:
            name, df = item
            path = f"{self.root}/data/{name}/{version}"
            seen = Observation()
            observed = df.observe(
                seen,
                F.count(F.lit(1)).alias("rows"),
                F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes"),
            )
            observed.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
            return name, path, seen.get["rows"], seen.get["bytes"]

        try:
            with ThreadPoolExecutor(WRITES_AT_ONCE) as pool:
                done = list(pool.map(put, tables.items()))
        except Exception:
            for name in tables:
                self._delete(f"{self.root}/data/{name}/{version}")
            raise
        return self._commit(done, source)

    def stage(self, df: DataFrame) -> tuple[str, int]:
        """Write a frame aside; its folder and row count."""
        path = f"{self.root}/staging/{uuid.uuid4().hex}"
        seen = Observation()
        try:
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        except Exception:
            self._delete(path)
            raise
        return path, seen.get["rows"]

    def discard(self, staged: str) -> None:
        """Delete what `stage` wrote."""
        if staged.startswith(f"{self.root}/staging/"):
            self._delete(staged)

    def delete_old(self, before: dt.datetime) -> int:
        """Delete the files of replaced versions written before a (zoned) moment; how many.

        Choose a moment that no running reader opened its tables before.
        """
        current = {e.path for e in self.entries().values()}
        manifest = self._manifest()
        old = manifest.filter(F.col("written_at") < F.lit(before)).select("path")
        gone = [r["path"] for r in old.distinct().collect() if r["path"] not in current]
        deleted = sum(self._delete(path) for path in gone)
        self._compact(manifest, before)
        return deleted

    def _compact(self, manifest: DataFrame, before: dt.datetime) -> None:
        """One manifest folder in place of those of before the moment, current rows only."""
        folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1).alias("folder")
        of_folder = manifest.select("*", folder).groupBy("folder").agg(F.max("written_at").alias("last"))
        folders = [r["folder"] for r in of_folder.filter(F.col("last") < F.lit(before)).collect()]
        if len(folders) < 2:
            return
        kept = [(n, e.path, e.rows, e.bytes, e.written_at, e.source) for n, e in self.entries().items() if e.written_at < before]
        rows = self.spark.createDataFrame(kept, MANIFEST)
        rows.coalesce(1).write.parquet(f"{self.root}/manifest/{uuid.uuid4().hex}")
        for path in folders:
            self._delete(path)

    def _delete(self, path: str) -> bool:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.delete(jvm_path, True)

    def save_model(self, name: str, model: PipelineModel, source: str | None = None) -> None:
        """Save as a new version and make it current."""
        path = f"{self.root}/models/{name}/{uuid.uuid4().hex}"
        model.write().save(path)
        self._commit([(MODEL + name, path, 0, 0)], source)

    def load_model(self, name: str) -> PipelineModel:
        return PipelineModel.load(self.entries()[MODEL + name].path)

    def _commit(self, done: list[tuple[str, str, int, int]], source: str | None) -> DataFrame:
        now = utc_now()
        rows = self.spark.createDataFrame([(*d, now, source) for d in done], MANIFEST)
        rows.coalesce(1).write.parquet(f"{self.root}/manifest/{uuid.uuid4().hex}")
        return rows

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/*")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], MANIFEST)
            raise

    def entries(self) -> dict[str, Entry]:
        """The current version of every table; one small row each."""
        newest = self._manifest().groupBy("table").agg(
            F.max_by(F.struct("path", "rows", "bytes", "written_at", "source"), "written_at").alias("e")
        )
        return {
            r["table"]: Entry(
                r["e"]["path"],
                r["e"]["rows"],
                r["e"]["bytes"],
                r["e"]["written_at"].astimezone(dt.timezone.utc),
                r["e"]["source"],
            )
            for r in newest.collect()
        }

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.entries()[name].path)
