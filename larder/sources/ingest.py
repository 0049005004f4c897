"""Raw text to clean typed tables, and the full-replace load of all three."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from larder.functions.expressions import date_or_null, na_to_null
from larder.sources import schema
from larder.sources.readers import MALFORMED
from larder.sources.store import Store

# The fact table first, then its dimensions.
LOAD_ORDER = ("transactions", "products", "households")

# Purchase lines that one task orders, about 150 MB in memory.
ROWS_PER_RANGE = 1_000_000

# Ranges that are few enough to shuffle into; a table too large for that gets larger ranges,
# which the sort spills and the writer cuts into files.
MOST_RANGES = 2_000


# Name that malformed records are counted under.
RECORD = "(record)"


class IncompleteLoad(ValueError):
    """Some of the three inputs are missing, so nothing is written."""


class RejectedValues(ValueError):
    """Some texts or records cannot be read, and the load was not permitted to drop them."""


class DuplicateKeys(ValueError):
    """A dimension holds the same numeric key more than once."""


def bronze(raw: DataFrame) -> DataFrame:
    """Headers trimmed and renamed, missing-value texts as NULL, all still text."""
    names = [c.strip() for c in raw.columns]
    named = raw.toDF(*[schema.RENAMES.get(n, n) for n in names])
    return named.select(*[na_to_null(F.col(c).cast("string")).alias(c) for c in named.columns])


def _typed(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "string":
        return F.rtrim(c).alias(name)
    if kind == "date":
        return date_or_null(c).alias(name)
    return c.try_cast(kind).alias(name)


def clean(table: str, bronze_rows: DataFrame) -> DataFrame:
    """The table's columns, picked by name and typed; unreadable values become NULL."""
    columns = schema.TABLES[table]
    absent = [c for c in columns if c not in bronze_rows.columns]
    if absent:
        raise ValueError(f"{table}: no column {', '.join(absent)}")
    return bronze_rows.select(*[_typed(c, kind) for c, kind in columns.items()])


def _unreadable(table: str) -> list[Column]:
    """Per typed column, how many texts its type cannot read."""
    return [
        F.count_if(F.col(c).isNotNull() & _typed(c, kind).isNull()).alias(c)
        for c, kind in schema.TABLES[table].items()
        if kind != "string"
    ]


def unreadable_counts(table: str, bronze_rows: DataFrame) -> DataFrame:
    """One row: per typed column, how many texts its type could not read."""
    return bronze_rows.agg(*_unreadable(table))


def _rejects(table: str, bronze_rows: DataFrame) -> list[Column]:
    malformed = F.col(MALFORMED).isNotNull() if MALFORMED in bronze_rows.columns else F.lit(False)
    return [F.count_if(malformed).alias(RECORD), *_unreadable(table)]


def rejects(bronze_tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, rows): unreadable texts per column, and malformed records as RECORD."""
    parts = []
    for table, rows in bronze_tables.items():
        counts = rows.agg(*_rejects(table, rows))
        cells = [F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"), F.col(c).alias("rows")) for c in counts.columns]
        parts.append(counts.select(F.inline(F.array(*cells))))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.filter("rows > 0")


class Cleaning:
    """Raw tables cleaned, their rejects counted by whichever job reads them first."""

    def __init__(self, raw: dict[str, DataFrame | None]):
        check_complete(raw)
        self.tables: dict[str, DataFrame] = {}
        self._seen: dict[str, Observation] = {}
        for table in LOAD_ORDER:
            rows = bronze(raw[table])
            self._seen[table] = Observation()
            self.tables[table] = clean(table, rows.observe(self._seen[table], *_rejects(table, rows)))

    def keep_first(self) -> Cleaning:
        """Repeated dimension numbers reduced to one row instead of refused."""
        for table, key in schema.KEYS.items():
            self.tables[table] = keep_first(self.tables[table], key)
        return self

    def rejects(self) -> list[tuple[str, str, int]]:
        """(table, column, rows) with rows; only after the tables have been read."""
        return [(t, c, n) for t in LOAD_ORDER for c, n in self._seen[t].get.items() if n]

    def refuse_rejects(self) -> None:
        found = self.rejects()
        if found:
            said = ", ".join(f"{t}.{c}: {n}" for t, c, n in found)
            raise RejectedValues(f"values or records that cannot be read ({said}); nothing was loaded")


def check_complete(inputs: dict[str, DataFrame | None]) -> None:
    absent = [t for t in LOAD_ORDER if inputs.get(t) is None]
    if absent:
        raise IncompleteLoad(f"all three tables must be given; missing: {', '.join(absent)}")


def check_unique(table: str, df: DataFrame) -> None:
    """Joins and paging rely on one dimension row per numeric key."""
    key = schema.KEYS[table]
    twice = (
        df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(5).collect()
    )
    if twice:
        raise DuplicateKeys(f"{table}: {key} repeated, e.g. {[r[0] for r in twice]}")


def keep_first(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the smallest by all its columns.

    An aggregate rather than a window, so copies of one key are reduced before
    the shuffle and never gathered in a single task.
    """
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("row"))
    return best.select(key, "row.*").select(*df.columns)


def rejects_frame(spark: SparkSession, found: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame(found, "table string, column string, rows bigint")


def cluster(transactions: DataFrame, rows: int) -> DataFrame:
    """Order the files by household and basket; `transactions` is a written table.

    A household lookup then skips nearly all files by their min/max values, and
    map-side aggregation by household or basket meets its rows together. Product
    and row number let the range split go on inside one very large basket and
    inside many copies of one line.

    Above one range their number follows from the rows, so that the memory of a task does
    not depend on the shuffle width of the session.
    """
    keys = ("HSHD_NUM", "BASKET_NUM", "PRODUCT_NUM", "row")
    numbered = transactions.withColumn("row", F.monotonically_increasing_id())
    wanted = min(-(-rows // ROWS_PER_RANGE), MOST_RANGES)
    if wanted > 1:
        # At least one for every core.
        wanted = max(wanted, transactions.sparkSession.sparkContext.defaultParallelism)
        ranges = numbered.repartitionByRange(wanted, *keys)
    else:
        ranges = numbered.repartitionByRange(*keys)
    return ranges.sortWithinPartitions("HSHD_NUM", "BASKET_NUM").drop("row")


def replace_tables(
    store: Store,
    tables: dict[str, DataFrame | None],
    before_write: Callable[[], None] = lambda: None,
) -> DataFrame:
    """Replace all three clean tables at once; summary of (table, rows).

    All three have been read once when `before_write` runs; it may refuse the load.

    Readers see the old three until the new three are committed together. The
    purchases are written aside first: ordering them reads its input twice, and
    the number of ranges follows from their count.
    """
    check_complete(tables)
    for name in schema.KEYS:
        check_unique(name, tables[name])
    staged, rows = store.stage(tables["transactions"])
    new = {t: tables[t] for t in LOAD_ORDER}
    new["transactions"] = cluster(store.spark.read.parquet(staged), rows)
    try:
        before_write()
        return store.write(new).select("table", "rows")
    finally:
        store.discard(staged)
