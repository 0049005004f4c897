"""The three clean tables as one argument for the jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.sources.ingest import check_unique
from larder.sources.store import Entry, Store, row_bytes

# A dimension is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 64 * 1024 * 1024


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure a frame and tell whether it may be broadcast."""
    size = df.agg(F.sum(row_bytes(df)).alias("bytes")).first()["bytes"] or 0
    return size <= limit


@dataclass(frozen=True)
class Star:
    """Dimension keys are unique; `..._fit` tells whether a whole dimension may be broadcast."""

    transactions: DataFrame
    households: DataFrame
    products: DataFrame
    households_fit: bool
    products_fit: bool
    broadcast_bytes: int = BROADCAST_BYTES

    def products_can(self, dim: DataFrame) -> bool:
        """Whether the columns that a job takes of the products may be broadcast."""
        return self.products_fit or is_small(dim, self.broadcast_bytes)

    def households_can(self, dim: DataFrame) -> bool:
        return self.households_fit or is_small(dim, self.broadcast_bytes)

    @classmethod
    def of(
        cls,
        transactions: DataFrame,
        households: DataFrame,
        products: DataFrame,
        broadcast_bytes: int = BROADCAST_BYTES,
    ) -> Star:
        """From any frames; checks and measures the two dimensions."""
        check_unique("households", households)
        check_unique("products", products)
        return cls(
            transactions,
            households,
            products,
            is_small(households, broadcast_bytes),
            is_small(products, broadcast_bytes),
            broadcast_bytes,
        )

    @classmethod
    def stored(cls, store: Store, broadcast_bytes: int = BROADCAST_BYTES) -> Star:
        """From a store; the sizes were measured when the tables were written."""
        return cls.of_entries(store, store.entries(), broadcast_bytes)

    @classmethod
    def of_entries(cls, store: Store, entries: dict[str, Entry], broadcast_bytes: int) -> Star:
        def read(name: str) -> DataFrame:
            return store.spark.read.parquet(entries[name].path)

        return cls(
            read("transactions"),
            read("households"),
            read("products"),
            entries["households"].bytes <= broadcast_bytes,
            entries["products"].bytes <= broadcast_bytes,
            broadcast_bytes,
        )
