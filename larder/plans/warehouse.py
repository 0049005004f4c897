"""Clean tables and everything derived from them, each built once per load.

Every derived table and model is kept with the version of the purchases it was made from.
One made from any other version than the current counts as missing and is built again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from larder.operators import basket, models, rfm, trees
from larder.sources import ingest
from larder.sources.star import BROADCAST_BYTES, Star
from larder.sources.store import MODEL, Entry, Store


class Warehouse:
    def __init__(self, store: Store, broadcast_bytes: int = BROADCAST_BYTES):
        self.store = store
        self.broadcast_bytes = broadcast_bytes
        self._entries: dict[str, Entry] | None = None
        # By path; a version's files never change.
        self._frames: dict[str, DataFrame] = {}
        self._models: dict[str, PipelineModel] = {}

    def entries(self) -> dict[str, Entry]:
        if self._entries is None:
            self._entries = self.store.entries()
        return self._entries

    def reload(self) -> None:
        """Forget what is known of the store, e.g. after another job's load."""
        self._entries = None
        self.__dict__.pop("star", None)
        self.__dict__.pop("_opened", None)

    def load(
        self, tables: dict[str, DataFrame | None], before_write: Callable[[], None] = lambda: None
    ) -> DataFrame:
        """Replace the three clean tables; all derived data becomes outdated."""
        summary = ingest.replace_tables(self.store, tables, before_write)
        self.reload()
        return summary

    @property
    def source(self) -> str:
        """The version of the purchases that this warehouse reads, until `reload`."""
        return self._opened["transactions"].path

    @cached_property
    def _opened(self) -> dict[str, Entry]:
        """The loaded tables as they were when first asked for."""
        return {t: self.entries()[t] for t in ingest.LOAD_ORDER}

    def is_current(self, name: str, not_before: dt.datetime | None = None) -> bool:
        """Derived from the version this warehouse reads, whenever that was."""
        entry = self.entries().get(name)
        if entry is None or entry.source != self.source:
            return False
        return not_before is None or entry.written_at >= not_before

    def status(self, names: Sequence[str]) -> DataFrame:
        """(table, current): whether each result follows from the tables as loaded last."""
        entries = self.store.entries()
        loaded = entries["transactions"].path
        rows = [(n, n in entries and entries[n].source == loaded) for n in names]
        return self.store.spark.createDataFrame(rows, "table string, current boolean")

    def write(self, tables: dict[str, DataFrame]) -> DataFrame:
        written = self.store.write(tables, self.source)
        self._entries = None
        return written

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if not self.is_current(name):
            self.write({name: build()})
        path = self.entries()[name].path
        if path not in self._frames:
            self._frames[path] = self.store.spark.read.parquet(path)
        return self._frames[path]

    def model(self, name: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
        if not self.is_current(MODEL + name):
            self.store.save_model(name, fit(), self.source)
            self._entries = None
        path = self.entries()[MODEL + name].path
        if path not in self._models:
            self._models[path] = PipelineModel.load(path)
        return self._models[path]

    def nodes(self, name: str) -> DataFrame:
        """The node table of a model that is fitted, written once."""
        return self.table(f"{name}_nodes", lambda: trees.node_table(self.store.spark, self.entries()[MODEL + name].path))

    @cached_property
    def star(self) -> Star:
        return Star.of_entries(self.store, self._opened, self.broadcast_bytes)

    def features(self) -> DataFrame:
        return self.table("features", lambda: rfm.household_features(self.star))

    def basket_items(self) -> DataFrame:
        return self.table("basket_items", lambda: basket.basket_commodities(self.star))

    def pairs(self, top_n: int | None) -> DataFrame:
        return basket.count_pairs(self.basket_items(), top_n)

    def pair_features(self, top_n: int | None = 100) -> DataFrame:
        """Features of the most frequent pairs, or of all."""
        name = "pair_features" if top_n == 100 else f"pair_features_{top_n}"
        pairs = self.pairs(top_n)
        if top_n is None:
            return self.table(name, lambda: basket.pair_features(pairs, basket.commodity_stats(self.star)))
        return self.table(name, lambda: basket.top_pair_features(self.star, pairs))

    def can_train(self) -> bool:
        return models.can_train(self.features())

    def clv_model(self) -> PipelineModel | None:
        """None without households to learn from."""
        if not self.can_train():
            return None
        return self.model("clv", lambda: models.train_clv(self.features()))

    def churn_model(self) -> PipelineModel | None:
        if not self.can_train():
            return None
        return self.model("churn", lambda: models.train_churn(self.features()))

    def pair_model(self) -> PipelineModel | None:
        """None when there are too few pairs to learn from."""
        if not models.enough_pairs(self.pair_features()):
            return None
        return self.model("pairs", lambda: models.train_pairs(self.pair_features()))

    def predictions(self) -> DataFrame:
        return self.table("predictions", self._score)

    def _score(self) -> DataFrame:
        """Both models are fitted at a time: their many short jobs fill each other's gaps."""
        features = self.features()
        with ThreadPoolExecutor(2) as pool:
            clv, churn = pool.submit(self.clv_model), pool.submit(self.churn_model)
            return models.predictions(features, clv.result(), churn.result())
