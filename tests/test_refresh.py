import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from larder.operators import dashboard, export, models
from larder.plans import refresh
from larder.plans.warehouse import Warehouse
import fixtures as fixture
from larder.sources.ingest import IncompleteLoad
from larder.sources.store import utc_now
from tests.conftest import SF, tuples


@pytest.fixture
def warehouse(store):
    return Warehouse(store)


def test_load_refresh_reuse_and_outdate(spark, warehouse, monkeypatch):
    raw = fixture.raw_tables(spark, SF)
    summary = {t: n for t, n, rejected in tuples(refresh.load_and_refresh(warehouse, raw)) if rejected == 0}
    assert summary["transactions"] == spark.read.parquet(f"{SF}/lineitem.parquet").count()

    store = warehouse.store
    first = store.entries()
    shown = dict(tuples(refresh.refresh_all(warehouse)))
    assert set(refresh.DASHBOARD) | set(refresh.CHURN_PAGE) | set(refresh.PAIR_PAGE) == set(shown)
    assert len(refresh.DASHBOARD) == 18 and shown["churn_counts"] == 3 and shown["top_clv"] == 10
    assert store.entries() == first, "fresh results are kept"
    assert None not in shown.values()
    assert sorted(tuples(store.read("dept"))) == sorted(tuples(dashboard.dept(warehouse.star)))

    now = utc_now()
    assert refresh.is_fresh(warehouse, now)
    assert not refresh.is_fresh(warehouse, now + dt.timedelta(seconds=refresh.MAX_AGE_SECONDS))

    later = now + dt.timedelta(seconds=refresh.MAX_AGE_SECONDS)
    refresh.refresh_all(warehouse, later)
    second = store.entries()
    assert second["dept"].path != first["dept"].path
    assert second["model:clv"].path == first["model:clv"].path, "models follow the load, not the clock"

    warehouse.load(fixture.typed_tables(spark, SF))
    assert not refresh.is_fresh(warehouse, utc_now())
    assert not any(warehouse.is_current(n) for n in ("features", "model:clv", "predictions", "basket"))

    def fail(_):
        raise RuntimeError("broken summary")

    monkeypatch.setitem(refresh.SUMMARIES, "dept", fail)
    monkeypatch.setattr(refresh, "train", lambda w: None)
    monkeypatch.setattr(refresh, "summary_results", lambda w: {"dept": fail(w)})
    before = store.entries()["dept"]
    with pytest.raises(RuntimeError, match="broken summary"):
        refresh.refresh_all(warehouse)
    assert store.entries()["dept"] == before


def test_incomplete_upload(spark, warehouse):
    raw = fixture.raw_tables(spark, SF) | {"products": None}
    with pytest.raises(IncompleteLoad, match="products"):
        refresh.load_and_refresh(warehouse, raw)
    assert warehouse.entries() == {}


def test_json_records(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, None), ("b", None, 2)], "k string, v double, n int")
    expected = [{"k": "a", "v": 1.5, "n": None}, {"k": "b", "v": None, "n": 2}]
    assert [json.loads(r["json"]) for r in export.as_json(rows).collect()] == expected
    export.write_json(rows.coalesce(1), str(tmp_path / "out"))
    written = spark.read.text(str(tmp_path / "out")).collect()
    assert [json.loads(r["value"]) for r in written] == expected


def test_derived_from_older_purchases_is_not_current(spark, store):
    """Another job loads while this warehouse is open; what it derives then is of the old tables."""
    tables = fixture.typed_tables(spark, SF)
    old = Warehouse(store)
    old.load(tables)
    assert old.star.transactions.count() > 0
    households = tables["households"].filter("HSHD_NUM % 2 = 0")
    fewer = tables | {"transactions": tables["transactions"].filter("HSHD_NUM % 2 = 0"), "households": households}
    new = Warehouse(store)
    new.load(fewer)
    stale = old.features().count()
    assert tuples(new.status(["features"])) == [("features", False)]
    reader = Warehouse(store)
    assert not reader.is_current("features")
    assert reader.features().count() < stale
    assert tuples(reader.status(["features", "nothing"])) == [("features", True), ("nothing", False)]


def test_every_result_counts_for_freshness(spark, warehouse):
    refresh.load_and_refresh(warehouse, fixture.raw_tables(spark, SF))
    for name in ("churn_report", "basket_model"):
        assert refresh.is_fresh(warehouse)
        warehouse.store.write({name: warehouse.store.read(name)}, "another load")
        assert not refresh.is_fresh(warehouse)
        warehouse.write({name: warehouse.store.read(name)})


@pytest.mark.parametrize("households", [0, 1])
def test_too_little_to_train_on(spark, warehouse, households):
    """The summaries are there all the same; the model results are absent."""
    typed = fixture.typed_tables(spark, SF)
    key = 999 if households == 0 else next(
        k for k in range(1, 50) if not spark.range(1).filter(models.is_training(F.lit(k).cast("bigint"))).count()
        and typed["transactions"].filter(f"HSHD_NUM = {k}").count()
    )
    warehouse.load({t: df.filter(f"HSHD_NUM = {key}") if t != "products" else df for t, df in typed.items()})
    shown = dict(tuples(refresh.refresh_all(warehouse)))
    assert set(shown) == set(refresh.RESULTS)
    assert all(shown[n] is not None for n in refresh.SUMMARIES)
    assert all(shown[n] is None for n in (*refresh.SCORED, *refresh.CHURN_PAGE))
    assert refresh.is_fresh(warehouse)


def test_manifests_are_compacted(spark, store):
    for _ in range(4):
        store.write({"a": spark.range(3)})
    store.write({"b": spark.range(2)}, "x")
    before = store.entries()
    assert store.delete_old(utc_now()) == 3
    assert store.entries() == before
    assert store._manifest().count() == 2
    store.write({"a": spark.range(1)})
    assert store.read("a").count() == 1 and store.entries()["b"].source == "x"
