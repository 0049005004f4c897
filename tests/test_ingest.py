import datetime as dt
from decimal import Decimal
from types import SimpleNamespace

import pytest

import fixtures
from larder.functions.expressions import date_or_null
from larder.plans import refresh
from larder.plans.warehouse import Warehouse
from larder.sources import ingest, readers, schema
from larder.sources.star import Star
from larder.sources.store import utc_now
from tests.conftest import SF, frame, line, text_frame, tuples

HOUSEHOLD_HEADER = "HSHD_NUM ,L,AGE_RANGE,MARITAL,INCOME_RANGE,HOMEOWNER,HSHD_COMPOSITION,HH_SIZE,CHILDREN"


def write(path, *rows):
    path.write_text("\n".join(rows) + "\n")
    return str(path)


@pytest.fixture
def files(tmp_path):
    return {
        "transactions": write(
            tmp_path / "t.csv",
            " BASKET_NUM,HSHD_NUM ,PURCHASE_,PRODUCT_NUM,SPEND,UNITS,STORE_R,WEEK_NUM,YEAR",
            "7,0010,24-AUG-18,0005,1.005,2,EAST ,05,2018",
            "8, 11 ,2018-08-25,6,null,x,,,2018",
            '9,"12",bad,6,-3.50,1,"WE""ST, N",10.0,2018',
        ),
        "products": write(
            tmp_path / "p.csv",
            "COMMODITY,PRODUCT_NUM,DEPARTMENT,BRAND_TY,NATURAL_ORGANIC_FLAG,EXTRA",
            "MILK  ,0005,FOOD,PRIVATE,Y,1",
            "null,6,FOOD,,N,2",
        ),
        "households": write(
            tmp_path / "h.csv", HOUSEHOLD_HEADER, "0010,Y ,null   ,Single,NULL ,Renter,x,1,Y", "11,N,19,M,NULL,O,y,2,1"
        ),
    }


def raw(spark, files):
    return {t: readers.read_csv(spark, p) for t, p in files.items()}


def cleaned(spark, files, table):
    return ingest.clean(table, ingest.bronze(readers.read_csv(spark, files[table])))


def test_clean_transactions(spark, files):
    df = cleaned(spark, files, "transactions")
    assert dict(df.dtypes)["SPEND"] == "decimal(20,4)"
    assert tuples(df) == [
        (7, 10, dt.date(2018, 8, 24), 5, Decimal("1.005"), 2, "EAST", 5, 2018),
        (8, 11, dt.date(2018, 8, 25), 6, None, None, None, None, 2018),
        (9, 12, None, 6, Decimal("-3.50"), 1, 'WE"ST, N', None, 2018),
    ]
    bronze = ingest.bronze(readers.read_csv(spark, files["transactions"]))
    assert tuples(ingest.unreadable_counts("transactions", bronze)) == [(0, 0, 1, 0, 0, 1, 1, 0)]


def test_columns_go_by_name_and_padding_goes(spark, files):
    assert tuples(cleaned(spark, files, "products")) == [
        (5, "FOOD", "MILK", "PRIVATE", "Y"),
        (6, "FOOD", None, None, "N"),
    ]
    households = cleaned(spark, files, "households").collect()
    assert households[0]["HSHD_NUM"] == 10
    assert (households[0]["AGE_RANGE"], households[0]["INCOME_RANGE"]) == ("null", "NULL")
    assert households[1]["INCOME_RANGE"] is None


def test_absent_column(spark):
    with pytest.raises(ValueError, match="DEPARTMENT"):
        ingest.clean("products", text_frame(spark, ["PRODUCT_NUM"], [("1",)]))


def test_files_with_other_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "a.csv", "A,B", "1,2")
    write(folder / "b.csv", "B,A", "3,4")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(folder)).collect()


def test_load_and_replace(spark, store, files):
    warehouse = Warehouse(store)
    clean = {t: cleaned(spark, files, t) for t in files}
    assert tuples(warehouse.load(clean)) == [("transactions", 3), ("products", 2), ("households", 2)]
    first = store.entries()
    assert sorted(tuples(store.read("transactions")), key=repr) == sorted(tuples(clean["transactions"]), key=repr)
    assert Star.stored(store).products_fit
    assert not Star.stored(store, broadcast_bytes=10).products_fit

    fewer = clean | {"transactions": clean["transactions"].limit(1)}
    assert tuples(warehouse.load(fewer))[0] == ("transactions", 1)
    assert store.read("transactions").count() == 1

    assert store.delete_old(first["products"].written_at) == 0
    assert store.delete_old(utc_now()) == 3
    assert store.read("products").count() == 2


def test_two_of_three_write_nothing(spark, store, files):
    tables = {t: cleaned(spark, files, t) for t in ("transactions", "products")}
    with pytest.raises(ingest.IncompleteLoad, match="households"):
        Warehouse(store).load(tables)
    assert store.entries() == {}


def test_failed_load_keeps_the_old_tables(spark, store, files):
    warehouse = Warehouse(store)
    clean = {t: cleaned(spark, files, t) for t in files}
    warehouse.load(clean)
    broken = clean["products"].selectExpr(
        "PRODUCT_NUM", "raise_error('bad disk') AS DEPARTMENT", "COMMODITY", "BRAND_TY", "NATURAL_ORGANIC_FLAG"
    )
    with pytest.raises(Exception, match="bad disk"):
        warehouse.load(clean | {"products": broken})
    assert store.read("transactions").count() == 3 and store.read("products").count() == 2


def test_repeated_keys_are_refused(spark, store):
    households = frame(spark, "households", [dict(HSHD_NUM=10, L="Y"), dict(HSHD_NUM=10, L="N"), dict(L="N")])
    tables = {
        "transactions": frame(spark, "transactions", [line(1, 10, 1, 1)]),
        "products": frame(spark, "products", [dict(PRODUCT_NUM=1)]),
        "households": households,
    }
    with pytest.raises(ingest.DuplicateKeys, match="10"):
        Warehouse(store).load(tables)
    kept = ingest.keep_first(households.filter("HSHD_NUM = 10"), "HSHD_NUM")
    assert [(r["HSHD_NUM"], r["L"]) for r in kept.collect()] == [(10, "N")]
    Warehouse(store).load(tables | {"households": kept})


def test_files_are_ordered_by_household(spark, store):
    lines = [line(b, b * 7 % 40, b % 5, 1) for b in range(400)]
    tables = {
        "transactions": frame(spark, "transactions", lines),
        "products": frame(spark, "products", [dict(PRODUCT_NUM=1)]),
        "households": frame(spark, "households", [dict(HSHD_NUM=1)]),
    }
    Warehouse(store).load(tables)
    spans = sorted(
        (min(h), max(h))
        for h in (
            [r["HSHD_NUM"] for r in spark.read.parquet(f).collect()]
            for f in store.read("transactions").inputFiles()
        )
    )
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_copies_of_one_line_spread_over_files(spark, store):
    rows = frame(spark, "transactions", [line(1, 1, 1, 1)] * 3000 + [line(b, b, 1, 1) for b in range(6000)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path, n = store.stage(rows)
        store.write({"transactions": ingest.cluster(spark.read.parquet(path), n)})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = store.read("transactions")
    sizes = [spark.read.parquet(f).count() for f in written.inputFiles()]
    assert sum(sizes) == 9000 and len(sizes) >= 7 and max(sizes) < 2000
    assert written.columns == rows.columns


def test_database_reads_are_partitioned():
    """The reader's arguments only; no database is started."""
    seen = {}
    reader = SimpleNamespace(jdbc=lambda url, table, **options: seen.update(url=url, table=table, **options))
    readers.read_jdbc(SimpleNamespace(read=reader), "jdbc:x", "transactions", "HSHD_NUM", 1, 5000, 16)
    assert (seen["column"], seen["lowerBound"], seen["upperBound"], seen["numPartitions"]) == ("HSHD_NUM", 1, 5000, 16)


@pytest.mark.parametrize(
    "text,expected",
    [("2018-08-24", dt.date(2018, 8, 24)), ("2018-8-4", dt.date(2018, 8, 4)), ("24-AUG-18", dt.date(2018, 8, 24)),
     ("20180824", dt.date(2018, 8, 24)), ("8/24/2018", dt.date(2018, 8, 24)), ("43336", None), ("201808", None), ("2018", None)],
)
def test_dates(spark, text, expected):
    rows = text_frame(spark, ["d"], [(text,)])
    assert rows.select(date_or_null("d")).first()[0] == expected


def test_money_is_held_wide(spark, files, store):
    rows = text_frame(spark, list(schema.TRANSACTIONS), [("1", "1", "2020-01-01", "1", s, "1", "E", "1", "2020") for s in ("123456789.50", "1.005")])
    values = {r["SPEND"] for r in ingest.clean("transactions", rows).collect()}
    assert values == {Decimal("123456789.5"), Decimal("1.005")}


DIRTY = [
    "BASKET_NUM,HSHD_NUM,PURCHASE_,PRODUCT_NUM,SPEND,UNITS,STORE_R,WEEK_NUM,YEAR",
    "1,10,2018-08-24,5,$3.10,1,EAST,34,2018",
    "2,10,43336,5,1.00,2.0,EAST,34,2018",
    "3,10,2018-08-24,5,1.00,1,EAST,34,2018,more",
    "4,10,2018-08-24",
]


def test_rejects_refuse_a_load_unless_permitted(spark, store, files, tmp_path):
    files["transactions"] = write(tmp_path / "dirty.csv", *DIRTY)
    found = {("transactions", "SPEND", 1), ("transactions", "UNITS", 1), ("transactions", "PURCHASE_DATE", 1), ("transactions", "(record)", 2)}
    bronze = {t: ingest.bronze(df) for t, df in raw(spark, files).items()}
    assert set(tuples(ingest.rejects(bronze))) == found
    warehouse = Warehouse(store)
    with pytest.raises(ingest.RejectedValues, match="SPEND: 1"):
        refresh.load(warehouse, raw(spark, files))
    assert store.entries() == {}
    summary, rejected = refresh.load(warehouse, raw(spark, files), permit_rejects=True)
    assert set(tuples(rejected)) == found
    assert tuples(summary)[0] == ("transactions", 4)
    assert store.read("transactions").columns == list(schema.TRANSACTIONS)


def test_keep_first_on_load(spark, store, files, tmp_path):
    files["households"] = write(tmp_path / "twice.csv", HOUSEHOLD_HEADER, "0010,Y,a,M,b,O,y,2,1", "10,N,a,M,b,O,y,2,1")
    files["transactions"] = write(tmp_path / "clean.csv", DIRTY[0], "1,10,2018-08-24,5,3.10,1,EAST,34,2018")
    warehouse = Warehouse(store)
    with pytest.raises(ingest.DuplicateKeys):
        refresh.load(warehouse, raw(spark, files))
    refresh.load(warehouse, raw(spark, files), keep_first=True)
    assert [(r["HSHD_NUM"], r["L"]) for r in store.read("households").collect()] == [(10, "N")]


def test_ranges_follow_from_the_rows(spark, monkeypatch):
    """However few partitions the session shuffles into, no task orders more than its share."""
    monkeypatch.setattr(ingest, "ROWS_PER_RANGE", 100)
    rows = frame(spark, "transactions", [line(b, b, 1, 1) for b in range(3000)])
    assert ingest.cluster(rows, 3000).rdd.getNumPartitions() == 30


def test_purchases_meet_their_orders_without_a_sort(spark, capsys):
    fixtures.typed_tables(spark, SF)["transactions"].explain()
    plan = capsys.readouterr().out
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
