import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from larder.session import build_session
from larder.sources import schema
from larder.sources.star import Star
from larder.sources.store import Store, storage_root

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def frame(spark, table, rows):
    """A clean table from tuples or dicts; absent columns are NULL."""
    columns = schema.TABLES[table]
    ddl = ", ".join(f"{c} {k}" for c, k in columns.items())
    full = [tuple(r.get(c) for c in columns) if isinstance(r, dict) else r for r in rows]
    return spark.createDataFrame(full, ddl)


def line(basket, household, product, spend, **more):
    row = dict(
        BASKET_NUM=basket,
        HSHD_NUM=household,
        PRODUCT_NUM=product,
        SPEND=None if spend is None else Decimal(str(spend)).quantize(Decimal("0.01")),
        UNITS=1,
        STORE_R="EAST",
        PURCHASE_DATE=dt.date(2020, 1, 1),
        WEEK_NUM=1,
        YEAR=2020,
    )
    return row | more


@pytest.fixture
def make_star(spark):
    def make(lines, households=(), products=(), **options):
        return Star.of(
            frame(spark, "transactions", lines),
            frame(spark, "households", list(households)),
            frame(spark, "products", list(products)),
            **options,
        )

    return make


@pytest.fixture
def store(spark, tmp_path):
    storage_root(spark)
    return Store(spark, str(tmp_path / "store"))


def tuples(df):
    return [tuple(r) for r in df.collect()]


def text_frame(spark, columns, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in columns]))
