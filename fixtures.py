"""The retail tables as views over the test tables (see FIXTURES.md).

The same SELECT texts serve Spark, with frames in place of the names in braces,
and the checking SQL, with table names there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOUSEHOLDS = """
SELECT c_custkey AS HSHD_NUM,
 CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END AS L,
 CASE WHEN c_custkey % 11 = 0 THEN 'null' ELSE c_mktsegment END AS AGE_RANGE,
 CASE WHEN c_custkey % 3 = 0 THEN 'Married' WHEN c_custkey % 3 = 1 THEN 'Single' ELSE 'null' END AS MARITAL,
 CASE WHEN c_custkey % 13 = 0 THEN 'null' WHEN c_acctbal < 0 THEN 'UNDER 35K' WHEN c_acctbal < 2500 THEN '35-49K'
      WHEN c_acctbal < 5000 THEN '50-74K' WHEN c_acctbal < 7500 THEN '75-99K' ELSE '100-150K' END AS INCOME_RANGE,
 CASE WHEN c_custkey % 4 = 0 THEN 'Renter' ELSE 'Homeowner' END AS HOMEOWNER,
 CASE WHEN c_custkey % 5 = 0 THEN '1 Adult' WHEN c_custkey % 5 IN (1, 2) THEN '2 Adults'
      ELSE '2 Adults and Kids' END AS HSHD_COMPOSITION,
 CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_nationkey % 5 = 4 THEN '5+'
      ELSE CAST(c_nationkey % 5 + 1 AS VARCHAR(2)) END AS HH_SIZE,
 CASE WHEN c_custkey % 7 = 0 THEN 'null' WHEN c_custkey % 7 = 1 THEN NULL WHEN c_custkey % 7 = 2 THEN '0'
      WHEN c_custkey % 7 = 3 THEN '1' WHEN c_custkey % 7 = 4 THEN '3' ELSE 'Y' END AS CHILDREN
FROM {customer}
"""

PRODUCTS = """
SELECT p_partkey AS PRODUCT_NUM, p_type AS DEPARTMENT,
 CASE WHEN p_partkey % 97 = 0 THEN 'null' ELSE p_name END AS COMMODITY,
 CASE WHEN p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5') THEN 'PRIVATE'
      WHEN p_partkey % 89 = 0 THEN NULL ELSE 'NATIONAL' END AS BRAND_TY,
 CASE WHEN p_partkey % 10 = 0 THEN 'Y' WHEN p_partkey % 83 = 0 THEN '' ELSE 'N' END AS NATURAL_ORGANIC_FLAG
FROM {part}
"""

TRANSACTIONS = """
SELECT l.l_orderkey AS BASKET_NUM, o.o_custkey AS HSHD_NUM, CAST(o.o_orderdate AS DATE) AS PURCHASE_DATE,
 l.l_partkey AS PRODUCT_NUM, CAST(l.l_extendedprice AS DECIMAL(20,4)) AS SPEND, CAST(l.l_quantity AS INT) AS UNITS,
 r.r_name AS STORE_R, CAST(floor((dayofyear(o.o_orderdate) - 1) / 7) AS INT) + 1 AS WEEK_NUM,
 CAST(year(o.o_orderdate) AS INT) AS YEAR
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

RAW_HOUSEHOLDS = """
SELECT CASE WHEN HSHD_NUM % 3 = 0 THEN lpad(CAST(HSHD_NUM AS VARCHAR(20)), 10, '0')
            ELSE CAST(HSHD_NUM AS VARCHAR(20)) END AS HSHD_NUM,
 concat(L, ' ') AS L, CASE WHEN AGE_RANGE = 'null' THEN 'null   ' ELSE AGE_RANGE END AS AGE_RANGE, MARITAL,
 CASE WHEN INCOME_RANGE = 'null' THEN 'NULL ' ELSE INCOME_RANGE END AS INCOME_RANGE,
 HOMEOWNER, HSHD_COMPOSITION, HH_SIZE, CHILDREN
FROM {households}
"""

RAW_PRODUCTS = """
SELECT CASE WHEN PRODUCT_NUM % 2 = 0 THEN lpad(CAST(PRODUCT_NUM AS VARCHAR(20)), 10, '0')
            ELSE CAST(PRODUCT_NUM AS VARCHAR(20)) END AS PRODUCT_NUM,
 DEPARTMENT, concat(COMMODITY, '  ') AS COMMODITY, BRAND_TY, NATURAL_ORGANIC_FLAG
FROM {products}
"""

RAW_TRANSACTIONS = """
SELECT CAST(BASKET_NUM AS VARCHAR(20)) AS BASKET_NUM,
 CASE WHEN HSHD_NUM % 5 = 0 THEN concat(' ', CAST(HSHD_NUM AS VARCHAR(20)))
      ELSE lpad(CAST(HSHD_NUM AS VARCHAR(20)), 10, '0') END AS HSHD_NUM,
 CAST(PURCHASE_DATE AS VARCHAR(10)) AS PURCHASE_, CAST(PRODUCT_NUM AS VARCHAR(20)) AS PRODUCT_NUM,
 CAST(SPEND AS VARCHAR(20)) AS SPEND, CAST(UNITS AS VARCHAR(20)) AS UNITS, STORE_R,
 CASE WHEN WEEK_NUM < 10 THEN concat('0', CAST(WEEK_NUM AS VARCHAR(2)))
      ELSE CAST(WEEK_NUM AS VARCHAR(2)) END AS WEEK_NUM,
 CAST(YEAR AS VARCHAR(4)) AS YEAR
FROM {transactions}
"""

# Some values that no type reads, as an upload may hold them.
DIRTY_TRANSACTIONS = """
SELECT BASKET_NUM, HSHD_NUM,
 CASE WHEN CAST(BASKET_NUM AS BIGINT) % 7 = 0 THEN '43336' ELSE PURCHASE_ END AS PURCHASE_, PRODUCT_NUM,
 CASE WHEN CAST(PRODUCT_NUM AS BIGINT) % 11 = 0 THEN concat('$', SPEND)
      WHEN CAST(PRODUCT_NUM AS BIGINT) % 11 = 1 THEN concat('123456', SPEND) ELSE SPEND END AS SPEND,
 CASE WHEN CAST(PRODUCT_NUM AS BIGINT) % 13 = 0 THEN concat(UNITS, '.0') ELSE UNITS END AS UNITS, STORE_R, WEEK_NUM, YEAR
FROM {raw_transactions}
"""

# Brands that differ in case only, or hold a dot.
ODD_PRODUCTS = """
SELECT PRODUCT_NUM, DEPARTMENT, COMMODITY, CASE PRODUCT_NUM % 4 WHEN 0 THEN 'NO. 1' WHEN 1 THEN 'Private' WHEN 2 THEN 'PRIVATE'
 ELSE BRAND_TY END AS BRAND_TY, NATURAL_ORGANIC_FLAG
FROM {products}
"""

SOURCE_TABLES = ("customer", "part", "lineitem", "orders", "supplier", "nation", "region")


def _fill(spark: SparkSession, text: str, frames: dict[str, DataFrame]) -> DataFrame:
    return spark.sql(text, **{n: df for n, df in frames.items() if f"{{{n}}}" in text})


def typed_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """transactions, products, households as lazy views over the test tables."""
    source = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCE_TABLES}
    # A task holds its share of the orders, so that no lines are sorted (and spilled) for the join.
    source["orders"] = source["orders"].hint("shuffle_hash")
    return {
        "transactions": _fill(spark, TRANSACTIONS, source),
        "products": _fill(spark, PRODUCTS, source),
        "households": _fill(spark, HOUSEHOLDS, source),
    }


def odd_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fill(spark, ODD_PRODUCTS, typed_tables(spark, sf_dir))


def dirty_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The raw tables with unreadable values among the purchases."""
    raw = raw_tables(spark, sf_dir)
    return raw | {"transactions": _fill(spark, DIRTY_TRANSACTIONS, {"raw_transactions": raw["transactions"]})}


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same tables as uploaded text: padded keys, padded and upper-case 'null'."""
    typed = typed_tables(spark, sf_dir)
    return {
        "transactions": _fill(spark, RAW_TRANSACTIONS, typed),
        "products": _fill(spark, RAW_PRODUCTS, typed),
        "households": _fill(spark, RAW_HOUSEHOLDS, typed),
    }
