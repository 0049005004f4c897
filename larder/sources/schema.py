"""Columns of the three tables: text as uploaded, typed once cleaned."""

from __future__ import annotations

# Clean types; every column is text in the raw layer.
TRANSACTIONS = {
    "BASKET_NUM": "bigint",
    "HSHD_NUM": "bigint",
    "PURCHASE_DATE": "date",
    "PRODUCT_NUM": "bigint",
    "SPEND": "decimal(20,4)",
    "UNITS": "int",
    "STORE_R": "string",
    "WEEK_NUM": "int",
    "YEAR": "int",
}

HOUSEHOLDS = {
    "HSHD_NUM": "bigint",
    "L": "string",
    "AGE_RANGE": "string",
    "MARITAL": "string",
    "INCOME_RANGE": "string",
    "HOMEOWNER": "string",
    "HSHD_COMPOSITION": "string",
    "HH_SIZE": "string",
    "CHILDREN": "string",
}

PRODUCTS = {
    "PRODUCT_NUM": "bigint",
    "DEPARTMENT": "string",
    "COMMODITY": "string",
    "BRAND_TY": "string",
    "NATURAL_ORGANIC_FLAG": "string",
}

TABLES = {"transactions": TRANSACTIONS, "products": PRODUCTS, "households": HOUSEHOLDS}

KEYS = {"products": "PRODUCT_NUM", "households": "HSHD_NUM"}

# Upload header -> table column.
RENAMES = {"PURCHASE_": "PURCHASE_DATE"}
