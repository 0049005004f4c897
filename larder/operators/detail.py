"""Paged purchase detail of one household or of all."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.joins import join_dimension
from larder.operators.paging import NEAR_ROWS, SORT_ROWS, order_by, page_of
from larder.sources.star import Star, is_small
from larder.sources.store import storage_root

PAGE_SIZE = 100

# Columns a caller may sort by; anything else means HSHD_NUM.
SORTABLE = (
    "HSHD_NUM", "BASKET_NUM", "PURCHASE_DATE", "PRODUCT_NUM",
    "DEPARTMENT", "COMMODITY", "SPEND", "UNITS",
)

# The columns of a detail row in order.
COLUMNS = (
    "HSHD_NUM", "BASKET_NUM", "PURCHASE_DATE", "PRODUCT_NUM", "DEPARTMENT", "COMMODITY",
    "SPEND", "UNITS", "STORE_R", "WEEK_NUM", "YEAR", "L", "AGE_RANGE", "MARITAL",
    "INCOME_RANGE", "HOMEOWNER", "HSHD_COMPOSITION", "HH_SIZE", "CHILDREN",
)

# A purchase line has no number of its own; these make the order total.
TIE_BREAK = (
    "HSHD_NUM", "BASKET_NUM", "PRODUCT_NUM", "SPEND", "UNITS", "STORE_R",
    "PURCHASE_DATE", "WEEK_NUM", "YEAR",
)

PRODUCT_COLUMNS = ("DEPARTMENT", "COMMODITY")


def sort_column(name: str) -> str:
    return name if name in SORTABLE else "HSHD_NUM"


def household_lines(star: Star, household: int | str | None) -> DataFrame:
    """Lines of one household, '0010' being 10, or of all when None."""
    if household is None:
        return star.transactions
    return star.transactions.filter(F.col("HSHD_NUM") == int(household))


def _columns(name: str) -> list[str]:
    return [name, *[c for c in TIE_BREAK if c != name]]


def _sortable_lines(star: Star, household: int | str | None, name: str) -> DataFrame:
    lines = household_lines(star, household)
    if name not in PRODUCT_COLUMNS:
        return lines
    names = star.products.select("PRODUCT_NUM", name)
    return join_dimension(lines, names, "PRODUCT_NUM", star.products_fit, "left")


def _describe(star: Star, page: DataFrame, order: list[Column]) -> DataFrame:
    """Add product and household columns to the rows of one page, found beforehand.

    A dimension too large to broadcast is cut down to the page's few keys first;
    the page is then written out once so that finding it is not repeated.
    """
    page = page.drop(*PRODUCT_COLUMNS)
    if not (star.products_fit and star.households_fit):
        storage_root(page.sparkSession)
        page = page.checkpoint()
    for dim, key, fits in (
        (star.products, "PRODUCT_NUM", star.products_fit),
        (star.households, "HSHD_NUM", star.households_fit),
    ):
        wanted = dim.select([c for c in dim.columns if c in COLUMNS])
        if not fits:
            keys = page.select(key)
            wanted = wanted.join(F.broadcast(keys) if is_small(keys) else keys, key, "left_semi")
            fits = is_small(wanted)
        page = page.join(F.broadcast(wanted) if fits else wanted, key, "left")
    return page.select(*COLUMNS).orderBy(*order)


def household_detail(
    star: Star,
    household: int | str | None = 10,
    sort: str = "HSHD_NUM",
    descending: bool = False,
    page: int = 1,
    page_size: int = PAGE_SIZE,
    sort_rows: int = SORT_ROWS,
    near: int = NEAR_ROWS,
) -> DataFrame:
    """One page of detail rows; lines without a known product or household stay."""
    if page < 1:
        raise ValueError("page starts at 1")
    name = sort_column(sort)
    lines = _sortable_lines(star, household, name)
    rows = page_of(lines, _columns(name), descending, (page - 1) * page_size, page_size, sort_rows, near)
    return _describe(star, rows, order_by(_columns(name), descending))


def _after(name: str, descending: bool, last: Mapping[str, object]) -> Column:
    """Rows strictly behind `last` in the page order (NULL first, or last when descending)."""
    behind = F.lit(False)
    same = F.lit(True)
    for c in _columns(name):
        col, value = F.col(c), last[c]
        down = descending and c == name
        if value is None:
            step = F.lit(False) if down else col.isNotNull()
        else:
            step = (col < F.lit(value)) | col.isNull() if down else col > F.lit(value)
        behind = behind | (same & F.coalesce(step, F.lit(False)))
        same = same & col.eqNullSafe(F.lit(value))
    return behind


def _from(name: str, descending: bool, last: Mapping[str, object]) -> Column:
    """Rows whose sort column alone may stand behind `last`: a plain filter for the scan."""
    col, value = F.col(name), last[name]
    if value is None:
        return col.isNull() if descending else F.lit(True)
    return (col <= F.lit(value)) | col.isNull() if descending else col >= F.lit(value)


def household_detail_after(
    star: Star,
    last: Mapping[str, object],
    household: int | str | None = 10,
    sort: str = "HSHD_NUM",
    descending: bool = False,
    page_size: int = PAGE_SIZE,
    sort_rows: int = SORT_ROWS,
) -> DataFrame:
    """The page behind a given detail row."""
    name = sort_column(sort)
    lines = _sortable_lines(star, household, name).filter(_from(name, descending, last) & _after(name, descending, last))
    rows = page_of(lines, _columns(name), descending, 0, page_size, sort_rows)
    return _describe(star, rows, order_by(_columns(name), descending))


def detail_count(star: Star, household: int | str | None = 10) -> DataFrame:
    """Lines behind a detail listing, counted without its joins."""
    return household_lines(star, household).agg(F.count(F.lit(1)).alias("cnt"))


def detail_pages(star: Star, household: int | str | None = 10, page_size: int = PAGE_SIZE) -> DataFrame:
    total = detail_count(star, household).withColumnRenamed("cnt", "total")
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("bigint")
    return total.select("total", pages.alias("total_pages"))


