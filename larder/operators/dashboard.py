"""The fourteen dashboard summaries, their headline figures and their pivots.

Every sum runs over DECIMAL, so results do not depend on row order, and is shown
as a double. Summaries that only add up spend reduce the lines to one row per
product first when the product table is too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.functions.expressions import (
    children_status,
    not_missing,
    organic_label,
    ratio,
    season,
)
from larder.functions.labels import SEASONS, season_dim
from larder.operators.joins import join_dimension
from larder.sources.star import Star


# Columns of the dimensions that summaries group by.
PRODUCT_NAMES = ("DEPARTMENT", "COMMODITY", "BRAND_TY", "NATURAL_ORGANIC_FLAG")
HOUSEHOLD_NAMES = ("INCOME_RANGE", "HH_SIZE", "CHILDREN")


def _money(total: Column) -> Column:
    return total.cast("double")


def _sum(name: str) -> Column:
    return _money(F.sum("SPEND")).alias(name)


def _avg_spend() -> Column:
    """Spend per distinct basket."""
    return ratio(F.sum("SPEND"), F.count_distinct("BASKET_NUM")).alias("avg_spend")


def _households(name: str) -> Column:
    return F.count_distinct("HSHD_NUM").alias(name)


def _with_households(star: Star, fact: DataFrame, *columns: Column | str) -> DataFrame:
    dim = star.households.select("HSHD_NUM", *columns)
    return join_dimension(fact, dim, "HSHD_NUM", star.households_can(dim))


def _with_products(star: Star, fact: DataFrame, *columns: Column | str) -> DataFrame:
    dim = star.products.select("PRODUCT_NUM", *columns)
    return join_dimension(fact, dim, "PRODUCT_NUM", star.products_can(dim))


def product_weeks(star: Star) -> DataFrame:
    """SPEND and LINES per product, year and week: what five summaries add up further."""
    return star.transactions.groupBy("PRODUCT_NUM", "YEAR", "WEEK_NUM").agg(
        F.sum("SPEND").alias("SPEND"), F.count(F.lit(1)).alias("LINES")
    )


def name_weeks(star: Star, weeks: DataFrame) -> DataFrame:
    """`product_weeks` by the columns that four summaries group by, joined with the products once."""
    names = ("DEPARTMENT", "COMMODITY", "BRAND_TY")
    return _with_products(star, weeks, *names).groupBy(*names, "YEAR", "WEEK_NUM").agg(
        F.sum("SPEND").alias("SPEND"), F.sum("LINES").alias("LINES")
    )


def named_lines(star: Star) -> DataFrame:
    """Household, spend and the product columns of every line: what three summaries start from."""
    lines = star.transactions.select("PRODUCT_NUM", "HSHD_NUM", "SPEND")
    return _with_products(star, lines, "DEPARTMENT", "BRAND_TY", "NATURAL_ORGANIC_FLAG").drop("PRODUCT_NUM")


def household_baskets(star: Star, *columns: Column | str) -> DataFrame:
    """SPEND per household and basket, beside columns of the household.

    A basket's lines lie together, so they are summed before anything moves.
    """
    baskets = star.transactions.groupBy("HSHD_NUM", "BASKET_NUM").agg(F.sum("SPEND").alias("SPEND"))
    return _with_households(star, baskets, *columns)


def known_baskets(star: Star) -> DataFrame:
    """`household_baskets` with the columns that three summaries group by."""
    return household_baskets(star, *HOUSEHOLD_NAMES)


def _baskets(star: Star, column: str, shared: DataFrame | None) -> DataFrame:
    """A household column beside HSHD_NUM, BASKET_NUM and SPEND; single lines when households are broadcast."""
    if shared is not None:
        return shared
    if star.households_can(star.households.select("HSHD_NUM", column)):
        lines = star.transactions.select("HSHD_NUM", "BASKET_NUM", "SPEND")
        return _with_households(star, lines, column)
    return household_baskets(star, column)


def _spend_by(star: Star, name: str, *keys: str, shared: DataFrame | None = None) -> DataFrame:
    """A product column, keys, SPEND and LINES, to be summed further.

    From the written `product_weeks` or `name_weeks` where they are given, else from the lines.

    One row per line when products are broadcast; else summed per product before
    the join, which then moves a row per product and key and meets no hot product.
    """
    if shared is not None:
        return shared if name in shared.columns else _with_products(star, shared, name)
    lines = star.transactions.select("PRODUCT_NUM", *keys, "SPEND")
    if star.products_can(star.products.select("PRODUCT_NUM", name)):
        return _with_products(star, lines.withColumn("LINES", F.lit(1)), name)
    sums = lines.groupBy("PRODUCT_NUM", *keys).agg(
        F.sum("SPEND").alias("SPEND"), F.count(F.lit(1)).alias("LINES")
    )
    return sums.join(star.products.select("PRODUCT_NUM", name), "PRODUCT_NUM")


# Summaries -------------------------------------------------------------------


def income(star: Star, shared: DataFrame | None = None) -> DataFrame:
    rows = _baskets(star, "INCOME_RANGE", shared).filter(not_missing("INCOME_RANGE"))
    return (
        rows.groupBy("INCOME_RANGE")
        .agg(_avg_spend(), _households("hh_count"))
        .orderBy(F.desc("avg_spend"), "INCOME_RANGE")
    )


def hhsize(star: Star, shared: DataFrame | None = None) -> DataFrame:
    rows = _baskets(star, "HH_SIZE", shared).filter(not_missing("HH_SIZE"))
    return rows.groupBy("HH_SIZE").agg(_avg_spend()).orderBy("HH_SIZE")


def children(star: Star, shared: DataFrame | None = None) -> DataFrame:
    rows = _baskets(star, "CHILDREN", shared).withColumn("children_status", children_status("CHILDREN"))
    return rows.groupBy("children_status").agg(_avg_spend(), _households("hh_count"))


def region(star: Star) -> DataFrame:
    return (
        star.transactions.filter(not_missing("STORE_R"))
        .groupBy("STORE_R")
        .agg(_sum("total_spend"), _households("unique_hh"))
        .orderBy(F.desc("total_spend"), "STORE_R")
    )


def weekly(star: Star, shared: DataFrame | None = None) -> DataFrame:
    lines = star.transactions if shared is None else shared
    return lines.groupBy("WEEK_NUM", "YEAR").agg(_sum("spend")).orderBy("YEAR", "WEEK_NUM")


def dept_year(star: Star, shared: DataFrame | None = None) -> DataFrame:
    return (
        _spend_by(star, "DEPARTMENT", "YEAR", shared=shared)
        .filter(F.col("YEAR").isNotNull())
        .groupBy("DEPARTMENT", "YEAR")
        .agg(_sum("total_spend"))
        .orderBy("YEAR", F.desc("total_spend"), "DEPARTMENT")
    )


def seasonal(star: Star) -> DataFrame:
    return (
        star.transactions.filter(F.col("WEEK_NUM").isNotNull())
        .groupBy(season("WEEK_NUM").alias("season"))
        .agg(_sum("total_spend"), _avg_spend(), _households("unique_hh"))
    )


def seasonal_commodity(star: Star, shared: DataFrame | None = None) -> DataFrame:
    """Spend per season and department; the first 20 by season name, then spend."""
    return (
        _spend_by(star, "DEPARTMENT", "WEEK_NUM", shared=shared)
        .filter(F.col("WEEK_NUM").isNotNull())
        .groupBy(season("WEEK_NUM").alias("season"), "DEPARTMENT")
        .agg(_sum("total_spend"))
        .orderBy("season", F.desc("total_spend"), "DEPARTMENT")
        .limit(20)
    )


def brand(star: Star, shared: DataFrame | None = None) -> DataFrame:
    return (
        _spend_by(star, "BRAND_TY", shared=shared)
        .filter(not_missing("BRAND_TY"))
        .groupBy("BRAND_TY")
        .agg(_sum("total_spend"), F.sum("LINES").alias("transaction_count"))
    )


def _lines_with(star: Star, name: str, shared: DataFrame | None) -> DataFrame:
    """A product column beside HSHD_NUM and SPEND of every line, from `named_lines` where given."""
    if shared is not None:
        return shared
    return _with_products(star, star.transactions.select("PRODUCT_NUM", "HSHD_NUM", "SPEND"), name)


def organic(star: Star, shared: DataFrame | None = None) -> DataFrame:
    return (
        _lines_with(star, "NATURAL_ORGANIC_FLAG", shared)
        .filter(not_missing("NATURAL_ORGANIC_FLAG"))
        .groupBy("NATURAL_ORGANIC_FLAG")
        .agg(_sum("total_spend"), _households("buyers"))
    )


def brand_income(star: Star, shared: DataFrame | None = None) -> DataFrame:
    brands = _lines_with(star, "BRAND_TY", shared).filter(not_missing("BRAND_TY"))
    if star.households_can(star.households.select("HSHD_NUM", "INCOME_RANGE")):
        rows = _with_households(star, brands, "INCOME_RANGE")
    else:
        sums = brands.groupBy("HSHD_NUM", "BRAND_TY").agg(F.sum("SPEND").alias("SPEND"))
        rows = sums.join(star.households.select("HSHD_NUM", "INCOME_RANGE"), "HSHD_NUM")
    return (
        rows.filter(not_missing("INCOME_RANGE"))
        .groupBy("INCOME_RANGE", "BRAND_TY")
        .agg(_sum("total_spend"))
        .orderBy("INCOME_RANGE", "BRAND_TY")
    )


def dept(star: Star, shared: DataFrame | None = None) -> DataFrame:
    return (
        _lines_with(star, "DEPARTMENT", shared)
        .groupBy("DEPARTMENT")
        .agg(_sum("total_spend"), _households("unique_households"))
        .orderBy(F.desc("total_spend"), "DEPARTMENT")
    )


def _commodity_spend(star: Star, shared: DataFrame | None = None) -> DataFrame:
    return _spend_by(star, "COMMODITY", shared=shared).groupBy("COMMODITY").agg(_sum("total_spend"))


def commodity(star: Star, shared: DataFrame | None = None) -> DataFrame:
    return _commodity_spend(star, shared).orderBy(F.desc("total_spend"), "COMMODITY").limit(10)


FROM_PRODUCT_WEEKS = {
    "weekly": weekly,
    "dept_year": dept_year,
    "seasonal_commodity": seasonal_commodity,
    "brand": brand,
    "commodity": commodity,
}
FROM_NAMED_LINES = {"organic": organic, "brand_income": brand_income, "dept": dept}
FROM_BASKETS = {"income": income, "hhsize": hhsize, "children": children}


# Headline figures and display forms ------------------------------------------


def top_name(ranked: DataFrame, name: str) -> DataFrame:
    """Name of the row with the largest spend as one row, 'N/A' when there is none.

    A tie goes to the alphabetically first name.
    """
    first = F.min_by(name, F.struct(-F.col("total_spend"), F.col(name)))
    return ranked.agg(F.coalesce(first, F.lit("N/A")).alias(name))


def kpi_top_department(star: Star) -> DataFrame:
    rows = _spend_by(star, "DEPARTMENT").groupBy("DEPARTMENT").agg(_sum("total_spend"))
    return top_name(rows, "DEPARTMENT")


def kpi_top_commodity(star: Star) -> DataFrame:
    return top_name(_commodity_spend(star), "COMMODITY")


def weekly_labels(weeks: DataFrame) -> DataFrame:
    """Axis label 'W<week> <year>' beside the spend of `weekly`."""
    return weeks.select(
        F.format_string("W%d %d", "WEEK_NUM", "YEAR").alias("label"), "spend"
    )


def organic_labelled(flags: DataFrame) -> DataFrame:
    """`organic` with every flag but 'Y' shown as Non-Organic."""
    return flags.select(organic_label("NATURAL_ORGANIC_FLAG").alias("label"), *flags.columns)


def seasonal_ordered(seasons: DataFrame) -> DataFrame:
    """Four rows in calendar order; a season without sales shows 0."""
    return (
        season_dim(seasons.sparkSession)
        .join(seasons.select("season", "total_spend"), "season", "left")
        .select("season_order", "season", F.coalesce("total_spend", F.lit(0.0)).alias("total_spend"))
        .orderBy("season_order")
    )


def in_order(rows: DataFrame) -> DataFrame:
    """The place of each row of an ordered summary, as the summary orders it."""
    numbered = rows.withColumn("id", F.monotonically_increasing_id())
    place = F.row_number().over(W.orderBy("id")).cast("bigint")
    return numbered.select(place.alias("place"), *rows.columns)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Displayed rank 1..n of a top-n list (never more than its few rows)."""
    rank = F.row_number().over(W.orderBy(*order)).cast("bigint")
    return rows.select(rank.alias("rank"), *rows.columns)


def bottom_up(rows: DataFrame) -> DataFrame:
    """A ranked list in reverse, as horizontal bars are drawn: place 1 is the last rank."""
    place = F.row_number().over(W.orderBy(F.desc("rank"))).cast("bigint")
    return rows.select(place.alias("place"), *rows.columns).orderBy("place")


# Pivots ----------------------------------------------------------------------


def pivot_spend(cells: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Rows by the given, fixed columns of total_spend, 0 where there is no cell.

    `cells` is a summary, one row per cell. Cells are filled by place, so that a value may
    be any text.
    """
    table = cells.groupBy(row).pivot(column, values).agg(F.first("total_spend"))
    places = table.toDF(row, *[f"cell_{i}" for i in range(len(values))])
    filled = [F.coalesce(f"cell_{i}", F.lit(0.0)).alias(v) for i, v in enumerate(values)]
    return places.select(row, *filled).orderBy(row)


def grid(cells: DataFrame, row: str, column: str) -> DataFrame:
    """The dense grid of a summary in long form: row, column, total_spend, 0 where there is no cell.

    Column values are data here and may be any texts, also ones that differ in case only.
    NULL makes a row of the grid, but no column.
    """
    known = cells.filter(F.col(column).isNotNull())
    values = known.agg(F.sort_array(F.collect_set(column))).scalar()
    by_row = cells.groupBy(row).agg(
        F.map_from_entries(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(column, "total_spend")))).alias("cells")
    )
    full = by_row.select(row, "cells", F.explode(values).alias(column))
    return full.select(
        row, column, F.coalesce(F.try_element_at("cells", F.col(column)), F.lit(0.0)).alias("total_spend")
    ).orderBy(row, column)


def dept_year_pivot(cells: DataFrame) -> DataFrame:
    return grid(cells, "DEPARTMENT", "YEAR")


def seasonal_dept_pivot(cells: DataFrame) -> DataFrame:
    return pivot_spend(cells, "DEPARTMENT", "season", list(SEASONS))


def brand_income_pivot(cells: DataFrame) -> DataFrame:
    return grid(cells, "INCOME_RANGE", "BRAND_TY")
