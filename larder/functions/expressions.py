"""Column expressions used by more than one job. All stay JVM-side."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts a CSV reader takes as a missing field.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Purchase date formats tried after ISO.
DATE_FORMATS = ("dd-MMM-yy", "M/d/yyyy", "yyyyMMdd")

# Four digits of a year at most: a bare number is no date.
ISO_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c: Column | str) -> Column:
    """Exact missing-value texts become NULL; padded ones stay as they are."""
    c = _col(c)
    return F.when(~c.isin(*NA_TOKENS), c)


def not_missing(c: Column | str) -> Column:
    """Text that is neither NULL, blank nor the word null, whatever its case or padding."""
    c = _col(c)
    return c.isNotNull() & ~F.lower(F.rtrim(c)).isin("null", "")


def number_or_null(c: Column | str) -> Column:
    """Text as a double; NULL when it is no plain decimal number."""
    c = _col(c)
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def date_or_null(c: Column | str) -> Column:
    """ISO first, then the other formats; two-digit years above 49 are 19xx."""
    c = F.trim(_col(c))
    iso = F.when(c.rlike(ISO_PATTERN), c.try_cast("date"))
    short = F.try_to_date(c, DATE_FORMATS[0])
    short = F.when(F.year(short) >= 2050, F.add_months(short, -1200)).otherwise(short)
    rest = [F.try_to_date(c, fmt) for fmt in DATE_FORMATS[1:]]
    return F.coalesce(iso, short, *rest)


def season(week: Column | str) -> Column:
    week = _col(week)
    return (
        F.when(week.between(1, 13), "Spring")
        .when(week.between(14, 26), "Summer")
        .when(week.between(27, 39), "Fall")
        .otherwise("Winter")
    )


def children_status(c: Column | str) -> Column:
    """Dashboard reading of CHILDREN: a count, so 'Y' is no child here."""
    c = _col(c)
    return (
        F.when(c.isNull() | (F.lower(F.rtrim(c)) == "null"), "Unknown")
        .when(number_or_null(c) > 0, "Has Children")
        .otherwise("No Children")
    )


def children_flag(c: Column | str) -> Column:
    """Feature reading of CHILDREN: 1 for 'Y', else 0."""
    return F.coalesce(F.trim(_col(c)) == "Y", F.lit(False)).cast("int")


def organic_label(flag: Column | str) -> Column:
    return F.when(_col(flag) == "Y", "Organic").otherwise("Non-Organic")


def churned(recency: Column | str) -> Column:
    """1 after more than 90 days without a purchase."""
    return (_col(recency) > 90).cast("int")


def risk_segment(probability: Column | str) -> Column:
    """Bins closed on the right: 0.3 is still low, 0.6 still medium."""
    p = _col(probability)
    return (
        F.when((p > -0.1) & (p <= 0.3), "Low Risk")
        .when((p > 0.3) & (p <= 0.6), "Medium Risk")
        .when((p > 0.6) & (p <= 1.0), "High Risk")
    )


def probability_band(probability: Column | str) -> Column:
    p = _col(probability)
    return F.when(p > 0.6, "red").when(p > 0.3, "amber").otherwise("green")


def correlation_direction(correlation: Column | str) -> Column:
    """Anything that is not above zero counts as protective."""
    return F.when(_col(correlation) > 0, "raises risk").otherwise("protective")


def cross_sell_priority(count: Column | str, high: int = 500, medium: int = 200) -> Column:
    c = _col(count)
    return F.when(c > high, "High").when(c > medium, "Medium").otherwise("Emerging")


def cents(money: Column | str) -> Column:
    """DECIMAL money in whole cents: sums per household or basket stay exact and cheap."""
    return (_col(money).cast("decimal(20,2)") * 100).cast("bigint")


def from_cents(total: Column | str) -> Column:
    return (_col(total).cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("double")


def ratio(total: Column | str, count: Column | str) -> Column:
    """total / count as a double; NULL when the count is zero."""
    return F.try_divide(_col(total).cast("double"), _col(count).cast("double"))
