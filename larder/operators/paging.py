"""One page of a listing in total order, however long the listing.

Spark's ordered limit sends offset + limit rows of every task to a single one.
That suits a short listing. In a long one the page's place is found first, by
counting rows per range of the leading sort column: only the ranges the page
touches are looked at again, more finely each time, and only a bounded number of
rows is ordered in the end. The driver sees nothing but those counts.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows that one ordered limit may look at.
SORT_ROWS = 1_000_000

# Rows up to the page's end that every task may hand to the one that merges them.
NEAR_ROWS = 10_000

# Ranges counted at a time.
RANGES = 1000


class Range(NamedTuple):
    """Rows whose column lies in lo..hi, or is NULL when both are None.

    The next column lies in next_lo..next_hi there.
    """

    lo: Any
    hi: Any
    next_lo: Any
    next_hi: Any
    rows: int


class Slice(NamedTuple):
    """`take` rows after the first `skip` of `rows` in page order."""

    rows: DataFrame
    skip: int
    take: int


def order_by(columns: Sequence[str], descending: bool) -> list[Column]:
    """NULL first when ascending, last when descending; only the first column descends."""
    first, *ties = columns
    leading = F.col(first).desc_nulls_last() if descending else F.col(first).asc_nulls_first()
    return [leading, *[F.col(c).asc_nulls_first() for c in ties]]


def _range_key(name: str, kind: str, lo: Any, hi: Any) -> Column:
    """An expression that never falls as the column rises."""
    c = F.col(name)
    if lo is None or lo == hi:
        return c
    if kind == "string":
        return F.substring(c, 1, len(os.path.commonprefix([lo, hi])) + 2)
    number = F.unix_date(c) if kind == "date" else c
    low = float((lo - dt.date(1970, 1, 1)).days if kind == "date" else lo)
    high = float((hi - dt.date(1970, 1, 1)).days if kind == "date" else hi)
    if high <= low:
        return c
    return F.floor((number.cast("double") - low) / (high - low) * (RANGES - 1))


def _count_ranges(rows: DataFrame, columns: Sequence[str], lo: Any, hi: Any) -> list[Range]:
    """Non-empty ranges of the first column, NULL first, then rising; one pass."""
    name, after = columns[0], columns[min(1, len(columns) - 1)]
    kind = dict(rows.dtypes)[name]
    counted = rows.select(
        F.col(name).alias("value"),
        F.col(after).alias("next_lo"),
        F.col(after).alias("next_hi"),
        F.lit(1).alias("rows"),
    )
    sums = [F.min("next_lo").alias("next_lo"), F.max("next_hi").alias("next_hi"), F.sum("rows").alias("rows")]
    if kind == "string":
        # Texts repeat: one row per text first, as the least text of a group needs a sort.
        counted = counted.groupBy("value").agg(*sums)
    found = (
        counted.groupBy(_range_key("value", kind, lo, hi).alias("range"))
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"), *sums)
        .orderBy(F.col("lo").asc_nulls_first())
        .collect()
    )
    return [Range(*r[1:]) for r in found]


class Part(NamedTuple):
    """Neighbouring ranges that the page reaches into, and its place in them."""

    ranges: list[Range]
    skip: int
    take: int

    @property
    def rows(self) -> int:
        return sum(r.rows for r in self.ranges)

    def holds(self, name: str) -> Column:
        c = F.col(name)
        known = [r for r in self.ranges if r.lo is not None]
        inside = F.lit(False)
        if known:
            lo, hi = min(r.lo for r in known), max(r.hi for r in known)
            inside = c.between(F.lit(lo), F.lit(hi))
        return inside | c.isNull() if len(known) < len(self.ranges) else inside


def _touched(ranges: list[Range], skip: int, take: int, most: int) -> list[Part]:
    """Parts of the page in order, neighbours joined up to `most` rows."""
    found: list[Part] = []
    before = 0
    for r in ranges:
        start, end = max(skip, before), min(skip + take, before + r.rows)
        if start < end:
            last = found[-1] if found else None
            if last is not None and last.rows + r.rows <= most:
                found[-1] = Part([*last.ranges, r], last.skip, last.take + end - start)
            else:
                found.append(Part([r], start - before, end - start))
        before += r.rows
    return found


def _narrow(
    rows: DataFrame,
    columns: Sequence[str],
    descending: bool,
    bounds: tuple[Any, Any],
    skip: int,
    take: int,
    most: int,
) -> list[Slice]:
    """Slices of at most `most` rows each that make up the page in order.

    Rows alike in all columns are the exception: any of them will do.
    """
    if not columns:
        return [Slice(rows, 0, take)]
    name, *ties = columns
    ranges = _count_ranges(rows, columns, *bounds)
    if descending:
        ranges.reverse()
    slices = []
    for part in _touched(ranges, skip, take, most):
        inside = rows.filter(part.holds(name))
        first = part.ranges[0]
        if part.rows <= most:
            slices.append(Slice(inside, part.skip, part.take))
            continue
        if first.lo == first.hi:
            left, down, within = ties, False, (first.next_lo, first.next_hi)
        else:
            left, down, within = columns, descending, (first.lo, first.hi)
        slices += _narrow(inside, left, down, within, part.skip, part.take, most)
    return slices


def page_of(
    rows: DataFrame,
    columns: Sequence[str],
    descending: bool,
    skip: int,
    take: int,
    most: int = SORT_ROWS,
    near: int = NEAR_ROWS,
) -> DataFrame:
    """`take` rows after the first `skip`, ordered by `columns`.

    A page that ends within `near` rows is one ordered limit over one scan, however long the
    listing; only deeper pages are looked for by counting.
    """
    order = order_by(columns, descending)
    if skip + take <= near:
        return rows.orderBy(*order).offset(skip).limit(take)
    most = max(most, take)
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min(columns[0]), F.max(columns[0])).first()
    slices = [Slice(rows, skip, take)]
    if skip >= n:
        slices = [Slice(rows.limit(0), 0, take)]
    elif n > most:
        slices = _narrow(rows, columns, descending, (lo, hi), skip, take, most)
    parts = [s.rows.orderBy(*order).offset(s.skip).limit(s.take) for s in slices]
    return reduce(DataFrame.unionByName, parts)
