import datetime as dt
import itertools
from dataclasses import replace

import pytest

from larder.operators import detail, paging
from tests.conftest import frame, line, tuples


@pytest.fixture
def star(make_star):
    lines = [
        line(
            b := i // 3,
            [10, 10, 10, 11, 12, None][i % 6],
            [1, 2, 3, None, 99][i % 5],
            None if i % 31 == 0 else i * 7 % 50,
            UNITS=i % 4,
            PURCHASE_DATE=dt.date(2020, 1, 1) + dt.timedelta(days=b % 9),
        )
        for i in range(240)
    ]
    households = [dict(HSHD_NUM=10, L="Y"), dict(HSHD_NUM=11, L="N")]
    products = [
        dict(PRODUCT_NUM=1, DEPARTMENT="FOOD", COMMODITY="MILK"),
        dict(PRODUCT_NUM=2, DEPARTMENT="FOOD", COMMODITY="MILKSHAKE"),
        dict(PRODUCT_NUM=3, DEPARTMENT="PETS", COMMODITY=None),
    ]
    return make_star(lines, households, products)


def key(name, descending):
    def part(value, down):
        if value is None:
            return (1, 0) if down else (0, 0)
        if isinstance(value, str):
            return (0 if down else 1, [-ord(c) for c in value] + [1] if down else value)
        value = value.toordinal() if isinstance(value, dt.date) else value
        return (0, -value) if down else (1, value)

    columns = [name, *[c for c in detail.TIE_BREAK if c != name]]
    return lambda r: tuple(part(r[c], descending and c == name) for c in columns)


WAYS = [
    ("HSHD_NUM", False),
    ("PURCHASE_DATE", True),
    ("PRODUCT_NUM", False),
    ("COMMODITY", False),
    ("COMMODITY", True),
    ("SPEND", True),
]


@pytest.mark.parametrize("name,descending", WAYS)
def test_pages_add_up(star, name, descending):
    rows = detail.household_detail(star, None, "HSHD_NUM", page_size=1000).collect()
    expected = sorted(rows, key=key(name, descending))
    pages = [detail.household_detail(star, None, name, descending, p, 95).collect() for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [95, 95, 50, 0]
    assert list(itertools.chain(*pages)) == expected
    columns = [name, *[c for c in detail.TIE_BREAK if c != name]]
    lines = detail._sortable_lines(star, None, name)
    for skip in (0, 37, 110, 231, 240):
        page = paging.page_of(lines, columns, descending, skip, 20, most=25, near=0).collect()
        assert [tuple(r[c] for c in columns) for r in page] == [
            tuple(r[c] for c in columns) for r in expected[skip : skip + 20]
        ]


@pytest.mark.parametrize("name,descending", [("SPEND", True), ("COMMODITY", False)])
def test_next_page_by_key(star, name, descending):
    first, second, third = (
        detail.household_detail(star, None, name, descending, p, 90).collect() for p in (1, 2, 3)
    )
    after = detail.household_detail_after(star, first[-1].asDict(), None, name, descending, 90)
    assert after.collect() == second
    after = detail.household_detail_after(star, second[-1].asDict(), None, name, descending, 90, sort_rows=100)
    assert after.collect() == third


def test_padded_number_is_the_same_household(star):
    a, b = detail.household_detail(star, "0010"), detail.household_detail(star, 10)
    assert a.columns == list(detail.COLUMNS)
    assert tuples(a) == tuples(b)
    assert a.count() == 100 and tuples(detail.detail_pages(star, "10")) == [(120, 2)]


def test_lines_without_partner_stay(star):
    rows = detail.household_detail(star, None, page_size=1000).collect()
    assert len(rows) == 240
    assert {r["L"] for r in rows if r["HSHD_NUM"] == 12} == {None}
    assert {r["DEPARTMENT"] for r in rows if r["PRODUCT_NUM"] == 99} == {None}


def test_unknown_sort_column(star):
    assert detail.sort_column("1; DROP TABLE x") == "HSHD_NUM"
    assert tuples(detail.household_detail(star, None, "L")) == tuples(detail.household_detail(star, None))


def test_bad_arguments(star):
    with pytest.raises(ValueError):
        detail.household_detail(star, page=0)
    with pytest.raises(ValueError):
        detail.household_detail(star, "ten")


def test_empty_listing(spark, make_star):
    star = make_star([])
    assert detail.household_detail(star).count() == 0
    assert tuples(detail.detail_pages(star, None)) == [(0, 1)]


def test_equal_rows_and_huge_numbers(spark):
    rows = [line(2**62 + i % 3, 1, 1, 1) for i in range(30)]
    df = frame(spark, "transactions", rows)
    page = paging.page_of(df, ["BASKET_NUM", "HSHD_NUM"], True, 8, 5, most=4, near=0)
    assert [r["BASKET_NUM"] - 2**62 for r in page.collect()] == [2, 2, 1, 1, 1]


@pytest.mark.parametrize("name,descending", [("SPEND", True), ("HSHD_NUM", False), ("PURCHASE_DATE", True)])
def test_first_and_next_page_are_one_scan_with_a_pushed_filter(spark, store, star, capsys, name, descending):
    store.write({"transactions": star.transactions})
    stored = replace(star, transactions=store.read("transactions"))
    first = detail.household_detail(stored, None, name, descending)
    last = first.tail(1)[0].asDict()
    for page in (first, detail.household_detail_after(stored, last, None, name, descending)):
        page.explain("formatted")
        plan = capsys.readouterr().out
        assert plan.count("/data/transactions/") == 1
    assert any(f"({name}," in line for line in plan.splitlines() if "PushedFilters" in line)
