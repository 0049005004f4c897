import random
from collections import Counter
from itertools import combinations

import pytest

from larder.operators import basket
from tests.conftest import line, tuples


def brute_force(items):
    baskets = {}
    for b, c in set(items):
        baskets.setdefault(b, []).append(c)
    counts = Counter(p for cs in baskets.values() for p in combinations(sorted(cs), 2))
    return sorted(((*p, n) for p, n in counts.items()), key=lambda r: (-r[2], r[0], r[1]))


@pytest.fixture
def star(make_star):
    commodity = {1: "MILK", 2: "BREAD", 3: "null ", 4: None, 5: "apples", 6: "MILK"}
    products = [dict(PRODUCT_NUM=k, COMMODITY=v) for k, v in commodity.items()]
    lines = [
        line(1, 1, 1, 5), line(1, 1, 2, 5), line(1, 1, 6, 1), line(1, 1, 3, 1),
        line(2, 1, 1, 4), line(2, 2, 2, 6), line(2, 2, 5, 1),
        line(3, 1, 1, 10), line(3, 1, 5, 1), line(3, 1, 4, 1),
        line(4, 1, 2, 11), line(4, 1, 5, 0.99), line(4, 1, 99, 0),
    ]
    return make_star(lines, products=products)


def test_top_baskets_and_ties(star):
    """Spend 12, 11, 12, 11.99: the third place goes on to the fourth basket."""
    assert tuples(basket.top_baskets(star, 2)) == [(1,), (3,)]
    assert tuples(basket.top_baskets(star, 3)) == [(1,), (3,), (4,)]


def test_pairs_of_known_commodities(star):
    assert tuples(basket.copurchase_pairs(star, 10)) == [
        ("BREAD", "MILK", 2),
        ("BREAD", "apples", 2),
        ("MILK", "apples", 2),
    ]
    assert tuples(basket.copurchase_pairs(star, 1, baskets=1)) == [("BREAD", "MILK", 1)]


def test_statistics_and_features(star):
    stats = {r["COMMODITY"]: (r["basket_count"], r["total_spend"]) for r in basket.commodity_stats(star).collect()}
    assert stats == {"MILK": (3, 20.0), "BREAD": (3, 22.0), "apples": (3, 2.99)}
    row = basket.basket_pair_features(star, 1).first()
    assert row.asDict() == dict(
        item_1="BREAD", item_2="MILK", times_bought_together=2, freq_1=3, freq_2=3, spend_1=22.0,
        spend_2=20.0, min_freq=3, max_freq=3, freq_ratio=0.75, total_spend=42.0,
    )


def test_unknown_item_counts_zero(spark, star):
    pairs = spark.createDataFrame([("BREAD", "zzz", 1)], "item_1 string, item_2 string, times_bought_together bigint")
    row = basket.pair_features(pairs, basket.commodity_stats(star)).first()
    assert (row["freq_2"], row["spend_2"], row["min_freq"], row["freq_ratio"]) == (0, 0.0, 0, 0.0)


@pytest.mark.parametrize("top_n", [5, 100, None])
@pytest.mark.parametrize("per_task", [1000, 20])
def test_long_tail_against_brute_force(spark, monkeypatch, top_n, per_task):
    """One basket holds every commodity; most commodities are rare."""
    monkeypatch.setattr(basket, "SEED_ITEMS", 8)
    monkeypatch.setattr(basket, "ITEMS_PER_TASK", per_task)
    rng = random.Random(1)
    items = [(0, f"c{k}") for k in range(90)]
    for b in range(1, 60):
        items += {(b, f"c{min(int(rng.expovariate(0.15)), 89)}") for _ in range(8)}
    items = sorted(set(items))
    df = spark.createDataFrame(items, "BASKET_NUM bigint, COMMODITY string")
    expected = brute_force(items)
    found = sorted(tuples(basket.count_pairs(df, top_n)), key=lambda r: (-r[2], r[0], r[1]))
    assert found == expected[:top_n]


def test_fewer_pairs_than_asked(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "BASKET_NUM bigint, COMMODITY string")
    assert tuples(basket.count_pairs(df, 10)) == [("a", "b", 1)]


def test_priority(spark):
    pairs = spark.createDataFrame(
        [("a", "b", n) for n in (501, 201, 200)], "item_1 string, item_2 string, times_bought_together bigint"
    )
    assert [r["priority"] for r in basket.with_priority(pairs).collect()] == ["High", "Medium", "Emerging"]
    assert [r["priority"] for r in basket.with_priority(pairs, 700, 500).collect()] == ["Medium", "Emerging", "Emerging"]
