"""Commodities bought together in the baskets that spend most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.expressions import cents, cross_sell_priority, not_missing
from larder.operators.joins import join_dimension
from larder.sources.star import Star, is_small
from larder.sources.store import storage_root

TOP_BASKETS = 5000

# Commodities whose pairs are counted first to learn which others can still matter.
SEED_ITEMS = 64

# A basket holds each commodity once; one task pairs up to this many of them with
# the others.
ITEMS_PER_TASK = 1000

# A list is broadcast up to this many rows, about 50 MB of commodity names.
BROADCAST_ROWS = 1_000_000


def _listed(rows: DataFrame, n: int) -> DataFrame:
    """A list of at most n rows, to be broadcast if n is small."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def top_baskets(star: Star, n: int = TOP_BASKETS) -> DataFrame:
    """The n baskets with the highest spend; ties go to the lower number."""
    return (
        star.transactions.groupBy("BASKET_NUM")
        .agg(F.sum(cents("SPEND")).alias("spend"))
        .orderBy(F.desc("spend"), F.col("BASKET_NUM").asc_nulls_first())
        .limit(n)
        .select("BASKET_NUM")
    )


def basket_commodities(star: Star, baskets: int = TOP_BASKETS) -> DataFrame:
    """Distinct (BASKET_NUM, COMMODITY) of the top baskets, known commodities only.

    The basket list has at most `baskets` rows, so the other lines go before any shuffle.
    Products too large to broadcast meet the few lines that are left, written out first.
    """
    chosen = _listed(top_baskets(star, baskets), baskets)
    lines = star.transactions.select("BASKET_NUM", "PRODUCT_NUM").join(
        chosen, "BASKET_NUM", "left_semi"
    )
    if not star.products_fit:
        storage_root(lines.sparkSession)
        lines = lines.distinct().checkpoint()
    named = star.products.select("PRODUCT_NUM", "COMMODITY").filter(not_missing("COMMODITY"))
    return (
        join_dimension(lines, named, "PRODUCT_NUM", star.products_fit)
        .select("BASKET_NUM", "COMMODITY")
        .distinct()
    )


def _count_pairs(items: DataFrame) -> DataFrame:
    """Pairs of a basket come from as many tasks as its own size calls for."""
    sizes = items.groupBy("BASKET_NUM").agg(F.ceil(F.count(F.lit(1)) / ITEMS_PER_TASK).alias("tasks"))
    sized = items.join(sizes, "BASKET_NUM")
    left = sized.select(
        "BASKET_NUM", F.col("COMMODITY").alias("item_1"), F.pmod(F.hash("COMMODITY"), "tasks").alias("part")
    )
    right = sized.select(
        "BASKET_NUM", F.col("COMMODITY").alias("item_2"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part")
    )
    return (
        left.join(right, ["BASKET_NUM", "part"])
        .filter("item_1 < item_2")
        .groupBy("item_1", "item_2")
        .agg(F.count(F.lit(1)).alias("times_bought_together"))
    )


def best_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The n most frequent pairs; ties go by name."""
    return pairs.orderBy(F.desc("times_bought_together"), "item_1", "item_2").limit(n)


def count_pairs(items: DataFrame, top_n: int | None, seeds: int | None = None) -> DataFrame:
    """Baskets per unordered pair, the `top_n` most frequent pairs or all.

    `items` is read several times and should be a written or checkpointed frame.

    A pair occurs no more often than its rarer item. The pairs of the most
    frequent items give a count that the n-th best pair reaches at least, and
    items seen in fewer baskets drop out before pairs are formed. That changes
    no result; it keeps the many rare items of a long-tailed catalogue out.
    """
    if top_n is None:
        return _count_pairs(items)
    by_item = items.groupBy("COMMODITY").agg(F.count(F.lit(1)).alias("baskets"))
    first = by_item.orderBy(F.desc("baskets"), "COMMODITY").limit(seeds or SEED_ITEMS).select("COMMODITY")
    seed_items = items.join(F.broadcast(first), "COMMODITY", "left_semi")
    bound = (
        best_pairs(_count_pairs(seed_items), top_n)
        .agg(F.when(F.count(F.lit(1)) == top_n, F.min("times_bought_together")).otherwise(0))
        .scalar()
    )
    frequent = by_item.filter(F.col("baskets") >= bound).select("COMMODITY")
    kept = items.join(frequent, "COMMODITY", "left_semi")
    return best_pairs(_count_pairs(kept), top_n)


def copurchase_pairs(
    star: Star, top_n: int | None = 10, baskets: int = TOP_BASKETS
) -> DataFrame:
    """item_1, item_2, times_bought_together over the top baskets, best first."""
    storage_root(star.transactions.sparkSession)
    return count_pairs(basket_commodities(star, baskets).checkpoint(), top_n)


def commodity_stats(star: Star, only: DataFrame | None = None) -> DataFrame:
    """Distinct baskets and spend per known commodity.

    `only` is a short list of commodities; other lines then go before the shuffle.
    """
    lines = star.transactions.select("PRODUCT_NUM", "BASKET_NUM", "SPEND")
    named = star.products.select("PRODUCT_NUM", "COMMODITY").filter(not_missing("COMMODITY"))
    if only is not None:
        named = named.join(F.broadcast(only) if is_small(only) else only, "COMMODITY", "left_semi")
        fits = star.products_fit or is_small(named)
    else:
        fits = star.products_can(named)
    return (
        join_dimension(lines, named, "PRODUCT_NUM", fits)
        .groupBy("COMMODITY")
        .agg(
            F.count_distinct("BASKET_NUM").alias("basket_count"),
            F.sum("SPEND").cast("double").alias("total_spend"),
        )
    )


def pair_features(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Frequencies and spend of both items beside each pair; unknown items count 0."""

    def of_item(i: int) -> DataFrame:
        return stats.select(
            F.col("COMMODITY").alias(f"item_{i}"),
            F.col("basket_count").alias(f"freq_{i}"),
            F.col("total_spend").alias(f"spend_{i}"),
        )

    zero = {"freq_1": 0, "freq_2": 0, "spend_1": 0.0, "spend_2": 0.0}
    both = pairs.join(of_item(1), "item_1", "left").join(of_item(2), "item_2", "left").fillna(zero)
    both = both.withColumn("min_freq", F.least("freq_1", "freq_2")).withColumn(
        "max_freq", F.greatest("freq_1", "freq_2")
    )
    return both.select(
        "item_1",
        "item_2",
        "times_bought_together",
        "freq_1",
        "freq_2",
        "spend_1",
        "spend_2",
        "min_freq",
        "max_freq",
        (F.col("min_freq") / (F.col("max_freq") + 1)).alias("freq_ratio"),
        (F.col("spend_1") + F.col("spend_2")).alias("total_spend"),
    )


def top_pair_features(star: Star, pairs: DataFrame) -> DataFrame:
    """Features of a top-n list of pairs, from the lines of its few items only."""
    storage_root(star.transactions.sparkSession)
    pairs = pairs.checkpoint()
    items = pairs.select(F.explode(F.array("item_1", "item_2")).alias("COMMODITY")).distinct()
    return pair_features(pairs, commodity_stats(star, items))


def basket_pair_features(
    star: Star, top_n: int | None = 100, baskets: int = TOP_BASKETS
) -> DataFrame:
    pairs = copurchase_pairs(star, top_n, baskets)
    if top_n is None:
        return pair_features(pairs, commodity_stats(star))
    return top_pair_features(star, pairs)


def with_priority(pairs: DataFrame, high: int = 500, medium: int = 200) -> DataFrame:
    return pairs.select(
        "item_1",
        "item_2",
        "times_bought_together",
        cross_sell_priority("times_bought_together", high, medium).alias("priority"),
    )


def pair_labels(pairs: DataFrame) -> DataFrame:
    """Axis label 'a + b' beside the count."""
    return pairs.select(F.concat("item_1", F.lit(" + "), "item_2").alias("label"), "times_bought_together")


def pair_axis_max(pairs: DataFrame) -> DataFrame:
    """Upper end of the actual-against-predicted axes."""
    return pairs.agg(F.max("times_bought_together").alias("axis_max"))
