"""Mixing sources to target weights, in blocks of equal numbers of words.

Sources in code point order (null last) weigh 1, 2, 3, 1, 2, ... and share the corpus size
by weight; none gets more than MAX_EPOCHS times its own size, and what that leaves over is
shared again. Every source is dealt into shards by a seeded hash, every shard into blocks of
about BLOCK_WORDS words. Sainte-Lague apportionment (highest quotients v / (2k + 1)) gives
each source a whole number of blocks, and in each source each shard its quota. A shard's
documents stand in seeded order; a quota takes all blocks as often as it can and the rest
as a run of blocks from a seeded one.

A null text has size 0; a source without words has target 0. Repeated rows count as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.staging import staged

SEED = 20
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BLOCK_WORDS = 64
SHARD_ROWS = 4_000
_PROBES = 32


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _sizes(docs: DataFrame) -> DataFrame:
    # A key that is never null, so that the null source joins like any other.
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    return docs.select("doc_id", "source", key.alias("key"), _size().alias("size"))


def _weighted(sources: DataFrame) -> DataFrame:
    """Sources with their weight, which follows from their place in code point order."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = staged(
        sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-order"
    )
    before = parts.groupBy("part").count().select(
        "part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before")
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    return parts.join(before, "part").withColumn("weight", weight).drop("part", "before")


def _targets(sources: DataFrame) -> DataFrame:
    """Adds target: min(weight * level, MAX_EPOCHS * size) with the level that uses all words."""
    cap = MAX_EPOCHS * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > cap
        found = sources.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        if found[0] == stopped or not found[2]:
            break
        stopped, level = found[0], (total - found[1]) / found[2]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double")))


def _seats(divisor: float) -> F.Column:
    return F.least(F.floor(F.col("votes") / F.lit(divisor) + 0.5), MAX_EPOCHS * F.col("blocks")).cast("long")


def apportion(sources: DataFrame) -> DataFrame:
    """Adds quota: round(sum of votes) blocks in all, by highest quotients votes / (2k + 1).

    A seat k is won if votes / (2k + 1) is at least half the divisor, so the search is for a
    divisor that deals the right number; quotients equal to the last one are told apart by
    their source. No source gets more than MAX_EPOCHS times its blocks.
    """
    house = round(sources.agg(F.sum("votes")).first()[0] or 0)
    # A divisor of 4 deals at most half the votes, a small one up to MAX_EPOCHS times the blocks.
    low, high, dealt = 0.0, 4.0, 0
    while house and dealt != house and high - low > 1e-13 * high:
        probes = [low + (high - low) * i / _PROBES for i in range(1, _PROBES)] + [high]
        sums = sources.agg(*[F.sum(_seats(p)) for p in probes]).first()
        at = next(i for i, n in enumerate(sums) if n <= house)
        low, high, dealt = probes[at - 1] if at else low, probes[at], sums[at]
    if not house:
        return sources.withColumn("quota", F.lit(0).cast("long"))
    dealt_out = sources.withColumn("quota", _seats(high))
    if dealt == house:
        return dealt_out
    room = dealt_out.filter(F.col("quota") < MAX_EPOCHS * F.col("blocks"))
    more = (
        room.orderBy((F.col("votes") / (2 * F.col("quota") + 1)).desc(), "key").limit(house - dealt)
        .select("key", F.lit(1).alias("more"))
    )
    return dealt_out.join(more, "key", "left").withColumn("quota", F.col("quota") + F.coalesce("more", F.lit(0))).drop("more")


def _shard_quotas(shards: DataFrame) -> DataFrame:
    """Deals each source's quota to its shards by highest quotients of their blocks.

    Shards are dealt by hash, so no shard's quota is more than two blocks off its share:
    quotients further down are won, further up lost.
    """
    share = F.floor(F.col("quota") * F.col("n") / F.col("blocks"))
    base = F.greatest(share - 2, F.lit(0))
    by_key = Window.partitionBy("key")
    near = shards.withColumn("base", base.cast("long")).withColumn("k", F.explode(F.sequence(F.col("base"), F.col("base") + 4)))
    near = near.filter(F.col("k") < MAX_EPOCHS * F.col("n"))
    left = F.col("quota") - F.sum(F.when(F.col("k") == F.col("base"), F.col("base")).otherwise(0)).over(by_key)
    rank = F.row_number().over(by_key.orderBy((F.col("n") / (2 * F.col("k") + 1)).desc(), F.xxhash64("key", "shard", F.lit(SEED)), "shard", "k"))
    won = near.withColumn("won", (rank <= left).cast("long"))
    return won.groupBy("key", "shard").agg(
        (F.max("base") + F.sum("won")).alias("q"), F.max("n").alias("n"), F.max("shard_size").alias("shard_size"),
        F.max("source_size").alias("source_size"), F.max("target").alias("target"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted): a row per input row."""
    sizes = staged(_sizes(docs), "mix-sizes")
    sources = sizes.groupBy("key").agg(
        F.max("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    sources = staged(_targets(_weighted(sources)), "mix-sources")
    shard_count = F.ceil(F.col("rows") / SHARD_ROWS)
    dealt = sizes.join(sources.select("key", shard_count.alias("shards")), "key").select(
        "key", "doc_id", "source", "size", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), "shards").alias("shard")
    )
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("shard_size")).withColumn(
        "n", F.when(F.col("shard_size") > 0, F.greatest(F.lit(1), F.round(F.col("shard_size") / BLOCK_WORDS))).otherwise(0).cast("long")
    )
    shards = staged(shards, "mix-shards")
    blocks = shards.groupBy("key").agg(F.sum("n").alias("blocks"))
    voted = sources.join(blocks, "key").filter("blocks > 0").withColumn(
        "votes", F.col("target") / F.col("source_size") * F.col("blocks")
    )
    quotas = apportion(staged(voted, "mix-votes")).select("key", "blocks", "quota", "source_size", "target")
    # Small next to the documents: a row per SHARD_ROWS of them.
    plan = staged(_shard_quotas(shards.filter("n > 0").join(quotas, "key")), "mix-quotas")

    order = Window.partitionBy("key", "shard").orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id", "size")
    placed = dealt.withColumn("to", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = placed.join(plan.drop("source_size", "target"), ["key", "shard"], "left").selectExpr(
        "*", "q div n AS epochs", "q % n AS more", "pmod(xxhash64(key, shard, %d), n) AS first" % SEED
    ).selectExpr(
        "*", "first * shard_size div n AS run_from",
        "least(first + more, n) * shard_size div n AS run_to",
        "greatest(first + more - n, 0) * shard_size div n AS wrapped_to",
    )
    overlap = "greatest(0, least(`to`, {to}) - greatest(`to` - size, {at}))"
    taken = f"epochs * size + {overlap.format(at='run_from', to='run_to')} + {overlap.format(at='0', to='wrapped_to')}"
    facts = sources.select("key", "source_size", "target")
    return chosen.withColumn("taken", F.expr(f"coalesce({taken}, 0)").cast("long")).join(facts, "key").select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it, with the columns of the input.

    A document of which the last round takes a part is given whole in that round; that
    concerns two documents of a shard at most. Rows of one doc_id, source and size count alike.
    """
    # Names of their own, as the documents may have any columns.
    times = mix(docs).filter("taken > 0").groupBy(
        F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size")
    ).agg(
        F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("_mix_times")
    )
    times = staged(times, "mix-times").hint("merge")
    same = docs["doc_id"].eqNullSafe(times["_mix_id"]) & docs["source"].eqNullSafe(times["_mix_source"])
    sized = docs.withColumn("_mix_words", _size())
    rows = sized.join(times, same & (F.col("_mix_words") == F.col("_mix_size")))
    copies = rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times"))))
    return copies.select(*[docs[c] for c in docs.columns])
