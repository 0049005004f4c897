"""Fact-to-dimension joins that hold for small and large dimensions alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_dimension(
    fact: DataFrame, dim: DataFrame, key: str, fits: bool, how: str = "inner"
) -> DataFrame:
    """Equi-join on `key`, `how` being inner or left.

    A dimension of proven small size is broadcast, so the fact never moves. A larger one is
    joined by a sort-merge join, of which adaptive execution splits the skewed partitions
    (`session.py` turns that on); the fact is read once. Rows without a key find no partner
    and need no shuffle in an inner join.
    """
    if fits:
        return fact.join(F.broadcast(dim), key, how)
    return fact.join(dim.hint("merge"), key, how)
