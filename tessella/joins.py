"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], weight: str, rows: int, share: int = 1000) -> DataFrame:
    """big joined with small(keys, weight, ...), where weight counts the original rows of a key and every key of big is there; keys may be null.

    Keys that hold more than a share-th part of all rows, so fewer than share
    for each row that an original row has in big, are broadcast: they are
    joined where their rows are. The others are shuffled.
    """
    named = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c) for c in small.columns if c not in keys])
    hot, rare = named.where(F.col(weight) * share > rows), named.where(F.col(weight) * share <= rows)
    drop = [f"__{k}" for k in keys]
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    here = big.join(F.broadcast(hot), on, "inner")
    rest = big.join(F.broadcast(hot.select(*drop)), on, "left_anti").join(rare, on, "inner")
    return here.drop(*drop).unionByName(rest.drop(*drop))
