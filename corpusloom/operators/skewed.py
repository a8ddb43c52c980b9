"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut, small


def hot_keys(df: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """(key) of at least ``hot_rows`` rows, counted exactly: partial counts before the shuffle, summed after. At most rows / ``hot_rows`` keys; null is none of them."""
    return df.where(df[key].isNotNull()).groupBy(df[key].alias(key)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_rows).select(key)


def join_hot_by_salts(left: DataFrame, right: DataFrame, key: str, *, salts: int = 64, broadcast_rows: int = 100_000, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has each key once: by broadcast where ``right`` is counted to be small, else with ``left`` dealt to ``salts`` parts and ``right`` repeated for each."""
    if small(right, broadcast_rows):
        return left.join(F.broadcast(right), key, how)
    dealt = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [key, "__salt"], how).drop("__salt")


def skew_join(left: DataFrame, right: DataFrame, key: str, *, hot_rows: int = 1_000_000, salts: int = 64, broadcast_rows: int = 100_000, how: str = "inner") -> DataFrame:
    """Inner or left-semi join of ``left`` to ``right``, which has each key once, with no task that holds a whole hot key.

    A small ``right`` is broadcast. Otherwise keys of ``left`` with at least ``hot_rows`` rows are found
    exactly; their rows are joined by :func:`join_hot_by_salts`, all others by one shuffle. ``left`` is
    read more than once then, so it should be a table or cut. Null keys match nothing.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError("only inner and left-semi joins")
    if small(right, broadcast_rows):
        return left.join(F.broadcast(right), key, how)
    hot = hot_keys(left, key, hot_rows)
    if small(hot, 0):
        return left.join(right, key, how)
    hot = cut(hot)
    warm = join_hot_by_salts(left, hot, key, salts=salts, broadcast_rows=broadcast_rows, how="left_semi")
    side = cut(right.join(hot, key, "left_semi"))
    marked = F.broadcast(hot) if small(hot, broadcast_rows) else hot
    cold = left.join(marked, key, "left_anti")
    return join_hot_by_salts(warm, side, key, salts=salts, broadcast_rows=broadcast_rows, how=how).unionByName(cold.join(right, key, how))
