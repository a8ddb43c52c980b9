"""Pairs within groups: in blocks that meet in tasks of bounded size, and unfolded from lists in parts of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_meetings(members: DataFrame, group: str, block: str, blocks: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Two sides (``group``, low, high, value) whose join on the first three lets each two blocks of a group meet once.

    ``block`` is the block of a member, from 0, and ``blocks`` the number of those of its group. The
    first side goes to the meetings with its own and later blocks, the second to those with its own and
    earlier ones; so each member is sent ``blocks + 1`` times, and a meeting holds two blocks.
    """
    first = members.select(group, F.col(block).alias("low"), F.explode(F.sequence(F.col(block), F.col(blocks) - 1)).alias("high"), F.col(value).alias("first"))
    second = members.select(group, F.explode(F.sequence(F.lit(0), F.col(block))).alias("low"), F.col(block).alias("high"), F.col(value).alias("second"))
    return first, second


def block_of(value: Column, blocks: Column) -> Column:
    """Block of a member, by a hash of its value."""
    return F.pmod(F.xxhash64(value), blocks).cast("int")


def unfold_pairs(df: DataFrame, items: str, *keep: str, part: int = 1024, first: str = "u", second: str = "v") -> DataFrame:
    """(``keep``..., first, second): each two items of a list, in the order of the list; a long list goes in parts, of which two are in a row at most."""
    last = F.greatest(F.ceil(F.size(items) / part).cast("int") - 1, F.lit(0))
    lists = df.where(F.size(items) > 1).select(*keep, F.col(items).alias("__all"), last.alias("__last"))
    dealt = lists.select(*keep, "__all", "__last", F.explode(F.sequence(F.lit(0), "__last")).alias("__i")).select(*keep, "__all", "__i", F.explode(F.sequence("__i", "__last")).alias("__j"))
    cut_out = lambda k: F.slice("__all", F.col(k) * part + 1, F.lit(part))
    met = dealt.select(*keep, (F.col("__i") == F.col("__j")).alias("__same"), cut_out("__j").alias("__b"), F.posexplode(cut_out("__i")).alias("__at", first))
    rest = F.when(F.col("__same"), F.slice("__b", F.col("__at") + 2, F.lit(part))).otherwise(F.col("__b"))
    return met.select(*keep, first, F.explode(rest).alias(second))
