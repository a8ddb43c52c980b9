"""Items that appear together in a basket more often than chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.blocks import block_meetings, block_of
from corpusloom.operators.skewed import skew_join
from corpusloom.session import cut, small


#: Items of a basket that are held as one list; a basket of more is dealt to several.
LIST_ITEMS = 1024
#: Pairs that one task makes, about.
TASK_PAIRS = 20_000_000


def baskets_of(rows: DataFrame, basket: str, item: str, *, list_items: int = LIST_ITEMS, broadcast_rows: int = 100_000) -> DataFrame:
    """(basket, block, blocks, items): the distinct items of each basket in ascending order, those of a large one in several blocks.

    A null item still makes its basket count; null baskets are left out. Items are made distinct
    before the shuffle, so a small basket costs about one record, however often its rows repeat an
    item. Baskets of more than ``list_items`` rows are found exactly by partial counts, and their items
    are dealt by hash to as many blocks as their rows ask for, so that no task holds such a basket.
    """
    held = cut(rows.where(rows[basket].isNotNull()).select(rows[basket].alias("basket"), rows[item].alias("item")))
    sizes = held.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > list_items)
    if small(sizes, 0):
        dealt = held.withColumns({"block": F.lit(0), "blocks": F.lit(1)})
    else:
        side = cut(sizes.select("basket", F.ceil(F.col("n") / list_items).cast("int").alias("blocks")))
        marked = F.broadcast(side) if small(side, broadcast_rows) else side
        large = skew_join(held, side, "basket", hot_rows=list_items, broadcast_rows=broadcast_rows)
        large = large.withColumn("block", F.coalesce(block_of(F.col("item"), F.col("blocks")), F.lit(0)))
        dealt = held.join(marked, "basket", "left_anti").withColumns({"block": F.lit(0), "blocks": F.lit(1)}).unionByName(large)
    return dealt.groupBy("basket", "block", "blocks").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _pairs(held: DataFrame) -> DataFrame:
    """(item_a, item_b), item_a < item_b, of the lists and, for large baskets, of each two of their blocks; one list or two in a row at most.

    Lists are dealt to as many tasks as their pairs ask for, since what comes out of a list grows with
    the square of what goes in.
    """
    spark, size = held.sparkSession, F.size("items").cast("double")
    made = held.groupBy((F.col("blocks") > 1).alias("large")).agg(F.sum(size * (size - 1) / 2).alias("inside"), F.sum(size * F.col("blocks") * LIST_ITEMS / 2).alias("met"))
    found = {r["large"]: r for r in made.collect()}  # two rows at most
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = held.where("blocks = 1 AND size(items) > 1")
    tasks = int((found[False]["inside"] if False in found else 0) // TASK_PAIRS) + 1
    whole = whole.repartition(tasks) if tasks > usual else whole
    inside = whole.select("items", F.posexplode("items").alias("at", "item_a")).select("item_a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("item_b"))
    if True not in found:
        return inside
    first, second = block_meetings(held.where("blocks > 1 AND size(items) > 0"), "basket", "block", "blocks", "items")
    met = first.join(second, ["basket", "low", "high"]).select("low", "high", "first", "second")
    met = met.repartition(max(usual, int(found[True]["met"] // TASK_PAIRS) + 1))
    across = met.select("low", "high", "second", F.explode("first").alias("a")).select("low", "high", "a", F.explode("second").alias("b")).where("low < high OR a < b")
    return inside.unionByName(across.select(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b")))


def pairs_together(baskets: DataFrame, *, min_baskets: int = 1, per_total: int | None = None, min_lift: float = 0.0, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_total, lift, pmi) with item_a < item_b.

    ``baskets`` comes from :func:`baskets_of`. n_total counts all baskets, those without items too. A
    pair comes out when ``n_ab >= min_baskets``, ``per_total * n_ab >= n_total`` if given, and
    ``n_total * n_ab >= min_lift * n_a * n_b``. lift is n_total * n_ab / (n_a * n_b), pmi its base-2
    logarithm. An item in fewer baskets than a pair needs cannot be in a result, so it is taken out of
    the baskets before any pair is made (exact, and the same at any number of items). Pairs are counted
    before the shuffle and summed after. No basket gives no rows.
    """
    held = cut(baskets.select("basket", "block", "blocks", "items"))
    total = held.where("block = 0").count() if small(held.where("blocks > 1"), 0) else held.select("basket").distinct().count()
    least = max(min_baskets, -(-total // per_total) if per_total else 1)
    mentions = held.select("basket", "block", "blocks", F.explode("items").alias("item"))
    single = cut(mentions.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    if least > 1:
        kept = skew_join(mentions, single.select("item"), "item", broadcast_rows=broadcast_rows, how="left_semi")
        held = cut(kept.groupBy("basket", "block", "blocks").agg(F.array_sort(F.collect_list("item")).alias("items")))
    counted = _pairs(held).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") >= least)
    a = single.select(F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    b = single.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    if small(single, broadcast_rows):
        a, b = F.broadcast(a), F.broadcast(b)
    n = F.lit(total).cast("bigint")
    lift = n.cast("double") * F.col("n_ab") / (F.col("n_a").cast("double") * F.col("n_b"))
    return (
        counted.join(a, "item_a").join(b, "item_b")
        .where(n.cast("decimal(38,0)") * F.col("n_ab") >= F.lit(min_lift) * (F.col("n_a").cast("decimal(19,0)") * F.col("n_b").cast("decimal(19,0)")))
        .select("item_a", "item_b", "n_ab", "n_a", "n_b", n.alias("n_total"), lift.alias("lift"), F.log2(lift).alias("pmi"))
    )
