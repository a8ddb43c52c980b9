"""Row numbers and running sums over a whole table, without a single-partition window.

The table is range-partitioned by the order; what comes before a partition is added from one row per
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut, stored


def _ranged(df: DataFrame, order: list[Column], compact: bool = False) -> DataFrame:
    """Rows in their range partitions, written once so that boundaries stay, with partition and place."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return (stored if compact else cut)(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at")))


def with_row_number(df: DataFrame, *order: Column, name: str = "row_no", start: int = 1, compact: bool = False) -> DataFrame:
    """``df`` with the place of each row in ``order``, which should be total for a defined result; ``compact`` keeps the rows between as Parquet."""
    rows = _ranged(df, list(order), compact)
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))  # one row a partition
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__before") + start).drop("__part", "__at", "__before", "__size")


def with_running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums, up to and with each row in ``order``; ``sums`` maps the new name to the column."""
    rows = _ranged(df, order)
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__part").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    offsets = totals.select("__part", *(F.coalesce(F.sum(f"__t_{n}").over(across), F.lit(0)).alias(f"__o_{n}") for n in sums))
    out = rows.join(F.broadcast(offsets), "__part")
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(inside) + F.col(f"__o_{n}"))
    return out.drop("__part", "__at", *(f"__o_{n}" for n in sums))


def numbered_parts(df: DataFrame, *order: Column, rows: int, name: str = "part") -> DataFrame:
    """``df`` with the 0-based number of the part of ``rows`` consecutive rows that each row is in."""
    return with_row_number(df, *order, name="__row").withColumn(name, F.floor((F.col("__row") - 1) / rows)).drop("__row")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group. Spark keeps at most ``k`` rows a group in each task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def exact_quantiles(df: DataFrame, value: str, shares: list[float]) -> dict[float, float | None]:
    """Exact quantiles of a column by linear interpolation, nulls left out; None without any value.

    Equal values are counted first and the counts summed in order, so no task holds all values; what
    comes back is at most two rows for each share.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    run = with_running_sums(counts, [F.col("value").asc()], {"until": "n"})
    total = run.agg(F.max("until")).first()[0]
    if not total:
        return dict.fromkeys(shares)
    places = {p: (total - 1) * p for p in shares}
    wanted = sorted({k for at in places.values() for k in (int(at), min(int(at) + 1, total - 1))})
    asked = F.filter(F.array(*(F.lit(k).cast("bigint") for k in wanted)), lambda k: (k < F.col("until")) & (k >= F.col("until") - F.col("n")))
    held = {r["k"]: float(r["value"]) for r in run.select("value", F.explode(asked).alias("k")).collect()}
    out = {}
    for p, at in places.items():
        low, high = held[int(at)], held[min(int(at) + 1, total - 1)]
        out[p] = low + (high - low) * (at - int(at))
    return out
