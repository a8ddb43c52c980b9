"""Records that differ only in formatting: one class per canonical key, with the number of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.blocks import block_meetings, block_of
from corpusloom.operators.skewed import hot_keys, join_hot_by_salts
from corpusloom.session import cut, small

from .labels import bound, decode_labels, letters_digits

#: Records of a block of a large class; two blocks meet in a task when pairs are made.
BLOCK_RECORDS = 4096
#: Pairs that one task makes, about.
TASK_PAIRS = 20_000_000


def label_multiset_key(value: Column) -> Column:
    """A 256-bit key of the labels in ``value``, equal when the labels are the same, each as often.

    Notation, letter case, white space, punctuation and order do not matter. Null where no label
    holds a letter or digit.
    """
    keys = F.filter(F.transform(decode_labels(value), letters_digits), lambda k: k != "")
    return bound(keys, lambda k: F.when(F.size(k) > 0, F.unhex(F.sha2(F.array_join(F.array_sort(k), "\n"), 256))))


def keyed_records(df: DataFrame, record: str, key: Column) -> DataFrame:
    """(record, key), each once, written once; rows without identifier or key are no records.

    ``key`` is computed in the scan, so that only identifiers and 32-byte keys are shuffled. Null keys
    are left out after that, as a condition on the key would compute it again.
    """
    return cut(df.where(df[record].isNotNull()).select(df[record].alias("record"), key.alias("key")).distinct()).where("key IS NOT NULL")


def _salt(column: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(salts)).cast("int")


def _classes(records: DataFrame, *by: str | Column) -> DataFrame:
    return records.groupBy("key", *by).agg(F.min("record").alias("representative"), F.count(F.lit(1)).alias("copies"))


def collapse_copies(df: DataFrame, record: str, key: Column, *, hot_rows: int = 1_000_000, salts: int = 64, broadcast_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Classes of records with equal ``key`` and their members.

    Returns ``classes`` (key, representative, copies) with the smallest identifier as representative,
    and ``members`` (record, key, hot). Keys with at least ``hot_rows`` records are found exactly by
    partial counts first; these are aggregated on (key, salt) and then on the key, all others in one
    shuffle. More hot keys than ``broadcast_rows`` are told apart by a salted join. Rows repeated under
    one identifier count once; null identifiers or keys are left out; an empty table gives no class.
    Columns of ``df`` other than ``record`` are not looked at, so their names are free.
    """
    records = keyed_records(df, record, key)
    hot = hot_keys(records, "key", hot_rows)
    if small(hot, 0):
        return cut(_classes(records)), records.withColumn("hot", F.lit(False))
    marked = cut(hot).withColumn("hot", F.lit(True))
    members = cut(join_hot_by_salts(records, marked, "key", salts=salts, broadcast_rows=broadcast_rows, how="left").withColumn("hot", F.coalesce("hot", F.lit(False))))
    salted = _classes(members.where("hot"), _salt("record", salts).alias("salt"))
    merged = salted.groupBy("key").agg(F.min("representative").alias("representative"), F.sum("copies").alias("copies"))
    return cut(_classes(members.where("NOT hot")).unionByName(merged)), members


def class_members(members: DataFrame, classes: DataFrame, *, least: int = 1, salts: int = 64, broadcast_rows: int = 100_000) -> DataFrame:
    """(representative, record, copies): each record of the classes with at least ``least`` copies beside the one that stands for it.

    This is the whole result without pairs: one row a record. Members of hot keys meet their class by
    broadcast, or dealt to ``salts`` parts where there are more hot classes than ``broadcast_rows``;
    the others by one shuffle.
    """
    wanted = classes.where(F.col("copies") >= least)
    cold = members.where("NOT hot").join(wanted, "key")
    heated = members.where("hot")
    if not heated.isEmpty():
        side = cut(wanted.join(heated.select("key").distinct(), "key", "left_semi"))
        cold = cold.unionByName(join_hot_by_salts(heated, side, "key", salts=salts, broadcast_rows=broadcast_rows))
    return cold.select("representative", "record", "copies")


def copy_pairs(members: DataFrame, classes: DataFrame, *, block_records: int = BLOCK_RECORDS, task_pairs: int = TASK_PAIRS, **options) -> DataFrame:
    """(record_a, record_b), record_a < record_b: all pairs of members of one class.

    Each class is dealt to blocks of about ``block_records``, as many as its size asks for, and each
    two blocks meet once, see :func:`block_meetings`; so both sides of a large class are split, and a
    task holds two blocks of it. The number of tasks follows the number of pairs, which the classes
    tell. As many rows come out as there are pairs, which is the square of a class; where that is not
    wanted, :func:`class_members` is the same result in one row a record.
    """
    least = 2
    total = classes.where(F.col("copies") >= least).agg(F.sum(F.col("copies").cast("double") * (F.col("copies") - 1) / 2)).first()[0] or 0.0
    rows = class_members(members, classes, least=least, **options)
    blocks = F.ceil(F.col("copies") / F.lit(block_records)).cast("int")
    held = cut(rows.select("representative", "record", blocks.alias("blocks"), block_of(F.col("record"), blocks).alias("block")))
    first, second = block_meetings(held, "representative", "block", "blocks", "record")
    tasks, meeting = int(total // task_pairs) + 1, ["representative", "low", "high"]
    if tasks > int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # asked for, as coalescing looks at the bytes that go in and not at the pairs that come out
        first, second = first.repartition(tasks, *meeting), second.repartition(tasks, *meeting)
    pairs = first.join(second, meeting).where("low < high OR first < second")
    return pairs.select(F.least("first", "second").alias("record_a"), F.greatest("first", "second").alias("record_b"))
