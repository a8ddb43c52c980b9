"""Mixing of sources to target shares of the total size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skewed import skew_join
from corpusloom.session import cut

from .bpe import DEFAULT_DIR, count_tokens

#: Mantissa bits of the hash that decides on the last copy.
_BITS = 53
#: Most targets that are sent to every task; more are joined by shuffle, documents of the largest sources by salts.
TARGETS_BROADCAST = 100_000


def source_sizes(df: DataFrame, source: str, text: str, *, directory: str = DEFAULT_DIR, name: str = "byte_bpe_50k.json") -> DataFrame:
    """(source, docs, tokens) over all documents, whole texts; the null source has its row.

    Tokens are summed before the shuffle, so a source that holds most documents costs as much as any.
    """
    sized = count_tokens(df.select(F.col(source).alias("source"), F.col(text).alias("text")), "text", directory=directory, name=name)
    return sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))


def repetition_rates(sizes: DataFrame, targets: DataFrame, *, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, attainable_share, max_repeats, docs, tokens, planned_tokens, rate) for every target or source that exists.

    ``targets`` has (source, target_share, max_repeats); a source repeated there holds its largest
    share and cap. The rate is how often a document of the source is emitted on average:
    ``planned_tokens / tokens`` with ``planned_tokens = target_share * total``, at most the cap.
    ``total_tokens`` is the size of the mixture; if None it is the largest at which no cap binds, so
    the shares stay in proportion and no source is cut short; the source that sets it is the one with
    rate ``max_repeats``. A target without tokens, or with a null or non-positive share or cap, has rate
    0, as has a source without a target. ``attainable_share`` is the share that the planned tokens are of
    all planned ones: beyond the target's where other targets have no tokens, below it where a given
    size lets the cap bind; 0 for rate 0.
    """
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("bigint").alias("max_repeats"))
    joined = wanted.join(sizes.where("source IS NOT NULL"), "source", "full").unionByName(sizes.where("source IS NULL"), allowMissingColumns=True)
    usable = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("tokens") > 0)
    if total_tokens is None:
        reach = joined.agg(F.min(F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).alias("total"))
    else:
        reach = joined.agg(F.lit(float(total_tokens)).alias("total"))
    rate = F.when(usable, F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.col("total") / F.col("tokens"))).otherwise(0.0)
    planned = cut(joined.crossJoin(F.broadcast(reach)).select(  # one row
        "source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        (rate * F.coalesce("tokens", F.lit(0))).alias("planned_tokens"), F.round(rate, 12).alias("rate"),
    ))
    whole = planned.agg(F.sum("planned_tokens").alias("whole"))
    attainable = F.coalesce(F.col("planned_tokens") / F.nullif("whole", F.lit(0.0)), F.lit(0.0))
    return planned.crossJoin(F.broadcast(whole)).select("source", "target_share", attainable.alias("attainable_share"), "max_repeats", "docs", "tokens", "planned_tokens", "rate")  # one row


def emit_copies(df: DataFrame, rates: DataFrame, key: str, source: str, *, seed: int = 17) -> DataFrame:
    """Rows of ``df``, each floor(rate) times and once more with probability rate - floor(rate), with ``copy_no`` from 1.

    The last copy is decided by a hash of ``key`` and ``seed``, so a rerun or a lost task gives the
    same rows. Rows of sources without rate, null ones included, are not emitted. All columns of
    ``df`` are kept; a column of ``df`` named copy_no is replaced. More rates than ``TARGETS_BROADCAST``
    are joined by shuffle, with the documents of large sources dealt to salts.
    """
    side = rates.where("rate > 0 AND source IS NOT NULL").select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    fraction = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 64 - _BITS) / F.lit(float(1 << _BITS))
    whole = F.floor("__rate")
    copies = (whole + F.when(fraction < F.col("__rate") - whole, 1).otherwise(0)).cast("int")
    return (
        skew_join(df.drop("copy_no").withColumn("__source", F.col(source)), side, "__source", broadcast_rows=TARGETS_BROADCAST)
        .withColumn("__copies", copies).where("__copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .select(*(c for c in df.columns if c != "copy_no"), "copy_no")
    )


def mix(df: DataFrame, targets: DataFrame, *, key: str, source: str, text: str, total_tokens: int | None = None, seed: int = 17, directory: str = DEFAULT_DIR, name: str = "byte_bpe_50k.json") -> DataFrame:
    """The mixed corpus: ``df`` with each document as often as its source's rate asks for; see the functions above."""
    sizes = cut(source_sizes(df, source, text, directory=directory, name=name))
    return emit_copies(df, cut(repetition_rates(sizes, targets, total_tokens=total_tokens)), key, source, seed=seed)


def mixture_shares(df: DataFrame, targets: DataFrame, *, key: str, source: str, text: str, total_tokens: int | None = None, seed: int = 17, directory: str = DEFAULT_DIR, name: str = "byte_bpe_50k.json") -> DataFrame:
    """What :func:`mix` reaches: (source, target_share, attainable_share, max_repeats, docs, tokens, rate, emitted_docs, emitted_tokens, actual_share).

    One row for every target or source; the actual share is of all emitted tokens, null if there are none.
    """
    counted = cut(count_tokens(df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")), "text", directory=directory, name=name))
    sizes = cut(counted.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")))
    rates = cut(repetition_rates(sizes, targets, total_tokens=total_tokens))
    emitted = emit_copies(counted, rates, "key", "source", seed=seed).groupBy("source").agg(F.count(F.lit(1)).alias("emitted_docs"), F.sum("n_tokens").alias("emitted_tokens"))
    full = rates.join(emitted, rates["source"].eqNullSafe(emitted["source"]), "left").drop(emitted["source"])
    tokens = F.coalesce("emitted_tokens", F.lit(0))
    whole = emitted.agg(F.sum("emitted_tokens").alias("whole"))
    return full.crossJoin(F.broadcast(whole)).select(  # one row
        "source", "target_share", "attainable_share", "max_repeats", "docs", "tokens", "rate", F.coalesce("emitted_docs", F.lit(0)).alias("emitted_docs"), tokens.alias("emitted_tokens"),
        (tokens / F.col("whole")).alias("actual_share"),
    )
