"""Ranking and classification metrics over (label, score) tables of any size.

Scores are grouped first, so what is ordered is the distinct scores; running sums are those of
:mod:`corpusloom.operators.ordering`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

from .ordering import exact_quantiles, top_per_group, with_row_number, with_running_sums


def by_score(df: DataFrame) -> DataFrame:
    """(score, pos, neg) for each distinct score."""
    return df.groupBy("score").agg(F.sum(F.col("label").cast("bigint")).alias("pos"), F.sum(1 - F.col("label").cast("bigint")).alias("neg"))


def roc_auc(df: DataFrame) -> DataFrame:
    """One row (auc); ties count half, null without both labels."""
    run = with_running_sums(by_score(df), [F.col("score").asc()], {"neg_until": "neg"})
    below = F.col("neg_until") - F.col("neg")
    area = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    return run.agg(F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def roc_points(df: DataFrame) -> DataFrame:
    """(score, fpr, tpr) for each distinct score taken as the threshold, all kept."""
    run = with_running_sums(by_score(df), [F.col("score").desc()], {"tp": "pos", "fp": "neg"})
    totals = run.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))  # one row
    return run.crossJoin(F.broadcast(totals)).select("score", F.try_divide(F.col("fp"), F.col("n")).alias("fpr"), F.try_divide(F.col("tp"), F.col("p")).alias("tpr"))


def precision_recall(df: DataFrame) -> DataFrame:
    """(score, precision, recall) for each distinct score taken as the threshold."""
    run = with_running_sums(by_score(df), [F.col("score").desc()], {"tp": "pos", "fp": "neg"})
    totals = run.agg(F.sum("pos").alias("p"))  # one row
    return run.crossJoin(F.broadcast(totals)).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp"), F.col("p")).alias("recall"), "pos", "p")


def average_precision(df: DataFrame) -> DataFrame:
    """One row (average_precision, prevalence)."""
    counts = df.agg(F.avg(F.col("label").cast("double")).alias("prevalence"))  # one row
    points = precision_recall(df)
    return points.agg(F.sum(F.try_divide(F.col("pos"), F.col("p")) * F.col("precision")).alias("average_precision")).crossJoin(F.broadcast(counts))


def confusion(df: DataFrame, thresholds: list[float], strict: bool = True) -> DataFrame:
    """(threshold, tn, fp, fn, tp, precision, recall, f1) for each threshold, in one pass over the rows; undefined ratios are 0."""
    aggregates = []
    for i, t in enumerate(thresholds):
        hit = F.col("score") > t if strict else F.col("score") >= t
        for name, c in (("tn", ~hit & (F.col("label") == 0)), ("fp", hit & (F.col("label") == 0)), ("fn", ~hit & (F.col("label") == 1)), ("tp", hit & (F.col("label") == 1))):
            aggregates.append(F.count_if(c).alias(f"{name}_{i}"))
    wide = df.agg(*aggregates)  # one row
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), *(F.col(f"{n}_{i}").alias(n) for n in ("tn", "fp", "fn", "tp"))) for i, t in enumerate(thresholds)))
    long = wide.select(F.inline(rows))
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return long.withColumns({"precision": precision, "recall": recall}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def at_k(df: DataFrame, ks: list[int], order: list[Column], groups: list[str] | None = None) -> DataFrame:
    """(k, tp, precision_at_k, recall_at_k), or per group within one global ranking (k, group, tp, recall_at_k, share_at_k).

    Only the ``max(ks)`` best rows are ranked; k beyond the number of rows is that number.
    """
    top = cut(df.orderBy(*order).limit(max(ks)))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most max(ks) rows
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("p"))  # one row
    levels = df.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    hits = ranked.join(F.broadcast(levels), F.col("rank") <= F.col("k"))
    if not groups:
        found = hits.groupBy("k").agg(F.sum(F.col("label").cast("bigint")).alias("tp"))
        out = levels.join(found, "k", "left").crossJoin(F.broadcast(totals))
        tp = F.coalesce("tp", F.lit(0))
        return out.select("k", tp.alias("tp"), F.try_divide(tp, F.least("k", "n")).alias("precision_at_k"), F.coalesce(F.try_divide(tp, F.col("p")), F.lit(0.0)).alias("recall_at_k"))
    found = hits.where("label = 1").groupBy("k", *groups).agg(F.count(F.lit(1)).alias("tp"))
    whole = df.where("label = 1").groupBy(*groups).agg(F.count(F.lit(1)).alias("positives"))
    every = found.groupBy("k").agg(F.sum("tp").alias("all_tp"))
    return found.join(whole, groups).join(every, "k").select("k", *groups, "tp", (F.col("tp") / F.col("positives")).alias("recall_at_k"), (F.col("tp") / F.col("all_tp")).alias("share_at_k"))


def hit_at_k(df: DataFrame, source: str, ks: list[int], order: list[Column]) -> DataFrame:
    """(k, sources, hits, hit_rate): sources with a positive among their k best rows, of those that have one at all."""
    best = top_per_group(df, [source], order, max(ks)).where("label = 1").groupBy(source).agg(F.min("rank").alias("first"))
    counts = best.agg(*(F.count_if(F.col("first") <= k).alias(f"k{k}") for k in ks))
    sources = df.where("label = 1").select(source).distinct().agg(F.count(F.lit(1)).alias("sources"))
    wide = counts.crossJoin(F.broadcast(sources))  # one row each
    return wide.select("sources", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hits")) for k in ks)))).withColumn("hit_rate", F.try_divide(F.col("hits"), F.col("sources")))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, mean_label) by equally filled bins; exact percentiles, interpolated, empty bins left out."""
    found = exact_quantiles(df, "score", [i / bins for i in range(1, bins)])
    edges = F.array(*(F.lit(e) for e in found.values()))
    placed = df.withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col("score"))))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("mean_label"))


def brier(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("label") - F.col("score")) * (F.col("label") - F.col("score"))).alias("brier"))


def blend_search(df: DataFrame, first: str, second: str, steps: int = 10) -> DataFrame:
    """(weight, auc) for weights 0 to 1 of ``first``; blended scores are rounded to nine digits, so that equal ones stay ties.

    All weights go in one pass: rows are counted by (weight, score) before the shuffle and ordered once.
    """
    weights = F.array(*(F.lit(i / steps) for i in range(steps + 1)))
    blended = df.select("label", first, second, F.explode(weights).alias("weight")).select("weight", "label", F.round(F.col("weight") * F.col(first) + (1 - F.col("weight")) * F.col(second), 9).alias("score"))
    counts = blended.groupBy("weight", "score").agg(F.sum(F.col("label").cast("bigint")).alias("pos"), F.sum(1 - F.col("label").cast("bigint")).alias("neg"))
    run = with_running_sums(counts, [F.col("weight").asc(), F.col("score").asc()], {"neg_until": "neg"})
    totals = run.groupBy("weight").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), (F.min(F.col("neg_until") - F.col("neg"))).alias("before"))  # one row a weight
    below = F.col("neg_until") - F.col("neg") - F.col("before")
    area = run.join(F.broadcast(totals), "weight").groupBy("weight").agg(F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("area"), F.first("p").alias("p"), F.first("n").alias("n"))
    return area.select("weight", F.try_divide("area", F.col("p").cast("double") * F.col("n")).alias("auc"))


def lorenz(counts: DataFrame, value: str, *order: Column) -> DataFrame:
    """(rank, share): cumulative share of ``value`` by ascending rank."""
    numbered = with_row_number(counts, *order, name="rank")
    run = with_running_sums(numbered.select("rank", F.col(value).alias("value")), [F.col("rank").asc()], {"until": "value"})
    total = run.agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))  # one row
    return run.crossJoin(F.broadcast(total)).select("rank", (F.col("until") / F.col("total") * 100).alias("share"), (F.try_divide(F.col("rank") - 1, F.col("n") - 1) * 100).alias("position"))
