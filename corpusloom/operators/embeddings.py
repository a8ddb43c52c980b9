"""Vectors of concepts: averages, pair inputs, neighbours, and models applied to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut, spread

from .ordering import top_per_group


def vector_means(df: DataFrame, key: str, vector: str, size: int, when: Column | None = None) -> DataFrame:
    """(``key``, vec, n): mean of the vectors of each key, of rows where ``when`` holds if there are any, else of all.

    Each place is an aggregate of its own, so vectors are summed before the shuffle and never unfolded.
    """
    condition = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    at = [F.get(F.col(vector), i).cast("double") for i in range(size)]
    chosen = [F.coalesce(F.avg(F.when(condition, x)), F.avg(x)) for x in at]
    return df.groupBy(key).agg(F.array(*chosen).alias("vec"), F.count(F.lit(1)).alias("n"))


def two_level_means(df: DataFrame, keys: list[str], group: str, vector: str, size: int) -> DataFrame:
    """Mean over ``group`` of the means within (keys, group): an item of many parts weighs as one."""
    inner = [F.avg(F.get(F.col(vector), i).cast("double")).alias(f"__v{i}") for i in range(size)]
    first = df.groupBy(*keys, group).agg(*inner)
    return first.groupBy(*keys).agg(F.array(*(F.avg(f"__v{i}") for i in range(size))).alias("vec"))


def pair_inputs(pairs: DataFrame, nodes: DataFrame, features: list[str], vectors: list[str] = ()) -> DataFrame:
    """``pairs`` with ``inputs``: node features of u and v, then vectors of u and v; pairs without both are left out."""
    out = pairs
    for end in ("u", "v"):
        out = out.join(nodes.select(F.col("id").alias(end), *(F.col(c).alias(f"__{end}_{c}") for c in [*features, *vectors])), end)
    own = lambda end: F.array(*(F.col(f"__{end}_{c}").cast("double") for c in features)) if features else F.array().cast("array<double>")
    parts = [own("u"), own("v"), *(F.col(f"__{end}_{c}").cast("array<double>") for end in ("u", "v") for c in vectors)]
    return out.select(*pairs.columns, F.concat(*parts).alias("inputs"))


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 2048) -> DataFrame:
    """(query, neighbour, distance, rank): the ``k`` rows closest to each query, without itself; ties by key.

    Exact: the stated queries go to the rows in blocks of at most ``block``; each task keeps its best k
    for each query, and these are merged.
    """
    spark = rows.sparkSession
    marked = cut(queries.select(F.col(key).alias("query"), F.col(vector).alias("vec")).where("vec IS NOT NULL").distinct())
    parts = max(1, -(-marked.count() // block))
    held = cut(spread(rows.select(F.col(key).alias("key"), F.col(vector).alias("vec")).where("vec IS NOT NULL")))
    best = None
    for part in range(parts):
        chosen = (marked if parts == 1 else marked.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part)).toPandas()  # about a block
        shared = spark.sparkContext.broadcast((chosen["query"].to_numpy(), np.array(chosen["vec"].tolist(), np.float64).reshape(len(chosen), -1)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, points = shared.value
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                own = np.array(batch["vec"].tolist(), np.float64)
                square = (points**2).sum(1)[:, None] + (own**2).sum(1)[None, :] - 2 * points @ own.T
                keys = batch["key"].to_numpy()
                square[ids[:, None] == keys[None, :]] = np.inf
                order = np.lexsort((np.broadcast_to(keys, square.shape), square), axis=1)[:, :k]
                q = np.repeat(np.arange(len(ids)), order.shape[1])
                r = order.ravel()
                exact = np.sqrt(((points[q] - own[r]) ** 2).sum(1))
                frame = pd.DataFrame({"query": ids[q], "neighbour": keys[r], "distance": exact})
                yield frame[np.isfinite(square[q, r])]

        near = held.mapInPandas(run, "query bigint, neighbour bigint, distance double")
        best = near if best is None else best.unionByName(near)
    return top_per_group(best, ["query"], [F.col("distance"), F.col("neighbour")], k)


def to_matrix_rows(vectors: DataFrame, size: int) -> DataFrame:
    """(id, vec) for every id from 0 to the greatest, zeros where there is none."""
    most = vectors.agg(F.max("id")).first()[0]
    ids = vectors.sparkSession.range(0, (most if most is not None else -1) + 1)
    return ids.join(vectors, "id", "left").select("id", F.coalesce("vec", F.array_repeat(F.lit(0.0), size)).alias("vec"))


def fit_pair_classifier(pairs: DataFrame, inputs: str = "inputs", label: str = "label", iterations: int = 50):
    """A logistic model over pair inputs, trained on the cluster."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = pairs.select(array_to_vector(F.col(inputs)).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=iterations, standardization=True).fit(data)


def geometric_sizes(first: int, factor: float, layers: int, last: int = 1) -> list[int]:
    """Layer sizes that shrink by ``factor``."""
    sizes = [first]
    for _ in range(layers):
        sizes.append(int(sizes[-1] * factor))
    return [*sizes, last]


def grid(settings: dict[str, list]) -> list[dict]:
    """All combinations of the settings, later names changing fastest."""
    out: list[dict] = [{}]
    for name, values in settings.items():
        out = [{**one, name: v} for one in out for v in values]
    return out


def cubic_trend(points: DataFrame, x: str, y: str, ahead: int = 2) -> DataFrame:
    """(x, y, fitted): a cubic through yearly values by least squares, and its values for ``ahead`` more steps.

    Only sums of powers of the centred and scaled x are gathered, one row whatever the table's size.
    """
    spark = points.sparkSession
    middle, width, last = points.agg(F.avg(x), F.greatest(F.max(x) - F.min(x), F.lit(1)), F.max(x)).first()
    if middle is None:
        return points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(None).cast("double").alias("fitted"))
    t = (F.col(x) - middle) / width
    sums = points.agg(*(F.sum(F.pow(t, i)).alias(f"p{i}") for i in range(7)), *(F.sum(F.pow(t, i) * F.col(y)).alias(f"q{i}") for i in range(4))).first()
    a = np.array([[sums[f"p{i + j}"] for j in range(4)] for i in range(4)], float)
    c = np.linalg.lstsq(a, np.array([sums[f"q{i}"] for i in range(4)], float), rcond=None)[0]
    more = spark.range(1, ahead + 1).select((F.col("id") + F.lit(float(last))).alias("x"), F.lit(None).cast("double").alias("y"))
    rows = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).unionByName(more)
    s = (F.col("x") - F.lit(float(middle))) / F.lit(float(width))
    return rows.withColumn("fitted", sum((float(k) * F.pow(s, i) for i, k in enumerate(c)), F.lit(0.0)))
