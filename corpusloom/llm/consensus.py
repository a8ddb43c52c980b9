"""Consensus labels, agreement and annotator reliability from several annotators' cells."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

from .labels import letters_digits, strip

#: What stands for "nothing marked", in lower case; cells without letters and digits do too.
PLACEHOLDERS = ("n/a",)


@dataclass
class Consensus:
    """Result of :func:`annotator_consensus`.

    ``items``: (item, label, votes, marked, support), one row for each item with a marked cell.
    ``annotators``: (annotator, marked, agreed, reliability).
    ``agreement``: one row (alpha, pairable_items, ratings, rounds).
    """

    items: DataFrame
    annotators: DataFrame
    agreement: DataFrame


def cell_keys(cell: Column) -> Column:
    """Keys of the labels that a cell names, in the order written, each once.

    Labels are split at ``,`` and ``;``. A key is the label in lower case with only letters and
    digits. Null, blank and placeholder cells give an empty array.
    """
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), "[,;]", -1), strip)
    named = F.filter(parts, lambda p: ~F.lower(p).isin(*PLACEHOLDERS))
    return F.array_distinct(F.filter(F.transform(named, letters_digits), lambda k: k != ""))


def _bit(i: int) -> Column:
    return F.lit(1 << i).cast("bigint")


def _votes(cells: list[str]) -> Column:
    """Array of (key, mask): each label of the item with the bits of the annotators who name it, first named first."""
    everything = F.array_distinct(F.concat(*(F.col(c) for c in cells)))
    return F.transform(
        everything,
        lambda k: F.struct(
            k.alias("key"),
            reduce(lambda a, b: a + b, (F.when(F.array_contains(F.col(c), k), _bit(i)).otherwise(F.lit(0).cast("bigint")) for i, c in enumerate(cells))).alias("mask"),
        ),
    )


def _weight(mask: Column, weights: list[float]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(mask.bitwiseAND(_bit(i)) != 0, F.lit(float(w))).otherwise(F.lit(0.0)) for i, w in enumerate(weights)))


def _best(masks: Column, weights: list[float], shared_first: bool) -> Column:
    """1-based place of the winning label: shared ones first if so wished, then by weight, then as first named."""
    scored = F.transform(
        masks,
        lambda m, i: F.struct(
            (F.when(F.bit_count(m) >= 2, 1).otherwise(0) if shared_first else F.lit(0)).alias("shared"),
            F.round(_weight(m, weights), 12).alias("weight"),
            (-i).alias("place"),
        ),
    )
    return F.lit(1) - F.array_max(scored)["place"]


def _loo_hit(masks: Column, annotator: int, weights: list[float], loo: str, shared_first: bool) -> Column:
    """Whether the annotator's cell names the label that the others' votes support."""
    own = _bit(annotator)
    if loo == "any":
        return F.exists(masks, lambda m: (m.bitwiseAND(own) != 0) & (m != own))
    others = F.transform(masks, lambda m: m.bitwiseAND(F.bitwise_not(own)))
    best = F.element_at(masks, _best(others, weights, shared_first).cast("int"))
    return (best.bitwiseAND(own) != 0) & (best != own)


def annotator_consensus(df: DataFrame, item: str, annotators: list[str], *, loo: str = "consensus", shared_first: bool = True, smoothing: float = 1.0, max_rounds: int = 50, tolerance: float = 1e-9) -> Consensus:
    """Consensus of the cells in ``annotators`` (at most 30 columns) by iteratively reweighted voting.

    Rounds alternate between the weighted consensus of each item and the accuracy of each annotator
    against the consensus of the others (leave-one-out), until no weight moves by more than
    ``tolerance``. With ``loo="any"`` the leave-one-out step takes as right what any other person on
    the item names; that does not depend on weights, so the second round finds them stable. The accuracy is ``(agreed + smoothing) / (marked + 2 * smoothing)``,
    over items with at least two marked cells. With ``shared_first`` a label named in two cells goes
    before any label named in one. Ties go to the label named first, in the order of the columns and
    within a cell.

    What a round needs of an item is only which annotators share its labels, so items are counted by
    that pattern once, before the shuffle, and the rounds run over the few patterns.

    The agreement is Krippendorff's alpha for nominal data with missing ratings; the rating of a cell
    is its label with most votes on the item, the first of these. It is null with fewer than two
    pairable ratings, and where all ratings are the same label.

    Repeated rows count once; of different rows with one identifier, the one that sorts first holds.
    Null identifiers and items without any mark are left out. Other columns are not looked at.
    """
    n = len(annotators)
    if not 2 <= n <= 30:
        raise ValueError("between 2 and 30 annotator columns are needed")
    cells = [f"cell_{i}" for i in range(n)]
    keyed = df.where(df[item].isNotNull()).select(df[item].alias("item"), *(cell_keys(df[a]).alias(c) for a, c in zip(annotators, cells)))
    single = keyed.groupBy("item").agg(F.min(F.struct(*cells)).alias("row")).select("item", "row.*")
    marked = reduce(lambda a, b: a + b, (F.when(F.size(c) > 0, 1).otherwise(0) for c in cells))
    items = cut(single.select("item", *cells, _votes(cells).alias("votes"), marked.alias("marked")).where("marked > 0"))

    patterns = cut(
        items.where("marked > 1")
        .select(F.transform("votes", lambda v: v["mask"]).alias("masks"), F.array(*(F.size(c) > 0 for c in cells)).alias("present"))
        .groupBy("masks", "present").agg(F.count(F.lit(1)).alias("items"))
    )
    weights, rounds, counts = [1.0] * n, 0, [(0, 0)] * n
    while rounds < max_rounds:
        rounds += 1
        sums = [
            F.sum(F.when(F.col("present")[i] & hit, F.col("items")).otherwise(0)).alias(f"{what}_{i}")
            for i in range(n)
            for what, hit in (("marked", F.lit(True)), ("agreed", _loo_hit(F.col("masks"), i, weights, loo, shared_first)))
        ]
        row = patterns.agg(*sums).first()
        counts = [(int(row[f"marked_{i}"] or 0), int(row[f"agreed_{i}"] or 0)) for i in range(n)]
        fresh = [(a + smoothing) / (m + 2 * smoothing) if m + smoothing > 0 else 0.5 for m, a in counts]
        moved = max(abs(a - b) for a, b in zip(weights, fresh))
        weights = fresh
        if moved <= tolerance:
            break

    masks = F.transform("votes", lambda v: v["mask"])
    winner = F.element_at("votes", _best(masks, weights, shared_first).cast("int"))
    total = reduce(lambda a, b: a + b, (F.when(F.size(c) > 0, F.lit(w)).otherwise(0.0) for c, w in zip(cells, weights)))
    result = items.select(
        "item", winner["key"].alias("label"), F.bit_count(winner["mask"]).alias("votes"), "marked",
        (_weight(winner["mask"], weights) / total).alias("support"),
    )
    spark = df.sparkSession
    people = spark.createDataFrame([(a, m, g, w) for a, (m, g), w in zip(annotators, counts, weights)], "annotator string, marked bigint, agreed bigint, reliability double")
    return Consensus(result, people, _alpha(items, cells, rounds))


def _alpha(items: DataFrame, cells: list[str], rounds: int) -> DataFrame:
    """Krippendorff's nominal alpha over the items with two marked cells or more."""

    def rating(c: str) -> Column:
        named = F.filter("votes", lambda v: F.array_contains(F.col(c), v["key"]))
        best = F.array_max(F.transform(named, lambda v, i: F.struct(F.bit_count(v["mask"]).alias("n"), (-i).alias("place"), v["key"].alias("key"))))
        return best["key"]

    ratings = items.where("marked > 1").select(F.array_compact(F.array(*(rating(c) for c in cells))).alias("ratings"))
    sized = ratings.withColumn("m", F.size("ratings"))
    same = F.aggregate("ratings", F.lit(0), lambda s, x: s + F.size(F.filter("ratings", lambda y: y == x)) - 1)
    observed = sized.agg(F.count(F.lit(1)).alias("pairable_items"), F.sum("m").alias("given"), F.sum(same / (F.col("m") - 1)).alias("observed"))
    chance = ratings.select(F.explode("ratings").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias("chance"))
    n = F.col("given").cast("double")
    disagreement, expected = 1 - F.col("observed") / n, 1 - F.col("chance") / (n * (n - 1))
    return observed.crossJoin(F.broadcast(chance)).select(  # two aggregates of one row each
        F.when((n > 1) & (expected > 0), 1 - disagreement / expected).alias("alpha"),
        "pairable_items", F.coalesce("given", F.lit(0)).alias("ratings"), F.lit(rounds).alias("rounds"),
    )
