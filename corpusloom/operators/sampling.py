"""Pair sets and candidate pairs, drawn by a fixed arithmetic hash instead of a random generator.

The hash ``(u * 1000003 + v * 7919 + seed * 104729) mod 2147483647`` is the order of every draw, so
that the same input gives the same rows on any cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import broadcast_if_small, cut, released, stored

from .graph import nodes_of


def pair_hash(u: Column, v: Column, seed: int = 42) -> Column:
    return F.pmod(u * 1000003 + v * 7919 + F.lit(seed * 104729), F.lit(2147483647))


def drawn_place(k: Column, count: int | Column, seed: int) -> Column:
    """The k-th draw among ``count`` places: x * x + x of a linear hash x of k, modulo a prime; plain integer arithmetic, the same in any engine."""
    x = F.pmod(k * 1000003 + F.lit(seed * 104729), F.lit(2147483647))
    return F.pmod(F.pmod(x * x + x, F.lit(2147483647)), F.lit(count) if isinstance(count, int) else count)


def canonical(pairs: DataFrame) -> DataFrame:
    return pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


#: Rows up to which a task may hold the first ones by hash, and ranges of hashes that are counted where it may not.
HELD_FIRST, HASH_RANGES = 100_000, 1 << 16


def first_by_hash(pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` pairs with the smallest hash, ties by u and v.

    Many are not held in one task: hashes are counted by range, the pairs of the ranges before the n-th
    come whole and only those of its range are ordered. ``pairs`` are read three times then.
    """
    key = pair_hash(F.col("u"), F.col("v"), seed)
    if n <= HELD_FIRST:
        return pairs.orderBy(key, "u", "v").limit(n)
    place = F.floor(key * HASH_RANGES / F.lit(2147483647)).cast("int")
    rest = n
    for r in sorted(pairs.groupBy(place.alias("place")).count().collect()):  # HASH_RANGES rows at most
        if r["count"] >= rest:
            return pairs.where(place < r["place"]).unionByName(pairs.where(place == r["place"]).orderBy(key, "u", "v").limit(rest))
        rest -= r["count"]
    return pairs


def unlinked_pairs(nodes: DataFrame, snaps: list[DataFrame], n: int, seed: int = 42, over: int = 3, rounds: int = 12) -> DataFrame:
    """``n`` pairs of nodes linked in none of ``snaps``, drawn by hash; fails where there are fewer.

    The k-th draw hashes k into two node ranks, ``over`` times as many draws as pairs are wanted and
    four times more each round until enough are left; all pairs of nodes are not built. How many there
    are is counted from the linked ones first. Where a graph is so dense that the draws would be more
    than all its pairs, or ``rounds`` are over, each node's free partners are listed instead, which is
    not more then.
    """
    from .ordering import with_row_number

    spark = nodes.sparkSession
    ranked = cut(with_row_number(nodes.select("id").distinct(), F.col("id"), name="rank", start=0))
    count = ranked.count()
    if len(snaps) == 1:
        linked = snaps[0].select("u", "v")
    else:
        linked = stored(reduce(DataFrame.unionByName, [s.select("u", "v") for s in snaps]).distinct(), "u", "v") if snaps else spark.createDataFrame([], "u bigint, v bigint")
    ranked = broadcast_if_small(ranked, 2_000_000)
    inside = linked.join(ranked.select(F.col("id").alias("u")), "u", "left_semi").join(ranked.select(F.col("id").alias("v")), "v", "left_semi")
    free = count * (count - 1) // 2 - inside.count()
    if free < n:
        raise ValueError(f"{free} unlinked pairs are fewer than the {n} asked for")
    draws = max(64, n * over)
    # only the smallest hashes are wanted: of many draws those beyond a bound that leaves enough are not compared
    below = int(2147483647 * min(1.0, 1.25 * n / draws)) if n > HELD_FIRST else 2147483647
    for _ in range(rounds):
        if draws >= count * count:
            break
        drawn = spark.range(draws).select(drawn_place(F.col("id"), count, seed).alias("a"), drawn_place(F.col("id"), count, seed + 1).alias("b"))
        ids = drawn.where("a != b").join(ranked.select(F.col("rank").alias("a"), F.col("id").alias("u")), "a").join(ranked.select(F.col("rank").alias("b"), F.col("id").alias("v")), "b")
        for bound in sorted({below, 2147483647}):
            some = canonical(ids.select("u", "v")).where(pair_hash(F.col("u"), F.col("v"), seed) < bound).distinct()
            found = stored(some.join(linked, ["u", "v"], "left_anti"), "u", "v")
            if found.count() >= n:
                return first_by_hash(found, n, seed)
        draws *= 4
    # so dense or so much wanted that the draws would come to all pairs: list them, in ranges of ranks
    every = ranked.select(F.col("id").alias("u"), F.explode(F.when(F.col("rank") + 1 < count, F.sequence(F.col("rank") + 1, F.lit(count - 1)))).alias("rank")).join(ranked.select("rank", F.col("id").alias("v")), "rank")
    return first_by_hash(canonical(every.select("u", "v")).join(linked, ["u", "v"], "left_anti"), n, seed)


def labelled_pairs(edges: DataFrame, past_day: int, future_day: int, *, n: int | None = None, negatives: float | None = None, min_links: int = 1, seed: int = 42) -> DataFrame:
    """(u, v, label): all new pairs, filled up with pairs linked neither before nor after.

    To ``n`` in all, which fails if there are more new pairs, or with ``negatives`` times as many as
    there are new ones, rounded down.
    """
    last = max(past_day, future_day)
    counted = edges.where(F.col("day") < last).groupBy("u", "v").agg(F.min("day").alias("day"), F.count_if(F.col("day") < future_day).alias("links"))
    every = stored(counted, "u", "v")
    known = cut(nodes_of(every.where(F.col("day") < past_day)))
    fresh = every.where((F.col("day") >= past_day) & (F.col("links") >= max(min_links, 1)))
    for end in ("u", "v"):
        fresh = fresh.join(broadcast_if_small(known.withColumnRenamed("id", end), 2_000_000), end, "left_semi")
    positives = stored(fresh.select("u", "v"), "u", "v")
    have = positives.count()
    n = have + int(have * (negatives or 0.0)) if n is None else n
    if have > n:
        raise ValueError(f"{have} positive pairs are more than the {n} asked for")
    others = unlinked_pairs(known, [every], n - have, seed)
    return positives.withColumn("label", F.lit(1)).unionByName(others.withColumn("label", F.lit(0)))


def stratified_pairs(pairs: DataFrame, n: int, ratio: float, seed: int = 42) -> DataFrame:
    """``n`` labelled pairs with round(n * ratio) positives, drawn by hash within each label; fails if there are too few."""
    wanted = round(n * ratio)
    parts = []
    for label, k in ((1, wanted), (0, n - wanted)):
        part = cut(first_by_hash(pairs.where(F.col("label") == label), k, seed))
        if part.count() < k:
            raise ValueError(f"fewer than {k} pairs with label {label}")
        parts.append(part)
    return parts[0].unionByName(parts[1])


def split_pairs(pairs: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``pairs`` with ``split`` train or val, by hash, so that it does not depend on partitions."""
    return pairs.withColumn("split", F.when(pair_hash(F.col("u"), F.col("v"), seed + 1) % 100 < round(share * 100), "train").otherwise("val"))


#: Sources of a run of :func:`candidates_between`, and targets of a task, about, which a Parquet dictionary of 1 MB still names.
RUN, TASK_TARGETS = 256, 50_000


def candidates_between(sources: DataFrame, targets: DataFrame, snap: DataFrame, most_degree: int | None = None, block: int = 5000) -> DataFrame:
    """Distinct canonical pairs of a source and a target that are not linked.

    Sources are a stated set; they go to the tasks that hold the targets in blocks of at most ``block``
    ids, so what is sent does not grow with them. A target with more neighbours than ``most_degree`` is
    left out. The result has as many rows as there are such pairs, and is not shuffled: a target knows
    which sources of a block it is linked to, and a pair that both ends could give comes from the
    smaller one as source only.

    A task gives its pairs by runs of ``RUN`` ascending sources, and all its targets within each: one end
    stays for a run and the other repeats with every target, which a compressed column keeps in a small
    part of what pairs take in any other order.
    """
    from .graph import both_ways, degrees
    from .ordering import with_row_number

    kept = targets.select(F.col("id").alias("v")).distinct()
    if most_degree is not None:
        low = degrees(snap).where(F.col("degree") <= most_degree).select(F.col("id").alias("v"))
        kept = kept.join(low, "v", "left_semi")
    asked = cut(sources.select(F.col("id").alias("u")).distinct())
    spark = snap.sparkSession
    released(spark)  # shuffles that made the snapshot, which else stay while all pairs are written
    kept = kept.join(asked.select(F.col("u").alias("v"), F.lit(True).alias("v_asks")), "v", "left").withColumn("v_asks", F.coalesce("v_asks", F.lit(False)))
    kept = cut(kept)
    # given, and after the last join, as targets are few bytes for what is made of them and would be put into one task
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // TASK_TARGETS))
    asked = asked.join(kept.select(F.col("v").alias("u"), F.lit(True).alias("u_kept")), "u", "left").withColumn("u_kept", F.coalesce("u_kept", F.lit(False)))
    asked = cut(with_row_number(asked, F.col("u"), name="row", start=0).withColumn("part", F.floor(F.col("row") / block)))
    near = cut(both_ways(snap.select("u", "v")).select(F.col("id").alias("v"), F.col("other").alias("u")).join(broadcast_if_small(asked.select("u", "part"), 2_000_000), "u"))
    out, count = None, asked.count()
    for part in range(max(1, -(-count // block))):
        linked = near.where(F.col("part") == part).groupBy("v").agg(F.collect_set("u").alias("linked"))  # a block at most
        some = asked.where(F.col("part") == part).select("row", "u", "u_kept")
        first, last = part * block, max(part * block, min((part + 1) * block, count) - 1)
        one = kept.join(linked, "v", "left").repartitionByRange(tasks, "v").withColumn("run", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(RUN)))).sortWithinPartitions("run", "v")
        one = one.withColumn("row", F.explode(F.sequence("run", F.least(F.col("run") + RUN - 1, F.lit(last))))).join(F.broadcast(some), "row")  # a block of stated sources
        one = one.where("u != v AND NOT (u > v AND v_asks AND u_kept)").where(~F.coalesce(F.array_contains("linked", F.col("u")), F.lit(False)))
        pairs = one.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def sampled_candidates(sources: DataFrame, targets: DataFrame, snap: DataFrame, n: int, *, per_source: int, most_degree: int | None = None, seed: int = 42, idle: int = 3) -> DataFrame:
    """At most ``n`` distinct canonical pairs of a source and a target that are not linked, drawn in rounds.

    A round gives each source the next ``per_source`` targets of its own order; rounds end when there
    are ``n`` pairs, or when ``idle`` of them one after another bring none. The order of a source walks
    the ranks of the targets from a hashed start with a hashed step that has no factor in common with
    their number, so every target comes once and no product of sources and targets is built: a round
    makes ``per_source`` rows a source. Of the last round the pairs with the smallest hash are kept.
    """
    from .graph import degrees
    from .ordering import with_row_number

    kept = targets.select("id").distinct()
    if most_degree is not None:
        kept = kept.join(degrees(snap).where(F.col("degree") <= most_degree).select("id"), "id", "left_semi")
    ranked = cut(with_row_number(kept, F.col("id"), name="rank", start=0))
    count = ranked.count()
    asked = sources.select(F.col("id").alias("a")).distinct()
    if not count:
        return canonical(asked.select(F.col("a").alias("u"), F.col("a").alias("v"))).limit(0)
    # of 128 numbers in a row one has no factor in common with any number below 2 ** 63
    tried = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.pmod(F.xxhash64("a", F.lit(seed + 1)), F.lit(count)) + i + 1)
    steps = [p for p in range(2, int(count**0.5) + 1) if count % p == 0]
    primes = [p for p in steps if all(p % q for q in range(2, int(p**0.5) + 1))]
    rest = count
    for p in primes:
        while rest % p == 0:
            rest //= p
    primes += [rest] if rest > 1 else []
    free = F.filter(tried, lambda s: reduce(lambda x, y: x & y, (s % p != 0 for p in primes), F.lit(True)))
    walkers = cut(asked.select("a", F.pmod(F.xxhash64("a", F.lit(seed)), F.lit(count)).alias("start"), F.get(free, 0).alias("step")))
    linked, found, have, empty, done = cut(snap.select("u", "v")), None, 0, 0, 0
    while have < n and empty < idle and done < count:
        places = F.sequence(F.lit(done), F.lit(min(done + per_source, count) - 1))
        drawn = walkers.select("a", F.explode(places).alias("k"), "start", "step").select("a", F.pmod((F.col("start").cast("decimal(38,0)") + F.col("k") * F.col("step").cast("decimal(20,0)")), F.lit(count).cast("decimal(20,0)")).cast("bigint").alias("rank"))
        fresh = canonical(drawn.join(ranked, "rank").select(F.col("a").alias("u"), F.col("id").alias("v"))).distinct().join(linked, ["u", "v"], "left_anti")
        if found is not None:
            fresh = fresh.join(found.select("u", "v"), ["u", "v"], "left_anti")
        fresh = cut(first_by_hash(fresh, n - have, seed))
        new = fresh.count()
        found, have, empty, done = fresh if found is None else found.unionByName(fresh), have + new, 0 if new else empty + 1, done + per_source
    return found


def balanced_batch(df: DataFrame, key: str, label: str, n: int, share: float, seed: int = 42, keep: list[str] = ()) -> DataFrame:
    """``n`` rows (draw, ``key``, ``label``, ``keep``...) drawn with replacement, round(n * share) of them with label 1.

    The k-th draw of a class hashes k into a rank of its rows by ``key``. Fails if a class that is
    asked for has no rows; null labels are in neither.
    """
    from .ordering import with_row_number

    positives, parts, spark = round(n * share), [], df.sparkSession
    for value, wanted, first in ((1, positives, 0), (0, n - positives, positives)):
        ranked = with_row_number(df.where(F.col(label) == value).select(key, label, *keep), F.col(key), name="rank", start=0, compact=True)
        count = ranked.count()
        if wanted and not count:
            raise ValueError(f"no row with label {value}")
        drawn = spark.range(first, first + wanted).select(F.col("id").alias("draw"), F.pmod(pair_hash(F.col("id"), F.lit(value), seed), F.lit(max(count, 1))).alias("rank"))
        parts.append(drawn.join(ranked, "rank").select("draw", key, label, *keep))
    return parts[0].unionByName(parts[1])


def allowed_nodes(ids: DataFrame, snap: DataFrame, least_degree: int = 1) -> DataFrame:
    """The ids that are in the snapshot with at least ``least_degree`` neighbours."""
    from .graph import degrees

    return ids.select("id").distinct().join(degrees(snap).where(F.col("degree") >= least_degree).select("id"), "id", "left_semi")
