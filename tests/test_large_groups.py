"""Hubs, long lists and hot keys: split, exact, and the same as brute force."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import blocks as B
from corpusloom.operators import graph as G
from corpusloom.operators import metrics as M
from corpusloom.operators import sampling as S
from corpusloom.operators.ordering import exact_quantiles
from corpusloom.operators.skewed import skew_join
from corpusloom.session import spread


@pytest.mark.parametrize("part", [2, 3, 100])
def test_unfolded_lists(spark, part):
    lists = [(1, [5, 3, 9, 1, 7, 2, 8], "x"), (2, [4], "x"), (3, [], "x"), (4, None, "x"), (5, [1, 2], "x")]
    df = spark.createDataFrame(lists, "g long, items array<long>, u string")
    found = sorted(tuple(r) for r in B.unfold_pairs(df, "items", "g", part=part, first="a", second="b").collect())
    assert found == sorted((g, a, b) for g, items, _ in lists for a, b in itertools.combinations(items or [], 2))


def test_a_work_of_three_thousand_concepts(spark):
    mentions = spark.range(3000).select(F.lit(1).alias("work_id"), F.col("id").alias("cid"), F.lit(0).alias("day"), F.lit(1995).alias("y"))
    edges = G.edges_of_mentions(mentions)
    assert edges.count() == 3000 * 2999 // 2 and edges.where("u >= v").count() == 0


def test_hubs_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_NEIGHBOURS", 7)
    links = sorted({(0, i) for i in range(1, 60)} | {(i, i + 1) for i in range(1, 59)})
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected = Counter(p for held in near.values() for p in itertools.combinations(sorted(held), 2))
    snap = spark.createDataFrame(links, "u long, v long").withColumn("links", F.lit(1))
    assert {(r["u"], r["v"]): r["common"] for r in G.two_step_pairs(snap).collect()} == expected
    asked = [(0, 1), (3, 5), (1, 59), (7, 99), (98, 99)]
    found = G.common_neighbours(snap, spark.createDataFrame(asked, "u long, v long"))
    assert {(r["u"], r["v"]): r["common"] for r in found.collect()} == {p: len(near.get(p[0], set()) & near.get(p[1], set())) for p in asked}
    assert G.two_step_pairs(snap.limit(0)).count() == 0


@pytest.mark.parametrize(("hot_rows", "broadcast_rows"), [(50, 0), (10_000, 0), (50, 1000), (1, 0)])
def test_skewed_joins(spark, hot_rows, broadcast_rows):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 1)], "k long, i long")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 300, 2)] + [(1, "hot")], "k long, r string")
    rights = {r["k"]: r["r"] for r in right.collect()}
    expected = sorted((r["k"], r["i"], rights[r["k"]]) for r in left.collect() if r["k"] in rights)
    found = skew_join(left, right, "k", hot_rows=hot_rows, salts=4, broadcast_rows=broadcast_rows)
    assert sorted(tuple(r) for r in found.select("k", "i", "r").collect()) == expected
    semi = skew_join(left, right, "k", hot_rows=hot_rows, salts=4, broadcast_rows=broadcast_rows, how="left_semi")
    assert sorted(r["i"] for r in semi.collect()) == sorted(x[1] for x in expected)
    assert skew_join(left.limit(0), right, "k", hot_rows=hot_rows, broadcast_rows=broadcast_rows).count() == 0


def test_quantiles_by_counts(spark):
    values = [float(x) for x in np.random.default_rng(1).integers(0, 40, 501)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    assert exact_quantiles(df, "v", shares) == pytest.approx({p: float(np.quantile(values, p)) for p in shares})
    assert exact_quantiles(df.limit(0), "v", [0.5]) == {0.5: None}
    one = spark.createDataFrame([(0.5, 1)], "score double, label int")
    assert [tuple(r) for r in M.calibration(one).collect()] == [(0, 1, 0.5, 1.0)] and M.calibration(one.limit(0)).count() == 0


def dense(spark, n):
    """All pairs of n nodes but those of neighbours on a ring."""
    return spark.createDataFrame([(a, b) for a, b in itertools.combinations(range(n), 2) if (b - a) % n not in (1, n - 1)], "u long, v long")


def test_all_unlinked_pairs_of_a_dense_graph_are_found(spark):
    nodes = spark.range(12)
    found = sorted(tuple(r) for r in S.unlinked_pairs(nodes, [dense(spark, 12)], 12).select("u", "v").collect())
    assert found == sorted((min(a, (a + 1) % 12), max(a, (a + 1) % 12)) for a in range(12))
    with pytest.raises(ValueError, match="12 unlinked pairs are fewer"):
        S.unlinked_pairs(nodes, [dense(spark, 12)], 13)


@pytest.mark.parametrize("block", [2, 5000])
def test_candidates_come_once(spark, block):
    links = [(1, 2), (2, 3), (4, 9), (5, 6)]
    snap = spark.createDataFrame(links, "u long, v long")
    for sources, targets in (([1, 2, 5, 5], [2, 3, 5, 6, 7]), ([3, 4, 9], [3, 4, 9]), ([], [1]), ([1], [])):
        s, t = (spark.createDataFrame([(i,) for i in ids], "id long") for ids in (sources, targets))
        expected = {(min(a, b), max(a, b)) for a in sources for b in targets if a != b} - set(links)
        assert sorted(tuple(r) for r in S.candidates_between(s, t, snap, block=block).select("u", "v").collect()) == sorted(expected)


def test_candidates_are_written_small_and_by_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(9)
    ids = [int(i) for i in rng.choice(100_000, 4000, replace=False)]
    links = {(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:])}
    snap, sources, targets = spark.createDataFrame(sorted(links), "u long, v long"), spark.createDataFrame([(i,) for i in ids[:600]], "id long"), spark.createDataFrame([(i,) for i in ids], "id long")
    S.candidates_between(sources, targets, snap, block=500).write.parquet(str(tmp_path / "pairs"))
    found = spark.read.parquet(str(tmp_path / "pairs"))
    expected = len({(min(a, b), max(a, b)) for a in ids[:600] for b in ids if a != b} - links)
    assert found.count() == found.distinct().count() == expected and found.join(snap, ["u", "v"]).count() == 0
    files = list((tmp_path / "pairs").glob("*.parquet"))
    assert len(files) >= 3 * spark.sparkContext.defaultParallelism
    assert sum(f.stat().st_size for f in files) < 0.3 * expected


@pytest.mark.parametrize("per_source", [1, 3, 50])
def test_rounds_reach_every_candidate(spark, per_source):
    snap = dense(spark, 12)
    sources, targets = spark.createDataFrame([(0,), (5,), (7,)], "id long"), spark.range(12)
    expected = {(min(s, t), max(s, t)) for s in (0, 5, 7) for t in range(12) if s != t} - {tuple(r) for r in snap.collect()}
    found = [tuple(r) for r in S.sampled_candidates(sources, targets, snap, 1000, per_source=per_source, idle=12).select("u", "v").collect()]
    assert sorted(found) == sorted(expected)
    assert S.sampled_candidates(sources, targets, snap, 2, per_source=per_source, idle=12).count() == 2
    assert S.sampled_candidates(sources, targets.limit(0), snap, 2, per_source=per_source).count() == 0


def test_balanced_batches(spark):
    rows = spark.createDataFrame([(i, 1 if i < 3 else 0 if i < 50 else None) for i in range(60)], "k long, label int")
    drawn = S.balanced_batch(rows, "k", "label", 100, 0.4).collect()
    assert len(drawn) == 100 and sum(r["label"] for r in drawn) == 40 and {r["k"] for r in drawn if r["label"]} <= {0, 1, 2}
    with pytest.raises(ValueError):
        S.balanced_batch(rows.where("label = 0"), "k", "label", 10, 0.5)


def test_features_of_years_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(w, int(a), int(b), int(d), 1995) for w, (a, b, d) in enumerate(zip(rng.integers(0, 9, 60), rng.integers(9, 18, 60), rng.integers(0, 30, 60)))]
    edges = spark.createDataFrame(rows, "work_id long, u long, v long, day int, y int")
    found = {r["id"]: r for r in G.node_features(edges, {1: 10, 2: 20}, binary=False).collect()}
    for year, day in ((1, 10), (2, 20)):
        links = Counter((u, v) for _, u, v, d, _ in rows if d < day)
        degree = Counter()
        for (u, v), n in links.items():
            degree[u] += n
            degree[v] += n
        hops = Counter()
        for (u, v), n in links.items():
            hops[u] += n * degree[v]
            hops[v] += n * degree[u]
        assert {i: (r[f"degree_{year}"], r[f"two_hop_{year}"]) for i, r in found.items()} == {i: (degree[i], hops[i]) for i in found}


def test_a_scan_of_many_splits_is_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).repartition(6).write.parquet(path)
    plain = spark.read.parquet(path).where("id > 3").select("t")
    assert spread(plain).rdd.getNumPartitions() == 12  # three a core
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        fresh = spark.read.parquet(path).where("id > 3").select("t")
        assert "Exchange" not in spread(fresh)._jdf.queryExecution().executedPlan().toString() and spread(fresh).count() == 49_996
        assert "Exchange" in spread(fresh, "t")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
