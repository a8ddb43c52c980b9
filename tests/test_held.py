"""Graphs held in files against brute force, and draws of many pairs without a task that holds them."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.operators import held as H
from corpusloom.operators import models as N
from corpusloom.operators import sampling as S
from tests.test_whole_jobs import brute_distances, neighbours

DRAW = random.Random(5)
WORKS = [(k, *sorted(DRAW.sample(range(100, 400, 3), 2)), DRAW.randrange(30)) for k in range(400)] + [(900, 1000, 1001, 3), (901, 1000, 1001, 25)]
DAYS = {1: 10, 2: 20}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(WORKS, "work_id long, u long, v long, day int")


@pytest.fixture(scope="module")
def asked(spark):
    ids = [*range(100, 400, 3), 1000, 1001, 5, 7777]
    return [tuple(sorted(DRAW.sample(ids, 2))) for _ in range(600)] + [(1000, 1001), (5, 7777), (103, 103)]


@pytest.mark.parametrize("marks", [1, 48 << 20])
def test_properties_by_lookup(spark, edges, asked, marks, monkeypatch):
    monkeypatch.setattr(H, "MARK_BYTES", marks)
    graph = H.hold_graph(G.first_days(edges, 20), DAYS, weighted=True)
    found = H.with_properties(spark.createDataFrame(asked, "u long, v long"), graph).collect()
    assert Counter((r["u"], r["v"]) for r in found) == Counter(asked)
    for y, day in DAYS.items():
        near = neighbours({(u, v) for _, u, v, d in WORKS if d < day})
        hops = {x: sum(len(near[o]) for o in near[x]) for x in list(near)}
        for r in found:
            u, v = near.get(r["u"], set()), near.get(r["v"], set())
            assert (r[f"degree_u_{y}"], r[f"degree_v_{y}"], r[f"two_hop_u_{y}"], r[f"two_hop_v_{y}"]) == (len(u), len(v), hops.get(r["u"], 0), hops.get(r["v"], 0))
            assert r[f"common_{y}"] == len(u & v)


def test_pair_properties_do_not_shuffle_pairs(spark, edges, asked):
    """Joined, each pair came with all neighbours of an end."""
    out = G.pair_properties(edges, spark.createDataFrame(asked, "u long, v long"), DAYS)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1, 2, 3, 1 << 31])
def test_walks_of_a_held_graph(spark, asked, most):
    links = {(u, v) for _, u, v, d in WORKS if d < 8} | {(i, i + 1) for i in range(5000, 5012)}
    pairs = sorted(set(asked) | {(5000, 5000 + i) for i in range(13)})
    graph = H.hold_graph(spark.createDataFrame([(*p, 0, 1) for p in links], "u long, v long, day int, links long"), {0: 1})
    found = {(r["u"], r["v"]): r["distance"] for r in H.with_distances(spark.createDataFrame(pairs, "u long, v long"), graph, most).collect()}
    assert found == {p: d if d <= most else -1 for p, d in brute_distances(links, pairs).items()}


def test_encoded_files_equal_the_joined_layers(spark, edges, asked):
    draw = np.random.default_rng(3)
    layers = [{"own": draw.normal(size=(3, 2)), "around": draw.normal(size=(3, 2)), "bias": draw.normal(size=3)}, {"own": draw.normal(size=(2, 3)), "around": draw.normal(size=(2, 3)), "bias": draw.normal(size=2)}]
    counted, pairs = G.first_days(edges, 20), spark.createDataFrame(sorted(set(asked)), "u long, v long")
    graph = H.hold_graph(counted, DAYS, weighted=True)
    found = {(r["u"], r["v"]): r["decoded"] for r in H.with_properties(pairs, graph, H.encode(spark, graph, layers)).where("decoded IS NOT NULL").collect()}
    nodes = G.degrees(counted).select("id", F.array(F.col("degree") / 100, F.col("weighted") / 100).alias("vec"))
    expected = {(r["u"], r["v"]): r["score"] for r in N.decode_pairs(pairs, N.sage_encode(nodes, counted, layers)).collect()}
    assert found.keys() == expected.keys() and all(abs(found[p] - expected[p]) < 1e-9 for p in found)


@pytest.mark.parametrize("n", [1, 50, 299, 300, 400])
def test_many_first_pairs_by_hash(spark, n, monkeypatch):
    """A limit of millions was one task's heap; ranges of hashes are counted instead."""
    pairs = spark.createDataFrame([(i, i * i % 97 + 1000) for i in range(300)], "u long, v long")
    expected = sorted(tuple(r) for r in S.first_by_hash(pairs, n).collect())
    monkeypatch.setattr(S, "HELD_FIRST", 0)
    monkeypatch.setattr(S, "HASH_RANGES", 16)
    few = S.first_by_hash(pairs, n)
    assert sorted(tuple(r) for r in few.collect()) == expected
    assert n < 299 or f"GlobalLimit {n}" not in few._jdf.queryExecution().optimizedPlan().toString()


def test_many_unlinked_pairs(spark, monkeypatch):
    nodes = spark.range(200).select("id")
    linked = spark.createDataFrame([(i, i + 1) for i in range(199)], "u long, v long")
    expected = sorted(tuple(r) for r in S.unlinked_pairs(nodes, [linked], 500).collect())
    monkeypatch.setattr(S, "HELD_FIRST", 0)
    assert sorted(tuple(r) for r in S.unlinked_pairs(nodes, [linked], 500).collect()) == expected
