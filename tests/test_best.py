"""The best of all pairs of a source and a node, found by groups, against all of them scored."""

import random

import numpy as np
import pytest

from corpusloom.operators import best as B
from corpusloom.operators import graph as G
from corpusloom.operators import held as H
from corpusloom.operators import models as N
from corpusloom.operators import sampling as S
from corpusloom.plans import model_queries as Q

DRAW = random.Random(11)
DAYS = {1: 10, 2: 20}
LAYERS = [{"own": np.array([[0.5, -0.5], [0.25, 1.0]]), "around": np.array([[1.0, 0.25], [-0.5, 0.75]]), "bias": np.array([0.1, -0.2])}]


def works(copies: int, nodes: int, links: int):
    """Links of a graph and of copies of it, so that many nodes are alike."""
    some = [(*sorted(DRAW.sample(range(nodes), 2)), DRAW.randrange(20)) for _ in range(links)]
    return [(1, 3 * u + 5000 * c, 3 * v + 5000 * c, day) for c in range(copies) for u, v, day in some]


@pytest.mark.parametrize("copies, nodes, links, sources, group", [(1, 60, 90, 7, 4), (4, 40, 60, 5, 8), (2, 50, 60, 400, 3), (1, 6, 12, 2, 2), (3, 80, 60, 9, 1)])
def test_the_best_of_a_product(spark, copies, nodes, links, sources, group, monkeypatch):
    for name, value in (("CHUNK", 37), ("GROUP", group), ("SOURCES", 3), ("WAYS", 4), ("SCORED", 2)):
        monkeypatch.setattr(B, name, value)
    rows = works(copies, nodes, links)
    every = spark.createDataFrame(rows, "work_id long, u long, v long, day int")
    counted = G.first_days(every, 20)
    graph = H.hold_graph(counted, DAYS, weighted=True)
    ids = sorted({x for r in rows for x in r[1:3]})
    asked = spark.createDataFrame([(i,) for i in [*DRAW.sample(ids, min(sources, len(ids))), 2, 99_999]], "id long")
    vectors = H.encode(spark, graph, LAYERS)
    candidates = S.candidates_between(S.allowed_nodes(asked, counted), G.nodes_of(counted), counted.select("u", "v"))
    near = [tuple(r) for r in B.near_pairs(graph, B.held_sources(asked, graph), spark).collect()]
    common = {(r["u"], r["v"]) for r in H.with_properties(candidates, graph).where("common_2 > 0").collect()}
    assert sorted(near) == sorted(common)
    # the last network gives the same score to many
    for seed, by in ((0, 1.0), (1, 3.0), (2, 0.0)):
        network = N.PairNetwork.of_sizes([12, 6, 4, 1], seed)
        network.layers[0]["weight"] *= by
        scored, most = Q._blended(candidates, graph, network, vectors)
        expected = sorted((-r["score"], r["u"], r["v"]) for r in scored.collect())[:50]
        ends = B.largest_of_ends(graph, B.held_sources(asked, graph), spark)
        assert {n: most[n] for n in ends} == ends
        found = sorted((-r["score"], r["u"], r["v"]) for r in Q._best_of_product(asked, graph, network, vectors, 50).collect())
        assert found == expected
