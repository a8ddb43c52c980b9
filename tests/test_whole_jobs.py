"""Queries over whole tables that SQL is too slow for, against brute force, and operators that fail instead of stopping short."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.plans import catalog, model_queries
from corpusloom.plans.views import EDGES, FUTURE_DAY, PAST_DAY
from corpusloom.plans.views import edges as edges_of
from corpusloom.session import table
from tests.oracle import connection

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def all_edges(data):
    """(work_id, u, v, day, y) by DuckDB."""
    return connection(data).execute(f"WITH {EDGES} SELECT work_id, u, v, day, y FROM edges").fetchall()


def smallest_reached(pairs):
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for u, v in pairs:
        a, b = root(u), root(v)
        above[max(a, b)] = min(a, b)
    return {x: root(x) for x in above}


def test_components_of_all_works(spark, data, all_edges):
    found = {r["id"]: r["component"] for r in QUERIES["grf10_components"](spark, data).collect()}
    assert found == smallest_reached({(u, v) for _, u, v, _, _ in all_edges})


def test_components_of_each_year(spark, data, all_edges):
    found = {r["y"]: (r["components"], r["largest"], r["nodes"]) for r in QUERIES["grf10_component_years"](spark, data).collect()}
    assert found == brute_years(all_edges)


def brute_years(rows):
    out = {}
    for year in {r[4] for r in rows}:
        sizes = Counter(smallest_reached({(r[1], r[2]) for r in rows if r[4] <= year}).values())
        out[year] = (len(sizes), max(sizes.values()), sum(sizes.values()))
    return out


def test_components_merge_over_years(spark):
    rows = [(1, 1, 2, 0, 1995), (2, 3, 4, 0, 1995), (3, 5, 6, 0, 1996), (4, 2, 3, 0, 1997), (5, 1, 2, 0, 1997)]
    found = G.component_years(spark.createDataFrame(rows, "work_id long, u long, v long, day int, y int"))
    assert {r["y"]: (r["components"], r["largest"], r["nodes"]) for r in found.collect()} == brute_years(rows) == {1995: (2, 2, 4), 1996: (3, 2, 6), 1997: (2, 4, 6)}
    assert G.component_years(spark.createDataFrame([], "work_id long, u long, v long, day int, y int")).count() == 0


def test_components_fail_when_rounds_run_out(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        G.components(chain, most_rounds=1)


def neighbours(pairs):
    out = defaultdict(set)
    for u, v in pairs:
        out[u].add(v)
        out[v].add(u)
    return out


def steps_from(near, source):
    seen, front = {source: 0}, {source}
    while front:
        front = {b for a in front for b in near.get(a, ())} - seen.keys()
        seen |= dict.fromkeys(front, max(seen.values()) + 1)
    return seen


def brute_distances(links, asked):
    near = neighbours(links)
    walks = {u: steps_from(near, u) for u in {u for u, _ in asked}}
    return {(u, v): walks[u].get(v, -1) for u, v in asked}


def test_distances_of_all_later_pairs(spark, data, all_edges):
    found = {(r["u"], r["v"]): r["distance"] for r in QUERIES["grf8_annotated_pairs"](spark, data).collect()}
    assert found == brute_distances({r[1:3] for r in all_edges if r[3] < PAST_DAY}, {r[1:3] for r in all_edges if r[3] >= PAST_DAY})
    assert {1, 2} <= set(found.values())


@pytest.mark.parametrize("held", [0, 1000])
def test_distances_of_any_length(spark, held):
    links = [(i, i + 1) for i in range(9)] + [(20, 21)]
    asked = [(0, 9), (0, 1), (3, 7), (0, 20), (20, 21), (50, 50), (0, 50), (50, 0), (4, 4)]
    snap = spark.createDataFrame(links, "u long, v long").withColumn("links", F.lit(1))
    found = G.all_pair_distances(snap, spark.createDataFrame(asked + asked[:2], "u long, v long"), held_pairs=held)
    rows = found.collect()
    assert {(r["u"], r["v"]): r["distance"] for r in rows} == brute_distances(links, asked) and len(rows) == len(asked)
    assert [r["distance"] for r in G.all_pair_distances(snap.limit(0), spark.createDataFrame([(1, 2)], "u long, v long"), held_pairs=held).collect()] == [-1]


def brute_two_steps(links):
    near, out = neighbours(links), Counter()
    for ends in near.values():
        out.update((a, b) for a in ends for b in ends if a < b)
    return out


@pytest.fixture(scope="module")
def past_links(all_edges):
    return {r[1:3] for r in all_edges if r[3] < PAST_DAY}


def test_two_step_pairs_of_the_past(spark, data, past_links):
    assert {(r["u"], r["v"]): r["common"] for r in QUERIES["joi18_two_step_pairs"](spark, data).collect()} == brute_two_steps(past_links)


def test_distance_candidates_of_the_past(spark, data, past_links):
    found = [(r["u"], r["v"]) for r in QUERIES["smp12_distance_candidates"](spark, data).collect()]
    assert sorted(found) == sorted(brute_two_steps(past_links).keys() - past_links)


def test_prospective_pairs_and_entry_of_the_past(spark, data, past_links):
    near, common = neighbours(past_links), brute_two_steps(past_links)
    best = sorted((-n, *pair) for pair, n in common.items() if pair not in past_links)[:50]
    expected = [(i, u, v, len(near[u]), len(near[v]), 2, -n) for i, (n, u, v) in enumerate(best, 1)]
    for df in (QUERIES["mod8_prospective_pairs"](spark, data), catalog.flagship(spark, data)):
        assert sorted(tuple(r[c] for c in ("rank", "u", "v", "degree_a", "degree_b", "graph_distance", "score")) for r in df.collect()) == expected


def test_labels_of_all_pairs(spark, data, all_edges):
    assert QUERIES["hlp16_pair_labels"](spark, data).count() == len(all_edges)


def test_all_emerging_pairs_are_scored(spark):
    """Rounds of 40 a source ended at 4,000 pairs, whatever the number of sources."""
    folder = "/root/testdata/sf0.01"
    t = lambda name: table(spark, folder, name)
    snap = G.snapshot(edges_of(t), FUTURE_DAY)
    found = [(r["u"], r["v"]) for r in model_queries._MODES["emerging"](t, snap).collect()]
    con = connection(folder)
    links = set(con.execute(f"WITH {EDGES} SELECT DISTINCT u, v FROM edges WHERE day < {FUTURE_DAY}").fetchall())
    fresh = {r[0] for r in con.execute(f"WITH {EDGES} SELECT cid FROM mentions WHERE y <= 1996 GROUP BY cid HAVING min(y) >= 1996 AND count(*) >= 3").fetchall()}
    nodes = {x for pair in links for x in pair}
    expected = {(min(a, b), max(a, b)) for a in fresh & nodes for b in nodes if a != b} - links
    assert len(expected) > 4000 and sorted(found) == sorted(expected)
