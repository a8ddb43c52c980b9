"""The best of all pairs of a source and a node by a pair network, without a row for each pair.

Pairs that share a neighbour are few, and are made and scored as any others. Of all the rest common
neighbours are 0, so a score hangs on what is known of each end alone: nodes that are alike are put
together, and a group is scored node by node only where a bound of its scores reaches the best so far.
Nothing is left out by it: a bound is never below a score of its group.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .held import HeldGraph, _sums, _unfolded, over_parts
from .models import PairNetwork

#: Nodes of a task at most and of a group, sources that are compared with groups at once, neighbours unfolded at once, groups scored at once.
CHUNK, GROUP, SOURCES, WAYS, SCORED = 1 << 16, 256, 128, 1 << 20, 64


def held_sources(sources: DataFrame, graph: HeldGraph) -> str:
    """The file of the ascending places of ``sources`` (id) that are in the graph, 4 bytes each."""
    ids = np.memmap(f"{graph.folder}/ids", np.int64, "r")
    asked = np.unique(sources.select(F.col("id").cast("bigint")).toArrow().column(0).to_numpy())  # a stated set
    at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
    at[ids[at] == asked].astype(np.int32).tofile(f"{graph.folder}/{(name := f'sources-{uuid.uuid4().hex}')}")
    return name


def _sources(graph: HeldGraph, name: str) -> np.ndarray:
    path = f"{graph.folder}/{name}"
    return np.fromfile(path, np.int32) if os.path.getsize(path) else np.zeros(0, np.int32)


def _around(held: dict[str, np.ndarray], place: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending neighbours of a node, and neighbours' neighbours, itself among them."""
    near = held["other"][held["first"][place] : held["first"][place + 1]].astype(np.int64)
    length = held["first"][near + 1] - held["first"][near]
    part, far = np.cumsum(length) // WAYS, np.zeros(0, np.int32)
    for some in np.split(near, np.flatnonzero(np.diff(part)) + 1):
        far = np.unique(np.r_[far, held["other"][_unfolded(held["first"], some)[0]]])
    return near, far


def near_pairs(graph: HeldGraph, sources: str, spark) -> DataFrame:
    """(u, v) of a source and a node that are not linked and have a common neighbour, each once; made in the tasks that read them."""
    count = len(_sources(graph, sources))
    tasks = max(3 * spark.sparkContext.defaultParallelism, -(-count // 256))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, every = graph.open(), _sources(graph, sources)
        asks = np.zeros(graph.nodes, bool)
        asks[every] = True
        ids = np.asarray(held["ids"])
        own = np.concatenate([np.zeros(0, np.int32), *(every[b.column(0).to_numpy()] for b in batches)]).tolist()
        for first in (True, False):  # sources as first ends, then as second ones, so that one end stays for long
            for source in own:
                near, far = _around(held, source)
                far = np.setdiff1d(far[far > source] if first else far[(far < source) & ~asks[far]], near, assume_unique=True)
                one, other = np.full(len(far), ids[source]), ids[far]
                yield pa.RecordBatch.from_arrays([pa.array(one if first else other), pa.array(other if first else one)], ["u", "v"])

    return spark.range(0, count, 1, tasks).mapInArrow(made, "u bigint, v bigint")


def largest_of_ends(graph: HeldGraph, sources: str, spark) -> dict[str, float]:
    """The largest scaled degree and two-hop degree of each year among the first and the second ends of all unlinked pairs of a source and a node; None where there is no pair."""
    kinds = [(k, y) for y in graph.years for k in ("degree", "two_hop")]

    def work(at: tuple) -> list[int]:
        _, node_at, way_at, n, m = at
        held, every = graph.open(), _sources(graph, sources)
        asks = np.zeros(graph.nodes, bool)
        asks[every] = True
        own, other = np.arange(node_at, node_at + n), held["other"][way_at : way_at + m]
        starts = held["first"][node_at : node_at + n] - way_at
        above = other > np.repeat(own, np.diff(np.r_[starts, m]))
        out = []
        for side, asked, free in ((above, len(every) - np.searchsorted(every, own, "right"), graph.nodes - 1 - own), (~above, np.searchsorted(every, own), own)):
            there = (asked > _sums(side & asks[other], starts)) | (asks[own] & (free > _sums(side, starts)))
            out += [int(held[f"{k}_{y}"][own[there]].max(initial=-1)) for k, y in kinds]
        return out

    most = [max(x) for x in zip(*over_parts(spark, graph, work))]
    named = dict(zip([(end, k, y) for end in ("u", "v") for k, y in kinds], most))
    return {f"{k}_{end}_{y}": named[end, k, y] / (graph.most[f"{k}_{y}"] or 1) if named[end, k, y] >= 0 else None for y in graph.years for k in ("degree", "two_hop") for end in ("u", "v")}


def _plain_layers(network: PairNetwork) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weight and bias of each layer with its batch norm in them."""
    out = []
    for w in network.layers:
        by = w["scale"] / np.sqrt(w["var"] + network.epsilon)
        out.append((w["weight"] * by[:, None], (w["bias"] - w["mean"]) * by + w["shift"]))
    return out


def _alike(x: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which each ``size`` of them one after another are alike: halves by the widest column again and again."""
    order, open_ = np.arange(len(x)), [(0, len(x))]
    while open_:
        low, high = open_.pop()
        if high - low <= size:
            continue
        half = -(-((high - low) // 2) // size) * size
        some = order[low:high]
        order[low:high] = some[np.argpartition(x[some, np.argmax(np.ptp(x[some], 0))], half)]
        open_ += [(low, low + half), (low + half, high)]
    return order


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def far_pairs(graph: HeldGraph, sources: str, spark, network: PairNetwork, vectors: str, most: dict[str, float], k: int, weights: tuple[float, float], floor: tuple[float, int]) -> DataFrame:
    """(u, v) among which are the ``k`` best of all pairs of a source and a node that are not linked and have no common neighbour.

    A score is ``weights``, none below 0, of the network's for the columns of ``most``, see ``graph.held_properties``, and of the sigmoid of
    the dot product of ``vectors``, rounded to 6 places; the best have the highest, then the smallest u and v. ``floor`` is a
    score and its u that at least ``k`` other pairs reach. Each task gives its own ``k`` best at most.
    """
    names = list(most)
    kinds = [f"{kind}_{{}}_{y}" for y in graph.years for kind in ("degree", "two_hop")]
    columns = {end: [names.index(n.format(end)) for n in kinds] for end in ("u", "v")}
    chunk = max(1, min(CHUNK, -(-graph.nodes // (3 * spark.sparkContext.defaultParallelism))))

    def best(low: int) -> list[tuple[int, int]]:
        held, every = graph.open(), _sources(graph, sources).astype(np.int64)
        vec = np.memmap(f"{graph.folder}/{vectors}", np.float64, "r").reshape(graph.nodes, -1)
        (first, bias), *layers = _plain_layers(network)
        asks = np.zeros(graph.nodes, bool)
        asks[every] = True

        def ends(places: np.ndarray, end: str) -> np.ndarray:
            """Inputs of nodes as first or second end."""
            scaled = [held[f"{kind}_{y}"][places] / (graph.most[f"{kind}_{y}"] or 1) for y in graph.years for kind in ("degree", "two_hop")]
            return np.stack([x / most[n.format(end)] if most[n.format(end)] else np.zeros(len(x)) for x, n in zip(scaled, kinds)], 1)

        own = np.arange(low, min(low + chunk, graph.nodes))
        own = own[_alike(ends(own, "v") * np.abs(first[:, columns["v"]]).sum(0), GROUP)]
        starts, high = np.arange(0, len(own), GROUP), low + len(own)
        hull = lambda x: (np.minimum.reduceat(x, starts, 0), np.maximum.reduceat(x, starts, 0))
        inputs = {end: ends(own, end) for end in ("u", "v")}
        hulls = {end: hull(inputs[end] @ first[:, columns[end]].T) for end in ("u", "v")}
        vec_low, vec_high = hull(vec[own])
        lowest = np.minimum.reduceat(own, starts)
        found = np.zeros((0, 3))  # score, u, v
        least, least_u = floor[0], int(np.searchsorted(held["ids"], floor[1]))

        def bounds(some: np.ndarray, end: str) -> np.ndarray:
            """Of each source as ``end`` and each group."""
            base, other = ends(some, end) @ first[:, columns[end]].T + bias, "v" if end == "u" else "u"
            down, up = (base[:, None] + h[None] for h in hulls[other])
            for weight, shift in layers:
                down, up = np.maximum(down, 0), np.maximum(up, 0)
                more, less = np.maximum(weight, 0).T, np.minimum(weight, 0).T
                down, up = down @ more + up @ less + shift, up @ more + down @ less + shift
            dot = np.maximum(vec[some][:, None] * vec_low[None], vec[some][:, None] * vec_high[None]).sum(2)
            return np.round(weights[0] * _sigmoid(up[..., 0]) + weights[1] * _sigmoid(dot) + 1e-9, 6)

        for at in range(0, len(every), SOURCES):
            block = every[at : at + SOURCES]
            for end, some in (("u", block[block < high]), ("v", block[block > low])):
                if not len(some):
                    continue
                bound = bounds(some, end)
                smallest = np.broadcast_to(some[:, None] if end == "u" else lowest[None], bound.shape)
                reach = lambda rows, cols: (bound[rows, cols] > least) | ((bound[rows, cols] == least) & (smallest[rows, cols] <= least_u))  # noqa: B023, E731
                rows, cols = np.nonzero((bound > least) | ((bound == least) & (smallest <= least_u)))
                order = np.argsort(-bound[rows, cols], kind="stable")
                rows, cols = rows[order], cols[order]
                while len(rows):
                    sizes = np.minimum(starts[cols[:SCORED]] + GROUP, len(own)) - starts[cols[:SCORED]]
                    mine = np.arange(sizes.sum()) + np.repeat(starts[cols[:SCORED]] - np.cumsum(sizes) + sizes, sizes)
                    source, node = np.repeat(some[rows[:SCORED]], sizes), own[mine]
                    kept = (node > source) if end == "u" else (node < source) & ~asks[node]
                    mine, source, node = mine[kept], source[kept], node[kept]
                    x = np.zeros((len(node), len(names)))
                    x[:, columns[end]], x[:, columns["v" if end == "u" else "u"]] = ends(source, end), inputs["v" if end == "u" else "u"][mine]
                    score = np.round(weights[0] * network(x)[:, 0] + weights[1] * _sigmoid((vec[source] * vec[node]).sum(1)), 6) if len(x) else np.zeros(0)
                    u, v = np.minimum(source, node), np.maximum(source, node)
                    good = np.flatnonzero((score > least) | ((score == least) & (u <= least_u)))
                    good = good[np.lexsort((v[good], u[good], -score[good]))]
                    fresh = 0
                    for step in range(0, len(good), 4 * k):  # linked and near ones are told only of those that could be among the best
                        part = good[step : step + 4 * k]
                        free = np.ones(len(part), bool)
                        for one in np.unique(source[part]):
                            that = source[part] == one
                            free[that] = ~np.isin(node[part[that]], np.concatenate(_around(held, int(one))))
                        part = part[free]
                        found = np.r_[found, np.stack([score[part], u[part], v[part]], 1)]
                        if (fresh := fresh + len(part)) >= k:
                            break  # those behind have lower scores, or the same and greater ends
                    found = found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))[:k]]
                    if len(found) == k and (-found[-1, 0], found[-1, 1]) < (-least, least_u):
                        least, least_u = float(found[-1, 0]), int(found[-1, 1])
                    rows, cols = rows[SCORED:], cols[SCORED:]
                    rest = reach(rows, cols)
                    rows, cols = rows[rest], cols[rest]
        ids = np.asarray(held["ids"])
        return [(int(ids[int(u)]), int(ids[int(v)])) for _, u, v in found]

    lows = range(0, graph.nodes, chunk)
    rows = spark.sparkContext.parallelize(lows, len(lows)).flatMap(best).collect()  # k a task
    return spark.createDataFrame(rows, "u bigint, v bigint")
