"""A graph as flat files in the shared folder, which tasks map into memory to look pairs up without a shuffle.

The files are neighbours by node, written from tasks; nothing of the graph comes to the driver but one
row a part. Pages that are mapped are shared by all workers of a machine and given back when memory is
short. A table of pairs is then read through once, in the batches it comes in.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import released, shared_folder

#: Bytes of the marks of one batch; pairs looked up at once.
MARK_BYTES, BATCH_PAIRS = 48 << 20, 20_000
#: Nodes and neighbours up to which a graph is held in files; the ids of all nodes are in a task's memory while they are written.
MOST_NODES, MOST_WAYS = 8_000_000, 2_000_000_000


def local_folder(spark) -> str | None:
    """The shared folder as a path that every machine opens, or None where it is none, as on HDFS."""
    at = urlparse(shared_folder(spark, "held"))
    return unquote(at.path) if at.scheme in ("", "file") else None


def _save(path: str, values: np.ndarray) -> None:
    """Written beside and renamed, so that a repeated task leaves a whole file."""
    with open(own := f"{path}.{uuid.uuid4().hex}", "wb") as out:
        values.tofile(out)
    os.replace(own, path)


def _into(path: str, kind: type, at: int, values: np.ndarray) -> None:
    with open(path, "r+b") as out:
        out.seek(at * np.dtype(kind).itemsize)
        values.astype(kind).tofile(out)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches of ``values`` that begin at ``starts``, none of which is empty."""
    return np.add.reduceat(values, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)


@dataclass
class HeldGraph:
    """Where the files are, and the largest degree and two-hop degree of each year."""

    folder: str
    nodes: int
    ways: int
    years: list[int]
    most: dict[str, int]
    parts: list[tuple[int, int, int, int, int]]

    def open(self) -> dict[str, np.ndarray]:
        kinds = {"ids": np.int64, "first": np.int64, "other": np.int32, "bits": np.uint8} | {f"{k}_{y}": np.int64 for y in self.years for k in ("degree", "two_hop")}
        return {name: np.memmap(f"{self.folder}/{name}", kind, "r") for name, kind in kinds.items()}


def over_parts(spark, graph: HeldGraph, work) -> list:
    """``work`` of each part of the graph: its number, its first node and neighbour, and how many it has of both."""
    return spark.sparkContext.parallelize(graph.parts, len(graph.parts)).map(work).collect()  # a row a part


def hold_graph(links: DataFrame, cutoffs: dict[int, int], weighted: bool = False) -> HeldGraph | None:
    """The graph of (u, v, day, links), see ``graph.first_days``, in files; None where it is empty, beyond the bounds or the shared folder is not a path.

    A pair is in the graph of each year of ``cutoffs`` whose day is after its own. A year's degrees count its own links; with ``weighted`` all works are summed by node too. At most eight years.
    """
    spark, folder, years = links.sparkSession, local_folder(links.sparkSession), list(cutoffs)
    if folder is None or len(years) > 8:
        return None
    folder = f"{folder}/held-{uuid.uuid4().hex}"
    bits = sum(((F.col("day") < day).cast("int") * (1 << i) for i, day in enumerate(cutoffs.values())), F.lit(0)).cast("short")
    wide = links.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"), bits.alias("bits"), (F.col("links") if weighted else F.lit(0)).cast("int").alias("links"))
    ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other")), F.struct(F.col("v").alias("id"), F.col("u").alias("other"))))
    ways = wide.select(ends.alias("e"), "bits", "links").select("e.id", "e.other", "bits", *(["links"] if weighted else []))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(b.column(i).to_numpy() for i in range(b.num_columns)) for b in batches]
        if not rows or not sum(len(r[0]) for r in rows):
            return
        ids, other, bits = (np.concatenate([r[i] for r in rows]) for i in range(3))
        part = TaskContext.get().partitionId()
        os.makedirs(folder, exist_ok=True)
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        works = {"weight": _sums(np.concatenate([r[3] for r in rows]), starts)} if weighted else {}
        for name, values in (*works.items(), ("ids", ids[starts]), ("length", np.diff(np.r_[starts, len(ids)])), ("other", other), ("bits", bits.astype(np.uint8))):
            _save(f"{folder}/{name}-{part}", values)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, int(ids[0]), len(starts), len(ids))], ["part", "low", "nodes", "ways"])

    # by range, so that the parts one after another are in the order of the ids
    ordered = ways.repartitionByRange(parts, "id").sortWithinPartitions("id", "other")
    held = sorted((r["low"], r["part"], r["nodes"], r["ways"]) for r in ordered.mapInArrow(write, "part bigint, low bigint, nodes bigint, ways bigint").collect())  # a row a part
    nodes, total = sum(r[2] for r in held), sum(r[3] for r in held)
    if not total or nodes > MOST_NODES or total > MOST_WAYS:
        return None
    by_node = ("weight",) if weighted else ()
    sizes = dict.fromkeys(by_node, (8, nodes)) | {"ids": (8, nodes), "first": (8, nodes + 1), "other": (4, total), "bits": (1, total)} | {f"{k}_{y}": (8, nodes) for y in years for k in ("degree", "two_hop")}
    for name, (width, n) in sizes.items():
        with open(f"{folder}/{name}", "wb") as out:
            out.truncate(width * n)
    places, node_at, way_at = [], 0, 0
    for _, part, n, m in held:
        places.append((part, node_at, way_at, n, m))
        _into(f"{folder}/ids", np.int64, node_at, np.fromfile(f"{folder}/ids-{part}", np.int64))  # 8 bytes a node, a part at a time
        node_at, way_at = node_at + n, way_at + m
    _into(f"{folder}/first", np.int64, nodes, np.array([total]))
    graph = HeldGraph(folder, nodes, total, years, {}, places)

    def place(at: tuple) -> list[int]:
        part, node_at, way_at, n, m = at
        length = np.fromfile(f"{folder}/length-{part}", np.int64)
        starts, bits, ids = np.cumsum(length) - length, np.fromfile(f"{folder}/bits-{part}", np.uint8), np.memmap(f"{folder}/ids", np.int64, "r")
        _into(f"{folder}/first", np.int64, node_at, starts + way_at)
        _into(f"{folder}/bits", np.uint8, way_at, bits)
        _into(f"{folder}/other", np.int32, way_at, np.searchsorted(ids, np.fromfile(f"{folder}/other-{part}", np.int64)))
        for name in by_node:
            _into(f"{folder}/{name}", np.int64, node_at, np.fromfile(f"{folder}/{name}-{part}", np.int64))
        most = []
        for i, y in enumerate(years):
            degree = _sums((bits >> i) & 1, starts)
            _into(f"{folder}/degree_{y}", np.int64, node_at, degree)
            most.append(int(degree.max()))
        return most

    def around(at: tuple) -> list[int]:
        _, node_at, way_at, n, m = at
        held = graph.open()
        other, bits, starts = held["other"][way_at : way_at + m], held["bits"][way_at : way_at + m], held["first"][node_at : node_at + n] - way_at
        most = []
        for i, y in enumerate(years):
            hops = _sums(np.where((bits >> i) & 1, held[f"degree_{y}"][other], 0), starts)
            _into(f"{folder}/two_hop_{y}", np.int64, node_at, hops)
            most.append(int(hops.max()))
        return most

    for kind, work in (("degree", place), ("two_hop", around)):
        for y, values in zip(years, zip(*over_parts(spark, graph, work))):
            graph.most[f"{kind}_{y}"] = max(values)
    for part, *_ in places:
        for name in ("ids", "length", "other", "bits", *by_node):
            os.remove(f"{folder}/{name}-{part}")
    released(spark)
    return graph


def _unfolded(first: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the neighbours of ``places`` are, how many each has, and where those of each begin."""
    low = first[places]
    length = first[places + 1] - low
    starts = np.cumsum(length) - length
    return np.arange(length.sum()) + np.repeat(low - starts, length), length, starts


def _common(held: dict[str, np.ndarray], u: np.ndarray, v: np.ndarray, years: int) -> np.ndarray:
    """Common neighbours of the pairs of places, a column a year; ``u`` ascending."""
    out = np.zeros((len(u), years), np.int64)
    nodes = len(held["ids"])
    fresh = np.r_[True, u[1:] != u[:-1]]
    row = np.cumsum(fresh) - 1
    sources = u[fresh]
    step = max(1, MARK_BYTES // nodes)
    marks = np.zeros(min(step, len(sources)) * nodes, np.uint8)
    for low in range(0, len(sources), step):
        some = sources[low : low + step]
        at, length, _ = _unfolded(held["first"], some)
        set_at = held["other"][at] + np.repeat(np.arange(len(some)) * nodes, length)
        marks[set_at] = held["bits"][at]
        begin, end = np.searchsorted(row, [low, low + len(some)])
        at, length, starts = _unfolded(held["first"], v[begin:end])
        met = marks[held["other"][at] + np.repeat((row[begin:end] - low) * nodes, length)] & held["bits"][at]
        for i in range(years):
            out[begin:end, i] = _sums((met >> i) & 1, starts)
        marks[set_at] = 0
    return out


def encode(spark, graph: HeldGraph, layers: list[dict[str, np.ndarray]]) -> str:
    """The file of the nodes' vectors after ``layers``, as ``models.sage_encode`` has them, from degree / 100 and works / 100 of a weighted graph."""
    folder, name = graph.folder, f"vec-{uuid.uuid4().hex}"
    for i, layer in enumerate(layers):
        with open(f"{folder}/{name}-{i + 1}", "wb") as out:
            out.truncate(8 * graph.nodes * len(layer["bias"]))

        def apply(at: tuple, i: int = i, layer: dict[str, np.ndarray] = layer) -> int:
            _, node_at, way_at, n, m = at
            held, size = graph.open(), layer["own"].shape[1]
            if i:
                of = lambda places: np.memmap(f"{folder}/{name}-{i}", np.float64, "r").reshape(-1, size)[places]
            else:
                weight = np.memmap(f"{folder}/weight", np.int64, "r")
                of = lambda places: np.stack([np.diff(held["first"])[places] / 100, weight[places] / 100], 1)
            starts = held["first"][node_at : node_at + n] - way_at
            mean = np.add.reduceat(of(held["other"][way_at : way_at + m]), starts, 0) / np.diff(np.r_[starts, m])[:, None]
            total = of(np.arange(node_at, node_at + n)) @ layer["own"].T + mean @ layer["around"].T + layer["bias"]
            total = np.maximum(total, 0) if i + 1 < len(layers) else total
            _into(f"{folder}/{name}-{i + 1}", np.float64, node_at * total.shape[1], total)
            return n

        over_parts(spark, graph, apply)
    return f"{name}-{len(layers)}"


def with_properties(pairs: DataFrame, graph: HeldGraph, vectors: str | None = None) -> DataFrame:
    """``pairs`` with, for each year, degree_u, degree_v, two_hop_u, two_hop_v and common; 0 for an id that the graph has not. No shuffle.

    With the name of a file of ``vectors`` also ``decoded``, the sigmoid of the dot product of both ends' vectors, null without both.
    """
    names = [f"{k}_{end}_{y}" for y in graph.years for k in ("degree", "two_hop") for end in ("u", "v")] + [f"common_{y}" for y in graph.years]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = graph.open()
        ids = np.asarray(held["ids"])
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH_PAIRS):
                batch = whole.slice(low, BATCH_PAIRS)
                ends, known = {}, {}
                for end in ("u", "v"):
                    value = batch.column(batch.schema.get_field_index(end)).to_numpy(zero_copy_only=False)
                    ends[end] = np.minimum(np.searchsorted(ids, value), len(ids) - 1)
                    known[end] = ids[ends[end]] == value
                columns = {}
                for y in graph.years:
                    for k in ("degree", "two_hop"):
                        for end in ("u", "v"):
                            columns[f"{k}_{end}_{y}"] = np.where(known[end], held[f"{k}_{y}"][ends[end]], 0)
                both = np.flatnonzero(known["u"] & known["v"])
                u, v = ends["u"][both], ends["v"][both]
                # marks are set once for each distinct first end
                if len(np.unique(v)) < len(np.unique(u)):
                    u, v = v, u
                order = np.argsort(u, kind="stable")
                common = np.zeros((batch.num_rows, len(graph.years)), np.int64)
                if len(both):
                    common[both[order]] = _common(held, u[order], v[order], len(graph.years))
                if vectors:
                    vec = np.memmap(f"{graph.folder}/{vectors}", np.float64, "r").reshape(graph.nodes, -1)
                    columns["decoded"] = 1 / (1 + np.exp(-(vec[ends["u"]] * vec[ends["v"]]).sum(1)))
                columns |= {f"common_{y}": common[:, i] for i, y in enumerate(graph.years)}
                decoded = [pa.array(columns["decoded"], mask=~(known["u"] & known["v"]))] if vectors else []
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(columns[n], pa.int64()) for n in names), *decoded], [*batch.schema.names, *names, *(["decoded"] if vectors else [])])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(look, f"{kept}, {', '.join(f'{n} bigint' for n in names)}{', decoded double' if vectors else ''}")


def with_distances(pairs: DataFrame, graph: HeldGraph, most: int = 1 << 31) -> DataFrame:
    """(u, v, distance) of ``pairs``, -1 beyond ``most`` or where there is no way, over all years of the graph.

    Best with the pairs of a u together: each u of a batch is walked until its own v are found, from
    their side. ``seen`` is cleared by what was reached, so a walk costs no more than it reaches.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = graph.open()
        ids, first, other = np.asarray(held["ids"]), held["first"], held["other"]
        seen, mark = np.full(len(ids), -1, np.int32), np.zeros(len(ids), np.int64)

        def once(places: np.ndarray) -> np.ndarray:
            mark[places] = np.arange(len(places))
            return places[mark[places] == np.arange(len(places))]

        for batch in batches:
            u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            distance = np.where(u == v, 0, -1).astype(np.int32)
            at, goals = (np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (u, v))
            asked = np.flatnonzero((u != v) & (ids[at] == u) & (ids[goals] == v))
            asked = asked[np.argsort(at[asked], kind="stable")]
            for mine in np.split(asked, np.flatnonzero(np.diff(at[asked])) + 1) if len(asked) else ():
                goal, front, step = goals[mine], at[mine[:1]], 0
                seen[front], touched = 0, [front]
                while len(front) and len(goal) and step < most:
                    # all of up to ``step`` are found: one more if a neighbour was reached last, two more if a neighbour's neighbour was
                    near, _, starts = _unfolded(first, goal)
                    met = np.logical_or.reduceat(seen[other[near]] == step, starts)
                    distance[mine[met]] = step + 1
                    mine, goal = mine[~met], goal[~met]
                    if len(goal) and step + 1 < most:
                        near, length, starts = _unfolded(first, goal)
                        far, wide, _ = _unfolded(first, other[near])
                        begins = np.cumsum(np.add.reduceat(wide, starts))
                        met = np.logical_or.reduceat(seen[other[far]] == step, np.r_[0, begins[:-1]])
                        distance[mine[met]] = step + 2
                        mine, goal = mine[~met], goal[~met]
                    for _ in range(2):
                        if len(goal) and len(front):
                            reached = other[_unfolded(first, front)[0]]
                            front = once(reached[seen[reached] < 0])
                            step += 1
                            seen[front] = step
                            touched.append(front)
                for places in touched:
                    seen[places] = -1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance)], ["u", "v", "distance"])

    return pairs.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).mapInArrow(walk, "u bigint, v bigint, distance int")
