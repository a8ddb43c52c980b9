"""The temporal concept graph: edges, snapshots, degrees, paths and components.

``mentions`` is (work_id, cid, day, y), ``edges`` is (work_id, u, v, day, y) with u < v, one row for
each work and pair. A snapshot is (u, v, links) with u < v, links counting the works before a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut, stored

from . import held as H
from .blocks import block_meetings, block_of, unfold_pairs
from .ordering import with_row_number


def edges_of_mentions(mentions: DataFrame) -> DataFrame:
    """All pairs of concepts of each work: grouped once and unfolded, so that mentions are shuffled once; long lists go in parts."""
    grouped = mentions.groupBy("work_id", "day", "y").agg(F.array_sort(F.collect_set("cid")).alias("cids"))
    return unfold_pairs(grouped, "cids", "work_id", "day", "y").select("work_id", "u", "v", "day", "y")


def until(edges: DataFrame, day: int) -> DataFrame:
    return edges.where(F.col("day") < day)


def snapshot(edges: DataFrame, day: int) -> DataFrame:
    """Distinct pairs before ``day`` with the number of works; counted before the shuffle."""
    return until(edges, day).groupBy("u", "v").agg(F.count(F.lit(1)).alias("links"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions, as (id, other, ...)."""
    rest = [c for c in pairs.columns if c not in ("u", "v")]
    return pairs.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other")), F.struct(F.col("v").alias("id"), F.col("u").alias("other")))).alias("e"), *rest).select("e.*", *rest)


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def compacted(snap: DataFrame) -> DataFrame:
    """(id, place): the nodes of a snapshot by ascending id, numbered from 0 without gaps. Tables by id and by place differ where ids are missing."""
    return with_row_number(nodes_of(snap), F.col("id"), name="place", start=0)


def degrees(snap: DataFrame) -> DataFrame:
    """(id, degree, weighted): distinct neighbours, and works with them."""
    return both_ways(snap).groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("links").alias("weighted"))


def two_hop(snap: DataFrame, binary: bool = True) -> DataFrame:
    """(id, two_hop): sum of the degrees of the neighbours, weighted by links where not ``binary``."""
    degree = degrees(snap).select(F.col("id").alias("other"), F.col("degree" if binary else "weighted").alias("d"))
    value = F.col("d") if binary else F.col("d") * F.col("links")
    return both_ways(snap).join(degree, "other").groupBy("id").agg(F.sum(value).alias("two_hop"))


def yearly_links(edges: DataFrame, cutoffs: dict[int, int]) -> DataFrame:
    """(u, v, l_<year>...) of the pairs before the last cutoff: the works that link them before each; one pass over ``edges`` for all years."""
    links = [F.count_if(F.col("day") < day).alias(f"l_{year}") for year, day in cutoffs.items()]
    return until(edges, max(cutoffs.values())).groupBy("u", "v").agg(*links)


def first_days(edges: DataFrame, day: int) -> DataFrame:
    """(u, v, day, links): pairs before ``day`` with the first day that links them and the number of works."""
    return until(edges, day).groupBy("u", "v").agg(F.min("day").alias("day"), F.count(F.lit(1)).alias("links"))


def yearly_nodes(links: DataFrame, years: list[int], binary: bool = True) -> DataFrame:
    """(id, degree_<year>..., two_hop_<year>...) of the nodes of :func:`yearly_links`, all years together; weighted by works where not ``binary``."""
    weight = lambda y: (F.col(f"l_{y}") > 0).cast("bigint") if binary else F.col(f"l_{y}")
    ways = both_ways(links)
    degree = cut(ways.groupBy("id").agg(*(F.sum(weight(y)).alias(f"degree_{y}") for y in years)))
    around = degree.select(F.col("id").alias("other"), *(F.col(f"degree_{y}").alias(f"__d_{y}") for y in years))
    hops = ways.join(around, "other").groupBy("id").agg(*(F.sum(weight(y) * F.col(f"__d_{y}")).alias(f"two_hop_{y}") for y in years))
    return degree.join(hops, "id")


def node_features(edges: DataFrame, cutoffs: dict[int, int], binary: bool = True) -> DataFrame:
    """(id, degree_<year>..., two_hop_<year>...) of all nodes of ``edges``, 0 where a node is not yet there."""
    found = yearly_nodes(cut(yearly_links(edges, cutoffs)), list(cutoffs), binary)
    names = [f"{kind}_{year}" for kind in ("degree", "two_hop") for year in cutoffs]
    return nodes_of(edges).join(found, "id", "left").select("id", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def yearly_common(links: DataFrame, years: list[int], pairs: DataFrame) -> DataFrame:
    """(u, v, common_<year>...) for the wanted ``pairs``, all years together.

    The paths of a pair start from its end with fewer neighbours and meet the neighbours of the other
    end on both ids, so no square of the graph is built and a hub is unfolded only beside another hub.
    """
    present = F.array(*((F.col(f"l_{y}") > 0).cast("int") for y in years))
    ways = cut(both_ways(links).select("id", "other", present.alias("in")))
    degree = ways.groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    asked = pairs.select("u", "v").distinct()
    for end in ("u", "v"):
        asked = asked.join(degree.select(F.col("id").alias(end), F.col("d").alias(f"__{end}")), end)  # a pair with an unknown end has no common neighbour
    u_first = F.col("__u") <= F.col("__v")
    turned = asked.select("u", "v", F.when(u_first, F.col("u")).otherwise(F.col("v")).alias("near"), F.when(u_first, F.col("v")).otherwise(F.col("u")).alias("far"))
    first = turned.join(ways.select(F.col("id").alias("near"), F.col("other").alias("mid"), F.col("in").alias("in_a")), "near")
    met = first.join(ways.select(F.col("id").alias("far"), F.col("other").alias("mid"), F.col("in").alias("in_b")), ["far", "mid"])
    return met.groupBy("u", "v").agg(*(F.sum(F.col("in_a")[i] * F.col("in_b")[i]).alias(f"common_{y}") for i, y in enumerate(years)))


def common_neighbours(snap: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, common) for the wanted ``pairs``; see :func:`yearly_common`."""
    found = yearly_common(snap.select("u", "v", F.lit(1).alias("l_0")), [0], pairs)
    return pairs.select("u", "v").distinct().join(found, ["u", "v"], "left").select("u", "v", F.coalesce("common_0", F.lit(0)).alias("common"))


#: Neighbours of a node that are one block where pairs of them are made, and pairs that one task makes, about.
BLOCK_NEIGHBOURS, TASK_PAIRS = 4096, 20_000_000


def two_step_pairs(snap: DataFrame) -> DataFrame:
    """(u, v, common) of all pairs u < v with a common neighbour; paths are counted before the shuffle.

    The neighbours of a hub are dealt to blocks, each two of which meet once, so that no task makes all
    its pairs; the number of tasks follows the number of paths, which the degrees tell.
    """
    ways = cut(both_ways(snap).select("id", "other"))
    degree = cut(ways.groupBy("id").agg(F.count(F.lit(1)).alias("d")))
    paths = degree.agg(F.sum(F.col("d").cast("double") * (F.col("d") - 1) / 2)).first()[0] or 0.0
    blocks = F.ceil(F.col("d") / BLOCK_NEIGHBOURS).cast("int")
    held = ways.join(degree, "id").select(F.col("id").alias("mid"), "other", blocks.alias("blocks"), block_of(F.col("other"), blocks).alias("block"))
    first, second = block_meetings(held, "mid", "block", "blocks", "other")
    tasks, meeting = int(paths // TASK_PAIRS) + 1, ["mid", "low", "high"]
    if tasks > int(snap.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        first, second = first.repartition(tasks, *meeting), second.repartition(tasks, *meeting)
    met = first.join(second, meeting).where("low < high OR first < second")
    return met.groupBy(F.least("first", "second").alias("u"), F.greatest("first", "second").alias("v")).agg(F.count(F.lit(1)).alias("common"))


def held_properties(pairs: DataFrame, graph: H.HeldGraph, vectors: str | None = None, most: dict[str, float] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """``pairs`` with the columns of :func:`pair_properties`, row by row, and by what each was divided.

    ``pairs`` are read twice, for the largest values and for the result; nothing of theirs is kept
    between. ``most`` of an earlier call spares the first pass, where ``pairs`` are some of its pairs.
    """
    years, kinds = graph.years, ("degree", "two_hop")
    raw = H.with_properties(pairs, graph, vectors)
    common = {f"common_{y}": F.col(f"common_{y}") for y in years}
    union = {y: F.col(f"degree_u_{y}") + F.col(f"degree_v_{y}") - F.col(f"common_{y}") for y in years}
    value = {f"{k}_{end}_{y}": F.col(f"{k}_{end}_{y}") / F.lit(graph.most[f"{k}_{y}"] or 1) for y in years for k in kinds for end in ("u", "v")}
    value |= common | {f"jaccard_{y}": F.when(union[y] > 0, F.col(f"common_{y}") / union[y]).otherwise(0.0) for y in years}
    if most is None:
        most = raw.agg(*(F.max(c).alias(n) for n, c in value.items())).first().asDict()  # one row
    divided = ((c / F.lit(most[n]) if most[n] else F.lit(0.0)).alias(n) for n, c in value.items())
    return raw.select(*pairs.columns, *divided, *(["decoded"] if vectors else [])), most


def pair_properties(edges: DataFrame, pairs: DataFrame, cutoffs: dict[int, int]) -> DataFrame:
    """Topological features of pairs: for each year scaled degrees and two-hop degrees of both ends, common neighbours and Jaccard.

    Degrees are divided by the largest of the year; common neighbours and Jaccard by the largest among
    the pairs; a column without a value above 0 is 0. All years are counted together. A graph that can
    be held in files is looked up by each pair without a shuffle, see ``held``; a larger one is joined.
    """
    years, kinds = list(cutoffs), ("degree", "two_hop")
    graph = H.hold_graph(first_days(edges, max(cutoffs.values())), cutoffs)
    if graph is not None:
        return held_properties(stored(pairs.select("u", "v").distinct(), "u", "v"), graph)[0]
    wanted, links = cut(pairs.select("u", "v").distinct()), cut(yearly_links(edges, cutoffs))
    node = cut(yearly_nodes(links, years))
    names = [f"{k}_{y}" for y in years for k in kinds]
    most = node.agg(*(F.max(n).alias(f"__m_{n}") for n in names))  # one row
    scaled = node.crossJoin(F.broadcast(most)).select("id", *((F.col(n) / F.col(f"__m_{n}")).alias(n) for n in names), *(F.col(f"degree_{y}").alias(f"__d_{y}") for y in years))
    out = wanted.join(yearly_common(links, years, wanted), ["u", "v"], "left")
    for end in ("u", "v"):
        side = [F.col(f"{k}_{y}").alias(f"{k}_{end}_{y}") for y in years for k in kinds] + [F.col(f"__d_{y}").alias(f"__d_{end}_{y}") for y in years]
        out = out.join(scaled.select(F.col("id").alias(end), *side), end, "left")
    out = out.withColumns({f"common_{y}": F.coalesce(f"common_{y}", F.lit(0)) for y in years})
    union = {y: F.coalesce(f"__d_u_{y}", F.lit(0)) + F.coalesce(f"__d_v_{y}", F.lit(0)) - F.col(f"common_{y}") for y in years}
    out = out.withColumns({f"jaccard_{y}": F.when(union[y] > 0, F.col(f"common_{y}") / union[y]).otherwise(0.0) for y in years})
    columns = [f"{k}_{end}_{y}" for y in years for k in kinds for end in ("u", "v")] + [f"{k}_{y}" for k in ("common", "jaccard") for y in years]
    out = cut(out.select("u", "v", *columns))
    most = out.agg(*(F.max(c).alias(f"__m_{c}") for c in columns))  # one row
    divided = lambda c: F.when(F.col(f"__m_{c}") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col(f"__m_{c}")).otherwise(0.0).alias(c)
    return out.crossJoin(F.broadcast(most)).select("u", "v", *(divided(c) for c in columns))


def linked_later(past: DataFrame, future: DataFrame, min_links: int = 1) -> DataFrame:
    """(u, v, links) of the pairs of the later snapshot, with at least ``min_links`` works, that the earlier one has not, both ends known in it."""
    known = nodes_of(past)
    fresh = future.where(F.col("links") >= min_links).join(past.select("u", "v"), ["u", "v"], "left_anti")
    return fresh.join(known.withColumnRenamed("id", "u"), "u", "left_semi").join(known.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v", "links")


def new_pairs(edges: DataFrame, past_day: int, future_day: int, min_links: int = 1) -> DataFrame:
    """Pairs first linked between the days, with at least ``min_links`` works by then, both ends known before."""
    return linked_later(cut(snapshot(edges, past_day)), snapshot(edges, future_day), min_links)


def distances_from(snap: DataFrame, sources: DataFrame, most: int = 6) -> DataFrame:
    """(source, id, distance) of everything within ``most`` steps; all sources walk at once, lineage is cut each round."""
    ways = cut(both_ways(snap).select("id", "other"))
    front = cut(sources.select(F.col(sources.columns[0]).alias("source")).distinct().select("source", F.col("source").alias("id"), F.lit(0).alias("distance")))
    seen = front
    for step in range(1, most + 1):
        reached = front.join(ways, "id").select("source", F.col("other").alias("id")).distinct().join(seen, ["source", "id"], "left_anti")
        front = cut(reached.withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def pair_distances(snap: DataFrame, pairs: DataFrame, most: int = 6) -> DataFrame:
    """``pairs`` with their distance, -1 beyond ``most`` or where there is no way; walks start from the side with fewer ids."""
    n_u, n_v = pairs.select("u").distinct().count(), pairs.select("v").distinct().count()
    start, end = ("u", "v") if n_u <= n_v else ("v", "u")
    walked = distances_from(snap, pairs.select(start), most).select(F.col("source").alias(start), F.col("id").alias(end), "distance")
    return pairs.join(walked, [start, end], "left").withColumn("distance", F.coalesce("distance", F.lit(-1)))


def all_pair_distances(snap: DataFrame, pairs: DataFrame, held_pairs: int | None = None) -> DataFrame:
    """Distinct (u, v, distance) of ``pairs`` over walks of any length, -1 only where there is no way.

    Many pairs have so many ends that walks from all of them reach about the square of the graph. A
    graph that can be held in files, of at most ``held_pairs`` pairs where that is given, is therefore
    mapped by the tasks, where each u is walked until its own v are found; a larger one is walked by joins.
    """
    asked = pairs.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).distinct()
    if held_pairs is not None and snap.count() > held_pairs:
        return pair_distances(snap, asked, most=1 << 31).select("u", "v", "distance")
    graph = H.hold_graph(snap.select("u", "v", F.lit(0).alias("day")), {0: 1})
    if graph is None:
        return pair_distances(snap, asked, most=1 << 31).select("u", "v", "distance")
    asked = stored(asked)
    tasks = max(3 * snap.sparkSession.sparkContext.defaultParallelism, -(-asked.count() // 100_000))
    return H.with_distances(asked.repartition(tasks, "u").sortWithinPartitions("u"), graph)


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that can be reached; by alternating large and small stars, lineage cut each round.

    Fails if the stars still change after ``most_rounds``.
    """
    current = cut(pairs.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a != b").distinct())
    for _ in range(most_rounds):
        ways = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        fresh = cut(large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct())
        moved = fresh.exceptAll(current).limit(1).count() + current.exceptAll(fresh).limit(1).count()
        current = fresh
        if not moved:
            break
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    roots = nodes_of(pairs)
    return roots.join(current.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_years(edges: DataFrame) -> DataFrame:
    """(y, components, largest, nodes) of the graph of all works until the end of each year of ``edges``.

    A year starts from the stars of the year before, which stand for all its older edges. Every
    component has at least two nodes, as nodes come from edges.
    """
    first = cut(edges.groupBy("u", "v").agg(F.min("y").alias("y")))
    stars, out = None, None
    for year in sorted(row["y"] for row in edges.select("y").distinct().collect()):  # one row a year
        fresh = first.where(F.col("y") == year).select("u", "v")
        stars = cut(components(fresh if stars is None else fresh.unionByName(stars.select(F.col("component").alias("u"), F.col("id").alias("v")))))
        sizes = stars.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        one = sizes.agg(F.lit(year).alias("y"), F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"), F.sum("size").alias("nodes"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else first.select("y", *(F.lit(0).cast("bigint").alias(c) for c in ("components", "largest", "nodes")))


def event_years(edges: DataFrame, pairs: DataFrame, start: int, end: int) -> DataFrame:
    """``pairs`` with the first year in (start, end] that links them, -1 without one."""
    first = edges.where((F.col("y") > start) & (F.col("y") <= end)).groupBy("u", "v").agg(F.min("y").alias("event_year"))
    return pairs.join(first, ["u", "v"], "left").withColumn("event_year", F.coalesce("event_year", F.lit(-1)))


def emerging(mentions: DataFrame, cutoff_year: int, start_year: int, least: int) -> DataFrame:
    """(cid, first_year, n) of concepts first seen in ``start_year`` or later and in ``least`` mentions by the cutoff year."""
    seen = mentions.where(F.col("y") <= cutoff_year).groupBy("cid").agg(F.min("y").alias("first_year"), F.count(F.lit(1)).alias("n"))
    return seen.where((F.col("first_year") >= start_year) & (F.col("n") >= least))


def message_mean(snap_edges: DataFrame, features: DataFrame, values: list[str]) -> DataFrame:
    """(id, mean of the neighbours' values): one aggregation layer over the full neighbourhood, repeated edges weighing as often."""
    sides = both_ways(snap_edges.select("u", "v"))
    return sides.join(features.select(F.col("id").alias("other"), *values), "other").groupBy("id").agg(*(F.avg(v).alias(v) for v in values))


def cumulative_edges(edges: DataFrame) -> DataFrame:
    """(y, edges, edges_until): one row a year."""
    yearly = edges.groupBy("y").agg(F.count(F.lit(1)).alias("edges"))
    return yearly.withColumn("edges_until", F.sum("edges").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, 0)))


def degree_column(by: Column) -> Column:
    return F.coalesce(by, F.lit(0))
