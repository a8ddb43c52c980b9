"""Queries of vector arithmetic, JSON, graph walks, candidate pairs, models, metrics and streams."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import best as B
from corpusloom.operators import embeddings as E
from corpusloom.operators import extraction as X
from corpusloom.operators import graph as G
from corpusloom.operators import held as H
from corpusloom.operators import metrics as M
from corpusloom.operators import models as N
from corpusloom.operators import sampling as S
from corpusloom.operators.extraction import reply_items, reply_reason, request_body
from corpusloom.session import cut, stored
from corpusloom.sources.readers import scratch
from corpusloom.streaming.incremental import append_new, run_once, running_counts, stream_table, streamed_edges

from .registry import Registry
from .relational_queries import _DEGREES, _VECTORS, _work_vectors, small_side
from .views import EDGES, FEATURE_DAYS, FUTURE_DAY, LABELS, LOOKUP, MENTIONS, PAST_DAY, PAST_GRAPH, SCORED, edges, label_lists, lookup, mentions, scored, snapshot_sql, ways_sql

q = Registry()

# --- vectors, scores, small parsing

_PAIRS_OF_VECTORS = "p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _vector_pairs(t):
    a = t("embeddings").select("vec_id", F.col("embedding").alias("x"))
    return a.join(t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")


@q("mat1_vector_measures", f"WITH {_PAIRS_OF_VECTORS} SELECT vec_id, round(list_distance(x, y), 5) AS euclidean, round(list_cosine_similarity(x, y), 5) AS cosine, round(list_dot_product(x, y), 5) AS dot, round(acos(list_cosine_similarity(x, y)), 5) AS angle FROM p")
def _(t, s, d):
    x, y = F.col("x"), F.col("y")
    return _vector_pairs(t).select("vec_id", *(F.round(f(x, y), 5).alias(n) for n, f in (("euclidean", V.euclidean), ("cosine", V.cosine), ("dot", V.dot), ("angle", V.angle))))


@q("mat2_pair_features", f"WITH {_PAIRS_OF_VECTORS} SELECT vec_id, CAST(len(x || y) AS INTEGER) AS joined, round(list_distance(x, y), 5) AS f0, round(list_cosine_similarity(x, y), 5) AS f1 FROM p")
def _(t, s, d):
    features = V.pair_features(F.col("x"), F.col("y"))
    return _vector_pairs(t).select("vec_id", F.size(F.concat("x", "y")).alias("joined"), F.round(F.get(features, 0), 5).alias("f0"), F.round(F.get(features, 1), 5).alias("f1"))


_COMMON = f"{PAST_GRAPH}, {_DEGREES}, common AS (SELECT s.u, s.v, count(*) AS common FROM snap s JOIN ways a ON a.id = s.u JOIN ways b ON b.id = s.v AND b.other = a.other GROUP BY 1, 2)"


@q("mat3_jaccard", f"WITH {_COMMON} SELECT s.u, s.v, round(CASE WHEN a.degree + b.degree - coalesce(common, 0) > 0 THEN coalesce(common, 0) / (a.degree + b.degree - coalesce(common, 0)) ELSE 0.0 END, 6) AS jaccard FROM snap s LEFT JOIN common USING (u, v) JOIN deg a ON a.id = s.u JOIN deg b ON b.id = s.v")
def _(t, s, d):
    snap = cut(G.snapshot(edges(t), PAST_DAY))
    degree = G.degrees(snap)
    out = G.common_neighbours(snap, snap)
    for end in ("u", "v"):
        out = out.join(degree.select(F.col("id").alias(end), F.col("degree").alias(f"d_{end}")), end)
    return out.select("u", "v", F.round(V.jaccard(F.col("common"), F.col("d_u"), F.col("d_v")), 6).alias("jaccard"))


@q("mat4_divided_by_largest", f"WITH {PAST_GRAPH}, {_DEGREES} SELECT id, round(degree / (SELECT max(degree) FROM deg), 6) AS share FROM deg")
def _(t, s, d):
    degree = cut(G.degrees(G.snapshot(edges(t), PAST_DAY)))
    return degree.crossJoin(F.broadcast(degree.agg(F.max("degree").alias("most")))).select("id", F.round(V.scaled(F.col("degree"), F.col("most")), 6).alias("share"))  # one row


@q("mat5_log_z_score", "WITH l AS (SELECT o_orderkey, ln(1 + o_totalprice) AS x FROM orders), m AS (SELECT avg(x) AS mean, stddev_pop(x) AS dev FROM l) SELECT o_orderkey, round((x - mean) / (dev + 1e-6), 5) AS z FROM l, m")
def _(t, s, d):
    logs = t("orders").select("o_orderkey", F.log1p("o_totalprice").alias("x"))
    moments = logs.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev"))  # one row
    return logs.crossJoin(F.broadcast(moments)).select("o_orderkey", F.round(V.z_score(F.col("x"), F.col("mean"), F.col("dev")), 5).alias("z"))


@q("mat6_clean_scores", "SELECT doc_id, CAST(CASE doc_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM documents")
def _(t, s, d):
    odd = F.element_at(F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(float("-inf")), F.lit(0.5), F.lit(None).cast("double")), (F.col("doc_id") % 5 + 1).cast("int"))
    return t("documents").select("doc_id", V.clean_score(odd).alias("score"))


@q("mat7_blend", f"WITH {SCORED} SELECT idx, round(0.2 * score + 0.8 * score2, 6) AS score FROM scored")
def _(t, s, d):
    return scored(t).select("idx", F.round(V.blend(F.col("score"), F.col("score2"), 0.2), 6).alias("score"))


@q("mat8_plane_distance", "SELECT a.vec_id, round(coalesce(sqrt(pow(a.embedding[1] - b.embedding[1], 2) + pow(a.embedding[2] - b.embedding[2], 2)), -1.0), 4) AS distance FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t, s, d):
    at = lambda c, i: F.get(c, i).cast("double")
    other = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    rows = t("embeddings").select("vec_id", F.col("embedding").alias("x")).join(other, "vec_id", "left")
    return rows.select("vec_id", F.round(V.plane_distance(at("x", 0), at("x", 1), at("y", 0), at("y", 1)), 4).alias("distance"))


@q("mat9_half_even", "SELECT p_partkey, CAST(round_even(CAST(p_size AS DECIMAL(9, 1)) / 2, 0) AS BIGINT) AS half FROM part")
def _(t, s, d):
    return t("part").select("p_partkey", F.bround(F.col("p_size") / 2, 0).cast("bigint").alias("half"))


@q("mat10_cubic_trend")
def _(t, s, d):
    yearly = t("surgery_pubmed_works").where("publication_year IS NOT NULL").groupBy("publication_year").agg(F.count(F.lit(1)).alias("n"))
    return E.cubic_trend(yearly, "publication_year", "n")


@q("mat11_principal_components")
def _(t, s, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = t("embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    return PCA(k=2, inputCol="x", outputCol="y").fit(rows).transform(rows).select("vec_id", F.transform(vector_to_array("y"), lambda v: F.round(F.abs(v), 5)).alias("size"))


@q("mat12_sigmoid_softmax", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-l_quantity / 10)), 6) AS sigmoid, round(exp(l_discount) / (exp(l_discount) + exp(l_tax)), 6) AS first FROM lineitem")
def _(t, s, d):
    first = F.get(V.softmax(F.array("l_discount", "l_tax")), 0)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(V.sigmoid(F.col("l_quantity") / 10), 6).alias("sigmoid"), F.round(first, 6).alias("first"))


_REPLY = "CASE k % 5 WHEN 0 THEN '{\"items\":[{\"pmid\":\"' || k || '\",\"concepts\":[\"INR threshold\",\"proctectomy\",\"study\",\"INR  threshold\"]}]}' WHEN 1 THEN '[1]' WHEN 2 THEN '{\"items\":[{\"pmid\":\"x\",\"concepts\":[]}]}' WHEN 3 THEN '{\"items\":[{\"pmid\":\"' || k || '\"}]}' ELSE 'no json' END"


def _replies(t):
    k = F.col("doc_id").cast("string")
    good = F.concat(F.lit('{"items":[{"pmid":"'), k, F.lit('","concepts":["INR threshold","proctectomy","study","INR  threshold"]}]}'))
    bare = F.concat(F.lit('{"items":[{"pmid":"'), k, F.lit('"}]}'))
    reply = F.element_at(F.array(good, F.lit("[1]"), F.lit('{"items":[{"pmid":"x","concepts":[]}]}'), bare, F.lit("no json")), (F.col("doc_id") % 5 + 1).cast("int"))
    return t("documents").select("doc_id", reply.alias("reply"), F.array(k).alias("expected"))


@q("jsn1_reply_reasons", "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'not_an_object_with_items' WHEN 2 THEN 'pmids_differ' WHEN 3 THEN 'item_fields' WHEN 4 THEN 'not_an_object_with_items' END AS reason FROM documents")
def _(t, s, d):
    return _replies(t).select("doc_id", reply_reason(F.col("reply"), F.col("expected")).alias("reason"))


@q("jsn1_reply_items", "SELECT CAST(doc_id AS VARCHAR) AS pmid, 'inr threshold' AS concepts FROM documents WHERE doc_id % 5 = 0")
def _(t, s, d):
    good = _replies(t).where(reply_reason(F.col("reply"), F.col("expected")).isNull())
    return reply_items(good, "reply").select("pmid", F.array_join("concepts", "/").alias("concepts"))


@q("jsn2_request_body", """SELECT doc_id, '{"messages":[{"role":"system","content":"name concepts"},{"role":"user","content":"[{\\"id\\":' || doc_id || '}]"}]}' AS body FROM documents""")
def _(t, s, d):
    items = F.array(F.struct(F.col("doc_id").alias("id")))
    return t("documents").select("doc_id", request_body("name concepts", items).alias("body"))


@q("jsn3_hashes", "SELECT doc_id, sha256(text) AS long_hash, md5(text) AS short_hash FROM documents")
def _(t, s, d):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("long_hash"), F.md5("text").alias("short_hash"))


@q("jsn4_settings", "SELECT p_partkey, p_size AS hidden, 0.5::DOUBLE AS rate FROM part")
def _(t, s, d):
    held = V.settings(F.concat(F.lit("hidden="), F.col("p_size").cast("string"), F.lit(",rate=0.5")))
    return t("part").select("p_partkey", held["hidden"].cast("int").alias("hidden"), held["rate"].cast("double").alias("rate"))


@q("jsn5_flatten", "SELECT p_partkey, p_brand || '/' || p_type || '/' || p_brand AS flat FROM part")
def _(t, s, d):
    return t("part").select("p_partkey", F.array_join(F.flatten(F.array(F.array("p_brand", "p_type"), F.array("p_brand"))), "/").alias("flat"))


@q("jsn6_optional_values", "SELECT doc_id, try_cast(publication_date AS INTEGER) AS number, lower(trim(lang)) IN ('1', 'true', 'yes', 'y') AS truth FROM documents")
def _(t, s, d):
    return t("documents").select("doc_id", V.optional_int(F.col("publication_date")).alias("number"), V.truth(F.col("lang")).alias("truth"))


@q("jsn7_matrix_rows", "SELECT i AS id, CASE WHEN vec_id IS NULL THEN 0.0 ELSE round(embedding[1]::DOUBLE, 5) END AS first_value FROM range((SELECT max(vec_id) + 1 FROM embeddings WHERE label > 4)) g(i) LEFT JOIN embeddings ON vec_id = i AND label > 4")
def _(t, s, d):
    vectors = t("embeddings").where("label > 4").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return E.to_matrix_rows(vectors, 64).select("id", F.round(F.get("vec", 0), 5).alias("first_value"))


# --- graph


@q("grf1_graph_build", f"WITH {EDGES}, c AS (SELECT cid, count(*) AS n FROM mentions GROUP BY cid HAVING count(*) >= 3), ids AS (SELECT p_partkey AS cid, row_number() OVER (ORDER BY p_name || ' ' || CAST(p_partkey AS VARCHAR)) - 1 AS id FROM part WHERE p_partkey IN (SELECT cid FROM c)) SELECT e.work_id, least(a.id, b.id) AS v1, greatest(a.id, b.id) AS v2, e.day FROM edges e JOIN ids a ON a.cid = e.u JOIN ids b ON b.cid = e.v")
def _(t, s, d):
    """Mentions by label, counted and filtered, ids by label order, then all pairs of each work."""
    from corpusloom.operators.ordering import with_row_number

    labels = lookup(t).withColumnRenamed("id", "cid")
    named = cut(mentions(t))
    kept = named.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    ids = cut(with_row_number(labels.join(kept, "cid", "left_semi"), F.col("concept"), name="id", start=0).select("cid", "id"))
    built = G.edges_of_mentions(named.join(small_side(ids), "cid").select("work_id", F.col("id").alias("cid"), "day", "y"))
    return built.select("work_id", F.col("u").alias("v1"), F.col("v").alias("v2"), "day")


@q("grf2_snapshots", f"WITH {EDGES} SELECT c.y AS year, count(*) AS pairs, CAST(sum(links) AS BIGINT) AS links FROM (SELECT c.y, u, v, count(*) AS links FROM edges, (VALUES {', '.join(f'({y}, {day})' for y, day in FEATURE_DAYS.items())}) c(y, cutoff) WHERE day < cutoff GROUP BY 1, 2, 3) c GROUP BY 1")
def _(t, s, d):
    every = cut(edges(t))
    out = None
    for year, day in FEATURE_DAYS.items():
        one = G.snapshot(every, day).agg(F.count(F.lit(1)).alias("pairs"), F.sum("links").alias("links")).select(F.lit(year).alias("year"), "pairs", "links")
        out = one if out is None else out.unionByName(one)
    return out


@q("grf3_neighbour_test", f"WITH {PAST_GRAPH}, p AS (SELECT DISTINCT u, v FROM edges WHERE day >= {FUTURE_DAY}) SELECT p.u, p.v, snap.u IS NOT NULL AS linked FROM p LEFT JOIN snap USING (u, v)")
def _(t, s, d):
    every = edges(t)
    asked = every.where(F.col("day") >= FUTURE_DAY).select("u", "v").distinct()
    return asked.join(G.snapshot(every, PAST_DAY).select("u", "v", F.lit(True).alias("linked")), ["u", "v"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def _feature_sql() -> str:
    parts, columns, joins = [], [], []
    for y, day in FEATURE_DAYS.items():
        parts += [snapshot_sql(f"s{y}", day), ways_sql(f"w{y}", f"s{y}"), f"d{y} AS (SELECT id, count(*) AS degree FROM w{y} GROUP BY id)", f"t{y} AS (SELECT w.id, CAST(sum(degree) AS BIGINT) AS two_hop FROM w{y} w JOIN d{y} d ON d.id = w.other GROUP BY w.id)"]
        columns += [f"coalesce(d{y}.degree, 0) AS degree_{y}", f"coalesce(t{y}.two_hop, 0) AS two_hop_{y}"]
        joins.append(f"LEFT JOIN d{y} ON d{y}.id = n.id LEFT JOIN t{y} ON t{y}.id = n.id")
    return f"WITH {EDGES}, nodes AS (SELECT u AS id FROM edges UNION SELECT v FROM edges), {', '.join(parts)} SELECT n.id, {', '.join(columns)} FROM nodes n {' '.join(joins)}"


@q("grf4_node_features", _feature_sql())
def _(t, s, d):
    return G.node_features(cut(edges(t)), FEATURE_DAYS)


def _property_sql() -> str:
    parts, columns, joins, names = [], [], [], []
    for y, day in FEATURE_DAYS.items():
        parts += [
            snapshot_sql(f"s{y}", day), ways_sql(f"w{y}", f"s{y}"), f"d{y} AS (SELECT id, count(*) AS d FROM w{y} GROUP BY id)", f"t{y} AS (SELECT w.id, sum(d) AS t FROM w{y} w JOIN d{y} d ON d.id = w.other GROUP BY w.id)",
            f"c{y} AS (SELECT p.u, p.v, count(*) AS c FROM pairs p JOIN w{y} a ON a.id = p.u JOIN w{y} b ON b.id = p.v AND b.other = a.other GROUP BY 1, 2)",
        ]
        for end in ("u", "v"):
            joins.append(f"LEFT JOIN d{y} d{end}{y} ON d{end}{y}.id = p.{end} LEFT JOIN t{y} t{end}{y} ON t{end}{y}.id = p.{end}")
            columns += [f"coalesce(d{end}{y}.d, 0) / (SELECT max(d) FROM d{y}) AS degree_{end}_{y}", f"coalesce(t{end}{y}.t, 0) / (SELECT max(t) FROM t{y}) AS two_hop_{end}_{y}"]
            names += [f"degree_{end}_{y}", f"two_hop_{end}_{y}"]
        union = f"(coalesce(du{y}.d, 0) + coalesce(dv{y}.d, 0) - coalesce(c{y}.c, 0))"
        joins.append(f"LEFT JOIN c{y} ON c{y}.u = p.u AND c{y}.v = p.v")
        columns += [f"coalesce(c{y}.c, 0) AS common_{y}", f"CASE WHEN {union} > 0 THEN coalesce(c{y}.c, 0) / {union} ELSE 0.0 END AS jaccard_{y}"]
        names += [f"common_{y}", f"jaccard_{y}"]
    scaled = ", ".join(f"round(CASE WHEN max({n}) OVER () > 0 THEN {n} / max({n}) OVER () ELSE 0.0 END + 1e-9, 6) AS {n}" for n in names)
    pairs = f"{snapshot_sql('fut', FUTURE_DAY)}, pairs AS (SELECT DISTINCT u, v FROM edges WHERE day >= {FUTURE_DAY})"
    return f"WITH {EDGES}, {pairs}, {', '.join(parts)}, raw AS (SELECT p.u, p.v, {', '.join(columns)} FROM pairs p {' '.join(joins)}) SELECT u, v, {scaled} FROM raw"


@q("grf5_pair_properties", _property_sql())
def _(t, s, d):
    every = edges(t)  # made again for each use: kept, they would be many times the tables
    out = G.pair_properties(every, every.where(F.col("day") >= FUTURE_DAY), FEATURE_DAYS)
    return out.select("u", "v", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in out.columns if c not in ("u", "v")))  # exact halves go up in any engine


_NEAR = f"WITH {PAST_GRAPH}, src AS (SELECT id FROM ways GROUP BY id ORDER BY count(*) DESC, id LIMIT 5), d1 AS (SELECT s.id AS source, w.other AS id FROM src s JOIN ways w ON w.id = s.id), d2 AS (SELECT DISTINCT d1.source, w.other AS id FROM d1 JOIN ways w ON w.id = d1.id), u AS (SELECT id AS source, id, 0 AS distance FROM src UNION ALL SELECT source, id, 1 FROM d1 UNION ALL SELECT source, id, 2 FROM d2)"


@q("grf6_pair_distance", f"{_NEAR}, b AS (SELECT source, id, min(distance) AS distance FROM u GROUP BY 1, 2) SELECT least(a.id, c.id) AS u, greatest(a.id, c.id) AS v, coalesce(b.distance, -1) AS distance FROM src a JOIN src c ON a.id < c.id LEFT JOIN b ON b.source = a.id AND b.id = c.id")
def _(t, s, d):
    snap = cut(G.snapshot(edges(t), PAST_DAY))
    busy = cut(G.degrees(snap).orderBy(F.desc("degree"), "id").limit(5).select("id"))
    asked = busy.select(F.col("id").alias("u")).join(busy.select(F.col("id").alias("v")), F.col("u") < F.col("v"))  # five ids
    return G.pair_distances(snap, asked, most=2).select("u", "v", "distance")


@q("grf7_bounded_walks", f"{_NEAR} SELECT source, id, min(distance) AS distance FROM u GROUP BY 1, 2")
def _(t, s, d):
    snap = cut(G.snapshot(edges(t), PAST_DAY))
    return G.distances_from(snap, G.degrees(snap).orderBy(F.desc("degree"), "id").limit(5), 2)


@q("grf8_annotated_pairs")
def _(t, s, d):
    """The pairs of all works from the past day on, in the graph before it."""
    every = edges(t)  # made again for each use: kept, they would be many times the tables
    return G.all_pair_distances(G.snapshot(every, PAST_DAY), every.where(F.col("day") >= PAST_DAY))


@q("grf9_depth_filter", f"{_NEAR}, b AS (SELECT source, id, min(distance) AS distance FROM u GROUP BY 1, 2), n AS (SELECT DISTINCT id FROM ways) SELECT s.id AS source, n.id FROM src s, n LEFT JOIN b ON b.source = s.id AND b.id = n.id WHERE coalesce(b.distance, 99) >= 3")
def _(t, s, d):
    snap = cut(G.snapshot(edges(t), PAST_DAY))
    busy = cut(G.degrees(snap).orderBy(F.desc("degree"), "id").limit(5).select(F.col("id").alias("source")))
    walked = G.distances_from(snap, busy, 2)
    every = G.nodes_of(snap).crossJoin(F.broadcast(busy))  # five sources
    return every.join(walked, ["source", "id"], "left").where(F.coalesce("distance", F.lit(99)) >= 3).select("source", "id")


_CC = f"WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT u, v FROM edges UNION SELECT DISTINCT v, u FROM edges), r(id, c) USING KEY (id) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, min(r.c) FROM r JOIN e ON e.u = r.id JOIN recurring.r AS k ON k.id = e.v WHERE r.c < k.c GROUP BY e.v)"


@q("grf10_components", f"{_CC} SELECT id, c AS component FROM r")
def _(t, s, d):
    return G.components(cut(edges(t).select("u", "v").distinct()))


@q("grf10_component_sizes", f"{_CC} SELECT c AS component, count(*) AS size FROM r GROUP BY 1 HAVING count(*) > 1")
def _(t, s, d):
    return G.components(cut(edges(t).select("u", "v").distinct())).groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")


def _component_years_sql() -> str:
    years = range(1990, 2006)
    tables = [
        f"e{y} AS (SELECT DISTINCT u, v FROM edges WHERE y <= {y} UNION SELECT DISTINCT v, u FROM edges WHERE y <= {y}), r{y}(id, c) USING KEY (id) AS (SELECT DISTINCT u, u FROM e{y} UNION SELECT e{y}.v, min(r{y}.c) FROM r{y} JOIN e{y} ON e{y}.u = r{y}.id JOIN recurring.r{y} AS k ON k.id = e{y}.v WHERE r{y}.c < k.c GROUP BY e{y}.v)"
        for y in years
    ]
    rows = [f"SELECT CAST({y} AS INTEGER) AS y, count(*) AS components, max(n) AS largest, CAST(sum(n) AS BIGINT) AS nodes FROM (SELECT c, count(*) AS n FROM r{y} GROUP BY c) HAVING {y} IN (SELECT y FROM edges)" for y in years]
    return f"WITH RECURSIVE {EDGES}, {', '.join(tables)} {' UNION ALL '.join(rows)}"


@q("grf10_component_years", _component_years_sql())
def _(t, s, d):
    return G.component_years(cut(edges(t)))


@q("grf11_degree_distribution", f"WITH {PAST_GRAPH}, {_DEGREES} SELECT degree, count(*) AS nodes FROM deg GROUP BY degree")
def _(t, s, d):
    return G.degrees(G.snapshot(edges(t), PAST_DAY)).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


@q("grf12_message_edges", f"WITH {EDGES} SELECT u AS id, v AS other, day FROM edges WHERE day < {PAST_DAY} UNION ALL SELECT v, u, day FROM edges WHERE day < {PAST_DAY}")
def _(t, s, d):
    return G.both_ways(G.until(edges(t), PAST_DAY).select("u", "v", "day"))


@q("agg20_distance_histogram", f"WITH {PAST_GRAPH}, p AS (SELECT u, v, CAST(count(*) > 1 AS INTEGER) AS label FROM edges WHERE day >= {PAST_DAY} GROUP BY u, v), two AS (SELECT DISTINCT p.u, p.v FROM p JOIN ways a ON a.id = p.u JOIN ways b ON b.id = p.v AND b.other = a.other), k AS (SELECT label, CASE WHEN snap.u IS NOT NULL THEN 1 WHEN two.u IS NOT NULL THEN 2 ELSE 3 END AS d FROM p LEFT JOIN snap USING (u, v) LEFT JOIN two ON two.u = p.u AND two.v = p.v) SELECT label, count(*) FILTER (d = 1) AS d1, count(*) FILTER (d = 2) AS d2, count(*) FILTER (d = 3) AS further, count(*) AS pairs FROM k GROUP BY label")
def _(t, s, d):
    """Later pairs, of one work or of several, by their distance in the graph before; all distances are walked, those beyond two stand in one column."""
    every = cut(edges(t))
    later = cut(every.where(F.col("day") >= PAST_DAY).groupBy("u", "v").agg((F.count(F.lit(1)) > 1).cast("int").alias("label")))
    walked = G.all_pair_distances(cut(G.snapshot(every, PAST_DAY)), later)
    rows = later.join(walked, ["u", "v"])
    return rows.groupBy("label").agg(F.count_if(F.col("distance") == 1).alias("d1"), F.count_if(F.col("distance") == 2).alias("d2"), F.count_if(~F.col("distance").isin(1, 2)).alias("further"), F.count(F.lit(1)).alias("pairs"))


# --- pair sets and candidates

_POSITIVE = f"{EDGES}, {snapshot_sql('a', PAST_DAY)}, {snapshot_sql('b', FUTURE_DAY)}, known AS (SELECT u AS id FROM a UNION SELECT v FROM a), pos AS (SELECT b.u, b.v FROM b LEFT JOIN a USING (u, v) WHERE a.u IS NULL AND b.u IN (SELECT id FROM known) AND b.v IN (SELECT id FROM known))"
_HASH = "(u * 1000003 + v * 7919 + 42 * 104729) % 2147483647"


def _unlinked_sql(snaps: list[tuple[str, int]], n: int) -> str:
    """Pairs drawn from the nodes of the first snapshot that no snapshot links, by the draws of the first round."""
    place = lambda s: f"(((k * 1000003 + {s * 104729}) % 2147483647) * ((k * 1000003 + {s * 104729}) % 2147483647) + (k * 1000003 + {s * 104729}) % 2147483647) % 2147483647 % n"
    parts = ", ".join(snapshot_sql(name, day) for name, day in snaps)
    linked = " UNION ".join(f"SELECT u, v FROM {name}" for name, _ in snaps)
    first = snaps[0][0]
    return f"""WITH {EDGES}, {parts}, nodes AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM (SELECT u AS id FROM {first} UNION SELECT v FROM {first})), c AS (SELECT count(*) AS n FROM nodes),
d AS (SELECT {place(42)} AS a, {place(43)} AS b FROM range({max(64, 3 * n)}) t(k), c), p AS (SELECT DISTINCT least(x.id, y.id) AS u, greatest(x.id, y.id) AS v FROM d JOIN nodes x ON x.rank = a JOIN nodes y ON y.rank = b WHERE a <> b)
SELECT u, v FROM p WHERE (u, v) NOT IN ({linked}) ORDER BY {_HASH}, u, v LIMIT {n}"""


@q("smp2_negative_pairs", _unlinked_sql([("a", PAST_DAY), ("b", FUTURE_DAY)], 2000))
def _(t, s, d):
    every = cut(edges(t))
    past, future = cut(G.snapshot(every, PAST_DAY)), cut(G.snapshot(every, FUTURE_DAY))
    return S.unlinked_pairs(G.nodes_of(past), [past, future], 2000)


@q("smp3_labelled_evaluation", f"WITH {_POSITIVE}, p AS (SELECT DISTINCT u, v FROM edges WHERE day >= {PAST_DAY}) SELECT p.u, p.v, CAST(coalesce(b.links >= 2 AND a.u IS NULL, false) AS INTEGER) AS label FROM p LEFT JOIN b USING (u, v) LEFT JOIN a ON a.u = p.u AND a.v = p.v")
def _(t, s, d):
    every = cut(edges(t))
    asked = every.where(F.col("day") >= PAST_DAY).select("u", "v").distinct()
    future = G.snapshot(every, FUTURE_DAY).where("links >= 2").select("u", "v", F.lit(1).alias("new")).join(G.snapshot(every, PAST_DAY).select("u", "v"), ["u", "v"], "left_anti")
    return asked.join(future, ["u", "v"], "left").select("u", "v", F.coalesce("new", F.lit(0)).alias("label"))


@q("smp4_stratified", f"WITH {_POSITIVE}, n AS (SELECT u, v FROM a), d AS (SELECT u, v, 1 AS label, row_number() OVER (ORDER BY {_HASH}, u, v) AS r FROM pos UNION ALL SELECT u, v, 0, row_number() OVER (ORDER BY {_HASH}, u, v) FROM n) SELECT u, v, label FROM d WHERE label = 1 AND r <= 100 OR label = 0 AND r <= 900")
def _(t, s, d):
    every = cut(edges(t))
    pairs = G.new_pairs(every, PAST_DAY, FUTURE_DAY).select("u", "v", F.lit(1).alias("label")).unionByName(G.snapshot(every, PAST_DAY).select("u", "v", F.lit(0).alias("label")))
    return S.stratified_pairs(cut(pairs), 1000, 0.1)


@q("smp5_split", f"WITH {_POSITIVE} SELECT u, v, CASE WHEN (u * 1000003 + v * 7919 + 43 * 104729) % 2147483647 % 100 < 80 THEN 'train' ELSE 'val' END AS split FROM pos")
def _(t, s, d):
    return S.split_pairs(G.new_pairs(edges(t), PAST_DAY, FUTURE_DAY).select("u", "v"))


def _pair_set_sql() -> str:
    place = lambda s: f"(((k * 1000003 + {s * 104729}) % 2147483647) * ((k * 1000003 + {s * 104729}) % 2147483647) + (k * 1000003 + {s * 104729}) % 2147483647) % 2147483647 % c.n"
    return f"""WITH {_POSITIVE}, w AS (SELECT count(*) // 2 AS n FROM pos), nodes AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM known), c AS (SELECT count(*) AS n FROM nodes),
d AS (SELECT {place(42)} AS a, {place(43)} AS b FROM (SELECT unnest(range(greatest(64, 3 * n))) AS k FROM w), c), p AS (SELECT DISTINCT least(x.id, y.id) AS u, greatest(x.id, y.id) AS v FROM d JOIN nodes x ON x.rank = a JOIN nodes y ON y.rank = b WHERE a <> b),
free AS (SELECT u, v, row_number() OVER (ORDER BY {_HASH}, u, v) AS r FROM p WHERE (u, v) NOT IN (SELECT u, v FROM a UNION SELECT u, v FROM b)),
rows AS (SELECT u, v, 1 AS label FROM pos UNION ALL SELECT u, v, 0 FROM free, w WHERE r <= w.n) SELECT u, v, label, CASE WHEN (u * 1000003 + v * 7919 + 43 * 104729) % 2147483647 % 100 < 80 THEN 'train' ELSE 'val' END AS split FROM rows"""


@q("smp6_pair_set", _pair_set_sql())
def _(t, s, d):
    return S.split_pairs(S.labelled_pairs(cut(edges(t)), PAST_DAY, FUTURE_DAY, negatives=0.5))


@q("smp7_balanced_batch", f"""WITH {SCORED}, r AS (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS rank, count(*) OVER (PARTITION BY label) AS c FROM scored),
d AS (SELECT i AS draw, CASE WHEN i < 80 THEN 1 ELSE 0 END AS label FROM range(400) t(i)) SELECT draw, idx, r.label FROM d JOIN r ON r.label = d.label AND r.rank = (draw * 1000003 + d.label * 7919 + 42 * 104729) % 2147483647 % r.c""")
def _(t, s, d):
    return S.balanced_batch(scored(t), "idx", "label", 400, 0.2)


@q("smp8_random_candidates", _unlinked_sql([("a", PAST_DAY)], 3000))
def _(t, s, d):
    past = cut(G.snapshot(edges(t), PAST_DAY))
    return S.unlinked_pairs(G.nodes_of(past), [past], 3000)


def _candidates(name: str, sources: str, targets: str, source_rows, target_rows) -> None:
    sql = f"WITH {PAST_GRAPH}, n AS (SELECT DISTINCT id FROM ways), s AS (SELECT id FROM n WHERE id IN ({sources})), g AS (SELECT id FROM n WHERE id IN ({targets})), p AS (SELECT DISTINCT least(s.id, g.id) AS u, greatest(s.id, g.id) AS v FROM s, g WHERE s.id <> g.id) SELECT u, v FROM p WHERE (u, v) NOT IN (SELECT (u, v) FROM snap)"

    @q(name, sql)
    def _(t, s, d):
        snap = cut(G.snapshot(edges(t), PAST_DAY))
        nodes = cut(G.nodes_of(snap))
        return S.candidates_between(*(cut(rows(t).select("id").distinct().join(nodes, "id", "left_semi")) for rows in (source_rows, target_rows)), snap)


_ids = lambda t, condition: t("part").where(condition).select(F.col("p_partkey").alias("id"))
_candidates("smp9_anchor_candidates", "SELECT p_partkey FROM part WHERE p_size = 7", "SELECT p_partkey FROM part", lambda t: _ids(t, "p_size = 7"), lambda t: _ids(t, "true"))
_candidates("smp10_module_cross", "SELECT p_partkey FROM part WHERE p_size = 3", "SELECT p_partkey FROM part WHERE p_size = 4", lambda t: _ids(t, "p_size = 3"), lambda t: _ids(t, "p_size = 4"))
_candidates(
    "smp11_emerging_candidates",
    "SELECT cid FROM mentions WHERE y <= 1996 GROUP BY cid HAVING min(y) >= 1996 AND count(*) >= 3", "SELECT p_partkey FROM part WHERE p_size < 20",
    lambda t: G.emerging(mentions(t), 1996, 1996, 3).select(F.col("cid").alias("id")), lambda t: _ids(t, "p_size < 20"),
)


@q("smp12_distance_candidates", f"WITH {EDGES}, {snapshot_sql('snap', PAST_DAY)}, {ways_sql('ways', 'snap')}, two AS (SELECT a.other AS u, b.other AS v FROM ways a JOIN ways b ON a.id = b.id AND a.other < b.other) SELECT DISTINCT u, v FROM two WHERE (u, v) NOT IN (SELECT (u, v) FROM snap)")
def _(t, s, d):
    snap = cut(G.snapshot(edges(t), PAST_DAY))
    return G.two_step_pairs(snap).select("u", "v").join(snap, ["u", "v"], "left_anti")


@q("smp13_sampled_candidates")
def _(t, s, d):
    snap = cut(G.snapshot(edges(t), PAST_DAY))
    sources, targets = S.allowed_nodes(_ids(t, "p_size = 3"), snap), S.allowed_nodes(_ids(t, "true"), snap)
    return S.sampled_candidates(sources, targets, snap, 5000, per_source=40, most_degree=60).select("u", "v")


@q("smp14_eligible_count", f"WITH {PAST_GRAPH}, {_DEGREES}, p AS (SELECT DISTINCT least(s.id, g.id) AS u, greatest(s.id, g.id) AS v FROM deg s, deg g WHERE s.id <> g.id AND s.id IN (SELECT p_partkey FROM part WHERE p_size = 3) AND g.degree <= 30) SELECT count(*) AS pairs FROM p WHERE (u, v) NOT IN (SELECT (u, v) FROM snap)")
def _(t, s, d):
    snap = cut(G.snapshot(edges(t), PAST_DAY))
    pairs = S.candidates_between(cut(S.allowed_nodes(_ids(t, "p_size = 3"), snap)), G.nodes_of(snap), snap, most_degree=30)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"))


@q("smp15_candidate_cache", f"WITH {EDGES}, {snapshot_sql('snap', PAST_DAY)} SELECT u, v FROM snap WHERE links >= 2")
def _(t, s, d):
    """Written under a hash of the parameters and read back, so other parameters never meet the same file."""
    from corpusloom.operators.extraction import settings_hash

    path = f"{scratch(s, 'cache')}/{settings_hash({'cutoff': PAST_DAY, 'min_links': 2})}"
    G.snapshot(edges(t), PAST_DAY).where("links >= 2").select("u", "v").write.parquet(path)
    return s.read.parquet(path)


@q("smp16_thinned_tiles", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 1000003 + 7919 + 42 * 104729) % 2147483647, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE n <= 30 OR r <= n // 5")
def _(t, s, d):
    from pyspark.sql import Window

    tile = Window.partitionBy("label").orderBy(S.pair_hash(F.col("vec_id"), F.lit(1)), "vec_id")
    rows = t("embeddings").select("label", "vec_id", F.row_number().over(tile).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("label")).alias("n"))
    return rows.where((F.col("n") <= 30) | (F.col("r") <= F.floor(F.col("n") / 5))).select("label", "vec_id")


# --- vectors of concepts, models


class _Places:
    """An encoder to show windows: the letters of a token, and its place in its window."""

    window = 50

    def tokens(self, text: str) -> list[str]:
        return [w for w in text.split(" ") if w]

    def encode_window(self, tokens: list[str]) -> np.ndarray:
        return np.array([[len(w), i] for i, w in enumerate(tokens)], np.float64)


@q("emb1_token_vectors", "WITH w AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS i FROM w) SELECT doc_id, CAST(i // 50 AS INTEGER) AS part, count(*) AS tokens, CAST(sum(length(token)) AS DOUBLE) AS letters, CAST(sum(i % 50) AS DOUBLE) AS places FROM p GROUP BY ALL")
def _(t, s, d):
    rows = N.token_vectors(t("documents"), "doc_id", "text", _Places())
    return rows.groupBy("doc_id", F.col("window").alias("part")).agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.get("vec", 0)).alias("letters"), F.sum(F.get("vec", 1)).alias("places"))


@q("txt25_close_phrases")
def _(t, s, d):
    """The ten words of a text whose vectors are closest to it, by hashed trigrams where no trained encoder is at hand."""
    return N.close_phrases(t("documents"), "doc_id", "text", N.TrigramEncoder())


@q("emb2_pending_embeddings", f"WITH {MENTIONS} SELECT DISTINCT work_id FROM mentions WHERE work_id NOT IN (SELECT vec_id FROM embeddings)")
def _(t, s, d):
    return mentions(t).select("work_id").distinct().join(t("embeddings").select(F.col("vec_id").alias("work_id")), "work_id", "left_anti")


@q("emb3_concept_vectors_at_cutoff", f"WITH {_VECTORS}, a AS (SELECT cid, count(*) AS n, avg(e[1]) AS x, avg(e[2]) AS y FROM wv WHERE day < {PAST_DAY} GROUP BY cid) SELECT cid, n, round(sqrt(x * x + y * y), 5) AS plane_norm FROM a")
def _(t, s, d):
    means = E.vector_means(_work_vectors(t).where(F.col("day") < PAST_DAY), "cid", "embedding", 64)
    return means.select("cid", "n", F.round(V.norm(F.slice("vec", 1, 2)), 5).alias("plane_norm"))


@q("emb4_neighbour_report", "WITH d AS (SELECT a.vec_id AS q, b.vec_id AS o, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, o) AS r FROM d) SELECT q AS query, array_to_string(list(CAST(o AS VARCHAR) ORDER BY r), ',') AS neighbours FROM r WHERE r <= 5 GROUP BY q")
def _(t, s, d):
    rows = t("embeddings")
    found = E.nearest(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 5)
    return found.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"].cast("string")), ",").alias("neighbours"))


def _inputs(t):
    snap = cut(G.snapshot(edges(t), PAST_DAY))
    nodes = G.degrees(snap).select("id", (F.col("degree") / 100).alias("degree"), (F.col("weighted") / 100).alias("weighted"))
    return E.pair_inputs(snap.select("u", "v", (F.col("links") > 1).cast("int").alias("label")), nodes, ["degree", "weighted"])


_SETTINGS = N.Settings(batches=120, batch_rows=256, rate_step=60, check_every=20)


def _features(t, past: int, future: int):
    """Pairs (u, v, label) that are first linked before ``future`` and twice as many others, and what adds their inputs: topological features at ``past``."""
    every = edges(t)  # made again for each use: kept, they would be many times the tables
    days = {1: past - 366, 2: past}
    pairs = stored(S.labelled_pairs(every, past, future, negatives=2.0), "u", "v")
    graph = H.hold_graph(G.first_days(every, past), days)
    if graph is None:
        properties = cut(G.pair_properties(every, pairs, days))
        names = [c for c in properties.columns if c not in ("u", "v")]
        return pairs, lambda some: some.join(properties, ["u", "v"]).select(*some.columns, F.array(*names).alias("inputs"))
    most = G.held_properties(pairs, graph)[1]
    return pairs, lambda some: G.held_properties(some, graph, most=most)[0].select(*some.columns, F.array(*most).alias("inputs"))


def _fitted(t):
    """(network, history of its fit, pairs with their split, what adds the inputs of pairs)."""
    pairs, inputs_of = _features(t, PAST_DAY, FUTURE_DAY)
    rows = S.split_pairs(pairs)
    train, check = rows.where("split = 'train'"), rows.where("split = 'val'")
    network, history = N.fit_pair_network(train, check, _SETTINGS, inputs_of=inputs_of)
    return network, history, rows, inputs_of


_SMALL_NETWORK = [
    {"weight": np.array([[0.5, -0.25, 0.125, 1.0], [-1.0, 0.75, 0.5, -0.5]]), "bias": np.array([0.1, -0.2]), "mean": np.array([0.3, 0.1]), "var": np.array([0.9, 1.2]), "scale": np.array([1.5, 0.8]), "shift": np.array([0.05, 0.4])},
    {"weight": np.array([[0.7, -1.3]]), "bias": np.array([0.25]), "mean": np.array([0.2]), "var": np.array([1.1]), "scale": np.array([0.9]), "shift": np.array([-0.1])},
]


def _network_sql() -> str:
    """The small network written out: linear, batch norm and ReLU, twice, and a sigmoid."""
    names = ["a.degree", "a.weighted", "b.degree", "b.weighted"]
    for i, w in enumerate(_SMALL_NETWORK):
        fresh = []
        for k in range(len(w["bias"])):
            linear = " + ".join(f"{x} * {n}" for x, n in zip(w["weight"][k], names)) + f" + {w['bias'][k]}"
            unit = f"(({linear} - {w['mean'][k]}) / sqrt({w['var'][k]} + 1e-5) * {w['scale'][k]} + {w['shift'][k]})"
            fresh.append(unit if i else f"greatest({unit}, 0)")
        names = fresh
    return f"1 / (1 + exp(-{names[0]}))"


@q("mod1_network_scores", f"WITH {PAST_GRAPH}, n AS (SELECT id, count(*) / 100.0 AS degree, sum(links) / 100.0 AS weighted FROM ways GROUP BY id), t AS (SELECT id, CAST(degree AS DOUBLE) AS degree, CAST(weighted AS DOUBLE) AS weighted FROM n) SELECT u, v, round({_network_sql()}, 6) AS score FROM snap JOIN t a ON a.id = u JOIN t b ON b.id = v")
def _(t, s, d):
    """A network with fixed weights over the degrees of both ends."""
    return N.score_pairs(_inputs(t), N.PairNetwork(_SMALL_NETWORK)).select("u", "v", F.round("score", 6).alias("score"))


@q("mod2_trained_network")
def _(t, s, d):
    """Scores of the held-out pairs by the network that is fitted on the others."""
    network, _, rows, inputs_of = _fitted(t)
    return N.score_pairs(inputs_of(rows.where("split = 'val'")), network).select("u", "v", "label", F.round("score", 4).alias("score"))


@q("mod2_training_history")
def _(t, s, d):
    history = _fitted(t)[1]
    return s.createDataFrame([(h["step"], round(h["loss"], 6), round(h["auc"], 6)) for h in history], "step int, loss double, auc double")


@q("mod2_logistic_classifier")
def _(t, s, d):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    pairs = _inputs(t)
    model = E.fit_pair_classifier(pairs, iterations=20)
    return model.transform(pairs.withColumn("features", array_to_vector("inputs"))).select("u", "v", "label", F.round(F.get(vector_to_array("probability"), 1), 4).alias("score"))


_SAGE = [
    {"own": np.array([[0.5, -0.5], [0.25, 1.0], [-0.75, 0.5]]), "around": np.array([[1.0, 0.25], [-0.5, 0.75], [0.5, 0.5]]), "bias": np.array([0.1, -0.2, 0.05])},
    {"own": np.array([[0.75, -0.25, 0.5], [0.5, 0.5, -1.0]]), "around": np.array([[-0.5, 0.25, 0.75], [1.0, -0.75, 0.25]]), "bias": np.array([0.0, 0.15])},
]


def _sage_sql() -> str:
    parts, size, before = [], 2, "x0"
    for i, w in enumerate(_SAGE):
        mean = ", ".join(f"avg(x.v{k}) AS m{k}" for k in range(size))
        out = []
        for k in range(len(w["bias"])):
            total = " + ".join([f"{w['own'][k][j]} * x.v{j}" for j in range(size)] + [f"{w['around'][k][j]} * coalesce(n.m{j}, 0)" for j in range(size)]) + f" + {w['bias'][k]}"
            out.append(f"{'greatest(' + total + ', 0)' if i + 1 < len(_SAGE) else total} AS v{k}")
        parts += [f"n{i} AS (SELECT w.id, {mean} FROM ways w JOIN {before} x ON x.id = w.other GROUP BY w.id)", f"x{i + 1} AS (SELECT x.id, {', '.join(out)} FROM {before} x LEFT JOIN n{i} n ON n.id = x.id)"]
        before, size = f"x{i + 1}", len(w["bias"])
    return ", ".join(parts)


def _encoded(t):
    """(pairs of the past graph, vectors of its nodes)."""
    snap = cut(G.snapshot(edges(t), PAST_DAY))
    nodes = G.degrees(snap).select("id", F.array(F.col("degree") / 100, F.col("weighted") / 100).alias("vec"))
    return snap.select("u", "v"), N.sage_encode(nodes, snap, _SAGE)


@q("mod3_encoded_pairs", f"WITH {PAST_GRAPH}, x0 AS (SELECT id, count(*)::DOUBLE / 100 AS v0, sum(links)::DOUBLE / 100 AS v1 FROM ways GROUP BY id), {_sage_sql()} SELECT u, v, round(1 / (1 + exp(-(a.v0 * b.v0 + a.v1 * b.v1))), 6) AS score FROM snap JOIN x2 a ON a.id = u JOIN x2 b ON b.id = v")
def _(t, s, d):
    """Two graph layers with fixed weights over the whole neighbourhood, and the dot product of both ends."""
    pairs, encoded = _encoded(t)
    return N.decode_pairs(pairs, encoded).withColumn("score", F.round("score", 6))


@q("mod3_sampled_neighbours", f"WITH {PAST_GRAPH}, r AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY (id * 1000003 + other * 7919 + 42 * 104729) % 2147483647, other) AS r FROM ways) SELECT id, other FROM r WHERE r <= 10")
def _(t, s, d):
    return N.sampled_neighbours(G.snapshot(edges(t), PAST_DAY), 10)


@q("mod4_encoder_evaluation", f"WITH {PAST_GRAPH}, x0 AS (SELECT id, count(*)::DOUBLE / 100 AS v0, sum(links)::DOUBLE / 100 AS v1 FROM ways GROUP BY id), {_sage_sql()}, p AS (SELECT CAST(links > 1 AS INTEGER) AS label, round(1 / (1 + exp(-(a.v0 * b.v0 + a.v1 * b.v1))), 9) AS score FROM snap JOIN x2 a ON a.id = u JOIN x2 b ON b.id = v), g AS (SELECT score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM p GROUP BY score), o AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)), 4) AS auc FROM o")
def _(t, s, d):
    """AUC of the encoder's saved weights, read back from their state."""
    snap = cut(G.snapshot(edges(t), PAST_DAY))
    state = json.loads(json.dumps([{k: v.tolist() for k, v in w.items()} for w in _SAGE]))
    nodes = G.degrees(snap).select("id", F.array(F.col("degree") / 100, F.col("weighted") / 100).alias("vec"))
    encoded = N.sage_encode(nodes, snap, [{k: np.array(v) for k, v in w.items()} for w in state])
    scored_pairs = N.decode_pairs(snap.select("u", "v", (F.col("links") > 1).cast("int").alias("label")), encoded)
    return M.roc_auc(scored_pairs.select("label", F.round("score", 9).alias("score"))).select(F.round("auc", 4).alias("auc"))


@q("mod3_fitted_layers")
def _(t, s, d):
    """Graph layers fitted on pairs that are linked later, and the scores they give to the held-out ones over the whole graph."""
    every = cut(edges(t))
    rows = cut(S.split_pairs(S.labelled_pairs(every, PAST_DAY, FUTURE_DAY, negatives=1.0)))
    snap = cut(G.snapshot(every, PAST_DAY))
    nodes = cut(G.degrees(snap).select("id", F.array(F.col("degree") / 100, F.col("weighted") / 100).alias("vec")))
    layers = N.fit_graph_layers(rows.where("split = 'train'"), nodes, snap, steps=150)
    return N.decode_pairs(rows.where("split = 'val'").select("u", "v", "label"), N.sage_encode(nodes, snap, layers)).withColumn("score", F.round("score", 4))


@q("mod5_text_classifier")
def _(t, s, d):
    """Pairs of the past graph told apart by the words of their labels: held-out ones and their scores."""
    from pyspark.ml.functions import vector_to_array

    rows = S.split_pairs(S.labelled_pairs(cut(edges(t)), PAST_DAY, FUTURE_DAY, negatives=1.0))
    texts = cut(N.label_texts(rows, lookup(t)))
    model = N.fit_text_classifier(texts.where("split = 'train'"))
    return model.transform(texts.where("split = 'val'")).select("u", "v", "label", F.round(F.get(vector_to_array("probability"), 1), 4).alias("score"))


@q("hlp11_compacted_degrees", f"WITH {PAST_GRAPH}, d AS (SELECT id, count(*) AS degree FROM ways GROUP BY id) SELECT id, degree, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS place FROM d")
def _(t, s, d):
    """Degrees by id and by the place that a node has among those present."""
    snap = cut(G.snapshot(edges(t), PAST_DAY))
    return G.degrees(snap).select("id", "degree").join(G.compacted(snap), "id")


@q("hlp4_ready_lists", f"WITH {LABELS} SELECT l.pmid, lower(w.abstract) AS abstract, array_to_string(list_sort(list_distinct(list_transform(l.labels, lambda x: lower(x)))), '|') AS labels FROM labels l JOIN (SELECT pmid, min(abstract) AS abstract FROM surgery_pubmed_works GROUP BY pmid) w ON w.pmid = l.pmid")
def _(t, s, d):
    """Abstracts in lower case beside the set of their labels, as containment needs them."""
    abstracts = t("surgery_pubmed_works").groupBy("pmid").agg(F.lower(F.min("abstract")).alias("abstract"))
    lists = label_lists(t).select("pmid", F.array_join(F.array_sort(F.array_distinct(F.transform("labels", F.lower))), "|").alias("labels"))
    return lists.join(abstracts, "pmid").select("pmid", "abstract", "labels")


@q("hlp12_modes", "SELECT mode, CAST(n AS INTEGER) AS inputs FROM (VALUES ('baseline', 4), ('pure_vectors', 8), ('combined', 12)) v(mode, n)")
def _(t, s, d):
    """How many inputs a pair has in each mode: node features, vectors, or both."""
    snap = cut(G.snapshot(edges(t), PAST_DAY))
    nodes = G.degrees(snap).select("id", "degree", "weighted", F.array_repeat(F.lit(0.5), 4).alias("vec"))
    out = None
    for mode in N.MODES:
        features, vectors = N.mode_inputs(mode, ["degree", "weighted"], ["vec"])
        one = E.pair_inputs(snap.select("u", "v"), nodes, features, vectors).select(F.lit(mode).alias("mode"), F.size("inputs").alias("inputs")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


@q("mod3_message_means", f"WITH {PAST_GRAPH}, e2 AS (SELECT u AS id, v AS other FROM edges WHERE day < {PAST_DAY} UNION ALL SELECT v, u FROM edges WHERE day < {PAST_DAY}), f AS (SELECT id, CAST(count(*) AS DOUBLE) AS degree FROM ways GROUP BY id) SELECT e2.id, round(avg(f.degree), 6) AS degree FROM e2 JOIN f ON f.id = e2.other GROUP BY e2.id")
def _(t, s, d):
    every = cut(edges(t))
    features = G.degrees(G.snapshot(every, PAST_DAY)).select("id", F.col("degree").cast("double").alias("degree"))
    return G.message_mean(G.until(every, PAST_DAY), features, ["degree"]).select("id", F.round("degree", 6).alias("degree"))


@q("mod6_grid", """WITH g AS (SELECT l AS layers, r AS rate, sha256('{"layers": ' || l || ', "rate": ' || r || '}') AS mark FROM (VALUES (1), (2), (3)) a(l), (VALUES (0.1::DOUBLE), (0.01::DOUBLE)) b(r)) SELECT * FROM g WHERE layers <> 2""")
def _(t, s, d):
    """All combinations of settings with their marks, without those whose mark is among the finished runs."""
    schema = "layers int, rate double, mark string"
    every = [(g["layers"], g["rate"], X.settings_hash(g)) for g in E.grid({"layers": [1, 2, 3], "rate": [0.1, 0.01]})]
    finished = s.createDataFrame([g for g in every if g[0] == 2], schema)
    return X.pending(s.createDataFrame(every, schema), finished, "mark").select("layers", "rate", "mark")


_TOP = f"""WITH {PAST_GRAPH}, {_DEGREES}, {LOOKUP}, src AS (SELECT min(id) AS id FROM ways), own AS (SELECT degree AS d FROM deg, src WHERE deg.id = src.id), most AS (SELECT max(degree)::DOUBLE AS m FROM deg),
c AS (SELECT b.other AS v, count(*) AS common FROM ways a, src, ways b WHERE a.id = src.id AND b.id = a.other GROUP BY 1),
f AS (SELECT deg.id AS v, deg.degree, coalesce(c.common, 0) AS common FROM deg LEFT JOIN c ON c.v = deg.id WHERE deg.id NOT IN (SELECT other FROM ways, src WHERE ways.id = src.id) AND deg.id NOT IN (SELECT id FROM src)),
p AS (SELECT v, degree, common, round(0.6 * (common::DOUBLE / (own.d + degree - common)) + 0.4 * (degree / most.m), 9) AS score FROM f, own, most)
SELECT CAST(row_number() OVER (ORDER BY score DESC, v) AS BIGINT) AS rank, lookup.concept, common, degree, round(score, 6) AS score FROM p JOIN lookup ON lookup.id = v ORDER BY rank LIMIT 15"""


@q("mod7_predictor", _TOP)
def _(t, s, d):
    """One concept with all that it is not linked to: the mixture 0.6 / 0.4 of Jaccard and scaled degree, the 15 best."""
    from pyspark.sql import Window

    snap = cut(G.snapshot(edges(t), PAST_DAY))
    ways, degree = cut(G.both_ways(snap).select("id", "other")), cut(G.degrees(snap).select("id", "degree"))
    source, most = degree.orderBy("id").first(), degree.agg(F.max("degree")).first()[0]
    if source is None:
        return degree.select(F.lit(0).cast("bigint").alias("rank"), F.lit("").alias("concept"), F.lit(0).cast("bigint").alias("common"), "degree", F.lit(0.0).alias("score")).limit(0)
    linked = cut(ways.where(F.col("id") == source["id"]).select(F.col("other").alias("id")))
    common = linked.join(ways, "id").groupBy(F.col("other").alias("id")).agg(F.count(F.lit(1)).alias("common"))
    free = degree.where(F.col("id") != source["id"]).join(linked, "id", "left_anti").join(common, "id", "left").withColumn("common", F.coalesce("common", F.lit(0)))
    jaccard = F.col("common") / (F.lit(source["degree"]) + F.col("degree") - F.col("common"))
    top = free.withColumn("score", F.round(0.6 * jaccard + 0.4 * (F.col("degree") / F.lit(float(most))), 9)).orderBy(F.desc("score"), "id").limit(15)
    named = top.join(lookup(t), "id")
    return named.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("bigint").alias("rank"), "concept", "common", "degree", F.round("score", 6).alias("score"))  # 15 rows


def top_unlinked_pairs(t, day: int, k: int):
    """The k pairs with most common neighbours that are not linked, with labels, degrees and distance."""
    from pyspark.sql import Window

    snap = cut(G.snapshot(edges(t), day))
    open_pairs = G.two_step_pairs(snap).join(snap.select("u", "v"), ["u", "v"], "left_anti")
    top = cut(open_pairs.orderBy(F.desc("common"), "u", "v").limit(k))
    out, degree, labels = top, G.degrees(snap).select("id", "degree"), lookup(t)
    for end, side in (("u", "a"), ("v", "b")):
        out = out.join(degree.select(F.col("id").alias(end), F.col("degree").alias(f"degree_{side}")), end).join(labels.select(F.col("id").alias(end), F.col("concept").alias(f"concept_{side}")), end, "left")
        out = out.withColumn(f"concept_{side}", F.coalesce(f"concept_{side}", F.lit("<unknown>")))
    rank = F.row_number().over(Window.orderBy(F.desc("common"), "u", "v")).cast("bigint")  # k rows
    return G.pair_distances(snap, out, most=2).select(rank.alias("rank"), "u", "v", "concept_a", "concept_b", "degree_a", "degree_b", F.col("distance").alias("graph_distance"), F.col("common").alias("score"))


@q("mod8_prospective_pairs", f"""WITH {EDGES}, {snapshot_sql('snap', PAST_DAY)}, {ways_sql('ways', 'snap')}, {_DEGREES}, {LOOKUP}, c AS (SELECT a.other AS u, b.other AS v, count(*) AS common FROM ways a JOIN ways b ON a.id = b.id AND a.other < b.other GROUP BY 1, 2),
top AS (SELECT u, v, common FROM c WHERE (u, v) NOT IN (SELECT (u, v) FROM snap) ORDER BY common DESC, u, v LIMIT 50)
SELECT row_number() OVER (ORDER BY common DESC, u, v) AS rank, u, v, x.concept AS concept_a, y.concept AS concept_b, a.degree AS degree_a, b.degree AS degree_b, 2 AS graph_distance, common AS score FROM top JOIN deg a ON a.id = u JOIN deg b ON b.id = v JOIN lookup x ON x.id = u JOIN lookup y ON y.id = v""")
def _(t, s, d):
    return top_unlinked_pairs(t, PAST_DAY, 50)


_emerging = lambda t: G.emerging(mentions(t), 1996, 1996, 3).select(F.col("cid").alias("id"))
_MODES = {
    "random": lambda t, snap: cut(S.unlinked_pairs(G.nodes_of(snap), [snap], 4000)),
    "anchor": lambda t, snap: S.candidates_between(cut(S.allowed_nodes(_ids(t, "p_size = 7"), snap)), cut(G.nodes_of(snap)), snap),
    "module_cross": lambda t, snap: S.candidates_between(cut(S.allowed_nodes(_ids(t, "p_size = 3"), snap)), cut(S.allowed_nodes(_ids(t, "p_size = 4"), snap)), snap),
    "emerging": lambda t, snap: S.candidates_between(cut(S.allowed_nodes(_emerging(t), snap)), cut(G.nodes_of(snap)), snap),
    "distance": lambda t, snap: stored(G.two_step_pairs(snap).select("u", "v").join(snap, ["u", "v"], "left_anti"), "u", "v"),
}


def _blended(pairs, graph, network, vectors, most=None):
    """(``pairs`` with the network's score and the graph layers' blended, by what each column was divided)."""
    properties, most = G.held_properties(pairs, graph, vectors, most)
    inputs = properties.where("decoded IS NOT NULL").select("u", "v", F.col("decoded").alias("score"), F.array(*most).alias("inputs"))
    scores = N.score_pairs(inputs, network, out="first")
    return scores.select("u", "v", F.round(0.8 * F.col("first") + 0.2 * F.col("score"), 6).alias("score")), most


def _best_of_product(sources, graph, network, vectors, k):
    """The ``k`` best of all unlinked pairs of a source and a node, as if all were listed and scored."""
    spark, order = sources.sparkSession, (F.desc("score"), "u", "v")
    named = B.held_sources(sources, graph)
    near = B.near_pairs(graph, named, spark)
    most = G.held_properties(near, graph)[1] | B.largest_of_ends(graph, named, spark)  # common neighbours are 0 elsewhere
    top = cut(_blended(near, graph, network, vectors, most)[0].orderBy(*order).limit(k))
    rows = top.orderBy(*order).collect()  # k rows
    floor = (rows[-1]["score"], rows[-1]["u"]) if len(rows) == k else (-1.0, 0)
    far = B.far_pairs(graph, named, spark, network, vectors, most, k, (0.8, 0.2), floor)
    return top.unionByName(_blended(far, graph, network, vectors, most)[0]).orderBy(*order).limit(k)


def _prospective(mode: str) -> None:
    @q(f"mod8_scored_{mode}")
    def _(t, s, d):
        """Candidates of one mode with the fitted network's score, blended with the graph layers' score, the 50 best with labels and distance."""
        from pyspark.sql import Window

        network = _fitted(t)[0]
        every = edges(t)
        counted = stored(G.first_days(every, FUTURE_DAY), "u", "v")
        snap = counted.select("u", "v", "links")
        days = {1: FUTURE_DAY - 366, 2: FUTURE_DAY}
        graph = H.hold_graph(counted, days, weighted=True)
        if graph is None or mode != "emerging":
            candidates = _MODES[mode](t, snap)
        if graph is None:
            properties = G.pair_properties(every, candidates, days)
            names = [c for c in properties.columns if c not in ("u", "v")]
            nodes = G.degrees(snap).select("id", F.array(F.col("degree") / 100, F.col("weighted") / 100).alias("vec"))
            first = N.score_pairs(properties.select("u", "v", F.array(*names).alias("inputs")), network, out="first").drop("inputs")
            both = N.decode_pairs(first, N.sage_encode(nodes, snap, _SAGE))
            blend = both.select("u", "v", F.round(0.8 * F.col("first") + 0.2 * F.col("score"), 6).alias("score"))
        elif mode == "emerging":
            blend = _best_of_product(_emerging(t), graph, network, H.encode(s, graph, _SAGE), 50)
        else:
            blend = _blended(candidates, graph, network, H.encode(s, graph, _SAGE))[0]
        top = cut(blend.orderBy(F.desc("score"), "u", "v").limit(50))
        far = G.pair_distances(snap, top, most=4) if graph is None else top.join(H.with_distances(top, graph, most=4), ["u", "v"])
        named = N.label_texts(far, lookup(t))
        return named.select(F.row_number().over(Window.orderBy(F.desc("score"), "u", "v")).alias("rank"), "u", "v", "text", F.col("distance").alias("graph_distance"), "score")  # 50 rows


for _mode in _MODES:
    _prospective(_mode)


# --- metrics

_S = f"WITH {SCORED}"
_G = "g AS (SELECT score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM scored GROUP BY score)"
_AUC = "SELECT sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)"


@q("met1_roc_auc", f"{_S}, {_G} SELECT round(auc, 9) AS auc FROM ({_AUC})")
def _(t, s, d):
    return M.roc_auc(scored(t)).select(F.round("auc", 9).alias("auc"))


def _confusion_sql(thresholds: list[float], strict: str) -> str:
    rows = ", ".join(f"({x})" for x in thresholds)
    counts = f"SELECT CAST(th AS DOUBLE) AS threshold, count(*) FILTER (NOT score {strict} th AND label = 0) AS tn, count(*) FILTER (score {strict} th AND label = 0) AS fp, count(*) FILTER (NOT score {strict} th AND label = 1) AS fn, count(*) FILTER (score {strict} th AND label = 1) AS tp FROM scored, (VALUES {rows}) x(th) GROUP BY th"
    return f"{_S}, c AS ({counts}), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM c) SELECT threshold, tn, fp, fn, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1 FROM r"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@q("met2_confusion", _confusion_sql([0.5], ">"))
def _(t, s, d):
    return _rounded(M.confusion(scored(t), [0.5]))


_SWEEP = [round(0.5 + 0.05 * i, 2) for i in range(10)]


@q("met3_threshold_sweep", _confusion_sql(_SWEEP, ">"))
def _(t, s, d):
    return _rounded(M.confusion(scored(t), _SWEEP))


@q("agg19_confusion_inclusive", _confusion_sql([0.5], ">="))
def _(t, s, d):
    return _rounded(M.confusion(scored(t), [0.5], strict=False))


@q("met4_blend_search", f"{_S}, b AS (SELECT w / 10.0::DOUBLE AS weight, label, round(w / 10.0::DOUBLE * score + (1 - w / 10.0::DOUBLE) * score2, 9) AS score FROM scored, range(11) r(w)), g AS (SELECT weight, score, sum(label) AS pos, sum(1 - label) AS neg FROM b GROUP BY 1, 2), k AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY weight ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT weight, round(sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc FROM k GROUP BY weight")
def _(t, s, d):
    return M.blend_search(scored(t), "score", "score2").withColumn("auc", F.round("auc", 6))


_RUN = f"{_S}, {_G}, r AS (SELECT score, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@q("met5_roc_curve", f"{_RUN} SELECT score, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM r")
def _(t, s, d):
    return M.roc_points(scored(t)).select("score", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@q("met6_precision_recall", f"{_RUN} SELECT score, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM r")
def _(t, s, d):
    return M.precision_recall(scored(t)).select("score", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@q("met6_average_precision", f"{_RUN} SELECT round(sum(pos / p * (tp / (tp + fp))), 9) AS average_precision, round((SELECT avg(label) FROM scored), 9) AS prevalence FROM r")
def _(t, s, d):
    return M.average_precision(scored(t)).select(F.round("average_precision", 9).alias("average_precision"), F.round("prevalence", 9).alias("prevalence"))


_KS = [10, 100, 1000, 100000]
_KV = ", ".join(f"({k})" for k in _KS)
_RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, idx) AS r, count(*) OVER () AS n FROM scored)"


@q("met7_at_k", f"{_S}, {_RANKED} SELECT k, CAST(coalesce(sum(label) FILTER (r <= k), 0) AS BIGINT) AS tp, round(coalesce(sum(label) FILTER (r <= k), 0) / least(k, max(n)), 6) AS precision_at_k, round(coalesce(sum(label) FILTER (r <= k), 0) / sum(label), 6) AS recall_at_k FROM ranked, (VALUES {_KV}) v(k) GROUP BY k")
def _(t, s, d):
    return M.at_k(scored(t), _KS, [F.desc("score"), F.col("idx")]).withColumns({c: F.round(c, 6) for c in ("precision_at_k", "recall_at_k")})


@q("met8_at_k_by_year", f"{_S}, {_RANKED}, h AS (SELECT k, yr, count(*) AS tp FROM ranked, (VALUES {_KV}) v(k) WHERE label = 1 AND r <= k GROUP BY 1, 2), w AS (SELECT yr, sum(label) AS p FROM scored GROUP BY yr) SELECT k, yr, tp, round(tp / p, 6) AS recall_at_k, round(tp / sum(tp) OVER (PARTITION BY k), 6) AS share_at_k FROM h JOIN w USING (yr)")
def _(t, s, d):
    return M.at_k(scored(t), _KS, [F.desc("score"), F.col("idx")], ["yr"]).withColumns({c: F.round(c, 6) for c in ("recall_at_k", "share_at_k")})


@q("met9_calibration", f"{_S}, e AS (SELECT {', '.join(f'quantile_cont(score, {i / 10}) AS e{i}' for i in range(1, 10))} FROM scored), b AS (SELECT {' + '.join(f'CAST(e{i} < score AS INTEGER)' for i in range(1, 10))} AS bin, score, label FROM scored, e) SELECT bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS mean_label FROM b GROUP BY bin")
def _(t, s, d):
    return M.calibration(scored(t)).withColumns({c: F.round(c, 6) for c in ("mean_score", "mean_label")})


@q("met9_brier", f"{_S} SELECT round(avg((label - score) * (label - score)), 9) AS brier FROM scored")
def _(t, s, d):
    return M.brier(scored(t)).select(F.round("brier", 9).alias("brier"))


@q("met10_hit_at_k", f"{_S}, r AS (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY score DESC, idx) AS r FROM scored), p AS (SELECT count(DISTINCT src) AS sources FROM scored WHERE label = 1) SELECT k, max(sources) AS sources, count(DISTINCT src) FILTER (label = 1 AND r <= k) AS hits, round(count(DISTINCT src) FILTER (label = 1 AND r <= k) / max(sources), 6) AS hit_rate FROM r, p, (VALUES (1), (3), (10)) v(k) GROUP BY k")
def _(t, s, d):
    return M.hit_at_k(scored(t), "src", [1, 3, 10], [F.desc("score"), F.col("idx")]).withColumn("hit_rate", F.round("hit_rate", 6))


@q("met11_accuracy", f"{_S} SELECT round(avg(CAST((score2 > score) = (label = 1) AS INTEGER)), 9) AS accuracy FROM scored")
def _(t, s, d):
    return scored(t).agg(F.round(F.avg(((F.col("score2") > F.col("score")) == (F.col("label") == 1)).cast("int")), 9).alias("accuracy"))


# --- helpers with a result of their own


@q("hlp3_joined_lists", f"WITH {LOOKUP} SELECT id, replace(concept, ' ', ',') AS joined FROM lookup")
def _(t, s, d):
    return lookup(t).select("id", F.array_join(F.split("concept", " ", -1), ",").alias("joined"))


@q("hlp8_display_text", r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS shown FROM documents")
def _(t, s, d):
    return t("documents").select("doc_id", T.normalized_space(F.coalesce("text", F.lit(""))).alias("shown"))


@q("hlp15_layer_sizes", "SELECT layers, CASE layers WHEN 1 THEN '20,10,1' ELSE '20,10,5,1' END AS sizes FROM (VALUES (1), (2)) v(layers)")
def _(t, s, d):
    return s.createDataFrame([(n, ",".join(map(str, E.geometric_sizes(20, 0.5, n)))) for n in (1, 2)], "layers int, sizes string")


@q("hlp16_pair_labels", f"WITH {EDGES}, {LOOKUP} SELECT e.work_id, e.u, e.v, a.concept || ' ; ' || b.concept AS text FROM edges e JOIN lookup a ON a.id = e.u JOIN lookup b ON b.id = e.v")
def _(t, s, d):
    return _pair_labels(t, edges(t))


def _pair_labels(t, pairs):
    labels = small_side(lookup(t))
    out = pairs.join(labels.select(F.col("id").alias("u"), F.col("concept").alias("a")), "u").join(labels.select(F.col("id").alias("v"), F.col("concept").alias("b")), "v")
    return out.select("work_id", "u", "v", F.concat_ws(" ; ", "a", "b").alias("text"))


@q("hlp17_ids_with_vectors", "SELECT DISTINCT vec_id AS id FROM embeddings WHERE embedding IS NOT NULL")
def _(t, s, d):
    return t("embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("id")).distinct()


@q("hlp18_unknown_labels", "SELECT label FROM (VALUES ('abduction splint'), ('no such concept')) v(label) WHERE label NOT IN (SELECT concept FROM lookup_m)")
def _(t, s, d):
    from corpusloom.sources.readers import listed_labels

    return listed_labels(s, given="abduction splint; no such concept").join(t("lookup_m").select(F.col("concept").alias("label")), "label", "left_anti")


@q("hlp21_one_author", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def _(t, s, d):
    author = t("orders").agg(F.min("o_custkey").alias("o_custkey"))
    return t("orders").join(F.broadcast(author), "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@q("hlp22_restored_case", "SELECT s_suppkey, s_name AS written FROM supplier")
def _(t, s, d):
    lowered = t("supplier").select("s_suppkey", F.lower("s_name").alias("label"))
    return lowered.join(t("supplier").select("s_suppkey", F.lower("s_name").alias("label"), F.col("s_name").alias("written")), ["s_suppkey", "label"]).select("s_suppkey", "written")


# --- streams


@q("str1_incremental_append", "SELECT DISTINCT pmid FROM surgery_pubmed_works")
def _(t, s, d):
    stream = stream_table(s, d, "surgery_pubmed_works", t("surgery_pubmed_works").schema).select("pmid", "fetched_at")
    target = scratch(s, "appended")
    append_new(stream, "pmid", target, scratch(s, "progress"))
    return s.read.parquet(target).select("pmid")


@q("str2_resumed_progress", "SELECT count(DISTINCT event_id) AS events FROM events")
def _(t, s, d):
    target, progress = scratch(s, "appended"), scratch(s, "progress")
    for _ in range(2):  # the second run finds nothing new
        append_new(stream_table(s, d, "events", t("events").schema).select("event_id", "ts"), "event_id", target, progress)
    return s.read.parquet(target).agg(F.count(F.lit(1)).alias("events"))


class _Touchy:
    """A client that fails for a batch with a record of its kind in it, unless that is alone."""

    def complete(self, records: list[dict]) -> str:
        if len(records) > 1 and any(int(r["pmid"]) % 97 == 0 for r in records):
            raise TimeoutError("slow")
        return json.dumps({"items": [{"pmid": r["pmid"], "concepts": [f"text of {r['pmid']}"]} for r in records]})


@q("str3_watched_until_filled", "SELECT doc_id, '[\"text of ' || doc_id || '\"]' AS concepts FROM documents")
def _(t, s, d):
    works = t("documents").select("doc_id", F.lit(None).cast("string").alias("concepts"))
    return X.watch(works, "doc_id", "concepts", _Touchy(), size=64, path=scratch(s, "watched"))[0]


@q("mod9_extracted_labels", "SELECT CAST(doc_id AS VARCHAR) AS pmid, 'text of ' || doc_id AS labels FROM documents WHERE doc_id % 97 <> 0 AND doc_id // 8 NOT IN (SELECT doc_id // 8 FROM documents WHERE doc_id % 97 = 0)")
def _(t, s, d):
    """Labels from an outside model in batches by id, with the check of its replies; batches that fail are left out here."""
    batches = t("documents").select(F.floor(F.col("doc_id") / 8).alias("batch"), F.col("doc_id").cast("string").alias("pmid")).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pmid"))).alias("items"))  # eight at most
    replies = X.run_extraction(batches, _Touchy()).join(batches, "batch")
    usable = replies.where(reply_reason(F.col("reply"), F.transform("items", lambda i: i["pmid"])).isNull())
    return reply_items(usable, "reply").select("pmid", F.array_join("concepts", "/").alias("labels"))


@q("str4_new_token_vectors", "SELECT doc_id, sum(length(w)) AS letters FROM (SELECT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM documents) GROUP BY doc_id")
def _(t, s, d):
    """Vectors of the tokens of new texts only: the second run finds none."""
    target, progress = scratch(s, "vectors"), scratch(s, "progress")
    for _ in range(2):
        stream = stream_table(s, d, "documents", t("documents").schema).select("doc_id", "text")
        append_new(stream, "doc_id", target, progress, lambda df: N.token_vectors(df, "doc_id", "text", _Places()))
    return s.read.parquet(target).groupBy("doc_id").agg(F.sum(F.get("vec", 0)).cast("bigint").alias("letters"))


@q("str5_growing_snapshots", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t, s, d):
    target = scratch(s, "windows")
    counts = running_counts(stream_table(s, d, "events", t("events").schema), "ts", "event_type", "1 day", "3650 days")
    run_once(counts, scratch(s, "progress"), lambda df, n: df.write.mode("overwrite").parquet(target), mode="complete")
    return s.read.parquet(target)


@q("str_edges_of_stream", "WITH m AS (SELECT event_id AS work_id, user_id % 7 AS a, CAST(floor(value) AS BIGINT) % 5 + 10 AS b FROM events) SELECT work_id, a AS u, b AS v FROM m")
def _(t, s, d):
    stream = stream_table(s, d, "events", t("events").schema)
    works = stream.select(F.col("event_id").alias("work_id"), "ts", F.array(F.col("user_id") % 7, F.floor("value") % 5 + 10).alias("cids"))
    target = scratch(s, "edges")
    run_once(streamed_edges(works, "ts", "3650 days"), scratch(s, "progress"), lambda df, n: df.write.mode("overwrite").parquet(f"{target}/batch_no={n}"))
    return s.read.parquet(target).select("work_id", "u", "v")
