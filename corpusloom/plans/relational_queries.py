"""Queries of joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.dates import five_year_period
from corpusloom.functions.predicates import FALSE_FORMULAS
from corpusloom.operators.embeddings import nearest, two_level_means, vector_means
from corpusloom.operators.extraction import batches_in_order, fill_blanks, pending, resumed
from corpusloom.operators.graph import both_ways, cumulative_edges, degrees, emerging, event_years, new_pairs, nodes_of, snapshot, two_hop, two_step_pairs
from corpusloom.operators.metrics import lorenz
from corpusloom.operators.ordering import exact_quantiles, numbered_parts, top_per_group, with_row_number, with_running_sums
from corpusloom.session import broadcast_if_small, cut
from corpusloom.sources.articles import modules_of_ids
from corpusloom.sources.readers import require_unique

from .filter_queries import _DEGREES, _PARTS
from .registry import Registry
from .views import EDGES, FUTURE_DAY, LABELS, LOOKUP, MENTIONS, PAST_DAY, PAST_GRAPH, SCORED, edges, label_lists, lookup, mentions, scored, snapshot_sql

q = Registry()
SMALL = 200_000


def small_side(df):
    """A dimension table, sent to the tasks only if it has been counted to be small."""
    return broadcast_if_small(df, SMALL)


# --- joins


@q("joi1_one_to_one", "SELECT o_orderkey, o_totalprice, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def _(t, s, d):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return require_unique(t("orders"), "o_orderkey").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey")


@q("joi2_label_to_id", f"WITH {LABELS}, e AS (SELECT pmid, unnest(labels) AS label FROM labels) SELECT DISTINCT pmid, id FROM e JOIN lookup_m ON lower(trim(label)) = concept")
def _(t, s, d):
    named = label_lists(t).select("pmid", F.explode("labels").alias("label")).select("pmid", F.lower(F.trim("label")).alias("concept"))
    return named.join(small_side(t("lookup_m").select("id", "concept")), "concept").select("pmid", "id").distinct()


@q("joi2_unresolved_labels", f"WITH {LABELS}, e AS (SELECT DISTINCT lower(trim(unnest(labels))) AS label FROM labels) SELECT label FROM e WHERE label NOT IN (SELECT concept FROM lookup_m)")
def _(t, s, d):
    named = label_lists(t).select(F.explode("labels").alias("label")).select(F.lower(F.trim("label")).alias("label")).distinct()
    return named.join(small_side(t("lookup_m").select(F.col("concept").alias("label"))), "label", "left_anti")


@q("joi3_id_to_label", "SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 > 0 THEN r_name END, '<unknown>') AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t, s, d):
    nations = t("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 > 0, F.col("n_regionkey")).alias("r_regionkey"))
    return nations.join(small_side(t("region")), "r_regionkey", "left").select("n_nationkey", F.coalesce("r_name", F.lit("<unknown>")).alias("region"))


@q("joi4_cooccurrence_edges", f"WITH {EDGES} SELECT work_id, u, v, day FROM edges")
def _(t, s, d):
    return edges(t).select("work_id", "u", "v", "day")


@q("joi5_listed_concepts", f"WITH {MENTIONS}, {LOOKUP} SELECT work_id, array_to_string(list_sort(list(concept)), ',') AS concepts FROM mentions JOIN lookup ON cid = id JOIN part ON p_partkey = cid WHERE p_size > 25 GROUP BY work_id")
def _(t, s, d):
    listed = lookup(t).join(t("part").where("p_size > 25").select(F.col("p_partkey").alias("id")), "id", "left_semi")
    return mentions(t).join(listed.withColumnRenamed("id", "cid"), "cid").groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("concepts"))


@q("joi6_pending_rows", "SELECT pmid FROM surgery_pubmed_works WHERE pmid NOT IN (SELECT pmid FROM surgery_pubmed_works WHERE is_retracted) GROUP BY pmid")
def _(t, s, d):
    works = t("surgery_pubmed_works").select("pmid", "is_retracted")
    return pending(works.select("pmid").distinct(), works.where("is_retracted").distinct(), "pmid")


_HALF = "w AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[\"old\"]' WHEN doc_id % 3 = 1 THEN '' END AS c FROM documents), f AS (SELECT doc_id, '[\"new\"]' AS c FROM documents WHERE doc_id % 2 = 0)"


def _halves(t):
    works = t("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, '["old"]').when(F.col("doc_id") % 3 == 1, "").alias("c"))
    return works, t("documents").where("doc_id % 2 = 0").select("doc_id", F.lit('["new"]').alias("c"))


@q("joi7_resumed_values", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[\"old\"]' END AS c FROM documents")
def _(t, s, d):
    works, _ = _halves(t)
    return resumed(works.select("doc_id"), works, "doc_id", "c").select("doc_id", "c")


@q("joi8_fill_blanks", f"WITH {_HALF} SELECT CASE WHEN coalesce(w.c, '') <> '' THEN 'preserved' WHEN f.c IS NOT NULL THEN 'filled' ELSE 'missing' END AS outcome, count(*) AS n FROM w LEFT JOIN f ON w.doc_id = f.doc_id GROUP BY ALL")
def _(t, s, d):
    works, fresh = _halves(t)
    return fill_blanks(works, fresh, "doc_id", "c").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@q("joi9_modules_of_ids", f"WITH m AS (SELECT pmid, unnest({_PARTS}) AS module, unnest(range(len({_PARTS}))) AS seq FROM surgery_pubmed_works) SELECT pmid, array_to_string(list(module ORDER BY seq, module), ',') AS modules FROM (SELECT pmid, module, min(seq) AS seq FROM m GROUP BY ALL) GROUP BY pmid")
def _(t, s, d):
    found = t("surgery_pubmed_works").select("pmid", F.posexplode(T.split_list(F.col("modules"))).alias("seq", "module"))
    return modules_of_ids(found).select("pmid", F.array_join("modules", ",").alias("modules"))


@q("joi10_pair_features", f"WITH {PAST_GRAPH}, {_DEGREES} SELECT snap.u, snap.v, a.degree AS degree_u, b.degree AS degree_v FROM snap JOIN deg a ON a.id = snap.u JOIN deg b ON b.id = snap.v")
def _(t, s, d):
    snap = cut(snapshot(edges(t), PAST_DAY))
    degree = degrees(snap).select("id", "degree")
    out = snap.select("u", "v")
    for end in ("u", "v"):
        out = out.join(degree.select(F.col("id").alias(end), F.col("degree").alias(f"degree_{end}")), end)
    return out.select("u", "v", "degree_u", "degree_v")


_VECTORS = f"{MENTIONS}, nv AS (SELECT count(*) AS n FROM embeddings), wv AS (SELECT work_id, cid, day, embedding AS e FROM mentions, nv JOIN embeddings ON vec_id = (work_id * 31 + cid) % n)"


def _work_vectors(t):
    vectors = t("embeddings").select("vec_id", "embedding")
    n = vectors.count()
    return mentions(t).withColumn("vec_id", (F.col("work_id") * 31 + F.col("cid")) % n).join(small_side(vectors), "vec_id")


@q("joi11_averaged_vectors", f"WITH {_VECTORS} SELECT cid, count(*) AS n, round(avg(e[1]), 5) AS first_value, round(avg(e[64]), 5) AS last_value FROM wv WHERE day < {PAST_DAY} GROUP BY cid")
def _(t, s, d):
    means = vector_means(_work_vectors(t).where(F.col("day") < PAST_DAY), "cid", "embedding", 64)
    return means.select("cid", "n", F.round(F.get("vec", 0), 5).alias("first_value"), F.round(F.get("vec", 63), 5).alias("last_value"))


@q("joi12_source_target_candidates", f"WITH {PAST_GRAPH}, src AS (SELECT id FROM ways GROUP BY id ORDER BY count(*) DESC, id LIMIT 10), pairs AS (SELECT DISTINCT least(s.id, w.id) AS u, greatest(s.id, w.id) AS v FROM src s, (SELECT DISTINCT id FROM ways) w WHERE s.id <> w.id) SELECT u, v FROM pairs WHERE (u, v) NOT IN (SELECT (u, v) FROM snap)")
def _(t, s, d):
    from corpusloom.operators.sampling import candidates_between

    snap = cut(snapshot(edges(t), PAST_DAY))
    degree = degrees(snap)
    return candidates_between(degree.orderBy(F.desc("degree"), "id").limit(10), degree.select("id"), snap)


@q("joi13_one_source_unlinked", f"WITH {PAST_GRAPH}, src AS (SELECT min(id) AS id FROM ways) SELECT DISTINCT w.id AS other FROM ways w, src WHERE w.id <> src.id AND w.id NOT IN (SELECT other FROM ways, src WHERE ways.id = src.id)")
def _(t, s, d):
    ways = cut(both_ways(snapshot(edges(t), PAST_DAY)).select("id", "other"))
    source = ways.agg(F.min("id").alias("id"))
    linked = ways.join(F.broadcast(source), "id", "left_semi").select("other")
    return ways.select(F.col("id").alias("other")).distinct().join(linked, "other", "left_anti").join(F.broadcast(source.select(F.col("id").alias("other"))), "other", "left_anti")


@q("joi14_event_years", f"WITH {PAST_GRAPH}, ev AS (SELECT u, v, min(y) AS event_year FROM edges WHERE y > 1996 AND y <= 1998 GROUP BY u, v) SELECT snap.u, snap.v, coalesce(event_year, -1) AS event_year FROM snap LEFT JOIN ev USING (u, v)")
def _(t, s, d):
    every = edges(t)
    return event_years(every, snapshot(every, PAST_DAY).select("u", "v"), 1996, 1998)


@q("joi15_frequency_and_degree", f"WITH {PAST_GRAPH}, {_DEGREES}, f AS (SELECT cid AS id, count(*) AS n FROM mentions GROUP BY cid ORDER BY n DESC, id LIMIT 100) SELECT id, n, degree FROM f JOIN deg USING (id)")
def _(t, s, d):
    frequent = mentions(t).groupBy(F.col("cid").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(100)
    return degrees(snapshot(edges(t), PAST_DAY)).select("id", "degree").join(F.broadcast(frequent), "id").select("id", "n", "degree")


@q("joi16_vectors_of_new_lookup", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(t, s, d):
    return t("embeddings").select("vec_id", "label").join(small_side(t("part").where("p_size > 10").select(F.col("p_partkey").alias("vec_id"))), "vec_id", "left_semi")


@q("joi17_count_mismatch", "WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, count(DISTINCT l_partkey) AS m FROM lineitem GROUP BY 1) SELECT n - m AS difference, count(*) AS works FROM a JOIN b USING (k) GROUP BY 1")
def _(t, s, d):
    per_work = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("m"))
    return per_work.groupBy((F.col("n") - F.col("m")).alias("difference")).agg(F.count(F.lit(1)).alias("works"))


@q("joi18_two_step_pairs", f"WITH {EDGES}, {snapshot_sql('snap', PAST_DAY)}, ways AS (SELECT u AS id, v AS other FROM snap UNION ALL SELECT v, u FROM snap) SELECT a.other AS u, b.other AS v, count(*) AS common FROM ways a JOIN ways b ON a.id = b.id AND a.other < b.other GROUP BY 1, 2")
def _(t, s, d):
    return two_step_pairs(snapshot(edges(t), PAST_DAY))


# --- aggregates


@q("agg1_concept_counts", "SELECT l_partkey AS cid, count(*) AS n FROM lineitem GROUP BY 1")
def _(t, s, d):
    return t("lineitem").groupBy(F.col("l_partkey").alias("cid")).agg(F.count(F.lit(1)).alias("n"))


@q("agg2_most_common", f"WITH {LABELS} SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM labels) GROUP BY label ORDER BY n DESC, label LIMIT 50")
def _(t, s, d):
    labels = label_lists(t).select(F.explode("labels").alias("label"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(50)


@q("agg3_edge_multiplicity", f"WITH {EDGES}, {snapshot_sql('snap', PAST_DAY)} SELECT u, v, links FROM snap")
def _(t, s, d):
    return snapshot(edges(t), PAST_DAY)


@q("agg4_degrees", f"WITH {PAST_GRAPH}, {_DEGREES} SELECT id, degree, weighted FROM deg")
def _(t, s, d):
    return degrees(snapshot(edges(t), PAST_DAY))


@q("agg5_two_hop_degree", f"WITH {PAST_GRAPH}, {_DEGREES} SELECT w.id, CAST(sum(degree) AS BIGINT) AS two_hop FROM ways w JOIN deg ON deg.id = w.other GROUP BY w.id")
def _(t, s, d):
    return two_hop(cut(snapshot(edges(t), PAST_DAY)))


@q("agg5_two_hop_weighted", f"WITH {PAST_GRAPH}, {_DEGREES} SELECT w.id, CAST(sum(weighted * links) AS BIGINT) AS two_hop FROM ways w JOIN deg ON deg.id = w.other GROUP BY w.id")
def _(t, s, d):
    return two_hop(cut(snapshot(edges(t), PAST_DAY)), binary=False)


@q("agg6_emerging_concepts", f"WITH {MENTIONS} SELECT cid, min(y) AS first_year, count(*) AS n FROM mentions WHERE y <= 1997 GROUP BY cid HAVING min(y) >= 1996 AND count(*) >= 2")
def _(t, s, d):
    return emerging(mentions(t), 1997, 1996, 2)


@q("agg7_concepts_of_works", f"WITH {MENTIONS} SELECT DISTINCT cid FROM mentions JOIN orders ON o_orderkey = work_id WHERE o_orderpriority = '1-URGENT' AND y BETWEEN 1995 AND 1996")
def _(t, s, d):
    urgent = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("work_id"))
    return mentions(t).where(F.col("y").between(1995, 1996)).join(urgent, "work_id", "left_semi").select("cid").distinct()


@q("agg8_first_event_year", f"WITH {EDGES} SELECT u, v, min(y) AS first_year FROM edges WHERE y > 1996 AND y <= 1998 GROUP BY u, v")
def _(t, s, d):
    return edges(t).where("y > 1996 AND y <= 1998").groupBy("u", "v").agg(F.min("y").alias("first_year"))


@q("agg9_mean_of_exact_vectors", f"WITH {_VECTORS} SELECT cid, count(*) AS n, round(coalesce(avg(e[1]) FILTER (work_id % 3 = 0), avg(e[1])), 5) AS first_value FROM wv GROUP BY cid")
def _(t, s, d):
    means = vector_means(_work_vectors(t), "cid", "embedding", 64, when=F.col("work_id") % 3 == 0)
    return means.select("cid", "n", F.round(F.get("vec", 0), 5).alias("first_value"))


@q("agg10_two_level_means", f"WITH {_VECTORS} SELECT cid, round(avg(m), 5) AS first_value FROM (SELECT cid, work_id % 4 AS g, avg(e[1]) AS m FROM wv GROUP BY 1, 2) GROUP BY cid")
def _(t, s, d):
    means = two_level_means(_work_vectors(t).withColumn("g", F.col("work_id") % 4), ["cid"], "g", "embedding", 64)
    return means.select("cid", F.round(F.get("vec", 0), 5).alias("first_value"))


_RATIO = "r AS (SELECT source_id, count(*) AS n, avg(CAST(contains(lower(abstract), 'surgery') AS INTEGER)) AS ratio FROM surgery_pubmed_works WHERE abstract IS NOT NULL AND source_id IS NOT NULL GROUP BY 1)"


def _ratios(t):
    held = t("surgery_pubmed_works").where("abstract IS NOT NULL AND source_id IS NOT NULL").select("source_id", T.contains_ignoring_case(F.col("abstract"), F.lit("surgery")).cast("int").alias("held"))
    return held.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.avg("held").alias("ratio"))


@q("agg11_containment_ratio", f"WITH {_RATIO} SELECT source_id, n, round(ratio, 6) AS ratio FROM r")
def _(t, s, d):
    return _ratios(t).withColumn("ratio", F.round("ratio", 6))


@q("agg11_ratio_summary", f"WITH {_RATIO} SELECT count(*) AS n, round(avg(ratio), 6) AS mean, round(stddev_samp(ratio), 6) AS deviation, min(ratio) AS low, round(quantile_cont(ratio, 0.25), 6) AS q1, round(quantile_cont(ratio, 0.5), 6) AS median, round(quantile_cont(ratio, 0.75), 6) AS q3, max(ratio) AS high, round(avg(CAST(ratio = 0 AS INTEGER)), 6) AS none, round(avg(CAST(ratio < 0.5 AS INTEGER)), 6) AS under_half FROM r WHERE n >= 3")
def _(t, s, d):
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    rows = cut(_ratios(t).where("n >= 3"))
    quartile = {p: F.round(F.lit(v).cast("double"), 6) for p, v in exact_quantiles(rows, "ratio", [0.25, 0.5, 0.75]).items()}
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ratio"), 6).alias("mean"), F.round(F.stddev_samp("ratio"), 6).alias("deviation"), F.min("ratio").alias("low"), quartile[0.25].alias("q1"),
        quartile[0.5].alias("median"), quartile[0.75].alias("q3"), F.max("ratio").alias("high"), share(F.col("ratio") == 0).alias("none"), share(F.col("ratio") < 0.5).alias("under_half"),
    )


@q("agg12_works_per_year", "SELECT publication_year, count(*) AS works, count(DISTINCT pmid) AS distinct_works FROM surgery_pubmed_works GROUP BY 1")
def _(t, s, d):
    return t("surgery_pubmed_works").groupBy("publication_year").agg(F.count(F.lit(1)).alias("works"), F.count_distinct("pmid").alias("distinct_works"))


@q("agg13_period_means", "SELECT CAST(y // 5 * 5 AS VARCHAR) || '-' || CAST(y // 5 * 5 + 4 AS VARCHAR) AS period, round(avg(n), 6) AS mean_works FROM (SELECT publication_year AS y, count(*) AS n FROM surgery_pubmed_works WHERE publication_year > 0 GROUP BY 1) GROUP BY 1")
def _(t, s, d):
    yearly = t("surgery_pubmed_works").where("publication_year > 0").groupBy("publication_year").agg(F.count(F.lit(1)).alias("n"))
    return yearly.groupBy(five_year_period(F.col("publication_year")).alias("period")).agg(F.round(F.avg("n"), 6).alias("mean_works"))


@q("agg14_concepts_per_year", f"WITH {MENTIONS} SELECT y, count(DISTINCT cid) AS concepts FROM mentions GROUP BY y")
def _(t, s, d):
    return mentions(t).groupBy("y").agg(F.count_distinct("cid").alias("concepts"))


@q("agg15_module_counts", f"SELECT module, count(*) AS works FROM (SELECT unnest({_PARTS}) AS module FROM surgery_pubmed_works) GROUP BY 1")
def _(t, s, d):
    return t("surgery_pubmed_works").select(F.explode(T.split_list(F.col("modules"))).alias("module")).groupBy("module").agg(F.count(F.lit(1)).alias("works"))


@q("agg16_corpus_facts", f"SELECT count(*) AS works, count(DISTINCT pmid) AS pmids, count(DISTINCT doi) AS dois, min(publication_year) AS first_year, max(publication_year) AS last_year, count(*) FILTER (abstract <> '') AS abstracts, count(DISTINCT source_id) AS sources, count(*) FILTER (len({_PARTS}) > 1) AS several_modules, count(*) FILTER (is_retracted) AS retracted FROM surgery_pubmed_works")
def _(t, s, d):
    works = t("surgery_pubmed_works")
    kinds = {"pmids": F.col("pmid").cast("string"), "dois": F.col("doi"), "sources": F.col("source_id")}
    named = works.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in kinds.items()))).alias("x")).select("x.*").where("value IS NOT NULL")
    distinct = named.groupBy("kind", "value").agg(F.lit(1).alias("one")).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))  # equal values go together before the shuffle, all kinds in one
    facts = works.agg(
        F.count(F.lit(1)).alias("works"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"),
        F.count_if(F.col("abstract") != "").alias("abstracts"), F.count_if(F.size(T.split_list(F.col("modules"))) > 1).alias("several_modules"), F.count_if("is_retracted").alias("retracted"),
    )
    return facts.crossJoin(F.broadcast(distinct))  # one row each


@q("agg17_list_lengths", f"WITH {LABELS} SELECT round(avg(len(labels)), 6) AS mean, CAST(median(len(labels)) AS DOUBLE) AS median, min(len(labels)) AS low, max(len(labels)) AS high FROM labels")
def _(t, s, d):
    n = F.size("labels").cast("bigint")
    lengths = label_lists(t).select(n.alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("works"))  # one row a length
    held = cut(lengths)
    median = exact_quantiles(label_lists(t).select(n.alias("n")), "n", [0.5])
    return held.agg(F.round(F.sum(F.col("n") * F.col("works")) / F.sum("works"), 6).alias("mean"), F.lit(median[0.5]).cast("double").alias("median"), F.min("n").alias("low"), F.max("n").alias("high"))


@q("agg18_reasons_with_zero", "WITH r(reason) AS (VALUES ('missing_title'), ('missing_abstract'), ('never')) SELECT r.reason, count(w.pmid) AS n FROM r LEFT JOIN (SELECT pmid, CASE WHEN display_name IS NULL THEN 'missing_title' WHEN abstract IS NULL THEN 'missing_abstract' END AS reason FROM surgery_pubmed_works) w ON r.reason = w.reason GROUP BY 1")
def _(t, s, d):
    from corpusloom.functions.predicates import without_reason

    reasons = s.createDataFrame([("missing_title",), ("missing_abstract",), ("never",)], "reason string")
    counted = without_reason(t("surgery_pubmed_works"), {"missing_title": F.col("display_name").isNull(), "missing_abstract": F.col("abstract").isNull()}).groupBy("reason").agg(F.count("pmid").alias("n"))
    return F.broadcast(reasons).join(counted, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


@q("agg21_edges_until_year", f"WITH {EDGES}, g AS (SELECT y, count(*) AS edges FROM edges GROUP BY y) SELECT y, edges, CAST(sum(edges) OVER (ORDER BY y) AS BIGINT) AS edges_until FROM g")
def _(t, s, d):
    return cumulative_edges(edges(t))


@q("agg22_grouped_suggestions", f"WITH {SCORED} SELECT src, idx, CAST(count(*) OVER (PARTITION BY src) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY n, src, score DESC, idx) AS BIGINT) AS place FROM (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM scored WHERE score > 0.5)")
def _(t, s, d):
    """Suggestions in groups of their source, small groups first, best first in a group; one row each, so that a group of any size is written in order."""
    rows = scored(t).where("score > 0.5")
    sizes = rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return with_row_number(rows.join(small_side(sizes), "src"), F.col("n"), F.col("src"), F.col("score").desc(), F.col("idx"), name="place").select("src", "idx", "n", "place")


@q("agg23_tile_landmarks", "WITH m AS (SELECT vec_id, CAST(floor(embedding[1] * 10 / 2) AS BIGINT) AS tile_x, CAST(floor(embedding[2] * 10 / 2) AS BIGINT) AS tile_y, (vec_id * 31) % 101 AS degree FROM embeddings) SELECT tile_x, tile_y, count(*) AS n, arg_min(vec_id, (-degree, vec_id)) AS landmark FROM m GROUP BY ALL")
def _(t, s, d):
    tile = lambda i: F.floor(F.get("embedding", i) * 10 / 2).alias("tile_" + "xy"[i])
    rows = t("embeddings").select("vec_id", tile(0), tile(1), ((F.col("vec_id") * 31) % 101).alias("degree"))
    return rows.groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"), F.min_by("vec_id", F.struct((-F.col("degree")).alias("o"), "vec_id")).alias("landmark"))


@q("agg24_author_concepts", "SELECT o_custkey AS author, l_partkey AS cid, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2 HAVING count(*) >= 2")
def _(t, s, d):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("cid"))
    return t("orders").select("o_orderkey", F.col("o_custkey").alias("author")).join(lines, "o_orderkey").groupBy("author", "cid").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@q("agg25_column_moments", "SELECT round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS deviation, max(l_quantity) AS high FROM lineitem")
def _(t, s, d):
    return t("lineitem").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_pop("l_quantity"), 6).alias("deviation"), F.max("l_quantity").alias("high"))


@q("agg26_graph_facts", f"WITH {EDGES} SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM (SELECT DISTINCT u, v FROM edges)) AS pairs, (SELECT count(*) FROM (SELECT u FROM edges UNION SELECT v FROM edges)) AS nodes, (SELECT min(day) FROM edges) AS first_day, (SELECT max(day) FROM edges) AS last_day")
def _(t, s, d):
    every = cut(edges(t))
    pairs = every.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("a"), F.max("day").alias("b"))
    facts = pairs.agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("pairs"), F.min("a").alias("first_day"), F.max("b").alias("last_day"))
    nodes = nodes_of(every).agg(F.count(F.lit(1)).alias("nodes"))
    return facts.crossJoin(F.broadcast(nodes)).select("edges", "pairs", "nodes", "first_day", "last_day")  # one row each


@q("agg27_new_edge_ratio", f"WITH {EDGES}, {snapshot_sql('a', PAST_DAY)}, {snapshot_sql('b', FUTURE_DAY)} SELECT round((SELECT count(*) FROM b) / (SELECT count(*) FROM a), 6) AS ratio")
def _(t, s, d):
    first = edges(t).where(F.col("day") < FUTURE_DAY).groupBy("u", "v").agg(F.min("day").alias("first"))
    return first.agg(F.round(F.count(F.lit(1)) / F.count_if(F.col("first") < PAST_DAY), 6).alias("ratio"))


@q("agg28_shared_concepts", f"WITH {MENTIONS}, p AS (SELECT DISTINCT cid, o_orderpriority AS m FROM mentions JOIN orders ON o_orderkey = work_id) SELECT count(*) AS shared FROM (SELECT cid FROM p WHERE m = '1-URGENT' INTERSECT SELECT cid FROM p WHERE m = '5-LOW')")
def _(t, s, d):
    modules = t("orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_orderpriority").alias("m"))
    held = mentions(t).join(modules, "work_id").groupBy("cid").agg(F.max((F.col("m") == "1-URGENT").cast("int")).alias("a"), F.max((F.col("m") == "5-LOW").cast("int")).alias("b"))
    return held.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("shared"))


def _agree(a: str) -> str:
    return f"count(*) FILTER (lower({a}) = lower(concept_gt)) AS hits_{a}, count(*) FILTER (coalesce({a}, '') NOT IN ('', '-', 'n/a')) AS given_{a}"


@q("agg29_benchmark_agreement", f"SELECT count(concept_gt) AS truths, {', '.join(map(_agree, ('annotator1', 'annotator2', 'annotator3')))} FROM annotations WHERE concept_gt IS NOT NULL")
def _(t, s, d):
    given = lambda a: F.count_if(~F.coalesce(F.col(a), F.lit("")).isin("", "-", "n/a")).alias(f"given_{a}")
    names = ("annotator1", "annotator2", "annotator3")
    return t("annotations").where("concept_gt IS NOT NULL").agg(F.count("concept_gt").alias("truths"), *(c for a in names for c in (F.count_if(F.lower(a) == F.lower("concept_gt")).alias(f"hits_{a}"), given(a))))


# --- windows


@q("win1_label_ids", "SELECT row_number() OVER (ORDER BY c) - 1 AS id, c AS concept FROM (SELECT DISTINCT concept AS c FROM lookup_m)")
def _(t, s, d):
    return with_row_number(t("lookup_m").select("concept").distinct(), F.col("concept"), name="id", start=0).select("id", "concept")


@q("win2_cumulative_concepts", f"WITH {MENTIONS}, g AS (SELECT y, count(DISTINCT cid) AS n FROM mentions GROUP BY y) SELECT y, CAST(sum(n) OVER (ORDER BY y) AS BIGINT) AS summed, CAST(sum(n) OVER (ORDER BY y) AS BIGINT) * CAST(sum(n) OVER (ORDER BY y) AS BIGINT) AS squared FROM g")
def _(t, s, d):
    yearly = mentions(t).groupBy("y").agg(F.count_distinct("cid").alias("n"))
    summed = F.sum("n").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, 0))  # one row a year
    return yearly.select("y", summed.alias("summed")).withColumn("squared", F.col("summed") * F.col("summed"))


@q("win2_distinct_until_year", f"WITH {MENTIONS}, f AS (SELECT cid, min(y) AS y FROM mentions GROUP BY cid), g AS (SELECT y, count(*) AS n FROM f GROUP BY y) SELECT y, CAST(sum(n) OVER (ORDER BY y) AS BIGINT) AS until FROM g")
def _(t, s, d):
    first = mentions(t).groupBy("cid").agg(F.min("y").alias("y")).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return first.select("y", F.sum("n").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, 0)).alias("until"))  # one row a year


@q("win3_edge_share", f"WITH {PAST_GRAPH}, {_DEGREES}, o AS (SELECT id, row_number() OVER (ORDER BY degree, id) AS rank, sum(degree) OVER (ORDER BY degree, id ROWS UNBOUNDED PRECEDING) AS until, sum(degree) OVER () AS total, count(*) OVER () AS n FROM deg) SELECT rank, round(until * 100.0 / total, 6) AS share, round((rank - 1) * 100.0 / (n - 1), 6) AS position FROM o")
def _(t, s, d):
    curve = lorenz(degrees(snapshot(edges(t), PAST_DAY)), "degree", F.col("degree"), F.col("id"))
    return curve.select("rank", F.round("share", 6).alias("share"), F.round("position", 6).alias("position"))


@q("win7_moving_averages", "WITH e AS (SELECT user_id, event_id, value FROM events) SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS current_mean, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING), 6) AS previous_mean FROM e")
def _(t, s, d):
    window = lambda a, b: Window.partitionBy("user_id").orderBy("event_id").rowsBetween(a, b)
    return t("events").select("event_id", F.round(F.avg("value").over(window(-4, 0)), 6).alias("current_mean"), F.round(F.avg("value").over(window(-9, -5)), 6).alias("previous_mean"))


@q("win8_patience", "WITH b AS (SELECT user_id, event_id, value > coalesce(max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) AS better FROM events), g AS (SELECT *, sum(CAST(better AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM b) SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS INTEGER) AS waited FROM g")
def _(t, s, d):
    user = Window.partitionBy("user_id").orderBy("event_id")
    best = F.coalesce(F.max("value").over(user.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1e300))
    runs = t("events").select("user_id", "event_id", (F.col("value") > best).cast("int").alias("better")).withColumn("run", F.sum("better").over(user.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.select("event_id", (F.row_number().over(Window.partitionBy("user_id", "run").orderBy("event_id")) - 1).alias("waited"))


@q("win9_chunk_numbers", "SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 500 AS BIGINT) AS chunk FROM events")
def _(t, s, d):
    return numbered_parts(t("events").select("event_id"), F.col("event_id"), rows=500, name="chunk")


@q("win10_fixed_batches", "SELECT b AS batch, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id), ',') AS ids FROM (SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 6 AS BIGINT) AS b FROM documents) GROUP BY 1")
def _(t, s, d):
    batches = batches_in_order(t("documents").select("doc_id"), [F.col("doc_id")], 6, "doc_id")
    return batches.select("batch", F.size("items").cast("bigint").alias("n"), F.array_join(F.transform("items", lambda i: i["doc_id"].cast("string")), ",").alias("ids"))


@q("win11_following_lines", "SELECT l_orderkey, l_linenumber, lead(l_partkey, 1) OVER w AS next_part, lead(l_partkey, 4) OVER w AS fourth_part FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def _(t, s, d):
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return lines.select("l_orderkey", "l_linenumber", F.lead("l_partkey", 1).over(order).alias("next_part"), F.lead("l_partkey", 4).over(order).alias("fourth_part"))


@q("win12_rank_column", f"WITH {SCORED} SELECT idx, row_number() OVER (ORDER BY score DESC, idx) AS rank FROM scored")
def _(t, s, d):
    return with_row_number(scored(t).select("idx", "score"), F.col("score").desc(), F.col("idx"), name="rank").select("idx", "rank")


@q("win_running_sums", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey) AS BIGINT) AS until FROM orders")
def _(t, s, d):
    return with_running_sums(t("orders").select("o_orderkey", "o_custkey"), [F.col("o_orderkey")], {"until": "o_custkey"}).select("o_orderkey", "until")


# --- sorts and limits


@q("srt1_stable_sort", "SELECT pmid, row_number() OVER (ORDER BY publication_date, CAST(pmid AS VARCHAR)) AS place FROM (SELECT DISTINCT pmid, publication_date FROM surgery_pubmed_works WHERE publication_date IS NOT NULL)")
def _(t, s, d):
    rows = t("surgery_pubmed_works").where("publication_date IS NOT NULL").select("pmid", "publication_date").distinct()
    return with_row_number(rows, F.col("publication_date"), F.col("pmid").cast("string"), name="place").select("pmid", "place")


@q("srt2_top_scores", f"WITH {SCORED} SELECT idx, score FROM scored ORDER BY score DESC, idx LIMIT 100")
def _(t, s, d):
    return scored(t).select("idx", "score").orderBy(F.desc("score"), "idx").limit(100)


@q("srt3_top_per_concept", f"WITH {SCORED} SELECT src, idx, CAST(rank AS INTEGER) AS rank FROM (SELECT src, idx, row_number() OVER (PARTITION BY src ORDER BY score DESC, idx) AS rank FROM scored) WHERE rank <= 15")
def _(t, s, d):
    return top_per_group(scored(t), ["src"], [F.desc("score"), F.col("idx")], 15).select("src", "idx", "rank")


@q("srt4_two_keys", "SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) AS place FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def _(t, s, d):
    brands = t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return with_row_number(brands, F.desc("n"), F.col("p_brand"), name="place").select("p_brand", "n", "place")


@q("srt5_head_of_counts", "SELECT l_partkey AS cid, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, cid LIMIT 30")
def _(t, s, d):
    return t("lineitem").groupBy(F.col("l_partkey").alias("cid")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cid").limit(30)


@q("srt6_own_and_other", f"WITH {SCORED}, own AS (SELECT DISTINCT l_partkey AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey IN (SELECT min(c_custkey) FROM customer)) SELECT idx, score, src IN (SELECT c FROM own) AS own FROM scored")
def _(t, s, d):
    author = t("customer").agg(F.min("c_custkey").alias("o_custkey"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(F.broadcast(author), "o_custkey", "left_semi")
    own = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("src")).join(orders, "o_orderkey", "left_semi").select("src").distinct()
    return scored(t).join(own.withColumn("own", F.lit(True)), "src", "left").select("idx", "score", F.coalesce("own", F.lit(False)).alias("own"))


@q("srt7_capped_enumeration", f"WITH {PAST_GRAPH} SELECT u, v FROM snap ORDER BY u, v LIMIT 1000")
def _(t, s, d):
    return snapshot(edges(t), PAST_DAY).select("u", "v").orderBy("u", "v").limit(1000)


@q("srt8_cap_per_source", f"WITH {PAST_GRAPH} SELECT u, v FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY (u * 1000003 + v * 7919 + 42 * 104729) % 2147483647, v) AS r FROM snap) WHERE r <= 3")
def _(t, s, d):
    from corpusloom.operators.sampling import pair_hash

    return top_per_group(snapshot(edges(t), PAST_DAY), ["u"], [pair_hash(F.col("u"), F.col("v")), F.col("v")], 3).select("u", "v")


@q("srt9_nearest_vectors", "WITH d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT query, neighbour, round(dist, 3) AS distance, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, neighbour) AS r FROM d) WHERE r <= 6")
def _(t, s, d):
    rows = t("embeddings")
    found = nearest(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 6)
    return found.select("query", "neighbour", F.round("distance", 3).alias("distance"), "rank")


# --- sets


@q("set1_new_edges", f"WITH {EDGES}, {snapshot_sql('a', PAST_DAY)}, {snapshot_sql('b', FUTURE_DAY)} SELECT u, v FROM b EXCEPT SELECT u, v FROM a")
def _(t, s, d):
    first = edges(t).where(F.col("day") < FUTURE_DAY).groupBy("u", "v").agg(F.min("day").alias("first"))
    return first.where(F.col("first") >= PAST_DAY).select("u", "v")


@q("set2_nodes", f"WITH {EDGES} SELECT u AS id FROM edges UNION SELECT v FROM edges")
def _(t, s, d):
    return nodes_of(edges(t))


@q("set3_allowed_ids", "SELECT vec_id AS id FROM embeddings INTERSECT SELECT l_partkey FROM lineitem")
def _(t, s, d):
    return t("embeddings").select(F.col("vec_id").alias("id")).intersect(t("lineitem").select(F.col("l_partkey").alias("id")))


@q("set4_unresolved", "SELECT DISTINCT id, 'asked only' AS side FROM materials_science_works WHERE id NOT IN (SELECT work_id FROM annotations WHERE work_id IS NOT NULL) UNION ALL SELECT DISTINCT work_id, 'answered only' FROM annotations WHERE work_id NOT IN (SELECT id FROM materials_science_works)")
def _(t, s, d):
    asked, answered = t("materials_science_works").select("id"), t("annotations").where("work_id IS NOT NULL").select(F.col("work_id").alias("id"))
    return asked.subtract(answered).withColumn("side", F.lit("asked only")).unionByName(answered.subtract(asked).withColumn("side", F.lit("answered only")))


@q("set5_concatenation", "SELECT pmid AS id, display_name FROM surgery_pubmed_works UNION ALL SELECT NULL, display_name FROM materials_science_works")
def _(t, s, d):
    return t("surgery_pubmed_works").select(F.col("pmid").alias("id"), "display_name").unionByName(t("materials_science_works").select("display_name"), allowMissingColumns=True)


@q("set6_array_difference", "SELECT p_partkey, array_to_string(list_filter(['In', p_brand, 'UV'], lambda x: x NOT IN ('In', 'UV')), ',') AS kept FROM part")
def _(t, s, d):
    return t("part").select("p_partkey", F.array_join(F.array_except(F.array(F.lit("In"), F.col("p_brand"), F.lit("UV")), F.array(*map(F.lit, FALSE_FORMULAS))), ",").alias("kept"))


@q("set7_table_and_graph", f"WITH {EDGES}, g AS (SELECT u AS id FROM edges UNION SELECT v FROM edges), m AS (SELECT DISTINCT cid AS id FROM mentions) SELECT (SELECT count(*) FROM (SELECT id FROM m EXCEPT SELECT id FROM g)) AS table_only, (SELECT count(*) FROM (SELECT id FROM g EXCEPT SELECT id FROM m)) AS graph_only")
def _(t, s, d):
    in_table = mentions(t).select(F.col("cid").alias("id")).distinct().withColumn("a", F.lit(1))
    in_graph = nodes_of(edges(t)).withColumn("b", F.lit(1))
    return in_table.join(in_graph, "id", "full").agg(F.count_if(F.col("b").isNull()).alias("table_only"), F.count_if(F.col("a").isNull()).alias("graph_only"))


@q("set8_ordered_distinct", "WITH f AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, min(doc_id) AS place FROM documents GROUP BY 1, 2) SELECT source, array_to_string(list(lang ORDER BY place), ',') AS langs FROM f GROUP BY source")
def _(t, s, d):
    """The languages of each feed in the order in which they come first."""
    first = t("documents").groupBy(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang")).agg(F.min("doc_id").alias("place"))
    return first.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "lang"))), lambda x: x["lang"]), ",").alias("langs"))  # one a language


@q("set9_symmetric_closure", f"WITH {PAST_GRAPH} SELECT id, other, links FROM ways")
def _(t, s, d):
    return both_ways(snapshot(edges(t), PAST_DAY))


@q("smp1_positive_pairs", f"WITH {EDGES}, {snapshot_sql('a', PAST_DAY)}, {snapshot_sql('b', FUTURE_DAY)}, known AS (SELECT u AS id FROM a UNION SELECT v FROM a) SELECT b.u, b.v, b.links FROM b LEFT JOIN a USING (u, v) WHERE a.u IS NULL AND b.u IN (SELECT id FROM known) AND b.v IN (SELECT id FROM known)")
def _(t, s, d):
    return new_pairs(edges(t), PAST_DAY, FUTURE_DAY)


