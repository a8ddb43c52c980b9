"""Stand-in views over the tables, as DataFrames and as SQL: mentions of parts in orders make the concept graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.dates import day_of_year_end
from corpusloom.functions.labels import decode_labels
from corpusloom.operators.graph import edges_of_mentions

#: The cutoff year of past snapshots and the years that lie ahead of it.
PAST, AHEAD = 1996, 2
#: Days of feature snapshots, and of whole-year cutoffs.
FEATURE_DAYS = {y: day_of_year_end(y) for y in (1995, 1996, 1997)}
PAST_DAY, FUTURE_DAY = 9862, 10592  # 1997-01-01 and 1999-01-01

MENTIONS = """mentions AS (
  SELECT DISTINCT l_orderkey AS work_id, l_partkey AS cid, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day,
         CAST(year(o_orderdate) AS INTEGER) AS y
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
EDGES = f"""{MENTIONS}, edges AS (
  SELECT a.work_id, a.cid AS u, b.cid AS v, a.day, a.y FROM mentions a JOIN mentions b ON a.work_id = b.work_id AND a.cid < b.cid)"""


def snapshot_sql(name: str, day: int) -> str:
    return f"{name} AS (SELECT u, v, count(*) AS links FROM edges WHERE day < {day} GROUP BY u, v)"


def ways_sql(name: str, snap: str) -> str:
    return f"{name} AS (SELECT u AS id, v AS other, links FROM {snap} UNION ALL SELECT v, u, links FROM {snap})"


PAST_GRAPH = f"{EDGES}, {snapshot_sql('snap', PAST_DAY)}, {ways_sql('ways', 'snap')}"


def _mentions(t, lines: DataFrame) -> DataFrame:
    orders = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("work_id"), F.col("l_partkey").alias("cid"), F.unix_date("d").alias("day"), F.year("d").alias("y"))


def mentions(t) -> DataFrame:
    return _mentions(t, t("lineitem").select("l_orderkey", "l_partkey").distinct())


def edges(t) -> DataFrame:
    """Edges of all mentions; a part that a work names twice is one in its set, so lines are not made distinct before."""
    return edges_of_mentions(_mentions(t, t("lineitem").select("l_orderkey", "l_partkey")))


def lookup(t) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("concept"))


LOOKUP = "lookup AS (SELECT p_partkey AS id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS concept FROM part)"
#: A score with ties, and a label, of each document.
SCORED = "scored AS (SELECT doc_id AS idx, CAST(doc_id % 97 AS BIGINT) AS src, CAST(1990 + doc_id % 7 AS INTEGER) AS yr, CAST((doc_id * 31 % 10 < 3) AS INTEGER) AS label, (coalesce(n_chars, 0) * 7919 % 1000) / 1000.0::DOUBLE AS score, (doc_id * 104729 % 1000) / 1000.0::DOUBLE AS score2 FROM documents)"


def scored(t) -> DataFrame:
    chars = F.coalesce("n_chars", F.lit(0))
    return t("documents").select(
        F.col("doc_id").alias("idx"), (F.col("doc_id") % 97).alias("src"), (F.lit(1990) + F.col("doc_id") % 7).cast("int").alias("yr"), (F.col("doc_id") * 31 % 10 < 3).cast("int").alias("label"),
        ((chars * 7919) % 1000 / 1000).alias("score"), ((F.col("doc_id") * 104729) % 1000 / 1000).alias("score2"),
    )


_SPACE = r"[\s\x{A0}\x{2000}-\x{200A}\x{3000}]"
_STRIP = rf"^{_SPACE}+|{_SPACE}+$"
_QUOTED = r"''(?:[^''\\]|\\.)*''|\"(?:[^\"\\]|\\.)*\""
#: Labels of each work, whatever their notation; none is an empty list.
LABELS = rf"""raw AS (SELECT pmid, regexp_replace(coalesce(llm_concepts, ''), '{_STRIP}', '', 'g') AS v FROM surgery_pubmed_works),
listed AS (SELECT pmid, CASE WHEN v[1] = '[' AND json_valid(v) THEN from_json(v, '["VARCHAR"]') WHEN v[1] = '{{' AND json_valid(v) THEN from_json(v->'$.concepts', '["VARCHAR"]')
  WHEN v[1] = '[' THEN list_transform(regexp_extract_all(v, '{_QUOTED}'), lambda x: x[2:-2]) WHEN contains(v, ';') THEN string_split(v, ';') WHEN contains(v, '|') THEN string_split(v, '|') ELSE string_split(v, ',') END AS items FROM raw),
labels AS (SELECT pmid, coalesce(list_filter(list_transform(items, lambda x: regexp_replace(x, '{_STRIP}', '', 'g')), lambda x: x <> ''), []) AS labels FROM listed)"""


def label_lists(t) -> DataFrame:
    """(pmid, labels) of every work, whatever their notation."""
    return t("surgery_pubmed_works").select("pmid", decode_labels(F.col("llm_concepts")).alias("labels"))
