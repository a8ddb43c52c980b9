"""Operators on small inputs: edge cases, ties, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import dates as D
from corpusloom.functions import predicates as P
from corpusloom.functions import text as T
from corpusloom.operators import embeddings as E
from corpusloom.operators import graph as G
from corpusloom.operators import metrics as M
from corpusloom.operators import models as N
from corpusloom.operators import sampling as S
from corpusloom.operators.formulas import ELEMENT_NAMES, extract_formulas, formulas_in, name_elements
from corpusloom.operators.keyphrases import ranked_phrases
from corpusloom.operators.ordering import with_row_number, with_running_sums


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "formula"),
    [("Ti2 C", "Ti2C"), ("Hf 3", "Hf3"), ("Gd2O 3", "Gd2O3"), ("Co 3+", "Co3+"), ("Ga 0.25", "Ga0.25"), ("Li-Ni-O", "LiNiO"), ("Bi-Sb-Te-doped", "BiSbTe"), ("La 2 Sr Mn 3 O 7-x", "La2SrMn3O7"), ("W 1 2", "W12")],
)
def test_formulas(text, formula):
    assert formulas_in(text) == {formula}


def test_formula_table(spark):
    assert len(ELEMENT_NAMES) == 118
    df = spark.createDataFrame([(1, "In Ti2 C"), (2, None), (3, "")], "id int, abstract string")
    assert [(r["abstract"], r["elements"]) for r in extract_formulas(df, "abstract").orderBy("id").collect()][1:] == [(None, None), ("", [])]
    assert one(spark, name_elements(F.array(F.lit("ni foam"), F.lit("w tip"), F.lit("at rest")), F.array(F.lit("Ni")))) == ["at rest", "nickel foam", "w tip"]


def test_phrases():
    assert [p for p, _ in ranked_phrases("Deep learning for steel grain growth. Steel of steel grain growth")] == ["steel grain growth", "deep learning"]
    assert ranked_phrases("") == []


def test_label_rules(spark):
    labels = F.array(*map(F.lit, ["Stent patency after one year", "gastrectomy", "TP53 mutations", "treatment", "pooled odds  ratios", "Stent patency after one year", "mri"]))
    assert one(spark, T.normalize_labels(labels)) == ["stent patency after one year", "tp53 mutations", "pooled odds ratios", "mri"]
    names = ["stage 3 melanoma", "β-lactam dose", "mri", "gastrectomy", "one label that has more words than allowed"]
    assert [one(spark, P.biomedical_label(F.lit(n))) for n in names] == [True, True, True, False, False]
    assert one(spark, T.parse_label_list(F.lit("['a', 'b']"))) == ["a", "b"] and one(spark, T.parse_label_list(F.lit(None).cast("string"))) == []
    for text, found in (('{"concepts": ["x"]}', ["x"]), ('["y", "z"]', ["y", "z"]), ("bare; labels", None), ("[broken", None), ("[]", [])):
        assert one(spark, T.parse_label_list(F.lit(text))) == found


def test_dates(spark):
    assert one(spark, D.any_date(F.lit("2020-02-31"))) is None
    assert str(one(spark, D.any_date(F.lit("03.02.2020")))) == "2020-02-03"
    assert one(spark, D.partial_date(F.lit(None).cast("string"), F.lit("Sept."), F.lit("40"), F.lit("Winter 1998-1999"))) == "1998-09-01"


def test_numbers_and_sums_over_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 7) % 1000).alias("k"), F.lit(1).alias("v"))
    assert with_row_number(df, F.col("k"), start=0).where("row_no != k").count() == 0
    assert with_running_sums(df, [F.col("k")], {"s": "v"}).where("s != k + 1").count() == 0
    assert with_row_number(df.limit(0), F.col("k")).count() == 0


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "u long, v long").withColumn("links", F.lit(1))


def test_walks_and_components(spark):
    snap = graph(spark, [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12)])
    walked = {(r["source"], r["id"]): r["distance"] for r in G.distances_from(snap, spark.createDataFrame([(1,)], "id long"), 2).collect()}
    assert walked == {(1, 1): 0, (1, 2): 1, (1, 3): 2}
    pairs = spark.createDataFrame([(1, 4), (1, 10), (2, 2)], "u long, v long")
    assert {(r["u"], r["v"]): r["distance"] for r in G.pair_distances(snap, pairs).collect()} == {(1, 4): 3, (1, 10): -1, (2, 2): 0}
    assert {r["id"]: r["component"] for r in G.components(snap).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10}
    assert G.components(snap.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    chain = graph(spark, [(i, i + 1) for i in range(60)])
    assert {r["component"] for r in G.components(chain).collect()} == {0}


def test_build_of_edges(spark):
    mentions = spark.createDataFrame([(1, c, 5, 1970) for c in (1, 2, 3, 4, 5)] + [(2, 1, 6, 1970), (2, 2, 6, 1970), (3, 9, 7, 1970), (1, 1, 5, 1970)], "work_id long, cid long, day int, y int")
    edges = G.edges_of_mentions(mentions)
    assert edges.count() == 11 and edges.where("u >= v").count() == 0
    assert G.snapshot(edges, 7).where("u = 1 AND v = 2").first()["links"] == 2


def test_sampling(spark):
    edges = spark.createDataFrame([(i, i, i + 1, 0, 1970) for i in range(20)] + [(100 + i, i, i + 2, 5, 1971) for i in range(0, 10)], "work_id long, u long, v long, day int, y int")
    pairs = S.labelled_pairs(edges, 3, 9, n=30)
    assert (pairs.where("label = 1").count(), pairs.where("label = 0").count()) == (10, 20)
    linked = G.snapshot(edges, 9).select("u", "v")
    assert pairs.where("label = 0").join(linked, ["u", "v"]).count() == 0
    assert S.stratified_pairs(pairs, 10, 0.3).where("label = 1").count() == 3
    with pytest.raises(ValueError):
        S.labelled_pairs(edges, 3, 9, n=5)
    with pytest.raises(ValueError):
        S.stratified_pairs(pairs, 100, 0.5)


def test_candidates_in_blocks(spark):
    snap = graph(spark, [(1, 2), (2, 3), (3, 4), (4, 5)])
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 5)], "id long")
    found = {b: sorted(map(tuple, S.candidates_between(ids, G.nodes_of(snap), snap, block=b).collect())) for b in (1, 2, 100)}
    assert found[1] == found[2] == found[100] == [(1, 3), (1, 4), (1, 5), (2, 4), (2, 5), (3, 5)]
    assert S.candidates_between(ids.limit(0), G.nodes_of(snap), snap).count() == 0


def test_metrics_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (0, 0.1), (1, 0.4)], "label int, score double")
    assert M.roc_auc(df).first()["auc"] == pytest.approx(0.625)
    assert M.roc_auc(df.where("label = 1")).first()["auc"] is None
    assert M.roc_auc(df.limit(0)).first()["auc"] is None
    assert M.confusion(df, [0.9]).first()["tp"] == 0 and M.confusion(df, [0.9], strict=False).first()["tp"] == 1
    assert {r["k"]: r["precision_at_k"] for r in M.at_k(df, [2, 100], [F.desc("score"), F.asc("label")]).collect()} == {2: 0.5, 100: 0.5}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], True), (1, [0.0, 1.0], False), (2, [2.0, 2.0], False)], "k int, v array<double>, exact boolean")
    assert {r["k"]: (r["vec"], r["n"]) for r in E.vector_means(df, "k", "v", 2, when=F.col("exact")).collect()} == {1: ([1.0, 0.0], 2), 2: ([2.0, 2.0], 1)}
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "id long, v array<double>")
    near = E.nearest(points.where("id IN (0, 5)"), points, "id", "v", 2, block=1)
    assert sorted((r["query"], r["rank"], r["neighbour"]) for r in near.collect()) == [(0, 1, 1), (0, 2, 2), (5, 1, 4), (5, 2, 6)]
    network = N.PairNetwork.of_sizes([2, 4, 1])
    x = np.array([[1.0, 2.0]])
    scored = N.score_pairs(spark.createDataFrame([([1.0, 2.0],)], "inputs array<double>"), network).first()["score"]
    assert scored == pytest.approx(float(network(x)[0, 0]))
    assert E.geometric_sizes(20, 0.5, 2) == [20, 10, 5, 1]


def test_trend(spark):
    points = spark.createDataFrame([(float(x), float(x) ** 3 - 2 * x) for x in range(2000, 2010)], "x double, y double")
    last = E.cubic_trend(points, "x", "y").orderBy(F.desc("x")).first()
    assert last["x"] == 2011 and last["fitted"] == pytest.approx(2011**3 - 2 * 2011, rel=1e-6)
