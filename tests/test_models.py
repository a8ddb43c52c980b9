"""Pair networks, graph layers, encoders, and runs that are watched until they are done."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import predicates as P
from corpusloom.operators import embeddings as E
from corpusloom.operators import extraction as X
from corpusloom.operators import models as N


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    network, x, y = N.PairNetwork.of_sizes([3, 5, 1], 2), rng.standard_normal((12, 3)), rng.integers(0, 2, 12).astype(float)
    _, gradients = network.step(x, y, 0.0, np.random.default_rng(0))
    for w, g in zip(network.layers, gradients):
        for name in ("weight", "scale", "shift"):
            at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
            kept, found = w[name][at], []
            for move in (1e-5, -1e-5):
                w[name][at] = kept + move
                found.append(network.step(x, y, 0.0, np.random.default_rng(0))[0])
            w[name][at] = kept
            assert g[name][at] == pytest.approx((found[0] - found[1]) / 2e-5, rel=1e-3, abs=1e-7)


def test_area_under_curve():
    rng = np.random.default_rng(3)
    labels, scores = rng.integers(0, 2, 200), rng.integers(0, 9, 200) / 9
    pairs = [(a > b) + (a == b) / 2 for a in scores[labels == 1] for b in scores[labels == 0]]
    assert N.area_under_curve(labels, scores) == pytest.approx(np.mean(pairs))
    assert np.isnan(N.area_under_curve(np.ones(3), np.ones(3)))


def ring_pairs(spark, n=3000):
    """A label that no single weight tells: whether the point lies near the circle of radius one."""
    rng = np.random.default_rng(5)
    points = rng.standard_normal((n, 2))
    inside = (np.abs(np.hypot(points[:, 0], points[:, 1]) - 1) < 0.35).astype(int)
    return spark.createDataFrame([(i, i + 1, [float(a), float(b)], int(c)) for i, ((a, b), c) in enumerate(zip(points, inside))], "u long, v long, inputs array<double>, label int")


def test_the_network_learns_what_a_logistic_model_cannot(spark):
    rows = ring_pairs(spark)
    train, check = rows.where("u % 3 > 0"), rows.where("u % 3 = 0")
    settings = N.Settings(hidden=(24, 12), batches=300, batch_rows=128, positive_share=0.5, rate=0.01)
    network, history = N.fit_pair_network(train, check, settings)
    again, _ = N.fit_pair_network(train, check, settings)
    held = check.toPandas()
    x = np.array(held["inputs"].tolist())
    found = N.area_under_curve(held["label"].to_numpy(), network(x)[:, 0])
    model = E.fit_pair_classifier(train)
    from pyspark.ml.functions import array_to_vector, vector_to_array

    logistic = model.transform(check.withColumn("features", array_to_vector("inputs"))).select("label", F.get(vector_to_array("probability"), 1).alias("p")).toPandas()
    assert found > 0.95 > 0.65 > N.area_under_curve(logistic["label"].to_numpy(), logistic["p"].to_numpy())
    assert np.array_equal(network(x), again(x)) and max(h["auc"] for h in history) == pytest.approx(found)


def test_training_stops_when_nothing_gets_better(spark):
    rows = ring_pairs(spark, 300)
    settings = N.Settings(batches=200, batch_rows=16, rate=0.0, check_every=5, patience=3)
    assert len(N.fit_pair_network(rows, rows, settings)[1]) == 4
    with pytest.raises(ValueError):
        N.fit_pair_network(rows.where("label = 1"), rows, settings)


def test_state_of_a_network(spark, tmp_path):
    settings, fitted = N.Settings(), []

    def fit():
        fitted.append(1)
        return N.PairNetwork.of_sizes([3, 4, 1])

    first = N.cached_or_fitted(spark, str(tmp_path / "m" / "net.json"), settings, fit)
    second = N.cached_or_fitted(spark, str(tmp_path / "m" / "net.json"), settings, fit)
    x = np.ones((2, 3))
    assert len(fitted) == 1 and np.array_equal(first(x), second(x))
    N.cached_or_fitted(spark, str(tmp_path / "m" / "net.json"), N.Settings(seed=8), fit)
    assert len(fitted) == 2
    with pytest.raises(ValueError):
        N.network_of_state(N.network_state(first, settings), N.Settings(seed=9))


def test_graph_layers_against_brute_force(spark):
    rng = np.random.default_rng(2)
    links = [(1, 2), (2, 3), (1, 3), (3, 4)]
    vectors = {i: rng.standard_normal(2) for i in range(1, 6)}
    layers = [{"own": rng.standard_normal((3, 2)), "around": rng.standard_normal((3, 2)), "bias": rng.standard_normal(3)}, {"own": rng.standard_normal((2, 3)), "around": rng.standard_normal((2, 3)), "bias": rng.standard_normal(2)}]
    near = {i: [b for a, b in links if a == i] + [a for a, b in links if b == i] for i in vectors}
    expected = vectors
    for k, layer in enumerate(layers):
        mean = {i: np.mean([expected[j] for j in near[i]], axis=0) if near[i] else np.zeros(len(expected[i])) for i in expected}
        expected = {i: layer["own"] @ expected[i] + layer["around"] @ mean[i] + layer["bias"] for i in expected}
        expected = {i: np.maximum(x, 0) for i, x in expected.items()} if k == 0 else expected
    nodes = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in vectors.items()], "id long, vec array<double>")
    edges = spark.createDataFrame(links, "u long, v long")
    found = N.sage_encode(nodes, edges, layers)
    for r in found.collect():
        np.testing.assert_allclose(r["vec"], expected[r["id"]], atol=1e-9)
    pairs = edges.withColumn("score", F.lit("clash"))
    dots = {(r["u"], r["v"]): r[-1] for r in N.decode_pairs(pairs.drop("score"), found).collect()}
    assert dots[1, 3] == pytest.approx(1 / (1 + np.exp(-expected[1] @ expected[3])))
    decoder = N.PairNetwork.of_sizes([8, 3, 1])
    mlp = {(r["u"], r["v"]): r["score"] for r in N.decode_pairs(edges, found, decoder).collect()}
    z = np.concatenate([expected[1], expected[3], np.abs(expected[1] - expected[3]), expected[1] * expected[3]])
    assert mlp[1, 3] == pytest.approx(float(decoder(z[None])[0, 0]))
    assert N.sampled_neighbours(edges, 1).count() == 4 and N.sampled_neighbours(edges, 9).count() == 8


def communities(spark, n=240, groups=4):
    """Nodes whose own vectors hardly tell their group, linked within it; pairs within a group are positives."""
    rng = np.random.default_rng(8)
    group = rng.integers(0, groups, n)
    centres = rng.standard_normal((groups, 6)) * 0.6
    nodes = spark.createDataFrame([(i, [float(x) for x in centres[g] + rng.standard_normal(6)]) for i, g in enumerate(group)], "id long, vec array<double>")
    links = sorted({(int(min(a, b)), int(max(a, b))) for a in range(n) for b in rng.choice(np.flatnonzero(group == group[a]), 8) if a != b})
    asked = rng.integers(0, n, (1500, 2))
    pairs = [(int(a), int(b), int(group[a] == group[b])) for a, b in asked if a != b]
    return nodes, spark.createDataFrame(links, "u long, v long"), spark.createDataFrame(pairs[:900], "u long, v long, label int"), spark.createDataFrame(pairs[900:], "u long, v long, label int")


def test_graph_layers_learn_communities(spark):
    nodes, edges, train, check = communities(spark)
    layers = N.fit_graph_layers(train, nodes, edges, sample=1024, steps=250)
    found = N.decode_pairs(check, N.sage_encode(nodes, edges, layers)).toPandas()
    alone = N.decode_pairs(check, nodes).toPandas()
    auc, before = (N.area_under_curve(x["label"].to_numpy(), x["score"].to_numpy()) for x in (found, alone))
    assert auc > 0.9 > before


def test_gradients_of_graph_layers():
    rng = np.random.default_rng(3)
    sides = [{"vec": rng.standard_normal(3).tolist(), "ring": [{"vec": rng.standard_normal(3).tolist(), "mean": rng.standard_normal(3).tolist()} for _ in range(k)]} for k in (0, 1, 2, 4, 3, 2)]
    u, v, y = N._Ends(sides[:3], 4), N._Ends(sides[3:], 4), np.array([1.0, 0.0, 1.0])
    layers = [{"own": rng.standard_normal((b, a)) / 3, "around": rng.standard_normal((b, a)) / 3, "bias": rng.standard_normal(b) / 3} for a, b in ((3, 4), (4, 2))]
    _, gradients = N.graph_step(u, v, y, layers)
    for w, g in zip(layers, gradients):
        for name in w:
            at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
            kept, moved = w[name][at], []
            for move in (1e-6, -1e-6):
                w[name][at] = kept + move
                moved.append(N.graph_step(u, v, y, layers)[0])
            w[name][at] = kept
            assert g[name][at] == pytest.approx((moved[0] - moved[1]) / 2e-6, rel=1e-3)


def test_text_classifiers(spark):
    labels = spark.createDataFrame([(i, f"{'bone' if i % 2 else 'skin'} graft {i}") for i in range(60)], "id long, concept string")
    pairs = spark.createDataFrame([(i, i + 2, i % 2) for i in range(58)], "u long, v long, label int")
    texts = N.label_texts(pairs, labels)
    assert texts.where("u = 3").first()["text"] == "bone graft 3 ; bone graft 5"
    model = N.fit_text_classifier(texts)
    assert model.transform(texts).where("prediction = label").count() == 58
    stand_in = lambda found: np.array([[1.0 - t.count("bone") / 2, t.count("bone") / 2] for t in found])
    assert {(r["label"], r["score"]) for r in N.score_texts(texts, stand_in, rows=7).collect()} == {(0, 0.0), (1, 1.0)}


def test_token_windows_and_close_phrases(spark):
    df = spark.createDataFrame([(1, "a bb ccc dddd eeeee"), (2, None), (3, ""), (None, "one")], "key long, text string")
    encoder = N.TrigramEncoder(size=8, window=2)
    rows = N.token_vectors(df, "key", "text", encoder).collect()
    assert [(r["window"], r["position"], r["token"]) for r in sorted(rows, key=lambda r: r["position"]) if r["key"] == 1] == [(0, 0, "a"), (0, 1, "bb"), (1, 2, "ccc"), (1, 3, "dddd"), (2, 4, "eeeee")]
    assert {r["key"] for r in rows} == {1, None} and all(np.linalg.norm(r["vec"]) == pytest.approx(1) for r in rows)
    text = spark.createDataFrame([(1, "Wear of hip implants: wear, implants, hips and implants."), (2, None)], "key long, text string")
    found = [r["phrase"] for r in N.close_phrases(text, "key", "text", N.TrigramEncoder(), k=3).orderBy("rank").collect()]
    assert found[0] == "implants" and len(found) == 3


def test_watch_goes_on_until_all_are_filled(spark, tmp_path):
    class Client:
        def complete(self, records):
            ids = [int(r["pmid"]) for r in records]
            if 13 in ids and len(ids) > 1 or 7 in ids:
                raise TimeoutError("slow")
            return json.dumps({"items": [{"pmid": str(i), "concepts": [f"label of {i}"]} for i in ids]})

    works = spark.createDataFrame([(i, '["old label"]' if i == 2 else None, "kept") for i in range(20)], "id long, concepts string, other string")
    out, rounds = X.watch(works, "id", "concepts", Client(), size=8, path=str(tmp_path / "w"))
    held = {r["id"]: r["concepts"] for r in out.collect()}
    assert held[2] == '["old label"]' and held[13] == '["label of 13"]' and held[7] is None and sum(v is None for v in held.values()) == 1
    assert rounds >= 3 and out.columns == ["id", "other", "concepts"]


def test_detectors(spark):
    detect = P.mostly_frequent_words(frozenset(["the", "of", "and"]))
    df = spark.createDataFrame([("the end of the day",), ("nur ein Satz",), ("123",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(P.detected_language(F.col("t"), detect)).collect()] == ["en", "unknown", "unknown", "unknown", None]
