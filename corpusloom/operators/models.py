"""Pair models: a feed-forward network with its training, graph layers with decoders, text classifiers, and their states.

Fitting goes over a bounded, documented sample of drawn batches; scoring goes over whole tables.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import both_ways
from .ordering import top_per_group
from .sampling import balanced_batch, pair_hash


@dataclass
class Settings:
    """Settings of a fit. ``batches * batch_rows`` rows are drawn with replacement, and ``check_rows`` held-out ones by hash; these bound the sample."""

    hidden: tuple[int, ...] = (32, 16)
    dropout: float = 0.1
    batches: int = 300
    batch_rows: int = 256
    positive_share: float = 0.3
    rate: float = 0.005
    rate_step: int = 100
    rate_factor: float = 0.5
    check_every: int = 25
    check_rows: int = 20_000
    patience: int = 4
    seed: int = 7

    def mark(self) -> str:
        return hashlib.sha256(json.dumps(self.__dict__, sort_keys=True).encode()).hexdigest()


def area_under_curve(labels: np.ndarray, scores: np.ndarray) -> float:
    """ROC AUC, ties count half; nan without both labels."""
    _, place, counts = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[place]
    pos = labels == 1
    n, p = len(labels), int(pos.sum())
    return float((rank[pos].sum() - p * (p + 1) / 2) / (p * (n - p))) if 0 < p < n else float("nan")


class PairNetwork:
    """Linear, batch norm, ReLU and dropout blocks; the last block is linear, batch norm and a sigmoid."""

    def __init__(self, layers: list[dict[str, np.ndarray]], epsilon: float = 1e-5):
        self.layers, self.epsilon = layers, epsilon

    @classmethod
    def of_sizes(cls, sizes: list[int], seed: int = 0) -> PairNetwork:
        """A network with reproducible weights, as a starting point."""
        rng = np.random.default_rng(seed)
        return cls(
            [
                {"weight": rng.uniform(-1, 1, (b, a)) / np.sqrt(a), "bias": rng.uniform(-1, 1, b) / np.sqrt(a), "mean": np.zeros(b), "var": np.ones(b), "scale": np.ones(b), "shift": np.zeros(b)}
                for a, b in zip(sizes, sizes[1:])
            ]
        )

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for i, w in enumerate(self.layers):
            x = x @ w["weight"].T + w["bias"]
            x = (x - w["mean"]) / np.sqrt(w["var"] + self.epsilon) * w["scale"] + w["shift"]
            if i + 1 < len(self.layers):
                x = np.maximum(x, 0)
        return 1 / (1 + np.exp(-x))

    def step(self, x: np.ndarray, labels: np.ndarray, dropout: float, rng: np.random.Generator, momentum: float = 0.1) -> tuple[float, list[dict[str, np.ndarray]]]:
        """Mean cross-entropy of a batch, in training mode, and the gradients; moves the running means and variances."""
        held, last = [], len(self.layers) - 1
        for i, w in enumerate(self.layers):
            entered = x
            z = x @ w["weight"].T + w["bias"]
            mean, var = z.mean(0), z.var(0)
            w["mean"] += momentum * (mean - w["mean"])
            w["var"] += momentum * (var * len(z) / max(len(z) - 1, 1) - w["var"])
            inverse = 1 / np.sqrt(var + self.epsilon)
            unit = (z - mean) * inverse
            x = unit * w["scale"] + w["shift"]
            kept = None
            if i < last:
                kept = (x > 0) * (rng.random(x.shape) >= dropout) / (1 - dropout)
                x = x * kept
            held.append((entered, unit, inverse, kept))
        p = 1 / (1 + np.exp(-x[:, 0]))
        loss = float(-np.mean(labels * np.log(np.maximum(p, 1e-12)) + (1 - labels) * np.log(np.maximum(1 - p, 1e-12))))
        d, gradients = ((p - labels) / len(labels))[:, None], []
        for w, (entered, unit, inverse, kept) in zip(reversed(self.layers), reversed(held)):
            d = d if kept is None else d * kept
            one = {"scale": (d * unit).sum(0), "shift": d.sum(0)}
            d = d * w["scale"]
            d = inverse * (d - d.mean(0) - unit * (d * unit).mean(0))
            one |= {"weight": d.T @ entered, "bias": d.sum(0)}
            d = d @ w["weight"]
            gradients.append(one)
        return loss, gradients[::-1]


def train_network(network: PairNetwork, batches: list[tuple[np.ndarray, np.ndarray]], check: tuple[np.ndarray, np.ndarray], settings: Settings) -> tuple[PairNetwork, list[dict]]:
    """Adam with a rate that falls in steps; returns the network with the best AUC on ``check`` and the history.

    Stops when ``patience`` checks one after another bring no better AUC.
    """
    rng = np.random.default_rng(settings.seed)
    names = ("weight", "bias", "scale", "shift")
    first, second = ([{k: np.zeros_like(w[k]) for k in names} for w in network.layers] for _ in range(2))
    best, best_auc, idle, history, losses = None, -1.0, 0, [], []
    for k, (x, labels) in enumerate(batches, 1):
        loss, gradients = network.step(x, labels, settings.dropout, rng)
        losses.append(loss)
        rate = settings.rate * settings.rate_factor ** ((k - 1) // settings.rate_step)
        for w, g, m, v in zip(network.layers, gradients, first, second):
            for name in names:
                m[name] += 0.1 * (g[name] - m[name])
                v[name] += 0.001 * (g[name] ** 2 - v[name])
                w[name] -= rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)
        if k % settings.check_every == 0 or k == len(batches):
            auc = area_under_curve(check[1], network(check[0])[:, 0]) if len(check[1]) else float("nan")
            history.append({"step": k, "loss": float(np.mean(losses)), "auc": auc})
            losses = []
            if best is None or auc > best_auc:
                best, best_auc, idle = PairNetwork([{n: a.copy() for n, a in w.items()} for w in network.layers]), auc, 0
            else:
                idle += 1
                if idle >= settings.patience:
                    break
    return best or network, history


def _arrays(df: DataFrame, inputs: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    rows = df.select(inputs, label).toArrow()
    width = len(rows[inputs][0]) if len(rows) else 0
    return np.array(rows[inputs].to_pylist(), np.float64).reshape(len(rows), width), rows[label].to_numpy().astype(np.float64)


def fit_pair_network(train: DataFrame, check: DataFrame, settings: Settings = Settings(), *, inputs: str = "inputs", label: str = "label", inputs_of: Callable[[DataFrame], DataFrame] | None = None) -> tuple[PairNetwork, list[dict]]:
    """A network fitted on class-balanced batches of ``train`` (u, v, inputs, label) and judged on ``check``.

    Both are bounded by ``settings``: the batches are drawn with replacement over the whole table, and the
    rows of ``check`` are those with the smallest hashes. Fails without rows of both labels. With
    ``inputs_of``, which adds ``inputs`` to (u, v, ...), only the rows that are drawn get their inputs.
    """
    n = settings.batches * settings.batch_rows
    keep = [inputs] if inputs_of is None else []
    keyed = train.select(F.struct("u", "v").alias("pair"), *keep, label)
    drawn = balanced_batch(keyed, "pair", label, n, settings.positive_share, settings.seed, keep=keep)
    if inputs_of is not None:
        drawn = inputs_of(drawn.select("draw", "pair.u", "pair.v", label))
    x, y = _arrays(drawn.orderBy(F.pmod(F.xxhash64("draw", F.lit(settings.seed)), F.lit(1 << 31)), "draw"), inputs, label)  # n rows
    few = check.orderBy(pair_hash(F.col("u"), F.col("v"), settings.seed), "u", "v").limit(settings.check_rows)
    few = few if inputs_of is None else inputs_of(few)
    network = PairNetwork.of_sizes([x.shape[1], *settings.hidden, 1], settings.seed)
    size = settings.batch_rows
    return train_network(network, [(x[i : i + size], y[i : i + size]) for i in range(0, n, size)], _arrays(few, inputs, label), settings)


def score_pairs(pairs: DataFrame, network: PairNetwork, inputs: str = "inputs", out: str = "score") -> DataFrame:
    """``pairs`` with the network's output for ``inputs``; the weights are sent to the tasks, they do not grow with the data."""
    shared = pairs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(shared.value(np.concatenate(x.to_numpy()).astype(np.float64, copy=False).reshape(len(x), -1))[:, 0] if len(x) else [], dtype="float64")

    return pairs.withColumn(out, scored(F.col(inputs)))


def network_state(network: PairNetwork, settings: Settings) -> dict:
    """The network as a JSON document, with the mark of the settings it was fitted with."""
    return {"settings": settings.mark(), "layers": [{k: v.tolist() for k, v in w.items()} for w in network.layers]}


def network_of_state(state: dict, settings: Settings) -> PairNetwork:
    """The network of a saved state; fails if it was fitted with other settings."""
    if state["settings"] != settings.mark():
        raise ValueError("the saved network was fitted with other settings")
    return PairNetwork([{k: np.array(v, np.float64) for k, v in w.items()} for w in state["layers"]])


#: Which inputs a model mode uses: node features, concept vectors.
MODES = {"baseline": (True, False), "pure_vectors": (False, True), "combined": (True, True)}


def mode_inputs(mode: str, features: list[str], vectors: list[str]) -> tuple[list[str], list[str]]:
    """Features and vectors that a mode keeps."""
    use_features, use_vectors = MODES[mode]
    return (features if use_features else []), (vectors if use_vectors else [])


# --- graph layers


def sampled_neighbours(edges: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """(id, other): at most ``most`` neighbours of each node, those with the smallest hashes; with all of them where there are fewer."""
    ways = both_ways(edges.select("u", "v")).distinct()
    return top_per_group(ways, ["id"], [pair_hash(F.col("id"), F.col("other"), seed), F.col("other")], most).select("id", "other")


def _dot(weights: np.ndarray, vector: Column) -> Column:
    """Matrix times vector as a column; the matrix is a literal."""
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in weights))
    return F.transform(rows, lambda row: F.aggregate(F.zip_with(row, vector, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))


def sage_layer(nodes: DataFrame, ways: DataFrame, layer: dict[str, np.ndarray], size: int, relu: bool) -> DataFrame:
    """(id, vec) after one layer: ``own`` times the node's vector plus ``around`` times the mean of its neighbours' plus ``bias``.

    ``ways`` is (id, other) in both directions; a node without neighbours has a mean of zeros. Means are
    aggregates of each place, summed before the shuffle.
    """
    near = ways.join(nodes.select(F.col("id").alias("other"), F.col("vec").alias("__v")), "other").groupBy("id").agg(F.array(*(F.avg(F.get("__v", i)) for i in range(size))).alias("__mean"))
    mean = F.coalesce("__mean", F.array_repeat(F.lit(0.0), size))
    total = F.zip_with(F.zip_with(_dot(layer["own"], F.col("vec")), _dot(layer["around"], mean), lambda a, b: a + b), F.array(*(F.lit(float(x)) for x in layer["bias"])), lambda a, b: a + b)
    return nodes.join(near, "id", "left").select("id", (F.transform(total, lambda x: F.greatest(x, F.lit(0.0))) if relu else total).alias("vec"))


def sage_encode(nodes: DataFrame, edges: DataFrame, layers: list[dict[str, np.ndarray]], most: int | None = None) -> DataFrame:
    """(id, vec) of all nodes after the layers, ReLU between them; over all neighbours, or over at most ``most`` of each node."""
    ways = both_ways(edges.select("u", "v")) if most is None else sampled_neighbours(edges, most)
    for i, layer in enumerate(layers):
        nodes = sage_layer(nodes, ways, layer, layer["own"].shape[1], i + 1 < len(layers))
    return nodes


def decode_pairs(pairs: DataFrame, encoded: DataFrame, decoder: PairNetwork | None = None) -> DataFrame:
    """``pairs`` with ``score``: the sigmoid of the dot product of both ends' vectors, or a network over both, their distance and their product."""
    out = pairs
    for end in ("u", "v"):
        out = out.join(encoded.select(F.col("id").alias(end), F.col("vec").alias(f"__{end}")), end)
    if decoder is None:
        dot = F.aggregate(F.zip_with("__u", "__v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return out.select(*pairs.columns, (1 / (1 + F.exp(-dot))).alias("score"))
    inputs = F.concat("__u", "__v", F.zip_with("__u", "__v", lambda a, b: F.abs(a - b)), F.zip_with("__u", "__v", lambda a, b: a * b))
    return score_pairs(out.select(*pairs.columns, inputs.alias("__inputs")), decoder, "__inputs").drop("__inputs")


def graph_samples(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """(label, u, v) with each end as (vec, ring): its vector and, of at most ``most`` neighbours, vector and mean of their own neighbours' vectors."""
    size = len((nodes.select("vec").first() or [[]])[0])
    ways = sampled_neighbours(edges, most, seed)
    mean = ways.join(nodes.select(F.col("id").alias("other"), F.col("vec").alias("__v")), "other").groupBy("id").agg(F.array(*(F.avg(F.get("__v", i)) for i in range(size))).alias("__mean"))
    whole = nodes.join(mean, "id", "left").select("id", "vec", F.coalesce("__mean", F.array_repeat(F.lit(0.0), size)).alias("mean"))
    rings = ways.join(whole.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.collect_list(F.struct("vec", "mean")).alias("ring"))  # ``most`` at most
    sides = whole.join(rings, "id", "left").select("id", F.struct("vec", F.coalesce("ring", F.array().cast("array<struct<vec:array<double>,mean:array<double>>>")).alias("ring")).alias("side"))
    out = pairs.select("label", "u", "v")
    for end in ("u", "v"):
        out = out.join(sides.select(F.col("id").alias(end), F.col("side").alias(f"{end}_side")), end)
    return out.select("label", F.col("u_side").alias("u"), F.col("v_side").alias("v"))


class _Ends:
    """Arrays of one end of sampled pairs: vectors (n, d), those of neighbours (n, k, d), the means around these (n, k, d), and how many there are."""

    def __init__(self, sides: list[dict], most: int):
        d = len(sides[0]["vec"]) if sides else 0
        self.own, self.near, self.around = np.array([s["vec"] for s in sides]).reshape(len(sides), d), np.zeros((len(sides), most, d)), np.zeros((len(sides), most, d))
        self.held = np.zeros((len(sides), most, 1))
        for i, s in enumerate(sides):
            for j, r in enumerate(s["ring"][:most]):
                self.near[i, j], self.around[i, j], self.held[i, j] = r["vec"], r["mean"], 1
        self.share = self.held / np.maximum(self.held.sum(1, keepdims=True), 1)

    def part(self, at: np.ndarray) -> _Ends:
        out = object.__new__(_Ends)
        for name, value in self.__dict__.items():
            setattr(out, name, value[at])
        return out


def _encode_ends(ends: _Ends, layers: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, tuple]:
    first, second = layers
    mean = (ends.near * ends.share).sum(1)
    a0 = ends.own @ first["own"].T + mean @ first["around"].T + first["bias"]
    a1 = ends.near @ first["own"].T + ends.around @ first["around"].T + first["bias"]
    h0, h1 = np.maximum(a0, 0), np.maximum(a1, 0)
    ring = (h1 * ends.share).sum(1)
    return h0 @ second["own"].T + ring @ second["around"].T + second["bias"], (mean, a0, a1, h0, ring)


def _end_gradients(ends: _Ends, layers: list[dict[str, np.ndarray]], kept: tuple, d: np.ndarray) -> list[dict[str, np.ndarray]]:
    (mean, a0, a1, h0, ring), second = kept, layers[1]
    d0 = d @ second["own"] * (a0 > 0)
    d1 = (d @ second["around"])[:, None] * ends.share * (a1 > 0)
    return [
        {"own": d0.T @ ends.own + np.einsum("nkh,nkd->hd", d1, ends.near), "around": d0.T @ mean + np.einsum("nkh,nkd->hd", d1, ends.around), "bias": d0.sum(0) + d1.sum((0, 1))},
        {"own": d.T @ h0, "around": d.T @ ring, "bias": d.sum(0)},
    ]


def graph_step(u: _Ends, v: _Ends, labels: np.ndarray, layers: list[dict[str, np.ndarray]]) -> tuple[float, list[dict[str, np.ndarray]]]:
    """Mean cross-entropy of pairs scored by the dot product of both ends, and the gradients of both layers."""
    (zu, ku), (zv, kv) = _encode_ends(u, layers), _encode_ends(v, layers)
    p = 1 / (1 + np.exp(-(zu * zv).sum(1)))
    loss = float(-np.mean(labels * np.log(np.maximum(p, 1e-12)) + (1 - labels) * np.log(np.maximum(1 - p, 1e-12))))
    d = ((p - labels) / len(labels))[:, None]
    both = zip(_end_gradients(u, layers, ku, d * zv), _end_gradients(v, layers, kv, d * zu))
    return loss, [{k: a[k] + b[k] for k in a} for a, b in both]


def fit_graph_layers(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, *, sizes: tuple[int, int] = (16, 8), most: int = 10, sample: int = 4096, steps: int = 300, rows: int = 256, rate: float = 0.01, positive_share: float = 0.5, seed: int = 7) -> list[dict[str, np.ndarray]]:
    """Two graph layers for :func:`sage_encode`, fitted to tell the labelled ``pairs`` apart by the dot product of their ends.

    ``sample`` pairs are drawn with replacement, ``positive_share`` of them linked ones, with at most
    ``most`` neighbours of each end; these bound what is gathered. Adam over batches of ``rows``.
    """
    keyed = pairs.select(F.struct("u", "v").alias("pair"), "label")
    drawn = balanced_batch(keyed, "pair", "label", sample, positive_share, seed).select("label", "pair.u", "pair.v")
    held = graph_samples(drawn, nodes, edges, most).toArrow().to_pylist()  # ``sample`` rows
    held.sort(key=lambda r: json.dumps(r))
    rng = np.random.default_rng(seed)
    u, v, labels = _Ends([r["u"] for r in held], most), _Ends([r["v"] for r in held], most), np.array([r["label"] for r in held], np.float64)
    widths = [u.own.shape[1], *sizes]
    layers = [{"own": rng.standard_normal((b, a)) / np.sqrt(a), "around": rng.standard_normal((b, a)) / np.sqrt(a), "bias": np.zeros(b)} for a, b in zip(widths, widths[1:])]
    first, second = ([{k: np.zeros_like(x) for k, x in w.items()} for w in layers] for _ in range(2))
    for k in range(1, steps + 1):
        at = rng.integers(0, len(labels), rows)
        _, gradients = graph_step(u.part(at), v.part(at), labels[at], layers)
        for w, g, m, s in zip(layers, gradients, first, second):
            for name in w:
                m[name] += 0.1 * (g[name] - m[name])
                s[name] += 0.001 * (g[name] ** 2 - s[name])
                w[name] -= rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(s[name] / (1 - 0.999**k)) + 1e-8)
    return layers


# --- text classifiers


def label_texts(pairs: DataFrame, labels: DataFrame, join: str = " ; ") -> DataFrame:
    """``pairs`` with ``text``: the labels of both ends, from ``labels`` (id, concept); pairs without both are left out."""
    out = pairs
    for end in ("u", "v"):
        out = out.join(labels.select(F.col("id").alias(end), F.col("concept").alias(f"__{end}")), end)
    return out.select(*pairs.columns, F.concat_ws(join, "__u", "__v").alias("text"))


def score_texts(pairs: DataFrame, classify: Callable[[list[str]], np.ndarray], text: str = "text", out: str = "score", rows: int = 256) -> DataFrame:
    """``pairs`` with the probability that an injected classifier gives to its second class; texts go to it in batches."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [np.asarray(classify(texts.iloc[i : i + rows].fillna("").tolist()), np.float64)[:, 1] for i in range(0, len(texts), rows)]
            yield pd.Series(np.concatenate(found) if found else [], dtype="float64")

    return pairs.withColumn(out, scored(F.col(text)))


def fit_text_classifier(pairs: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14, iterations: int = 20):
    """A logistic model over hashed words of the text, trained on the cluster; its ``transform`` adds ``probability``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    stages = [RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"\W+"), HashingTF(inputCol="__words", outputCol="__counts", numFeatures=features), LogisticRegression(featuresCol="__counts", labelCol=label, maxIter=iterations)]
    return Pipeline(stages=stages).fit(pairs)


# --- encoders of texts


@dataclass
class TrigramEncoder:
    """Vectors of texts by hashed letter trigrams; stands where no trained encoder is at hand, and shows what one must offer."""

    size: int = 64
    window: int = 510
    _cache: dict = field(default_factory=dict, repr=False)

    def tokens(self, text: str) -> list[str]:
        return text.split()

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in enumerate(texts):
            padded = f" {text.lower()} "
            for i in range(max(len(padded) - 2, 1)):
                mark = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")
                out[row, mark % self.size] += 1 if mark >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def encode_window(self, tokens: list[str]) -> np.ndarray:
        """One vector a token, which may depend on the others of its window."""
        return self.encode(tokens)


def token_vectors(df: DataFrame, key: str, text: str, encoder, rows: int = 64) -> DataFrame:
    """(``key``, window, position, token, vec) of all tokens of whole texts, by an injected encoder.

    ``encoder`` has ``window``, ``tokens(text)`` and ``encode_window(tokens)``; a text of more than
    ``window`` tokens goes to it in consecutive windows. Null and empty texts have no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(encoder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = shared.value
        for frame in frames:
            for one, body in zip(frame["key"], frame["text"]):
                tokens = coder.tokens(body) if body else []
                for start in range(0, len(tokens), coder.window):
                    part = tokens[start : start + coder.window]
                    yield pd.DataFrame({"key": [one] * len(part), "window": start // coder.window, "position": range(start, start + len(part)), "token": part, "vec": list(coder.encode_window(part))})

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInPandas(run, f"key {kind}, window int, position int, token string, vec array<double>").withColumnRenamed("key", key)


def close_phrases(df: DataFrame, key: str, text: str, encoder, k: int = 10, words: int = 1) -> DataFrame:
    """(``key``, rank, phrase, score): the ``k`` distinct phrases of ``words`` words whose vectors are closest to that of the text, ties by name."""
    shared = df.sparkSession.sparkContext.broadcast(encoder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for one, body in zip(frame["key"], frame["text"]):
                tokens = [t for t in (w.strip(".,;:!?()[]\"'").lower() for w in (body or "").split()) if t]
                phrases = sorted({" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)})
                if phrases:
                    vectors = shared.value.encode([*phrases, body])
                    scores = np.round(vectors[:-1] @ vectors[-1], 9)
                    rows += [(one, r, phrases[i], float(scores[i])) for r, i in enumerate(sorted(range(len(phrases)), key=lambda i: (-scores[i], phrases[i]))[:k], 1)]
            yield pd.DataFrame(rows, columns=["key", "rank", "phrase", "score"])

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInPandas(run, f"key {kind}, rank int, phrase string, score double").withColumnRenamed("key", key)


def cached_or_fitted(spark: SparkSession, path: str, settings: Settings, fit: Callable[[], PairNetwork]) -> PairNetwork:
    """The network saved at ``path`` if its settings are these, else a fitted one, which is saved there."""
    from corpusloom.sources.readers import read_state, write_state

    state = read_state(spark, path)
    if state is not None and state["settings"] == settings.mark():
        return network_of_state(state, settings)
    network = fit()
    write_state(spark, network_state(network, settings), path)
    return network
