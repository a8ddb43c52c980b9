"""Encoding, mixing, languages and stuffed pages."""

import base64
import random
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, language, mixing, stuffing
from corpusloom.llm.bigru import ByteLabeller

TIKTOKEN = f"{bpe.DEFAULT_DIR}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoder():
    return bpe.PrefixEncoder(bpe.load_vocabulary())


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TIKTOKEN, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(encoder, reference):
    rng = random.Random(1)
    pools = ["abcdeinotrsh '", "".join(map(chr, range(32, 0x250))), "漢字仮名かなКирилица😀👍🏽 \n\t", "=-_ .01234<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60)))
        ids = encoder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert b"".join(encoder.tokens[i] for i in ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, " " * 9_000, "=-" * 8_000, "aaab" * 5_000])
def test_long_pieces(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


def test_bounded_memory_does_not_change_ids(encoder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 3)
    text = "Conversion from laparoscopic resection to open repair was required in 84.3% of cases. " * 3
    assert bpe.PrefixEncoder(bpe.load_vocabulary()).encode(text) == reference.encode_ordinary(text)


def test_encode_table(spark, encoder):
    df = spark.createDataFrame([(1, "two words", "x"), (2, None, "x"), (3, "", "x"), (1, "two words", "x"), (None, " ", "x")], "key long, text string, ids string")
    out = sorted(((r["key"] or 0, r["ids"]) for r in bpe.encode_texts(df, "key", "text").collect()))
    assert out == [(0, encoder.encode(" ")), (1, encoder.encode("two words")), (1, encoder.encode("two words")), (2, []), (3, [])]
    assert bpe.encode_texts(df.limit(0), "key", "text").count() == 0
    counts = {(r["key"], r["n_tokens"]) for r in bpe.count_tokens(df, "text").collect()}
    assert (2, 0) in counts and (1, 2) in counts


def mixture(spark):
    docs = spark.createDataFrame([(i, "big" if i % 10 else "small", "some words of text here", i) for i in range(1000)] + [(5000, "gone", "x", 1), (5001, None, "y", 1), (5002, "small", None, 1)], "doc long, feed string, body string, copy_no long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 9)], "source string, target_share double, max_repeats int")
    return docs, targets, {"key": "doc", "source": "feed", "text": "body"}


def test_mixture_reaches_shares_within_caps(spark):
    docs, targets, names = mixture(spark)
    shares = {r["source"]: r for r in mixing.mixture_shares(docs, targets, **names).collect()}
    assert set(shares) == {"big", "small", "absent", "gone", None}
    assert shares["small"]["rate"] == pytest.approx(3.0) and shares["big"]["rate"] < 1
    assert shares["big"]["actual_share"] == pytest.approx(5 / 9, abs=0.04) and shares["absent"]["actual_share"] == 0
    assert shares["big"]["attainable_share"] == pytest.approx(5 / 9) and shares["small"]["attainable_share"] == pytest.approx(4 / 9) and shares["absent"]["attainable_share"] == 0
    out = mixing.mix(docs, targets, **names)
    assert out.columns == ["doc", "feed", "body", "copy_no"]
    copies = {r["doc"]: r["count"] for r in out.groupBy("doc").count().collect()}
    assert max(copies.values()) == 3 and 5000 not in copies and 5001 not in copies
    assert sorted(map(tuple, out.select("doc", "copy_no").collect())) == sorted(map(tuple, mixing.mix(docs, targets, **names).select("doc", "copy_no").collect()))


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    docs, targets, names = mixture(spark)
    rows = sorted(map(tuple, mixing.mix(docs, targets, **names).select("doc", "copy_no").collect()))
    monkeypatch.setattr(mixing, "TARGETS_BROADCAST", 1)
    monkeypatch.setattr("corpusloom.operators.skewed.hot_keys", lambda df, key, _, f=mixing.skew_join.__globals__["hot_keys"]: f(df, key, 500))
    assert sorted(map(tuple, mixing.mix(docs, targets, **names).select("doc", "copy_no").collect())) == rows


def test_a_vocabulary_without_a_byte_fails():
    vocabulary = {"tokens": [b"a", b"b"], "left": np.array([-1, -1]), "right": np.array([-1, -1])}
    assert bpe.PrefixEncoder(vocabulary).encode("abba") == [0, 1, 1, 0]
    with pytest.raises(ValueError):
        bpe.PrefixEncoder(vocabulary).encode("abc")


def test_mixture_of_a_given_size_and_of_nothing(spark):
    docs, targets, names = mixture(spark)
    shares = {r["source"]: r for r in mixing.mixture_shares(docs, targets, total_tokens=10**9, **names).collect()}
    assert (shares["big"]["rate"], shares["small"]["rate"]) == (1.0, 3.0)
    assert mixing.mix(docs.limit(0), targets, **names).count() == 0
    assert mixing.mix(docs, targets.limit(0), **names).count() == 0


SENTENCES = {
    "en": ["The hardness of the alloy was measured after the third cycle.", "We show that the results depend on the cooling rate.", "However, no relation was found between the two values."],
    "de": ["Die Härte der Legierung wurde nach dem dritten Zyklus gemessen.", "Wir zeigen, dass die Ergebnisse von der Kühlrate abhängen.", "Es wurde jedoch kein Zusammenhang zwischen den Werten gefunden."],
    "ru": ["Твёрдость сплава измеряли после третьего цикла.", "Мы показали, что результаты зависят от скорости охлаждения.", "Однако связи между значениями не обнаружено."],
}


@pytest.fixture(scope="module")
def model():
    sample = [(" ".join(SENTENCES[lang][(i + k) % 3] for k in range(2)), lang) for lang in SENTENCES for i in range(30)]
    sample += [(SENTENCES["en"][i % 3], "de") for i in range(2)]  # wrong labels
    return language.fit_labeller(sorted(sample), hidden=16, rounds=(90, 60))


def test_gradients():
    rng = np.random.default_rng(0)
    net = ByteLabeller.fresh(["a", "b"], 4, rng)
    codes, targets = rng.integers(0, 9, (6, 3)).astype(np.uint8), rng.integers(0, 2, (6, 3))
    _, gradients = net.step(codes, targets)
    for array, gradient in zip(net.arrays(), gradients):
        spot = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        kept = array[spot]
        array[spot] = kept + 1e-2
        up, _ = net.step(codes, targets)
        array[spot] = kept - 1e-2
        down, _ = net.step(codes, targets)
        array[spot] = kept
        assert gradient[spot] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4)


def test_languages_and_segments(spark, model):
    mixed = f"{SENTENCES['en'][0]} {SENTENCES['ru'][1]} {SENTENCES['en'][1]}"
    long = " ".join(SENTENCES["de"] * 60)
    rows = [("a", SENTENCES["de"][0]), ("b", mixed), ("c", None), ("d", ""), ("e", "  "), ("f", long), ("g", f"{SENTENCES['en'][0]} Keywords: сплав, твёрдость"), ("a", SENTENCES["de"][0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, body string, confidence int")
    out = {r["lang_key"]: r for r in language.label_languages(df.withColumnRenamed("lang", "lang_key"), "lang_key", "body", model).collect()}
    assert {k: r["lang"] for k, r in out.items()} == {"a": "de", "b": "en", "c": None, "d": None, "e": None, "f": "de", "g": "en"}
    assert [(s["lang"], s["sentences"]) for s in out["b"]["segments"]] == [("en", 1), ("ru", 1), ("en", 1)]
    assert [mixed[s["start"] : s["stop"]].strip() for s in out["b"]["segments"]] == [SENTENCES["en"][0], SENTENCES["ru"][1], SENTENCES["en"][1]]
    assert all(s["stop"] <= len(long) for s in out["f"]["segments"]) and out["f"]["segments"][-1]["stop"] == len(long)
    assert 0.5 < out["a"]["confidence"] <= 1


def test_blocks_of_a_long_text_do_not_change_labels(model):
    text = " ".join(f"{SENTENCES[lang][i % 3]} “Quoted {i} words.”" for i in range(40) for lang in ("en", "ru", "de")[: 1 + i % 3])
    [whole], [dealt] = (language.label_texts(model, [text], most) for most in (1 << 30, 100))
    assert [{k: v for k, v in s.items() if k != "confidence"} for s in whole[2]] == [{k: v for k, v in s.items() if k != "confidence"} for s in dealt[2]]
    assert whole[0] == dealt[0] and whole[1] == pytest.approx(dealt[1], abs=1e-6) and len(whole[2]) > 20
    [p] = model.log_probabilities([text.encode()])
    for block in (7, 1000, 1 << 20):
        parts = list(model.long_probabilities(text.encode(), block))
        assert [s for s, _ in parts] == list(range(0, len(text.encode()), block))
        np.testing.assert_allclose(np.concatenate([x for _, x in parts]), p, atol=1e-4)


def test_repeated_rows_are_labelled_once(spark, model, monkeypatch):
    monkeypatch.setattr(language, "SEEN_ROWS", 2)
    rows = [("a", SENTENCES["de"][0]), ("a", SENTENCES["de"][1]), ("b", SENTENCES["ru"][0]), (None, SENTENCES["en"][0]), ("c", None)] * 50
    out = language.label_languages(spark.createDataFrame(rows, "id string, body string").repartition(3), "id", "body", model).collect()
    assert sorted((r["id"] or "", r["lang"] or "") for r in out) == [("", "en"), ("a", "de"), ("a", "de"), ("b", "ru"), ("c", "")]


def test_long_quotations_are_no_sentences(model):
    quoted = f"{SENTENCES['en'][0]} It is called “{' '.join(s.rstrip('.') for s in SENTENCES['ru'] * 5)}” in the text of the law."
    [(lang, _, segments)] = language.label_texts(model, [quoted])
    assert lang == "en" and [s["lang"] for s in segments if s["sentences"]] == ["en"]
    start = time.time()
    language.label_texts(model, ['"a' * 100_000, "“a" * 50_000, ". " * 100_000])
    assert time.time() - start < 60


def test_no_model_and_no_rows(spark, model):
    df = spark.createDataFrame([("a", "text")], "id string, body string")
    assert language.label_languages(df, "id", "body", None).first()["lang"] is None
    assert language.label_languages(df.limit(0), "id", "body", model).count() == 0
    assert language.fit_labeller([]) is None and language.fit_labeller([("no", "en")]) is None


@pytest.mark.parametrize(("label", "code"), [("en", "en"), ("EN_us", "en"), ("ger", "de"), ("Portuguese", "pt"), ("zh-Hans", "zh"), ("und", None), ("", None), (None, None), ("enx", None)])
def test_names_of_languages(spark, label, code):
    assert spark.createDataFrame([(label,)], "x string").select(language.named_language(F.col("x"))).first()[0] == code


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(f"Text number {i} about nothing much.", "en" if i % 9 else "de") for i in range(900)], "t string, l string")
    sample = language.labelled_sample(df, "t", F.col("l"), per_language=20)
    assert sample == language.labelled_sample(df, "t", F.col("l"), per_language=20)
    assert {lang: sum(x[1] == lang for x in sample) for lang in ("en", "de")} == {"en": 20, "de": 20}
    often = df.union(spark.range(20_000).select(F.lit("One text that comes very often indeed.").alias("t"), F.lit("de").alias("l"))).union(spark.createDataFrame([("x" * 30_000, "de")], "t string, l string"))
    sample = language.labelled_sample(often, "t", F.col("l"), per_language=20)
    assert sum(x[1] == "de" for x in sample) == 20 and max(len(x[0]) for x in sample) <= language.SAMPLE_CHARS


TALK = "The patients were seen again after six weeks, and none of them had any pain. We could not explain why the others had more of it. "
PAGES = [
    (TALK, False), (TALK.upper(), False), ("hip implant | knee brace | hip implant | bone screw\n" * 9, True), ("hip implant for hip implant and hip implant. " * 9, True), ("https://a.example/x?id=1\n" * 9, True),
    (" ".join(f"#tag{i}" for i in range(40)), True), ("\n".join(f"bone screw {i}.5 mm SKU 88{i} EUR {i}" for i in range(20)), True), (TALK * 3 + "Keywords: pain, delirium, blood loss", False),
    (TALK + "[cheap mesh](http://b.example/mesh) " * 20, True), (TALK * 4 + " (see http://b.example/mesh)", False), ("结果表明，硬度在很大程度上取决于冷却速度。将样品加热到五百开，然后用电子显微镜进行观察。", False),
]


def corpus(spark, rows):
    """``rows`` of (id, body) in a corpus of talk, with a column whose name clashes."""
    talk = [(1000 + i, " ".join(SENTENCE.format(i * k % 83 + 12, "abcdefg"[i % 7], "knee hip spine wrist ankle".split()[k % 5]) for k in range(1, 5))) for i in range(60)]
    return spark.createDataFrame([(*r, "x") for r in [*rows, *talk]], "id long, body string, flagged string")


SENTENCE = "Of the {} patients seen in ward {}, none had pain in the {} after the second week of the trial."


def test_pages(spark):
    out = {r["id"]: r for r in stuffing.page_shapes(corpus(spark, [(i, t) for i, (t, _) in enumerate(PAGES)]), "id", "body").collect()}
    assert [out[i]["flagged"] for i in range(len(PAGES))] == [flagged for _, flagged in PAGES]
    assert not any(r["flagged"] for i, r in out.items() if i >= 1000)


def test_page_table(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "<p></p>"), (5, "hip implant; " * 200_000), (5, TALK), (None, TALK)]
    df = corpus(spark, rows)
    out = [r for r in stuffing.page_shapes(df, "id", "body").collect() if (r["id"] or 0) < 1000]
    assert len(out) == len(rows) and [r["id"] for r in out if r["flagged"]] == [5]
    assert {r["id"]: r["outside_share"] for r in out if r["id"] in (1, 2, 3, 4)} == {1: None, 2: None, 3: None, 4: 0.0}
    assert stuffing.page_shapes(df.limit(0), "id", "body").count() == 0


def test_corpus_shapes_count_everything(spark):
    lines = stuffing.line_shapes(corpus(spark, [(1, "hip implant | knee brace\nhttps://a.example/x"), (2, None)]), "id", "body")
    shapes = stuffing.corpus_shapes(lines).collect()
    assert sum(r["segments"] for r in shapes) == 60 * 4 + 2 and sum(r["segments"] for r in shapes if r["sentences"]) == 240
    assert len({r["shape"] for r in shapes}) == len(shapes) <= stuffing.N_SHAPES + 1
    assert stuffing.Shape(4, 4, 2, 1, 1, 1, 1, 1).code == stuffing.N_SHAPES - 1


@pytest.mark.parametrize("text", ["[" * 300_000, "[a](" * 100_000, "<a " * 100_000, "<" + " " * 300_000, "a." * 200_000, "#" * 300_000, "<a>x" * 100_000, '."' * 200_000, "? " * 200_000, "(see [x](" + "y" * 300_000 + ")"])
def test_scanning_is_linear(text):
    start = time.time()
    sizes, _ = stuffing.shape_sizes(text)
    assert time.time() - start < 5 and sum(sizes.values()) <= len(text)


def test_long_links_are_links():
    address = "https://a.example/" + "x" * 5000
    assert stuffing.shape_sizes(f"[{'shop ' * 400}]({address})")[0] == {None: 2000 + len(address) + 4}
    assert stuffing.shape_sizes(f'<a href="{address}">{"<b>buy</b> " * 400}</a>')[1][None] == 1


def test_import_only_here():
    import pathlib

    root = pathlib.Path(sys.modules["corpusloom"].__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "corpusloom.llm" in p.read_text()]
