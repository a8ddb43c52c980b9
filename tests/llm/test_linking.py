"""Linking of typed values to entries."""

from collections import Counter

import pytest

from corpusloom.llm import linking as L

ENTRIES = ["fistula formation", "bronchial fistula formation", "hyperkalemia after transfusion", "hypokalemia after transfusion", "pediatric tumor resection", "grade 2 splenic injury", "grade 3 splenic injury", "serum α-fetoprotein level", "abduction splint", "adduction splint", "gastric nerve monitoring", "stainless steel coating"]


def index_of(entries, threshold=0.55):
    forms = [L.normal_form(e) for e in entries]
    numbers = {"".join(c for c in "".join(w) if c.isdigit()) for w in forms}
    return L.ReferenceIndex(list(enumerate(forms)), L.gram_counts(map("".join, forms)), len(forms), numbers, threshold=threshold, most_errors=3)


def test_known_numbers_only_spare_work(vocabulary):
    with_numbers, without = index_of(ENTRIES), index_of(ENTRIES)
    without.numbers = None
    forms = [L.normal_form(v) for v in ("grade 2 splenic injury", "grade 4 splenic injury", "grade 23 splenic injury", "fistula formation 2", "hyperkalemia aftr transfusion")]
    assert with_numbers.found(forms, vocabulary.facts) == without.found(forms, vocabulary.facts)


def resolve(index, value, vocabulary):
    return L.decide(index.found([L.normal_form(value)], vocabulary.facts)[0], 0.02)


@pytest.fixture(scope="module")
def index():
    return index_of(ENTRIES)


@pytest.fixture(scope="module")
def vocabulary(index):
    return L.Vocabulary(w for ws in index.words for w in ws)


@pytest.mark.parametrize(
    ("value", "entry"),
    [
        ("Bronchial Fistula Formations", 1), ("fistula formation, bronchial", 1), ("bronchial ﬁstula_formation (BFF)", 1), ("“brónchial fistula  formation”.", 1), ("bronchiаl fistula formation", 1), ("broncial fistula fromation", 1),
        ("bronchialfistula formation", 1), ("a case of bronchial fistula formation", 1), ("acase of paediatric tumour resections", 4), ("hypokalaemia after transfusion", 3), ("grade III splenic injury", 6), ("gradeiii splenic injury", 6),
        ("serum alpha-fetoprotein level", 7), ("serum β-fetoprotein level", None), ("grade 4 splenic injury", None), ("hyperkalemia", None), ("gastric fistula formation", None), ("aduction splint", None), ("bone defect", None),
        ("steel coating, stainless", 11), ("(fistula formation)", 0), ("bronchial fistula", None), ("", None), ("???", None),
    ],
)
def test_values(index, vocabulary, value, entry):
    assert resolve(index, value, vocabulary) == entry


def brute(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                rows[i][j] = i + j
                continue
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def test_typing_errors_against_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(2))
        assert L.typing_errors(a, b, 3) == min(brute(a, b), 4)


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.9])
def test_candidates_against_brute_force(threshold):
    """All pairs whose cosine reaches the threshold, and no others, come out of the index."""
    import random

    import numpy as np

    rng, index = random.Random(4), index_of(ENTRIES, threshold)
    for _ in range(150):
        texts = []
        for _ in range(5):
            text = list(rng.choice(index.joined))
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice("abcdefghijklmnopqrstuvwxyz")
            texts.append("".join(text))
        letters, of, gram = L._letters_and_grams(texts)
        query, entry, cosine = index.candidates(letters, np.array([len(t) for t in texts]), of, gram)
        found = {(q, e): c for q, e, c in zip(query.tolist(), entry.tolist(), cosine.tolist())}
        for q, text in enumerate(texts):
            held = set(gram[of == q].tolist())
            for e, other in enumerate(index.joined):
                own = set(index.grams[index.grams_start[e] : index.grams_start[e + 1]].tolist())
                norms = [sum(index.weight[g] ** 2 for g in x) ** 0.5 for x in (held, own)]
                cos = sum(index.weight[g] ** 2 for g in held & own) / max(norms[0] * norms[1], 1e-9)
                if Counter(filter(str.isdigit, text)) == Counter(filter(str.isdigit, other)) and abs(cos - threshold) > 1e-6 and abs(len(text) - len(other)) <= 3 and sum((Counter(text) - Counter(other)).values()) + sum((Counter(other) - Counter(text)).values()) <= 6:
                    assert ((q, e) in found) == (cos >= threshold)
                    assert (q, e) not in found or found[q, e] == pytest.approx(cos)


def test_decision():
    c = L.Candidate
    assert L.decide([], 0.02) is None
    assert L.decide([c(0.9, 2, 1), c(0.8, 1, 2)], 0.02) == 1  # the cosine decides beyond the margin
    assert L.decide([c(0.9, 2, 1), c(0.89, 1, 2)], 0.02) == 2  # the errors decide within it
    assert L.decide([c(0.9, 1, 1), c(0.89, 1, 2)], 0.02) is None


def test_an_entry_with_other_words_does_not_stand_before_the_right_one():
    entries = ["renal wound dehiscence", "duodenal wound dehiscence", "renal ischemia", "wound dehiscence grade"]
    index = index_of(entries)
    words = L.Vocabulary(w for ws in index.words for w in ws)
    assert resolve(index, "dudenal wound dehiscence", words) == 1 and resolve(index, "renl wound dehiscence", words) == 0


def test_facts_of_parts_of_a_vocabulary(vocabulary):
    words = sorted(vocabulary.words)
    for parts in (1, 2, 5):
        dealt = [L.Vocabulary(words[k::parts]) for k in range(parts)]
        for word in ["fistula", "fistla", "aduction", "postoperatively", "bronchialfistula", "xy", "serumlevel"]:
            assert L.merged_facts(v.facts(word) for v in dealt) == vocabulary.facts(word)


def test_the_number_of_blocks_does_not_matter(spark):
    """Equal normal forms, ties and weights are those of the whole list, however it is dealt."""
    import random

    rng = random.Random(7)
    entries = [*ENTRIES, "tumour marker", "tumor marker", "tumor marked", "tumor barker"] + [f"{a} {b} repair" for a in ("gastric", "pastric", "hepatic", "cardiac") for b in ("wall", "vein", "duct", "fall")]
    values = {"tumor markr", "tumor marker", "gastric vall repair", "aduction splint"}
    for _ in range(300):
        text = list(rng.choice(entries))
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = rng.choice("abcdefghijklmnopqrstuvwxyz ")
        values.add("".join(text))
    reference = spark.createDataFrame(list(enumerate(entries, 1)), "id long, concept string")
    table = spark.createDataFrame([(v,) for v in sorted(values)], "label string")
    results = []
    for options in ({}, {"block_entries": 20}, {"block_entries": 5}, {"words_broadcast": 9}, {"words_broadcast": 9, "block_entries": 15}):
        out = L.link_values(table, reference, value="label", entry="concept", entry_id="id", **options)
        results.append({r["label"]: r["ref_id"] for r in out.collect()})
    assert len(results[0]) == len(values) and len([x for x in results[0].values() if x]) > 150
    assert results[0]["tumor markr"] == 13 and all(r == results[0] for r in results[1:])


@pytest.mark.parametrize("options", [{}, {"block_entries": 3}])
def test_mentions(spark, options):
    reference = spark.createDataFrame([(i, e, "x") for i, e in enumerate(ENTRIES)] + [(None, "no id", "x"), (99, None, "x"), (50, "Fistula Formation", "x")], "id long, concept string, ref_id string")
    rows = [(1, "fistula formation"), (1, "Fistula formations"), (1, "Fistula formations"), (2, "nothing known"), (3, None), (4, "x" * 100_000), (5, "hyperkalaemia after transfusion"), (6, "-")]
    mentions = spark.createDataFrame([(*r, "clash") for r in rows], "pmid long, label string, value string")
    for hot_rows, broadcast_rows in ((1, 200_000), (1000, 200_000), (1, 2), (1000, 2)):
        out = L.link_mentions(mentions, reference, record="pmid", value="label", entry="concept", entry_id="id", hot_rows=hot_rows, broadcast_rows=broadcast_rows, **options)
        assert sorted((r["pmid"], r["label"][:40], r["ref_id"]) for r in out.collect()) == [(1, "Fistula formations", 0), (2, "nothing known", -1), (4, "x" * 40, -1), (5, "hyperkalaemia after transfusion", 2), (6, "-", -1)]
    assert L.link_mentions(mentions.limit(0), reference, record="pmid", value="label", entry="concept", entry_id="id").count() == 0
    empty = L.link_mentions(mentions, reference.limit(0), record="pmid", value="label", entry="concept", entry_id="id")
    assert {r["ref_id"] for r in empty.collect()} == {-1}
