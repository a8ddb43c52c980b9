"""Copies, co-occurrence and consensus against brute force, with hot keys, nulls, repeats and clashing names."""

import ast
import itertools
import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import copies as C
from corpusloom.llm.consensus import annotator_consensus, cell_keys
from corpusloom.llm.labels import decode_labels, letters_digits
from corpusloom.llm.p_queries import oracle_sql, queries
from corpusloom.llm.together import baskets_of, pairs_together
from tests.oracle import assert_equal, connection

NOTATIONS = [
    ('["a b", "c"]', ["a b", "c"]), ("['it\\'s', \"x y\"]", ["it's", "x y"]), ('{"concepts": ["a", "\\u00e9"]}', ["a", "é"]), ('  [ ]', []), ("{}", []), (None, []), ("", []), ("  ", []), ("a ; b,c ;", ["a", "b,c"]),
    ("a | b", ["a", "b"]), ("x, y", ["x", "y"]), ("single", ["single"]), ("[broken, list", ["[broken", "list"]), ('["dup", "dup"]', ["dup", "dup"]), ("['\\xa0a', 'b\\\\c']", ["a", "b\\c"]),
]


@pytest.mark.parametrize(("text", "labels"), NOTATIONS)
def test_notations(spark, text, labels):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(decode_labels(F.col("v"))).first()[0] == labels


def test_python_notation_as_python_reads_it(spark):
    for value in (["plain", "it's", 'say "x"', "tab\tend", "ü–", "back\\slash"],):
        assert spark.createDataFrame([(repr(value),)], "v string").select(decode_labels(F.col("v"))).first()[0] == [x.strip() for x in ast.literal_eval(repr(value))]
        assert spark.createDataFrame([(json.dumps(value),)], "v string").select(decode_labels(F.col("v"))).first()[0] == value


def works(spark):
    forms = ['["A b", "c"]', "C; a-B", "['c', 'A  B.']", "c, c, ab", None, "", "[]", "...", '["ab","c"]']
    rows = [(i, forms[i % len(forms)], "x") for i in range(60)] + [(3, forms[3], "again"), (None, forms[0], "no id")]
    return spark.createDataFrame(rows, "pmid long, v string, record string"), forms


@pytest.mark.parametrize("hot_rows", [2, 15, 10_000])
def test_copies_against_brute_force(spark, hot_rows):
    df, forms = works(spark)
    classes, members = C.collapse_copies(df, "pmid", C.label_multiset_key(df["v"]), hot_rows=hot_rows, salts=3)
    groups = defaultdict(set)
    same = {0: "abc", 1: "abc", 2: "abc", 8: "abc", 3: "abcc"}
    for i in range(60):
        if i % len(forms) in same:
            groups[same[i % len(forms)]].add(i)
    assert sorted((r["representative"], r["copies"]) for r in classes.collect()) == sorted((min(g), len(g)) for g in groups.values())
    pairs = sorted(tuple(r) for r in C.copy_pairs(members, classes, block_records=5, salts=3).collect())
    assert pairs == sorted(p for g in groups.values() for p in itertools.combinations(sorted(g), 2))


def test_copies_of_nothing(spark):
    df, _ = works(spark)
    classes, members = C.collapse_copies(df.limit(0), "pmid", C.label_multiset_key(df["v"]))
    assert classes.count() == 0 and C.copy_pairs(members, classes).count() == 0


def test_a_class_of_a_hundred_thousand(spark):
    """A third of all records in one class, and other large ones: every block pair meets once, in tasks of bounded size."""
    n = 100_000
    df = spark.range(3 * n).select(F.col("id").alias("pmid"), F.when(F.col("id") < n, "one; class").when(F.col("id") < n + 9000, "another").otherwise(F.col("id").cast("string")).alias("v"))
    classes, members = C.collapse_copies(df, "pmid", C.label_multiset_key(df["v"]), hot_rows=1000)
    assert sorted(tuple(r) for r in classes.where("copies > 1").select("representative", "copies").collect()) == [(0, n), (n, 9000)]
    assert C.class_members(members, classes, least=2).groupBy("representative").count().count() == 2
    assert C.copy_pairs(members, classes).count() == n * (n - 1) // 2 + 9000 * 8999 // 2


def test_more_hot_keys_than_are_broadcast(spark):
    df = spark.range(400).select(F.col("id").alias("pmid"), (F.col("id") % 9).cast("string").alias("v"))
    classes, members = C.collapse_copies(df, "pmid", df["v"], hot_rows=10, salts=3, broadcast_rows=2)
    assert sorted((r["representative"], r["copies"]) for r in classes.collect()) == [(k, len(range(k, 400, 9))) for k in range(9)]
    assert C.class_members(members, classes, salts=3, broadcast_rows=2).where("record % 9 = representative").count() == 400


def test_a_basket_of_fifty_thousand_items(spark):
    """Only items that other baskets have too can be in a pair; the large basket is dealt to blocks."""
    rows = spark.range(50_000).select(F.lit(0).alias("b"), F.col("id").alias("i")).union(spark.range(400).select((F.col("id") % 2 + 1).alias("b"), (F.col("id") * 100).alias("i")))
    baskets = baskets_of(rows, "b", "i")
    assert baskets.where("basket = 0").agg(F.max("blocks"), F.sum(F.size("items"))).first()[0] == 49
    found = {(r["item_a"], r["item_b"]): r["n_ab"] for r in pairs_together(baskets, min_baskets=2).collect()}
    held = [{x * 100 for x in range(400) if x % 2 == k} for k in (0, 1)]
    assert found == {p: 2 for h in held for p in itertools.combinations(sorted(h), 2)}


def test_entries_of_a_large_lookup(spark):
    from corpusloom.llm.p_queries import _entries_of

    named = spark.createDataFrame([(i, f"k{i % 4}") for i in range(40)] + [(99, "none"), (None, "k1")], "pmid long, key string")
    lookup = spark.createDataFrame([("k1", 1), ("k1", 11), ("k3", 3)], "key string, lookup_id long")
    sets = [{(r["basket"], tuple(r["items"])) for r in baskets_of(_entries_of(named, lookup, n), "pmid", "lookup_id").collect()} for n in (1, 100)]
    assert sets[0] == sets[1] and len(sets[0]) == 41


@pytest.mark.parametrize("list_items", [2, 3, 1000])
def test_large_baskets_against_brute_force(spark, list_items):
    rows = [(b, (b * k * k) % 23) for b in range(12) for k in range(1, 12)] + [(b, None) for b in range(20)]
    baskets = baskets_of(spark.createDataFrame(rows, "b long, i long"), "b", "i", list_items=list_items, broadcast_rows=3)
    held = defaultdict(set)
    for b, i in rows:
        held[b] |= {i} - {None}
    both = Counter(p for s in held.values() for p in itertools.combinations(sorted(s), 2))
    for least in (1, 3):
        for broadcast_rows in (1, 1000):
            found = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_total"]) for r in pairs_together(baskets, min_baskets=least, broadcast_rows=broadcast_rows).collect()}
            assert found == {p: (n, 20) for p, n in both.items() if n >= least}


def test_pairs_together_against_brute_force(spark):
    rows = [(b, f"i{(b * k) % 7}") for b in range(50) for k in range(1, 5)] + [(99, None), (None, "i1"), (1, "i1"), (1, "i1")]
    baskets = baskets_of(spark.createDataFrame(rows, "b long, i string").withColumn("basket", F.lit("clash")), "b", "i")
    held = defaultdict(set)
    for b, i in rows:
        if b is not None:
            held[b] |= {i} - {None}
    single = Counter(i for s in held.values() for i in s)
    both = Counter(p for s in held.values() for p in itertools.combinations(sorted(s), 2))
    for least, lift in ((1, 0), (5, 0), (1, 1)):
        for broadcast_rows in (1000, 1):
            found = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"]) for r in pairs_together(baskets, min_baskets=least, min_lift=lift, broadcast_rows=broadcast_rows).collect()}
            assert found == {p: (n, single[p[0]], single[p[1]]) for p, n in both.items() if n >= least and len(held) * n >= lift * single[p[0]] * single[p[1]]}
    assert pairs_together(baskets.limit(0)).count() == 0


CELLS = [
    (1, "a", "A.", "b", "a"), (2, "a", "b", None, "b"), (3, "x; y", "z", "y", "y"), (4, None, "n/a", "-", None), (5, "a", "", None, "a"), (1, "a", "A.", "b", "a"), (6, "c", "d", "e", "d"), (7, "q", "q", None, "q"), (8, None, "q", "r", "q"),
]


def test_consensus_by_any_support(spark):
    df = spark.createDataFrame([r[:4] + ("clash",) for r in CELLS] + [(None, "a", "a", "a", "x")], "item_id long, p1 string, p2 string, p3 string, label string")
    out = annotator_consensus(df, "item_id", ["p1", "p2", "p3"], loo="any", smoothing=0.0)
    people = {r["annotator"]: (r["marked"], r["agreed"]) for r in out.annotators.collect()}
    assert people == {"p1": (5, 3), "p2": (6, 2), "p3": (4, 1)}
    found = {r["item"]: r["label"] for r in out.items.collect()}
    assert found == {1: "a", 2: "a", 3: "y", 5: "a", 6: "c", 7: "q", 8: "q"}


def test_any_support_goes_in_rounds_until_stable(spark):
    df = spark.createDataFrame([r[:4] for r in CELLS], "item_id long, p1 string, p2 string, p3 string")
    assert annotator_consensus(df, "item_id", ["p1", "p2", "p3"], loo="any", smoothing=0.0).agreement.first()["rounds"] == 2


def test_consensus_converges_and_alpha(spark):
    df = spark.createDataFrame([(i, f"l{i % 3}", f"l{i % 3}", f"l{(i if i % 4 else i + 1) % 3}") for i in range(40)], "item_id long, p1 string, p2 string, p3 string")
    out = annotator_consensus(df, "item_id", ["p1", "p2", "p3"])
    r = {x["annotator"]: x["reliability"] for x in out.annotators.collect()}
    assert r["p1"] == r["p2"] > r["p3"]
    one = out.agreement.first()
    ratings = [[f"l{i % 3}", f"l{i % 3}", f"l{(i if i % 4 else i + 1) % 3}"] for i in range(40)]
    n = Counter(x for u in ratings for x in u)
    observed = sum(sum(u.count(x) - 1 for x in u) / 2 for u in ratings) / 120
    expected = sum(c * (c - 1) for c in n.values()) / (120 * 119)
    assert one["alpha"] == pytest.approx(1 - (1 - observed) / (1 - expected))


def test_consensus_of_nothing(spark):
    df = spark.createDataFrame([], "item_id long, p1 string, p2 string")
    out = annotator_consensus(df, "item_id", ["p1", "p2"])
    assert out.items.count() == 0 and out.agreement.first()["alpha"] is None
    assert spark.range(1).select(cell_keys(F.lit(" A-b ; N/A, ,c;c"))).first()[0] == ["ab", "c"]
    assert spark.range(1).select(letters_digits(F.lit("Ä_1 ﬁ!"))).first()[0] == "ä1ﬁ"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, data, name):
    assert_equal(queries()[name](spark, data), connection(data), oracle_sql()[name])
