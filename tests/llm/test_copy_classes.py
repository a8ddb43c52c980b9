"""Pairs by way of the classes."""

import itertools

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import copies as C
from corpusloom.llm import p_queries


@pytest.mark.parametrize("hot_rows", [3, 10_000])
def test_pairs_follow_the_classes(spark, hot_rows):
    df = spark.createDataFrame([(i, f"k{i % 4}" if i < 20 else f"single{i}") for i in range(40)], "pmid long, v string")
    classes, members = C.collapse_copies(df, "pmid", C.label_multiset_key(df["v"]), hot_rows=hot_rows, salts=3)
    expected = sorted(p for k in range(4) for p in itertools.combinations(range(k, 20, 4), 2))
    assert sorted(map(tuple, C.copy_pairs(members, classes, salts=3).collect())) == expected
    assert C.copy_pairs(members, classes.where(F.lit(False)), salts=3).count() == 0
    held = {(r["representative"], r["record"], r["copies"]) for r in C.class_members(members, classes).collect()}
    assert held == {(k, i, 5) for k in range(4) for i in range(k, 20, 4)} | {(i, i, 1) for i in range(20, 40)}


def test_found_pairs_use_the_classes(spark, data, monkeypatch):
    collapse = p_queries.collapse_copies

    def without_classes(*args, **options):
        classes, members = collapse(*args, **options)
        return classes.limit(0), members

    assert p_queries.p1_found(spark, data).count() > 0
    monkeypatch.setattr(p_queries, "collapse_copies", without_classes)
    assert p_queries.p1_found(spark, data).count() == 0
