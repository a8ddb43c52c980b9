"""Filters as boolean columns, and ordered reasons why a row is left out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ABBREVIATIONS, strip

#: Words that keep a two-word phrase out, and words that keep any phrase out.
WEAK_WORDS = ["important", "also", "due", "thoroughly", "using", "showed", "much", "times"]
EMPTY_WORDS = ["results", "result", "recent", "recently", "present", "presented", "presents", "work", "works", "experiment", "experiments", "experimental", "paper", "papers"]
#: Capitalised strings that look like formulas and are none.
FALSE_FORMULAS = ["In", "At", "VIP", "C", "K", "As", "I", "II", "III", "IV", "V", "Pa", "UV", "U", "K1"]


def length_between(text: Column, low: int = 250, high: int = 3000) -> Column:
    return F.length(text).between(low, high)


def length_inside(text: Column, low: int = 250, high: int = 3000) -> Column:
    """Both bounds left out."""
    return (F.length(text) > low) & (F.length(text) < high)


def no_latex(text: Column) -> Column:
    return ~text.rlike(r"\\[a-z]+")


def topic_score(concepts: Column, topic: str) -> Column:
    """Score of the first entry named ``topic``, rounded half-even to three places; -1 without one."""
    return F.coalesce(F.bround(F.get(F.filter(concepts, lambda c: c["name"] == topic), 0)["score"], 3), F.lit(-1.0))


def without_reason(df: DataFrame, reasons: dict[str, Column], column: str = "reason") -> DataFrame:
    """``df`` with the name of the first condition that holds, in the given order; null for rows that stay."""
    return df.withColumn(column, F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in reasons.items())))


def words_single_blank(text: Column) -> Column:
    """Number of parts between single blanks; two blanks hold an empty part."""
    return F.size(F.split(text, " ", -1))


def words_any_space(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+", -1), lambda w: w != ""))


def keyword_phrase(text: Column) -> Column:
    """At most two words and none that says nothing; parts of speech are not looked at."""
    words = F.split(text, " ", -1)
    stop = F.array(*(F.lit(w) for w in [*WEAK_WORDS, *EMPTY_WORDS]))
    return ~F.arrays_overlap(words, stop) & (F.size(words) <= 2)


#: Tags of adverbs, prepositions, conjunctions, determiners and adjectives, which keep short phrases out.
TAGS_LEFT_OUT = ["RB", "IN", "CC", "DT", "JJ", "JJR"]


def tagged_phrase(text: Column, tag: Callable[[list[str]], list[str]], most_words: int = 2) -> Column:
    """Whether a phrase of at most ``most_words`` words has none whose part of speech, by an injected tagger, is left out; longer ones are kept. Null for null."""

    @F.pandas_udf("boolean")
    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            words = [None if x is None else x.split(" ") for x in batch]
            yield pd.Series([None if w is None else len(w) > most_words or not any(t in TAGS_LEFT_OUT for t in tag(w)) for w in words], dtype="object")

    return kept(text)


def no_lone_number(text: Column) -> Column:
    return ~text.rlike(r"\b\d+\b")


def ascii_only(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")


def biomedical_label(text: Column, low: int = 2, high: int = 6) -> Column:
    return F.lower(text).isin(ABBREVIATIONS) | words_any_space(text).between(low, high)


def formula_parts(text: Column) -> Column:
    """Parts of a formula that begin with a capital; digits and signs are passed over."""
    return F.regexp_extract_all(F.regexp_replace(text, "[^A-Za-z]", ""), F.lit("[A-Z][a-z]*|^[a-z]+"), F.lit(0))


def formula_of_elements(text: Column, least: int = 2) -> Column:
    """At least ``least`` parts, none of them twice."""
    parts = formula_parts(text)
    return (F.size(F.array_distinct(parts)) == F.size(parts)) & (F.size(parts) >= least)


def without_false_formulas(formulas: Column) -> Column:
    return F.array_except(formulas, F.array(*(F.lit(f) for f in FALSE_FORMULAS)))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


#: Conditions that a label must meet, by the column that it came from: parameters are bounds of words and letters.
LABEL_FILTERS = {
    "rake_concepts": lambda c, words, letters: all_of(keyword_phrase(c), ascii_only(c), words_single_blank(c).between(*words), length_between(c, *letters)),
    "llama_concepts": lambda c, words, letters: all_of(no_lone_number(c), ascii_only(c), words_single_blank(c).between(*words), length_between(c, *letters)),
    "llm_concepts": lambda c, words, letters: all_of(biomedical_label(c, *words), length_between(c, *letters)),
}


def label_filter(text: Column, column: str, words: tuple[int, int], letters: tuple[int, int] = (2, 100)) -> Column:
    """The stack of filters for labels of ``column``; unknown columns have that of ``llama_concepts``."""
    return LABEL_FILTERS.get(column, LABEL_FILTERS["llama_concepts"])(text, words, letters)


def mostly_frequent_words(words: frozenset[str], code: str = "en") -> Callable[[str], str]:
    """A detector that answers ``code`` where one word of five, or more, is among ``words``; it fails on a text without words."""

    def detect(text: str) -> str:
        found = re.findall("[a-z]+", text.lower())
        if not found:
            raise ValueError("no words")
        return code if 5 * sum(w in words for w in found) >= len(found) else "unknown"

    return detect


def detected_language(text: Column, detect: Callable[[str], str]) -> Column:
    """The language that an injected detector finds in whole texts; ``unknown`` where it fails, null for null."""

    @F.pandas_udf("string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for one in batch:
                try:
                    out.append(None if one is None else detect(one))
                except Exception:  # noqa: BLE001 - whatever it is, the text has no language then
                    out.append("unknown")
            yield pd.Series(out, dtype="object")

    return found(text)
