"""Ranked key phrases of a text by the degree and frequency of their words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.session import spread

#: Words between which phrases are cut.
STOP_WORDS = frozenset(
    [
        "a", "about", "above", "after", "again", "against", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below",
        "between", "both", "but", "by", "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have",
        "having", "he", "her", "here", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "may", "me", "might", "more",
        "most", "must", "my", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own", "same", "she",
        "should", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until",
        "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would", "you", "your",
    ]
)


def ranked_phrases(text: str, least: int = 2, most: int = 6, stop: frozenset[str] = STOP_WORDS) -> list[tuple[str, float]]:
    """Distinct phrases of ``least`` to ``most`` words between stop words and punctuation, with the sum of degree / frequency of their words, best first, ties by name."""
    phrases: list[list[str]] = []
    for part in re.split(r"[^\w\s-]+|\n", text.lower()):
        run: list[str] = []
        for word in [*part.split(), ""]:
            if word and word not in stop:
                run.append(word)
            elif run:
                phrases.append(run)
                run = []
    phrases = [p for p in phrases if least <= len(p) <= most]
    frequency = Counter(w for p in phrases for w in p)
    degree: Counter = Counter()
    for p in phrases:
        for w in p:
            degree[w] += len(p)
    scores = {" ".join(p): sum(degree[w] / frequency[w] for w in p) for p in phrases}
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


def extract_phrases(df: DataFrame, key: str, text: str, least: int = 2, most: int = 6) -> DataFrame:
    """(``key``, rank, phrase, score) of the phrases of every text; null and empty texts have none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, p, s) for k, t in zip(batch[key], batch[text]) if t for i, (p, s) in enumerate(ranked_phrases(t, least, most), 1)]
            yield pd.DataFrame(rows, columns=[key, "rank", "phrase", "score"]).astype({"rank": "int32"})

    return spread(df.select(key, text)).mapInPandas(run, f"`{key}` {kind}, rank int, phrase string, score double")
