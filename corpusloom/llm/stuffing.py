"""Pages of strung-together keywords, links, tags and listings instead of sentences.

Every line, cut further at sentence ends, is reduced to a shape: how many words, how many of them are
short, capitalised or numbers, whether separators or repeated words prevail, whether it holds links,
whether it ends like a sentence. No word is looked up. Shapes are grouped over the whole corpus: one
whose segments mostly end like sentences there is a shape of sentences. A page is flagged when a few
shapes that are none hold more than half of its characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut, spread

from .batches import parts

#: Least share of ended segments, over the corpus, of a shape of sentences: for segments that end like one, and for those that do not.
ENDED_SHARE, UNENDED_SHARE = 0.5, 0.9
#: Most shapes without sentences that may hold more than half of a flagged page.
FEW_SHAPES = 12

# The patterns below stop at the next opening sign, so that each is linear in the length of a text, and none has a bound on what it reads.
_HTML_LINK = re.compile(r"<a\b[^<>]*+>[^<]*+(?:<(?!/?a\b)[^<]*+)*+</a\s*+>", re.I)
_BREAK = re.compile(r"<\s*+/?\s*+(?:br|p|li|ul|ol|div|tr|td|h\d)\b[^<>]*+>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!][^<>\n]*+>")
_LINK = re.compile(
    r"\[[^\[\]\n]*+\]\([^()\n]*+\)"  # [text](address)
    r"|(?:https?|ftp)://[^\s<>\"]++|www\.[^\s<>\"]++"
    r"|(?<![\w.-])(?:[\w-]++\.)+[a-z]{2,}/[^\s<>\")]*+"
    r"|(?<!\w)#[^\W\d_]\w*+"
)
_END = re.compile(r"(?<=[.!?…])[\"'”»)\]]*+\s++(?=[^\W\d_a-zà-öø-ÿа-я]|[\"'“«(\[¿¡])|(?<=[。！？])")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_SEPARATOR = re.compile(r"[|;•·#>»/]|\s[-–—*]\s|\s{2,}|[,:] ")
_CJK_SEPARATOR = re.compile(r"、|(?<=[぀-鿿]) (?=[぀-鿿])")
_MARK = "\x00"
_CLOSING = "\"'”»)]"
_STOPS = frozenset(".!?…。！？")


class Shape(NamedTuple):
    """What is kept of a segment; numbers are coarse classes."""

    words: int  # 0: none, 1: 1-3, 2: 4-7, 3: 8-30, 4: more
    short: int  # twelfths of the words that have at most three letters, at most 3; 4: written without spaces
    capitals: int  # thirds of the words that begin with a capital, at most 2
    numbers: int  # 1: one word of four, or more, holds digits
    separators: int  # 0: few, 1: one for four words or more
    repeats: int  # 0: other than short words are mostly new, 1: many come again
    links: int  # 1: holds links
    ended: int  # 1: ends like a sentence

    @property
    def code(self) -> int:
        code = 0
        for value, size in zip(self, SIZES):
            code = code * size + value
        return code


#: Values of each part of a shape; their product bounds the number of shapes.
SIZES = (5, 5, 3, 2, 2, 2, 2, 2)
N_SHAPES = int(np.prod(SIZES))
#: Code of the shape that stands for the links themselves.
LINKS = N_SHAPES


def _repeats(words: list[str]) -> bool:
    """Whether, in stretches of 24 words, three tenths or more are words that were there before."""
    n = len(words)
    if n < 4:
        return n > 1 and len(set(words)) == 1
    if n < 32:
        return len(set(words)) <= 0.7 * n
    spans = [words[i : i + 24] for i in range(0, n, 24)]
    if len(spans[-1]) < 8:
        rest = spans.pop()
        spans[-1] = spans[-1] + rest
    return sum(len(set(s)) for s in spans) <= 0.7 * n


def _size(n: int) -> int:
    return 0 if n < 1 else 1 if n < 4 else 2 if n < 8 else 3 if n <= 30 else 4


def shape_of(segment: str) -> Shape:
    """The shape of one segment; links are already replaced by a mark."""
    links = int(_MARK in segment)
    plain = segment.replace(_MARK, " ").strip() if links else segment
    ended = int(plain.rstrip(_CLOSING)[-1:] in _STOPS) if plain else 0
    words = _WORD.findall(plain)
    n = len(words)
    if not n:
        return Shape(0, 0, 0, 0, 0, 0, links, 0)
    if not plain.isascii():
        ideographs = _CJK.findall(plain)
        if len(ideographs) >= 4 and 2 * len(ideographs) > sum(map(len, words)):
            separators = len(_SEPARATOR.findall(plain)) + len(_CJK_SEPARATOR.findall(plain))
            n = len(ideographs) // 2
            return Shape(_size(n), 4, 0, 0, int(separators > 1 and 4 * separators >= n), int(_repeats([a + b for a, b in zip(ideographs, ideographs[1:])])), links, ended)
    low = plain.lower()
    small = _WORD.findall(low) if low != plain else words
    if len(small) != n:
        small = [w.lower() for w in words]
    others = [w for w in small if len(w) > 3 or not w.isalpha()]
    numbers = sum(not w.isalpha() and any(map(str.isdigit, w)) for w in others)
    changed = 0 if plain.isupper() else sum(a[0] != b[0] for a, b in zip(words, small))
    separators = len(_SEPARATOR.findall(plain))
    return Shape(_size(n), min(3, 12 * (n - len(others)) // n), min(2, 3 * changed // n), int(4 * numbers >= n), int(separators > 1 and 4 * separators >= n), int(_repeats(others)), links, ended)


def shape_sizes(text: str) -> tuple[Counter, Counter]:
    """Characters and segments by shape; links have ``None`` for a shape. Markup and white space count nowhere."""
    sizes: Counter = Counter()
    segments: Counter = Counter()

    def link(match: re.Match) -> str:
        sizes[None] += len(match[0])
        segments[None] += 1
        return _MARK

    if "<" in text:
        text = _TAG.sub(" ", _BREAK.sub("\n", _HTML_LINK.sub(link, text)))
    text = _LINK.sub(link, text)
    for line in text.splitlines():
        start = 0
        for end in [*_END.finditer(line), None]:
            segment = line[start : end.start() if end else len(line)].strip(" \t\x00")
            start = end.end() if end else start
            if segment:
                shape = shape_of(segment)
                sizes[shape] += len(segment) - (segment.count(_MARK) if shape.links else 0)
                segments[shape] += 1
    return sizes, segments


def line_shapes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, blank, shapes) for every row: the characters and segments of each shape of the whole text, at most one element for each possible shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("shape", pa.int32()), ("chars", pa.int64()), ("segments", pa.int64())]))
        for batch in batches:
            for part in parts(batch, 1):
                found, blank = [], []
                for t in part.column(1).to_pylist():
                    blank.append(not t or not t.strip())
                    sizes, segments = ((), ()) if blank[-1] else shape_sizes(t)
                    found.append([(LINKS if s is None else s.code, sizes[s], segments[s]) for s in sizes])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blank), pa.array([[{"shape": a, "chars": b, "segments": c} for a, b, c in f] for f in found], kind)], ["key", "blank", "shapes"])

    narrow = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return spread(narrow).mapInArrow(run, f"key {kind}, blank boolean, shapes array<struct<shape:int,chars:bigint,segments:bigint>>")


def corpus_shapes(lines: DataFrame) -> DataFrame:
    """(shape, pages, segments, chars, ended_share, sentences): the shapes of the corpus of :func:`line_shapes`, grouped.

    ``ended_share`` is that of the segments that are alike but for their end and their links, with one
    ended and one unended segment added. ``sentences`` tells the shapes of sentences: of four words or
    more, without many separators or repeated words, and with a share of ``ENDED_SHARE``, or of
    ``UNENDED_SHARE`` for the shape without an end. At most one row for each possible shape; counts are
    combined before the shuffle.
    """
    grouped = lines.select(F.inline("shapes")).groupBy("shape").agg(F.count(F.lit(1)).alias("pages"), F.sum("segments").alias("segments"), F.sum("chars").alias("chars"))
    alike, n = (F.col("shape") / 4).cast("int"), F.sum("segments")
    shares = grouped.where(F.col("shape") < LINKS).groupBy(alike.alias("alike")).agg(((F.sum(F.when(F.col("shape") % 2 == 1, F.col("segments")).otherwise(0)) + 1) / (n + 2)).alias("ended_share"))
    joined = grouped.withColumn("alike", alike).join(shares, "alike", "left")
    words = F.col("shape") / F.lit(int(np.prod(SIZES[1:])))
    plain = (F.col("alike") % 4 == 0) & (words >= 2) & (F.col("shape") < LINKS)
    least = F.when(F.col("shape") % 2 == 1, F.lit(ENDED_SHARE)).otherwise(F.lit(UNENDED_SHARE))
    return joined.select("shape", "pages", "segments", "chars", F.when(F.col("shape") < LINKS, F.col("ended_share")).alias("ended_share"), (plain & (F.col("ended_share") >= least)).alias("sentences"))


def _dominating(outside: Column, total: Column) -> Column:
    """How many of the sizes in ``outside``, the largest first, make more than half of ``total``; null if all of them do not."""
    start = F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(0).alias("n"))
    largest = F.reverse(F.array_sort(outside))
    walked = F.aggregate(largest, start, lambda s, x: F.when(2 * s["held"] > total, s).otherwise(F.struct((s["held"] + x).alias("held"), (s["n"] + 1).alias("n"))))
    return F.when(2 * walked["held"] > total, walked["n"])


def page_shapes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, outside_share, n_shapes, flagged) for every row; whole texts.

    ``outside_share`` is the share of characters in shapes that are none of sentences, links included;
    ``n_shapes`` how many of these, the largest first, hold more than half of the page, null if they
    do not; flagged if that are at most ``FEW_SHAPES``. Which shapes are of sentences is told by the
    table itself, see :func:`corpus_shapes`, so a page's mark depends on the corpus that it is in.
    Null, empty and blank texts have nulls and are not flagged; a text of nothing but markup has a
    share of 0. Rows with null or repeated keys come out one for one. Other columns are not read.
    An empty table gives no rows.
    """
    lines = cut(line_shapes(df, key, text))
    sentences = sorted(r["shape"] for r in corpus_shapes(lines).where("sentences").select("shape").collect())  # at most N_SHAPES
    known = F.array(*(F.lit(s) for s in sentences)) if sentences else F.array().cast("array<int>")
    total = F.aggregate("shapes", F.lit(0).cast("bigint"), lambda s, x: s + x["chars"])
    outside = F.transform(F.filter("shapes", lambda s: ~F.array_contains(known, s["shape"])), lambda s: s["chars"])
    sized = lines.select("key", "blank", total.alias("total"), outside.alias("outside"))
    without = F.aggregate("outside", F.lit(0).cast("bigint"), lambda s, x: s + x)
    marked = sized.select("key", F.when(~F.col("blank"), F.coalesce(without / F.nullif("total", F.lit(0)), F.lit(0.0))).alias("outside_share"), _dominating(F.col("outside"), F.col("total")).alias("n_shapes"))
    return marked.select(F.col("key").alias(key), "outside_share", "n_shapes", F.coalesce(F.col("n_shapes") <= FEW_SHAPES, F.lit(False)).alias("flagged"))
