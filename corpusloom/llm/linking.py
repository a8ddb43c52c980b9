"""Mapping of freely typed values to the entries of a reference list.

Distinct values are normalised. Candidates come from an inverted index of character trigrams over the
reference and are scored by the cosine of inverse-frequency weights, which are counted over the whole
list. Those that reach the threshold are checked exactly: letters may differ by a few typing errors, numbers
and known words may not. Of what is left the best is accepted when its cosine lies a margin before the
next; of candidates within the margin the one with fewest typing errors holds.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skewed import skew_join
from corpusloom.session import cut, small, spread

from .batches import parts

#: Most words and numbers of the entries that are sent to every task.
WORDS_BROADCAST = 1_000_000
#: Marks of (value, entry) that are held at once in a task, a byte each.
CELLS = 1 << 22
#: Normal forms whose candidates are kept in one worker; others are looked up again.
KEPT_FORMS = 100_000

#: Letters of other scripts that look like Latin ones, and their Latin look-alikes.
LOOK_ALIKES = str.maketrans("аеосрхуіѕјԁһ", "aeocpxyisjdh")
#: Greek letters that are spoken by name in terms.
GREEK = {"α": "alpha ", "β": "beta ", "γ": "gamma ", "δ": "delta ", "κ": "kappa ", "ω": "omega "}
#: Roman numerals of grades and stages.
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5"}
#: British spellings and the American ones, inside words.
SPELLINGS = (
    ("paed", "ped"), ("haem", "hem"), ("aem", "em"), ("oed", "ed"), ("oesoph", "esoph"), ("tumour", "tumor"), ("fibre", "fiber"),
    ("isation", "ization"), ("aluminium", "aluminum"), ("sulph", "sulf"), ("centre", "center"),
)
#: Phrases before a term that do not change what it names.
CARRIERS = re.compile(r"^(?:an? ?)?case ?of ?(?=\w)|^(?:the|an?) ")

_WORD = re.compile(r"[^\W_]+")
_RANK = re.compile(r"\b(grade|stage|type|class) ?(i{1,3}|iv|v)\b")
_TRAILING = re.compile(r"^(.*\w\W*?)\(\s*([^\s()]{1,12})\s*\)\W*$", re.S)


def normal_form(value: str) -> tuple[str, ...]:
    """The words of a value in the form in which values and entries are compared.

    Letter case, accents, ligatures, look-alike letters, punctuation, British spelling, plural, Roman
    numerals of ranks, articles and an acronym of the words in brackets at the end do not matter; words after
    a single comma come first, as in an index.
    """
    if value.isascii():
        text = value.lower()
    else:
        text = unicodedata.normalize("NFKD", value).casefold().translate(LOOK_ALIKES)
        text = "".join(c for c in text if not unicodedata.combining(c))
        for letter, name in GREEK.items():
            if letter in text:
                text = text.replace(letter, name)
    text = text.strip()
    while text[:1] in "([{" and text[-1:] in ")]}" and len(text) > 1:
        text = text[1:-1].strip()
    if "(" in text and (m := _TRAILING.match(text)):
        initials = "".join(w[0] for w in _WORD.findall(re.sub(r"\b(alpha|beta|gamma|delta|kappa|omega) ", r"\1", m[1])))
        acronym = re.sub(r"[\W_]", "", re.sub(r"(alpha|beta|gamma|delta|kappa|omega) ?", lambda g: g[1][0], m[2]))
        for start in range(min(4, len(initials))):
            tail = initials[start:]
            if len(acronym) == len(tail) and sum(a != b for a, b in zip(acronym, tail)) <= (len(tail) > 2):
                text = m[1]
                break
    if text.count(",") == 1:
        before, after = text.split(",")
        if _WORD.search(before) and _WORD.search(after):
            text = f"{after} {before}"
    text = CARRIERS.sub("", " ".join(_WORD.findall(text)))
    text = _RANK.sub(lambda m: f"{m[1]} {ROMAN[m[2]]}", text)
    out = []
    for word in text.split():
        for british, american in SPELLINGS:
            if british in word:
                word = word.replace(british, american)
        if len(word) > 3 and word[-1] == "s":
            word = word[:-2] if word.endswith("ches") or word.endswith("shes") else word[:-1]
        out.append(word)
    return tuple(out)


def typing_errors(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between ``a`` and ``b``; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    end = 0
    while end < stop - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    older: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            fresh.append(cost)
        if min(fresh) > most:
            return most + 1
        older, row = row, fresh
    return min(row[-1], most + 1)


#: Classes of letters: a to z, 0 to 9, anything else.
_CLASSES = 37
_CLASS_OF = np.full(256, _CLASSES - 1, np.int64)
_CLASS_OF[97:123], _CLASS_OF[48:58] = np.arange(26), np.arange(26, 36)


def _letters_and_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter counts of each text, and (text, trigram) of all trigrams that it holds, each once; two blanks follow each text."""
    flat = _CLASS_OF[np.frombuffer("".join(t + "??" for t in texts).encode("latin-1", "replace"), np.uint8)]
    row = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    counts = np.bincount(row * _CLASSES + flat, minlength=len(texts) * _CLASSES).reshape(len(texts), _CLASSES)
    inside = row[:-2] == row[2:]
    codes = ((flat[:-2] * _CLASSES + flat[1:-1]) * _CLASSES + flat[2:])[inside]
    held = np.unique(row[:-2][inside] * _CLASSES**3 + codes)
    return counts.astype(np.int16), held // _CLASSES**3, held % _CLASSES**3


def gram_counts(forms: Iterable[str]) -> np.ndarray:
    """In how many of the forms each trigram is; one number for each of the possible trigrams."""
    _, _, gram = _letters_and_grams(list(forms)) if (forms := list(forms)) else (None, None, np.zeros(0, np.int64))
    return np.bincount(gram, minlength=_CLASSES**3)


class Facts(NamedTuple):
    """What the words of all entries tell of a word."""

    known: bool  # it is one of them
    distance: int  # typing errors to the nearest of them that have four letters or more, at most 3
    near: tuple[str, ...]  # these, if within two
    affixes: tuple[str, ...]  # those of five letters or more that it begins or ends with


class Vocabulary:
    """The distinct words of the entries, or a part of them."""

    def __init__(self, words: Iterable[str]):
        self.words = set(words)
        self.long = sorted((w for w in self.words if len(w) > 3), key=lambda w: (len(w), w))
        self.ends = np.searchsorted([len(w) for w in self.long], np.arange(max(map(len, self.long), default=0) + 4))
        self.letters = _letters_and_grams(self.long)[0] if self.long else np.zeros((0, _CLASSES), np.int16)
        self.cache: dict[str, Facts] = {}

    def facts(self, word: str) -> Facts:
        found = self.cache.get(word)
        if found is None:
            found = self._facts(word)
            if len(self.cache) >= 100_000:
                self.cache.clear()
            self.cache[word] = found
        return found

    def _facts(self, word: str) -> Facts:
        if word in self.words:
            return Facts(True, 0, (word,), ())
        best, names = 2, []
        if len(word) > 3:
            start, stop = (int(self.ends[min(n, len(self.ends) - 1)]) for n in (len(word) - 2, len(word) + 3))
            letters = _letters_and_grams([word])[0][0]
            apart = np.abs(self.letters[start:stop] - letters).sum(1)  # each typing error changes two letter counts at most
            for at in np.flatnonzero(apart <= 4).tolist():
                known = self.long[start + at]
                d = typing_errors(word, known, best)
                if d < best:
                    best, names = d, [known]
                elif d == best:
                    names.append(known)
        ends = {part for n in range(5, len(word)) for part in (word[:n], word[-n:])}
        return Facts(False, best if names else 3, tuple(sorted(names)), tuple(sorted(ends & self.words)))


def merged_facts(parts: Iterable[Facts]) -> Facts:
    """Facts of a word from those of the parts of a vocabulary."""
    parts = list(parts)
    distance = min(p.distance for p in parts)
    near = tuple(sorted({w for p in parts if p.distance == distance for w in p.near}))
    return Facts(any(p.known for p in parts), distance, near, tuple(sorted({w for p in parts for w in p.affixes})))


class Candidate(NamedTuple):
    cosine: float
    errors: int
    ref_id: int


def decide(found: Iterable[Candidate], margin: float) -> int | None:
    """The id of the accepted one of the candidates of a value, all of which have passed the exact checks.

    That is the one with the highest cosine; of those within ``margin`` of it, the one with fewest
    typing errors. None if two of these have as few.
    """
    found = list(found)
    if not found:
        return None
    top = max(c.cosine for c in found) - margin
    tied = sorted(c.errors for c in found if c.cosine >= top)
    if len(tied) > 1 and tied[0] == tied[1]:
        return None
    return next(c.ref_id for c in found if c.cosine >= top and c.errors == tied[0])


class ReferenceIndex:
    """Inverted trigram index over a bounded list of (id, normal form), which are distinct.

    ``counts`` are the numbers of entries with each trigram and ``total`` that of all entries, over the
    whole list, of which this may be a part; so weights and cosines do not depend on the part.
    """

    def __init__(self, entries: list[tuple[int, tuple[str, ...]]], counts: np.ndarray, total: int, numbers: set[str] | None, *, threshold: float, most_errors: int):
        self.ids = [i for i, _ in entries]
        self.words = [w for _, w in entries]
        self.joined = ["".join(w) for w in self.words]
        self.sizes = np.array([len(t) for t in self.joined], np.int64)
        self.threshold, self.most_errors, self.numbers = threshold, most_errors, numbers
        self.digits = ["".join(c for c in t if c.isdigit()) for t in self.joined]
        self.letters, entry, gram = _letters_and_grams(self.joined) if self.joined else (np.zeros((0, _CLASSES), np.int16), np.zeros(0, int), np.zeros(0, int))
        self.weight = np.where(counts > 0, np.log1p(total / np.maximum(counts, 1)), 0.0)
        self.norms = np.maximum(np.sqrt(np.bincount(entry, self.weight[gram] ** 2, minlength=len(self.joined))), 1e-9)
        self.grams, self.grams_start = gram, np.searchsorted(entry, np.arange(len(self.joined) + 1))
        order = np.argsort(gram, kind="stable")
        self.places = entry[order]
        self.length = np.bincount(gram, minlength=_CLASSES**3)
        self.start = np.cumsum(self.length) - self.length

    def candidates(self, letters: np.ndarray, sizes: np.ndarray, text: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, cosine) of all pairs whose cosine reaches the threshold and whose letters are within the typing errors.

        A pair that reaches the threshold shares one of the rarest trigrams of the query: those that
        are left after the commonest, as long as their squared weights stay under the squared
        threshold's part of the norm. Only their postings are read. Trigrams that no entry has weigh
        nothing.
        """
        n, m = len(self.joined), len(sizes)
        squares = self.weight[gram] ** 2
        norms = np.maximum(np.sqrt(np.bincount(text, squares, minlength=m)), 1e-9)
        order = np.lexsort((squares, text))
        running = np.cumsum(squares[order])
        before = np.r_[0.0, running][np.searchsorted(text, np.arange(m))]
        rare = order[running - before[text[order]] >= (self.threshold**2 - 1e-9) * norms[text[order]] ** 2]
        length = self.length[gram[rare]]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[gram[rare]] - ends + length, length)
        seen = np.zeros(m * n, bool)
        seen[np.repeat(text[rare], length) * n + self.places[at]] = True
        query, entry = np.divmod(np.flatnonzero(seen), max(n, 1))
        fit = np.abs(sizes[query] - self.sizes[entry]) <= self.most_errors
        query, entry = query[fit], entry[fit]
        difference = np.abs(letters[query] - self.letters[entry])
        fit = (difference.sum(1) <= 2 * self.most_errors) & ~difference[:, 26:36].any(1)
        query, entry = query[fit], entry[fit]
        held = self.grams_start[entry + 1] - self.grams_start[entry]
        ends = np.cumsum(held)
        grams = self.grams[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.grams_start[entry] - ends + held, held)]
        wanted, codes = np.repeat(query, held) * _CLASSES**3 + grams, text * _CLASSES**3 + gram
        place = np.minimum(np.searchsorted(codes, wanted), max(len(codes) - 1, 0))
        shared = np.where(codes[place] == wanted, self.weight[grams] ** 2, 0.0) if len(codes) else np.zeros(0)
        cosine = np.bincount(np.repeat(np.arange(len(query)), held), shared, minlength=len(query)) / (norms[query] * self.norms[entry])
        hit = cosine >= self.threshold
        return query[hit], entry[hit], cosine[hit]

    def _other_word(self, words: tuple[str, ...], entry: int, facts: Callable[[str], Facts]) -> bool:
        """Whether a word of the value is, or is a misspelling of, a known word that the entry does not have."""
        own = self.words[entry]
        for word in words:
            if word in own or word.isdigit():
                continue
            if len(word) <= 3:
                if facts(word).known:
                    return True
                continue
            fact = None
            if any(typing_errors(word, k, 1) <= 1 for k in own if len(k) > 3):
                if not facts(word).known:
                    continue  # no known word is closer
                return True
            fact = facts(word)
            if fact.known or fact.near and not any(k in own for k in fact.near):
                return True
            if not fact.near and any(k not in own and not any(k in w for w in own) for k in fact.affixes):
                return True
        return False

    def found(self, words: list[tuple[str, ...]], facts: Callable[[str], Facts]) -> list[list[Candidate]]:
        """The candidates of each value that pass the exact checks of letters, digits and known words; for each number of typing errors the two with the highest cosines, which is all that :func:`decide` can need."""
        every = ["".join(w) for w in words]
        out: list[list[Candidate]] = [[] for _ in every]
        # a value with a number that no entry has means none of them
        kept = [i for i, t in enumerate(every) if self.numbers is None or ("".join(c for c in t if c.isdigit()) if not t.isalpha() else "") in self.numbers]
        step = max(1, CELLS // max(len(self.joined), 1))
        for start in range(0, len(kept) if self.joined else 0, step):
            part = kept[start : start + step]
            texts = [every[i] for i in part]
            letters, text_of, gram = _letters_and_grams(texts)
            ranked: dict[int, list[tuple[int, float, int]]] = {}
            for q, e, c in zip(*(x.tolist() for x in self.candidates(letters, np.array([len(t) for t in texts]), text_of, gram))):
                text = texts[q]
                if self.digits[e] and self.digits[e] != "".join(x for x in text if x.isdigit()):
                    continue
                most = min(self.most_errors, 1 if len(text) < 9 else 2 if len(text) < 18 else 3)
                d = typing_errors(text, self.joined[e], most)
                if d <= most:
                    ranked.setdefault(q, []).append((d, -round(c, 9), e))
            for q, held in ranked.items():
                i, taken = part[q], Counter()
                for d, c, e in sorted(held):
                    if taken[d] < 2 and not (d and self._other_word(words[i], e, facts)):
                        taken[d] += 1
                        out[i].append(Candidate(-c, d, self.ids[e]))
        return out


_BUILT: dict = {}
_FOUND = pa.list_(pa.struct([("cosine", pa.float64()), ("errors", pa.int32()), ("ref_id", pa.int64())]))
_FOUND_SQL = "array<struct<cosine:double,errors:int,ref_id:bigint>>"
_FACTS_SQL = "array<struct<word:string,known:boolean,distance:int,near:array<string>,affixes:array<string>>>"


def normal_entries(reference: DataFrame, entry: str, entry_id: str) -> DataFrame:
    """(form, id): the normal forms of the entries as words joined by blanks, each once with its smallest id; null ids and entries are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(normal_form(t)) for t in batch.column(1).to_pylist()], pa.string())], ["id", "form"])

    rows = reference.select(reference[entry_id].cast("bigint").alias("id"), reference[entry].alias("entry")).where("id IS NOT NULL AND entry IS NOT NULL")
    return rows.mapInArrow(run, "id bigint, form string").where("form != ''").groupBy("form").agg(F.min("id").alias("id"))


def _counted(forms: DataFrame) -> tuple[np.ndarray, set[str] | None]:
    """Trigram counts over all forms, and the digit strings in them; the counts have one number a trigram, whatever the list.

    The digit strings only spare work, as digits are compared for each candidate too; more of them than
    ``WORDS_BROADCAST`` are not sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CLASSES**3, np.int64)
        for batch in batches:
            total += gram_counts(t.replace(" ", "") for t in batch.column(0).to_pylist())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["gram", "n"])

    counts = np.zeros(_CLASSES**3, np.int64)
    for row in forms.select("form").mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most one row a possible trigram
        counts[row["gram"]] = row["n"]
    digits = forms.select(F.regexp_replace("form", r"[^0-9]", "").alias("d")).distinct()
    return counts, {r["d"] for r in digits.collect()} if small(digits, WORDS_BROADCAST) else None


def _word_facts(values: DataFrame, words: DataFrame, blocks: int) -> DataFrame:
    """(value, facts) of the words of the values' forms, where the vocabulary is too large for one task: it is dealt to blocks, and what they tell of a word is merged."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(v, w) for v in batch.column(0).to_pylist() for w in set(normal_form(v)) if not w.isdigit()]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in held], pa.string()), pa.array([w for _, w in held], pa.string())], ["value", "word"])

    named = cut(values.mapInArrow(split, "value string, word string"))
    each = cut(named.select("word").distinct())
    answers = []
    for block in range(blocks):
        part = [r["word"] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == block).toLocalIterator()]  # at most about WORDS_BROADCAST
        shared = values.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary = Vocabulary(shared.value)
            for batch in batches:
                asked = batch.column(0).to_pylist()
                facts = [vocabulary.facts(w) for w in asked]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([f.known for f in facts]), pa.array([f.distance for f in facts], pa.int32()), pa.array([f.near for f in facts], pa.list_(pa.string())), pa.array([f.affixes for f in facts], pa.list_(pa.string()))],
                    ["word", "known", "distance", "near", "affixes"],
                )

        answers.append(each.mapInArrow(run, "word string, known boolean, distance int, near array<string>, affixes array<string>"))
    every = reduce(DataFrame.unionByName, answers).groupBy("word").agg(F.collect_list(F.struct("known", "distance", "near", "affixes")).alias("parts"))  # one a block
    least = F.array_min(F.transform("parts", lambda p: p["distance"]))
    facts = every.withColumn("least", least).select(
        "word",
        F.struct(
            "word", F.exists("parts", lambda p: p["known"]).alias("known"), F.col("least").alias("distance"),
            F.array_distinct(F.flatten(F.transform(F.filter("parts", lambda p: p["distance"] == F.col("least")), lambda p: p["near"]))).alias("near"),
            F.array_distinct(F.flatten(F.transform("parts", lambda p: p["affixes"]))).alias("affixes"),
        ).alias("fact"),
    )
    return skew_join(named, cut(facts), "word", broadcast_rows=0).groupBy("value").agg(F.collect_list("fact").alias("facts"))  # one a word of the value


def link_values(values: DataFrame, reference: DataFrame, *, value: str, entry: str, entry_id: str, threshold: float = 0.55, margin: float = 0.02, most_errors: int = 3, block_entries: int = 50_000, words_broadcast: int = WORDS_BROADCAST) -> DataFrame:
    """(``value``, ref_id) for each distinct non-null value; ref_id is null where no entry is accepted.

    ``reference`` has (entry_id, entry); null ids and entries are left out, and of entries that are
    equal in normal form the smallest id stands for all. Trigrams are weighted over the whole list. It
    is sent to the tasks in blocks of about ``block_entries``, dealt by a hash of the normal form; each
    block tells its candidates for all values, and the decision is made over those of all blocks, so
    the number of blocks does not matter. So is the vocabulary of the entries beyond
    ``words_broadcast`` words. See :func:`decide` for acceptance by cosine, margin and typing errors.
    Values without letters or digits, an empty reference, and values whose normal form is longer than
    any entry's by more than ``most_errors`` come out unmatched. An empty table gives no rows. Other
    columns are not looked at.
    """
    spark = values.sparkSession
    distinct = spread(values.select(values[value].alias("value")).where("value IS NOT NULL").distinct(), "value")
    forms = cut(normal_entries(reference, entry, entry_id))
    total = forms.count()
    blocks = max(1, -(-total // block_entries))
    counts, numbers = _counted(forms)
    words = cut(forms.select(F.explode(F.split("form", " ")).alias("word")).distinct())
    size = words.count()
    if size <= words_broadcast:
        vocabulary, asked = [r["word"] for r in words.collect()], distinct
    else:
        distinct = cut(distinct)
        vocabulary, asked = None, spread(distinct.join(_word_facts(distinct, words, -(-size // words_broadcast)), "value", "left"))
    if blocks > 1 and vocabulary is not None:
        asked = cut(distinct)
    answers = []
    for block in range(blocks):
        part = forms if blocks == 1 else forms.where(F.pmod(F.xxhash64("form"), F.lit(blocks)) == block)
        entries = sorted((r["id"], tuple(r["form"].split(" "))) for r in part.toLocalIterator())  # a block, by the count above
        shared = spark.sparkContext.broadcast((entries, counts, total, numbers, vocabulary))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            key = shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared)
            if key not in _BUILT:
                _BUILT.clear()
                entries, counts, total, numbers, held = shared.value
                _BUILT[key] = ReferenceIndex(entries, counts, total, numbers, threshold=threshold, most_errors=most_errors), None if held is None else Vocabulary(held), {}
            index, vocabulary, cache = _BUILT[key]
            longest = max(map(len, index.joined), default=0) + most_errors
            for batch in batches:
                for part in parts(batch, 0, 1 << 20, 512):
                    forms = [normal_form(t) for t in part.column(0).to_pylist()]
                    fit = sorted({w for w in forms if w and w not in cache and sum(map(len, w)) <= longest})
                    told = {} if vocabulary else {f["word"]: Facts(f["known"], f["distance"], tuple(f["near"]), tuple(f["affixes"])) for held in part.column(1).to_pylist() for f in held or ()}
                    if len(cache) > KEPT_FORMS:
                        cache.clear()
                    answer = dict(zip(fit, index.found(fit, vocabulary.facts if vocabulary else told.__getitem__))) if fit else {}
                    found = [answer[w] if w in answer else cache.get(w, []) for w in forms]
                    cache.update(answer)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[c._asdict() for c in f] for f in found], _FOUND)], ["value", "found"])

        answers.append(asked.mapInArrow(run, f"value string, found {_FOUND_SQL}"))
    merged = answers[0]
    if blocks > 1:
        merged = reduce(DataFrame.unionByName, answers).groupBy("value").agg(F.flatten(F.collect_list("found")).alias("found"))  # at most eight candidates a block
    top = F.array_max(F.transform("found", lambda c: c["cosine"])) - F.lit(margin)
    tied = F.array_sort(F.transform(F.filter("found", lambda c: c["cosine"] >= top), lambda c: F.struct(c["errors"].alias("errors"), c["ref_id"].alias("ref_id"))))
    first, second = F.get("tied", 0), F.get("tied", 1)
    sure = second.isNull() | (first["errors"] < second["errors"])
    return merged.select("value", tied.alias("tied")).select(F.col("value").alias(value), F.when(sure, first["ref_id"]).alias("ref_id"))


def link_mentions(mentions: DataFrame, reference: DataFrame, *, record: str, value: str, entry: str, entry_id: str, hot_rows: int = 1_000_000, broadcast_rows: int = 200_000, **options) -> DataFrame:
    """(record, value, ref_id): each distinct (record, value) that is not letter for letter an entry, with the entry it means or -1.

    Values are linked once each, see :func:`link_values`. Values in at least ``hot_rows`` records are
    joined back by broadcast, or dealt to parts where there are more of them than ``broadcast_rows``, so
    that none of them fills a task.
    """
    exact = reference.select(reference[entry].alias(value)).where(F.col(value).isNotNull()).distinct()
    if small(exact, broadcast_rows):
        named = cut(mentions.select(record, value).join(F.broadcast(exact), value, "left_anti").distinct())
        values = named
    else:  # entries are told apart among the distinct values, of which none is hot; their mentions find no link below
        named = cut(mentions.select(record, value).distinct())
        values = named.select(value).distinct().join(exact, value, "left_anti")
    linked = link_values(values, reference, value=value, entry=entry, entry_id=entry_id, **options)
    known = named.where(F.col(value).isNotNull())
    found = skew_join(known, cut(linked.withColumn("ref_id", F.coalesce("ref_id", F.lit(-1).cast("bigint")))), value, hot_rows=hot_rows, broadcast_rows=0)
    return found.select(record, value, "ref_id")
