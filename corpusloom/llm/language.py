"""Languages of documents and of the stretches within them, by a byte-level recurrent network."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import plan_bytes, spread

from .batches import parts
from .bigru import ByteLabeller, train

#: Codes and names of languages, by two-letter code.
LANGUAGE_NAMES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français", "es": "spa spanish español castilian", "pt": "por portuguese português", "it": "ita italian italiano",
    "nl": "nld dut dutch nederlands", "sv": "swe swedish svenska", "pl": "pol polish polski", "ru": "rus russian русский", "zh": "zho chi cmn chinese 中文", "ja": "jpn japanese 日本語",
}
#: Bound of the training sample: at most so many texts of each language, each of at most so many characters.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 250, 20_000
#: Bytes of text that are labelled side by side; a longer text is labelled by itself, in memory of one block.
BATCH_BYTES = 1 << 20
#: Rows, and characters of text, that a task remembers to leave out repeated rows before the shuffle.
SEEN_ROWS, SEEN_CHARS = 100_000, 32 << 20
#: Least mean probability of a sentence that makes a document mixed.
SURE = 0.7

_NAMES = {name: code for code, names in LANGUAGE_NAMES.items() for name in (code, *names.split())}
_END = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|(?<=[。！？])\s*|\n+")
_QUOTED = re.compile(r"\"[^\"\n]{2,}+\"|“[^“”\n]{2,}+”|«[^«»\n]{2,}+»|„[^„“”\n]{2,}+[“”]|《[^《》\n]{2,}+》|「[^「」\n]{2,}+」|『[^『』\n]{2,}+』")
_HEADED_LIST = re.compile(r"^\s*+[^\W\d][^\n.。:：]{0,40}[:：]\s*+[^.。!?]*+$")
_CLOSED = re.compile(r"[.!?…。！？][\"'”»)\]]*+$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]{2,}")


def named_language(label: Column) -> Column:
    """The two-letter code that a label names, in any convention and with or without a region; null if none."""
    text = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    names = F.create_map(*(F.lit(x) for pair in sorted(_NAMES.items()) for x in pair))
    return F.coalesce(F.try_element_at(names, text), F.try_element_at(names, F.regexp_extract(text, r"^(\p{L}+)[-_ (]", 1)))


def is_sentence(piece: str) -> bool:
    """Whether a piece of text is a whole sentence: ended, of four words or six ideographs, and no list under a heading."""
    text = piece.strip()
    if not _CLOSED.search(text):
        return False
    return len(_CJK.findall(text)) >= 6 or len(_WORD.findall(_QUOTED.sub(" ", text))) >= 4


def pieces_of(text: str) -> list[tuple[int, int]]:
    """(start, stop) of the pieces between sentence ends and line breaks; together they cover the text."""
    out, start = [], 0
    for m in _END.finditer(text):
        if m.end() > start and text[start : m.start()].strip():
            out.append((start, m.end()))
            start = m.end()
    if start < len(text):
        if text[start:].strip() or not out:
            out.append((start, len(text)))
        else:
            out[-1] = (out[-1][0], len(text))
    return out


def without_quotes(text: str) -> str:
    """``text`` with quoted words blanked, byte for byte, so that places stay."""
    return _QUOTED.sub(lambda m: m[0][0] + " " * (len(m[0].encode()) - len(m[0][0].encode()) - len(m[0][-1].encode())) + m[0][-1], text)


def sentences_of(text: str) -> list[str]:
    """The whole sentences of a text, quoted words blanked."""
    pieces = (text[a:b].strip() for a, b in pieces_of(text))
    return [without_quotes(p) for p in pieces if is_sentence(p) and not _HEADED_LIST.match(p)]


def training_batches(sentences: list[tuple[str, int]], rng: np.random.Generator, *, steps: int, rows: int = 64, length: int = 96) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte and label batches: sentences strung together, languages changing between them, some in capitals, without accents or with reading errors."""
    by_label: dict[int, list[str]] = {}
    for piece, label in sentences:
        by_label.setdefault(label, []).append(piece)
    labels = sorted(by_label)
    for _ in range(steps if labels else 0):
        codes, targets = np.zeros((rows, length), np.uint8), np.zeros((rows, length), np.int64)
        for row in range(rows):
            data, marks, label = b"", [], labels[rng.integers(len(labels))]
            capitals, plain, errors = rng.random() < 0.15, rng.random() < 0.15, 0.06 if rng.random() < 0.2 else 0.0
            skip = int(rng.integers(60))
            while len(data) < length + skip:
                if marks and rng.random() < 0.5:
                    label = labels[rng.integers(len(labels))]
                piece = by_label[label][rng.integers(len(by_label[label]))]
                if capitals:
                    piece = piece.upper()
                if plain:
                    piece = "".join(c for c in unicodedata.normalize("NFKD", piece) if not unicodedata.combining(c)) if not _CJK.search(piece) else piece
                if errors:
                    piece = "".join("l1. "[rng.integers(4)] if c.isalpha() and rng.random() < errors else c for c in piece)
                coded = (piece + ("" if _CJK.search(piece) and rng.random() < 0.7 else " ")).encode()
                data += coded
                marks += [label] * len(coded)
            codes[row] = np.frombuffer(data[skip : skip + length], np.uint8)
            targets[row] = marks[skip : skip + length]
        yield np.ascontiguousarray(codes.T), np.ascontiguousarray(targets.T)


def labelled_sample(df: DataFrame, text: str, label: Column, per_language: int = SAMPLE_PER_LANGUAGE, most_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most ``per_language`` different texts for each language named by ``label``, whole ones of at most ``most_chars`` characters.

    Chosen by a hash of the text, so the same table gives the same sample. Different texts are counted
    by that hash first and thinned by it before the languages are told apart, so that no language fills
    a task, and a text that comes often does not make the sample smaller.
    """
    rows = df.where(F.length(df[text]) <= most_chars).select(df[text].alias("text"), label.alias("lang")).where("lang IS NOT NULL AND length(trim(text)) > 0").withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["count"] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return []
    kept = F.lit(False)
    for lang, n in counts.items():
        share = min(1.0, (3 * per_language + 50) / n)
        kept = kept | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1_000_000_007)) < int(share * 1_000_000_007) + 1))
    chosen = rows.where(kept).distinct().groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "text"))), 1, per_language).alias("held"))
    return sorted((x["text"], r["lang"]) for r in chosen.collect() for x in r["held"])  # bounded by per_language and most_chars


def agreeing_sentences(model: ByteLabeller, texts: list[tuple[list[str], int]], sure: float = 0.6) -> list[tuple[str, int]]:
    """Sentences of the texts that the network, over all their sentences, finds in their label's language, without those that it is sure are in another."""
    p = model.log_probabilities([s.encode() for sentences, _ in texts for s in sentences])
    means = np.stack([np.exp(x).mean(0) for x in p]) if p else np.zeros((0, len(model.labels)))
    kept, at = [], 0
    for sentences, label in texts:
        own = means[at : at + len(sentences)]
        at += len(sentences)
        if int(own.mean(0).argmax()) == label:
            kept += [(s, label) for s, m in zip(sentences, own) if int(m.argmax()) == label or m.max() < sure]
    return kept


def fit_labeller(sample: list[tuple[str, str]], *, hidden: int = 24, rounds: tuple[int, ...] = (250, 120, 250), seed: int = 5) -> ByteLabeller | None:
    """A network trained on the sentences of labelled texts; None where there is no sentence.

    Labels may be wrong, and texts may hold sentences of other languages. So training goes in
    ``rounds`` of so many steps, and between them all texts are judged again, see
    :func:`agreeing_sentences`.
    """
    labels = sorted({lang for _, lang in sample})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    model = ByteLabeller.fresh(labels, hidden, rng)
    place = {lang: i for i, lang in enumerate(labels)}
    texts = [(s, place[lang]) for t, lang in sample if (s := sentences_of(t))]
    everything = kept = [(s, label) for sentences, label in texts for s in sentences]
    if not everything:
        return None
    for k, steps in enumerate(rounds):
        train(model, training_batches(kept, rng, steps=steps), steps=steps, rate=0.02 if k == 0 else 0.012)
        if k + 1 < len(rounds):
            kept = agreeing_sentences(model, texts) or everything
    return model


class _Pieces:
    """The pieces of a text, and sums over the positions of each that are taken in as they come."""

    def __init__(self, text: str, labels: int):
        self.text, self.places = text, pieces_of(text)
        sizes = [len(text[a:b].encode("utf-8", "replace")) for a, b in self.places]
        self.ends = np.cumsum(sizes) if sizes else np.zeros(0, np.int64)
        headed = [bool(_HEADED_LIST.match(text[a:b].strip())) for a, b in self.places]
        marked = [is_sentence(text[a:b]) and not h for (a, b), h in zip(self.places, headed)]
        if not any(marked):  # a text without a sentence is taken as one if it has as many words
            marked = [not h and (len(_CJK.findall(text[a:b])) >= 6 or len(_WORD.findall(text[a:b])) >= 4) for (a, b), h in zip(self.places, headed)]
        self.marked = marked
        self.quoted = self._quoted()
        self.p, self.log_p, self.n = np.zeros((len(sizes), labels)), np.zeros((len(sizes), labels)), np.zeros(len(sizes), np.int64)

    def _quoted(self) -> list[tuple[int, int]]:
        """(start, stop) in bytes of the quotations within sentences that hold other text too."""
        out, at = [], 0
        for (a, b), end, sentence in zip(self.places, self.ends.tolist(), self.marked):
            piece = self.text[a:b]
            found = list(_QUOTED.finditer(piece)) if sentence else []
            if found and sum(m.end() - m.start() for m in found) < len(piece):
                out += [(at + len(piece[: m.start()].encode("utf-8", "replace")), at + len(piece[: m.end()].encode("utf-8", "replace"))) for m in found]
            at = end
        return out

    def take(self, start: int, log_p: np.ndarray) -> None:
        """Takes in the log-probabilities of the bytes from ``start`` on."""
        keep = np.ones(len(log_p), bool)
        for a, b in self.quoted:
            keep[max(0, a - start) : max(0, b - start)] = False
        piece = np.searchsorted(self.ends, np.arange(start, start + len(log_p)), side="right")
        first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        held = piece[first]
        masked = log_p * keep[:, None]
        self.log_p[held] += np.add.reduceat(masked, first)
        self.p[held] += np.add.reduceat(np.exp(log_p) * keep[:, None], first)
        self.n[held] += np.add.reduceat(keep.astype(np.int64), first)

    def result(self, labels: list[str]) -> tuple[str | None, float, list[dict]]:
        """Pooled language, its probability, and the segments of the text."""
        if not len(self.n) or not self.n.any():
            return None, 0.0, []
        chosen = np.array(self.marked) & (self.n > 0)
        pool = chosen if chosen.any() else self.n > 0
        totals = self.p[pool].sum(0) / self.n[pool].sum()
        joined: list[dict] = []
        for (a, b), sentence, p, log_p, n in zip(self.places, self.marked, self.p, self.log_p, self.n.tolist()):
            if not n:
                continue
            best = int(log_p.argmax())
            lang, confidence = labels[best], float(p[best] / n)
            if joined and joined[-1]["lang"] == lang:
                last, whole = joined[-1], joined[-1]["n"] + n
                last["confidence"] = (last["confidence"] * last["n"] + confidence * n) / whole
                last["stop"], last["n"], last["sentences"] = b, whole, last["sentences"] + int(sentence)
            else:
                joined.append({"start": a, "stop": b, "lang": lang, "confidence": confidence, "sentences": int(sentence), "n": n})
        for s in joined:
            del s["n"]
        best = int(totals.argmax())
        return labels[best], float(totals[best]), joined


_RESULT = "lang string, confidence double, segments array<struct<start:int,stop:int,lang:string,confidence:double,sentences:int>>"
_SEGMENTS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32())]))


def label_texts(network: ByteLabeller, texts: list[str], batch_bytes: int = BATCH_BYTES) -> list[tuple[str | None, float, list[dict]]]:
    """(language, confidence, segments) of each text. Texts of more than ``batch_bytes`` are labelled in blocks that carry their states on, so the bound does not change a label."""
    data = [without_quotes(t).encode("utf-8", "replace") for t in texts]
    held = [_Pieces(t, len(network.labels)) for t in texts]
    short = [i for i, d in enumerate(data) if len(d) <= batch_bytes]
    for i, log_p in zip(short, network.log_probabilities([data[i] for i in short])):
        if len(log_p):
            held[i].take(0, log_p)
    for i in range(len(texts)):
        if len(data[i]) > batch_bytes:
            for start, log_p in network.long_probabilities(data[i]):
                held[i].take(start, log_p)
    return [h.result(network.labels) for h in held]


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) without those that the task has seen lately; what is forgotten is left to the task that gets all of one row."""
    seen: set = set()
    chars = 0
    for batch in batches:
        fresh = []
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fresh.append(row not in seen)
            if fresh[-1]:
                chars += len(row[1] or "")
                if len(seen) >= SEEN_ROWS or chars > SEEN_CHARS:
                    seen.clear()
                    chars = len(row[1] or "")
                seen.add(row)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def label_languages(df: DataFrame, key: str, text: str, model: ByteLabeller | None) -> DataFrame:
    """(``key``, lang, confidence, segments) for every distinct (key, text); whole texts.

    ``lang`` pools the probabilities of all positions in sentences, ``confidence`` is its pooled
    probability. ``segments`` are the stretches of one language in characters, with the mean
    probability and the number of whole sentences; sentences are ended by a full stop and have four
    words or six ideographs, quoted words in them do not count. A text without a sentence is taken
    as one if it has as many words. Null, empty and blank texts, and all texts without a model, have
    a null language, confidence 0 and no segments. Other columns are not looked at.

    Texts are shuffled once. Repeated rows are left out before that as far as a task remembers them,
    so that a row that comes very often fills no task, and the others after it.
    """
    spark = df.sparkSession
    narrow = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    once = spread(narrow.mapInArrow(_first_seen, f"key {kind}, text string"), "key", F.xxhash64("text"), task_mb=4, size=plan_bytes(narrow))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, seen = shared.value, set()
        for batch in batches:
            for part in parts(batch, 1, BATCH_BYTES, 1024):
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                marks = [(k, None if t is None else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()) for k, t in rows]
                fresh = [i for i, m in enumerate(marks) if not (m in seen or seen.add(m))]
                rows = [rows[i] for i in fresh]
                told = [i for i, (_, t) in enumerate(rows) if network and t and t.strip()]
                found: list = [(None, 0.0, [])] * len(rows)
                for i, answer in zip(told, label_texts(network, [rows[i][1] for i in told]) if told else ()):
                    found[i] = answer
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(fresh, pa.int64())), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], _SEGMENTS)],
                    ["key", "lang", "confidence", "segments"],
                )

    return once.mapInArrow(run, f"key {kind}, {_RESULT}").withColumnRenamed("key", key)


def sentence_languages(segments: Column, lang: Column, sure: float = SURE) -> Column:
    """The languages of which there is a whole sentence: that of the document, and others of which the network is sure."""
    kept = F.filter(segments, lambda s: (s["sentences"] > 0) & ((s["lang"] == lang) | (s["confidence"] >= sure)))
    return F.array_distinct(F.transform(kept, lambda s: s["lang"]))
