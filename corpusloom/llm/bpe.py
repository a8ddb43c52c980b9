"""Byte-pair encoding of whole texts by one pass of dynamic programming over prefixes.

The unique encoding of a piece ends, for every prefix, in one last token. Tokens that end at a
position come from a suffix automaton (trie with suffix links) over the vocabulary, longest first; of
these, the one that may stand after the last token of the prefix before it is stored. Two tokens may
stand side by side if merging their bytes from the left to the right by rank would keep them apart.
Following the stored tokens back from the end gives the ids. Time is linear in the length of a piece,
whatever it consists of.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import spread

from .batches import parts

#: Pieces kept with their ids in one worker, and the longest piece that is kept. They bound memory; what is not kept is encoded again.
KEPT_PIECES, KEPT_LENGTH = 200_000, 48
#: Verdicts on token pairs kept in one worker.
KEPT_PAIRS = 400_000
DEFAULT_DIR = "/opt/tokenizers"

#: Fixed value: the piece pattern that belongs to the vocabulary.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in the vocabulary file: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load_vocabulary(directory: str = DEFAULT_DIR, name: str = "byte_bpe_50k.json") -> dict:
    """Bytes of each token and the pair that merges into it, as two arrays; -1 for tokens that are no merge.

    About two megabytes, whatever the corpus, so it may be broadcast.
    """
    model = json.loads((Path(directory) / name).read_text(encoding="utf-8"))["model"]
    letters, ids = _byte_letters(), model["vocab"]
    tokens: list[bytes] = [b""] * (max(ids.values()) + 1)
    for text, i in ids.items():
        if all(c in letters for c in text):
            tokens[i] = bytes(letters[c] for c in text)
    left, right = np.full(len(tokens), -1, np.int32), np.full(len(tokens), -1, np.int32)
    merged = np.zeros(len(tokens), bool)
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        left[ids[a + b]], right[ids[a + b]] = ids[a], ids[b]
        merged[ids[a + b]] = True
    usable = [t if merged[i] or len(t) == 1 else b"" for i, t in enumerate(tokens)]  # special tokens are no text
    return {"tokens": usable, "left": left, "right": right}


class PrefixEncoder:
    """Encodes texts with one vocabulary; see the module's description."""

    def __init__(self, vocabulary: dict):
        import ahocorasick
        import regex

        self.tokens: list[bytes] = vocabulary["tokens"]
        self.size = [len(t) for t in self.tokens]
        self.left, self.right = vocabulary["left"].tolist(), vocabulary["right"].tolist()
        self.merges = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a >= 0}
        self.find_pieces = regex.compile(PIECES).findall
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(self.tokens):
            if token:
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}

    def _apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b may stand side by side.

        Going down the merges at the seam in reverse order of rank: no two parts that meet there may
        have a merge that comes before the merges that built them.
        """
        first_limit = second_limit = len(self.tokens)
        while True:
            merge = self.merges.get((a, b))
            if merge is not None and merge < first_limit and merge <= second_limit:
                return False
            if a > b and self.right[a] >= 0 or self.left[b] < 0:
                if self.right[a] < 0:
                    return True
                first_limit, second_limit, a = a, a - 1, self.right[a]
            else:
                first_limit, second_limit, b = b + 1, b, self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            known = self._apart(a, b)
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece; fails where the vocabulary has no token for some byte of it."""
        last: list[int] = [-1] * len(data)
        size, compatible = self.size, self.compatible
        for end, token in self.automaton.iter(data.decode("latin-1")):
            if last[end] >= 0:
                continue
            before = end - size[token]
            if before < 0 or compatible(last[before], token):
                last[end] = token
        if -1 in last:
            raise ValueError("the vocabulary has no token for a byte of the text")
        ids, at = [], len(data) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[last[at]]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and for empty text."""
        out: list[int] = []
        if not text:
            return out
        kept, extend = self.pieces, out.extend
        for piece in self.find_pieces(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.encode_bytes(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[piece] = ids
            extend(ids)
        return out


@lru_cache(maxsize=2)
def _encoder(directory: str, name: str) -> PrefixEncoder:
    return PrefixEncoder(load_vocabulary(directory, name))


class _Shared:
    """The vocabulary as a broadcast; the encoder is built once in each Python worker."""

    def __init__(self, spark: SparkSession, directory: str, name: str):
        self.name = f"{directory}/{name}"
        self.value = spark.sparkContext.broadcast(load_vocabulary(directory, name))

    def encoder(self) -> PrefixEncoder:
        if self.name not in _BUILT:
            _BUILT.clear()
            _BUILT[self.name] = PrefixEncoder(self.value.value)
        return _BUILT[self.name]


_BUILT: dict[str, PrefixEncoder] = {}


def _id_lists(encoder: PrefixEncoder, texts: list) -> pa.ListArray:
    lists = [encoder.encode(t) for t in texts]
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def encode_texts(df: DataFrame, key: str, text: str, *, directory: str = DEFAULT_DIR, name: str = "byte_bpe_50k.json") -> DataFrame:
    """(``key``, ids array<int>) for every row of ``df``; whole texts, no special tokens.

    Null and empty texts have an empty array. Rows with a null or repeated key come out as they are,
    one for one. Other columns are not read. An empty table gives no rows.
    """
    shared = _Shared(df.sparkSession, directory, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.encoder()
        for batch in batches:
            for part in parts(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), _id_lists(encoder, part.column(1).to_pylist())], ["key", "ids"])

    narrow = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return spread(narrow).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def count_tokens(df: DataFrame, text: str, *, out: str = "n_tokens", directory: str = DEFAULT_DIR, name: str = "byte_bpe_50k.json") -> DataFrame:
    """``df`` without ``text`` and with the number of tokens of it in ``out``; 0 for null and empty."""
    shared = _Shared(df.sparkSession, directory, name)
    others = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.encoder()
        for batch in batches:
            for part in parts(batch, 0):
                counts = pa.array([len(encoder.encode(t)) for t in part.column(0).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], counts], [*others, out])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others), f"`{out}` bigint"])
    return spread(df.select(text, *others)).mapInArrow(run, schema)
