"""Byte-level BPE with word ends: pre-tokens, encoding by merge rank, decoding.

A tokenizer file in the JSON format of the tokenizers library is read on the
driver and sent to the tasks as text; its size is fixed.

Encoding one pre-token: its symbols form a doubly linked list, and a priority
queue holds the possible merges by rank, then by place. The best entry is taken;
if one of its symbols has been merged since, the entry is stale and skipped. A
merge unlinks the right symbol and queues the two new neighbours, so a pre-token
of n symbols costs n log n even when it is a text without a blank.

Pre-tokens are kept per worker up to ``KEEP`` entries, so each is usually
encoded once per worker. Ids are returned packed: little-endian unsigned 32-bit
numbers. The decoded text is the vocabulary strings of the ids, joined by blanks
when the file names no decoder.

Defined results: a null or empty text has no ids and decodes to "". Texts are
never cut. Further columns pass through; input columns named like a result are
replaced. Empty tables give empty tables.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoca.llm.common import replaced, schema_with, slices, without

VOCABULARY = "word_bpe_49k.json"
# pre-tokens kept by a worker, and the longest that is kept
KEEP, KEEP_CHARS = 300_000, 64
# characters whose composition and lower case need no table: Latin letters and common punctuation
_PLAIN_RANGES = ((0x00, 0x12F), (0x131, 0x24F), (0x2010, 0x2027), (0x20AC, 0x20AC))
# fixed values: the alternatives of the file's pre-tokenizer, and white space as it means it
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_WHITE = " \t\n\x0b\x0c\r\x85\xa0"


def byte_alphabet() -> list[str]:
    """The printable character standing for each byte value."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in shown}
    for b in range(256):
        names.setdefault(b, chr(256 + b - sum(s < b for s in shown)))
    return [names[b] for b in range(256)]


def _characters(of: str) -> str:
    plain = [chr(c) for low, high in _PLAIN_RANGES for c in range(low, high + 1)]
    return "".join(re.escape(c) for c in plain if unicodedata.category(c).startswith(of))


class Codec:
    """One tokenizer file, ready for use in a task."""

    def __init__(self, spec: str):
        parts = json.loads(spec)
        model = parts["model"]
        if model["type"] != "BPE" or parts.get("decoder") is not None:
            raise ValueError("a BPE file without a decoder is expected")
        self.spec = spec
        self.vocabulary = model["vocab"]
        self.word_end = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.added_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.strings = {i: s.encode() for s, i in (self.vocabulary | self.added).items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        v = self.vocabulary
        self.ranks = {(v[a], v[b]): (rank, v[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.alphabet = byte_alphabet()
        letters, numbers = _characters("L"), _characters("N")
        self.words = re.compile(
            f"{_CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{letters}{numbers}{re.escape(_WHITE)}]+"
        )
        self.unusual = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _PLAIN_RANGES) + "]")
        self.known: dict[str, bytes] = {}
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.spec)
        return self._library

    def _plain_words(self, text: str) -> list[str]:
        if text.isascii() or not self.unusual.search(text):
            return self.words.findall(text.lower())
        # other scripts: the library's own normalisation and classes
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pre_tokens(self, text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
        """Pre-tokens of ``text``, and (place among them, id) of each added token found in it."""
        if not text:
            return [], []
        if not self.added_pattern.search(text):
            return self._plain_words(text), []
        words, special = [], []
        for k, part in enumerate(self.added_pattern.split(text)):
            if k % 2:
                special.append((len(words), self.added[part]))
            elif part:
                words += self._plain_words(part)
        return words, special

    def symbols(self, word: str) -> list[int]:
        names = [self.alphabet[b] for b in word.encode()]
        names[-1] += self.word_end
        return [self.vocabulary[n] for n in names if n in self.vocabulary]

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge neighbours by rank until no merge is left."""
        ranks, last = self.ranks, len(symbols) - 1
        right = [*range(1, last + 1), -1] if symbols else []
        left = list(range(-1, last))
        queue = []
        for at in range(last):
            if found := ranks.get((symbols[at], symbols[at + 1])):
                queue.append((found[0], at, symbols[at], symbols[at + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, at, a, b, made = heapq.heappop(queue)
            other = right[at]
            if other < 0 or symbols[at] != a or symbols[other] != b:
                continue
            symbols[at], symbols[other] = made, -1
            right[at] = after = right[other]
            right[other] = -1
            if after >= 0:
                left[after] = at
                if found := ranks.get((made, symbols[after])):
                    heapq.heappush(queue, (found[0], at, made, symbols[after], found[1]))
            before = left[at]
            if before >= 0 and (found := ranks.get((symbols[before], made))):
                heapq.heappush(queue, (found[0], before, symbols[before], made, found[1]))
        return [s for s in symbols if s >= 0]

    def packed(self, word: str) -> bytes:
        if (ids := self.known.get(word)) is None:
            ids = np.array(self.merge(self.symbols(word)), dtype="<u4").tobytes()
            if len(word) <= KEEP_CHARS:
                if len(self.known) >= KEEP:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        words, special = self.pre_tokens(text)
        get, packed = self.known.get, self.packed
        parts = [get(w) or packed(w) for w in words]
        for place, token in reversed(special):
            parts.insert(place, token.to_bytes(4, "little"))
        return b"".join(parts)

    def decode(self, ids: bytes | None) -> bytes:
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """The worker's codec of ``spec``, made once."""
    if spec not in _CODECS:
        _CODECS.clear()
        _CODECS[spec] = Codec(spec)
    return _CODECS[spec]


def spec_of(vocabulary: str = VOCABULARY) -> str:
    """The text of a public tokenizer file, by name."""
    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        return file.read()


def _mapped(docs: DataFrame, work, spec: str, out) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value)
        for batch in slices(batches):
            yield replaced(batch, **work(own, batch))

    return docs.mapInArrow(run, out)


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.names.index(name)).to_pylist()


def _encoded(own: Codec, batch: pa.RecordBatch) -> dict[str, pa.Array]:
    ids = [own.encode(text) for text in _column(batch, "text")]
    return {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64())}


def _decoded(own: Codec, batch: pa.RecordBatch) -> dict[str, pa.Array]:
    return {"decoded": pa.array([own.decode(i) for i in _column(batch, "ids")], pa.binary()).cast(pa.string())}


def _round_trip(own: Codec, batch: pa.RecordBatch) -> dict[str, pa.Array]:
    made = _encoded(own, batch)
    texts = [own.decode(i) for i in made["ids"].to_pylist()]
    return {**made, "decoded": pa.array(texts, pa.binary()).cast(pa.string())}


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``ids`` (packed) and ``n_tokens`` of ``text``."""
    rows = docs.withColumn("text", F.col("text").cast("string"))
    return _mapped(rows, _encoded, spec_of(vocabulary), schema_with(rows, ids="binary", n_tokens="bigint"))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``."""
    return _mapped(encoded, _decoded, spec_of(vocabulary), schema_with(encoded, decoded="string"))


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` less ``text``, with ``ids``, ``n_tokens`` and ``decoded``, in one pass over the texts."""
    rows = docs.withColumn("text", F.col("text").cast("string"))
    out = schema_with(rows, ids="binary", n_tokens="bigint", decoded="string")
    return without(_mapped(rows, _round_trip, spec_of(vocabulary), out), "text")
