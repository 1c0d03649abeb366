"""Spelling variants of a corpus: words one edit apart, found over a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols. Two words one edit apart have reduced
words at most one edit apart, so each distinct reduced word generates its full
one-edit neighbourhood (itself, every deletion, replacement and insertion over the
few symbols), which is joined with the reduced vocabulary; what meets is verified
on the original strings. Neighbourhoods are symmetric, so of two reduced words
only the one with the smaller hash asks for the other and every pair is met once.

Scale: runs of letters become counts before they are shuffled. Only words of at
least ``min_length`` letters and ``min_count`` occurrences enter the joins, which
are equi-joins on a hash of a reduced word and on the reduced word; candidates are
verified inside the join and go no further. A word has a bounded number of near
words (letters x places), so no group grows with the corpus. Neighbourhoods are
worked out in pieces of ``KEYS_AT_ONCE`` keys, or a word's own, some 16 a letter. Chains of
forms are followed by doubling: a form is ``ratio`` times as frequent as its word,
so there are few rounds.

Defined results: a null or empty text has no words; a null ``doc_id`` counts as
empty text in the checksum. Repeated documents count each time. Of
equally frequent near words the least in code-point order is the form. No
documents, or no word frequent enough, give an empty table. Other columns of the
documents are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoca.llm.common import ASCII_LOWER
from convoca.sources.staging import full_width, stage

RUN = re.compile(r"[A-Za-z\u00C0-\u00FF]+")
SYMBOLS = 8
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
# distinct words counted in a task before they are handed on
WORDS_AT_ONCE = 100_000
# neighbours held at once in a task
KEYS_AT_ONCE = 1 << 20
# odd multiplier of the hash of a reduced word; powers and sums wrap at 64 bits
BASE = 0x9E3779B97F4A7C15


def symbol_table(symbols: int = SYMBOLS) -> np.ndarray:
    """Symbol (from 1) of every letter by its Latin-1 code: a multiplicative hash of the code."""
    codes = np.arange(256, dtype=np.uint64)
    return ((codes * np.uint64(2654435761) >> np.uint64(13)) % np.uint64(symbols) + np.uint64(1)).astype(np.uint8)


def damaged(prefix: int, run: str, every: int) -> str:
    """``run`` less one code point where ``every`` divides its checksum, continued from ``prefix``."""
    at = zlib.crc32(run.encode(), prefix)
    if at % every:
        return run
    place = at % len(run)
    return run[:place] + run[place + 1 :]


def letter_runs(docs: DataFrame, misspell_every: int | None = None) -> DataFrame:
    """(word, n): partial counts of the maximal runs of letters of every text, A-Z lower-cased.

    With ``misspell_every``, a run whose CRC-32 of ``doc_id:run`` it divides loses
    the code point at that number modulo its length, the same in the whole document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def made() -> pa.RecordBatch:
            out = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                words = RUN.findall(text.as_buffer().to_pybytes().translate(ASCII_LOWER).decode())
                if misspell_every:
                    prefix = zlib.crc32(f"{name or ''}:".encode())
                    for word, n in Counter(words).items():
                        counts[damaged(prefix, word, misspell_every)] += n
                else:
                    counts.update(words)
                if len(counts) > WORDS_AT_ONCE:
                    yield made()
        yield made()

    columns = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("binary"))
    return columns.mapInArrow(run, "word string, n bigint")


def word_counts(runs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the frequent long words of ``runs`` (word, n), which may repeat words."""
    counted = runs.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and letter codes of the words of each length."""
    rows = defaultdict(list)
    for at, word in enumerate(words):
        rows[len(word)].append(at)
    for length, at in rows.items():
        codes = np.frombuffer(b"".join(words[i] for i in at), dtype=np.uint8).reshape(len(at), length)
        yield np.array(at), codes


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each reduced word, given as bytes of symbols."""
    out = np.zeros(len(words), dtype=np.uint64)
    for at, codes in _by_length(words):
        if codes.shape[1]:
            out[at] = (codes.astype(np.uint64) * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def neighbourhoods(words: list[bytes], symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of ``words`` (bytes of symbols) and hashes of their one-edit neighbours, each once a word.

    A neighbour's hash comes from the sums before and after the place of the edit.
    """
    for at, codes in _by_length(words):
        length = codes.shape[1]
        width = 1 + length + length * (symbols - 1) + (length + 1) * symbols
        step = max(1, KEYS_AT_ONCE // width)
        for start in range(0, len(at), step):
            rows, part = at[start : start + step], codes[start : start + step].astype(np.uint64)
            power = _powers(length + 1)
            terms = part * power[:length]
            before = np.zeros((len(rows), length + 1), dtype=np.uint64)
            np.cumsum(terms, axis=1, out=before[:, 1:])
            whole = before[:, -1]
            after = whole[:, None] - before  # of the places from each one on
            # what follows a deletion moves one place down: its terms lose one factor
            shifted = np.zeros_like(before)
            np.cumsum(part[:, 1:] * power[: length - 1], axis=1, out=shifted[:, 1:length])
            shifted = shifted[:, length - 1 : length] - shifted if length else shifted
            keys = [whole[:, None], before[:, :length] + shifted[:, :length]]
            for symbol in range(1, symbols + 1):
                new = np.uint64(symbol)
                keys.append(whole[:, None] + (new - part) * power[:length])
                keys.append(before + new * power + after * np.uint64(BASE))
            found = np.sort(np.concatenate(keys, axis=1), axis=1)
            fresh = np.ones(found.shape, dtype=bool)
            fresh[:, 1:] = found[:, 1:] != found[:, :-1]
            yield np.repeat(rows, fresh.sum(axis=1)), found[fresh].view(np.int64)


def _reduced(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """(word, n, reduced, code): the reduced word as bytes, and its hash."""
    table = symbol_table(symbols).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [w.encode("latin-1").translate(table) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.binary()), pa.array(hashes(made))],
                names=["word", "n", "reduced", "code"],
            )

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n bigint, reduced binary, code bigint")


def _asked(reduced: DataFrame, symbols: int) -> DataFrame:
    """(reduced, code): reduced words and the hashes, not below their own, of their neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            own = hashes(words)
            for rows, keys in neighbourhoods(words, symbols):
                keep = keys >= own[rows]
                taken = batch.column(0).take(pa.array(rows[keep]))
                yield pa.RecordBatch.from_arrays([taken, pa.array(keys[keep])], names=["reduced", "code"])

    return full_width(reduced.select("reduced").distinct(), "reduced").mapInArrow(run, "reduced binary, code bigint")


def near_pairs(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, other, other_n): every two words of ``vocabulary`` (word, n) exactly one edit apart, once.

    ``vocabulary`` holds distinct words of Latin-1 letters.
    """
    reduced = stage(_reduced(full_width(vocabulary, "word"), symbols), "reduced")
    asked = _asked(reduced, symbols)
    met = asked.join(
        reduced.select("code", F.col("word").alias("other"), F.col("n").alias("other_n")), "code"
    ).withColumnRenamed("code", "other_code")
    apart = F.levenshtein("word", "other", 1) == 1
    # words of one hash meet from both sides
    once = (F.col("code") != F.col("other_code")) | (F.col("word") < F.col("other"))
    pairs = met.join(reduced.hint("shuffle_merge"), "reduced").filter(once & apart)
    return pairs.select("word", "n", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last word reached, by doubling."""
    current = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(
            current.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots",
        )
        if not moved.filter("moved").limit(1).count():
            return moved.select("word", "root")
        current = moved.select("word", "root")


def variants(vocabulary: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``vocabulary`` (word, n).

    ``form`` is the most frequent near word where it is at least ``ratio`` times as
    frequent as the word, ``root`` the last form of the chain, the word itself if it has none.
    """
    vocabulary = stage(vocabulary, "vocabulary")
    pairs = near_pairs(vocabulary, symbols)
    way = lambda a, b, n: F.struct(F.col(a).alias("word"), F.struct((-F.col(n)).alias("n"), F.col(b).alias("word")).alias("near"))
    both = pairs.select(F.explode(F.array(way("word", "other", "other_n"), way("other", "word", "n"))).alias("p"))
    best = both.groupBy(F.col("p.word").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min("p.near").alias("best")
    )
    chosen = -F.col("best.n") >= ratio * F.col("n")
    found = stage(
        vocabulary.join(best, "word", "left").select(
            "word",
            F.when(chosen, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(chosen, -F.col("best.n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
