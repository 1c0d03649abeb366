"""Bigram language model by Katz backoff, counted over all training documents.

A seen bigram gets its Good-Turing discounted share of its context, an unseen one
what the discounts leave, shared out like unigrams: p(w | u) = alpha(u) p(w) with
alpha(u) = (1 - sum of the seen shares) / (1 - sum of the seen words' p), so every
context adds up to one. Unigrams are discounted the same way; what is left goes
to one unknown word. Only where a caller limits the words by ``head_rows``, the
others share what is left with the unknown word, evenly.

What is counted, and how it stays whole and bounded:

* chunks: the texts are taken apart once and written as chunks of ``CHUNK_TOKENS``
  tokens, about: the chunk's distinct words as hashes, and every token by its
  word's place among them. All later steps read the chunks.
* unigrams: per chunk, then by word. The ``HEAD_ROWS`` most frequent words at most
  are sent to the tasks, with their counts, as a cache; other words, with the
  shards they stand in, meet the unigram table in a shuffle, and the shards use
  their counts for unigram probabilities and hand them on to the chunks.
* bigrams: the distinct ones of each chunk, with their training counts there, go
  in packed columns to shards by their context (of hot contexts, which are words
  with at least one in ``HOT`` of all tokens: by both words); the number of shards
  follows the number of tokens. A shard gets a bigram once a chunk at most,
  however frequent it is. It adds up the counts and answers every chunk: the
  counts of its bigrams, and of contexts with unseen ones what the backoff needs.
  No table holds anything by document and shard.
* The counts of counts of all shards give the discounts; then each chunk meets its
  answers, takes its bigrams in the same order again and adds up its documents.

A context whose followers all occur more than ``K`` times, and every hot context,
reserves one count for what is unseen. Discounts that Good-Turing cannot give
(too few counts) take half a count.

Defined results: a null or empty text is its end alone. Rows are scored one by
one, so repeated rows and ids repeat; a row without ``doc_id`` is learnt from. Without training documents every word is
unknown. Columns other than ``doc_id`` and ``text`` are not carried. Which rows share a
chunk changes no score, so the order in which they are read is of no account.
Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoca.llm.common import ASCII_LOWER, as_bytes, slices_of_text
from convoca.sources.staging import stage

HEAD_ROWS = 1 << 18
HOT = 2000
# tokens, about, whose bigrams a shard counts, and of a chunk
SHARD_TOKENS, CHUNK_TOKENS = 1_500_000, 1_500_000
# counts up to K are discounted
K = 5
# bytes of text a task takes apart at once
TEXT_BYTES = 2 << 20
_MASK = (1 << 63) - 1
# no token holds white space
END, START = b"\n", b"\t"


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) & _MASK


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").translate(ASCII_LOWER).split(), END]


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's factors for counts 1..K from counts of counts n[1..K+1]; index 0 is unused."""
    out = np.ones(K + 1)
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        good = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else -1.0
        d = (good - tail) / (1 - tail) if tail < 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Head:
    """What every task knows: frequent words with counts, discounts, totals, hot contexts."""

    hashes: np.ndarray
    counts: np.ndarray
    factors: np.ndarray
    # of all words that are neither in the head nor in the unigram table
    tail_log_p: float
    n: int
    v: int
    documents: int
    hot: np.ndarray

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the head's words, -1 for others."""
        return _place(self.hashes, hashes)

    def log_p(self, counts: np.ndarray) -> np.ndarray:
        """Logarithms of the unigram probabilities of words with these counts."""
        return np.log10(_discounted(counts, self.factors) / (self.n + 1))

    def p_log(self, counts: np.ndarray) -> np.ndarray:
        """The same, where words that were never counted have what is left."""
        out = np.full(len(counts), self.tail_log_p)
        out[counts > 0] = self.log_p(counts[counts > 0])
        return out

    def known(self, hashes: np.ndarray, tail: np.ndarray, tail_counts: np.ndarray) -> np.ndarray:
        """Training counts by hash; ``tail`` has the words known beside the head, in order."""
        out = np.zeros(len(hashes), np.int64)
        for words, counts in ((tail, tail_counts), (self.hashes, self.counts)):
            place = _place(words, hashes)
            out[place >= 0] = counts[place[place >= 0]]
        return out

    def hot_place(self, hashes: np.ndarray) -> np.ndarray:
        return _place(self.hot, hashes)


def _discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return np.where(counts <= K, factors[np.minimum(counts, K)], 1.0) * counts


def _place(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


def held_out() -> Column:
    """Rows not learnt from: the CRC-32 of the id, as text, leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


_CHUNK = "chunk bigint, n_tokens bigint, n_train bigint, ids binary, marks binary, sizes binary, words binary, stream binary"


def chunks(docs: DataFrame) -> DataFrame:
    """``docs`` as chunks: rows with their ids, marks and sizes, distinct words, and the tokens by their words' places."""
    most = CHUNK_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        number: dict[bytes, int] = {}
        ids, marks, sizes, held, size = [], [], [], [], 0

        def made() -> pa.RecordBatch:
            nonlocal first
            stream = np.concatenate(held)
            hashes = np.fromiter(map(word_hash, number), dtype=np.int64, count=len(number))
            # frequent words come first, as small numbers pack well
            order = np.argsort(-np.bincount(stream, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            mark = np.concatenate(marks)
            values = (
                first, len(stream), int((mark & 1 == 0).sum()),
                _packed(np.concatenate(ids).view(np.uint64)), _packed(mark), _packed(np.array(sizes)), _packed(hashes[order]), _packed(rank[stream]),
            )
            first += 1
            kinds = [pa.int64()] * 3 + [pa.binary()] * 5
            names = ["chunk", "n_tokens", "n_train", "ids", "marks", "sizes", "words", "stream"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in slices_of_text(batches, 2, TEXT_BYTES):
            flat: list[bytes] = []
            for text in as_bytes(batch.column(2)):
                before = len(flat)
                flat += tokens(text)
                sizes.append(len(flat) - before)
            new = set(flat).difference(number)
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            held.append(np.fromiter(map(number.__getitem__, flat), dtype=np.int32, count=len(flat)))
            ids.append(pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            marks.append(flags + 2 * pc.is_null(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.uint8))
            size += len(flat)
            if size >= most:
                yield made()
                number, ids, marks, sizes, held, size = {}, [], [], [], [], 0
        if sizes:
            yield made()

    columns = (F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.select(*columns).mapInArrow(run, _CHUNK)


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows as lists of values; a batch may have many chunks."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield [column[k].as_py() for column in batch.columns]


def _learnt(marks: bytes, sizes: bytes) -> np.ndarray:
    """Of each token of a chunk, whether its row is learnt from."""
    return np.repeat(_unpacked(marks)[0] & 1 == 0, _unpacked(sizes)[0])


def unigrams(parts: DataFrame) -> DataFrame:
    """(w, n): hash and count of every token of the training rows of chunks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, sizes, words, stream in _one_by_one(batches):
            hashes = _unpacked(words)[0]
            n = np.bincount(_unpacked(stream)[0][_learnt(marks, sizes)], minlength=len(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[n > 0]), pa.array(n[n > 0].astype(np.int64))], names=["w", "n"])

    found = parts.select("marks", "sizes", "words", "stream").mapInArrow(count, "w bigint, n bigint")
    return found.groupBy("w").agg(F.sum("n").alias("n"))


def head_of(words: DataFrame, documents: int, rows: int = HEAD_ROWS, only: bool = False) -> Head:
    """The head of the unigram table, within its bounds; ``only`` leaves other words without a probability of their own."""
    rank = F.floor(F.log2("n") * 16)
    total = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    n, v = total[0] or 0, total[1]
    least, taken = 1 << 30, 0
    for row in sorted(words.groupBy(rank.alias("rank")).count().collect(), reverse=True):
        if (taken := taken + row["count"]) > rows:
            break
        least = row["rank"]
    known = words.filter(rank >= least).select("w", "n").toArrow()
    hashes, counts = known["w"].to_numpy().astype(np.int64), known["n"].to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    few = {r["n"]: r["count"] for r in words.filter(F.col("n") <= K + 1).groupBy("n").count().collect()}
    d = discounts(np.array([0.0, *[few.get(r, 0) for r in range(1, K + 2)]]))
    if only:
        rest = (1.0 - _discounted(counts, d).sum() / (n + 1)) / (v - len(counts) + 1)
    else:
        rest = (1.0 + sum((1.0 - d[r]) * r * few.get(r, 0) for r in range(1, K + 1))) / (n + 1)
    hot = hashes[counts * HOT >= n] if n else hashes[:0]
    return Head(hashes, counts, d, float(np.log10(rest)), n, v, documents, np.sort(np.r_[hot, word_hash(START)]))


def _context_counts(head: Head, hot_place: np.ndarray) -> np.ndarray:
    """Training count of hot contexts; the start of a text counts once a document."""
    hashes = head.hot[hot_place]
    place = head.place(hashes)
    counts = head.counts[np.maximum(place, 0)] if len(head.counts) else np.zeros(len(place))
    return np.where(hashes == word_hash(START), head.documents, counts)


def _narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as hold them all."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _written(values: np.ndarray) -> bytes:
    """Numbers with the bytes of equal weight together, which pack better."""
    small = _narrow(values)
    return np.array([len(small), small.itemsize], np.int64).tobytes() + small.view(np.uint8).reshape(-1, small.itemsize).T.tobytes()


def _packed(*lists: np.ndarray) -> bytes:
    data = b"".join(map(_written, lists))
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> list[np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    plain = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    out, at = [], 0
    while at < size:
        n, width = map(int, np.frombuffer(plain, np.int64, 2, at))
        planes = np.frombuffer(plain, np.uint8, n * width, at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))
        at += 16 + n * width
    return out


@dataclass
class Bigrams:
    """A chunk's words and distinct bigrams, those of a shard together, in order of their contexts and words.

    Words are numbered in order of their codes: places in the head, or less than 0.
    """

    hashes: np.ndarray
    codes: np.ndarray
    # of the bigrams: contexts, words, training counts in the chunk, edges of shards
    u: np.ndarray
    w: np.ndarray
    n: np.ndarray
    edges: np.ndarray
    # of the tokens: words, bigrams
    word: np.ndarray
    pair: np.ndarray

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the bigrams of a context in a shard start, and how many they are."""
        new = np.r_[True, self.u[1:] != self.u[:-1]][: len(self.u)]
        new[self.edges[:-1][np.diff(self.edges) > 0]] = True
        starts = np.nonzero(new)[0]
        return starts, np.diff(np.r_[starts, len(self.u)])


def _numbered(words: bytes, stream: bytes, sizes: np.ndarray, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and codes of a chunk's words and the start in order of the codes, and the tokens' contexts and words by it."""
    hashes = np.r_[_unpacked(words)[0], word_hash(START)]
    place = head.place(hashes)
    codes = np.where(place >= 0, place, -1 - hashes)
    order = np.argsort(codes)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    w = rank[_unpacked(stream)[0]]
    u = np.roll(w, 1)
    u[np.cumsum(np.r_[0, sizes[:-1]])] = rank[-1]
    return hashes[order], codes[order], u, w


def _bigrams(words: bytes, stream: bytes, sizes: bytes, marks: bytes, head: Head, shards: int) -> Bigrams:
    hashes, codes, u, w = _numbered(words, stream, _unpacked(sizes)[0], head)
    key = u.astype(np.int64) * len(hashes) + w
    del u
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    starts = np.nonzero(new)[0]
    n = np.add.reduceat(_learnt(marks, sizes)[order].astype(np.int64), starts)
    pair = np.empty(len(order), np.int32)
    pair[order] = np.cumsum(new) - 1
    del new, order
    key = key[starts]
    pu, pw = (key // len(hashes)).astype(np.int32), (key % len(hashes)).astype(np.int32)
    del key, starts
    shard = _shard(hashes[pu], hashes[pw], head.hot_place(hashes)[pu] >= 0, shards)
    order = np.argsort(shard, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    return Bigrams(hashes, codes, pu[order], pw[order], n[order], edges, w, rank[pair])


def _asked(parts: DataFrame, head: Head, shards: int) -> DataFrame:
    """(shard, chunk, packed): the distinct bigrams of every chunk, by shard."""
    shipped = parts.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, *data in _one_by_one(batches):
            names, packed = _pack(_bigrams(*data, shipped.value, shards), len(shipped.value.hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), pa.array([chunk] * len(names), pa.int64()), pa.array(packed, pa.binary())],
                names=["shard", "chunk", "packed"],
            )

    return parts.select("chunk", "words", "stream", "sizes", "marks").mapInArrow(run, "shard int, chunk bigint, packed binary")


def _pack(found: Bigrams, head_size: int) -> tuple[list[int], list[bytes]]:
    """By shard: contexts, outside the head as hashes and in it by their steps, with the numbers of their bigrams;
    words outside the head as hashes, all words by their places in the head and behind it; counts."""
    names, packed = [], []
    starts, sizes = found.runs()
    for s in np.nonzero(np.diff(found.edges))[0]:
        part = slice(found.edges[s], found.edges[s + 1])
        own = slice(*np.searchsorted(starts, found.edges[s : s + 2]))
        contexts = found.codes[found.u[starts[own]]]
        tail = int(np.searchsorted(contexts, 0))
        outside, places = _outside(found, part, head_size)
        lists = (-1 - contexts[:tail], np.diff(contexts[tail:], prepend=0), sizes[own], found.hashes[outside], places, found.n[part])
        names.append(int(s))
        packed.append(_packed(*lists))
    return names, packed


def _outside(found: Bigrams, part: slice, head_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a shard's bigrams: the distinct words outside the head, and every word's place, those of the head first."""
    w = found.w[part]
    places = found.codes[w]
    outside, at = np.unique(w[places < 0], return_inverse=True)
    places[places < 0] = head_size + at
    return outside, places


def _unpack(data: bytes, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of contexts, with the numbers of their bigrams; hashes of words outside the head; places of words, and counts."""
    tail, steps, sizes, outside, places, n = _unpacked(data)
    return np.r_[tail, head[np.cumsum(steps)]], sizes, outside, places, n


def _shard(u: np.ndarray, w: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """Shards of bigrams, in as few bytes as hold them."""
    shard = (_spread(u, w, hot) * shards) >> 32
    return shard.astype(np.uint16) if shards <= 1 << 16 else shard


def _spread(u: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Places of bigrams in a range of 32 bits, over which hashes are even: a shard is a part of it."""
    return np.where(hot, _mixed(u, w), u) >> 31


def _mixed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of both words, of 63 bits."""
    mixed = (u.view(np.uint64) ^ (w.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64) & _MASK


_ANSWER = "chunk bigint, shard int, packed binary, counts array<bigint>, hot array<int>, hot_stats array<double>"


def _answers(asked: list[bytes], head: Head, tail: np.ndarray, tail_counts: np.ndarray, only: bool = False) -> tuple[list[bytes], dict]:
    """A shard's answers to what chunks have asked, and its counts of counts and hot contexts' parts.

    ``tail`` has the hashes, in order, of the shard's words that only the unigram table knows;
    with ``only`` they count for the base scores and have no probability of their own.
    An answer has the counts of the bigrams; twice their contexts' totals, and one more for
    those that reserve a count; of those with unseen bigrams the numbers of followers by
    discounted count, the sum of the other counts and the bits of the seen words' probability;
    the training counts of words outside the head.
    """
    lists = [[], [], [], [], []]
    for data in asked:
        for held, values in zip(lists, _unpack(data, head.hashes), strict=True):
            held.append(values)
    asked.clear()
    # where each chunk's bigrams, contexts and words outside the head end
    ends, runs, outer = (np.cumsum([0, *map(len, lists[i])]) for i in (4, 1, 2))
    contexts, sizes, outside, places, n = map(np.concatenate, lists)
    lists.clear()
    u = np.repeat(contexts, sizes)
    w = np.empty(len(places), np.int64)
    inside = places < len(head.hashes)
    w[inside] = head.hashes[places[inside]]
    w[~inside] = outside[(places + np.repeat(outer[:-1] - len(head.hashes), np.diff(ends)))[~inside]]
    del contexts, places, inside
    # bigrams are told apart by the hash of both words
    _, first, pair = np.unique(_mixed(u, w), return_index=True, return_inverse=True)
    pair = pair.astype(np.int32)
    pu, pw = u[first], w[first]
    del u, w, first
    c = np.bincount(pair, n, minlength=len(pu)).astype(np.int64)
    del n, _
    cu, context = np.unique(pu, return_inverse=True)
    context = context.astype(np.int32)
    hot = head.hot_place(cu)
    seen = c > 0
    p = 10.0 ** head.p_log(head.known(pw[seen], tail[:0], tail_counts[:0]) if only else head.known(pw[seen], tail, tail_counts))
    del pu, pw
    # per context: discounted counts 1..K, the sum of the others, the seen words' probabilities
    stats = np.zeros((len(cu), K + 2))
    for r in range(1, K + 1):
        stats[:, r - 1] = np.bincount(context[c == r], minlength=len(cu))
    stats[:, K] = np.bincount(context[c > K], c[c > K], minlength=len(cu))
    stats[:, K + 1] = np.bincount(context[seen], p, minlength=len(cu))
    total = stats[:, :K] @ np.arange(1, K + 1) + stats[:, K]
    total[hot >= 0] = _context_counts(head, hot[hot >= 0])
    reserving = ((stats[:, :K].sum(axis=1) == 0) | (hot >= 0)) & (total > 0)
    c_asked, starts = c[pair], np.cumsum(sizes) - sizes
    which = context[pair[starts]]
    totals = (2 * total.astype(np.int64) + reserving)[which]
    lone = np.nonzero(np.minimum.reduceat(c_asked, starts) == 0)[0]
    table, edges = stats[which[lone]], np.searchsorted(lone, runs)
    known = head.known(outside, tail, tail_counts)
    made = []
    for k in range(len(ends) - 1):
        few = table[edges[k] : edges[k + 1]]
        made.append(
            _packed(
                c_asked[ends[k] : ends[k + 1]],
                totals[runs[k] : runs[k + 1]],
                few[:, :K].T.ravel().astype(np.int64),
                few[:, K].astype(np.int64),
                np.ascontiguousarray(few[:, K + 1]).view(np.uint64),
                known[outer[k] : outer[k + 1]],
            )
        )
    hots = np.nonzero(hot >= 0)[0]
    counts = np.bincount(np.minimum(c[seen], K + 2), minlength=K + 3)
    return made, {"counts": counts.tolist(), "hot": hot[hots].tolist(), "hot_stats": stats[hots].ravel().tolist()}


def _tails(parts: DataFrame, words: DataFrame, head: Head, shards: int) -> DataFrame:
    """(shard, w, n): by shard, its words outside the head with their training counts."""
    shipped = parts.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, stream, sizes in _one_by_one(batches):
            hashes, codes, u, w = _numbered(data, stream, _unpacked(sizes)[0], shipped.value)
            outside = codes[w] < 0
            u, w = u[outside], w[outside]
            shard = _shard(hashes[u], hashes[w], shipped.value.hot_place(hashes)[u] >= 0, shards)
            w, shard = np.divmod(np.unique(w.astype(np.int64) * shards + shard), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(hashes[w])], names=["shard", "w"])

    asked = parts.select("words", "stream", "sizes").mapInArrow(run, "shard int, w bigint")
    return asked.join(words, "w").select("shard", "w", "n")


def _answered(asked: DataFrame, tails: DataFrame, head: Head, only: bool) -> DataFrame:
    """The shards' answers, a row for each chunk, and a row for each shard, with chunk -1, of its counts of counts and hot contexts."""
    shipped = asked.sparkSession.sparkContext.broadcast(head)

    def run(shard: pd.DataFrame, tail: pd.DataFrame) -> pd.DataFrame:
        w, first = np.unique(tail["w"].to_numpy(np.int64), return_index=True)
        n = tail["n"].to_numpy(np.int64)[first]
        asking = [*shard["chunk"], -1]
        made, own = _answers(list(shard["packed"]), shipped.value, w, n, only)
        columns = {name: [[]] * len(made) + [value] for name, value in own.items()}
        return pd.DataFrame({"chunk": asking, "shard": [shard["shard"].iloc[0]] * len(asking), "packed": [*made, b""], **columns})

    return asked.groupBy("shard").cogroup(tails.groupBy("shard")).applyInPandas(run, _ANSWER)


def _alpha(stats: np.ndarray, total: np.ndarray, whole: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 of the backoff weights; contexts never seen leave it all to the unigrams."""
    given = stats[:, :K] @ (d[1:] * np.arange(1, K + 1)) + stats[:, K]
    left = 1.0 - given / np.maximum(whole, 1)
    return np.where(total > 0, np.log10(np.maximum(left, 1e-300)) - np.log10(np.maximum(1.0 - stats[:, K + 1], 1e-300)), 0.0)


def _values(found: Bigrams, answers: list[bytes], head: Head, d: np.ndarray, hot_alpha: np.ndarray, only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a chunk's bigrams, and training counts of its words, from the answers in order of their shards."""
    starts, sizes = found.runs()
    c, totals, lone, known = [], [], [], np.zeros(len(found.hashes), np.int64)
    inside = found.codes >= 0
    known[inside] = head.counts[found.codes[inside]]
    asked = np.nonzero(np.diff(found.edges))[0]
    for s, data in zip(asked, answers, strict=True):
        own, total, few, more, seen, n = _unpacked(data)
        c.append(own.astype(np.int32) if len(own) and own.max() < 1 << 31 else own)
        totals.append(total)
        lone.append(np.c_[few.reshape(K, -1).T, more, seen.view(np.float64)])
        w = found.w[found.edges[s] : found.edges[s + 1]]
        known[np.unique(w[found.codes[w] < 0])] = n
    c, totals, lone = np.concatenate(c), np.concatenate(totals), np.concatenate(lone)
    total = totals >> 1
    whole = total + (totals & 1)
    few = np.minimum(c, K)
    value = np.log10(np.maximum(np.where(c <= K, d[few] * few, c), 1e-300)) - np.log10(np.maximum(np.repeat(whole, sizes), 1))
    # what contexts with unseen bigrams leave
    some = np.nonzero(np.minimum.reduceat(c, starts) == 0)[0]
    hot = head.hot_place(found.hashes[found.u[starts[some]]])
    alpha = np.zeros(len(starts))
    alpha[some] = np.where(hot >= 0, hot_alpha[np.maximum(hot, 0)], _alpha(lone, total[some], whole[some], d))
    unseen = np.nonzero(c == 0)[0]
    p_log = head.p_log(np.where(inside, known, 0) if only else known)
    value[unseen] = np.repeat(alpha, sizes)[unseen] + p_log[found.w[unseen]]
    return value, known


def _scored(parts: DataFrame, answered: DataFrame, head: Head, shards: int, d: np.ndarray, hot_alpha: np.ndarray, only: bool) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, logs, score): the rows of all chunks."""
    shipped = parts.sparkSession.sparkContext.broadcast((head, d, hot_alpha))

    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own, factors, weights = shipped.value
        data = {name: chunk[name].iloc[0] for name in ("words", "stream", "sizes", "marks")}
        found = _bigrams(**data, head=own, shards=shards)
        packed = list(answers.sort_values("shard")["packed"])
        value, known = _values(found, packed, own, factors, weights, only)
        sizes, marks = _unpacked(data["sizes"])[0], _unpacked(data["marks"])[0]
        row = np.repeat(np.arange(len(sizes)), sizes)
        # sums follow the order of the text, so they do not depend on the chunk
        added = lambda values: np.bincount(row, values, minlength=len(sizes))
        return pd.DataFrame(
            {
                "doc_id": pd.arrays.IntegerArray(_unpacked(chunk["ids"].iloc[0])[0], marks >= 2),
                "held_out": marks & 1 == 1,
                "n_tokens": sizes,
                "n_known": added((known > 0)[found.word]).astype(np.int64),
                "logs": added(np.log10(known + 1.0)[found.word]),
                "score": added(value[found.pair]),
            }
        )

    columns = parts.select("chunk", "ids", "marks", "sizes", "words", "stream").groupBy("chunk")
    return columns.cogroup(answered.groupBy("chunk")).applyInPandas(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double"
    )


def _hot_alpha(summaries: DataFrame, head: Head, d: np.ndarray) -> np.ndarray:
    """Backoff weights of the hot contexts, whose counts lie in all shards."""
    width = K + 2
    parts = summaries.select(F.explode(F.arrays_zip("hot", F.sequence(F.lit(0), F.size("hot") - 1).alias("i"))).alias("h"), "hot_stats") \
        .filter("h.hot is not null") \
        .select("h.hot", *[F.get("hot_stats", F.col("h.i") * width + j).alias(f"s{j}") for j in range(width)])
    stats = np.zeros((len(head.hot), width))
    for r in parts.groupBy("hot").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)]).collect():
        stats[r["hot"]] = [r[f"s{j}"] for j in range(width)]
    total = _context_counts(head, np.arange(len(head.hot)))
    return _alpha(stats, total, total + 1.0, d)


def scores(
    docs: DataFrame, head_rows: int | None = None, shard_tokens: int = SHARD_TOKENS, cached_rows: int = HEAD_ROWS
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    All words of the training documents have their own probability. ``cached_rows``
    bounds those sent to the tasks and changes no score. A caller who wants a
    smaller vocabulary in ``score`` limits it to ``head_rows`` words.
    """
    only = head_rows is not None
    parts = stage(chunks(docs), "chunks")
    size, documents = parts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    words = stage(unigrams(parts), "unigrams")
    head = head_of(words, documents, head_rows if only else cached_rows, only)
    shards = max(1, -(-size // shard_tokens))
    tails = _tails(parts, words, head, shards)
    answered = stage(_answered(_asked(parts, head, shards), tails, head, only), "bigram-shards")
    of_shards = answered.filter("chunk < 0")
    counted = of_shards.select(F.posexplode("counts").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(K + 3)
    for r in counted:
        n[r["r"]] = r["n"]
    d = discounts(n)
    hot_alpha = _hot_alpha(of_shards, head, d)
    answers = answered.filter("chunk >= 0").select("chunk", "shard", "packed")
    level = float(np.log10(head.n + head.v + 1))
    return _scored(parts, answers, head, shards, d, hot_alpha, only).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(head.n).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * level).alias("base_score"),
        "score",
    )
