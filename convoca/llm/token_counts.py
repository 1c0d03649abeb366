"""Token counts of documents without making ids.

The number of tokens of a text is the sum over its pre-tokens of their numbers
of pieces, and a corpus has far fewer distinct pre-tokens than pre-tokens:

1. every task counts the pre-tokens of its documents; the counts are added up,
   and each distinct pre-token is split into pieces once (``vocabulary``);
2. the frequent ones - at most ``HEAD_ROWS``, none longer than ``HEAD_BYTES``, a
   fixed bound - are sent to the tasks and joined there with the pre-token
   frequencies of each document. They hold the hot keys and most of the text;
3. the frequencies of the others are shuffled to the rest of the vocabulary and
   summed per document.

Defined results: a null text is empty, with no bytes and no tokens. Rows are
counted one by one, so repeated rows and repeated ids give repeated results.
Columns other than ``doc_id`` and ``text`` are not carried. Empty tables give
empty tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoca.llm.bpe import VOCABULARY, codec, spec_of
from convoca.llm.common import slices
from convoca.sources.staging import stage

# bounds of what is sent to every task
HEAD_ROWS, HEAD_BYTES = 1 << 18, 256
# distinct pre-tokens a task holds before it hands them on
HELD = 300_000
LIMIT = 2048


def vocabulary(docs: DataFrame, tokenizer: str = VOCABULARY) -> DataFrame:
    """(word, n, pieces): every pre-token of ``docs``, its frequency and number of pieces."""
    spec = docs.sparkSession.sparkContext.broadcast(spec_of(tokenizer))

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = codec(spec.value), Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.update(own.pre_tokens(text)[0])
                if len(held) >= HELD:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        tokenize, alphabet = own.library.model.tokenize, own.alphabet
        for batch in batches:
            words = batch.column(0).to_pylist()
            pieces = [len(tokenize("".join([alphabet[b] for b in w.encode()]))) for w in words]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pieces, pa.int64())], names=["word", "n", "pieces"]
            )

    words = docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n bigint")
    totals = words.groupBy("word").agg(F.sum("n").alias("n"))
    return totals.mapInArrow(split, "word string, n bigint, pieces bigint")


def _head(words: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent words, at most ``rows`` of them, and the others."""
    rank = F.floor(F.log2("n") * 16)
    short = F.octet_length("word") <= HEAD_BYTES
    ranks = words.filter(short).groupBy(rank.alias("rank")).count().collect()
    least, taken = 1 << 30, 0
    for row in sorted(ranks, reverse=True):
        if (taken := taken + row["count"]) > rows:
            break
        least = row["rank"]
    inside = short & (rank >= least)
    return words.filter(inside), words.filter(~inside)


def token_counts(docs: DataFrame, tokenizer: str = VOCABULARY, limit: int = LIMIT, head_rows: int = HEAD_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    words = stage(vocabulary(docs, tokenizer), "vocabulary")
    head, rest = _head(words, head_rows)
    context = docs.sparkSession.sparkContext
    known = head.select("word", "pieces").toArrow()
    sent = context.broadcast((known["word"].to_pylist(), known["pieces"].to_pylist()))
    spec = context.broadcast(spec_of(tokenizer))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces = codec(spec.value), dict(zip(*sent.value, strict=True))
        for batch in slices(batches):
            n_bytes, n_known, others = [], [], []
            for text in batch.column(2).to_pylist():
                found, special = own.pre_tokens(text)
                total, left = len(special), []
                for word, n in Counter(found).items():
                    if (size := pieces.get(word)) is None:
                        left.append({"word": word, "f": n})
                    else:
                        total += n * size
                n_bytes.append(len((text or "").encode()))
                n_known.append(total)
                others.append(left)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_known, pa.int64()),
                    pa.array(others, pa.list_(pa.struct([("word", pa.string()), ("f", pa.int64())]))),
                ],
                names=["row", "doc_id", "n_bytes", "n_known", "others"],
            )

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    by_doc = numbered.mapInArrow(
        frequencies, "row bigint, doc_id bigint, n_bytes bigint, n_known bigint, others array<struct<word:string,f:bigint>>"
    )
    pairs = by_doc.select("row", "doc_id", "n_bytes", "n_known", F.explode_outer("others").alias("o")).select(
        "row", "doc_id", "n_bytes", "n_known", "o.word", "o.f"
    )
    total = F.col("n_known") + F.coalesce(F.sum(F.col("f") * F.col("pieces")), F.lit(0))
    counted = (
        pairs.join(rest.select("word", "pieces"), "word", "left")
        .groupBy("row", "doc_id", "n_bytes", "n_known")
        .agg(total.alias("n_tokens"))
    )
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
