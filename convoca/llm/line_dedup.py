"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

A line's key is the line without blanks at its ends, A-Z lower-cased; it is
stored as a 16-byte digest. ``LineIndex`` keeps three tables in one folder:

postings  one row per document and key it holds
refs      per key the exact number of documents holding it and the smallest id
filters   per shard a cuckoo filter with the keys of the shard

An insert asks the filters first. A key they do not know is new and is appended
without a look at ``refs``; only keys that hit are joined with it. A delete
lowers the counts, takes keys nobody holds any more out of the filters and
finds the next holder of keys that lost their smallest one, so that deleting
what was inserted restores the decisions of before.

Keys are reduced per task before they are shuffled, so a line in a third of all
documents costs one row per task. A shard has a bounded number of keys: their
number follows the number of keys, and the filters are built anew when it grows.

Defined results: a null text is one empty line. A row without ``doc_id`` holds
nothing and stays whole. Rows that share a ``doc_id`` are one document. Empty
tables give empty tables. Further columns pass through; an input column named
``n_lines`` or ``n_dropped`` is replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoca.llm.common import ASCII_LOWER, as_bytes, replaced, schema_with, slices, without
from convoca.sources.staging import shared_dir

BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
# keys in a shard; a shard is one group of one task
SHARD_KEYS = 50_000


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).translate(ASCII_LOWER)


def _long_enough(key: bytes, chars: int) -> bool:
    # a code point has at most four bytes
    return len(key) >= 4 * chars or (len(key) >= chars and len(key.decode("utf-8", "replace")) >= chars)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class Cuckoo:
    """Cuckoo filter over 16-byte digests: buckets of four 16-bit marks, an exact rest.

    A digest that finds no room after ``KICKS`` moves goes to ``rest``, so
    nothing is lost. Only digests known to be inside may be removed.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int):
        self.buckets = 1 << max(2, (int(capacity / (self.SLOTS * 0.8))).bit_length())
        self.marks = array("H", bytes(2 * self.SLOTS * self.buckets))
        self.rest: list[bytes] = []

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:8], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & (self.buckets - 1))

    def _find(self, bucket: int, mark: int) -> int:
        start = bucket * self.SLOTS
        for slot in range(start, start + self.SLOTS):
            if self.marks[slot] == mark:
                return slot
        return -1

    def __contains__(self, key: bytes) -> bool:
        mark, first, second = self._places(key)
        return self._find(first, mark) >= 0 or self._find(second, mark) >= 0 or key in self.rest

    def add(self, key: bytes) -> None:
        mark, first, second = self._places(key)
        moved = []
        for bucket in (first, second):
            if (slot := self._find(bucket, 0)) >= 0:
                self.marks[slot] = mark
                return
        bucket = second
        for step in range(self.KICKS):
            slot = bucket * self.SLOTS + step % self.SLOTS
            moved.append((slot, self.marks[slot]))
            self.marks[slot], mark = mark, self.marks[slot]
            bucket = self._other(bucket, mark)
            if (free := self._find(bucket, 0)) >= 0:
                self.marks[free] = mark
                return
        for slot, mark in reversed(moved):
            self.marks[slot] = mark
        self.rest.append(key)

    def remove(self, key: bytes) -> None:
        if key in self.rest:
            self.rest.remove(key)
            return
        mark, first, second = self._places(key)
        for bucket in (first, second):
            if (slot := self._find(bucket, mark)) >= 0:
                self.marks[slot] = 0
                return

    def dump(self) -> bytes:
        return self.buckets.to_bytes(4, "little") + self.marks.tobytes() + b"".join(self.rest)

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        made = cls.__new__(cls)
        made.buckets = int.from_bytes(data[:4], "little")
        end = 4 + 2 * cls.SLOTS * made.buckets
        made.marks = array("H")
        made.marks.frombytes(data[4:end])
        made.rest = [data[i : i + 16] for i in range(end, len(data), 16)]
        return made


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, key): the keys of at least ``min_chars`` code points of each document, each once."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, held = [], []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if doc is None or not text:
                    continue
                own = {k for line in text.split(b"\n") if _long_enough(k := line_key(line), min_chars)}
                held += [digest(k) for k in own]
                ids += [doc] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "key"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(keys, "doc_id bigint, key binary").distinct()


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _update(keys: pd.DataFrame, old: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Ask and change the filter of one shard.

    ``change``: 1 adds a key unless it seems to be inside, 2 adds it in any case, -1 takes it out.
    """
    shard = (keys if len(keys) else old)["shard"].iloc[0]
    cuckoo = Cuckoo.load(old["cuckoo"].iloc[0]) if len(old) else Cuckoo(capacity)
    known = []
    for key, change in zip(keys["key"], keys["change"], strict=True):
        inside = key in cuckoo
        known.append(inside)
        if change < 0:
            cuckoo.remove(key)
        elif not inside or change > 1:
            cuckoo.add(key)
    out = keys.assign(known=known, cuckoo=None) if len(keys) else keys.assign(known=None, cuckoo=None)
    state = pd.DataFrame({"shard": [shard], "key": [None], "change": [0], "known": [None], "cuckoo": [cuckoo.dump()]})
    return pd.concat([out, state], ignore_index=True)[["shard", "key", "change", "known", "cuckoo"]]


_ASKED = "shard int, key binary, change int, known boolean, cuckoo binary"


@dataclass
class LineIndex:
    """The state of the dedup. Every change writes new tables; the old ones stay readable."""

    spark: SparkSession
    folder: str
    min_chars: int = MIN_CHARS
    shard_keys: int = SHARD_KEYS
    shards: int = 0
    postings: DataFrame | None = None
    refs: DataFrame | None = None
    filters: DataFrame | None = None

    @classmethod
    def create(cls, spark: SparkSession, folder: str | None = None, **options) -> LineIndex:
        """An empty index in ``folder``, by default a new one in the session's shared folder."""
        return cls(spark, folder or f"{shared_dir(spark)}/line-index-{uuid.uuid4().hex}", **options)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _ask(self, keys: DataFrame, grown: int) -> tuple[DataFrame, DataFrame]:
        """Filters' answers for ``keys`` (key, change), and the filters after the change."""
        shards = max(1, -(-grown // self.shard_keys))
        filters = self.filters
        if filters is None or shards > self.shards:
            # room for as many keys again; all keys so far go into wider filters
            self.shards = max(1, 2 * shards - 1)
            if filters is not None:
                told = self.refs.select("key", F.lit(2).alias("change"))
                filters = self._grouped(told, None).filter("cuckoo is not null").select("shard", "cuckoo")
                filters = self._write(filters, "filters")
        asked = self._write(self._grouped(keys, filters), "asked")
        answers = asked.filter("cuckoo is null").select("key", "change", "known")
        return answers, asked.filter("cuckoo is not null").select("shard", "cuckoo")

    def _grouped(self, keys: DataFrame, filters: DataFrame | None) -> DataFrame:
        capacity = 2 * self.shard_keys
        sharded = keys.select(_shard(self.shards).alias("shard"), "key", "change").groupBy("shard")
        if filters is None:
            empty = pd.DataFrame({"shard": [], "cuckoo": []})
            return sharded.applyInPandas(lambda keys: _update(keys, empty, capacity), _ASKED)
        return sharded.cogroup(filters.groupBy("shard")).applyInPandas(
            lambda keys, old: _update(keys, old, capacity), _ASKED
        )

    def insert(self, docs: DataFrame) -> None:
        """Add the lines of ``docs``. Documents already inside are left as they are."""
        new = postings(docs, self.min_chars)
        if self.postings is not None:
            new = new.join(self.postings.select("doc_id").distinct(), "doc_id", "left_anti")
        new = self._write(new, "postings")
        batch = self._write(
            new.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")), "batch"
        )
        size = batch.count() + (0 if self.refs is None else self.refs.count())
        change = 2 if self.refs is None else 1
        answers, self.filters = self._ask(batch.select("key", F.lit(change).alias("change")), size)
        if self.refs is None:
            self.refs, self.postings = batch, new
            return
        maybe = batch.join(answers.filter("known").select("key"), "key", "left_semi")
        fresh = batch.join(answers.filter("known").select("key"), "key", "left_anti")
        # a hit may be a chance one: the exact table decides
        both = self.refs.unionByName(maybe).groupBy("key").agg(
            F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"), F.count(F.lit(1)).alias("rows")
        )
        both = self._write(both, "both")
        chance = maybe.join(self.refs.select("key"), "key", "left_anti").select("key", F.lit(2).alias("change"))
        self.refs = self._write(both.drop("rows").unionByName(fresh), "refs")
        # keys that hit by chance still need a mark of their own
        _, self.filters = self._ask(chance, size)
        self.postings = self._write(self.postings.unionByName(new), "postings")

    def delete(self, doc_ids: DataFrame) -> None:
        """Take out the documents of ``doc_ids`` (doc_id); those not inside are passed over."""
        if self.refs is None:
            return
        ids = doc_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
        gone = self._write(self.postings.join(ids, "doc_id", "left_semi"), "gone")
        left = self._write(self.postings.join(ids, "doc_id", "left_anti"), "postings")
        lowered = gone.groupBy("key").agg(F.count(F.lit(1)).alias("n_gone"), F.min("doc_id").alias("least_gone"))
        counted = self._write(
            self.refs.join(lowered, "key", "left").withColumn("n_left", F.col("n_docs") - F.coalesce("n_gone", F.lit(0))),
            "counted",
        )
        headless = counted.filter("n_left > 0 and least_gone = first_doc").select("key")
        heirs = left.join(headless, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("heir"))
        refs = (
            counted.filter("n_left > 0")
            .join(heirs, "key", "left")
            .select("key", F.col("n_left").alias("n_docs"), F.coalesce("heir", "first_doc").alias("first_doc"))
        )
        dead = counted.filter("n_left = 0").select("key", F.lit(-1).alias("change"))
        self.refs = self._write(refs, "refs")
        self.postings = left
        _, self.filters = self._ask(dead, self.refs.count())

    def repeated(self) -> DataFrame:
        """(key, first_doc) of the keys that at least two documents hold."""
        return self.refs.filter("n_docs >= 2").select("key", "first_doc")

    def dedup(self, docs: DataFrame) -> DataFrame:
        """``docs`` less the lines that an inserted document of a smaller id holds too.

        ``docs`` must have been inserted. ``text`` is what stays, joined by
        newlines; ``n_lines`` and ``n_dropped`` are added.
        """
        drops = (
            self.postings.join(self.repeated(), "key")
            .filter("doc_id <> first_doc")
            .groupBy(F.col("doc_id").alias("__doc"))
            .agg(F.collect_list("key").alias("__drop"))
        )
        rows = without(docs, "n_lines", "n_dropped")
        joined = rows.join(drops, rows["doc_id"].cast("bigint") == drops["__doc"], "left").drop("__doc")
        joined = joined.withColumn("text", F.col("text").cast("string"))
        out = schema_with(joined.drop("__drop", "text"), text="string", n_lines="bigint", n_dropped="bigint")
        kept = joined.mapInArrow(_kept, out)
        return kept.select(*[F.col(f"`{c}`") for c in rows.columns], "n_lines", "n_dropped")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        names = batch.schema.names
        texts, lines, dropped = [], [], []
        drop_lists = batch.column(names.index("__drop")).to_pylist()
        for text, drop in zip(as_bytes(batch.column(names.index("text"))), drop_lists, strict=True):
            own = (text or b"").split(b"\n")
            kept = own
            if drop:
                bad = set(drop)
                kept = [line for line in own if digest(line_key(line)) not in bad]
            texts.append(b"\n".join(kept))
            lines.append(len(own))
            dropped.append(len(own) - len(kept))
        rest = batch.select([n for n in names if n != "__drop"])
        yield replaced(
            rest,
            text=pa.array(texts, pa.binary()).cast(pa.string()),
            n_lines=pa.array(lines, pa.int64()),
            n_dropped=pa.array(dropped, pa.int64()),
        )


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """Insert ``docs`` into a new index and drop what repeats (see ``LineIndex.dedup``)."""
    index = LineIndex.create(docs.sparkSession, **options)
    index.insert(docs)
    return index.dedup(docs)
