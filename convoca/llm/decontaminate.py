"""Benchmark decontamination by winnowing, in DataFrame expressions only.

A document word is hit when it lies inside an occurrence of a benchmark window:
``WINDOW`` consecutive words of an item, or all words of a shorter item.

1. Of the ``KGRAM``-word hashes within each window the least is kept. Equal
   windows keep equal hashes, so every shared window shares a fingerprint. A run
   of windows keeping the same hash is one row.
2. Fingerprints of the documents are joined with those of the benchmark. The
   benchmark's are broadcast up to ``BROADCAST_ROWS`` rows and shuffled beyond.
   Windows of shorter items are hashed whole, one pass per length that occurs.
3. Hits are extended to the windows they stand for, and these are compared with
   the items' windows word by word. Only texts with hits are read again, and of
   equal texts one.
4. Matching windows are united per text, so overlapping ones count a word once.

Defined results: null and empty texts have no words, hit nothing and are clean.
Items without words or without ``item_id`` are passed over; repeated items count
once. Every row of the documents gives a row; repeated rows repeat. Columns other
than ``doc_id`` and ``text`` are not carried by ``contamination``; ``drop_contaminated``
keeps all. Empty tables give empty tables, an empty benchmark marks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoca.llm.common import ascii_lower
from convoca.sources.staging import broadcast_if_small, stage

WINDOW, KGRAM = 13, 8
# a document is contaminated when one word in SHARE is hit
SHARE = 20
BROADCAST_ROWS = 500_000
# fixed value: the bytes that separate words once A-Z are lower-cased
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def _from_zero(upto: Column) -> Column:
    """0 .. ``upto``, nothing when that is negative."""
    return F.when(upto >= 0, F.sequence(F.lit(0), upto)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: str, size: int, n: str) -> Column:
    """Hash of the ``size`` words from each place on."""
    return F.transform(
        _from_zero(F.col(n) - size), lambda i: F.xxhash64(*[F.get(F.col(hashes), i + j) for j in range(size)])
    )


def _kept(grams: str, window: int, kgram: int) -> Column:
    """The least k-gram hash of each window."""
    width = window - kgram + 1
    return F.transform(
        _from_zero(F.size(grams) - width), lambda i: F.least(*[F.get(F.col(grams), i + j) for j in range(width)])
    )


def _hashed(rows: DataFrame, kgram: int, window: int) -> DataFrame:
    """``rows`` (with ``text``) plus __n, __h (word hashes), __kept (fingerprint per window)."""
    rows = rows.withColumn("__w", words(F.col("text")))
    rows = rows.withColumn("__n", F.size("__w")).withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("__g", _grams("__h", kgram, "__n"))
    return rows.withColumn("__kept", _kept("__g", window, kgram)).drop("__g")


def item_windows(benchmark: DataFrame, window: int = WINDOW, kgram: int = KGRAM) -> DataFrame:
    """(item_id, size, print, words): every window of every item, its fingerprint and its words as text."""
    items = benchmark.filter("item_id is not null").select("item_id", F.col("text").cast("string").alias("text"))
    items = _hashed(items.dropDuplicates(), kgram, window).filter("__n > 0")
    whole = F.array(
        F.struct(
            F.col("__n").alias("size"),
            F.xxhash64("__h").alias("print"),
            F.concat_ws(" ", "__w").alias("words"),
        )
    )
    each = F.transform(
        "__kept",
        lambda p, i: F.struct(
            F.lit(window).alias("size"),
            p.alias("print"),
            F.concat_ws(" ", F.slice("__w", i + 1, F.lit(window))).alias("words"),
        ),
    )
    found = items.select("item_id", F.explode(F.when(F.col("__n") < window, whole).otherwise(each)).alias("w"))
    return found.select("item_id", "w.size", "w.print", "w.words").distinct()


def _runs(window: int) -> Column:
    """(print, start, windows, size): windows in a row that keep the same hash are one run."""
    kept = F.col("__kept")
    starts = F.filter(
        _from_zero(F.size("__kept") - 1), lambda i: (i == 0) | (F.get(kept, i) != F.get(kept, i - 1))
    )
    return F.transform(
        starts,
        lambda s: F.struct(
            F.get(kept, s).alias("print"), s.alias("start"), F.lit(0).alias("windows"), F.lit(window).alias("size")
        ),
    )


def _short(size: int) -> Column:
    return F.transform(
        _from_zero(F.col("__n") - size),
        lambda i: F.struct(
            F.xxhash64(F.slice("__h", i + 1, F.lit(size))).alias("print"),
            i.alias("start"),
            F.lit(1).alias("windows"),
            F.lit(size).alias("size"),
        ),
    )


def _with_ends(runs: str) -> Column:
    """Runs with the number of their windows: up to the next run of the document."""
    return F.transform(
        F.col(runs),
        lambda r, j: F.struct(
            r["print"].alias("print"),
            r["start"].alias("start"),
            (F.coalesce(F.get(F.col(runs), j + 1)["start"], F.size("__kept")) - r["start"]).alias("windows"),
            r["size"].alias("size"),
        ),
    )


def _hits(docs: DataFrame, windows: DataFrame, window: int, kgram: int) -> DataFrame:
    """(doc_id, mark, print, start, windows, size) of the hits, and a row of size 0 per document.

    ``mark`` is the hash of the text; the row of size 0 holds the number of words in ``windows``.
    """
    sizes = [r["size"] for r in windows.filter(F.col("size") < window).select("size").distinct().collect()]
    rows = _hashed(docs, kgram, window).withColumn("__long", _runs(window)).withColumn("__runs", _with_ends("__long"))
    itself = F.array(
        F.struct(
            F.xxhash64("doc_id").alias("print"),
            F.lit(-1).alias("start"),
            F.col("__n").alias("windows"),
            F.lit(0).alias("size"),
        )
    )
    all_runs = F.concat(itself, F.col("__runs"), *[_short(size) for size in sorted(sizes)])
    each = rows.select("doc_id", "mark", F.explode(all_runs).alias("r")).select("doc_id", "mark", "r.*")
    prints = windows.select(F.col("print").alias("known")).distinct()
    found = each.join(broadcast_if_small(prints, BROADCAST_ROWS), F.col("print") == F.col("known"), "left")
    return found.filter("size = 0 or known is not null").drop("known")


def _covered(spans: str) -> Column:
    """Number of words inside the spans (start, size), which are sorted by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        F.col(spans),
        zero,
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["size"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, kgram: int = KGRAM) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (sorted item_ids as strings), contaminated, spans."""
    docs = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("mark"),
    )
    windows = stage(item_windows(benchmark, window, kgram), "item-windows")
    hits = stage(_hits(docs, windows, window, kgram), "window-hits")
    asked = hits.filter("size > 0").select("mark", "start", "windows", "size").distinct()
    per_text = asked.groupBy("mark").agg(F.collect_list(F.struct("start", "windows", "size")).alias("runs"))
    per_text = stage(per_text, "texts-hit")
    marks = broadcast_if_small(per_text.select("mark"), BROADCAST_ROWS)
    texts = docs.select("mark", "text").join(marks, "mark", "left_semi").groupBy("mark").agg(F.first("text").alias("text"))
    extended = (
        texts.join(per_text, "mark")
        .withColumn("__w", words(F.col("text")))
        .select("mark", "__w", F.explode("runs").alias("r"))
        .select("mark", "__w", "r.size", F.explode(F.expr("sequence(r.start, r.start + r.windows - 1)")).alias("start"))
        .select("mark", "start", "size", F.concat_ws(" ", F.expr("slice(__w, start + 1, size)")).alias("words"))
    )
    known = broadcast_if_small(windows.select("words").distinct(), BROADCAST_ROWS)
    matched = stage(extended.join(known, "words", "left_semi"), "windows-matched")
    spans = matched.groupBy("mark").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"))
    of_item = windows.select("words", F.col("item_id").cast("string").alias("item_id")).distinct()
    items = (
        matched.select("mark", "words").distinct().join(broadcast_if_small(of_item, BROADCAST_ROWS), "words")
        .groupBy("mark").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    per_text = spans.withColumn("n_hit", _covered("spans")).join(items, "mark")
    rows = hits.filter("size = 0").select("doc_id", "mark", F.col("windows").cast("bigint").alias("n_words"))
    found = rows.join(per_text, "mark", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the contaminated ones. Rows that share a doc_id go if one of them is; a row without one stays."""
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("bigint") == bad["__bad"], "left_anti")
