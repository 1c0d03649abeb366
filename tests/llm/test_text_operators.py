"""Line dedup, near-duplicates, decontamination, licenses, tokens and the language model against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from convoca.llm import bpe, decontaminate, katz, licenses, line_dedup, simhash, token_counts
from convoca.sources.staging import stage

SCHEMA = "doc_id bigint, text string, key string, n_lines int, ids string, row string, mark string, spans string"
LONG = "palabra " * 3000
ODD = [
    (0, None),
    (1, ""),
    (2, " \t\n\n "),
    (3, "The same LONG line of text\nonly here, nowhere else\nshort\n"),
    (4, "short\n  the same long line of TEXT\t\nanother one of its own"),
    (5, "the same long line of text\nthe same long line of text"),
    (6, LONG),
    (7, LONG + "end"),
    (8, "Ünïcödé ïs nöt lówered ÀÉ\nünïcödé ïs nöt lówered àé"),
    (9, "<|endoftext|> it's we'll <|startoftext|>İΣ 日本 ½"),
    (9, "<|endoftext|> it's we'll <|startoftext|>İΣ 日本 ½"),
    (None, "the same long line of text\nrest"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", -1, "x", "r", "m", "s") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def prose():
    """Documents with copies, near copies and shared lines."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [line(12) for _ in range(5)]
    docs = []
    for i in range(120):
        if i % 5 == 4:
            text = docs[rng.randrange(len(docs))][1]
            if i % 10 == 4:
                text = text + " " + line(1)
        else:
            text = "\n".join([line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))] + [rng.choice(common)])
        docs.append((i * 3, text))
    return docs + [(1000 + (i or 0), t) for i, t in ODD if i is not None] + [(None, docs[0][1])]


# --- lines


def keys(text):
    found = (line.strip(" \t\n\x0b\x0c\r").translate(brute.A_LOWER) for line in (text or "").split("\n"))
    return list(found)


def deduped(docs, present=None):
    present = docs if present is None else present
    holders = {}
    for i, text in present:
        if i is not None:
            for k in keys(text):
                if len(k) >= 10:
                    holders.setdefault(k, set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [
            line for line, k in zip(lines, keys(text), strict=True)
            if i is None or len(holders.get(k, ())) < 2 or min(holders[k]) == i
        ]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def got_lines(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("which", ["odd", "prose"])
def test_line_dedup(spark, prose, which):
    docs = ODD if which == "odd" else prose
    df = line_dedup.dedup_lines(frame(spark, docs), shard_keys=20)
    assert df.columns == ["doc_id", "text", "key", "ids", "row", "mark", "spans", "n_lines", "n_dropped"]
    assert got_lines(df) == deduped(docs)


def test_line_index_is_reversible(spark, prose):
    docs = [(i, t) for i, t in prose if i is not None]
    first, second = docs[: len(docs) // 2], docs[len(docs) // 2 :]
    index = line_dedup.LineIndex.create(spark, shard_keys=30)
    index.insert(frame(spark, first))
    assert got_lines(index.dedup(frame(spark, first))) == deduped(first)
    index.insert(frame(spark, second))
    assert got_lines(index.dedup(frame(spark, docs))) == deduped(docs)
    counts = {bytes(r["key"]): (r["n_docs"], r["first_doc"]) for r in index.refs.collect()}
    # the holders of lines go, others follow them
    gone = [(i, t) for i, t in docs if i % 2 == 0]
    left = [(i, t) for i, t in docs if i % 2]
    index.delete(spark.createDataFrame([(i,) for i, _ in [*gone, (-5, "")]], "doc_id bigint"))
    assert got_lines(index.dedup(frame(spark, left))) == deduped(left)
    index.insert(frame(spark, gone))
    assert {bytes(r["key"]): (r["n_docs"], r["first_doc"]) for r in index.refs.collect()} == counts
    assert got_lines(index.dedup(frame(spark, docs))) == deduped(docs)
    filters = {r["shard"]: line_dedup.Cuckoo.load(bytes(r["cuckoo"])) for r in index.filters.collect()}
    known = index.refs.select("key", line_dedup._shard(index.shards).alias("s")).collect()
    assert all(bytes(r["key"]) in filters[r["s"]] for r in known)


def test_cuckoo_filter_keeps_and_forgets():
    cuckoo = line_dedup.Cuckoo(100)
    digests = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(3000)]
    for d in digests[:1000]:  # ten times its capacity: the rest is kept exactly
        cuckoo.add(d)
    assert all(d in line_dedup.Cuckoo.load(cuckoo.dump()) for d in digests[:1000])
    for d in digests[:950]:
        cuckoo.remove(d)
    assert all(d in cuckoo for d in digests[950:1000])
    assert sum(d in cuckoo for d in digests[1000:]) < 100


# --- fingerprints


def fingerprint(text):
    words = brute.blank_words(text)
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return value - (1 << 64) if value >> 63 else value


def test_simhash_classes(spark, prose):
    docs = prose
    df = simhash.near_duplicate_classes(frame(spark, docs), leaf_rows=4)
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in df.collect()]
    prints = [(i, fingerprint(t)) for i, t in docs]
    want = brute.components([(i, p) for i, p in prints if i is not None])
    assert sorted((i, p) for i, p, _ in got if i is not None) == sorted((i, p) for i, p in prints if i is not None)
    assert all(c == want[i] for i, _, c in got if i is not None)
    assert [c for i, _, c in got if i is None] == [0]
    kept = simhash.drop_near_duplicates(frame(spark, docs))
    # rows of one id stay together
    left = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in left if i is not None) == sorted(i for i, _ in docs if i is not None and want[i] == i)
    assert left.count(None) == 1
    assert kept.columns == frame(spark, docs).columns


def test_trees_find_all_links_of_dense_groups(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(base[i % 40]) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for i in range(1500)]
    far = rng.integers(0, 1 << 63, 500).tolist()
    prints = list(enumerate([*near, *far]))
    df = spark.createDataFrame(prints, "doc_id bigint, fp bigint")
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(df, leaf_rows=16).collect()}
    assert got == brute.components(prints)


# --- benchmark


def contaminated(docs, items):
    windows = {}
    for item, text in items:
        w = brute.plain_words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for i, text in docs:
        w = brute.plain_words(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[s : s + size]))) is not None:
                    hit |= set(range(s, s + size))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination(spark, prose, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rng = random.Random(1)
    items = [(0, None), (1, ""), (2, "only three words"), (3, "the THE the"), (None, "no id"), (3, "the THE the")]
    docs = list(prose)
    for n in range(12):
        w = brute.plain_words(docs[rng.randrange(100)][1])
        items.append((10 + n, " ".join(w[n : n + rng.randint(9, 30)])))
    docs += [(5000, "the " * 500), (5001, "Only three, words; the the"), *ODD]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, words string")
    got = decontaminate.contamination(frame(spark, docs), bench)
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()]
    assert sorted(rows, key=str) == contaminated(docs, items)
    if limit:
        left = decontaminate.drop_contaminated(frame(spark, docs), bench)
        bad = {i for i, *_, c in contaminated(docs, items) if c}
        assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, _ in docs if i is None or i not in bad)
        assert left.columns == frame(spark, docs).columns


def test_decontamination_uses_no_python(spark, prose):
    bench = spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    plan = decontaminate.contamination(frame(spark, prose[:5]), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# --- licenses


def scanned(docs):
    out = []
    for i, text in docs:
        w = brute.plain_words(text)
        starts, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            for s in range(len(w) - len(p) + 1):
                if w[s : s + len(p)] == p:
                    starts.append(s)
                    base.add(label)
        labels, score = set(base), 1.0 if starts else 0.0
        for line in (text or "").split("\n"):
            own = set(brute.plain_words(line))
            for label, template in licenses.TEMPLATES:
                t = set(brute.plain_words(template))
                if len(own & t) >= math.ceil(0.8 * len(t) - 1e-9):
                    labels.add(label)
                    score = max(score, len(own & t) / len(t))
        out.append((i, len(w), len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=str)


def test_license_scan(spark):
    rng = random.Random(4)
    docs = list(ODD)
    for n in range(150):
        label, template = licenses.TEMPLATES[n % len(licenses.TEMPLATES)]
        w = re.findall(r"\S+", template)
        kept = [x for x in w if rng.random() < 0.9]
        rng.shuffle(kept)
        docs.append((100 + n, "some text\n" + " ".join(kept[: rng.randint(0, 5)] + ["of"] * 3 + kept) + "\nmore MIT  License"[: 20 * (n % 2)]))
    docs.append((900, "mit license mit license apache-license general\npublic license"))
    got = licenses.scan(frame(spark, docs))
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = [tuple(r[c] for c in columns[:-1]) + (round(r["score"], 9),) for r in got.collect()]
    assert sorted(rows, key=str) == scanned(docs)


def test_license_windows(spark):
    """Wrapped notices are whole, scattered words are none, short templates need their telling word."""
    wrapped = [
        (n, "# some code\n# " + template.replace(" ", "\n# " if n % 2 else "\n", 30) + "\nmore text here", label)
        for n, (label, template) in enumerate(licenses.TEMPLATES)
    ]
    far = " ".join(f"{w} " + "lorem ipsum dolor " * 20 for w in licenses.TEMPLATES[1][1].split())
    others = ["Released under the Apache License.", "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0", far]
    docs = [(n, text) for n, text, _ in wrapped] + [(100 + n, text) for n, text in enumerate(others)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(frame(spark, docs)).collect()}
    assert all(label in got[n][0].split(",") and got[n][1] == 1 for n, _, label in wrapped)
    assert [got[100 + n][0] for n in range(4)] == ["apache", "", "", ""]


# --- tokens


def test_tokens_are_the_library_s(spark, prose):
    library = Tokenizer.from_str(bpe.spec_of())
    rng = random.Random(9)
    letters = "aàéßŒñ ΣσςİıJ1²½'’“€ \u0085\x1c\t\n<|endoftext|>日本語한글ẞﬁ!?._-0Ⅷ٣​﻿\x00"
    docs = ODD + prose[:40] + [(2000 + n, "".join(rng.choice(letters) for _ in range(60))) for n in range(300)]
    docs.append((3000, "a" * 20_000))
    encoded = [library.encode(t or "", add_special_tokens=False).ids for _, t in docs]
    want = sorted(
        ((i, len(e), np.array(e, dtype="<u4").tobytes(), library.decode(e, skip_special_tokens=False)) for (i, _), e in zip(docs, encoded, strict=True)),
        key=str,
    )
    made = bpe.encode_decode(frame(spark, docs))
    assert "text" not in made.columns and "key" in made.columns
    rows = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in made.collect()]
    assert sorted(rows, key=str) == want
    apart = bpe.decode(bpe.encode(frame(spark, docs)))
    rows = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in apart.collect()]
    assert sorted(rows, key=str) == want

    for head in (1 << 18, 20):  # everything sent to the tasks, or nearly nothing
        counts = token_counts.token_counts(frame(spark, docs), limit=50, head_rows=head)
        got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counts.collect()), key=str)
        assert got == sorted(
            ((i, len((t or "").encode()), len(e), len(e) > 50) for (i, t), e in zip(docs, encoded, strict=True)), key=str
        )


# --- language model


@pytest.mark.parametrize(("head_rows", "hot"), [(1 << 18, 2000), (60, 25)])
def test_katz(spark, prose, head_rows, hot, monkeypatch):
    monkeypatch.setattr(katz, "HOT", hot)
    docs = [(i, t) for i, t in prose + ODD if i is not None]
    got = katz.scores(frame(spark, docs), head_rows=head_rows, shard_tokens=500).collect()
    train = [(i, t) for i, t in docs if brute.crc(i) % 7 != 2]
    plain = brute.Katz(train, hot)
    ranks = {}
    for n in plain.uni.values():
        ranks[math.floor(math.log2(n) * 16)] = ranks.get(math.floor(math.log2(n) * 16), 0) + 1
    least, taken = 1 << 30, 0
    for rank in sorted(ranks, reverse=True):
        if (taken := taken + ranks[rank]) > head_rows:
            break
        least = rank
    model = brute.Katz(train, hot, {w for w, n in plain.uni.items() if math.floor(math.log2(n) * 16) >= least})
    # exactly normalised: every context adds up to one, with the unknown word
    for u in ["\t", *list(model.uni)[:40]]:
        if u != "\n":
            total = sum(model.probability(u, w) for w in model.uni) + model.probability(u, "??")
            assert total == pytest.approx(1)
    want = []
    for i, t in docs:
        own = [*brute.blank_words(t), "\n"]
        base = sum(math.log10((model.uni[w] + 1) / (model.n + model.v + 1)) for w in own)
        want.append((i, brute.crc(i) % 7 == 2, len(own), sum(w in model.uni for w in own), model.n, round(base, 6), round(model.score(t), 6)))
    rows = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
    for a, b in zip(sorted(rows, key=str), sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-6)


@pytest.mark.parametrize("cached", [60, 1 << 18])
def test_katz_gives_every_word_its_own_probability(spark, prose, cached, monkeypatch):
    """The words sent to the tasks are a cache: how many there are changes no score."""
    monkeypatch.setattr(katz, "HOT", 25)
    docs = [(i, t) for i, t in prose + ODD if i is not None]
    model = brute.Katz([(i, t) for i, t in docs if brute.crc(i) % 7 != 2], 25)
    assert len(model.uni) > 4 * 60
    got = katz.scores(frame(spark, docs), shard_tokens=500, cached_rows=cached).collect()
    want = sorted((i, model.score(t)) for i, t in docs)
    for a, b in zip(sorted((r["doc_id"], r["score"]) for r in got), want, strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=2e-6)


def test_katz_does_not_depend_on_the_order_of_rows(spark, prose, monkeypatch):
    """Rows behind a shuffle, in other partitions every time they are read, with copies and clashing columns."""
    monkeypatch.setattr(katz, "HOT", 25)
    docs = [(i, t) for i, t in prose[:60] + ODD if i is not None]
    docs += [(10_000 + n, docs[3][1]) for n in range(30)]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id bigint, text string, row bigint")
    want = None
    for parts in (1, 5):
        mixed = df.repartition(parts, F.rand(parts)).withColumn("score", F.lit(0))
        rows = sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.scores(mixed, shard_tokens=300, cached_rows=40).collect())
        want = want or rows
        assert rows == want
    model = brute.Katz([(i, t) for i, t in docs if brute.crc(i) % 7 != 2], 25)
    for got, plain in zip(sorted((r[0], r[3]) for r in want), sorted((i, model.score(t)) for i, t in docs), strict=True):
        assert got[0] == plain[0] and got[1] == pytest.approx(plain[1], abs=2e-6)


def test_katz_tables_do_not_grow_with_documents_times_shards(spark, monkeypatch):
    """Documents of the same bigrams: what the shards hand on follows the bigrams of a chunk, not the documents in every shard."""
    kept = {}
    monkeypatch.setattr(katz, "HOT", 1)
    monkeypatch.setattr(katz, "stage", lambda df, name: kept.setdefault(name, stage(df, name)))
    length = []
    for count in (60, 1200):
        draw = random.Random(7)
        docs = [(i, " ".join(draw.choices("abcdefgh", k=60))) for i in range(count)]
        katz.scores(frame(spark, docs).coalesce(1), shard_tokens=count * 3)
        length.append(kept.pop("bigram-shards").agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0])
        kept.clear()
    assert length[1] < 3 * length[0]


def test_katz_in_chunks(spark, prose, monkeypatch):
    """Small chunks, each with answers of many shards, and a row without an id."""
    monkeypatch.setattr(katz, "HOT", 25)
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 150)
    monkeypatch.setattr(katz, "TEXT_BYTES", 400)
    docs = [(i, t) for i, t in prose + ODD if i is not None]
    train = [(i, t) for i, t in docs if brute.crc(i) % 7 != 2]
    model = brute.Katz([*train, (None, docs[1][1])], 25)
    got = katz.scores(frame(spark, [*docs, (None, docs[1][1])]), shard_tokens=400, cached_rows=60).collect()
    rows = sorted((r["doc_id"], r["score"]) for r in got if r["doc_id"] is not None)
    for a, b in zip(rows, sorted((i, model.score(t)) for i, t in docs), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=2e-6)
    [lone] = [r for r in got if r["doc_id"] is None]
    assert not lone["held_out"] and lone["score"] == pytest.approx(model.score(docs[1][1]), abs=2e-6)


# --- nothing at all


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert line_dedup.dedup_lines(none).count() == 0
    assert simhash.near_duplicate_classes(none).count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(frame(spark, ODD), bench).filter("contaminated").count() == 0
    assert licenses.scan(none).count() == 0
    assert token_counts.token_counts(none).count() == 0
    assert bpe.encode_decode(none).count() == 0
    assert katz.scores(none).count() == 0
