"""Spelling variants against plain loops."""

import random
import re
import zlib
from collections import Counter

import pytest

import brute
from convoca.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n bigint"


def plain_counts(docs, every=199, length=6, least=5):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(brute.A_LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= length and n >= least}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=5):
    form, near = {}, {}
    for w, n in counts.items():
        close = [x for x in counts if one_apart(w, x)]
        near[w] = len(close)
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    stems = ["mataró", "mataro", "letters", "lettres", "Straße", "strasse", "çalıñas", "aaaaaa", "aaaaaaa", "ÀÀÀÀÀÀ", "abcdef", "abcdeg"]
    rows = [(None, None), (0, ""), (1, "12 !! ×÷"), (None, "letters " * 7), (2, "a" * 70_000 + " x"), (2, "aaaaaab " * 3)]
    rows += [(3 + n, "z" * 3000 + " " + "z" * 2999) for n in range(6)]
    for n in range(400):
        words = []
        for _ in range(rng.randint(1, 30)):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                at, c = rng.randrange(len(w)), rng.choice("abrtÀß")
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            words.append(w)
        rows.append((n // 2, " ".join(words)))
    return rows + rows[:40]


def test_same_as_plain_loops(spark, docs):
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], SCHEMA).repartition(5)
    counts = spelling.word_counts(spelling.letter_runs(df, 199))
    want = plain_counts(docs)
    assert dict(map(tuple, counts.collect())) == want
    assert any(r[1] for r in plain_variants(want)) and found(spelling.variants(counts)) == plain_variants(want)


@pytest.mark.parametrize("symbols", [1, 3])
def test_few_symbols_give_the_same(spark, docs, symbols):
    """With one symbol all words of a length share a reduced word."""
    want = plain_counts(docs)
    words = spark.createDataFrame(list(want.items()), "word string, n bigint")
    assert found(spelling.variants(words, symbols=symbols)) == plain_variants(want)


def test_chains_and_ties(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "cccccc": 5, "bccccc": 25, "acccccc": 25, "dddddd": 5, "ddddde": 24}
    got = {r[0]: r for r in found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")))}
    assert got["aaaaaa"][1:3] == ("aaaaab", "aaabbb") and got["aaaabb"][1:3] == ("aaabbb", "aaabbb")
    assert got["cccccc"][1:] == ("acccccc", "acccccc", 5, 2, 25)
    assert got["dddddd"][1:] == (None, "dddddd", 5, 1, None)


def test_no_words(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spelling.variants(spelling.word_counts(spelling.letter_runs(none))).count() == 0
    short = spark.createDataFrame([(1, "one two six", "a", 1), (2, None, "b", 2)], SCHEMA)
    assert spelling.variants(spelling.word_counts(spelling.letter_runs(short, 199))).count() == 0


def test_neighbourhoods_are_whole():
    rng = random.Random(1)
    words = list({bytes(rng.randint(1, 4) for _ in range(rng.randint(1, 6))) for _ in range(100)})
    got = {}
    for rows, keys in spelling.neighbourhoods(words, 4):
        for row, key in zip(rows.tolist(), keys.tolist(), strict=True):
            got.setdefault(row, []).append(key)
    letters = [bytes([c]) for c in range(1, 5)]
    for row, w in enumerate(words):
        near = {w} | {w[:p] + w[p + 1 :] for p in range(len(w))}
        near |= {w[:p] + c + w[p + 1 :] for p in range(len(w)) for c in letters}
        near |= {w[:p] + c + w[p:] for p in range(len(w) + 1) for c in letters}
        assert sorted(got[row]) == sorted(spelling.hashes(list(near)).tolist())
