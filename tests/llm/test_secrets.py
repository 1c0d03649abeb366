"""Secret scans: rules against plain loops, automata against plain sums, added spans on held-out formats."""

import math
import random
import re
import string

import numpy as np
import pytest

from convoca.llm import secrets

ALNUM = string.ascii_letters + string.digits


def plain_base(text):
    text, out = text or "", []
    assign = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    rules = [(assign + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2), ("AKIA[A-Z0-9]+", 16, 0), ("[0-9a-f]+", 32, 0)]
    for k, (rule, least, group) in enumerate(rules):
        out += [(m.start(), k, m.end(), secrets.KINDS[k]) for m in re.finditer(rule, text) if len(m.group(group)) >= least]
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def value(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(13)
    odd = [
        (None, None), (0, ""), (1, "password: short token=abc secret = 'longenough1' api_key:\"k\" apikey=ABCDEFGH9"),
        (2, "token:secret:abcdefgh TOKEN==xxxxxxxx paſſword=abcdefghij ſecret=abcdefghij"), (3, "AKIA AKIAB AKIA" + "Z9" * 6 + " xAKIA" + "0" * 12 + "b"),
        (4, "f" * 31 + " " + "0" * 32 + "g" + "a1" * 40_000), (5, "ñ𝒳 password='" + "Aa1" * 5 + "' ñ"), (5, "ñ𝒳 password='" + "Aa1" * 5 + "' ñ"),
        (6, "=" * 70_000 + " secret=" + "q" * 50_000),
    ]
    prose = [value(rng, "etaoinshrdlu", rng.randint(2, 12)) for _ in range(6000)]
    docs = odd
    for n in range(900):
        words = [rng.choice(prose) for _ in range(60)] + [f"user{n}@mail{n % 9}.example.com", f"2024-{n % 12:02d}-11T10:00", "under_scored_name", "some/path/file.txt"]
        if n % 3 == 0:
            words.append(rng.choice(["token = ", 'api_key: "']) + value(rng, "0123456789abcdef", 40))
        elif n % 3 == 1:
            words.append("AKIA" + value(rng, string.ascii_uppercase + string.digits, 16))
        rng.shuffle(words)
        docs.append((100 + n, " ".join(words)))
    # of these forms the rules know nothing
    missed = {5000 + n: value(rng, "0123456789abcdef", 31) for n in range(12)} | {6000 + n: "AKIB" + value(rng, string.ascii_uppercase + string.digits, 16) for n in range(12)}
    docs += [(n, "some words around " + v + " here") for n, v in missed.items()]
    return docs, missed


def test_spans(spark, leaks):
    docs, missed = leaks
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id bigint, text string, spans string, kind string").repartition(4)
    got = secrets.find(df).collect()
    base = sorted(((r["doc_id"], [(s["start"], s["end"], s["kind"]) for s in r["spans"] if s["base"]]) for r in got), key=str)
    assert base == sorted(((i, plain_base(t)) for i, t in docs), key=str)
    added = {r["doc_id"]: [s for s in r["spans"] if not s["base"]] for r in got if r["doc_id"] is not None}
    for r in got:
        own = [(s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert all(e <= s["start"] or s["end"] <= b for s in r["spans"] if not s["base"] for b, e in own)
    caught = sum((18, 18 + len(v)) in [(s["start"], s["end"]) for s in added[n]] for n, v in missed.items())
    false = sum(len(s) for n, s in added.items() if n not in missed)
    assert caught >= 21 and false <= 5, (caught, false)
    text = dict(docs)[5001]
    masked = secrets.redact(df.filter("doc_id = 5001 or doc_id = 1 or doc_id is null"), secrets.train(df)).collect()
    masked = {r["doc_id"]: r["text"] for r in masked}
    assert masked[None] is None and missed[5001] not in masked[5001] and masked[5001].endswith("] here") and text.startswith("some")
    assert masked[1] == "password: short token=abc [assign]' api_key:\"k\" [assign]"


def test_same_sample_however_the_rows_lie(spark, leaks):
    docs = spark.createDataFrame([(i, t) for i, t in leaks[0]], "doc_id bigint, text string")
    one, other = (secrets.samples(docs.repartition(n), 50, 80) for n in (1, 7))
    assert one == other and [len(v) for v in one] == [50, 50, 50, 80]


def test_shares_and_thresholds_follow_all_values(spark, leaks):
    """However small the samples are, the shares are those of all values of even hash, and thresholds those of all others."""
    docs = spark.createDataFrame([(i, t) for i, t in leaks[0]], "doc_id bigint, text string")
    model = secrets.train(docs.repartition(5), 60, 90)
    labelled, ordinary = {0: set(), 1: set(), 2: set()}, set()
    for _, text in leaks[0]:
        spans, free = secrets.spans_and_runs(text or "")
        for _, kind, _, found in spans:
            if len(found) <= secrets.LONGEST:
                labelled[kind].add(found)
        ordinary.update(r for _, r in free if len(r) <= secrets.LONGEST)
    for kind, automaton in enumerate(model.kinds):
        assert len(labelled[kind]) > 200
        counts = np.zeros(automaton.logs.shape)
        for found in labelled[kind]:
            if secrets._rank(found) % 2 == 0:
                state = 0
                for symbol in found:
                    counts[state, secrets.SYMBOLS.index(symbol)] += 1
                    state = automaton.to[state, secrets.SYMBOLS.index(symbol)]
                counts[state, secrets.END] += 1
        shares = (counts + secrets.EVEN / (secrets.N_SYMBOLS + 1)) / (counts.sum(axis=1, keepdims=True) + secrets.EVEN)
        assert automaton.logs == pytest.approx(np.log(shares))
        # the credentials' part of the threshold: all but MISSED of the other half reach it, within a step
        others = [v for v in labelled[kind] if secrets._rank(v) % 2]
        low = np.quantile(model.scores(others)[kind], secrets.MISSED, method="higher")
        usual = model.scores(sorted(ordinary))[kind]
        if (usual >= low).mean() <= secrets.SUSPECT:
            assert model.thresholds[kind] <= low
        assert (usual >= model.thresholds[kind]).mean() < 0.05
    again = secrets.train(docs.repartition(2), 60, 90)
    assert again.thresholds == model.thresholds


def reached(tree):
    seen = [0]
    for state in seen:
        seen += [to for to in tree.next[state].values() if to not in seen]
    return set(seen)


def test_scores_are_sums_of_logarithms():
    rng = random.Random(4)
    values = [value(rng, "abc", rng.randint(1, 6)) + "9" for _ in range(400)]
    tree = secrets.infer(values)
    automaton = secrets.Automaton.of(tree)
    runs = sorted([*values[:20], "zz", "abc", "-" * 90, "a" * 300], key=len, reverse=True)
    lengths = np.array([len(r) for r in runs])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    codes = secrets.CODES[np.frombuffer("".join(runs).encode(), dtype=np.uint8)]
    even = 1 / (len(secrets.SYMBOLS) + 1)

    often = {}  # where an unseen symbol leads
    for state in range(len(tree.total)):
        for symbol, n in tree.times[state].items():
            if state in reached(tree):
                often.setdefault(symbol, []).append((n, tree.next[state][symbol]))

    def plain(run):
        state, total = 0, 0.0
        for symbol in [*run, None]:
            if state is None:
                total += math.log(even)
            else:
                counts, n = (tree.times[state].get(symbol, 0) if symbol else tree.ends[state]), sum(tree.times[state].values()) + tree.ends[state]
                total += math.log((counts + secrets.EVEN * even) / (n + secrets.EVEN))
            if symbol:
                known = tree.next[state].get(symbol) if state is not None else None
                state = known if known is not None else max(often[symbol])[1] if symbol in often else None
        return total

    assert automaton.score(codes, starts, lengths) == pytest.approx([plain(r) for r in runs])
    # shares of every state add up to one
    assert np.exp(automaton.logs).sum(axis=1) == pytest.approx(1)


def test_merging_finds_the_format():
    """Even strings over some letters behind a fixed beginning become few states; different shares stay apart."""
    rng = random.Random(6)
    tree = secrets.infer(["AKIA" + value(rng, "XYZ012", 16) for _ in range(1000)])
    automaton = secrets.Automaton.of(tree)
    assert len(automaton.logs) <= 9
    parity = ["".join("a" if i % 2 == 0 else "b" for i in range(rng.choice([4, 6, 8, 10]))) for _ in range(500)]
    tree = secrets.infer(parity)
    state, seen = 0, []
    for symbol in "abababab":
        seen.append(set(tree.times[state]))
        state = tree.next[state][symbol]
    assert all(s == ({"a"} if i % 2 == 0 else {"b"}) for i, s in enumerate(seen))


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert secrets.find(none).count() == 0
    few = spark.createDataFrame([(1, "token=abcdefgh1 Zz9Zz9Zz9Zz9Zz9Zz9"), (2, None)], "doc_id bigint, text string")
    assert sorted(len(r["spans"]) for r in secrets.find(few).collect()) == [0, 1]
