"""Personal data, neighbours and toxicity, and the pipeline."""

import random
import re

import numpy as np
import pytest

import brute
from convoca.llm import neighbours, pii, toxicity

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in RULES.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == "card" and 12 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append((m.start(), list(RULES).index(kind), m.end(), kind))
    return sorted(out)


def card(rng, right=True):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    last = next(c for c in "0123456789" if luhn(digits + c) == right)
    return digits + last


@pytest.fixture(scope="module")
def private():
    rng = random.Random(8)
    docs = [(0, None), (1, ""), (2, "nothing here"), (3, "a@b.c_d@e.f @ x@y z@@q.r +12 +1 234567 89(0)"),
            (4, "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1..2 12 -34 5"), (5, "9" * 4000 + " 1" * 3000), (6, "a." * 3000 + "@x" + ".y" * 3000),
            (7, "ñ€𝒳 " * 50 + "mail ana@ejemplo.es, 𝒳 +34 612 345 678"), (7, "ñ€𝒳 ana@ejemplo.es"), (None, "10.0.0.1")]
    letters = "0123456789.- +()@ab_%\x00"
    docs += [(100 + n, "".join(rng.choice(letters) for _ in range(80))) for n in range(150)]
    for n in range(300):
        said = rng.choice(["", "call ", "card "])
        what = [
            f"user{n}@mail.example.com", f"10.{n % 256}.3.{n % 7}", card(rng), f"+1 ({rng.randint(200, 999)}) 555-{n:04d}",
            f"version {n}.2.{n % 9}.300", f"order {rng.randint(10**8, 10**9)}", f"{rng.randint(200, 999)}/{n}/{n}",
        ][n % 7]
        docs.append((1000 + n, f"some words {said}{what} and more"))
    return docs


def test_personal_data(spark, private):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in private], "doc_id bigint, text string, mark string, kind string")
    got = pii.find(df).collect()
    rows = sorted(((r["doc_id"], [(s["start"], s["kind_no"] - 1, s["end"], s["kind"]) for s in r["spans"] if s["base"]]) for r in got), key=str)
    assert rows == sorted(((i, base_spans(t)) for i, t in private), key=str)
    for r in got:
        base = [(s["start"], s["end"]) for s in r["spans"] if s["base"]]
        added = [(s["start"], s["end"]) for s in r["spans"] if not s["base"]]
        assert all(e <= a or b <= s for s, e in added for a, b in base)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(df.filter("doc_id = 2 or doc_id = 1002 or doc_id = 1000")).collect()}
    assert masked[2] == "nothing here" and "[email]" in masked[1000] and "[card]" in masked[1002]


class Given:
    """A judge that takes probabilities as they stand."""

    thresholds = {k: 0.5 for k in pii.KINDS}

    def judged(self, found):
        return found


def greedy(rows):
    """Base spans, and proposals in order of probability that overlap nothing taken so far."""
    kept = [r for r in rows if r[4]]
    for r in sorted((r for r in rows if not r[4] and r[5] >= 0.5), key=lambda r: (-r[5], r[2], r[3], r[1])):
        if all(r[3] <= k[2] or k[3] <= r[2] for k in kept):
            kept.append(r)
    return sorted(r[:5] for r in kept)


def test_chains_of_overlaps(spark):
    """A span goes only for one that stays: chains of three, four and many against a plain loop."""
    rng = random.Random(14)
    texts = [
        [("email", 0, 10, True, None), ("phone", 8, 20, False, 0.7), ("phone", 18, 21, False, 0.6), ("card", 20, 30, False, 0.95)],
        [("card", 0, 10, False, 0.6), ("phone", 8, 14, False, 0.9), ("ip", 12, 20, False, 0.8), ("card", 18, 25, False, 0.7)],
        [("card", 0, 10, False, 0.9), ("phone", 0, 10, False, 0.9), ("ip", 10, 12, True, None), ("card", 12, 14, False, 0.4)],
        [("ip", 5, 6, True, None), ("card", 5, 9, True, None), ("phone", 0, 30, False, 0.99), ("email", 9, 30, False, 0.5)],
    ]
    for _ in range(150):
        spans = set()
        for _ in range(rng.randint(1, 12)):
            start = rng.randint(0, 40)
            spans.add((rng.choice(pii.KINDS), start, start + rng.randint(1, 9)))
        texts.append([(*s, base := rng.random() < 0.2, None if base else rng.choice([0.3, 0.5, 0.7, 0.9])) for s in sorted(spans)])
    rows = [(n, *span) for n, spans in enumerate(texts) for span in spans]
    found = spark.createDataFrame(rows, "mark bigint, kind string, start bigint, end bigint, base boolean, p double")
    got = {}
    for r in pii.chosen(found, Given()).collect():
        got.setdefault(r["mark"], []).append((r["mark"], r["kind"], r["start"], r["end"], r["base"]))
    for n in range(len(texts)):
        assert sorted(got.get(n, [])) == greedy([r for r in rows if r[0] == n]), texts[n]
    assert (0, "card", 20, 30, False) in got[0]


def test_trees_choose_spans_the_rules_miss(spark):
    """Proposals like confirmed ones are chosen, others are not."""
    rng = random.Random(3)
    rows = [(n, f"card {card(rng)} ok") for n in range(400)]
    rows += [(1000 + n, f"order {rng.randint(10**9, 10**10)} ok") for n in range(400)]
    rows += [(2000 + n, f"card {card(rng, right=False)} ok") for n in range(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.spans(df.selectExpr("doc_id as mark", "text"))
    judge = pii.fit(found)
    chosen = pii.chosen(found, judge).collect()
    by_doc = {r["mark"] for r in chosen if r["kind"] == "card"}
    assert judge.thresholds.get("card") and by_doc >= set(range(400))
    assert not {i for i in by_doc if 1000 <= i < 2000}
    assert by_doc >= {2000, 2001}


def test_trees_choose_frequent_spans_the_rules_miss(spark):
    """Spans in the generators' own forms are found where they are as frequent as confirmed ones."""
    rng = random.Random(5)
    texts = []
    for n in range(300):
        phone, number = f"1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}", card(rng)
        texts += [("sure", f"mail user{n}@mail.example.com now"), ("email", f"mail other{n} [at] mail.example.com now"),
                  ("sure", f"call +{phone} now"), ("phone", f"call {phone} now"), ("sure", f"card {number} ok"),
                  ("card", "card " + "/".join(number[i : i + 4] for i in (0, 4, 8, 12)) + " ok"),
                  ("none", f"order {rng.randint(10**9, 10**10)} ok"), ("none", f"meet{n} [at] noon now")]
    df = spark.createDataFrame([(n, text) for n, (_, text) in enumerate(texts)], "doc_id bigint, text string")
    found = {(r["doc_id"], s["kind"]) for r in pii.find(df).collect() for s in r["spans"]}
    for kind in ("email", "phone", "card"):
        assert sum((n, kind) in found for n, (k, _) in enumerate(texts) if k == kind) >= 270
    assert sum(texts[n][0] == "none" for n, _ in found) <= 12


def test_personal_data_without_python_or_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    found = pii.find(df)
    assert found.count() == 0
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


# --- neighbours


def vectors(rng, n):
    x = rng.standard_normal((n, 16)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(n)]
    # one vector many times
    rows += [(n + i, x[0].tolist()) for i in range(n // 3)]
    odd = [(None, x[1].tolist()), (9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16),
           (9005, [float("inf")] + [0.0] * 15), (9006, [1.0, 2.0]), (9007, []), (0, x[0].tolist())]
    return rows, odd


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 100)
    monkeypatch.setattr(neighbours, "TILE_ROWS", 200)
    rows, odd = vectors(np.random.default_rng(4), 1500)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id bigint, embedding array<float>, score int")
    v = neighbours.valid(df)
    got = neighbours.nearest(v, v.filter("vec_id % 20 = 0"), bucket_rows=64).collect()
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    by_query, hits, n = {}, 0, 0
    for r in got:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by_query) == set(ids[ids % 20 == 0].tolist())
    for q, found in by_query.items():
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((ids, -s))[:20]
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21)) and q not in {i for _, i, _ in found}
        assert all(abs(s[i] - score) < 1e-9 for _, i, score in found)
        assert [(-score, i) for _, i, score in found] == sorted((-score, i) for _, i, score in found)
        hits += len({i for _, i, _ in found} & set(ids[order].tolist()))
        n += 20
    assert hits >= 0.9 * n


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.5, 0.5]), (20, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    v = neighbours.valid(df)
    got = sorted(tuple(r) for r in neighbours.nearest(v, v.filter("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 5, 0.5), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 5, 0.5)]
    none = neighbours.valid(df.filter("false"))
    assert neighbours.nearest(none, none).count() == 0


# --- toxicity


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(6)
    parts = ["an", "ter", "lo", "mi", "sa", "ver", "on", "ing", "re", "tu"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    bad = ["grumble", "knabwit", "zorfface"]
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = i % 3 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity(spark, labelled):
    docs, labels = labelled
    odd = [(9000, None), (9001, ""), (9002, "w" * 5000), (None, "an ter lo"), (9003, "you kna*bwit"), (9004, "k n a b w i t"),
           (9005, "knnabwit lo"), (9006, "an ver mi"), (9006, "an ver mi")]
    df = spark.createDataFrame([(i, t, "best", 0.5) for i, t in docs + odd], "doc_id bigint, text string, best string, score double")
    marks = spark.createDataFrame(labels + [(0, None), (77_777, 1), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(df, marks.filter(~toxicity.held_out()))
    got = toxicity.score(df, model)
    assert got.columns == ["doc_id", "text", "best", "score", "predicted"]
    rows = got.select("doc_id", "score", "predicted", toxicity.held_out().alias("out")).collect()
    assert len(rows) == len(docs) + len(odd)
    truth = dict(labels)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["doc_id"] in truth and brute.crc(r["doc_id"]) % 3 == 1]
    assert all(r["out"] == (brute.crc(r["doc_id"]) % 3 == 1) for r in rows if r["doc_id"] is not None)
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.98 * len(held)
    found = {r["doc_id"]: r["predicted"] for r in rows if r["doc_id"] is None or r["doc_id"] >= 9000}
    assert [found[i] for i in (9003, 9004, 9005)] == [1, 1, 1]
    assert [found[i] for i in (None, 9000, 9001, 9002, 9006)] == [0] * 5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_toxicity_without_labels(spark, labelled):
    df = spark.createDataFrame(labelled[0][:5], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.train(df, none) is None
    assert {r["score"] for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(df.filter("false"), None).count() == 0


def test_string_kernel():
    words = ["idiot", "idiiot", "i", "zzzz", "idiot"]
    k = toxicity.kernel(words, ["idiot"])[:, 0]
    assert k[0] == pytest.approx(1) and k[4] == pytest.approx(1)
    assert 0.5 < k[1] < 1 and k[2] == 0 and k[3] == 0
    assert toxicity.windows("An I.D.I.O.T, i d i o t! " + "x" * 60)[:2] == ["idiot", "idiot"]
