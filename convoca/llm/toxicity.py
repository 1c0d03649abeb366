"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel of two words counts their common subsequences of four characters, a
mark at the start of the word being one, each occurrence weighted by ``DECAY`` to
the power of the characters it spans (``SPAN`` at most), normalised to one for
equal words. An insult with inserted or missing characters keeps most of its
subsequences, and so most of its kernel.

Training uses labelled documents of the caller's choosing, at most
``DOCS_PER_CLASS`` of each label, taken by the hash of their ids:

1. The sentences' words are counted by label, once per pair of neighbours they
   stand between, so that copies of a document count once. Words whose own counts,
   or those of their first four to eight characters, speak for the toxic label beyond
   chance (``EVIDENCE``, ``RATIO``) are positive examples, words of clean
   sentences negative ones; all numbers are bounded.
2. Nystroem: ``LANDMARKS`` words span the feature space; a machine with squared
   hinge loss is fitted there, the clean words it ranks highest are added as
   negatives and it is fitted again.
3. The machine is linear in the landmarks' subsequences, so its weights fold into
   one table of fixed size, which is sent to the tasks.
4. The scores of a document are the best word and the number of words beyond the
   margin; a logistic fit on the training documents makes them a probability.

A word is what stands between white space, its other signs removed; single
characters in a row are put together, long words are cut into overlapping parts.
Labels, language, source and ids are no inputs of a score.

Defined results: null and empty texts score like a text of harmless words. Every
row gets a score of its own. Labels that are null, or whose document is missing,
teach nothing; without both labels every score is 0. Further columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoca.llm.common import replaced, schema_with, slices, without
from convoca.sources.staging import stage

THRESHOLD = 0.7
DECAY, SPAN = 0.7, 8
# bounds of what training looks at
DOCS_PER_CLASS, POSITIVES, NEGATIVES, HARD, LANDMARKS = 4000, 2000, 6000, 3000, 512
# log-likelihood ratio and ratio of rates from which counts speak for a label
EVIDENCE, RATIO = 24.0, 8.0
# lengths of the beginnings of words that are counted
STEMS = (4, 8)
# a word longer than LONG is cut into parts of that length
LONG, STEP = 24, 12
SYMBOLS = 64
# places of the weights' table, to which subsequences are hashed
PLACES = 1 << 21
KEEP = 250_000
# words at once in training, which keeps the driver small
AT_ONCE = 512

_SENTENCE_END = re.compile(r"[.!?\n]+")
_SIGNS = re.compile(r"[\W_]+")


def windows(sentence: str) -> list[str]:
    """The words of a sentence, ready for the kernel."""
    out, singles = [], []
    for token in [*sentence.lower().split(), ""]:
        word = token if token.isalpha() else _SIGNS.sub("", token)
        if len(word) == 1:
            singles.append(word)
            continue
        if len(singles) > 2:
            out.append("".join(singles))
        singles = []
        if len(word) > LONG:
            out += [word[at : at + LONG] for at in range(0, len(word) - STEP, STEP)]
        elif len(word) > 2:
            out.append(word)
    return [part for w in out for part in ([w] if len(w) <= LONG else [w[a : a + LONG] for a in range(0, len(w) - STEP, STEP)])]


def _symbols(words: list[str], size: int) -> np.ndarray:
    points = np.array([list(map(ord, w)) for w in words], dtype=np.int64).reshape(len(words), size)
    letters = (points >= 97) & (points < 123)
    digits = (points >= 48) & (points < 58)
    last = SYMBOLS - 1
    inner = np.where(letters, points - 97, np.where(digits, points - 22, 36 + points % (last - 36)))
    return np.c_[np.full(len(words), last), inner]


_PLACES: dict[int, tuple[np.ndarray, ...]] = {}


def _subsequences(size: int) -> tuple[np.ndarray, ...]:
    """Places of the four characters of each subsequence of a word of ``size`` and its mark."""
    if size not in _PLACES:
        found = [
            (first, *inner, last)
            for first in range(size + 1)
            for last in range(first + 3, min(size + 1, first + SPAN))
            for inner in combinations(range(first + 1, last), 2)
        ]
        _PLACES[size] = tuple(np.array(found, dtype=np.int64).reshape(-1, 4).T)
    return _PLACES[size]


_WEIGHTS = DECAY ** np.arange(4, SPAN + 1)


def _by_size(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions of the words, codes of their subsequences, spans less four) for each length."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for size in np.unique(sizes):
        at = np.nonzero(sizes == size)[0]
        i, j, k, m = _subsequences(int(size))
        if not len(i):
            continue
        step = max(1, (1 << 20) // len(i))
        for start in range(0, len(at), step):
            part = at[start : start + step]
            s = _symbols([words[p] for p in part], int(size))
            codes = ((s[:, i] * SYMBOLS + s[:, j]) * SYMBOLS + s[:, k]) * SYMBOLS + s[:, m]
            yield part, (codes * 0x9E3779B1 >> 11) % PLACES, m - i - 3


def _summed(codes: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) with the occurrences of a code in a row added up."""
    keys = np.sort(codes * 8 + spans[None, :], axis=1)
    rows = np.repeat(np.arange(len(keys)), keys.shape[1])
    flat = keys.ravel()
    code, weight = flat >> 3, _WEIGHTS[flat & 7]
    starts = np.nonzero(np.r_[True, (code[1:] != code[:-1]) | (rows[1:] != rows[:-1])])[0]
    return rows[starts], code[starts], np.add.reduceat(weight, starts)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, value) of the normalised kernel's feature vectors, by word."""
    out: list[list[np.ndarray]] = [[], [], []]
    for at, codes, spans in _by_size(words):
        rows, code, weight = _summed(codes, spans)
        norms = np.sqrt(np.bincount(rows, weight**2, minlength=len(at)))
        for column, values in zip(out, (at[rows], code, weight / norms[rows]), strict=True):
            column.append(values)
    kinds = (np.int64, np.int64, np.float64)
    return tuple(np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(out, kinds, strict=True))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values, words x landmarks, worked out for a few landmarks and words at a time."""
    out = np.zeros((len(words), len(landmarks)))
    for first in range(0, len(words), AT_ONCE):
        row, code, value = features(words[first : first + AT_ONCE])
        for start in range(0, len(landmarks), AT_ONCE // 8):
            own = landmarks[start : start + AT_ONCE // 8]
            own_row, own_code, own_value = features(own)
            known, place = np.unique(own_code, return_inverse=True)
            if not len(known):
                continue
            table = np.zeros((len(known), len(own)))
            table[place, own_row] = own_value
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = np.nonzero(known[at] == code)[0]
            if not len(hit):
                continue
            r = row[hit]
            starts = np.nonzero(np.r_[True, r[1:] != r[:-1]])[0]
            products = table[at[hit]] * value[hit, None]
            np.add.at(out, (first + r[starts], slice(start, start + len(own))), np.add.reduceat(products, starts, axis=0))
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared hinge loss, by Newton's method on the active rows."""
    size = x.shape[1] + 1
    ridge = np.full(size, penalty)
    ridge[-1] = 1e-6
    w = np.zeros(size)
    for _ in range(50):
        square, right = np.diag(ridge), np.zeros(size)
        active = 1 - y * (x @ w[:-1] + w[-1]) > 0
        for at in range(0, len(x), AT_ONCE):
            part = active[at : at + AT_ONCE]
            xa = np.c_[x[at : at + AT_ONCE][part], np.ones(part.sum())]
            weighted = xa * weight[at : at + AT_ONCE][part][:, None]
            square += weighted.T @ xa
            right += weighted.T @ y[at : at + AT_ONCE][part]
        new = np.linalg.solve(square, right)
        if np.allclose(new, w, atol=1e-8):
            break
        w = w + 0.7 * (new - w)
    return w[:-1], float(w[-1])


def _fitted(positive: list[str], negative: list[str], landmark_pool: list[str]) -> Model:
    """A machine on ``LANDMARKS`` words, half of them positive and half from ``landmark_pool``."""
    rng = np.random.default_rng(0)
    half = LANDMARKS // 2
    landmarks = positive[:half] + [landmark_pool[k] for k in rng.permutation(len(landmark_pool))[:half]]
    landmarks = sorted(set(landmarks))
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    good = values > 1e-6 * values.max()
    back = vectors[:, good] / np.sqrt(values[good])
    words = positive + negative
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    weight = np.where(y > 0, 0.5 / len(positive), 0.5 / len(negative))
    w, bias = _machine(kernel(words, landmarks) @ back, y, weight)
    row, code, value = features(landmarks)
    table = np.bincount(code, value * (back @ w)[row], minlength=PLACES).astype(np.float32)
    return Model(table, min(bias, -1e-6), np.zeros(3))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - (y > 0))) + penalty * len(y) * np.r_[w[:-1] * 0.01, 0]
        hess = (x * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(np.r_[np.full(len(w) - 1, penalty * len(y) * 0.01), 1e-6])
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """Weights of the subsequences, the bias, and the logistic fit. Of fixed size."""

    table: np.ndarray
    bias: float
    fit: np.ndarray

    def similarities(self, words: list[str]) -> np.ndarray:
        """The kernel part of the machine's value of each word, 0 where it speaks for clean."""
        out = np.zeros(len(words))
        for at, codes, spans in _by_size(words):
            raw = self.table[codes] @ _WEIGHTS[spans]
            up = np.nonzero(raw > 0)[0]
            if len(up):
                rows, _, weight = _summed(codes[up], spans)
                out[at[up]] = raw[up] / np.sqrt(np.bincount(rows, weight**2, minlength=len(up)))
        return out

    def probability(self, best: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = np.c_[best + self.bias, np.log1p(count), np.ones(len(best))]
        return 1 / (1 + np.exp(-np.clip(x @ self.fit, -30, 30)))


class Scorer:
    """A model in a worker, with the words it has seen, up to ``KEEP``."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def best_and_count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words = [windows(text or "") for text in texts]
        new = list({w for own in words for w in own if w not in self.known})
        if len(self.known) + len(new) > KEEP:
            self.known = {}
            new = list({w for own in words for w in own})
        for start in range(0, len(new), 1 << 14):
            part = new[start : start + (1 << 14)]
            self.known.update(zip(part, self.model.similarities(part).tolist(), strict=True))
        get, margin = self.known.__getitem__, -self.model.bias
        best, count = np.zeros(len(texts)), np.zeros(len(texts))
        for k, own in enumerate(words):
            values = list(map(get, own))
            best[k] = max(values, default=0.0)
            if best[k] > margin:
                count[k] = sum(v > margin for v in values)
        return best, count


def _training_docs(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(text, toxic) of at most ``per_class`` documents of each label, by hash of the id."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sides = [
        known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for value in (0, 1)
    ]
    chosen = stage(sides[0].unionByName(sides[1]), "toxicity-ids").withColumnRenamed("doc_id", "__doc")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most 2 * per_class ids
    return stage(rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("__doc")).select("text", "toxic"), "toxicity-docs")


def _word_counts(train: DataFrame) -> DataFrame:
    """(word, n_toxic, n_clean): distinct pairs of neighbours a word has under each label."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            seen = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for sentence in _SENTENCE_END.split(text or ""):
                    own = ["", *windows(sentence), ""]
                    for left, word, right in zip(own, own[1:], own[2:], strict=False):
                        seen.add((word, xxhash.xxh64_intdigest(f"{left} {right}") >> 1, toxic))
            words, marks, kinds = zip(*seen, strict=True) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(marks, pa.int64()), pa.array(kinds, pa.int32())],
                names=["word", "mark", "toxic"],
            )

    rows = train.select("text", F.col("toxic").cast("int")).mapInArrow(contexts, "word string, mark bigint, toxic int")
    return (
        rows.distinct()
        .groupBy("word")
        .agg(F.sum("toxic").alias("n_toxic"), F.sum(1 - F.col("toxic")).alias("n_clean"))
    )


def _evidence(n_toxic, n_clean, share: float):
    """Signed log-likelihood ratio of the counts against the share of toxic words."""
    both = n_toxic + n_clean
    part = lambda n, expected: F.when(n > 0, n * F.ln(n / expected)).otherwise(0.0)
    value = 2 * (part(n_toxic, both * share) + part(n_clean, both * (1 - share)))
    return F.when(n_toxic > both * share, value).otherwise(-value)


def train(docs: DataFrame, labels: DataFrame, per_class: int = DOCS_PER_CLASS) -> Model | None:
    """A model from ``labels`` (doc_id, toxic); None without examples of both labels."""
    chosen = _training_docs(docs, labels, per_class)
    counts = stage(_word_counts(chosen), "toxicity-words")
    total = counts.agg(F.sum("n_toxic"), F.sum("n_clean")).first()
    if not total[0] or not total[1]:
        return None
    share = total[0] / (total[0] + total[1])
    odds = share / (1 - share)
    beyond = lambda t, c: (_evidence(t, c, share) >= EVIDENCE) & (t >= RATIO * odds * c)
    t, c = F.col("n_toxic"), F.col("n_clean")
    sizes = F.sequence(F.lit(STEMS[0]), F.least(F.length("word"), F.lit(STEMS[1])))
    stems = counts.filter(F.length("word") >= STEMS[0]).select(
        "word", "n_toxic", "n_clean", F.explode(F.transform(sizes, lambda n: F.substring("word", F.lit(1), n))).alias("stem")
    )
    telling = stems.groupBy("stem").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    telling = telling.filter(beyond(t, c)).select("stem")
    by_stem = stems.join(telling, "stem", "left_semi").filter(t >= RATIO * odds * c).select("word").distinct()
    found = counts.join(by_stem.withColumn("by_stem", F.lit(True)), "word", "left")
    marked = stage(found.withColumn("positive", F.coalesce("by_stem", F.lit(False)) | beyond(t, c)), "toxicity-marked")
    positive = [
        r["word"]
        for r in marked.filter("positive").orderBy(F.desc(_evidence(t, c, share)), "word").limit(POSITIVES).collect()
    ]
    clean = marked.filter("not positive and n_clean > 0")
    negative = [r["word"] for r in clean.orderBy(F.xxhash64("word"), "word").limit(NEGATIVES // 2).collect()]
    negative += [r["word"] for r in clean.orderBy(F.desc("n_clean"), "word").limit(NEGATIVES // 2).collect()]
    negative = sorted(set(negative))
    if not positive or not negative:
        return None
    model = _fitted(positive, negative, negative)
    hard = [r["word"] for r in _scored_words(clean, model).orderBy(F.desc("value"), "word").limit(HARD).collect()]
    model = _fitted(positive, sorted({*negative, *hard}), hard)
    rows = _measured(chosen, model).select("best", "n_beyond", "toxic").toPandas()
    x = np.c_[rows["best"] + model.bias, np.log1p(rows["n_beyond"])]
    y = rows["toxic"].to_numpy(dtype=float)
    model.fit = _logistic(x, y)
    if min(model.fit[:2]) < 0:  # neither may speak against toxicity
        kept = int(np.argmax(model.fit[:2]))
        slope, level = _logistic(x[:, [kept]], y)
        model.fit = np.array([0.0, 0.0, level])
        model.fit[kept] = max(slope, 0.0)
    return model


def _scored_words(words: DataFrame, model: Model) -> DataFrame:
    shipped = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shipped.value.similarities(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["word", "value"])

    return words.select("word").mapInArrow(run, "word string, value double")


def _measured(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` less ``text`` with ``best`` and ``n_beyond`` of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in slices(batches):
            at = batch.schema.names.index("text")
            best, count = scorer.best_and_count(batch.column(at).to_pylist())
            yield replaced(batch, best=pa.array(best), n_beyond=pa.array(count))

    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(run, schema_with(rows, best="double", n_beyond="double"))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    if model is None:
        return without(docs, "score", "predicted").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in slices(batches):
            at = batch.schema.names.index("text")
            p = shipped.value.probability(*scorer.best_and_count(batch.column(at).to_pylist()))
            yield replaced(
                batch, score=pa.array(p), predicted=pa.array((p >= threshold).astype(np.int32))
            )

    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(run, schema_with(rows, score="double", predicted="int"))


def held_out():
    """Rows that teach nothing: the CRC-32 of the id, as text, leaves 1 when divided by 3."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
