"""Secrets in texts: rules, and automata inferred from the credentials the rules label.

Base spans come from three rules. Their values are labelled credentials of a kind,
and runs that touch no span are ordinary; both are known by their text, each once,
at most ``LONGEST`` characters long. The values of even hash fit the automata, the others
set the thresholds:

1. States: of each kind a bounded sample (``CREDENTIALS`` values, ``ORDINARY`` runs; of them those of even hash)
   becomes a prefix tree with counts, and states whose distributions are compatible
   by Hoeffding's bound are merged until none is left to try, red states against
   blue ones. Only which states there are, and where symbols lead, comes from the sample.
2. Shares: all values of even hash pass the automaton, and the counts of what they
   do in each state are its probabilities. Symbols that the sample never showed count too.
3. Thresholds, from the scores of all other values and of all ordinary runs, in steps
   of one part in ``STEPS``: below what all but ``MISSED`` of the credentials score, in the middle of the
   widest gap among the scores of the highest ``SUSPECT`` of the ordinary runs there. If over ``SUSPECT``
   of ordinary runs score like credentials, the format is no mark of one, and the
   threshold is what only ``FALSE`` of all of them reach. It is never below that of an
   ordinary run. A kind with fewer than ``ENOUGH`` credentials adds nothing.

Every run of ``LEAST`` or more characters that can stand in a credential, holds a
letter and touches no base span is scored by each automaton: its log-likelihood a character
less that of an ordinary run, an even mixture of their automaton and of any characters. A run belongs to the kind that scores best and
is a span where it reaches the kind's threshold.

Scale: two passes over the texts and no state across rows. The first writes the
distinct values, which are shuffled once; steps 2 and 3 read them, and their
tables are bounded by the states and by the range of scores.
Samples are the values of least hash, whatever the partitions. Runs are scored in tables of
``RUNS_AT_ONCE``, one character of all runs at a time.

Defined results: a null or empty text has no spans; the same text gives the same
spans wherever it stands; places are code points, ends are exclusive; kinds that
start together follow the order of ``KINDS``. With an empty table nothing is
learned or returned. Columns named ``spans`` are replaced, others stay.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoca.llm.common import replaced, schema_with, slices
from convoca.sources.staging import stage

KINDS = ("assign", "access", "hex")
# every find of the first rule has one of these in lower case
KEYWORDS = ("password", "passwd", "secret", "token", "api")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a shorter run of these letters fails whole, so it can be passed over at once
HEX = re.compile(r"[0-9a-f]{32,}")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
LEAST = 8
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
NUMBER = re.compile(r"[0-9+/_.=-]+")

CREDENTIALS, ORDINARY, LONGEST, ENOUGH = 2000, 4000, 256, 30
FALSE, MISSED, SUSPECT = 0.0005, 0.02, 0.01
# chance of parting two equal states, and the weight of the even distribution in every state
ALPHA, EVEN = 0.01, 0.5
RUNS_AT_ONCE = 50_000
# values a task holds to tell them apart, and steps of a score in the tables behind the thresholds
HELD, STEPS = 100_000, 4096

N_SYMBOLS = len(SYMBOLS)
END = N_SYMBOLS
# the number under which ordinary runs go
PLAIN = len(KINDS)
CODES = np.full(128, 255, dtype=np.uint8)
CODES[np.frombuffer(SYMBOLS.encode(), dtype=np.uint8)] = np.arange(N_SYMBOLS)

SPAN = "struct<start:bigint,end:bigint,kind:string,base:boolean,score:double>"


def spans_and_runs(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, str]]]:
    """(start, kind's number, end, value) of the rules' finds, by start, then kind; (start, run) of candidates touching none."""
    runs = [(m.start(), m[0]) for m in RUN.finditer(text)]
    low = text.lower()
    spans = []
    if any(word in low for word in KEYWORDS):
        spans += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    for start, run in runs:
        if len(run) >= 32:
            spans += [(start + m.start(), 2, start + m.end(), m[0]) for m in HEX.finditer(run)]
    spans.sort()
    at, reach, free = 0, 0, []
    for start, run in runs:
        while at < len(spans) and spans[at][0] < start + len(run):
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= start and not NUMBER.fullmatch(run):
            free.append((start, run))
    return spans, free


class Tree:
    """States with counts of endings and of each symbol's transitions; a prefix tree before states are merged."""

    def __init__(self, values: Iterable[str]):
        self.total, self.ends, self.next, self.times = [0], [0], [{}], [defaultdict(int)]
        for value in values:
            state = 0
            for symbol in value:
                self.total[state] += 1
                self.times[state][symbol] += 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.total)
                    self.total.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.times.append(defaultdict(int))
                state = self.next[state][symbol]
            self.total[state] += 1
            self.ends[state] += 1

    def _differ(self, a: int, b: int) -> bool:
        """Whether some share of the two states differs by more than chance, by Hoeffding's bound."""
        n, m = self.total[a], self.total[b]
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (n**-0.5 + m**-0.5)
        if bound >= 1:
            return False
        if abs(self.ends[a] / n - self.ends[b] / m) > bound:
            return True
        one, two = self.times[a], self.times[b]
        return any(abs(one.get(s, 0) / n - two.get(s, 0) / m) > bound for s in one.keys() | two.keys())

    def compatible(self, a: int, b: int) -> bool:
        """Whether neither the two states nor those they lead to differ."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(a, b):
                return False
            todo += [(to, self.next[b][s]) for s, to in self.next[a].items() if s in self.next[b]]
        return True

    def merge(self, into: int, state: int) -> list[tuple[int, str]]:
        """Fold the tree below ``state`` into the states from ``into`` on; returns the new arcs (state, symbol)."""
        todo, new = [(into, state)], []
        while todo:
            into, state = todo.pop()
            self.total[into] += self.total[state]
            self.ends[into] += self.ends[state]
            for symbol, n in self.times[state].items():
                self.times[into][symbol] += n
            for symbol, to in self.next[state].items():
                if symbol in self.next[into]:
                    todo.append((self.next[into][symbol], to))
                else:
                    self.next[into][symbol] = to
                    new.append((into, symbol))
        return new


def infer(values: Iterable[str]) -> Tree:
    """The automaton left after merging every compatible pair, states met first coming first."""
    tree = Tree(values)
    red = [0]
    blue = dict.fromkeys((0, s) for s in sorted(tree.next[0]))
    while blue:
        source, symbol = next(iter(blue))
        del blue[source, symbol]
        state = tree.next[source][symbol]
        if state in red:
            continue
        match = next((r for r in red if tree.compatible(r, state)), None)
        if match is None:
            red.append(state)
            blue.update(dict.fromkeys((state, s) for s in sorted(tree.next[state])))
        else:
            tree.next[source][symbol] = match
            # red states may get arcs to new ones
            blue.update(dict.fromkeys((r, s) for r, s in tree.merge(match, state) if r in red))
    return tree


@dataclass
class Automaton:
    """Log-probabilities and targets by state and symbol.

    A symbol unseen in a state leads where it leads most often, one never seen to the last state.
    """

    logs: np.ndarray  # states x (symbols and the end)
    to: np.ndarray  # states x symbols

    @classmethod
    def of(cls, tree: Tree) -> Automaton:
        order = [0]
        for state in order:
            order += [to for _, to in sorted(tree.next[state].items()) if to not in order]
        numbers = {state: i for i, state in enumerate(order)}
        lost = len(order)
        logs = np.full((lost + 1, N_SYMBOLS + 1), 1 / (N_SYMBOLS + 1))
        often: dict[str, tuple[int, int]] = {}
        for state in order:
            for symbol, n in tree.times[state].items():
                often[symbol] = max(often.get(symbol, (0, 0)), (n, numbers[tree.next[state][symbol]]))
        usual = np.full(N_SYMBOLS, lost, dtype=np.int32)
        for symbol, (_, target) in often.items():
            usual[SYMBOLS.index(symbol)] = target
        to = np.tile(usual, (lost + 1, 1))
        for state, i in numbers.items():
            counts = np.zeros(N_SYMBOLS + 1)
            counts[END] = tree.ends[state]
            for symbol, n in tree.times[state].items():
                counts[SYMBOLS.index(symbol)] = n
                to[i, SYMBOLS.index(symbol)] = numbers[tree.next[state][symbol]]
            logs[i] = (counts + EVEN / (N_SYMBOLS + 1)) / (counts.sum() + EVEN)
        return cls(np.log(logs), to)

    def counts(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How often the runs of ``codes``, longest first, show each symbol or end in each state."""
        out, width = np.zeros(self.logs.size, dtype=np.int64), N_SYMBOLS + 1
        state, left = np.zeros(len(starts), dtype=np.int32), len(starts)
        for at in range(int(lengths[0]) if left else 0):
            while lengths[left - 1] <= at:
                left -= 1
            symbol = codes[starts[:left] + at]
            out += np.bincount(state[:left] * np.int64(width) + symbol, minlength=len(out))
            state[:left] = self.to[state[:left], symbol]
        out += np.bincount(state * np.int64(width) + END, minlength=len(out))
        return out.reshape(self.logs.shape)

    def with_counts(self, counts: np.ndarray) -> Automaton:
        """The same states and targets with the shares of ``counts``."""
        total = counts.sum(axis=1, keepdims=True)
        return replace(self, logs=np.log((counts + EVEN / (N_SYMBOLS + 1)) / (total + EVEN)))

    def score(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-likelihood of each run of ``codes``, longest first."""
        out, state = np.zeros(len(starts)), np.zeros(len(starts), dtype=np.int32)
        left = len(starts)
        for at in range(int(lengths[0]) if left else 0):
            while lengths[left - 1] <= at:
                left -= 1
            symbol = codes[starts[:left] + at]
            out[:left] += self.logs[state[:left], symbol]
            state[:left] = self.to[state[:left], symbol]
        return out + self.logs[state, END]


def _laid(runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all runs, and their starts, lengths and numbers, longest first."""
    lengths = np.array([len(r) for r in runs], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(runs) else lengths
    codes = CODES[np.frombuffer("".join(runs).encode(), dtype=np.uint8)]
    return codes, starts[order], lengths[order], order


@dataclass
class Model:
    ordinary: Automaton
    kinds: list[Automaton | None]
    thresholds: list[float]

    def scores(self, runs: list[str]) -> np.ndarray:
        """kinds x runs: log-likelihood a character above that of an ordinary run."""
        *place, order = _laid(runs)
        even = -(place[2] + 1) * math.log(N_SYMBOLS + 1)
        plain = np.logaddexp(self.ordinary.score(*place), even) - math.log(2)
        out = np.full((len(KINDS), len(runs)), -np.inf)
        for k, automaton in enumerate(self.kinds):
            if automaton is not None:
                out[k, order] = (automaton.score(*place) - plain) / (place[2] + 1)
        return out

    def chosen(self, runs: list[str]) -> list[tuple[int, int, float]]:
        """(number of the run, kind's number, score) of the runs that are spans."""
        if not runs or all(k is None for k in self.kinds):
            return []
        found = self.scores(runs)
        above = np.where(found >= np.array(self.thresholds)[:, None], found, -np.inf)
        best = above.argmax(axis=0)
        value = above[best, np.arange(len(runs))]
        return [(int(i), int(best[i]), float(value[i])) for i in np.nonzero(np.isfinite(value))[0]]


def _rank(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode(), seed=13)


def values(docs: DataFrame) -> DataFrame:
    """(kind, value, rank): all labelled values of ``docs`` (text) and, as ``PLAIN``, all ordinary runs, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[set[str]] = [set() for _ in range(PLAIN + 1)]

        def rows() -> pa.RecordBatch:
            kinds = np.repeat(np.arange(PLAIN + 1, dtype=np.int32), [len(own) for own in held])
            found = [value for own in held for value in own]
            ranks = pa.array(map(_signed, found), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(found, pa.string()), ranks], names=["kind", "value", "rank"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    spans, free = spans_and_runs(text)
                    for _, kind, _, value in spans:
                        if len(value) <= LONGEST:
                            held[kind].add(value)
                    held[PLAIN].update(r for _, r in free if len(r) <= LONGEST)
            if sum(map(len, held)) >= HELD:
                yield rows()
                for own in held:
                    own.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "kind int, value string, rank bigint").distinct()


def _signed(value: str) -> int:
    return _rank(value) - (1 << 63)


def _least(found: DataFrame, credentials: int, ordinary: int) -> list[list[str]]:
    out = []
    for kind, n in enumerate([credentials] * PLAIN + [ordinary]):
        least = found.filter(F.col("kind") == kind).orderBy("rank", "value").limit(n)
        out.append([r["value"] for r in least.collect()])
    return out


def samples(docs: DataFrame, credentials: int = CREDENTIALS, ordinary: int = ORDINARY) -> list[list[str]]:
    """Labelled values of every kind and ordinary runs, by hash; bounded by the two numbers."""
    return _least(values(docs), credentials, ordinary)


def train(docs: DataFrame, credentials: int = CREDENTIALS, ordinary: int = ORDINARY) -> Model:
    """Automata and thresholds from the labelled credentials and ordinary runs of ``docs`` (text).

    The two numbers bound the samples that states are merged on; shares and thresholds are those of all values.
    Ordinary runs that score like credentials are taken out and the rest is fitted
    again, as credentials that the rules do not know stand among them.
    """
    found = stage(values(docs), "secret-values")
    seen = _least(found, credentials, ordinary)
    *labelled, plain = [[value for value in own if not _rank(value) & 1] for own in seen]
    kinds = [Automaton.of(infer(own)) if len(all_of) >= ENOUGH else None for own, all_of in zip(labelled, seen, strict=False)]
    first = Automaton.of(infer(plain))
    if all(k is None for k in kinds):
        return Model(first, kinds, [math.inf] * PLAIN)
    *kinds, first = _counted(found, [*kinds, first])
    model = Model(first, kinds, [])
    model.thresholds = _thresholds(found, model)
    plain = _unlike(model, plain)
    *_, second = _counted(found, [None] * PLAIN + [Automaton.of(infer(plain))], model)
    last = Model(second, kinds, [])
    last.thresholds = _thresholds(found, last, model)
    return last


def _unlike(model: Model, runs: list[str]) -> list[str]:
    """The runs that reach no threshold."""
    like = {i for i, _, _ in model.chosen(runs)}
    return [run for i, run in enumerate(runs) if i not in like]


def _by_kind(batch: pa.RecordBatch, odd: bool, without: Model | None) -> Iterator[tuple[int, list[str]]]:
    """(kind, its values of even or odd hash); all ordinary runs go with the odd ones, less those that ``without`` takes for credentials."""
    for part in slices(iter([batch]), RUNS_AT_ONCE):
        kinds, odds = np.asarray(part.column(0)), (np.asarray(part.column(2)) & 1) == 1
        said = part.column(1)
        for kind in range(PLAIN + 1):
            inside = (kinds == kind) & ((odds == odd) | (odd and kind == PLAIN))
            own = said.filter(pa.array(inside)).to_pylist()
            if without is not None and kind == PLAIN:
                own = _unlike(without, own)
            if own:
                yield kind, own


def _counted(found: DataFrame, automata: list[Automaton | None], without: Model | None = None) -> list[Automaton | None]:
    """``automata``, one for each kind, with the shares of all values of even hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [None if a is None else np.zeros(a.logs.shape, dtype=np.int64) for a in automata]
        for batch in batches:
            for kind, own in _by_kind(batch, False, without):
                if automata[kind] is not None:
                    sums[kind] += automata[kind].counts(*_laid(own)[:3])
        for kind, own in enumerate(sums):
            if own is not None:
                state, symbol = np.nonzero(own)
                columns = [np.full(len(state), kind, np.int32), state.astype(np.int32), symbol.astype(np.int32), own[state, symbol]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "state", "symbol", "n"])

    rows = found.mapInArrow(run, "kind int, state int, symbol int, n bigint")
    sums = [None if a is None else np.zeros(a.logs.shape, dtype=np.int64) for a in automata]
    # at most a row for each state and symbol
    for r in rows.groupBy("kind", "state", "symbol").agg(F.sum("n").alias("n")).collect():
        sums[r["kind"]][r["state"], r["symbol"]] = r["n"]
    return [None if a is None else a.with_counts(n) for a, n in zip(automata, sums, strict=True)]


def _thresholds(found: DataFrame, model: Model, without: Model | None = None) -> list[float]:
    """A threshold for each kind from the scores of its values of odd hash and of all ordinary runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, own in _by_kind(batch, True, without):
                scores = model.scores(own)
                for k in range(PLAIN) if kind == PLAIN else [kind]:
                    if model.kinds[k] is not None:
                        step, n = np.unique(np.floor(scores[k] * STEPS).astype(np.int64), return_counts=True)
                        columns = [np.full(len(step), k, np.int32), np.full(len(step), kind == PLAIN), step, n.astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "plain", "step", "n"])

    rows = found.mapInArrow(run, "kind int, plain boolean, step bigint, n bigint")
    tables: dict[tuple[int, bool], list[tuple[int, int]]] = defaultdict(list)
    for r in rows.groupBy("kind", "plain", "step").agg(F.sum("n").alias("n")).collect():
        tables[r["kind"], r["plain"]].append((r["step"], r["n"]))
    out = []
    for k in range(PLAIN):
        mine, usual = (np.array(sorted(tables[k, plain]), dtype=np.int64).reshape(-1, 2) for plain in (False, True))
        out.append(_bar(_quantile(mine, MISSED), usual) if len(mine) else math.inf)
    return out


def _quantile(table: np.ndarray, share: float) -> int:
    """Least step of ``table`` (step, n) with over ``share`` of the rows up to it."""
    upto = np.cumsum(table[:, 1])
    return int(table[np.searchsorted(upto, share * (upto[-1] - 1), side="right"), 0])


def _bar(low: int, usual: np.ndarray) -> float:
    """Threshold of a kind whose credentials reach the step ``low``, given the steps of ordinary runs and how often they occur."""
    below = usual[usual[:, 0] < low]
    n, n_below = usual[:, 1].sum(), below[:, 1].sum()
    if n - n_below > SUSPECT * n:
        return max(0.0, float((_quantile(usual, 1 - FALSE) + 1) / STEPS))
    # credentials that the rules do not know form a group of their own in the tail
    tail = below[below[:, 0] >= _quantile(below, 1 - SUSPECT), 0] if len(below) else below[:, 0]
    steps = np.r_[tail, low] if len(tail) else np.array([low, low])
    widest = int(np.argmax(np.diff(steps)))
    return max(0.0, float((steps[widest] + steps[widest + 1]) / 2 / STEPS))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` (text) with ``spans``, by start, then kind: the rules' and those the automata add."""
    model = train(docs) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            spans: list[list[dict]] = []
            places: list[tuple[int, int]] = []
            runs: list[str] = []

            def settled() -> None:
                for i, kind, score in model.chosen(runs):
                    row, start = places[i]
                    spans[row].append({"start": start, "end": start + len(runs[i]), "kind": KINDS[kind], "base": False, "score": score})
                runs.clear()
                places.clear()

            for row, text in enumerate(batch.column(at).to_pylist()):
                base, free = spans_and_runs(text or "")
                spans.append([{"start": s, "end": e, "kind": KINDS[k], "base": True, "score": None} for s, k, e, _ in base])
                for start, value in free:
                    places.append((row, start))
                    runs.append(value)
                if len(runs) >= RUNS_AT_ONCE:
                    settled()
            settled()
            for found in spans:
                found.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("score", pa.float64())]))
            yield replaced(batch, spans=pa.array(spans, kind))

    return docs.mapInArrow(run, schema_with(docs, spans=f"array<{SPAN}>"))


def joined(spans: str):
    """``kind:start:end`` of a column of spans, comma-joined."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, said), ",")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; of overlapping spans the first stands for all they cover."""
    found = find(docs, model)
    # pieces of text between spans, kept with where the next may begin
    step = lambda acc, s: F.struct(
        F.when(
            s["start"] >= acc["at"],
            F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")),
        ).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    text = F.aggregate("spans", begin, step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.char_length("text"))))
    return found.withColumn("text", text).select(*docs.columns)
