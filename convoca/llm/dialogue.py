"""Repair of conversation structure: cheapest edits to ``(s?(ua)+)?`` by an auction for shortest paths.

A conversation is a lattice: nodes are (rows read, role state), arcs are Keep (0),
Rerole (2), Delete (3) and Insert (2), with 1 for a truncated row that stays.
``settle`` is the auction: every node has a price, at most the cost of its cheapest
arc plus the price behind it. A path grows from its start along the arc that
attains the price; where a node's price is below all its arcs, it is raised to the
least and the path retreats. When the path reaches the end, the prices along it
are exact distances. Prices start at what the rows ahead cost in any case.
``trace`` then walks from the start over tight arcs in the order of their letters,
settling a node before an arc to it counts as tight, so the letters are the least
of all cheapest edits. Every state allows one role for Insert and Rerole, so the
letters say everything.

Scale: rows are range-partitioned by conversation and turn, so a conversation may
lie in many partitions, and are cut into segments of at most ``ROWS`` rows or
``BYTES`` of text (and blocks of ``BLOCK`` rows for the auction). Nearly all
conversations are one segment and are solved alone. Of longer ones each segment
is summed up by the costs between its four entry and exit states; a stream over
these summaries, backwards, gives each segment the prices behind it, then all
segments are traced at once from each entry, and a stream forwards picks the entry.
Streams hold one summary at a time. Copies are found by grouping digests of 128
bits, which pre-aggregates a line that a third of all rows share.

Defined results: null roles and texts count as one blank; rows with equal turns
are taken by role, then text; null turns come first; a null ``conv_id`` is a
conversation of its own. A role is known by its first letter, and one without
``s``, ``u`` or ``a`` (an empty one too) cannot be kept. Conversations whose rows
are all deleted have an empty text. An empty table gives an empty table. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from convoca.llm.common import slices
from convoca.sources.staging import full_width, stage

ROWS, BYTES, BLOCK = 1024, 1 << 20, 64
BLANKS = " \t\n\v\f\r"
FAR = 1 << 60

START, SYSTEM, USER, ASSISTANT = range(4)
# the state after one more turn that an edit chooses, and its role
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
# the states in which a row of each initial can be kept, and the state after it
KEEPS = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
    "x": {},
}
FINAL = (0, FAR, FAR, 0)
# a row is written as d (has to go) or by its initial, a capital if truncated
KINDS = "dsuaxSUAX"


def _arcs(kind: str, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and step (of node numbers) of every edit before or at a row, in order of letters."""
    more = int(kind.isupper())
    out = [("D", 3, 4), ("I", 2, NEXT[state] - state)]
    if kind != "d":
        after = KEEPS[kind.lower()].get(state)
        if after is not None:
            out.append(("K", more, 4 + after - state))
        out.append(("R", 2 + more, 4 + NEXT[state] - state))
    return out


ARCS = {kind: [_arcs(kind, state) for state in range(4)] for kind in KINDS}
LEAST = {kind: 3 if kind == "d" else int(kind.isupper()) for kind in KINDS}


class Lattice:
    """A block of rows with the costs behind it; node ``4 * rows read + state``, the end behind the last."""

    def __init__(self, kinds: str, exits: tuple[int, ...], last: bool):
        self.kinds, n = kinds, len(kinds)
        self.end = 4 * n + 4
        self.outs = [[("", exits[q], self.end - 4 * n - q)] for q in range(4)]
        if last:
            for q in range(4):
                self.outs[q].append(("I", 2, NEXT[q] - q))
        ahead = min(exits)
        prices = [ahead] * 4
        for kind in reversed(kinds):
            ahead += LEAST[kind]
            prices += [ahead] * 4
        self.price = prices[::-1] + [0]
        self.exact = [False] * self.end + [True]
        if FAR in exits:
            self._close()

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        at, state = node >> 2, node & 3
        return ARCS[self.kinds[at]][state] if at < len(self.kinds) else self.outs[state]

    def _close(self) -> None:
        """Nodes with no way to the end get the price ``FAR`` for good."""
        for node in range(self.end - 4, self.end):
            self.exact[node] = self.outs[node & 3][0][1] == FAR
        for at in range(len(self.kinds), -1, -1):
            nodes = range(4 * at, 4 * at + 4)
            if at < len(self.kinds):
                for node in nodes:
                    self.exact[node] = True
            for _ in range(3):  # inserted turns lead on within the row
                for node in nodes:
                    open_ = (cost < FAR and not (self.exact[node + step] and node + step < self.end) for _, cost, step in self.arcs(node))
                    if self.exact[node] and any(open_):
                        self.exact[node] = False
            for node in nodes:
                if self.exact[node]:
                    self.price[node] = FAR

    def settle(self, node: int) -> int:
        """The exact distance of ``node`` from the end, by auction."""
        price, exact, path = self.price, self.exact, [node]
        while not exact[node := path[-1]]:
            best, to = FAR + 1, node
            for _, cost, step in self.arcs(node):
                if cost + price[node + step] < best:
                    best, to = cost + price[node + step], node + step
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            exact[node] = True
        return price[path[0]]

    def trace(self, state: int) -> tuple[str, int]:
        """Letters of the least cheapest way from a state before the block, and the state behind it."""
        node, letters = state, []
        self.settle(node)
        while True:
            for letter, cost, step in self.arcs(node):
                to = node + step
                if cost + self.price[to] == self.price[node] and cost + self.settle(to) == self.price[node]:
                    break
            if to == self.end:
                return "".join(letters), node & 3
            letters.append(letter)
            node = to


def prices(kinds: str, exits: tuple[int, ...], last: bool, block: int = BLOCK) -> list[Lattice]:
    """The blocks of a segment, each settled against the one behind it."""
    out = []
    for at in reversed(range(0, max(1, len(kinds)), block)):
        lattice = Lattice(kinds[at : at + block], exits, last and at + block >= len(kinds))
        exits = tuple(min(FAR, lattice.settle(state)) for state in range(4))
        out.append(lattice)
    return out[::-1]


def edits(kinds: str, state: int, exits: tuple[int, ...], last: bool, block: int = BLOCK) -> tuple[str, int]:
    """Letters of the edits of a segment entered in ``state``, and the state behind it."""
    letters = []
    for lattice in prices(kinds, exits, last, block):
        some, state = lattice.trace(state)
        letters.append(some)
    return "".join(letters), state


@lru_cache(maxsize=100_000)
def whole(kinds: str) -> str:
    """Letters of the edits of a conversation in one segment."""
    return edits(kinds, START, FINAL, True)[0]


def cost_of(kinds: str, letters: str) -> int:
    rows = iter(kinds)
    out = 0
    for letter in letters:
        kind = "d" if letter == "I" else next(rows)
        out += {"D": 3, "I": 2, "K": 0, "R": 2}[letter] + (letter in "KR" and kind.isupper())
    return out


def replay(letters: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of every turn that remains."""
    at = 0
    for letter in letters:
        if letter == "D":
            at += 1
            continue
        if letter == "K":
            role, state = roles[at], KEEPS[roles[at][:1]][state]
        else:
            state = NEXT[state]
            role = ROLE[state]
        yield letter, role, "" if letter == "I" else texts[at]
        at += letter != "I"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by the checksum of ``conv_id:turn`` modulo 20, nulls as one blank.

    0 drops the row, 1 empties its text, 2 removes the marks that end sentences,
    3 repeats it, 4 makes it a user's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    at = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), at.alias("at"))
    times = F.when(F.col("at") == 3, 2).otherwise(1)
    text = F.when(F.col("at") == 1, "").when(F.col("at") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter("at <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("at") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")


def _fault(text: str) -> str:
    text = text.rstrip(BLANKS)
    return "b" if not text else "." if text[-1] in ".!?" else "t"


def _tables(rows: Iterator[tuple], names: list[str], types: list, at_once: int) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, at_once)):
        columns = zip(*held, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _mapped(df: DataFrame, columns: list[str], function, out: str, keep: int = 0, at_once: int = 1000) -> DataFrame:
    """Rows of ``columns`` turned by ``function`` (an iterator of tuples to one); its first ``keep`` columns are those, then ``out``."""
    schema = T.StructType([df.schema[c] for c in columns[:keep]] + T._parse_datatype_string(out).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in slices(batches) for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _tables(function(rows), arrow.names, arrow.types, at_once)

    return df.select(*columns).mapInArrow(run, schema)


def _cut(rows: Iterator[tuple], most: int) -> Iterator[tuple]:
    part, seg, size, held = TaskContext.get().partitionId(), 0, 0, []

    def made() -> tuple:
        conv, turns, roles, texts = zip(*held, strict=True)
        digests = [hashlib.blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest() for r, t in zip(roles, texts, strict=True)]
        initials = "".join(r[0] if r[:1] in ("s", "u", "a") else "x" for r in roles)
        return conv[0], part, seg, turns, roles, texts, digests, initials, "".join(map(_fault, texts))

    for row in rows:
        if held and (row[0] != held[0][0] or len(held) >= most or size >= BYTES):
            yield made()
            seg, size, held = seg + 1, 0, []
        held.append(row)
        size += len(row[3])
    if held:
        yield made()


def segments(turns: DataFrame, most: int = ROWS) -> DataFrame:
    """Rows in order, one row for each segment: conversation, place, turns, roles, texts, digests, initials and faults."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role"), blank("text"))
    width = 2 * int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # bounds of the ranges are sampled: only the beginnings of texts take part
    rows = rows.repartitionByRange(width, "conv_id", "turn", "role", F.substring("text", 1, 32))
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text")
    out = (
        "part int, seg int, turns array<bigint>, roles array<string>, texts array<string>, "
        "digests array<binary>, initials string, faults string"
    )
    return stage(_mapped(rows, ["conv_id", "turn", "role", "text"], partial(_cut, most=most), out, keep=1, at_once=50), "segments")


def _facts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """What the rows of a segment are: kinds, numbers of faults, role breaks, turns, and its edges."""
    for conv, part, seg, turns, initials, faults, firsts in rows:
        firsts = set(firsts or ())
        kinds, copies = [], 0
        for at, (initial, fault) in enumerate(zip(initials, faults, strict=True)):
            again = fault != "b" and at not in firsts
            copies += again
            kinds.append("d" if again or fault == "b" else initial.upper() if fault == "t" else initial)
        kinds = "".join(kinds)
        breaks = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
        known = [t for t in turns if t is not None]
        yield (
            conv, part, seg, kinds, faults.count("b"), copies, sum(k.isupper() for k in kinds), breaks,
            len(set(known)), min(known, default=None), max(known, default=None), turns[0], turns[-1], initials[0] + initials[-1],
        )


def facts(segs: DataFrame) -> DataFrame:
    """One row for each segment, of bounded size and without texts; ``pieces`` counts the segments of its conversation."""
    line = segs.select("part", "seg", "conv_id", F.posexplode("digests").alias("at", "digest"))
    first = line.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "seg", "at")).alias("f"))
    first = first.groupBy(F.col("f.part").alias("part"), F.col("f.seg").alias("seg")).agg(F.collect_list("f.at").alias("firsts"))
    both = segs.select("conv_id", "part", "seg", "turns", "initials", "faults").join(first, ["part", "seg"], "left")
    found = _mapped(
        both, ["conv_id", "part", "seg", "turns", "initials", "faults", "firsts"], _facts,
        "kinds string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, n_turns bigint, "
        "low bigint, high bigint, first_turn bigint, last_turn bigint, ends string", keep=3,
    )
    return stage(found, "facts")


def _solved(rows: Iterator[tuple]) -> Iterator[tuple]:
    for part, seg, kinds in rows:
        letters = whole(kinds)
        yield part, seg, START, letters, cost_of(kinds, letters)


def _between(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Costs between the four states before and behind each segment; of a last one those to the end."""
    for *place, kinds, last in rows:
        goals = [FINAL] if last else [tuple(0 if q == goal else FAR for q in range(4)) for goal in range(4)]
        yield *place, [min(FAR, prices(kinds, goal, bool(last))[0].price[q]) for goal in goals for q in range(4)]


def _behind(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Prices behind each segment, the last first, with the role breaks and shared turns at its joints."""
    before: tuple = ()
    for part, seg, conv, first_turn, last_turn, ends, costs in rows:
        if before != (conv,):
            before, ahead, later = (conv,), FINAL, None
        breaks = int(later is not None and ends[1] + later[1][0] not in ("su", "ua", "au"))
        shared = int(later is not None and last_turn is not None and last_turn == later[0])
        yield part, seg, ahead, breaks, shared
        if len(costs) == 4:
            ahead = tuple(costs)
        else:
            ahead = tuple(min(FAR, min(costs[4 * goal + q] + ahead[goal] for goal in range(4))) for q in range(4))
        later = (first_turn, ends)


def _ways(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Edits of a segment from every state it can be entered in."""
    for *place, kinds, last, exits in rows:
        made = [edits(kinds, state, FINAL if last else tuple(exits), bool(last)) for state in range(4)]
        yield *place, [letters for letters, _ in made], [cost_of(kinds, letters) for letters, _ in made], [after for _, after in made]


def _entered(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The state each segment is entered in."""
    before: tuple = ()
    for part, seg, conv, states in rows:
        if before != (conv,):
            before, state = (conv,), START
        yield part, seg, state
        state = states[state]


def audits(known: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(part, seg, several, state, audit, cost) of every segment; joints of conversations of several segments (None without any)."""
    counts = known.groupBy("conv_id").agg(F.max(F.struct("part", "seg")).alias("end"), F.count(F.lit(1)).alias("pieces"))
    long = counts.filter("pieces > 1").select(F.col("conv_id").alias("long"), "end")
    marked = known.join(long, F.col("conv_id").eqNullSafe(F.col("long")), "left")
    marked = stage(marked.withColumn("last", (F.struct("part", "seg") == F.col("end")).cast("int")).drop("long", "end"), "marked")
    alone = full_width(marked.filter("last is null"), "part", "seg")
    solved = _mapped(alone, ["part", "seg", "kinds"], _solved, "state int, audit string, cost bigint", keep=2)
    solved = solved.withColumn("several", F.lit(False))
    several = marked.filter("last is not null")
    if not several.limit(1).count():
        return stage(solved, "audits"), None
    place, edges = ["part", "seg", "conv_id"], ["first_turn", "last_turn", "ends"]
    costs = _mapped(full_width(several, "part", "seg"), [*place, *edges, "kinds", "last"], _between, "costs array<bigint>", keep=6)
    backward = stage(costs, "between").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seg"))
    joints = stage(
        _mapped(backward, [*place, *edges, "costs"], _behind, "exits array<bigint>, breaks bigint, shared bigint", keep=2), "joints"
    )
    ahead = full_width(several.select(*place, "kinds", "last").join(joints.select("part", "seg", "exits"), ["part", "seg"]), "part", "seg")
    out = "audits array<string>, costs array<bigint>, states array<int>"
    ways = stage(_mapped(ahead, [*place, "kinds", "last", "exits"], _ways, out, keep=3, at_once=100), "ways")
    forward = ways.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    states = _mapped(forward, [*place, "states"], _entered, "state int", keep=2)
    chosen = ways.join(states, ["part", "seg"]).select(
        "part", "seg", "state", F.get("audits", "state").alias("audit"), F.get("costs", "state").alias("cost"), F.lit(True).alias("several")
    )
    return stage(solved.unionByName(chosen), "audits"), joints


def _remade(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, part, seg, roles, texts, state, audit in rows:
        left = list(replay(audit, state, roles, texts))
        yield conv, part, seg, [x[0] for x in left], [x[1] for x in left], [x[2] for x in left]


def _turns_left(segs: DataFrame, done: DataFrame) -> DataFrame:
    """(conv_id, part, seg, edits, roles, texts): what is left of each segment."""
    both = segs.select("conv_id", "part", "seg", "roles", "texts").join(done.select("part", "seg", "state", "audit"), ["part", "seg"])
    columns = ["conv_id", "part", "seg", "roles", "texts", "state", "audit"]
    return _mapped(both, columns, _remade, "edits array<string>, roles array<string>, texts array<string>", keep=3, at_once=50)


def repair(turns: DataFrame, most: int = ROWS) -> DataFrame:
    """(conv_id, part, seg, at, edit, role, text): turns that remain of ``turns`` (conv_id, turn, role, text).

    In a conversation they follow one another by ``part``, ``seg`` and ``at``.
    """
    segs = segments(turns, most)
    done, _ = audits(facts(segs))
    left = _turns_left(segs, done).select("conv_id", "part", "seg", F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("at", "t"))
    return left.select("conv_id", "part", "seg", "at", F.col("t.edits").alias("edit"), F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def _joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Edits and digest of each conversation, its segments one after another."""
    before: tuple = ()
    for conv, audit, n_left, body in rows:
        if before != (conv,):
            if before:
                yield before[0], "".join(letters), digest.hexdigest()
            before, letters, digest, begun = (conv,), [], hashlib.sha256(), False
        letters.append(audit)
        if n_left:
            digest.update((b"\n" if begun else b"") + body.encode())
            begun = True
    if before:
        yield before[0], "".join(letters), digest.hexdigest()


def report(turns: DataFrame, ids: DataFrame, most: int = ROWS) -> DataFrame:
    """Per conversation of ``ids`` (conv_id): faults of its ``turns``, cost and letters of the edits, digest of what is left."""
    segs = segments(turns, most)
    known = facts(segs)
    done, joints = audits(known)
    body = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit(":"), t["texts"])), "\n")
    left = _turns_left(segs, done).select("part", "seg", F.size("roles").alias("n_left"), body.alias("body"))
    left = left.join(done.select("part", "seg", "several", "audit", "cost"), ["part", "seg"])
    digest = F.when(~F.col("several"), F.sha2("body", 256)).alias("repaired_sha256")
    rest = F.when(F.col("several"), F.col("body")).alias("body")
    left = stage(left.select("part", "seg", "several", "audit", "cost", "n_left", digest, rest), "left")
    every = known.join(left, ["part", "seg"])
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0)).cast("bigint").alias("gaps")
    numbers = ["blank", "duplicate", "truncated", "illegal", "cost"]
    found = every.filter("not several").select("conv_id", gaps, *numbers, "audit", "repaired_sha256")
    if joints is not None:
        sums = every.filter("several").join(joints, ["part", "seg"]).groupBy("conv_id").agg(
            F.max("high").alias("high"), F.min("low").alias("low"), (F.sum("n_turns") - F.sum("shared")).alias("n_turns"),
            *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")),
            (F.sum("illegal") + F.sum("breaks")).alias("illegal"),
        )
        pieces = every.filter("several").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
        texts = _mapped(pieces, ["conv_id", "audit", "n_left", "body"], _joined, "audit string, repaired_sha256 string", keep=1)
        texts = texts.withColumnRenamed("conv_id", "long")
        sums = sums.join(texts, F.col("conv_id").eqNullSafe(F.col("long"))).select("conv_id", gaps, *numbers, "audit", "repaired_sha256")
        found = found.unionByName(sums)
    own = ids.select(F.col("conv_id").alias("own")).distinct()
    return own.join(found, F.col("own").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("own").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *numbers)),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
