"""Conversation repair against a plain table of cheapest edits."""

import hashlib
import random
import re
import zlib

import pytest

from convoca.llm import dialogue

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANK = "[\\x20\\x09-\\x0D]"


def plain_damage(rows):
    out = []
    for row in rows:
        said = [" " if x is None else str(x) for x in row[:2]]
        at = zlib.crc32(":".join(said).encode()) % 20
        conv, turn, role, text = row
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if at == 1 else re.sub("[.!?]", "", text) if at == 2 else text
        out += [(conv, turn, "user" if at == 4 else role, text)] * (0 if at == 0 else 2 if at == 3 else 1)
    return out


def cheapest(rows):
    """(cost, letters, (role, text) that remain) by going back over all rows and states."""
    legal = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    names = {"u": "user", "a": "assistant"}
    best = {"0": (0, "", ()), "a": (0, "", ()), "u": (2, "I", (("assistant", ""),)), "s": (4, "II", (("user", ""), ("assistant", "")))}
    for role, text, fault in reversed(rows):
        now = {}
        for q in "0sua":
            ways = [(best[q][0] + 3, "D" + best[q][1], best[q][2])]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                after = legal.get((q, role[:1]))
                if after:
                    c, s, out = best[after]
                    ways.append((c + more, "K" + s, ((role, text), *out)))
                for new, full in names.items():
                    if (q, new) in legal:
                        c, s, out = best[new]
                        ways.append((c + 2 + more, "R" + s, ((full, text), *out)))
            now[q] = min(ways, key=lambda w: w[:2])
        for _ in range(3):
            for q in "0sua":
                for new, full in names.items():
                    if (q, new) in legal:
                        c, s, out = now[new]
                        now[q] = min(now[q], (c + 2, "I" + s, ((full, ""), *out)), key=lambda w: w[:2])
        best = now
    return best["0"]


def plain_report(original, rows):
    out = []
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in mine:
            said = re.sub(f"{BLANK}+$", "", text)
            faults.append("blank" if not re.search(f"[^{BLANK[1:]}", text) else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, letters, left = cheapest([(r[2], r[3], f) for r, f in zip(mine, faults, strict=True)])
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False)), cost, letters,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(df):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, df.select(columns).collect()), key=str)


def talk(rng, conv, n, roles=("system", "user", "assistant", "user", "assistant", "x", "", None, "sage", "User")):
    out = []
    for turn in range(n):
        text = rng.choice(["yes.", "No", f"line {rng.randint(0, 5)}.", f"t{turn}!", " \t", "", None, "ends. \n", "é?"])
        out.append((conv, None if rng.random() < 0.05 else turn + (turn > 5) * rng.randint(0, 2), rng.choice(roles), text))
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(12)
    rows = [r for conv in range(150) for r in talk(rng, conv, rng.randint(1, 14))]
    rows += [r for conv in range(150, 220) for r in talk(rng, conv, rng.randint(1, 14), ("user", "assistant"))]
    rows += talk(rng, None, 9) + rows[:30] + [(500, None, "user", "same.")] * 40 + [(501, 7, None, None)] + [(502, 3, "user", "w. " * 40_000)]
    return rows


def test_same_as_plain_table(spark, talks):
    df = spark.createDataFrame([(*r, "k", 1) for r in talks], SCHEMA + ", kinds string, part int").repartition(3)
    bad = dialogue.damaged(df)
    assert sorted(map(tuple, bad.collect()), key=str) == sorted(plain_damage(talks), key=str)
    assert rows_of(dialogue.report(bad, df)) == plain_report(talks, plain_damage(talks))


def test_long_conversations_in_pieces(spark):
    """Segments of a few rows; one conversation spans many partitions."""
    rng = random.Random(5)
    rows = talk(rng, 1, 700) + talk(rng, 2, 60, ("user",)) + talk(rng, None, 40, ("assistant", "user")) + [(3, None, "user", "hot.")] * 90
    rows += [r for conv in range(10, 30) for r in talk(rng, conv, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(dialogue.report(df, df, most=7)) == plain_report(rows, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    left = dialogue.repair(df, most=7).filter("conv_id = 1").orderBy("part", "seg", "at").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in left)) and len(left) > 100


def test_every_sequence_of_kinds():
    """All sequences of four kinds, blocks of one and of two rows against one block."""
    from itertools import product

    rng = random.Random(2)
    for n in range(5):
        for kinds in product(dialogue.KINDS, repeat=n):
            if n > 2 and rng.random() < 0.8:
                continue
            kinds = "".join(kinds)
            rows = [({"d": "user"}.get(k, k.lower() + "!"), "", "blank" if k == "d" else "truncated" if k.isupper() else "") for k in kinds]
            cost, letters, _ = cheapest(rows)
            for block in (1, 2, 64):
                got = dialogue.edits(kinds, dialogue.START, dialogue.FINAL, True, block)[0]
                assert (dialogue.cost_of(kinds, got), got) == (cost, letters), kinds


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dialogue.report(none, none).count() == 0 and dialogue.repair(none).count() == 0
    ids = spark.createDataFrame([(4, 1, "user", "a."), (None, 1, "user", "a.")], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert rows_of(dialogue.report(none, ids)) == sorted([(c, 0, 0, 0, 0, 0, 0, "", empty) for c in (4, None)], key=str)
