"""Conversation repair against a plain dynamic programme over audit strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import turns as T

SF = "/root/testdata/sf0.01"
EMIT = {"n": "u", "s": "u", "u": "a", "a": "u"}
KEEPS = {"n": "su", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Least (cost, audit) of ``(role, text, fault)`` rows, by states after each row, from the last row on."""
    after = None
    for i in range(len(rows), -1, -1):
        best = {q: [(0, "")] if i == len(rows) and q in "na" else [] for q in "nsua"}
        if i < len(rows):
            role, _, fault = rows[i]
            more = fault == "truncated"
            for q in "nsua":
                best[q].append((after[q][0] + 3, "D" + after[q][1]))
                if fault not in ("blank", "duplicate"):
                    if role[:1] and role[:1] in KEEPS[q]:
                        best[q].append((after[role[0]][0] + more, "K" + after[role[0]][1]))
                    best[q].append((after[EMIT[q]][0] + 2 + more, "R" + after[EMIT[q]][1]))
        for _ in range(3):
            for q in "nsua":
                best[q] += [(c + 2, "I" + a) for c, a in best[EMIT[q]]]
        after = {q: min(best[q]) for q in "nsua"}
    return after["n"]


def plain(rows):
    """The report of one damaged conversation: rows ``(turn, role, text)`` in order."""
    seen, found = set(), []
    for turn, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
        seen.add((role, text))
        found.append((role, text, fault))
    cost, audit = cheapest(found)
    state, at, lines = "n", 0, []
    for op in audit:
        if op == "D":
            at += 1
            continue
        role, text, _ = found[at] if op != "I" else (None, "", None)
        state = role[0] if op == "K" else EMIT[state]
        lines.append(f"{role if op == 'K' else FULL[state]}:{text}")
        at += op != "I"
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    faults = [sum(f == kind for *_, f in found) for kind in ("blank", "duplicate", "truncated")]
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha), lines


def damaged(rows):
    """Conversations after damage, from ``(conv_id, turn, role, text)``."""
    out = defaultdict(list)
    for k, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if k is None else k}:{' ' if turn is None else turn}".encode()) % 20
        out[k]
        if f:
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            out[k] += [(turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {k: sorted(v, key=order) for k, v in out.items()}


def compare(spark, rows, frame):
    got = {r.conv_id: tuple(r)[1:] for r in T.report(frame).collect()}
    want = {k: plain(v)[0] for k, v in damaged(rows).items()}
    assert got == want


def test_auction_finds_the_first_of_all_cheapest_edits():
    r = random.Random(3)
    for _ in range(1500):
        faults = [None, None, None, "blank", "duplicate", "truncated"]
        rows = [(r.choice(["user", "assistant", "system", "tool", "", " "]), "", r.choice(faults)) for _ in range(r.randrange(12))]
        size, end, steps = r.choice([1, 2, 3, 5, 32]), T.END, []
        for part in reversed([rows[i : i + size] for i in range(0, len(rows), size)]):
            found, end = T.Lattice([(x[0][:1], x[2]) for x in part], end).steps()
            steps = found + steps
        digest = T._Digest()
        for (role, text, fault), step in zip(rows, steps):
            digest.turn(None, role, text, fault, step)
        digest.close()
        assert (digest.cost, "".join(digest.audit)) == cheapest(rows) and end[0] == digest.cost


def test_prices_never_exceed_an_arc_and_are_exact_where_said():
    r = random.Random(4)
    for _ in range(200):
        turns = [(r.choice("uuaast"), r.choice([None, None, "blank", "truncated"])) for _ in range(9)]
        lattice = T.Lattice(turns, T.END)
        lattice.auction(0)
        for node in range(lattice.sink):
            assert all(lattice.price[node] <= cost + lattice.price[head] for _, cost, head in lattice.arcs(node))
        names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
        assert lattice.price[0] == cheapest([(names[i], "", f) for i, f in turns])[0]


def test_given_conversations(spark):
    frame = spark.read.parquet(f"{SF}/conversations.parquet")
    compare(spark, [tuple(x) for x in frame.select("conv_id", "turn", "role", "text").collect()], frame.repartition(3))


def test_edges(spark):
    r = random.Random(8)
    rows = [(1, i, r.choice(["user", "assistant"]), r.choice(["yes.", "no", "Ok!", " ", "well? \n"])) for i in range(600)]
    rows += [(2, None, "user", "a."), (2, None, None, "b."), (2, 5, "assistant", None), (2, 9, "", "c?"), (2, 9, "system", "d.")]
    rows += [(None, 0, "user", "x" * 200_000 + "."), (None, 1, "assistant", "end.\n\n"), (3, 7, "user", ""), (4, None, None, None)]
    rows += [(5, 2, "user", "tie."), (5, 2, "assistant", "tie."), (5, 2, "user", "tie."), (2**62 + 1, 2**60 + 1, "user", "big."), (2**62 + 3, 2**60 + 7, "user", "big.")]
    dropped = next(k for k in range(100, 1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "alone."))
    frame = spark.createDataFrame([(*x, "k", "f", "s") for x in rows], "conv_id long, turn long, role string, text string, place string, fault string, steps string")
    compare(spark, rows, frame.repartition(4))
    assert T.report(frame).where(f"conv_id = {dropped}").first()[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert T.report(frame.limit(0)).count() == 0
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    compare(spark, rows, frame)
    spark.conf.set(batch, before)


@pytest.mark.parametrize("partitions", [1, 3])
def test_repaired_turns(spark, partitions):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi!"), (1, 3, "user", "Hi!"), (2, 0, "user", "So"), (3, 0, "user", " ")]
    frame = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string").repartition(partitions)
    got = defaultdict(list)
    for x in sorted(T.repaired(frame).collect()):
        got[x.conv_id].append(f"{x.role}:{x.text}")
    want = {k: plain([x[1:] for x in rows if x[0] == k])[1] for k in (1, 2, 3)}
    assert dict(got) == {k: v for k, v in want.items() if v}
