"""Conversation structure repair: cheapest edits to ``(system? (user assistant)+)?`` by an auction over a cost lattice.

A lattice node is a place between turns and a state of the grammar; an arc is an edit with an integer cost. The
auction keeps a price for each node, never above the cost of any arc plus the price at its head. A path grows from a
node along the arc that attains that bound; where the price at its end is below the bound, the price rises to it and
the path draws back. When the path meets the sink, the prices on it are exact, the arcs that attain them are tight, and
following tight arcs in the order of their letters gives the first of all cheapest edits.

A conversation is streamed twice through the task its rows are dealt to: backwards in short runs of turns, each with the
exact prices at its end as the cost of its sinks, and forwards along the traced arcs. Neither holds more than a batch of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_batches

#: Cost of each edit, and of each truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the grammar: nothing yet, after the system turn, after a user's turn, after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The state that a new turn leads to, by the state before it, and the role it has there.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Initials that may stand at a place, by the state before it, with the state they lead to.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Price of each state after the last turn: inserts that close an exchange.
END = (0, 2 * INSERT, INSERT, 0)
#: Turns of one run of the lattice.
RUN = 16
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
SPACE = r"[\x20\x09-\x0D]"


class Lattice:
    """Edits of a run of turns ``(initial, fault)``, with the prices of the four states at its end.

    Prices are counted from the least of these, so that all arcs cost nothing or more and zero is a lawful first price.
    """

    def __init__(self, turns: list[tuple[str, str | None]], end: tuple[int, ...]):
        self.turns, self.base = turns, min(end)
        self.sink = 4 * len(turns) + 4
        self.end = [p - self.base for p in end]
        self.price = [0] * (self.sink + 1)
        self.exact = [False] * self.sink + [True]
        self.known: list[list[tuple[str, int, int]] | None] = [None] * self.sink

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """``letter, cost, head`` of the arcs from a node, in the order of their letters."""
        found = self.known[node]
        if found is None:
            place, state = divmod(node, 4)
            if place == len(self.turns):
                found = [("", self.end[state], self.sink)]
            else:
                initial, fault = self.turns[place]
                ahead, new, more = node - state + 4, NEXT[state], TRUNCATED if fault == CUT else 0
                found = [("D", DELETE, ahead + state), ("I", INSERT, node - state + new)]
                if fault not in (BLANK, DUPLICATE):
                    if initial in KEPT[state]:
                        found.append(("K", KEEP + more, ahead + KEPT[state][initial]))
                    found.append(("R", REROLE + more, ahead + new))
            self.known[node] = found
        return found

    def auction(self, origin: int) -> None:
        """Makes the price of ``origin`` exact. Each cycle costs something, so the path never closes one and the auction ends."""
        price, path = self.price, [origin]
        while not self.exact[path[-1]]:
            node = path[-1]
            level, head = min((cost + price[head], head) for _, cost, head in self.arcs(node))
            if level > price[node]:
                price[node] = level
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        for node in path:
            self.exact[node] = True

    def tight(self, node: int) -> tuple[str, int]:
        """The tight arc of the least letter: an arc is tight if it still attains the price when the price at its head is exact."""
        self.auction(node)
        for letter, cost, head in self.arcs(node):
            if cost + self.price[head] == self.price[node]:
                self.auction(head)
                if cost + self.price[head] == self.price[node]:
                    return letter, head
        raise AssertionError("an exact price has a tight arc")

    def steps(self) -> tuple[list[str], tuple[int, ...]]:
        """For each turn the letters up to its own and the state after it, by the state before it; the four prices at the start.

        Only states that some entry of the run leads to have letters.
        """
        out, entering = [], set(STATES)
        for place in range(len(self.turns)):
            by_state, leaving = [""] * 4, set()
            for state in sorted(entering):
                letters, node = "", 4 * place + state
                while node < 4 * place + 4:
                    letter, node = self.tight(node)
                    letters += letter
                by_state[state] = f"{letters}{node % 4}"
                leaving.add(node % 4)
            out.append(",".join(by_state))
            entering = leaving
        return out, tuple(self.price[s] + self.base for s in STATES)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` with faults drawn by CRC-32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops a row (it stays, marked ``gone``, so that its conversation does not vanish), 1 empties its text, 2 removes
    its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), draw.alias("_f"))
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_f") == 3, 2).otherwise(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("_f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_f") == 0).alias("gone"), copies.alias("_copy"))
    return rows.drop("_copy")


def faulty(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone, place, fault``: turns in order, each with its first fault or null.

    Order is by turn (null first), then role and text, so ties have one order; rows that repeat stay beside each other.
    A text seen earlier with its role is known by 128 bits of hash.
    """
    one = Window.partitionBy("conv_id", "gone").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv_id", "gone", "role", F.md5("text")).orderBy("place")
    rows = turns.withColumn("place", F.row_number().over(one)).withColumn("_nth", F.row_number().over(same))
    # Java's $ would also match before a last line break, so the end is \z.
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(F.col("_nth") > 1, DUPLICATE)
        .when(~F.col("text").rlike(rf"[.!?]{SPACE}*\z"), CUT)
    )
    return rows.select("conv_id", "turn", "role", "text", "gone", "place", F.when(~F.col("gone"), fault).alias("fault"))


def _rows(batch: pd.DataFrame, *columns: str) -> Iterator[tuple]:
    """Rows of a batch with None for what is missing; ids and turns travel as strings, so that none becomes a float."""
    return zip(*[[None if x is None or x != x or x is pd.NA else x for x in batch[c].astype(object)] for c in columns])


def _priced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Backwards through the conversations: adds ``steps``; between runs only four prices are kept."""
    now, end = object(), END
    for batch in batches:
        rows = [(k, r[:1], f, g) for k, r, f, g in _rows(batch, "conv_id", "role", "fault", "gone")]
        steps: list[str | None] = [None] * len(rows)
        at = 0
        while at < len(rows):
            if rows[at][0] != now:
                now, end = rows[at][0], END
            upto = at
            while upto < len(rows) and upto - at < RUN and not rows[upto][3] and rows[upto][0] == now:
                upto += 1
            if upto == at:  # a row that is gone has no place
                at += 1
                continue
            found, end = Lattice([(r[1], r[2]) for r in reversed(rows[at:upto])], end).steps()
            steps[at:upto] = found[::-1]
            at = upto
        yield batch.assign(steps=steps)


def _stepped(turns: DataFrame) -> DataFrame:
    """Turns with their ``steps``, sorted by conversation and place; a conversation lies in one partition."""
    text_batches(turns.sparkSession)
    schema = "conv_id string, turn string, role string, text string, gone boolean, place int, fault string, steps string"
    rows = faulty(turns).withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "gone", F.desc("place"))
    return ordered.mapInPandas(_priced, schema).sortWithinPartitions("conv_id", "gone", "place")


class _Digest:
    """What the report says of one conversation, and its repaired turns, as its rows pass."""

    def __init__(self):
        self.state, self.audit, self.cost = START, [], 0
        self.counts = {BLANK: 0, DUPLICATE: 0, CUT: 0}
        self.illegal, self.before = 0, None
        self.first = self.last = None
        self.distinct = 0
        self.sha, self.any = hashlib.sha256(), False

    def line(self, role: str, text: str) -> tuple[str, str]:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True
        return role, text

    def inserted(self) -> tuple[str, str, str]:
        self.state = NEXT[self.state]
        self.cost += INSERT
        self.audit.append("I")
        return *self.line(ROLE[self.state], ""), "I"

    def turn(self, turn, role: str, text: str, fault: str | None, steps: str) -> list[tuple[str, str, str]]:
        """Counts one row and returns the repaired turns up to it, each with its edit."""
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            if self.first is None:
                self.first = int(turn)
            if int(turn) != self.last:
                self.distinct, self.last = self.distinct + 1, int(turn)
        found = []
        letters, after = (step := steps.split(",")[self.state])[:-1], int(step[-1])
        for letter in letters:
            if letter == "I":
                found.append(self.inserted())
                continue
            self.audit.append(letter)
            if letter == "D":
                self.cost += DELETE
                continue
            self.cost += (KEEP if letter == "K" else REROLE) + (TRUNCATED if fault == CUT else 0)
            found.append((*self.line(role if letter == "K" else ROLE[after], text), letter))
        self.state = after
        return found

    def close(self) -> list[tuple[str, str, str]]:
        """The inserts that close the last exchange."""
        found = []
        while self.state in (SYSTEM, USER):
            found.append(self.inserted())
        return found

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.distinct


def _passed(batches: Iterator[pd.DataFrame], finished, repaired) -> Iterator[list]:
    """Forwards through the conversations: what ``finished`` says of each and ``repaired`` of each repaired turn, batch by batch."""
    now, digest = None, None
    for batch in batches:
        out = []
        for k, turn, role, text, gone, fault, steps in _rows(batch, "conv_id", "turn", "role", "text", "gone", "fault", "steps"):
            if digest is None or k != now:
                if digest is not None:
                    out += repaired(now, digest.close()) + finished(now, digest)
                now, digest = k, _Digest()
            if not gone:
                out += repaired(k, digest.turn(turn, role, text, fault, steps))
        yield out
    if digest is not None:
        yield repaired(now, digest.close()) + finished(now, digest)


def repaired(turns: DataFrame) -> DataFrame:
    """``conv_id, place, role, text, edit``: the turns after repair, counted from 0 in each conversation.

    ``edit`` is K for a turn that is kept, R for one with another role, I for an empty one put in; deleted turns are
    not there. Takes ``conv_id, turn, role, text`` and drops other columns; null roles and texts are one space, rows
    with a null id are one conversation, and an empty table gives no rows.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = _stepped(turns.select("conv_id", "turn", text_of("role"), text_of("text"), F.lit(False).alias("gone")))

    def pieces(batches):
        count, now = 0, object()
        for found in _passed(batches, lambda k, d: [], lambda k, turns: [(k, *t) for t in turns]):
            out = []
            for k, role, text, edit in found:
                count, now = (count, k) if k == now else (0, k)
                out.append((k, count, role, text, edit))
                count += 1
            yield pd.DataFrame(out, columns=["conv_id", "place", "role", "text", "edit"])

    out = rows.mapInPandas(pieces, "conv_id string, place long, role string, text string, edit string")
    return out.withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


def report(conversations: DataFrame) -> DataFrame:
    """The damaged conversations' faults and cheapest repair, one row for each id; other columns are dropped.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. A conversation of which no row is
    left has zeros, an empty audit and the digest of the empty string. Long texts and conversations pass in batches.
    """
    columns = ["conv_id", "gaps", BLANK, DUPLICATE, CUT, "illegal", "cost", "audit", "repaired_sha256"]
    rows = _stepped(damaged(conversations))

    def digests(batches):
        close = lambda k, d: [(k, d.gaps(), *d.counts.values(), d.illegal, d.cost, "".join(d.audit), d.sha.hexdigest())]
        for found in _passed(batches, close, lambda k, turns: []):
            yield pd.DataFrame(found, columns=columns)

    numbers = ", ".join(f"{c} long" for c in columns[1:7])
    out = rows.mapInPandas(digests, f"conv_id string, {numbers}, audit string, repaired_sha256 string")
    return out.withColumn("conv_id", F.col("conv_id").cast(conversations.schema["conv_id"].dataType))
