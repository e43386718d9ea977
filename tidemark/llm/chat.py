"""Chat formatting: layouts recognised by the hash of their field paths, mapped to turns, and one reversible template."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import text_batches

#: Control strings of the template. Inside texts a tilde after the first character breaks them; a tilde is doubled.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
_CONTROL = re.compile("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL))
_PIECE = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>\n(?P<system>.*?)\n<</SYS>>|<<ROLE>>(?P<role>.*?)<<TEXT>>(?P<other>.*?)<</ROLE>>| (?P<assistant>.*?)</s>", re.DOTALL)


def paths(value, at: str = "") -> Iterator[str]:
    """The nested field paths of a record or a schema, list items as ``[]``; values and their order do not count."""
    if isinstance(value, T.StructType):
        value = {f.name: f.dataType for f in value.fields}
    if isinstance(value, dict):
        for k, v in value.items():
            yield from paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, T.ArrayType):
        yield from paths(value.elementType, at + "[]")
    elif isinstance(value, list):
        if not value:
            yield at + "[]"
        for v in value:
            yield from paths(v, at + "[]")
    else:
        yield at


def schema_fingerprint(value) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths(value)))).encode()).hexdigest()[:16]


def layouts_of(*examples: tuple[dict, dict]) -> dict[str, dict]:
    """Mappings by the fingerprint of the paths they need, each with these paths under ``needs``."""
    return {schema_fingerprint(example): {**mapping, "needs": frozenset(paths(example))} for example, mapping in examples}


#: Layouts of whole records: where the turns lie and which fields of a turn, or fixed roles and fields in order.
LAYOUTS = layouts_of(
    ({"messages": [{"role": "", "content": ""}]}, {"turns": "messages", "role": "role", "text": "content"}),
    ({"conversations": [{"from": "", "value": ""}]}, {"turns": "conversations", "role": "from", "text": "value"}),
    ({"prompt": "", "response": ""}, {"fields": [("user", "prompt"), ("assistant", "response")]}),
    ({"prompt": "", "completion": ""}, {"fields": [("user", "prompt"), ("assistant", "completion")]}),
    ({"instruction": "", "output": ""}, {"fields": [("user", "instruction"), ("assistant", "output")]}),
    ({"instruction": "", "input": "", "output": ""}, {"fields": [("user", "instruction", "input"), ("assistant", "output")]}),
    ({"system": "", "instruction": "", "output": ""}, {"fields": [("system", "system"), ("user", "instruction"), ("assistant", "output")]}),
    ({"system": "", "instruction": "", "input": "", "output": ""}, {"fields": [("system", "system"), ("user", "instruction", "input"), ("assistant", "output")]}),
)
#: Layouts of tables with a row per turn: the columns of the canonical turns.
TABLES = layouts_of(
    ({"conv_id": "", "turn": "", "role": "", "text": ""}, {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"}),
    ({"id": "", "index": "", "from": "", "value": ""}, {"conv_id": "id", "turn": "index", "role": "`from`", "text": "value"}),
)


def selected(value, layouts: dict[str, dict], known: dict | None = None) -> dict | None:
    """The mapping whose needed paths the value has: that of its own fingerprint, else the one that needs most.

    Other fields do not matter; an empty list stands for lists of any items. ``known`` remembers choices by fingerprint.
    """
    mark = schema_fingerprint(value)
    if mark in layouts:
        return layouts[mark]
    if known is not None and mark in known:
        return known[mark]
    own = set(paths(value))
    has = lambda path: path in own or any(path.startswith(f"{p}.") for p in own if p.endswith("[]"))
    fit = [m for m in layouts.values() if all(has(p) for p in m["needs"])]
    found = max(fit, key=lambda m: len(m["needs"]), default=None)
    if known is not None:
        known[mark] = found
    return found


#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _text(x) -> str:
    return x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)


def _others(value, used) -> str | None:
    """The fields that a mapping does not use, as JSON; null if there are none."""
    rest = {k: v for k, v in value.items() if k not in used} if isinstance(value, dict) else {}
    return json.dumps(rest, ensure_ascii=False) if rest else None


def _read(value, mapping: dict) -> list[tuple[str, str, str | None, str | None]]:
    """Role, text, other fields of the record, other fields of the turn, for each turn of a record."""
    if "turns" in mapping:
        role, text = mapping["role"], mapping["text"]
        more = _others(value, {mapping["turns"]})
        field = lambda t, f: _text(t.get(f)) if isinstance(t, dict) else ""
        return [(ROLES.get(field(t, role), field(t, role)), field(t, text) if isinstance(t, dict) else _text(t), more, _others(t, {role, text})) for t in value[mapping["turns"]]]
    more = _others(value, {f for _, *fields in mapping["fields"] for f in fields})
    return [(role, "\n".join(x for x in (_text(value[f]) for f in fields) if x), more, None) for role, *fields in mapping["fields"]]


def turns_of_record(record: str | None, layouts: dict[str, dict] = LAYOUTS) -> list[tuple[str, str]] | None:
    """Role and text of each turn of a JSON record; None where it is no JSON object or its layout is unknown."""
    try:
        value = json.loads(record or "")
    except ValueError:
        return None
    mapping = selected(value, layouts) if isinstance(value, dict) else None
    return None if mapping is None else [turn[:2] for turn in _read(value, mapping)]


def turns_of_records(records: DataFrame, conv_id: str, record: str, layouts: dict[str, dict] = LAYOUTS) -> DataFrame:
    """``conv_id, turn, role, text, layout, record_extra, turn_extra`` from a column of JSON records of any known layout.

    A record may have any other fields: those of the record and of its turns are kept as JSON beside each turn. A record
    whose layout is unknown, or that is no JSON object, gives one row with null role and text and its fingerprint (or
    null) as ``layout``, so that it is seen and a mapping can be added; all of it is in ``record_extra``.
    """

    def read(batches):
        known: dict = {}
        for batch in batches:
            rows = []
            for key, text in zip(batch["k"], batch["r"]):
                try:
                    value = json.loads(text or "")
                except ValueError:
                    rows.append((key, None, None, None, None, text, None))
                    continue
                layout = schema_fingerprint(value)
                mapping = selected(value, layouts, known) if isinstance(value, dict) else None
                if mapping is None:
                    rows.append((key, None, None, None, layout, text, None))
                else:
                    rows += [(key, i, *turn[:2], layout, *turn[2:]) for i, turn in enumerate(_read(value, mapping))]
            out = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "layout", "record_extra", "turn_extra"])
            yield out.astype({"turn": "Int64"})

    kind = records.schema[conv_id].dataType.simpleString()
    text_batches(records.sparkSession)
    out = f"conv_id {kind}, turn long, role string, text string, layout string, record_extra string, turn_extra string"
    return records.select(F.col(conv_id).alias("k"), F.col(record).alias("r")).mapInPandas(read, out)


def turns_of_table(table: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of a table with a row per turn; the paths of its schema select the columns, others are dropped."""
    mapping = selected(table.schema, TABLES)
    if mapping is None:
        raise ValueError(f"no mapping for the layout {sorted(set(paths(table.schema)))}")
    return table.select(*[F.expr(mapping[c]).alias(c) for c in ("conv_id", "turn", "role", "text")])


def escaped(text: str) -> str:
    return _CONTROL.sub("~", text.replace("~", "~~"))


def unescaped(text: str) -> str:
    return re.sub(r"~(.)", r"\1", text, flags=re.DOTALL)


def piece(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template and the range of it that the loss counts (empty but for assistants)."""
    inside = escaped(text)
    if role == "user":
        return f"[INST] {inside} [/INST]", 0, 0
    if role == "assistant":
        return f" {inside}</s>", 1, 1 + len(inside)
    if role == "system":
        return f"<<SYS>>\n{inside}\n<</SYS>>", 0, 0
    return f"<<ROLE>>{escaped(role)}<<TEXT>>{inside}<</ROLE>>", 0, 0


def read_piece(formatted: str) -> tuple[str, str]:
    m = _PIECE.fullmatch(formatted)
    if m["other"] is not None:
        return unescaped(m["role"]), unescaped(m["other"])
    role = next(r for r in ("user", "system", "assistant") if m[r] is not None)
    return role, unescaped(m[role])


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, formatted, loss_from, loss_to`` per turn, code point offsets; a conversation is its turns in order.

    Null roles and texts count as empty. Nothing is shuffled; a conversation of any length never is one string.
    """
    text_batches(turns.sparkSession)

    @F.pandas_udf("formatted string, loss_from long, loss_to long")
    def form(role: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([piece(r or "", t or "") for r, t in zip(role, text)], columns=["formatted", "loss_from", "loss_to"])

    return turns.withColumn("_f", form(F.col("role").cast("string"), F.col("text").cast("string"))).select("conv_id", "turn", "_f.*")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads the output back, turn by turn; a conversation's digests grow with it, its text is never held."""
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})
    state, none = None, object()
    now = none
    close = lambda: (None if now is pd.NA else now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
    for batch in batches:
        rows = []
        for key, text, a, b in zip(batch["conv_id"].astype("Int64"), batch["formatted"], batch["loss_from"], batch["loss_to"]):
            if now is none or (key is pd.NA) != (now is pd.NA) or (key is not pd.NA and key != now):
                if now is not none:
                    rows.append(close())
                now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, said = read_piece(text)
            loss = unescaped(text[int(a) : int(b)])
            state[0] += 1
            state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            state[2] += len(loss)
            state[3].update(loss.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
        yield frame(rows)
    if now is not none:
        yield frame([close()])


def report(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the output.

    Turns are ordered by number (null last), then by their formatted text; repeated rows are turns of their own. A
    digest runs over a conversation in order, so its turns pass one task, sorted on disk and streamed in batches.
    Rows with a null id are one conversation; an empty table gives no rows.
    """
    turns = turns_of_table(conversations)
    order = ["conv_id", F.col("turn").asc_nulls_last(), "formatted"]
    rows = formatted(turns).repartition("conv_id").sortWithinPartitions(*order)
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.select("conv_id", "formatted", "loss_from", "loss_to").mapInPandas(_digests, out)
