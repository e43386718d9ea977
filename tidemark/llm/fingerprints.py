"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

Every paragraph (line) gives a wide vector, and a text's fingerprint is the sum of its paragraphs' vectors: ``EXACT``
lanes hashed from the whole paragraph, added modulo 2**64, and ``CELLS`` lanes, added modulo 2**32, to which each short
word run of the paragraph adds plus or minus one. Sums do not depend on the order, and paragraphs are inserted or deleted by adding
or subtracting their vectors. The first lanes decide equality, the angle of the others tells how alike two texts are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_batches, text_key
from tidemark.session import cut_lineage

EXACT, CELLS = 16, 256
#: Words of one run; a run ends with its paragraph.
RUN = 3
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of ``BASE`` and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _cells(data: bytes) -> np.ndarray:
    """Signed counts of the word runs of all paragraphs; hashes of byte ranges come from one running polynomial."""
    b = np.frombuffer(data, np.uint8)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(CELLS, np.int64)
    up, down = _power(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)))
    line = np.cumsum(b == 10)[first]
    last = np.searchsorted(line, line, "right") - 1
    stop = end[np.minimum(np.arange(len(first)) + RUN - 1, last)]
    h = _mixed((total[stop] - total[first]) * down[first])
    sign = 1 - 2 * ((h >> np.uint64(32)) & np.uint64(1)).astype(np.int64)
    return np.bincount((h % np.uint64(CELLS)).astype(np.int64), sign, CELLS).astype(np.int64)


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The two sums of a text (or of a single paragraph); a null or empty text has no paragraphs."""
    data = (text or "").encode("utf-8", "surrogatepass")
    exact = np.zeros(EXACT, np.uint64)
    if data:
        digests = b"".join(hashlib.shake_128(p).digest(8 * EXACT) for p in data.split(b"\n"))
        exact = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
    return exact, _cells(data).astype(np.uint32)


def inserted(fingerprint: str, paragraph: str) -> str:
    """The fingerprint of a text with one more paragraph (not the empty one before any other)."""
    return _changed(fingerprint, paragraph, 1)


def deleted(fingerprint: str, paragraph: str) -> str:
    return _changed(fingerprint, paragraph, -1)


def _changed(fingerprint: str, paragraph: str, sign: int) -> str:
    exact, cells = read(fingerprint)
    more = np.frombuffer(hashlib.shake_128(paragraph.encode("utf-8", "surrogatepass")).digest(8 * EXACT), "<u8")
    runs = _cells(paragraph.encode("utf-8", "surrogatepass")).astype(np.uint32)
    return written(exact + more, cells + runs) if sign > 0 else written(exact - more, cells - runs)


def written(exact: np.ndarray, cells: np.ndarray) -> str:
    return exact.astype("<u8").tobytes().hex() + cells.astype("<u4").tobytes().hex()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    data = bytes.fromhex(fingerprint)
    return np.frombuffer(data[: 8 * EXACT], "<u8").astype(np.uint64), np.frombuffer(data[8 * EXACT :], "<u4").astype(np.uint32)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal fingerprints, else the cosine of the signed counts, at least 0; a text without words is like none."""
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = (v[1].astype(np.uint32).view(np.int32).astype(np.float64) for v in (a, b))
    size = np.sqrt((x @ x) * (y @ y))
    return round(float(min(1.0, max(0.0, x @ y / size))), 6) if size else 0.0


def edited(text: str, following: str) -> str:
    """The text whose last quarter is the first as many code points of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


#: What is held between the passes: digest and both fingerprints of a row are packed, as in hex they take several times the room.
HELD = "doc_id long, n_chars long, packed binary, near_edited double, near_next double"


def _planes(fingerprint: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The exact sums, then the counts with the sign in the lowest bit and bytes of one weight side by side."""
    exact, cells = fingerprint
    c = cells.astype(np.uint32).view(np.int32)
    zigzag = ((c << 1) ^ (c >> 31)).astype("<i4")
    return exact.astype("<u8").tobytes() + zigzag.view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    zigzag = np.ascontiguousarray(np.frombuffer(data[8 * EXACT :], np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.frombuffer(data[: 8 * EXACT], "<u8"), (zigzag >> np.uint32(1)) ^ (np.uint32(0) - (zigzag & np.uint32(1)))


def packed(digest: bytes, own, changed) -> bytes:
    return zlib.compress(digest + _planes(own) + _planes(changed))


def unpacked(data: bytes) -> tuple[str, str, str]:
    """Hex digest and both fingerprints as written."""
    data = zlib.decompress(data)
    half = 32 + (len(data) - 32) // 2
    return data[:32].hex(), written(*_from_planes(data[32:half])), written(*_from_planes(data[half:]))


def _result(doc_id, text: str, own, following: str, other) -> dict:
    new = edited(text, following)
    changed = own if new == text else vector(new)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).digest()
    return {"doc_id": doc_id, "n_chars": len(text), "packed": packed(digest, own, changed), "near_edited": likeness(own, changed), "near_next": likeness(own, other)}


def _typed(rows: list[dict], more: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in HELD.split(", ")] + more, dtype=object)
    return out.astype({"doc_id": "Int64", "n_chars": "Int64", "near_edited": "float64", "near_next": "float64", **{c: "Int64" for c in more if c == "_part"}})


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of all rows but the last of a partition; that row and the partition's first text are handed on."""
    before, part = None, None
    for batch in batches:
        rows = []
        for doc_id, text, part in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["_part"]):
            doc_id, text = None if doc_id is pd.NA else int(doc_id), text or ""
            own = vector(text)
            if before is None:
                rows.append({"_part": int(part), "_head": text})
            else:
                rows.append(_result(*before, text, own))
            before = (doc_id, text, own)
        yield _typed(rows, ["_part", "_head", "_tail"])
    if before is not None:
        yield _typed([{"doc_id": before[0], "_part": int(part), "_tail": before[1]}], ["_part", "_head", "_tail"])


def _closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [_result(None if d is pd.NA else int(d), t, vector(t), h, vector(h)) for d, t, h in zip(batch["doc_id"].astype("Int64"), batch["_tail"], batch["_head"])]
        yield _typed(rows, [])


def report(docs: DataFrame) -> DataFrame:
    """One row of fingerprints per document, its edited text and its likeness to both that and the next document.

    Documents are range-sorted by id (null ids last, equal ids by text), so each task sees most rows beside their next;
    one open row per partition is joined with the first text of the next partition with rows, the last with the first.
    Texts are shuffled once and pass in batches; what is checkpointed holds fingerprints packed. Null texts count as empty; repeated rows follow one another; an empty
    table gives no rows; a single row is next to itself. Other columns are not read.
    """
    text_batches(docs.sparkSession)
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("_key"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("_part"))
    found = cut_lineage(rows.mapInPandas(_neighbours, HELD + ", _part long, _head string, _tail string"))
    heads = found.where("_head is not null").select("_part", "_head")
    parts = heads.select("_part").withColumn("_next", F.lead("_part").over(Window.orderBy("_part")))  # one row per partition
    first = heads.agg(F.min("_part").alias("_least"))
    parts = parts.join(F.broadcast(first), F.lit(True)).select("_part", F.coalesce("_next", "_least").alias("_next"))
    tails = found.where("_tail is not null").select("doc_id", "_part", "_tail").join(parts, "_part")
    open_rows = tails.join(heads.withColumnRenamed("_part", "_next"), "_next").select("doc_id", "_tail", "_head")
    done = found.where("_part is null").drop("_part", "_head", "_tail")
    whole = done.unionByName(open_rows.mapInPandas(_closed, HELD))

    @F.pandas_udf("edited_sha256 string, fingerprint string, edited_fingerprint string")
    def opened(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unpacked(d) for d in data], columns=["edited_sha256", "fingerprint", "edited_fingerprint"])

    return whole.withColumn("_x", opened("packed")).select("doc_id", "n_chars", "_x.*", "near_edited", "near_next")
