"""Benchmark decontamination with one Aho-Corasick automaton over the normalised benchmark items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import boxed, text_batches

#: Words of one window.
WINDOW = 10
#: Characters of normalised items in one automaton (some 100 MB with its states); a larger benchmark is scanned in blocks.
BLOCK_CHARS = 2_000_000
#: A-Z become a-z, and every other ASCII character that is no digit or letter a space; bytes above x7F are kept.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words in a text as it is, before A-Z are lowered.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split(b" ") if text else []


def normalised(text: str | None) -> tuple[str, int]:
    """The words between single spaces, one character per UTF-8 byte, with a space at both ends; their number."""
    words = [w for w in normal_words(text) if w]
    return (f" {b' '.join(words).decode('latin-1')} " if words else ""), len(words)


def windows(text: str | None, size: int = WINDOW) -> Iterator[str]:
    """Every ``size`` consecutive words of an item, or all if it has fewer."""
    words = normalised(text)[0].split(" ")[1:-1]
    for i in range(max(1, len(words) - size + 1) if words else 0):
        yield f" {' '.join(words[i : i + size])} "


class Scanner:
    """The automaton over the windows of a block of items; built once in each Python worker."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        self.owners: dict[str, set[str]] = {}
        for item, text in items:
            for w in windows(text, size):
                self.owners.setdefault(w, set()).add(item or "")
        self.automaton = ahocorasick.Automaton()
        for w, owners in self.owners.items():
            self.automaton.add_word(w, (len(w), owners))
        if self.owners:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[list[int]], list[str]]:
        """Number of words, hit spans as ``[first word, last word + 1]``, and items, over the whole text."""
        line, n = normalised(text)
        if not n or not self.owners:
            return n, [], []
        found = list(self.automaton.iter(line))
        if not found:
            return n, [], []
        ends = np.array([end + 1 for end, _ in found])
        sizes = np.array([size for _, (size, _) in found])
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        first, last = np.searchsorted(spaces, ends - sizes), np.searchsorted(spaces, ends - 1)
        spans: list[list[int]] = []
        for a, b in sorted(zip(first.tolist(), last.tolist())):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        return n, spans, sorted(set().union(*(owners for _, (_, owners) in found)))


def original_offsets(text: str, spans: list[list[int]]) -> list[list[int]]:
    """Word spans as code point offsets of the text itself."""
    at = [m.span() for m in WORD.finditer(text)]
    return [[at[a][0], at[b - 1][1]] for a, b in spans]


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(list, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of at most ``limit`` characters (a longer item alone), read partition by partition."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    block, held = [], 0
    for item, text in rows.toLocalIterator(prefetchPartitions=True):
        if block and held + len(text) > limit:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += len(text)
    yield block


SCANNED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("words", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)


def scanned(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a struct ``_scan`` of ``n_words``, hit word spans, item ids and the spans' offsets in the text.

    One automaton holds the windows of all items while these have at most ``block_chars`` characters, and a row is
    scanned once. A larger benchmark comes in blocks, each broadcast and scanned in turn, and what the blocks find
    in a row is merged; no row is shuffled either way. A null text has no words; a null item id counts as ``''``;
    repeated items count once.
    """
    spark = docs.sparkSession
    text_batches(spark)
    out, parts = docs, []
    for k, block in enumerate(_blocks(benchmark, block_chars)):
        out = out.withColumn(f"_scan{k}", _scan(spark.sparkContext.broadcast((block, size)))(F.col("text").cast("string")))
        parts.append(f"_scan{k}")
    if len(parts) == 1:
        return out.withColumnRenamed(parts[0], "_scan")
    return out.withColumn("_scan", _merge()(*parts)).drop(*parts)


def _scan(items):
    held: dict[int, Scanner] = {}

    @F.pandas_udf(SCANNED)
    def scan(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held[0] = Scanner(*items.value)
        rows = []
        for text in texts:
            n, spans, found = held[0].scan(text)
            rows.append((n, spans, found, original_offsets(text, spans) if spans else []))
        return pd.DataFrame(rows, columns=SCANNED.fieldNames())

    return scan


def _merge():
    @F.pandas_udf(SCANNED)
    def merge(*found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in zip(*(f.itertuples(index=False) for f in found)):
            words, spans = _merged([s for r in row for s in r.words]), _merged([s for r in row for s in r.spans])
            rows.append((row[0].n_words, words, sorted({i for r in row for i in r.items}), spans))
        return pd.DataFrame(rows, columns=SCANNED.fieldNames())

    return merge


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans`` (offsets in the text)."""
    found = scanned(docs.select("doc_id", "text"), benchmark, size)
    hit = F.aggregate("_scan.words", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return found.select(
        "doc_id",
        F.col("_scan.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_scan.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_scan.items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.col("_scan.items").alias("items"),
        F.col("_scan.spans").alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of the benchmark."""
    found = scanned(boxed(docs).select("_row", "_row.text"), benchmark, size)
    return found.where(F.size("_scan.items") == 0).select("_row.*")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
