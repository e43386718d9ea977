"""Language identification by rank-order profiles of character n-grams and the out-of-place distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_batches

#: N-grams of one to three letters (a space marks word edges); entries of a language's and of a document's profile.
ORDERS, LENGTH = (1, 2, 3), 400
UNKNOWN = "und"
_letters = np.full(0x110000, 0xFFFFFF, np.int64)


def _folded(text: str) -> np.ndarray:
    """Lower-case letters as code points; every run of other characters is one space, also at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _letters[points]
    if (new := out == 0xFFFFFF).any():
        for p in np.unique(points[new]):
            _letters[p] = ord(chr(p).lower()[0]) if chr(p).isalpha() else 32
        out = _letters[points]
    out = np.concatenate(([32], out, [32]))
    return out[np.concatenate(([True], (out[1:] != 32) | (out[:-1] != 32)))]


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text as integers (21 bits for each character) and how often each occurs."""
    s = _folded(text)
    if len(s) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = []
    for n in ORDERS:
        g = np.zeros(max(0, len(s) - n + 1), np.int64)
        for k in range(n):
            g = g << 21 | s[k : len(s) - n + 1 + k]
        grams.append(g[g != 32])
    return np.unique(np.concatenate(grams), return_counts=True)


def profiles(training: DataFrame) -> dict[str, np.ndarray]:
    """The ``LENGTH`` most frequent n-grams of each language over all ``lang, text`` of ``training``, ties by n-gram.

    Counts of a batch are added before they are shuffled; only the profiles, of fixed length, reach the driver.
    """
    text_batches(training.sparkSession)

    def count(batches):
        for batch in batches:
            for lang, rows in batch.groupby("lang", sort=False):
                grams, n = _counts("\n".join(rows["text"]))
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

    n = training.where("lang is not null and text is not null").select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
    n = n.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = n.withColumn("rank", rank).where(F.col("rank") <= LENGTH)
    out: dict[str, list[int]] = {}
    for lang, gram in best.orderBy("lang", "rank").select("lang", "gram").toLocalIterator():
        out.setdefault(lang, []).append(gram)
    return {k: np.array(v, np.int64) for k, v in out.items()}


def identified(text: str | None, names: list[str], grams: np.ndarray, ranks: np.ndarray) -> tuple[str, float]:
    """The language with the least out-of-place distance and one minus that distance as a share of the largest possible.

    ``grams`` are the n-grams of all profiles in order, ``ranks`` their rank in each language or ``LENGTH`` where absent.
    """
    found, n = _counts(text or "")
    if not len(found) or not names:
        return UNKNOWN, 0.0
    top = found[np.lexsort((found, -n))][:LENGTH]
    at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
    places = np.where((grams[at] == top)[:, None], ranks[at], LENGTH)
    apart = np.where(places == LENGTH, LENGTH, np.abs(places - np.arange(len(top))[:, None])).sum(axis=0)
    best = int(np.argmin(apart))
    return names[best], round(1.0 - float(apart[best]) / (LENGTH * len(top)), 6)


def predicted(docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score`` from the whole text; a null text or one without letters is ``und`` at 0.

    Ties go to the language that is first by name. Only the text is read for a prediction; no row is shuffled.
    """
    spark = docs.sparkSession
    text_batches(spark)
    names = sorted(learned)
    grams = np.unique(np.concatenate([learned[k] for k in names])) if names else np.zeros(0, np.int64)
    ranks = np.full((len(grams), len(names)), LENGTH)
    for j, k in enumerate(names):
        ranks[np.searchsorted(grams, learned[k]), j] = np.arange(len(learned[k]))
    held = spark.sparkContext.broadcast((names, grams, ranks))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([identified(t, *held.value) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("_p", predict(F.col(text).cast("string"))).withColumns({"lang_pred": F.col("_p.lang_pred"), "score": F.col("_p.score")}).drop("_p")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, learnt from the rows that are not held out.

    A row with a null id is not held out. Repeated rows are predicted alike; an empty table gives no rows.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    learned = profiles(rows.where(~F.col("held_out")).select("lang", "text"))
    return predicted(rows.select("doc_id", "text", "held_out"), learned).select("doc_id", "held_out", "lang_pred", "score")
