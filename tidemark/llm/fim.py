"""Fill-in-middle: texts cut at token boundaries that a learned rank index finds, and put together in another order.

The boundaries of a text's tokens (code point offsets, rank 0 to n) are fitted by straight segments whose error is
bounded, and every rank's residual against its segment is kept in one byte. A cut is the segment's prediction at its
rank plus that residual, so it is exact; new cuts need the index alone, not the text. The index is a column beside its
row: nothing is shuffled, and the pieces are taken and joined by SQL functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, text_batches

#: The marks of prefix, suffix and middle; percent of texts left plain, and of the others that start with the suffix.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Largest distance of a boundary from its segment; with the rounding of a prediction a residual fits one byte.
ERROR = 100
#: Code points whose boundaries are looked for at once.
CHUNK = 1 << 20
INDEX = "n long, ranks array<int>, starts array<long>, slopes array<double>, residuals binary"


def boundaries(text: str) -> np.ndarray:
    """Offsets of all boundaries of the tokens ``[A-Za-z]+|[^A-Za-z]``, the end of the text included."""
    found, before = [], False
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        lower = points | 32
        letter = (lower >= 97) & (lower <= 122)
        inside = letter.copy()  # a letter that goes on with the token of the letter before it
        inside[1:] &= letter[:-1]
        inside[0] &= before
        found.append(np.flatnonzero(~inside) + at)
        before = bool(letter[-1])
    return np.concatenate([*found, [len(text)]]).astype(np.int64)


def fitted(offsets: np.ndarray, error: int = ERROR) -> tuple[list[int], list[int], list[float]]:
    """First rank, first offset and slope of each segment: the longest from its start within ``error`` of every boundary.

    A segment starts at its first boundary; each further one narrows the cone of slopes that pass it within the
    error, and the first that would close the cone starts the next segment.
    """
    ranks, starts, slopes = [], [], []
    at, n = 0, len(offsets)
    while at < n:
        low, high, size, reach = 0.0, np.inf, 256, at + 1
        while reach < n:
            far = min(n, reach + size)
            run = np.arange(reach - at, far - at, dtype=np.float64)
            rise = (offsets[reach:far] - offsets[at]).astype(np.float64)
            lows = np.maximum.accumulate(np.maximum((rise - error) / run, low))
            highs = np.minimum.accumulate(np.minimum((rise + error) / run, high))
            closed = lows > highs
            stop = int(closed.argmax()) if closed.any() else len(run)
            if stop:
                low, high = lows[stop - 1], highs[stop - 1]
            reach += stop
            if stop < len(run):
                break
            size *= 2
        ranks.append(at)
        starts.append(int(offsets[at]))
        slopes.append(float((low + high) / 2) if reach > at + 1 else 0.0)
        at = reach
    return ranks, starts, slopes


def predicted(ranks, starts, slopes, rank) -> np.ndarray:
    """What the segments say of the boundaries at the ranks, before correction."""
    ranks, rank = np.asarray(ranks), np.asarray(rank)
    s = np.searchsorted(ranks, rank, side="right") - 1
    return np.asarray(starts)[s] + np.rint(np.asarray(slopes)[s] * (rank - ranks[s])).astype(np.int64)


def index_of(text: str | None, error: int = ERROR) -> tuple[int, list[int], list[int], list[float], bytes]:
    """The rank index of one text: number of tokens, segments, one residual byte for each boundary."""
    offsets = boundaries(text or "")
    ranks, starts, slopes = fitted(offsets, error)
    residuals = offsets - predicted(ranks, starts, slopes, np.arange(len(offsets)))
    return len(offsets) - 1, ranks, starts, slopes, residuals.astype(np.int8).tobytes()


def located(ranks, starts, slopes, residuals: bytes, rank) -> np.ndarray:
    """Exact offsets of the boundaries at the ranks, from the index alone."""
    return predicted(ranks, starts, slopes, rank) + np.frombuffer(residuals, np.int8)[np.asarray(rank)]


def indexed(docs: DataFrame, text: str = "text", error: int = ERROR) -> Column:
    """The rank index of a text column as a struct; ``error`` of 1 to 126 code points."""
    if not 1 <= error <= 126:
        raise ValueError("residuals are kept in one byte: error must be 1 to 126")
    text_batches(docs.sparkSession)

    @F.pandas_udf(INDEX)
    def build(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([index_of(t, error) for t in texts], columns=["n", "ranks", "starts", "slopes", "residuals"])

    return build(F.col(text))


def cuts(index: Column, first: Column, second: Column) -> Column:
    """``first, second``: the exact offsets of two ranks (0 to ``n``), from the index alone."""

    @F.pandas_udf("first long, second long")
    def cut(index: pd.DataFrame, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        rows = zip(index["ranks"], index["starts"], index["slopes"], index["residuals"], first, second)
        return pd.DataFrame([located(a, b, c, d, [i, j]) for a, b, c, d, i, j in rows], columns=["first", "second"])

    return cut(index, first, second)


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form: texts that hold a mark are plain, so each mark stands once."""
    body = F.substring(output, len(PREFIX) + 1, 2_147_483_647)
    one = F.split_part(body, F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.lit(1))
    rest = F.split_part(body, F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.lit(2))
    two, three = F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def _rows(docs: DataFrame, seed: int, plain_percent: int, spm_percent: int, error: int) -> DataFrame:
    """``_row, _index, _form, _cut, _output`` for every row."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("null"))), 256)
    rows = boxed(docs).withColumns({"_text": F.coalesce("_row.text", F.lit("")), "_draw": draw})
    h = [F.conv(F.substring("_draw", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE)
    plain = (F.col("_text") == "") | marked | (h[2] % 100 >= 100 - plain_percent)
    rows = rows.withColumn("_form", F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm"))
    rows = rows.withColumn("_index", indexed(rows, "_text", error))
    units = F.col("_index.n") + 1
    one, two = F.pmod(h[0], units), F.pmod(h[1], units)
    rows = rows.withColumn("_cut", cuts(F.col("_index"), F.least(one, two), F.greatest(one, two)))
    first, second = F.col("_cut.first").cast("int"), F.col("_cut.second").cast("int")
    head, middle = F.substring("_text", F.lit(1), first), F.substring("_text", first + 1, second - first)
    tail = F.substring("_text", second + 1, F.length("_text"))
    psm, spm = F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), middle)
    return rows.withColumn("_output", F.when(F.col("_form") == "plain", F.col("_text")).when(F.col("_form") == "psm", psm).otherwise(spm))


def transformed(docs: DataFrame, seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, error: int = ERROR) -> DataFrame:
    """``docs``, all rows and columns under ``row``, with ``form, output, cut`` (two offsets, null if plain) and the rank ``index``.

    Both cuts are token boundaries drawn by a hash of id and seed, so a rerun and repeated rows agree. A null text
    counts as empty and is plain, as are texts that hold a mark; a null id is drawn as the word ``null``. A text of
    one token, or of any length, is cut like others; columns of any name stay inside ``row``; an empty table gives no rows.
    """
    cut = F.when(F.col("_form") != "plain", F.col("_cut"))
    return _rows(docs, seed, plain_percent, spm_percent, error).select(
        F.col("_row").alias("row"), F.col("_form").alias("form"), F.col("_output").alias("output"), cut.alias("cut"), F.col("_index").alias("index")
    )


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` per row; other columns are dropped."""
    rows = _rows(docs.select("doc_id", "text"), 1, PLAIN_PERCENT, SPM_PERCENT, ERROR)
    cut = lambda c: F.when(F.col("_form") != "plain", c)
    return rows.select(
        "_row.doc_id",
        F.col("_index.n").alias("n"),
        F.col("_form").alias("form"),
        cut(F.col("_cut.first")).alias("prefix_chars"),
        cut(F.col("_cut.second") - F.col("_cut.first")).alias("middle_chars"),
        F.sha2("_output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("_output"), F.col("_form")), 256).alias("restored_sha256"),
    )
