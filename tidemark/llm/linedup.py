"""Line dedup: repeated runs of lines found by prefix doubling over line ids, later copies deleted. SQL functions only.

A text is its sequence of line ids. Doubling names the run of 2**k lines from each line by the pair of names of its
halves; equal names are equal runs, so suffixes that share a prefix share a name and form an interval of the suffix
array. A name is a hash of content, not a rank, so that doubling needs no exchange between documents. Suffixes are told apart as deep
as ``words`` words reach: that prefix decides whether a suffix starts a repeated run, and the union of such prefixes
over a run, with the mirrored suffix at its end, is the maximal run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, text_key

#: Words of the shortest repeated run that is deleted.
WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, _key, line, _id, _words`` for each line with words of the different documents."""
    ids = F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("_id"), F.regexp_count(x, F.lit(WORD)).cast("int").alias("_words")))
    each = docs.select("doc_id", text_key().alias("_key"), ids.alias("_ids")).where("_ids is not null").dropDuplicates(["doc_id", "_key"])
    return each.select("doc_id", "_key", F.posexplode("_ids").alias("line", "_x")).select("doc_id", "_key", "line", "_x.*").where("_words > 0")


def _doubled(lines: DataFrame, words: int) -> tuple[DataFrame, int]:
    """Adds ``_from{k}`` and ``_to{k}``, the names of the 2**k lines from and up to each line, while such runs can be needed."""
    order = Window.partitionBy("doc_id", "_key").orderBy("line")
    out, k = lines.withColumn("_from0", F.col("_id")), 0
    while 2 ** (k + 1) <= words:
        out = out.withColumn("_half", F.lead(f"_from{k}", 2**k).over(order))
        out = out.withColumn(f"_from{k + 1}", F.when(F.col("_half").isNotNull(), F.xxhash64(f"_from{k}", "_half"))).drop("_half")
        k += 1
    return out.withColumns({f"_to{j}": F.lag(f"_from{j}", 2**j - 1).over(order) if j else F.col("_from0") for j in range(k + 1)}), k


def _named(count: Column, first: list[Column], last: list[Column]) -> Column:
    """A run of ``count`` lines is named by its first and its last 2**k lines, which together cover it."""
    name, check = None, None
    for k, (a, b) in enumerate(zip(first, last)):
        fits = count >= 2**k
        name = F.xxhash64(count, a, b) if name is None else F.when(fits, F.xxhash64(count, a, b)).otherwise(name)
        check = F.hash(a, b, count) if check is None else F.when(fits, F.hash(a, b, count)).otherwise(check)
    return F.struct(name.alias("_name"), check.alias("_check"))


def runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, _key, _a, _z, _name, _check, _side``: from each line the fewest lines with ``words`` words, and up to each line."""
    doc = Window.partitionBy("doc_id", "_key")
    lines = _lines(docs).withColumn("_upto", F.sum("_words").over(doc.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("_before", F.col("_upto") - F.col("_words"))
    rows, k = _doubled(lines, words)
    ahead = doc.orderBy("_before").rangeBetween(0, words - 1)
    back = doc.orderBy("_upto").rangeBetween(-(words - 1), 0)
    levels = range(k + 1)
    whole = doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(ahead), "_end": F.last("line").over(ahead), "_all": F.max("_upto").over(whole)} | {f"_e{j}": F.last(f"_to{j}").over(ahead) for j in levels})
    rows = rows.withColumns({"_m": F.count(F.lit(1)).over(back), "_start": F.first("line").over(back)} | {f"_s{j}": F.first(f"_from{j}").over(back) for j in levels})
    forward = F.struct(F.lit(0).alias("_side"), F.col("line").alias("_a"), F.col("_end").alias("_z"), _named(F.col("_n"), [F.col(f"_from{j}") for j in levels], [F.col(f"_e{j}") for j in levels]).alias("_x"))
    backward = F.struct(F.lit(1).alias("_side"), F.col("_start").alias("_a"), F.col("line").alias("_z"), _named(F.col("_m"), [F.col(f"_s{j}") for j in levels], [F.col(f"_to{j}") for j in levels]).alias("_x"))
    both = F.array(F.when(F.col("_all") >= F.col("_before") + words, forward), F.when(F.col("_upto") >= words, backward))
    return rows.select("doc_id", "_key", F.explode(both).alias("_r")).where("_r is not null").select("doc_id", "_key", "_r._side", "_r._a", "_r._z", "_r._x.*")


def later_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, _key, _lines``: the lines of each document that belong to a run which occurs before.

    First comes the least document id (null last), then the least text name, then the least line.
    """
    found = runs(docs, words)
    place = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_key", "_a")
    first = found.groupBy("_side", "_name", "_check").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    later = found.join(first, ["_side", "_name", "_check"]).where(place > F.col("_first"))
    return later.groupBy("doc_id", "_key").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("_a", "_z")))).alias("_lines"))


def _changed(docs: DataFrame, words: int) -> DataFrame:
    """``_row, _text, _removed`` for every row: the row as it was, its text as it is left, the lines that go."""
    gone = later_copies(docs, words).select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "_lines")
    named = boxed(docs).withColumn("_key", text_key("_row.text"))
    found = named.join(gone, F.col("_row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    kept = F.array_join(F.filter(F.split("_row.text", "\n"), lambda x, i: ~F.array_contains("_lines", i)), "\n")
    text = F.when(F.col("_lines").isNull(), F.col("_row.text")).otherwise(kept)
    removed = F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long")
    return found.select("_row", text.alias("_text"), removed.alias("_removed"))


def deduplicated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs``, all rows and columns, without the later copies of repeated line runs in ``text``.

    A run counts from ``words`` words on, blank lines aside; blank lines inside a deleted run go with it. A text of
    which nothing is left is empty; null texts stay null; ``n_chars``, where there is one, follows a changed text. Rows
    that repeat both id and text are one document and are changed alike. An empty table gives no rows.
    """
    row = F.col("_row").withField("text", F.col("_text"))
    if "n_chars" in docs.columns:
        n = F.when(F.col("_removed") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
        row = row.withField("n_chars", n)
    return _changed(docs, words).select(row.alias("_row")).select("_row.*")


def report(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` per row, with the text as it is left."""
    n = F.when(F.col("_row.text").isNull(), F.lit(0)).otherwise(F.size(F.split("_row.text", "\n"))).cast("long")
    out = _changed(docs.select("doc_id", "text"), words)
    return out.select("_row.doc_id", n.alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_text").alias("text"))
