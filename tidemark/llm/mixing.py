"""Mixing sources to target weights: hash-random order, prefix sums within each source, a cut at the exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, text_key
from tidemark.session import cut_lineage

#: Weights of the sources in the order of their names, repeating; share of all words; most epochs.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
#: Rows that one block of a source's random order holds on average.
BLOCK_ROWS = 2_000
#: Rows of a table of blocks that a join may broadcast (some 100 bytes each); above it both sides are shuffled.
BROADCAST_BLOCKS = 50_000


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, source, _name, size`` and columns ``more``: one row for each document; a null text has size 0."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", text_key().alias("_name"), size.alias("size"), *more)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, target`` from one row per source.

    Sources in the order of their names (null last) weigh ``weights``, repeating. They share ``share`` of all words;
    a target stops at ``epochs`` times its source's size, and the excess goes to the others by weight until none is
    above. That fixed point is a water level: with the sources ordered by limit per weight, the first whose share of
    what is left stays within its limit sets the level for itself and all after it. The windows run over the sources,
    not the documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", weight).withColumn("_limit", F.lit(epochs) * F.col("source_size"))
    by_limit = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = F.sum("_limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumns(
        {
            "_all": F.sum("source_size").over(everything),
            "_before": F.coalesce(before, F.lit(0)),
            "_weights": F.sum("_w").over(by_limit.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    s = s.withColumn("_level", (F.lit(share) * F.col("_all") - F.col("_before")) / F.col("_weights"))
    s = s.withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_limit"))
    level = F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("_water", level)
    target = F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_water") * F.col("_w"), F.col("_limit").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def _drawn(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with the MD5 of their id and the seed, which is their place in their source's order."""
    return rows.withColumn("_draw", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed)))))


def _in_blocks(rows: DataFrame, plan: DataFrame, block_rows: int) -> DataFrame:
    """Rows with the size and target of their source and their block of its order."""
    keyed = rows.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    blocks = F.floor(F.col("_rows") / F.lit(block_rows)) + 1
    top = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long")
    return keyed.withColumn("_block", F.floor(top * blocks / F.lit(1 << 32)))


def _planned(docs: DataFrame, weights, share: float, epochs: int, seed: int, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Small rows in blocks; ``source, source_size, target, _rows`` of each source; ``_s, _b, _start, _sum`` of each block: words before and in it."""
    rows = cut_lineage(_drawn(sized(docs), seed))
    per_source = cut_lineage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")))
    goals = targets(per_source.select("source", "source_size"), weights, share, epochs)
    plan = cut_lineage(goals.join(per_source.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    keyed = _in_blocks(rows, plan, block_rows)
    sums = keyed.groupBy("source", "_block").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"), "_sum")
    return keyed, plan, starts


def _started(keyed: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows with ``_whole`` epochs of their source and ``_left``, the words of the last epoch that are left for their block."""
    keyed = keyed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))).drop("_s", "_b")
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    return keyed.withColumn("_whole", whole).withColumn("_left", words - F.col("_whole") * F.col("source_size") - F.col("_start"))


def _taken(left: Column) -> Column:
    """Words taken of a row for whose last epoch so many are left."""
    return (F.col("_whole") * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))).cast("long")


def _words_before() -> Column:
    """Words of the rows before each one in its block."""
    inside = Window.partitionBy("source", "_block").orderBy("_draw", "doc_id", "size", "_name").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("size").over(inside), F.lit(0))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, _name, source, size, source_size, target, taken`` for every row of ``docs``.

    A document's key is the MD5 of its id and the seed, so a rerun draws the same order. The top bits of the key cut a
    source's order into blocks of about ``block_rows`` rows, whatever share of the rows it holds: block sums and their
    running total over blocks give each block its start, and a window inside the block gives each row the words before
    it. A source takes whole epochs while its target has room for one, then the first rows of its order up to the word
    that fills the target: the row at the cut gives only the words that are left. Rows that repeat an id follow one
    another; empty tables give no rows.
    """
    keyed, _, starts = _planned(docs, weights, share, epochs, seed, block_rows)
    taken = _taken(F.col("_left") - _words_before())
    return _started(keyed, starts).select("doc_id", "_name", "source", "size", "source_size", "target", taken.alias("taken"))


def _few(table: DataFrame) -> DataFrame:
    """A table for a join with whole documents, which stay where they are while it has few rows."""
    table = cut_lineage(table)
    return F.broadcast(table) if table.count() <= BROADCAST_BLOCKS else table


def _decided(docs: DataFrame, weights, share: float, epochs: int, seed: int, block_rows: int) -> DataFrame:
    """``_row, size, source_size, target, taken, mix``: whole rows and what :func:`mix` decides about each, see :func:`mixture`.

    A block takes all of its rows or none but where a source's order is cut, so only the rows of these blocks, about
    ``block_rows`` for each source, are shuffled and ordered; the others find their block in a small table.
    """
    _, plan, starts = _planned(docs, weights, share, epochs, seed, block_rows)
    whole = _drawn(sized(boxed(docs).select("_row", "_row.doc_id", "_row.source", "_row.text"), "_row"), seed)
    rows = _started(_in_blocks(whole, _few(plan), block_rows), _few(starts))
    cut = (F.col("_left") > 0) & (F.col("_left") < F.col("_sum"))
    kept = ["_row", "size", "source_size", "target"]
    uncut = rows.where(~cut).select(*kept, _taken(F.when(F.col("_left") > 0, F.col("size")).otherwise(F.lit(0))).alias("taken"))
    rows = uncut.unionByName(rows.where(cut).select(*kept, _taken(F.col("_left") - _words_before()).alias("taken")))

    def copy(epoch: Column) -> Column:
        taken = F.least(F.col("size"), F.col("taken") - (epoch - 1) * F.col("size"))
        head = F.array_join(F.slice(F.regexp_extract_all("_row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), 1, taken.cast("int")), "")
        text = F.when(taken < F.col("size"), head).otherwise(F.col("_row.text"))
        parts = [epoch.alias("epoch"), taken.alias("taken"), text.alias("text")]
        if "n_chars" in docs.columns:
            parts.append(F.when(taken < F.col("size"), F.length(text)).otherwise(F.col("_row.n_chars")).alias("n_chars"))
        return F.struct(*parts)

    last = F.ceil(F.try_divide(F.col("taken"), F.col("size"))).cast("int")
    return rows.withColumn("mix", F.transform(F.when(F.col("taken") > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), copy))


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row of ``docs``, all columns, with ``size, source_size, target, taken`` and ``mix``, the texts that the mix takes of it.

    ``mix`` has a struct ``epoch, taken, text`` (and ``n_chars`` where ``docs`` has it) for each epoch, counted from 1;
    it is empty where nothing is taken. Columns of ``docs`` with one of these names are left out.
    """
    added = ("size", "source_size", "target", "taken", "mix")
    own = [F.col(f"_row.`{c.replace('`', '``')}`") for c in docs.columns if c not in added]
    return _decided(docs, weights, share, epochs, seed, block_rows).select(*own, *added)


def unrolled(rows: DataFrame) -> DataFrame:
    """A row for each epoch of ``_row, target, mix``: the columns of ``_row``, its text as it is taken, with ``epoch, taken, target``."""
    each = rows.select("_row", "target", F.explode("mix").alias("_copy"))
    columns = [c for c in rows.schema["_row"].dataType.names if c not in ("epoch", "taken", "target")]
    own = [F.col(f"_copy.{c}") if c in ("text", "n_chars") else F.col(f"_row.`{c.replace('`', '``')}`") for c in columns]
    return each.select(*own, "_copy.epoch", "_copy.taken", "target")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The training mix: rows of ``docs`` that :func:`mix` takes, all columns, with ``epoch, taken, target`` beside them.

    A row comes once for each epoch, counted from 1; the text of the last epoch ends with the last word taken, and
    ``taken`` is the words of this row's text. An ``n_chars`` column follows a text that is cut. Repeated rows are
    each a document; documents of which nothing is taken, and so those without words, are not in the mix.
    """
    return unrolled(_decided(docs, weights, share, epochs, seed, block_rows).select("_row", "target", "mix"))


def report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
