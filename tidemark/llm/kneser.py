"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, each code point a symbol of its own; a word that repeats the word before it is one
symbol. A gram is its last symbol and its context, the ``ORDER - 1`` symbols before it as one number in base V. Counts,
continuation counts, discounts, probabilities and back-off weights are Spark tables keyed (sharded) by language and
gram or context and joined on these keys. To score, texts are dealt to shards of bounded size; each shard's different
grams are joined with the tables and meet its texts again. Only tables of few grams are broadcast.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.llm.common import boxed, text_batches
from tidemark.session import cut_lineage

ORDER, V = 4, 0x110000
#: Stand before a text and for a repeated word.
BEGIN, AGAIN = 2, 3
BEGIN_CHAR, AGAIN_CHAR = chr(BEGIN), chr(AGAIN)
START = BEGIN_CHAR * (ORDER - 1)
REPEATED = re.compile(r"\b(\w++)((?:\s++\1\b)+)")
#: Share of trusted text that a threshold keeps, and symbols of average text that each text is judged with:
#: a text of a few words says little about its quality and is drawn towards the mean of its language.
QUANTILE, PRIOR = 0.99, 50.0
#: One in so many trusted texts (by hash, so that copies stay together) is not learnt from but sets means and thresholds.
HELD_OUT = 5
#: Scores below which a language has no threshold.
LEAST = 10
#: Steps per bit of the histogram from which quantiles are read.
STEPS = 256
#: Trusted ids that a join may broadcast (16 bytes each); above it both sides are shuffled.
BROADCAST_IDS = 2_000_000
#: Rows of a table of grams that a join may broadcast (some 40 bytes each); else the grams of the texts are shuffled to it.
BROADCAST_GRAMS = 50_000
#: Characters of a shard of texts to score and of a compressed pack of them, and what a row counts beside its text.
SHARD, PACK, ROW = 4_000_000, 500_000, 200
#: Symbols whose grams are made at once, some 100 bytes each: a worker's memory follows this and the different grams, not a shard's symbols.
RUN = 250_000


def plain(text: str | None) -> str:
    """The text with each repeat of a word as one symbol; control characters used as symbols become spaces."""
    text = (text or "").replace(BEGIN_CHAR, " ").replace(AGAIN_CHAR, " ")
    return REPEATED.sub(lambda m: m[1] + AGAIN_CHAR * len(m[2].split()), text)


def runs(texts: list[str], size: int) -> Iterator[tuple[str, list[int], list[int]]]:
    """The texts, already :func:`plain`, as strings of about ``size`` symbols for :func:`grams`; which texts are in each, and how many symbols of them.

    Each text or part stands behind the ``ORDER - 1`` symbols before it. Only longer texts are cut, always at the same
    places, so that equal texts have equal sums whatever stands beside them.
    """
    parts, which, own, held = [], [], [], 0
    for number, text in enumerate(texts):
        for at in range(0, len(text), size):
            part = text[at : at + size]
            if parts and held + len(part) > size:
                yield "".join(parts), which, own
                parts, which, own, held = [], [], [], 0
            parts.append((START + text[max(0, at - ORDER + 1) : at])[1 - ORDER :] + part)
            which.append(number)
            own.append(len(part))
            held += len(part)
    if parts:
        yield "".join(parts), which, own


def grams(run: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``context, symbol`` of the different grams of one of :func:`runs`, and which one each of its symbols ends."""
    points = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    context = np.zeros(max(0, len(points) - ORDER + 1), np.int64)
    for k in range(ORDER - 1):
        context = context * V + points[k : len(context) + k]
    symbol = points[ORDER - 1 :]
    own = symbol != BEGIN
    which, contexts = pd.factorize(context[own])
    at, pairs = pd.factorize(which * V + symbol[own])
    return contexts[pairs // V], pairs % V, at


def counted(packs: Iterable[list[str]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``context, symbol, n`` of the different grams of all packs of texts; runs add up as soon as they are as many as the sum before."""
    total, more, waiting = [np.zeros(0, np.int64)] * 3, [], 0

    def added():
        context, symbol, n = (np.concatenate(x) for x in zip(total, *more, strict=True))
        which, contexts = pd.factorize(context)
        at, pairs = pd.factorize(which * V + symbol)
        return [contexts[pairs // V], pairs % V, np.bincount(at, n, len(pairs)).astype(np.int64)]

    for texts in packs:
        for run, _, _ in runs(texts, size):
            context, symbol, at = grams(run)
            more.append([context, symbol, np.bincount(at, minlength=len(symbol))])
            waiting += len(symbol)
            if waiting >= max(size, len(total[0])):
                total, more, waiting = added(), [], 0
    return tuple(added())


@dataclass
class Model:
    """Grams ``seen`` and their ``contexts`` of all languages and orders (:func:`_counted`), ``sizes``: rows by order and language of both.

    A gram's probability is what it has of its own, its discounted count over the total, and the back-off weight times
    the probability of the shorter gram. Texts' grams are joined with all orders and add this up.
    """

    langs: list[str]
    seen: DataFrame | None = None
    contexts: DataFrame | None = None
    sizes: list[Row] = field(default_factory=list)
    means: dict[str, float] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    def only(self, langs: list[str]) -> Model:
        """The model of some of the languages."""
        own = F.col("lang").isin(langs)
        return Model(langs, self.seen.where(own), self.contexts.where(own), [r for r in self.sizes if r["lang"] in set(langs)])

    def tables(self) -> list[tuple[DataFrame, DataFrame]]:
        """For each order from 1 grams and contexts, those of few rows to be broadcast."""
        of = Counter()
        for r in self.sizes:
            of[r["order"], r["table"]] += r["n"]
        small = lambda table, *name: F.broadcast(table) if of[name] <= BROADCAST_GRAMS else table
        return [(small(seen, order, 0), small(contexts, order, 1)) for order, (seen, contexts) in enumerate(_by_order(self.seen, self.contexts), 1)]


def trusted_text(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, text`` of documents that some label calls good and none bad or toxic; rows without a language are out."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select("doc_id")
    good = cut_lineage(good)
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    return docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text").join(good, "doc_id", "left_semi")


def _by_language(batch: pd.DataFrame):
    for lang, rows in batch.groupby("lang", sort=False):
        yield lang, [plain(t) for t in rows["text"]]


def _gram_counts(trusted: DataFrame) -> DataFrame:
    """``lang, context, symbol, n`` over all trusted text; each batch and then each task adds up before the shuffle.

    Repeats are not learnt: one trusted text full of them would make them likely everywhere.
    """

    def count(batches):
        for batch in batches:
            for lang, texts in _by_language(batch):
                context, symbol, n = counted([texts], RUN)
                told = symbol != AGAIN
                for k in range(ORDER - 1):
                    told &= context // V**k % V != AGAIN
                yield pd.DataFrame({"lang": lang, "context": context[told], "symbol": symbol[told], "n": n[told]})

    counts = trusted.select("lang", "text").mapInPandas(count, "lang string, context long, symbol long, n long")
    return counts.groupBy("lang", "context", "symbol").agg(F.sum("n").alias("n"))


def _discount(n: Column) -> Column:
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def _discounts(counts: DataFrame) -> DataFrame:
    """``order, lang, d1, d2, d3`` from the counts of counts; a language too small to have them, or positive ones, discounts by a half."""
    c = counts.groupBy("order", "lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    whole = F.expr("least(n1, n2, n3) > 0")
    formula = lambda k, low, high: F.least(F.lit(float(k)), k - (k + 1) * y * F.try_divide(F.col(high), F.col(low)))
    bounded = lambda k, low, high: F.when(whole & (formula(k, low, high) > 0), formula(k, low, high)).otherwise(0.5)
    return c.select("order", "lang", bounded(1, "n1", "n2").alias("d1"), bounded(2, "n2", "n3").alias("d2"), bounded(3, "n3", "n4").alias("d3"))


def _counted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of all orders together: ``order, lang, context, symbol, n`` of the grams seen; ``order, lang, context, total, weight, d1, d2, d3`` of their contexts.

    Lower orders count the different grams that end in a gram instead of its occurrences. Each job costs the driver
    threads and blocks of broadcasts, so the orders pass each step in one job.
    """
    shorter, lower = counts, []
    for order in range(ORDER - 1, 0, -1):
        n = F.count_if(F.col("n") > 0)  # all of them; as n is read, each order's exchange is the one that the next order reads
        shorter = shorter.groupBy("lang", _shortened(order).alias("context"), "symbol").agg(n.alias("n"))
        lower.append(shorter.select(F.lit(order).alias("order"), "lang", "context", "symbol", "n"))
    seen = counts.select(F.lit(ORDER).alias("order"), "lang", "context", "symbol", "n").unionByName(cut_lineage(reduce(DataFrame.unionByName, lower)))
    c = seen.join(F.broadcast(_discounts(seen)), ["order", "lang"]).withColumn("d", F.least(_discount(F.col("n")), F.col("n")))
    weight = (F.sum("d") / F.sum("n")).alias("weight")
    return seen, cut_lineage(c.groupBy("order", "lang", "context").agg(F.sum("n").alias("total"), weight, *[F.first(x).alias(x) for x in ("d1", "d2", "d3")]))


def _shortened(order: int) -> Column:
    """The context of a gram of this order that ends a longer one."""
    return F.col("context") % V ** (order - 1)


def _by_order(seen: DataFrame, contexts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    return [tuple(table.where(F.col("order") == order).drop("order") for table in (seen, contexts)) for order in range(1, ORDER + 1)]


def probabilities(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1, from ``lang, gram, n``, each gram a number in base V: ``lang, context, symbol, p`` of the grams seen,
    and ``lang, context, weight`` to back off with.
    """
    tables = _by_order(*_counted(counts.select("lang", F.expr(f"gram div {V}").alias("context"), (F.col("gram") % V).alias("symbol"), "n")))
    of = lambda order, seen: _probability(seen.select("lang", "context", "symbol"), tables[:order]).select("lang", "context", "symbol", "p")
    return [(of(order, seen), contexts.select("lang", "context", "weight")) for order, (seen, contexts) in enumerate(tables, 1)]


def _fitted(learnt: DataFrame) -> Model:
    """The model of each language of ``learnt``, without means and thresholds."""
    both = _counted(cut_lineage(_gram_counts(learnt)))
    rows = [table.select("order", "lang", F.lit(k).alias("table")) for k, table in enumerate(both)]
    sizes = rows[0].unionByName(rows[1]).groupBy("order", "lang", "table").agg(F.count(F.lit(1)).alias("n")).collect()  # a few rows of each language
    return Model(sorted({r["lang"] for r in sizes}), *both, sizes)


def _probability(needed: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``needed`` (``lang, context, symbol`` of the last order of ``tables``, and more) with the probability ``p`` of each gram."""
    for order, (seen, contexts) in reversed(list(enumerate(tables, 1))):
        at = "context" if order == len(tables) else "_c"  # the grams come dealt by the whole context
        needed = needed if order == len(tables) else needed.withColumn("_c", _shortened(order))
        needed = needed.join(seen.select("lang", F.col("context").alias(at), "symbol", "n"), ["lang", at, "symbol"], "left")
        needed = needed.join(contexts.withColumnRenamed("context", at), ["lang", at], "left")
        own = (F.col("n") - F.least(_discount(F.col("n")), F.col("n"))) / F.col("total")
        needed = needed.withColumns({f"_own{order}": own, f"_w{order}": F.col("weight")}).drop("n", *contexts.columns[2:])
    p = F.lit(1.0 / V)
    for order in range(1, len(tables) + 1):
        p = F.coalesce(F.col(f"_own{order}"), F.lit(0.0)) + F.coalesce(F.col(f"_w{order}"), F.lit(1.0)) * p
    return needed.withColumn("p", p)


def _bound(rates: int, mean: float, deviation: float, quantile: float) -> float:
    """Upper bound of one more rate in the share ``quantile`` of cases, by Student's law."""
    z, v = NormalDist().inv_cdf(quantile), rates - 1
    t = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2)
    return mean + t * deviation * math.sqrt(1 + 1 / rates)


def train(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> Model:
    """The model of trusted text with each language's mean and threshold, in bits per symbol, from trusted text it has not seen.

    On the text that a model was made from perplexity is lower than on any other, so a threshold from there would
    reject clean documents. A language whose unseen texts are too few for the quantile (1 / (1 - quantile)) has all its
    trusted texts scored by cross-fitting. If these are still too few, the threshold is the bound of one more text, not
    below their maximum: a plain maximum of n would reject one clean text in n + 1. With under ``LEAST`` scores a
    language has no threshold and rejects nothing.
    """
    text_batches(docs.sparkSession)
    trusted = trusted_text(docs, labels).withColumn("_fold", F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)))
    texts = trusted.where("text <> ''").groupBy("lang").agg(F.count_if(F.col("_fold") > 0).alias("learnt"), F.count_if(F.col("_fold") == 0).alias("held")).collect()
    langs = sorted(r["lang"] for r in texts if r["learnt"])
    if not langs:
        return Model([])
    needed = math.ceil(round(1 / (1 - quantile), 6))
    small = F.col("lang").isin([r["lang"] for r in texts if r["learnt"] and r["held"] < needed])
    # each fold's models have the fold before the language in their name, longer than any language; one fit makes them all
    longest = max(len(r["lang"]) for r in texts)
    without = lambda k: F.concat(F.rpad(k.cast("string"), longest + 1, " "), "lang")
    names = [F.when(F.col("_fold") > 0, F.col("lang")), *[F.when(small & (F.col("_fold") != k), without(F.lit(k))) for k in range(1, HELD_OUT)]]
    fits = _fitted(trusted.select(F.explode(F.array_compact(F.array(*names))).alias("lang"), "text"))
    model = fits.only(langs)
    unseen_by = F.when(F.col("_fold") == 0, F.col("lang")).when(small, without(F.col("_fold")))
    scores = scored(boxed(trusted.select("doc_id", unseen_by.alias("lang"), "text").where("lang is not null")), fits).where("_symbols > 0")
    lang = F.when(F.length("_row.lang") > longest, F.substring("_row.lang", longest + 2, 1 << 30)).otherwise(F.col("_row.lang"))
    scores = cut_lineage(scores.select(lang.alias("lang"), "_bits", "_symbols"))
    model.means = {r["lang"]: r["mean"] for r in scores.groupBy("lang").agg((F.sum("_bits") / F.sum("_symbols")).alias("mean")).collect()}
    if not model.means:
        return model
    means = F.create_map(*[F.lit(x) for item in model.means.items() for x in item])
    rate = (F.col("_bits") + PRIOR * means[F.col("lang")]) / (F.col("_symbols") + PRIOR)
    rates = scores.select("lang", rate.alias("rate"))
    bins = rates.groupBy("lang", F.ceil(F.col("rate") * STEPS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang")
    share = F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)
    limits = bins.withColumn("share", share).where(F.col("share") >= quantile).groupBy("lang").agg((F.min("bin") / F.lit(float(STEPS))).alias("t"))
    limits = {r["lang"]: r["t"] for r in limits.collect()}
    for r in rates.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("deviation")).collect():
        if r["n"] >= needed:
            model.thresholds[r["lang"]] = limits[r["lang"]]
        elif r["n"] >= LEAST:
            model.thresholds[r["lang"]] = max(limits[r["lang"]], _bound(r["n"], r["mean"], r["deviation"], quantile))
    return model


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(shard: pa.Table) -> Iterator[tuple[str | None, list[str], pa.Table]]:
    """Language, texts made :func:`plain` and boxed rows of each pack of a shard."""
    for pack in shard.column("_pack"):
        rows = pa.ipc.open_stream(pack.as_buffer()).read_all()
        row = rows.column("_row").combine_chunks()
        yield row.field("lang")[0].as_py(), [plain(t) for t in row.field("text").to_pylist()], rows


def _known(found: pa.Table, name: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The bits of grams ``context, symbol`` by the model of this name."""
    found = found.filter(pa.compute.equal(found.column("lang"), name))
    context, symbol, bits = (found.column(c).to_numpy() for c in ("context", "symbol", "bits"))
    contexts = pd.Index(pd.unique(context))
    pairs = pd.Index(contexts.get_indexer(context) * V + symbol)

    def of(context, symbol):
        place = pairs.get_indexer(contexts.get_indexer(context) * V + symbol)
        if (place < 0).any():
            raise ValueError("a text changed between its counting and its scoring")
        return bits[place]

    return of


def _dealt(rows: DataFrame, models: int) -> DataFrame:
    """``_shard, _pack``: rows of one language in compressed packs, some of them a shard of about ``SHARD`` characters.

    A pack's shard follows from its content, so that a rerun deals alike and copies spread with the rows around them.
    Where there is no language, each gram is scored by all ``models`` and shards are smaller by that, down to a pack.
    """
    lang, text = F.col("_row.lang"), F.col("_row.text")
    sizes = rows.groupBy(lang.alias("lang")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)) + ROW).alias("size")).orderBy("lang")
    shards, first = {}, 0
    for r in sizes.collect():
        most = SHARD if r["lang"] is not None else max(PACK, SHARD / max(1, models))
        shards[r["lang"]] = first, math.ceil(r["size"] / most)
        first += shards[r["lang"]][1]

    def pack(batches):
        held: dict[str | None, list[pa.RecordBatch]] = {}
        size: dict[str | None, int] = {}

        def flushed(lang):
            content = _packed(pa.Table.from_batches(held.pop(lang)))
            del size[lang]
            start, count = shards[lang]
            shard = start + int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "big") % count
            return pa.RecordBatch.from_pydict({"_shard": pa.array([shard], pa.int64()), "_pack": pa.array([content], pa.binary())})

        for batch in batches:
            row = batch.column("_row")
            code, langs = pd.factorize(np.array(row.field("lang").to_pylist(), object), use_na_sentinel=False)
            weight = pa.compute.fill_null(pa.compute.utf8_length(row.field("text")), 0).to_numpy(zero_copy_only=False) + ROW
            for k, lang in enumerate(None if pd.isna(x) else x for x in langs):
                at = np.flatnonzero(code == k)
                held.setdefault(lang, []).append(batch.take(pa.array(at)))
                size[lang] = size.get(lang, 0) + int(weight[at].sum())
            for lang in [x for x in size if size[x] >= PACK or sum(size.values()) >= 16 * PACK]:
                yield flushed(lang)
        for lang in list(size):
            yield flushed(lang)

    return rows.select("_row").mapInArrow(pack, "_shard long, _pack binary")


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``_row, _model, _bits, _symbols`` of boxed rows: a text's language, or where it has none the model that fits best.

    A text of a language without a model has no score.
    """
    text_batches(rows.sparkSession)
    langs = model.langs
    known = set(langs)
    tried = lambda lang: langs if lang is None else [lang] if lang in known else []
    dealt = _dealt(rows, len(langs))

    def distinct(shard: pa.Table) -> pa.Table:
        lang = None

        def packs():
            nonlocal lang
            for lang, texts, _ in _unpacked(shard):  # noqa: B007
                yield texts

        context, symbol, _ = counted(packs(), RUN)
        names, number = tried(lang), shard.column("_shard")[0].as_py()
        columns = {"lang": np.repeat(np.array(names, object), len(symbol)), "context": np.tile(context, len(names)), "symbol": np.tile(symbol, len(names))}
        return pa.table({"lang": pa.array(columns["lang"], pa.string()), "context": columns["context"], "symbol": columns["symbol"], "_shard": np.full(len(symbol) * len(names), number)})

    def score(shard: pa.Table, found: pa.Table) -> pa.Table:
        names, known_grams, out = [], None, []
        for lang, texts, rows in _unpacked(shard):
            if known_grams is None:
                names = tried(lang)
                known_grams = [_known(found, name) for name in names]
            bits = np.zeros((len(names), len(texts)))
            for run, which, own in runs(texts, RUN):
                context, symbol, at = grams(run)
                firsts = np.cumsum([0, *own[:-1]])
                for k, known_bits in enumerate(known_grams):
                    bits[k, which] += np.add.reduceat(known_bits(context, symbol)[at], firsts)
            if names:
                best, least, sizes = np.array(names, object)[bits.argmin(axis=0)], bits.min(axis=0), np.array([len(t) for t in texts], np.int64)
            else:
                best, least, sizes = np.full(len(texts), None, object), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            out.append(pa.table({"_row": rows.column("_row"), "_model": pa.array(best, pa.string()), "_bits": least, "_symbols": sizes}))
        return pa.concat_tables(out)

    needed = dealt.groupBy("_shard").applyInArrow(distinct, "lang string, context long, symbol long, _shard long")
    needed = needed.groupBy("lang", "context", "symbol").agg(F.collect_list("_shard").alias("_shards"))
    bits = _probability(needed, model.tables()).select("lang", "context", "symbol", (-F.log2("p")).alias("bits"), F.explode("_shards").alias("_shard"))
    schema = StructType([rows.schema["_row"], StructField("_model", StringType()), StructField("_bits", DoubleType()), StructField("_symbols", LongType())])
    return dealt.groupBy("_shard").cogroup(bits.groupBy("_shard")).applyInArrow(score, schema)


def judged(rows: DataFrame, model: Model) -> DataFrame:
    """Boxed rows with ``_model, _perplexity, _threshold, _keep``.

    The perplexity includes ``PRIOR`` symbols of average text. Null and empty texts, those of a language without
    a model or scores, and all texts where nothing is trusted, have a null perplexity and are kept. Repeated rows are
    judged alike.
    """
    nothing = {"_perplexity": F.lit(None).cast("double"), "_threshold": F.lit(None).cast("double"), "_keep": F.lit(True)}
    if not model.langs:
        return rows.withColumns({"_model": F.lit(None).cast("string"), **nothing})
    s = scored(rows, model)
    if not model.thresholds:
        return s.withColumns(nothing).drop("_bits", "_symbols")
    lookup = lambda values: F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col("_model")]
    rate = (F.col("_bits") + PRIOR * lookup(model.means)) / (F.col("_symbols") + PRIOR)
    s = s.withColumn("_rate", F.when(F.col("_symbols") > 0, rate)).withColumn("_limit", lookup(model.thresholds))
    keep = F.coalesce(F.col("_rate") <= F.col("_limit"), F.lit(True))
    return s.withColumns({"_perplexity": F.pow(F.lit(2.0), "_rate"), "_threshold": F.pow(F.lit(2.0), "_limit"), "_keep": keep}).drop("_bits", "_symbols", "_rate", "_limit")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: ``doc_id, lang_model, perplexity, threshold, keep``."""
    out = judged(boxed(docs.select("doc_id", "text", "lang")), train(docs, labels))
    return out.select("_row.doc_id", F.col("_model").alias("lang_model"), F.round("_perplexity", 6).alias("perplexity"), F.col("_threshold").alias("threshold"), F.col("_keep").alias("keep"))


def good_text(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose perplexity stays within the threshold of their language."""
    return judged(boxed(docs), train(docs, labels)).where("_keep").select("_row.*")
