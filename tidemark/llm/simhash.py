"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, verified Hamming distance.

The pipeline's near-dedup (:func:`one_of_each_likeness`) goes by a verified shingle similarity. The SimHash groups empty its
crowds first; similar texts may differ in up to 13 of 64 bits, for which pigeonhole keys are either a few bits short or too
many, so bands of minimum hashes name the candidates among what is left.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, components, text_batches, text_key
from tidemark.session import cut_lineage

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 16
#: Members of a block from which its links are found by midpoints instead of pairs.
DENSE = 256
#: One of each likeness: words of a shingle and least Jaccard similarity of near-duplicates.
WORDS, LIKENESS = 5, 0.8
#: Bands of minimum hashes that name candidates: 1 - (1 - s**ROWS)**BANDS of the pairs of similarity s share one, 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: Minimum hashes of a text: the first make the bands, one bit of each makes the sketch.
MINIMA = 256
FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIXER = np.uint64(0xBF58476D1CE4E5B9)
#: Differing bits of two sketches from which a pair is not verified. Of similarity 0.8 one bit in ten differs, so 26 of 256
#: with a deviation of 4.8; a pair of 0.8 has more than 46 with a probability of 4e-5.
FAR = 46
#: First band and number of bands of the rounds before the one over all bands.
SHARES = ((1, 1), (2, 1), (3, 2))
#: Members of a band up to which all are paired, and those of a larger band that the first round pairs; each round pairs eight times as many.
FEW, LEADERS = 32, 32


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit fingerprint, as a signed integer; without words it is zero."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # splits at x20, x09 to x0D
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    spans = zip(starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        part = hashes[k : k + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "_fp", words: int = 4) -> DataFrame:
    """Add the fingerprint as a long; a null text counts as one without words."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn(out, prints(F.col(text).cast("string")))


def block_count(distinct: int, bits: int) -> int:
    """Blocks so that ``blocks - bits`` equal ones make keys a few bits shorter than log2 of the fingerprints.

    Any number above ``bits`` finds every close pair; more blocks make rarer keys and more copies of a row.
    """
    for blocks in range(bits + 1, 2 * bits + 3):
        if distinct <= 1 << (64 * (blocks - bits) // blocks + 1):
            return blocks
    return 2 * bits + 2


def masks(blocks: int, bits: int) -> list[int]:
    """One mask for each choice of ``blocks - bits`` blocks, as signed integers."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(parts, blocks - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, bits: int = 4, dense: int = DENSE) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints of column ``_fp`` that connect all within ``bits``.

    Two fingerprints that differ in at most ``bits`` bits agree in at least ``blocks - bits`` blocks, so they share
    a key. Keys with up to ``dense`` members join with themselves and the Hamming distance is verified. Members of
    larger keys are linked through midpoints: two fingerprints are within ``bits`` exactly if some point is within
    ``bits / 2`` of both. Each member names the points around it and is linked to the least member that names the
    same point, so a crowd costs rows in proportion to its size, and no link that connects different parts is lost.
    """
    if bits % 2:
        raise ValueError("bits must be even")
    blocks = block_count(prints.count(), bits)
    chosen = F.array(*[F.lit(m).cast("long") for m in masks(blocks, bits)])
    keyed = prints.select("_fp", F.posexplode(chosen).alias("_k", "_m")).select("_fp", F.xxhash64("_k", F.col("_fp").bitwiseAND(F.col("_m"))).alias("_key"))
    shared = cut_lineage(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    members = cut_lineage(keyed.join(shared, "_key"))
    few = members.where(F.col("_n") <= dense)
    other = few.select("_key", F.col("_fp").alias("b"))
    near = few.join(other, "_key").where(F.col("_fp") < F.col("b")).where(F.bit_count(F.col("_fp").bitwiseXOR(F.col("b"))) <= bits)
    found = near.select(F.col("_fp").alias("a"), "b").distinct()
    crowd = members.where(F.col("_n") > dense).select("_fp").distinct()
    flips = [0] + [_signed(sum(1 << i for i in at)) for r in range(1, bits // 2 + 1) for at in combinations(range(64), r)]
    around = crowd.select("_fp", F.explode(F.lit(flips).cast("array<long>")).alias("_flip")).select("_fp", F.col("_fp").bitwiseXOR(F.col("_flip")).alias("_at"))
    least = around.groupBy("_at").agg(F.min("_fp").alias("a"), F.max("_fp").alias("_z")).where("a < _z").select("_at", "a")
    met = around.join(least, "_at").where("a < _fp").select("a", F.col("_fp").alias("b")).distinct()
    return found.unionByName(met)


def _grouped(docs: DataFrame, bits: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, _key, _fp`` and the group of each fingerprint: ``_fp, _first`` with the least ``doc_id, _key`` in reach."""
    rows = with_fingerprint(docs.select("doc_id", "text", text_key().alias("_key")), words=words)
    prints = cut_lineage(rows.select("doc_id", "_key", "_fp"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_key"))
    own = cut_lineage(prints.groupBy("_fp").agg(least.alias("_low")))
    roots = cut_lineage(components(links(own.select("_fp"), bits)))
    rooted = own.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("_root", F.coalesce("root", "_fp"))
    lowest = rooted.groupBy("_root").agg(F.min("_low").alias("_first"))
    return prints, rooted.select("_fp", "_root").join(lowest, "_root").select("_fp", "_first")


def near_groups(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``; ``component_id`` is the least id in reach.

    Null and empty texts have the fingerprint zero and are linked like others. Rows with a null id take part as any
    other; a group of null ids alone has a null component. Repeated rows are returned as often as they come, an empty
    table gives no rows, and other columns are not read.
    """
    prints, groups = _grouped(docs, bits, words)
    hexed = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    return prints.join(groups, "_fp").select("doc_id", hexed.alias("fingerprint"), F.col("_first.doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each group the row of the least id stays.

    Null ids come after all others; among rows of one id the least name of the text decides; of rows that
    repeat both one stays. Groups are those of :func:`near_groups`.
    """
    prints, groups = _grouped(docs, bits, words)
    kept = groups.select(F.col("_first.doc_id").alias("_id"), F.col("_first._key").alias("_name"))
    return _rows(docs, kept)


def _rows(docs: DataFrame, kept: DataFrame, name: Callable[[str], Column] = text_key) -> DataFrame:
    """One row of ``docs``, all columns, for each ``_id, _name`` of ``kept``; ``name`` made the names of the texts."""
    named = boxed(docs).withColumn("_key", name("_row.text"))
    found = named.join(kept, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_name")), "left_semi")
    once = Window.partitionBy("_row.doc_id", "_key").orderBy(F.lit(0))
    return found.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").select("_row.*")


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct word shingles in ascending order; a shorter text is one shingle, one without words none."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = (b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in joined), np.uint64))


def profile(text: str | None, words: int = WORDS) -> np.ndarray:
    """The fingerprint of the distinct shingles, the words of the sketch and one key for each band; without words all zero."""
    found = shingles(text, words)
    if not len(found):
        return np.zeros(1 + MINIMA // 64 + BANDS, np.int64)
    low, counts = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64), np.zeros(64, np.int64)
    for k in range(0, len(found), 256):
        part = found[k : k + 256]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        x = part[:, None] * FACTORS
        x ^= x >> np.uint64(29)
        low = np.minimum(low, (x * MIXER).min(axis=0))
    print_ = np.packbits(counts * 2 > len(found), bitorder="little").view(np.int64)
    sketch = np.packbits((low >> np.uint64(20)).astype(np.uint8) & 1).view(np.int64)
    bands = [xxhash.xxh64_intdigest(rows.tobytes(), SEED) for rows in low[: BANDS * ROWS].reshape(BANDS, ROWS)]
    return np.concatenate((print_, sketch, np.array(bands, np.uint64).view(np.int64)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same) if len(a) or len(b) else 1.0


def text_name(text: str = "text") -> Column:
    """A 128-bit name of a text, which alone decides whether two texts are one; a null text has a name of its own."""
    return F.unhex(F.md5(F.concat(F.when(F.col(text).isNull(), "-").otherwise("+"), F.coalesce(F.col(text).cast("string"), F.lit("")))))


def _differing(a: str, b: str) -> Column:
    """Differing bits of two sketches."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(MINIMA // 64)), F.lit(0))


def _alike(docs: DataFrame, texts: DataFrame, pairs: DataFrame, likeness: float, words: int, met: bool) -> DataFrame:
    """Those of ``pairs`` (``a, b``: the ``_low`` of two texts) that are alike.

    Pairs meet their sketches first, unless they have already ``met``; whole texts go only where these do not rule the likeness out.
    """
    text_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def close(left: pd.Series, right: pd.Series) -> pd.Series:
        held: dict = {}
        of = lambda t: held[t] if t in held else held.setdefault(t, shingles(t, words))
        return pd.Series([jaccard(of(a), shingles(b, words)) >= likeness for a, b in zip(left, right)], dtype=bool)

    sketch = lambda x: texts.select(F.col("_low").alias(x), F.col("_sketch").alias(f"_s{x}"))
    likely = pairs.distinct()
    if not met:
        likely = likely.join(sketch("a"), "a").join(sketch("b"), "b").where(_differing("_sa", "_sb") <= FAR).select("a", "b")
    likely = cut_lineage(likely)
    needed = likely.select(F.explode(F.array("a._key", "b._key")).alias("_key")).distinct()
    named = docs.select(text_name().alias("_key"), F.col("text").cast("string").alias("_t")).join(needed, "_key", "left_semi").dropDuplicates(["_key"])
    of = lambda x, t: named.select(F.col("_key").alias(f"_k{x}"), F.col("_t").alias(t))
    texted = likely.join(of("b", "_right"), F.col("b._key") == F.col("_kb")).join(of("a", "_left"), F.col("a._key") == F.col("_ka"))
    return cut_lineage(texted.where(close("_left", "_right")).select("a", "b"))


def _stars(members: DataFrame, by: str) -> DataFrame:
    """Pairs ``a, b`` of the most central text of each group (``_score``, then the last ``_low``) and each other member."""
    central = members.groupBy(by).agg(F.max(F.struct("_score", "_low")).alias("_top"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return members.join(central, by).where(F.col("_low") != F.col("_top._low")).select(F.col("_top._low").alias("a"), F.col("_low").alias("b"))


def _group_stars(texts: DataFrame, bits: int = 4) -> DataFrame:
    """Stars of the SimHash groups."""
    prints = cut_lineage(texts.select("_fp").distinct())
    roots = components(links(prints, bits)).select(F.col("node").alias("_fp"), "root")
    return _stars(texts.join(roots, "_fp", "left").select("_low", "_score", F.coalesce("root", "_fp").alias("_root")), "_root")


def _pairs(some: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of the texts of a band, the earlier first; callers bound the bands.

    Members carry their sketches, which the join itself compares: texts that these tell apart never become a row. Where
    they carry the crowds ``_of`` that they are in, a pair is a row of the first crowd it shares only.
    """
    first = some.select("_band", F.col("_low").alias("_first"), F.col("_sketch").alias("_s"), *[F.col("_of").alias("_o") for c in some.columns if c == "_of"])
    met = first.join(others, "_band").where(F.col("_first") != F.col("_low")).where(_differing("_s", "_sketch") <= FAR)
    if "_o" in first.columns:
        met = met.where(F.array_min(F.array_intersect("_o", "_of")) == F.col("_band"))
    return met.select(F.least("_first", "_low").alias("a"), F.greatest("_first", "_low").alias("b"))


def _sized(members: DataFrame) -> DataFrame:
    """Members of bands of two or more, with the size ``_n`` of the band."""
    shared = members.groupBy("_band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return cut_lineage(members.join(shared, "_band"))


def _unlike(docs: DataFrame, likeness: float, words: int, few: int = FEW, leaders: int = LEADERS) -> DataFrame:
    """``_key, _low`` of the texts that stay: the name and the least ``_none, doc_id, _key`` among rows of the text.

    Verified links make groups, of which the least text stays. Who has a link to a centre needs no other, so it leaves:

    1. SimHash groups: each member is compared with the most central text of its group, the one that shares bands with most.
    2. Bands of minimum hashes: each text that is left is compared with the most central text of its bands, first of one
       band, then of the next few (``SHARES``), so that a crowd goes at about one pair for each member, then of all.
    3. Bands of up to ``few`` texts: what is left is compared with all texts of the band.
    4. Larger bands: what is left is compared with all texts of the band too, those that have left included, first with about
       ``leaders`` of them and in each round with eight times as many, so that the rounds grow with the logarithm of a crowd.

    The first two steps make pairs in proportion to the texts, whatever the size of a crowd, so only texts that are
    unlike every centre reach the others. These join with their sketches, and only what is likely alike becomes a row.
    """
    text_batches(docs.sparkSession)

    @F.pandas_udf("array<long>")
    def profiles(texts: pd.Series) -> pd.Series:
        return pd.Series([profile(t, words) for t in texts])

    rows = docs.select("doc_id", text_name().alias("_key"), profiles(F.col("text").cast("string")).alias("_p"))
    low = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_key"))
    once = rows.groupBy("_key").agg(low.alias("_low"), F.first("_p").alias("_p"))
    parts = F.col("_p")[0].alias("_fp"), F.slice("_p", 2, MINIMA // 64).alias("_sketch"), F.slice("_p", 2 + MINIMA // 64, BANDS).alias("_bands")
    texts = cut_lineage(once.select("_key", "_low", *parts))
    banded = lambda df, at=(1, BANDS): df.select("*", F.posexplode(F.slice("_bands", *at)).alias("_k", "_v")).withColumn("_band", F.xxhash64(F.col("_k") + at[0], "_v"))
    alike = lambda pairs, met=False: _alike(docs, texts, pairs, likeness, words, met)
    without = lambda members, found: members.join(found.select(F.col("b").alias("_low")).distinct(), "_low", "left_anti")

    spread = _sized(banded(texts).select("_band", "_low")).groupBy("_low").agg(F.sum("_n").alias("_score"))
    scored = cut_lineage(texts.join(spread, "_low", "left").select("_low", "_fp", "_bands", F.coalesce("_score", F.lit(0)).alias("_score")))
    found = alike(_group_stars(scored))
    joined, left = found, without(scored, found)
    for share in (*SHARES, (1, BANDS)):
        found = alike(_stars(banded(left, share).select("_band", "_low", "_score"), "_band"))
        joined, left = joined.unionByName(found), without(left, found)

    sketched = lambda members: members.join(texts.select("_low", "_sketch"), "_low")
    members = _sized(banded(scored).select("_band", "_low"))
    left = cut_lineage(sketched(members.join(left.select("_low"), "_low", "left_semi")))
    found = alike(_pairs(sketched(members.where(F.col("_n") <= few)), left), met=True)
    joined, left = joined.unionByName(found), without(left, found)
    crowds = members.where(F.col("_n") > few)
    of = crowds.groupBy("_low").agg(F.collect_set("_band").alias("_of"))
    left = cut_lineage(left.where(F.col("_n") > few).join(of, "_low"))
    place = F.floor(F.pmod(F.xxhash64("_low._key"), F.lit(1 << 30)) * F.col("_n") / F.lit(1 << 30))
    crowds = cut_lineage(sketched(crowds.withColumn("_place", place).join(of, "_low")))
    met, most = 0, crowds.agg(F.max("_n")).first()[0] or 0
    while met < most and not left.isEmpty():
        some = crowds.where((F.col("_place") >= met) & (F.col("_place") < met + leaders)).drop("_place", "_n")
        found = alike(_pairs(left, some), met=True)
        joined, left = joined.unionByName(found), cut_lineage(without(left, found))
        met, leaders = met + leaders, 8 * leaders
    roots = components(joined).where("node <> root").select(F.col("node").alias("_low"))
    return texts.select("_key", "_low").join(roots, "_low", "left_anti")


def one_of_each_likeness(docs: DataFrame, likeness: float = LIKENESS, words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each group the row of the least id stays.

    Two texts are linked where their sets of ``words``-word shingles have a Jaccard similarity of ``likeness`` or more;
    texts without words are alike. A row goes only where verified links lead from it to rows of lesser ids. Null ids
    come after all others; among rows of one id the least name of the text decides; of rows that repeat both one stays.
    An empty table gives no rows.
    """
    kept = _unlike(docs, likeness, words).select(F.col("_low.doc_id").alias("_id"), F.col("_low._key").alias("_name"))
    return _rows(docs, kept, text_name)
