"""Secret scan: candidates in running text, and a random forest that removes the false positives. SQL functions and Spark ML only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Candidates in a word: every run of at least this many characters of keys and hashes,
VALUE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: Shapes of issued keys, and names that keys are assigned to.
ISSUED = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35})$"
NAMED = r"(?i)(token|secret|password|passwd|pwd|api_?key|access_?key|private_?key|credential|auth)"
#: what stands after a key's name and = or : (of any length, up to the closing quote, without quotes up to & , ; or a
#: bracket), and passwords in URLs.
PLACE = rf"(?<={NAMED.replace('(token', '(?:token')}[\w.\-]{{0,40}}[\"']?[=:]{{1,2}}>?"
ASSIGNED = rf"{PLACE}\")[^\"\s]+|{PLACE}')[^'\s]+|{PLACE})[^\s=:\"'>&,;(){{}}\[\]<][^\s\"'&,;(){{}}\[\]<>]*"
USER = r"(?<=://[^\s/@:]{0,100}:)[^\s/@]+(?=@)"
#: A word after a name and = or : is a candidate but for its quotes and marks.
NAME_BEFORE = rf"{NAMED}[\w.\-]*[\"']?\s*[=:]+>?[\"']?$"
QUOTED = r"^([\"'])(.*?)(?:\1|$)"
WHOLE = r"^[\"']*([^\"'\s]*[^\"'\s,;.)}\]])"
#: Most frequent words that count as the dictionary, labelled findings of each class for a fit, and buckets of paths.
DICTIONARY, FINDINGS, PATHS = 4096, 20_000, 16
FEATURES = ["length", "digits", "capitals", "vowels", "letter_digit", "case_change", "hexadecimal", "dictionary", "path", "named", "assigned", "quoted", "word_after"]


def _spans(word: Column, pattern: str) -> Column:
    """``value, at`` for every match of ``pattern`` in ``word``, ``at`` counted from 1."""
    found, gaps = F.regexp_extract_all(word, F.lit(pattern), 0), F.split(word, pattern, -1)
    size = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda total, x: total + F.length(x))
    return F.transform(found, lambda v, i: F.struct(v.alias("value"), (size(gaps, i + 1) + size(found, i) + 1).alias("at")))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """``doc_id, word_no, value, path, before, word, after, lead`` for every candidate of the whole texts; null texts have none.

    A word has as many as there are runs, assigned values and passwords of URLs in it, each place once; ``lead`` is what
    stands before the value in its part of the word.
    """
    words = F.split("text", r"[\x20\x09-\x0D]+")
    at = lambda i: F.coalesce(F.get("_w", i), F.lit(""))
    found = F.filter(
        F.transform("_w", lambda w, i: F.struct(i.cast("long").alias("word_no"), w.alias("word"), F.concat_ws(" ", at(i - 2), at(i - 1)).alias("before"), at(i + 1).alias("after"))),
        lambda c: c["word"].rlike(VALUE) | c["word"].rlike("[=:].") | c["before"].rlike("[=:]>?[\"']?$"),
    )
    rows = docs.select("doc_id", F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), words.alias("_w")).where("_w is not null")
    rows = rows.select("doc_id", "path", F.explode(found).alias("_c")).select("doc_id", "path", "_c.*")
    word = F.col("word")
    whole = F.when(word.rlike(QUOTED), F.regexp_extract(word, QUOTED, 2)).otherwise(F.regexp_extract(word, WHOLE, 1))
    named = F.when(word.rlike("[=:]."), F.concat(_spans(word, ASSIGNED), _spans(word, USER))).otherwise(F.array().cast("array<struct<value:string,at:int>>"))
    after = F.when(F.col("before").rlike(NAME_BEFORE) & (whole != ""), F.array(F.struct(whole.alias("value"), F.expr("locate(_whole, word)").alias("at"))))
    after = F.coalesce(after, F.array().cast("array<struct<value:string,at:int>>"))
    rows = rows.withColumn("_whole", whole).withColumn("_v", F.explode(F.array_distinct(F.concat(_spans(word, VALUE), named, after))))
    lead = F.regexp_extract(F.expr("substring(word, 1, _v.at - 1)"), r"([^&,;{}?]*)$", 1)
    return rows.select("doc_id", "path", "word_no", "word", "before", "after", F.col("_v.value").alias("value"), lead.alias("lead"))


def _named() -> Column:
    """Whether a key's name stands before the value; earlier words count only where nothing else is assigned between."""
    return F.when(F.col("lead").rlike(r"\w[\"']?[=:]"), F.col("lead")).otherwise(F.concat_ws(" ", "before", "lead")).rlike(NAMED)


def _assigned() -> Column:
    return (F.col("before").rlike("[=:]>?[\"']?$") & F.col("lead").rlike(r"^\W*$")) | F.col("lead").rlike(r"[=:]>?\W*$")


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """The ``size`` words of four letters or more that occur most often in all texts, in lower case."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), 0)).alias("part"))
    return words.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "part").limit(size).select("part")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with ``FEATURES``; ``words`` has at most ``DICTIONARY`` rows and is broadcast."""
    size = F.length("value")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / size
    parts = F.regexp_extract_all(F.lower("value"), F.lit(r"[a-z]{4,}"), 0)
    each = found.select("value").distinct().select("value", F.explode(F.array_distinct(parts)).alias("part"))
    covered = each.join(F.broadcast(words), "part").groupBy("value").agg(F.sum(F.length("part")).alias("_covered"))
    return found.join(covered, "value", "left").withColumns(
        {
            "length": size.cast("double"),
            "digits": share("[0-9]"),
            "capitals": share("[A-Z]"),
            "vowels": share("[aeiouAEIOU]"),
            "letter_digit": share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
            "case_change": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
            "hexadecimal": F.col("value").rlike("^[0-9a-f]+$").cast("double"),
            "dictionary": F.least(F.lit(1.0), F.coalesce("_covered", F.lit(0)) / size),
            "path": F.pmod(F.xxhash64("path"), F.lit(PATHS)).cast("double"),
            "named": _named().cast("double"),
            "assigned": _assigned().cast("double"),
            "quoted": F.col("word").rlike("[\"']").cast("double"),
            "word_after": F.col("after").rlike(r"^\p{L}+\W*$").cast("double"),
        }
    ).drop("_covered")


def labelled(found: DataFrame) -> DataFrame:
    """Findings labelled by rule where none are given: 1 for an issued shape or a mixed value under a key's name."""
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    return found.withColumn("label", (F.col("value").rlike(ISSUED) | (_named() & _assigned() & mixed)).cast("double"))


def fitted(findings: DataFrame, most: int = FINDINGS, trees: int = 24, depth: int = 6):
    """The forest from at most ``most`` described findings of each ``label``, in hash order; None unless both labels occur."""
    order = [F.xxhash64("value", "before", "after"), F.col("value"), F.col("doc_id"), F.col("word_no")]
    sides = [findings.where(F.col("label") == x).orderBy(*order).limit(most) for x in (0.0, 1.0)]
    sample = cut_lineage(sides[0].unionByName(sides[1]).select("label", *FEATURES))
    if sample.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7).fit(rows)


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source") -> DataFrame:
    """``doc_id, word_no, value, path, score, secret`` for every candidate: the forest's vote and whether it is over a half.

    ``findings`` are candidates with a ``label`` from earlier reviews; without them rules label this table's own. Where
    only one label occurs there is nothing to learn, and the score is null and ``secret`` true. Null and empty texts have
    no candidates, repeated rows are scored alike, an empty table gives no rows; other columns are not read.
    """
    words = cut_lineage(dictionary(docs))
    found = cut_lineage(described(candidates(docs, path).withColumn("_path", F.col("path")), words))
    known = labelled(found) if findings is None else described(findings, words)
    model = fitted(known)
    if model is None:
        scored = found.withColumn("score", F.lit(None).cast("double"))
    else:
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
        scored = model.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.select("doc_id", "word_no", "value", F.col("_path").alias("path"), "score", F.coalesce(F.col("score") > 0.5, F.lit(True)).alias("secret"))
