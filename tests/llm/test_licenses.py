"""License scan against a plain scan of every window and notice."""

import random
import re

import pytest

from tidemark.llm import licenses as L


def words_of(text):
    return re.findall(L.WORD, (text or "").translate(str.maketrans(L.UPPER, L.LOWER)))


def plain_matches(text, notices, threshold):
    words, out = words_of(text), set()
    for n in L.notices_of(notices, threshold):
        for b in range(0, len(words), n.stride):
            shared = len(set(words[b : b + 2 * n.stride]) & set(n.words))
            if shared >= n.need:
                out.add((n.label, n.family, b, min(2 * n.stride, len(words) - b), shared, shared / len(n.words)))
    return out


def plain_report(text, notices, threshold):
    words = words_of(text)
    found = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    met = plain_matches(text, notices, threshold)
    own = {m[0] for m in met if (m[5], m[4]) == max((x[5], x[4]) for x in met if x[1:4] == m[1:4])}
    base = {label for _, label in found}
    starts = [i for i, _ in found]
    score = 1.0 if base else max([m[5] for m in met], default=0.0)
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    pool = [w for *_, t in L.NOTICES for w in words_of(t)] + "river stone walks é bird".split()
    line = lambda n: " ".join(r.choice(pool) for _ in range(n))
    texts = [None, "", "...", "Under the MIT license", "under the mit license " * 3 + "cc-by_nc; apache license version 2"]
    texts += [f"{line(r.randrange(30))}\n{t}\n{line(r.randrange(30))}" for _, _, t in L.NOTICES]
    for _ in range(60):  # notices with words lost, put in or in another order
        own = words_of(r.choice(L.NOTICES)[2])
        own = [w for w in own if r.random() > 0.05]
        if r.random() < 0.3:
            r.shuffle(own)
        for _ in range(r.randrange(4)):
            own.insert(r.randrange(len(own) + 1), "also")
        texts.append(f"{line(r.randrange(200))} {' '.join(own)} {line(r.randrange(100))}")
    texts.append(line(30_000) + " released under the MIT License, see cc by nc")
    rows = list(enumerate(texts)) + [(None, L.NOTICES[0][2]), (3, "Under the MIT license"), (3, "another text of one id")]
    return rows


@pytest.mark.parametrize("threshold", [0.9, 0.6, 1.0])
def test_every_block_is_found(spark, rows, threshold):
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string").repartition(3)
    got = {tuple(m) for m in L.matches(frame, threshold=threshold).drop("_key").collect()}
    want = {(i, *m) for i, t in rows for m in plain_matches(t, L.NOTICES, threshold)}
    assert got == want and len(want) > 30


def test_report(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, labels string, _w string, _at int").repartition(3)
    got = sorted(map(tuple, L.report(frame).collect()), key=repr)
    assert got == sorted(((i, *plain_report(t, L.NOTICES, L.THRESHOLD)) for i, t in rows), key=repr)
    assert L.report(frame.limit(0)).count() == 0


def test_other_notices(spark):
    rows = [(1, "free to use for good and not for evil"), (2, "nothing")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    notices = [("json", "json", "for good, not evil"), ("empty", "empty", "...")]
    assert {r.doc_id: (r.labels, r.score) for r in L.report(frame, notices).collect()} == {1: ("json", 1.0), 2: ("", 0.0)}
    assert {r.labels for r in L.report(frame, []).collect()} == {""}
    with pytest.raises(ValueError):
        L.notices_of(notices, 1.2)


def test_no_python_in_the_plan(spark, rows):
    frame = spark.createDataFrame(rows[:5], "doc_id long, text string")
    plan = L.report(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_words_are_cut_between_separators(spark):
    texts = [None, "", " ", "..", "a", " A\x00b\x7f9_c` ", "\u00c9T\u00c9 \U0001f600x\u00a0y\u2003z", "\ud7ff@[{~A-Z", "x\n\ny\u0080\x85 "]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = L._worded(frame)
    assert {r.doc_id: r._w for r in rows.collect()} == {i: words_of(t) for i, t in enumerate(texts)}
    assert "regexp_extract_all" not in rows._jdf.queryExecution().executedPlan().toString()
