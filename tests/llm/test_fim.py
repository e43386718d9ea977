"""Fill-in-middle: the rank index against plain tokens, the query against plain cuts."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import fim

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def offsets(text):
    return [m.start() for m in TOKEN.finditer(text)] + [len(text)]


@given(st.text(alphabet="abZ \n.é😀_9", max_size=400), st.integers(1, 126))
@settings(max_examples=150, deadline=None)
def test_every_boundary_is_exact(text, error):
    n, *index, residuals = fim.index_of(text, error)
    want = offsets(text)
    assert n == len(want) - 1
    assert fim.located(*index, residuals, np.arange(n + 1)).tolist() == want
    assert np.abs(np.frombuffer(residuals, np.int8).astype(int)).max() <= error + 1


def test_long_texts_across_chunks(monkeypatch):
    r = random.Random(1)
    text = "".join(r.choice(["word", " ", "x" * r.randrange(1, 900), "\n", "...", "é"]) for _ in range(20_000))
    plain = offsets(text)
    for chunk in (7, 1 << 12, 1 << 20):
        monkeypatch.setattr(fim, "CHUNK", chunk)
        assert fim.boundaries(text).tolist() == plain
    n, ranks, starts, slopes, residuals = fim.index_of(text)
    assert fim.located(ranks, starts, slopes, residuals, np.arange(n + 1)).tolist() == plain
    assert len(ranks) < n / 5  # tokens of up to 900 letters each start a segment


def test_a_straight_text_has_one_segment():
    assert len(fim.index_of("ab " * 10_000)[1]) == 1


def plain(doc_id, text, seed=1):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    draw = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(draw[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    head, middle, tail = "".join(tokens[:i]), "".join(tokens[i:j]), "".join(tokens[j:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(head), len(middle), f"<S>{tail}<P>{head}<M>{middle}"
    return n, "psm", len(head), len(middle), f"<P>{head}<S>{tail}<M>{middle}"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    texts = [None, "", " ", "a", "one <P> two", "ends with <S", "<", "😀 é ñ", "\n\n", "x" * 50_000, " ".join(r.choice(["tall", "tree", "1", "<S", "M>"]) for _ in range(40_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here"), (3, "a"), (3, "b c")]
    return rows + [(100 + i, "".join(r.choice("ab <>PSM.é\n") for _ in range(r.randrange(60)))) for i in range(150)]


def test_report_and_round_trip(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, n string, _index int, output string").repartition(3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((i, *p[:4], sha(p[4]), sha(t or "")) for i, t in rows for p in [plain(i, t)]), key=repr)
    assert sorted(map(tuple, fim.report(frame).collect()), key=repr) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.report(frame.limit(0)).count() == 0


def test_transformed_keeps_rows_and_seeds_differ(spark, rows):
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, form string")
    got = fim.transformed(frame, seed=5).collect()
    assert sorted((r.row.doc_id, r.row.text, r.row.form, r.form, r.output) for r in got if r.row.doc_id is not None) == sorted(
        (i, t, "x", plain(i, t, 5)[1], plain(i, t, 5)[4]) for i, t in rows if i is not None and t is not None
    ) + [(0, None, "x", "plain", "")] or len(got) == len(rows)
    assert len(got) == len(rows)
    with pytest.raises(ValueError):
        fim.transformed(frame, error=200)
