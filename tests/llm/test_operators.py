"""The operators against plain versions on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import html
import json
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

import corpus_pipeline
from tidemark.llm import chat, common, decontam, fingerprints, kneser, language, linedup, mixing, pages, secrets, simhash

WORDS = "river stone walks over green hills while small birds sing near old houses and the wind carries leaves".split()
CLASH = "_key string, _row string, _lines string, _nth string, _id string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    run = "\n".join(prose(100 + i, 20) for i in range(4))
    return [
        (1, prose(1, 200)),
        (2, f"{prose(2, 9)}\n{run}\n{prose(3, 12)}"),
        (3, f"{prose(4, 30)}\n\n{run}\n{prose(5, 8)}"),
        (4, prose(1, 200)),
        (5, None),
        (6, ""),
        (7, " \n\t\n"),
        (None, "no id"),
        (8, prose(8, 30_000)),
        (8, prose(8, 30_000)),
        (9, "a b c"),
        (10, "\n".join([prose(200, 60)] * 3)),
        (11, "Grüße \U0001f600 ñandú"),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{(i or 0) % 3}" if i != 9 else None, len(t or ""), *["x"] * 5) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(5)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# fingerprints


@given(st.lists(st.text(alphabet="ab \té", max_size=12), min_size=1, max_size=6), st.randoms())
@settings(max_examples=60, deadline=None)
def test_paragraph_order_and_updates(paragraphs, r):
    text = "\n".join(paragraphs)
    own = fingerprints.written(*fingerprints.vector(text))
    if text:
        r.shuffle(paragraphs)
        if "\n".join(paragraphs):
            assert fingerprints.written(*fingerprints.vector("\n".join(paragraphs))) == own
        more = fingerprints.inserted(own, "one more here")
        assert more == fingerprints.written(*fingerprints.vector(text + "\none more here"))
        assert fingerprints.deleted(more, "one more here") == own


def test_fingerprints_of_edited_and_next(docs, texts):
    order = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0))
    got = {(r.doc_id, r.n_chars): r for r in fingerprints.report(docs).collect()}
    assert fingerprints.report(docs).count() == len(texts)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        if i == 8:
            continue  # repeated rows: one is next to the other, the last to the row after
        new = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        r = got[i, len(t)]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == fingerprints.written(*fingerprints.vector(t))
        assert r.edited_fingerprint == fingerprints.written(*fingerprints.vector(new))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert got[1, len(texts[0][1])].near_edited > 0.5 > got[1, len(texts[0][1])].near_next
    assert fingerprints.report(docs.where("doc_id = 9")).first().near_next == 1.0
    assert fingerprints.report(docs.limit(0)).count() == 0


# decontamination


def test_decontamination(spark, docs, texts):
    items = [(1, texts[0][1][300:500]), (2, "A, b; c!"), (3, None), (4, "  "), (5, "nowhere to be found"), (2, "A, b; c!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for blocks in (decontam.BLOCK_CHARS, 30):
        found = decontam.scanned(docs.select("doc_id", "text"), bench, block_chars=blocks)
        for r in found.collect():
            words, hit, ids = split(r.text), set(), set()
            for item, text in items:
                w = split(text)
                size = min(10, len(w))
                for a in range(len(w) - size + 1 if w else 0):
                    for at in range(len(words) - size + 1):
                        if words[at : at + size] == w[a : a + size]:
                            hit |= set(range(at, at + size))
                            ids.add(str(item))
            assert r._scan.n_words == len(words)
            assert sum(b - a for a, b in r._scan.words) == len(hit)
            assert r._scan["items"] == sorted(ids)
            assert all(split(r.text[a:b]) for a, b in r._scan.spans)
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {2, 3, 5, 6, 7, None, 8, 10, 11}
    assert decontam.clean(docs.limit(0), bench).count() == 0
    assert decontam.clean(docs, bench.limit(0)).count() == len(texts)


# secrets


def test_secret_scan(spark):
    r = random.Random(4)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'some words token = "{key(40)}" and more text', "a") for i in range(60)]
    rows += [(100 + i, f"some words {r.choice(WORDS)}{''.join(r.sample(WORDS, 3))} and more text", "b") for i in range(60)]
    rows += [(200, None, "a"), (201, "", None), (0, rows[0][1], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.scan(docs).collect()
    assert len(found) == sum(bool(re.search(secrets.VALUE, w)) for _, t, _ in rows for w in (t or "").split())
    assert {x.doc_id for x in found if x.secret} == set(range(60))
    assert secrets.scan(docs.limit(0)).count() == 0
    assert all(x.secret and x.score is None for x in secrets.scan(docs.where("doc_id < 60")).collect())


def test_candidates_are_all_places(spark):
    k = [c * 4 + "0123456789abcdefXYZ" for c in "pqrstuv"]
    texts = {
        1: f"x a={k[0]}&token={k[1]} y",
        2: '{"id":7,"password":"hu$n.ter2","api_key":"' + k[2] + '","z":[1]}',
        3: f"get https://me:pa.ss!w0rd@host/x?key={k[3]}&x=1 now",
        4: f"{k[4]}.{k[5]}.{k[6]} and {k[0]},{k[1]} then {k[2]}@host",
        5: "set password: s3cr#t, or PWD = 'abc1' or pwd='q;&z' and passwd: \"r;t\", name: nothing",
        6: f"a={k[0]}&b={k[0]}",
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, source string")
    found = {}
    for r in secrets.candidates(docs).collect():
        found.setdefault(r.doc_id, []).append(r.value)
    assert set(found[1]) == {k[0], k[1]} and found[1].count(k[0]) == 1
    assert set(found[2]) == {"hu$n.ter2", k[2]}
    assert {"pa.ss!w0rd", k[3]} <= set(found[3])
    assert set(found[4]) == {*k[4:], *k[:3]}
    assert {"s3cr#t", "abc1", "q;&z", "r;t"} == set(found[5])
    assert len(secrets.candidates(docs.where("doc_id = 6")).collect()) == 2


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href='/b'>News</a></ul></nav><!-- no --><div class="ad">Buy this now.</div>
<article><h1>{head}</h1><p><b>{a}<br><p>{b} &amp; &eacute;t&#233;</p></article><footer>&copy; site</footer></body></html>"""


def test_blocks_of_broken_markup():
    assert pages.blocks(None) == [] and pages.blocks("") == []
    assert [t for _, t, _ in pages.blocks("<p>a<p>b <i>c</i>d<script>x<p>y")] == ["a", "b cd"]
    assert [t for _, t, _ in pages.blocks("x <p title=it's>y</p> &lt;p&gt; <!-- z")] == ["x", "y", "<p>"]


def test_gradients():
    import numpy as np

    r = np.random.default_rng(1)
    x, y = r.normal(size=(2, 4, pages.PATH + pages.WORDS + pages.PLAIN)).astype(np.float32), np.ones((2, 4), np.float32)
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], np.float32)
    model = pages.Labeller()

    def loss():
        p = model.probabilities(x, mask).astype(np.float64)
        return -(np.log(p) * y * mask).sum() / mask.sum()

    g = model.gradients(x, mask, y)
    for w, d in ((model.v, g[0]), (model.w[0], g[2]), (model.w[1], g[4]), (model.b[1], g[5])):
        at = tuple(s // 2 for s in w.shape)
        old, step = w[at], 1e-2
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * step) - d[at]) < 2e-3



def test_long_pages_are_learnt_to_their_end(spark):
    paragraphs = lambda i: [prose(i + 7 * k, 9) for k in range(110)]
    made = [(i, "u", PAGE.format(head=prose(i, 4), a=prose(i + 50, 12), b=prose(i + 90, 25))) for i in range(30)]
    long = [(100 + i, "u", PAGE.format(head=prose(i, 4), a=prose(i + 50, 12), b="</p><p>".join(paragraphs(i)))) for i in range(8)]
    got = {r.page_id: r.text for r in pages.report(spark.createDataFrame([*made, *long], "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[100 + i] == " ".join([prose(i, 4), prose(i + 50, 12), *paragraphs(i), "& été"])
    first = pages.trained(spark.createDataFrame(made[:3], "page_id long, url string, html string"))
    assert first.v.shape == pages.Labeller().v.shape

def test_main_text(spark):
    made = [(i, "http://x/", PAGE.format(head=prose(i, 4), a=prose(i + 50, 12), b=prose(i + 90, 25))) for i in range(40)]
    rows = [*made, (40, None, None), (41, "u", ""), (0, *made[0][1:])]
    got = pages.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "" if r.page_id >= 40 else f"{prose(r.page_id, 4)} {prose(r.page_id + 50, 12)} {prose(r.page_id + 90, 25)} & été"
        assert r.text == want and r.n_chars == len(want)
    assert pages.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert html.unescape("&eacute;") == "é"


# chat


@given(st.text(alphabet="~<>/s[]INTSYROLEX \n", max_size=40), st.sampled_from(["user", "assistant", "system", "tool", "", "<s>"]))
@settings(max_examples=300, deadline=None)
def test_template_reads_back(text, role):
    for said in (text, text + "</s>", "[INST]" + text, "<<SYS>>" + text):
        formed, a, b = chat.piece(role, said)
        assert chat.read_piece(formed) == (role, said)
        assert chat.unescaped(formed[a:b]) == (said if role == "assistant" else "")
        assert not any(c in chat.escaped(said) for c in chat.CONTROL)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "hi"), (1, 0, "user", None), (1, 1, "assistant", "hi"), (2, None, None, "x"), (2, 0, "system", "~"), (None, 0, "user", "q")]
    rows += [(3, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(3000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.report(table).collect()}
    assert set(got) == {1, 2, 3, None}
    for key in got:
        turns = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or 0, chat.piece(r[2] or "", r[3] or "")[0]))
        want = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[key].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[key].n_turns == len(turns)
    assert chat.report(table.limit(0)).count() == 0


def test_layouts(spark):
    records = [
        ("a", '{"messages":[{"role":"user","content":"q"},{"content":"r","role":"assistant"}]}'),
        ("b", '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r"}]}'),
        ("c", '{"response":"r","prompt":"q"}'),
        ("d", '{"instruction":"q","input":"","output":"r"}'),
        ("e", '{"unknown":1}'),
        ("f", "no json"),
        ("g", None),
    ]
    out = chat.turns_of_records(spark.createDataFrame(records, "id string, record string"), "id", "record").collect()
    for key in "abcd":
        assert sorted((r.turn, r.role, r.text) for r in out if r.conv_id == key) == [(0, "user", "q"), (1, "assistant", "r")]
    assert [(r.conv_id, r.turn, r.layout is None) for r in sorted(out) if r.conv_id in "efg"] == [("e", None, False), ("f", None, True), ("g", None, True)]


def test_other_fields_cost_no_turn_and_are_kept(spark):
    plain = {"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}
    records = [
        {"messages": [{**plain[0], "name": "Ann"}, plain[1]], "id": 7, "source": {"site": "x"}},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r", "weight": 0}], "history": []},
        {"prompt": "q", "response": "r", "lang": "en"},
        {"prompt": "q", "completion": "r", "tags": ["a"]},
        {"instruction": "q", "output": "r", "id": "7"},
        {"instruction": "q", "input": "", "output": "r", "id": "7"},
        {"system": None, "instruction": "q", "output": "r", "meta": {"a": [1]}},
    ]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, record string")
    out = chat.turns_of_records(frame, "id", "record").collect()
    for i, record in enumerate(records):
        turns = sorted((r.turn, r.role, r.text) for r in out if r.conv_id == i and r.role != "system")
        assert [t[1:] for t in turns] == [("user", "q"), ("assistant", "r")]
        extra = json.loads(next(r.record_extra for r in out if r.conv_id == i))
        assert extra and extra.items() <= record.items()
    assert [r.turn_extra for r in sorted(out) if r.conv_id == 0] == ['{"name": "Ann"}', None]
    assert chat.turns_of_record('{"messages": [], "id": 1}') == [] and chat.turns_of_record('{"id": 1}') is None


def test_tables_with_other_columns(spark):
    frame = spark.createDataFrame([(1, 0, "user", "q", "x")], "id long, index long, `from` string, value string, note string")
    assert chat.turns_of_table(frame).collect() == [(1, 0, "user", "q")]
    with pytest.raises(ValueError):
        chat.turns_of_table(frame.drop("value"))


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, docs, texts):
    prints = [(i, plain_fingerprint(t)) for i, t in texts]
    root = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if bin(prints[a][1] ^ prints[b][1]).count("1") <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    least = {r: min((prints[j][0] for j in range(len(prints)) if root[j] == r and prints[j][0] is not None), default=None) for r in root}
    want = sorted(((i, f"{p:016x}", least[root[j]]) for j, (i, p) in enumerate(prints)), key=repr)
    assert rows_of(simhash.near_groups(docs)) == want
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, set(least.values())))
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0


def test_dense_blocks_link_as_pairs_do(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(3)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    near = {signed(b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))) for b in base for _ in range(60)}
    prints = spark.createDataFrame([(x,) for x in near], "_fp long")

    def parts(links):
        own = {x: x for x in near}
        for _ in range(12):
            for a, b in links:
                own[a] = own[b] = min(own[a], own[b])
        return own

    pairs = [(a, b) for a in near for b in near if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4]
    for dense in (2, 10_000):
        assert parts([tuple(x) for x in simhash.links(prints, dense=dense).collect()]) == parts(pairs)


def test_likeness_of_shingles_decides(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = {}
    for g in range(30):
        base = [word() for _ in range(200)]
        for c in range(1 if g % 3 else 4):
            copy = list(base)
            for k in range(4 * c):  # 0 to 12 words changed: similarity 1 down to some 0.55
                copy[r.randrange(200)] = word()
            texts[g * 100 + c] = " ".join(copy)
    crowd = [word() for _ in range(300)]
    for c in range(120):  # a crowd over FEW
        copy = list(crowd)
        copy[r.randrange(300)] = word()
        texts[9000 + c] = " ".join(copy)
    for c in range(90):  # a crowd of pairs that are not alike
        texts[20000 + c] = " ".join(crowd[:150] + [word() for _ in range(60)])
    texts |= {30000: "", 30001: None, 30002: " \n", 30003: "two words", 30004: "Two  WORDS", None: "two words"}
    sets = {i: set(simhash.shingles(t)) for i, t in texts.items()}
    alike = lambda a, b: not sets[a] and not sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    order = sorted(texts, key=lambda i: (i is None, i))
    root = {i: i for i in order}
    for j, b in enumerate(order):
        for a in order[:j]:
            if alike(a, b):
                root[b] = root[a]
                break
    want = [i for i in order if root[i] == i]
    frame = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(0, texts[0], "again")], "doc_id long, text string, source string")
    got = corpus_pipeline.near_dedup(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted((x.doc_id for x in got.collect()), key=lambda i: (i is None, i)) == want
    assert corpus_pipeline.near_dedup(spark, frame.limit(0), "").count() == 0
    small = simhash._unlike(frame, 0.8, 5, few=30, leaders=8)
    assert small.count() == len(want)


def test_crowds_of_a_common_passage(spark):
    passage = prose(7, 60)
    texts = [(i, f"{prose(100 + i, 60)} {passage}") for i in range(120)] + [(200 + i, f"{prose(100 + i, 60)} {passage} end") for i in range(5)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    kept = simhash._unlike(frame, 0.8, 5, few=20, leaders=8)
    assert sorted(r._low.doc_id for r in kept.collect()) == list(range(120))


def test_crowds_are_compared_whole(spark):
    """Texts that are like a member of a crowd but not like its centre; the member has left by then."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(300)]
    changed = lambda words, at, n: [*words[:at], *[word() for _ in range(n)], *words[at + n :]]
    texts = {0: base} | {i: changed(base, r.randrange(299), 1) for i in range(1, 31)}
    for i in range(12):
        texts[100 + i] = changed(base, 8 * i, 25)
        texts[200 + i] = changed(texts[100 + i], 150 + 8 * i, 25)
    sets = {i: simhash.shingles(" ".join(t)) for i, t in texts.items()}
    assert all(simhash.jaccard(sets[0], sets[100 + i]) > 0.8 > 0.75 > simhash.jaccard(sets[0], sets[200 + i]) and simhash.jaccard(sets[100 + i], sets[200 + i]) > 0.8 for i in range(12))
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    assert [x._low.doc_id for x in simhash._unlike(frame, 0.8, 5, few=1, leaders=4).collect()] == [0]


def test_profiles_tell_likeness():
    base = prose(3, 400).split()
    texts = [" ".join(base[:k] + prose(9, 400).split()[k:]) for k in (400, 390, 380, 300)]
    mine = [simhash.profile(t) for t in texts]
    differing = lambda a, b: sum(bin((int(x) ^ int(y)) & (1 << 64) - 1).count("1") for x, y in zip(a[1:5], b[1:5]))
    alike = lambda a, b: simhash.jaccard(simhash.shingles(a), simhash.shingles(b))
    for t, p in zip(texts[1:], mine[1:]):
        share = 1 - 2 * differing(mine[0], p) / simhash.MINIMA  # one bit in two differs where the minima do
        assert abs(share - alike(texts[0], t)) < 0.25
    assert not simhash.profile(None).any() and not simhash.profile(" ").any()


# line dedup


def plain_line_dedup(rows, words):
    """Windows of the fewest lines with ``words`` words, from each line on and up to each line, against those seen before."""
    order = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0))
    gone = {row: set() for row in order}
    for step in (1, -1):
        seen = set()
        for row in order:
            lines = (row[1] or "").split("\n")
            told = [i for i, x in enumerate(lines) if re.search(linedup.WORD, x)]
            found = []
            for i in range(len(told)):
                n, j = 0, i
                while 0 <= j < len(told) and n < words:
                    n += len(re.findall(linedup.WORD, lines[told[j]]))
                    j += step
                if n >= words:
                    found.append((min(i, j - step), max(i, j - step)))
            for a, z in sorted(found):
                key = tuple(lines[told[k]] for k in range(a, z + 1))
                if key in seen:
                    gone[row] |= set(range(told[a], told[z] + 1))
                seen.add(key)
    return sorted(((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])) for i, t in rows), key=repr)


def test_line_dedup(docs, texts):
    out = linedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert rows_of(out.select("doc_id", "text")) == plain_line_dedup(texts, linedup.WORDS)
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    assert linedup.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_of_few_lines(spark, seed):
    r = random.Random(seed)
    rows = [(i, "\n".join(r.choice(["a b", "c", "d e f", "", "g"]) for _ in range(r.randrange(0, 30)))) for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(linedup.deduplicated(docs, words=6).select("doc_id", "text")) == plain_line_dedup(rows, 6)


# quality


def test_quality(spark):
    rows = [(i, prose(i, 80), "en") for i in range(120)] + [(500 + i, "".join(random.Random(i).choice("#@!0123qxzQXZ&%") for _ in range(400)), "en") for i in range(5)]
    rows += [(600, None, "en"), (601, "", None), (602, prose(7, 80), None), (602, prose(7, 80), None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, _score string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(500, 0, 1)], "doc_id long, quality int, toxic int")
    kept = kneser.good_text(docs, labels)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and not set(range(500, 505)) & set(ids)
    assert len(set(range(120)) & set(ids)) >= 112 and {600, 601} <= set(ids)
    assert ids.count(602) == (2 if 7 in ids else 0)  # the same text without a language
    assert kneser.good_text(docs, labels.limit(0)).count() == len(rows)
    assert kneser.good_text(docs.limit(0), labels).count() == 0


def test_small_and_unlabelled_languages_stay(spark):
    other = lambda seed: prose(seed, 80).translate(str.maketrans("aeiorstln", "qxzjkvwyu"))
    rows = [(i, prose(i, 80), "en") for i in range(40)] + [(1000 + i, prose(1000 + i, 80), "en") for i in range(300)]
    rows += [(5000 + i, other(i), "zz") for i in range(50)] + [(6000, other(77), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    ids = {r.doc_id for r in kneser.good_text(docs, labels).collect()}
    assert set(range(5000, 5050)) <= ids and 6000 not in ids
    assert len(ids & set(range(1000, 1300))) >= 294
    few = {r.doc_id for r in kneser.good_text(docs.where("lang is not null"), labels.limit(8)).collect()}
    assert len(few) == len(rows) - 1


def test_components_end_with_stars(spark, monkeypatch):
    """A star is done in one round: it took another one to see that nothing changed."""
    cuts = []
    monkeypatch.setattr(common, "cut_lineage", lambda df, cut=common.cut_lineage: cuts.append(df) or cut(df))
    found = {r.node: r.root for r in common.components(spark.createDataFrame([(1, k) for k in range(2, 9)], "a long, b long")).collect()}
    assert found == {k: 1 for k in range(1, 9)} or found == {k: 1 for k in range(2, 9)}
    assert len(cuts) == 2
    r = random.Random(8)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    root = list(range(60))
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect():
        assert root[x.node] == x.root


def test_a_fit_takes_few_jobs(spark):
    """Each job costs the driver threads and blocks of broadcasts; a fit with cross-fitted languages took 195 of them."""
    docs = spark.createDataFrame([(i, prose(i, 40), ("en", "fr")[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    spark.sparkContext.setJobGroup("fit", "")
    try:
        model = kneser.train(docs, labels)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert model.langs == ["en", "fr"] and set(model.means) == set(model.thresholds) == {"en", "fr"}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit")) <= 60


def test_probabilities_sum_to_one(spark):
    counts = spark.createDataFrame([("en", ((1 * kneser.V + 2) * kneser.V + 3) * kneser.V + k, 1 + k % 4) for k in range(4, 20)], "lang string, gram long, n long")
    for p, weight in kneser.probabilities(counts):
        assert all(0 < r.p <= 1 for r in p.collect())
        assert all(0 <= r.weight <= 1 for r in weight.collect())


def plain_kneser_ney(trusted):
    """Bits of a text under interpolated modified Kneser-Ney of order 4 over whole characters, by the formulas."""
    size, begin = kneser.ORDER, kneser.BEGIN_CHAR * (kneser.ORDER - 1)
    seen = [begin + kneser.plain(t) for t in trusted]
    tables = [Counter(t[i - size + 1 : i + 1] for t in seen for i in range(size - 1, len(t)))]
    tables[0] = Counter({g: n for g, n in tables[0].items() if kneser.AGAIN_CHAR not in g})
    while len(tables) < size:
        tables.insert(0, Counter(g[1:] for g in tables[0]))
    cuts = []
    for c in tables:
        n = [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [min(k, k - (k + 1) * y * n[k] / n[k - 1]) if min(n[:3]) > 0 else 0 for k in (1, 2, 3)]
        cuts.append([x if x > 0 else 0.5 for x in d])

    def p(gram):
        if not gram:
            return 1 / kneser.V
        c, d = tables[len(gram) - 1], cuts[len(gram) - 1]
        under = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        if not under:
            return p(gram[1:])
        cut = lambda n: min(n, d[min(n, 3) - 1])
        n, total = under.get(gram, 0), sum(under.values())
        return ((n - cut(n) if n else 0) + sum(map(cut, under.values())) * p(gram[1:])) / total

    def bits(text):
        t = begin + kneser.plain(text)
        return -sum(math.log2(p(t[i - size + 1 : i + 1])) for i in range(size - 1, len(t)))

    return bits


@pytest.mark.parametrize("broadcast", [0, 300, 50_000])
def test_scores_follow_the_formulas_for_every_character(spark, monkeypatch, broadcast):
    monkeypatch.setattr(kneser, "BROADCAST_GRAMS", broadcast)
    monkeypatch.setattr(kneser, "SHARD", 600)
    monkeypatch.setattr(kneser, "PACK", 300)
    r = random.Random(4)
    han = [chr(0x4E00 + 7 * k) for k in range(60)]
    words = ["Alpha", "BETA", "\u00c9t\u00e9", "gamma gamma", "na\u00efve", "\U0001f600!"]
    zh = ["".join(r.choice(han[:45]) + r.choice("\u3002 ") for _ in range(25)) for _ in range(8)]
    en = [" ".join(r.choice(words) for _ in range(12)) for _ in range(8)]
    model = kneser._fitted(spark.createDataFrame([("zh", t) for t in zh] + [("en", t) for t in en], "lang string, text string"))
    others = ["".join(r.choice(han) for _ in range(20)), "Alpha ALPHA BETA", "beta gamma", "\x02\x03", "", None, en[0], zh[0]]
    rows = [(i, lang, t, ["k"]) for i, (lang, t) in enumerate((lang, t) for t in others for lang in ("en", "zh", None, "xx"))] + [(0, "en", others[0], ["k"])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, _shard array<string>")
    got = kneser.scored(kneser.boxed(docs), model).select("_row.*", "_model", "_bits", "_symbols").collect()
    plain = {"en": plain_kneser_ney(en), "zh": plain_kneser_ney(zh)}
    assert sorted((x.doc_id, x._shard[0]) for x in got) == sorted((i, "k") for i, *_ in rows)
    for x in got:
        tried = {k: f(x.text or "") for k, f in plain.items() if x.lang in (k, None)}
        assert x._model == (min(tried, key=lambda k: (tried[k], k)) if tried else None)
        assert x._bits == pytest.approx(min(tried.values()) if tried else 0, abs=1e-6)


def test_scores_do_not_depend_on_runs(spark, monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("abc  \u4e00\U0001f600") for _ in range(r.randrange(0, 60))) for _ in range(30)]
    docs = spark.createDataFrame([(i, ("en", "fr", None)[i % 3], t) for i, t in enumerate([*texts, *texts])], "doc_id long, lang string, text string")
    learnt = spark.createDataFrame([("en", t) for t in texts[:9]] + [("fr", t) for t in texts[9:20]], "lang string, text string")
    found = []
    for size in (7, 50, 250_000):
        monkeypatch.setattr(kneser, "RUN", size)
        model = kneser._fitted(learnt)
        found.append({x.doc_id: x for x in kneser.scored(kneser.boxed(docs), model).select("_row.*", "_model", "_bits", "_symbols").collect()})
    plain = {"en": plain_kneser_ney(texts[:9]), "fr": plain_kneser_ney(texts[9:20])}
    for got in found:
        assert len(got) == 60
        for i, x in got.items():
            tried = {k: f(x.text) for k, f in plain.items() if x.lang in (k, None)}
            assert x._bits == pytest.approx(min(tried.values()), abs=1e-6) and x._symbols == len(kneser.plain(x.text))
            assert x._model == (x.lang or min(tried, key=lambda k: (tried[k], k)))
            assert x.lang != got[i % 30].lang or x._bits == got[i % 30]._bits


def test_a_shard_takes_little_memory(spark, monkeypatch):
    """Hashing deals twice SHARD to some shards; two workers stand beside the heap of an executor."""
    kept = []
    for kind in (GroupedData, PandasCogroupedOps):
        monkeypatch.setattr(kind, "applyInArrow", lambda self, f, schema, apply=kind.applyInArrow: kept.append(f) or apply(self, f, schema))
    texts = [prose(i, 700) for i in range(40)]
    learnt = spark.createDataFrame([("en", t) for t in texts[:4]], "lang string, text string")
    docs = spark.createDataFrame([(1, "en", texts[0])], "doc_id long, lang string, text string")
    kneser.scored(kneser.boxed(docs), kneser._fitted(learnt))
    distinct, score = kept[-2:]
    rows = [{"doc_id": i, "lang": "en", "text": t} for i, t in enumerate(texts)]
    times = 2 * kneser.SHARD // sum(map(len, texts)) + 1
    pack = kneser._packed(pa.table({"_row": pa.array(rows * (times // 16 + 1))}))
    shard = pa.table({"_shard": pa.array([0] * 16, pa.int64()), "_pack": pa.array([pack] * 16, pa.binary())})
    found = distinct(shard.slice(0, 1))
    found = found.append_column("bits", pa.array(np.ones(len(found))))
    peaks = []
    for call in (lambda: distinct(shard), lambda: score(shard, found)):
        tracemalloc.start()
        try:
            assert call().num_rows
            peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        finally:
            tracemalloc.stop()
    assert max(peaks) < 120, peaks


# language


def test_language(spark):
    kinds = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "zwölf große würfel über grünem fluss", "cc": "który łąka śnieg źródło żółty"}
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(kinds[k].split()) for _ in range(40)), k) for i in range(90) for k in [sorted(kinds)[i % 3]]]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (None, "lorem ipsum", "aa"), (903, "LOREM IPSUM " * 20000, None), (0, *rows[0][1:])]
    docs = spark.createDataFrame([(*x, "y") for x in rows], "doc_id long, text string, lang string, lang_pred string")
    got = {x.doc_id: x for x in language.report(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i is not None and i < 90)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "aa" and all(0 <= x.score <= 1 for x in got.values())
    assert language.report(docs.limit(0)).count() == 0
    assert {x.lang_pred for x in language.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# mixing


def test_mix(docs, texts):
    out = mixing.report(docs).collect()
    assert len(out) == len(texts)
    for source in {r.source for r in out}:
        own = [r for r in out if r.source == source]
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert own[0].target <= 2 * own[0].source_size
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    assert sorted(out, key=repr) == sorted(mixing.report(docs.repartition(3)).collect(), key=repr)
    assert mixing.report(docs.limit(0)).count() == 0


def test_mixed_documents_are_the_plan(spark):
    rows = [(i, f"  {prose(i, 5 + i % 40)}\n end {i} ", "abc"[min(i % 7, 2)], i) for i in range(200)]
    rows += [(7, rows[7][1], rows[7][2], 7), (None, "no  id", "a", 0), (900, None, None, 0), (901, "", "b", 0), (902, prose(9, 4000), "big", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    per = lambda found: {k: sum(r.taken for r in found if (r.doc_id, r.source) == k) for k in {(r.doc_id, r.source) for r in found if r.taken}}
    whole = {r[0]: r[1] for r in rows}
    for share in (0.5, 1.5):
        plan, out = mixing.mix(docs, share=share).collect(), mixing.mixed(docs, share=share).collect()
        assert any(r.taken == 0 < r.size for r in plan) if share < 1 else any(r.epoch == 2 for r in out)
        assert per(plan) == per(out)
        assert any(r.text != whole[r.doc_id] for r in out)
        for r in out:
            assert len(r.text.split()) == r.taken > 0 and whole[r.doc_id].startswith(r.text)
            assert r.text == whole[r.doc_id] or r.n_chars == len(r.text)
    assert mixing.mixed(docs).columns == [*docs.columns, "epoch", "taken", "target"]
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_the_mixing_stage_makes_the_mix(spark, tmp_path):
    rows = [(i, f" {prose(i, 5 + i % 40)} ", "en", "abc"[i % 3], i) for i in range(300)]
    rows += [rows[7], rows[7], (None, "no  id", "en", "a", 0), (None, "no  id", "en", "a", 0), (900, None, "en", None, 0), (901, "", None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    dict(corpus_pipeline.STAGES)["mixing sources to target weights"](spark, docs, "").write.parquet(f"{tmp_path}/mix")
    out = spark.read.parquet(f"{tmp_path}/mix").collect()
    assert sorted((r[:5] for r in out), key=repr) == sorted(rows, key=repr)
    assert any(r.taken == 0 < r.size for r in out) and any(len(r.mix) == 2 for r in out)
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken, r.source) for r in out if r.doc_id is not None) == sorted(tuple(r) for r in mixing.report(docs).collect() if r.doc_id is not None)
    cut = 0
    for r in out:
        texts = [m.text.split() for m in r.mix]
        assert [m.epoch for m in r.mix] == list(range(1, len(texts) + 1)) and [m.taken for m in r.mix] == [len(t) for t in texts]
        assert sum(map(len, texts)) == r.taken and all(r.text.startswith(m.text) for m in r.mix)
        assert all(len(t) == r.size for t in texts[:-1])
        cut += bool(texts) and len(texts[-1]) < r.size
    assert 0 < cut <= 3
    per = lambda found: sorted(((r.doc_id, r.epoch, r.taken, r.text, r.n_chars) for r in found), key=repr)
    again = mixing.mixed(docs, block_rows=7).collect()
    assert per(mixing.unrolled(spark.read.parquet(f"{tmp_path}/mix").select(F.struct(*docs.columns).alias("_row"), "target", "mix")).collect()) == per(again)


def test_pipeline_returns_the_mix(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "epoch", "taken", "target"]
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.taken > 0 for r in out.collect())


def test_packed_fingerprints_come_back_as_written():
    import numpy as np

    from tidemark.llm import fingerprints as fp

    texts = ["", "one line", "a b c d e f\n" * 900, "ü ñ 漢字 text of words\n\nand more " * 40]
    for a in texts:
        for b in texts:
            digest, own, changed = b"\x07" * 32, fp.vector(a), fp.vector(b)
            assert fp.unpacked(fp.packed(digest, own, changed)) == (digest.hex(), fp.written(*own), fp.written(*changed))
    wide = np.array([0, 1, 2**31 - 1, 2**31, 2**32 - 1] + [5] * (fp.CELLS - 5), np.uint32), np.arange(fp.EXACT, dtype=np.uint64)
    assert fp.unpacked(fp.packed(bytes(32), (wide[1], wide[0]), fp.vector("x")))[1] == fp.written(wide[1], wide[0])
