"""Main text of web pages: a bidirectional LSTM labels every leaf block of a page in the context of the whole page."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_batches

#: Buckets of hashed path parts and of hashed words, plain numbers of a block, and hidden units of a direction.
PATH, WORDS, PLAIN, HIDDEN = 96, 48, 6, 16
#: Pages of a fit, blocks of all of them together, and rounds over them.
SAMPLE, TRAIN_BLOCKS, EPOCHS = 160, 12_800, 24
#: Blocks with padding that are labelled or learnt at a time.
CELLS = 4096
#: Elements that hold no text, that are never closed, that run on in a line, and that end one of their own.
UNREAD = "script|style|noscript|template|svg|iframe|object|textarea"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
HOLDERS = frozenset("ul ol dl table article section div body nav aside footer header main form select".split())
#: Names by which training pages tell their main part and what surrounds it.
MAIN = frozenset("article main content post entry story".split())
AROUND = frozenset(
    "nav menu header footer aside sidebar form button select label head title ad ads advert advertisement sponsor promo banner cookie consent notice popup modal "
    "breadcrumb breadcrumbs comment comments reply related share social subscribe newsletter search login copyright widget".split()
)
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<unread>{UNREAD})\b.*?(?:</(?P=unread)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


def blocks(html: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """Path, text and linked characters of each leaf block of the whole page, in order; blocks without text are left out."""
    html = html or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out, parts, linked, at = [], [], 0, 0

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append((tuple(n for _, names in stack for n in names), text, linked))
        parts, linked = [], 0

    def said(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            linked += len(text) if any(t == "a" for t, _ in stack) else 0

    for m in _TAG.finditer(html):
        said(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            close()
        if m["end"] or m["end2"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
        elif tag not in VOID:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES.get(tag, "").split():
                    del stack[i:]
                    break
                if stack[i][0] in HOLDERS:
                    break
            names = [p.lower() for g in _NAMES.findall(m["attrs"] or m["attrs2"] or "") for p in re.split(r"[^A-Za-z0-9]+", "".join(g)) if p]
            stack.append((tag, (tag, *("." + n for n in names))))
    said(html[at:])
    close()
    return out


def features(page: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    """One vector per block: hashed parts of its path, hashed words in shares, and plain numbers."""
    x = np.zeros((len(page), PATH + WORDS + PLAIN), np.float32)
    for row, (path, text, linked) in zip(x, page):
        for part in path:
            row[zlib.crc32(part.encode()) % PATH] = 1.0
        words = text.split(" ")
        at = np.fromiter((zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
        row[PATH : PATH + WORDS] = np.bincount(at % WORDS, minlength=WORDS) / len(words)
        n = len(text)
        row[PATH + WORDS :] = (np.log1p(len(words)) / 5, min(1.0, linked / n), n / len(words) / 20, (text.count(".") + text.count(",")) / len(words), float(text[-1] in ".!?"), 1.0)
    return x


class Labeller:
    """Two LSTM passes over the blocks of a page, one from each end, and a logistic layer on both states."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        size = PATH + WORDS + PLAIN + HIDDEN
        self.w = [r.normal(0, 0.15, (size, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
        self.b = [np.zeros(4 * HIDDEN, np.float32) for _ in range(2)]
        for b in self.b:
            b[HIDDEN : 2 * HIDDEN] = 1.0
        self.v, self.c = r.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)

    def _pass(self, k: int, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        h = c = np.zeros((len(x), HIDDEN), np.float32)
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        own = x @ self.w[k][:-HIDDEN] + self.b[k]
        for t in range(x.shape[1]) if k == 0 else range(x.shape[1] - 1, -1, -1):
            z = own[:, t] + h @ self.w[k][-HIDDEN:]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g, m = np.tanh(z[:, 3 * HIDDEN :]), mask[:, t : t + 1]
            new = f * c + i * g
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, np.tanh(new), m))
            h, c = m * o * np.tanh(new) + (1 - m) * h, m * new + (1 - m) * c
            out[:, t] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        z = np.concatenate([self._pass(k, x, mask) for k in range(2)], axis=2) @ self.v + self.c
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        kept: list[list] = [[], []]
        h = np.concatenate([self._pass(k, x, mask, kept[k]) for k in range(2)], axis=2)
        p = 1 / (1 + np.exp(-np.clip(h @ self.v + self.c, -30, 30)))
        dz = ((p - y) * mask / mask.sum()).astype(np.float32)
        out = [np.einsum("bt,bth->h", dz, h), dz.sum(keepdims=True).reshape(1)]
        for k in range(2):
            dw, db = np.zeros_like(self.w[k]), np.zeros_like(self.b[k])
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            own = dz[..., None] * self.v[k * HIDDEN : (k + 1) * HIDDEN]
            for t, h0, c0, i, f, o, g, tc, m in reversed(kept[k]):
                dh = dh + own[:, t]
                up = dh * m
                d = dc * m + up * o * (1 - tc**2)
                dg = np.concatenate((d * g * i * (1 - i), d * c0 * f * (1 - f), up * tc * o * (1 - o), d * i * (1 - g**2)), axis=1)
                dw[:-HIDDEN] += x[:, t].T @ dg
                dw[-HIDDEN:] += h0.T @ dg
                db += dg.sum(axis=0)
                dh = dg @ self.w[k][-HIDDEN:].T + dh * (1 - m)
                dc = d * f + dc * (1 - m)
            out += [dw, db]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.02, batch: int = 32) -> Labeller:
        """Adam over batches of pages of like length, in an order drawn from a fixed seed."""
        weights = lambda: [self.v, self.c, self.w[0], self.b[0], self.w[1], self.b[1]]
        first, second = [np.zeros_like(w) for w in weights()], [np.zeros_like(w) for w in weights()]
        order, r, step = sorted(range(len(pages)), key=lambda j: len(pages[j])), np.random.default_rng(11), 0
        groups = []
        while order:
            taken = [order.pop()]
            while order and len(taken) < batch and (len(taken) + 1) * len(pages[taken[0]]) <= CELLS:
                taken.append(order.pop())
            groups.append(padded([pages[j] for j in taken], [labels[j] for j in taken]))
        for _ in range(epochs):
            for j in r.permutation(len(groups)):
                step += 1
                for w, g, a, b in zip(weights(), self.gradients(*groups[j]), first, second):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self


def padded(pages: list[np.ndarray], labels: list[np.ndarray] | None = None):
    x = np.zeros((len(pages), max(map(len, pages)), PATH + WORDS + PLAIN), np.float32)
    mask, y = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], np.float32)
    for j, p in enumerate(pages):
        x[j, : len(p)], mask[j, : len(p)] = p, 1.0
        if labels is not None:
            y[j, : len(p)] = labels[j]
    return (x, mask) if labels is None else (x, mask, y)


def told(path: tuple[str, ...]) -> bool:
    """Whether the names on a training block's path say that it belongs to the main part."""
    names = [p.lstrip(".") for p in path]
    inner = max((i for i, n in enumerate(names) if n in MAIN), default=-1)
    return inner >= 0 and not any(n in AROUND for n in names[inner + 1 :]) and not any(n in AROUND - {"header"} for n in names[:inner])


def varied(page: list[tuple[tuple[str, ...], str, int]], r: np.random.Generator) -> list[tuple[tuple[str, ...], str, int]]:
    """The page in another layout: main and surrounding parts under other names, so that the labeller knows them all."""
    main, around = sorted(MAIN), sorted(AROUND - {"head", "title"})
    swap: dict[str, tuple[str, ...]] = {}
    out = []
    for path, text, linked in page:
        new: list[str] = []
        for part in path:
            name = part.lstrip(".")
            if name in MAIN or name in AROUND - {"head", "title"}:
                if part not in swap:
                    other = str(r.choice(main if name in MAIN else around))
                    swap[part] = (other,) if other in ("article", "main", "nav", "aside", "footer", "header", "form") and r.random() < 0.6 else ("div", "." + other)
                new += swap[part]
            else:
                new.append(part)
        out.append((tuple(new), text, linked))
    if len(out) > 2 and r.random() < 0.5:  # a surrounding block right after or inside the main part
        j = int(r.integers(1, len(out)))
        source = out[int(r.integers(len(out)))]
        inside = out[j - 1][0] if r.random() < 0.5 else ("html", "body")
        out.insert(j, ((*inside, "div", "." + str(r.choice(around)), "p"), source[1], 0))
    return out


def trained(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """The labeller from ``sample`` pages in hash order, each as it is and twice in other layouts.

    Pages are learnt whole, so that the fit sees how they end. A page that would take the blocks of the sample over
    ``TRAIN_BLOCKS`` is left out of the fit.
    """
    rows = pages.where("html is not null").orderBy(F.xxhash64("html"), "page_id").select("html").limit(sample)
    r, x, y, left = np.random.default_rng(3), [], [], TRAIN_BLOCKS
    for (html,) in rows.toLocalIterator():
        page = blocks(html)
        if len(page) > left:
            continue
        left -= len(page)
        for layout in (page, varied(page, r), varied(page, r)):
            if layout:
                x.append(features(layout))
                y.append(np.array([told(path) for path, _, _ in layout], np.float32))
    return Labeller().fit(x, y) if x else Labeller()


def main_texts(labeller: Labeller, htmls: list[str | None], cells: int = CELLS) -> list[str]:
    """The main text of each page; pages of like length are labelled together, ``cells`` blocks with padding at a time."""
    pages = [blocks(h) for h in htmls]
    out = [""] * len(pages)
    order = sorted((j for j in range(len(pages)) if pages[j]), key=lambda j: len(pages[j]))
    while order:
        taken = [order.pop()]
        while order and (len(taken) + 1) * len(pages[taken[0]]) <= cells:
            taken.append(order.pop())
        p = labeller.probabilities(*padded([features(pages[j]) for j in taken]))
        for j, row in zip(taken, p):
            out[j] = " ".join(text for (_, text, _), q in zip(pages[j], row) if q > 0.5)
    return out


def extracted(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """``pages`` with ``_text``; nothing is shuffled."""
    spark = pages.sparkSession
    text_batches(spark)
    held = spark.sparkContext.broadcast(labeller)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield pd.Series(main_texts(held.value, [None if h is None else str(h) for h in html]), dtype=object)

    return pages.withColumn("_text", extract(F.col("html").cast("string")))


def report(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per page. Null and empty pages have no text; repeated pages are read alike."""
    rows = pages.select("page_id", "url", "html")
    return extracted(rows, trained(rows)).select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
