"""Main text of web pages: boosted trees over DOM nodes, decoded as a hierarchy.

Every block element and text run is a node with features: text, links and
density of its subtree, depth, place among its siblings and on the page, and
learned weights of its attribute tokens and those on its path. Gradient-boosted
trees give each node the log odds that it holds main text. Decoding picks the
best consistent set: a node may be kept only if its parent is, so the value of
a subtree is its own log odds and the positive values below it (one pass from
the leaves, exact), and no kept run stands in a rejected ancestor.

The model is fitted on the driver from a bounded sample: ``SAMPLE_PAGES`` pages
of the table (those of the smallest hashes of page_id, at most ``SAMPLE_CHARS``
long; rows of one id by the digest of their html, so that reruns agree)
whose single article or main element marks the main text, and
``DRAWN_PAGES`` pages drawn from a grammar of page layouts filled with the
sample's words (at most ``SAMPLE_WORDS`` different ones, those of the smallest
digests; parameters ``sample_words``, ``sample_pages``, ``sample_chars``). All pages are extracted whole, in one pass without a shuffle.

Text: character references decoded, white space within a block made one
space, blocks joined by one space in page order.

Defined results: null or empty html gives an empty text; a page without main
text gives an empty text; repeated rows and repeated or null ids keep their rows.
"""
from __future__ import annotations

import hashlib
import random
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings, text_batches
from .dom import TEXT, Page, parse

SAMPLE_PAGES = 200
SAMPLE_CHARS = 50_000
SAMPLE_WORDS = 20_000
DRAWN_PAGES = 500
N_FEATURES = 22
PARENT_SHARE, PARENT_LIMIT = 1.0, 4.0


# ---- features -------------------------------------------------------------

def features(page: Page, weights: dict[str, float]) -> np.ndarray:
    """(nodes, N_FEATURES)."""
    n = len(page.tag)
    parent, text = page.parent, page.text
    size = [len(t) for t in text]
    linked = list(page.linked)
    stops = [t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in text]
    below, runs, children, longest = [0] * n, [0] * n, [0] * n, list(size)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        size[p] += size[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
        below[p] += below[i] + 1
        runs[p] += runs[i] + (page.tag[i] == TEXT)
        children[p] += 1
        longest[p] = max(longest[p], longest[i])
    depth, rank, before = [0] * n, [0] * n, [0] * n
    own_low, own_high, path_low, path_high = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    seen, passed = [0] * n, 0
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        rank[i] = seen[p]
        seen[p] += 1
        before[i] = passed
        passed += len(text[i])
        low = high = 0.0
        for t in page.tokens[i]:
            w = weights.get(t, 0.0)
            low, high = min(low, w), max(high, w)
        own_low[i], own_high[i] = low, high
        path_low[i], path_high[i] = min(path_low[p], low), max(path_high[p], high)
    size, linked, stops, below, runs, children, longest, depth, rank, before, own_low, own_high, path_low, path_high = (
        np.array(x, dtype=np.float64) for x in (size, linked, stops, below, runs, children, longest, depth, rank, before,
                                                own_low, own_high, path_low, path_high))
    up = np.maximum(np.array(parent), 0)
    total = max(size[0], 1.0)
    share = linked / np.maximum(size, 1)
    words = np.array([t.count(" ") + 1 if t else 0 for t in text], dtype=np.float64)
    x = np.stack([
        np.log1p(size), share, np.log1p(below), np.log1p(size / (below + 1)), depth,
        rank / np.maximum(children[up], 1), np.log1p(children[up]), np.log1p(children),
        stops / np.maximum(size, 1) * 100, size / total, before / total, np.log1p(longest), np.log1p(runs),
        np.log1p(words), own_low, own_high, path_low, path_high,
        np.log1p(size[up]), share[up], own_low[up] + own_high[up],
        np.array([t == TEXT for t in page.tag], dtype=np.float64)], axis=1)
    return x


# ---- boosted trees ---------------------------------------------------------

@dataclass(frozen=True)
class Trees:
    """Complete binary trees: inner nodes test feature > threshold."""
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48,
          ridge: float = 1.0) -> Trees:
    """Logistic gradient boosting with histogram splits."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    cell = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    rate_y = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(rate_y / (1 - rate_y)))
    score = np.full(n, base)
    inner = 2**depth - 1
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-6)
            for j in range(d):
                k = len(edges[j])
                if k == 0:
                    continue
                flat = local * (k + 1) + cell[:, j]
                left_g = np.cumsum(np.bincount(flat, g, width * (k + 1)).reshape(width, k + 1), axis=1)
                left_h = np.cumsum(np.bincount(flat, h, width * (k + 1)).reshape(width, k + 1), axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = (left_g**2 / (left_h + ridge) + (all_g - left_g)**2 / (all_h - left_h + ridge)
                        - all_g**2 / (all_h + ridge))[:, :-1]
                cut = gain.argmax(axis=1)
                better = np.flatnonzero(gain[np.arange(width), cut] > best)
                best[better] = gain[better, cut[better]]
                feature[first + better] = j
                threshold[first + better] = edges[j][cut[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        local = at - inner
        leaf = rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + ridge)
        score += leaf[local]
        trees.append((feature, threshold, leaf))
    return Trees(*(np.stack(t) for t in zip(*trees)), base)


# ---- training pages --------------------------------------------------------

REJECTED_IN_MAIN = frozenset("nav aside footer form button".split())


def marked_nodes(page: Page, is_main) -> np.ndarray:
    """1 for nodes whose subtree holds a main run; ``is_main(node)`` marks the tops of main text,
    and REJECTED_IN_MAIN elements hold none."""
    n = len(page.tag)
    inside, y = [False] * n, np.zeros(n)
    for i in range(1, n):
        inside[i] = (inside[page.parent[i]] or is_main(i)) and page.tag[i] not in REJECTED_IN_MAIN
        if inside[i] and page.tag[i] == TEXT:
            y[i] = 1
    for i in range(n - 1, 0, -1):
        y[page.parent[i]] = max(y[page.parent[i]], y[i])
    return y


def silver(page: Page) -> np.ndarray | None:
    """Labels of a page whose only article (or else only main) element holds the main text."""
    for tag in ("article", "main"):
        if page.tag.count(tag) == 1:
            return marked_nodes(page, lambda i: page.tag[i] == tag)
    return None


MAIN_TOPS = ("article", "main", "div class=content", "div id=content", "div class=post", "div class='post-body'",
             "div class='entry-content'", "div class='article-body'", "div class='story-text'", "div id='main-content'",
             "section class=article", "div role=main", "div class=text", "div", "section", "td")
WRAPPERS = ("div class=wrapper", "div class=container", "div id=page", "div class=row", "div", "section class=layout", "body")
ADS = ("div class=ad", "div class='ad-slot'", "div class=ads", "div class=advert", "div class=advertisement",
       "div class='sponsored promo'", "div id='banner-ad'", "aside class=ad", "div class=promo", "section class=sponsor")
NOTICES = ("div class='cookie-notice'", "div id='cookie-banner'", "div class='gdpr consent'", "div class=notice",
           "div class=alert", "div class='popup modal'", "div class=banner", "section class=cookies", "div role=alert")
MENUS = ("nav", "nav class=menu", "div class='nav navbar'", "ul class=menu", "div id=navigation", "nav class=breadcrumb",
         "div class=breadcrumbs", "div class='top-menu'", "div role=navigation", "div class='pagination pager'")
HEADERS = ("header", "header class='site-header'", "div id=header", "div class=masthead", "div class='top-bar'", "div class=logo",
           "div role=banner")
FOOTERS = ("footer", "footer class='site-footer'", "div id=footer", "div class=copyright", "div class='footer-links'",
           "div role=contentinfo")
SIDES = ("aside", "aside class=sidebar", "div class=sidebar", "div id=sidebar", "div class='widget recent-posts'", "div class=related",
         "div class='related-articles recommended'", "section class='more-stories'", "div class='tags tag-cloud'",
         "div class='share social'", "div role=complementary")
FORMS = ("form", "form class=search", "form class='newsletter subscribe'", "form id=login", "div class='newsletter signup'")
REMARKS = ("div class=comments", "section id=comments", "div class='comment-list'", "ol class=commentlist", "div class='reader-comments'",
           "section class=discussion", "div class=replies", "div id=disqus", "div class=reviews", "section class=responses")


class Drawer:
    """Draws labelled pages: main text carries the attribute id=0x0 marks only inside this class."""

    def __init__(self, words: list[str], seed: int = 7):
        self.r, self.words = random.Random(seed), words

    def prose(self, low: int, high: int) -> str:
        w = [self.r.choice(self.words) for _ in range(self.r.randint(low, high))]
        for i in range(self.r.randint(6, 14), len(w), self.r.randint(7, 15)):
            w[i - 1] += self.r.choice(".,.")
        return " ".join(w) + ("." if self.r.random() < 0.7 else "")

    def wrap(self, top: str, inner: str) -> str:
        return f"<{top}>{inner}</{top.split()[0]}>"

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.prose(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def boilerplate(self, kinds) -> str:
        top = self.r.choice(kinds)
        if kinds is MENUS:
            inner = self.links(self.r.randint(2, 9))
        elif kinds is HEADERS:
            inner = self.r.choice([f"<a href=/>{self.prose(1, 3)}</a>", f"<h1>{self.prose(1, 4)}</h1><p>{self.prose(2, 9)}</p>",
                                   self.prose(1, 6), self.links(4)])
        elif kinds is FOOTERS:
            inner = self.r.choice([f"&copy; {self.prose(2, 25)}", f"<p>{self.prose(4, 30)}</p>" + self.links(4), self.links(6)])
        elif kinds is SIDES:
            inner = self.r.choice([f"<h3>{self.prose(1, 3)}</h3>" + self.links(5), f"<p>{self.prose(4, 30)}</p>",
                                   "".join(f"<div><a href=#>{self.prose(3, 9)}</a><p>{self.prose(5, 20)}</p></div>" for _ in range(3))])
        elif kinds is FORMS:
            inner = f"<label>{self.prose(1, 4)}</label><input name=q><button>{self.prose(1, 2)}</button>" + self.r.choice(
                ["", f"<p>{self.prose(3, 15)}</p>"])
        elif kinds is REMARKS:
            item = "li" if top.startswith("ol") else "div class=comment"
            inner = f"<h3>{self.prose(1, 3)}</h3>" + "".join(
                self.wrap(item, f"<b>{self.prose(1, 2)}</b><p>{self.prose(3, 60)}</p>") for _ in range(self.r.randint(1, 5)))
        else:
            inner = self.r.choice([self.prose(2, 30), f"<p>{self.prose(3, 30)}</p>", f"<a href=#>{self.prose(2, 8)}</a>",
                                   f"<p>{self.prose(3, 12)}</p><button>{self.prose(1, 2)}</button>"])
        return self.wrap(top, inner)

    def block(self) -> str:
        r = self.r.random()
        if r < 0.62:
            body = self.prose(1, 3) if self.r.random() < 0.15 else self.prose(5, 90)
            if self.r.random() < 0.25:
                body = f"<b>{body}<br>" if self.r.random() < 0.5 else f"{body} <a href=x>{self.prose(1, 6)}</a> {self.prose(1, 9)}"
            return f"<p>{body}</p>" if self.r.random() < 0.8 else f"<p>{body}"
        if r < 0.74:
            return f"<h2>{self.prose(1, 9)}</h2>"
        if r < 0.83:
            return "<ul>" + "".join(f"<li>{self.prose(1, 20)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>"
        if r < 0.88:
            return f"<blockquote>{self.prose(5, 40)}</blockquote>"
        if r < 0.92:
            return "<table>" + "".join(f"<tr><td>{self.prose(1, 3)}</td><td>{self.prose(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div>{self.prose(5, 60)}</div>"

    def page(self) -> str:
        """A page whose main top is marked by a data attribute, which the features never see."""
        r = self.r
        title = r.choice(["", f"<h1>{self.prose(2, 12)}</h1>", f"<h1>{self.prose(2, 12)}</h1>",
                          f"<header><h1>{self.prose(2, 12)}</h1></header>"])
        blocks = [f"<i0>{title}</i0>" if title else ""] + [f"<i0>{self.block()}</i0>" for _ in range(r.choice([1, 2, 3, 5, 8, 13, 20] * 3 + [150]))]
        for kinds, share in ((ADS, 0.25), (SIDES, 0.15), (FORMS, 0.1)):
            if r.random() < share:
                blocks.insert(r.randint(1, len(blocks)), self.boilerplate(kinds))
        inside = r.random() < 0.3
        if inside and r.random() < 0.6:
            blocks.append(self.boilerplate(REMARKS))
        top = r.choice(MAIN_TOPS[:2]) if r.random() < 0.4 else r.choice(MAIN_TOPS)
        main = self.wrap(top, "".join(blocks))
        if top == "td":
            main = f"<table><tr>{main}</tr></table>"
        if r.random() < 0.08:  # a bare fragment
            return main
        before = [self.boilerplate(k) for k, share in ((NOTICES, 0.3), (HEADERS, 0.5), (MENUS, 0.7), (ADS, 0.4), (FORMS, 0.15))
                  if r.random() < share]
        after = [self.boilerplate(k) for k, share in ((REMARKS, 0.35), (SIDES, 0.4), (ADS, 0.2), (MENUS, 0.15), (FOOTERS, 0.7),
                                                      (NOTICES, 0.15), (FORMS, 0.1)) if r.random() < share]
        r.shuffle(before)
        if r.random() < 0.3 and after:
            before.append(after.pop(0))
        for _ in range(r.choice([0, 0, 1, 2])):
            main = self.wrap(r.choice(WRAPPERS), main)
        return "<html><body>" + "".join(before) + main + "".join(after) + "</body></html>"


def drawn(source: str) -> tuple[Page, np.ndarray]:
    """A drawn page and its labels; the marks around main blocks leave no trace in the page."""
    marked = parse(source)
    y = marked_nodes(marked, lambda i: marked.tag[i] == "i0")
    keep = [i for i, t in enumerate(marked.tag) if t != "i0"]
    place = {old: new for new, old in enumerate(keep)}

    def above(i: int) -> int:
        p = marked.parent[i]
        while p >= 0 and marked.tag[p] == "i0":
            p = marked.parent[p]
        return place.get(p, -1)

    return Page([marked.tag[i] for i in keep], [above(i) for i in keep], [marked.tokens[i] for i in keep],
                [marked.text[i] for i in keep], [marked.linked[i] for i in keep]), y[keep]


def token_weights(pages: list[tuple[Page, np.ndarray]], smooth: float = 4.0) -> dict[str, float]:
    """Log odds of each attribute token that elements carrying it hold main text, against all elements."""
    seen: dict[str, list[float]] = {}
    for page, y in pages:
        for tokens, label in zip(page.tokens, y):
            for t in tokens:
                c = seen.setdefault(t, [0.0, 0.0])
                c[int(label)] += 1
    kept = sum(c[1] for c in seen.values()) / max(sum(c[0] + c[1] for c in seen.values()), 1)
    kept = min(max(kept, 0.01), 0.99)
    return {t: float(np.log((c[1] + smooth * kept) / (c[0] + smooth * (1 - kept))) - np.log(kept / (1 - kept)))
            for t, c in seen.items()}


@dataclass(frozen=True)
class Extractor:
    weights: dict[str, float]
    trees: Trees

    def texts(self, sources: list[str]) -> list[str]:
        pages = [parse(s) for s in sources]
        if not pages:
            return []
        odds = self.trees.log_odds(np.concatenate([features(p, self.weights) for p in pages]))
        out, at = [], 0
        for p in pages:
            out.append(decode(p, odds[at:at + len(p.tag)]))
            at += len(p.tag)
        return out


def decode(page: Page, odds: np.ndarray) -> str:
    """Text of the best set of nodes in which every kept node's parent is kept.

    A node's own log odds count with a share of its parent's, so that one block among many like it is not lost."""
    n = len(page.tag)
    up = np.clip(odds[np.maximum(page.parent, 0)], -PARENT_LIMIT, PARENT_LIMIT)
    up[[p <= 0 for p in page.parent]] = 0
    value = (odds + PARENT_SHARE * up).tolist()
    for i in range(n - 1, 0, -1):
        if value[i] > 0:
            value[page.parent[i]] += value[i]
    kept, blocks = [True] + [False] * (n - 1), []
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and value[i] > 0
        if kept[i] and page.tag[i] == TEXT:
            blocks.append(page.text[i])
    return " ".join(blocks)


PLAIN_WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which".split()


def sampled_words(texts: Iterable[str], limit: int = SAMPLE_WORDS) -> list[str]:
    """The different words of all texts, sorted; beyond ``limit`` those of the smallest digests."""
    words = {w for t in texts for w in t.split()}
    if len(words) > limit:
        words = sorted(words, key=lambda w: (hashlib.md5(w.encode()).digest(), w))[:limit]
    return sorted(words)


def train(sample: list[str], drawn_pages: int = DRAWN_PAGES, sample_words: int = SAMPLE_WORDS) -> Extractor:
    """Fit token weights and trees on the sample's marked pages and on drawn ones."""
    marked = [(p, y) for p in map(parse, sample) if (y := silver(p)) is not None]
    drawer = Drawer(sampled_words((t for p, _ in marked for t in p.text), sample_words) or PLAIN_WORDS)
    pages = marked + [drawn(drawer.page()) for _ in range(drawn_pages)]
    weights = token_weights(pages)
    x = np.concatenate([features(p, weights)[1:] for p, _ in pages])
    y = np.concatenate([y[1:] for _, y in pages])
    return Extractor(weights, boost(x, y))


def sampled(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> list[str]:
    """At most ``sample_pages`` different pages of at most ``sample_chars`` characters, the same whatever the order of rows."""
    rows = pages.where(F.col("page_id").isNotNull()).select("page_id", "html")
    place = F.xxhash64("page_id")
    ids = [r[0] for r in rows.select("page_id").distinct().orderBy(place, "page_id").limit(sample_pages).collect()]
    short = rows.where(F.col("page_id").isin(ids) & (F.length("html") <= sample_chars))
    # at most sample_pages short pages a task, then in all
    best = short.orderBy(place, "page_id", F.md5("html")).limit(sample_pages)
    return sorted({r["html"] for r in best.collect()})


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS,
        sample_words: int = SAMPLE_WORDS) -> Extractor:
    """Model from a bounded, repeatable sample of the table."""
    return train(sampled(pages, sample_pages, sample_chars), sample_words=sample_words)


def extract(pages: DataFrame, *keep: str, model: Extractor | None = None) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of every whole page."""
    spark = pages.sparkSession
    text_batches(spark, 256)
    shared = spark.sparkContext.broadcast(model or fit(pages))

    @F.arrow_udf("string")
    def main_text(html: pa.Array) -> pa.Array:
        return pa.array(shared.value.texts(strings(html)), type=pa.string())

    return (pages.select(*keep, main_text(F.col("html")).alias("text"))
            .select(*keep, "text", F.length("text").cast("long").alias("n_chars")))
