"""Main text of web pages by gradient-boosted trees over DOM-node features.

Training takes a bounded sample of pages (``sample_pages``, those with the smallest
hash of the id). Their elements are labelled by landmarks: inside or around
article and main, and not in or of a menu, header, footer, sidebar, form or an
element whose attribute words say so. Each page is taken once as it is, once with its
landmarks renamed to plain div (so that density, depth and sibling features are
learned too, under the labels of the page as it is) and once with some paragraphs moved into a comment, notice or sidebar
element at a random place. The trees are fitted on the driver and are a few kB.

Decoding is hierarchical: a dropped element drops all below it, so the labels of a
page are those of highest total log-probability among the consistent ones (one
pass up the tree, one down). Kept text blocks are joined by line feeds.

Null html counts as empty; a page without text gives an empty string; a page is
parsed whole, however long or broken; repeated rows stay; extra columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shelfwise.llm.dom import Page, features, marks


class Boosted:
    """Boosted regression trees for log-loss: each tree splits whole levels of nodes on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[list[tuple]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)])
        p0 = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(p0 / (1 - p0)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            score += np.array([v for *_, v in tree])[leaf]
        return self

    def _grow(self, binned, grad, hess):
        tree, at, level = [(-1, 0.0, 0, 0, 0.0)], np.zeros(len(grad), np.int64), [0]
        for _ in range(self.depth):
            nxt = []
            for node in level:
                rows = np.flatnonzero(at == node)
                if len(rows) < 20:
                    continue
                g, h = grad[rows], hess[rows]
                best = (1e-3, None, None)
                whole = g.sum() ** 2 / (h.sum() + self.l2)
                for f in range(binned.shape[1]):
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, g, self.bins))
                    hl = np.cumsum(np.bincount(b, h, self.bins))
                    gain = gl ** 2 / (hl + self.l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.l2) - whole
                    gain[len(self.edges[f]):] = -1
                    if (k := int(gain.argmax())) < len(self.edges[f]) and gain[k] > best[0]:
                        best = (gain[k], f, k)
                if best[1] is None:
                    continue
                _, f, k = best
                left, right = len(tree), len(tree) + 1
                tree[node] = (f, float(self.edges[f][k]), left, right, 0.0)
                tree += [(-1, 0.0, 0, 0, 0.0)] * 2
                at[rows] = np.where(binned[rows, f] <= k, left, right)
                nxt += [left, right]
            level = nxt
        for node, split in enumerate(tree):
            if split[0] < 0:
                rows = at == node
                tree[node] = (-1, 0.0, 0, 0, float(-self.rate * grad[rows].sum() / (hess[rows].sum() + self.l2)))
        return tree, at

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            feat, cut, left, right, value = (np.array(c) for c in zip(*tree))
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feat[at]
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at])
                at = np.where(f < 0, at, go)
            out += value[at]
        return out


def weak_labels(page: Page) -> np.ndarray | None:
    """1 for elements in or around the landmarked content; None where a page has no landmark."""
    boiler, content = marks(page)
    n, parent = len(page.tag), page.parent
    inside, dropped = np.zeros(n, bool), np.zeros(n, bool)
    for k in range(n):
        p = parent[k]
        dropped[k] = boiler[k] or (k > 0 and dropped[p])
        inside[k] = not dropped[k] and (content[k] and page.tag[k] in ("article", "main") or (k > 0 and inside[p]))
    if not inside.any():
        return None
    keep = inside.copy()
    for k in range(n - 1, 0, -1):
        keep[parent[k]] |= keep[k] and not dropped[parent[k]]
    return keep.astype(float)


def _variants(html: str, rng: random.Random):
    """(html, html to label): the page, the page without landmarks, the page with an added foreign element."""
    yield html, html
    plain = re.sub(r"(?i)<(/?)(article|main|nav|header|footer|aside)\b[^>]*>", r"<\1div>", html)
    yield plain, html
    words = rng.choice(["comments", "comment-list", "notice", "cookie notice", "sidebar", "related posts", "newsletter form", "share", "promo"])
    tag = rng.choice(["div", "section", "aside", "ul"])
    moved = re.findall(r"(?is)<p>[^<]{20,400}</p>", html)[:3]
    extra = f'<{tag} class="{words}">{"".join(moved) or "<p>Read more.</p>"}</{tag}>'
    places = [m.end() for m in re.finditer(r"(?i)</p>", html)] or [len(html)]
    at = rng.choice(places)
    changed = html[:at] + extra + html[at:]
    yield changed, changed


def train(pages: list[str], seed: int = 7) -> Boosted:
    rng, xs, ys = random.Random(seed), [], []
    for html in pages:
        for shown, told in _variants(html, rng):
            page, labelled = Page(shown), Page(told)
            y = weak_labels(labelled)
            if y is not None and page.parent == labelled.parent:
                xs.append(features(page))
                ys.append(y)
    if not xs:
        warnings.warn("no sampled page has a landmark (article, main or a content word): the trees learn from one page of fixed form", stacklevel=2)
        return train(["<body><nav><a href=x>menu</a></nav><article><p>Some text, of a sentence.</p></article><footer>end</footer></body>"] * 30)
    return Boosted().fit(np.vstack(xs), np.concatenate(ys))


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Most probable consistent labels: nothing below a dropped element is kept."""
    n = len(page.tag)
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best_keep, all_drop = keep.copy(), drop.copy()
    for k in range(n - 1, 0, -1):
        best_keep[page.parent[k]] += max(best_keep[k], all_drop[k])
        all_drop[page.parent[k]] += all_drop[k]
    out = np.zeros(n, bool)
    for k in range(n):
        out[k] = (k == 0 or out[page.parent[k]]) and best_keep[k] > all_drop[k]
    return out


def main_texts(htmls: list, model: Boosted, at_once: int = 200_000) -> list[str]:
    """The main text of each page; the trees see the elements of many pages at once, up to a bounded number and a page."""
    out: list[str] = []
    pages: list[Page] = []

    def flush():
        odds = model.log_odds(np.vstack([features(p) for p in pages]))
        ends = np.cumsum([len(p.tag) for p in pages])
        for page, some in zip(pages, np.split(odds, ends[:-1])):
            kept = decode(page, some)
            out.append("\n".join(t for k, t, _ in page.runs if kept[k]))
        pages.clear()

    held = 0
    for html in htmls:
        pages.append(Page(html or ""))
        held += len(pages[-1].tag) + len(html or "") // 50
        if held > at_once:
            flush()
            held = 0
    if pages:
        flush()
    return out


def main_text(html: str | None, model: Boosted) -> str:
    return main_texts([html], model)[0]


def fit(pages: DataFrame, sample_pages: int = 300, sample_chars: int = 200_000) -> Boosted:
    """The model, from at most ``sample_pages`` pages of less than ``sample_chars`` characters each, the first by the hash of their id.

    The ids are chosen first, so that no more than the chosen pages reach the driver.
    """
    fits = pages.where(F.length("html") < sample_chars).where("page_id is not null")
    ids = [r[0] for r in fits.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages).collect()]
    some = fits.where(F.col("page_id").isin(ids)).select("html").limit(sample_pages).collect()
    return train([r["html"] for r in some])


def extract(pages: DataFrame, model: Boosted | None = None, sample_pages: int = 300) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    model = model or fit(pages, sample_pages)

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series(main_texts(list(html), model), dtype=object)
    got = pages.select("page_id", "url", text("html").alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
