"""HTML extraction: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags. Each block has its word count and link
density, those of the blocks before and behind it, and marks of the elements around it: where
the page's article or main element is, if it has one (place: 1 inside, 0 outside, 0.5 on pages
without one), navigation and the like, heading, list item. Names of classes are not looked at.
A CART tree grown on the labelled table in html_training.py tells main text from the rest.

Defined cases: null or empty html gives the empty text and 0 characters; a page whose blocks
are all classified as boilerplate gives the empty text; unclosed and stray tags are tolerated;
repeated rows are extracted one by one; an empty table gives no rows; very long pages are read
whole and nothing is capped; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, by_bytes

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
#: Elements without readable text, elements inside a line of text, and containers.
SILENT = set("script style noscript template svg iframe head title textarea select button object canvas math".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = set("div section article main nav header footer aside form ul ol dl table figure dialog details fieldset menu body".split())
VOID = set("br hr img input link meta wbr area base col embed source track param".split())
APART = set("nav footer aside form dialog menu fieldset".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FEATURES = ["words", "links", "words_before", "links_before", "words_behind", "links_behind", "place", "apart", "heading", "item"]
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*.?true|display\s*:\s*none", re.I)


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """(text, own features: words, link density, place, apart, heading, item) in page order."""
    out: list[tuple[str, list[float]]] = []
    stack: list[tuple[str, bool, bool]] = []  # container, article, apart
    text: list[str] = []
    linked, in_link, silent, leaf, unseen, at = 0, 0, "", "", False, 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if words:
                article, apart = stack[-1][1:] if stack else (False, False)
                out.append((words, [words.count(" ") + 1, min(1.0, linked / len(words)), article, apart or unseen, leaf in HEADINGS, leaf in ("li", "dt", "dd", "option", "td", "th")]))
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece and not silent:
            text.append(piece)
            if in_link:
                linked += len(" ".join(entities.unescape(piece).split()))

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        close, name, attributes = bool(m[1]), m[2].lower(), m[3]
        if silent:
            if close and name == silent:
                silent = ""
            continue
        if name in SILENT:
            if not close and not attributes.endswith("/"):
                if name in ("script", "style", "textarea", "title", "noscript", "iframe"):  # raw text: only its own end tag ends it
                    end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                elif name != "head":
                    silent = name
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if close else 1
            elif name == "br":
                say(" ")
            continue
        flush()
        in_link = 0
        if name in VOID:
            continue
        if name in CONTAINERS:
            leaf, unseen = "", False
            if close:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif not attributes.endswith("/"):
                article, apart = stack[-1][1:] if stack else (False, False)
                header = name == "header" and not article
                stack.append((name, article or name in ("article", "main"), apart or name in APART or header or bool(HIDDEN.search(attributes))))
        elif close:
            leaf, unseen = "", False
        else:
            leaf, unseen = name, bool(HIDDEN.search(attributes))
    say(page[at:])
    flush()
    if not any(own[2] for _, own in out):
        for _, own in out:
            own[2] = 0.5
    return out


def features(found: list[tuple[str, list[float]]]) -> np.ndarray:
    """One row of FEATURES for each block."""
    x = np.zeros((len(found), len(FEATURES)))
    own = np.array([f for _, f in found], float).reshape(-1, 6)
    x[:, :2] = own[:, :2]
    x[1:, 2:4] = own[:-1, :2]
    x[:-1, 4:6] = own[1:, :2]
    x[:, 6:] = own[:, 2:]
    return x


class Tree:
    """CART with Gini impurity, grown until leaves are pure or as small as min_leaf; at most `cuts` thresholds of a feature are tried at a node."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12, min_leaf: int = 2, cuts: int = 40):
        self.value = float(y.mean()) if len(y) else 0.0
        self.column = -1
        if depth == 0 or len(y) < 2 * min_leaf or y.min() == y.max():
            return
        best = (np.inf, -1, 0.0)
        for column in range(x.shape[1]):
            values = np.unique(x[:, column])
            if len(values) > cuts + 1:
                values = np.unique(np.quantile(x[:, column], np.linspace(0, 1, cuts + 1), method="nearest"))
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, column] <= cut
                n, m = left.sum(), (~left).sum()
                if min(n, m) >= min_leaf:
                    p, q = y[left].mean(), y[~left].mean()
                    best = min(best, (round(n * p * (1 - p) + m * q * (1 - q), 9), column, float(cut)))
        if best[1] >= 0 and best[0] < len(y) * self.value * (1 - self.value) - 1e-9:
            self.column, self.cut = best[1:]
            left = x[:, self.column] <= self.cut
            self.low, self.high = (Tree(x[side], y[side], depth - 1, min_leaf, cuts) for side in (left, ~left))

    def splits(self) -> list[str]:
        """The features of all inner nodes."""
        return [FEATURES[self.column], *self.low.splits(), *self.high.splits()] if self.column >= 0 else []

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.column < 0:
            return np.full(len(x), self.value)
        out, left = np.empty(len(x)), x[:, self.column] <= self.cut
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


def labelled(pages: list) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages."""
    xs, ys = [], []
    for page in pages:
        found = blocks("".join(before + text + after for before, text, after, _ in page))
        labels = [label for _, text, _, label in page if text]
        if len(found) != len(labels):
            raise ValueError("a labelled page does not give a block for each label")
        xs.append(features(found))
        ys.append(labels)
    return np.concatenate(xs), np.concatenate(ys).astype(float)


@functools.lru_cache(maxsize=1)
def trained() -> Tree:
    """The tree grown on the labelled table."""
    from .html_training import pages

    return Tree(*labelled(pages()))


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """Text of the blocks that the tree takes for main text, joined by one space."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = (tree or trained()).predict(features(found)) >= 0.5
    return " ".join(t for (t, _), k in zip(found, keep) if k)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for every row; the tree is grown by the driver and goes to the tasks with the function."""
    tree = trained()
    bound_batches(pages.sparkSession)

    def run(batches):
        for batch in (part for whole in batches for part in by_bytes(whole, 2, 4 << 20)):
            texts = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "u", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h")).mapInArrow(run, "id long, u string, text string, n_chars long")
    return rows.select(F.col("id").alias(id_col), F.col("u").alias(url_col), "text", "n_chars")
