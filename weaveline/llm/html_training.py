"""Labelled blocks for the decision tree: (markup before, text, markup behind, 1 for main text).

A table built by rule, written for this repository: pages of many shapes from a fixed seed. A row
without text only places markup. No class or identifier is set, so nothing can be learned from
names. Shapes with an article or main element and shapes of bare divisions and table cells, where
only word counts, link densities and the blocks around tell what is what, come equally often.
"""

from __future__ import annotations

import random

WORDS = "the council agreed to repair an old bridge over river after years of letters from people who live on both its banks and use it daily in spring while others would rather wait until autumn".split()


def _say(rng: random.Random, low: int, high: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))).capitalize()


def _link(rng: random.Random, low: int = 1, high: int = 3) -> str:
    return f'<a href="/{rng.choice(WORDS)}">{_say(rng, low, high)}</a>'


def _links(rng: random.Random, tag: str, n: int) -> list:
    """n blocks that are links, or one block of n links."""
    if rng.random() < 0.3:
        return [("<div>", " | ".join(_link(rng) for _ in range(n)), "</div>", 0)]
    rows = [("<li>", _link(rng, 1, 6), "</li>", 0) for _ in range(n)]
    return [(f"<{tag}><ul>", "", "", 0), *rows, ("", "", f"</ul></{tag}>", 0)]


def _article(rng: random.Random) -> list:
    rows = [("<h1>", _say(rng, 3, 12), "</h1>", 1)] if rng.random() < 0.5 else [("<p>", _say(rng, 9, 60), "</p>", 1)]
    if rng.random() < 0.3:
        rows.append(("<p>", _say(rng, 2, 6), "</p>", 1))
    for _ in range(rng.randint(3, 14)):
        kind = rng.random()
        if kind < 0.15:
            rows.append(("<p>", _say(rng, 1, 8), rng.choice(["</p>", ""]), 1))
        elif kind < 0.5:
            rows.append(("<p>", _say(rng, 9, 40), rng.choice(["</p>", ""]), 1))
        elif kind < 0.8:
            rows.append(("<p>", f"{_say(rng, 30, 120)}<br>{_say(rng, 5, 30)}", "</p>", 1))
        elif kind < 0.88:
            rows.append(("<p>", f"{_say(rng, 12, 60)} {_link(rng)} {_say(rng, 3, 20)}", "</p>", 1))
        elif kind < 0.94:
            rows.append((rng.choice(["<h2>", "<h3>"]), _say(rng, 2, 7), "</h2>", 1))
        else:
            rows += [("<ul><li>", _say(rng, 2, 20), "</li>", 1), ("<li>", _say(rng, 2, 20), "</li></ul>", 1)]
    return [*rows, ("<p>", _say(rng, 9, 60), "</p>", 1)]


def _comments(rng: random.Random, tag: str) -> list:
    rows = [(f"<{tag}><h3>", _say(rng, 1, 2), "</h3>", 0)]
    for _ in range(rng.randint(1, 5)):
        rows += [("<div>", _link(rng, 1, 2), "</div>", 0), ("<p>", _say(rng, 3, 30), "</p>", 0)]
    return [*rows, ("", "", f"</{tag}>", 0)]


def _page(rng: random.Random) -> list:
    own = rng.choice(["article", "main", "", ""])  # the element that holds the article
    frame = rng.choice(["div", "section", "td"]) if not own else own
    apart = lambda tag: tag if rng.random() < (0.7 if own else 0.3) else "div"
    page = []
    if rng.random() < 0.2:
        page.append(("<div><p>", _say(rng, 10, 25), "</p></div>", 0))  # a notice
    page += _links(rng, apart("nav"), rng.randint(3, 9))
    if rng.random() < (0.6 if own else 0.2):
        page.append(("<div>", _say(rng, 3, 12), "</div>", 0))  # an advert
    if rng.random() < 0.2:
        page.append(("<div>", " ".join(_link(rng) for _ in range(3)), "</div>", 0))  # where the page lies
    page += [(f"<{frame}>", "", "", 0), *_article(rng)]
    if rng.random() < 0.3:
        page += _links(rng, "div", rng.randint(2, 5))  # where to share it
    if not own and rng.random() < 0.15:
        page += _comments(rng, "section")
    page.append(("", "", f"</{frame}>", 0))
    if rng.random() < 0.4:
        page += [(f"<{(tag := apart('aside'))}><h3>", _say(rng, 1, 3), "</h3>", 0), *_links(rng, "div", rng.randint(2, 6)), ("", "", f"</{tag}>", 0)]
    if rng.random() < 0.2:
        page.append(("<form><p>", _say(rng, 4, 16), "</p></form>", 0))
    if rng.random() < 0.3:
        page += _comments(rng, "section")
    if rng.random() < 0.85:
        tag = apart("footer")
        page.append((f"<{tag}>", f"&copy; {_say(rng, 3, 20)} {_link(rng) if rng.random() < 0.4 else ''}", f"</{tag}>", 0))
    return page


def pages(n: int = 400, seed: int = 7) -> list:
    rng = random.Random(seed)
    return [_page(rng) for _ in range(n)]
