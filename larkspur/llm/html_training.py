"""Labelled pages from templates, and the fit of the block classifier's weights on them.

Pages come in layouts with semantic elements, with class names only, with neither, as layout tables and as plain text; each block of text is
known to be content or boilerplate. fit() is a logistic regression with a ridge penalty, by Newton steps. Its outcome on the
pages of TRAINING stands as WEIGHTS in html_text.py; other seeds are held out.
"""

from __future__ import annotations

import random

import numpy as np

from larkspur.llm import html_text

#: (seed, pages) of the pages that the weights were fitted on.
TRAINING = (1, 1500)
RIDGE = 1.0

SYLLABLES = "an be ca do el fi go hu in ka lo mi no or pa qui re su ta un ve we xo ya ze éa ür ño".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def sentences(rng: random.Random, n: int) -> str:
    return " ".join(words(rng, rng.randint(4, 16)).capitalize() + rng.choice("...!?") for _ in range(n))


class Page:
    """Markup with the label of each text in it."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.labels = rng, {}

    def said(self, text: str, content: bool) -> str:
        self.labels[text] = content
        return text

    def links(self, n: int) -> str:
        """A menu; now and then one of its items is a plain sentence."""
        rng = self.rng
        items = [f"<a href='/x'>{self.said(words(rng, rng.randint(1, 3)), False)}</a>" for _ in range(n)]
        if rng.random() < 0.3:
            items.insert(rng.randint(0, n), self.said(sentences(rng, rng.randint(1, 2)), False))
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"

    def boiler(self, marked: bool) -> str:
        """A run of boilerplate: menus, notices, forms; where something marks it, adverts and teasers too."""
        rng = self.rng
        kind = rng.choice([0, 0, 1, 3, 4, 5, 6] + [2, 7, 8] * marked)
        if kind == 0:
            return self.links(rng.randint(2, 9))
        if kind == 1:
            return f"<p>{rng.choice(['&copy; ', ''])}{self.said(words(rng, rng.randint(2, 12)), False)}</p>"
        if kind == 2:
            return f"<{(tag := rng.choice(['div', 'p']))}>{self.said(sentences(rng, rng.randint(1, 3)), False)}</{tag}>"
        if kind == 3:
            return f"<form><label>{self.said(words(rng, 2), False)}</label><button>{self.said(words(rng, 1), False)}</button></form>"
        if kind == 4:
            return "".join(f"<div><a href='/y'>{self.said(words(rng, rng.randint(4, 10)), False)}</a></div>" for _ in range(rng.randint(2, 4)))
        if kind == 5:
            return f"<span>{self.said(words(rng, rng.randint(1, 3)), False)}</span>"
        if kind == 6:
            return f"<h3>{self.said(words(rng, rng.randint(1, 4)), False)}</h3>" + self.links(rng.randint(2, 6))
        if kind == 7:
            teaser = lambda: f"<h4>{self.said(words(rng, rng.randint(2, 6)), False)}</h4><p>{self.said(sentences(rng, 1), False)}</p>"
            return "".join(teaser() for _ in range(rng.randint(2, 4)))
        return "<ul>" + "".join(f"<li>{self.said(sentences(rng, 1), False)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>"

    def article(self) -> str:
        """Title, paragraphs long and short, lists, quotes, dates, references, now and then an advert in between."""
        rng = self.rng
        out = [f"<h1>{self.said(words(rng, rng.randint(3, 9)), True)}</h1>"] if rng.random() < 0.9 else []
        par = rng.choice(["p", "p", "p", "div"])
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.55:
                text = sentences(rng, rng.randint(2, 6))
                inner = self.said(text, True)
                if rng.random() < 0.2:
                    head, _, rest = text.partition(" ")
                    inner = f"<a href='/z'>{head}</a> {rest}"
                out.append(f"<{par}>{inner}</{par}>")
            elif kind < 0.64:
                out.append(f"<{par}>{self.said(sentences(rng, 1), True)}</{par}>")
            elif kind < 0.74:
                out.append(f"<{par}>{self.said(words(rng, rng.randint(1, 6)), True)}</{par}>")
            elif kind < 0.79:
                out.append(f"<{par}><a href='/q'>{self.said(words(rng, rng.randint(2, 9)), True)}</a></{par}>")
            elif kind < 0.85:
                out.append(f"<h2>{self.said(words(rng, rng.randint(1, 5)), True)}</h2>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{self.said(words(rng, rng.randint(2, 12)), True)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.96:
                out.append(f"<blockquote>{self.said(sentences(rng, rng.randint(1, 3)), True)}</blockquote>")
            else:
                mark = rng.choice(["ad", "promo box", "advert", "newsletter signup", "related"])
                out.append(f"<div class='{mark}'>{self.said(sentences(rng, 1), False)}</div>")
        return "".join(out)

    def comments(self) -> str:
        rng = self.rng
        return "".join(f"<div>{self.said(words(rng, 1), False)}<p>{self.said(sentences(rng, rng.randint(1, 3)), False)}</p></div>" for _ in range(rng.randint(1, 4)))

    def around(self, tag: str, name: str, inner: str) -> str:
        attribute = f" class='{name}'" if name else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"


def page(rng: random.Random) -> tuple[str, dict[str, bool]]:
    """(html, label of each text)."""
    p = Page(rng)
    if rng.random() < 0.05:
        return p.said(rng.choice([words(rng, rng.randint(1, 8)), sentences(rng, rng.randint(1, 4))]), True), p.labels
    layout = rng.choice(["semantic", "classes", "bare", "table"])
    marked = layout in ("semantic", "classes")
    before, after = ([p.boiler(marked) for _ in range(rng.randint(least, 3))] for least in (1, 0))
    main, comments = p.article(), p.comments() if rng.random() < 0.35 else ""
    if layout == "semantic":
        main = p.around(rng.choice(["article", "main"]), "", main)
        body = "".join(p.around(rng.choice(["nav", "header", "aside"]), "", x) for x in before) + main
        body += p.around("section", "comments", comments) if comments else ""
        body += "".join(p.around(rng.choice(["aside", "footer", "nav"]), "", x) for x in after)
    elif layout == "classes":
        body = "".join(p.around("div", rng.choice(["navbar", "top-menu", "header", "cookie-notice", "banner"]), x) for x in before)
        body += p.around("div", rng.choice(["post-content", "entry", "article-body", "story", ""]), main)
        body += p.around("div", rng.choice(["comments", "comment-list"]), comments) if comments else ""
        body += "".join(p.around("div", rng.choice(["sidebar", "footer", "related", "widget", ""]), x) for x in after)
    elif layout == "bare":
        body = "".join(f"<div>{x}</div>" for x in before) + f"<div>{main}</div>" + "".join(f"<div>{x}</div>" for x in after)
    else:
        body = f"<table><tr><td>{''.join(before)}</td><td>{main}</td></tr></table><div>{''.join(after)}</div>"
    return f"<html><head><title>t</title></head><body>{body}</body></html>", p.labels


def pages(seed: int, n: int) -> list[tuple[str, dict[str, bool]]]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]


def labelled(made: list[tuple[str, dict[str, bool]]]) -> list[tuple[list[html_text.Block], list[bool]]]:
    """Blocks of each page with their labels."""
    out = []
    for markup, labels in made:
        blocks = html_text.blocks_of(markup)
        out.append((blocks, [labels.get(b.text.removeprefix("© "), False) for b in blocks]))
    return out


def fit(made: list[tuple[str, dict[str, bool]]]) -> dict[str, float]:
    """Weights of html_text.FEATURES."""
    pairs = labelled(made)
    x = np.array([html_text.features(b) for blocks, _ in pairs for b in blocks], float)
    y = np.array([label for _, labels in pairs for label in labels], float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (y - p) - RIDGE * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        w += np.linalg.solve(curve, slope)
    return {name: round(float(v), 2) for name, v in zip(html_text.FEATURES, w, strict=True)}


def accuracy(made: list[tuple[str, dict[str, bool]]]) -> tuple[float, float, float]:
    """(share of blocks that the cut labels rightly, that the sign of the cost does, on which the two differ)."""
    n = cut = sign = differ = 0
    for blocks, labels in labelled(made):
        costs = [html_text.cost(b) for b in blocks]
        got = html_text.minimum_cut(costs, html_text.smoothness(blocks))
        for label, ours, c in zip(labels, got, costs, strict=True):
            n += 1
            cut += label == ours
            sign += label == (c >= 0)
            differ += ours != (c >= 0)
    return cut / n, sign / n, differ / n
