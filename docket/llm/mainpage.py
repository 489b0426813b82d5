"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks (runs of text between block-level tags). Features are the tags
and class or id words of a block's ancestors and simple counts over its text. A chain CRF with the labels
"main" and "other" is trained by regularised gradient steps on labelled pages, here pages made
from a grammar of common layouts, so no corpus rows are needed, or on pages that the caller labels. Viterbi decoding picks the best
sequence of labels for a whole page.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by how they break text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table div section article main body td th li blockquote form nav aside header footer figure".split())
# Text that is never shown; an element left open runs to the end of the page.
HIDDEN = "script|style|noscript|template|svg|iframe|object|canvas"
MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<({HIDDEN})(?=[\s/>])[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "path", "names", "linked")

    def __init__(self, text: str, path: tuple, names: frozenset, linked: int):
        self.text, self.path, self.names, self.linked = text, path, names, linked


def leaf_blocks(page: str) -> list[Block]:
    """The non-empty leaf blocks of a page in order: text with references decoded, white space single."""
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    run: list[str] = []
    linked = depth = 0
    where: tuple = ()

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split()) if run else ""
        if text:
            names = frozenset().union(*(n for _, n in where))
            blocks.append(Block(text, tuple(t for t, _ in where), names, linked))
        run.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked, where
        if piece:
            if not run:
                where = tuple(x for x in stack if x[0] not in INLINE)
            run.append(piece)
            if depth:
                linked += len(piece)

    at = 0
    for m in MARKUP.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag in INLINE:
                depth = max(0, depth - (tag == "a"))
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag == "br":
            add(" ")
        elif tag in INLINE:
            depth += tag == "a"
        else:
            flush()
            depth = 0
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[tag]:
                        del stack[k:]
                        break
                    if stack[k][0] in STOPS and stack[k][0] not in CLOSES[tag]:
                        break
            if tag not in VOID and not (m.group(4) or "").endswith("/"):
                names = frozenset(w for x in NAMES.findall(m.group(4) or "") for w in WORDS.findall("".join(x).lower()))
                stack.append((tag, names))
    add(page[at:])
    flush()
    return blocks


def block_features(blocks: list[Block], k: int) -> list[str]:
    """Names of the features that hold for block k."""
    b, n = blocks[k], len(blocks)
    text = b.text
    words = text.count(" ") + 1
    out = ["bias", f"tag {b.path[-1] if b.path else ''}", f"words {min(6, words.bit_length())}", f"links {min(4, 4 * b.linked // max(len(text), 1))}"]
    out += [f"in {t}" for t in {*b.path}]
    out += [f"named {w}" for w in b.names]
    out.append(f"ends {text[-1] if text[-1] in '.!?:,;|' else 'other'}")
    out.append(f"place {min(3, 4 * k // n)}")
    if k == 0 or k == n - 1:
        out.append("first" if k == 0 else "last")
    if "©" in text or "copyright" in text.lower()[:40]:
        out.append("copyright")
    return out


class ChainModel:
    """Two labels; weights for label 1 of each feature, and for each pair of neighbouring labels."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.step = np.zeros((2, 2))

    def train(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> "ChainModel":
        """AdaGrad on the conditional log-likelihood, by forward-backward over each page."""
        names = sorted({f for x, _ in pages for feats in x for f in feats})
        number = {f: k for k, f in enumerate(names)}
        coded = [([np.array([number[f] for f in feats]) for feats in x], np.array(y)) for x, y in pages if y]
        w, w2, t, t2 = np.zeros(len(names)), np.full(len(names), 1e-6), np.zeros((2, 2)), np.full((2, 2), 1e-6)
        for _ in range(rounds):
            for x, y in coded:
                e = np.array([w[f].sum() for f in x])
                n = len(e)
                fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
                fwd[0] = [0, e[0]]
                for k in range(1, n):
                    m = fwd[k - 1][:, None] + t
                    fwd[k] = np.logaddexp(m[0], m[1]) + [0, e[k]]
                for k in range(n - 2, -1, -1):
                    m = t + bwd[k + 1] + np.array([0, e[k + 1]])
                    bwd[k] = np.logaddexp(m[:, 0], m[:, 1])
                total = np.logaddexp(*fwd[-1])
                p = np.exp(fwd[:, 1] + bwd[:, 1] - total)
                g = np.zeros(len(names))
                for f, miss in zip(x, y - p):
                    g[f] += miss
                used = np.unique(np.concatenate(x))
                gt = np.zeros((2, 2))
                if n > 1:
                    np.add.at(gt, (y[:-1], y[1:]), 1)
                    late = bwd[1:] + np.stack([np.zeros(n - 1), e[1:]], 1)
                    gt -= np.exp(fwd[:-1, :, None] + t + late[:, None, :] - total).sum(0)
                g[used] -= decay * len(coded) * w[used] * 0.1
                w2[used] += g[used] ** 2
                w[used] += rate * g[used] / np.sqrt(w2[used])
                t2 += gt**2
                t += rate * gt / np.sqrt(t2)
        self.weights, self.step = dict(zip(names, w.tolist())), t
        return self

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most likely labels (Viterbi)."""
        (a, b), (c, d) = self.step.tolist()
        get, back, low, high = self.weights.get, [], 0.0, 0.0
        for k, feats in enumerate(rows):
            e = sum(get(f, 0.0) for f in feats)
            if k == 0:
                low, high = 0.0, e
                continue
            to0, to1 = (0, low + a) if low + a >= high + c else (1, high + c), (0, low + b) if low + b >= high + d else (1, high + d)
            back.append((to0[0], to1[0]))
            low, high = to0[1], to1[1] + e
        if not rows:
            return []
        label = [int(high > low)]
        for step in reversed(back):
            label.append(step[label[-1]])
        return label[::-1]


def _prose(rng: random.Random, low: int, high: int, end: bool = True) -> str:
    parts = "a the of in to and er on th re st ing ed ly le de la que ion ment der die sch ung keit el los ado con é ü ñ".split()
    line = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))
    return line.capitalize() + (rng.choice([".", ".", ".", ".", "!", "?", "", "&amp;&amp;", " %%%", "***"]) if end else "")


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, str]]:
    """(html, main text) of n pages from a grammar of layouts: what stands in the main column is the article."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        main: list[str] = []

        def block(tag: str, low: int, high: int, attr: str = "", keep: bool = False, close: bool = True) -> str:
            text = _prose(rng, low, high, end=keep or rng.random() < 0.5)
            if keep:
                main.append(html.unescape(text))
            if rng.random() < 0.2:
                text = text.replace(" ", rng.choice([" <b>", " <em>", " <i>"]), 1) + "</b></em></i>" if " " in text else text
            return f"<{tag}{attr}>{text}" + (f"</{tag}>" if close else "")

        def links(k: int) -> str:
            return "<ul>" + "".join(f'<li><a href="/x">{_prose(rng, 1, 3, False)}</a></li>' for _ in range(k)) + "</ul>"

        def aside(kind: str, *names: str) -> str:
            attr = f' {rng.choice(["class", "id"])}="{rng.choice(names)}"'
            tag = rng.choice([kind, "div"])
            inner = rng.choice([lambda: _prose(rng, 3, 30), lambda: block("p", 3, 40), lambda: links(rng.randint(2, 6)), lambda: block("h3", 1, 4) + block("p", 5, 30)])()
            return f"<{tag}{attr}>{inner}</{tag}>"

        before = [
            lambda: "<nav>" + links(rng.randint(2, 8)) + "</nav>",
            lambda: aside("header", "header", "masthead", "top banner", "site-header"),
            lambda: aside("div", "nav", "menu", "breadcrumb", "navbar", "topbar"),
            lambda: aside("div", "ad", "ads", "advert", "sponsored", "banner ad", "promo"),
            lambda: aside("div", "cookie notice", "cookies", "notice", "consent", "alert", "gdpr", "newsletter"),
        ]
        after = [
            lambda: aside("aside", "sidebar", "related", "widget", "side", "recommended", "share social"),
            lambda: "<aside>" + block("h3", 1, 4) + rng.choice([links(4), block("p", 4, 40)]) + "</aside>",
            lambda: aside("section", "comments", "comment", "discussion", "replies", "disqus")
            .replace("</p>", "</p>" + block("p", 4, 60), 1),
            lambda: '<div class="comments"><h3>Comments</h3>' + "".join('<div class="comment">' + block("p", 3, 50) + "</div>" for _ in range(rng.randint(1, 5))) + "</div>",
            lambda: '<section id="comments">' + "".join(block("p", 3, 50) for _ in range(rng.randint(1, 5))) + "</section>",
            lambda: "<form><label>" + _prose(rng, 1, 4) + '</label><input name="q"><button>' + _prose(rng, 1, 2) + "</button></form>",
            before[3], before[4],
        ]
        kind = rng.random()
        if kind < 0.03:  # text alone, or hardly a tag
            text = block("p", 1, 60, keep=True)
            out.append((rng.choice([re.sub("<[^>]*>", "", text), text, "<html><body>" + re.sub("<[^>]*>", "", text) + "</body></html>"]), " ".join(" ".join(x.split()) for x in main)))
            continue
        if kind < 0.1:  # columns that nothing names
            column = "".join(block("p", 3, 90, keep=True) for _ in range(rng.randint(1, 6)))
            side = rng.choice([lambda: links(rng.randint(2, 8)), lambda: "".join(f'<p><a href="/x">{_prose(rng, 1, 4, False)}</a></p>' for _ in range(rng.randint(2, 6)))])
            cells = [f"<div>{side()}</div>" if rng.random() < 0.4 else "", f"<div>{column}</div>", f"<div>{side()}</div>" if rng.random() < 0.8 else ""]
            out.append((rng.choice(["<div>{}</div>", "<html><body>{}</body></html>", "<html><body><div>{}</div></body></html>"]).format("".join(cells)), " ".join(" ".join(x.split()) for x in main)))
            continue
        controls = lambda: rng.choice([  # noqa: E731  (of no form)
            f"<textarea>{_prose(rng, 1, 6, False)}</textarea>", f"<button>{_prose(rng, 1, 3, False)}</button>", f"<select><option>{_prose(rng, 1, 2, False)}</option><option>{_prose(rng, 1, 2, False)}</option></select>",
            f"<label>{_prose(rng, 1, 3, False)}</label><textarea>{_prose(rng, 1, 5, False)}</textarea><button>{_prose(rng, 1, 2, False)}</button>", f"<fieldset><legend>{_prose(rng, 1, 3, False)}</legend><label>{_prose(rng, 1, 3, False)}</label></fieldset>",
        ])
        boxes = [before[3], before[4], after[0], after[2], after[3], after[4], after[5], controls, lambda: aside("div", "newsletter", "subscribe", "signup box", "share", "social", "related")]
        bare = rng.random() < 0.1  # a page that is nothing but its article
        body = "" if bare else "".join(rng.choice(before)() for _ in range(rng.randint(0, 3)))
        if not bare and rng.random() < 0.6:
            body = "<nav>" + links(rng.randint(2, 7)) + "</nav>" + body
        opaque = "".join(rng.choice("abcdefghjkmnxyz") for _ in range(rng.randint(1, 3))) + str(rng.randint(0, 99))
        plain = [(f'<div class="{opaque}">', "</div>"), (f'<div id="{opaque}">', "</div>"), ("<div>", "</div>"), (f'<table><tr><td class="{opaque}">', "</td></tr></table>"), (f'<section><div class="{opaque}">', "</div></section>"), ("", "")]
        wrap = rng.choice(plain) if rng.random() < 0.3 else rng.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="article">', "</div>"), ('<div class="post entry"><section>', "</section></div>"), ('<div class="story body text">', "</div>")])
        body += wrap[0] + (block("h1", 2, 12, keep=True) if rng.random() < (0.5 if bare else 0.85) else "")
        for _ in range(rng.randint(0, 9)):
            body += rng.choice([
                lambda: block("p", 1, 90, keep=True, close=rng.random() < 0.8), lambda: block("p", 1, 90, keep=True), lambda: block("p", 1, 8, keep=True),
                lambda: block("h2", 1, 8, keep=True), lambda: "<ul>" + "".join(block("li", 1, 20, keep=True) for _ in range(rng.randint(1, 4))) + "</ul>",
                lambda: block("blockquote", 4, 40, keep=True), lambda: "<p>" + block("b", 2, 20, keep=True).replace("</b>", "<br>"), lambda: block("pre", 2, 20, keep=True),
                lambda: "<table><tr>" + block("td", 1, 5, keep=True) + block("td", 1, 5, keep=True) + "</tr></table>",
            ])()
            if rng.random() < 0.06:
                body += rng.choice(boxes)()
        if rng.random() < 0.25:  # what follows the article inside its own column
            body += "".join(rng.choice(boxes)() for _ in range(rng.randint(1, 2)))
        body += wrap[1] + (controls() if rng.random() < 0.1 else "") + ("" if bare else "".join(rng.choice(after)() for _ in range(rng.randint(0, 3))))
        if not bare and rng.random() < 0.85:
            body += rng.choice(["<footer>", '<div class="footer">', '<div id="footer">']) + f"&copy; {_prose(rng, 1, 14)} &middot; {_prose(rng, 1, 12)}" + rng.choice(["</footer>", "</div>"])
        head = f"<!DOCTYPE html><html><head><title>{_prose(rng, 2, 10)}</title><style>p{{}}</style></head><body>"
        out.append((head + body + "</body></html>", " ".join(" ".join(x.split()) for x in main)))
    return out


@lru_cache(1)
def default_model() -> ChainModel:
    """Trained on labelled_pages(): a block is main if its text is what comes next in the page's main text."""
    data = []
    for page, text in labelled_pages():
        blocks, labels, at = leaf_blocks(page), [], 0
        for b in blocks:
            hit = text.startswith(b.text, at) and text[at + len(b.text) : at + len(b.text) + 1] in ("", " ")
            labels.append(int(hit))
            at += (len(b.text) + 1) * hit
        data.append(([block_features(blocks, k) for k in range(len(blocks))], labels))
    return ChainModel().train(data)


def main_text(page: str, model: ChainModel) -> str:
    blocks = leaf_blocks(page)
    labels = model.decode([block_features(blocks, k) for k in range(len(blocks))])
    return " ".join(b.text for b, label in zip(blocks, labels) if label)


def extract_main(pages: DataFrame, model: ChainModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text (empty if none), n_chars.

    A null page is empty and has empty text; other columns are ignored; repeated rows and rows without an id are extracted each; a
    page without tags is one block. Nothing is cut, however long the page.
    """
    model = model or default_model()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py() or "", model) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], schema=schema)

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
