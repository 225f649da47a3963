"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A leaf block is the text between two block-level boundaries of the document
tree.  Its features are the tags and class words of its ancestors and properties
of its text; neighbouring labels are tied by transition weights.  The weights
are fitted to labelled pages (``labelled_pages`` builds them from a seed, in
many layouts) by gradient ascent on the conditional likelihood, and Viterbi
picks each page's labels.  Blocks labelled as article text are joined in order.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul head title".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text; that of every other element is read, shown or not.
RAW_TAGS = frozenset(("script", "style"))
#: A start tag of the key closes open elements of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head", "title"}}
SCOPES = frozenset("ul ol dl table select article section aside nav header footer main div body html form".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
#: Class and id words that are features; others only count as unknown.
CLASS_WORDS = frozenset(
    "article post entry content story body text main page ad ads advert advertisement banner sponsor sponsored promo nav navigation menu breadcrumb breadcrumbs header masthead footer foot "
    "sidebar side aside widget related recommended popular comment comments reply replies disqus discussion cookie cookies consent notice notices gdpr popup modal share social subscribe newsletter signup "
    "login search form copyright legal tags meta byline author date caption pagination pager toolbar toc skip links list".split()
)


def _classes(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    return frozenset(w for m in ATTRIBUTE.finditer(attributes) for w in WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()) if w in CLASS_WORDS)


class Block:
    __slots__ = ("text", "tags", "words", "linked", "inner")

    def __init__(self, text: str, tags: frozenset[str], words: frozenset[str], linked: float, inner: str):
        self.text, self.tags, self.words, self.linked, self.inner = text, tags, words, linked, inner


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order; scripts, styles, comments of the markup, the head and empty blocks are left out.

    Broken markup is taken as browsers do: open paragraphs end at the next block,
    an end tag without a start is ignored, and what is still open ends with the page.
    """
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    links = [0, 0]  # characters inside and outside links
    depth = 0  # of open links

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tags = frozenset(t for t, _ in stack)
                if "head" not in tags and "title" not in tags:
                    inner = next((t for t, _ in reversed(stack) if t in BLOCK_TAGS), "")
                    out.append(Block(text, tags, frozenset().union(*(w for _, w in stack)), links[0] / max(1, sum(links)), inner))
            parts = []
        links[0] = links[1] = 0

    def say(raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            links[0 if depth else 1] += len(text)

    def close(names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        nonlocal depth
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                flush()
                depth -= sum(t == "a" for t, _ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3])
            continue
        name, ends, attributes = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if ends:
            if name in BLOCK_TAGS:
                flush()
                close({name}, frozenset())
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        depth -= name == "a"
                        del stack[i]
                        break
                    if stack[i][0] in BLOCK_TAGS:
                        break
            continue
        if name in RAW_TAGS:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK_TAGS:
            flush()
            close({"p"}, SCOPES - {"p"})
            if name in CLOSES:
                close(CLOSES[name], SCOPES)
        if name in VOID_TAGS or attributes.rstrip().endswith("/") and name not in BLOCK_TAGS:
            continue
        if name in BLOCK_TAGS or name == "a" or "=" in attributes or name in ("b", "i", "span", "strong", "em", "button", "label"):
            depth += name == "a"
            stack.append((name, _classes(attributes)))
    flush()
    return out


#: The first of these that a block lies in is its zone.
ZONES = ("nav", "footer", "aside", "form", "header", "button", "article", "main")
_SENTENCE = re.compile(r"[.!?…](?:\s|$)")


def block_features(b: Block, i: int, n: int) -> list[str]:
    size = len(b.text)
    words = b.text.count(" ") + 1
    f = [f"in:{t}" for t in b.tags if t in BLOCK_TAGS or t in ("a", "button", "label")]
    f += [f"class:{w}" for w in b.words]
    f += ["bias", f"inner:{b.inner}", f"size:{min(8, size.bit_length())}", f"words:{min(6, words.bit_length())}", f"linked:{int(4 * b.linked)}", f"sentences:{min(3, len(_SENTENCE.findall(b.text)))}"]
    if "©" in b.text or "copyright" in b.text.lower():
        f.append("copyright")
    zone = next((z for z in ZONES if z in b.tags), "none")
    f += [f"zone:{zone}", f"zone:{zone}:{'marked' if b.words else 'plain'}:{'linked' if b.linked > 0.6 else 'said'}"]
    f.append(f"first:{min(2, i)}")
    f.append(f"last:{min(2, n - 1 - i)}")
    return f


class ChainCrf:
    """Two labels (0 boilerplate, 1 article), emission weights by feature and a transition matrix."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        self.table = {k: (float(weights[i, 0]), float(weights[i, 1])) for k, i in index.items()}

    @classmethod
    def fit(cls, pages: list[tuple[list[list[str]], list[int]]], steps: int = 300, rate: float = 0.1, decay: float = 1e-3):
        """Full-batch adaptive-moment ascent; forward-backward over all pages at once gives the expected counts."""
        index: dict[str, int] = {}
        rows = [([[index.setdefault(f, len(index)) for f in fs] for fs in blocks], labels) for blocks, labels in pages if labels]
        k, width = len(rows), max(len(y) for _, y in rows)
        sizes = np.array([len(y) for _, y in rows])
        cells = [(i, j, fs) for i, (blocks, _) in enumerate(rows) for j, fs in enumerate(blocks)]
        cell = np.repeat([i * width + j for i, j, _ in cells], [len(fs) for _, _, fs in cells])
        feature = np.concatenate([fs for _, _, fs in cells])
        there = np.arange(width)[None, :] < sizes[:, None]
        gold = np.zeros((k, width), dtype=np.int64)
        for i, (_, y) in enumerate(rows):
            gold[i, : len(y)] = y
        truth = np.eye(2)[gold] * there[..., None]
        pairs = there[:, 1:]
        gold_moves = np.zeros((2, 2))
        np.add.at(gold_moves, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1.0)
        p = np.zeros((len(index) + 2, 2))
        m, v = np.zeros_like(p), np.zeros_like(p)
        last = sizes - 1
        for step in range(1, steps + 1):
            e = np.stack([np.bincount(cell, weights=p[feature, y], minlength=k * width) for y in (0, 1)], axis=1).reshape(k, width, 2)
            moves = p[-2:]
            a, z = np.zeros((k, width, 2)), np.zeros((k, width, 2))
            a[:, 0] = e[:, 0]
            for i in range(1, width):
                a[:, i] = e[:, i] + np.logaddexp(a[:, i - 1, :1] + moves[0], a[:, i - 1, 1:] + moves[1])
            for i in range(width - 2, -1, -1):
                ahead = (e[:, i + 1] + z[:, i + 1])[:, None, :] + moves[None]
                z[:, i] = np.where(pairs[:, i, None], np.logaddexp(ahead[..., 0], ahead[..., 1]), 0.0)
            total = np.logaddexp(*a[np.arange(k), last].T)
            chance = np.where(there[..., None], np.exp(np.minimum(0, a + z - total[:, None, None])), 0.0)
            miss = (truth - chance).reshape(k * width, 2)
            g = -decay * p * k
            for y in (0, 1):
                g[:-2, y] += np.bincount(feature, weights=miss[cell, y], minlength=len(index))
            pair = a[:, :-1, :, None] + moves + (e[:, 1:] + z[:, 1:])[:, :, None, :] - total[:, None, None, None]
            g[-2:] += gold_moves - np.where(pairs[..., None, None], np.exp(np.minimum(0, pair)), 0.0).sum(axis=(0, 1))
            g /= k
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(index, p[:-2], p[-2:])

    def viterbi(self, blocks: list[list[str]]) -> list[int]:
        """The most probable labels; equal scores go to label 0."""
        get, none = self.table.get, (0.0, 0.0)
        (s00, s01), (s10, s11) = self.moves.tolist()
        back: list[tuple[int, int]] = []
        a0 = a1 = 0.0
        for i, fs in enumerate(blocks):
            e0 = e1 = 0.0
            for f in fs:
                w = get(f, none)
                e0 += w[0]
                e1 += w[1]
            if i:
                x0, y0, x1, y1 = a0 + s00, a1 + s10, a0 + s01, a1 + s11
                back.append((int(y0 > x0), int(y1 > x1)))
                a0, a1 = e0 + max(x0, y0), e1 + max(x1, y1)
            else:
                a0, a1 = e0, e1
        if not blocks:
            return []
        out = [int(a1 > a0)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def labelled_pages(n: int = 260, seed: int = 5) -> Iterator[tuple[str, list[int]]]:
    """``(html, label of each leaf block)`` in many layouts: the training material.

    Article blocks carry the mark U+E000 while the page is put together, so the
    labels come from the same block splitter that reads real pages.
    """
    r = random.Random(seed)
    letters = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ou", "ion", "ä", "é", "ó", "ing", "ble"]
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(3, 18).capitalize() + r.choice((".", ".", ".", "?", "", ","))
    prose = lambda a, b: " ".join(sentence() for _ in range(r.randint(a, b)))
    some = lambda p, make: make() if r.random() < p else ""
    keep = "\ue000"
    for _ in range(n):
        semantic = r.random() < 0.75
        links = lambda k: "".join(f"<li><a href='/x'>{words(1, 3)}</a></li>" for _ in range(k))
        nav = lambda: r.choice((f"<nav><ul>{links(r.randint(3, 9))}</ul></nav>", f"<div class='menu'><ul>{links(r.randint(3, 8))}</ul></div>", f"<div id='navigation'>{' | '.join(f'<a href=/>{word()}</a>' for _ in range(5))}</div>"))
        ad = lambda: f"<div class='{r.choice(('ad', 'ads', 'advert banner', 'sponsored', 'promo'))}'>{r.choice(('', '<p>'))}{prose(1, 5)}</div>"
        head = lambda: r.choice((f"<header>{words(1, 4)}<p>{sentence()}</p></header>", f"<div class='masthead header'><h2>{words(1, 3)}</h2></div>"))
        side = lambda: f"<{(t := r.choice(('aside', 'div')))} class='{r.choice(('sidebar', 'widget related', 'side'))}'><h3>{words(1, 3)}</h3><p>{prose(1, 5)}</p><ul>{links(r.randint(2, 5))}</ul></{t}>"
        notice = lambda: f"<div class='{r.choice(('cookie notice', 'consent', 'notice', 'gdpr popup'))}'><p>{prose(1, 4)}</p><button>{word()}</button></div>"
        form = lambda: f"<form class='{r.choice(('newsletter', 'search', ''))}'><label>{words(1, 4)}</label><input name=q><p>{prose(1, 2)}</p><button>{word()}</button></form>"
        comments = lambda: f"<{(t := r.choice(('section', 'div')))} {r.choice(('id', 'class'))}='{r.choice(('comments', 'comment list', 'discussion', 'replies'))}'><h3>{words(1, 3)}</h3>" + "".join(f"<div class='comment'><p>{prose(1, 6)}</p></div>" for _ in range(r.randint(1, 4))) + f"</{t}>"
        foot = lambda: r.choice((f"<footer>&copy; {word()}.example &middot; {prose(1, 4)}</footer>", f"<div class='footer'><p>Copyright {word()} {prose(1, 3)}</p></div>", f"<footer><p>{prose(1, 3)}</p><ul>{links(3)}</ul></footer>"))

        def body() -> str:
            out = f"<h1>{keep}{words(2, 12)}{r.choice(('', '.'))}</h1>"
            for _ in range(r.choice((0, 1, 2, 4, 7, 12))):
                kind = r.random()
                text = keep + prose(1, 9)
                if kind < 0.7:
                    out += r.choice((f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{keep}{sentence()} <a href='/y'>{word()}</a> {sentence()}</p>"))
                elif kind < 0.78:
                    out += f"<h2>{keep}{words(1, 7)}</h2><p>{keep}{prose(1, 6)}</p>"
                elif kind < 0.86:
                    out += "<ul>" + "".join(f"<li>{keep}{prose(1, 2)}</li>" for _ in range(3)) + "</ul>"
                elif kind < 0.92:
                    out += f"<blockquote>{text}</blockquote>"
                elif kind < 0.94:
                    out += r.choice((  # what pages also hold: figures, formulas, fallbacks, unseen parts, nested tables, unclosed lists
                        f"<figure><img src=a.png><figcaption>{keep}{sentence()}</figcaption></figure>", f"<p>{keep}{sentence()} <math><mi>{word()}</mi><mo>=</mo><mi>{word()}</mi></math> {sentence()}</p>",
                        f"<div hidden><p>{text}</p></div>", f"<p style='display:none'>{text}", f"<object data=x><p>{keep}{sentence()}</p></object>", f"<video src=v>{keep}{sentence()}</video>",
                        f"<table><tr><td><table><tr><td>{keep}{sentence()}</td></tr></table></td><td>{keep}{words(1, 4)}</td></tr></table>", f"<ol><li>{keep}{sentence()}<li>{keep}{sentence()}</ol>",
                        f"<dl><dt>{keep}{words(1, 3)}<dd>{keep}{sentence()}</dl>", f"<pre>{keep}{sentence()}\n{sentence()}</pre>", f"<details><summary>{keep}{words(1, 4)}</summary>{text}</details>", f"<div><span>{text}</span></div>",
                    ))
                elif kind < 0.96:
                    out += f"<table><tr><td>{keep}{words(1, 3)}</td><td>{keep}{words(1, 5)}</td></tr></table>"
                else:
                    out += r.choice((ad(), side(), form()))
            return out

        inside = some(0.1, head) + body() + some(0.15, comments)
        main = r.choice((f"<article>{inside}</article>", f"<main><article class='post'>{inside}</article></main>", f"<main>{inside}</main>")) if semantic else r.choice((f"<div class='content'>{inside}</div>", f"<div id='article-body' class='entry text'>{inside}</div>", f"<div class='post'>{inside}</div>", f"<div><div>{inside}</div></div>"))
        page = "<!DOCTYPE html><html><head><title>" + words(2, 6) + "</title><style>p{}</style></head><body>" + some(0.3, notice) + some(0.4, head) + some(0.9, nav) + some(0.7, ad) + some(0.3, side) + main + some(0.4, side) + some(0.3, comments) + some(0.2, ad) + some(0.2, form) + some(0.95, foot) + some(0.15, notice)
        yield page.replace(keep, ""), [int(keep in b.text) for b in leaf_blocks(page)]


@lru_cache(maxsize=2)
def trained(n: int = 260, seed: int = 5) -> ChainCrf:
    pages = []
    for page, labels in labelled_pages(n, seed):
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            pages.append(([block_features(b, i, len(blocks)) for i, b in enumerate(blocks)], labels))
    return ChainCrf.fit(pages)


def main_text(page: str | None, model: ChainCrf) -> str:
    blocks = leaf_blocks(page)
    labels = model.viterbi([block_features(b, i, len(blocks)) for i, b in enumerate(blocks)])
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; a null or empty page has an empty text.

    Null ids and urls stay null, repeated rows are read each, extra columns are
    ignored, an empty table gives an empty result; pages are read whole.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained())  # a model of fixed size
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("html"))

    def run(batches):
        m = model.value
        for b in batches:
            texts = [main_text(x, m) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
