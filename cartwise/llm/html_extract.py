"""Main text of web pages: a linear-chain CRF over the DOM's leaf blocks.

A page is read into leaf blocks (runs of text that no block-level tag breaks) with the
path of their ancestors. Each block has features of its ancestors (tags, class and id
words, alone and joined with whether an article or main element is above) and of its
text (length, link share, closing punctuation, place in the page). A chain of two labels,
content and other, is trained by maximum likelihood (forward-backward) on labelled pages
and decoded by Viterbi.

The labelled pages are made here, page layouts of many kinds in which the label of each
block is known; their number is the parameter ``pages``. Words carry no weight, so the
model doesn't depend on a language.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their role in HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q "
                   "s samp small span strike strong sub sup time tt u var wbr".split())
#: Their text is not the page's; math is read as text of the block in which it stands.
SILENT = frozenset("script style noscript template svg math iframe object canvas textarea select button title head "
                   "audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes these open elements when no other block stands between.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A block start also ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("article aside body div footer form header html main nav section table td ul ol dl".split())
#: Word parts of class and id names that layouts use.
OTHER_STEMS = ("advert adsense banner sponsor promo sidebar widget related recommend share social comment reply "
               "discuss disqus footer header masthead navbar navigation menu breadcrumb pagination pager cookie "
               "consent notice popup modal overlay newsletter subscribe signup login search toolbar copyright legal "
               "disclaimer skip alert").split()
CONTENT_STEMS = "article content entry post story body main text".split()
STEMS = (*OTHER_STEMS, *CONTENT_STEMS)
#: A tag ends at its > and, outside quotes, before the next <; so a page of tags that never end is
#: read once. What looks like a tag and isn't one stays text.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+)>|<[!?][^<>]*+>", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names(attrs: str) -> tuple[str, ...]:
    out = []
    for m in NAMES.finditer(attrs):
        for w in PARTS.findall(m[1] or m[2] or m[3] or ""):
            w = w.lower()
            w = w[:-1] if len(w) > 2 and w.endswith("s") and not w.endswith("ss") else w
            stems = [s for s in STEMS if s in w]
            out += [f".{s}" for s in stems] or [f".{w}"]
    return tuple(dict.fromkeys(out))


def _root(element: tuple[str, tuple]) -> bool:
    return element[0] in ("article", "main") or any(n[1:] in CONTENT_STEMS for n in element[1])


class Node:
    """An open element with what the elements down to it add up to. Elements of one name many
    times over add nothing, so deep nesting costs no more than the names in it."""
    __slots__ = ("tag", "last", "tags", "names", "below", "inside")

    def __init__(self, tag: str, names: tuple, parent: "Node | None"):
        self.tag = tag
        none = frozenset()
        self.last, self.tags, self.names, self.below, self.inside = (
            (parent.last, parent.tags, parent.names, parent.below, parent.inside) if parent else ("", none, none, none, False))
        if tag in INLINE and not names:
            return  # says nothing about its blocks
        self.last = tag
        if self.inside:  # stands below the article element
            self.below = self.below | {f"below={tag}", *(f"below={n}" for n in names)}
        if tag not in ("html", "body"):
            self.tags = self.tags | {tag}
        self.names = self.names | {f"any={n}" for n in names}
        self.inside = self.inside or _root((tag, names))


ROOT = Node("", (), None)


def leaf_blocks(page: str) -> list[tuple[Node, str, float]]:
    """(innermost element, text, share of link text) of each non-empty block, in page order.

    White space inside a block is one space. A silent element (and math) without end tag ends at the end
    tag of an element that it stands in; svg and math also end at a block's start tag."""
    out: list = []
    stack: list[Node] = []
    opened: Counter = Counter()
    inner: Counter = Counter()
    parts: list[str] = []
    linked = 0
    at = silent = 0
    skip: str | None = None

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((stack[-1] if stack else ROOT, text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def add(raw):
        nonlocal linked
        if raw and skip in (None, "math"):
            parts.append(raw)
            if any(n.tag == "a" for n in stack[-4:]):
                linked += len(raw.strip())

    def close(k):
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    for m in TOKEN.finditer(page):
        if m.start() < silent:
            continue
        add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if skip is not None:  # in a silent element that has children
            if m[1]:
                if inner[tag]:
                    inner[tag] -= 1
                    continue
                if tag == skip or not opened[tag]:
                    skip = None if tag == skip else skip
                    continue
            elif skip not in ("svg", "math") or not (tag in ENDS_P or tag in CLOSES):
                inner[tag] += tag not in VOID and not m[3].rstrip().endswith("/")
                continue
            skip = None  # ended from outside: the tag counts as any other
        if m[1]:
            if tag == "br" or not opened[tag]:
                continue
            if tag not in INLINE:
                flush()
            close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in ("script", "style", "title", "textarea", "noscript", "iframe"):
            if tag not in INLINE and tag not in ("script", "style"):
                flush()
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = silent = end.end() if end else len(page)
            continue
        if tag in SILENT and tag != "head":
            if not m[3].rstrip().endswith("/"):
                skip = tag
                inner.clear()
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            closes = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            if any(opened[t] for t in closes):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in closes:
                        close(k)
                        break
                    if stack[k].tag in SCOPES:
                        break
        if not m[3].rstrip().endswith("/") or tag not in INLINE:
            stack.append(Node(tag, _names(m[3]) if m[3] else (), stack[-1] if stack else None))
            opened[tag] += 1
    add(page[at:])
    flush()
    return out


def block_features(blocks: list) -> list[list[str]]:
    out = []
    for i, (node, text, link) in enumerate(blocks):
        where = "in" if node.inside else "out"
        f = {"bias", f"last={node.last}", where, *node.names, *node.below}
        for t in node.tags:
            f |= {f"any={t}", f"any={t}@{where}"}
        words = text.count(" ") + 1
        f.add(f"words={min(6, words.bit_length())}")
        f.add(f"link={int(link * 4)}")
        if text[-1] in ".!?:;\"'”»…":
            f.add("stop")
        if "©" in text:
            f.add("copy")
        if i < 2:
            f.add("first")
        if i >= len(blocks) - 2:
            f.add("last")
        out.append(sorted(f))
    return out


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page and the label (1: content) of each of its blocks."""
    out: list[str] = []
    labels: list[int] = []
    word = lambda: "".join(rng.choice("abdeghilmnorstuvé") for _ in range(rng.randint(2, 9)))
    say = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))

    def put(tag, text, label, attrs=""):
        out.append(f"<{tag}{attrs}>{text}</{tag}>" if rng.random() < 0.9 or tag not in ("p", "li") else f"<{tag}{attrs}>{text}")
        labels.append(label)

    def box(tag, names, fill):
        kind = f' class="{rng.choice(names)}"' if names and rng.random() < 0.8 else \
            f' id="{rng.choice(names)}"' if names else ""
        out.append(f"<{tag}{kind}>")
        fill()
        out.append(f"</{tag}>")

    def links(n=None):
        out.append("<ul>")
        for _ in range(n or rng.randint(2, 7)):
            put("li", f'<a href="/{word()}">{say(1, 3)}</a>', 0)
        out.append("</ul>")

    def other(lo=1, hi=20):
        for _ in range(rng.randint(1, 3)):
            put(rng.choice(["p", "div", "p", "h3", "span"]), say(lo, hi) + rng.choice(["", ".", "!"]), 0)
            if out[-1].startswith("<span"):
                out[-1] = f"<div>{out[-1]}</div>"

    def junk():
        k = rng.randrange(12)
        if k == 0:
            box("nav", rng.choice([[], ["menu", "navbar", "breadcrumb"]]), links)
        elif k == 1:
            box(rng.choice(["aside", "div", "section"]), ["sidebar", "widget", "related", "recommended"],
                rng.choice([links, other]))
        elif k == 2:
            box(rng.choice(["div", "section", "aside"]), ["ad", "ads", "advert", "banner", "sponsored", "promo"],
                lambda: other(2, 30))
        elif k == 3:
            box("form", rng.choice([[], ["search", "newsletter", "login", "subscribe"]]), lambda: other(1, 12))
        elif k in (4, 5):
            box(rng.choice(["section", "div", "ol"]), ["comments", "comment", "reply", "discussion", "comment-list"],
                lambda: other(3, 60))
        elif k == 6:
            box("div", ["cookie", "notice", "consent", "popup", "alert", "modal", "overlay"], lambda: other(3, 40))
        elif k == 7:
            box("div", ["share", "social", "pagination", "toolbar", "skip", "legal", "disclaimer", "copyright"],
                rng.choice([links, other]))
        elif k == 8:
            box("div", ["menu", "navigation", "navbar", "header", "masthead", "footer"], rng.choice([links, other]))
        elif k == 9:
            box("aside", [], lambda: other(2, 40))
        elif k == 10:
            names = ["ad", "advert", "promo", "notice", "share", "related", "comment"]
            rng.shuffle(names)
            out.append(f'<div class="{names[0]}">{say(2, 30)}.</div>')
            labels.append(0)
        else:
            box("section", ["related", "comments", "newsletter", "sponsor"], other)

    def body():
        if rng.random() < 0.8:
            head = f"<h1>{say(2, 12)}</h1>"
            out.append(f"<header>{head}</header>" if rng.random() < 0.2 else head)
            labels.append(1)
        for i in range(rng.randint(1, 8)):
            k = rng.random()
            if k < 0.08:
                put(rng.choice(["h2", "h3"]), say(1, 8), 1)
            elif k < 0.14:
                out.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    put("li", say(2, 20), 1)
                out.append("</ul>")
            elif k < 0.18:
                out.append(f"<blockquote><p>{say(5, 30)}.</p></blockquote>")
                labels.append(1)
            elif k < 0.22:
                out.append(f"<table><tr><td>{say(1, 5)}</td><td>{say(1, 5)}</td></tr></table>")
                labels.extend((1, 1))
            elif k < 0.3 and i:
                junk()
            else:
                text = say(1, 90) + rng.choice([".", ".", ".", "", "?"])
                if rng.random() < 0.2:
                    text += f' <a href="#">{say(1, 4)}</a> {say(3, 20)}.'
                if rng.random() < 0.1:
                    text = f"<b>{text}<br>"
                put("p", text, 1)
        while rng.random() < 0.25:
            junk()

    out.append("<html><head><title>t</title></head><body>")
    if rng.random() < 0.5:
        out.append(f"<header><div>{say(1, 6)}</div></header>" if rng.random() < 0.6 else f"<header><h1>{say(1, 5)}</h1></header>")
        labels.append(0)
    if rng.random() < 0.7:
        box("nav", [], links)
    while rng.random() < 0.5:
        junk()
    where, names = rng.choice([("article", []), ("article", []), ("article", ["post", "story"]), ("main", []),
                               ("div", ["content", "post", "entry-content", "article-body", "main-content", "story"]),
                               ("section", ["content", "post-body", "article", "entry"]), ("div", []), ("", [])])
    if not where:
        body()
    elif where != "main" and rng.random() < 0.3:
        out.append("<main>")
        box(where, names, body)
        out.append("</main>")
    else:
        box(where, names, body)
    while rng.random() < 0.5:
        junk()
    if rng.random() < 0.8:
        out.append(f"<footer>&copy; {say(1, 14)}.</footer>" if rng.random() < 0.7 else f"<footer><p>{say(2, 30)}.</p></footer>")
        labels.append(0)
    out.append(rng.choice(["</body></html>", ""]))
    return "".join(out), labels


def train(pages: int = 500, seed: int = 11, epochs: int = 120, rate: float = 0.15, l2: float = 2e-3):
    """CRF weights: ({feature: (other, content)}, transitions[2][2])."""
    rng = random.Random(seed)
    data = []
    while len(data) < pages:
        page, y = labelled_page(rng)
        x = block_features(leaf_blocks(page))
        assert len(x) == len(y), (page, y)
        data.append((x, y))
    index: dict[str, int] = {}
    for x, _ in data:
        for f in x:
            for k in f:
                index.setdefault(k, len(index))
    longest = max(len(y) for _, y in data)
    n = len(data)
    mask, gold = np.zeros((n, longest), bool), np.zeros((n, longest), int)
    rows, cols = [], []
    for i, (x, y) in enumerate(data):
        mask[i, :len(y)], gold[i, :len(y)] = True, y
        for t, f in enumerate(x):
            rows += [i * longest + t] * len(f)
            cols += [index[k] for k in f]
    rows, cols = np.array(rows), np.array(cols)
    w, trans = np.zeros((len(index), 2)), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    truth = np.eye(2)[gold] * mask[..., None]
    pair_truth = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    log_sum = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    for step in range(1, epochs + 1):
        emit = np.stack([np.bincount(rows, w[cols, k], n * longest) for k in (0, 1)], 1).reshape(n, longest, 2)
        fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
        fwd[:, 0] = emit[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.where(mask[:, t, None], log_sum(fwd[:, t - 1, :, None] + trans, 1) + emit[:, t], fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            back = log_sum(trans[None] + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(mask[:, t + 1, None], back, 0)
        z = log_sum(fwd[:, -1], 1)
        post = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
        pair = np.exp(fwd[:, :-1, :, None] + trans + (emit + bwd)[:, 1:, None, :] - z[:, None, None, None])
        pair = (pair * mask[:, 1:, None, None]).sum((0, 1))
        diff = (truth - post).reshape(-1, 2)
        grad = np.stack([np.bincount(cols, diff[rows, k], len(index)) for k in (0, 1)], 1) / n - l2 * w
        grad_t = (pair_truth - pair) / n - l2 * trans
        for value, g, a, b in ((w, grad, m[0], m[1]), (trans, grad_t, m[2], m[3])):  # Adam
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            value += rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)
    return {k: (float(w[i, 0]), float(w[i, 1])) for k, i in index.items()}, trans.tolist()


def viterbi(features: list[list[str]], model) -> list[int]:
    weights, trans = model
    none = (0.0, 0.0)
    best, back = None, []
    for f in features:
        e0 = sum(weights.get(k, none)[0] for k in f)
        e1 = sum(weights.get(k, none)[1] for k in f)
        if best is None:
            best = (e0, e1)
            continue
        from0 = (best[0] + trans[0][0], best[1] + trans[1][0])
        from1 = (best[0] + trans[0][1], best[1] + trans[1][1])
        back.append((int(from0[1] > from0[0]), int(from1[1] > from1[0])))
        best = (max(from0) + e0, max(from1) + e1)
    if best is None:
        return []
    path = [int(best[1] > best[0])]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def main_text(page: str, model) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b[1] for b, keep in zip(blocks, viterbi(block_features(blocks), model)) if keep)


def extract_pages(pages: DataFrame, model=None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    Null and empty pages, and pages without a content block, give an empty text. Repeated rows
    give equal texts. Unclosed and stray tags are read as browsers do in outline; nothing of
    a content block is cut. An empty table gives no rows.
    """
    model = train() if model is None else model
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([main_text(p, shared.value) if p else "" for p in b], dtype=object)

    text = F.pandas_udf(extract, "string")
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         text(F.col("html").cast("string")).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
