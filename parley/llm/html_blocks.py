"""HTML extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks, each with the path of block tags above it. A bidirectional LSTM, written and
trained here in numpy, reads a vector of tag path, hashed class words, hashed text words and shape for every block of the
page, from both ends, and labels each block with the whole page in view. It learns from a bounded sample of pages whose
markup names the article, and from variants of them without those names and with more furniture.

The text is the labelled blocks in page order, joined by one new line; character references are decoded, white space in
a block is one space. Null html is empty. Pages without a learned-from sample are labelled by a network that has seen
none: nothing is extracted. Pages are read whole. Repeated rows get equal texts. An empty table gives an empty result.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import fold, keep, lowest, text_of, texts

#: Fitted on at most so many pages that name the article, those whose ids hash lowest, and on blocks up to SPAN of each.
SAMPLE, SPAN, UNITS, EPOCHS, BATCH, RATE = 300, 64, 16, 10, 48, 0.01
TAGS, CLASSES, WORDS, SHAPE = 48, 96, 32, 10
WIDTH = 2 * TAGS + CLASSES + WORDS + SHAPE

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = frozenset("script style noscript template title svg iframe object select textarea button".split())
_RAW = frozenset("script style textarea title".split())
_BLOCKS = frozenset("html body div p h1 h2 h3 h4 h5 h6 ul ol li table caption thead tbody tfoot tr td th section article main aside nav header "
                    "footer form fieldset legend label blockquote pre figure figcaption dl dt dd hr address details summary center dialog".split())
_ALONE = frozenset("noscript iframe select button".split())  # hidden elements that cannot stand in one of their own kind
_ENDS = {"li": ("li", ("ul", "ol")), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",))}
_SPLIT = re.compile(r"[^a-z0-9]+")

# Words in class names and ids that mark page furniture, by kind: fixed values.
FURNITURE = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toc tabs pagination pager skip",
    "header": "header masthead topbar branding logo",
    "footer": "footer copyright legal colophon imprint",
    "sidebar": "sidebar aside rail widget related recommended recommendations trending popular tags",
    "notice": "cookie cookies notice banner consent alert gdpr popup modal overlay paywall warning",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion",
    "form": "form newsletter subscribe subscription search login signup share social",
    "comment": "comment comments reply replies respond discussion disqus responses reviews",
}
_MARKS = frozenset(" ".join(FURNITURE.values()).split())
_FURNITURE_TAGS = frozenset("nav header footer aside form".split())
_CONTENT = ("content", "post", "entry", "story", "main", "body", "text", "page", "single", "blog")


@dataclass(frozen=True)
class Block:
    """Path of (tag, class words), text, and characters inside links."""

    path: tuple[tuple[str, tuple[str, ...]], ...]
    text: str
    linked: int


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = at = passed = 0
    tokens = _tokens(page)
    ends = _hidden_ends(tokens, len(page))

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(tuple(stack), text, linked))
            parts.clear()
        linked = 0

    for k, (start, end, tag, closing, attributes) in enumerate(tokens):
        if k < passed:
            continue
        if start > at:
            told = html.unescape(page[at:start])
            parts.append(told)
            linked += len(told) if links else 0
        at = end
        if k in ends:
            passed, at = ends[k]
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag == "body" and not closing:
            flush()
            stack[:] = [(tag, _names(attributes))]
        elif tag in _BLOCKS:
            flush()
            if closing:
                _close(stack, tag)
            else:
                if stack and stack[-1][0] == "p":
                    stack.pop()
                if tag in _ENDS:
                    _end_open(stack, tag)
                if tag != "hr":
                    stack.append((tag, _names(attributes)))
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    flush()
    return found


def _tokens(page: str) -> list[tuple[int, int, str, bool, str]]:
    """Start, end, tag ("" for a comment or declaration), whether it closes, attributes. A script and the like is one token
    up to its end tag, the end of the page where it has none."""
    out: list[tuple[int, int, str, bool, str]] = []
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        at, tag, closing, attributes = m.end(), (m[2] or m[5] or "").lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            tag = ""
        out.append((m.start(), at, tag, closing, attributes))
    return out


def _hidden_ends(tokens: list[tuple[int, int, str, bool, str]], size: int) -> dict[int, tuple[int, int]]:
    """Hidden elements by the place of their start: the token and the character after which the page goes on.

    One that has its end tag within the element around it ends there. Any other was left open: it ends before the next
    block start or end, or with the page.
    """
    ends: dict[int, tuple[int, int]] = {}
    unended: list[int] = []
    opened: list[tuple[str, int]] = []
    count: Counter[str] = Counter()
    for k, (_, end, tag, closing, attributes) in enumerate(tokens):
        hides = tag in _HIDDEN
        if not hides and (tag not in _BLOCKS or tag == "hr") or hides and not closing and attributes.endswith("/"):
            continue
        if closing and count[tag]:
            while True:
                last, at = opened.pop()
                count[last] -= 1
                if last == tag:
                    break
                if last in _HIDDEN:
                    unended.append(at)
            if hides:
                ends[at] = (k + 1, end)
        elif not closing:
            if count[tag] and tag in _ALONE:
                i = next(i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == tag)
                unended.append(opened.pop(i)[1])
                count[tag] -= 1
            opened.append((tag, k))
            count[tag] += 1
    unended += [at for tag, at in opened if tag in _HIDDEN]
    going = [k for k, (_, _, tag, _, _) in enumerate(tokens) if tag in _BLOCKS] if unended else []
    for at in unended:
        i = bisect.bisect(going, at)
        ends[at] = (going[i], tokens[going[i]][0]) if i < len(going) else (len(tokens), size)
    return ends


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    told = " ".join(next(filter(None, m.groups()), "") for m in _NAMES.finditer(attributes))
    return tuple(w for w in _SPLIT.split(told.lower()) if w)


def _close(stack: list, tag: str) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == tag:
            del stack[i:]
            return


def _end_open(stack: list, tag: str) -> None:
    """A list item, cell or term ends an open one of its own list or table."""
    other, within = _ENDS[tag]
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in within:
            return
        if stack[i][0] in (tag, other):
            del stack[i:]
            return


@functools.lru_cache(maxsize=65536)
def _bucket(word: str, kind: str, size: int) -> int:
    return zlib.crc32(f"{kind}:{word}".encode("utf-8", "surrogatepass")) % size


def vectors(found: list[Block]) -> np.ndarray:
    """One row a block: tags of the path, own tag, class words of the path, words of the text, shape."""
    x = np.zeros((len(found), WIDTH), np.float32)
    for i, b in enumerate(found):
        row = x[i]
        for tag, names in b.path:
            row[_bucket(tag, "tag", TAGS)] = 1
            for name in names:
                row[2 * TAGS + _bucket(name, "class", CLASSES)] = 1
                if name in _MARKS:
                    row[-1] = 1
        if b.path:
            row[TAGS + _bucket(b.path[-1][0], "own", TAGS)] = 1
        words = b.text.lower().split(" ")
        held = [(_bucket if len(w) <= 64 else _bucket.__wrapped__)(w, "word", WORDS) for w in words]  # the cache takes no very long words
        row[2 * TAGS + CLASSES:-SHAPE] = np.bincount(held, minlength=WORDS) / len(words)
        n = len(b.text)
        row[-SHAPE:-1] = (math.log1p(n) / 8, math.log1p(len(words)) / 6, min(1.0, b.linked / n), sum(map(b.text.count, ".,;!?")) / n,
                          b.text[-1] in ".!?", "©" in b.text, (i + 1) / len(found), len(b.path) / 10, i == 0)
    return x


@dataclass
class Labeller:
    """Weights of both directions: inputs (2, D, 4H), recurrent (2, H, 4H), bias (2, 1, 4H), label (2, H), label bias."""

    inputs: np.ndarray
    recurrent: np.ndarray
    bias: np.ndarray
    label: np.ndarray
    shift: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.bias, self.label, self.shift]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _read(net: Labeller, way: int, x: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T, B, H) of one direction over x (T, B, D), and what the way back needs."""
    span, lanes, _ = x.shape
    h = net.recurrent.shape[1]
    given = x @ net.inputs[way] + net.bias[way]
    state, cell = np.zeros((lanes, h), np.float32), np.zeros((lanes, h), np.float32)
    states, kept = np.zeros((span, lanes, h), np.float32), []
    for t in range(span):
        a = given[t] + state @ net.recurrent[way]
        gates = _sigmoid(a[:, :3 * h])
        fresh = np.tanh(a[:, 3 * h:])
        before = cell
        cell = gates[:, h:2 * h] * cell + gates[:, :h] * fresh
        squashed = np.tanh(cell)
        kept.append((state, before, gates, fresh, squashed))
        state = gates[:, 2 * h:] * squashed
        states[t] = state
    return states, kept


def _gradients(net: Labeller, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    """x (T, B, D), y and mask (T, B), sequences at the start of their lanes: gradients of the mean cross-entropy."""
    h = net.recurrent.shape[1]
    back = _turned(x, mask)
    ahead, behind = _read(net, 0, x), _read(net, 1, back)
    turned = _turned(behind[0], mask)
    p = _sigmoid(ahead[0] @ net.label[0] + turned @ net.label[1] + net.shift)
    d = ((p - y) * mask / mask.sum()).astype(np.float32)
    out = [np.zeros_like(w) for w in net.weights()]
    out[3][0], out[3][1] = np.einsum("tb,tbh->h", d, ahead[0]), np.einsum("tb,tbh->h", d, turned)
    out[4][:] = d.sum()
    for way, seen, push, kept in ((0, x, d[..., None] * net.label[0], ahead[1]), (1, back, _turned(d[..., None] * net.label[1], mask), behind[1])):
        d_state, d_cell = np.zeros(push.shape[1:], np.float32), np.zeros(push.shape[1:], np.float32)
        d_given = np.zeros((*push.shape[:2], 4 * h), np.float32)
        for t in range(len(push) - 1, -1, -1):
            state, before, gates, fresh, squashed = kept[t]
            d_state = d_state + push[t]
            d_cell = d_cell + d_state * gates[:, 2 * h:] * (1 - squashed ** 2)
            d_gates = np.concatenate([d_cell * fresh, d_cell * before, d_state * squashed], axis=1) * gates * (1 - gates)
            d_a = np.concatenate([d_gates, d_cell * gates[:, :h] * (1 - fresh ** 2)], axis=1)
            d_given[t] = d_a
            out[1][way] += state.T @ d_a
            d_state = d_a @ net.recurrent[way].T
            d_cell = d_cell * gates[:, h:2 * h]
        out[0][way] = np.einsum("tbd,tbk->dk", seen, d_given)
        out[2][way] = d_given.sum(axis=(0, 1))
    return out


def _turned(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Every lane's sequence back to front, padding still behind it."""
    sizes = mask.sum(axis=0).astype(int)
    steps = np.arange(len(x))[:, None]
    source = np.where(steps < sizes, sizes - 1 - steps, steps)
    return np.take_along_axis(x, source[..., None] if x.ndim == 3 else source, axis=0)


def named_content(block: Block) -> bool | None:
    """Whether the markup itself says that a block is in the article: the labels to learn from."""
    tags = {tag for tag, _ in block.path}
    if tags & _FURNITURE_TAGS or any(n in _MARKS for _, names in block.path for n in names):
        return False
    return bool(tags & {"article", "main"}) or any("article" in names or "main" in names for _, names in block.path)


def _variants(page: list[Block], others: list[str], rng: np.random.Generator) -> list[list[tuple[Block, bool]]]:
    """The page; the page without named content; and with more furniture."""
    plain = [(b, bool(named_content(b))) for b in page]
    name = _CONTENT[rng.integers(len(_CONTENT))]
    rename = lambda path: tuple(("div", (name,)) if tag in ("article", "main") else (tag, names) for tag, names in path)
    hidden = [(replace(b, path=rename(b.path)), y) for b, y in plain]
    crowded = list(hidden if rng.random() < 0.5 else plain)
    content = [b for b, y in crowded if y]
    above = content[-1].path[:-1] if content else (("body", ()),)
    places = {"menu": 0.0, "header": 0.0, "notice": 0.0, "advert": 0.5, "sidebar": 1.0, "comment": 1.0, "form": 1.0, "footer": 1.0}
    for kind in rng.permutation(sorted(places))[:rng.integers(2, 7)].tolist():
        marks = FURNITURE[kind].split()
        mark = marks[rng.integers(len(marks))]
        tags = {"menu": ("nav", "ul", "div"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "form": ("form", "div")}.get(kind, ("div", "section"))
        tag = tags[rng.integers(len(tags))]
        names = () if tag in _FURNITURE_TAGS and rng.random() < 0.5 else (mark,)
        stem = above if rng.random() < 0.4 else (("body", ()),)
        new = []
        for _ in range(rng.integers(1, 5)):
            text = others[rng.integers(len(others))]
            text = " ".join(text.split()[:int(rng.integers(1, 40))]) or text
            new.append((Block((*stem, (tag, names), (("p", "li", "div", "h3", "span")[rng.integers(5)], ())), text, len(text) if kind in ("menu", "sidebar") and rng.random() < 0.7 else 0), False))
        at = int(places[kind] * len(crowded)) if stem == (("body", ()),) else len(crowded)
        if kind == "advert" and crowded:
            at = int(rng.integers(len(crowded) + 1))
        crowded[at:at] = new
    return [plain, hidden, crowded]


def train(pages: list[str]) -> Labeller:
    """Fit by Adam over variants of pages whose markup names the article."""
    rng = np.random.default_rng(5)
    scale = lambda *s: rng.normal(0, 1 / math.sqrt(s[-2]), s).astype(np.float32)
    net = Labeller(scale(2, WIDTH, 4 * UNITS), scale(2, UNITS, 4 * UNITS), np.zeros((2, 1, 4 * UNITS), np.float32), rng.normal(0, 0.25, (2, UNITS)).astype(np.float32), np.full(1, -1.0, np.float32))
    parsed = [p for p in map(blocks, pages) if any(named_content(b) for b in p)]
    if not parsed:
        net.label[:] = 0
        net.shift[:] = -30
        return net
    others = [b.text for p in parsed for b in p][:20000]
    lanes = []
    for p in parsed:
        for v in _variants(p, others, rng):
            at = int(rng.integers(max(1, len(v) - SPAN + 1))) if rng.random() < 0.5 else 0
            lanes.append((vectors([b for b, _ in v])[at:at + SPAN], np.array([y for _, y in v], np.float32)[at:at + SPAN]))
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    step, steps = 0, EPOCHS * -(-len(lanes) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(lanes))
        for a in range(0, len(order), BATCH):
            part = [lanes[i] for i in order[a:a + BATCH]]
            span = max(len(y) for _, y in part)
            x, y, mask = np.zeros((span, len(part), WIDTH), np.float32), np.zeros((span, len(part)), np.float32), np.zeros((span, len(part)), np.float32)
            for i, (v, told) in enumerate(part):
                x[:len(told), i], y[:len(told), i], mask[:len(told), i] = v, told, 1
            step += 1
            for w, g, m, v in zip(net.weights(), _gradients(net, x, y, mask), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (RATE * (1 - step / (steps + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def labels(net: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """Probability of content for every block of every page."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: -len(pages[i]))
    at = 0
    while at < len(order):  # pages of like length together; a very long one alone
        longest = len(pages[order[at]])
        part = order[at:at + max(1, min(256, 40_000 // longest))]
        x, mask = np.zeros((longest, len(part), WIDTH), np.float32), np.zeros((longest, len(part)), np.float32)
        for k, i in enumerate(part):
            n = len(pages[i])
            x[:n, k], mask[:n, k] = vectors(pages[i]), 1
        ahead, behind = _states(net, 0, x), _turned(_states(net, 1, _turned(x, mask)), mask)
        p = _sigmoid(ahead @ net.label[0] + behind @ net.label[1] + net.shift)
        for k, i in enumerate(part):
            out[i] = p[:len(pages[i]), k]
        at += len(part)
    return out


def _states(net: Labeller, way: int, x: np.ndarray) -> np.ndarray:
    return _read(net, way, x)[0]


def sample(pages: DataFrame) -> list[str]:
    """At most SAMPLE pages whose markup names the article, those whose ids hash lowest."""
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts(batches, 1024, 4_000_000):
            yield batch.filter(pa.array([any(map(named_content, blocks(h))) for h in batch.column(1).to_pylist()])).select(["doc_id"])

    known = (pages.select(F.col("page_id").cast("long").alias("doc_id"), F.col("html").cast("string").alias("html"))
             .where(F.col("doc_id").isNotNull() & F.col("html").rlike("(?i)article|main")))  # other pages name none
    chosen = lowest(keep(known.mapInArrow(named, "doc_id long"), "named").withColumn("_g", fold(1)), "_g", SAMPLE, "pages").select("doc_id").distinct()
    rows = known.join(F.broadcast(chosen), "doc_id").collect()
    return [r["html"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["html"]))][:2 * SAMPLE]


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_content of every row of `pages` (page_id, url, html)."""
    known = net or train(sample(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts(batches, 1024, 4_000_000):
            parsed = [blocks(h) for h in batch.column(2).to_pylist()]
            told = labels(known, parsed)
            found = ["\n".join(b.text for b, p in zip(page, ps) if p >= 0.5) for page, ps in zip(parsed, told)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64()), pa.array([len(p) for p in parsed], pa.int64()),
                                              pa.array([int((p >= 0.5).sum()) for p in told], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_content long")
