"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, with scripts, styles,
comments and the head left out, character references decoded and white space made single.
A block is described by its whole tag path, hashed (tags and the words of their class and id), its
innermost elements once more, its hashed words, and its length, link share and place. A bidirectional LSTM in numpy reads the
vectors of all blocks of a page and gives every block the probability of belonging to
the main text; blocks of at least one half are joined in page order by two line feeds.

The network is trained here on at most ``PAGES`` pages (hash order). Pages with semantic
containers give weak labels: blocks in ``article`` or ``main`` are main text unless a closer
container says otherwise. From their texts more pages are laid out by rule, with other
containers, class names, notices, forms, adverts, side columns and reader comments, so that the
network learns to judge by path, words and neighbours and not by one template.

Null and empty html, and pages without main text, give an empty text. Without a page to
learn from, the laid-out pages use placeholder words. Equal pages get equal texts. A very
long page is one sequence and is read whole.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import mapped, read

PAGES, LAID_OUT = 150, 450
PATH, NEAR, WORDS, NUMBERS, HIDDEN = 96, 48, 48, 5, 16
SIZE = PATH + NEAR + WORDS + NUMBERS
INNERMOST = 4  # elements of a path that are also described apart from the others

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|[^<]+|<", re.S | re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
# Tags that do not end a block.
INLINE = frozenset("a abbr b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A new one of these ends an open one of the same kind.
CLOSES_ITSELF = frozenset("p li td th tr dt dd option".split())
# Plain characters up to their end tag or the end of the page.
RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "textarea", "title")}
# Left out with all that is in them, up to their end tag or that of an element around them.
HIDDEN_TAGS = {tag: re.compile(rf"</{tag}\b", re.I) for tag in ("noscript", "template", "svg", "iframe", "select")}
# Where the page has no further end tag for one of those, it ends at one of these.
BREAKS_OUT = frozenset("address article aside blockquote body center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table ul".split())


class Block:
    __slots__ = ("path", "text", "link")

    def __init__(self, path: tuple, text: str, link: int):
        self.path, self.text, self.link = path, text, link


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order; ``path`` holds ``(tag, words of class, id and role)`` from the outside in."""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    pieces: list[str] = []
    link = [0]

    def flush():
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text and not any(tag == "head" for tag, _ in stack):
                out.append(Block(tuple(stack), text, link[0]))
            pieces.clear()
        link[0] = 0

    last_end: dict[str, int] = {}
    hidden = None  # place in the stack of the outermost element that is left out
    at = 0
    last_close = page.rfind(">")
    while at < len(page):
        if at > last_close:
            # No tag can end any more: plain text up to the start of a comment, in one piece.
            piece = page[at:].split("<!--", 1)[0]
            if hidden is None and piece:
                pieces.append(piece)
                if any(t == "a" for t, _ in stack):
                    link[0] += len(piece)
            break
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            piece = m.group(0)
            if hidden is not None or piece.startswith(("<!", "<?")):
                continue
            pieces.append(piece)
            if any(t == "a" for t, _ in stack):
                link[0] += len(piece)
            continue
        tag, closing, attributes = tag.lower(), m.group(1) or m.group(4), (m.group(3) or m.group(6) or "")
        if closing:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if hidden is not None:
                if found is None or found > hidden:
                    del stack[len(stack) if found is None else found:]
                    continue
                del stack[hidden:]
                inside, hidden = found == hidden, None
                if inside:
                    continue
            if tag not in INLINE:
                flush()
            if found is not None:
                del stack[found:]
            continue
        foreign = hidden is not None and any(t == "svg" for t, _ in stack[hidden:])
        if tag in RAW and not foreign:
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if hidden is not None and tag in BREAKS_OUT:
            name = stack[hidden][0]
            if name not in last_end:
                last_end[name] = max((e.start() for e in HIDDEN_TAGS[name].finditer(page, at)), default=-1)
            if last_end[name] < at:
                del stack[hidden:]
                hidden = None
        if hidden is None and tag not in HIDDEN_TAGS:
            if tag not in INLINE:
                flush()
            elif tag == "br":
                pieces.append(" ")
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            if hidden is None and tag in HIDDEN_TAGS:
                hidden = len(stack)
            if hidden is None and tag == "body":
                stack = [s for s in stack if s[0] != "head"]
            if tag in CLOSES_ITSELF and any(t == tag for t, _ in stack[-4:]):
                while stack and stack[-1][0] != tag and (stack[-1][0] in INLINE or stack[-1][0] in CLOSES_ITSELF):
                    stack.pop()
                if stack and stack[-1][0] == tag:
                    stack.pop()
            names = tuple(w for a in _NAMES.findall(attributes) for w in _PARTS.findall("".join(a).lower())) if "=" in attributes else ()
            stack.append((tag, names))
    flush()
    return out


def _slot(text: str, size: int) -> int:
    return zlib.crc32(text.encode()) % size


def vectors(page: list[Block]) -> np.ndarray:
    """Inputs of the network, one row per block."""
    out = np.zeros((len(page), SIZE), np.float32)
    for i, block in enumerate(page):
        row = out[i]
        for first, size, elements in ((0, PATH, block.path), (PATH, NEAR, block.path[-INNERMOST:])):
            for tag, names in elements:
                row[first + _slot(tag, size)] += 1
                for name in names:
                    row[first + _slot("." + name, size)] += 1
        np.minimum(row[:PATH + NEAR], 2, out=row[:PATH + NEAR])
        words = block.text.split()
        begin = PATH + NEAR
        for word in words:
            row[begin + _slot(word.lower(), WORDS)] += 1
        row[begin: begin + WORDS] = np.log1p(row[begin: begin + WORDS]) * 0.3
        n = len(block.text)
        row[-NUMBERS:] = (np.log1p(n) / 5, min(1.0, block.link / max(1, n)), sum(c in ".,;!?" for c in block.text) / max(4, len(words)),
                          i / len(page), float(len(words) < 8))
    return out


class Lstm:
    """One direction."""

    def __init__(self, rng, inputs: int, hidden: int):
        self.wx = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden)).astype(np.float32)
        self.wh = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden: 2 * hidden] = 1
        self.hidden = hidden

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """``x`` is (steps, pages, inputs). Masked steps keep the state."""
        n, pages, _ = x.shape
        h, c = np.zeros((pages, self.hidden), np.float32), np.zeros((pages, self.hidden), np.float32)
        hs, memory = np.empty((n, pages, self.hidden), np.float32), []
        pre = x @ self.wx + self.b
        for t in range(n):
            z = pre[t] + h @ self.wh
            gates = 1 / (1 + np.exp(-z[:, : 3 * self.hidden]))
            i, f, o = np.split(gates, 3, 1)
            g = np.tanh(z[:, 3 * self.hidden:])
            m = mask[t][:, None]
            new = f * c + i * g
            if keep:
                memory.append((h, c, i, f, o, g, np.tanh(new), m))
            c = m * new + (1 - m) * c
            h = m * (o * np.tanh(new)) + (1 - m) * h
            hs[t] = h
        return (hs, memory) if keep else hs

    def backward(self, x, memory, d_hs):
        g_wx, g_wh, g_b = np.zeros_like(self.wx), np.zeros_like(self.wh), np.zeros_like(self.b)
        d_h, d_c = np.zeros_like(d_hs[0]), np.zeros_like(d_hs[0])
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, tanh_c, m = memory[t]
            d_h = d_h + d_hs[t]
            d_new = m * (d_h * o * (1 - tanh_c ** 2) + d_c)
            d_z = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), m * d_h * tanh_c * o * (1 - o), d_new * i * (1 - g ** 2)], 1)
            g_wx += x[t].T @ d_z
            g_wh += h.T @ d_z
            g_b += d_z.sum(0)
            d_h = d_z @ self.wh.T + (1 - m) * d_h
            d_c = d_new * f + (1 - m) * d_c
        return g_wx, g_wh, g_b


class Labeller:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng, SIZE, HIDDEN), Lstm(rng, SIZE, HIDDEN)
        self.v, self.c = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)

    @staticmethod
    def _batch(pages: list[np.ndarray]):
        n = max(map(len, pages))
        x, mask = np.zeros((n, len(pages), SIZE), np.float32), np.zeros((n, len(pages)), np.float32)
        for i, p in enumerate(pages):
            x[: len(p), i], mask[: len(p), i] = p, 1
        return x, mask

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Per page, the probability of every block. Pages of like length are read together."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            width = max(1, min(64, 20_000 // len(pages[order[-1]])))
            some, order = order[-width:], order[:-width]
            x, mask = self._batch([pages[i] for i in some])
            h = np.concatenate([self.ahead.forward(x, mask), self.back.forward(x[::-1], mask[::-1])[::-1]], 2)
            p = 1 / (1 + np.exp(-(h @ self.v + self.c)))
            for k, i in enumerate(some):
                out[i] = p[: len(pages[i]), k]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 12, seed: int = 13) -> Labeller:
        rng = np.random.default_rng(seed)
        params = [self.ahead.wx, self.ahead.wh, self.ahead.b, self.back.wx, self.back.wh, self.back.b, self.v, self.c]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        steps = 0
        for _ in range(epochs):
            for some in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // 16)):
                x, mask = self._batch([pages[i] for i in some])
                y = np.zeros_like(mask)
                for k, i in enumerate(some):
                    y[: len(labels[i]), k] = labels[i]
                ahead, memory_a = self.ahead.forward(x, mask, True)
                back, memory_b = self.back.forward(x[::-1], mask[::-1], True)
                h = np.concatenate([ahead, back[::-1]], 2)
                d = (1 / (1 + np.exp(-(h @ self.v + self.c))) - y) * mask / mask.sum()
                d_h = d[:, :, None] * self.v
                grads = [*self.ahead.backward(x, memory_a, d_h[:, :, :HIDDEN]),
                         *self.back.backward(x[::-1], memory_b, d_h[::-1, :, HIDDEN:]),
                         np.tensordot(h, d, ([0, 1], [0, 1])), d.sum(keepdims=True)[0]]
                steps += 1
                for p, g, (m, s) in zip(params, grads, moments):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= (0.01 * (m / (1 - 0.9 ** steps)) / (np.sqrt(s / (1 - 0.999 ** steps)) + 1e-8)).astype(np.float32)
        return self


MAIN = frozenset("article main".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
# Words of class names; fixed lists of the page layouts the training pages are made of.
MAIN_NAMES = "content article post entry story main body text page-content post-body article-body entry-content".split()
SIDE_NAMES = ("nav navbar menu header site-header footer site-footer sidebar side widget ad ads advert banner promo sponsored cookie notice alert "
              "consent comment comments reply share social related newsletter subscribe login search breadcrumb pagination copyright toolbar modal").split()


def weak_label(block: Block) -> float | None:
    """1 in an article or main, 0 in other containers, by the closest one; None where none says anything.

    What an element is counts before its class names: ``<article class="has-sidebar">`` is an article.
    """
    for tag, names in reversed(block.path):
        if tag in MAIN:
            return 1.0
        if tag in ASIDE or any(n in SIDE_NAMES for n in names):
            return 0.0
    return None


def laid_out(texts: list[str], rng) -> tuple[str, list[float]]:
    """A page made by rule, and the label of each of its blocks."""
    def pick(options):
        return options[int(rng.integers(len(options)))]

    def words(low, high):
        source = pick(texts).split() or ["text"]
        n = int(rng.integers(low, high))
        at = int(rng.integers(max(1, len(source) - n)))
        return entities.escape(" ".join(source[at: at + n]))

    labels: list[float] = []

    def deep(inner, most):
        """Sometimes inside up to ``most`` more elements that say nothing."""
        for _ in range(int(rng.integers(1, most + 1)) if rng.random() < 0.1 else 0):
            inner = pick(["<div>{}</div>", "<div>{}</div>", "<div class='row'>{}</div>", "<section>{}</section>", "<ol><li>{}</li></ol>", "<ul><li><div>{}</div></li></ul>"]).format(inner)
        return inner

    def side():
        name, kind = pick(SIDE_NAMES), pick(["nav", "header", "footer", "aside", "form", "div", "div", "div", "section", "ul"])
        mark = f' class="{name}"' if kind in ("div", "section", "ul") or rng.random() < 0.4 else ""
        n = int(rng.integers(1, 6))
        long = kind == "aside" or name.startswith(("comment", "reply", "cookie", "notice"))
        inner = []
        for _ in range(n):
            text = words(4, 40) if long and rng.random() < 0.7 else words(1, 7)
            shape = pick(["<li><a href='#'>{}</a></li>", "<p>{}</p>", "<div>{}</div>", "<a href='#'>{}</a><br>" if n == 1 else "<li>{}</li>", "<h3>{}</h3>"])
            inner.append(deep(shape.format(text), 6))
            labels.append(0.0)
        return f"<{kind}{mark}>{deep(''.join(inner), 4)}</{kind}>"

    def main():
        kind = pick(["article", "main", "div", "div", "div", "section"])
        mark = f' class="{pick(MAIN_NAMES)}"' if kind in ("div", "section") or rng.random() < 0.3 else ""
        inner = [f"<h1>{words(3, 14)}</h1>"]
        labels.append(1.0)
        for _ in range(int(rng.integers(1, 14))):
            shape = pick(["<p>{}</p>"] * 6 + ["<h2>{}</h2>", "<li>{}</li>", "<blockquote>{}</blockquote>", "<div>{}</div>", "<pre>{}</pre>"])
            inner.append(deep(shape.format(words(1, 9) if rng.random() < 0.2 else words(8, 90)), 4))
            labels.append(1.0)
            if rng.random() < 0.06:
                inner.append(side())
        if rng.random() < 0.1:
            return f"<{kind}{mark}>{deep(''.join(inner) + side(), 6)}</{kind}>"
        return f"<{kind}{mark}>{deep(''.join(inner), 6)}</{kind}>"

    before = "".join(side() for _ in range(int(rng.integers(0, 4))))
    middle = main()
    after = "".join(side() for _ in range(int(rng.integers(0, 5))))
    wrap = pick(["{}", "<div class='wrapper'>{}</div>", "<div id='page'><div class='row'>{}</div></div>"])
    return f"<html><body>{deep(wrap.format(before + middle + after), 6)}</body></html>", labels


def fit(pages: DataFrame, bound: int = PAGES, made: int = LAID_OUT) -> Labeller:
    # Tasks send hashes first, so that no more than the chosen pages reach the driver.
    known = pages.filter("html IS NOT NULL").select("html", F.xxhash64("html").alias("_h"))
    last = known.select("_h").distinct().orderBy("_h").limit(bound).agg(F.max("_h")).first()[0]
    rows = known.filter(F.col("_h") <= F.lit(last)).select("html").distinct().collect() if last is not None else []
    rows.sort(key=lambda r: r.html)
    xs, ys, texts = [], [], []
    for r in rows:
        page = blocks(r.html)
        marks = [weak_label(b) for b in page]
        texts += [b.text for b, y in zip(page, marks) if y == 1.0]
        if page and 1.0 in marks:
            xs.append(vectors(page))
            ys.append(np.array([y or 0.0 for y in marks], np.float32))
    rng = np.random.default_rng(17)
    texts = sorted(texts) or ["plain words of a page that has some text"]
    for _ in range(made):
        page, labels = laid_out(texts, rng)
        cut = blocks(page)
        if len(cut) == len(labels):
            xs.append(vectors(cut))
            ys.append(np.array(labels, np.float32))
    return Labeller().fit(xs, ys)


def extracted(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """Input columns except ``html``, and ``_text``."""
    others = [c for c in pages.columns if c != "html"]
    rows = pages.select(F.struct(*others).alias("_row"), "html")
    sent = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(batch):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            cut = [blocks(p or "") for p in part.column(1).to_pylist()]
            chances = sent.value.probabilities([vectors(b) for b in cut])
            texts = ["\n\n".join(b.text for b, p in zip(page, chance) if p >= 0.5) for page, chance in zip(cut, chances)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["_row", "_text"])

    kind = rows.schema["_row"].dataType.simpleString()
    return mapped(rows, run, f"_row {kind}, _text string").select(*[F.col("_row")[c].alias(c) for c in others], "_text")


def op10(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages, fit(pages)).select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
