"""Main-text extraction: a recurrent block labeller over a page's sequence of blocks.

A page is cut into its leaf blocks of text. Each block has a vector: its tag path with class, id and role words, hashed; its
words, hashed; and a few measures. A bidirectional LSTM in numpy reads the whole sequence of a page and labels every block
as main text or not. It is trained on a bounded sample of the pages at hand, labelled by the marks that pages carry on
their own (landmark elements and class words), and on pages composed from the same blocks with other usual layouts.
"""

from __future__ import annotations

import html
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import in_arrow, pieces, table

#: Pages that train the labeller, those of the smallest hashes of their distinct content, and the stretches of so many blocks
#: that train it of one page, spread from its start to its end. The bounds hold for tables of any size.
TRAIN_PAGES, TRAIN_STRETCHES, STRETCH = 160, 2, 80
HIDDEN, PATH_BITS, WORD_BITS = 12, 9, 6
_EPOCHS, _BATCH = 24, 32

# Elements whose content is never text of the page: _RAW reach to the end of the page if they aren't closed, _HIDDEN only to
# their end tag, and are like any other element without one.
_RAW = ("script", "style")
_HIDDEN = {t: re.compile(rf"</{t}\s*+>", re.I) for t in ("template", "iframe", "svg", "canvas", "textarea", "select", "title")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element that a start tag ends.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table body html article section div td th".split())

#: What opens markup: a comment, a declaration, or a tag's name.
_OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<mark>[!?])|(?P<end>/?)(?P<tag>[a-z][^\s/>]*+))", re.I)
#: The rest of a tag: a quote opens a value only after an equals sign, as browsers read it.
_REST = re.compile(r"((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in _RAW}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z]+|[0-9]+")

#: Class, id and role words, and elements, that mark blocks beside the main text.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsored sponsor promo promotion sidebar side aside widget comment comments reply replies respond disqus cookie cookies consent gdpr notice notification alert popup modal "
    "overlay newsletter subscribe signup login share sharing social related recommended trending breadcrumb breadcrumbs menu nav navigation navbar toolbar topbar masthead header footer copyright legal search form pagination "
    "pager skip complementary contentinfo".split()
)
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button head search".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())


class Node:
    """An open element: what the path down to it says, kept up to date as elements open, so that depth costs nothing.

    bits are the hashed tags, classes, ids and roles of the path; beside is whether a mark on it says that the text is not main
    text, inside whether one says that it is, within whether it is in an article or main element."""

    __slots__ = ("tag", "bits", "beside", "inside", "within", "last")

    def __init__(self, tag: str, words: tuple[str, ...], above: Node | None):
        self.tag = tag
        self.bits, self.beside, self.inside, self.within, self.last = (above.bits, above.beside, above.inside, above.within, above.last) if above else (0, False, False, False, "")
        if above is None or (tag not in _BLOCK and not words):
            return  # inline elements without marks say nothing
        self.last = tag
        for x in (f"<{tag}", *(f".{w}" for w in words)):
            self.bits |= 1 << _slot(x)
        own = tag not in MAIN_TAGS and not ASIDE_WORDS.isdisjoint(words)
        self.beside |= tag in ASIDE_TAGS or own or (tag == "header" and not self.inside)
        self.inside |= tag in MAIN_TAGS or not MAIN_WORDS.isdisjoint(words)
        self.within |= tag in MAIN_TAGS


@cache
def _slot_of_tag(x: str) -> int:
    return zlib.crc32(x.encode()) >> (32 - PATH_BITS)


def _slot(x: str) -> int:
    return _slot_of_tag(x) if len(x) < 20 and x[0] == "<" else zlib.crc32(x.encode()) >> (32 - PATH_BITS)


@dataclass
class Block:
    node: Node
    text: str
    linked: int  # characters inside links


_ROOT = Node("", (), None)


class _Stack:
    """The open elements, with the places of each name, so that closing one never searches the stack."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        at = len(self.nodes)
        self.nodes.append(Node(tag, words, self.nodes[-1] if at else _ROOT))
        self.places.setdefault(tag, []).append(at)
        if tag in _BLOCK:
            self.blocks.append(at)

    def top(self) -> Node:
        return self.nodes[-1] if self.nodes else _ROOT

    def _last(self, names) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def close(self, names: tuple[str, ...], stop: frozenset[str]) -> None:
        """Close the last element of these names and all in it, unless an element of stop stands in between."""
        at = self._last(names)
        if at < 0 or at < ((self.blocks[-1] if self.blocks else -1) if stop is _BLOCK else self._last(stop)):
            return
        for node in self.nodes[at:]:
            self.places[node.tag].pop()
        del self.nodes[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of text in page order; references decoded, white space collapsed, blank blocks left out.

    The work is linear in the page, however elements nest and whatever isn't closed: the first tag without an end to be found
    makes all later quotes ordinary characters, and no markup is looked for after the last closing bracket."""
    if not page:
        return []
    found: list[Block] = []
    stack = _Stack()
    held: list[str] = []
    at = links = linked = 0
    last_end, quotes = page.rfind(">"), True

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                found.append(Block(stack.top(), text, linked))
            held.clear()
        linked = 0

    unclosed: set[str] = set()
    while m := _OPEN.search(page, at):
        start = m.start()
        if m.group("comment"):
            end = page.find("-->", start + 4)
            end, attrs, tag = (end + 3 if end >= 0 else len(page)), "", None
        elif m.end() > last_end:
            break  # nothing ends after this
        else:
            tag = m.group("tag")
            if tag is None:
                end, attrs = page.find(">", start) + 1, ""
            else:
                rest = _REST.match(page, m.end()) if quotes else None
                if quotes and rest is None:
                    quotes = False
                end = rest.end() if rest else page.find(">", m.end()) + 1
                attrs, tag = page[m.end() : end - 1], tag.lower()
                if tag in _RAW_END and not m.group("end") and not attrs.endswith("/"):
                    shut = _RAW_END[tag].search(page, end)
                    end, tag = (shut.end() if shut else len(page)), None
                elif tag in _RAW_END and not m.group("end"):
                    tag = None
        if start > at:
            held.append(page[at:start])
            if links:
                linked += start - at
        at = end
        if tag is None:
            continue
        if tag in _HIDDEN and not m.group("end"):
            if attrs.endswith("/"):
                continue
            if tag not in unclosed:
                if shut := _HIDDEN[tag].search(page, at):
                    at = shut.end()
                    continue
                unclosed.add(tag)
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            held.append(" ")
        if m.group("end"):
            if tag == "a":
                links = max(0, links - 1)
            stack.close((tag,), frozenset() if tag in _BLOCK else _BLOCK)
            continue
        if tag in _VOID:
            continue
        if tag == "a":
            links += 1
        if tag in _BLOCK and tag not in ("body", "html", "option"):
            stack.close(("p",), _SCOPE)
        if tag in _ENDS:
            stack.close(_ENDS[tag], _SCOPE - {"td", "th"} if tag == "tr" else _SCOPE - set(_ENDS[tag]))
        words: tuple[str, ...] = ()
        if attrs and ("=" in attrs):
            words = tuple(w.lower() for a in _ATTR.finditer(attrs) for w in _WORDS.findall(a[2] or a[3] or a[4] or ""))
        stack.push(tag, words)
    if at < len(page):
        held.append(page[at:])
    flush()
    return found


def labels(page: list[Block]) -> np.ndarray:
    """Which blocks their own marks call main text: no mark beside it on the path, and a main element if the page has any."""
    ok = np.array([not b.node.beside for b in page], bool)
    main = np.array([b.node.within for b in page], bool)
    return ok & main if (ok & main).any() else ok


_word_slots: dict[str, int] = {}
N_MEASURES = 6


def _path_rows(page: list[Block]) -> np.ndarray:
    own = [b.node.bits | (1 << _slot(f"/{b.node.last}") if b.node.last else 0) for b in page]
    packed = np.frombuffer(b"".join(x.to_bytes(1 << PATH_BITS >> 3, "little") for x in own), np.uint8)
    return np.unpackbits(packed, bitorder="little").reshape(len(page), -1)


def vectors(page: list[Block]) -> np.ndarray:
    """One row per block: hashed path, hashed words, measures."""
    x = np.zeros((len(page), (1 << PATH_BITS) + (1 << WORD_BITS) + N_MEASURES), np.float32)
    n, p, w = len(page), 1 << PATH_BITS, 1 << WORD_BITS
    if len(_word_slots) > 100_000:
        _word_slots.clear()
    if page:
        x[:, :p] = _path_rows(page)
    for i, b in enumerate(page):
        words = b.text.split(" ")
        slots = []
        for s in words:
            k = _word_slots.get(s)
            if k is None:
                k = _word_slots[s] = zlib.crc32(s.lower().encode()) >> (32 - WORD_BITS)
            slots.append(k)
        x[i, p : p + w] = np.sqrt(np.bincount(slots, minlength=w) / len(slots))
        size = len(b.text)
        x[i, p + w :] = (np.log1p(size) / 8, np.log1p(len(words)) / 6, min(1.0, b.linked / size), i / n, (n - i) / n, b.text[-1] in ".!?")
    return x


class Labeller:
    """A bidirectional LSTM with a logistic output over the joined states of both directions."""

    def __init__(self, width: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        draw = lambda *s: (rng.standard_normal(s) * (0.6 / np.sqrt(s[0]))).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": draw(width, 4 * hidden) * 2, f"U{d}": draw(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1  # remember at first
        self.p |= {"V": draw(2 * hidden, 1), "v": np.zeros(1, np.float32)}

    def _run(self, z: np.ndarray, on: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
        """z: (time, page, 4 hidden) inputs; on: (time, page, 1) whether a page has the step."""
        n = self.hidden
        h = c = np.zeros((z.shape[1], n), np.float32)
        out = np.zeros((*z.shape[:2], n), np.float32)
        for t in range(len(z)):
            a = z[t] + h @ u
            s = 1 / (1 + np.exp(-a[:, : 3 * n]))
            g = np.tanh(a[:, 3 * n :])
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            c2 = f * c + i * g
            k = np.tanh(c2)
            if keep is not None:
                keep.append((i, f, o, g, c, k, h))
            m = on[t]
            c = m * c2 + (1 - m) * c
            h = m * (o * k) + (1 - m) * h
            out[t] = h
        return out

    def _back(self, d_out: np.ndarray, on: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        n = self.hidden
        dz = np.zeros((*d_out.shape[:2], 4 * n), np.float32)
        du = np.zeros_like(u)
        dh = dc = np.zeros(d_out.shape[1:], np.float32)
        for t in range(len(d_out) - 1, -1, -1):
            i, f, o, g, c, k, h = kept[t]
            m = on[t]
            dh = dh + d_out[t]
            dy, dx = m * dh, m * dc
            do, dk = dy * k, dy * o
            dc2 = dx + dk * (1 - k * k)
            da = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - g * g)], 1)
            dz[t] = da
            du += h.T @ da
            dh = (1 - m) * dh + da @ u.T
            dc = (1 - m) * dc + dc2 * f
        return dz, du

    @staticmethod
    def _laid(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        long = max(map(len, pages))
        x = np.zeros((long, len(pages), pages[0].shape[1]), np.float32)
        on = np.zeros((long, len(pages), 1), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k] = p
            on[: len(p), k] = 1
        return x, on

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of main text for each block of each page."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        for i in range(0, len(order), 64):
            some = order[i : i + 64]
            x, on = self._laid([pages[k] for k in some])
            p = self.p
            hf = self._run(x @ p["Wf"] + p["cf"], on, p["Uf"], None)
            hb = self._run((x @ p["Wb"] + p["cb"])[::-1], on[::-1], p["Ub"], None)[::-1]
            y = 1 / (1 + np.exp(-(np.concatenate([hf, hb], 2) @ p["V"] + p["v"])))
            for j, k in enumerate(some):
                out[k] = y[: len(pages[k]), j, 0]
        return out

    def fit(self, pages: list[np.ndarray], truth: list[np.ndarray], epochs: int = _EPOCHS, seed: int = 11) -> Labeller:
        rng, p = np.random.default_rng(seed), self.p
        first, second, step = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}, 0
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        groups = [order[i : i + _BATCH] for i in range(0, len(order), _BATCH)]
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                some = groups[g]
                x, on = self._laid([pages[k] for k in some])
                y = np.zeros(on.shape, np.float32)
                for j, k in enumerate(some):
                    y[: len(truth[k]), j, 0] = truth[k]
                kf, kb = [], []
                hf = self._run(x @ p["Wf"] + p["cf"], on, p["Uf"], kf)
                hb = self._run((x @ p["Wb"] + p["cb"])[::-1], on[::-1], p["Ub"], kb)[::-1]
                h = np.concatenate([hf, hb], 2)
                e = on * (1 / (1 + np.exp(-(h @ p["V"] + p["v"]))) - y) / on.sum()
                dh = e @ p["V"].T
                n = self.hidden
                zf, uf = self._back(dh[:, :, :n], on, p["Uf"], kf)
                zb, ub = self._back(dh[::-1, :, n:], on[::-1], p["Ub"], kb)
                zb = zb[::-1]
                flat = x.reshape(-1, x.shape[2])
                grad = {
                    "V": (h.reshape(-1, 2 * n).T @ e.reshape(-1, 1)), "v": e.sum((0, 1)), "Uf": uf, "Ub": ub, "cf": zf.sum((0, 1)), "cb": zb.sum((0, 1)),
                    "Wf": flat.T @ zf.reshape(-1, 4 * n), "Wb": flat.T @ zb.reshape(-1, 4 * n),
                }
                step += 1
                rate = 0.03 * (1 if epoch < 0.7 * epochs else 0.3)
                for k, v in grad.items():
                    v = np.clip(v, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


_SIDE = (
    '<aside>{}</aside>', '<div class="sidebar">{}</div>', '<div id="sidebar" class="widget">{}</div>', '<div class="ad">{}</div>', '<div class="advertisement">{}</div>', '<div class="banner promo">{}</div>',
    '<div class="cookie-notice">{}</div>', '<div id="cookie-consent">{}</div>', '<div class="notice">{}</div>', '<div class="newsletter"><form action="/s">{}<button>Go</button></form></div>', '<form>{}</form>',
    '<section class="comments">{}</section>', '<div id="comments"><div class="comment">{}</div></div>', '<ul class="comments"><li class="comment">{}</li></ul>', '<div class="related">{}</div>', '<div class="share social">{}</div>',
    '<div class="breadcrumb">{}</div>', '<div role="complementary">{}</div>', '<div class="popup">{}</div>', '<div class="sponsored">{}</div>',
)
_TOP = ("<header>{}</header>", '<header class="masthead">{}</header>', '<div id="header">{}</div>', '<div class="topbar">{}</div>', "<nav><ul><li><a href=\"/x\">{}</a></li></ul></nav>", '<div class="menu"><ul><li>{}</li></ul></div>', '<div role="navigation">{}</div>')
_END = ("<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer"><p>{}</p></div>', '<div role="contentinfo">{}</div>', '<div class="copyright">{}</div>')
_MAIN = ("<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post-body">{}</div>', '<article class="post"><header>{}</header></article>', '<div role="main">{}</div>', "<section>{}</section>")
_TEXT = ("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<ol><li>{}</li></ol>", "<blockquote>{}</blockquote>", "<div>{}</div>", "<p><b>{}</b><br>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>")


def _named(words: list[str], rng: np.random.Generator) -> str:
    """An element that one of the words names."""
    tag, attr, word = (str(rng.choice(x)) for x in (("div", "div", "section"), ("class", "id"), words))
    return f'<{tag} {attr}="{word}">{{}}</{tag}>'


def composed(texts: list[str], rng: np.random.Generator) -> str:
    """A page of usual layout with texts in random places."""
    beside, main = sorted(ASIDE_WORDS), sorted(MAIN_WORDS)
    take = lambda forms: html.escape(texts[rng.integers(len(texts))])[: int(rng.choice([40, 90, 200, 2000]))].join(str(rng.choice(forms)).split("{}"))
    side = lambda: "".join((_named(beside, rng) if rng.random() < 0.4 else str(rng.choice(_SIDE))).replace("{}", take(_TEXT) if rng.random() < 0.6 else take(("{}",))) for _ in range(rng.integers(0, 4)))
    top = "".join(take(_TOP) for _ in range(rng.integers(0, 4)))
    body = take(("<h1>{}</h1>",)) if rng.random() < 0.8 else ""
    for _ in range(rng.integers(0, 14)):
        body += take(_TEXT)
        if rng.random() < 0.15:
            body += side()
    if rng.random() < 0.3:
        body += side()
    return f"<html><body>{top}{side()}{(_named(main, rng) if rng.random() < 0.4 else str(rng.choice(_MAIN))).replace('{}', body)}{side()}{''.join(take(_END) for _ in range(rng.integers(0, 3)))}</body></html>"


def train(pages: list[str], seed: int = 5) -> Labeller:
    """Fit a labeller on the given pages and twice as many composed ones."""
    rng = np.random.default_rng(seed)
    own = [b for p in pages if (b := blocks(p))]
    # Blocks, not pages, set the cost of training: long pages give TRAIN_STRETCHES stretches, the first and the last among them.
    starts = lambda n: sorted({round(k * max(0, n - STRETCH) / (TRAIN_STRETCHES - 1)) for k in range(TRAIN_STRETCHES)})
    own = [p[i : i + STRETCH] for p in own for i in starts(len(p))]
    texts = sorted({b.text for p in own for b in p if len(b.text) > 3}) or ["text"]
    made = [blocks(composed(texts, rng)) for _ in range(2 * max(len(own), 60))]
    given = [p for p in own + made if p]
    return Labeller((1 << PATH_BITS) + (1 << WORD_BITS) + N_MEASURES).fit([vectors(p) for p in given], [labels(p).astype(np.float32) for p in given])


def train_on(pages: DataFrame, html_col: str = "html", bound: int = TRAIN_PAGES) -> Labeller:
    """A labeller trained, in one task, on `bound` pages at most. A table without text trains on composed pages alone."""
    h = F.xxhash64(html_col)
    filled = pages.where(F.length(html_col) > 0)
    # Hashes first, so that copies of a page count once and only the chosen pages travel.
    least = [r.h for r in filled.select(h.alias("h")).distinct().orderBy("h").limit(bound).collect()]
    some = filled.where(h.isin(least)).select(h.alias("h"), F.col(html_col).alias("html")).dropDuplicates(["h"])
    none = pages.sparkSession.range(1).select(F.lit(0).cast("long").alias("h"), F.lit("").alias("html"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = io.BytesIO()
        np.savez(out, **train(sorted(p for b in batches for p in b.column(1).to_pylist() if p)).p)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["weights"])

    made = some.unionByName(none).coalesce(1).mapInArrow(of, "weights binary").first()[0]
    model = Labeller((1 << PATH_BITS) + (1 << WORD_BITS) + N_MEASURES)
    model.p = dict(np.load(io.BytesIO(made)))
    return model


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """(id_col, text): one row per input row; the blocks labelled main text, joined by line feeds, empty if there is none.

    Null and empty pages have empty text; broken markup is read as far as it goes; repeated rows are read like others. An
    empty table gives an empty result; further columns are ignored.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            cut = [blocks(p) for p in b.column(1).to_pylist()]
            said = model.scores([vectors(p) for p in cut])
            texts = ["\n".join([x.text for x, y in zip(p, s, strict=True) if y > threshold]) for p, s in zip(cut, said, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return in_arrow(pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")), of, f"id {kind}, text string").withColumnRenamed("id", id_col)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Null and empty pages, and pages without main text, have an empty one; repeats are read like
    others; an empty table gives no rows; further columns are ignored."""
    pages = table(spark, sf_dir, "pages")
    keyed = pages.select(F.struct("page_id", "url").alias("k"), "html")
    made = extract(keyed, train_on(pages), "k")
    return made.select("k.page_id", "k.url", "text", F.length("text").cast("long").alias("n_chars"))
