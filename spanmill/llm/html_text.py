"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks (text between block-level tags; scripts, styles, head, comments and markup are none). A block is
a sparse vector of hashed tag-path tokens (tags, classes, ids, roles), hashed words and a few measures. A bidirectional LSTM in numpy reads
the whole sequence, so each block is judged in the context of the document, and labels it text or not.

Training: a bounded sample (``sample`` pages with the lowest id hash, of each up to ``TRAIN_BLOCKS`` blocks from its start, middle and end, with their
places in the page; of a page above ``TRAIN_CHARS`` characters as many from its start are read) in one task. No page is labelled by hand: the labels are weak ones from the meaning of tags and names, and the sample is varied by
inserting furniture blocks, renaming containers and dropping path tokens, so that names, words and neighbours all carry weight.
Every page of the table is then labelled whole: all names, all words, all blocks. Labelling shares work between blocks: the input of a tag path
is computed once per distinct path, words and measures are two products of matrices, and pages of like length advance together.

A path holds each token once, where it first occurs, so a page nested n deep costs n, not n^2.

Cases: null or empty html gives an empty text; broken markup is read as browsers roughly do; character references are decoded, also
without a semicolon where HTML allows it; repeated rows get equal results; an empty table gives an empty result; a page of any
length is read whole; extra columns are ignored.
"""

from __future__ import annotations

import io
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed
from .substring_dedup import _arrow, _column

SAMPLE, TRAIN_CHARS, TRAIN_BLOCKS, EPOCHS, BATCH, TOGETHER = 320, 200_000, 64, 10, 32, 256
PATH, WORD, MORE, HIDDEN = 512, 128, 8, 16
SIZE = PATH + WORD + MORE

# fixed values of HTML: elements without an end tag, inline elements, elements without text
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SKIP = set("script style template noscript head title svg math iframe object".split())
CLOSED_BY_BLOCK = "p"
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
# fixed values of the weak labels: what names of containers mean
FURNITURE_TAGS = set("nav footer aside header form button select menu dialog fieldset".split())
FURNITURE_NAMES = set("nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement banner promo sponsored "
                      "cookie cookies consent notice notices popup modal share sharing social related recommended comment comments reply replies discussion newsletter subscribe signup login search pagination "
                      "widget toolbar copyright legal disclaimer contentinfo complementary".split())
COMMENT_NAMES = set("comment comments reply replies discussion".split())
CONTENT_TAGS = ("article", "main")
CONTENT_NAMES = set("main content article post entry story body text".split())


@lru_cache(100_000)
def _names(kind: str, value: str) -> tuple[str, ...]:
    return tuple(f"{kind}:{x}" for x in re.findall(r"[a-z]+", value.lower()))


class Blocks(HTMLParser):
    """(path tokens, text, characters inside links) of every leaf block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...], frozenset[str]]] = [("", (), frozenset())]
        self.places: dict[str, list[int]] = {}  # open elements by tag, innermost last
        self.boxes: list[int] = [0]  # open elements that are not inline
        self.out: list[tuple[tuple[str, ...], str, int]] = []
        self.held: list[str] = []
        self.linked = self.skipped = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not asked for

    def _flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.out.append((self.stack[-1][1], text, self.linked))
            self.held, self.linked = [], 0

    def _pop(self, at: int) -> None:
        for tag, _, _ in reversed(self.stack[at:]):
            self.places[tag].pop()
            self.skipped -= tag in SKIP
        del self.stack[at:]
        while self.boxes[-1] >= at:
            self.boxes.pop()

    def _open(self, *tags: str) -> int:
        """Place of the innermost open element of one of the tags, 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.held.append(" ")
            return
        if tag not in INLINE:
            self._flush()
            if tag in SIBLINGS:
                at = self._open(*SIBLINGS[tag])
                if at > self._open("ul", "ol", "dl", "table", "select"):
                    self._pop(at)
            at = self._open(CLOSED_BY_BLOCK)
            if at and self.boxes[-1] == at:
                self._pop(at)
        if tag in VOID:
            return
        _, path, known = self.stack[-1]
        names = [tag]
        for k, v in attrs:
            if v and k in ("class", "id", "role"):
                names += _names(k[0], v)
        if not known.issuperset(names):
            path = (*path, *(n for n in dict.fromkeys(names) if n not in known))
            known = known.union(names)
        if tag not in INLINE:
            self.boxes.append(len(self.stack))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, path, known))
        self.skipped += tag in SKIP

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math") and self.stack[-1][0] == tag:
            self._pop(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        at = self._open(tag)
        if not at:
            return
        if tag not in INLINE:
            self._flush()
        elif self.boxes[-1] > at:
            return  # an inline end tag does not close blocks
        self._pop(at)

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        self.held.append(data)
        if self.places.get("a") and self.places["a"][-1] >= len(self.stack) - 3:
            self.linked += len(data.strip())

    def end(self) -> list[tuple[tuple[str, ...], str, int]]:
        self.close()
        self._flush()
        return self.out


def leaf_blocks(html: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    if not html:
        return []
    p = Blocks()
    p.feed(html)
    return p.end()


def weak_label(path: tuple[str, ...]) -> int:
    """1: text of the page, 0: furniture. Furniture stays furniture, whatever names lie inside; an article or main element is text again
    unless the furniture is a tag of its own or a list of comments."""
    inside = 0
    for t in path:
        name = t.partition(":")[2]
        if (t in FURNITURE_TAGS and not (t == "header" and inside == 1)) or name in COMMENT_NAMES:
            inside = -2
        elif name in FURNITURE_NAMES:
            inside = min(inside, -1)
        elif t in CONTENT_TAGS and inside > -2 or name in CONTENT_NAMES and inside > -1:
            inside = 1
    return int(inside == 1)


_CRC: dict[str, int] = {}


def _crc(s: str) -> int:
    if s not in _CRC:
        if len(_CRC) > 200_000:
            _CRC.clear()
        _CRC[s] = zlib.crc32(s.encode("utf-8", "surrogatepass"))
    return _CRC[s]


_BUCKET: dict[str, int] = {}


def _bucket(w: str) -> int:
    if len(_BUCKET) > 500_000:
        _BUCKET.clear()
    _BUCKET[w] = n = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORD
    return n


def measures(text: str, words: int, linked: int, at: int, count: int) -> tuple[float, ...]:
    n, last = len(text), max(1, count - 1)
    return (min(math.log1p(words) / 6, 2.0), linked / n, sum(map(text.count, ".,;!?")) / n * 10, float(text[-1] in ".!?"), at / last, (count - 1 - at) / last, float(at == 0), 1.0)


def block_features(path: tuple[str, ...], text: str, linked: int, at: int, count: int) -> tuple[list[int], list[float]]:
    """Indices and values of a block's sparse vector."""
    index = [_crc(t) % PATH for t in dict.fromkeys(path)]
    value = [1.0] * len(index)
    words = text.split()
    for k, n in Counter(_BUCKET[w] if w in _BUCKET else _bucket(w) for w in words).items():
        index.append(PATH + k), value.append(n / len(words))
    index += range(PATH + WORD, SIZE)
    value += measures(text, len(words), linked, at, count)
    return index, value


def page_features(blocks: list[tuple[tuple[str, ...], str, int]], places: list[int] | None = None, count: int | None = None) -> list[tuple[list[int], list[float]]]:
    return [block_features(p, t, k, i, count or len(blocks)) for i, (p, t, k) in zip(places or range(len(blocks)), blocks)]


class Labeller:
    """Bidirectional LSTM with one output per block; gates in the order input, forget, output, candidate."""

    NAMES = ("wx", "wh", "b", "out", "bias")

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {"wx": r.normal(0, 0.1, (2, SIZE, 4 * h)), "wh": r.normal(0, 0.2, (2, h, 4 * h)), "b": np.zeros((2, 4 * h)), "out": r.normal(0, 0.2, 2 * h), "bias": np.zeros(1)}
        self.w["b"][:, h : 2 * h] = 1

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **self.w)
        return f.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Labeller:
        out = cls()
        with np.load(io.BytesIO(data)) as z:
            out.w = {k: z[k] for k in cls.NAMES}
        return out

    def _inputs(self, rows: list[tuple[list[int], list[float]]], way: int) -> np.ndarray:
        """Input part of the gates for every block; sparse rows, a slice at a time."""
        out = np.empty((len(rows), 4 * HIDDEN))
        for lo in range(0, len(rows), 1024):
            part = rows[lo : lo + 1024]
            index = np.concatenate([np.asarray(i) for i, _ in part])
            value = np.concatenate([np.asarray(v) for _, v in part])
            first = np.cumsum([0] + [len(i) for i, _ in part[:-1]])
            out[lo : lo + len(part)] = np.add.reduceat(self.w["wx"][way][index] * value[:, None], first, axis=0)
        return out + self.w["b"][way]

    @staticmethod
    def _pad(pages: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """(position in the flat list of blocks, mask), time by page."""
        t = max(map(len, pages))
        first = np.cumsum([0] + [len(p) for p in pages[:-1]])
        n = np.array([len(p) for p in pages])
        at = np.arange(t)[:, None]
        return np.where(at < n, first + np.minimum(at, n - 1), 0), at < n

    def forward(self, pages: list[list[tuple[list[int], list[float]]]], keep: bool = False):
        """Log-odds of every block (flat), and what training needs."""
        rows = [r for p in pages for r in p]
        where, mask = self._pad(pages)
        h = HIDDEN
        states, memory = np.zeros((len(rows), 2 * h)), []
        for way in (0, 1):
            z = self._inputs(rows, way)[where]
            order = range(len(where)) if way == 0 else range(len(where) - 1, -1, -1)
            s, c = np.zeros((len(pages), h)), np.zeros((len(pages), h))
            steps = []
            for t in order:
                g = z[t] + s @ self.w["wh"][way]
                a = 1 / (1 + np.exp(-g[:, : 3 * h]))
                i, f, o, u = a[:, :h], a[:, h : 2 * h], a[:, 2 * h :], np.tanh(g[:, 3 * h :])
                m = mask[t][:, None]
                c2 = np.where(m, f * c + i * u, c)
                th = np.tanh(c2)
                s2 = np.where(m, o * th, s)
                if keep:
                    steps.append((t, s, c, i, f, o, u, th))
                live = mask[t]
                states[where[t][live], way * h : (way + 1) * h] = s2[live]
                s, c = s2, c2
            memory.append(steps)
        logits = states @ self.w["out"] + self.w["bias"][0]
        return (logits, rows, where, mask, states, memory) if keep else logits

    def gradients(self, pages, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the blocks."""
        logits, rows, where, mask, states, memory = self.forward(pages, keep=True)
        h = HIDDEN
        d = (1 / (1 + np.exp(-logits)) - y) / len(y)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["out"], g["bias"] = states.T @ d, np.array([d.sum()])
        back = d[:, None] * self.w["out"]
        index = np.concatenate([np.asarray(i) for i, _ in rows])
        value = np.concatenate([np.asarray(v) for _, v in rows])
        x = np.zeros((len(rows), SIZE))  # dense: a batch has at most BATCH * TRAIN_BLOCKS blocks and a few inserted ones
        np.add.at(x, (np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows]), index), value)
        for way in (0, 1):
            dz = np.zeros((len(rows), 4 * h))
            ds, dc = np.zeros((len(pages), h)), np.zeros((len(pages), h))
            for t, s, c, i, f, o, u, th in reversed(memory[way]):
                m = mask[t][:, None]
                a = ds + np.where(m, back[where[t], way * h : (way + 1) * h], 0)
                dc2 = dc + a * o * (1 - th * th)
                dg = np.hstack([dc2 * u * i * (1 - i), dc2 * c * f * (1 - f), a * th * o * (1 - o), dc2 * i * (1 - u * u)]) * m
                g["wh"][way] += s.T @ dg
                live = mask[t]
                dz[where[t][live]] = dg[live]
                ds, dc = np.where(m, dg @ self.w["wh"][way].T, ds), np.where(m, dc2 * f, dc)
            g["b"][way] = dz.sum(0)
            g["wx"][way] = x.T @ dz
        return g

    def fit(self, pages: list, labels: list[np.ndarray], epochs: int, seed: int = 11, rate: float = 0.02) -> None:
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        order = np.argsort([len(p) for p in pages], kind="stable")  # pages of like length share a batch
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for e in range(epochs):
            for b in r.permutation(len(batches)):
                g = self.gradients([pages[i] for i in batches[b]], np.concatenate([labels[i] for i in batches[b]]))
                step += 1
                for k in self.w:
                    m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                    m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                    self.w[k] -= rate * (1 - 0.8 * e / epochs) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)


def varied(pages: list[list[tuple[tuple[str, ...], str, int]]], seed: int = 5) -> tuple[list, list[np.ndarray]]:
    """Feature sequences and weak labels of the pages, and of variants with inserted furniture, renamed containers and dropped tokens."""
    r = np.random.default_rng(seed)
    texts = [t for p in pages for _, t, _ in p]
    names = sorted(FURNITURE_NAMES)
    tags = sorted(FURNITURE_TAGS)
    content = sorted(CONTENT_NAMES)
    out, labels = [], []

    def add(blocks, y):
        out.append(page_features(blocks)), labels.append(np.array(y, float))

    for p in pages:
        third = TRAIN_BLOCKS // 3
        middle = (len(p) - third) // 2
        places = range(len(p)) if len(p) <= TRAIN_BLOCKS else [*range(TRAIN_BLOCKS - 2 * third), *range(middle, middle + third), *range(len(p) - third, len(p))]
        whole, p = len(p), [p[i] for i in places]
        y = [weak_label(b[0]) for b in p]
        out.append(page_features(p, list(places), whole)), labels.append(np.array(y, float))
        for _ in range(2):
            # the container of the text under another name
            box = ("main",) if r.random() < 0.3 else ("div", ("c:", "i:")[r.integers(2)] + content[r.integers(len(content))]) if r.random() < 0.6 else ("article",)
            blocks, marks = [], []
            for (path, text, linked), k in zip(p, y):
                path = tuple(x for t in path for x in (box if t in CONTENT_TAGS else (t,)))
                path = tuple(t for t in path if r.random() > 0.05 or t in box)
                blocks.append((path, text, linked)), marks.append(k)
            for _ in range(int(r.integers(1, 7))):
                text = texts[r.integers(len(texts))]
                text = text if r.random() < 0.5 else " ".join(text.split()[: int(r.integers(1, 12))])
                outer = ("html", "body", *(box if r.random() < 0.35 else ()))
                own = (tags[r.integers(len(tags))],) if r.random() < 0.5 else (("div", "section", "ul", "p")[r.integers(4)], ("c:", "i:", "r:")[r.integers(3)] + names[r.integers(len(names))])
                leaf = ((), ("p",), ("ul", "li"), ("h2",), ("div",), ("label",))[r.integers(6)]
                # often a few blocks in a row belong to one container
                for _ in range(int(r.integers(1, 4))):
                    at = int(r.integers(len(blocks) + 1)) if r.random() < 0.5 else len(blocks) * int(r.integers(2))
                    blocks.insert(at, ((*outer, *own, *leaf), text, len(text) * int(r.random() < 0.3))), marks.insert(at, 0)
            add(blocks, marks)
    return out, labels


def train_task():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((i, h) for b in batches for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        pages = [p for p in (leaf_blocks(h) for _, h in rows) if p]
        if pages:
            net = Labeller()
            net.fit(*varied(pages), EPOCHS)
            yield pa.RecordBatch.from_arrays([pa.array([net.dump()], pa.binary())], names=["model"])
    return run


def train(pages: DataFrame, id: str = "page_id", html: str = "html", sample: int = SAMPLE) -> bytes | None:
    """The fitted labeller (about a quarter of a MB), or None without pages."""
    p = packed(pages, html, id).select("doc", "body").filter("body <> ''")
    ids = p.select("doc").distinct().orderBy(F.xxhash64("doc"), "doc").limit(sample).select(F.col("doc").alias("own"))
    s = p.join(F.broadcast(ids), F.col("doc").eqNullSafe(F.col("own"))).groupBy("doc").agg(F.min(F.substring("body", 1, TRAIN_CHARS)).alias("body"))
    row = s.repartition(1).mapInArrow(train_task(), "model binary").first()
    return bytes(row["model"]) if row else None


class Scorer:
    """The labeller's forward pass over whole pages: inputs shared between blocks, pages in step, single precision."""

    def __init__(self, net: Labeller):
        h = 4 * HIDDEN
        w = net.w["wx"].astype(np.float32)
        self.path_rows = np.concatenate([w[0, :PATH], w[1, :PATH]], 1)
        self.rest = np.concatenate([w[0, PATH:], w[1, PATH:]], 1)
        self.bias = net.w["b"].astype(np.float32).reshape(2 * h)
        self.wh, self.out, self.shift = net.w["wh"].astype(np.float32), net.w["out"].astype(np.float32), np.float32(net.w["bias"][0])
        self.known: dict[tuple[str, ...], int] = {}
        self.inputs = np.empty((1024, 2 * h), np.float32)

    def _path(self, path: tuple[str, ...]) -> int:
        at = self.known.get(path)
        if at is None:
            at = self.known[path] = len(self.known)
            if at == len(self.inputs):
                self.inputs = np.concatenate([self.inputs, np.empty_like(self.inputs)])
            self.inputs[at] = self.path_rows[[_crc(t) % PATH for t in path]].sum(0) + self.bias
        return at

    def _gates(self, blocks: list) -> np.ndarray:
        """Input part of the gates, both ways, of every block of some pages."""
        if len(self.known) > 20_000:
            self.known.clear()
        count = sum(map(len, blocks))
        paths, more, words, sizes = [], [], [], []
        for page in blocks:
            for i, (path, text, linked) in enumerate(page):
                split = text.split()
                paths.append(self._path(path)), sizes.append(len(split))
                words += [_BUCKET[w] if w in _BUCKET else _bucket(w) for w in split]
                more.append(measures(text, len(split), linked, i, len(page)))
        size = np.array(sizes)
        x = np.zeros((count, WORD + MORE), np.float32)
        x[:, WORD:] = more
        at = np.repeat(np.arange(count) * WORD, size) + np.array(words, np.int64)
        x[:, :WORD] = np.bincount(at, minlength=count * WORD).reshape(count, WORD) / size[:, None]
        return self.inputs[paths] + x @ self.rest

    def logits(self, blocks: list) -> list[np.ndarray]:
        """Log-odds of every block, page by page; ``blocks``: pages with one block at least, longest first."""
        z = self._gates(blocks)
        h, n = HIDDEN, np.array([len(p) for p in blocks])
        first = np.cumsum(n) - n
        live = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")  # pages that have a block t
        out = np.full(len(z), self.shift, np.float32)
        for way in (0, 1):
            s, c = np.zeros((len(n), h), np.float32), np.zeros((len(n), h), np.float32)
            zw, wh, o = z[:, way * 4 * h : (way + 1) * 4 * h], self.wh[way], self.out[way * h : (way + 1) * h]
            for t in range(n[0]) if way == 0 else range(n[0] - 1, -1, -1):
                k = live[t]
                rows = first[:k] + t
                g = zw[rows] + s[:k] @ wh
                a = 1 / (1 + np.exp(-g[:, : 3 * h]))
                c[:k] = a[:, h : 2 * h] * c[:k] + a[:, :h] * np.tanh(g[:, 3 * h :])
                s[:k] = a[:, 2 * h :] * np.tanh(c[:k])
                out[rows] += s[:k] @ o
        return np.split(out, first[1:])


def page_texts(net: Scorer | None, htmls: list[str | None]) -> list[str]:
    """Main texts; pages are labelled in batches of like length."""
    blocks = [leaf_blocks(h) for h in htmls]
    out = [""] * len(htmls)
    todo = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: -len(blocks[i]))
    for lo in range(0, len(todo) if net else 0, TOGETHER):
        part = todo[lo : lo + TOGETHER]
        for i, logits in zip(part, net.logits([blocks[i] for i in part])):
            out[i] = " ".join(b[1] for b, z in zip(blocks[i], logits.tolist()) if z > 0)
    return out


def extract_task(model: bytes | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Scorer(Labeller.load(model)) if model else None
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = page_texts(net, _column(part, "body").to_pylist())
                yield pa.RecordBatch.from_arrays([_column(part, "doc"), _column(part, "url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)
    return run


def extract(pages: DataFrame, model: bytes | None = None, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """doc, url, text, n_chars: one row per page. Without a model one is trained on these pages."""
    model = model or train(pages, id, html)
    p = packed(pages, html, id).select("doc", F.col(f"row.`{url}`").alias("url"), "body")
    ddl = f"doc {p.schema['doc'].dataType.simpleString()}, url {p.schema['url'].dataType.simpleString()}, text string, n_chars long"
    return p.mapInArrow(extract_task(model, _arrow(ddl)), ddl)
