"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over words that are present and word beginnings that are frequent in the
text (inflected forms share their beginning); each model also sees the log-odds of the
categories before it. These come out of fold while training (a row's earlier probability is from a model that has not seen the row), so
later models learn how good the earlier ones really are. The last category decides, at the threshold with the best out-of-fold F1 (the one next to one half among about equals).

Training uses a bounded sample: the ``sample`` labelled rows whose ids hash lowest, their ``features`` most telling features (chi-squared over
the sample, at least ``min_docs`` documents), and one task that fits them (L1 logistic regression by accelerated proximal gradient; at
most sample x features numbers). Everything else covers all rows: every document is scored on its whole text.

Cases: a null or empty text scores the bias; rows without a label are scored, not trained on; repeated ids in the labels count once (a category holds if any
row says so); a category without both classes gets its smoothed rate; without labels nothing is toxic; empty tables give empty results;
extra columns of the documents are kept by ``keep_clean`` and ignored by ``score``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import land
from .common import chunks, packed
from .substring_dedup import _arrow, _column
from .tokens import ALNUM, Words, mix, word_hashes

SAMPLE, FEATURES, MIN_DOCS, FOLDS, L1 = 6000, 384, 5, 4, 2e-3
PREFIXES, LEVELS = (4, 5, 6, 7, 8), (0.006, 0.015, 0.04)  # bytes of a word beginning; shares of the words of a text
# earlier to later; conditions over the label table
CATEGORIES = {"toxic_prose": "toxic = 1 and quality = 1", "toxic_junk": "toxic = 1 and quality = 0", "toxic": "toxic = 1"}


def sample_documents(docs: DataFrame, labels: DataFrame, categories: Mapping[str, str], text: str, id: str, label_id: str, sample: int) -> DataFrame:
    """(doc, body, y): the training rows with one 0/1 per category."""
    y = labels.select(F.col(label_id).alias("lid"), *[F.coalesce(F.expr(c), F.lit(False)).cast("int").alias(f"c{i}") for i, c in enumerate(categories.values())])
    y = y.filter("lid is not null").groupBy("lid").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(categories))])
    y = y.orderBy(F.xxhash64("lid"), "lid").limit(sample).select("lid", F.array(*[f"c{i}" for i in range(len(categories))]).alias("y"))
    d = packed(docs, text, id).select("doc", "body")
    return land(d.join(F.broadcast(y), d["doc"] == y["lid"]).select("doc", "body", "y"))  # at most ``sample`` ids are broadcast


def _salted(h: np.ndarray, k: int) -> np.ndarray:
    return mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def evidence(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, level), each once: level -1 for a word that is present, level i for a word beginning whose share of all words of the
    text is at least LEVELS[i]. With ``wanted`` (sorted hashes) only these are looked at."""
    w = Words(texts, ALNUM, lower=True, pair=False)
    out_t, out_h, out_l = [], [], []
    for k in (0, *PREFIXES):
        ends = w.ends if k == 0 else np.minimum(w.ends, w.starts + k)
        h = _salted(word_hashes(w.buf, w.starts, ends) if k else w.h[0], k)
        t = w.text
        long = np.ones(len(h), bool) if k == 0 else w.ends - w.starts >= k
        if wanted is not None and len(wanted):
            long &= wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
        elif wanted is not None:
            long[:] = False
        t, h = t[long], h[long]
        order = np.lexsort((h, t))
        t, h = t[order], h[order]
        first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])]) if len(t) else np.empty(0, int)
        n = np.diff(np.append(first, len(t)))
        t, h = t[first], h[first]
        for level, share in [(-1, 0.0)] if k == 0 else enumerate(LEVELS):
            hit = n >= share * w.count[t]
            out_t.append(t[hit]), out_h.append(h[hit]), out_l.append(np.full(int(hit.sum()), level))
    return np.concatenate(out_t), np.concatenate(out_h), np.concatenate(out_l)


def words_task(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            t, h, level = evidence(texts)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64), pa.int64()), pa.array(level, pa.int32()), _column(part, "y").take(pa.array(t))], schema=schema)
    return run


def select_words(s: DataFrame, n_categories: int, features: int, min_docs: int) -> list[list[int]]:
    """[hash, level] of the most telling words and word beginnings, sorted (hashes as unsigned numbers); at most ``features``."""
    total = s.agg(F.count("*").alias("n"), *[F.sum(F.get("y", F.lit(i))).alias(f"p{i}") for i in range(n_categories)]).first()
    if not total["n"]:
        return []
    ddl = "h long, level int, y array<int>"
    w = s.mapInArrow(words_task(_arrow(ddl)), ddl).groupBy("h", "level").agg(F.count("*").alias("df"), *[F.sum(F.get("y", F.lit(i))).alias(f"a{i}") for i in range(n_categories)])
    scores = []
    for i in range(n_categories):
        n, p = float(total["n"]), float(total[f"p{i}"] or 0)
        if 0 < p < n:
            a, df = F.col(f"a{i}"), F.col("df")
            diff = a * n - df * p
            scores.append(diff * diff * n / (df * F.greatest(n - df, F.lit(1.0)) * p * (n - p)))
    if not scores:
        return []
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    top = w.filter(F.col("df") >= min_docs).orderBy(best.desc(), "h", "level").limit(features).select("h", "level").collect()
    return sorted([r["h"] & ((1 << 64) - 1), r["level"]] for r in top)


class Vocabulary:
    """Look-up of the chosen features in texts."""

    def __init__(self, chosen: list[list[int]]):
        self.size = len(chosen)
        self.hashes = np.unique(np.array([h for h, _ in chosen], np.uint64))
        self.keys = self._key(np.array([h for h, _ in chosen], np.uint64), np.array([v for _, v in chosen], np.int64))
        self.order = np.argsort(self.keys)

    @staticmethod
    def _key(h: np.ndarray, level: np.ndarray) -> np.ndarray:
        return mix(h + (level + 2).astype(np.uint64))

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, each once, by text."""
        t, h, level = evidence(texts, self.hashes)
        if not self.size or not len(t):
            return np.empty(0, int), np.empty(0, int)
        key = self._key(h, level)
        at = self.order[np.minimum(np.searchsorted(self.keys, key, sorter=self.order), self.size - 1)]
        hit = self.keys[at] == key
        pair = np.unique(t[hit].astype(np.int64) * self.size + at[hit])
        return pair // self.size, pair % self.size


def vectors_task(chosen: list[list[int]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(chosen)
        for part, texts in chunks(batches):
            t, f = v.find(texts)
            ends = np.searchsorted(t, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([_column(part, "doc").cast(pa.string()), _column(part, "y"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f, pa.int32()))], schema=schema)
    return run


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(x: np.ndarray, y: np.ndarray, l1: float = L1, steps: int = 150) -> np.ndarray:
    """Weights and bias (last): L1 logistic regression chooses the inputs, a second one with hardly any penalty weighs them."""
    w = _fit(x, y, l1, steps)
    chosen = np.flatnonzero(w[:-1])
    out = np.zeros(x.shape[1] + 1)
    out[[*chosen, -1]] = _fit(x[:, chosen], y, l1 / 100, steps)
    return out


def _fit(x: np.ndarray, y: np.ndarray, l1: float, steps: int) -> np.ndarray:
    """Accelerated proximal gradient; one class only: its smoothed rate."""
    n, k = x.shape
    w = np.zeros(k + 1)
    rate = (y.sum() + 0.5) / (n + 1)
    w[-1] = np.log(rate / (1 - rate))
    if not n or y.min() == y.max():
        return w
    xb = np.hstack([x, np.ones((n, 1), x.dtype)])
    v = np.ones(k + 1)
    for _ in range(15):
        v = xb.T @ (xb @ v)
        v /= np.linalg.norm(v)
    step = n / (0.25 * np.linalg.norm(xb @ v) ** 2 * 1.05)
    z, t = w.copy(), 1.0
    for _ in range(steps):
        new = z - step * (xb.T @ (sigmoid(xb @ z) - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def train_chain(x: np.ndarray, y: np.ndarray, folds: int = FOLDS) -> tuple[list[np.ndarray], float]:
    """One weight vector per category (words, earlier log-odds, bias) and the threshold of the last one."""
    n, m = y.shape
    fold = np.arange(n) % folds
    models: list[np.ndarray] = []
    inner = x.astype(float)
    p = np.zeros(n)
    for c in range(m):
        p = np.zeros(n)
        for f in range(folds):
            rest = fold != f
            if (~rest).any():
                p[~rest] = apply(fit(inner[rest], y[rest, c]), inner[~rest])
        models.append(fit(inner, y[:, c]))
        inner = np.hstack([inner, logit(p)[:, None]])
    truth = y[:, -1]
    if not truth.any():
        return models, 2.0
    grid = np.linspace(0.1, 0.9, 17)
    f1 = np.array([2 * truth[p >= t].sum() / max(1, (p >= t).sum() + truth.sum()) for t in grid])
    near = grid[f1 >= f1.max() - 0.005]  # of thresholds that are about as good, the one next to one half
    threshold = float(near[np.abs(near - 0.5).argmin()])
    return models, threshold


def train_task(features: int, categories: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, f, y) for b in batches for d, y, f in zip(*(c.to_pylist() for c in b.columns)))
        x, y = np.zeros((len(rows), features)), np.zeros((len(rows), categories))
        for i, (_, f, c) in enumerate(rows):
            x[i, f], y[i] = 1, c
        models, threshold = train_chain(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps({"models": [m.tolist() for m in models], "threshold": threshold})])], names=["model"])
    return run


def train(docs: DataFrame, labels: DataFrame, categories: Mapping[str, str] = CATEGORIES, text: str = "text", id: str = "doc_id", label_id: str = "doc_id",
          sample: int = SAMPLE, features: int = FEATURES, min_docs: int = MIN_DOCS) -> dict:
    """The model: names, vocabulary, weights per category, threshold."""
    s = sample_documents(docs, labels, categories, text, id, label_id, sample)
    vocabulary = select_words(s, len(categories), features, min_docs)
    if not vocabulary:
        return {"names": list(categories), "vocabulary": [], "models": [[0.0] * i + [-30.0] for i in range(len(categories))], "threshold": 2.0}
    ddl = "doc string, y array<int>, f array<int>"
    rows = s.mapInArrow(vectors_task(vocabulary, _arrow(ddl)), ddl).repartition(1).mapInArrow(train_task(len(vocabulary), len(categories)), "model string")
    return {"names": list(categories), "vocabulary": vocabulary} | json.loads(rows.first()["model"])


def probabilities(texts: list[bytes], model: dict, vocabulary: Vocabulary) -> np.ndarray:
    t, f = vocabulary.find(texts)
    out = np.zeros((len(texts), len(model["names"])))
    for c, w in enumerate(np.asarray(w) for w in model["models"]):
        k = vocabulary.size
        z = np.bincount(t, w[:k][f], len(texts)) + w[-1]
        for e in range(c):
            z += w[k + e] * logit(out[:, e])
        out[:, c] = sigmoid(z)
    return out


def score_task(model: dict, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model["vocabulary"])
        for part, texts in chunks(batches):
            p = probabilities(texts, model, v)
            yield pa.RecordBatch.from_arrays([_column(part, "doc"), *(pa.array(c) for c in p.T), pa.array(p[:, -1] >= model["threshold"])], schema=schema)
    return run


def score(docs: DataFrame, model: dict, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc, p_<category> ..., rejected: one row per document."""
    d = packed(docs, text, id).select("doc", "body")
    ddl = f"doc {d.schema['doc'].dataType.simpleString()}, " + "".join(f"p_{n} double, " for n in model["names"]) + "rejected boolean"
    return d.mapInArrow(score_task(model, _arrow(ddl)), ddl)


def clean_task(model: dict, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model["vocabulary"])
        for part, texts in chunks(batches, text):
            yield part.filter(pa.array(probabilities(texts, model, v)[:, -1] < model["threshold"]))
    return run


def keep_clean(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, all columns as they are."""
    return docs.mapInArrow(clean_task(model, text), docs.schema)
