"""Ranked search, spelling groups and quality rules against brute-force versions on awkward rows, and on empty tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.llm import lexical, quality, spelling
from spanmill.llm.common import CHUNK_BYTES

CLASH = "doc_id long, text string, row string, k1 string, doc int, item string, term int, good int, word int, n string, s int, score string, body string"
SPACE = r"[^\x20\x09-\x0D]+"


def ascii_lower(s: str) -> str:
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), s)


def rows_of(pairs):
    return [(i, t, "r", "k", 1, "i", 2, 3, 4, "n", 5, "x", "b") for i, t in pairs]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    vocabulary = "alpha alphas alpho beta betas gamma gammma delta deltas epsilon epsilom zeta Ünder ünder straße x 42 \U0001f600".split()
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "..."), (5, "one"), (5, "one"), (None, "alpha beta gamma"), (None, "Alpha delta"), (6, "é" * 70_000), (7, "alpha " * 900)]
    out += [(10 + i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 90)))) for i in range(60)]
    out += [(100 + i, out[-1][1]) for i in range(30)] + [(200, "word | " * 60), (201, "line one\nline one\n\nline two\nline one"), (202, "a\x85b\x1cc  d")]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), CLASH).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


# ranked search

ITEMS = [(1, "alpha beta"), (2, "Gamma, delta! delta"), (3, None), (4, "nowhere"), (5, "ünder x 42 \U0001f600"), (None, "zeta"), (7, "alpha beta"), (7, "alpha beta"), (8, "one epsilon straße")]


def brute_rank(texts, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall(ascii_lower(t or ""))
    held = [(i, Counter(split(t))) for i, t in texts]
    held = [(i, c) for i, c in held if c]
    docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in held:
            m = 10 + 90 * c.total() * docs // total
            s = sum(math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(split(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, block, pairs", [(1 << 14, 64, 1 << 20), (8, 2, 4)])
def test_search(spark, docs, none, texts, monkeypatch, shard, block, pairs):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "ITEM_TERMS", pairs)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(map(tuple, lexical.rank(docs, items, k=7).collect()), key=repr)
    assert got == brute_rank(texts, ITEMS, 7) and len(got) > 30
    assert lexical.rank(none, items).count() == 0 and lexical.rank(docs, items.limit(0)).count() == 0


def test_search_rejects_blocks():
    """With a threshold, blocks of the non-essential lists stay packed, and the result is that of a full count."""
    r = np.random.default_rng(5)
    m = np.full(4000, 40)
    term = [np.sort(r.choice(4000, n, replace=False)) for n in (4000, 3000, 40, 12)]
    doc, number = np.concatenate(term), np.repeat(np.arange(4), [len(t) for t in term])
    order = np.lexsort((number, doc))
    tf = r.integers(1, 400, len(doc))
    weight = np.array([3, 40, 4000, 9000])
    s = lexical.Shard(m, np.bincount(doc, minlength=4000), number[order].astype(np.int32), tf[order], weight)
    full = np.zeros(4000, np.int64)
    np.add.at(full, doc[order], lexical.part_score(weight[number[order]], tf[order], m[doc[order]]))
    read, plain = [], lexical.Shard.read
    s.read = lambda b: (read.append(len(b)), plain(s, b))[1]
    least = int(np.sort(full)[-5])
    found, score = s.search(np.arange(4), 10, least)
    assert dict(zip(found.tolist(), score.tolist())) == {i: int(x) for i, x in enumerate(full) if x >= least}
    assert sum(read) < len(s.first) / 2


def test_length_share_beyond_64_bits():
    assert lexical.length_share(np.array([10**10]), 10**11, 10**13).tolist() == [10 + 90 * 10**10 * 10**11 // 10**13]


# spelling

def brute_groups(count, ratio=5):
    near = defaultdict(set)
    letters = sorted(set("".join(count)))
    for w in count:
        for i in range(len(w) + 1):
            for x in [w[:i] + w[i + 1 :]] + [w[:i] + c + w[i:] for c in letters] + [w[:i] + c + w[i + 1 :] for c in letters]:
                if x in count and x != w:
                    near[w].add(x)
    best = {w: min(near[w], key=lambda x: (-count[x], x)) for w in count if near[w]}
    form = {w: b for w, b in best.items() if count[b] >= ratio * count[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted([(w, form.get(w), root(w), n, len(near[w]), count[form[w]] if w in form else None) for w, n in count.items()], key=repr)


def test_vocabulary(spark, docs, none, texts, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 7)
    more = texts + [(300, "Straßen " * 12 + "aé" * 300_000 + " " + "longer words × ÷ " * 80_000)]
    want = Counter()
    for i, t in more:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = ascii_lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 3 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 2}
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more[-1:], "doc_id long, text string"))
    got = {r["word"]: r["n"] for r in spelling.vocabulary(d, min_len=5, min_count=2, drop_every=3).collect()}
    assert got == want and len(more[-1][1].encode()) > 2 * CHUNK_BYTES
    assert spelling.groups(spelling.vocabulary(none)).count() == 0


@pytest.mark.parametrize("bucket", [2048, 1])
def test_groups(spark, bucket):
    r = random.Random(2)
    count = {"chain": 1, "chains": 5, "chainsy": 25, "chainsyx": 125, "chainsyxw": 9000, "tie": 1, "tin": 9, "tip": 9, "alone": 4, "ñandú": 3, "nandú": 15, "aaaa": 2, "aaaaa": 40, "listen": 7, "silent": 70}
    for _ in range(250):
        w = "".join(r.choice("abc") for _ in range(r.randrange(3, 8)))
        count.setdefault(w, r.choice((1, 1, 2, 6, 30, 200)))
    words = spark.createDataFrame(list(count.items()), "word string, n long").repartition(3)
    got = sorted(map(tuple, spelling.groups(words, bucket=bucket).collect()), key=repr)
    assert got == brute_groups(count)
    with pytest.raises(ValueError):
        spelling.groups(words, ratio=1)


# quality

def brute_quality(texts, trusted):
    space = re.compile(SPACE)
    size = sum(len((t or "").encode()) for _, t in texts)
    buckets = next(2**k for k in range(16, 23) if 4**k >= size or k == 22)

    def h(w):
        x = 0
        for c in w:
            x = (x * quality.BASE + ord(c)) % quality.PRIME
        return x

    def grams(t):
        x = [h(w) for w in space.findall(t or "")]
        return [v % buckets for v in x + [(a * quality.JOIN + b + 1) % quality.PRIME for a, b in zip(x, x[1:])]]
    raw, good = Counter(), Counter()
    for i, t in texts:
        raw.update(grams(t))
        if i in trusted and i is not None:
            good.update(grams(t))
    r, g = raw.total(), good.total()
    weight = {b: math.floor(1e6 * math.log((good[b] + 10.0) / (raw[b] * float(g) / r + 10.0))) for b in raw}
    out = []
    for i, t in texts:
        w = space.findall(t or "")
        x = grams(t)
        score = sum(weight[b] for b in x) // max(len(x), 1)
        seen = Counter(zip(w, w[1:], w[2:]))
        cover = {j + o for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for o in range(3)}
        lines = [x for x in (t or "").split("\n") if space.search(x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover), score, failed, not failed and score >= -90_000))
    return sorted(out, key=repr)


def test_quality(spark, docs, none, texts):
    more = texts + [(300, "w" * 5000 + " " + "z" * 2048 + " |" * 7), (301, " ".join(f"t{i}###" for i in range(80)))]
    d = docs.select("doc_id", "text", "good", "body").unionByName(spark.createDataFrame([(*x, 0, "b") for x in more[-2:]], "doc_id long, text string, good int, body string"))
    trusted = {i for i, _ in texts if i is not None and i < 150}
    ids = spark.createDataFrame([(i,) for i in [*trusted, None, 10, 10]], "doc_id long")
    w = quality.train(d, ids)
    got = sorted((tuple(r) for r in quality.judge(d, w).collect()), key=repr)
    want = brute_quality(more, trusted)
    assert got == want and {x[-1] for x in want} == {True, False} and any(x[5] for x in want)
    kept = quality.keep_good(d, w)
    assert kept.columns == d.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(x[0] or 0 for x in want if x[-1])
    assert quality.judge(none, quality.train(none, ids)).count() == 0
    lone = quality.judge(d, quality.train(d, ids.limit(0)))
    assert lone.filter(F.col("score") != 0).count() == 0


def test_held_out_quality(spark):
    """Labels not trained on: junk goes, clean documents stay."""
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    w = quality.train(d, labels.filter("quality = 1 and doc_id % 2 = 0").select("doc_id"))
    j = quality.judge(d, w).withColumnRenamed("doc", "doc_id").join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed")
    share = {r[0]: r[1] for r in j.groupBy("quality").agg(F.avg(F.col("kept").cast("double"))).collect()}
    assert share[1] > 0.99 and share[0] < 0.01


def test_buckets_grow():
    assert [quality.buckets_for(x) for x in (0, 10**9, 10**11, 10**15)] == [1 << 16, 1 << 16, 1 << 19, 1 << 22]


def test_encoder_shares_calls():
    """Words are encoded many to a call, with the ids of the whole text, whatever white space and marks lie between them."""
    import numpy as np

    from spanmill.llm import packing
    enc, calls = packing.Encoder(packing.default_vocabulary()), []
    texts = ["a\n b\n\nc", "x  y", "don't. \u00e9!! \u00f1?\tq", " lead and trail ", "", "\n", " \n", "\u4e2d\u6587. a\u00a0b", " ".join(f"word{i}." for i in range(2000))]
    whole = [np.frombuffer(x, "<u4").tolist() for x in enc._ids(texts)]
    ids = enc._ids
    enc._ids = lambda t: (calls.extend(t), ids(t))[1]
    assert [x.tolist() for x in enc.encode(texts)] == whole and len(calls) < 100
    assert [x.tolist() for x in enc.encode(texts)] == whole
