"""Nearest neighbours, page texts, toxicity and the pipeline: brute force, held-out accuracy, awkward rows."""

from __future__ import annotations

import time
import html
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.llm import ann, html_text, toxicity


def test_ann_recall_and_scores(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rows += [(9001, None), (9002, [0.0] * 64), (9003, [1.0, None] + [0.0] * 62), (9004, [float("nan")] + [1.0] * 63), (9005, [1.0, 2.0]), (None, [1.0] * 64), (9006, [float("inf")] + [1.0] * 63), (50, rows[1][1])]
    v = spark.createDataFrame([(i, x, "a", 1) for i, x in rows], "vec_id long, embedding array<float>, v string, dim int")
    got = ann.nearest(v, lambda c: c % 50 == 0, k=5, block=(150, 8)).collect()
    best = {}
    for i, x in rows:
        if i is not None and x is not None and None not in x and all(map(math.isfinite, x)) and any(x) and len(x) == 64:
            best[i] = min(best.get(i, x), x)
    ids = np.array(sorted(best))
    m = np.array([best[i] for i in ids.tolist()])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = total = 0
    for q in ids[ids % 50 == 0].tolist():
        s = m @ m[ids == q][0]
        s[ids == q] = -9
        want = ids[np.lexsort((ids, -s))[:5]].tolist()
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(c - s[ids == j][0]) < 1e-12 for _, j, c in mine)
        assert [c for *_, c in mine] == sorted((c for *_, c in mine), reverse=True)
        hit += len({j for _, j, _ in mine} & set(want))
        total += 5
    assert hit / total >= 0.9


def test_ann_small(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(v, lambda c: c % 50 == 0, k=5).orderBy("rank").collect()]
    assert [(r[1], r[2]) for r in got] == [(1, 1), (2, 2), (3, 3)] and got[0][3] == 1.0
    assert ann.nearest(v.limit(0), lambda c: c % 50 == 0).count() == 0


PAGES = [
    (1, "<body><nav><a href=/>home</a></nav><article><h1>T &amp; U</h1><p>first   para <b>bold</b> text.<p>second&nbsp;para<br>goes on &copy 1</article><footer>foot</footer>",
     "T & U first para bold text. second para goes on © 1"),
    (2, None, ""), (3, "", ""), (4, "<html><head><title>t</title><style>x{}</style></head><body><script>var a='<p>no</p>';</script></body></html>", ""),
]


@pytest.fixture(scope="module")
def model(spark):
    return html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), sample=120)


def article(h: str) -> str:
    m = re.search(r"<article>(.*?)</article>", h or "", re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", m[1])).split()) if m else ""


def test_page_texts_of_unseen_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["doc"]: r for r in html_text.extract(pages, model).collect()}
    assert len(got) == pages.count()
    right = sum(got[r["page_id"]]["text"] == article(r["html"]) for r in pages.collect())
    assert right >= 0.99 * len(got) and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_page_cases(spark, model):
    long = "<article>" + "<p>words that go on and on.</p>" * 3000 + "</article>"
    rows = [(i, "u", h, 1) for i, h, _ in PAGES] + [(9, None, long, 1), (1, "u", PAGES[0][1], 1)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, doc int"), model).collect()
    by = {r["doc"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(by[i] == t for i, _, t in PAGES) and by[9] == " ".join(["words that go on and on."] * 3000)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(empty).count() == 0


def test_gradients_of_the_labeller():
    net = html_text.Labeller()
    blocks = [("body", "nav"), ("body", "article", "p"), ("body", "footer")]
    pages = [html_text.page_features([(p, "some words here.", 0) for p in blocks]), html_text.page_features([(blocks[1], "other", 2)])]
    y = np.array([0.0, 1, 0, 1])

    def loss():
        z = net.forward(pages)
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))
    g = net.gradients(pages, y)
    r = np.random.default_rng(0)
    for k, w in net.w.items():
        for _ in range(4):
            at = tuple(int(r.integers(n)) for n in w.shape)
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, rest = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0 and quality = 1")
    m = toxicity.train(docs, train, sample=3000)
    j = toxicity.score(docs, m).join(rest, F.col("doc") == F.col("doc_id")).groupBy("rejected", "toxic").count().collect()
    n = {(r["rejected"], r["toxic"]): r["count"] for r in j}
    assert n.get((True, 1), 0) / (n.get((True, 1), 0) + n.get((False, 1), 0)) >= 0.9
    assert n.get((True, 0), 0) / (n.get((True, 0), 0) + n.get((False, 0), 0)) <= 0.02


def test_toxicity_cases(spark):
    rows = [(i, "fine calm words here" if i % 2 else "fine vile words here", 7) for i in range(60)] + [(100, None, 7), (101, "", 7), (None, "vile", 7), (1, "fine calm words here", 7), (102, "vile " * 50_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (2, 1, 1)], "doc_id long, quality int, toxic int")
    m = toxicity.train(docs, labels)
    got = {r["doc"]: r["rejected"] for r in toxicity.score(docs, m).collect()}
    assert got[0] and got[58] and not got[1] and not got[59] and not got[100] and not got[101]
    kept = toxicity.keep_clean(docs, m)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 59, 100, 101} and 58 not in {r["doc_id"] for r in kept.collect()}
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.keep_clean(docs, nothing).count() == docs.count() and toxicity.score(docs.limit(0), nothing).count() == 0


def test_chain_uses_earlier_categories():
    r = np.random.default_rng(1)
    x = (r.random((400, 6)) < 0.3).astype(float)
    y = np.stack([x[:, 0], np.where(r.random(400) < 0.9, x[:, 0], x[:, 1])], 1)
    models, threshold = toxicity.train_chain(x, y)
    assert len(models[1]) == len(models[0]) + 1 and 0.1 <= threshold <= 0.9


def test_pipeline(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_labels_of_containers():
    """Furniture wins inside one container and keeps what lies inside it; an article in a page with a side bar is text."""
    label = html_text.weak_label
    text = [("html", "body", "article", "p"), ("body", "div", "c:post", "p"), ("div", "c:has", "c:sidebar", "article", "p"), ("article", "header", "h1")]
    none = [("div", "c:comments", "div", "c:comment", "c:body"), ("div", "c:comments", "article"), ("footer", "div", "c:footer", "c:content"), ("article", "aside", "c:content"), ("div", "c:content", "c:sidebar")]
    assert [label(p) for p in text] == [1] * 4 and [label(p) for p in none] == [0] * 5


def test_shared_inputs_equal_the_plain_forward_pass():
    """Pages of all lengths, labelled together in single precision, against the network page by page on sparse rows."""
    r = np.random.default_rng(3)
    pages = []
    for n in (1, 1, 2, 7, 30, 90):
        paths = [("html", "body", *(f"c:{x}" for x in r.choice(["post", "nav", "sidebar", "x"], 2, replace=False))) for _ in range(n)]
        pages.append([(p, " ".join(r.choice(["the", "a", "Menu", "word.", "é"], int(r.integers(1, 300)))), int(r.integers(0, 5))) for p in paths])
    net = html_text.Labeller()
    pages.sort(key=len, reverse=True)
    got = html_text.Scorer(net).logits(pages)
    assert all(np.allclose(g, net.forward([html_text.page_features(p)]), atol=1e-4) for g, p in zip(got, pages))


def test_deep_nesting_is_linear():
    began = time.perf_counter()
    deep = html_text.leaf_blocks("".join(f"<div class='x'>t{i}" for i in range(20_000)) + "<p>end" + "<b>x" * 20_000)
    assert len(deep) == 20_001 and deep[-1][0] == ("div", "c:x", "p", "b") and time.perf_counter() - began < 20
    long = " ".join(f"u{i}" for i in range(40)) + " sidebar comments"
    assert html_text.weak_label(html_text.leaf_blocks(f"<div class='{long}'><p>x")[0][0]) == 0 and html_text.leaf_blocks("</p></b><b><p>a</b>b<li>c<li>d")[-1][1] == "d"
