"""Vectors, toxicity, pages and the pipeline: brute force where there is one, held-out accuracy, odd rows."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from shelfmark.llm import pages, toxicity, vectors
from shelfmark.registry import QUERIES


def by_force(rows, threshold):
    unit = []
    for _, v in rows:
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    linked = lambda a, b: unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold
    n = len(rows)
    links = [sum(linked(a, b) for b in range(n) if a != b) for a in range(n)]
    return [(rows[k][0], links[k], rows[g][0]) for k, g in enumerate(brute.groups(n, linked))]


@pytest.mark.parametrize("dense", [0, 500])
def test_vectors(spark, dense):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    rows = [c + 0.05 * rng.standard_normal(16) for c in centres for _ in range(6)] + [centres[0] + 0.08 * rng.standard_normal(16) for _ in range(dense)]
    rows += list(rng.standard_normal((300, 16))) + [rows[3], rows[3] * 2.0]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]
    k = len(rows)
    rows += [(k, None), (k + 1, []), (k + 2, [0.0] * 16), (k + 3, [float("nan")] * 16), (k + 4, [1.0, None]), (k + 5, [float("inf")] * 16), (k + 6, [1.0, 2.0]), (k + 7, [1.0, 2.0]), (k + 8, rows[0][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("node", T.StringType())]))
    made = {r.vec_id: (r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(frame).collect()}
    assert made == {x[0]: x for x in by_force(rows, 0.95)}


def test_vectors_whole(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    made = {r.vec_id: (r.vec_id, r.n_links, r.component_id) for r in QUERIES["op2_embedding_near_dedup"](spark, sf).collect()}
    assert made == {x[0]: x for x in by_force(rows, 0.95)}


def test_vectors_without_ids_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
    made = vectors.near_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, None)], schema)).collect()
    assert sorted(map(str, [(r.vec_id, r.n_links, r.component_id, r.kept) for r in made])) == sorted(map(str, [(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, False)]))


def test_toxicity(spark):
    rng = random.Random(2)
    plain = [a + b for a in ("an", "re", "ti", "ou", "en", "st") for b in ("the", "ly", "ion", "ing", "ed", "er", "ha")]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(8, 200))]
        bad = i % 9 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), "rotten" + rng.choice("abcdefghijklm") * 2)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "anthe"), (3, rows[3][1])]
    labels += [(None, 1), (2000, 0), (5, None), (7, 0)]
    docs = spark.createDataFrame([(i, t, "s", 1.0) for i, t in rows], "doc_id long, text string, key string, score double")
    made = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in made if r.held_out and r.doc_id < 900]
    wrong = [r for r in held if r.predicted != (r.doc_id % 9 == 0)]
    assert len(made) == len(rows) and len(wrong) <= 0.03 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in made)
    none = toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/">Home</a><li><a href="/x">Link {n}</a></ul></nav><div class="cookie-notice">We use cookies {n}</div>
<div id="wrap"><div class="content"><h1>Head {n} &amp; more</h1><p>First <b>bo</b>ld   text {n}.<br>Second line&nbsp;here</p><p>{body}</p><table><tr><td>cell{n}<td>two</table></div>
<div class="sidebar"><p>Read also this long and winding text number {n} that is no article at all</p></div>
<section id="comments"><p>A reader says {n} that this and that is so and much more of the same kind</p></section></div>
<form><input name="q"><label>Search</label></form><footer>All rights {n}</footer>"""


def test_pages(spark):
    body = "Some sentences of the text number {n} that go on for a while so that there is enough of them."
    rows = [(n, f"http://h.example/{n}", PAGE.format(n=n, body=body.format(n=n))) for n in range(6)]
    want = {n: f"Head {n} & more First bold text {n}. Second line here {body.format(n=n)} cell{n} two" for n in range(6)}
    rows += [(10, "http://h.example/0", rows[0][2]), (11, None, "<p>bare <i>t</i>ext"), (12, "x", None), (13, "", ""), (14, "http://h.example/z", "plain words only"), (15, "//o.example/", "<div>" * 300 + "deep" + "</div>" * 300), (None, "http://p.example", "<article><p>a</p></article>")]
    want |= {10: want[0], 11: "bare text", 12: "", 13: "", 14: "plain words only", 15: "deep", None: "a"}
    frame = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, host int")
    made = {r.page_id: r for r in pages.extract_pages(frame).collect()}
    assert {k: r.text for k, r in made.items()} == want
    assert all(r.n_chars == len(r.text) and r.host == 5 for r in made.values())
    assert pages.extract_pages(frame.limit(0)).count() == 0


def test_pages_whole(spark, sf):
    import html
    import re

    made = {r.page_id: r.text for r in QUERIES["op10_page_text"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", inner)]
        assert made[r.page_id] == " ".join(x for x in parts if x)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    ids = [r.doc_id for r in out]
    assert len(set(ids)) == len(ids) and 0 < len(ids) < docs.count()
    assert all(r.round_trip and r.parity for r in out)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert not any(x[3] for x in brute.contamination([r.text for r in out], items))
    left = [line for r in out for line in r.text.split("\n") if line.strip()]
    assert len(left) == len(set(" ".join(brute.BLANK.split(x)).strip() for x in left))
    assert [c for c in docs.columns] == [c for c in out[0].asDict() if c in docs.columns]
    assert all(r.n_chars == len(r.text) for r in out)
