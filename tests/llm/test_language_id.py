"""Gradients against differences, labels against a plain loop, held-out accuracy."""
import zlib

import numpy as np
from pyspark.sql import functions as F

from filings_engine.llm import language_id as G


def test_gradients():
    net = G.Network(3, hidden=3, seed=1)
    r = np.random.default_rng(2)
    x, y = r.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1])
    x[4:, 1] = G.PAD
    _, grads = net.loss(x, y)
    for k, g in grads.items():
        for at in [tuple(r.integers(0, n) for n in g.shape) for _ in range(4)] + [(0, int(x[0, 0])) if k[0] == "E" else (0, 0)]:
            old, step = net.p[k][at], 1e-5
            net.p[k][at] = old + step
            up = net.loss(x, y)[0]
            net.p[k][at] = old - step
            down = net.loss(x, y)[0]
            net.p[k][at] = old
            if k[0] == "E" and at[1] == G.PAD:
                continue
            assert abs((up - down) / (2 * step) - g[at]) < 1e-6, k


def plain(p, h, text):
    """One text, byte by byte."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = {}
    for way in "fb":
        s, states[way] = np.zeros(h), [None] * len(text)
        for t in (range(len(text)) if way == "f" else reversed(range(len(text)))):
            a, g = p["E" + way][:, text[t]], p["U" + way] @ s
            z, r = sig(a[:h] + g[:h]), sig(a[h:2 * h] + g[h:2 * h])
            n = np.tanh(a[2 * h:] + r * g[2 * h:])
            s = (1 - z) * n + z * s
            states[way][t] = s
    v = [p["c"][:, 0] + p["Wf"] @ a + p["Wb"] @ b for a, b in zip(states["f"], states["b"])]
    return [np.exp(q - q.max()) / np.exp(q - q.max()).sum() for q in v]


def test_pooling_reads_every_byte():
    net = G.Network(3, hidden=4, seed=3)
    texts = [b"abc", b"", bytes(range(256)) * 2, b"z" * 20, b"hello world, " * 9]
    got = G.pooled(net.frozen(), texts, window=16, lanes=5)
    for t, g in zip(texts, got):
        labels = [q for a in range(0, len(t), 16) for q in plain(net.p, 4, t[a:a + 16])]
        assert np.allclose(g, np.mean(labels, 0) if labels else 0, atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.col("doc_id")
    model = G.fit_language(docs, ~G.held_out(out))
    got = G.identify(docs, model).join(docs.select("doc_id", "lang", "text", G.held_out(out).alias("out")), "doc_id").collect()
    assert {r.doc_id for r in got if r.out} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    tested = [r for r in got if r.out and r.lang and len(r.text.split()) >= 5]
    assert sum(r.lang_pred == r.lang for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in got)


def test_rows(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de", 1) for i in range(40)]
    rows += [(None, "the dog", None, 1), (100, None, "en", 1), (101, "", "de", 1), (102, "12 3!", "de", 1), (1, rows[1][1], "en", 1), (103, "the cat and " * 20000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = G.fit_language(docs, ~G.held_out(F.col("doc_id")), steps=40)
    got = G.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[100] == by[101] == by[102] == "und" and by[1] == by[103] == "en" and by[2] == "de"
    empty = docs.limit(0)
    assert G.identify(empty, G.fit_language(empty, F.lit(True))).count() == 0
    assert {r.lang_pred for r in G.identify(docs, ([], {})).collect()} == {"und"}
