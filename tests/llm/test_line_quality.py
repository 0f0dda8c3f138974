"""Base rule against a plain count, the chain against all labellings."""
import itertools
import random

import duckdb
import numpy as np
import pytest

from filings_engine.llm import line_quality as L


def plain_repeats(words, k=5):
    w = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
    return len({p for i, g in enumerate(w) if w.count(g) > 1 for p in range(i, i + k)})


@pytest.mark.parametrize("n", [0, 4, 5, 30, 400])
def test_repeated_words(n):
    r = random.Random(n)
    for alphabet in ("a", "ab", "abcdefgh", [str(i) for i in range(300)]):
        words = [r.choice(alphabet) for _ in range(n)]
        assert L.repeated_words(words) == plain_repeats(words)
    words = [str(i) for i in range(300)] + list("vwxyz") + [str(i) for i in range(100, 260)]
    assert L.repeated_words(words) == plain_repeats(words)


def test_viterbi_is_the_best_labelling():
    r = random.Random(1)
    emit = [[r.gauss(0, 1) for _ in range(L.WIDTH)] for _ in (0, 1)]
    move = [[r.gauss(0, 1) for _ in (0, 1)] for _ in (0, 1)]
    for n in (0, 1, 2, 7):
        lines = [tuple(r.randrange(L.WIDTH) for _ in L.BUCKETS) for _ in range(n)]
        score = lambda y: sum(emit[y[t]][f] for t in range(n) for f in lines[t]) + sum(move[a][b] for a, b in zip(y, y[1:]))  # noqa: E731,B023
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(L.viterbi(lines, emit, move)) == best


def test_training_raises_likelihood_of_labels():
    r = random.Random(2)
    seqs = [([(r.choice([0, 1] if y else [1, 2]),) * len(L.BUCKETS) for _ in range(6)], y) for y in (0, 1) for _ in range(40)]
    emit, move = L.train(seqs)
    right = sum(np.mean(L.viterbi(s, emit, move)) > 0.5 if y else np.mean(L.viterbi(s, emit, move)) < 0.5 for s, y in seqs)
    assert right >= 76
    assert move[0][0] > move[0][1] and move[1][1] > move[1][0]


def test_rows(spark):
    good = "This is a plain line of quiet text.\nAnother one follows it here, longer than before."
    junk = "a### | b$$$ | c%%% | d&&& | e*** | f###\nmore### | of%%% | that&&& | here### | it$$$"
    rows = [(i, good.replace("plain", f"plain{i}"), "z") for i in range(20)] + [(100 + i, junk.replace("b$", f"b{i}$"), "z") for i in range(20)]
    rows += [(None, good, "z"), (300, None, "z"), (301, "", "z"), (302, "\n\n x", "z"), (0, rows[0][1], "z"), (303, "w " * 50, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(20), *range(100, 120)]] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = L.judge_lines(docs, L.fit_lines(docs, labels)).collect()
    assert len(out) == len(rows)
    kept = {r.doc_id for r in out if r.kept}
    assert kept == {None, *range(20)}
    stay = L.keep_good(docs, L.fit_lines(docs, labels))
    assert stay.schema == docs.schema and sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(r.doc_id) for r in out if r.kept)
    by = {r.doc_id: r for r in out}
    assert (by[300].n_words, by[300].base_failed, by[302].word_chars, by[303].n_repeat_words) == (0, True, 1, 50)
    assert by[100].n_symbols == sum(junk.count(c) for c in "#*$%&|<>")
    assert L.judge_lines(docs.limit(0), L.fit_lines(docs.limit(0), labels.limit(0))).count() == 0


def test_separates_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    weights = L.fit_lines(docs, labels, train_docs=20)
    out = {r.doc_id: r for r in L.judge_lines(docs, weights).collect()}
    quality = dict(duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall())
    wrong = [k for k, q in quality.items() if not out[k].base_failed and out[k].kept != bool(q)]
    assert len(wrong) <= 0.02 * len(quality)
