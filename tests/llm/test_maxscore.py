"""MaxScore against the inner products of all pairs."""

import math
import random
from collections import Counter

import pytest

from filings_engine.llm import maxscore as ms


def plain(rows, every, k, scale=64):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(good):
        if q is None or q % every:
            continue
        scores = [(-max(-2 ** 63, min(2 ** 63 - 1, sum(s * t for s, t in zip(x, y)))), i is None, i) for b, (i, y) in enumerate(good) if a != b]
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda z: (z[0], z[1], z[2] or 0))[:k])]
    return Counter(out)


def found(spark, rows, every, k, **sizes):
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, terms string, query long").repartition(3)
    return Counter(tuple(r) for r in ms.top_k(df, every=every, k=k, **sizes).collect())


def vectors(rng, n, dims, spread):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(3)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 40, "block_rows": 10}])
def test_random_vectors(spark, sizes):
    rng = random.Random(3)
    for dims, spread in ((12, 0.3), (5, 2.0)):
        rows = vectors(rng, 260, dims, spread)
        assert found(spark, rows, 7, 20, **sizes) == plain(rows, 7, 20)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = vectors(rng, 60, 4, 0.5)
    same = rows[10][1]
    rows += [(100 + i, same) for i in range(40)] + [rows[10], rows[10], (None, same), (None, rows[5][1]), (200, []), (201, [1.0]), (205, [0.5, -0.25] * 3),
             (210, None), (215, [1.0, None]), (220, [float("nan")] * 4), (225, [float("inf"), 1.0, 1.0, 1.0])]
    assert found(spark, rows, 5, 20, shard_rows=30, block_rows=6) == plain(rows, 5, 20)
    assert found(spark, rows[:9], 5, 20) == plain(rows[:9], 5, 20)      # fewer rows than k


def test_components_beyond_doubles(spark):
    rows = [(0, [1e9, 3.0]), (1, [2e9, 1.0]), (2, [-1e9, 0.1]), (3, [1e12, 1e12]), (4, [1e9 + 1 / 64, 3.0])]
    assert found(spark, rows, 2, 3) == plain(rows, 2, 3)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = ms.top_k(df)
    assert out.collect() == [] and [f"{f.name} {f.dataType.simpleString()}" for f in out.schema] == ["query_id bigint", "rank int", "vec_id bigint", "score bigint"]


def test_pruning_leaves_few_candidates():
    """The bounds do something: most rows are never scored in full."""
    import numpy as np
    rng = np.random.default_rng(0)
    terms = np.floor(64 * rng.normal(size=(3000, 64)) / 8)
    index = ms.Shard(np.arange(3000), terms)
    queries = terms[:20]
    full = queries @ terms.T
    np.fill_diagonal(full[:, :20], -1e9)
    least = np.sort(full, 1)[:, -20].astype(float)
    for q, (rows, scores) in enumerate(index.search(queries, np.arange(20), least, 20)):
        assert sorted(scores.tolist(), reverse=True) == sorted(full[q], reverse=True)[:20]
    assert index.probed < 20 * 600
