"""Directory against splitting bucket by bucket."""
import hashlib
import random

import pytest

from filings_engine.llm import sharding as S


def bits(key):
    return f"{int(hashlib.md5((chr(0) if key is None else str(key)).encode()).hexdigest(), 16):0128b}"


def split(rows, limit, prefix=""):
    """Extendible hashing as told: rows(bits, bytes)."""
    if not rows:
        return {}
    total = sum(b for _, b in rows)
    if total <= limit or len({x for x, _ in rows}) == 1:
        return {prefix: (total, len(rows), total <= limit)}
    n = len(prefix)
    return split([r for r in rows if r[0][n] == "0"], limit, prefix + "0") | split([r for r in rows if r[0][n] == "1"], limit, prefix + "1")


@pytest.mark.parametrize("limit,spare", [(1, 3), (50, 0), (300, 1), (10 ** 9, 3)])
def test_against_splitting(spark, monkeypatch, limit, spare):
    monkeypatch.setattr(S, "SPARE", spare)
    r = random.Random(limit)
    rows = [(i, "é" * r.choice([0, 1, 5, 20]), 0) for i in range(120)] + [(7, "x" * 100, 1)] * 3 + [(None, None, 2), (None, "abc", 2), (500, "y" * 400, 3), (501, "", 3), (502, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    want = split([(bits(k), len((t or "").encode())) for k, t, _ in rows], limit)
    got = S.assign_shards(docs, limit=limit).collect()
    assert len(got) == len(rows)
    for g in got:
        assert bits(g.doc_id).startswith(g.shard) and g.depth == len(g.shard)
        assert (g.shard_bytes, g.shard_rows, g.fits) == want[g.shard]
    assert S.assign_shards(docs.limit(0)).count() == 0
