"""Fingerprints against Spark's own hash, components against all pairs."""
import random

import pytest
from pyspark.sql import functions as F

from filings_engine.llm import simhash as S


def brute(rows):
    """(doc_id, fp) -> component by union of all pairs within two bits."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if bin((a ^ rows[j][1]) & (2 ** 64 - 1)).count("1") <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(rows))]


def spark_fingerprint(spark, text):
    words = [w for w in text.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})).replace("\x0b", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [r[0] for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    return S.signed(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))


@pytest.mark.parametrize("text", ["Aa bÉ  c D aa bÉ c", "one", "one two", "x y z w", "a b c a b c a b c d"])
def test_fingerprint(spark, text):
    assert S.fingerprint(text.encode()) == spark_fingerprint(spark, text)


def test_fingerprint_empty_and_blocks(monkeypatch):
    assert S.fingerprint(b"") == S.fingerprint(b" \n\t") == 0
    text = " ".join(map(str, range(500))).encode()
    want = S.fingerprint(text)
    monkeypatch.setattr(S, "HASH_BLOCK", 7)
    assert S.fingerprint(text) == want


@pytest.mark.parametrize("limit", [64, 3, 1])
def test_components_against_all_pairs(spark, monkeypatch, limit):
    r = random.Random(limit)
    fps = [r.getrandbits(64) for _ in range(40)]
    for _ in range(160):                     # chains and balls of near values
        v = r.choice(fps)
        for _ in range(r.choice([0, 1, 2, 2, 3])):
            v ^= 1 << r.randrange(64)
        fps.append(v)
    rows = [(i, S.signed(v)) for i, v in enumerate(fps)]
    rows += [(None, rows[0][1]), (None, S.signed(r.getrandbits(64))), rows[5]]
    monkeypatch.setattr(S, "fingerprints", lambda d, *a: d.select("doc_id", "fp"))
    docs = spark.createDataFrame(rows, "doc_id long, fp long")
    got = S.near_duplicates(docs, list_limit=limit).collect()
    want = [(k, f"{f & (2 ** 64 - 1):016x}", c) for (k, f), c in zip(rows, brute(rows))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_rows_and_keep_first(spark):
    a, b = "the quick brown fox jumps over the lazy dog " * 3, "entirely other words stand in this text " * 3
    rows = [(3, a, "x"), (1, a.upper(), "x"), (5, b, "x"), (5, b, "x"), (7, None, "x"), (8, "", "x"), (None, " ", "x"), (None, b, "y"), (None, "third text with no id at all", "y"), (None, "third text with no id at all", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {(3, 1), (1, 1), (5, 5), (7, 7), (8, 7), (None, 7), (None, 5), (None, None)}
    assert sorted(str(r.doc_id) for r in S.keep_first(docs).collect()) == ["1", "5", "7", "None"]
    assert S.near_duplicates(docs.limit(0)).count() == 0
