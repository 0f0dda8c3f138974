"""Periodic runs against a search of all periods."""

import hashlib
import random
import zlib

from hypothesis import given, settings, strategies as st

from filings_engine.llm import periodic_runs as pr


def plain(words, min_length=24, exponent=3):
    """Every maximal stretch of every period, smallest period of its stretch only."""
    n, out = len(words), set()
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s, e = i - q, j
            if e - s >= max(min_length, exponent * q) and not any(all(words[x] == words[x - d] for x in range(s + d, e)) for d in range(1, q)):
                out.add((s, e - s, q))
            i = j
    return sorted(out)


def blocks(rng, n):
    words = []
    while len(words) < n:
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        words += unit * rng.randint(1, 8) + unit[:rng.randint(0, len(unit))]
    return [w.encode() for w in words[:n]]


def test_all_periods_of_random_texts():
    rng = random.Random(5)
    for k in range(400):
        words = blocks(rng, rng.randint(0, 160))
        assert pr.runs_of(words) == plain(words)
        assert pr.runs_of(words, pairs=7) == plain(words)       # the DP in small steps


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=70), st.integers(2, 24), st.integers(2, 4))
def test_other_limits(words, min_length, exponent):
    assert pr.runs_of(words, min_length, exponent, 11) == plain(words, min_length, exponent)


def test_one_word_thousands_of_times():
    assert pr.runs_of([b"x"] * 5000) == [(0, 5000, 1)]
    assert pr.runs_of([b"x"] * 23) == []
    nested = ([b"x"] * 30 + [b"y"]) * 4
    assert pr.runs_of(nested) == plain(nested)


def test_collapse_keeps_the_first_period():
    words = [b"s"] + [b"a", b"b", b"c"] * 10 + [b"e"]
    runs = pr.runs_of(words)
    assert runs == [(1, 30, 3)] and pr.collapsed(words, runs) == b"s a b c e"


def planted(key, text):
    words = [] if text is None else text.encode().split()
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(key, text):
    words = planted(key, text)
    runs = plain(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    return (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def digest(df):
    return [tuple(r) for r in pr.digests(pr.find_runs(pr.plant_repeats(df))).collect()]


def test_query_on_odd_rows(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n", "é ü \x1c a\x85b", "one two", "w " * 400, "lone\x0bword"] + [
        " ".join(w.decode() for w in blocks(rng, rng.randint(20, 120))) for _ in range(150)]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "z " * 30, "x", "y"), (3, texts[3], "x", "y"), (20, texts[20], "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, `a.b` string").repartition(3)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(7, 157)) > 5
    assert sorted(digest(df), key=str) == sorted((expected(k, t) for k, t, *_ in rows), key=str)


def test_empty_table(spark):
    assert digest(spark.createDataFrame([], "doc_id long, text string")) == []
