"""Periodic run detection: online sparse diagonal DP.

A run is a stretch of words with smallest period q, at least ``min_length``
words and ``exponent`` periods long, that no neighbouring word extends.  Words w
and w - q of a run are equal, so a run is one unbroken stretch of the diagonal
of lag q in the matrix of equal words.  Going through the text, the earlier
occurrences of each symbol give the lags it touches: a lag touched by the symbol
before grows by one, a new one starts at one, and a lag that is not touched any
more has ended and emits its stretch at once if that is long enough.

The matrix is kept sparse by its symbols: every run has at least ``width`` equal
words in a row (16 for 24 words and 3 periods), so the symbols are the windows of
that many words, named exactly by doubling, and a diagonal of g windows is one of
g + width - 1 words.  Only windows that occur again touch any lag.

Words are the runs of characters other than ASCII white space.  A stretch whose
smallest period is a divisor of the lag lies in the run of that divisor and is
left out.

Defined results: null and empty texts, and those with fewer than ``min_length``
words, have no runs, and the collapsed text is their words joined by a space.
Very long texts are treated whole; the open lags and one block of ``PAIRS``
touched lags are held, the time follows the pairs of equal windows.  Runs are in
order of start, then period, so ties have one order.  Repeated rows and null keys
each keep their row, an empty table gives an empty table, extra columns of the
input do not take part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MIN_LENGTH, EXPONENT = 24, 3
#: Touched lags of one step of the DP; a single word may touch as many as the text has words.
PAIRS = 1 << 18
#: Rows of one output batch.
ROWS = 512


def least_matches(min_length: int, exponent: int) -> int:
    """Equal words in a row that every run has, whatever its period."""
    return min(max(min_length - q, (exponent - 1) * q, 1) for q in range(1, min_length + 1))


def window_names(words: list[bytes], width: int) -> np.ndarray | None:
    """A number for each window of ``width`` words (a power of two), equal for
    equal windows only; None if no window occurs twice."""
    seen: dict[bytes, int] = {}
    names = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, len(words))
    count, n = len(seen), 1
    while count < len(names):
        if n == width:
            return names
        pairs = names[:-n] * count + names[n:]
        found, names = np.unique(pairs, return_inverse=True)
        count, n = len(found), 2 * n
    return None


def stretches(lag: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins (first, last) stretches of one lag that follow each other."""
    order = np.lexsort((first, lag))
    lag, first, last = lag[order], first[order], last[order]
    new = np.ones(len(lag), bool)
    new[1:] = (lag[1:] != lag[:-1]) | (first[1:] != last[:-1] + 1)
    starts = np.flatnonzero(new)
    return lag[starts], first[starts], last[np.append(starts[1:], len(lag)) - 1] if len(lag) else last


def diagonals(names: np.ndarray, max_lag: int, pairs: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lag, first, last) of the stretches of equal symbols, each emitted in the
    step in which it ends."""
    order = np.argsort(names, kind="stable")
    same = np.zeros(len(names), bool)
    same[1:] = names[order][1:] == names[order][:-1]
    place = np.arange(len(names))
    group = np.maximum.accumulate(np.where(same, 0, place))
    earlier, begin = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
    earlier[order], begin[order] = place - group, group
    steps = np.flatnonzero(earlier)
    total = np.cumsum(earlier[steps])
    active = (np.empty(0, np.int64),) * 3
    a = 0
    while a < len(steps):
        b = max(a + 1, int(np.searchsorted(total, total[a] - earlier[steps[a]] + pairs, "right")))
        at, n = steps[a:b], earlier[steps[a:b]]
        of = np.repeat(at, n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        lag = of - order[np.repeat(begin[at], n) + nth]
        near = lag <= max_lag
        lag, of = lag[near], of[near]
        lag, first, last = stretches(np.append(active[0], lag), np.append(active[1], of), np.append(active[2], of))
        ended = last < at[-1]
        yield lag[ended], first[ended], last[ended]
        active = lag[~ended], first[~ended], last[~ended]
        a = b
    yield active


def runs_of(words: list[bytes], min_length: int = MIN_LENGTH, exponent: int = EXPONENT, pairs: int = PAIRS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, in order of start, then period."""
    n = len(words)
    if n < min_length:
        return []
    width = 1 << (least_matches(min_length, exponent).bit_length() - 1)
    names = window_names(words, width)
    if names is None:
        return []
    found: list[tuple[int, int, int]] = []
    for lag, first, last in diagonals(names, n // exponent, pairs):
        length = last - first + width + lag
        good = length >= np.maximum(min_length, exponent * lag)
        found += zip(lag[good].tolist(), (first - lag)[good].tolist(), length[good].tolist())
    runs: dict[int, list[tuple[int, int]]] = {}
    for lag, start, length in sorted(found):
        inside = (any(s <= start and start + length <= s + m for s, m in runs[q]) for q in runs if lag % q == 0 and q < lag)
        if not any(inside):
            runs.setdefault(lag, []).append((start, length))
    return sorted((s, m, q) for q, x in runs.items() for s, m in x)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that a run repeats."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(words)


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """(key, runs, collapsed), one row per row of ``docs``; ``runs`` is an array
    of (start, length, period) counted in words."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                runs, texts, ends = [], [], [0]
                for t in part.column(1).cast(pa.binary()):
                    words = t.as_py().split()
                    found = runs_of(words, min_length, exponent)
                    texts.append(collapsed(words, found))
                    runs += found
                    ends.append(len(runs))
                flat = pa.StructArray.from_arrays([pa.array([r[i] for r in runs], pa.int64()) for i in range(3)], fields=list(kind))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                                       pa.array(texts, pa.binary()).cast(pa.string())], names=["key", "runs", "collapsed"])

    out = f"key {rows.schema['key'].dataType.simpleString()}, runs array<{RUN}>, collapsed string"
    return rows.mapInArrow(search, out).withColumnRenamed("key", key)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties: the smallest start,
    then period.  Null without a run."""
    def before(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))
    return F.get(F.array_sort(runs, before), F.lit(0))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_runs, the strongest run, digests of all runs and of the collapsed
    text) of ``find_runs``."""
    best, runs = strongest(F.col("runs")), F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r, F.lit("\n"))), "")
    return (found.withColumn("best", best)
            .select(F.col(f"`{key}`"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


def plant_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with periodic tails planted by key, as a test corpus: with h the
    CRC-32 of the decimal key and g = h div 10, each word from a = g mod n on
    becomes word a + (i - a) mod p of the text, p = 1 + (n - a) div (3 + g mod 8),
    where h is divisible by 10.  Null keys and wordless texts stay as they are."""
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.floor(h / 10).alias("g"), words.alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, get(words, int(a + (i - a) % p)))), ' ')")
    return rows.select(F.col("key").alias(key), F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias(text))
