"""Document quality by labelling the sequence of its lines.

A linear-chain conditional random field marks each line with a word as
content or boilerplate.  Its emissions are sums of weights of bucketed line
features, its transitions a 2 x 2 table; Viterbi decoding gives the best
labelling, and the share of words on content lines decides retention.  A fixed
base rule (too few words, too many repeated word windows) rejects first.

Training: the lines of labelled documents (quality 1: content, 0: boilerplate),
from at most ``2 * train_docs`` documents a class chosen by id hash, by
maximum likelihood (forward-backward in numpy, on the driver).  With no labelled
rows of both classes nothing is learned and every line counts as content.

Defined results: null and empty texts have no words and are rejected by the base
rule; repeated rows and null ids keep their rows; other columns do not take part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filings_engine.llm.common import sample_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]")
PUNCTUATION = re.compile(r"[^\w\s]")
DIGIT = re.compile(r"[0-9]")
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
CONTENT_SHARE = 0.5
TRAIN_DOCS = 400
#: Upper bounds of the buckets of each feature; the last bucket is open.
BUCKETS = {
    "words": [2, 5, 12, 40],
    "symbols_a_word": [0.0, 0.1, 0.5, 1.5],
    "bars": [0, 1, 4],
    "punctuation_a_word": [0.02, 0.15, 0.4, 1.0],
    "capitals_a_char": [0.02, 0.08, 0.25, 0.6],
    "digits_a_char": [0.0, 0.05, 0.3],
    "distinct_words": [0.3, 0.6, 0.9],
    "ends_sentence": [0],
    "seen_before": [0],
}
SIZES = [len(b) + 1 for b in BUCKETS.values()]
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]]).astype(int).tolist()
WIDTH = sum(SIZES)


def bucket(value: float, bounds: list) -> int:
    for i, b in enumerate(bounds):
        if value <= b:
            return i
    return len(bounds)


def line_features(line: str, words: list[str], seen: bool) -> tuple[int, ...]:
    """Index of the active weight of each feature."""
    n, chars = len(words), max(1, len(line))
    values = (n, len(SYMBOL.findall(line)) / n, line.count("|"), len(PUNCTUATION.findall(line)) / n,
              len(CAPITAL.findall(line)) / chars, len(DIGIT.findall(line)) / chars, len(set(words)) / n,
              words[-1][-1] in ".!?:", seen)
    return tuple(o + bucket(v, b) for v, b, o in zip(values, BUCKETS.values(), OFFSETS))


def lines_of(text: str) -> tuple[list[tuple[int, ...]], list[int], int]:
    """Features and words of the lines with a word; lines equal to an earlier one."""
    found, counts, seen, again = [], [], set(), 0
    for line in text.split("\n"):
        words = WORD.findall(line)
        if words:
            known = line in seen
            again += known
            seen.add(line)
            found.append(line_features(line, words, known))
            counts.append(len(words))
    return found, counts, again


def repeated_words(words: list[str], k: int = WINDOW) -> int:
    """Words inside windows of k words that occur twice or more."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    if n > 200:
        # equal windows have equal sums, so only windows whose sum repeats are compared
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
        _, back, times = np.unique(total, return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[back] > 1).tolist()
    else:
        at = range(n)
    windows = {i: tuple(words[i:i + k]) for i in at}
    times = Counter(windows.values())
    covered, end = 0, 0
    for i in at:
        if times[windows[i]] > 1:
            covered += i + k - max(i, end)
            end = i + k
    return covered


# --- the chain -----------------------------------------------------------
def viterbi(lines: list[tuple[int, ...]], emit: list[list[float]], move: list[list[float]]) -> list[int]:
    """Best labels (1 content), ties to content."""
    best, back = [0.0, 0.0], []
    for t, line in enumerate(lines):
        e0 = sum([emit[0][f] for f in line])
        e1 = sum([emit[1][f] for f in line])
        if t:
            a0, b0, a1, b1 = best[0] + move[0][0], best[1] + move[1][0], best[0] + move[0][1], best[1] + move[1][1]
            back.append((b0 >= a0, b1 >= a1))
            best = [max(a0, b0) + e0, max(a1, b1) + e1]
        else:
            best = [e0, e1]
    label = [int(best[1] >= best[0])] if lines else []
    for p in reversed(back):
        label.append(int(p[label[-1]]))
    return label[::-1]


def train(sequences: list[tuple[list[tuple[int, ...]], int]], steps: int = 80, rate: float = 0.2, ridge: float = 1e-2,
          block: int = 32) -> tuple[list[list[float]], list[list[float]]]:
    """Weights (emit[label][feature], move[from][to]) of maximum likelihood.
    Sequences are cut into blocks of lines; classes weigh the same."""
    parts = [(s[a:a + block], y) for s, y in sequences for a in range(0, len(s), block)]
    if len({y for _, y in parts}) < 2:
        return [[0.0] * WIDTH] * 2, [[0.0, 0.0]] * 2
    n, longest = len(parts), max(len(s) for s, _ in parts)
    x, mask, y = np.zeros((n, longest, len(BUCKETS)), int), np.zeros((n, longest)), np.array([y for _, y in parts])
    for i, (s, _) in enumerate(parts):
        x[i, :len(s)], mask[i, :len(s)] = s, 1
    lines = mask.sum(1)
    weight = np.where(y == 1, 1 / lines[y == 1].sum(), 1 / lines[y == 0].sum()) / 2
    emit, move = np.zeros((2, WIDTH)), np.zeros((2, 2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, move)]
    add = lambda v: v.max(-1) + np.log(np.exp(v - v.max(-1, keepdims=True)).sum(-1))
    for step in range(1, steps + 1):
        e = emit[:, x].sum(-1).transpose(1, 2, 0)                       # n, t, label
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            nxt = e[:, t] + np.stack([add(alpha[:, t - 1] + move[:, j]) for j in (0, 1)], -1)
            alpha[:, t] = np.where(mask[:, t, None] > 0, nxt, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            prv = np.stack([add(e[:, t + 1] + beta[:, t + 1] + move[i]) for i in (0, 1)], -1)
            beta[:, t] = np.where(mask[:, t + 1, None] > 0, prv, 0)
        z = add(alpha[:, -1])
        node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        gold = np.zeros_like(node)
        gold[np.arange(n), :, y] = mask
        up = (gold - node) * weight[:, None, None]
        g_emit = np.stack([np.bincount(x.ravel(), np.repeat(up[..., j].ravel(), len(BUCKETS)), WIDTH) for j in (0, 1)])
        g_move = np.zeros((2, 2))
        live = mask[:, 1:] * weight[:, None]
        for i in (0, 1):
            for j in (0, 1):
                pair = np.exp(alpha[:, :-1, i] + move[i, j] + e[:, 1:, j] + beta[:, 1:, j] - z[:, None])
                g_move[i, j] = (live * ((y == i) & (i == j))[:, None]).sum() - (live * pair).sum()
        for p, g, m in ((emit, g_emit, moments[0]), (move, g_move, moments[1])):
            g = g - ridge * p / len(parts)
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
            p += rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8)
    return emit.tolist(), move.tolist()


def fit_lines(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS):
    """Weights learned from labels(key, quality)."""
    picked = [sample_rows(labels.where((F.col("quality") == q) & F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct(), "key", train_docs)
              .withColumn("y", F.lit(q)) for q in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [[v for f in lines_of(t.as_py())[0] for v in f] for t in b.column("text")]
            yield pa.record_batch([b.column("y"), pa.array(lines, pa.list_(pa.int32()))], names=["y", "lines"])

    k = len(BUCKETS)
    found = rows.select("y", "text").mapInArrow(run, "y int, lines array<int>").collect()
    sequences = sorted(([tuple(r.lines[a:a + k]) for a in range(0, len(r.lines), k)], r.y) for r in found)
    return train([s for s in sequences if s[0]])


def judge(t: str, weights, content_share: float = CONTENT_SHARE) -> tuple:
    """The figures of one text, in the order of ``judge_lines``."""
    words = WORD.findall(t)
    n, repeat = len(words), repeated_words(words)
    lines, counts, again = lines_of(t)
    label = viterbi(lines, *weights)
    share = sum(c for c, y in zip(counts, label) if y) / n if n else 0.0
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    return n, sum(map(len, words)), len(SYMBOL.findall(t)), again, repeat, share, failed, not failed and share >= content_share


def judge_lines(docs: DataFrame, weights, key: str = "doc_id", text: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    content_share, base_failed, kept), one row per row."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept"]
    types = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*[judge(t.as_py(), weights, content_share) for t in b.column("text")])) or [[]] * len(names)
            yield pa.record_batch([b.column("key"), *[pa.array(v, t) for v, t in zip(found, types)]], names=["key", *names])

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} {'long' if t == pa.int64() else 'double' if t == pa.float64() else 'boolean'}" for c, t in zip(names, types)))
    return out.withColumnRenamed("key", key)


def keep_good(docs: DataFrame, weights, text: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([judge(t.as_py() or "", weights, content_share)[-1] for t in b.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
