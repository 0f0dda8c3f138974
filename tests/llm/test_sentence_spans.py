"""Removed sentences against a plain search over all runs."""
import random
import re

import pytest
from pyspark.sql import functions as F

from filings_engine.llm import sentence_spans as S


def plain_pieces(text):
    return [p for p in re.findall(S.PIECE, text or "") if p.replace("\n", " ").strip(" ")]


def plain(rows, span, least):
    docs = sorted({(k is None, k or 0, t) for k, t in rows if t is not None}, key=lambda d: (d[0], d[1]))
    seen, gone = {}, {}
    for n, k, t in docs:
        s = [p.lower().replace("\n", " ").strip(" ") for p in plain_pieces(t)]
        for i in range(len(s) - span + 1):
            run = tuple(s[i:i + span])
            if sum(len(x.split(" ")) for x in run) >= least:
                if run in seen:
                    gone.setdefault((None if n else k, t), set()).update(range(i, i + span))
                else:
                    seen[run] = (k, i)
    return gone


@pytest.mark.parametrize("span,least", [(2, 1), (2, 6), (3, 4), (1, 2)])
def test_against_plain_search(spark, span, least):
    r = random.Random(span * 10 + least)
    parts = ["one two three.", " Four five!", "Six\n", "seven eight nine ten? ", "é.", "  ", "\n\n", " Eleven twelve thirteen fourteen."]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(9)))) for i in range(40)]
    rows += [(None, rows[3][1] + " one two three. Four five!"), (50, None), (51, ""), rows[5], rows[5]]
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, at int")
    want = plain(rows, span, least)
    got = {(r.key, r.row): set(r.sentences) for r in S.repeated_sentences(docs, span=span, min_words=least).collect()}
    named = {r.row: r.text for r in docs.select("text", F.xxhash64("text").alias("row")).collect()}
    assert {(k, named[h]): s for (k, h), s in got.items()} == want
    out = S.remove_repeats(docs, span=span, min_words=least).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "at"}
    expected = []
    for k, t in rows:
        gone = want.get((k, t))
        expected.append((k, t if not gone else "".join(p for i, p in enumerate(plain_pieces(t)) if i not in gone)))
    assert sorted(map(str, ((r.doc_id, r.text) for r in out))) == sorted(map(str, expected))
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_planted_passages(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n: " ".join(word() + ("." if r.random() < 0.12 else "") for _ in range(n))
    passage = text(30) + ". " + text(40)
    rows = [(i, text(80) + (" " + passage + " " if i % 4 == 0 else " ") + text(60)) for i in range(40)]
    got = {x.key: x.first_key for x in S.repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(4, 40, 4)}


def test_whole_passages(spark):
    long = "the only sentence of this copied passage has quite a few words but no end"
    short = "".join(f"w{i}. " for i in range(30))
    tabs, han = "\t".join(f"c{i}" for i in range(14)) + "\n", "这是一个没有空格的很长的句子而且是复制的\n"
    rows = [(1, long), (2, long), (3, "Ahead of it. " + long + ". Some more."), (4, "One. " + long + ". Two."),
            (5, short + "x y."), (6, "Other. " + short + "z."), (7, "a.\n" + tabs + "b."), (8, "c.\n" + tabs + "d."), (9, "e\n" + han + "f"), (10, "g\n" + han + "h"), (11, "Few words."), (12, "Few words.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.key for r in S.repeated_sentences(docs).collect()} == set()
    out = {r.doc_id: r.text for r in S.remove_repeats(docs, whole=True).collect()}
    assert out[1] == long and out[2] == "" and out[4] == "One. Two."
    assert out[6] == "Other. z." and out[8] == "c.\nd." and out[10] == "g\nh"
    assert all(out[k] == dict(rows)[k] for k in (1, 3, 5, 7, 9, 11, 12))


def test_whole_keeps_what_the_pairs_find(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pairs = {(r.key, r.row): set(r.sentences) for r in S.repeated_sentences(docs).collect()}
    whole = {(r.key, r.row): set(r.sentences) for r in S.repeated_sentences(docs, whole=True).collect()}
    assert pairs and all(s <= whole[k] for k, s in pairs.items())
