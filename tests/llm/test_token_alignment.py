"""Alignment against both libraries on whole texts and counts in a dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P

from filings_engine.llm import token_alignment as ta


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def plain_tokens(text, libraries):
    """(id, begin, end) by both, or nothing."""
    if not text:
        return [], []
    chars = ta.byte_of_char()
    a = [(i, bytes(chars[c] for c in libraries[0].id_to_token(i))) for i in libraries[0].encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in libraries[1].encode(text):
        p = libraries[1].id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if libraries[1].is_byte(i) else p.replace("▁", " ").encode()))
    if any(b"".join(x for _, x in t) != (" " + text).encode() for t in (a, b)):
        return [], []
    out = []
    for tokens in (a, b):
        at, spans = 0, []
        for i, x in tokens:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def plain(rows, libraries):
    docs = []
    for key, text in rows:
        a, b = plain_tokens(text, libraries)
        links = [(x, y) for x, s, e in a for y, p, q in b if s < q and p < e]
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [[[i for i, s, e in t if lo <= s and e <= hi] for t in (a, b)] for lo, hi in zip([0, *common], common)]
        docs.append((key, len(a), len(b), len(common), links, ";".join("|".join(",".join(map(str, g)) for g in x) for x in groups)))
    count = Counter(p for d in docs for p in set(d[4]))
    high = {}
    for (a, _), n in count.items():
        high[a] = max(high.get(a, 0), n)
    return [(k, na, nb, ng, len(links), sum(count[p] == high[p[0]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for k, na, nb, ng, links, g in docs]


ODD = [None, "", " ", "  ", "a", " lead", "trail ", "two  spaces   three", "tab\tand\nline \n next\n\n  deep", "x \t y", "end.\nNext one.\r\nWin",
       "it's 12,345.6 don't", "café ﬁne ｆull", "中文没有空格 " * 3, "a▁b", "plain ▁ word", "<s>x</s> <|endoftext|> <0x41>",
       "nul\x00 \x1c sep\x85 nb\xa0sp 　wide", "emoji \U0001f600\U0001f468‍\U0001f469", "\n", "\n \n", "a \n b", "w " * 50, "z" * 300]


def check(spark, libraries, rows, **sizes):
    df = spark.createDataFrame([(k, t, 1, "q") for k, t in rows], "doc_id long, text string, key int, `a.b` string").repartition(3)
    got = [tuple(r) for r in ta.digests(ta.align_texts(df, **sizes)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, libraries), key=str)


def random_texts(rng, n):
    words = ["the", "nation", "'s", "heaß", "12", "Ertion,", "of.\nAnd", "фы", "x", "", "\n", "ing", "(a)", "ou|ou"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_odd_and_random_texts(spark, libraries):
    rng = random.Random(8)
    rows = list(enumerate(ODD + random_texts(rng, 120)))
    rows += [(None, "the nation"), (None, "the nation"), rows[30], rows[30]]
    check(spark, libraries, rows)


def test_many_small_chunks_and_a_deep_tree(spark, libraries):
    rng = random.Random(2)
    check(spark, libraries, list(enumerate(random_texts(rng, 60) + ODD)), chunk_chars=300, fan=2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ta.digests(ta.align_texts(df)).collect() == []


def test_units_join_to_whole_texts(libraries):
    """Unit by unit as the libraries encode the whole text, on the given tables."""
    import duckdb
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id limit 400").fetchall()]
    codecs = ta.Codecs(*ta.default_vocabularies())
    for text in texts + [t for t in ODD if t]:
        parts, a, b = ta.units(text), [], []
        assert " ".join(parts) == text
        found = [codecs.encode([p]) for p in parts]
        whole = plain_tokens(text, libraries)
        if None in found:
            assert whole == ([], [])
            continue
        assert np.concatenate([x for x, _ in found]).tolist() == [i for i, *_ in whole[0]]
        assert np.concatenate([y for _, y in found]).tolist() == [i for i, *_ in whole[1]]


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 5000):
        keys = np.unique(rng.integers(0, 1 << 50, n))
        sizes, bits = ta.build_hash(keys)
        assert sorted(ta.hash_numbers(keys, sizes, bits).tolist()) == list(range(len(keys)))
    with pytest.raises(RuntimeError):
        ta.numbers_of(np.array([7]), {"sizes": sizes, "bits": bits, "keys": keys})
