"""Tree concatenation against the library on whole texts."""
import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from filings_engine.llm import bpe_tree as B

PATH = B.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def hard_texts():
    r = random.Random(3)
    yield from ["", " ", "\n\t", "a", "don't we'll 123 4,5!!'s x'ree", "ÉLÈVE é ́x", "<|endoftext|>hi <|startoftext|>x", "a b c\x1cd", "ΣΑΣ ΟΔΟΣ İI", "the" * 900, "!" * 300 + "'s" * 100]
    for size in (30, 300, 3000):
        for alphabet in ("ab", "aeinrst", "the in an re ", "aé'!s 1\n", "日本 語x́"):
            yield "".join(r.choice(alphabet) for _ in range(size))


@pytest.mark.parametrize("leaf,run", [(7, 8), (64, 40), (1000, 100)])
def test_joins_equal_whole_encoding(library, leaf, run):
    c = B.Codec(PATH, leaf, run)
    for t in hard_texts():
        want = library.encode(t, add_special_tokens=False).ids
        got = c.encode_text(t)
        ids = b"".join(x for _, (x, _) in got)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, repr(t[:80])
        assert "".join(y for _, (_, y) in got)[:-1] == library.decode(want, skip_special_tokens=False)


def test_rows(spark, library):
    texts = list(hard_texts()) + [None, "x" * 5000, "x" * 5000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no key", "clash"), (None, "y z " * 400, "clash"), (0, "other text of key 0 " * 50, "clash"), (0, "other text of key 0 " * 50, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = B.digests(B.encode_texts(docs, leaf_chars=200, run_chars=150)).collect()
    want = []
    for k, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert B.digests(B.encode_texts(docs.limit(0))).count() == 0


class Counting:
    """The library, with the number of bytes it is given."""

    def __init__(self, library):
        self.library, self.bytes = library, 0

    def __getattr__(self, name):
        return getattr(self.library, name)

    def encode(self, text, **kw):
        self.bytes += len(text.encode())
        return self.library.encode(text, **kw)

    def encode_batch_fast(self, texts, **kw):
        self.bytes += sum(len(t.encode()) for t in texts)
        return self.library.encode_batch_fast(texts, **kw)


@pytest.mark.parametrize("alphabet", ["aeinrstlo", "оеаинтсрв", "日本語中文字"])
def test_unsplit_words_are_joined_not_encoded_again(library, alphabet):
    r = random.Random(5)
    word = "".join(r.choice(alphabet) for _ in range(60_000))
    c = B.Codec(PATH, 4_000, 500)
    c.library = Counting(c.library)
    found = c.encode_text(word)
    ids = b"".join(x for _, (x, _) in found)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(word, add_special_tokens=False).ids
    assert c.library.bytes < 2 * len(word.encode())


def test_words_that_only_look_unsplit(library):
    """Letters whose normal form has other places, and words that a border cuts."""
    for text in ("İ" * 700, "é" * 500, "Σ" * 900, "aΣ" * 400, "日" * 400 + "é" * 300, "x" * 600 + "'s" + "y" * 600, "ﬁ" * 700, "가" * 500):
        c = B.Codec(PATH, 300, 100)
        ids = b"".join(x for _, (x, _) in c.encode_text(text))
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(text, add_special_tokens=False).ids
