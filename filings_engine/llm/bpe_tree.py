"""BPE encoding by tree concatenation, and decoding.

A text longer than ``leaf_chars`` is halved until each leaf fits; the leaves
are rows of their own, encoded in parallel wherever Spark puts them.  Leaves
are then joined pairwise, bottom up.  A cut may fall anywhere, also inside a
word, so each join encodes a window around it anew and widens the window until
its first and last pieces equal what the left and the right side already hold;
only then are the pieces between them replaced.

Two kinds of pieces:

* a text is a list of runs between ASCII white space.  White space is a hard
  border of the tokenizer, so a whole run that comes out equal on either side
  proves that nothing beyond it can change.
* a run of over ``RUN_CHARS`` bytes that is one word of letters (already in the
  tokenizer's normal form) cannot be split.  There the pieces are its tokens: an
  encoding is right exactly if every adjacent pair of tokens is, so a token with the
  same place and id in the window and in a side proves the rest of that side.  A word
  cut by leaves keeps the tokens of both sides; only the windows are encoded anew.

Defined results: null and empty texts have no tokens (decoded: empty text).
Strings of special tokens in a text are those tokens, as in the tokenizers
library.  Repeated rows and null keys each keep their row; extra columns of
the input do not take part.  Very long texts are encoded in leaves of bounded size;
the joins of one text are one row of one task.  An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

LEAF_CHARS = 32_768
RUN_CHARS = 2_048
#: Words whose tokens a worker remembers before it starts again, and new ones encoded in one text.
MEMO_WORDS, CALL_WORDS = 250_000, 512
#: Texts of one step.
ROWS = 256
LETTERS = regex.compile(r"\p{L}+")
CONTROLS = bytes([*range(32), 127])
SPACE = b" \t\n\r\x0b\x0c"


class Split(Exception):
    """The library splits what was taken for one word."""


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """Tokenizer of one worker with a bounded memo of whole runs."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, run_chars: int = RUN_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.leaf_chars, self.run_chars = leaf_chars, run_chars
        vocab = self.library.get_vocab(with_added_tokens=True)
        token = {i: t for t, i in vocab.items()}
        names = [token.get(i, "") for i in range(max(token) + 1)]
        self.shown = [t + " " for t in names]
        self.ends_word = np.array([t.endswith("</w>") for t in names])
        self.size = np.array([len(t.removesuffix("</w>")) for t in names], np.int64)      # a character is a byte
        self.memo: dict[bytes, tuple[bytes, str]] = {}

    def pack(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, "<u4").tobytes(), "".join(map(self.shown.__getitem__, ids))

    def encode_runs(self, runs: list[bytes]) -> list[tuple[bytes, str]]:
        """(packed ids, decoded text) of each run; new runs go to the library
        together."""
        found = list(map(self.memo.get, runs))
        if None in found:
            new = {r for r, f in zip(runs, found) if f is None}
            if len(self.memo) + len(new) > MEMO_WORDS:
                self.memo.clear()
                new = set(runs)
            self.learn(new)
            found = list(map(self.memo.__getitem__, runs))
        return found

    def encode_many(self, texts: list[bytes]) -> list[tuple[bytes, str]]:
        """(packed ids, decoded text) of whole texts."""
        runs = [t.split() for t in texts]
        found, out, a = self.encode_runs(list(itertools.chain.from_iterable(runs))), [], 0
        for r in runs:
            part = found[a:a + len(r)]
            a += len(r)
            out.append((b"".join([x for x, _ in part]), "".join([y for _, y in part])[:-1]))
        return out

    def learn(self, new: set[bytes]) -> None:
        plain, lone = [], []
        for r in new:
            if len(r) <= self.run_chars and b"<" not in r and keeps_length(r):
                plain.append(r)
            elif len(r) <= self.run_chars or (word := normal_word(r)) is None:
                lone.append(r)
            else:
                try:
                    self.memo[r] = self.pack([i for i, _ in self.encode_word(word)])
                except Split:
                    lone.append(r)
        blocks = [plain[a:a + CALL_WORDS] for a in range(0, len(plain), CALL_WORDS)]
        for block, e in zip(blocks, self.library.encode_batch_fast([b" ".join(x).decode() for x in blocks], add_special_tokens=False)):
            # the normal form keeps the length, so the tokens of a run end where it ends
            ids = np.array(e.ids, "<u4")
            ends, run_ends = np.cumsum(self.size[ids]), np.cumsum([len(r) for r in block])
            until = np.searchsorted(ends, run_ends, "right")
            if until[0] == 0 or until[-1] != len(ids) or (ends[until - 1] != run_ends).any():
                lone += block
                continue
            packed, shown = ids.tobytes(), list(map(self.shown.__getitem__, ids.tolist()))
            cuts = [0, *until.tolist()]
            self.memo.update((r, (packed[4 * i:4 * j], "".join(shown[i:j]))) for r, i, j in zip(block, cuts, cuts[1:]))
        for r, e in zip(lone, self.library.encode_batch_fast([r.decode() for r in lone], add_special_tokens=False)):
            self.memo[r] = self.pack(e.ids)

    # --- one word without any border -----------------------------------
    def tokens(self, word: bytes) -> list[tuple[int, int]]:
        """(id, bytes) of the tokens of a word in normal form."""
        ids = self.library.encode(word.decode(), add_special_tokens=False).ids
        if self.ends_word[ids].sum() != 1 or self.size[ids].sum() != len(word):
            raise Split
        return list(zip(ids, self.size[ids].tolist()))

    def encode_word(self, word: bytes) -> list[tuple[int, int]]:
        if len(word) <= self.run_chars:
            return self.tokens(word)
        mid = len(word) // 2
        while inside(word, mid):
            mid += 1
        return self.join_word(word, mid, self.encode_word(word[:mid]), self.encode_word(word[mid:]))

    def join_word(self, word: bytes, cut: int, left: list, right: list) -> list[tuple[int, int]]:
        """``left`` encodes word[:cut], ``right`` word[cut:]."""
        left_ends = np.cumsum([n for _, n in left])
        right_ends = cut + np.cumsum([n for _, n in right])
        width = 32
        while True:
            # a window starts where a token of the left side starts and ends where one of the right side ends
            i, j = max(0, int(np.searchsorted(left_ends, cut - width)) - 1), min(len(right), int(np.searchsorted(right_ends, cut + width)) + 1)
            while i and inside(word, int(left_ends[i - 1])):
                i -= 1
            while j < len(right) and inside(word, int(right_ends[j - 1])):
                j += 1
            lo, hi = int(left_ends[i - 1]) if i else 0, int(right_ends[j - 1])
            spans, p = [], lo
            for t, n in self.tokens(word[lo:hi]):
                spans.append((p, p + n, t))
                p += n
            of_left = {(int(left_ends[x]) - left[x][1], int(left_ends[x]), left[x][0]): x for x in range(i, len(left))} if i else {}
            of_right = {(int(right_ends[x]) - right[x][1], int(right_ends[x]), right[x][0]): x for x in range(j)} if j < len(right) else {}
            first = next((k for k, w in enumerate(spans) if w in of_left), None) if i else 0
            last = next((k for k in range(len(spans) - 1, -1, -1) if spans[k] in of_right), None) if j < len(right) else len(spans) - 1
            if first is not None and last is not None and first <= last:
                head = left[:of_left[spans[first]]] if i else []
                tail = right[of_right[spans[last]] + 1:] if j < len(right) else []
                return head + [(t, b - a) for a, b, t in spans[first:last + 1]] + tail
            width *= 2

    def join_runs(self, a: tuple, b: tuple) -> tuple:
        """The run of two touching parts with their encodings.  One long word keeps
        the tokens of both sides."""
        run = a[0] + b[0]
        word = normal_word(run) if len(run) > self.run_chars else None
        if word is not None:
            try:
                sides = [[(i, int(self.size[i])) for i in np.frombuffer(x, "<u4").tolist()] for _, (x, _) in (a, b)]
                if [sum(n for _, n in side) for side in sides] == [len(a[0]), len(b[0])]:
                    return run, self.pack([i for i, _ in self.join_word(word, len(a[0]), *sides)])
            except Split:
                pass
        return run, self.encode_runs([run])[0]

    # --- a text as a list of runs --------------------------------------
    def encode_leaf(self, leaf: bytes) -> list[tuple[bytes, tuple[bytes, str]]]:
        runs = leaf.split()
        return list(zip(runs, self.encode_runs(runs)))

    def join_text(self, left: list, right: list, touching: bool) -> list:
        """Joins two encoded texts.  ``touching``: no white space stands at
        the cut, so its two runs are parts of one."""
        if not touching or not left or not right:
            return left + right
        joined, width = self.join_runs(left[-1], right[0]), 1
        while True:
            a, b = left[-1 - width:], right[:1 + width]
            window = self.encode_leaf(b" ".join([r for r, _ in a[:-1]])) + [joined] + self.encode_leaf(b" ".join([r for r, _ in b[1:]]))
            agree_left = width >= len(left) or window[0] == a[0]
            agree_right = width >= len(right) or window[-1] == b[-1]
            if agree_left and agree_right:
                return left[:len(left) - len(a)] + window + right[len(b):]
            width *= 2

    def join_leaves(self, leaves: list[tuple[bytes, list]]) -> list:
        """Bottom-up tree over neighbouring (leaf text, encoding) pairs."""
        parts = [(t, t, e) for t, e in leaves]      # first leaf's text, last leaf's text, encoding
        while len(parts) > 1:
            joined = []
            for i in range(0, len(parts) - 1, 2):
                (f, x, a), (y, g, b) = parts[i], parts[i + 1]
                touching = x[-1:] not in SPACE_SET and y[:1] not in SPACE_SET
                joined.append((f, g, self.join_text(a, b, touching)))
            parts = joined + parts[len(joined) * 2:]
        return parts[0][2] if parts else []

    def encode_text(self, text: str) -> list:
        return self.join_leaves([(t, self.encode_leaf(t)) for t in map(str.encode, halves(text, self.leaf_chars))])


def inside(word: bytes, at: int) -> bool:
    """Whether ``at`` lies inside a character."""
    return at < len(word) and word[at] & 0xC0 == 0x80


def keeps_length(run: bytes) -> bool:
    """Whether the normal form of a run should be as long as the run.  What is
    taken for such is compared with its tokens later."""
    if run.isascii():
        return run.translate(None, CONTROLS) == run
    text = run.decode()
    return unicodedata.is_normalized("NFC", text) and len(text.split()) == 1 and len(text.lower().encode()) == len(run)


def normal_word(run: bytes) -> bytes | None:
    """The normal form of a run that is one word of letters and whose parts have
    their normal forms at the same places; else null."""
    text = run.decode()
    if not LETTERS.fullmatch(text):
        return None
    if run.isascii():
        return run.lower()
    return run if unicodedata.is_normalized("NFC", text) and all(c == c.lower() for c in set(text)) else None


SPACE_SET = {SPACE[i:i + 1] for i in range(len(SPACE))} | {b""}


def halves(text: str, leaf_chars: int) -> list[str]:
    """The text cut into halves, and those again, until each part fits."""
    if len(text) <= leaf_chars:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], leaf_chars) + halves(text[mid:], leaf_chars)


@functools.lru_cache(maxsize=2)
def codec(path: str, leaf_chars: int, run_chars: int) -> Codec:
    return Codec(path, leaf_chars, run_chars)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
                 leaf_chars: int = LEAF_CHARS, run_chars: int = RUN_CHARS) -> DataFrame:
    """(key, ids binary: little-endian 32-bit ids, decoded string), one row per
    row of ``docs``.

    Texts of one leaf are encoded where they are read.  Only the leaves of
    longer texts are shuffled: first spread, then gathered per row for the
    joins (a row's leaves make one output row, so they fit a task)."""
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= leaf_chars)
    long = rows.where(F.length("text") > leaf_chars)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, leaf_chars, run_chars)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a in range(0, len(texts), ROWS):
                found = c.encode_many(texts.slice(a, ROWS).cast(pa.binary()).to_pylist())
                yield pa.record_batch([keys.slice(a, ROWS), pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.string())],
                                      names=["key", "ids", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(len(batch)):
                parts = [x.encode() for x in halves(batch.column("text")[a].as_py(), leaf_chars)]
                same = batch.select(["key", "row", "copies"]).take(pa.array([a] * len(parts)))
                yield pa.record_batch([*same.columns, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
                                      names=["key", "row", "copies", "leaf", "part"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, leaf_chars, run_chars)
        for batch in batches:
            for a in range(len(batch)):
                found = c.encode_leaf(batch.column("part")[a].as_py())
                yield pa.record_batch([*batch.slice(a, 1).columns, pa.array([[x for _, (x, _) in found]], pa.list_(pa.binary())),
                                       pa.array([[y for _, (_, y) in found]], pa.list_(pa.string()))],
                                      names=["key", "row", "copies", "leaf", "part", "ids", "decoded"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, leaf_chars, run_chars)
        for batch in batches:
            for a in range(len(batch)):
                row = batch.column("parts")[a].as_py()
                done = c.join_leaves([(x["part"], list(zip(x["part"].split(), zip(x["ids"], x["decoded"])))) for x in row])
                n = batch.column("copies")[a].as_py()
                yield pa.record_batch([batch.column("key").take(pa.array([a] * n)), pa.array([b"".join([x for _, (x, _) in done])] * n, pa.binary()),
                                       pa.array(["".join([y for _, (_, y) in done])[:-1]] * n, pa.string())], names=["key", "ids", "decoded"])

    kind = rows.schema["key"].dataType.simpleString()
    out = f"key {kind}, ids binary, decoded string"
    first = short.mapInArrow(whole, out)
    # equal rows are one row with a count; the hash of key and text names it
    named = f"key {kind}, row long, copies long"
    parts = (long.groupBy("key", "text").agg(F.count("*").alias("copies"))
             .select("key", F.xxhash64("key", "text").alias("row"), "copies", "text")
             .mapInArrow(cut, f"{named}, leaf int, part binary")
             .repartition("key", "row", "leaf")
             .mapInArrow(leaves, f"{named}, leaf int, part binary, ids array<binary>, decoded array<string>"))
    gathered = parts.groupBy("key", "row", "copies").agg(F.array_sort(F.collect_list(F.struct("leaf", "part", "ids", "decoded"))).alias("parts"))
    second = gathered.select("key", "copies", "parts").mapInArrow(joined, out)
    return first.unionByName(second).select(F.col("key").alias(key), "ids", "decoded")


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of ``encode_texts``."""
    return encoded.select(key, (F.length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
