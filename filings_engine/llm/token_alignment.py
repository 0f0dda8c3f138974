"""Cross-tokenizer alignment with corpus-wide pair counts by minimal perfect
hashing.

A text is encoded by a byte-level BPE vocabulary (A, after a space) and by a piece
vocabulary (B, which adds that space itself).  Byte offsets where tokens of both
end cut them into groups; two tokens are linked if their byte ranges overlap.  The
count of an id pair is the number of documents that hold it linked.

1. Chunks: the texts land in the shared folder with a chunk number (a bounded number
   of characters each), so both passes see the same chunks.
2. First pass: each chunk is aligned; per chunk and hash segment it lists its distinct
   pairs and how many of its documents hold them.
3. The distinct pairs of a segment get a minimal perfect hash: bit arrays in levels,
   a key sits in the first level where no other key of the segment shares its bit,
   and its number is the rank of that bit.
4. Counts: each group of ``FAN`` chunks adds its counts into one dense vector indexed
   by that number (the stored key is compared), and the vectors are summed in a tree
   of ``FAN`` children a node.  No group holds more than ``FAN`` of anything.
5. Second pass: each chunk asks the segments for its pairs (hash, key compared), is
   aligned anew and looks its links up.

The pairs of a segment number at most |A| * |B| / ``SEGMENTS``, whatever the corpus;
nothing is broadcast or collected.

Alignment is by units, the parts of a text that begin with a single space: neither
vocabulary has a token over such a border (checked for B when it is loaded, a
property of the pattern of A).  A worker remembers the units it has aligned; new
ones are encoded together, many to a call.

Defined results: texts that are null, empty, or whose tokens of either vocabulary do
not join to a space and the text have no tokens: zeros and an empty ``groups``.
Strings of special tokens in a text are plain text.  Very long texts are whole; a
text over ``CHUNK_CHARS`` is a chunk of its own.  Repeated rows and null keys each
keep their row and count as documents of their own.  Ties for an A id's highest count
are all highest.  An empty table gives an empty table; extra columns do not take
part."""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from filings_engine.llm.common import cut_lineage
from filings_engine.session import materialize

CHUNK_CHARS = 1 << 22
#: Characters that a row counts besides its text, so that empty rows fill chunks too.
ROW_CHARS = 64
SEGMENTS = 256
FAN = 64
#: Units that a worker remembers when it begins a chunk, and that are encoded in one call.
MEMO_UNITS, CALL_UNITS = 300_000, 2_048
#: Bits of a level for each key that is left.
GAMMA = 2
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANKS = "\t-\r\x85\xa0  -     　"
BLANK_STARTS = {"", " ", *re.findall(f"[{BLANKS}]", "".join(map(chr, range(0x3001))))}
LOOSE, CUT = re.compile(f" [{BLANKS}]"), re.compile(f"(?<=[^ {BLANKS}]) ")
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def units(text: str) -> list[str]:
    """The text cut before single spaces, without those spaces."""
    parts = text.split(" ")
    return CUT.split(text) if "" in parts or LOOSE.search(text) else parts


class Codecs:
    """Both vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        with open(path_a, encoding="utf-8") as f:
            file = json.load(f)
        model, added = file["model"], {x["id"] for x in file.get("added_tokens", [])}
        chars, vocab = byte_of_char(), model["vocab"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("the ids of a byte-level vocabulary must follow its merges")
        self.bytes_a = {i: bytes([chars[c] for c in t]) for t, i in vocab.items() if i not in added}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes_a.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes over the beginning of a word")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.size_a[list(self.bytes_a)] = [len(b) for b in self.bytes_a.values()]
        self.size_b = np.array([len(b) for b in self.bytes_b], np.int64)
        if len(set(self.bytes_a.values()) & {bytes([b]) for b in range(256)}) < 256:
            raise ValueError("a byte-level vocabulary has every byte")
        #: text of an id with what may stand behind it: place 4 * id + (0: ',', 1: '|', 2: ';', 3: nothing)
        self.text = np.array([f"{i}{x}" for i in range(max(len(self.size_a), len(self.size_b))) for x in (",", "|", ";", "")], object)

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by A and B of the parts, each after a space; None if the tokens of B
        do not join to that (those of A do, as it has every byte)."""
        text = " ".join(parts)
        a = np.asarray(self.a.encode_ordinary(" " + text), np.int64)
        b = np.asarray(self.b.encode(text) if text else [self.b.piece_to_id("▁")], np.int64)
        joined = b"".join(map(self.bytes_b.__getitem__, b.tolist()))
        return (a, b) if joined == (" " + text).encode() else None


class Memo:
    """Aligned units of a worker: counts, links as slots of distinct pairs, and the
    groups as text if they are asked for."""

    def __init__(self, codecs: Codecs, with_groups: bool = True):
        self.codecs, self.with_groups = codecs, with_groups
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.slot: dict[int, int] = {}
        self.groups: list[str] = []
        self.sizes: list[np.ndarray] = []        # (n_a, n_b, n_groups, n_links) of each unit, -1 if it has no tokens
        self.links: list[np.ndarray] = []        # slots, unit after unit

    def learn(self, new: set[str]) -> None:
        lone = [p for p in new if p[:1] in BLANK_STARTS]
        joint = list(new.difference(lone))
        for a in range(0, len(joint), CALL_UNITS):
            self.align(joint[a:a + CALL_UNITS])
        for p in lone:
            self.align([p])
        if new:
            self.sizes = [np.concatenate(self.sizes)]
            self.links = [np.concatenate(self.links)]
            self.ends = np.cumsum(np.maximum(self.sizes[0][:, 3], 0))
            self.pairs = np.fromiter(self.slot, np.int64, len(self.slot))

    def align(self, parts: list[str]) -> None:
        found = self.codecs.encode(parts)
        if found is None and len(parts) > 1:
            self.align(parts[:len(parts) // 2])
            self.align(parts[len(parts) // 2:])
            return
        self.index.update(zip(parts, range(len(self.index), len(self.index) + len(parts))))
        if found is None:
            self.groups.append("")
            self.sizes.append(np.full((1, 4), -1, np.int64))
            self.links.append(np.empty(0, np.int64))
            return
        a, b = found
        unit_ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        a_ends, b_ends = np.cumsum(self.codecs.size_a[a]), np.cumsum(self.codecs.size_b[b])
        cuts = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        both = np.append(cuts[1:] == cuts[:-1], False)
        cuts, common = cuts[~both], cuts[both]
        pairs = a[np.searchsorted(a_ends, cuts)] << 32 | b[np.searchsorted(b_ends, cuts)]
        distinct, at = np.unique(pairs, return_inverse=True)
        slot = self.slot
        self.links.append(np.array([slot.setdefault(p, len(slot)) for p in distinct.tolist()], np.int64)[at])
        ends = [np.searchsorted(e, unit_ends, "right") for e in (a_ends, b_ends, common, cuts)]
        self.sizes.append(np.diff(np.stack(ends, 1), axis=0, prepend=0))
        if self.with_groups:
            self.groups += self.group_texts(a, b, a_ends, b_ends, common, unit_ends, ends[0] + ends[1])

    def group_texts(self, a, b, a_ends, b_ends, common, unit_ends, ends) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each unit: all tokens in order of group, A before
        B, each with what stands behind it."""
        a_of, b_of = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        a_until = np.searchsorted(a_ends, common, "right")                      # tokens of A up to a group
        b_before = np.append(0, np.searchsorted(b_ends, common, "right"))       # tokens of B before it
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + b_before[a_of]] = self.codecs.text[4 * a + (a_ends == common[a_of])]
        behind = np.where(b_ends == common[b_of], np.where(b_ends == unit_ends[np.searchsorted(unit_ends, b_ends)], 3, 2), 0)
        text[np.arange(len(b)) + a_until[b_of]] = self.codecs.text[4 * b + behind]
        items, ends = text.tolist(), [0, *ends.tolist()]
        return ["".join(items[i:j]) for i, j in zip(ends, ends[1:])]

    def read(self, texts: list[str | None]) -> list[np.ndarray]:
        """The units of each text; none if it has no tokens."""
        if len(self.index) > MEMO_UNITS:
            self.clear()
        parts = [units(t) if t else [] for t in texts]
        flat = list(itertools.chain.from_iterable(parts))
        at = np.fromiter(map(self.index.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            missed = [flat[i] for i in missing.tolist()]
            self.learn(set(missed))
            at[missing] = np.fromiter(map(self.index.__getitem__, missed), np.int64, len(missed))
        seen = np.split(at, np.cumsum([len(p) for p in parts])[:-1]) if parts else []
        return [x[:0] if len(x) and self.sizes[0][x, 0].min() < 0 else x for x in seen]

    def links_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the links of some units, and how many each has."""
        n = self.sizes[0][at, 3]
        begin = self.ends[at] - n
        return self.links[0][np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


@functools.lru_cache(maxsize=1)
def codecs(path_a: str, path_b: str) -> Codecs:
    return Codecs(path_a, path_b)


@functools.lru_cache(maxsize=1)
def memo(path_a: str, path_b: str, with_groups: bool) -> Memo:
    return Memo(codecs(path_a, path_b), with_groups)


# --- minimal perfect hash ---------------------------------------------------
def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64(MIX[0] * (level + 1) % 2 ** 64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def segment_of(pairs: np.ndarray) -> np.ndarray:
    return (mixed(pairs, -1) % np.uint64(SEGMENTS)).astype(np.int32)


def build_hash(keys: np.ndarray) -> tuple[list[int], bytes]:
    """Sizes of the levels and their bits for distinct keys."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = max(8, GAMMA * len(left) + 7 & ~7)
        at = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        count = np.bincount(at, minlength=size)
        bits.append(count == 1)
        sizes.append(size)
        left = left[count[at] > 1]
    return sizes, np.packbits(np.concatenate(bits)).tobytes() if bits else b""


def hash_numbers(keys: np.ndarray, sizes: list[int], bits: bytes) -> np.ndarray:
    """The number of each key (any number, or -1, for keys that are not in the hash)."""
    flags = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    rank = np.cumsum(flags) - 1
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + (mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
        hit = flags[at]
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return out


def numbers_of(pairs: np.ndarray, segment: dict) -> np.ndarray:
    """Numbers of pairs that must be in the segment; keys are compared."""
    at = hash_numbers(pairs, segment["sizes"], segment["bits"])
    if (at < 0).any() or (segment["keys"][at] != pairs).any():
        raise RuntimeError("a pair is not in its segment")
    return at


def longs(table: pa.Table, column: str) -> np.ndarray:
    """All values of a column of arrays, row after row."""
    x = table[column].combine_chunks()
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy()


# --- the job ------------------------------------------------------------------
def align_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_a: str | None = None, vocabulary_b: str | None = None,
                chunk_chars: int = CHUNK_CHARS, fan: int = FAN) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one row per
    row of ``docs``; ``groups`` lists the ids of each group as ``a1,a2|b1``, joined
    by ``;``."""
    path_a, path_b = (v or d for v, d in zip((vocabulary_a, vocabulary_b), default_vocabularies() if None in (vocabulary_a, vocabulary_b) else (None, None)))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            total = chars + np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_CHARS)
            if len(total):
                chars = int(total[-1])
            yield pa.record_batch([*batch.columns, pa.array((part << 32) + total // chunk_chars, pa.int64())], names=["key", "text", "chunk"])

    def pairs_of(chunk: int, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        known = memo(path_a, path_b, False)
        seen = known.read(texts)
        count, last = np.zeros(len(known.slot), np.int64), np.zeros(len(known.slot), np.int64)
        for at in seen:
            if len(at):
                slots = known.links_of(at)[0]
                place = np.arange(len(slots))
                last[slots] = place
                count[slots[last[slots] == place]] += 1          # each slot of a document once
        held = np.flatnonzero(count)
        if not len(held):
            return
        pairs = known.pairs[held]
        segment = segment_of(pairs)
        order = np.argsort(segment, kind="stable")
        names, first = np.unique(segment[order], return_index=True)
        offsets = pa.array(np.append(first, len(order)), pa.int32())
        yield pa.record_batch([pa.array(np.full(len(names), chunk), pa.int64()), pa.array(names, pa.int32()),
                               pa.ListArray.from_arrays(offsets, pa.array(pairs[order])), pa.ListArray.from_arrays(offsets, pa.array(count[held][order]))],
                              names=["chunk", "segment", "pairs", "docs"])

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts = None, []
        for batch in batches:
            for chunk, x in zip(batch.column("chunk").to_pylist(), batch.column("text")):
                if chunk != now:
                    yield from pairs_of(now, texts)
                    now, texts = chunk, []
                texts.append(x.as_py())
        yield from pairs_of(now, texts)

    landed = materialize(rows.mapInArrow(cut, f"key {kind}, text string, chunk long"), as_table=True)
    held = materialize(landed.select("chunk", "text").mapInArrow(first_pass, "chunk long, segment int, pairs array<long>, docs array<long>"), as_table=True)
    chunks = landed.select("chunk").distinct().count()
    spans = max(1, -(-chunks // fan))
    held = held.withColumn("span", F.pmod(F.xxhash64("chunk"), F.lit(spans)).cast("int"))

    def make_hash(table: pa.Table) -> pa.Table:
        keys = table["pair"].combine_chunks().to_numpy()
        sizes, bits = build_hash(keys)
        ordered = np.empty_like(keys)
        ordered[hash_numbers(keys, sizes, bits)] = keys
        return pa.table({"segment": table["segment"].slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int32())), "bits": pa.array([bits], pa.binary()),
                         "keys": pa.array([ordered], pa.list_(pa.int64()))})

    distinct = held.select("segment", F.explode("pairs").alias("pair")).distinct()
    hashes = cut_lineage(distinct.groupBy("segment").applyInArrow(make_hash, "segment int, sizes array<int>, bits binary, keys array<long>"))

    def per_span(segments: DataFrame) -> DataFrame:
        every = segments.withColumnRenamed("segment", "of").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))
        return every.groupBy("of", "part")

    def opened(segment: pa.Table) -> dict:
        row = {"sizes": segment["sizes"][0].as_py(), "bits": segment["bits"][0].as_py(), "keys": longs(segment.select(["keys"]), "keys")}
        return row | ({"values": longs(segment.select(["values"]), "values")} if "values" in segment.column_names else {})

    def add_up(name: tuple, asked: pa.Table, segment: pa.Table) -> pa.Table:
        out = pa.schema([("segment", pa.int32()), ("span", pa.int32()), ("vector", pa.list_(pa.int64()))])
        if not len(asked):
            return out.empty_table()
        known = opened(segment)
        vector = np.zeros(len(known["keys"]), np.int64)
        np.add.at(vector, numbers_of(longs(asked, "pairs"), known), longs(asked, "docs"))
        return pa.table([[name[0].as_py()], [name[1].as_py()], [vector]], schema=out)

    def tree_sum(table: pa.Table) -> pa.Table:
        total = functools.reduce(np.add, (x.values.to_numpy() for x in table["vector"]))
        return table.slice(0, 1).set_column(2, "vector", pa.array([total], pa.list_(pa.int64())))

    vector = "segment int, span int, vector array<long>"
    vectors = held.groupBy("segment", "span").cogroup(per_span(hashes)).applyInArrow(add_up, vector)
    left = spans
    while left > 1:
        left = -(-left // fan)
        vectors = vectors.withColumn("span", F.floor(F.col("span") / fan).cast("int")).groupBy("segment", "span").applyInArrow(tree_sum, vector)
    # the highest count of an A id: at most |B| pairs a window
    counted = (hashes.join(vectors.select("segment", "vector"), "segment")
               .select("segment", "sizes", "bits", F.posexplode(F.arrays_zip("keys", "vector")).alias("at", "pair")))
    a = F.shiftright(F.col("pair.keys"), 32)
    best = F.col("pair.vector") == F.max("pair.vector").over(W.partitionBy(a))
    valued = (counted.select("segment", F.struct("at", "pair.keys", (2 * F.col("pair.vector") + best.cast("long")).alias("value")).alias("x"))
              .groupBy("segment").agg(F.array_sort(F.collect_list("x")).alias("x"))
              .join(hashes.select("segment", "sizes", "bits"), "segment").select("segment", "sizes", "bits", F.col("x.keys").alias("keys"), F.col("x.value").alias("values")))

    def answer(asked: pa.Table, segment: pa.Table) -> pa.Table:
        if not len(asked):
            return pa.table([[], [], []], schema=pa.schema([("chunk", pa.int64()), ("pairs", pa.list_(pa.int64())), ("values", pa.list_(pa.int64()))]))
        known = opened(segment)
        lists = asked["pairs"].combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        pairs = lists.flatten()
        ends = pa.array(np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy())), pa.int32())
        values = pa.ListArray.from_arrays(ends, pa.array(known["values"][numbers_of(pairs.to_numpy(), known)]))
        return pa.table([asked["chunk"], pa.ListArray.from_arrays(ends, pairs), values], names=["chunk", "pairs", "values"])

    answers = held.groupBy("segment", "span").cogroup(per_span(valued)).applyInArrow(answer, "chunk long, pairs array<long>, values array<long>")
    fields = [("key", rows.select("key").limit(0).toArrow().schema.field("key").type), *((c, pa.int64()) for c in COUNTS), ("groups", pa.string())]

    def second_pass(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known = memo(path_a, path_b, True)
        seen = known.read(texts["text"].to_pylist())
        used = np.unique(np.concatenate([*seen, np.empty(0, np.int64)]))
        score = np.zeros((len(known.index), 2), np.int64)
        if len(used):
            pairs, order = np.unique(longs(answers, "pairs"), return_index=True)
            slots, n = known.links_of(used)
            found = np.searchsorted(pairs, known.pairs[slots])
            value = longs(answers, "values")[order][found]
            total = np.concatenate([[[0, 0]], np.cumsum(np.stack([value & 1, value >> 1], 1), 0)])
            score[used] = total[np.cumsum(n)] - total[np.cumsum(n) - n]
        sums = [np.concatenate([known.sizes[0][at].sum(0), score[at].sum(0)]) if len(at) else np.zeros(6, np.int64) for at in seen]
        columns = np.array(sums).reshape(-1, 6)
        groups = [";".join(map(known.groups.__getitem__, at.tolist())) for at in seen]
        return pa.table([texts["key"], *(pa.array(columns[:, i]) for i in range(6)), pa.array(groups, pa.string())], schema=pa.schema(fields))

    out = f"key {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups string"
    done = landed.groupBy("chunk").cogroup(answers.withColumnRenamed("chunk", "asked").groupBy("asked")).applyInArrow(second_pass, out)
    return done.withColumnRenamed("key", key)


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def digests(aligned: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, the counts, groups_sha256) of ``align_texts``."""
    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return aligned.select(F.col(f"`{key}`"), *COUNTS, sha.alias("groups_sha256"))
