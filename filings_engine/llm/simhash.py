"""SimHash near-duplicates by a byte-position inverted index.

Fingerprint: ASCII capitals lower-cased, words are runs of anything but ASCII
white space, every ``shingle_words`` words in a row (repeats included, joined
by one space; a shorter text is one shingle) hashed with XXH64, seed 42; a bit
is set if over half of the hashes have it.

Two of 8 bytes can hold the at most 2 differing bits, so linked fingerprints
share at least 6 positional bytes (the count filter's guaranteed minimum).  A
list per single (position, byte) would hold 1/256 of the corpus, so the index
is built on four positional bytes at a time: cut into four blocks of two bytes,
6 shared bytes leave at least two blocks whole, hence a linked pair meets in one
of six lists.  Pairs that meet are tallied over all eight positions, those
below the minimum dropped, the rest verified by their differing bits.

Equal fingerprints are one entry, so copies never pair up.  A list longer than
``list_limit`` is not paired at all: its members emit the 65 fingerprints
within one bit of themselves instead.  Two fingerprints are within two bits
exactly if they emit a common one, so a star per emitted value links the same
sets with work linear in the list.

Defined results: a text that is null or has no word gets fingerprint zero and
is linked like any other; rows with a null id are classified, and a component
takes its smallest non-null id (null if it has none); repeated rows stay rows.
Other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from filings_engine.llm.common import boxed, components, cut_lineage, hot_join, row_hash

SHINGLE_WORDS = 3
MAX_BITS = 2
LIST_LIMIT = 64
#: Shingles hashed before their bits are added up (64 bytes each).
HASH_BLOCK = 65_536
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: The six pairs of two-byte blocks, as masks over the 64 bits.
BLOCKS = [0xFFFF << (16 * i) for i in range(4)]
MASKS = [(BLOCKS[i] | BLOCKS[j]) for i in range(4) for j in range(i + 1, 4)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint of UTF-8 text."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    k = min(shingle_words, len(words))
    ones, n = np.zeros(64, np.int64), len(words) - k + 1
    hash64 = xxhash.xxh64_intdigest
    for a in range(0, n, HASH_BLOCK):
        part = words[a:a + HASH_BLOCK + k - 1]
        h = np.array([hash64(b" ".join(s), 42) for s in zip(*[part[i:] for i in range(k)])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp long), one row per row."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle_words) for t in b.column("text")]
            yield pa.record_batch([b.column("key"), pa.array(fps, pa.int64())], names=["key", "fp"])

    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp long")
    return out.withColumnRenamed("key", key)


def shared_bytes(a: Column, b: Column) -> Column:
    """Tally of equal positional bytes of two fingerprints."""
    x = a.bitwiseXOR(b)
    return sum(F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(8))


def fingerprint_links(fps: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints, fps(fp).  Outside long
    lists these are all pairs within ``MAX_BITS``; inside, stars with the same
    components."""
    lists = F.array(*[F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bytes")) for i, m in enumerate(MASKS)])
    postings = fps.select("fp", F.explode(lists).alias("p")).select("fp", "p.no", "p.bytes")
    # only lists with company; landed, so that a long list can be split between tasks
    size = cut_lineage(postings.groupBy("no", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut_lineage(postings.join(size, ["no", "bytes"]))
    short, long = shared.where(F.col("n") <= list_limit), shared.where(F.col("n") > list_limit)
    a, b = short.select("no", "bytes", F.col("fp").alias("a")), short.select("no", "bytes", F.col("fp").alias("b"))
    pairs = a.join(b, ["no", "bytes"]).where("a < b")
    xor = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(xor.bitwiseAND(F.lit(signed(m))) == 0, F.lit(i)) for i, m in enumerate(MASKS)])
    pairs = (pairs.where(first == F.col("no"))
             .where(shared_bytes(F.col("a"), F.col("b")) >= 8 - MAX_BITS)
             .where(F.bit_count(xor) <= MAX_BITS).select("a", "b"))
    # long lists: every value within one bit; equal values meet within two
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    met = long.select("fp").distinct().select("fp", F.explode(near).alias("near"))
    centre = met.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("near", "a")
    stars = met.join(centre, "near").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS,
                    list_limit: int = LIST_LIMIT) -> DataFrame:
    """(key, fingerprint hex, component_id) for every row of ``docs``."""
    rows = cut_lineage(fingerprints(docs, key, text, shingle_words).withColumnRenamed(key, "key"))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    links = fingerprint_links(classes.select("fp"), list_limit)
    member = components(classes.select(F.col("fp").alias("node")), links)
    classes = classes.join(member, F.col("fp") == F.col("node")).select("fp", "least", "n", "component")
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("texts"))
    classes = hot_join(classes, least, "component", "texts").select("fp", "n", "component_id")
    return (hot_join(rows, classes, "fp", "n")
            .select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The one row of each component that stays, all columns: the smallest id,
    then the smallest hash of the row (rows without an id come last)."""
    tag = row_hash(docs)
    rows = docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), tag.alias("tag")).alias("row"), F.col(text).alias("text"))
    whole = boxed(docs, key, tag)
    found = near_duplicates(rows, "row", "text")
    dropped = found.where("row <> component_id").select(F.col("row.key").alias("_key"), F.col("row.tag").alias("_tag")).distinct()
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_tag"))
    kept = whole.join(dropped, same, "left_anti")
    # rows equal in every column are one document as well
    repeated = cut_lineage(found.where("row = component_id").groupBy("row").agg(F.count("*").alias("n")).where("n > 1")
                           .select(F.col("row.key").alias("_key"), F.col("row.tag").alias("_tag")))
    if repeated.limit(1).count():
        once = kept.join(repeated, same, "left_semi").groupBy("key", "row").agg(F.first("doc").alias("doc"))
        kept = kept.join(repeated, same, "left_anti").select("doc").unionByName(once.select("doc"))
    return kept.select("doc.*")
