"""Sharding by extendible hashing (DataFrame functions only).

A row's place is the bit string of the hash of its id.  The directory starts as one
bucket; a bucket whose rows weigh more than ``limit`` bytes splits on the next bit, the
others stay, until every bucket fits.  A bucket is thus the shortest hash prefix that
fits, and its depth is local to it.

The rows are first weighed per cell of a fixed number of prefix bits (partial sums, so a
hot source or a group of copies costs one row per task).  The cells are a few times the
shards needed, and all splitting happens on this table.  Only buckets that a whole cell
overflows go another round, on the next bits of their own rows.

Defined results: rows that share one id share all bits and cannot be split, nor can a row
heavier than ``limit``: such a bucket stops at the first prefix they have to themselves
and is marked ``fits = false``.  Null ids hash like a value of their own; null texts weigh
0 bytes; an empty table has no shards.  Extra columns do not take part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from filings_engine.llm.common import cut_lineage

LIMIT = 1 << 20
BITS = 128
#: Bits of a cell beyond those that number the shards.
SPARE = 3


def bits_of(key: Column) -> Column:
    """The 128 bits of the MD5 of the id's text, as a string of 0 and 1."""
    h = F.md5(F.coalesce(key.cast("string"), F.lit("\u0000")).cast("binary"))
    return F.concat_ws("", *[F.lpad(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(4)])


def directory(cells: DataFrame, limit: int, base: int, depth: int) -> DataFrame:
    """Open buckets (d, shard, shard_bytes, shard_rows, fits, more) of
    cells(cell of ``depth`` bits, bytes, rows, low, high).  Every prefix from ``base`` bits on is
    weighed; the open ones are the shortest that stop.  ``more``: the cell itself overflows."""
    nodes = cells.select("*", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("d"))
    sums = nodes.groupBy("d", F.expr("substring(cell, 1, d)").alias("shard")).agg(
        F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"), (F.min("low") == F.max("high")).alias("alone"))
    sums = cut_lineage(sums.withColumn("fits", F.col("shard_bytes") <= limit).withColumn("stops", F.col("fits") | F.col("alone")))
    split = sums.where(~F.col("stops")).select((F.col("d") + 1).alias("pd"), F.col("shard").alias("parent"))
    ends = sums.where(F.col("stops") | (F.col("d") == depth))
    below = ends.where(F.col("d") > base).join(split, (F.col("d") == F.col("pd")) & (F.expr("substring(shard, 1, d - 1)") == F.col("parent")), "left_semi")
    return below.unionByName(ends.where(F.col("d") == base)).select("d", "shard", "shard_bytes", "shard_rows", "fits", (~F.col("stops")).alias("more"))


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, shard bits, depth, shard_bytes, shard_rows, fits), one row per row."""
    left = cut_lineage(docs.select(F.col(key).alias("key"), bits_of(F.col(key)).alias("bits"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")))
    done, base = None, 0
    while True:
        total, buckets = left.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count_distinct(F.substring("bits", 1, base))).first()
        # every bucket that is left needs so many bits more on average
        depth = min(BITS, base + SPARE + math.ceil(math.log2(total / limit / max(1, buckets) + 1)))
        cell = F.substring("bits", 1, depth)
        cells = cut_lineage(left.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("bits").alias("low"), F.max("bits").alias("high")))
        opened = cut_lineage(directory(cells, limit, base, depth))
        prefixes = cells.select("cell", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("cd")).withColumn("prefix", F.expr("substring(cell, 1, cd)"))
        of_cell = prefixes.join(opened, (F.col("cd") == F.col("d")) & (F.col("prefix") == F.col("shard"))).drop("cd", "prefix")
        placed = cut_lineage(left.withColumn("own", cell).join(of_cell, F.col("own") == F.col("cell")).drop("own", "cell"))
        part = placed.where(~F.col("more"))
        done = part if done is None else done.unionByName(part)
        left = placed.where("more").select("key", "bits", "bytes")
        base = depth
        if not left.limit(1).count():
            break
    return done.select(F.col("key").alias(key), "shard", F.col("d").cast("int").alias("depth"), "shard_bytes", "shard_rows", "fits")
