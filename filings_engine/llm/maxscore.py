"""Exact top-k search by inner product: MaxScore over shards.

A vector component becomes the integer floor(scale * x); a dimension is a term,
and its postings are the rows with a non-zero component there.  Embeddings are
dense, so a shard stores the postings of a dimension as a column.  Per shard the
largest and the smallest component of each dimension and the largest norm bound
what a set of terms can add to a score.

A query's terms go in order of their bounds.  The longest tail whose bound is
under the query's threshold is non-essential: a row without any other term
cannot compete.  The essential postings are traversed for a block of queries at
once; a row stays a candidate while its partial score plus the bound of its rest
(the smaller of the sum of term bounds and the product of the rest's norms)
reaches the threshold, and the non-essential terms are probed in falling order
for the candidates alone.

Thresholds: the first shard (bounded) is searched by all queries, and the kth
score found there is the threshold of each query in all other shards; it is at
most the final kth score, so nothing is lost, and ties stay in.  Within a shard the
threshold rises to the kth partial score that the candidates are sure of.  The
shards' top k are merged.

Equal vectors: only the ``k + 1`` smallest ids of one vector can be in any top k,
so the others are left out before the shuffle (exact, and a vector that a third of
all rows share costs nothing).  Shards and query blocks have a bounded number of
rows whatever the table; a task holds one of each.

Defined results: vectors that are null or hold null or non-finite components take
no part.  Missing components of shorter vectors are zero, an empty vector scores 0
everywhere.  A query meets every row but itself, also rows with its own id or
vector; a repeated query row has its own result.  Ties go to the smaller id, null
ids last; null ids are no queries.  Scores beyond 64 bits stop at its limits
before they are ranked.  An empty table gives an empty table; extra columns do not take part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from filings_engine.llm.common import cut_lineage

K, SCALE = 20, 64
SHARD_ROWS, BLOCK_ROWS = 8_192, 1_024
#: Queries whose partial scores a task holds at once, and terms of one probe.
SIDE, STEP = 32, 4
NONE = int(np.iinfo(np.int64).min)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < n[:, None]] = column.flatten().to_numpy()
    return out


class Shard:
    """Postings and bounds of the rows of one shard, sorted by id."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.terms = ids[order], terms[order].astype(np.float64)
        self.squares = self.terms ** 2
        self.high, self.low = self.terms.max(0, initial=0), self.terms.min(0, initial=0)
        self.probed = 0

    def search(self, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, scores) of the best k rows of each query; ``own``: a row
        that does not count (or -1), ``least``: the threshold."""
        bounds = np.maximum(queries * self.high, queries * self.low)
        order = np.argsort(-bounds, axis=1, kind="stable")
        tail = np.cumsum(np.take_along_axis(bounds, order, 1)[:, ::-1], 1)[:, ::-1]
        norm = np.cumsum(np.take_along_axis(queries ** 2, order, 1)[:, ::-1], 1)[:, ::-1]
        longest = np.sqrt(self.squares.sum(1).max(initial=0))
        essential = np.zeros(queries.shape, bool)
        np.put_along_axis(essential, order, np.minimum(tail, slack(np.sqrt(norm) * longest)) >= least[:, None], 1)
        partial = (queries * essential) @ self.terms.T
        rest = slack(np.sqrt(((queries ** 2) * ~essential).sum(1)[:, None] * ((~essential).astype(np.float64) @ self.squares.T)))
        np.minimum(rest, (bounds * ~essential).sum(1)[:, None], out=rest)
        for i in range(len(queries)):
            if own[i] >= 0:
                rest[i, own[i]] = -np.inf
            rows = np.flatnonzero(partial[i] + rest[i] >= least[i])
            self.probed += len(rows)
            score, left = partial[i, rows], order[i][~essential[i][order[i]]]
            weights = queries[i, left]
            below, short, bound = weights ** 2, self.squares[np.ix_(rows, left)], bounds[i, left]
            for a in range(0, len(left), STEP):
                score = score + self.terms[np.ix_(rows, left[a:a + STEP])] @ weights[a:a + STEP]
                b = a + STEP
                reach = slack(np.sqrt(below[b:].sum() * short[:, b:].sum(1)))
                floor = least[i]
                if len(rows) > k:      # the rest of a row takes off its reach at most
                    floor = max(floor, np.partition(score - reach, len(rows) - k)[len(rows) - k])
                keep = score + np.minimum(bound[b:].sum(), reach) >= floor
                rows, score, short = rows[keep], score[keep], short[keep]
            best = np.lexsort((rows, -score))[:k]
            yield rows[best], score[best]


def slack(x: np.ndarray) -> np.ndarray:
    """Bounds from square roots, safe against rounding."""
    return x * (1 + 1e-9) + 1e-6


def exact_search(ids: np.ndarray, terms: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Every row against every query in whole numbers, for components so large
    that their products leave the exact range of doubles."""
    order = np.argsort(ids, kind="stable")
    table = terms[order].astype(object)
    for q, o in zip(queries.astype(object), own):
        scores = [(-max(NONE, min(int(s), -NONE - 1)), i) for i, s in enumerate(table @ q) if i != o]
        best = sorted(scores)[:k]
        yield np.array([i for _, i in best], int), [-s for s, _ in best]


def search_group(shard: pa.Table, block: pa.Table, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
    """(query number, mask of null ids, ids, scores) for one shard and block."""
    rows, asked = shard.combine_chunks(), block.combine_chunks()
    lists = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rows["terms"], asked["weights"])]
    width = max(int(np.diff(x.offsets.to_numpy()).max(initial=0)) for x in lists)
    terms, queries = (matrix(x, width) for x in lists)
    top = np.iinfo(np.int64).max                                  # null ids go last
    lone = rows["vec_id"].is_null().to_numpy()
    ids = rows["vec_id"].fill_null(top).to_numpy()
    order = np.lexsort((lone, ids))
    ids, lone, terms = ids[order], lone[order], terms[order]
    # a query's own row: one of the rows with its id and vector
    first = {(i, t.tobytes()): at for at, i, t in reversed(list(zip(range(len(ids)), ids.tolist(), terms)))}
    mine = asked["query_id"].to_numpy()
    own = np.array([first.get((i, t.tobytes()), -1) for i, t in zip(mine.tolist(), queries)], int)
    own[own >= 0] = np.where(lone[own[own >= 0]], -1, own[own >= 0])
    numbers, least = asked["query"].to_numpy(), asked["least"].fill_null(NONE).to_numpy().astype(np.float64)
    biggest = max(int(np.abs(terms.astype(np.float64)).max(initial=0)), 1) * max(int(np.abs(queries.astype(np.float64)).max(initial=0)), 1) * max(width, 1)
    places = np.arange(len(ids))
    if biggest >= 1 << 52:
        for number, (at, scores) in zip(numbers, exact_search(places, terms, queries, own, k)):
            yield number, lone[at], ids[at], scores
        return
    index = Shard(places, terms)
    for a in range(0, len(queries), SIDE):
        part = slice(a, a + SIDE)
        for number, (at, scores) in zip(numbers[part], index.search(queries[part].astype(np.float64), own[part], least[part], k)):
            yield number, lone[at], ids[at], scores.astype(np.int64).tolist()


FOUND = "query long, vec_id long, score long"


def top_k(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = K, scale: int = SCALE,
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of every query, a row
    whose id is divisible by ``every``."""
    x = F.col(f"`{vector}`").cast("array<double>")
    usable = x.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c)), F.lit(True))
    low, high = -(2.0 ** 62), 2.0 ** 62
    whole = rows.where(usable).select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.transform(
        x, lambda c: F.floor(F.least(F.lit(high), F.greatest(F.lit(low), scale * c))).cast("long")).alias("terms"))
    few = (whole.withColumn("nth", F.row_number().over(W.partitionBy("terms").orderBy(F.col("vec_id").asc_nulls_last())))
           .where(F.col("nth") <= k + 1).select("vec_id", "terms", F.xxhash64("vec_id", "terms").alias("at")))
    few = cut_lineage(few)
    asked = cut_lineage(whole.where(F.col("vec_id") % every == 0).groupBy("vec_id", "terms").agg(F.count("*").alias("times"))
                        .select(F.col("vec_id").alias("query_id"), "terms", "times", F.monotonically_increasing_id().alias("query")))
    shards = max(1, -(-few.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_rows))
    index = few.select("vec_id", "terms", F.pmod("at", F.lit(shards)).cast("int").alias("shard"))
    queries = asked.select("query", "query_id", F.col("terms").alias("weights"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"))
    schema = pa.schema([(c, pa.int64()) for c in ("query", "vec_id", "score")])

    def search(queries: DataFrame, low: int, high: int) -> DataFrame:
        """Best rows of each query in each shard from ``low`` up to ``high``: one
        group per shard and block."""
        def group(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
            if not len(shard) or not len(block):
                return schema.empty_table()
            query, ids, scores, null = [], [], [], []
            for number, lone, at, found in search_group(shard, block, k):
                query += [number] * len(at)
                ids.append(at)
                null.append(lone)
                scores += found
            ids = pa.array(np.concatenate(ids or [np.empty(0, np.int64)]), mask=np.concatenate(null or [np.empty(0, bool)]))
            return pa.table([pa.array(query, pa.int64()), ids, pa.array(scores, pa.int64())], schema=schema)

        groups = (high - low + 1) * blocks
        left = index.where(F.col("shard").between(low, high)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = queries.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high))))
        left, right = (x.repartition(groups, "shard", "block") for x in (left, right))
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(group, FOUND)

    first = cut_lineage(search(queries.withColumn("least", F.lit(None).cast("long")), 0, 0))
    found = first
    if shards > 1:
        least = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query", "least")
        found = found.unionByName(search(queries.join(least, "query", "left"), 1, shards - 1))
    best = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return (top.join(asked.select("query", "query_id", "times"), "query")
            .withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("query_id", "rank", "vec_id", "score"))
