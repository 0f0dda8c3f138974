"""Request-rate audit (the throttle re-aimed as log analysis)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from filings_engine.operators.positions import running_count

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(ts: str):
    """Microseconds since the epoch of a zone-less timestamp (no session
    time-zone or DST involved)."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, CAST(`{ts}` AS TIMESTAMP_NTZ))")


def request_rate_audit(events: DataFrame, key: str = "user_id", ts: str = "ts",
                       limit: int = 10, period_us: int = 1_000_000,
                       id_col: str = "event_id") -> DataFrame:
    """For each request, how many other requests of the same key lie in the
    trailing half-open window (t - period, t] (equal timestamps count), and
    whether that reaches ``limit`` (the throttle would have waited).

    Skew-safe plan: time is cut into period-long buckets; each event is a
    member of its bucket and a carried copy in the next one, so every window
    (t - period, t] lies inside one (key, bucket) partition.  The range frame
    then runs per (key, bucket) — groups bounded by two periods of one key,
    not by the key's whole history."""
    us = epoch_micros(ts)
    base = events.select(key, id_col, ts, us.alias("_us"))
    bucket = F.floor(F.col("_us") / F.lit(period_us))
    places = F.array(F.struct(bucket.alias("_b"), F.lit(True).alias("_m")), F.struct((bucket + 1).alias("_b"), F.lit(False).alias("_m")))
    w = (Window.partitionBy(key, "_b").orderBy("_us")
         .rangeBetween(-(period_us - 1), Window.currentRow))
    counted = (base.select("*", F.inline(places))
               .withColumn("n_recent", F.count(F.lit(1)).over(w) - 1)
               .filter("_m"))
    return counted.select(key, id_col, ts, "n_recent", (F.col("n_recent") >= limit).alias("over_limit"))


def request_rate_ranks(events: DataFrame, key: str = "user_id", ts: str = "ts", limit: int = 10, period_us: int = 1_000_000,
                       id_col: str = "event_id", partitions: int | None = None) -> DataFrame:
    """``request_rate_audit`` for hot keys and long periods, by rank differences:
    the requests of (t - period, t] are those up to t less those up to t - period.

    Requests are counted per (key, t) first, so equal times are one row; each such
    row asks for the count up to its start.  Counts and questions are ranked together
    over range partitions of (key, time), so neither a key's share of the rows nor the
    length of the period bounds a task.  A request without a time has no count."""
    us = epoch_micros(ts)
    base = events.select(F.col(key).alias("_k"), us.alias("_t"), *[F.col(c).alias(f"_{i}") for i, c in enumerate((key, id_col, ts))])
    counts = base.where("_t IS NOT NULL").groupBy("_k", "_t").agg(F.count(F.lit(1)).alias("_n"))
    points = counts.select("_k", F.inline(F.array(
        F.struct(F.col("_t").alias("_at"), F.col("_n").alias("_w"), F.lit(0).alias("_asks"), F.col("_t").alias("_of")),
        F.struct((F.col("_t") - period_us).alias("_at"), F.lit(0).cast("long").alias("_w"), F.lit(1).alias("_asks"), F.col("_t").alias("_of")))))
    ranks = running_count(points, "_k", "_at", "_w", "_asks", "_rank", partitions)
    up_to = [F.max(F.when(F.col("_asks") == asks, F.col("_rank"))) for asks in (0, 1)]
    recent = ranks.groupBy(F.col("_k").alias("_key"), F.col("_of").alias("_time")).agg((up_to[0] - up_to[1] - 1).alias("n_recent"))
    out = base.join(recent, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_time")), "left")
    return out.select(F.col("_0").alias(key), F.col("_1").alias(id_col), F.col("_2").alias(ts), "n_recent", (F.col("n_recent") >= limit).alias("over_limit"))
