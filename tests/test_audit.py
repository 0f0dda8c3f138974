import datetime as dt
import random

from pyspark.sql import Window, functions as F

from filings_engine.operators import positions as ps
from filings_engine.operators.audit import request_rate_audit, request_rate_ranks


def test_window_edges_and_brute_force(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, 1, base), (2, 1, base + dt.timedelta(seconds=1)),            # exactly one period apart
            (3, 1, base + dt.timedelta(seconds=1)), (4, 2, base)]
    rnd = random.Random(7)
    for i in range(5, 400):
        rows.append((i, rnd.randint(3, 6), base + dt.timedelta(microseconds=rnd.randint(0, 5_000_000))))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    got = {r.event_id: (r.n_recent, r.over_limit) for r in
           request_rate_audit(df, limit=3, period_us=1_000_000).collect()}
    assert got[2][0] == 1 and got[1][0] == 0          # event 1 is exactly one period before 2: outside
    for eid, uid, ts in rows:                          # brute force
        n = sum(1 for e2, u2, t2 in rows if u2 == uid and e2 != eid and ts - dt.timedelta(seconds=1) < t2 <= ts)
        assert got[eid] == (n, n >= 3), eid


def test_ranks_of_a_hot_key_over_a_long_period(spark):
    """One key holds most requests, many at one time; the period is longer than the log."""
    base, rnd = dt.datetime(2024, 1, 1), random.Random(3)
    rows = [(i, rnd.choice([1, 1, 1, 2, None]), base + dt.timedelta(seconds=rnd.choice([7, rnd.randint(0, 900)]))) for i in range(900)]
    rows += [(900, 1, None), (901, None, None)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").repartition(5)
    for seconds in (1, 60, 100_000):
        period = dt.timedelta(seconds=seconds)
        got = {r.event_id: (r.n_recent, r.over_limit) for r in request_rate_ranks(df, limit=50, period_us=seconds * 1_000_000, partitions=7).collect()}
        assert len(got) == len(rows)
        for eid, uid, ts in rows:
            n = ts and sum(1 for _, u, t in rows if u == uid and t and ts - period < t <= ts) - 1
            assert got[eid] == (n, None if n is None else n >= 50)


def test_a_hot_key_spreads_over_all_partitions(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 1, id % 50) AS k", "id AS at", "1L AS w", "0 AS asks")
    per_part = ps.ranged(df.where("k = 1"), [F.col("k"), F.col("at")], 8).groupBy("_part").count().collect()
    assert len(per_part) == 8 and max(r["count"] for r in per_part) < 2 * min(r["count"] for r in per_part)
    got = ps.running_count(df, "k", "at", "w", "asks", partitions=8)
    plain = df.withColumn("expected", F.sum("w").over(Window.partitionBy("k").orderBy("at")))
    assert got.join(plain, ["k", "at"]).where("running = expected").count() == 20_000


def test_positions_in_the_whole_order(spark):
    df = spark.range(5000).selectExpr("id", "id * 7919 % 13 AS g", "if(id % 9 = 0, NULL, id * 31 % 101) AS v").repartition(6)
    order = [F.col("g").asc(), F.col("v").desc_nulls_last(), F.col("id").asc()]
    got = [r.id for r in ps.with_position(df, order, partitions=7).orderBy("position").collect()]
    want = sorted(range(5000), key=lambda i: (i * 7919 % 13, i % 9 == 0, 0 if i % 9 == 0 else -(i * 31 % 101), i))
    assert got == want
    assert [r.position for r in ps.with_position(df.limit(3), order).orderBy("position").collect()] == [1, 2, 3]
    assert ps.with_position(df.where("id < 0"), order).count() == 0
