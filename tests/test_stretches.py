"""Streams in stretches: late, repeated and unordered events, restarts, against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators.windows import folded
from docspark.streaming import monitors, stretches

SCHEMA = "event_id long, user_id long, event_type string, value double, second long"


def put(spark, folder, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("second").cast("timestamp_ntz")).drop("second")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, monitor):
    """One run of the stream over what is there, from its checkpoint."""
    stream = monitor(monitors.events_stream(spark, f"{folder}/in"))
    monitors.run_once(stream, folder, stored=True)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows")


def events(seed, n, seconds):
    rng = random.Random(seed)
    return [(i, rng.randrange(6), rng.choice(["error", "view", "view"]), rng.random(), rng.randrange(seconds)) for i in range(n)]


def test_late_repeated_and_restarted(spark, tmp_path):
    folder, size = f"file://{tmp_path}", 600
    rows = sorted(events(1, 300, 6000), key=lambda r: r[4])
    first, second = rows[:150], rows[150:]
    mark = max(r[4] for r in first) - 300
    closed = mark // size * size  # stretches before it are closed by the first run
    late = [(1000, 1, "view", 99.0, closed - 1), (1001, 1, "view", 99.0, 5)]
    in_time = [(1002, 1, "view", 0.5, mark + 1), (1003, 2, "error", 0.25, max(r[4] for r in first) - 200)]
    monitor = stretches.stretches("event_type", "string", stretches._first_and_sum(0.3), "s double, first double", size)
    random.Random(2).shuffle(first)
    put(spark, folder, first + first[:40])  # unordered, some twice
    run(spark, folder, monitor)
    put(spark, folder, late + in_time + second + second[::3] + [r for r in first if r[4] >= closed][:5])
    sums = run(spark, folder, monitor)
    counted = [r for r in first + second + in_time]
    end = (max(r[4] for r in counted) - 300) // size * size
    want = {}
    for r in sorted(counted, key=lambda r: (r[4], r[0])):
        if r[4] < end:
            n, e = want.get(r[2], (0, r[3]))
            want[r[2]] = n + 1, 0.7 * e + 0.3 * r[3] if n else r[3]
    got = {r.event_type: r.ewma for r in folded(sums, "event_type", 0.3, 2).collect()}
    assert got == pytest.approx({k: e for k, (_, e) in want.items()})
    assert {r.event_type: r.n for r in sums.groupBy("event_type").agg(F.sum("n").alias("n")).collect()} == {k: n for k, (n, _) in want.items()}
    assert sums.groupBy("event_type", "block").count().filter("count > 1").isEmpty()  # a stretch closes once
    again = run(spark, folder, monitor)  # nothing new
    assert again.count() == sums.count()


@pytest.mark.parametrize("last, least", [(5, 3), (4, 4), (3, 1)])
def test_hits_across_borders(last, least):
    rng = random.Random(last)
    import pandas as pd

    for _ in range(60):
        bits = "".join(rng.choice("0001") for _ in range(rng.randint(0, 15)))
        rows = pd.DataFrame({"event_type": ["error" if b == "1" else "view" for b in bits]})
        hit, head, tail = stretches._bits(last, least)(rows)
        assert hit == any(bits[k : k + last].count("1") >= least for k in range(len(bits) - last + 1))
        assert head == bits[: last - 1] and tail == bits[max(len(bits) - last + 1, 0) :]


def test_users_that_fall_silent_and_come_back(spark, tmp_path):
    folder = f"file://{tmp_path}"
    start = 100_000
    events_ = lambda *pairs: [(k, u, "view", 0.0, start + s) for k, (u, s) in enumerate(pairs)]

    def monitor(stream):
        rows = stream.withWatermark("ts", "5 minutes").select("user_id", "ts", F.unix_micros("ts").alias("at"))
        return rows.groupBy("user_id").transformWithStateInPandas(stretches.Heartbeat(600_000), "user_id bigint, seen bigint, stale boolean", "append", "eventTime")

    put(spark, folder, events_((1, 0), (2, 0), (1, 100), (3, 2000)))
    rows = run(spark, folder, monitor)
    assert {(r.user_id, r.seen // 10**6 - start, r.stale) for r in rows.collect()} == {(1, 100, True), (2, 0, True)}
    put(spark, folder, events_((1, 2100), (3, 2050), (2, 50), (4, 5000)))  # user 1 comes back, user 2 too late
    rows = run(spark, folder, monitor)
    assert {(r.user_id, r.seen // 10**6 - start, r.stale) for r in rows.collect()} == {(1, 100, True), (2, 0, True), (1, 2100, False), (1, 2100, True), (3, 2050, True)}
