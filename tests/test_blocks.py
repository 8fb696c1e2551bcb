"""Percentiles, prefixes, batches and runs that work in blocks, against plain versions."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from docspark.operators import aggregates, extras, joins, windows
from docspark.plans import inspect
from docspark.sources.tables import Tables


@pytest.mark.parametrize("accuracy", [5, 10_000])
def test_percentiles_are_elements(spark, accuracy):
    rng = random.Random(accuracy)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, 0.0, rng.random(), -rng.random() * 1e6, float(rng.randrange(4))])) for _ in range(2000)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    for share in (0.0, 0.25, 0.5, 0.95, 0.999):
        want = {}
        for k in {k for k, x in rows if x is not None}:
            own = sorted(x for kk, x in rows if kk == k and x is not None)
            want[k] = own[int(len(own) * share)]
        assert {r.k: r.p for r in aggregates.index_percentile(df, "k", "x", share, "p", accuracy).collect()} == want, share


def test_longest_prefix_by_equality(spark):
    rng = random.Random(1)
    name = lambda: "".join(rng.choice("ab/") for _ in range(rng.randint(0, 8)))
    paths, known = [(name(),) for _ in range(300)] + [(None,), ("é/b",)], [(name(),) for _ in range(40)] + [(None,), ("é",)]
    for prefixes in (known, [(p,) for (p,) in known if p], [], [(None,)]):
        got = joins.longest_prefix(spark.createDataFrame(paths, "p string"), "p", spark.createDataFrame(prefixes, "prefix string"))
        want = {p: max((x for (x,) in prefixes if x is not None and p.startswith(x)), key=len, default=None) for (p,) in paths if p is not None}
        assert {r.p: r.prefix for r in got.collect()} == {p: x for p, x in want.items() if x is not None}


def test_many_prefixes_need_no_nested_loop(spark):
    prefixes = spark.range(100_000).select(F.concat(F.lit("/src/"), F.col("id").cast("string"), F.lit("/")).alias("prefix"))
    paths = spark.range(200).select(F.concat(F.lit("/src/"), (F.col("id") * 1000).cast("string"), F.lit("/f")).alias("p"))
    met = joins.longest_prefix(paths, "p", prefixes)
    assert met.count() == 100
    assert "NestedLoop" not in inspect.physical(met) and "Cartesian" not in inspect.physical(met)


@pytest.mark.parametrize("block, most_files", [(4, 4), (5, 3), (64, 4), (7, 1), (3, 9)])
def test_next_fit_equals_the_fold(spark, block, most_files):
    rng = random.Random(block)
    rows = [(rng.choice([1, 2, 3, None]), f"p{i:04}", rng.choice([0, 1, 5, 9, 10, 11, 40, None])) for i in range(230)] + [(9, "only", 99)]
    got = extras.next_fit(spark.createDataFrame(rows, "k long, p string, b long"), "k", "p", "b", 20, most_files, block)
    want = {}
    for k in {r[0] for r in rows}:
        total = n = batches = 0
        for b in (r[2] or 0 for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])):
            if not batches or total + b > 20 or n >= most_files:
                total, n, batches = b, 1, batches + 1
            else:
                total, n = total + b, n + 1
        want[k] = batches
    assert {r.k: r.batches for r in got.collect()} == want


@pytest.mark.parametrize("rows", [3, 10, 20_000])
def test_longest_runs_across_blocks(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(windows, "BLOCK_ROWS", rows)
    rng = random.Random(rows)
    events = [(i, rng.randrange(30), "error" if rng.random() < 0.7 else "view") for i in range(600)]
    df = spark.createDataFrame(events, "event_id long, user_id long, event_type string").selectExpr("event_id", "user_id", "event_type", "1.0D as value", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,event_id div 4) as ts", "'{}' as props")
    df.write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for shard in range(10):
        own = [kind == "error" for i, user, kind in events if user % 10 == shard]
        if any(own):
            want[shard] = max(len(list(run)) for bad, run in groupby(own) if bad)
    assert {r.shard: r.longest for r in windows.consecutive_errors(Tables(spark, str(tmp_path))).collect()} == want


def test_rollups_of_rollups(spark):
    rng = random.Random(4)
    rows = [(60 * i // 7, rng.choice([None, rng.gauss(50, 20), 10.0, 10.0])) for i in range(9000)]
    metrics = spark.createDataFrame([(s, x, s * 3) for s, x in rows], "s long, cpu double, rss_bytes long").withColumn("timestamp", F.timestamp_seconds("s").cast("timestamp_ntz"))
    fine = aggregates.rolled_up(metrics, 60)
    far = aggregates.coarser(aggregates.coarser(fine, 3600), 21600)
    whole = {r.bucket: r for r in aggregates.downsample(metrics, 21600).collect()}
    shares = [0.05, 0.5, 0.95]
    for r in far.withColumn("q", F.array(*(F.kll_sketch_get_quantile_double("cpu_sketch", F.lit(x)) for x in shares))).collect():
        w = whole[r.bucket]
        assert (round(r.cpu_sum / r.cpu_n, 6), r.cpu_max, r.rss_max, r.samples) == (w.cpu_avg, w.cpu_max, w.rss_max, w.samples)
        own = sorted(x for s, x in rows if x is not None and s // 21600 * 21600 == int((r.bucket - __import__("datetime").datetime(1970, 1, 1)).total_seconds()))
        for share, q in zip(shares, r.q):  # the element's ranks reach into the error bound
            lo, hi = sum(x < q for x in own) / len(own), sum(x <= q for x in own) / len(own)
            assert lo - 0.02 <= share <= hi + 0.02
    assert len(whole) > 3
