"""Stateful monitors over the event stream, and the batch queries that they agree with.

Each monitor is a function of a streaming DataFrame with (event_id, ts, user_id,
event_type, value); ``replayed`` runs it over a table as an available-now stream,
writes to the shared folder and gives the rows back.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..registry import query
from ..sources.tables import Tables


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (path or "file://" + os.path.join(tempfile.gettempdir(), "docspark-streams")).rstrip("/")


def own_folder(spark: SparkSession, stem: str) -> str:
    """A new folder in the shared one; it goes when the driver's JVM ends."""
    uri = f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return uri


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: ends the lineage, survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


#: The state store that timers and lists need.
STATE_STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_once(stream: DataFrame, folder: str, mode: str = "append", stored: bool = False) -> None:
    """Work off what is there, from where the folder's checkpoint stands, and write each batch's rows. stored: with the state store for lists and timers."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")  # a batch that runs again overwrites itself

    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    if stored:
        conf.set(STATE_STORE, ROCKS)
    try:
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        if stored:
            conf.unset(STATE_STORE) if before is None else conf.set(STATE_STORE, before)


def replayed(t: Tables, monitor: Callable[[DataFrame], DataFrame], mode: str = "append", stored: bool = False) -> DataFrame:
    """The monitor's output over all events, as a table."""
    out = own_folder(t.spark, "stream")
    t.raw("events").write.parquet(f"{out}/in")
    stream = monitor(events_stream(t.spark, f"{out}/in"))
    run_once(stream, out, mode, stored)
    return t.spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{out}/rows")


def hourly(stream: DataFrame) -> DataFrame:
    """Tumbling hours with five minutes of lateness."""
    rows = stream.withWatermark("ts", "5 minutes").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("cpu_avg"), F.max("value").alias("cpu_max"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("hour_bucket"), "n", "cpu_avg", "cpu_max")


_HOURLY = "SELECT DATE_TRUNC('hour',ts) AS hour_bucket, COUNT(*) AS n, ROUND(AVG(value),6) AS cpu_avg, MAX(value) AS cpu_max FROM events GROUP BY 1"


@query("T01_hourly_rollup", f"SELECT * FROM ({_HOURLY}) WHERE hour_bucket + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 5 MINUTES")
def hourly_stream(t: Tables) -> DataFrame:
    """Closed hours only: the last ones wait for the watermark."""
    return replayed(t, hourly)


@query("T02_downsample_stream", "SELECT TIME_BUCKET(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS bucket, COUNT(*) AS n, MAX(value) AS peak FROM events GROUP BY 1 HAVING TIME_BUCKET(INTERVAL 6 HOURS, MAX(ts), TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS <= (SELECT MAX(ts) FROM events) - INTERVAL 5 MINUTES")
def downsampled_stream(t: Tables) -> DataFrame:
    def monitor(s: DataFrame) -> DataFrame:
        rows = s.withWatermark("ts", "5 minutes").groupBy(F.window("ts", "6 hours")).agg(F.count("*").alias("n"), F.max("value").alias("peak"))
        return rows.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "n", "peak")

    return replayed(t, monitor)


def stateful(step: Callable[[tuple, pd.DataFrame], tuple], start: tuple, state: str, key: str, columns: list[str]):
    """A monitor that folds each key's events, in order of time, into a small state and gives the state after each batch."""

    def monitor(stream: DataFrame) -> DataFrame:
        def update(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
            now = held.get if held.exists else start
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            now = step(now, rows)
            held.update(now)
            yield pd.DataFrame([(*k, *now)], columns=columns)

        out = ", ".join([f"{columns[0]} string", state])
        keyed = stream.withColumn("key_", F.col(key).cast("string"))
        return keyed.groupBy("key_").applyInPandasWithState(update, out, state, "update", GroupStateTimeout.NoTimeout)

    return monitor


def _latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    return rows.groupBy(key).agg(*(F.max_by(c, by).alias(c) for c in rows.columns if c != key))


# Failures that open the breaker, and how long it stays open, in seconds.
OPEN_AFTER, FIRST_WAIT, LONGEST_WAIT = 5, 60.0, 900.0


@query("T07_circuit_breaker_stream")
def circuit_breaker_stream(t: Tables) -> DataFrame:
    """Closed, open and half-open by event time; each failed trial doubles the wait."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple:
        n, status, failures, wait, until = state
        for at, kind in zip(rows["ts"].astype("int64") / 1e9, rows["event_type"]):
            n += 1
            if status == "open" and at >= until:
                status = "half_open"
            if status == "open":
                continue
            if kind != "error":
                status, failures, wait = "closed", 0, FIRST_WAIT
            elif status == "half_open":
                wait = min(wait * 2, LONGEST_WAIT)
                status, until = "open", at + wait
            else:
                failures += 1
                if failures >= OPEN_AFTER:
                    status, until = "open", at + wait
        return n, status, failures, wait, until

    monitor = stateful(step, (0, "closed", 0, FIRST_WAIT, 0.0), "n bigint, status string, failures int, wait double, until double", "shard", ["shard", "n", "status", "failures", "wait", "until"])
    return _latest(replayed(t, lambda s: monitor(s.withColumn("shard", F.col("user_id") % 10)), "update"), "shard", "n").drop("until")


@query("T08b_active_users", "SELECT DATE_TRUNC('hour',ts) AS start, COUNT(DISTINCT user_id) AS users FROM events GROUP BY 1")
def active_users(t: Tables) -> DataFrame:
    return t.raw("events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.countDistinct("user_id").alias("users"))


@query("T09_operation_registry", "SELECT user_id, ARG_MAX(event_type,(ts,event_id)) AS last_op, MAX(ts) AS seen FROM events GROUP BY 1 HAVING MAX(ts) >= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY")
def operation_registry(t: Tables) -> DataFrame:
    """The latest operation of each user, purged after a day of silence."""
    now = t.raw("events").agg(F.max("ts").alias("now"))
    last = t.raw("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_op"), F.max("ts").alias("seen"))
    return last.join(F.broadcast(now), F.col("seen") >= F.col("now") - F.expr("INTERVAL 1 DAY")).drop("now")


@query("T12_stale_heartbeats", "SELECT user_id FROM events GROUP BY 1 HAVING MAX(ts) < (SELECT MAX(ts) FROM events) - INTERVAL 30 MINUTES")
def stale_heartbeats(t: Tables) -> DataFrame:
    now = t.raw("events").agg(F.max("ts").alias("now"))
    last = t.raw("events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    return last.join(F.broadcast(now), F.col("seen") < F.col("now") - F.expr("INTERVAL 30 MINUTES")).select("user_id")


@query("T15_sessions", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM g GROUP BY user_id, k")
def sessions(t: Tables) -> DataFrame:
    """Session windows, which the corpus engine had none of."""
    rows = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")
