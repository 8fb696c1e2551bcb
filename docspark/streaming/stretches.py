"""Streams whose order matters, in stretches of event time: an average, a latch, a rate, silent users.

Events come late, twice and in any order, and a frequent kind may be a third of all. So
state is kept by (key, stretch of time): the events of a stretch wait in a list until an
event-time timer says that the watermark has passed its end, then they are put in
order, each once, and become one small summary, and the state goes. Summaries are
associative: a batch query puts the stretches of a key together in their order, so no
key's events ever meet in one task. Events older than the watermark are dropped, as in
any window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from ..operators.windows import folded
from ..registry import query
from ..sources.tables import Tables
from .monitors import replayed

DAY = 86_400
LATENESS = "5 minutes"
_EVENT = ["event_id", "at", "event_type", "value"]


class Stretch(StatefulProcessor):
    """Holds the events of a (key, stretch) until its end has passed, then gives their summary."""

    def __init__(self, summary: Callable[[pd.DataFrame], tuple], columns: list[str], seconds: int):
        self.summary, self.columns, self.seconds = summary, columns, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "event_id bigint, at bigint, event_type string, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            self.handle.registerTimer((int(key[1]) + self.seconds) * 1000)
        for pdf in rows:
            self.held.appendList([(int(i), int(at), kind, None if x != x else float(x)) for i, at, kind, x in zip(*(pdf[c] for c in _EVENT))])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pd.DataFrame(list(self.held.get()), columns=_EVENT).drop_duplicates("event_id").sort_values(["at", "event_id"])
        self.held.clear()
        yield pd.DataFrame([(key[0], int(key[1]), len(rows), *self.summary(rows))], columns=self.columns)

    def close(self) -> None:
        pass


def stretches(key: str, kind: str, summary: Callable[[pd.DataFrame], tuple], schema: str, seconds: int):
    """A monitor of (key, block, n, ...) rows, one for each closed stretch; schema names what the summary gives."""
    out = f"{key} {kind}, block bigint, n bigint, {schema}"
    columns = [c.split()[0] for c in out.split(", ")]

    def monitor(stream: DataFrame) -> DataFrame:
        events = stream.withWatermark("ts", LATENESS).select(F.col(key), (F.floor(F.unix_seconds("ts") / seconds) * seconds).cast("long").alias("block"), "ts", "event_id", F.unix_micros("ts").alias("at"), F.col("event_type").alias("event_type_") if key == "event_type" else F.col("event_type"), F.col("value").cast("double").alias("value"))
        if key == "event_type":
            events = events.withColumnsRenamed({"event_type": "kind", "event_type_": "event_type"})
        group = "kind" if key == "event_type" else key
        return events.groupBy(group, "block").transformWithStateInPandas(Stretch(summary, columns, seconds), out, "append", "eventTime")

    return monitor


_CLOSED = f"(FLOOR(EPOCH_US(ts)/1000000/{DAY})+1)*{DAY} <= (SELECT EPOCH_US(MAX(ts))/1000000 - 300 FROM events)"


def _first_and_sum(alpha: float):
    def summary(rows: pd.DataFrame) -> tuple:
        total = 0.0
        for x in rows["value"]:
            total = total * (1 - alpha) + alpha * x
        return total, float(rows["value"].iloc[0])

    return summary


@query("T04_ewma_stream", f"""WITH s AS (SELECT event_type, value AS x, ROW_NUMBER() OVER w AS rn, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events WHERE {_CLOSED} WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_type, ANY_VALUE(n) AS n, ROUND(SUM(CASE WHEN rn = 1 THEN POW(0.7,n-1)*x ELSE 0.3*POW(0.7,n-rn)*x END),6) AS ewma FROM s GROUP BY 1""")
def ewma_stream(t: Tables, alpha: float = 0.3, seconds: int = DAY) -> DataFrame:
    """Exponential moving average of each operation over all closed stretches, seeded with the first observation."""
    sums = replayed(t, stretches("event_type", "string", _first_and_sum(alpha), "s double, first double", seconds), stored=True)
    counts = sums.groupBy("event_type").agg(F.sum("n").alias("n"))
    return folded(sums, "event_type", alpha).join(counts, "event_type").select("event_type", "n", F.round("ewma", 6).alias("ewma"))


def _bits(last: int, least: float):
    def summary(rows: pd.DataFrame) -> tuple:
        bits = "".join("1" if k == "error" else "0" for k in rows["event_type"])
        bad, hit = bits[:last].count("1"), False
        for k in range(last, len(bits) + 1):
            hit = hit or bad >= least
            if k < len(bits):
                bad += (bits[k] == "1") - (bits[k - last] == "1")
        return bool(hit), bits[: last - 1], bits[-(last - 1) :]

    return summary


@query("T05_error_latch_stream", f"""WITH s AS (SELECT (user_id%10)::BIGINT AS shard, event_type = 'error' AS bad, ts, event_id FROM events WHERE {_CLOSED}),
r AS (SELECT shard, COUNT(*) OVER w AS n, COUNT_IF(bad) OVER w AS errors FROM s WINDOW w AS (PARTITION BY shard ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT shard, COUNT(*) AS n, BOOL_OR(n = 20 AND errors >= 6)::INT AS latched FROM r GROUP BY 1""")
def error_latch_stream(t: Tables, last: int = 20, least: int = 6, seconds: int = DAY) -> DataFrame:
    """Per shard of users: whether the last events ever held so many errors. A stretch knows its own hits and its ends; hits across a border are found from the ends."""
    monitor = stretches("shard", "bigint", _bits(last, least), "hit boolean, head string, tail string", seconds)
    rows = replayed(t, lambda s: monitor(s.withColumn("shard", (F.col("user_id") % 10).cast("long"))), stored=True)
    # each stretch holds an event at least, so that many of them hold all that a border can see
    before = F.array_join(F.collect_list("tail").over(Window.partitionBy("shard").orderBy("block").rowsBetween(1 - last, -1)), "")
    border = F.concat(F.right(before, F.lit(last - 1)), F.col("head"))
    some = F.exists(F.sequence(F.lit(1), F.greatest(F.length("border") - (last - 1), F.lit(1))), lambda i: F.length(F.replace(F.col("border").substr(i, F.lit(last)), F.lit("0"))) >= least)
    across = (F.length("border") >= last) & some
    return rows.withColumn("border", border).groupBy("shard").agg(F.sum("n").alias("n"), F.bool_or(F.col("hit") | across).cast("int").alias("latched"))


def _latest(last: int):
    return lambda rows: ([int(x) for x in rows["at"].iloc[-last:]],)


@query("T03_rolling_eta_stream", f"""WITH s AS (SELECT event_type, EPOCH_US(ts) AS us, COUNT(*) OVER (PARTITION BY event_type) AS n, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE {_CLOSED})
SELECT event_type, ANY_VALUE(n) AS n, CASE WHEN COUNT(*) >= 3 AND MAX(us) > MIN(us) THEN ROUND(1000/((COUNT(*)-1)/((MAX(us)-MIN(us))/1000000::DOUBLE)),3) ELSE -1 END AS eta FROM s WHERE rn <= 100 GROUP BY 1""")
def rolling_eta_stream(t: Tables, last: int = 100, left: int = 1000, seconds: int = DAY) -> DataFrame:
    """Seconds to go for ``left`` more events at the rate of the last ones, by kind; -1 where there is no rate."""
    rows = replayed(t, stretches("event_type", "string", _latest(last), "times array<bigint>", seconds), stored=True)
    counts = rows.groupBy("event_type").agg(F.sum("n").alias("n"))
    newest = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("at")))
    held = rows.select("event_type", F.explode("times").alias("at")).withColumn("k", newest).filter(F.col("k") <= last)
    span = held.groupBy("event_type").agg(F.count("*").alias("c"), ((F.max("at") - F.min("at")) / 1e6).alias("s"))
    eta = F.when((F.col("c") >= 3) & (F.col("s") > 0), F.round(left / ((F.col("c") - 1) / F.col("s")), 3)).otherwise(-1.0)
    return counts.join(span, "event_type").select("event_type", "n", eta.alias("eta"))


class Heartbeat(StatefulProcessor):
    """The last sign of a key, with a timer for its silence."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, stale boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(pdf["at"].max()) for pdf in rows)
        held, stale = self.last.get() if self.last.exists() else (-1, False)
        if newest <= held:
            return
        if held >= 0 and not stale:
            self.handle.deleteTimer(held // 1000 + self.patience)
        self.last.update((newest, False))
        self.handle.registerTimer(newest // 1000 + self.patience)
        if stale:
            yield pd.DataFrame([(key[0], newest, False)], columns=["user_id", "seen", "stale"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self.last.get()
        self.last.update((held, True))
        yield pd.DataFrame([(key[0], held, True)], columns=["user_id", "seen", "stale"])

    def close(self) -> None:
        pass


@query("T12b_stale_heartbeats_stream", "SELECT user_id, MAX(ts) AS seen FROM events GROUP BY 1 HAVING MAX(ts) + INTERVAL 30 MINUTES <= (SELECT MAX(ts) FROM events) - INTERVAL 5 MINUTES")
def stale_heartbeats_stream(t: Tables, minutes: int = 30) -> DataFrame:
    """Users whose silence outlasted its timer and who weren't seen since."""

    def monitor(stream: DataFrame) -> DataFrame:
        events = stream.withWatermark("ts", LATENESS).select("user_id", "ts", F.unix_micros("ts").alias("at"))
        return events.groupBy("user_id").transformWithStateInPandas(Heartbeat(minutes * 60_000), "user_id bigint, seen bigint, stale boolean", "append", "eventTime")

    rows = replayed(t, monitor, stored=True)
    # a user who was seen again has a later row
    last = rows.groupBy("user_id").agg(F.max(F.struct("seen", "stale")).alias("l")).filter("l.stale")
    return last.select("user_id", F.timestamp_micros("l.seen").cast("timestamp_ntz").alias("seen"))


@query("T08_active_users_stream", """SELECT w AS start, COUNT(DISTINCT user_id) AS users FROM (SELECT user_id, UNNEST([TIME_BUCKET(INTERVAL 30 MINUTES, ts, TIMESTAMP '1970-01-01'), TIME_BUCKET(INTERVAL 30 MINUTES, ts, TIMESTAMP '1970-01-01') - INTERVAL 30 MINUTES]) AS w FROM events)
WHERE w + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 5 MINUTES GROUP BY 1""")
def active_users_stream(t: Tables) -> DataFrame:
    """Users seen in sliding windows of an hour, counted exactly: state has a row for each user of an open window, spread by both."""

    def monitor(s: DataFrame) -> DataFrame:
        seen = s.withWatermark("ts", LATENESS).groupBy(F.window("ts", "1 hour", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
        rows = seen.groupBy("window").agg(F.count("*").alias("users"))
        return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "users")

    return replayed(t, monitor)
