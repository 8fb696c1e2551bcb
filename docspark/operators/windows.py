"""Window functions: ranks, latest rows, rolling rates, latches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.tables import Tables
from ..streaming.monitors import cut


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with its rows' numbers from 0 on in this order as ``place``: sorted once in ranges and cut there, then counted by range."""
    # the cut holds the ranges, whose bounds are sampled, and the order of the rows in them
    rows = cut(df.sort(*order)).withColumn("at", F.monotonically_increasing_id())
    within, part = F.col("at").bitwiseAND((1 << 33) - 1), F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    starts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", F.col("start") + within).drop("part", "at", "start")


def numbered_within(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df with its rows' numbers from 0 on within each key as ``place``; no key is sorted in one task."""
    placed = numbered(df, key, *order)
    starts = placed.groupBy(F.col(key).alias("key_")).agg(F.min("place").alias("first"))
    return placed.join(starts, F.col(key).eqNullSafe(F.col("key_"))).withColumn("place", F.col("place") - F.col("first")).drop("key_", "first")


#: Rows that a rolling window is worked off in.
BLOCK_ROWS = 20_000


def in_blocks(placed: DataFrame, last: int) -> DataFrame:
    """Numbered rows dealt to blocks (``block``); the last rows of a block come again at the head of the next, marked not ``own``."""
    block = F.floor(F.col("place") / BLOCK_ROWS)
    ahead = F.floor((F.col("place") + last - 1) / BLOCK_ROWS)
    return placed.withColumn("block", F.explode(F.sequence(block, ahead))).withColumn("own", F.col("block") == block)


@query("W01_rank_in_list", "SELECT id, ROW_NUMBER() OVER (PARTITION BY source_format ORDER BY file_size_bytes DESC, id)-1 AS rank FROM v_corpus")
def rank_in_list(t: Tables) -> DataFrame:
    rows = t.corpus.select("id", "source_format", (-F.col("file_size_bytes")).alias("smaller"))
    return numbered_within(rows, "source_format", "smaller", "id").select("id", F.col("place").cast("long").alias("rank"))


@query("W02_best_chunk_per_doc", "WITH s AS (SELECT doc_id, vec_id, ROUND(embedding[1],6) AS score FROM v_vectors) SELECT doc_id, ARG_MAX(vec_id,(score,-vec_id)) AS vec_id, MAX(score) AS score, MIN(vec_id) AS first_seen FROM s GROUP BY 1")
def best_chunk(t: Tables) -> DataFrame:
    s = t.vectors.select("doc_id", "vec_id", F.round(F.col("embedding")[0], 6).alias("score"))
    return s.groupBy("doc_id").agg(F.max_by("vec_id", F.struct("score", -F.col("vec_id"))).alias("vec_id"), F.max("score").alias("score"), F.min("vec_id").alias("first_seen"))


@query("W03_latest_per_key", "SELECT user_id, id FROM v_analysis_queue QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY enqueued_at DESC, id DESC) = 1")
def latest_per_key(t: Tables) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.desc("enqueued_at"), F.desc("id"))
    return t.analysis_queue.withColumn("rn", F.row_number().over(newest)).filter("rn = 1").select("user_id", "id")


@query("W04_occurrence_number", "SELECT id, ROW_NUMBER() OVER (PARTITION BY content_hash ORDER BY source_path)-1 AS n FROM v_source_files")
def occurrence_number(t: Tables) -> DataFrame:
    return numbered_within(t.source_files.select("id", "content_hash", "source_path"), "content_hash", "source_path").select("id", F.col("place").cast("long").alias("n"))


@query("W05_chunk_index", "SELECT id, CAST(UNNEST(RANGE(LEN(STRING_SPLIT(content,CHR(10))))) AS INT) AS chunk_index, UNNEST(STRING_SPLIT(content,CHR(10))) AS chunk FROM v_corpus")
def chunk_index(t: Tables) -> DataFrame:
    return t.corpus.select("id", F.posexplode(F.split("content", "\n")).alias("chunk_index", "chunk"))


@query("W06_heading_path", """WITH s AS (SELECT history_id, segment_index, MOD(segment_index,3)+1 AS level, 'H'||segment_index AS title FROM v_transcript_segments)
SELECT history_id, segment_index, CASE level WHEN 1 THEN title WHEN 2 THEN COALESCE(LAST_VALUE(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w||' > ','')||title
ELSE COALESCE(LAST_VALUE(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w||' > ','')||COALESCE(LAST_VALUE(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w||' > ','')||title END AS path
FROM s WINDOW w AS (PARTITION BY history_id ORDER BY segment_index ROWS UNBOUNDED PRECEDING)""")
def heading_path(t: Tables) -> DataFrame:
    """The last title of each lower level, joined; levels follow each other from 1 to 3."""
    s = t.transcript_segments.select("history_id", "segment_index", (F.col("segment_index") % 3 + 1).alias("level"), F.concat(F.lit("H"), F.col("segment_index").cast("string")).alias("title"))
    before = Window.partitionBy("history_id").orderBy("segment_index").rowsBetween(Window.unboundedPreceding, 0)
    above = lambda n: F.when(F.col("level") > n, F.last(F.when(F.col("level") == n, F.col("title")), ignorenulls=True).over(before))
    return s.select("history_id", "segment_index", F.concat_ws(" > ", above(1), above(2), "title").alias("path"))


@query("W07_rolling_rate", """SELECT id, CASE WHEN COUNT(*) OVER w >= 3 AND MAX(timestamp) OVER w > MIN(timestamp) OVER w THEN ROUND((COUNT(*) OVER w-1)/(EPOCH_US(MAX(timestamp) OVER w)-EPOCH_US(MIN(timestamp) OVER w))*1e6,9) END AS per_second FROM v_activity_events
WINDOW w AS (PARTITION BY event_type ORDER BY timestamp, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def rolling_rate(t: Tables, last: int = 100, least: int = 3) -> DataFrame:
    rows = in_blocks(numbered_within(t.activity_events.select("id", "event_type", "timestamp"), "event_type", "timestamp", "id"), last)
    w = Window.partitionBy("event_type", "block").orderBy("place").rowsBetween(1 - last, 0)
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = rows.withColumn("span", F.max(at).over(w) - F.min(at).over(w)).withColumn("n", F.count("*").over(w)).filter("own")
    return rows.select("id", F.when((F.col("n") >= least) & (F.col("span") > 0), F.round((F.col("n") - 1) / F.col("span") * 1e6, 9)).alias("per_second"))


@query("W08_ewma", """WITH s AS (SELECT event_type, duration_seconds AS x, ROW_NUMBER() OVER w AS rn, COUNT(*) OVER (PARTITION BY event_type) AS n FROM v_activity_events WINDOW w AS (PARTITION BY event_type ORDER BY timestamp, id))
SELECT event_type, ROUND(SUM(CASE WHEN rn = 1 THEN POW(0.7,n-1)*x ELSE 0.3*POW(0.7,n-rn)*x END),6) AS ewma FROM s GROUP BY 1""")
def ewma(t: Tables, alpha: float = 0.3) -> DataFrame:
    """Exponential moving average over all observations of each operation, seeded with the first.

    A stretch of rows acts on the average as one decay and one weighted sum, so
    blocks of rows are summed by themselves and then folded in their order.
    """
    rows = numbered_within(t.activity_events.select("event_type", "timestamp", "id", F.col("duration_seconds").alias("x")), "event_type", "timestamp", "id")
    counts = rows.groupBy("event_type").agg(F.count("*").alias("all"))
    rows = rows.join(counts, "event_type").withColumn("block", F.floor(F.col("place") / BLOCK_ROWS))
    after = F.least((F.col("block") + 1) * BLOCK_ROWS, F.col("all")) - 1 - F.col("place")  # rows of the block that follow
    decay = F.pow(F.lit(1 - alpha), after)
    sums = rows.groupBy("event_type", "block").agg(F.sum(alpha * decay * F.col("x")).alias("s"), F.count("*").alias("n"), F.min_by("x", "place").alias("first"))
    return folded(sums, "event_type", alpha).select("event_type", F.round("ewma", 6).alias("ewma"))


#: Summaries that are folded as one list.
FOLD = 1000


def folded(sums: DataFrame, key: str, alpha: float, fold: int | None = None) -> DataFrame:
    """(key, ewma) of (key, block, n, s, first): averages of blocks in their order. Two blocks act as one with their rows together, so lists of FOLD blocks are folded first, and then the lists."""
    fold = fold or FOLD
    kept = lambda n: F.pow(F.lit(1 - alpha), n)
    rows = lambda: F.array_sort(F.collect_list(F.struct("block", "n", "s", "first")))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"))
    joined = F.aggregate("rows", none, lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["s"] * kept(b["n"]) + b["s"]).alias("s")))
    lists = sums.groupBy(key, F.floor(F.col("block") / fold).alias("list")).agg(rows().alias("rows"))
    lists = lists.select(key, F.col("list").alias("block"), joined.alias("j"), F.col("rows")[0]["first"].alias("first")).select(key, "block", "j.n", "j.s", "first")
    whole = lists.groupBy(key).agg(rows().alias("rows"))
    return whole.select(key, F.aggregate("rows", F.col("rows")[0]["first"], lambda e, b: e * kept(b["n"]) + b["s"]).alias("ewma"))


@query("W09_error_latch", """WITH s AS (SELECT id, user_id, timestamp, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad FROM v_activity_events), r AS (SELECT *, COUNT(*) OVER w AS n, AVG(bad) OVER w AS rate FROM s WINDOW w AS (PARTITION BY user_id%10 ORDER BY timestamp,id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT id, MAX(CASE WHEN n >= 20 AND rate >= 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id%10 ORDER BY timestamp,id ROWS UNBOUNDED PRECEDING) AS latched FROM r""")
def error_latch(t: Tables, last: int = 100, least: int = 20, rate: float = 0.25) -> DataFrame:
    """1 from the first row on at which the rolling error rate reached its limit."""
    s = t.activity_events.select("id", (F.col("user_id") % 10).alias("shard"), "timestamp", (F.col("event_type") == "error").cast("int").alias("bad"))
    placed = numbered_within(s, "shard", "timestamp", "id")
    rolling = Window.partitionBy("shard", "block").orderBy("place").rowsBetween(1 - last, 0)
    hit = (F.count("*").over(rolling) >= least) & (F.avg("bad").over(rolling) >= rate)
    first = in_blocks(placed, last).withColumn("hit", hit).filter("own and hit").groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(first, "shard", "left").select("id", F.coalesce((F.col("place") >= F.col("first")).cast("int"), F.lit(0)).alias("latched"))


@query("W09b_consecutive_errors", """WITH s AS (SELECT id, user_id%10 AS shard, timestamp, event_type = 'error' AS bad FROM v_activity_events), i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY shard ORDER BY timestamp,id)-ROW_NUMBER() OVER (PARTITION BY shard,bad ORDER BY timestamp,id) AS island FROM s)
SELECT shard, MAX(n) AS longest FROM (SELECT shard, island, COUNT(*) AS n FROM i WHERE bad GROUP BY 1,2) GROUP BY 1""")
def consecutive_errors(t: Tables) -> DataFrame:
    """Longest run of errors. Runs are found in blocks of rows; those that touch a block's edge are joined up, a few for each block."""
    s = t.activity_events.select("id", (F.col("user_id") % 10).alias("shard"), "timestamp", (F.col("event_type") == "error").alias("bad"))
    placed = numbered_within(s, "shard", "timestamp", "id").select("shard", "place", "bad").withColumn("block", F.floor(F.col("place") / BLOCK_ROWS))
    nth = F.row_number().over(Window.partitionBy("shard", "block").orderBy("place"))
    runs = placed.filter("bad").withColumn("island", F.col("place") - nth).groupBy("shard", "block", "island").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    edge = (F.col("first") % BLOCK_ROWS == 0) | (F.col("last") % BLOCK_ROWS == BLOCK_ROWS - 1)
    runs = runs.select("shard", "first", "last", edge.alias("edge"))
    own = Window.partitionBy("shard").orderBy("first")
    opens = F.coalesce(F.lag("last").over(own) != F.col("first") - 1, F.lit(True))
    joined = runs.filter("edge").withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("shard", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return joined.select("shard", "first", "last").union(runs.filter("not edge").select("shard", "first", "last")).groupBy("shard").agg(F.max(F.col("last") - F.col("first") + 1).alias("longest"))


@query("W10_rolling_median", """SELECT id, ROUND(MEDIAN(duration_seconds) OVER (PARTITION BY user_id ORDER BY timestamp,id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW),6) AS med FROM v_activity_events""")
def rolling_median(t: Tables, last: int = 100) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("timestamp", "id").rowsBetween(1 - last, 0)
    return t.activity_events.select("id", F.round(F.percentile("duration_seconds", F.lit(0.5)).over(w), 6).alias("med"))


@query("W12_changes_only", "SELECT id, event_type FROM v_activity_events QUALIFY LAG(event_type) OVER (PARTITION BY user_id ORDER BY timestamp,id) IS DISTINCT FROM event_type")
def changes_only(t: Tables) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("timestamp", "id"))
    return t.activity_events.withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col("event_type"))).select("id", "event_type")


@query("W13_version_history", "SELECT id, source_file_id, ROW_NUMBER() OVER w AS version, file_size_bytes-LAG(file_size_bytes) OVER w AS grown FROM v_bulk_files WHERE status = 'converted' WINDOW w AS (PARTITION BY source_file_id ORDER BY converted_at, id)")
def version_history(t: Tables) -> DataFrame:
    w = Window.partitionBy("source_file_id").orderBy("converted_at", "id")
    return t.bulk_files.filter("status = 'converted'").select("id", "source_file_id", F.row_number().over(w).cast("long").alias("version"), (F.col("file_size_bytes") - F.lag("file_size_bytes").over(w)).alias("grown"))
