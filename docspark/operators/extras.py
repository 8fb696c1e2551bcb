"""Row-shaped operators of media, OCR and operations, and keyed maintenance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.tables import Tables
from .windows import BLOCK_ROWS, numbered_within


@query("X01_even_sample", """WITH s AS (SELECT history_id, segment_index, ROW_NUMBER() OVER (PARTITION BY history_id ORDER BY segment_index)-1 AS i, COUNT(*) OVER (PARTITION BY history_id) AS n FROM v_transcript_segments)
SELECT history_id, segment_index FROM s WHERE n <= 4 OR i IN (SELECT CAST(FLOOR(k*(n-1)/3.0) AS BIGINT) FROM (VALUES (0),(1),(2),(3)) v(k))""")
def even_sample(t: Tables, k: int = 4) -> DataFrame:
    """k rows of each group, evenly spread, first and last included."""
    s = t.transcript_segments.select("history_id", "segment_index", (F.row_number().over(Window.partitionBy("history_id").orderBy("segment_index")) - 1).alias("i"), F.count("*").over(Window.partitionBy("history_id")).alias("n"))
    wanted = F.array(*(F.floor(F.lit(j) * (F.col("n") - 1) / float(k - 1)) for j in range(k)))
    return s.filter((F.col("n") <= k) | F.array_contains(wanted, F.col("i").cast("long"))).select("history_id", "segment_index")


@query("X02_scene_bounds", "SELECT history_id, segment_index, (start_seconds+end_seconds)/2 AS midpoint, CASE WHEN LEAD(start_seconds) OVER w IS NULL THEN end_seconds+5 ELSE LEAD(start_seconds) OVER w END AS scene_end FROM v_transcript_segments WINDOW w AS (PARTITION BY history_id ORDER BY segment_index)")
def scene_bounds(t: Tables, rest: float = 5) -> DataFrame:
    following = F.lead("start_seconds").over(Window.partitionBy("history_id").orderBy("segment_index"))
    return t.transcript_segments.select("history_id", "segment_index", ((F.col("start_seconds") + F.col("end_seconds")) / 2).alias("midpoint"), F.coalesce(following, F.col("end_seconds") + rest).alias("scene_end"))


@query("X03_greedy_batches", """WITH RECURSIVE o AS (SELECT dir_id, file_size_bytes AS b, ROW_NUMBER() OVER (PARTITION BY dir_id ORDER BY source_path) AS rn FROM v_source_files), g AS (SELECT dir_id, rn, b AS total, 1 AS n, 1 AS batch FROM o WHERE rn = 1
UNION ALL SELECT o.dir_id, o.rn, CASE WHEN g.total+o.b > 300000 OR g.n >= 4 THEN o.b ELSE g.total+o.b END, CASE WHEN g.total+o.b > 300000 OR g.n >= 4 THEN 1 ELSE g.n+1 END, CASE WHEN g.total+o.b > 300000 OR g.n >= 4 THEN g.batch+1 ELSE g.batch END FROM g JOIN o ON o.dir_id = g.dir_id AND o.rn = g.rn+1)
SELECT dir_id, MAX(batch) AS batches FROM g GROUP BY 1""")
def greedy_batches(t: Tables, most_bytes: int = 300_000, most_files: int = 4) -> DataFrame:
    """Next-fit batches of a folder's files in order of path, bounded by bytes and count."""
    return next_fit(t.source_files, "dir_id", "source_path", "file_size_bytes", most_bytes, most_files)


def next_fit(files: DataFrame, key: str, order: str, size: str, most_bytes: int, most_files: int, block: int | None = None) -> DataFrame:
    """(key, batches): a batch takes the files of a key in order as long as their bytes stay within most_bytes and their number within most_files; a larger file is a batch of its own.

    A block of files acts on what comes before it by the place at which a batch starts in it:
    for each of the most_files places it can be, the block knows how many batches start in it
    and where the first one starts after it. A key's blocks are put together from that,
    so no key's files meet in one task.
    """
    block = max(block or BLOCK_ROWS, most_files)
    placed = numbered_within(files.select(key, order, F.col(size).cast("long").alias("bytes")), key, order)
    # a block reads on for the files that its last batch may still take
    last = F.floor(F.col("place") / block)
    dealt = placed.select(key, "place", "bytes", F.explode(F.sequence(F.greatest(F.floor((F.col("place") - most_files) / block), F.lit(0)), last)).alias("block"))

    def steps(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        sizes, at = table.column("bytes").fill_null(0).to_pylist(), table.column("block")[0].as_py()
        n = min(len(sizes), block)
        sums = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=object))])
        following = []
        for i in range(n):  # where the batch that starts at i ends
            j = i + 1
            while j < len(sizes) and j - i < most_files and sums[j + 1] - sums[i] <= most_bytes:
                j += 1
            following.append(j)
        out, starts = [], [0] * (len(sizes) + 1)
        leaves = list(range(len(sizes) + 1))
        for i in reversed(range(n)):
            j = following[i]
            starts[i], leaves[i] = (starts[j] + 1, leaves[j]) if j < n else (1, j)
        for i in range(most_files):
            out.append({"batches": starts[i] if i < n else 0, "next": max(leaves[i] - n, 0) if i < n else i - n})
        return pa.table({key: table.column(key).slice(0, 1), "block": pa.array([at], pa.int64()), "ways": pa.array([out], pa.list_(pa.struct([("batches", pa.int64()), ("next", pa.int64())])))})

    kind = dict(files.dtypes)[key]
    ways = dealt.groupBy(key, "block").applyInArrow(steps, f"`{key}` {kind}, block bigint, ways array<struct<batches: bigint, next: bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("batches"), F.lit(0).cast("long").alias("next"))
    along = lambda a, w: F.struct((a["batches"] + F.get(w["ways"], a["next"].cast("int"))["batches"]).alias("batches"), F.get(w["ways"], a["next"].cast("int"))["next"].alias("next"))
    return ways.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "ways"))).alias("all")).select(key, F.aggregate("all", start, along)["batches"].alias("batches"))


@query("X04_low_confidence_runs", """WITH s AS (SELECT user_id, created_at, id, duration_ms, file_size_bytes, COALESCE(ocr_confidence < 50,FALSE) AS low FROM v_conversion_history), i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at,id,duration_ms,file_size_bytes)-ROW_NUMBER() OVER (PARTITION BY user_id,low ORDER BY created_at,id,duration_ms,file_size_bytes) AS island FROM s)
SELECT user_id, COUNT(*) AS flags, MAX(n) AS longest FROM (SELECT user_id, island, COUNT(*) AS n FROM i WHERE low GROUP BY 1,2 HAVING COUNT(*) >= 2) GROUP BY 1""")
def low_confidence_runs(t: Tables, least: int = 2) -> DataFrame:
    s = t.conversion_history.withColumn("low", F.coalesce(F.col("ocr_confidence") < 50, F.lit(False)))
    nth = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy("created_at", "id", "duration_ms", "file_size_bytes"))
    runs = s.withColumn("island", nth("user_id") - nth("user_id", "low")).filter("low").groupBy("user_id", "island").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return runs.groupBy("user_id").agg(F.count("*").alias("flags"), F.max("n").alias("longest"))


@query("X05_rebuild_text", "SELECT history_id, STRING_AGG(text,' ' ORDER BY segment_index) AS text FROM v_transcript_segments GROUP BY 1")
def rebuild_text(t: Tables) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "text"))), lambda s: s.text)
    return t.transcript_segments.groupBy("history_id").agg(F.array_join(parts, " ").alias("text"))


@query("X06_handwriting", "SELECT source_format, ROUND(AVG(ocr_confidence),3) AS mean_conf, AVG(ocr_confidence) < 40 AND AVG(CASE WHEN ocr_confidence < 50 THEN 1.0::DOUBLE ELSE 0 END) >= 0.6 AS handwritten FROM v_conversion_history WHERE ocr_confidence IS NOT NULL GROUP BY 1")
def handwriting(t: Tables) -> DataFrame:
    c = F.col("ocr_confidence")
    low = F.avg(F.when(c < 50, 1.0).otherwise(0.0))
    return t.conversion_history.filter(c.isNotNull()).groupBy("source_format").agg(F.round(F.avg(c), 3).alias("mean_conf"), ((F.avg(c) < 40) & (low >= 0.6)).alias("handwritten"))


@query("X08_directory_listing", "SELECT dir_id, COUNT(*) AS files, SUM(file_size_bytes) AS bytes, COUNT(DISTINCT file_ext) AS kinds FROM v_source_files GROUP BY 1")
def directory_listing(t: Tables) -> DataFrame:
    return t.source_files.groupBy("dir_id").agg(F.count("*").alias("files"), F.sum("file_size_bytes").alias("bytes"), F.countDistinct("file_ext").alias("kinds"))


@query("X09_log_inventory", "SELECT event_type AS stream, CASE WHEN timestamp < (SELECT MAX(timestamp) FROM v_activity_events)-INTERVAL 7 DAYS THEN 'archive' ELSE 'live' END AS state, COUNT(*) AS n, SUM(LENGTH(metadata)) AS bytes FROM v_activity_events GROUP BY 1,2")
def log_inventory(t: Tables) -> DataFrame:
    now = t.activity_events.agg(F.max("timestamp").alias("now"))
    state = F.when(F.col("timestamp") < F.col("now") - F.expr("INTERVAL 7 DAYS"), "archive").otherwise("live")
    return t.activity_events.join(F.broadcast(now)).groupBy(F.col("event_type").alias("stream"), state.alias("state")).agg(F.count("*").alias("n"), F.sum(F.length("metadata")).alias("bytes"))


@query("X10_health_summary", "SELECT 'source_files' AS name, COUNT(*) AS n FROM v_source_files UNION ALL SELECT 'bulk_files', COUNT(*) FROM v_bulk_files UNION ALL SELECT 'analysis_queue', COUNT(*) FROM v_analysis_queue UNION ALL SELECT 'file_flags', COUNT(*) FROM v_file_flags")
def health_summary(t: Tables) -> DataFrame:
    out = None
    for name in ("source_files", "bulk_files", "analysis_queue", "file_flags"):
        one = getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("X11_prefetch_candidates", "SELECT id FROM v_conversion_history WHERE duration_ms > 4000 AND file_size_bytes < 20000")
def prefetch_candidates(t: Tables) -> DataFrame:
    return t.conversion_history.filter("duration_ms > 4000 and file_size_bytes < 20000").select("id")


@query("X12_folder_tree", "WITH RECURSIVE p AS (SELECT r_regionkey AS id, CAST(NULL AS INT) AS parent, r_name AS name FROM region UNION ALL SELECT 100+n_nationkey, n_regionkey, n_name FROM nation), tree AS (SELECT id, name AS path, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.id, tree.path||'/'||p.name, tree.depth+1 FROM p JOIN tree ON p.parent = tree.id) SELECT id, path, depth FROM tree")
def folder_tree(t: Tables) -> DataFrame:
    """Paths of all folders from parent pointers, by a recursive query."""
    t.raw("region").createOrReplaceTempView("tree_region")
    t.raw("nation").createOrReplaceTempView("tree_nation")
    return t.spark.sql("""WITH RECURSIVE p AS (SELECT r_regionkey AS id, CAST(NULL AS INT) AS parent, r_name AS name FROM tree_region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM tree_nation),
        tree(id, path, depth) AS (SELECT id, name, 0 FROM p WHERE parent IS NULL UNION ALL SELECT p.id, tree.path || '/' || p.name, tree.depth + 1 FROM p JOIN tree ON p.parent = tree.id) SELECT id, path, depth FROM tree""")


@query("C01_job_counters", "SELECT j.id, j.status, COUNT(b.id) AS total, COUNT(b.id) FILTER (b.status = 'converted') AS done FROM v_bulk_jobs j LEFT JOIN v_bulk_files b ON b.job_id = j.id GROUP BY 1,2")
def job_counters(t: Tables) -> DataFrame:
    n = t.bulk_files.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "converted").alias("done"))
    return t.bulk_jobs.select("id", "status").join(n, "id", "left").fillna(0, ["total", "done"])


@query("C03_cascading_delete", "SELECT (SELECT COUNT(*) FROM v_bulk_files WHERE job_id NOT IN (SELECT id FROM v_bulk_jobs WHERE status = 'failed')) AS files_left, (SELECT COUNT(*) FROM v_bulk_jobs WHERE status <> 'failed') AS jobs_left")
def cascading_delete(t: Tables) -> DataFrame:
    keys = t.bulk_jobs.filter("status = 'failed'").select(F.col("id").alias("job_id"))
    files = t.bulk_files.join(keys, "job_id", "left_anti").agg(F.count("*").alias("files_left"))
    return files.crossJoin(t.bulk_jobs.filter("status <> 'failed'").agg(F.count("*").alias("jobs_left")))


@query("C05_single_active", "SELECT provider_id, model, provider_id||model = 'p0m1' AS is_active FROM v_rates")
def single_active(t: Tables) -> DataFrame:
    return t.rates.select("provider_id", "model", (F.concat("provider_id", "model") == "p0m1").alias("is_active"))


@query("C14_latest_scan_per_status", "SELECT status, ARG_MAX(id,(started_at,id)) AS latest FROM v_bulk_jobs GROUP BY 1")
def latest_scan(t: Tables) -> DataFrame:
    return t.bulk_jobs.groupBy("status").agg(F.max_by("id", F.struct("started_at", "id")).alias("latest"))


@query("C18_my_flags", "SELECT f.id FROM v_file_flags f WHERE f.status = 'active' AND f.reason = 'pii' ORDER BY f.id LIMIT 50")
def my_flags(t: Tables) -> DataFrame:
    return t.file_flags.filter("status = 'active' and reason = 'pii'").orderBy("id").limit(50).select("id")


@query("C23_foreign_keys", "SELECT 'bulk_files.job_id' AS fk, COUNT(*) AS broken FROM v_bulk_files WHERE job_id NOT IN (SELECT id FROM v_bulk_jobs) UNION ALL SELECT 'file_flags.source_file_id', COUNT(*) FROM v_file_flags WHERE source_file_id NOT IN (SELECT id FROM v_source_files)")
def foreign_keys(t: Tables) -> DataFrame:
    def broken(child: DataFrame, key: str, parent: DataFrame, name: str) -> DataFrame:
        return child.join(parent.select(F.col("id").alias(key)), key, "left_anti").agg(F.count("*").alias("broken")).select(F.lit(name).alias("fk"), "broken")

    return broken(t.bulk_files, "job_id", t.bulk_jobs, "bulk_files.job_id").unionByName(broken(t.file_flags, "source_file_id", t.source_files, "file_flags.source_file_id"))


@query("C24_slot_collisions", "SELECT CAST(HOUR(timestamp) AS INT) AS hour, CAST(MINUTE(timestamp) AS INT) AS minute, COUNT(*) AS n FROM v_activity_events WHERE event_type = 'signup' GROUP BY 1,2 HAVING COUNT(*) > 1")
def slot_collisions(t: Tables) -> DataFrame:
    return t.activity_events.filter("event_type = 'signup'").groupBy(F.hour("timestamp").alias("hour"), F.minute("timestamp").alias("minute")).agg(F.count("*").alias("n")).filter("n > 1")


@query("C30_event_fields", "SELECT id, CAST(metadata->>'$.k' AS BIGINT) AS k FROM v_activity_events")
def event_fields(t: Tables) -> DataFrame:
    """A field of JSON text; text that isn't JSON gives null."""
    return t.activity_events.select("id", F.try_variant_get(F.try_parse_json("metadata"), "$.k", "bigint").alias("k"))


@query("C23b_key_integrity", " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS n, COUNT(*) - COUNT(id) AS without_key, COUNT(id) - COUNT(DISTINCT id) AS repeated FROM v_{n}" for n in ("source_files", "bulk_jobs", "analysis_queue", "conversion_history", "activity_events")))
def key_integrity(t: Tables) -> DataFrame:
    """Of each table: rows, rows without a key, and rows beyond the first of a key."""

    def told(name: str) -> DataFrame:
        per_key = getattr(t, name).groupBy("id").agg(F.count("*").alias("n"))
        key = F.col("id").isNotNull()
        return per_key.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~key, F.col("n"))), F.lit(0)).alias("without_key"), F.coalesce(F.sum(F.when(key, F.col("n") - 1)), F.lit(0)).alias("repeated")).select(F.lit(name).alias("table_name"), "n", "without_key", "repeated")

    whole = None
    for name in ("source_files", "bulk_jobs", "analysis_queue", "conversion_history", "activity_events"):
        whole = told(name) if whole is None else whole.unionByName(told(name))
    return whole
