"""Keyed state as sets of rows: upserts, unique names, queues of reviews and issues, appended facts, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sinks import writers
from ..sources.tables import Tables
from .lifecycle import upsert
from .maintenance import scratch, updated


def exported(df: DataFrame, t: Tables, name: str, schema: str) -> DataFrame:
    """df written as delimited files with a header and read back."""
    folder = scratch(t, f"{name}-{uuid.uuid4().hex[:6]}")
    writers.export_csv(df, folder)
    return writers.exported_csv(t.spark, folder, schema)


@query("K05_upsert_preferences", "SELECT user_id AS key, ARG_MAX(event_type,(timestamp,id)) AS value, COUNT(*) AS writes FROM v_activity_events GROUP BY 1 UNION ALL SELECT -1, 'default', 0")
def upsert_preferences(t: Tables) -> DataFrame:
    """Stored preferences with the latest write of each key over them; one that nobody wrote stays."""
    e = t.activity_events
    stale = e.filter("user_id % 2 = 0").select(F.col("user_id").alias("key"), F.lit("stale").alias("value"), F.lit(0).cast("long").alias("writes")).distinct()
    stored = t.spark.createDataFrame([(-1, "default", 0)], "key long, value string, writes long").unionByName(stale)
    latest = e.groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", F.struct("timestamp", "id")).alias("value"), F.count("*").alias("writes"))
    return upsert(stored, latest, "key")


@query("K17_export_metrics", "SELECT seq, cpu, rss_bytes FROM v_system_metrics WHERE timestamp >= (SELECT MAX(timestamp) FROM v_system_metrics) - INTERVAL 30 DAYS")
def export_metrics(t: Tables, days: int = 30) -> DataFrame:
    now = t.system_metrics.agg(F.max("timestamp").alias("now"))
    rows = t.system_metrics.join(F.broadcast(now), F.col("timestamp") >= F.col("now") - F.make_interval(days=F.lit(days)))
    return exported(rows.select("seq", "cpu", "rss_bytes"), t, "metrics", "seq long, cpu double, rss_bytes long")


@query("K17b_export_costs", "SELECT provider_id, model, COUNT(*) AS calls, SUM(tokens_used) AS tokens FROM v_analysis_queue WHERE tokens_used IS NOT NULL AND provider_id IS NOT NULL GROUP BY 1,2")
def export_costs(t: Tables) -> DataFrame:
    rows = t.analysis_queue.filter("tokens_used is not null and provider_id is not null").groupBy("provider_id", "model").agg(F.count("*").alias("calls"), F.sum("tokens_used").alias("tokens"))
    return exported(rows, t, "costs", "provider_id string, model string, calls long, tokens long")


@query("K17c_export_unrecognized", "SELECT source_path, file_ext AS source_format, file_size_bytes, job_id FROM v_bulk_files WHERE status = 'unrecognized'")
def export_unrecognized(t: Tables) -> DataFrame:
    rows = t.bulk_files.filter("status = 'unrecognized'").select("source_path", F.col("file_ext").alias("source_format"), "file_size_bytes", "job_id")
    return exported(rows, t, "unrecognized", "source_path string, source_format string, file_size_bytes long, job_id string")


_LOCATIONS = "l AS (SELECT c_custkey AS id, c_mktsegment||'-'||MOD(c_custkey,40) AS name FROM customer)"


@query("C04_unique_names", f"WITH {_LOCATIONS} SELECT id, name FROM l QUALIFY ROW_NUMBER() OVER (PARTITION BY name ORDER BY id) = 1")
def unique_names(t: Tables) -> DataFrame:
    """Locations as they are created one after another: a name that is taken is refused, so the first of each stays."""
    rows = t.raw("customer").select(F.col("c_custkey").alias("id"), F.concat_ws("-", "c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("name"))
    return rows.groupBy("name").agg(F.min("id").alias("id")).select("id", "name")


@query("C04b_renamed_locations", f"WITH {_LOCATIONS}, f AS (SELECT id, name FROM l QUALIFY ROW_NUMBER() OVER (PARTITION BY name ORDER BY id) = 1) SELECT id, CASE WHEN MOD(id,2) = 0 AND REPLACE(name,'-1','-2') NOT IN (SELECT name FROM f o WHERE o.id <> f.id) THEN REPLACE(name,'-1','-2') ELSE name END AS name FROM f")
def renamed_locations(t: Tables) -> DataFrame:
    """New names for some; one that another location has is refused."""
    stored = unique_names(t)
    asked = stored.withColumn("asked", F.when(F.col("id") % 2 == 0, F.replace("name", F.lit("-1"), F.lit("-2"))).otherwise(F.col("name")))
    taken = stored.select(F.col("name").alias("asked"), F.col("id").alias("owner"))
    free = F.col("owner").isNull() | (F.col("owner") == F.col("id"))
    return asked.join(taken, "asked", "left").select("id", F.when(free, F.col("asked")).otherwise(F.col("name")).alias("name"))


@query("C08_conversion_records", "SELECT id, source_format, status, COALESCE(ocr_confidence,0) < 70 AS needs_review, CASE WHEN status = 'success' AND ocr_confidence IS NOT NULL THEN ROUND(ocr_confidence,4) END AS ocr_mean FROM v_conversion_history")
def conversion_records(t: Tables, threshold: float = 70.0) -> DataFrame:
    """Appended records, then the OCR figures of the successful ones set."""
    rows = t.conversion_history.select("id", "source_format", "status", (F.coalesce("ocr_confidence", F.lit(0.0)) < threshold).alias("needs_review"), F.lit(None).cast("double").alias("ocr_mean"), "ocr_confidence")
    done = (F.col("status") == "success") & F.col("ocr_confidence").isNotNull()
    return updated(rows, done, ocr_mean=F.round("ocr_confidence", 4)).drop("ocr_confidence")


@query("C09_batch_state", "SELECT batch_id, ARG_MAX(status,(enqueued_at,id)) AS status, COUNT(*) AS writes FROM v_analysis_queue WHERE batch_id IS NOT NULL GROUP BY 1")
def batch_state(t: Tables) -> DataFrame:
    """One row for each batch: the last state written, inserted or updated."""
    q = t.analysis_queue.filter("batch_id is not null")
    last = q.groupBy("batch_id").agg(F.max_by("status", F.struct("enqueued_at", "id")).alias("status"), F.count("*").alias("writes"))
    stored = q.groupBy("batch_id").agg(F.min_by("status", F.struct("enqueued_at", "id")).alias("status")).withColumn("writes", F.lit(1).cast("long"))
    return upsert(stored.filter("batch_id < 'b5'"), last, "batch_id")


_REVIEW = "r AS (SELECT id, job_id, source_path, CASE WHEN MOD(file_size_bytes,3) = 0 THEN 'converted' WHEN MOD(file_size_bytes,5) = 0 THEN 'skipped_permanently' ELSE 'pending' END AS status FROM v_bulk_files WHERE status = 'failed')"


def review_queue(t: Tables) -> DataFrame:
    """Failed files up for review; some were resolved since."""
    size = F.col("file_size_bytes")
    rows = t.bulk_files.filter("status = 'failed'").select("id", "job_id", "source_path", "file_size_bytes", F.lit("pending").alias("status"))
    state = F.when(size % 3 == 0, "converted").otherwise("skipped_permanently")
    return updated(rows, (size % 3 == 0) | (size % 5 == 0), status=state).drop("file_size_bytes")


@query("C11_review_summary", f"WITH {_REVIEW} SELECT job_id, COUNT(*) FILTER (status = 'pending') AS pending, COUNT(*) FILTER (status = 'converted') AS converted, COUNT(*) FILTER (status = 'skipped_permanently') AS skipped_permanently, COUNT(*) AS total FROM r GROUP BY 1")
def review_summary(t: Tables) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return review_queue(t).groupBy("job_id").agg(n("pending"), n("converted"), n("skipped_permanently"), F.count("*").alias("total"))


@query("C11b_review_page", f"WITH {_REVIEW} SELECT id, source_path FROM r WHERE job_id = 'job2' AND status = 'pending' ORDER BY source_path, id LIMIT 50")
def review_page(t: Tables) -> DataFrame:
    return review_queue(t).filter("job_id = 'job2' and status = 'pending'").orderBy("source_path", "id").limit(50).select("id", "source_path")


_ISSUES = """i AS (SELECT id, '/o/'||dir_id||file_ext AS out, source_path FROM v_source_files), g AS (SELECT *, COUNT(*) OVER (PARTITION BY out) AS n FROM i),
issue AS (SELECT id, CASE WHEN LENGTH(source_path) > 14 THEN 'path_too_long' ELSE 'collision' END AS issue_type, out AS collision_group, source_path FROM g WHERE n > 1 OR LENGTH(source_path) > 14)"""


def path_issues(t: Tables, longest: int = 14) -> DataFrame:
    """(id, issue_type, collision_group, source_path): too long paths, and output paths that several files claim."""
    rows = t.source_files.select("id", "source_path", F.concat(F.lit("/o/"), F.col("dir_id").cast("string"), F.col("file_ext")).alias("collision_group"))
    claimed = rows.groupBy("collision_group").agg(F.count("*").alias("n"))
    long = F.length("source_path") > longest
    found = rows.join(claimed, "collision_group").filter((F.col("n") > 1) | long)
    return found.select("id", F.when(long, "path_too_long").otherwise("collision").alias("issue_type"), "collision_group", "source_path")


@query("C13_path_issue_summary", f"WITH {_ISSUES} SELECT k.issue_type, COUNT(i.id) AS n FROM (VALUES ('path_too_long'),('collision'),('case_collision')) k(issue_type) LEFT JOIN issue i ON i.issue_type = k.issue_type GROUP BY 1 UNION ALL SELECT 'total', COUNT(*) FROM issue")
def path_issue_summary(t: Tables) -> DataFrame:
    from .aggregates import zero_filled

    counts = path_issues(t).groupBy("issue_type").agg(F.count("*").alias("n"))
    known = zero_filled(counts, "issue_type", ["path_too_long", "collision", "case_collision"])
    return known.unionByName(known.agg(F.sum("n").alias("n")).select(F.lit("total").alias("issue_type"), "n"))


@query("C13b_resolved_issues", f"WITH {_ISSUES} SELECT id, CASE WHEN issue_type = 'collision' THEN 'renamed' END AS resolution, CASE WHEN issue_type = 'collision' THEN collision_group||'.'||id END AS resolved_path FROM issue")
def resolved_issues(t: Tables) -> DataFrame:
    rows = path_issues(t).select("id", "issue_type", "collision_group", F.lit(None).cast("string").alias("resolution"), F.lit(None).cast("string").alias("resolved_path"))
    done = updated(rows, F.col("issue_type") == "collision", resolution=F.lit("renamed"), resolved_path=F.concat_ws(".", "collision_group", "id"))
    return done.select("id", "resolution", "resolved_path")


@query("C17_usage_appended", "SELECT provider_id, model, COUNT(*) AS calls, SUM(tokens_used) AS tokens FROM v_analysis_queue WHERE tokens_used IS NOT NULL AND user_id % 2 = 0 GROUP BY 1,2")
def usage_appended(t: Tables) -> DataFrame:
    """Facts appended for users whose toggle is on, then summed."""
    toggles = t.activity_events.select("user_id").distinct().withColumn("enabled", F.col("user_id") % 2 == 0)
    facts = t.analysis_queue.filter("tokens_used is not null").join(toggles.filter("enabled").select("user_id"), "user_id", "left_semi")
    folder = scratch(t, "usage")
    facts.filter("tokens_used % 2 = 0").select("provider_id", "model", "tokens_used").write.mode("append").parquet(folder)
    facts.filter("tokens_used % 2 = 1").select("provider_id", "model", "tokens_used").write.mode("append").parquet(folder)
    return t.spark.read.parquet(folder).groupBy("provider_id", "model").agg(F.count("*").alias("calls"), F.sum("tokens_used").alias("tokens"))


@query("C19_disk_series", "SELECT DATE_TRUNC('day',source_mtime)::TIMESTAMP AS day, SUM(file_size_bytes) AS bytes FROM v_source_files GROUP BY 1 HAVING day >= (SELECT DATE_TRUNC('day',MAX(source_mtime)) FROM v_source_files) - INTERVAL 90 DAYS")
def disk_series(t: Tables, days: int = 90) -> DataFrame:
    """Daily samples inserted as rows and read back for a trailing range."""
    folder = scratch(t, "disk")
    t.source_files.groupBy(F.date_trunc("day", "source_mtime").cast("timestamp_ntz").alias("day")).agg(F.sum("file_size_bytes").alias("bytes")).write.mode("append").parquet(folder)
    stored = t.spark.read.parquet(folder)
    now = stored.agg(F.max("day").alias("now"))
    return stored.join(F.broadcast(now), F.col("day") >= F.col("now") - F.make_interval(days=F.lit(days))).select("day", "bytes")


@query("C27_next_action", "SELECT id, CASE WHEN file_ext IN ('.mp3','.wav','.mp4','.mov') THEN 'transcribe' WHEN file_ext IN ('.png','.jpg','.tif') THEN 'analyze' WHEN file_ext IN ('.pdf','.docx','.xlsx','.txt','.zip') THEN 'convert' ELSE 'none' END AS action, file_ext IN ('.png','.jpg','.pdf','.mp3','.wav','.mp4','.mov') AS renders FROM v_source_files")
def next_action(t: Tables) -> DataFrame:
    """What to do with a file by its type, and whether a browser shows it as it is."""
    e = F.lower("file_ext")
    action = F.when(e.isin(".mp3", ".wav", ".mp4", ".mov"), "transcribe").when(e.isin(".png", ".jpg", ".tif"), "analyze").when(e.isin(".pdf", ".docx", ".xlsx", ".txt", ".zip"), "convert").otherwise("none")
    return t.source_files.select("id", action.alias("action"), e.isin(".png", ".jpg", ".pdf", ".mp3", ".wav", ".mp4", ".mov").alias("renders"))


@query("C29_request_activity", "SELECT user_id, MAX(timestamp) AS last_seen, COUNT(*) AS requests, COUNT(*) FILTER (event_type = 'view') AS streams FROM v_activity_events WHERE timestamp > (SELECT MAX(timestamp) FROM v_activity_events) - INTERVAL 5 DAYS GROUP BY 1")
def request_activity(t: Tables, days: int = 5) -> DataFrame:
    now = t.activity_events.agg(F.max("timestamp").alias("now"))
    recent = t.activity_events.join(F.broadcast(now), F.col("timestamp") > F.col("now") - F.make_interval(days=F.lit(days)))
    return recent.groupBy("user_id").agg(F.max("timestamp").alias("last_seen"), F.count("*").alias("requests"), F.count_if(F.col("event_type") == "view").alias("streams"))
