"""Life cycle of files: change sets between scans, transitions, upserts, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import Tables
from .windows import numbered_within


def classify(registry: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(source_path, change): new, modified, restored, unchanged or missing, by one full outer join."""
    old = registry.select("source_path", F.col("source_mtime").alias("old_mtime"), F.col("file_size_bytes").alias("old_size"), "lifecycle_status")
    new = snapshot.select("source_path", F.col("source_mtime").alias("new_mtime"), F.col("file_size_bytes").alias("new_size"))
    change = F.when(F.col("old_mtime").isNull(), "new").when(F.col("new_mtime").isNull(), "missing").when(F.col("lifecycle_status").isin("marked_for_deletion", "in_trash"), "restored")
    change = change.when((F.col("old_mtime") != F.col("new_mtime")) | (F.col("old_size") != F.col("new_size")), "modified").otherwise("unchanged")
    return old.join(new, "source_path", "full_outer").select("source_path", change.alias("change"))


_CHANGES = """SELECT COALESCE(r.source_path,s.source_path) AS source_path, CASE WHEN r.source_path IS NULL THEN 'new' WHEN s.source_path IS NULL THEN 'missing' WHEN r.lifecycle_status IN ('marked_for_deletion','in_trash') THEN 'restored'
WHEN r.source_mtime <> s.source_mtime OR r.file_size_bytes <> s.file_size_bytes THEN 'modified' ELSE 'unchanged' END AS change FROM v_registry r FULL JOIN v_snapshot s ON r.source_path = s.source_path"""


@query("L01_classify_scan", _CHANGES)
def classify_scan(t: Tables) -> DataFrame:
    return classify(t.registry, t.snapshot)


@query("L02_deleted_and_moved", """WITH gone AS (SELECT * FROM v_registry WHERE lifecycle_status = 'active' AND source_path NOT IN (SELECT source_path FROM v_snapshot)), fresh AS (SELECT * FROM v_snapshot WHERE source_path NOT IN (SELECT source_path FROM v_registry))
SELECT g.id, CASE WHEN f.file_key IS NULL THEN 'deleted' ELSE 'moved' END AS event, f.source_path AS new_path FROM gone g LEFT JOIN fresh f ON f.file_key = g.file_key""")
def deleted_and_moved(t: Tables) -> DataFrame:
    gone = t.registry.filter("lifecycle_status = 'active'").join(t.snapshot, "source_path", "left_anti")
    fresh = t.snapshot.join(t.registry, "source_path", "left_anti").select("file_key", F.col("source_path").alias("new_path"))
    return gone.join(fresh, "file_key", "left").select("id", F.when(F.col("new_path").isNull(), "deleted").otherwise("moved").alias("event"), "new_path")


@query("L03_scan_counters", f"WITH c AS ({_CHANGES}) SELECT COUNT(*) FILTER (change = 'new') AS files_new, COUNT(*) FILTER (change = 'modified') AS files_modified, COUNT(*) FILTER (change = 'restored') AS files_restored, COUNT(*) FILTER (change = 'missing') AS files_missing FROM c")
def scan_counters(t: Tables) -> DataFrame:
    n = lambda c: F.count_if(F.col("change") == c).alias(f"files_{c}")
    return classify(t.registry, t.snapshot).agg(n("new"), n("modified"), n("restored"), n("missing"))


@query("L04_due_for_trash", "SELECT id, CASE lifecycle_status WHEN 'marked_for_deletion' THEN 'to_trash' ELSE 'to_purge' END AS action FROM v_source_files WHERE (lifecycle_status = 'marked_for_deletion' AND source_mtime <= (SELECT MAX(source_mtime) FROM v_source_files) - INTERVAL 36 HOURS) OR (lifecycle_status = 'in_trash' AND source_mtime <= (SELECT MAX(source_mtime) FROM v_source_files) - INTERVAL 60 DAYS)")
def due(t: Tables, grace_hours: int = 36, trash_days: int = 60) -> DataFrame:
    """Files past their grace in the trash cycle; now is the newest change."""
    now = t.source_files.agg(F.max("source_mtime").alias("now"))
    s, at = F.col("lifecycle_status"), F.col("source_mtime")
    late = lambda **x: at <= F.col("now") - F.make_interval(**{k: F.lit(v) for k, v in x.items()})
    rows = t.source_files.join(F.broadcast(now)).filter(((s == "marked_for_deletion") & late(hours=grace_hours)) | ((s == "in_trash") & late(days=trash_days)))
    return rows.select("id", F.when(s == "marked_for_deletion", "to_trash").otherwise("to_purge").alias("action"))


def transition(state: Column, event: Column) -> Column:
    """The state after an event; events that don't fit leave it as it is."""
    is_ = lambda s, e: (state == s) & (event == e)
    return F.when(is_("active", "missing"), "marked_for_deletion").when(state.isin("marked_for_deletion", "in_trash") & (event == "restored"), "active").when(is_("marked_for_deletion", "grace_over"), "in_trash").when(is_("in_trash", "retention_over"), "purged").otherwise(state)


@query("L05_transitions", f"WITH c AS ({_CHANGES}) SELECT r.id, CASE WHEN r.lifecycle_status = 'active' AND c.change = 'missing' THEN 'marked_for_deletion' WHEN r.lifecycle_status IN ('marked_for_deletion','in_trash') AND c.change = 'restored' THEN 'active' ELSE r.lifecycle_status END AS new_status FROM v_registry r JOIN c ON c.source_path = r.source_path")
def transitions(t: Tables) -> DataFrame:
    changes = classify(t.registry, t.snapshot)
    return t.registry.join(changes, "source_path").select("id", transition(F.col("lifecycle_status"), F.col("change")).alias("new_status"))


@query("L06_version_snapshot", f"WITH c AS ({_CHANGES}), v AS (SELECT source_file_id, COUNT(*) AS n FROM v_bulk_files WHERE status = 'converted' GROUP BY 1) SELECT r.id, COALESCE(v.n,0)+1 AS version_number, c.change AS change_type FROM v_registry r JOIN c ON c.source_path = r.source_path LEFT JOIN v ON v.source_file_id = r.id WHERE c.change IN ('modified','restored')")
def version_snapshot(t: Tables) -> DataFrame:
    versions = t.bulk_files.filter("status = 'converted'").groupBy(F.col("source_file_id").alias("id")).agg(F.count("*").alias("n"))
    changed = classify(t.registry, t.snapshot).filter(F.col("change").isin("modified", "restored"))
    return t.registry.join(changed, "source_path").join(versions, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("version_number"), F.col("change").alias("change_type"))


@query("L07_stale_checks", """SELECT 'flag_without_file' AS check_name, COUNT(*) AS n FROM v_file_flags WHERE source_file_id NOT IN (SELECT id FROM v_source_files) UNION ALL SELECT 'queue_without_file', COUNT(*) FROM v_analysis_queue WHERE source_file_id NOT IN (SELECT id FROM v_source_files)
UNION ALL SELECT 'file_without_run', COUNT(*) FROM v_source_files WHERE id NOT IN (SELECT source_file_id FROM v_bulk_files) UNION ALL SELECT 'run_of_purged', COUNT(*) FROM v_bulk_files WHERE source_file_id IN (SELECT id FROM v_source_files WHERE lifecycle_status = 'purged')""")
def stale_checks(t: Tables) -> DataFrame:
    files = t.source_files.select(F.col("id").alias("source_file_id"), "lifecycle_status")
    checks = {
        "flag_without_file": t.file_flags.join(files, "source_file_id", "left_anti"), "queue_without_file": t.analysis_queue.join(files, "source_file_id", "left_anti"),
        "file_without_run": files.join(t.bulk_files, "source_file_id", "left_anti"), "run_of_purged": t.bulk_files.join(files.filter("lifecycle_status = 'purged'"), "source_file_id", "left_semi"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("L08_self_correction", """SELECT COUNT(*) AS kept FROM v_bulk_files b WHERE source_file_id IN (SELECT id FROM v_source_files WHERE lifecycle_status <> 'purged') AND NOT (status = 'pending' AND EXISTS (SELECT 1 FROM v_bulk_files c WHERE c.source_path = b.source_path AND c.status = 'converted'))""")
def self_correction(t: Tables) -> DataFrame:
    """Runs that remain after rows of purged files and superseded pending rows are deleted."""
    live = t.source_files.filter("lifecycle_status <> 'purged'").select(F.col("id").alias("source_file_id"))
    done = t.bulk_files.filter("status = 'converted'").select("source_path").distinct().withColumn("done", F.lit(True))
    rest = t.bulk_files.join(live, "source_file_id", "left_semi").join(done, "source_path", "left")
    return rest.filter(~((F.col("status") == "pending") & F.coalesce("done", F.lit(False)))).agg(F.count("*").alias("kept"))


@query("L09_enqueue_decision", """SELECT s.id, CASE WHEN q.status IS NULL THEN 'insert' WHEN q.status IN ('pending','batched') THEN 'existing' WHEN q.status = 'failed' THEN 'requeue' ELSE 'skip' END AS decision FROM v_source_files s LEFT JOIN (SELECT source_file_id, ARG_MAX(status,(enqueued_at,id)) AS status FROM v_analysis_queue GROUP BY 1) q ON q.source_file_id = s.id""")
def enqueue_decision(t: Tables) -> DataFrame:
    last = t.analysis_queue.groupBy(F.col("source_file_id").alias("id")).agg(F.max_by("status", F.struct("enqueued_at", "id")).alias("status"))
    s = F.col("status")
    decision = F.when(s.isNull(), "insert").when(s.isin("pending", "batched"), "existing").when(s == "failed", "requeue").otherwise("skip")
    return t.source_files.select("id").join(last, "id", "left").select("id", decision.alias("decision"))


@query("L10_write_results", "SELECT id, CASE WHEN status <> 'failed' THEN status WHEN retry_count < 3 THEN 'pending' ELSE 'failed' END AS new_status, CASE WHEN status = 'failed' THEN retry_count+1 ELSE retry_count END AS retries FROM v_analysis_queue")
def write_results(t: Tables, most: int = 3) -> DataFrame:
    failed, n = F.col("status") == "failed", F.col("retry_count")
    return t.analysis_queue.select("id", F.when(~failed, F.col("status")).when(n < most, "pending").otherwise("failed").alias("new_status"), F.when(failed, n + 1).otherwise(n).alias("retries"))


@query("L11_flag_lifecycle", "SELECT id, CASE WHEN status = 'active' AND MOD(n,7) = 0 THEN 'expired' ELSE status END AS new_status FROM v_file_flags")
def flag_lifecycle(t: Tables) -> DataFrame:
    expired = (F.col("status") == "active") & (F.col("n") % 7 == 0)
    return t.file_flags.select("id", F.when(expired, "expired").otherwise(F.col("status")).alias("new_status"))


@query("L12_auto_convert_decision", """WITH m AS (SELECT DATE_TRUNC('hour',m.timestamp) AS h, AVG(cpu) AS cpu, COUNT(*) FILTER (event_type = 'view') AS discovered, COUNT(*) AS requests FROM v_system_metrics m JOIN v_activity_events a ON a.id = m.seq GROUP BY 1),
u AS (SELECT *, ROUND(AVG(cpu) OVER w,6) AS usual, AVG(requests) OVER w AS usual_requests, ISODOW(h) <= 5 AND HOUR(h) BETWEEN 6 AND 17 AS business FROM m WINDOW w AS (PARTITION BY ISODOW(h), HOUR(h)))
SELECT h AS hour_bucket, discovered, discovered > 0 AS should_convert, CASE WHEN discovered = 0 THEN 0 ELSE CAST(LEAST(GREATEST(1,FLOOR((100-GREATEST(ROUND(cpu,6),usual))*(CASE WHEN business THEN 0.7::DOUBLE*0.7::DOUBLE ELSE 0.7::DOUBLE END)/15)),8) AS INT) END AS workers,
CASE WHEN discovered = 0 THEN 0 ELSE CAST(LEAST(GREATEST(1,FLOOR(LEAST(CASE WHEN HOUR(h) < 5 AND usual_requests < 10 THEN 500 WHEN NOT business THEN 250 WHEN usual_requests < 10 THEN 100 ELSE 50 END,discovered)*0.7::DOUBLE)),discovered) AS INT) END AS batch_size FROM u""")
def auto_convert(t: Tables) -> DataFrame:
    """For each hour: files found, whether to convert them, with how many workers and in what batch, from the load now and usually."""
    from .scalars import batch_size, workers

    kinds = t.activity_events.select(F.col("id").alias("seq"), "event_type")
    m = t.system_metrics.join(kinds, "seq").groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour_bucket"))
    m = m.agg(F.avg("cpu").alias("cpu"), F.count_if(F.col("event_type") == "view").alias("discovered"), F.count("*").alias("requests"))
    m = m.withColumn("day_of_week", F.weekday("hour_bucket")).withColumn("hour", F.hour("hour_bucket"))
    usual = m.groupBy("day_of_week", "hour").agg(F.round(F.avg("cpu"), 6).alias("usual"), F.avg("requests").alias("usual_requests"))
    found, day, hour = F.col("discovered"), F.col("day_of_week"), F.col("hour")
    some = lambda x: F.when(found == 0, 0).otherwise(x)
    started = workers(F.round("cpu", 6), F.col("usual"), day, hour)
    return m.join(F.broadcast(usual), ["day_of_week", "hour"]).select("hour_bucket", "discovered", (found > 0).alias("should_convert"), some(started).alias("workers"), some(batch_size(found, F.col("usual_requests"), day, hour)).alias("batch_size"))


@query("L13_trash_listing", "SELECT id, file_size_bytes FROM v_source_files WHERE lifecycle_status = 'in_trash' ORDER BY source_mtime DESC, id LIMIT 100")
def trash_listing(t: Tables) -> DataFrame:
    return t.source_files.filter("lifecycle_status = 'in_trash'").orderBy(F.desc("source_mtime"), "id").limit(100).select("id", "file_size_bytes")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows written over it by key: columns that rows have win, others stay. One row of rows for each key."""
    own = [c for c in rows.columns if c != key]
    new = rows.select(key, *(F.col(c).alias(f"new_{c}") for c in own), F.lit(True).alias("is_new_"))
    joined = table.join(new, key, "full_outer")
    return joined.select(*(F.when(F.col("is_new_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in table.columns))


@query("K03_upsert_files", "SELECT COALESCE(s.source_path,r.source_path) AS source_path, CASE WHEN s.source_path IS NOT NULL THEN s.file_size_bytes ELSE r.file_size_bytes END AS file_size_bytes, r.lifecycle_status FROM v_registry r FULL JOIN v_snapshot s ON s.source_path = r.source_path")
def upsert_files(t: Tables) -> DataFrame:
    return upsert(t.registry.select("source_path", "file_size_bytes", "lifecycle_status"), t.snapshot.select("source_path", "file_size_bytes"), "source_path")


@query("K04_upsert_runs", "SELECT s.source_path, CASE WHEN r.source_mtime IS NOT DISTINCT FROM s.source_mtime THEN 'skipped' ELSE 'pending' END AS status FROM v_snapshot s LEFT JOIN v_registry r ON r.source_path = s.source_path")
def upsert_runs(t: Tables) -> DataFrame:
    stored = t.registry.select("source_path", F.col("source_mtime").alias("stored"))
    return t.snapshot.join(stored, "source_path", "left").select("source_path", F.when(F.col("stored").eqNullSafe(F.col("source_mtime")), "skipped").otherwise("pending").alias("status"))


@query("K06_insert_or_ignore", "SELECT source_path FROM v_registry UNION ALL SELECT source_path FROM v_snapshot WHERE source_path NOT IN (SELECT source_path FROM v_registry)")
def insert_or_ignore(t: Tables) -> DataFrame:
    return t.registry.select("source_path").union(t.snapshot.join(t.registry, "source_path", "left_anti").select("source_path"))


@query("K07_replace_for_key", "SELECT project_id, media_path FROM v_media_refs WHERE project_id NOT IN (1,2,3) UNION ALL SELECT k, '/m/new'||k FROM (VALUES (1),(2),(3)) v(k)")
def replace_for_key(t: Tables) -> DataFrame:
    """All rows of some keys replaced at once."""
    fresh = t.spark.createDataFrame([(k, f"/m/new{k}") for k in (1, 2, 3)], "project_id long, media_path string")
    return t.media_refs.select("project_id", "media_path").join(fresh.select("project_id"), "project_id", "left_anti").unionByName(fresh)


@query("K15_manifest_json", """SELECT job_id, '{"job":"'||job_id||'","total":'||COUNT(*)||',"converted":'||COUNT(*) FILTER (status = 'converted')||'}' AS manifest FROM v_bulk_files GROUP BY 1""")
def manifest_json(t: Tables) -> DataFrame:
    sums = t.bulk_files.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "converted").alias("converted"))
    return sums.select("job_id", F.to_json(F.struct(F.col("job_id").alias("job"), "total", "converted")).alias("manifest"))


@query("K16_style_sidecar", "SELECT content_hash||':'||(ROW_NUMBER() OVER (PARTITION BY content_hash ORDER BY source_path)-1) AS entry, source_path FROM v_source_files")
def style_sidecar(t: Tables) -> DataFrame:
    placed = numbered_within(t.source_files.select("content_hash", "source_path"), "content_hash", "source_path")
    return placed.select(F.concat_ws(":", "content_hash", F.col("place").cast("string")).alias("entry"), "source_path")


@query("K22_retention", "SELECT COUNT(*) AS kept, MIN(timestamp) AS oldest FROM v_system_metrics WHERE timestamp >= (SELECT MAX(timestamp) FROM v_system_metrics) - INTERVAL 10 DAYS")
def retention(t: Tables, days: int = 10) -> DataFrame:
    now = t.system_metrics.agg(F.max("timestamp").alias("now"))
    kept = t.system_metrics.join(F.broadcast(now), F.col("timestamp") >= F.col("now") - F.make_interval(days=F.lit(days)))
    return kept.agg(F.count("*").alias("kept"), F.min("timestamp").alias("oldest"))


@query("S07_incremental_dirs", "WITH a AS (SELECT dir_id, MAX(source_mtime) AS m FROM v_registry GROUP BY 1), b AS (SELECT CAST(STRING_SPLIT(REPLACE(source_path,'/moved',''),'/')[3] AS BIGINT) AS dir_id, MAX(source_mtime) AS m FROM v_snapshot GROUP BY 1) SELECT b.dir_id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.dir_id = b.dir_id AND a.m = b.m)")
def incremental_dirs(t: Tables) -> DataFrame:
    """Folders to walk again: those whose newest change isn't the stored one."""
    stored = t.registry.groupBy("dir_id").agg(F.max("source_mtime").alias("m"))
    folder = F.split(F.regexp_replace("source_path", "^/moved", ""), "/")[2].cast("long")
    return t.snapshot.groupBy(folder.alias("dir_id")).agg(F.max("source_mtime").alias("m")).join(stored, ["dir_id", "m"], "left_anti").select("dir_id")
