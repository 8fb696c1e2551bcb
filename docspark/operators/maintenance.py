"""Keyed maintenance, writers read back, similarity and remaining sources."""

from __future__ import annotations

import difflib
import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sinks import writers
from ..sources import files
from ..sources.tables import Tables
from ..streaming.monitors import _latest, own_folder, replayed, stateful
from .windows import numbered


def scratch(t: Tables, name: str) -> str:
    """A path that nothing is at yet, in a folder of the run's own."""
    return f"{own_folder(t.spark, name)}/data"


def updated(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows that meet the condition get new values; the others stay."""
    return df.select(*(F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


@query("S10_exclusions", "SELECT id FROM v_source_files WHERE NOT STARTS_WITH(source_path,'/src/2/') AND NOT CONTAINS(source_path,'77') AND file_ext <> '.png'")
def exclusions(t: Tables) -> DataFrame:
    p = F.col("source_path")
    return t.source_files.filter(~p.startswith("/src/2/") & ~p.contains("77") & (F.col("file_ext") != ".png")).select("id")


@query("S11_delimited_round_trip", "SELECT id, COALESCE(lifecycle_status,'') AS lifecycle_status, source_path FROM v_source_files")
def delimited_round_trip(t: Tables) -> DataFrame:
    """Written and read again as tab-separated text; every column a string."""
    folder = scratch(t, "tsv")
    t.source_files.select("id", "lifecycle_status", "source_path").write.option("header", True).option("sep", "\t").csv(folder)
    return files.delimited(t.spark, folder, "\t")


@query("S23_table_schema", "SELECT UNNEST(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS column_name")
def table_schema(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(f.name,) for f in t.raw("orders").schema], "column_name string")


@query("S35_json_log", "SELECT id, CAST(metadata->>'$.k' AS BIGINT) AS k FROM v_activity_events WHERE event_type = 'error'")
def json_log(t: Tables) -> DataFrame:
    """Compressed log lines written, then read and parsed."""
    folder = scratch(t, "log")
    line = F.to_json(F.struct(F.col("id"), F.col("metadata")))
    t.activity_events.filter("event_type = 'error'").select(line.alias("value")).write.option("compression", "gzip").text(folder)
    rows = files.json_lines(t.spark, folder)
    inner = F.try_parse_json(F.try_variant_get("json", "$.metadata", "string"))
    return rows.select(F.try_variant_get("json", "$.id", "bigint").alias("id"), F.try_variant_get(inner, "$.k", "bigint").alias("k"))


@query("S38_reader_registry", "SELECT UNNEST(['.docx','.xlsx']) AS ext, TRUE AS supported UNION ALL SELECT '.pdf', FALSE")
def reader_registry(t: Tables) -> DataFrame:
    from ..sources.containers import READERS

    known = F.array(*(F.lit(f".{k}") for k in READERS))
    return t.source_files.select(F.col("file_ext").alias("ext")).filter("ext in ('.docx','.xlsx','.pdf')").distinct().select("ext", F.array_contains(known, F.col("ext")).alias("supported"))


DEFAULTS = {"ocr_threshold": "70", "workers": "4", "theme": "light"}


@query("S39_preferences", "SELECT d.key, COALESCE(p.value,d.value) AS value FROM (VALUES ('ocr_threshold','70'),('workers','4'),('theme','light')) d(key,value) LEFT JOIN (VALUES ('workers','8')) p(key,value) ON p.key = d.key")
def preferences(t: Tables) -> DataFrame:
    stored = t.spark.createDataFrame([("workers", "8")], "key string, stored string")
    return t.spark.createDataFrame(list(DEFAULTS.items()), "key string, value string").join(stored, "key", "left").select("key", F.coalesce("stored", "value").alias("value"))


@query("K02_atomic_batch", "SELECT COUNT(*) AS n, SUM(file_size_bytes) AS bytes FROM v_source_files")
def atomic_batch(t: Tables) -> DataFrame:
    """One job, one commit: written rows are all there or none."""
    folder = scratch(t, "batch")
    t.source_files.write.parquet(folder)
    return t.spark.read.parquet(folder).agg(F.count("*").alias("n"), F.sum("file_size_bytes").alias("bytes"))


@query("K07b_replace_partitions", "SELECT lifecycle_status, COUNT(*) AS n FROM v_source_files WHERE lifecycle_status <> 'purged' GROUP BY 1 UNION ALL SELECT 'purged', 1")
def replaced_partitions(t: Tables) -> DataFrame:
    folder = scratch(t, "partitions")
    rows = t.source_files.select("id", "lifecycle_status")
    writers.replace_partitions(rows, folder, "lifecycle_status")
    writers.replace_partitions(t.spark.createDataFrame([("only", "purged")], rows.schema), folder, "lifecycle_status")
    return t.spark.read.parquet(folder).groupBy("lifecycle_status").agg(F.count("*").alias("n"))


@query("K10_csv_export", "SELECT id, title FROM v_corpus")
def csv_export(t: Tables) -> DataFrame:
    """Titles with quotes and line breaks written as CSV and read back."""
    folder = scratch(t, "csv")
    writers.export_csv(t.corpus.select("id", "title"), folder)
    return writers.exported_csv(t.spark, folder, "id long, title string")


@query("K13_json_export", "SELECT id, lang FROM v_corpus")
def json_export(t: Tables) -> DataFrame:
    folder = scratch(t, "json")
    writers.export_json(t.corpus.select("id", "lang"), folder)
    return t.spark.read.schema("id long, lang string").json(folder)


@query("K20_vector_upsert", "SELECT vec_id, CASE WHEN doc_id = 2 THEN 'new' ELSE source_format END AS source_format FROM v_vectors WHERE doc_id <> 3")
def vector_upsert(t: Tables) -> DataFrame:
    """Points of one document replaced, those of another deleted."""
    fresh = t.vectors.filter("doc_id = 2").withColumn("source_format", F.lit("new"))
    return t.vectors.filter("doc_id not in (2, 3)").unionByName(fresh).select("vec_id", "source_format")


@query("W11_diff_context", "WITH f AS (SELECT id, timestamp, event_type = 'error' AS hit FROM v_activity_events) SELECT id FROM f QUALIFY BOOL_OR(hit) OVER (ORDER BY timestamp, id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def diff_context(t: Tables) -> DataFrame:
    """Changed rows with three rows around each, as in a hunk."""
    events = t.activity_events.select("id", "timestamp", "event_type")
    return near_hits(events, F.col("event_type") == "error", "timestamp", "id").select("id")


def near_hits(rows: DataFrame, hit: Column, *order: str, n: int = 3) -> DataFrame:
    """Rows that meet the condition, with n rows around each in this order."""
    placed = numbered(rows.withColumn("hit", F.coalesce(hit, F.lit(False))), *order)
    near = placed.filter("hit").select(F.explode(F.sequence(F.col("place") - n, F.col("place") + n)).alias("place")).distinct()
    return placed.join(near, "place", "left_semi").drop("place", "hit")


@query("W11b_diff_context_all", "WITH f AS (SELECT id, timestamp, event_type = 'error' AS hit FROM v_activity_events) SELECT id FROM f QUALIFY BOOL_OR(hit) OVER (ORDER BY timestamp, id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def diff_context_all(t: Tables) -> DataFrame:
    """W11 under the name that it had while W11 itself held to some users."""
    return diff_context(t)


@query("O06_fusion_order", "WITH r AS (SELECT id, file_size_bytes%97 AS score, MOD(id,2) = 0 AS in_kw FROM v_corpus) SELECT id, ROW_NUMBER() OVER (ORDER BY score DESC, in_kw DESC, id) AS place FROM r ORDER BY place LIMIT 40")
def fusion_order(t: Tables) -> DataFrame:
    r = t.corpus.select("id", (F.col("file_size_bytes") % 97).alias("score"), (F.col("id") % 2 == 0).alias("in_kw"))
    order = [F.desc("score"), F.desc("in_kw"), F.col("id")]
    return r.orderBy(*order).limit(40).select("id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("F18_heading_line")
def heading_line(t: Tables) -> DataFrame:
    """Whether a title reads as a heading: a line or two, short, no closing mark, in capitals or in title case."""
    looks = F.pandas_udf(_reads_as_heading, "boolean")
    return t.corpus.select("id", looks("title").alias("heading"))


def _reads_as_heading(titles: pd.Series) -> pd.Series:
    def heading(title) -> bool:
        lines = (title or "").strip().split("\n")
        first = lines[0].strip()
        short = bool(first) and len(lines) <= 2 and len(first) < 80 and first[-1] not in ".,;:!"
        return short and (first.isupper() and len(first) > 2 or first.istitle() and len(first) < 60)

    return pd.Series([heading(x) for x in titles], dtype=bool)


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


@query("F27_similarity")
def similarity(t: Tables) -> DataFrame:
    """Matching-block ratio of each title with that of the next document of its source."""
    placed = numbered(t.corpus.select("id", "source_format", "title"), "source_format", "id")
    following = placed.select((F.col("place") - 1).alias("place"), "source_format", F.col("title").alias("other"))
    ratio = F.pandas_udf(_ratio, "double")
    return placed.join(following, ["place", "source_format"]).select("id", F.round(ratio("title", "other"), 6).alias("ratio"))


def _shape(values: pd.Series) -> pd.DataFrame:
    def walk(x, depth=1):
        inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
        below = [walk(v, depth + 1) for v in inner] if depth < 20 else []
        return max([depth if isinstance(x, (dict, list)) else depth - 1, *(d for d, _ in below)]), (len(x) if isinstance(x, dict) else 0) + sum(k for _, k in below)

    return pd.DataFrame([walk(json.loads(v)) if v else (0, 0) for v in values], columns=["depth", "keys"])


@query("F30_json_shape", "SELECT id, 1 AS depth, 1 AS keys FROM v_activity_events")
def json_shape(t: Tables) -> DataFrame:
    shape = F.pandas_udf(_shape, "depth int, keys int")
    return t.activity_events.select("id", shape("metadata").alias("s")).select("id", "s.depth", "s.keys")


@query("D06_index_rebuild", "SELECT COUNT(*) AS indexed, COUNT(*) FILTER (is_flagged) AS flagged FROM v_corpus")
def index_rebuild(t: Tables) -> DataFrame:
    """The whole index written anew, then counted."""
    folder = scratch(t, "index")
    rebuild(t.corpus.select("id", "title", "is_flagged"), F.col("id").isNull(), folder)
    return t.spark.read.parquet(folder).agg(F.count("*").alias("indexed"), F.count_if("is_flagged").alias("flagged"))


class RebuildStopped(RuntimeError):
    """Too many rows of a rebuild failed; the index is as it was."""


def rebuild(rows: DataFrame, bad: Column, folder: str, most: float = 0.5, least_rows: int = 10) -> tuple[int, int]:
    """Write the good rows as the new index in folder; (rows written, rows left out). From least_rows on, a share of bad ones of most or more stops it.

    The rows are written beside the old index and counted by the same job; the folders
    change places only after the count, so readers see the old index or the new one.
    """
    spark, staged = rows.sparkSession, f"{folder}.next-{uuid.uuid4().hex}"
    failed = F.coalesce(bad, F.lit(True))
    seen = Observation()
    try:
        rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("bad")).filter(~failed).write.parquet(staged)
        n, out = seen.get["n"], seen.get["bad"]
        if n >= least_rows and out >= most * n:
            raise RebuildStopped(f"{out} of {n} rows failed")
        path = lambda uri: spark._jvm.org.apache.hadoop.fs.Path(uri)
        store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        old = f"{folder}.old-{uuid.uuid4().hex}"
        if store.exists(path(folder)):
            store.rename(path(folder), path(old))
        store.rename(path(staged), path(folder))
        store.delete(path(old), True)
        return n - out, out
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(staged)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# Congestion ratios that shed two or one threads, the one that restores one, and the pause between changes in seconds.
SEVERE, MILD, RECOVERED, PAUSE = 3.0, 2.0, 1.5, 5.0


@query("T06_throttler_stream")
def throttler_stream(t: Tables, most: int = 8, baseline: float = 25.0, last: int = 100) -> DataFrame:
    """Threads that the rolling median latency allows, by shard of users."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple:
        n, threads, changed, recent = state
        held = [float(x) for x in recent.split(",") if x]
        for at, x in zip(rows["ts"].astype("int64") / 1e9, rows["value"]):
            n += 1
            held = (held + [float(x)])[-last:]
            ratio = sorted(held)[len(held) // 2] / baseline
            move = -2 if ratio >= SEVERE else -1 if ratio >= MILD else 1 if ratio <= RECOVERED else 0
            if at - changed >= PAUSE and 1 <= max(1, threads + move) <= most and max(1, threads + move) != threads:
                threads, changed = max(1, threads + move), at
        return n, threads, changed, ",".join(f"{x:.4f}" for x in held)

    monitor = stateful(step, (0, most, 0.0, ""), "n bigint, threads int, changed double, recent string", "shard", ["shard", "n", "threads", "changed", "recent"])
    return _latest(replayed(t, lambda s: monitor(s.withColumn("shard", F.col("user_id") % 10)), "update"), "shard", "n").select("shard", "n", "threads")


@query("T13_log_tail", "SELECT event_id FROM events WHERE event_type = 'error'")
def log_tail(t: Tables) -> DataFrame:
    """A file stream, filtered, delivered exactly once."""
    return replayed(t, lambda s: s.filter("event_type = 'error'").select("event_id"))


@query("C02_unprocessed", "SELECT job_id, COUNT(*) AS unprocessed FROM v_bulk_files WHERE status IN ('pending','failed') GROUP BY 1")
def unprocessed(t: Tables) -> DataFrame:
    return t.bulk_files.filter(F.col("status").isin("pending", "failed")).groupBy("job_id").agg(F.count("*").alias("unprocessed"))


@query("C06_unindexed", "SELECT id FROM v_source_files WHERE lifecycle_status = 'active' AND id NOT IN (SELECT source_file_id FROM v_analysis_queue WHERE status = 'completed') ORDER BY id LIMIT 100")
def unindexed(t: Tables) -> DataFrame:
    done = t.analysis_queue.filter("status = 'completed'").select(F.col("source_file_id").alias("id"))
    return t.source_files.filter("lifecycle_status = 'active'").join(done, "id", "left_anti").select("id").orderBy("id").limit(100)


@query("C07_members_by_hash", "SELECT content_hash, ARRAY_TO_STRING(LIST_SORT(LIST(id)),',') AS ids FROM v_source_files WHERE content_hash IN ('h3','h4') GROUP BY 1")
def members_by_hash(t: Tables) -> DataFrame:
    return t.source_files.filter(F.col("content_hash").isin("h3", "h4")).groupBy("content_hash").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


@query("C10_resolve_flags", "SELECT id, CASE WHEN status = 'active' AND reason = 'other' THEN 'resolved' ELSE status END AS status FROM v_file_flags")
def resolve_flags(t: Tables) -> DataFrame:
    return updated(t.file_flags, (F.col("status") == "active") & (F.col("reason") == "other"), status=F.lit("resolved")).select("id", "status")


@query("C12_by_hash_and_status", "SELECT lifecycle_status, COUNT(*) AS n, COUNT(DISTINCT content_hash) AS hashes FROM v_source_files GROUP BY 1")
def by_hash_and_status(t: Tables) -> DataFrame:
    return t.source_files.groupBy("lifecycle_status").agg(F.count("*").alias("n"), F.countDistinct("content_hash").alias("hashes"))


@query("C15_cancel_batched", "SELECT status, COUNT(*) AS n FROM (SELECT CASE WHEN status = 'batched' THEN 'pending' ELSE status END AS status FROM v_analysis_queue WHERE MOD(user_id,9) <> 0) GROUP BY 1")
def cancel_batched(t: Tables) -> DataFrame:
    """Batched rows set back, rows of some users deleted."""
    kept = t.analysis_queue.filter("user_id % 9 <> 0")
    return updated(kept, F.col("status") == "batched", status=F.lit("pending")).groupBy("status").agg(F.count("*").alias("n"))


@query("C21_startup_repair", "SELECT id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status FROM v_bulk_jobs")
def startup_repair(t: Tables) -> DataFrame:
    return updated(t.bulk_jobs, F.col("status") == "running", status=F.lit("failed")).select("id", "status")


@query("C22_added_column", "SELECT id, status, CAST(NULL AS BIGINT) AS priority FROM v_bulk_jobs UNION ALL SELECT 'job0','new',5")
def added_column(t: Tables) -> DataFrame:
    """Old rows beside rows with a column more."""
    fresh = t.spark.createDataFrame([("job0", "new", 5)], "id string, status string, priority long")
    return fresh.unionByName(t.bulk_jobs.select("id", "status"), allowMissingColumns=True)


@query("C25_upload_checks", "SELECT id, CASE WHEN file_ext NOT IN ('.pdf','.docx','.xlsx') THEN 'type' WHEN file_size_bytes > 200000 THEN 'size' ELSE 'ok' END AS verdict, REGEXP_REPLACE(source_path,'[^A-Za-z0-9._-]+','_','g') AS safe_name FROM v_source_files")
def upload_checks(t: Tables, most: int = 200_000) -> DataFrame:
    verdict = F.when(~F.col("file_ext").isin(".pdf", ".docx", ".xlsx"), "type").when(F.col("file_size_bytes") > most, "size").otherwise("ok")
    return t.source_files.select("id", verdict.alias("verdict"), F.regexp_replace("source_path", "[^A-Za-z0-9._-]+", "_").alias("safe_name"))


@query("C26_prompt", "SELECT STRING_AGG('['||rn||'] '||title, CHR(10) ORDER BY rn) AS prompt FROM (SELECT title, ROW_NUMBER() OVER (ORDER BY id) AS rn FROM v_corpus ORDER BY id LIMIT 8)")
def prompt(t: Tables, n: int = 8) -> DataFrame:
    """The first snippets, numbered, as one text."""
    top = t.corpus.orderBy("id").limit(n).agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("s"))
    return top.select(F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x.title)), "\n").alias("prompt"))


@query("C28_transcript_read", "SELECT history_id, segment_index, REGEXP_REPLACE('['||segment_index||'] '||text,'^\\[[0-9]+\\] ','') AS text FROM v_transcript_segments")
def transcript_read(t: Tables) -> DataFrame:
    line = F.concat(F.lit("["), F.col("segment_index").cast("string"), F.lit("] "), F.col("text"))
    return t.transcript_segments.select("history_id", "segment_index", F.regexp_replace(line, r"^\[[0-9]+\] ", "").alias("text"))
