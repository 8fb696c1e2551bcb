"""Filters and projections."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import Tables


def all_of(**equal) -> Column:
    """Equality on every column that has a value; None means any."""
    return reduce(and_, (F.col(c) == v for c, v in equal.items() if v is not None), F.lit(True))


@query("P01_dynamic_filters", "SELECT id FROM v_conversion_history WHERE source_format = 'pdf' AND status = 'error'")
def dynamic_filters(t: Tables) -> DataFrame:
    return t.conversion_history.filter(all_of(source_format="pdf", status="error", user_id=None)).select("id")


@query("P02_contains_any_case", "SELECT id FROM v_source_files WHERE source_path ILIKE '%99%.PDF%'")
def contains_any_case(t: Tables) -> DataFrame:
    return t.source_files.filter(F.col("source_path").ilike("%99%.PDF%")).select("id")


@query("P03_prefix_any_case", "SELECT id FROM v_source_files WHERE source_path ILIKE '/SRC/12%'")
def prefix_any_case(t: Tables) -> DataFrame:
    return t.source_files.filter(F.col("source_path").ilike("/SRC/12%")).select("id")


@query("P04_half_open_range", "SELECT seq FROM v_system_metrics WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-06'")
def half_open_range(t: Tables) -> DataFrame:
    at = F.col("timestamp")
    return t.system_metrics.filter((at >= F.lit("2024-01-05").cast("timestamp_ntz")) & (at < F.lit("2024-01-06").cast("timestamp_ntz"))).select("seq")


#: Relative ranges by token, in hours.
RANGES = {"1h": 1, "6h": 6, "24h": 24, "7d": 168, "30d": 720, "90d": 2160}


def since(df: DataFrame, column: str, token: str) -> DataFrame:
    """Rows within the range before the newest row; an unknown token means a day."""
    now = df.agg(F.max(column).alias("now_"))
    return df.join(F.broadcast(now), F.col(column) >= F.col("now_") - F.make_interval(hours=F.lit(RANGES.get(token, 24)))).drop("now_")


for _token, _hours in RANGES.items():
    query(f"P05_since_{_token}", f"SELECT COUNT(*) AS n FROM v_system_metrics WHERE timestamp >= (SELECT MAX(timestamp) FROM v_system_metrics) - INTERVAL {_hours} HOURS")(lambda t, k=_token: since(t.system_metrics, "timestamp", k).agg(F.count("*").alias("n")))


@query("P06_in_list", "SELECT id FROM v_activity_events WHERE event_type IN ('click','purchase')")
def in_list(t: Tables) -> DataFrame:
    return t.activity_events.filter(F.col("event_type").isin("click", "purchase")).select("id")


@query("P07_null_tolerant", "SELECT id FROM v_analysis_queue WHERE batch_id = 'b1' OR batch_id IS NULL")
def null_tolerant(t: Tables) -> DataFrame:
    return t.analysis_queue.filter("batch_id = 'b1' or batch_id is null").select("id")


@query("P08_coalesce", "SELECT id, COALESCE(tokens_used,0) AS tokens, COALESCE(provider_id,'none') AS provider FROM v_analysis_queue")
def defaults(t: Tables) -> DataFrame:
    return t.analysis_queue.select("id", F.coalesce("tokens_used", F.lit(0)).alias("tokens"), F.coalesce("provider_id", F.lit("none")).alias("provider"))


@query("P09_case", "SELECT id, CASE WHEN ocr_confidence IS NULL THEN 'none' WHEN ocr_confidence < 70 THEN 'low' ELSE 'good' END AS ocr_class FROM v_conversion_history")
def cases(t: Tables) -> DataFrame:
    c = F.col("ocr_confidence")
    return t.conversion_history.select("id", F.when(c.isNull(), "none").when(c < 70, "low").otherwise("good").alias("ocr_class"))


@query("P10_padded_projection", "SELECT source_path, 'scanned' AS stage, CAST(NULL AS VARCHAR) AS error, file_size_bytes FROM v_source_files")
def padded_projection(t: Tables) -> DataFrame:
    return t.source_files.select("source_path", F.lit("scanned").alias("stage"), F.lit(None).cast("string").alias("error"), "file_size_bytes")


@query("P11_first_non_empty", "SELECT id, COALESCE(NULLIF(TRIM(SUBSTR(title,1,1)),''), NULLIF(source_format,''), 'untitled') AS label FROM v_corpus")
def first_non_empty(t: Tables) -> DataFrame:
    filled = lambda c: F.nullif(c, F.lit(""))
    return t.corpus.select("id", F.coalesce(filled(F.trim(F.substring("title", 1, 1))), filled(F.col("source_format")), F.lit("untitled")).alias("label"))


#: Columns that a listing may be sorted by.
SORTABLE = {"size": "file_size_bytes", "path": "source_path", "date": "source_mtime"}


def sorted_by(df: DataFrame, key: str, descending: bool) -> DataFrame:
    if key not in SORTABLE:
        raise ValueError(f"can't sort by {key}")
    column = F.col(SORTABLE[key])
    return df.orderBy(column.desc() if descending else column.asc(), "id")


@query("P12_whitelisted_sort", "SELECT id, file_size_bytes FROM v_source_files ORDER BY file_size_bytes DESC, id LIMIT 20")
def whitelisted_sort(t: Tables) -> DataFrame:
    return sorted_by(t.source_files, "size", True).limit(20).select("id", "file_size_bytes")


@query("P13_role_gate", "SELECT id FROM v_corpus WHERE NOT is_flagged")
def role_gate(t: Tables) -> DataFrame:
    return t.corpus.filter(~F.coalesce("is_flagged", F.lit(False))).select("id")


@query("P14_reanalyze_selector", "WITH s AS (SELECT id FROM v_analysis_queue WHERE status = 'failed' AND provider_id = 'p0' LIMIT 1001) SELECT LEAST(COUNT(*),1000) AS selected, COUNT(*) > 1000 AS overflow FROM s")
def reanalyze_selector(t: Tables, cap: int = 1000, **equal) -> DataFrame:
    """Rows to analyse again, at most cap, and whether there were more. Without any filter it refuses."""
    equal = equal or {"status": "failed", "provider_id": "p0"}
    if not any(v is not None for v in equal.values()):
        raise ValueError("a filter is needed")
    return t.analysis_queue.filter(all_of(**equal)).limit(cap + 1).agg(F.least(F.count("*"), F.lit(cap)).alias("selected"), (F.count("*") > cap).alias("overflow"))


LEVELS = {"debug": 10, "info": 20, "warning": 30, "error": 40, "critical": 50}


@query("P15_log_predicate", """SELECT id FROM v_activity_events WHERE CASE event_type WHEN 'error' THEN 40 WHEN 'signup' THEN 30 WHEN 'purchase' THEN 20 ELSE 10 END >= 30 AND CONTAINS(LOWER(metadata),'"k": 1')""")
def log_predicate(t: Tables) -> DataFrame:
    """Lines at or over a level that contain a text in any case."""
    level = F.when(F.col("event_type") == "error", LEVELS["error"]).when(F.col("event_type") == "signup", LEVELS["warning"]).when(F.col("event_type") == "purchase", LEVELS["info"]).otherwise(LEVELS["debug"])
    return t.activity_events.filter((level >= LEVELS["warning"]) & F.lower("metadata").contains('"k": 1')).select("id")


@query("P16_blocklisted", "SELECT id FROM v_source_files WHERE content_hash IN ('h1','h7') OR source_path IN (SELECT source_path FROM v_source_files WHERE dir_id = 5)")
def blocklisted(t: Tables) -> DataFrame:
    """Files blocked by hash or by path: two semi joins, not one join with OR."""
    hashes = t.spark.createDataFrame([("h1",), ("h7",)], "content_hash string")
    paths = t.source_files.filter("dir_id = 5").select("source_path")
    return t.source_files.join(hashes, "content_hash", "left_semi").select("id").union(t.source_files.join(paths, "source_path", "left_semi").select("id")).distinct()


#: Categories by extension.
CATEGORIES = {".pdf": "document", ".docx": "document", ".xlsx": "spreadsheet", ".png": "image", ".jpg": "image", ".mp4": "video", ".mp3": "audio", ".zip": "archive"}


@query("P17_category", "SELECT id, CASE file_ext WHEN '.pdf' THEN 'document' WHEN '.docx' THEN 'document' WHEN '.xlsx' THEN 'spreadsheet' WHEN '.png' THEN 'image' ELSE 'unknown' END AS category FROM v_source_files")
def category(t: Tables) -> DataFrame:
    table = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    return t.source_files.select("id", F.coalesce(F.try_element_at(table, F.lower("file_ext")), F.lit("unknown")).alias("category"))


@query("P18_under_root", "SELECT id FROM v_source_files WHERE STARTS_WITH(source_path,'/src/3/')")
def under_root(t: Tables, root: str = "/src/3") -> DataFrame:
    return t.source_files.filter(F.col("source_path").startswith(root.rstrip("/") + "/")).select("id")
