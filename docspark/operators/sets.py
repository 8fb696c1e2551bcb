"""Unions, differences and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.tables import Tables


def first_per(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("rn_ = 1").drop("rn_")


@query("U01_status_union", """SELECT source_path, stage FROM (SELECT source_path, 'scanned' AS stage FROM v_source_files WHERE lifecycle_status = 'active' UNION ALL SELECT source_path, 'trash' FROM v_source_files WHERE lifecycle_status = 'in_trash'
UNION ALL SELECT source_path, 'failed' FROM v_bulk_files WHERE status = 'failed' UNION ALL SELECT source_path, 'pending' FROM v_bulk_files WHERE status = 'pending' UNION ALL SELECT source_path, 'skipped' FROM v_bulk_files WHERE status = 'skipped') ORDER BY source_path, stage LIMIT 500""")
def status_union(t: Tables) -> DataFrame:
    branch = lambda df, where, stage: df.filter(where).select("source_path", F.lit(stage).alias("stage"))
    out = branch(t.source_files, "lifecycle_status = 'active'", "scanned").unionByName(branch(t.source_files, "lifecycle_status = 'in_trash'", "trash"))
    for s in ("failed", "pending", "skipped"):
        out = out.unionByName(branch(t.bulk_files, f"status = '{s}'", s))
    return out.orderBy("source_path", "stage").limit(500)


@query("U02_concatenated_hits", "SELECT CAST(id AS VARCHAR) AS id, title, 'documents' AS source_index FROM v_corpus WHERE CONTAINS(content,'the ') UNION ALL SELECT history_id||':'||segment_index, CAST(NULL AS VARCHAR), 'transcripts' FROM v_transcript_segments WHERE CONTAINS(text,'the ')")
def concatenated_hits(t: Tables) -> DataFrame:
    a = t.corpus.filter(F.col("content").contains("the ")).select(F.col("id").cast("string").alias("id"), "title", F.lit("documents").alias("source_index"))
    b = t.transcript_segments.filter(F.col("text").contains("the ")).select(F.concat_ws(":", F.col("history_id").cast("string"), F.col("segment_index").cast("string")).alias("id"), F.lit("transcripts").alias("source_index"))
    return a.unionByName(b, allowMissingColumns=True)


@query("U03_stale_ids", "SELECT DISTINCT source_file_id AS id FROM v_bulk_files EXCEPT SELECT id FROM v_source_files WHERE lifecycle_status = 'active'")
def stale_ids(t: Tables) -> DataFrame:
    return t.bulk_files.select(F.col("source_file_id").alias("id")).subtract(t.source_files.filter("lifecycle_status = 'active'").select("id"))


@query("U04_id_union", "SELECT source_file_id AS id FROM v_file_flags UNION SELECT source_file_id FROM v_analysis_queue")
def id_union(t: Tables) -> DataFrame:
    return t.file_flags.select(F.col("source_file_id").alias("id")).union(t.analysis_queue.select("source_file_id")).distinct()


@query("U05_dedup_titles", "SELECT id, title FROM v_corpus QUALIFY ROW_NUMBER() OVER (PARTITION BY LOWER(title) ORDER BY id) = 1")
def dedup_titles(t: Tables) -> DataFrame:
    return first_per(t.corpus.withColumn("k", F.lower("title")), "k", "id").select("id", "title")


@query("U06_dedup_paths", "SELECT id, source_path FROM v_bulk_files WHERE source_file_id <> 'sf1' QUALIFY ROW_NUMBER() OVER (PARTITION BY source_path ORDER BY id) = 1")
def dedup_paths(t: Tables) -> DataFrame:
    return first_per(t.bulk_files.filter("source_file_id <> 'sf1'"), "source_path", "id").select("id", "source_path")
