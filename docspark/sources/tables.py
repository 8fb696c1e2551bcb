"""The corpus tables, adapted from the tables at hand.

Each property is a DataFrame with the columns of one corpus table; SQL holds the
same definition for the oracle engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches, ship


def text(*parts) -> Column:
    """Concatenation; strings are literals."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def pick(number: Column, *values: str) -> Column:
    """values[number], the last one for anything else."""
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(number == i, v).otherwise(out)
    return out


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)
        bound_batches(spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def source_files(self) -> DataFrame:
        key = F.col("o_orderkey")
        ext = pick(key % 5, ".pdf", ".docx", ".xlsx", ".png", ".txt")
        return self.raw("orders").select(
            text("sf", key).alias("id"), ext.alias("file_ext"), text("/src/", F.col("o_custkey"), "/", key, ext).alias("source_path"),
            F.floor("o_totalprice").cast("long").alias("file_size_bytes"), F.col("o_orderdate").alias("source_mtime"),
            text("h", key % 1000).alias("content_hash"), pick(key % 10, "marked_for_deletion", "in_trash", "purged", "active").alias("lifecycle_status"),
            F.col("o_custkey").alias("dir_id"),
        )

    @cached_property
    def bulk_jobs(self) -> DataFrame:
        started = self.raw("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min("l_shipdate").alias("started_at"))
        jobs = self.raw("supplier").join(started, "s_suppkey", "left")
        return jobs.select(text("job", F.col("s_suppkey")).alias("id"), pick(F.col("s_suppkey") % 4, "running", "failed", "completed").alias("status"), "started_at")

    @cached_property
    def bulk_files(self) -> DataFrame:
        l, key = self.raw("lineitem"), F.col("l_orderkey")
        ext = pick(key % 5, ".pdf", ".docx", ".xlsx", ".png", ".txt")
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        l = l.join(orders, l.l_orderkey == orders.o_orderkey)
        return l.select(
            text("bf", key, "-", F.col("l_linenumber"), "-", F.col("l_partkey"), "-", F.col("l_suppkey"), "-", F.col("l_quantity").cast("long")).alias("id"),
            text("job", F.col("l_suppkey")).alias("job_id"), text("sf", key).alias("source_file_id"), text("/src/", F.col("o_custkey"), "/", key, ext).alias("source_path"), ext.alias("file_ext"),
            F.floor("l_extendedprice").cast("long").alias("file_size_bytes"),
            pick((F.col("l_partkey") + F.col("l_linenumber")) % 8, "converted", "failed", "unrecognized", "skipped", "pending").alias("status"), F.col("l_shipdate").alias("converted_at"),
        )

    @cached_property
    def analysis_queue(self) -> DataFrame:
        e, kind = self.raw("events"), F.col("event_type")
        status = F.when(kind == "click", "completed").when(kind == "purchase", "batched").when(kind == "error", "failed").when(kind == "signup", "excluded").otherwise("pending")
        provider = F.when(F.col("event_id") % 3 == 0, "p0").when(F.col("event_id") % 3 == 1, "p1")
        return e.select(
            text("aq", F.col("event_id")).alias("id"), F.when(kind != "view", text("b", F.col("user_id"))).alias("batch_id"), status.alias("status"),
            F.when(kind == "click", F.floor(F.col("value") * 1000).cast("long")).alias("tokens_used"), provider.alias("provider_id"), text("m", F.col("event_id") % 2).alias("model"),
            F.col("ts").alias("enqueued_at"), text("sf", F.col("event_id") % 2000).alias("source_file_id"), F.col("user_id"), (F.col("event_id") % 4).cast("long").alias("retry_count"),
        )

    @cached_property
    def conversion_history(self) -> DataFrame:
        l, key = self.raw("lineitem"), F.col("l_orderkey")
        return l.select(
            text(key, "-", F.col("l_linenumber"), "-", F.col("l_partkey")).alias("id"), pick(key % 5, "pdf", "docx", "xlsx", "png", "txt").alias("source_format"),
            F.when(F.col("l_returnflag") == "R", "error").otherwise("success").alias("status"), (F.col("l_quantity") * 100).cast("long").alias("duration_ms"),
            F.when(F.col("l_partkey") % 3 != 0, F.col("l_discount") * 1000).alias("ocr_confidence"), F.col("l_shipdate").alias("created_at"),
            F.floor("l_extendedprice").cast("long").alias("file_size_bytes"), text("u", F.col("l_suppkey") % 20).alias("user_id"),
        )

    @cached_property
    def system_metrics(self) -> DataFrame:
        return self.raw("events").select(F.col("ts").alias("timestamp"), F.col("value").alias("cpu"), (F.col("event_id") * 1000).alias("rss_bytes"), (F.col("event_type") == "click").cast("int").alias("bulk_active"), F.col("event_id").alias("seq"))

    @cached_property
    def activity_events(self) -> DataFrame:
        return self.raw("events").select(F.col("event_id").alias("id"), "event_type", F.col("props").alias("metadata"), F.col("value").alias("duration_seconds"), F.col("ts").alias("timestamp"), "user_id")

    @cached_property
    def corpus(self) -> DataFrame:
        d, l = self.raw("documents"), self.raw("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        return d.join(l, "doc_id", "left").select(
            F.col("doc_id").alias("id"), F.col("text").alias("content"), F.substring("text", 1, 60).alias("title"), F.col("source").alias("source_format"), "lang",
            F.col("n_chars").alias("file_size_bytes"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_flagged"),
        )

    @cached_property
    def file_flags(self) -> DataFrame:
        l = self.raw("labels")
        status = F.when(F.col("toxic") == 1, "active").when(F.col("quality") == 0, "dismissed").otherwise("expired")
        return l.select(text("fl", F.col("doc_id")).alias("id"), text("sf", F.col("doc_id") + 1).alias("source_file_id"), status.alias("status"), pick(F.col("doc_id") % 3, "pii", "confidential", "other").alias("reason"), F.col("doc_id").alias("n"))

    @cached_property
    def transcript_segments(self) -> DataFrame:
        start = F.col("turn") * F.lit(10.0)
        return self.raw("conversations").select(F.col("conv_id").alias("history_id"), F.col("turn").alias("segment_index"), start.alias("start_seconds"), (start + 10).alias("end_seconds"), F.col("role").alias("speaker"), "text")

    @cached_property
    def media_refs(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("project_id"), text("/m/", F.col("l_partkey")).alias("media_path"), F.col("l_linestatus").alias("media_type"))

    @cached_property
    def snapshot(self) -> DataFrame:
        """A later scan of source_files: some files gone, some touched, some moved under the same hash."""
        o = self.source_files.withColumn("key", F.substring("id", 3, 20).cast("long")).filter("key % 17 <> 0")
        moved = F.col("key") % 19 == 0
        return o.select(F.when(moved, text("/moved", F.col("source_path"))).otherwise(F.col("source_path")).alias("source_path"), F.when((F.col("key") % 13 == 0) & ~moved, F.col("source_mtime") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("source_mtime")).alias("source_mtime"), "file_size_bytes", text("u", F.col("key")).alias("file_key"), "content_hash")

    @cached_property
    def registry(self) -> DataFrame:
        """source_files with a hash of their own each, for move detection."""
        return self.source_files.withColumn("file_key", text("u", F.substring("id", 3, 20)))

    @cached_property
    def rates(self) -> DataFrame:
        return self.spark.createDataFrame([("p0", "m0", 3.0, 15.0), ("p0", "m1", 0.25, 1.25), ("p1", "*", 5.0, 20.0)], "provider_id string, model string, input_rate double, output_rate double")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select("vec_id", F.floor(F.col("vec_id") / 3.0).cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), pick(F.col("label") % 4, "pdf", "docx", "txt", "html").alias("source_format"))


_EXT = "CASE MOD(o_orderkey,5) WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.png' ELSE '.txt' END"

#: The same tables for the oracle engine.
SQL: dict[str, str] = {
    "v_source_files": f"SELECT 'sf'||o_orderkey AS id, {_EXT} AS file_ext, '/src/'||o_custkey||'/'||o_orderkey||{_EXT} AS source_path, CAST(FLOOR(o_totalprice) AS BIGINT) AS file_size_bytes, o_orderdate AS source_mtime, 'h'||MOD(o_orderkey,1000) AS content_hash, CASE MOD(o_orderkey,10) WHEN 0 THEN 'marked_for_deletion' WHEN 1 THEN 'in_trash' WHEN 2 THEN 'purged' ELSE 'active' END AS lifecycle_status, o_custkey AS dir_id FROM orders",
    "v_bulk_jobs": "SELECT 'job'||s_suppkey AS id, CASE MOD(s_suppkey,4) WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'completed' END AS status, started_at FROM supplier LEFT JOIN (SELECT l_suppkey, MIN(l_shipdate) AS started_at FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey",
    "v_bulk_files": f"SELECT 'bf'||l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey||'-'||CAST(l_quantity AS BIGINT) AS id, 'job'||l_suppkey AS job_id, 'sf'||l_orderkey AS source_file_id, '/src/'||o_custkey||'/'||o_orderkey||{_EXT} AS source_path, {_EXT} AS file_ext, CAST(FLOOR(l_extendedprice) AS BIGINT) AS file_size_bytes, CASE MOD(l_partkey+l_linenumber,8) WHEN 0 THEN 'converted' WHEN 1 THEN 'failed' WHEN 2 THEN 'unrecognized' WHEN 3 THEN 'skipped' ELSE 'pending' END AS status, l_shipdate AS converted_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "v_analysis_queue": "SELECT 'aq'||event_id AS id, CASE WHEN event_type <> 'view' THEN 'b'||user_id END AS batch_id, CASE event_type WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'batched' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'excluded' ELSE 'pending' END AS status, CASE WHEN event_type = 'click' THEN CAST(FLOOR(value*1000) AS BIGINT) END AS tokens_used, CASE MOD(event_id,3) WHEN 0 THEN 'p0' WHEN 1 THEN 'p1' END AS provider_id, 'm'||MOD(event_id,2) AS model, ts AS enqueued_at, 'sf'||MOD(event_id,2000) AS source_file_id, user_id, MOD(event_id,4) AS retry_count FROM events",
    "v_conversion_history": "SELECT l_orderkey||'-'||l_linenumber||'-'||l_partkey AS id, CASE MOD(l_orderkey,5) WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'png' ELSE 'txt' END AS source_format, CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'success' END AS status, CAST(l_quantity*100 AS BIGINT) AS duration_ms, CASE WHEN MOD(l_partkey,3) <> 0 THEN l_discount*1000 END AS ocr_confidence, l_shipdate AS created_at, CAST(FLOOR(l_extendedprice) AS BIGINT) AS file_size_bytes, 'u'||MOD(l_suppkey,20) AS user_id FROM lineitem",
    "v_system_metrics": "SELECT ts AS timestamp, value AS cpu, event_id*1000 AS rss_bytes, CAST(event_type = 'click' AS INT) AS bulk_active, event_id AS seq FROM events",
    "v_activity_events": "SELECT event_id AS id, event_type, props AS metadata, value AS duration_seconds, ts AS timestamp, user_id FROM events",
    "v_corpus": "SELECT d.doc_id AS id, text AS content, SUBSTR(text,1,60) AS title, source AS source_format, lang, n_chars AS file_size_bytes, COALESCE(toxic = 1, FALSE) AS is_flagged FROM documents d LEFT JOIN (SELECT doc_id, MAX(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id",
    "v_file_flags": "SELECT 'fl'||doc_id AS id, 'sf'||(doc_id+1) AS source_file_id, CASE WHEN toxic = 1 THEN 'active' WHEN quality = 0 THEN 'dismissed' ELSE 'expired' END AS status, CASE MOD(doc_id,3) WHEN 0 THEN 'pii' WHEN 1 THEN 'confidential' ELSE 'other' END AS reason, doc_id AS n FROM labels",
    "v_transcript_segments": "SELECT conv_id AS history_id, turn AS segment_index, CAST(turn*10.0 AS DOUBLE) AS start_seconds, CAST(turn*10.0+10 AS DOUBLE) AS end_seconds, role AS speaker, text FROM conversations",
    "v_media_refs": "SELECT l_orderkey AS project_id, '/m/'||l_partkey AS media_path, l_linestatus AS media_type FROM lineitem",
    "v_registry": "SELECT *, 'u'||SUBSTR(id,3) AS file_key FROM v_source_files",
    "v_snapshot": "SELECT CASE WHEN MOD(k,19) = 0 THEN '/moved'||source_path ELSE source_path END AS source_path, CASE WHEN MOD(k,13) = 0 AND MOD(k,19) <> 0 THEN source_mtime + INTERVAL 1 DAY ELSE source_mtime END AS source_mtime, file_size_bytes, 'u'||k AS file_key, content_hash FROM (SELECT *, CAST(SUBSTR(id,3) AS BIGINT) AS k FROM v_source_files) WHERE MOD(k,17) <> 0",
    "v_rates": "SELECT * FROM (VALUES ('p0','m0',3.0::DOUBLE,15.0::DOUBLE),('p0','m1',0.25,1.25),('p1','*',5.0,20.0)) AS t(provider_id, model, input_rate, output_rate)",
    "v_vectors": "SELECT vec_id, CAST(FLOOR(vec_id/3.0) AS BIGINT) AS doc_id, CAST(embedding AS DOUBLE[]) AS embedding, CASE MOD(label,4) WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'txt' ELSE 'html' END AS source_format FROM embeddings",
}
