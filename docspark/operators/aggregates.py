"""Roll-ups over the corpus tables: counts, rates, histograms, time buckets, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.tables import Tables
from ..streaming.monitors import own_folder
from .windows import numbered


def zero_filled(counts: DataFrame, key: str, values: list[str]) -> DataFrame:
    """counts (key, n) for exactly these values, 0 where one has no rows."""
    known = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return known.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def share(condition: Column, digits: int = 1) -> Column:
    """Percentage of rows that meet the condition."""
    return F.round(F.avg(F.when(condition, 100.0).otherwise(0.0)), digits)


QUEUE_STATES = ["pending", "batched", "completed", "failed"]


@query("A01_status_counts", """SELECT s.status, COUNT(q.id) AS n FROM (VALUES ('pending'),('batched'),('completed'),('failed')) s(status)
LEFT JOIN v_analysis_queue q ON q.status = s.status GROUP BY 1""")
def status_counts(t: Tables) -> DataFrame:
    return zero_filled(t.analysis_queue.groupBy("status").agg(F.count("*").alias("n")), "status", QUEUE_STATES)


@query("A01b_flag_counts", "SELECT status, COUNT(*) AS n FROM v_file_flags GROUP BY 1")
def flag_counts(t: Tables) -> DataFrame:
    return t.file_flags.groupBy("status").agg(F.count("*").alias("n"))


@query("A02_lifecycle_breakdown", "SELECT lifecycle_status, COUNT(*) AS n, SUM(file_size_bytes) AS bytes FROM v_source_files GROUP BY 1")
def lifecycle_breakdown(t: Tables) -> DataFrame:
    return t.source_files.groupBy("lifecycle_status").agg(F.count("*").alias("n"), F.sum("file_size_bytes").alias("bytes"))


@query("A03_top_formats", "SELECT source_format, COUNT(*) AS n FROM v_conversion_history WHERE status = 'success' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top_formats(t: Tables) -> DataFrame:
    return t.conversion_history.filter("status = 'success'").groupBy("source_format").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_format").limit(10)


@query("A04_success_rate", "SELECT ROUND(AVG(CASE WHEN status = 'success' THEN 100.0::DOUBLE ELSE 0 END),1) AS success_rate FROM v_conversion_history")
def success_rate(t: Tables) -> DataFrame:
    return t.conversion_history.agg(share(F.col("status") == "success").alias("success_rate"))


@query("A05_history_stats", """SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'success') AS ok, ROUND(AVG(CASE WHEN status = 'success' THEN 100.0::DOUBLE ELSE 0 END),1) AS rate,
SUM(duration_ms) // COUNT(*) AS avg_ms, COUNT(*) FILTER (ocr_confidence < 70) AS below_threshold, COUNT(ocr_confidence) AS with_ocr FROM v_conversion_history""")
def history_stats(t: Tables, threshold: float = 70) -> DataFrame:
    ok = F.col("status") == "success"
    return t.conversion_history.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("ok"), share(ok).alias("rate"), F.expr("sum(duration_ms) div count(*)").alias("avg_ms"),
        F.count_if(F.col("ocr_confidence") < threshold).alias("below_threshold"), F.count("ocr_confidence").alias("with_ocr"),
    )


@query("A05b_most_used_format", "SELECT source_format, COUNT(*) AS n FROM v_conversion_history GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def most_used_format(t: Tables) -> DataFrame:
    return t.conversion_history.groupBy("source_format").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_format").limit(1)


@query("A06_debug_stats", """SELECT source_format, SUM(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS errors, ROUND(AVG(duration_ms),4) AS avg_ms, SUM(CASE WHEN ocr_confidence IS NOT NULL THEN 1 ELSE 0 END) AS ocr_pages
FROM v_conversion_history GROUP BY 1""")
def debug_stats(t: Tables) -> DataFrame:
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return t.conversion_history.groupBy("source_format").agg(one(F.col("status") == "error").alias("errors"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"), one(F.col("ocr_confidence").isNotNull()).alias("ocr_pages"))


@query("A07_ocr_histogram", """SELECT b.bucket, COUNT(h.id) AS n FROM (SELECT UNNEST(RANGE(10)) AS bucket) b LEFT JOIN (SELECT id, LEAST(CAST(FLOOR(ocr_confidence/10) AS BIGINT),9) AS bucket FROM v_conversion_history
WHERE ocr_confidence IS NOT NULL) h ON h.bucket = b.bucket GROUP BY 1""")
def ocr_histogram(t: Tables) -> DataFrame:
    bucket = F.least(F.floor(F.col("ocr_confidence") / 10), F.lit(9)).cast("long")
    counts = t.conversion_history.filter("ocr_confidence is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return t.spark.range(10).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query("A08_ocr_timeline", """SELECT CAST(created_at AS DATE) AS day, ROUND(AVG(ocr_confidence),1) AS avg_conf, ROUND(MIN(ocr_confidence),1) AS min_conf, ROUND(MAX(ocr_confidence),1) AS max_conf, COUNT(*) AS n
FROM v_conversion_history WHERE ocr_confidence IS NOT NULL GROUP BY 1""")
def ocr_timeline(t: Tables) -> DataFrame:
    c = F.col("ocr_confidence")
    return t.conversion_history.filter(c.isNotNull()).groupBy(F.to_date("created_at").alias("day")).agg(F.round(F.avg(c), 1).alias("avg_conf"), F.round(F.min(c), 1).alias("min_conf"), F.round(F.max(c), 1).alias("max_conf"), F.count("*").alias("n"))


#: Resolutions of a metric series, in seconds.
RESOLUTIONS = {"raw": 0, "1m": 60, "5m": 300, "15m": 900, "1h": 3600, "6h": 21600}


def downsample(metrics: DataFrame, seconds: int) -> DataFrame:
    """Averages and peaks by time bucket."""
    bucket = F.window(F.col("timestamp").cast("timestamp"), f"{seconds} seconds").start.cast("timestamp_ntz")
    return metrics.groupBy(bucket.alias("bucket")).agg(F.round(F.avg("cpu"), 6).alias("cpu_avg"), F.max("cpu").alias("cpu_max"), F.max("rss_bytes").alias("rss_max"), F.count("*").alias("samples"))


def _downsample_sql(seconds: int) -> str:
    return f"SELECT TIME_BUCKET(INTERVAL {seconds} SECONDS, timestamp, TIMESTAMP '1970-01-01') AS bucket, ROUND(AVG(cpu),6) AS cpu_avg, MAX(cpu) AS cpu_max, MAX(rss_bytes) AS rss_max, COUNT(*) AS samples FROM v_system_metrics GROUP BY 1"


for _name, _seconds in RESOLUTIONS.items():
    if _seconds:
        query(f"A09_downsample_{_name}", _downsample_sql(_seconds))(lambda t, s=_seconds: downsample(t.system_metrics, s))


def rolled_up(metrics: DataFrame, seconds: int, k: int = 400) -> DataFrame:
    """A roll-up that can be rolled up again: sums, numbers, peaks and a mergeable quantile sketch of cpu by time bucket. k sets the sketch's rank error, about 1.3 / k ** 0.9."""
    bucket = F.window(F.col("timestamp").cast("timestamp"), f"{seconds} seconds").start.cast("timestamp_ntz")
    cpu = F.col("cpu").cast("double")
    return metrics.groupBy(bucket.alias("bucket")).agg(F.sum("cpu").alias("cpu_sum"), F.count("cpu").alias("cpu_n"), F.max("cpu").alias("cpu_max"), F.max("rss_bytes").alias("rss_max"), F.count("*").alias("samples"), F.kll_sketch_agg_double(cpu, k).alias("cpu_sketch"))


def coarser(rollup: DataFrame, seconds: int) -> DataFrame:
    """A roll-up of a finer one, whose buckets must fit into these; the raw samples aren't read."""
    bucket = F.window(F.col("bucket").cast("timestamp"), f"{seconds} seconds").start.cast("timestamp_ntz")
    return rollup.groupBy(bucket.alias("bucket")).agg(F.sum("cpu_sum").alias("cpu_sum"), F.sum("cpu_n").alias("cpu_n"), F.max("cpu_max").alias("cpu_max"), F.max("rss_max").alias("rss_max"), F.sum("samples").alias("samples"), F.kll_merge_agg_double("cpu_sketch").alias("cpu_sketch"))


@query("A09b_rollup_chain", "SELECT TIME_BUCKET(INTERVAL 6 HOURS, timestamp, TIMESTAMP '1970-01-01') AS bucket, ROUND(SUM(cpu),4) AS cpu_sum, COUNT(cpu) AS cpu_n, MAX(cpu) AS cpu_max, MAX(rss_bytes) AS rss_max, COUNT(*) AS samples FROM v_system_metrics GROUP BY 1")
def rollup_chain(t: Tables) -> DataFrame:
    """Six-hour buckets out of stored one-hour ones out of stored one-minute ones."""
    folder, rows = own_folder(t.spark, "rollups"), rolled_up(t.system_metrics, RESOLUTIONS["1m"])
    for name in ("1m", "1h"):
        rows.write.parquet(f"{folder}/{name}")
        rows = coarser(t.spark.read.parquet(f"{folder}/{name}"), RESOLUTIONS["1h" if name == "1m" else "6h"])
    return rows.select("bucket", F.round("cpu_sum", 4).alias("cpu_sum"), "cpu_n", "cpu_max", "rss_max", "samples")


def index_percentile(rows: DataFrame, key: str, value: str, share: float, name: str, accuracy: int = 10_000) -> DataFrame:
    """(key, name): for each key the element at int(n * share) of its sorted values, the definition that the roll-ups use, exactly.

    A mergeable sketch, whose rank error is at most n / accuracy, brackets the element; values
    below the bracket are counted, and only those in it are put in order, equal ones as one row.
    """
    some = rows.select(key, value).filter(F.col(value).isNotNull())
    edge = lambda s: F.percentile_approx(value, F.lit(min(max(s, 0.0), 1.0)), F.lit(accuracy))
    marks = some.groupBy(key).agg(F.count("*").alias("n"), edge(share - 2 / accuracy).alias("lo"), edge(share + 2 / accuracy).alias("hi"), F.min(value).alias("least"), F.max(value).alias("most"))
    lo = F.when(F.lit(share <= 2 / accuracy), F.col("least")).otherwise(F.col("lo"))
    hi = F.when(F.lit(share >= 1 - 2 / accuracy), F.col("most")).otherwise(F.col("hi"))
    marks = marks.select(F.col(key).alias("key_"), F.floor(F.col("n") * share).alias("wanted"), lo.alias("lo"), hi.alias("hi"))
    near = some.join(marks, F.col(key).eqNullSafe(F.col("key_"))).filter(F.col(value) <= F.col("hi"))
    counted = near.groupBy(key, F.when(F.col(value) >= F.col("lo"), F.col(value)).alias("x"), "wanted").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("upto", upto).filter("x is not null and upto > wanted").groupBy(key).agg(F.min("x").alias(name))


@query("A10_hourly_rollup", """SELECT DATE_TRUNC('hour',timestamp) AS hour_bucket, ROUND(AVG(cpu),6) AS cpu_avg, MAX(cpu) AS cpu_max, LIST_SORT(LIST(cpu))[CAST(FLOOR(COUNT(*)*0.95) AS BIGINT)+1] AS cpu_p95,
SUM(bulk_active) AS busy, COUNT(*) AS samples FROM v_system_metrics GROUP BY 1""")
def hourly_rollup(t: Tables) -> DataFrame:
    m = t.system_metrics.withColumn("hour_bucket", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    sums = m.groupBy("hour_bucket").agg(F.round(F.avg("cpu"), 6).alias("cpu_avg"), F.max("cpu").alias("cpu_max"), F.sum("bulk_active").alias("busy"), F.count("*").alias("samples"))
    return sums.join(index_percentile(m, "hour_bucket", "cpu", 0.95, "cpu_p95"), "hour_bucket").select("hour_bucket", "cpu_avg", "cpu_max", "cpu_p95", "busy", "samples")


@query("A11_hour_of_week_profile", """SELECT CAST(ISODOW(timestamp)-1 AS INT) AS day_of_week, CAST(HOUR(timestamp) AS INT) AS hour, ROUND(AVG(cpu),6) AS cpu_avg, COUNT(*) AS samples FROM v_system_metrics GROUP BY 1,2""")
def hour_of_week(t: Tables) -> DataFrame:
    return t.system_metrics.groupBy(F.weekday("timestamp").alias("day_of_week"), F.hour("timestamp").alias("hour")).agg(F.round(F.avg("cpu"), 6).alias("cpu_avg"), F.count("*").alias("samples"))


@query("A12_executive_summary", """SELECT COUNT(*)*120/3600.0::DOUBLE AS uptime_hours, ROUND(AVG(cpu),6) AS cpu_avg, MAX(cpu) AS cpu_peak, LIST_SORT(LIST(cpu))[CAST(FLOOR(COUNT(*)*0.95) AS BIGINT)+1] AS cpu_p95,
ROUND(AVG(cpu) FILTER (bulk_active = 0),6) AS idle_baseline, MAX(rss_bytes) AS rss_max FROM v_system_metrics""")
def executive_summary(t: Tables, sample_seconds: int = 120) -> DataFrame:
    m = t.system_metrics.withColumn("all", F.lit(1))
    sums = m.groupBy("all").agg(
        (F.count("*") * sample_seconds / 3600.0).alias("uptime_hours"), F.round(F.avg("cpu"), 6).alias("cpu_avg"), F.max("cpu").alias("cpu_peak"),
        F.round(F.avg(F.when(F.col("bulk_active") == 0, F.col("cpu"))), 6).alias("idle_baseline"), F.max("rss_bytes").alias("rss_max"),
    )
    return sums.join(index_percentile(m, "all", "cpu", 0.95, "cpu_p95"), "all").select("uptime_hours", "cpu_avg", "cpu_peak", "cpu_p95", "idle_baseline", "rss_max")


@query("A12b_memory_stability", """WITH r AS (SELECT rss_bytes, NTILE(10) OVER (ORDER BY timestamp, seq) AS tile FROM v_system_metrics), a AS (SELECT AVG(rss_bytes) FILTER (tile = 1) AS first_avg, AVG(rss_bytes) FILTER (tile = 10) AS last_avg FROM r)
SELECT ROUND(first_avg,3) AS first_avg, ROUND(last_avg,3) AS last_avg, last_avg <= first_avg*1.2 AS stable FROM a""")
def memory_stability(t: Tables) -> DataFrame:
    """Whether the last tenth of the time-ordered samples uses at most a fifth more than the first."""
    n = t.system_metrics.count()
    big, small = -(-n // 10) if n % 10 else n // 10, n // 10
    mean = lambda tile: F.avg(F.when(tile, F.col("rss_bytes")))
    rows = numbered(t.system_metrics.select("timestamp", "seq", "rss_bytes"), "timestamp", "seq")
    means = rows.agg(mean(F.col("place") < big).alias("first_avg"), mean(F.col("place") >= n - small).alias("last_avg"))
    return means.select(F.round("first_avg", 3).alias("first_avg"), F.round("last_avg", 3).alias("last_avg"), (F.col("last_avg") <= F.col("first_avg") * 1.2).alias("stable"))


@query("A13_trend", """SELECT ROUND((ARG_MAX(rss_bytes,seq)-ARG_MIN(rss_bytes,seq))/(EPOCH(MAX(timestamp)-MIN(timestamp))/86400.0),4) AS bytes_per_day FROM v_system_metrics""")
def trend(t: Tables) -> DataFrame:
    days = (F.unix_micros(F.max("timestamp").cast("timestamp")) - F.unix_micros(F.min("timestamp").cast("timestamp"))) / 86400e6
    return t.system_metrics.agg(F.round((F.max_by("rss_bytes", "seq") - F.min_by("rss_bytes", "seq")) / days, 4).alias("bytes_per_day"))


@query("A14_hourly_throughput", """SELECT CAST(h.hour AS INT) AS hour, COUNT(a.id) AS n FROM (SELECT UNNEST(RANGE(24)) AS hour) h LEFT JOIN v_activity_events a ON HOUR(a.timestamp) = h.hour AND a.timestamp > (SELECT MAX(timestamp) FROM v_activity_events) - INTERVAL 24 HOURS GROUP BY 1""")
def hourly_throughput(t: Tables) -> DataFrame:
    now = t.activity_events.agg(F.max("timestamp").alias("now"))
    recent = t.activity_events.join(F.broadcast(now), F.col("timestamp") > F.col("now") - F.expr("INTERVAL 24 HOURS"))
    counts = recent.groupBy(F.hour("timestamp").alias("hour")).agg(F.count("*").alias("n"))
    return t.spark.range(24).select(F.col("id").cast("int").alias("hour")).join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


@query("A15_activity_pulse", "SELECT COUNT(*) FILTER (status = 'pending') AS queued, COUNT(*) FILTER (status = 'batched') AS running, COUNT(DISTINCT user_id) AS users, MAX(enqueued_at) AS last_seen FROM v_analysis_queue")
def activity_pulse(t: Tables) -> DataFrame:
    s = F.col("status")
    return t.analysis_queue.agg(F.count_if(s == "pending").alias("queued"), F.count_if(s == "batched").alias("running"), F.countDistinct("user_id").alias("users"), F.max("enqueued_at").alias("last_seen"))


def pipeline_funnel(files: DataFrame, runs: DataFrame, queue: DataFrame) -> DataFrame:
    """(stage, n): where active files stand on their way through conversion and analysis."""
    active = files.filter("lifecycle_status = 'active'")
    done = runs.filter("status = 'converted'").select("source_path").distinct()
    tries = runs.join(done, "source_path", "left_anti")
    one = lambda stage, df, n=F.count("*"): df.agg(n.alias("n")).select(F.lit(stage).alias("stage"), "n")
    paths = F.countDistinct("source_path")
    parts = [
        one("scanned", active),
        one("pending_conversion", active.join(done, "source_path", "left_anti")),
        one("failed", tries.filter("status = 'failed'"), paths),
        one("unrecognized", tries.filter("status = 'unrecognized'"), paths),
        one("pending_analysis", queue.filter("status = 'pending'")),
        one("batched_for_analysis", queue.filter("status = 'batched'")),
        one("analysis_failed", queue.filter("status = 'failed'")),
        one("indexed", active.join(done, "source_path", "left_semi")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("A16_pipeline_funnel", """WITH done AS (SELECT DISTINCT source_path FROM v_bulk_files WHERE status = 'converted'), act AS (SELECT * FROM v_source_files WHERE lifecycle_status = 'active'),
tries AS (SELECT * FROM v_bulk_files b WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.source_path = b.source_path))
SELECT 'scanned' AS stage, COUNT(*) AS n FROM act UNION ALL SELECT 'pending_conversion', COUNT(*) FROM act WHERE source_path NOT IN (SELECT source_path FROM done)
UNION ALL SELECT 'failed', COUNT(DISTINCT source_path) FROM tries WHERE status = 'failed' UNION ALL SELECT 'unrecognized', COUNT(DISTINCT source_path) FROM tries WHERE status = 'unrecognized'
UNION ALL SELECT 'pending_analysis', COUNT(*) FROM v_analysis_queue WHERE status = 'pending' UNION ALL SELECT 'batched_for_analysis', COUNT(*) FROM v_analysis_queue WHERE status = 'batched'
UNION ALL SELECT 'analysis_failed', COUNT(*) FROM v_analysis_queue WHERE status = 'failed' UNION ALL SELECT 'indexed', COUNT(*) FROM act WHERE source_path IN (SELECT source_path FROM done)""")
def funnel(t: Tables) -> DataFrame:
    return pipeline_funnel(t.source_files, t.bulk_files, t.analysis_queue)


@query("A17_token_totals", "SELECT provider_id, model, COUNT(*) AS n, COALESCE(SUM(tokens_used),0) AS tokens, ROUND(AVG(tokens_used),4) AS avg_tokens FROM v_analysis_queue WHERE status = 'completed' GROUP BY 1,2")
def token_totals(t: Tables) -> DataFrame:
    return t.analysis_queue.filter("status = 'completed'").groupBy("provider_id", "model").agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"), F.round(F.avg("tokens_used"), 4).alias("avg_tokens"))


@query("A18_batch_rollup", """SELECT batch_id, COUNT(*) AS n, COUNT(*) FILTER (status = 'completed') AS done, COALESCE(SUM(tokens_used) FILTER (status = 'completed'),0) AS tokens, MIN(enqueued_at) FILTER (status = 'completed') AS first_done, MAX(enqueued_at) FILTER (status = 'completed') AS last_done,
CASE WHEN BOOL_OR(status = 'failed') THEN 'failed' WHEN BOOL_OR(status = 'batched') THEN 'batched' WHEN BOOL_AND(status = 'completed') THEN 'completed' ELSE 'mixed' END AS batch_status
FROM v_analysis_queue WHERE batch_id IS NOT NULL AND status <> 'excluded' GROUP BY 1""")
def batch_rollup(t: Tables) -> DataFrame:
    s, done = F.col("status"), F.col("status") == "completed"
    only = lambda c: F.when(done, F.col(c))
    state = F.when(F.bool_or(s == "failed"), "failed").when(F.bool_or(s == "batched"), "batched").when(F.bool_and(done), "completed").otherwise("mixed")
    return t.analysis_queue.filter("batch_id is not null and status <> 'excluded'").groupBy("batch_id").agg(
        F.count("*").alias("n"), F.count_if(done).alias("done"), F.coalesce(F.sum(only("tokens_used")), F.lit(0)).alias("tokens"), F.min(only("enqueued_at")).alias("first_done"), F.max(only("enqueued_at")).alias("last_done"), state.alias("batch_status")
    )


@query("A19_user_usage", "SELECT user_id, COUNT(*) AS calls, COALESCE(SUM(tokens_used),0) AS tokens, MAX(enqueued_at) AS last_used FROM v_analysis_queue GROUP BY 1")
def user_usage(t: Tables) -> DataFrame:
    return t.analysis_queue.groupBy("user_id").agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"), F.max("enqueued_at").alias("last_used"))


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows with input_rate and output_rate: those of (provider, model), else of (provider, '*'), else null. The rate table has a row for each priced model."""
    exact = rates.filter("model <> '*'")
    wild = rates.filter("model = '*'").select("provider_id", F.col("input_rate").alias("any_in"), F.col("output_rate").alias("any_out"))
    found = rows.join(exact, ["provider_id", "model"], "left").join(wild, "provider_id", "left")
    return found.withColumn("input_rate", F.coalesce("input_rate", "any_in")).withColumn("output_rate", F.coalesce("output_rate", "any_out")).drop("any_in", "any_out")


def blended_cost(tokens: Column) -> Column:
    """Cost at half input and half output rates, for tokens in millions."""
    return tokens / 1e6 * (F.col("input_rate") + F.col("output_rate")) / 2


_PRICED = """priced AS (SELECT q.*, COALESCE(e.input_rate,w.input_rate) AS input_rate, COALESCE(e.output_rate,w.output_rate) AS output_rate FROM v_analysis_queue q LEFT JOIN v_rates e ON e.provider_id = q.provider_id AND e.model = q.model
LEFT JOIN v_rates w ON w.provider_id = q.provider_id AND w.model = '*')"""


@query("A20_batch_cost", f"""WITH {_PRICED}, filled AS (SELECT batch_id, input_rate, output_rate, COALESCE(tokens_used, AVG(tokens_used) OVER (PARTITION BY batch_id)) AS tokens, tokens_used IS NULL AS guessed FROM priced WHERE batch_id IS NOT NULL)
SELECT batch_id, COUNT(*) AS files, COUNT(*) FILTER (guessed) AS guessed, ROUND(SUM(tokens),3) AS tokens, ROUND(SUM(tokens/1e6*(input_rate+output_rate)/2),4) AS cost FROM filled GROUP BY 1""")
def batch_cost(t: Tables) -> DataFrame:
    priced = with_rates(t.analysis_queue.filter("batch_id is not null"), t.rates)
    filled = priced.withColumn("tokens", F.coalesce(F.col("tokens_used").cast("double"), F.avg("tokens_used").over(Window.partitionBy("batch_id"))))
    return filled.groupBy("batch_id").agg(F.count("*").alias("files"), F.count_if(F.col("tokens_used").isNull()).alias("guessed"), F.round(F.sum("tokens"), 3).alias("tokens"), F.round(F.sum(blended_cost(F.col("tokens"))), 4).alias("cost"))


#: Cost of a group's tokens, which are whole numbers and so summed exactly before they are priced.
_COST = "SUM(tokens_used)/1e6*(MAX(input_rate)+MAX(output_rate))/2"


def group_cost() -> Column:
    return F.sum("tokens_used") / 1e6 * (F.max("input_rate") + F.max("output_rate")) / 2


@query("A21_billing_cycle_cost", f"""WITH {_PRICED} SELECT provider_id, model, COUNT(*) AS calls, SUM(tokens_used) AS tokens, ROUND({_COST},6) AS cost, ROUND({_COST}/20*31,6) AS projected
FROM priced WHERE enqueued_at >= TIMESTAMP '2024-01-01' AND enqueued_at < TIMESTAMP '2024-01-21' AND tokens_used IS NOT NULL GROUP BY 1,2""")
def billing_cycle_cost(t: Tables, start: str = "2024-01-01", days_into: int = 20, days_total: int = 31) -> DataFrame:
    begin = F.lit(start).cast("timestamp_ntz")
    rows = t.analysis_queue.filter((F.col("enqueued_at") >= begin) & (F.col("enqueued_at") < begin + F.make_interval(days=F.lit(days_into))) & F.col("tokens_used").isNotNull())
    return with_rates(rows, t.rates).groupBy("provider_id", "model").agg(F.count("*").alias("calls"), F.sum("tokens_used").alias("tokens"), F.round(group_cost(), 6).alias("cost"), F.round(group_cost() / days_into * days_total, 6).alias("projected"))


@query("A22_daily_cost", f"""WITH {_PRICED} SELECT CAST(enqueued_at AS DATE) AS day, provider_id, model, SUM(tokens_used) AS tokens, ROUND({_COST},6) AS cost FROM priced
WHERE enqueued_at > (SELECT MAX(enqueued_at) FROM v_analysis_queue) - INTERVAL 14 DAYS AND tokens_used IS NOT NULL GROUP BY 1,2,3""")
def daily_cost(t: Tables, days: int = 14) -> DataFrame:
    now = t.analysis_queue.agg(F.max("enqueued_at").alias("now"))
    rows = t.analysis_queue.filter("tokens_used is not null").join(F.broadcast(now), F.col("enqueued_at") > F.col("now") - F.make_interval(days=F.lit(days)))
    return with_rates(rows, t.rates).groupBy(F.to_date("enqueued_at").alias("day"), "provider_id", "model").agg(F.sum("tokens_used").alias("tokens"), F.round(group_cost(), 6).alias("cost"))


@query("A23_cross_ref_stats", "SELECT COUNT(DISTINCT project_id) AS projects, COUNT(*) AS refs, COUNT(DISTINCT media_path) AS media FROM v_media_refs")
def cross_ref_stats(t: Tables) -> DataFrame:
    return t.media_refs.agg(F.countDistinct("project_id").alias("projects"), F.count("*").alias("refs"), F.countDistinct("media_path").alias("media"))


@query("A23b_top_media", "SELECT media_path, COUNT(DISTINCT project_id) AS n FROM v_media_refs GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def top_media(t: Tables) -> DataFrame:
    return t.media_refs.groupBy("media_path").agg(F.countDistinct("project_id").alias("n")).orderBy(F.desc("n"), "media_path").limit(5)


@query("A24_latest_ref_per_project", "SELECT project_id, media_type, MAX(media_path) AS last_path FROM v_media_refs GROUP BY 1,2")
def latest_ref(t: Tables) -> DataFrame:
    return t.media_refs.groupBy("project_id", "media_type").agg(F.max("media_path").alias("last_path"))


@query("A25_unrecognized_stats", "SELECT file_ext, GROUPING(file_ext) AS all_ext, COUNT(*) AS n, SUM(file_size_bytes) AS bytes, COUNT(DISTINCT job_id) AS jobs FROM v_bulk_files WHERE status = 'unrecognized' GROUP BY GROUPING SETS ((file_ext),())")
def unrecognized_stats(t: Tables) -> DataFrame:
    """By extension and in all, in one pass of grouping sets."""
    return t.bulk_files.filter("status = 'unrecognized'").rollup("file_ext").agg(F.grouping("file_ext").cast("long").alias("all_ext"), F.count("*").alias("n"), F.sum("file_size_bytes").alias("bytes"), F.countDistinct("job_id").alias("jobs"))


@query("A26_ocr_gaps", "SELECT COUNT(*) AS n, MIN(created_at) AS oldest FROM v_conversion_history WHERE ocr_confidence IS NULL AND status = 'success'")
def ocr_gaps(t: Tables) -> DataFrame:
    return t.conversion_history.filter("ocr_confidence is null and status = 'success'").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))


@query("A27_path_issue_summary", """SELECT CASE WHEN LENGTH(source_path) > 18 THEN 'too_long' ELSE 'ok' END AS issue_type, COUNT(*) AS n FROM v_source_files GROUP BY 1""")
def path_issues(t: Tables, longest: int = 18) -> DataFrame:
    return t.source_files.groupBy(F.when(F.length("source_path") > longest, "too_long").otherwise("ok").alias("issue_type")).agg(F.count("*").alias("n"))


@query("A28_distinct_models", "SELECT provider_id, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT model)),',') AS models FROM v_analysis_queue WHERE provider_id IS NOT NULL GROUP BY 1")
def distinct_models(t: Tables) -> DataFrame:
    return t.analysis_queue.filter("provider_id is not null").groupBy("provider_id").agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


@query("A29_next_version", "SELECT f.id, COALESCE(COUNT(b.id),0)+1 AS next_version FROM v_source_files f LEFT JOIN v_bulk_files b ON b.source_file_id = f.id AND b.status = 'converted' GROUP BY 1")
def next_version(t: Tables) -> DataFrame:
    versions = t.bulk_files.filter("status = 'converted'").groupBy(F.col("source_file_id").alias("id")).agg(F.count("*").alias("v"))
    return t.source_files.select("id").join(versions, "id", "left").select("id", (F.coalesce("v", F.lit(0)) + 1).alias("next_version"))


@query("A30_file_eta", """WITH l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_format ORDER BY created_at DESC, id DESC, duration_ms DESC, file_size_bytes DESC) AS rn FROM v_conversion_history WHERE status = 'success')
SELECT source_format, ROUND(AVG(duration_ms),4) AS avg_ms, ROUND(AVG(file_size_bytes),4) AS avg_bytes, COUNT(*) AS n FROM l WHERE rn <= 50 GROUP BY 1""")
def file_eta(t: Tables) -> DataFrame:
    """Mean duration and size of each format's last 50 successes."""
    last = Window.partitionBy("source_format").orderBy(F.desc("created_at"), F.desc("id"), F.desc("duration_ms"), F.desc("file_size_bytes"))
    return t.conversion_history.filter("status = 'success'").withColumn("rn", F.row_number().over(last)).filter("rn <= 50").groupBy("source_format").agg(F.round(F.avg("duration_ms"), 4).alias("avg_ms"), F.round(F.avg("file_size_bytes"), 4).alias("avg_bytes"), F.count("*").alias("n"))


@query("A31_latency_classes", """SELECT source_format, MEDIAN(duration_ms) AS med, ROUND(STDDEV_SAMP(duration_ms),4) AS sd, ROUND(STDDEV_SAMP(duration_ms)/AVG(duration_ms),4) AS cv,
CASE WHEN MEDIAN(duration_ms) < 1000 THEN 'fast' WHEN STDDEV_SAMP(duration_ms)/AVG(duration_ms) > 0.5 THEN 'erratic' ELSE 'slow' END AS class FROM v_conversion_history GROUP BY 1""")
def latency_classes(t: Tables) -> DataFrame:
    d = "duration_ms"
    cv = F.stddev_samp(d) / F.avg(d)
    return t.conversion_history.groupBy("source_format").agg(F.median(d).alias("med"), F.round(F.stddev_samp(d), 4).alias("sd"), F.round(cv, 4).alias("cv"), F.when(F.median(d) < 1000, "fast").when(cv > 0.5, "erratic").otherwise("slow").alias("class"))


@query("A32_batch_manifest", """SELECT job_id, COUNT(*) AS files, COUNT(*) FILTER (status = 'converted') AS converted, COUNT(*) FILTER (status = 'failed') AS failed, SUM(file_size_bytes) AS bytes, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT file_ext)),' ') AS formats FROM v_bulk_files GROUP BY 1""")
def batch_manifest(t: Tables) -> DataFrame:
    s = F.col("status")
    return t.bulk_files.groupBy("job_id").agg(F.count("*").alias("files"), F.count_if(s == "converted").alias("converted"), F.count_if(s == "failed").alias("failed"), F.sum("file_size_bytes").alias("bytes"), F.array_join(F.array_sort(F.collect_set("file_ext")), " ").alias("formats"))


@query("A33_facets", "SELECT source_format, COUNT(*) AS n FROM v_corpus WHERE CONTAINS(LOWER(content),'the') GROUP BY 1")
def facets(t: Tables, term: str = "the") -> DataFrame:
    return t.corpus.filter(F.lower("content").contains(term)).groupBy("source_format").agg(F.count("*").alias("n"))


@query("A34_collisions", "SELECT content_hash, COUNT(*) AS n, MIN(source_path) AS first_path FROM v_source_files GROUP BY 1 HAVING COUNT(*) > 1")
def collisions(t: Tables) -> DataFrame:
    return t.source_files.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("source_path").alias("first_path")).filter("n > 1")


@query("A34b_case_collisions", "SELECT LOWER(w) AS folded, COUNT(DISTINCT w) AS spellings FROM (SELECT REGEXP_EXTRACT(text,'[^ \\n\\t]+') AS w FROM documents) GROUP BY 1 HAVING COUNT(DISTINCT w) > 1")
def case_collisions(t: Tables) -> DataFrame:
    """Names (here first words) that differ in nothing but case."""
    name = F.regexp_extract("text", r"[^ \n\t]+", 0)
    return t.raw("documents").groupBy(F.lower(name).alias("folded")).agg(F.countDistinct(name).alias("spellings")).filter("spellings > 1")


@query("A35_index_stats", "SELECT 'documents' AS index_name, COUNT(*) AS n FROM v_corpus UNION ALL SELECT 'transcripts', COUNT(DISTINCT history_id) FROM v_transcript_segments UNION ALL SELECT 'pages', COUNT(*) FROM pages")
def index_stats(t: Tables) -> DataFrame:
    one = lambda name, df, n: df.agg(n.alias("n")).select(F.lit(name).alias("index_name"), "n")
    return one("documents", t.corpus, F.count("*")).unionByName(one("transcripts", t.transcript_segments, F.countDistinct("history_id"))).unionByName(one("pages", t.raw("pages"), F.count("*")))


@query("A36_disk_usage", "SELECT CASE WHEN file_ext IN ('.pdf','.docx') THEN 'documents' WHEN file_ext = '.png' THEN 'images' ELSE 'other' END AS component, SUM(file_size_bytes) AS bytes, COUNT(*) AS files FROM v_source_files GROUP BY 1")
def disk_usage(t: Tables) -> DataFrame:
    component = F.when(F.col("file_ext").isin(".pdf", ".docx"), "documents").when(F.col("file_ext") == ".png", "images").otherwise("other")
    return t.source_files.groupBy(component.alias("component")).agg(F.sum("file_size_bytes").alias("bytes"), F.count("*").alias("files"))


@query("A37_structural_hash", """WITH s AS (SELECT doc_id, CAST(LENGTH(text)-LENGTH(REPLACE(text,CHR(10),'')) AS BIGINT) AS breaks, LENGTH(text) AS chars FROM documents) SELECT doc_id, SHA256('{"breaks": '||breaks||', "chars": '||chars||'}') AS structure FROM s""")
def structural_hash(t: Tables) -> DataFrame:
    """Hash of a document's shape as JSON with sorted keys."""
    breaks = F.length("text") - F.length(F.regexp_replace("text", "\n", ""))
    return t.raw("documents").select("doc_id", F.sha2(F.concat(F.lit('{"breaks": '), breaks.cast("string"), F.lit(', "chars": '), F.length("text").cast("string"), F.lit("}")), 256).alias("structure"))
