"""Scalar functions as column expressions (docspark.functions.text), applied to the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query
from ..sources.tables import Tables


@query("F01_normalize_filename")
def normalize_filename(t: Tables) -> DataFrame:
    name = F.concat(F.lit("My_"), F.initcap("source_format"), F.lit("Report-"), F.col("id").cast("string"), F.lit(".final.pdf"))
    return t.corpus.select("id", X.normalized_filename(name).alias("normalized"))


@query("F02_doc_id", "SELECT id, SUBSTR(SHA256(source_path),1,16) AS doc_key FROM v_source_files")
def doc_id(t: Tables) -> DataFrame:
    return t.source_files.select("id", X.short_hash(F.col("source_path")).alias("doc_key"))


@query("F03_content_hash", "SELECT id, SUBSTR(SHA256(LOWER(TRIM(REGEXP_REPLACE(content,'[ \\t\\n\\r\\f\\v]+',' ','g')))),1,16) AS content_hash FROM v_corpus")
def content_hash(t: Tables) -> DataFrame:
    return t.corpus.select("id", X.content_hash(F.col("content")).alias("content_hash"))


@query("F04_file_hash", "SELECT id, SHA256(content) AS file_hash FROM v_corpus")
def file_hash(t: Tables) -> DataFrame:
    return t.corpus.select("id", F.sha2("content", 256).alias("file_hash"))


@query("F05_point_id", "SELECT vec_id, SUBSTR(SHA256(doc_id||':'||MOD(vec_id,3)),1,16) AS point_id FROM v_vectors")
def point_id(t: Tables) -> DataFrame:
    """The first 64 bits of a chunk's hash, as 16 hex digits: an unsigned number doesn't fit a long."""
    return t.vectors.select("vec_id", X.short_hash(F.concat_ws(":", F.col("doc_id").cast("string"), (F.col("vec_id") % 3).cast("string"))).alias("point_id"))


@query("F06_headings", "SELECT id, ARRAY_TO_STRING(REGEXP_EXTRACT_ALL('# '||title||CHR(10)||content||CHR(10)||'## End','(?m)^#{1,3}[ ]+(.+)$',1),'|') AS headings FROM v_corpus")
def headings(t: Tables) -> DataFrame:
    markdown = F.concat(F.lit("# "), F.col("title"), F.lit("\n"), F.col("content"), F.lit("\n## End"))
    return t.corpus.select("id", F.array_join(X.headings(markdown), "|").alias("headings"))


@query("F07_strip_for_index", "SELECT id, REGEXP_REPLACE(REGEXP_REPLACE('---'||CHR(10)||'a: 1'||CHR(10)||'---'||CHR(10)||'![x](y) `code` '||title,'^---\\n(?s:.*?)\\n---\\n',''),'!\\[[^\\]]*\\]\\([^)]*\\)|`[^`]*`','','g') AS stripped FROM v_corpus")
def strip_for_index(t: Tables) -> DataFrame:
    return t.corpus.select("id", X.stripped(F.concat(F.lit("---\na: 1\n---\n![x](y) `code` "), F.col("title"))).alias("stripped"))


@query("F08_frontmatter", "SELECT id, title AS body, 'src' AS kind FROM v_corpus")
def frontmatter(t: Tables) -> DataFrame:
    text = F.concat(F.lit("---\nkind: src\n---\n"), F.col("title"))
    return t.corpus.select("id", X.without_frontmatter(text).alias("body"), X.frontmatter_value(text, "kind").alias("kind"))


@query("F09_title_fallback", "SELECT id, COALESCE(NULLIF(TRIM(title),''),source_format) AS title FROM v_corpus")
def title_fallback(t: Tables) -> DataFrame:
    return t.corpus.select("id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("source_format")).alias("title"))


@query("F09b_title_of_document", """WITH d AS (SELECT id, source_format AS stem, CASE lang WHEN 'en' THEN '---'||CHR(10)||'title: '||REPLACE(title,CHR(10),' ')||CHR(10)||'---'||CHR(10)||'# other' WHEN 'de' THEN 'text'||CHR(10)||'##  '||REPLACE(title,CHR(10),' ')||CHR(10)||'# later' ELSE title END AS md FROM v_corpus)
SELECT id, COALESCE(NULLIF(TRIM(REGEXP_EXTRACT(md,'^---\\n(?:[^\\n]*\\n)*?title:[ ]*([^\\n]*)\\n(?:[^\\n]*\\n)*?---',1)),''), NULLIF(TRIM(REGEXP_EXTRACT(md,'(?:^|\\n)#{1,3}[ \\t]+([^\\n]+)',1)),''), stem) AS title FROM d""")
def title_of_document(t: Tables) -> DataFrame:
    """The title that the front matter gives, else the first heading, else the file's name; the three kinds by language."""
    flat = F.replace(F.col("title"), F.lit("\n"), F.lit(" "))
    given = F.concat(F.lit("---\ntitle: "), flat, F.lit("\n---\n# other"))
    headed = F.concat(F.lit("text\n##  "), flat, F.lit("\n# later"))
    markdown = F.when(F.col("lang") == "en", given).when(F.col("lang") == "de", headed).otherwise(F.col("title"))
    return t.corpus.select("id", X.document_title(markdown, F.col("source_format")).alias("title"))


@query("F10_visual_lines", "SELECT id, ARRAY_TO_STRING(LIST_FILTER(STRING_SPLIT('*Visual: '||title||CHR(10)||content,CHR(10)), LAMBDA x: STARTS_WITH(x,'*Visual:')),'|') AS frames FROM v_corpus")
def visual_lines(t: Tables) -> DataFrame:
    lines = F.split(F.concat(F.lit("*Visual: "), F.col("title"), F.lit("\n"), F.col("content")), "\n")
    return t.corpus.select("id", F.array_join(F.filter(lines, lambda x: x.startswith("*Visual:")), "|").alias("frames"))


@query("F11_highlight", "SELECT id, REGEXP_REPLACE(SUBSTR(content,1,300),'(?i)(the)','<em>\\1</em>','g') AS highlighted, SUBSTR(content,1,500) AS preview FROM v_corpus")
def highlight(t: Tables) -> DataFrame:
    return t.corpus.select("id", X.highlighted(F.substring("content", 1, 300), "the").alias("highlighted"), F.substring("content", 1, 500).alias("preview"))


_OPENING_SQL = f"'(?i)^{X.either(X.OPENINGS)}'"
_TEMPORAL_SQL = f"'(?i){X.either(X.TEMPORAL)}'"
#: Queries of every kind: questions, quoted ones, single tokens, plain texts.
_QUERIES_SQL = "q AS (SELECT item_id, text, CASE MOD(item_id,5) WHEN 0 THEN 'what are the '||text WHEN 1 THEN 'Where does the latest '||text WHEN 2 THEN '\"'||text||'\"' WHEN 3 THEN REGEXP_EXTRACT(text,'[^ \\n\\t]+') ELSE text END AS query FROM benchmark)"


def queries_of(t: Tables) -> DataFrame:
    """(item_id, text, query)"""
    text, kind = F.col("text"), F.col("item_id") % 5
    asked = F.when(kind == 0, F.concat(F.lit("what are the "), text)).when(kind == 1, F.concat(F.lit("Where does the latest "), text))
    asked = asked.when(kind == 2, F.concat(F.lit('"'), text, F.lit('"'))).when(kind == 3, F.regexp_extract(text, r"[^ \n\t]+", 0)).otherwise(text)
    return t.raw("benchmark").select("item_id", "text", asked.alias("query"))


@query("F12_query_preprocess", f"WITH {_QUERIES_SQL} SELECT item_id, TRIM(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(query,'^\\s+',''),{_OPENING_SQL},''),'\\s+',' ','g')) AS normalized, REGEXP_MATCHES(query,{_TEMPORAL_SQL}) AS temporal FROM q")
def query_preprocess(t: Tables) -> DataFrame:
    q = F.col("query")
    return queries_of(t).select("item_id", X.preprocessed_query(q).alias("normalized"), X.asks_for_recent(q).alias("temporal"))


_KEYWORD_HITS_SQL = r"""h AS (SELECT item_id, query, COUNT(DISTINCT c.id) AS n_hits FROM q LEFT JOIN (SELECT DISTINCT id, UNNEST(REGEXP_SPLIT_TO_ARRAY(LOWER(content),'[^a-z0-9]+')) AS token FROM v_corpus) c ON c.token = REGEXP_EXTRACT(LOWER(query),'[a-z0-9]+') AND c.token <> '' GROUP BY 1,2)"""
_CONFIDENT_SQL = "n_hits > 0 AND ((STARTS_WITH(query,'\"') AND SUFFIX(query,'\"') AND LENGTH(query) > 2) OR (REGEXP_MATCHES(query,'^\\s*[^\\s]+\\s*$') AND n_hits >= 5))"


def keyword_hits(t: Tables) -> DataFrame:
    """(item_id, query, n_hits): documents with each query's first token. The corpus tokens are met by an equi-join before they are counted."""
    asked = queries_of(t).select("item_id", "query", F.regexp_extract(F.lower("query"), "[a-z0-9]+", 0).alias("token"))
    tokens = t.corpus.select("id", F.explode(F.array_distinct(F.split(F.lower("content"), "[^a-z0-9]+"))).alias("token")).filter("token <> ''")
    counts = tokens.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count_distinct("id").alias("n"))
    return asked.join(counts, "token", "left").select("item_id", "query", F.coalesce("n", F.lit(0)).alias("n_hits"))


@query("F13_keyword_confidence", f"WITH {_QUERIES_SQL}, {_KEYWORD_HITS_SQL} SELECT item_id, n_hits, {_CONFIDENT_SQL} AS confident FROM h")
def keyword_confidence(t: Tables) -> DataFrame:
    return keyword_hits(t).select("item_id", "n_hits", X.keyword_is_confident(F.col("query"), F.col("n_hits")).alias("confident"))


@query("F14_truncate_at_break", r"""WITH h AS (SELECT id, content, SUBSTR(content,1,400) AS head FROM v_corpus), p AS (SELECT *, CASE WHEN CONTAINS(head,CHR(10)||CHR(10)) THEN 399-INSTR(REVERSE(head),CHR(10)||CHR(10)) ELSE -1 END AS para, CASE WHEN CONTAINS(head,CHR(10)) THEN 400-INSTR(REVERSE(head),CHR(10)) ELSE -1 END AS line FROM h)
SELECT id, CASE WHEN LENGTH(content) <= 400 THEN content ELSE REGEXP_REPLACE(CASE WHEN para > 200 THEN SUBSTR(head,1,para) WHEN line > 200 THEN SUBSTR(head,1,line) ELSE head END,'\s+\z','') END AS clipped FROM p""")
def truncate_at_break(t: Tables) -> DataFrame:
    return t.corpus.select("id", X.truncated(F.col("content"), 400).alias("clipped"))


@query("F15_token_estimate", "SELECT id, CAST(LENGTH(content)//4 AS BIGINT) AS tokens FROM v_corpus")
def token_estimate(t: Tables) -> DataFrame:
    return t.corpus.select("id", F.expr("length(content) div 4").alias("tokens"))


@query("F16_text_quality", "SELECT id, letters >= 10 AND odd::DOUBLE/GREATEST(letters,1) > 0.3 AS suspect FROM (SELECT id, LENGTH(REGEXP_REPLACE(content,'[^\\pL]','','g')) AS letters, LENGTH(REGEXP_REPLACE(content,'[^\\pL]|[\\x00-\\x{24F}]','','g')) AS odd FROM v_corpus)")
def text_quality(t: Tables) -> DataFrame:
    """Whether over 30 % of at least ten letters lie beyond the Latin blocks."""
    letters, odd = F.length(F.regexp_replace("content", r"[^\p{L}]", "")), F.length(F.regexp_replace("content", r"[^\p{L}]|[\x00-\x{24F}]", ""))
    return t.corpus.select("id", ((letters >= 10) & (odd / F.greatest(letters, F.lit(1)) > 0.3)).alias("suspect"))


@query("F17_glyph_garbage", "SELECT l_orderkey, AVG(CASE WHEN x0 = 0 AND top = 0 THEN 1.0 ELSE 0.0 END) > 0.8 OR (COUNT(DISTINCT x0) = 1 AND COUNT(DISTINCT top) = 1) AS garbage FROM (SELECT l_orderkey, CASE WHEN MOD(l_orderkey,3) = 0 THEN 0 ELSE l_linenumber END AS x0, MOD(l_orderkey,2)*MOD(l_partkey,3) AS top FROM lineitem) GROUP BY 1")
def glyph_garbage(t: Tables) -> DataFrame:
    """Text layers whose glyphs stand at the origin (over 80 %) or all at one place; lines stand in for glyphs."""
    key = F.col("l_orderkey")
    glyphs = t.raw("lineitem").select("l_orderkey", F.when(key % 3 == 0, 0).otherwise(F.col("l_linenumber")).alias("x0"), (key % 2 * (F.col("l_partkey") % 3)).alias("top"))
    stacked = F.avg(F.when((F.col("x0") == 0) & (F.col("top") == 0), 1.0).otherwise(0.0)) > 0.8
    one = (F.min("x0") == F.max("x0")) & (F.min("top") == F.max("top"))
    return glyphs.groupBy("l_orderkey").agg((stacked | one).alias("garbage"))


@query("F19_redact_secrets", "SELECT id, CASE WHEN REGEXP_MATCHES(event_type,'(?i)(error|signup)') THEN '[REDACTED, '||LENGTH(metadata)||' chars]' ELSE metadata END AS shown FROM v_activity_events")
def redact(t: Tables) -> DataFrame:
    return t.activity_events.select("id", X.redacted(F.col("event_type"), F.col("metadata"), "(?i)(error|signup)").alias("shown"))


@query("F20_human_size", "SELECT id, CASE WHEN file_size_bytes < 1024 THEN file_size_bytes||' B' WHEN file_size_bytes < 1048576 THEN PRINTF('%.1f KB',ROUND(file_size_bytes/1024.0::DOUBLE,1)) ELSE PRINTF('%.1f MB',ROUND(file_size_bytes/1048576.0::DOUBLE,1)) END AS size FROM v_source_files")
def human_size(t: Tables) -> DataFrame:
    return t.source_files.select("id", X.human_size(F.col("file_size_bytes")).alias("size"))


@query("F21_timestamps", "SELECT history_id, segment_index, PRINTF('%02d:%02d:%02d',CAST(s//3600 AS INT),CAST(s%3600//60 AS INT),CAST(s%60 AS INT)) AS clock, PRINTF('%02d:%02d:%02d,%03d',CAST(s//3600 AS INT),CAST(s%3600//60 AS INT),CAST(s%60 AS INT),250) AS srt FROM (SELECT *, CAST(start_seconds AS BIGINT) AS s FROM v_transcript_segments)")
def timestamps(t: Tables) -> DataFrame:
    s = F.col("start_seconds")
    return t.transcript_segments.select("history_id", "segment_index", X.clock(s).alias("clock"), X.caption_time(s + 0.25, ",").alias("srt"))


@query("F22_eta_text", "SELECT id, CASE WHEN duration_ms < 1000 THEN 'finishing...' WHEN duration_ms < 60000 THEN '~'||duration_ms//1000||'s remaining' ELSE PRINTF('~%dm %02ds remaining',duration_ms//60000,duration_ms%60000//1000) END AS eta FROM v_conversion_history")
def eta_text(t: Tables) -> DataFrame:
    return t.conversion_history.select("id", X.eta_text(F.expr("duration_ms div 1000")).alias("eta"))


@query("F23_caption_seconds", "SELECT history_id, segment_index, start_seconds+0.25 AS seconds FROM v_transcript_segments")
def caption_seconds(t: Tables) -> DataFrame:
    return t.transcript_segments.select("history_id", "segment_index", X.seconds_of(X.caption_time(F.col("start_seconds") + 0.25, ".")).alias("seconds"))


@query("F24_strip_tags", "SELECT page_id, REGEXP_REPLACE(html,'<[^>]+>','','g') AS plain FROM pages")
def strip_tags(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", F.regexp_replace("html", "<[^>]+>", "").alias("plain"))


@query("F25_strip_markdown", "SELECT id, TRIM(REGEXP_REPLACE('## **'||title||'**','^#+ *|[*_`]+','','g')) AS plain FROM v_corpus")
def strip_markdown(t: Tables) -> DataFrame:
    return t.corpus.select("id", F.trim(F.regexp_replace(F.concat(F.lit("## **"), F.col("title"), F.lit("**")), "^#+ *|[*_`]+", "")).alias("plain"))


@query("F26_escape_pipes", "SELECT id, REPLACE(REPLACE(title,'|','\\|'),CHR(10),' ') AS cell FROM v_corpus")
def escape_pipes(t: Tables) -> DataFrame:
    return t.corpus.select("id", X.cell(F.col("title")).alias("cell"))


@query("F28_output_path", "SELECT id, '/out'||REGEXP_REPLACE(source_path,'\\.[^./]+$','.md') AS output_path, LENGTH(source_path) <= 240 AS fits FROM v_source_files")
def output_path(t: Tables) -> DataFrame:
    return t.source_files.select("id", F.concat(F.lit("/out"), F.regexp_replace("source_path", r"\.[^./]+$", ".md")).alias("output_path"), (F.length("source_path") <= 240).alias("fits"))


@query("F29_slug", "SELECT id, TRIM(REGEXP_REPLACE(LOWER(REPLACE(title,' ','-')),'[^a-z0-9-]','','g'),'-') AS slug FROM v_corpus")
def slug(t: Tables) -> DataFrame:
    return t.corpus.select("id", X.slug(F.col("title")).alias("slug"))


@query("F31_billing_cycle", "SELECT id, CAST(CASE WHEN DAY(timestamp) >= 15 THEN DATE_TRUNC('month',timestamp)+INTERVAL 14 DAYS ELSE DATE_TRUNC('month',timestamp)-INTERVAL 1 MONTH+INTERVAL 14 DAYS END AS DATE) AS cycle_start FROM v_activity_events")
def billing_cycle(t: Tables, day: int = 15) -> DataFrame:
    return t.activity_events.select("id", X.cycle_start(F.col("timestamp"), day).alias("cycle_start"))


@query("F32_business_hours", "SELECT id, ISODOW(timestamp) <= 5 AND HOUR(timestamp) BETWEEN 6 AND 17 AS busy FROM v_activity_events")
def business_hours(t: Tables) -> DataFrame:
    at = F.col("timestamp")
    return t.activity_events.select("id", ((F.weekday(at) < 5) & F.hour(at).between(6, 17)).alias("busy"))


@query("F33_worker_decision", """SELECT seq, CAST(LEAST(GREATEST(1,FLOOR((100-GREATEST(cpu,usual))*(CASE WHEN ISODOW(timestamp) <= 5 AND HOUR(timestamp) BETWEEN 6 AND 17 THEN 0.7::DOUBLE*0.7::DOUBLE ELSE 0.7::DOUBLE END)/15)),8) AS INT) AS workers
FROM (SELECT *, ROUND(AVG(cpu) OVER (PARTITION BY ISODOW(timestamp), HOUR(timestamp)),6) AS usual FROM v_system_metrics)""")
def worker_decision(t: Tables) -> DataFrame:
    return with_usual_load(t).select("seq", workers(F.col("cpu"), F.col("usual"), F.col("day_of_week"), F.col("hour")).alias("workers"))


def with_usual_load(t: Tables) -> DataFrame:
    """Metrics with the mean load of their hour of the week; 168 rows join back."""
    m = t.system_metrics.withColumn("day_of_week", F.weekday("timestamp")).withColumn("hour", F.hour("timestamp"))
    usual = m.groupBy("day_of_week", "hour").agg(F.round(F.avg("cpu"), 6).alias("usual"))
    return m.join(F.broadcast(usual), ["day_of_week", "hour"])


def workers(cpu: Column, usual: Column, day_of_week: Column, hour: Column, caution: float = 0.7, most: int = 8) -> Column:
    """Workers to start: one for each 15 % of the load that is free now and usually, held back by ``caution`` once, in business hours twice."""
    business = (day_of_week < 5) & hour.between(6, 17)
    free = (100 - F.greatest(cpu, usual)) * F.when(business, caution * caution).otherwise(caution)
    return F.least(F.greatest(F.lit(1), F.floor(free / 15)), F.lit(most)).cast("int")


def batch_size(discovered: Column, requests: Column, day_of_week: Column, hour: Column, caution: float = 0.7) -> Column:
    """Files to convert now: more at night and out of business hours, fewer where users are active."""
    business, quiet = (day_of_week < 5) & hour.between(6, 17), requests < 10
    base = F.when((hour < 5) & quiet, 500).when(~business, 250).when(quiet, 100).otherwise(50)
    return F.least(F.greatest(F.lit(1), F.floor(F.least(base, discovered) * caution)), discovered).cast("int")


@query("F34_blended_rate", "SELECT provider_id, model, ROUND((input_rate+output_rate)/2,6) AS blended FROM v_rates")
def blended_rate(t: Tables) -> DataFrame:
    return t.rates.select("provider_id", "model", F.round((F.col("input_rate") + F.col("output_rate")) / 2, 6).alias("blended"))


@query("F35_time_parts", "SELECT id, CAST(HOUR(timestamp) AS INT) AS hour, STRFTIME(timestamp,'%Y-%m-%d %H:00') AS bucket, timestamp >= (SELECT MAX(timestamp) FROM v_activity_events)-INTERVAL 24 HOURS AS recent FROM v_activity_events")
def time_parts(t: Tables) -> DataFrame:
    now = t.activity_events.agg(F.max("timestamp").alias("now"))
    at = F.col("timestamp")
    return t.activity_events.join(F.broadcast(now)).select("id", F.hour(at).alias("hour"), F.date_format(at, "yyyy-MM-dd HH:00").alias("bucket"), (at >= F.col("now") - F.expr("INTERVAL 24 HOURS")).alias("recent"))


@query("F36_staleness", "SELECT id, DATE_DIFF('day',CAST(source_mtime AS DATE),(SELECT CAST(MAX(source_mtime) AS DATE) FROM v_source_files)) > 90 AS stale FROM v_source_files")
def staleness(t: Tables, days: int = 90) -> DataFrame:
    now = t.source_files.agg(F.max("source_mtime").alias("now"))
    return t.source_files.join(F.broadcast(now)).select("id", (F.datediff("now", "source_mtime") > days).alias("stale"))


@query("F37_cosine", "SELECT a.doc_id, ROUND(LIST_COSINE_SIMILARITY(a.embedding,b.embedding),6) AS cos FROM v_vectors a JOIN v_vectors b ON a.doc_id = b.doc_id AND MOD(a.vec_id,3) = 0 AND MOD(b.vec_id,3) = 1")
def cosine_of_neighbours(t: Tables) -> DataFrame:
    from .search import cosine

    a = t.vectors.filter("vec_id % 3 = 0").select("doc_id", F.col("embedding").alias("a"))
    b = t.vectors.filter("vec_id % 3 = 1").select("doc_id", F.col("embedding").alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("cos"))


@query("F38_eta_confidence", "SELECT event_type, CASE WHEN COUNT(*) >= 50 THEN 'high' WHEN COUNT(*) >= 10 THEN 'medium' ELSE 'low' END AS confidence FROM v_activity_events GROUP BY 1")
def eta_confidence(t: Tables) -> DataFrame:
    n = F.count("*")
    return t.activity_events.groupBy("event_type").agg(F.when(n >= 50, "high").when(n >= 10, "medium").otherwise("low").alias("confidence"))


@query("F39_media_type", "SELECT id, CASE WHEN file_ext = '.png' THEN 'image' WHEN file_ext IN ('.mp4','.mov') THEN 'video' ELSE 'other' END AS media_type FROM v_source_files")
def media_type(t: Tables) -> DataFrame:
    e = F.lower("file_ext")
    return t.source_files.select("id", F.when(e.isin(".png", ".jpg"), "image").when(e.isin(".mp4", ".mov"), "video").otherwise("other").alias("media_type"))


@query("F40_mask", "SELECT id, CASE WHEN LENGTH(content_hash) <= 3 THEN REPEAT('*',LENGTH(content_hash)) ELSE REPEAT('*',LENGTH(content_hash)-2)||RIGHT(content_hash,2) END AS masked FROM v_source_files")
def masked(t: Tables) -> DataFrame:
    return t.source_files.select("id", X.masked(F.col("content_hash"), 2, 3).alias("masked"))


@query("F41_log_levels", "SELECT id, CASE event_type WHEN 'error' THEN 40 WHEN 'signup' THEN 30 ELSE 20 END AS level FROM v_activity_events")
def log_levels(t: Tables) -> DataFrame:
    k = F.col("event_type")
    return t.activity_events.select("id", F.when(k == "error", 40).when(k == "signup", 30).otherwise(20).alias("level"))


@query("F42_magic_bytes", "SELECT id, CASE WHEN STARTS_WITH(content,'%PDF') THEN 'application/pdf' WHEN STARTS_WITH(content,'T') THEN 'text/t' ELSE 'text/plain' END AS mime FROM v_corpus")
def magic_bytes(t: Tables) -> DataFrame:
    return t.corpus.select("id", X.mime_of(F.col("content").cast("binary"), {b"%PDF": "application/pdf", b"T": "text/t"}, "text/plain").alias("mime"))


@query("F43_archive_safety", "SELECT job_id, COUNT(*) > 700 AS too_many, SUM(file_size_bytes) > 20000000 AS too_large FROM v_bulk_files GROUP BY 1")
def archive_safety(t: Tables, entries: int = 700, size: int = 20_000_000) -> DataFrame:
    return t.bulk_files.groupBy("job_id").agg((F.count("*") > entries).alias("too_many"), (F.sum("file_size_bytes") > size).alias("too_large"))


# Folders in each other, members, bytes taken out, and bytes out for each byte in, that an archive may have.
MOST_DEPTH, MOST_MEMBERS, MOST_BYTES, MOST_RATIO = 20, 100_000, 50 << 30, 200


def archive_verdict(depth: Column, members: Column, unpacked: Column, packed: Column, limits: tuple = (MOST_DEPTH, MOST_MEMBERS, MOST_BYTES, MOST_RATIO)) -> Column:
    """The first rule that an archive breaks: depth, members, size or ratio; ok without one. Nothing packed has no ratio."""
    return F.when(depth > limits[0], "depth").when(members > limits[1], "members").when(unpacked > limits[2], "size").when(unpacked > limits[3] * F.greatest(packed, F.lit(0)), F.when(packed > 0, "ratio").otherwise("ok")).otherwise("ok")


@query("F43b_archive_verdict", """WITH m AS (SELECT source_file_id AS id, MAX(LENGTH(source_path)-LENGTH(REPLACE(source_path,'/','')))-1 AS depth, COUNT(*) AS members, SUM(file_size_bytes) AS unpacked FROM v_bulk_files GROUP BY 1)
SELECT m.id, depth, members, CASE WHEN depth > 2 THEN 'depth' WHEN members > 6 THEN 'members' WHEN unpacked > 300000 THEN 'size' WHEN f.file_size_bytes > 0 AND unpacked > f.file_size_bytes*1.5 THEN 'ratio' ELSE 'ok' END AS verdict FROM m JOIN v_source_files f ON f.id = m.id""")
def archives(t: Tables) -> DataFrame:
    """Files as archives of what was made of them, under limits that some of them break."""
    path = F.col("source_path")
    members = t.bulk_files.groupBy(F.col("source_file_id").alias("id")).agg(
        (F.max(F.length(path) - F.length(F.replace(path, F.lit("/")))) - 1).alias("depth"), F.count("*").alias("members"), F.sum("file_size_bytes").alias("unpacked")
    )
    both = members.join(t.source_files.select("id", F.col("file_size_bytes").alias("packed")), "id")
    return both.select("id", "depth", "members", archive_verdict(F.col("depth"), F.col("members"), F.col("unpacked"), F.col("packed"), (2, 6, 300_000, 1.5)).alias("verdict"))
