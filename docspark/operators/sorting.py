"""Sorts, limits and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import Tables


def page(df: DataFrame, order: list, number: int, per_page: int) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


@query("O01_page", "SELECT id, created_at FROM v_conversion_history ORDER BY created_at DESC, id, duration_ms, file_size_bytes LIMIT 25 OFFSET 50")
def history_page(t: Tables) -> DataFrame:
    return page(t.conversion_history, [F.desc("created_at"), "id", "duration_ms", "file_size_bytes"], 3, 25).select("id", "created_at")


@query("O01b_page_count", "SELECT COUNT(*) AS total, CAST(CEIL(COUNT(*)/25.0) AS BIGINT) AS pages FROM v_conversion_history")
def page_count(t: Tables, per_page: int = 25) -> DataFrame:
    return t.conversion_history.agg(F.count("*").alias("total"), F.ceil(F.count("*") / per_page).alias("pages"))


@query("O02_newest", "SELECT id, enqueued_at FROM v_analysis_queue ORDER BY enqueued_at DESC, id DESC LIMIT 10")
def newest(t: Tables) -> DataFrame:
    return t.analysis_queue.orderBy(F.desc("enqueued_at"), F.desc("id")).limit(10).select("id", "enqueued_at")


@query("O03_multi_key", "SELECT DISTINCT project_id, media_path, media_type FROM v_media_refs ORDER BY 1,2,3 LIMIT 100")
def multi_key(t: Tables) -> DataFrame:
    return t.media_refs.select("project_id", "media_path", "media_type").distinct().orderBy("project_id", "media_path", "media_type").limit(100)


@query("O04_nulls_first", "SELECT id, tokens_used FROM v_analysis_queue ORDER BY tokens_used ASC NULLS FIRST, id LIMIT 30")
def nulls_first(t: Tables) -> DataFrame:
    return t.analysis_queue.orderBy(F.asc_nulls_first("tokens_used"), "id").limit(30).select("id", "tokens_used")


@query("O05_last_matches", "SELECT id FROM v_activity_events WHERE event_type = 'error' ORDER BY id DESC LIMIT 20 OFFSET 10")
def last_matches(t: Tables) -> DataFrame:
    return t.activity_events.filter("event_type = 'error'").orderBy(F.desc("id")).offset(10).limit(20).select("id")


@query("O07_vector_top_k", "WITH q AS (SELECT embedding AS e FROM v_vectors WHERE vec_id = 0) SELECT vec_id, ROUND(LIST_COSINE_SIMILARITY(embedding,(SELECT e FROM q)),6) AS score FROM v_vectors ORDER BY LIST_COSINE_SIMILARITY(embedding,(SELECT e FROM q)) DESC, vec_id LIMIT 10")
def vector_top_k(t: Tables, k: int = 10) -> DataFrame:
    from .search import stored_vectors, vector

    return stored_vectors(t).exact(vector(t, 0), k).select("vec_id", F.round("score", 6).alias("score"))


@query("O08_search_sort", "SELECT id FROM v_corpus WHERE CONTAINS(LOWER(content),'and') ORDER BY file_size_bytes DESC, id LIMIT 20")
def search_sort(t: Tables) -> DataFrame:
    return t.corpus.filter(F.lower("content").contains("and")).orderBy(F.desc("file_size_bytes"), "id").limit(20).select("id")


@query("O09_first_and_last_items", """WITH w AS (SELECT doc_id, STRING_SPLIT(text,' ') AS w FROM documents) SELECT doc_id, ARRAY_TO_STRING(CASE WHEN LEN(w) > 7 THEN w[1:5]||w[LEN(w)-1:LEN(w)] ELSE w END,' ') AS sample FROM w""")
def first_and_last(t: Tables) -> DataFrame:
    w = F.split("text", " ")
    return t.raw("documents").select("doc_id", F.array_join(F.when(F.size(w) > 7, F.concat(F.slice(w, 1, 5), F.slice(w, -2, 2))).otherwise(w), " ").alias("sample"))


@query("O10_capped_listing", "SELECT source_path FROM v_source_files WHERE dir_id = 7 ORDER BY source_path LIMIT 200")
def capped_listing(t: Tables) -> DataFrame:
    return t.source_files.filter("dir_id = 7").orderBy("source_path").limit(200).select("source_path")


@query("O11_claim", "SELECT id FROM v_analysis_queue WHERE status = 'pending' ORDER BY enqueued_at, id LIMIT 50")
def claim(t: Tables, n: int = 50) -> DataFrame:
    return t.analysis_queue.filter("status = 'pending'").orderBy("enqueued_at", "id").limit(n).select("id")
