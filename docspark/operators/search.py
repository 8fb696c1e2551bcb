"""Keyword, vector and hybrid search over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..registry import query
from ..sources.tables import Tables
from ..streaming.monitors import own_folder
from .postings_index import Index, index_of
from .vector_index import VectorIndex, vector_index_of
from .scalars import _CONFIDENT_SQL, _KEYWORD_HITS_SQL, _QUERIES_SQL, _TEMPORAL_SQL, keyword_hits


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


_TOKENS = "tok AS (SELECT id, UNNEST(REGEXP_SPLIT_TO_ARRAY(LOWER(content),'[^a-z0-9]+')) AS token FROM v_corpus), post AS (SELECT token, id, COUNT(*) AS tf FROM tok WHERE token <> '' GROUP BY 1,2)"
_HITS = f"{_TOKENS}, hits AS (SELECT id, COUNT(*) AS words, SUM(tf) AS tf FROM post WHERE token IN ('the','thing') GROUP BY 1)"
TERMS = ("the", "thing")


def corpus_index(t: Tables) -> Index:
    """The stored index of the corpus."""
    return index_of(t.spark, f"{t.sf_dir}/documents.parquet", t.corpus)


@query("Q01_keyword_search", f"WITH {_HITS} SELECT h.id, words, tf, title FROM hits h JOIN v_corpus c ON c.id = h.id WHERE NOT is_flagged ORDER BY words DESC, tf DESC, h.id LIMIT 20")
def keyword_search(t: Tables, terms=TERMS, k: int = 20, where: str = "not is_flagged") -> DataFrame:
    """The best documents by terms held and occurrences, out of the buckets and blocks that can hold them."""
    return corpus_index(t).top(list(terms), k, F.expr(where)).select("id", "words", "tf", "title")


_RULES = """WITH d AS (SELECT id, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(LOWER(title),'[^a-z0-9]+'), LAMBDA x: x <> '') AS a, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(LOWER(content),'[^a-z0-9]+'), LAMBDA x: x <> '') AS b FROM v_corpus),
w AS (SELECT id, UNNEST(a) AS token, UNNEST(RANGE(LEN(a))) AS pos FROM d UNION ALL SELECT id, UNNEST(b), UNNEST(RANGE(LEN(b))) + 1099511627776 FROM d),
q AS (SELECT place, term, token, LEVENSHTEIN(term, token) AS typos FROM (SELECT DISTINCT token FROM w), (VALUES (0,'the'),(1,'thing')) t(place, term) WHERE LEVENSHTEIN(term, token) <= CASE WHEN LEN(term) >= 9 THEN 2 WHEN LEN(term) >= 5 THEN 1 ELSE 0 END),
m AS (SELECT id, place, typos, pos FROM w JOIN q USING (token)),
e AS (SELECT id, place, MIN(typos) AS typos, MIN(pos) AS first FROM m GROUP BY 1, 2),
s AS (SELECT id, pos - LEAST(MAX(CASE WHEN place = 0 THEN pos END) OVER o, MAX(CASE WHEN place = 1 THEN pos END) OVER o) AS span, MAX(CASE WHEN place = 0 THEN pos END) OVER o IS NOT NULL AND MAX(CASE WHEN place = 1 THEN pos END) OVER o IS NOT NULL AS whole FROM m WINDOW o AS (PARTITION BY id ORDER BY pos, place ROWS UNBOUNDED PRECEDING)),
p AS (SELECT id, MIN(span) AS span FROM s WHERE whole GROUP BY 1),
r AS (SELECT e.id, COUNT(*) AS words, SUM(typos) AS typos, CASE WHEN COUNT(*) = 2 THEN LEAST(GREATEST(ANY_VALUE(span) - 1, 0), 8) ELSE 0 END AS proximity, COUNT_IF(first >= 1099511627776) AS attribute, COUNT_IF(typos = 0) AS exactness FROM e LEFT JOIN p ON p.id = e.id GROUP BY 1)
SELECT id, words, typos::BIGINT AS typos, proximity::BIGINT AS proximity, attribute, exactness, ROW_NUMBER() OVER (ORDER BY words DESC, typos, proximity, attribute, exactness DESC, id) - 1 AS rank FROM r ORDER BY rank LIMIT 50"""


@query("Q02_ranking_rules", _RULES)
def ranking_rules(t: Tables, terms=TERMS, k: int = 50) -> DataFrame:
    """The rules in their order: words, typos, proximity, attribute, exactness, id."""
    rules = ("words", "typos", "proximity", "attribute", "exactness")
    best = [F.desc("words"), "typos", "proximity", "attribute", F.desc("exactness"), "id"]
    top = corpus_index(t).ranked(list(terms), k)
    return top.select("id", *rules, (F.row_number().over(Window.orderBy(*best)) - 1).cast("long").alias("rank"))


@query("Q03_unified_search", "SELECT 'documents' AS source_index, COUNT(*) AS total FROM v_corpus WHERE CONTAINS(LOWER(content),'thing') UNION ALL SELECT 'transcripts', COUNT(*) FROM v_transcript_segments WHERE CONTAINS(LOWER(text),'thing') UNION ALL SELECT 'pages', COUNT(*) FROM pages WHERE CONTAINS(LOWER(html),'thing')")
def unified_search(t: Tables, term: str = "thing") -> DataFrame:
    one = lambda df, c, name: df.filter(F.lower(c).contains(term)).agg(F.count("*").alias("total")).select(F.lit(name).alias("source_index"), "total")
    return one(t.corpus, "content", "documents").unionByName(one(t.transcript_segments, "text", "transcripts")).unionByName(one(t.raw("pages"), "html", "pages"))


@query("Q04_vector_search", "WITH q AS (SELECT embedding AS e FROM v_vectors WHERE vec_id = 1), s AS (SELECT vec_id, doc_id, LIST_COSINE_SIMILARITY(embedding,(SELECT e FROM q)) AS s FROM v_vectors WHERE source_format = 'pdf') SELECT vec_id, doc_id, ROUND(s,6) AS score FROM s ORDER BY s DESC, vec_id LIMIT 15")
def vector_search(t: Tables) -> DataFrame:
    """The best vectors of one format, exactly, by the unit vectors of the stored index."""
    return stored_vectors(t).exact(vector(t, 1), 15, F.col("source_format") == "pdf").select("vec_id", "doc_id", F.round("score", 6).alias("score"))


def stored_vectors(t: Tables) -> VectorIndex:
    return vector_index_of(t.spark, f"{t.sf_dir}/embeddings.parquet", t.vectors)


def vector(t: Tables, vec_id: int) -> list[float]:
    return t.vectors.filter(F.col("vec_id") == vec_id).first().embedding


@query("Q04b_indexed_search")
def indexed_search(t: Tables, k: int = 10, probes: int = 8) -> DataFrame:
    """The ten nearest vectors of every fiftieth one, out of the lists nearest to it."""
    queries = t.vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return stored_vectors(t).search_all(queries, k, probes).select("query_id", "place", "vec_id", F.round("score", 6).alias("score"))


@query("Q05_hybrid_fusion", f"""WITH {_HITS}, kw AS (SELECT id, ROW_NUMBER() OVER (ORDER BY words DESC, tf DESC, id)-1 AS kr FROM hits QUALIFY kr < 30), q AS (SELECT embedding AS e FROM v_vectors WHERE vec_id = 1),
vs AS (SELECT doc_id, MAX(LIST_COSINE_SIMILARITY(embedding,(SELECT e FROM q))) AS s FROM v_vectors GROUP BY 1), vr AS (SELECT doc_id AS id, ROW_NUMBER() OVER (ORDER BY ROUND(s,9) DESC, doc_id)-1 AS vr FROM vs QUALIFY vr < 30)
SELECT COALESCE(kw.id,vr.id) AS id, ROUND(COALESCE(1.0::DOUBLE/(61+kr),0)+COALESCE(1.0::DOUBLE/(61+vr),0),9) AS score, kr IS NULL AS vector_only FROM kw FULL JOIN vr ON kw.id = vr.id""")
def hybrid_fusion(t: Tables, k: int = 60, n: int = 30) -> DataFrame:
    """Reciprocal rank fusion of the keyword and the vector list; each document by its best chunk."""

    def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
        top = df.orderBy(*order).limit(n)
        return top.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias(name))

    kw = ranked(corpus_index(t).top(list(TERMS), n), [F.desc("words"), F.desc("tf"), F.col("id")], "kr")
    one = t.vectors.filter("vec_id = 1").select(F.col("embedding").alias("q"))
    best = t.vectors.join(F.broadcast(one)).groupBy(F.col("doc_id").alias("id")).agg(F.round(F.max(cosine(F.col("embedding"), F.col("q"))), 9).alias("s"))
    vec = ranked(best, [F.desc("s"), F.col("id")], "vr")
    part = lambda c: F.coalesce(1.0 / (k + 1 + F.col(c)), F.lit(0.0))
    return kw.join(vec, "id", "full_outer").select("id", F.round(part("kr") + part("vr"), 9).alias("score"), F.col("kr").isNull().alias("vector_only"))


@query("Q06_hybrid_gate", f"WITH {_QUERIES_SQL}, {_KEYWORD_HITS_SQL} SELECT item_id, CASE WHEN {_CONFIDENT_SQL} THEN 'keyword' ELSE 'hybrid' END AS mode, CASE WHEN NOT ({_CONFIDENT_SQL}) AND REGEXP_MATCHES(query,{_TEMPORAL_SQL}) THEN 'date' ELSE 'relevance' END AS sort FROM h")
def hybrid_gate(t: Tables) -> DataFrame:
    """Keyword search alone where it is sure of itself; else hybrid search, by date where the query asks for recent documents."""
    q = F.col("query")
    rows = keyword_hits(t).withColumn("sure", X.keyword_is_confident(q, F.col("n_hits")))
    return rows.select("item_id", F.when(F.col("sure"), "keyword").otherwise("hybrid").alias("mode"), F.when(~F.col("sure") & X.asks_for_recent(q), "date").otherwise("relevance").alias("sort"))


@query("Q07_autocomplete", "SELECT title FROM (SELECT title, ROW_NUMBER() OVER (PARTITION BY LOWER(title) ORDER BY id) AS rn FROM v_corpus WHERE STARTS_WITH(LOWER(title),'th')) WHERE rn = 1 ORDER BY title LIMIT 10")
def autocomplete(t: Tables, prefix: str = "th") -> DataFrame:
    own = t.corpus.filter(F.lower("title").startswith(prefix)).withColumn("rn", F.row_number().over(Window.partitionBy(F.lower("title")).orderBy("id")))
    return own.filter("rn = 1").select("title").orderBy("title").limit(10)


@query("Q08_related_documents", "WITH q AS (SELECT embedding AS e FROM v_vectors WHERE vec_id = 3), s AS (SELECT doc_id, MAX(LIST_COSINE_SIMILARITY(embedding,(SELECT e FROM q))) AS s FROM v_vectors WHERE doc_id <> 1 GROUP BY 1) SELECT doc_id, ROUND(s,6) AS score FROM s ORDER BY ROUND(s,9) DESC, doc_id LIMIT 10")
def related_documents(t: Tables) -> DataFrame:
    one = t.vectors.filter("vec_id = 3").select(F.col("embedding").alias("q"))
    best = t.vectors.filter("doc_id <> 1").join(F.broadcast(one)).groupBy("doc_id").agg(F.max(cosine(F.col("embedding"), F.col("q"))).alias("s"))
    return best.orderBy(F.desc(F.round("s", 9)), "doc_id").limit(10).select("doc_id", F.round("s", 6).alias("score"))


@query("Q08b_related_by_terms", f"""WITH {_TOKENS}, df AS (SELECT token, COUNT(*) AS df FROM post GROUP BY 1), n AS (SELECT COUNT(*) AS n FROM v_corpus), w AS (SELECT id, post.token, tf*LN(1+n/df::DOUBLE) AS w FROM post JOIN df ON df.token = post.token, n),
q AS (SELECT token, w FROM w WHERE id = 1 ORDER BY ROUND(w,9) DESC, token LIMIT 10), nr AS (SELECT id, SQRT(SUM(w*w)) AS norm FROM w GROUP BY 1)
SELECT w.id, ROUND(SUM(w.w*q.w)/norm,6) AS score FROM w JOIN q ON q.token = w.token JOIN nr ON nr.id = w.id WHERE w.id <> 1 GROUP BY w.id, norm ORDER BY ROUND(SUM(w.w*q.w)/norm,9) DESC, w.id LIMIT 10""")
def related_by_terms(t: Tables, doc: int = 1, k: int = 10) -> DataFrame:
    """Documents related to one by a query that is derived from its text."""
    text = t.corpus.filter(F.col("id") == doc).first().content
    return corpus_index(t).related(text, k, doc).select("id", F.round("score", 6).alias("score"))


@query("Q03b_facets", "SELECT source_format, lang, COUNT(*) AS n FROM v_corpus WHERE CONTAINS(REGEXP_REPLACE(' '||LOWER(content)||' ','[^a-z0-9]+',' ','g'),' thing ') GROUP BY 1, 2")
def facets(t: Tables, terms=("thing",), by=("source_format", "lang")) -> DataFrame:
    """Counts of all hits by facet, out of the postings of the terms."""
    index = corpus_index(t)
    return index.hits(list(terms)).select("id").join(index.docs(), "id").groupBy(*by).agg(F.count("*").alias("n"))


@query("Q09_budgeted_context", "WITH h AS (SELECT id, file_size_bytes//4 AS tokens FROM v_corpus WHERE CONTAINS(LOWER(content),'thing')), c AS (SELECT id, tokens, SUM(LEAST(tokens,500)) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT * FROM h ORDER BY id LIMIT 100)) SELECT id, CAST(running AS BIGINT) AS running FROM c WHERE running <= 8000")
def budgeted_context(t: Tables, per_doc: int = 500, budget: int = 8000) -> DataFrame:
    """Hits in order while their clipped token estimates fit a budget; a top-100 list is ranked, not the corpus."""
    top = t.corpus.filter(F.lower("content").contains("thing")).orderBy("id").limit(100)
    running = F.sum(F.least(F.expr("file_size_bytes div 4"), F.lit(per_doc))).over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return top.select("id", running.cast("long").alias("running")).filter(F.col("running") <= budget)


@query("Q10_help_snippet", "SELECT id, LIST_FILTER(STRING_SPLIT(content,CHR(10)), LAMBDA x: CONTAINS(LOWER(x),'thing') AND NOT STARTS_WITH(x,'#'))[1] AS snippet FROM v_corpus WHERE CONTAINS(LOWER(content),'thing')")
def help_snippet(t: Tables, term: str = "thing") -> DataFrame:
    lines = F.filter(F.split("content", "\n"), lambda x: F.lower(x).contains(term) & ~x.startswith("#"))
    return t.corpus.filter(F.lower("content").contains(term)).select("id", F.get(lines, 0).alias("snippet"))


@query("Q11_log_search", "SELECT id, event_type FROM v_activity_events WHERE event_type IN ('error','signup') AND REGEXP_MATCHES(metadata,'[0-4]') ORDER BY id DESC LIMIT 40")
def log_search(t: Tables) -> DataFrame:
    return t.activity_events.filter(F.col("event_type").isin("error", "signup") & F.col("metadata").rlike("[0-4]")).orderBy(F.desc("id")).limit(40).select("id", "event_type")


@query("Q12_tool_listing", "SELECT id, title, lang FROM v_corpus WHERE source_format = 'src1' ORDER BY id LIMIT 25")
def tool_listing(t: Tables) -> DataFrame:
    return t.corpus.filter("source_format = 'src1'").orderBy("id").limit(25).select("id", "title", "lang")


@query("Q13_browse", "SELECT id, title FROM v_corpus ORDER BY id LIMIT 50 OFFSET 50")
def browse(t: Tables) -> DataFrame:
    return t.corpus.orderBy("id").offset(50).limit(50).select("id", "title")


@query("K19_postings", f"WITH {_TOKENS} SELECT token, COUNT(*) AS docs, SUM(tf) AS tf FROM post GROUP BY 1")
def postings_table(t: Tables) -> DataFrame:
    """The vocabulary of the stored index."""
    return corpus_index(t).vocabulary().select("token", "docs", "tf")


_CHANGED = """gone AS (SELECT doc_id AS id FROM labels WHERE toxic = 1 UNION SELECT item_id FROM benchmark), now AS (SELECT id, content FROM v_corpus WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT item_id, ANY_VALUE(text) FROM benchmark GROUP BY 1),
tok AS (SELECT id, UNNEST(REGEXP_SPLIT_TO_ARRAY(LOWER(content),'[^a-z0-9]+')) AS token FROM now)"""


@query("K19b_index_changes", f"WITH {_CHANGED} SELECT token, COUNT(DISTINCT id) AS docs, COUNT(*) AS tf FROM tok WHERE token <> '' GROUP BY 1")
def index_changes(t: Tables) -> DataFrame:
    """The vocabulary after a change set: documents labelled toxic are deleted, those with the id of a benchmark item take its text. Only the changes are written."""
    index = Index(t.spark, own_folder(t.spark, "changed-postings"))
    index.build(t.corpus)
    fresh = t.raw("benchmark").groupBy(F.col("item_id").cast("long").alias("id")).agg(F.min("text").alias("content")).filter("id is not null")
    fresh = fresh.select(F.lit("upsert").alias("op"), "id", F.substring("content", 1, 60).alias("title"), "content")
    toxic = t.raw("labels").filter("toxic = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct().join(fresh.select("id"), "id", "left_anti")
    index.apply(fresh.unionByName(toxic.select(F.lit("delete").alias("op"), "id"), allowMissingColumns=True))
    return index.vocabulary().select("token", "docs", "tf")
