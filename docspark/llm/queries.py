"""The queries of this subpackage by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ball_kmeans import op12_ball_kmeans
from .embedding_dedup import op6_embedding_dedup
from .filter_audit import op13_filter_audit
from .line_dedup import op10_line_dedup
from .lm_scoring import op8_lm_scoring
from .minhash_dedup import op9_minhash_dedup
from .packing import op7_packing
from .quality_classifier import op2_quality_classifier
from .quality_rules import op4_quality_rules
from .sentencepiece_codec import op5_sentencepiece
from .substring_dedup import op3_substring_dedup
from .token_counts import op1_token_counts
from .url_filters import RULES, Spread, op11_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_packing": op7_packing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_url_filters": op11_url_filters,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_filter_audit": op13_filter_audit,
}

_WORDS = r"LIST_FILTER(REGEXP_SPLIT_TO_ARRAY({text}, '[\x20\x09-\x0D]+'), LAMBDA x: x <> '')"

_SUBSTRING = f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="COALESCE(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, UNNEST(RANGE(1, LEN(w) - 11)) AS i, UNNEST(LIST_TRANSFORM(RANGE(1, LEN(w) - 11), LAMBDA j: ARRAY_TO_STRING(w[j:j + 12], ' '))) AS g FROM d WHERE LEN(w) >= 13),
first AS (SELECT g, MIN(doc_id) AS lo FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM win JOIN first USING (g), (SELECT UNNEST(RANGE(13)) AS k) WHERE lo < doc_id),
words AS (SELECT doc_id, UNNEST(RANGE(1, LEN(w) + 1)) AS pos, UNNEST(w) AS word FROM d),
kept AS (SELECT words.doc_id, STRING_AGG(word, ' ' ORDER BY words.pos) AS rest, COUNT(*) AS n FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos WHERE gone.pos IS NULL GROUP BY 1)
SELECT d.doc_id, LEN(w) AS n_words, LEN(w) - COALESCE(n, 0) AS n_removed, SHA256(COALESCE(rest, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

#: Smallest id that each node reaches over the undirected edges link(a, b).
_REACH = "reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)"

_MINHASH = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN LEN(w) = 1 THEN w[1] ELSE UNNEST(LIST_TRANSFORM(RANGE(1, GREATEST(LEN(w), 2)), LAMBDA j: w[j] || ' ' || w[j + 1])) END AS g FROM d WHERE LEN(w) > 0),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1), met AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)), {_REACH}
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, LEAST(d.doc_id, COALESCE(r.lo, d.doc_id)) AS component_id, d.doc_id <= COALESCE(r.lo, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, MIN(b) AS lo FROM reach GROUP BY 1) r ON r.a = d.doc_id"""

_EMBEDDINGS = f"""WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE LIST_COSINE_SIMILARITY(x.v, y.v) >= 0.93), {_REACH}
SELECT e.vec_id, COALESCE(l.n, 0) AS n_links, LEAST(e.vec_id, COALESCE(r.lo, e.vec_id)) AS component_id, e.vec_id <= COALESCE(r.lo, e.vec_id) AS kept
FROM e LEFT JOIN (SELECT a, COUNT(*) AS n FROM link GROUP BY 1) l ON l.a = e.vec_id LEFT JOIN (SELECT a, MIN(b) AS lo FROM reach GROUP BY 1) r ON r.a = e.vec_id"""


def _url_filters(how: Spread = Spread()) -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    lower = "TRANSLATE({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ws = r"[ \t\r\n\f]"
    href = rf"""(?i)<a{ws}(?:[^<>]*?{ws})?href{ws}*={ws}*["'']?{ws}*([^"'' \t\r\n\f<>]+)"""

    def ranks(name: str, verdict: str, src: str, dst: str) -> str:
        mass = f"COUNT(*) FILTER (verdict = '{verdict}') / COUNT(*)"
        return f"""{name}_seed AS (SELECT host, {mass} AS mass FROM ruled WHERE host <> '' GROUP BY 1 HAVING mass > 0 AND mass >= {how.seed_share}),
{name}_share AS (SELECT {src} AS src, {dst} AS dst, n / SUM(n) OVER (PARTITION BY {src}) AS share FROM edge),
{name}_wave(k, host, rank) AS (SELECT 0, host, mass * (1 - {how.damping}::DOUBLE) FROM {name}_seed UNION ALL SELECT ANY_VALUE(k) + 1, dst, SUM(share * rank * {how.damping}::DOUBLE) FROM {name}_wave w JOIN {name}_share e ON e.src = w.host WHERE k < {how.rounds} GROUP BY dst),
{name} AS (SELECT host, SUM(rank) AS rank FROM {name}_wave GROUP BY 1)"""

    return f"""WITH RECURSIVE rules(rule_host, start, verdict) AS (VALUES {rules}),
p AS (SELECT page_id, html, ROW_NUMBER() OVER () AS row_id, {lower.format("COALESCE(REGEXP_EXTRACT(url, '://([^/?#]*)', 1), '')")} AS host, COALESCE(REGEXP_EXTRACT(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT row_id, ARG_MAX(rule_host || start, LEN(rule_host || start)) AS rule, ARG_MAX(verdict, LEN(rule_host || start)) AS verdict FROM p JOIN rules ON (host = rule_host OR ENDS_WITH(host, '.' || rule_host)) AND STARTS_WITH(path, start) GROUP BY 1),
ruled AS (SELECT page_id, host, path, rule, verdict FROM p LEFT JOIN fits ON fits.row_id = p.row_id),
link AS (SELECT host AS src, {lower.format(f"REGEXP_EXTRACT(UNNEST(REGEXP_EXTRACT_ALL(html, '{href}', 1)), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)")} AS dst FROM p),
edge AS (SELECT src, dst, COUNT(*) AS n FROM link WHERE src <> '' AND dst <> '' AND dst <> src GROUP BY 1, 2),
{ranks("trust", "allow", "src", "dst")}, {ranks("distrust", "block", "dst", "src")},
bad AS (SELECT d.host FROM distrust d LEFT JOIN trust t ON t.host = d.host WHERE d.rank >= {how.least_distrust} AND d.rank > {how.trust_weight} * COALESCE(t.rank, 0))
SELECT page_id, r.host, path, rule, COALESCE(verdict, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM ruled r LEFT JOIN bad ON bad.host = r.host"""


def _kmeans(k: int = 8, rounds: int = 10) -> str:
    far = "LIST_SUM(LIST_TRANSFORM(LIST_ZIP(e.v, c.v), LAMBDA z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    text = f"""WITH e AS MATERIALIZED (SELECT ROW_NUMBER() OVER () AS row_id, vec_id, LIST_TRANSFORM(embedding, LAMBDA x: FLOOR(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE LEN(embedding) = 64 AND LEN(LIST_FILTER(embedding, LAMBDA x: x IS NULL OR NOT ISFINITE(x))) = 0),
c0 AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY SHA256('3:' || vec_id::VARCHAR), v) - 1 AS cluster, v FROM e WHERE vec_id IS NOT NULL QUALIFY cluster < {k})"""
    for t in range(rounds + 1):
        text += f""",
a{t} AS MATERIALIZED (SELECT row_id, ARG_MIN(cluster, d * {k} + cluster) AS cluster, MIN(d) AS distance FROM (SELECT e.row_id, c.cluster, {far} AS d FROM e, c{t} c) GROUP BY 1)"""
        if t < rounds:
            text += f""",
m{t} AS (SELECT cluster, i, SUM(x)::HUGEINT AS s, COUNT(*)::HUGEINT AS n FROM (SELECT cluster, UNNEST(RANGE(1, 65)) AS i, UNNEST(v) AS x FROM a{t} JOIN e ON e.row_id = a{t}.row_id) GROUP BY 1, 2),
n{t} AS (SELECT cluster, LIST(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM m{t} GROUP BY 1),
c{t + 1} AS MATERIALIZED (SELECT c.cluster, COALESCE(n.v, c.v) AS v FROM c{t} c LEFT JOIN n{t} n ON n.cluster = c.cluster)"""
    return text + f"""
SELECT e.vec_id, a.cluster::INTEGER AS cluster, a.distance, (SUM(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (SUM(a.distance) OVER ())::BIGINT AS inertia, SHA256(ARRAY_TO_STRING(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN e ON e.row_id = a.row_id JOIN c{rounds} c ON c.cluster = a.cluster"""


_AUDIT = f"""WITH d AS (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS text, {_WORDS.format(text="COALESCE(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, BOOL_OR(quality = 1) AS good, BOOL_OR(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, COALESCE(good, FALSE) AS good, COALESCE(toxic, FALSE) AS toxic, LEN(w) < 50 AS A, 100 * LEN(LIST_DISTINCT(w)) < 65 * LEN(w) AS B, 100 * (LENGTH(text) - LENGTH(REGEXP_REPLACE(text, '[A-Z]', '', 'g'))) > 5 * LENGTH(text) AS C,
 REGEXP_MATCHES(text, '[#$%&*|]') AS D, COALESCE(d.doc_id > MIN(d.doc_id) OVER (PARTITION BY text), FALSE) AS E FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, MAP {{'A': A, 'B': B, 'C': C, 'D': D, 'E': E}} AS m, COUNT(*) AS n, COUNT_IF(good) AS g, COUNT_IF(toxic) AS t FROM f GROUP BY 1, 2),
x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE LEN(LIST_DISTINCT([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, k::INTEGER AS step, filter_order[k:k] AS own, STRING_SPLIT(filter_order[1:k - 1], '') AS before FROM o, RANGE(1, 6) r(k)),
y AS (SELECT part, filter_order, step, own, n, g, t, m[own] AS fails, COALESCE(LIST_BOOL_OR(LIST_TRANSFORM(LIST_FILTER(before, LAMBDA b: b <> ''), LAMBDA b: m[b])), FALSE) AS gone, LEN(LIST_FILTER(MAP_VALUES(m), LAMBDA v: v)) AS fs FROM c, s),
z AS (SELECT part, filter_order, step, own, SUM(n) FILTER (NOT fails AND NOT gone) AS kept, SUM(n) FILTER (fails AND NOT gone) AS removed, SUM(n) FILTER (fails AND gone) AS redundant, SUM(n) FILTER (fails AND fs = 1) AS unique_fails,
 SUM(g) FILTER (fails AND NOT gone) AS good_lost, SUM(t) FILTER (fails AND NOT gone) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, COALESCE(kept, 0)::BIGINT AS kept, COALESCE(removed, 0)::BIGINT AS removed, COALESCE(redundant, 0)::BIGINT AS redundant, COALESCE(unique_fails, 0)::BIGINT AS unique_fails,
 COALESCE(good_lost, 0)::BIGINT AS good_lost, COALESCE(toxic_lost, 0)::BIGINT AS toxic_lost, COALESCE(SUM(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM z"""

#: DuckDB SQL for those that SQL can express; it compares all pairs, so it is for small tables.
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": _SUBSTRING,
    "op6_embedding_dedup": _EMBEDDINGS,
    "op9_minhash_dedup": _MINHASH,
    "op11_url_filters": _url_filters(),
    "op12_ball_kmeans": _kmeans(),
    "op13_filter_audit": _AUDIT,
}
