"""Joins over the corpus tables: lookups, semi and anti joins, wildcard and prefix joins, merges."""

from __future__ import annotations

import bisect
from collections import Counter
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pieces import pieces
from ..registry import query
from ..sources.tables import Tables
from .aggregates import with_rates
from .similarity import similar
from .windows import numbered_within


@query("J01_pending_with_job", "SELECT b.id, b.job_id, j.status AS job_status FROM v_bulk_files b LEFT JOIN v_bulk_jobs j ON j.id = b.job_id WHERE b.status = 'pending'")
def pending_with_job(t: Tables) -> DataFrame:
    jobs = t.bulk_jobs.select(F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    return t.bulk_files.filter("status = 'pending'").join(jobs, "job_id", "left").select("id", "job_id", "job_status")


@query("J02_lifecycle_gate", "SELECT b.id, s.lifecycle_status FROM v_bulk_files b LEFT JOIN v_source_files s ON s.id = b.source_file_id WHERE s.lifecycle_status = 'active' OR s.lifecycle_status IS NULL")
def lifecycle_gate(t: Tables) -> DataFrame:
    files = t.source_files.select(F.col("id").alias("source_file_id"), "lifecycle_status")
    return t.bulk_files.join(files, "source_file_id", "left").filter("lifecycle_status = 'active' or lifecycle_status is null").select("id", "lifecycle_status")


@query("J03_queue_with_path", "SELECT q.id, s.source_path, s.file_size_bytes FROM v_analysis_queue q LEFT JOIN v_source_files s ON s.id = q.source_file_id")
def queue_with_path(t: Tables) -> DataFrame:
    files = t.source_files.select(F.col("id").alias("source_file_id"), "source_path", "file_size_bytes")
    return t.analysis_queue.join(files, "source_file_id", "left").select("id", "source_path", "file_size_bytes")


@query("J04_flags_with_files", "SELECT f.id, f.reason, s.source_path FROM v_file_flags f JOIN v_source_files s ON s.id = f.source_file_id WHERE f.status = 'active'")
def flags_with_files(t: Tables) -> DataFrame:
    files = t.source_files.select(F.col("id").alias("source_file_id"), "source_path")
    return t.file_flags.filter("status = 'active'").join(files, "source_file_id").select("id", "reason", "source_path")


@query("J05_converted_files", "SELECT s.id, MAX(b.converted_at) AS last_converted, COUNT(*) AS n FROM v_source_files s JOIN v_bulk_files b ON b.source_file_id = s.id AND b.status = 'converted' GROUP BY 1")
def converted_files(t: Tables) -> DataFrame:
    done = t.bulk_files.filter("status = 'converted'").select(F.col("source_file_id").alias("id"), "converted_at")
    return t.source_files.select("id").join(done, "id").groupBy("id").agg(F.max("converted_at").alias("last_converted"), F.count("*").alias("n"))


@query("J06_latest_run_per_path", "SELECT source_path, ARG_MAX(id, (converted_at, id)) AS latest_id FROM v_bulk_files GROUP BY 1")
def latest_run(t: Tables) -> DataFrame:
    return t.bulk_files.groupBy("source_path").agg(F.max_by("id", F.struct("converted_at", "id")).alias("latest_id"))


@query("J07_cross_job_dedup", """WITH r AS (SELECT b.id, b.source_path, j.started_at, RANK() OVER (PARTITION BY b.source_path ORDER BY j.started_at DESC NULLS LAST) AS rk FROM v_bulk_files b JOIN v_bulk_jobs j ON j.id = b.job_id) SELECT id FROM r WHERE rk > 1 OR started_at IS NULL""")
def cross_job_dedup(t: Tables) -> DataFrame:
    """Rows to delete: all but those of the latest-started job of each path."""
    jobs = t.bulk_jobs.select(F.col("id").alias("job_id"), "started_at")
    ranked = t.bulk_files.join(jobs, "job_id").withColumn("rk", F.rank().over(Window.partitionBy("source_path").orderBy(F.desc_nulls_last("started_at"))))
    return ranked.filter("rk > 1 or started_at is null").select("id")


@query("J08_never_converted", "SELECT id FROM v_source_files s WHERE lifecycle_status = 'active' AND NOT EXISTS (SELECT 1 FROM v_bulk_files b WHERE b.source_path = s.source_path AND b.status = 'converted')")
def never_converted(t: Tables) -> DataFrame:
    return t.source_files.filter("lifecycle_status = 'active'").join(t.bulk_files.filter("status = 'converted'"), "source_path", "left_anti").select("id")


@query("J09_failed_without_twin", "SELECT COUNT(DISTINCT source_path) AS n FROM v_bulk_files b WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM v_bulk_files c WHERE c.source_path = b.source_path AND c.status = 'converted')")
def failed_without_twin(t: Tables) -> DataFrame:
    done = t.bulk_files.filter("status = 'converted'").select("source_path")
    return t.bulk_files.filter("status = 'failed'").join(done, "source_path", "left_anti").agg(F.countDistinct("source_path").alias("n"))


@query("J10_superseded_pending", "SELECT id FROM v_bulk_files b WHERE status = 'pending' AND EXISTS (SELECT 1 FROM v_bulk_files c WHERE c.source_path = b.source_path AND c.status = 'converted')")
def superseded_pending(t: Tables) -> DataFrame:
    done = t.bulk_files.filter("status = 'converted'").select("source_path")
    return t.bulk_files.filter("status = 'pending'").join(done, "source_path", "left_semi").select("id")


@query("J11_phantom_prune", "SELECT id FROM v_analysis_queue WHERE source_file_id NOT IN (SELECT id FROM v_source_files WHERE id IS NOT NULL)")
def phantom_prune(t: Tables) -> DataFrame:
    return t.analysis_queue.join(t.source_files.select(F.col("id").alias("source_file_id")), "source_file_id", "left_anti").select("id")


@query("J12_purged_prune", "SELECT id FROM v_bulk_files WHERE source_file_id IN (SELECT id FROM v_source_files WHERE lifecycle_status = 'purged')")
def purged_prune(t: Tables) -> DataFrame:
    purged = t.source_files.filter("lifecycle_status = 'purged'").select(F.col("id").alias("source_file_id"))
    return t.bulk_files.join(purged, "source_file_id", "left_semi").select("id")


@query("J13_disappeared", "SELECT source_path FROM v_source_files WHERE lifecycle_status = 'active' AND source_path NOT IN (SELECT source_path FROM v_snapshot)")
def disappeared(t: Tables) -> DataFrame:
    return t.source_files.filter("lifecycle_status = 'active'").join(t.snapshot, "source_path", "left_anti").select("source_path")


@query("J14_moves", """WITH gone AS (SELECT * FROM v_registry WHERE source_path NOT IN (SELECT source_path FROM v_snapshot)), fresh AS (SELECT * FROM v_snapshot WHERE source_path NOT IN (SELECT source_path FROM v_registry))
SELECT g.source_path AS old_path, MIN(f.source_path) AS new_path FROM gone g JOIN fresh f ON f.file_key = g.file_key GROUP BY 1""")
def moves(t: Tables) -> DataFrame:
    """Paths that went, with the smallest new path of the same content."""
    gone = t.registry.join(t.snapshot, "source_path", "left_anti").select("file_key", F.col("source_path").alias("old_path"))
    fresh = t.snapshot.join(t.registry, "source_path", "left_anti").select("file_key", F.col("source_path").alias("new_path"))
    return gone.join(fresh, "file_key").groupBy("old_path").agg(F.min("new_path").alias("new_path"))


@query("J15_rate_lookup", """SELECT q.id, COALESCE(e.input_rate,w.input_rate) AS input_rate FROM v_analysis_queue q LEFT JOIN v_rates e ON e.provider_id = q.provider_id AND e.model = q.model LEFT JOIN v_rates w ON w.provider_id = q.provider_id AND w.model = '*'""")
def rate_lookup(t: Tables) -> DataFrame:
    return with_rates(t.analysis_queue, t.rates).select("id", "input_rate")


@query("J16_rank_merge", """WITH a AS (SELECT id, ROW_NUMBER() OVER (ORDER BY file_size_bytes DESC, id)-1 AS ra FROM v_corpus ORDER BY ra LIMIT 50), b AS (SELECT id, ROW_NUMBER() OVER (ORDER BY title, id)-1 AS rb FROM v_corpus ORDER BY rb LIMIT 50)
SELECT COALESCE(a.id,b.id) AS id, ROUND(COALESCE(1.0::DOUBLE/(60+ra+1),0)+COALESCE(1.0::DOUBLE/(60+rb+1),0),9) AS score FROM a FULL JOIN b ON a.id = b.id""")
def rank_merge(t: Tables) -> DataFrame:
    """Two ranked lists merged by a full outer join of their ranks."""

    def ranked(order: list[Column], name: str) -> DataFrame:
        top = t.corpus.orderBy(*order).limit(50)
        return top.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias(name))

    a, b = ranked([F.desc("file_size_bytes"), F.col("id")], "ra"), ranked([F.col("title"), F.col("id")], "rb")
    one = lambda c: F.coalesce(1.0 / (60 + F.col(c) + 1), F.lit(0.0))
    return a.join(b, "id", "full_outer").select("id", F.round(one("ra") + one("rb"), 9).alias("score"))


@query("J17_scene_interleave", """WITH scenes AS (SELECT DISTINCT history_id, FLOOR(start_seconds/30)*30 AS scene_start FROM v_transcript_segments), u AS (SELECT history_id, scene_start AS at_s, 0 AS kind, 0 AS idx FROM scenes UNION ALL SELECT history_id, start_seconds, 1, segment_index FROM v_transcript_segments)
SELECT history_id, at_s, kind, CAST(idx AS BIGINT) AS idx, ROW_NUMBER() OVER (PARTITION BY history_id ORDER BY at_s, kind, idx) AS position FROM u""")
def scene_interleave(t: Tables) -> DataFrame:
    """Scene blocks put before the first segment that starts at or after them."""
    s = t.transcript_segments
    scenes = s.select("history_id", (F.floor(F.col("start_seconds") / 30) * 30).cast("double").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("idx")).distinct()
    both = scenes.unionByName(s.select("history_id", F.col("start_seconds").alias("at"), F.lit(1).alias("kind"), F.col("segment_index").alias("idx")))
    return both.withColumnRenamed("at", "at_s").withColumn("position", F.row_number().over(Window.partitionBy("history_id").orderBy("at_s", "kind", "idx")))


@query("J17b_scene_of_segment", """WITH scenes AS (SELECT DISTINCT history_id, FLOOR(start_seconds/25)*25+5 AS scene_start FROM v_transcript_segments) SELECT s.history_id, s.segment_index, MAX(c.scene_start) AS scene_start FROM v_transcript_segments s LEFT JOIN scenes c ON c.history_id = s.history_id AND c.scene_start <= s.start_seconds GROUP BY 1,2""")
def scene_of_segment(t: Tables) -> DataFrame:
    """As-of: the last scene that starts at or before each segment, by one sort instead of a range join."""
    s = t.transcript_segments
    scenes = s.select("history_id", (F.floor(F.col("start_seconds") / 25) * 25 + 5).cast("double").alias("at")).distinct().withColumn("segment_index", F.lit(None).cast("long"))
    both = scenes.unionByName(s.select("history_id", F.col("start_seconds").alias("at"), "segment_index"))
    order = Window.partitionBy("history_id").orderBy("at", F.col("segment_index").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("segment_index").isNull(), F.col("at")), ignorenulls=True).over(order)
    return both.withColumn("scene_start", last).filter("segment_index is not null").groupBy("history_id", "segment_index").agg(F.max("scene_start").alias("scene_start"))


@query("J18_excluded_by_prefix", "SELECT id FROM v_source_files WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('/src/1'),('/src/25')) p(prefix) WHERE STARTS_WITH(source_path, prefix))")
def not_excluded(t: Tables) -> DataFrame:
    """Files outside all excluded prefixes, however many there are."""
    prefixes = t.spark.createDataFrame([("/src/1",), ("/src/25",)], "prefix string")
    met = longest_prefix(t.source_files, "source_path", prefixes)
    return t.source_files.join(met, "source_path", "left_anti").select("id")


def longest_prefix(paths: DataFrame, path: str, prefixes: DataFrame) -> DataFrame:
    """(path, prefix): the longest of the prefixes that each distinct path begins with; paths without one are left out.

    The beginnings of a path, as long as some prefix is, are joined by equality. Null prefixes fit nothing, an empty one fits all.
    """
    known = prefixes.filter("prefix is not null").select("prefix").distinct()
    sizes = sorted(r.n for r in known.select(F.length("prefix").alias("n")).distinct().collect())  # at most as many as a path has characters
    own = paths.filter(F.col(path).isNotNull()).select(path).distinct()
    size = F.explode(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.length(path)))
    begins = own.select(path, size.alias("size")).select(path, F.col(path).substr(F.lit(1), F.col("size")).alias("prefix"))
    return begins.join(known, "prefix").groupBy(path).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


@query("J19_projects_of_media", "SELECT media_path, COUNT(DISTINCT project_id) AS projects, MIN(project_id) AS first_project FROM v_media_refs GROUP BY 1")
def projects_of_media(t: Tables) -> DataFrame:
    return t.media_refs.groupBy("media_path").agg(F.countDistinct("project_id").alias("projects"), F.min("project_id").alias("first_project"))


@query("J20_similar_titles", """WITH c AS (SELECT text, MIN(id) AS class_id, COUNT(DISTINCT id) AS n FROM (SELECT id, LOWER(TRIM(REGEXP_REPLACE(title,'[\\x20\\x09-\\x0D]+',' ','g'))) AS text FROM v_corpus) GROUP BY 1 HAVING text IS NOT NULL),
g AS (SELECT class_id, n, CASE WHEN text = '' THEN [] ELSE LIST_DISTINCT(LIST_TRANSFORM(RANGE(1, GREATEST(LENGTH(text)-1, 2)), LAMBDA i: SUBSTR(text, i::INT, 3))) END AS g FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b, b.n AS m, LEN(LIST_INTERSECT(a.g, b.g)) AS shared, LEN(a.g)+LEN(b.g) AS total FROM g a JOIN g b ON a.class_id <> b.class_id AND 100*LEAST(LEN(a.g),LEN(b.g)) >= 80*GREATEST(LEN(a.g),LEN(b.g)) AND LEN(a.g) > 0),
l AS (SELECT a AS class_id, SUM(m) AS linked, ARG_MAX(b, (shared/(total-shared)::DOUBLE, -b)) AS best_id, MAX(shared/(total-shared)::DOUBLE) AS s FROM p WHERE 100*shared >= 80*(total-shared) GROUP BY 1),
i AS (SELECT DISTINCT id, LOWER(TRIM(REGEXP_REPLACE(title,'[\\x20\\x09-\\x0D]+',' ','g'))) AS text FROM v_corpus)
SELECT id, COALESCE(c.class_id, id) AS class_id, COALESCE(n-1+COALESCE(linked,0),0)::BIGINT AS n_links, best_id, ROUND(s,6) AS similarity FROM i LEFT JOIN c ON c.text = i.text LEFT JOIN l ON l.class_id = c.class_id""")
def similar_titles(t: Tables, percent: int = 80) -> DataFrame:
    """Every title with its class of equal ones, the number of similar ones in the whole corpus and the best of them."""
    return similar(t.corpus.select("id", F.col("title").alias("text")), percent)


def _alike(a: str, i: int, b: str, j: int, most: int, back: bool = False) -> int:
    """Letters that a from i on and b from j on have in common at their beginning, or those before i and j at their end; most at most."""
    low = 0
    while low < most:
        middle = (low + most + 1) // 2
        same = a[i - middle : i - low] == b[j - middle : j - low] if back else a[i + low : i + middle] == b[j + low : j + middle]
        low, most = (middle, most) if same else (low, middle - 1)
    return low


class _Entry:
    """A stored text: its letters' counts, and the places of those that a match may start from, as difflib has them."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def counts(self) -> Counter:
        return Counter(self.text)

    @cached_property
    def places(self) -> dict[str, list[int]]:
        n = len(self.text)
        found: dict[str, list[int]] = {c: [] for c, k in self.counts.items() if n < 200 or k <= n // 100 + 1}  # frequent ones in a long text only extend a match
        for j, c in enumerate(self.text):
            if c in found:
                found[c].append(j)
        return found

    def ratio(self, a: str) -> float:
        """difflib.SequenceMatcher(None, a, self.text).ratio(), looking only at the letters of ``a`` that a match may start from."""
        b = self.text
        starts = [i for i, c in enumerate(a) if c in self.places]
        matches, todo = 0, [(0, len(a), 0, len(b))]
        while todo:
            alo, ahi, blo, bhi = todo.pop()
            besti, bestj, size, last, runs = alo, blo, 0, -2, {}
            for i in starts[bisect.bisect_left(starts, alo) : bisect.bisect_left(starts, ahi)]:
                before, runs = runs if i == last + 1 else {}, {}
                last, where = i, self.places[a[i]]
                for j in where[bisect.bisect_left(where, blo) : bisect.bisect_left(where, bhi)]:
                    k = runs[j] = before.get(j - 1, 0) + 1
                    if k > size:
                        besti, bestj, size = i - k + 1, j - k + 1, k
            more = _alike(a, besti, b, bestj, min(besti - alo, bestj - blo), back=True)
            besti, bestj, size = besti - more, bestj - more, size + more
            size += _alike(a, besti + size, b, bestj + size, min(ahi - besti, bhi - bestj) - size)
            if size:
                matches += size
                todo += [x for x in ((alo, besti, blo, bestj), (besti + size, ahi, bestj + size, bhi)) if x[0] < x[1] and x[2] < x[3]]
        return 2.0 * matches / (len(a) + len(b)) if a or b else 1.0


def best_matches(elements: list[str], stored: list[str], least: float) -> list[tuple[int, int, float]]:
    """(element, stored entry, ratio): for each element the entry with the highest matching-block ratio of at least ``least``, the first of equal ones."""
    entries = [_Entry(x) for x in stored]
    out = []
    for i, text in enumerate(elements):
        counts, best = Counter(text), (0.0, -1)
        for j, other in enumerate(entries if text else ()):
            bar, n = max(least, best[0]), len(text) + len(other.text)
            # bounds of the ratio: by lengths, then by letters in common
            if 2.0 * min(len(text), len(other.text)) / n < bar or 2.0 * sum(min(k, other.counts[c]) for c, k in counts.items() if c in other.counts) / n < bar:
                continue
            if (ratio := other.ratio(text)) >= least and ratio > best[0]:
                best = (ratio, j)
        if best[1] >= 0:
            out.append((i, best[1], best[0]))
    return out


@query("J20_fuzzy_elements")
def fuzzy_elements(t: Tables, least: float = 0.9) -> DataFrame:
    """Elements of a document that have no exact entry among its stored ones, with the best fuzzy match there; an equi-join by document.

    The stored entries are a document's lines; the elements are its lines with every
    other one edited. Exact matches, by normalized text, need no comparison.
    """
    plain = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    lines = F.filter(F.split("content", "\n"), lambda x: F.trim(x) != "")
    edited = F.transform(lines, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, "(?i)the", "teh")).otherwise(x))
    docs = t.corpus.select("id", F.transform(lines, plain).alias("stored"), F.transform(edited, plain).alias("elements"))
    docs = docs.select("id", "stored", F.array_except("elements", "stored").alias("elements")).filter(F.size("elements") > 0)

    def run(batches):
        for pdf in batches:
            rows = ((i, elements[a], stored[b], round(r, 6)) for i, stored, elements in zip(pdf.id, pdf.stored, pdf.elements) for a, b, r in best_matches(list(elements), list(stored), least))
            yield from pieces(rows, ["id", "element", "entry", "ratio"])

    return docs.mapInPandas(run, "id bigint, element string, entry string, ratio double")


@query("J21_occurrence_match", """WITH p AS (SELECT id, content_hash, ROW_NUMBER() OVER (PARTITION BY content_hash ORDER BY source_path)-1 AS n FROM v_source_files), s AS (SELECT content_hash, file_key, ROW_NUMBER() OVER (PARTITION BY content_hash ORDER BY source_path)-1 AS n FROM v_snapshot),
l AS (SELECT content_hash, ARG_MAX(file_key,n) AS last_key FROM s GROUP BY 1) SELECT p.id, COALESCE(s.file_key, l.last_key) AS entry FROM p LEFT JOIN s ON s.content_hash = p.content_hash AND s.n = p.n LEFT JOIN l ON l.content_hash = p.content_hash""")
def occurrence_match(t: Tables) -> DataFrame:
    """The n-th element of a hash takes the n-th stored entry of that hash, or the last stored one."""
    nth = lambda rows, c: numbered_within(rows.select(c, "content_hash", "source_path"), "content_hash", "source_path").select(c, "content_hash", F.col("place").alias("n"))
    have, stored = nth(t.source_files, "id"), nth(t.snapshot, "file_key")
    last = stored.groupBy("content_hash").agg(F.max_by("file_key", "n").alias("last_key"))
    return have.join(stored, ["content_hash", "n"], "left").join(last, "content_hash", "left").select("id", F.coalesce("file_key", "last_key").alias("entry"))


@query("J22_path_collisions", "SELECT id, COUNT(*) OVER (PARTITION BY dir_id, file_ext) AS twins FROM v_source_files QUALIFY twins > 1")
def path_collisions(t: Tables) -> DataFrame:
    twins = t.source_files.groupBy("dir_id", "file_ext").agg(F.count("*").alias("twins")).filter("twins > 1")
    return t.source_files.join(twins, ["dir_id", "file_ext"]).select("id", "twins")


@query("J23_drift_check", """WITH a AS (SELECT job_id, COUNT(*) AS op_total FROM v_bulk_files GROUP BY 1), b AS (SELECT job_id, COUNT(DISTINCT source_path) AS db_total FROM v_bulk_files GROUP BY 1) SELECT a.job_id, op_total, db_total FROM a JOIN b ON a.job_id = b.job_id WHERE ABS(op_total-db_total) > 10""")
def drift_check(t: Tables, most: int = 10) -> DataFrame:
    both = t.bulk_files.groupBy("job_id").agg(F.count("*").alias("op_total"), F.countDistinct("source_path").alias("db_total"))
    return both.filter(F.abs(F.col("op_total") - F.col("db_total")) > most)
