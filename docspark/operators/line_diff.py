"""Line differences of versions, for all documents at once: patience matching in rounds of joins and windows.

The lines of both versions are rows. In each round the unmatched lines between two
matched ones form a segment; in it, equal lines at both ends are matched, and of the lines
that occur equally often on both sides (once, as a rule) the n-th is paired with the n-th and
the longest run of pairs in order is kept. Rounds end when nothing new is matched; what
is left was removed or added. Lines keep their line feed, so a last line with and one without
differ, as in a patch.

At scale: a document's lines meet in one task, as they do in its text; documents are
worked off side by side. Lines are compared by a number that equal lines of a document
share, not by a hash.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming.monitors import cut

OLD, NEW = 0, 1
# Lines around a change, the largest patch in bytes, bullets of a summary and characters of one.
CONTEXT, MOST_BYTES, MOST_BULLETS, MOST_CHARS = 3, 1 << 20, 20, 80


def lines_of(text: Column) -> Column:
    """The lines of a text, each with its line feed; none of a null or empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=\n)"), lambda x: x != "")


def in_order(pairs: list[tuple[int, int]]) -> list[int]:
    """Places of a longest run of pairs whose second numbers rise; the first ones rise already."""
    tails, last, before = [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tails, j)
        before.append(last[at - 1] if at else -1)
        tails[at : at + 1], last[at : at + 1] = [j], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _kept(pairs: pa.Array) -> pa.Array:
    rows = [[(p["i"], p["j"]) for p in x] for x in pairs.to_pylist()]
    return pa.array([[{"i": x[k][0], "j": x[k][1]} for k in in_order(x)] for x in rows], pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))


def _found(lines: DataFrame) -> DataFrame:
    """(id, i, j): new pairs of equal lines, in order within their segments."""
    through = Window.partitionBy("id", "side").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    free = lines.withColumn("seg", F.count("to").over(through)).filter("to is null").drop("to")
    own = Window.partitionBy("id", "seg", "side")
    free = free.withColumn("r", F.row_number().over(own.orderBy("no"))).withColumn("n", F.count("*").over(own)).withColumn("q", F.col("n") - F.col("r") + 1)
    on = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))

    def equal_run(rank: str) -> DataFrame:
        """Equal lines from one end of each segment on."""
        met = free.groupBy("id", "seg", rank).agg(on(OLD, "code").alias("a"), on(NEW, "code").alias("b"), on(OLD, "n").alias("n_old"), on(NEW, "n").alias("n_new"))
        first = F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col(rank)))
        return met.groupBy("id", "seg").agg((F.coalesce(first, F.max(rank) + 1) - 1).alias(f"run_{rank}"), F.least(F.max("n_old"), F.max("n_new")).alias("least"))

    ends = equal_run("r").select("id", "seg", "run_r", F.coalesce("least", F.lit(0)).alias("least")).join(equal_run("q").select("id", "seg", "run_q"), ["id", "seg"])
    ends = ends.select("id", "seg", "run_r", F.greatest(F.least(F.col("run_q"), F.col("least") - F.col("run_r")), F.lit(0)).alias("run_q"))
    told = free.join(ends, ["id", "seg"])
    place = F.when(F.col("r") <= F.col("run_r"), F.col("r")).when(F.col("q") <= F.col("run_q"), -F.col("q"))
    told = told.withColumn("place", place)
    at_ends = told.filter("place is not null").groupBy("id", "seg", "place").agg(on(OLD, "no").alias("i"), on(NEW, "no").alias("j")).select("id", "i", "j")
    rest = told.filter("place is null")
    same = rest.groupBy("id", "seg", "code").agg(F.count_if(F.col("side") == OLD).alias("a"), F.count_if(F.col("side") == NEW).alias("b")).filter("a = b").select("id", "seg", "code")
    nth = F.row_number().over(Window.partitionBy("id", "seg", "code", "side").orderBy("no"))
    paired = rest.join(same, ["id", "seg", "code"]).withColumn("nth", nth).groupBy("id", "seg", "code", "nth").agg(on(OLD, "no").alias("i"), on(NEW, "no").alias("j"))
    runs = paired.groupBy("id", "seg").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("pairs"))
    kept = runs.select("id", F.explode(F.arrow_udf(_kept, "array<struct<i: int, j: int>>")("pairs")).alias("p")).select("id", "p.i", "p.j")
    return at_ends.union(kept)


def edits(pairs: DataFrame) -> DataFrame:
    """(id, pos, kind, line, i, j) of (id, old, new), ids unique: all lines in the order of a patch; kind is blank, - or +, i and j are the numbers of the line in both versions from 0 on."""
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), lines_of(F.col(c)).alias("lines")) for s, c in ((OLD, "old"), (NEW, "new"))))).alias("s")
    changed = pairs.filter("id is not null and not coalesce(old, '') <=> coalesce(new, '')")
    rows = changed.select("id", sides).select("id", "s.side", F.posexplode("s.lines").alias("no", "line"))
    code = F.min(F.col("no").cast("long") * 2 + F.col("side")).over(Window.partitionBy("id", "line"))
    texts = cut(rows.withColumn("code", code))
    lines = texts.select("id", "side", "no", "code", F.lit(None).cast("int").alias("to"))
    while True:
        found = cut(_found(lines))
        if found.isEmpty():
            break
        both = F.explode(F.array(F.struct(F.lit(OLD).alias("side"), F.col("i").alias("no"), F.col("j").alias("now")), F.struct(F.lit(NEW).alias("side"), F.col("j").alias("no"), F.col("i").alias("now")))).alias("b")
        lines = cut(lines.join(found.select("id", both).select("id", "b.*"), ["id", "side", "no"], "left").select("id", "side", "no", "code", F.coalesce("to", "now").alias("to")))
    through = Window.partitionBy("id", "side").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    ranked = lines.withColumn("m", F.count("to").over(through))
    kind = F.when(F.col("to").isNotNull(), " ").when(F.col("side") == OLD, "-").otherwise("+")
    shown = ranked.filter(~((F.col("side") == NEW) & F.col("to").isNotNull())).withColumn("kind", kind)
    # a matched line closes the stretch that it follows; removed lines come before added ones
    order = [F.when(F.col("kind") == " ", F.col("m") - 1).otherwise(F.col("m")), F.when(F.col("kind") == " ", 2).when(F.col("kind") == "+", 1).otherwise(0), F.col("no")]
    placed = shown.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    i = F.when(F.col("side") == OLD, F.col("no"))
    j = F.when(F.col("side") == NEW, F.col("no")).otherwise(F.col("to"))
    return placed.join(texts.select("id", "side", "no", "line"), ["id", "side", "no"]).select("id", "pos", "kind", "line", i.alias("i"), j.alias("j"))


def in_hunks(rows: DataFrame, context: int = CONTEXT) -> DataFrame:
    """The rows of ``edits`` near a change, with the number of their ``hunk`` from 1 on, and lines of both versions before them (``i_at``, ``j_at``)."""
    own = Window.partitionBy("id").orderBy("pos")
    near = F.max(F.col("kind") != " ").over(own.rowsBetween(-context, context))
    before = lambda c: F.count(c).over(own.rowsBetween(Window.unboundedPreceding, -1))
    close = rows.withColumn("i_at", before("i")).withColumn("j_at", before("j")).withColumn("near", near).filter("near").drop("near")
    opens = F.coalesce(F.lag("pos").over(own) != F.col("pos") - 1, F.lit(True))
    return close.withColumn("opens", opens.cast("int")).withColumn("hunk", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def hunks(rows: DataFrame) -> DataFrame:
    """(id, hunk, old_start, old_lines, new_start, new_lines, added, removed, body) of the rows of ``in_hunks``; starts count from 1, or name the line before where a side has none."""
    told = F.concat("kind", F.rtrim(F.col("line"), F.lit("\n")), F.when(F.col("line").endswith("\n"), "").otherwise("\n\\ No newline at end of file"))
    grouped = rows.groupBy("id", "hunk").agg(
        F.min("i_at").alias("i"), F.count("i").alias("old_lines"), F.min("j_at").alias("j"), F.count("j").alias("new_lines"), F.count_if(F.col("kind") == "+").alias("added"), F.count_if(F.col("kind") == "-").alias("removed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", told.alias("text")))), lambda x: x["text"]), "\n").alias("body"),
    )
    start = lambda at, n: F.col(at) + F.when(F.col(n) > 0, 1).otherwise(0)
    return grouped.select("id", "hunk", start("i", "old_lines").alias("old_start"), "old_lines", start("j", "new_lines").alias("new_start"), "new_lines", "added", "removed", "body")


def summaries(rows: DataFrame) -> DataFrame:
    """(id, summary) of the rows of ``in_hunks``: a bullet for each changed line with text, sections by name, table rows in a run counted; equal neighbours once; of more than MOST_BULLETS the last one says how many are left."""
    own = Window.partitionBy("id").orderBy("pos")
    content = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    rows = rows.withColumn("content", content).withColumn("said", (F.col("kind") != " ") & (F.col("content") != ""))
    rows = rows.withColumn("table", F.col("said") & F.col("content").startswith("|"))
    rows = rows.withColumn("run", F.sum((~F.col("table")).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    tables = rows.filter("table").groupBy("id", "run").agg(F.min("pos").alias("pos"), n("+").alias("a"), n("-").alias("r"))
    parts = F.concat_ws(", ", F.when(F.col("a") > 0, F.concat(F.col("a").cast("string"), F.lit(" rows added"))), F.when(F.col("r") > 0, F.concat(F.col("r").cast("string"), F.lit(" rows removed"))))
    tables = tables.select("id", "pos", F.concat(F.lit("Table updated: "), parts).alias("bullet"))
    heading = F.regexp_extract("content", r"^#{1,6}\s+(.+)$", 1)
    short = F.when(F.length("content") > MOST_CHARS, F.concat(F.substring("content", 1, MOST_CHARS), F.lit("..."))).otherwise(F.col("content"))
    told = F.when(heading != "", F.concat(F.lit("Section '"), F.trim(heading), F.lit("' modified"))).otherwise(F.concat(F.when(F.col("kind") == "+", "Added: ").otherwise("Removed: "), short))
    bullets = rows.filter("said and not table").select("id", "pos", told.alias("bullet")).union(tables)
    new = bullets.withColumn("again", F.lag("bullet").over(own).eqNullSafe(F.col("bullet"))).filter("not again").withColumn("k", F.row_number().over(own))
    new = new.withColumn("n", F.count("*").over(Window.partitionBy("id"))).filter(F.col("k") <= MOST_BULLETS)
    more = F.concat(F.lit("... and "), (F.col("n") - (MOST_BULLETS - 1)).cast("string"), F.lit(" more changes"))
    new = new.withColumn("bullet", F.when((F.col("n") > MOST_BULLETS) & (F.col("k") == MOST_BULLETS), more).otherwise(F.col("bullet")))
    return new.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "bullet"))), lambda x: x["bullet"]).alias("summary"))


def diff(pairs: DataFrame) -> DataFrame:
    """(id, added, removed, patch, patch_truncated, summary) of (id, old, new), ids unique; a patch beyond MOST_BYTES is left out and flagged. Null texts are empty; equal ones have no patch."""
    near = cut(in_hunks(edits(pairs)))
    head = lambda s, n: F.concat_ws(",", F.col(s).cast("string"), F.when(F.col(n) != 1, F.col(n).cast("string")))
    each = hunks(near).withColumn("text", F.concat(F.lit("@@ -"), head("old_start", "old_lines"), F.lit(" +"), head("new_start", "new_lines"), F.lit(" @@\n"), F.col("body")))
    whole = F.concat(F.lit("--- previous\n+++ current\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk", "text"))), lambda x: x["text"]), "\n"))
    by_id = each.groupBy("id").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), whole.alias("patch"))
    large = F.coalesce(F.octet_length("patch") > MOST_BYTES, F.lit(False))
    none = F.array().cast("array<string>")
    told = pairs.filter("id is not null").select("id").join(by_id, "id", "left").join(summaries(near), "id", "left")
    return told.select("id", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"), F.when(~large, F.coalesce("patch", F.lit(""))).alias("patch"), large.alias("patch_truncated"), F.coalesce("summary", none).alias("summary"))
