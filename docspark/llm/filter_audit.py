"""Filter interaction audit (13): what each of five filters removes in every order, by a Walsh-Hadamard transform.

A document's failures are a mask of five bits. For every part and label, 32 signed
parity sums are aggregated: sum s adds +1 for a document whose mask shares an even
number of bits with s, and -1 for an odd one. The transform is its own inverse but for
the factor 32, so the sums give the exact number of documents of each mask. All else is
arithmetic on 32 numbers: step k of an order removes the masks that hold its filter's
bit and none of the bits before it; a document that fails f filters is removed by each
of them in 120 / f of the 120 orders, which gives the Shapley values in closed form.

Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * [A-Z] > 5 * code
points; D holds any of #$%&*|; E the text is that of a smaller doc_id, anywhere in the
table. Words are maximal runs of [^\\x20\\x09-\\x0D], case-sensitive.

At scale: one pass over the texts leaves a few numbers and a 256-bit digest of each
document; texts of one digest are one. Classes of equal texts are grouped with sums
before the shuffle, and joined back by a plain equi-join, whose hot classes adaptive
execution can split. Parity sums are pre-aggregated in every task.

Defined cases. Null text: empty. Null source: the part ''. Null doc_id: has no smaller
id and is none for others, has no label. Repeated rows: documents of their own, of one
id, so none fails E by another. Repeated label rows: a document counts once, as good
or toxic if any of its rows says so. An empty table has no parts. Other columns are
ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Each order with its steps: (filter_order, step, bit of the step's filter, bits before it).
STEPS = [("".join(o), k + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(g) for g in o[:k])) for o in permutations(FILTERS) for k, f in enumerate(o)]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): mask holds bit k for filter k of FILTERS, E included. docs: (doc_id, source, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # sizes only leave the projection, so that a text's words are made once and dropped at once
    sized = base.select("doc_id", "part", F.transform(F.array("text"), lambda x: _sizes(x))[0].alias("x"))
    n, x = F.col("x.words"), F.col("x")
    bit = lambda k, failed: F.when(failed, 1 << k).otherwise(0)
    four = bit(0, n < 50) + bit(1, 100 * x.distinct < 65 * n) + bit(2, 100 * x.upper > 5 * x.points) + bit(3, x.symbol)
    # written once: the classes are counted and joined without the texts
    seen = frames.cut(sized.select("doc_id", "part", four.alias("mask"), x.digest.alias("digest")))
    classes = frames.cut(seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return seen.join(classes, "digest", "left").select("doc_id", "part", (F.col("mask") + bit(4, copy)).alias("mask"))


def _sizes(text: Column) -> Column:
    return F.transform(
        F.array(_words(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct"), (F.length(text) - F.length(F.translate(text, _UPPER, ""))).cast("long").alias("upper"),
            F.length(text).cast("long").alias("points"), text.rlike("[#$%&*|]").alias("symbol"), F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
    )[0]


def parity_sums(masks: DataFrame) -> DataFrame:
    """(part, good, toxic, sums): for each part and label, the 32 signed parity sums over its masks."""
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(s)) % 2)
    grouped = masks.groupBy("part", "good", "toxic").agg(*(F.sum(sign(s).cast("long")).alias(f"s{s}") for s in range(MASKS)))
    return grouped.select("part", "good", "toxic", F.array(*(f"s{s}" for s in range(MASKS))).alias("sums"))


def mask_cells(sums: Column) -> Column:
    """The numbers of documents of each mask from the parity sums: the same transform, divided by 32 (exactly)."""
    sign = lambda m, s: 1 - 2 * (F.bit_count(m.bitwiseAND(s)) % 2)
    places = F.sequence(F.lit(0), F.lit(MASKS - 1))
    whole = lambda m: F.aggregate(places, F.lit(0).cast("long"), lambda a, s: a + F.get(sums, s) * sign(m, s))
    return F.transform(places, lambda m: F.shiftright(whole(m), len(FILTERS)))


def evaluate(cells: DataFrame) -> DataFrame:
    """All orders and steps from (part, good, toxic, cells): 600 rows a part."""
    total = lambda where, name: F.array(*(F.coalesce(F.sum(F.when(where, F.col("cells")[m])), F.lit(0)) for m in range(MASKS))).alias(name)
    parts = cells.groupBy("part").agg(total(F.lit(True), "n"), total(F.col("good"), "g"), total(F.col("toxic"), "t"))
    steps = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("before")) for o, k, b, p in STEPS))
    each = parts.select("part", "n", "g", "t", F.explode(steps).alias("s")).select("part", "n", "g", "t", "s.*")
    places = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def over(column: str, holds) -> Column:
        """Sum of the cells whose mask holds."""
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, m: a + F.when(holds(m), F.get(F.col(column), m)).otherwise(F.lit(0).cast("long")))

    bit, before = F.col("bit"), F.col("before")
    has, met = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    gone = lambda m: has(m) & ~met(m)
    orders = F.array(*(F.lit(120 // f if f else 0).cast("long") for f in range(len(FILTERS) + 1)))
    shapley = F.aggregate(places, F.lit(0).cast("long"), lambda a, m: a + F.when(has(m), F.get(F.col("n"), m) * F.get(orders, F.bit_count(m))).otherwise(F.lit(0).cast("long")))
    return each.select(
        "part", "filter_order", "step", over("n", lambda m: ~has(m) & ~met(m)).alias("kept"), over("n", gone).alias("removed"), over("n", lambda m: has(m) & met(m)).alias("redundant"),
        over("n", lambda m: m == bit).alias("unique_fails"), over("g", gone).alias("good_lost"), over("t", gone).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of docs (doc_id, source, text) with labels (doc_id, quality, toxic)."""
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    masks = failures(docs).join(marked, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return evaluate(parity_sums(masks).select("part", "good", "toxic", mask_cells(F.col("sums")).alias("cells")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(frames.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), frames.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
