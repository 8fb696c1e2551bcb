"""A similarity join of short texts over the whole corpus, complete for its threshold.

Texts are compared as sets of character 3-grams of their normalized form, by Jaccard
similarity in percent. Equal texts are one class and compared once. Sets of such a
similarity differ in a bounded number of grams. All grams are dealt to so many parts, by
hash, that two such sets differ by one gram at most in some part: there the whole part of
one equals the whole part of the other, or that less one gram. The join is by equality of
these; a pair's sizes and the parity of its grams in 64 bits, which changes in no more places
than the sets differ in, then leave little but similar pairs, which are verified on the
texts. Nothing is blocked by the beginning of a text or any other guess, so no pair is lost.

At scale: the rows of the join grow with the grams of all different texts, and none is
made from a gram that many texts hold, only from parts with all their grams. Candidates
travel as pairs of ids, the texts join afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.monitors import cut

GRAM = 3
#: Sizes of sets are banded at this times powers of two: titles of 60 letters and what may be similar to them lie in one band.
BAND = 37.5


def normalized(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def gram_set(text: Column) -> Column:
    """The distinct 3-grams of a text; the text itself if it is shorter; none of an empty one."""
    n = F.greatest(F.length(text) - (GRAM - 1), F.lit(1))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: text.substr(i, F.lit(GRAM)))))


def classes(rows: DataFrame) -> DataFrame:
    """(text, class_id, n, key) of (id, text): equal normalized texts are one class, named by its smallest id; null texts and ids are in none. key is unique, as an id may have several texts."""
    own = rows.filter("id is not null and text is not null").select("id", normalized(F.col("text")).alias("text"))
    # cut: the numbers hold only as long as the rows lie as they do
    return cut(own.groupBy("text").agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("n")).withColumn("key", F.monotonically_increasing_id()))


def _most_apart(sizes: Column, percent: int) -> Column:
    """Grams in one set alone, at most, of two similar ones of so many grams in all."""
    return sizes - 2 * F.floor((percent * sizes + 99 + percent) / (100 + percent))


def signatures(texts: DataFrame, percent: int) -> DataFrame:
    """(key, n, parity, whole, sign) of (key, text): for each part its whole (whole true), and it less each of its grams.

    A text is in the bands of its size and of the sizes that a similar larger one may have; parts are those of the band.
    """
    grams = texts.select("key", F.transform(gram_set(F.col("text")), lambda g: F.xxhash64(g)).alias("hashes")).filter("size(hashes) > 0")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    parity = F.aggregate("hashes", F.lit(0).cast("long"), lambda p, h: p.bitwiseXOR(bit(h)))
    band = lambda n: F.floor(F.log2(n / BAND)).cast("int")
    rows = grams.select("key", F.size("hashes").alias("n"), parity.alias("parity"), "hashes")
    rows = rows.withColumn("band", F.explode(F.sequence(band(F.col("n").cast("double")), band(F.col("n") * 100 / percent + 1e-6))))
    largest = F.ceil(F.pow(F.lit(2.0), F.col("band") + 1) * BAND)
    rows = rows.withColumn("parts", F.floor(F.floor(2 * largest * (100 - percent) / (100 + percent) + 1e-6) / 2) + 1)
    held = F.transform("hashes", lambda h: F.struct(F.pmod(F.shiftright(h, 6), F.col("parts")).alias("part"), h.alias("h")))
    none = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(None).cast("long").alias("h")))
    each = rows.repartition("key").select("key", "n", "parity", "band", F.explode(F.concat(held, none)).alias("g"))  # by text: its parts are grouped where they are
    parts = each.groupBy("key", "n", "parity", "band", "g.part").agg(F.coalesce(F.bit_xor("g.h"), F.lit(0).cast("long")).alias("all"), F.collect_list("g.h").alias("hs"))
    signs = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("all").alias("x"))), F.transform("hs", lambda h: F.struct(F.lit(False).alias("whole"), F.col("all").bitwiseXOR(h).alias("x"))))
    return parts.select("key", "n", "parity", "band", "part", F.explode(signs).alias("s")).select("key", "n", "parity", "s.whole", F.xxhash64("band", "part", "s.x").alias("sign"))


def similar_pairs(texts: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared, whole) for all pairs a <> b, once each, of (key, text) with 100 * shared grams >= percent * grams of both."""
    signs = signatures(texts, percent)
    x = signs.select("sign", F.struct("key", "n", "parity", "whole").alias("x"))
    y = signs.filter("whole").select("sign", F.struct("key", "n", "parity").alias("y"))
    apart = F.bit_count(F.col("x.parity").bitwiseXOR(F.col("y.parity")))
    near = (apart <= _most_apart(F.col("x.n") + F.col("y.n"), percent)) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    once = (F.col("x.key") < F.col("y.key")) | ~F.col("x.whole") & (F.col("x.key") != F.col("y.key"))
    met = x.join(y, "sign").filter(once & near)
    pairs = met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"), (F.col("x.n") + F.col("y.n")).alias("total")).distinct()
    a, b = (texts.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    shared = F.size(F.array_intersect(gram_set(F.col("text_a")), gram_set(F.col("text_b"))))
    # as an array of one: in a filter, Spark would cut and compare the grams again for each use of the number
    verified = F.filter(F.array(F.struct(shared.alias("shared"), F.col("total"))), lambda p: 100 * p["shared"] >= percent * (p["total"] - p["shared"]))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.explode(verified).alias("p"))
    return both.select("a", "b", "p.shared", (F.col("p.total") - F.col("p.shared")).alias("whole"))


def similar(rows: DataFrame, percent: int = 80) -> DataFrame:
    """A row for each of (id, text): id, class_id, n_links (other rows with an equal or similar text), best_id (class of the most similar different text, the smallest of equals) and its similarity.

    A row without text has itself as its class and no links; repeated rows of an id and a text are one.
    """
    own = classes(rows)
    pairs = similar_pairs(own, percent)
    ways = F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("b").alias("other")), F.struct(F.col("b").alias("key"), F.col("a").alias("other"))))
    of_other = own.select(F.col("key").alias("other"), F.col("n").alias("m"), F.col("class_id").alias("other_id"))
    links = pairs.select(ways.alias("w"), (F.col("shared") / F.col("whole")).alias("s")).select("w.*", "s").join(of_other, "other")
    told = links.groupBy("key").agg(F.sum("m").alias("linked"), F.max(F.struct("s", (-F.col("other_id")).alias("o"))).alias("best"))
    by_class = own.join(told, "key", "left").select("text", "class_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), (-F.col("best.o")).alias("best_id"), F.round("best.s", 6).alias("similarity"))
    ids = rows.filter("id is not null").select("id", normalized(F.col("text")).alias("text")).distinct()
    return ids.join(by_class, "text", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "best_id", "similarity")
