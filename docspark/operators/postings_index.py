"""A stored inverted index: positional postings in buckets of tokens, changed by segments, asked without a scan of the corpus.

A segment is a folder of tables. ``postings`` (token, block, id, tf, places) lies in buckets of the token's hash and is sorted by token, block and id, so a
query opens the buckets of its terms and, in them, the row groups that hold them. ``blocks``
(token, block, top) has the largest number of occurrences of a token in a document of a
block of ids: the bound by which whole blocks are skipped. ``words`` (token, docs, tf) is the
vocabulary, with its deletion neighbourhood in ``near`` (variant, token), which the first
query with typos writes.
``docs`` holds what is shown and filtered of each document.

A change set (upserts and deletes by id) is written as a segment of its own with the
ids it replaces; rows of older segments with those ids no longer count. ``merge`` writes
all that counts as one segment. A segment counts once its ``changed`` table, which is
written last, is complete; one that failed half-way is never seen.

At scale: a document's tokens are grouped within its own task, so postings are shuffled
once, as they are written; a frequent token is spread by its blocks of ids. Bounds of
blocks stay right after deletes, as they only fall.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches, ship
from ..streaming.monitors import own_folder

#: Attributes that are searched, best first.
ATTRIBUTES = ("title", "content")
#: Shown and filtered columns of a document, where the corpus has them.
SHOWN = ("title", "source_format", "lang", "file_size_bytes", "is_flagged")
# Word lengths from which on one typo and two typos are let pass.
ONE_TYPO, TWO_TYPOS = 5, 9
#: Words longer than this are matched as they are: runs of letters, not words that somebody mistypes.
LONGEST_TYPO = 40
#: Words that a scan's filter lists; more are joined.
MOST_LISTED = 1000


@dataclass(frozen=True)
class Layout:
    buckets: int = 64
    block_ids: int = 4096
    #: Blocks whose postings of one token go to one task.
    blocks_a_task: int = 256


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def bucket_of(token: Column, layout: Layout) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(layout.buckets)).cast("int")


#: Words whose postings are made at once.
WORDS = 1 << 17
#: A place is a word's number in its attribute, plus this for each better attribute.
ATTRIBUTE = 1 << 40


def _sliced(batches: Iterator[pa.RecordBatch], most: int = WORDS) -> Iterator[pa.RecordBatch]:
    """The batches' documents in slices of at most so many words; a longer document is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words of all attributes, their number in each) to a row for each distinct word of a document, with its places."""
    for batch in _sliced(batches):
        words = batch.column("words").flatten().dictionary_encode()
        if not len(words):
            continue
        code = words.indices.to_numpy().astype(np.int64)
        sizes = batch.column("sizes").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
        row = np.repeat(np.arange(len(sizes)), sizes.sum(1))
        flat = sizes.ravel()
        attr = np.repeat(np.tile(np.arange(sizes.shape[1]), len(sizes)), flat)
        place = np.arange(len(code)) - np.repeat(np.cumsum(flat) - flat, flat) + attr * ATTRIBUTE
        order = np.lexsort((place, code, row))
        key = row[order] * len(words.dictionary) + code[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        in_text = np.add.reduceat((attr[order] == sizes.shape[1] - 1).astype(np.int64), first)
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(place[order]))
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[order][first])), batch.column("id").take(pa.array(row[order][first])), pa.array(in_text), places], names=["token", "id", "tf", "places"])


_POSTINGS = "token string, block bigint, id bigint, tf bigint, places array<bigint>"
_PARTED = {"postings": f"{_POSTINGS}, bucket int", "blocks": "token string, block bigint, top bigint, docs bigint, tf bigint, bucket int", "near": "variant string, token string, bucket int"}


def postings(docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(token, block, id, tf, places) of docs with a long id and ATTRIBUTES, without a shuffle; tf counts the text, the last attribute. Rows without id, null and empty texts have none."""
    parts = [F.coalesce(tokens(F.col(a)), F.array().cast("array<string>")) for a in ATTRIBUTES]
    rows = docs.filter("id is not null").select(F.col("id").cast("long").alias("id"), *(p.alias(f"w{k}") for k, p in enumerate(parts)))
    names = [f"w{k}" for k in range(len(parts))]
    found = rows.select("id", F.concat(*names).alias("words"), F.array(*(F.size(n) for n in names)).alias("sizes")).mapInArrow(_grouped, "token string, id bigint, tf bigint, places array<bigint>")
    return found.select("token", F.floor(F.col("id") / layout.block_ids).cast("long").alias("block"), "id", "tf", "places")


def typos_allowed(word: Column) -> Column:
    n = F.length(word)
    return F.when(n > LONGEST_TYPO, 0).when(n >= TWO_TYPOS, 2).when(n >= ONE_TYPO, 1).otherwise(0)


def with_deletions(words: DataFrame, column: str, cuts: Column) -> DataFrame:
    """words with ``variant``: what is left of the column when at most ``cuts`` (0 to 2) of its letters go. Two words within edit distance d share a variant with at most d letters gone from each."""
    w, n = F.col(column), F.length(column)
    own = words.withColumn("cuts", cuts)
    one = own.filter((F.col("cuts") >= 1) & (n > 1)).withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    two = one.filter((F.col("cuts") >= 2) & (F.col("i") < n) & (n > 2)).withColumn("j", F.explode(F.sequence(F.col("i") + 1, n)))
    head, tail = w.substr(F.lit(1), F.col("i") - 1), lambda k: w.substr(F.col(k) + 1, n)
    gone = own.withColumn("variant", w).union(one.withColumn("variant", F.concat(head, tail("i"))).drop("i"))
    return gone.union(two.withColumn("variant", F.concat(head, w.substr(F.col("i") + 1, F.col("j") - F.col("i") - 1), tail("j"))).drop("i", "j")).drop("cuts")


def neighbourhood(words: DataFrame) -> DataFrame:
    """(variant, token): the deletion neighbourhood of a vocabulary, as far as the typos of a term can reach: a term of two typos meets words two letters shorter."""
    n = F.length("token")
    return with_deletions(words.select("token"), "token", F.when(n > LONGEST_TYPO + 2, 0).when(n >= TWO_TYPOS - 2, 2).when(n >= ONE_TYPO - 1, 1).otherwise(0)).select("variant", "token")


class Index:
    """Segments of postings in one folder."""

    def __init__(self, spark: SparkSession, folder: str, layout: Layout = Layout()):
        self.spark, self.folder, self.layout = spark, folder.rstrip("/"), layout
        self._frames: dict[tuple[str, str], DataFrame] = {}
        ship(spark)
        bound_batches(spark)

    def _path(self, uri: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def segments(self) -> list[int]:
        """Numbers of the segments that count: all complete ones from the last merged one on."""
        root, store = self._path(self.folder)
        names = [s.getPath().getName() for s in store.listStatus(root)] if store.exists(root) else []
        numbers = sorted((int(m[2]), m[1]) for n in names if (m := re.fullmatch(r"(base|segment)=(\d+)", n)))
        done = [(n, kind) for n, kind in numbers if (where := self._path(f"{self.folder}/{kind}={n}/changed/_SUCCESS"))[1].exists(where[0])]
        base = max((n for n, kind in done if kind == "base"), default=0)
        self._kinds = {n: kind for n, kind in done}
        return [n for n, _ in done if n >= base]

    def _next(self) -> int:
        root, store = self._path(self.folder)
        names = [s.getPath().getName() for s in store.listStatus(root)] if store.exists(root) else []
        return 1 + max((int(n.split("=")[1]) for n in names if "=" in n), default=0)

    def _read(self, folder: str, name: str) -> DataFrame:
        """A table of a segment; its files are listed once, as they never change."""
        if (folder, name) not in self._frames:
            reader = self.spark.read.schema(_PARTED[name]) if name in _PARTED else self.spark.read
            self._frames[folder, name] = reader.parquet(f"{folder}/{name}")
        return self._frames[folder, name]

    def _table(self, name: str) -> DataFrame | None:
        """A table of all segments that count, with the number of its ``segment``."""
        parts = [self._read(f"{self.folder}/{self._kinds[n]}={n}", name).withColumn("segment", F.lit(n)) for n in self.segments()]
        whole = None
        for p in parts:
            whole = p if whole is None else whole.unionByName(p)
        return whole

    def _write(self, folder: str, rows: DataFrame, docs: DataFrame, changed: DataFrame) -> None:
        b, lay = bucket_of(F.col("token"), self.layout), self.layout
        kept = rows.withColumn("bucket", b).withColumn("part", F.floor(F.col("block") / lay.blocks_a_task))
        dealt = kept.repartition("bucket", "part").sortWithinPartitions("bucket", "token", "block", "id").drop("part")
        dealt.write.partitionBy("bucket").option("parquet.block.size", 16 << 20).parquet(f"{folder}/postings")
        stored = self._read(folder, "postings")
        blocks = stored.groupBy("bucket", "token", "block").agg(F.max("tf").alias("top"), F.count_if(F.col("tf") > 0).alias("docs"), F.sum("tf").alias("tf"))
        blocks.repartition("bucket").sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").parquet(f"{folder}/blocks")
        words = self._read(folder, "blocks").groupBy("token").agg(F.sum("docs").alias("docs"), F.sum("tf").alias("tf"))
        words.sort("token").write.parquet(f"{folder}/words")
        docs.write.parquet(f"{folder}/docs")
        changed.select("id").distinct().write.parquet(f"{folder}/changed")  # last: the segment counts from here on

    def _write_near(self) -> None:
        """The deletion neighbourhoods of the segments that have none yet: the first query with typos writes them."""
        for n in self.segments():
            folder = f"{self.folder}/{self._kinds[n]}={n}"
            path, store = self._path(f"{folder}/near/_SUCCESS")
            if not store.exists(path):
                near = neighbourhood(self._read(folder, "words").select("token")).withColumn("bucket", F.pmod(F.xxhash64("variant"), F.lit(self.layout.buckets)).cast("int"))
                near.repartition("bucket").sortWithinPartitions("bucket", "variant").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/near")

    def _shown(self, docs: DataFrame) -> DataFrame:
        return docs.filter("id is not null").select(F.col("id").cast("long").alias("id"), *(c for c in SHOWN if c in docs.columns))

    def build(self, docs: DataFrame) -> None:
        """All of docs as the index; ids are unique."""
        self._write(f"{self.folder}/base={self._next()}", postings(docs, self.layout), self._shown(docs), self._shown(docs))

    def apply(self, changes: DataFrame) -> None:
        """A change set of (op, id, ...): op upsert replaces or adds a document, delete drops it; one row an id. Nothing else is written anew."""
        known = F.when(F.lower("op").isin("upsert", "delete"), F.lower("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
        changes = changes.withColumn("op", known)
        docs = changes.filter("op = 'upsert'")
        self._write(f"{self.folder}/segment={self._next()}", postings(docs, self.layout), self._shown(docs), changes.select(F.col("id").cast("long").alias("id")))

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Rows (id, segment) that no later segment replaces."""
        numbers = self.segments()
        later = self._table("changed")
        if len(numbers) < 2:
            return rows
        last = later.filter(F.col("segment") > numbers[0]).groupBy("id").agg(F.max("segment").alias("last"))
        return rows.join(last, "id", "left").filter("last is null or segment >= last").drop("last")

    def merge(self) -> None:
        """All that counts as one segment; the old ones go."""
        old = [(n, self._kinds[n]) for n in self.segments()]
        if len(old) < 2:
            return
        rows = self._latest(self._table("postings")).drop("bucket", "segment")
        docs = self.docs().drop("segment")
        self._write(f"{self.folder}/base={self._next()}", rows, docs, docs)
        for n, kind in old:
            path, store = self._path(f"{self.folder}/{kind}={n}")
            store.delete(path, True)

    def docs(self) -> DataFrame:
        return self._latest(self._table("docs")).drop("segment")

    def _of(self, name: str, column: str, values: list[str]) -> DataFrame:
        """Rows of the values alone: their buckets' files are the only ones listed in the scan."""
        rows = self._table(name)
        numbers = self.spark.createDataFrame([(v,) for v in values], "v string").select(F.pmod(F.xxhash64("v"), F.lit(self.layout.buckets)).cast("int")).distinct().collect()
        return rows.filter(F.col("bucket").isin([n[0] for n in numbers]) & F.col(column).isin(values))

    def postings_of(self, terms: list[str]) -> DataFrame:
        """(token, block, id, tf, places) of some tokens."""
        return self._latest(self._of("postings", "token", terms)).drop("bucket", "segment")

    def hits(self, terms: list[str]) -> DataFrame:
        """(id, words, tf) of every document whose text holds one of the terms: how many of them, and how often."""
        return _counted(self.postings_of(terms))

    def vocabulary(self) -> DataFrame:
        """(token, docs, tf) of all texts."""
        if len(self.segments()) == 1:
            return self._table("words").filter("docs > 0").drop("segment")
        rows = self._latest(self._table("postings")).filter("tf > 0")
        return rows.groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))

    def _vocabulary_of(self, words: list[str]) -> DataFrame:
        """(token, docs) of some words."""
        return self.vocabulary().filter(F.col("token").isin(words)).select("token", "docs")

    def _norms(self) -> DataFrame:
        """(id, norm): the length of each document's vector of weights, written once for the segments that count."""
        numbers = self.segments()
        path = f"{self.folder}/norms-{'-'.join(map(str, numbers))}"
        where, store = self._path(f"{path}/_SUCCESS")
        if not store.exists(where):
            rows = self._latest(self._table("postings")).filter("tf > 0").select("id", "token", "tf")
            weights = rows.join(self.vocabulary().select("token", "docs"), "token").withColumn("w", _weight(self.docs().count()))
            weights.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def derived_query(self, text: str, terms: int = 10) -> list[tuple[str, float]]:
        """The words that tell a text from the others, with their weights: occurrences times the logarithm of 1 + documents over documents that hold it."""
        own = self.spark.createDataFrame([(text,)], "text string").select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("tf"))
        known = own.join(self._vocabulary_of(sorted({r.token for r in own.select("token").collect()})), "token")  # the words of one text
        best = known.select("token", _weight(self.docs().count()).alias("w")).orderBy(F.desc(F.round("w", 9)), "token").limit(terms).collect()
        return [(r.token, r.w) for r in best]

    def related(self, text: str, k: int, without: int | None = None, terms: int = 10, where: Column | None = None) -> DataFrame:
        """(id, score): the documents nearest to a text by the weights of its derived query, over the length of their own vectors."""
        query = self.derived_query(text, terms)
        asked = self.spark.createDataFrame(query, "token string, q double")
        rows = self.postings_of([w for w, _ in query]).filter("tf > 0").join(asked, "token").join(self._vocabulary_of([w for w, _ in query]), "token")
        shown = (self.docs() if where is None else self.docs().filter(where)).select("id")
        found = rows.filter(F.lit(True) if without is None else F.col("id") != without).withColumn("w", _weight(self.docs().count()))
        scored = found.groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("dot")).join(self._norms(), "id").join(shown, "id")
        return scored.select("id", (F.col("dot") / F.col("norm")).alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(k)

    def bounds(self, terms: list[str]) -> DataFrame:
        """(block, words, tf): at most what a document of each block can have."""
        each = self._of("blocks", "token", terms).filter("top > 0").groupBy("block", "token").agg(F.max("top").alias("top"))
        return each.groupBy("block").agg(F.count("*").alias("words"), F.sum("top").alias("tf"))

    def top(self, terms: list[str], k: int, where: Column | None = None) -> DataFrame:
        """The k best documents by (words, tf, smaller id) of those that meet ``where``, as (id, words, tf) and the shown columns.

        The blocks with the highest bounds are read first; the k-th of their documents
        is the mark that any other block's bound has to reach to be read at all.
        """
        terms = sorted({t for t in terms if t})
        shown = self.docs() if where is None else self.docs().filter(where)
        if not terms:
            return shown.limit(0).select("id", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("tf"), *[c for c in shown.columns if c != "id"])
        bounds = self.bounds(terms)
        best = [F.desc("words"), F.desc("tf"), F.col("id")]
        first = bounds.orderBy(F.desc("words"), F.desc("tf"), "block").limit(max(1, 2 * k // 100 + 4)).select("block", "words", "tf").collect()
        rows = self.postings_of(terms)
        ranked = lambda some: _counted(some).join(shown, "id").orderBy(*best).limit(k)
        seen = ranked(rows.filter(F.col("block").isin([r.block for r in first]))).select("words", "tf").collect()
        if len(seen) == k:
            mark = F.struct(F.lit(seen[-1].words).cast("long").alias("words"), F.lit(seen[-1].tf).cast("long").alias("tf"))
            bounds = bounds.filter(F.struct(F.col("words").cast("long").alias("words"), F.col("tf").cast("long").alias("tf")) >= mark)
        return ranked(rows.join(bounds.select("block"), "block", "left_semi"))

    def corrections(self, terms: list[str]) -> DataFrame:
        """(term, place, token, typos): the words of the vocabulary that may stand for each term, itself included."""
        self._write_near()
        asked = self.spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, place int")
        variants = with_deletions(asked.withColumn("allowed", typos_allowed(F.col("term"))), "term", F.col("allowed"))
        wanted = [r.variant for r in variants.select("variant").distinct().collect()]  # a few hundred a term
        met = F.broadcast(variants).join(self._of("near", "variant", wanted).select("variant", "token").distinct(), "variant")
        typos = F.levenshtein("term", "token")
        return met.withColumn("typos", typos).filter(F.col("typos") <= F.col("allowed")).select("term", "place", "token", "typos").distinct()

    def ranked(self, terms: list[str], k: int, where: Column | None = None, sort: Column | None = None) -> DataFrame:
        """The k best by words, typos, proximity, attribute, ``sort``, exactness and id: each rule decides among the documents that the ones before leave equal.

        words: terms that the document holds, typos let pass. typos: edits of the best match
        of each. proximity: the words between them in the smallest stretch of one attribute
        that holds them all, 8 for each term after the first at most. attribute: terms that the
        title doesn't hold. exactness: terms held as they were typed.
        """
        terms = [t for t in dict.fromkeys(terms) if t]
        fixes = self.corrections(terms)
        few = fixes.limit(MOST_LISTED + 1).collect()
        if len(few) <= MOST_LISTED:
            fixes = self.spark.createDataFrame(few, fixes.schema)
            rows = self.postings_of(sorted({r.token for r in few}))
        else:  # too many for the filter of a scan
            rows = self._latest(self._table("postings")).drop("bucket", "segment")
        shown = self.docs() if where is None else self.docs().filter(where)
        found = rows.join(fixes, "token").groupBy("id").agg(F.collect_list(F.struct("place", "typos", "places")).alias("found"))
        # the best of a document's matches of each term; null for terms that it doesn't hold
        of = lambda i: F.filter("found", lambda f: f["place"] == i)
        each = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(terms) - 1)), lambda i: F.struct(F.array_min(F.transform(of(i), lambda f: f["typos"])).alias("typos"), F.array_min(F.flatten(F.transform(of(i), lambda f: f["places"]))).alias("first"))), lambda m: m["first"].isNotNull())
        placed = F.array_sort(F.flatten(F.transform("found", lambda f: F.transform(f["places"], lambda p: F.struct(p.alias("at"), f["place"].alias("place"))))))
        count = lambda test: F.size(F.filter("each", test)).cast("long")
        docs = found.select("id", each.alias("each"), placed.alias("placed")).select(
            "id", F.size("each").cast("long").alias("words"), F.aggregate("each", F.lit(0).cast("long"), lambda a, m: a + m["typos"]).alias("typos"),
            _smallest_span(F.col("placed"), F.size("each").cast("long"), len(terms)).alias("proximity"), count(lambda m: m["first"] >= ATTRIBUTE).alias("attribute"), count(lambda m: m["typos"] == 0).alias("exactness"),
        )
        order = [F.desc("words"), F.col("typos"), F.col("proximity"), F.col("attribute"), *([sort] if sort is not None else []), F.desc("exactness"), F.col("id")]
        return docs.join(shown, "id").orderBy(*order).limit(k)


def _weight(n: int) -> Column:
    return F.col("tf") * F.log(1 + F.lit(float(n)) / F.col("docs"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.filter("tf > 0").groupBy("id").agg(F.count_distinct("token").alias("words"), F.sum("tf").alias("tf"))


def _smallest_span(placed: Column, words: Column, n: int) -> Column:
    """Words between the terms in the smallest stretch that holds all of a document's matched terms: one pass over the merged places, with the last place of each term."""
    never = -(1 << 60)
    start = F.struct(F.array_repeat(F.lit(never), n).alias("last"), F.lit(1 << 60).alias("best"))

    def step(state, x):
        last = F.transform(state["last"], lambda v, i: F.when(i == x["place"], x["at"]).otherwise(v))
        seen = F.filter(last, lambda v: v > never)
        span = F.when(F.size(seen) == words, x["at"] - F.array_min(seen)).otherwise(F.lit(1 << 60))
        return F.struct(last.alias("last"), F.least(state["best"], span).alias("best"))

    best = F.aggregate(placed, start, step)["best"]
    return F.least(F.greatest(best - (words - 1), F.lit(0)), 8 * (words - 1)).cast("long")


_built: dict[tuple, Index] = {}


def files_key(spark: SparkSession, path: str) -> tuple:
    """What tells a table of an application from another, and from itself with other files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in (store.listStatus(where) if store.exists(where) else [])))
    return spark.sparkContext.applicationId, path, files


def index_of(spark: SparkSession, path: str, docs: DataFrame) -> Index:
    """The stored index of a table's documents, built when an application first asks for it, and anew when the table's files change."""
    key = files_key(spark, path)
    if key not in _built:
        index = Index(spark, own_folder(spark, "postings"))
        index.build(docs)
        _built[key] = index
    return _built[key]
