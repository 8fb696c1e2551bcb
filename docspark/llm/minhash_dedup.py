"""MinHash near-dedup (9): fast similarity sketching, banding, exact verification.

A document's set are its distinct 2-word shingles. A sketch of ``bins``
coordinates is filled in rounds: in round i each shingle goes to a hashed bin
with the value i + hash, and the smallest value stays; from round ``bins`` on,
round i fills bin i - bins, so every coordinate is filled after 2 * bins rounds.
Rounds end when no bin is empty, as later values are greater.

Documents with equal sets are one class (128-bit fingerprint and size) and go on
as their smallest id. Bands of coordinates put classes into buckets. In each
bucket every class is compared with the smallest, on full sets, and links join
classes into components. Then all classes that meet one smallest class somewhere and
are still in different components are compared with each other, in blocks of
bounded size, and only links between components come out. So no component is
missed, and a hot bucket of copies costs one comparison a
class. With the default bands a pair at
similarity 0.8 shares no bucket with probability (1 - 0.8**5)**32 = 3e-6.

Defined cases. Null, empty or blank text: an empty set, linked with nothing,
kept. One word: that word is the set. Rows without id: no component, kept.
Repeated rows: each gets its class's answer. Rows of one id with different texts
share the id's component. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, graph
from .textops import U64, Words, _multipliers, gather, long_lists, mix64, roll, sliced


@dataclass(frozen=True)
class Sketching:
    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in turn, and how many each has; fewer than k words are one shingle."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    rolled, index = words.windows(hashes, k)
    edge = np.searchsorted(index, words.first)
    sets = []
    for d in range(words.n_docs):
        lo, hi = edge[d], edge[d + 1]
        if hi > lo:
            sets.append(np.unique(rolled[lo:hi]))
        else:
            own = hashes[words.first[d] : words.first[d + 1]]
            sets.append(roll(own, len(own)) if len(own) else own)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.array([len(s) for s in sets], np.int64)


def sketches(flat: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """A row of ``bins`` coordinates for each set that isn't empty."""
    counts = counts[counts > 0]
    empty = np.iinfo(np.uint64).max
    out = np.full(len(counts) * bins, empty, U64)
    owner = np.repeat(np.arange(len(counts)) * bins, counts)
    salts = _multipliers(2 * bins, 9)
    for i in range(2 * bins):
        if not len(flat):
            break
        hashed = mix64(flat ^ salts[i])
        value = (U64(i) << U64(55)) | (hashed >> U64(9))
        at = ((hashed & U64(0xFFFFFFFF)) * U64(bins) >> U64(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(out, owner + at, value)
        open_sets = (out.reshape(-1, bins) == empty).any(1)
        more = open_sets[owner // bins]
        flat, owner = flat[more], owner[more]
    return out.reshape(-1, bins)


_SKETCH = pa.struct([("n_shingles", pa.int64()), ("print_a", pa.int64()), ("print_b", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sketch(how: Sketching):
    def run(text: pa.Array) -> pa.Array:
        out = []
        for part in sliced(text):
            flat, counts = shingle_sets(part, how.words)
            some = counts > 0
            grid = sketches(flat, counts, how.bins).reshape(-1, how.bands, how.rows)
            key = mix64((grid * _multipliers(how.rows, 11)).sum(2, dtype=U64) + np.arange(how.bands, dtype=U64) * U64(0x9E3779B97F4A7C15))
            prints = np.zeros((2, len(part)), U64)
            if some.any():
                first = (np.cumsum(counts) - counts)[some]
                for row, seed in zip(prints, (5, 6)):
                    row[some] = np.add.reduceat(mix64(flat ^ _multipliers(1, seed)[0]), first)
            out.append(pa.StructArray.from_arrays([pa.array(counts), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), long_lists(key.reshape(-1).view(np.int64), some * how.bands, pa.int64())], fields=list(_SKETCH)))
        return pa.concat_arrays(out) if out else pa.array([], _SKETCH)

    return F.arrow_udf(run, "struct<n_shingles: bigint, print_a: bigint, print_b: bigint, bands: array<bigint>>")


def overlap(k: int):
    """Arrow UDF of two text columns: size of both sets' intersection and union."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        (left, n), (right, m) = _sets(a, k), _sets(b, k)
        shared = np.zeros(len(n), np.int64)
        x, y = np.cumsum(n) - n, np.cumsum(m) - m
        for i in range(len(n)):
            both = np.concatenate([left[x[i] : x[i] + n[i]], right[y[i] : y[i] + m[i]]])
            both.sort()
            shared[i] = (both[1:] == both[:-1]).sum()
        return pa.StructArray.from_arrays([pa.array(shared), pa.array(n + m - shared)], names=["shared", "whole"])

    return F.arrow_udf(run, "struct<shared: bigint, whole: bigint>")


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [shingle_sets(part, k) for part in sliced(column)]
    return (np.concatenate([f for f, _ in parts]), np.concatenate([c for _, c in parts])) if parts else (np.zeros(0, U64), np.zeros(0, np.int64))


def compare(pairs: DataFrame, texts: DataFrame, how: Sketching) -> DataFrame:
    """pairs (a, b) with ``shared`` and ``whole`` from the full texts (id, text)."""
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(right, "b").join(left, "a")
    return joined.select("a", "b", overlap(how.words)("text_a", "text_b").alias("o")).select("a", "b", "o.shared", "o.whole")


#: Classes that are compared with each other in one task.
BLOCK = 250


def _link_blocks(how: Sketching):
    """Classes of one block, or of two, with components: component pairs that full sets link. No pairs of classes are written."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
        block, root = table.column("block").to_numpy(), table.column("root").to_numpy()
        flat, size = _sets(table.column("text").combine_chunks(), how.words)
        index = np.unique(flat, return_inverse=True)[1]
        start = np.cumsum(size) - size
        mark = np.zeros(int(index.max()) + 1 if len(index) else 0, np.int32)
        found: set[tuple[int, int]] = set()
        for x in np.flatnonzero(block == left).tolist():
            other = (root > root[x]) if left == right else (root != root[x])
            y = np.flatnonzero((np.minimum(size, size[x]) * 100 >= np.maximum(size, size[x]) * how.percent) & (block == right) & other)
            if not len(y):
                continue
            own = index[start[x] : start[x] + size[x]]
            mark[own] = 1
            shared = np.add.reduceat(mark[gather(index, start[y], size[y])], np.cumsum(size[y]) - size[y])
            mark[own] = 0
            hit = shared * 100 >= (size[x] + size[y] - shared) * how.percent
            found.update((min(int(root[x]), r), max(int(root[x]), r)) for r in root[y[hit]].tolist())
        a, b = ([p[k] for p in sorted(found)] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    spark = docs.sparkSession
    sketched = docs.select("doc_id", _sketch(how)(docs.text.cast("binary")).alias("s")).select("doc_id", "s.*")
    folder = frames.new_folder(spark, "minhash")
    sketched.write.parquet(f"{folder}/sketches")
    sketched = spark.read.parquet(f"{folder}/sketches")
    prints = ["print_a", "print_b", "n_shingles"]
    # cut, so that the joins back are plain ones, whose hot classes adaptive execution can split
    classes = frames.cut(sketched.filter("n_shingles > 0 and doc_id is not null").groupBy(*prints).agg(F.min("doc_id").alias("class_id")))
    members = frames.cut(sketched.select("doc_id", *prints).join(classes, prints, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")))
    chosen = sketched.join(classes.withColumnRenamed("class_id", "doc_id"), ["doc_id", *prints], "left_semi")
    rows = chosen.select(F.col("doc_id").alias("b"), F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("b").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = frames.cut(rows.join(buckets, "band").filter("a <> b"))  # classes by bucket, its smallest aside
    pairs = rows.select("a", "b").distinct()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter("doc_id is not null").join(wanted, "doc_id", "left_semi")
    texts.select(F.col("doc_id").alias("id"), "text").write.parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    linked = F.col("shared") * 100 >= F.col("whole") * how.percent
    first = frames.cut(compare(pairs, texts, how))
    # an id with several texts holds their classes together
    several = members.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).filter("a < z").select("doc_id", "a")
    same_id = members.join(several, "doc_id").filter("class_id > a").select("a", F.col("class_id").alias("b"))
    labels = frames.cut(graph.components(first.filter(linked).select("a", "b").union(same_id)))
    # second round: classes around one smallest class that are still in different components
    root = labels.select(F.col("node").alias("b"), "root")
    around = pairs.join(root, "b", "left").select("a", "b", F.coalesce("root", "b").alias("root"))
    # cut, so that the join back is a plain one, whose hot buckets adaptive execution can split
    mixed = frames.cut(around.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("lo < hi").select("a", "blocks"))
    around = around.join(mixed, "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    around = around.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("left", F.least("block", "with")).withColumn("right", F.greatest("block", "with"))
    around = around.drop("blocks", "with").join(texts.withColumnRenamed("id", "b"), "b")
    second = frames.cut(around.groupBy("a", "left", "right").applyInArrow(_link_blocks(how), "a bigint, b bigint").distinct())
    if second.limit(1).count():
        labels = graph.components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second))
    found = members.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.coalesce("root", "class_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: The contract of the query: 2-word shingles.
TWO_WORDS = Sketching(words=2)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(frames.table(spark, sf_dir, "documents").select("doc_id", "text"), TWO_WORDS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the smallest document of each component of near duplicates (five-word shingles, 0.8)."""
    frames.ship(spark)
    dropped = near_duplicates(docs.select("doc_id", "text")).filter(~F.col("kept")).select("doc_id").distinct()
    return frames.same_columns(docs.join(dropped, "doc_id", "left_anti"), docs)
