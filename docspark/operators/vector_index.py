"""A stored vector index: lists around coarse centroids, product codes to preselect, exact scores in the end.

Vectors are stored as unit vectors, so a cosine is a dot product and no norm is ever
computed again. Each lies in the folder of its nearest centroid (its list), with a code of a
byte for each part of the vector: the nearest entry of that part's codebook. A query
opens the ``probes`` lists nearest to it, scores their codes by table lookup, reads the
vectors of the best ``k * more`` alone and ranks those exactly. A whole table of queries is
met with the lists by an equi-join, in blocks. ``exact`` ranks everything.

Centroids and codebooks are fitted on at most ``sample`` vectors, those with the
smallest hash of their id; every vector is indexed. A list of any size is spread over
files and tasks. Null vectors, zero vectors, those with null or non-finite components and
those of another length than the most frequent one have no direction to compare and aren't indexed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from ..streaming.monitors import cut, own_folder


@dataclass(frozen=True)
class Shape:
    #: 0: about the square root of the number of vectors, 1024 at most.
    lists: int = 0
    parts: int = 8
    entries: int = 64
    sample: int = 20_000
    rounds: int = 10
    #: Vectors of a list that go to one file and are compared as one block.
    block: int = 8192


def finite(x: Column) -> Column:
    return F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(x, lambda e: e != 0)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row, the first of equal ones."""
    return np.argmin((centers * centers).sum(1) - 2 * x @ centers.T, 1)


def centers_of(x: np.ndarray, k: int, rounds: int, seed: int = 5) -> np.ndarray:
    """k centers of a bounded sample, by Lloyd's rounds; empty ones start anew at a row."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        sums, n = np.zeros_like(centers), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centers


@dataclass(frozen=True)
class Model:
    centers: np.ndarray  # lists x width
    books: list[np.ndarray]  # for each part: entries x its width
    cuts: np.ndarray  # where the parts begin and end

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(x[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1).astype(np.uint8)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The nearest lists of each query, nearest first."""
        far = (self.centers * self.centers).sum(1) - 2 * q @ self.centers.T
        return np.argsort(far, 1, kind="stable")[:, :n]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


class VectorIndex:
    """The index of a table (vec_id, embedding, ...) in one folder."""

    def __init__(self, vectors: DataFrame, folder: str, shape: Shape = Shape()):
        self.spark, self.folder, self.shape = vectors.sparkSession, folder.rstrip("/"), shape
        ship(self.spark)
        self._build(vectors)

    def _build(self, vectors: DataFrame) -> None:
        x = F.col("embedding").cast("array<double>")
        norm = F.sqrt(F.aggregate("unit", F.lit(0.0), lambda s, v: s + v * v))
        good = vectors.filter("vec_id is not null").withColumn("unit", x).drop("embedding").filter(finite(F.col("unit")))
        self.columns = [c for c in good.columns if c != "unit"]
        sizes = good.groupBy(F.size("unit").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        self.width = sizes[0].n if sizes else 1
        good = good.filter(F.size("unit") == self.width).withColumn("norm_", norm).withColumn("unit", F.transform("unit", lambda v: v / F.col("norm_"))).drop("norm_")
        total = sizes[0]["count"] if sizes else 0
        sample = _matrix(good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(self.shape.sample).select("unit").toArrow().column("unit").combine_chunks()) if total else np.zeros((1, 1))
        cuts = np.linspace(0, self.width, min(self.shape.parts, self.width) + 1).astype(int)
        books = [centers_of(sample[:, a:b], min(self.shape.entries, 256), self.shape.rounds) for a, b in zip(cuts, cuts[1:])]
        model = self.model = Model(centers_of(sample, self.shape.lists or min(1024, max(1, int(total**0.5))), self.shape.rounds), books, cuts)

        def place(unit: pa.Array) -> pa.Array:
            x = _matrix(unit)
            if not len(x):
                return pa.array([], pa.struct([("list", pa.int32()), ("code", pa.binary())]))
            codes = model.codes(x)
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1]).tobytes()), pa.py_buffer(codes.tobytes())])
            return pa.StructArray.from_arrays([pa.array(nearest(x, model.centers).astype(np.int32)), packed], names=["list", "code"])

        placed = good.withColumn("p", F.arrow_udf(place, "struct<list: int, code: binary>")("unit")).select(*self.columns, "unit", "p.code", "p.list")
        spread = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-total // (self.shape.block * len(model.centers))))))  # a list of the usual size is one file
        placed.repartition("list", spread).sortWithinPartitions("list", "vec_id").write.partitionBy("list").parquet(f"{self.folder}/vectors")
        self.schema = placed.schema

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/vectors")

    def _unit(self, q: list[float]) -> np.ndarray:
        q = np.asarray(q, float)
        if q.shape != (self.width,) or not np.isfinite(q).all() or not q.any():
            raise ValueError(f"a query is {self.width} finite numbers, not all 0")
        return q / np.sqrt(q @ q)

    def _scored(self, rows: DataFrame, q: np.ndarray) -> DataFrame:
        own = F.array(*map(F.lit, q.tolist()))
        return rows.withColumn("score", F.aggregate(F.zip_with("unit", own, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))

    def exact(self, q: list[float], k: int, where: Column | None = None) -> DataFrame:
        """The k vectors with the highest cosine, smaller ids first among equals: a scan of the unit vectors."""
        rows = self.rows() if where is None else self.rows().filter(where)
        return self._scored(rows, self._unit(q)).orderBy(F.desc("score"), "vec_id").limit(k).drop("unit", "code", "list")

    def search(self, q: list[float], k: int, probes: int = 8, more: int = 20, where: Column | None = None) -> DataFrame:
        """The same out of the nearest lists: codes first, then the vectors of the best ``k * more``."""
        unit, model = self._unit(q), self.model
        near = self.rows().filter(F.col("list").isin([int(i) for i in model.probes(unit[None], probes)[0]]))
        near = near if where is None else near.filter(where)
        table = np.zeros((len(model.books), 256))
        for p, (a, b, book) in enumerate(zip(model.cuts, model.cuts[1:], model.books)):
            table[p, : len(book)] = book @ unit[a:b]

        def rough(code: pa.Array) -> pa.Array:
            codes = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(-1, len(table))
            return pa.array(table[np.arange(len(table)), codes].sum(1))

        best = near.select("vec_id", "list", F.arrow_udf(rough, "double")("code").alias("rough")).orderBy(F.desc("rough"), "vec_id").limit(k * more).select("vec_id", "list").collect()
        some = near.filter(F.col("vec_id").isin([r.vec_id for r in best]) & F.col("list").isin(sorted({r.list for r in best}) or [-1]))
        return self._scored(some, unit).orderBy(F.desc("score"), "vec_id").limit(k).drop("unit", "code", "list")

    def search_all(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """(query_id, place, vec_id, score) for a table of queries (query_id, embedding): each meets the vectors of its nearest lists, in blocks of both."""
        model, width, block = self.model, self.width, self.shape.block

        def lists(x: pa.Array) -> pa.Array:
            return _lists(model.probes(_matrix(x), probes).astype(np.int32)) if len(x) else pa.array([], pa.list_(pa.int32()))

        q = F.col("embedding").cast("array<double>")
        asked = queries.filter("query_id is not null").select("query_id", q.alias("q")).filter((F.size("q") == width) & finite(F.col("q")))
        asked = cut(asked.withColumn("list", F.explode(F.arrow_udf(lists, "array<int>")("q"))))
        blocks = lambda rows, name: rows.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
        sizes = cut(blocks(self.rows(), "of_rows").join(blocks(asked, "of_queries"), "list"))
        mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.rows().select("vec_id", "unit", "list").join(sizes, "list").select("vec_id", "unit", "list", mine("vec_id", "of_rows").alias("a"), every("of_queries").alias("b"))
        right = asked.join(sizes, "list").select("query_id", "q", "list", mine("query_id", "of_queries").alias("b"), every("of_rows").alias("a"))

        def compare(rows: pa.Table, some: pa.Table) -> pa.Table:
            out: tuple[list, list, list] = ([], [], [])
            if rows.num_rows and some.num_rows:
                ids = rows.column("vec_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], _matrix(rows.column("unit").combine_chunks())[order]
                y = _matrix(some.column("q").combine_chunks())
                y = y / np.sqrt((y * y).sum(1, keepdims=True))
                for lo in range(0, len(y), 256):
                    scores = y[lo : lo + 256] @ x.T
                    top = np.argsort(-scores, 1, kind="stable")[:, :k]
                    out[0].append(np.repeat(some.column("query_id").to_numpy()[lo : lo + 256], top.shape[1]))
                    out[1].append(ids[top].ravel())
                    out[2].append(np.take_along_axis(scores, top, 1).ravel())
            return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0), t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        keys = ("list", "a", "b")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("place", place).filter(F.col("place") <= k).select("query_id", "place", "vec_id", "score")


_built: dict[tuple, VectorIndex] = {}


def vector_index_of(spark: SparkSession, path: str, vectors: DataFrame) -> VectorIndex:
    """The stored index of a table's vectors, built when an application first asks for it, and anew when the table's files change."""
    from .postings_index import files_key

    key = files_key(spark, path)
    if key not in _built:
        _built[key] = VectorIndex(vectors, own_folder(spark, "vectors"))
    return _built[key]
