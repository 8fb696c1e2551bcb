"""Centroid clustering (12): ball k-means over vectors of integers.

A cluster is a ball: its centroid and the largest distance of a member. A centroid j
can take a member x from cluster i only if half its distance to centroid i doesn't
exceed that of x, so a ball's neighbours are the centroids with half distance up to
its radius. Half distances to the neighbours in ascending order cut the ball into a
core, whose members stay without a comparison, and annuli: a member of annulus t is
compared with the first t neighbours alone. All is exact: distances are squared and
integer, the test is 4 * d(x, i) >= d(i, j), and ties go to the smaller number.

Each round reads the vectors with their cluster of the round before, moves them, and
writes them anew; each task adds a row for each cluster with the sums, the number, the
radius and the distances of its members, so the next centroids come from a few rows,
whose columns are empty elsewhere, and not from a shuffle of vectors. A cluster that holds a third of all vectors is worked
off like any other, since nothing is grouped by cluster but those rows. A round's table
is deleted once the next one is written. Rounds end early if no centroid moves: all
later ones would be equal.

Vectors: exactly ``dimensions`` components, none null or not finite, each turned into
floor(scale * x). Beyond ``largest`` (2^26.5 with 64 components) four times a squared
distance might not fit into 64 bits; such a component raises an error.

Defined cases. Null vectors and those of another length or with null or non-finite
components: left out. Null id: clustered, but no starting centroid. Repeated rows: vectors
of their own. Fewer vectors than k: as many centroids. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames

_ROWS = "kind int, vec_id bigint, cluster int, distance bigint, v binary, n bigint, sums array<bigint>, radius bigint, inertia decimal(38,0)"


@dataclass(frozen=True)
class Clustering:
    k: int = 8
    rounds: int = 10
    dimensions: int = 64
    scale: float = 1024.0
    seed: int = 3


def kept_vectors(embeddings: DataFrame, how: Clustering) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that are clustered."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return embeddings.filter((F.size(x) == how.dimensions) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))


def largest(width: int) -> int:
    """The largest component, so that 4 times the squared distance of two vectors stays under 2^63."""
    return math.isqrt(((1 << 63) - 1) // (16 * width))


def to_integers(values: np.ndarray, scale: float) -> np.ndarray:
    """Rows of vectors as integers."""
    whole = np.floor(values * scale)
    if whole.size and max(-whole.min(), whole.max()) > largest(values.shape[1]):
        raise ValueError("a component is too large: squared distances might not fit into 64 bits")
    return whole.astype(np.int64)


def squared(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one center, exact."""
    apart = x - center
    return np.einsum("ij,ij->i", apart, apart)


def moved(x: np.ndarray, own: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest center of each row and its squared distance, from the centers they had; and the number of distances that were computed."""
    between = np.stack([squared(centers, c) for c in centers])
    cluster, distance, computed = own.copy(), np.zeros(len(x), np.int64), len(x)
    for i in np.unique(own):
        members = np.flatnonzero(own == i)
        vectors = x[members]
        at = squared(vectors, centers[i])
        radius = at.max()
        near = np.flatnonzero(between[i] <= 4 * radius)  # the ball's neighbours
        near = near[near != i]
        near = near[np.argsort(between[i, near], kind="stable")]
        annulus = np.searchsorted(between[i, near], 4 * at, side="right")  # 0: the stable core
        best, least = np.full(len(members), i), at.copy()
        for t, j in enumerate(near):
            ask = np.flatnonzero(annulus > t)
            if not len(ask):
                break  # neighbours are in ascending order
            other = squared(vectors[ask], centers[j])
            computed += len(ask)
            better = (other < least[ask]) | ((other == least[ask]) & (j < best[ask]))
            best[ask[better]], least[ask[better]] = j, other[better]
        cluster[members], distance[members] = best, least
    return cluster, distance, computed


def _round(centers: np.ndarray, how: Clustering, first: bool):
    """Rows of vectors (from ``kept_vectors`` in the first round) to moved ones, and a row for each cluster of the task."""
    schema = pa.schema([("kind", pa.int32()), ("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("v", pa.binary()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("radius", pa.int64()), ("inertia", pa.decimal128(38, 0))])
    k, width = centers.shape

    def run(batches):
        count, sums, radius, inertia = np.zeros(k, np.int64), np.zeros((k, width), np.int64), np.zeros(k, np.int64), [0] * k
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if first:
                x = to_integers(batch.column("embedding").flatten().to_numpy().reshape(n, width), how.scale)
                own = np.zeros(n, np.int64)
            else:
                raw = b"".join(batch.column("v").to_pylist())
                x, own = np.frombuffer(raw, np.int32).reshape(n, width).astype(np.int64), batch.column("cluster").to_numpy().astype(np.int64)
            cluster, distance, _ = moved(x, own, centers)
            np.add.at(sums, cluster, x)
            count += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, distance)
            for c in np.unique(cluster):
                inertia[c] += sum(map(int, distance[cluster == c])) if distance.max() > 1 << 40 else int(distance[cluster == c].sum())
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (4 * width))
            packed = pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(x.astype(np.int32)).tobytes())])
            none = lambda kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance), packed, *(none(schema.field(c).type) for c in ("n", "sums", "radius", "inertia"))], schema=schema)
        have = np.flatnonzero(count)
        if len(have):
            m = len(have)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(have.astype(np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(count[have]), pa.array(list(sums[have]), pa.list_(pa.int64())), pa.array(radius[have]), pa.array([inertia[c] for c in have], pa.decimal128(38, 0))],
                schema=schema,
            )

    return run


def _balls(rows: DataFrame, width: int) -> dict[int, tuple]:
    """cluster: (n, sums, radius, inertia) from the rows of the tasks; k rows come to the driver."""
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    summed = rows.filter("kind = 1").groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(wide(F.col("sums")[i]) for i in range(width))).alias("sums"), F.max("radius").alias("radius"), F.sum("inertia").alias("inertia"))
    return {r.cluster: (r.n, [int(s) for s in r.sums], r.radius, int(r.inertia)) for r in summed.collect()}


def starting_centers(vectors: DataFrame, how: Clustering) -> np.ndarray:
    """The vectors whose ids, hashed with the seed, come first: k rows of the table."""
    print_ = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.filter("vec_id is not null").orderBy(print_, "embedding").limit(how.k).collect()
    return to_integers(np.array([r.embedding for r in rows], float).reshape(-1, how.dimensions), how.scale)


def cluster(embeddings: DataFrame, how: Clustering = Clustering()) -> DataFrame:
    """(vec_id, cluster, distance, n_members, radius, cluster_inertia, inertia, centroid_sha256, centroid) of the vectors of embeddings (vec_id, embedding)."""
    spark = embeddings.sparkSession
    frames.ship(spark)
    vectors = kept_vectors(embeddings, how)
    centers = starting_centers(vectors, how)
    if not len(centers):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, n_members bigint, radius bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    folder, before = frames.new_folder(spark, "ball-kmeans"), None
    for turn in range(how.rounds + 1):
        source = vectors if before is None else spark.read.parquet(before).filter("kind = 0").select("vec_id", "v", "cluster")
        path = f"{folder}/round={turn}"
        source.mapInArrow(_round(centers, how, before is None), _ROWS).write.parquet(path)
        if before is not None:
            frames.delete(spark, before)
        before = path
        balls = _balls(spark.read.parquet(path), how.dimensions)
        after = centers.copy()
        for c, (n, sums, _, _) in balls.items():
            after[c] = [s // n for s in sums]
        if turn == how.rounds or (after == centers).all():
            break
        centers = after
    whole = sum(b[3] for b in balls.values())
    told = [(c, n, radius, own, whole, hashlib.sha256(",".join(map(str, centers[c].tolist())).encode()).hexdigest(), centers[c].tolist()) for c, (n, _, radius, own) in balls.items()]
    of = spark.createDataFrame(told, "cluster int, n_members bigint, radius bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    rows = spark.read.parquet(before).filter("kind = 0").select("vec_id", "cluster", "distance")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "n_members", "radius", "cluster_inertia", "inertia", "centroid_sha256", "centroid")  # k rows


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return cluster(frames.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select(*columns)
