"""Embedding near-dedup (6): a forest of random-projection trees with spill overlap.

Vectors of one label and length are looked for within each other. A tree splits
recursively: each node has a random direction of its own and the median of a bounded
sample as its threshold, and vectors close to a threshold go to both sides. A node whose
vectors are on average as close as the least cosine isn't split, since most of its pairs
are links; blocks take its leaf apart. In a leaf
all vectors are compared by cosine in double precision; a pair counts in the first
leaf that holds both, so links are counted once although trees overlap.

A group (label and length) of n vectors has log2(n / leaf_rows) levels. The first
``fitted_levels`` of them are fitted on at most ``sample_rows`` vectors of the whole
table, on the driver. Deeper levels go on in rounds of ``fitted_levels`` more: each
node that is still to be split fits a subtree of its own on at most about
``node_rows`` of its vectors, in Spark, with directions and spill as above, and the
subtrees join back by node. A pair at the least cosine is parted by a level of one tree
with a probability that follows from the spread of the projections, which the sample
shows; the number of trees follows from that and from the number of levels, so that the
expected recall stays above ``recall`` at any size, up to ``most_trees``. All vectors
are indexed.

Equal vectors are one class, which is indexed once and counts with its size. A
leaf of many vectors is split into blocks; each pair of blocks is one task group,
so nothing grows without bound and no pairs are written: a group returns, for
each vector, a count and one edge to the smallest vector that its links reach there.

Defined cases. Null or unequal labels: never compared. Null, empty or zero vectors
and such with null or non-finite components link with nothing. Vectors of different
lengths are never compared; a length that the sample misses has one leaf. Null
vec_id: no component, kept. Repeated rows: members of one class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, graph


@dataclass(frozen=True)
class Forest:
    least_cosine: float = 0.93
    trees: int = 14
    most_trees: int = 100
    recall: float = 0.998
    leaf_rows: int = 400
    block_rows: int = 600
    #: Share of a node's sample on each side of a threshold that goes to both children.
    spill: float = 0.03
    sample_rows: int = 20_000
    #: Levels that one round fits.
    fitted_levels: int = 8
    node_rows: int = 20_000
    seed: int = 17

    @property
    def tight(self) -> float:
        """Standard deviation of the projections of unit vectors whose mean cosine is the least one."""
        return math.sqrt(1 - self.least_cosine)

    def trees_for(self, levels: int, spread: float = 1.0) -> int:
        """Trees enough for the recall; spread: standard deviation of projections in the nodes that are split."""
        if not levels:
            return self.trees
        # the pair's projections differ by a normal number; a median parts them with that times the density there
        parted = math.sqrt(2 - 2 * self.least_cosine) / math.pi / max(spread, self.tight)
        together = (1 - min(parted, 0.5)) ** levels
        return min(max(self.trees, math.ceil(math.log(1 - self.recall) / math.log(1 - together))), self.most_trees)


class Subtree:
    """Directions by node, drawn from a seed, and thresholds (low, middle, high) by node, of a tree of some levels; node n of a level has the children 2n and 2n + 1."""

    def __init__(self, seed: tuple[int, ...], levels: int, width: int):
        rng = np.random.default_rng(seed)
        self.seed, self.levels, self.width = seed, levels, width
        self.directions = [rng.standard_normal((1 << level, width)) for level in range(levels)]
        self.cuts = [np.zeros((1 << level, 3)) for level in range(levels)]

    def fit(self, sample: np.ndarray, how: Forest) -> Subtree:
        node, spreads, spill = np.zeros(len(sample), np.int64), [], how.spill
        for directions, cuts in zip(self.directions, self.cuts):
            at = np.einsum("ij,ij->i", sample, directions[node])
            order = np.argsort(node, kind="stable")
            edge = np.searchsorted(node[order], np.arange(len(cuts) + 1))
            for n in np.flatnonzero(np.diff(edge) >= 20):
                own = at[order[edge[n] : edge[n + 1]]]
                spread = own.std()
                if spread < how.tight:
                    cuts[n] = np.inf
                else:
                    cuts[n] = np.quantile(own, (0.5 - spill, 0.5, 0.5 + spill))
                    spreads.append(spread)
            node = 2 * node + (at > cuts[node, 1])
        self.spread = float(np.mean(spreads)) if spreads else 1.0
        return self

    def leaves(self, vectors: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) for each leaf that holds a row, each row going down so many levels, self.levels at most."""
        row, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        for level, (directions, cuts) in enumerate(zip(self.directions, self.cuts)):
            down = np.flatnonzero(levels[row] > level)
            if not len(down):
                break
            own = node[down]
            at = np.einsum("ij,ij->i", vectors[row[down]], directions[own])
            low, mid, high = cuts[own].T
            side = at > mid
            both = (at >= low) & (at <= high) & (high > low)
            node[down] = 2 * own + side
            node = np.concatenate([node, 2 * own[both] + ~side[both]])
            row = np.concatenate([row, row[down[both]]])
        return row, node

    def __reduce__(self):
        return _rebuilt, (self.seed, self.levels, self.width, self.thresholds())

    def thresholds(self) -> bytes:
        return b"".join(c.tobytes() for c in self.cuts)

    def set(self, thresholds: bytes) -> Subtree:
        """With stored thresholds; without any, each node splits at 0."""
        values, at = np.frombuffer(thresholds) if thresholds else np.zeros(3 << self.levels), 0
        for level in range(self.levels):
            self.cuts[level] = values[at : at + (3 << level)].reshape(-1, 3)
            at += 3 << level
        return self


def _rebuilt(seed: tuple[int, ...], levels: int, width: int, thresholds: bytes) -> Subtree:
    return Subtree(seed, levels, width).set(thresholds)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, scaled first so that very large and very small components keep their precision."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


#: A leaf's code holds its tree above its path; all vectors of a group go down equally far.
_TREE = 48


def _groups(values: np.ndarray):
    order = np.argsort(values, kind="stable")
    edge = np.flatnonzero(np.diff(values[order])) + 1
    return [(int(values[g[0]]), g) for g in np.split(order, edge)] if len(values) else []


def _by_width(column: pa.Array):
    """(width, rows, unit vectors) of the widths in a column of arrays."""
    offsets = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    base = offsets[0]
    for width, rows in _groups(np.diff(offsets)):
        yield width, rows, _unit(flat[(offsets[rows] - base)[:, None] + np.arange(width)])


def _first_leaves(shared):
    """Arrow UDF (embedding, levels) to leaf codes after the first round; ``shared`` broadcasts trees by width."""

    def run(column: pa.Array, levels: pa.Array) -> pa.Array:
        fitted = shared.value
        rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        deep = levels.to_numpy(zero_copy_only=False)
        for width, own, vectors in _by_width(column):
            if width not in fitted:
                rows.append(own)
                codes.append(np.zeros(len(own), np.int64))
            for t, tree in enumerate(fitted.get(width, ())):
                here = np.flatnonzero(deep[own] > 0) if t else np.arange(len(own))  # without levels one leaf holds all
                row, node = tree.leaves(vectors[here], deep[own[here]])
                rows.append(own[here[row]])
                codes.append((np.int64(t) << np.int64(_TREE)) | node)
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        counts = np.bincount(row, minlength=len(column))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(code[order]))

    return F.arrow_udf(run, "array<bigint>")


def _seed(how: Forest, round_: int, code: int) -> tuple[int, ...]:
    return how.seed, round_, code >> _TREE, code & ((1 << _TREE) - 1)


def _fit_node(how: Forest, round_: int):
    """A sample of one node's vectors to the thresholds of its subtree."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        code, levels = table.column("leaf")[0].as_py(), table.column("levels")[0].as_py()
        (width, _, vectors), = _by_width(table.column("embedding").combine_chunks())
        tree = Subtree(_seed(how, round_, code), min(levels, how.fitted_levels), width).fit(vectors, how)
        return pa.table({**{c: table.column(c).slice(0, 1) for c in ("label", "width", "leaf")}, "cuts": pa.array([tree.thresholds()], pa.binary())})

    return run


def _go_down(how: Forest, round_: int):
    """Arrow UDF (embedding, levels, leaf, cuts) to the codes below."""

    def run(column: pa.Array, levels: pa.Array, leaf: pa.Array, cuts: pa.Array) -> pa.Array:
        out: list = [None] * len(column)
        code, deep = leaf.to_numpy(zero_copy_only=False), levels.to_numpy(zero_copy_only=False)
        for width, own, vectors in _by_width(column):
            for c, rows in _groups(code[own]):
                for d, some in _groups(deep[own[rows]]):
                    at = rows[some]
                    depth = min(d, how.fitted_levels)
                    tree = Subtree(_seed(how, round_, c), depth, width)
                    for bytes_, group in _by_value([cuts[int(i)].as_py() for i in own[at]]):
                        row, node = tree.set(bytes_).leaves(vectors[at[group]], np.full(len(group), depth))
                        path = ((c & ((1 << _TREE) - 1)) << depth) | node
                        for r in range(len(group)):
                            out[own[at[group[r]]]] = (path[row == r] | (c >> _TREE << _TREE)).tolist()
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>")


def _by_value(values: list[bytes]):
    """A node of another label has the same code, but thresholds of its own."""
    found: dict[bytes, list[int]] = {}
    for i, v in enumerate(values):
        found.setdefault(v, []).append(i)
    return [(v, np.array(g)) for v, g in found.items()]


def _deeper(rows: DataFrame, how: Forest, rounds: int) -> DataFrame:
    """rows (label, width, class_id, size, embedding, levels, leaf) gone down the levels beyond the first round."""
    node = ["label", "width", "leaf"]
    kept = f"label {rows.schema['label'].dataType.simpleString()}, width int, leaf bigint, cuts binary"
    for r in range(1, rounds):
        rows = rows.withColumn("levels", F.col("levels") - how.fitted_levels)
        done, more = rows.filter("levels <= 0"), rows.filter("levels > 0")
        counts = frames.cut(more.groupBy(*node).agg(F.count("*").alias("n")))
        chance = F.pmod(F.xxhash64("class_id", F.lit(r)), F.lit(1 << 20)) < F.lit(how.node_rows) / F.col("n") * (1 << 20)
        cuts = frames.cut(more.join(counts, node).filter(chance).groupBy(*node).applyInArrow(_fit_node(how, r), kept))
        below = more.join(cuts, node, "left").withColumn("leaf", F.explode(_go_down(how, r)("embedding", "levels", "leaf", F.coalesce("cuts", F.lit(b"")))))
        rows = frames.cut(done.unionByName(below.drop("cuts")))
    return rows


def _common(codes_a: list[np.ndarray], codes_b: list[np.ndarray], i: np.ndarray, j: np.ndarray, leaf: int) -> np.ndarray:
    """Which pairs share a leaf with a smaller code."""
    if not len(i):
        return np.zeros(0, bool)
    pad = lambda codes: _padded([c[c < leaf] for c in codes])
    a, b = pad(codes_a), pad(codes_b)
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), 100_000):
        x, y = a[i[lo : lo + 100_000]], b[j[lo : lo + 100_000]]
        hit = np.zeros(len(x), bool)
        for c in range(x.shape[1]):
            hit |= ((x[:, c : c + 1] == y) & (x[:, c : c + 1] >= 0)).any(1)
        out[lo : lo + 100_000] = hit
    return out


def _padded(codes: list[np.ndarray]) -> np.ndarray:
    width = max(map(len, codes), default=0)
    out = np.full((len(codes), width), -1, np.int64)
    for r, c in enumerate(codes):
        out[r, : len(c)] = c
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the edges."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


def _compare(how: Forest):
    """One leaf, or one pair of its blocks: links found here first, and edges that connect what they link."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        leaf, left, right = (table.column(c)[0].as_py() for c in ("leaf", "left", "right"))
        block = table.column("block").to_numpy()
        ids, size = table.column("class_id").to_numpy(), table.column("size").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, size, block = ids[order], size[order], block[order]
        column = table.column("embedding").combine_chunks().take(pa.array(order))
        vectors = _unit(_matrix(column, len(column[0])))
        lists = table.column("leaves").combine_chunks()
        codes = [lists[int(r)].values.to_numpy() for r in order]
        found_i, found_j = [], []
        for lo in range(0, len(ids), 1000):
            i, j = np.nonzero(vectors[lo : lo + 1000] @ vectors.T >= how.least_cosine - 1e-9)
            i += lo
            keep = i < j
            if left != right:
                keep &= block[i] != block[j]
            i, j = i[keep], j[keep]
            exact = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= how.least_cosine
            found_i.append(i[exact])
            found_j.append(j[exact])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        new = ~_common(codes, codes, i, j, leaf)
        i, j = i[new], j[new]
        links = np.bincount(i, weights=size[j], minlength=len(ids)) + np.bincount(j, weights=size[i], minlength=len(ids))
        root = _roots(len(ids), i, j)
        some = links > 0
        return pa.table({"class_id": pa.array(ids[some]), "links": pa.array(links[some].astype(np.int64)), "reach": pa.array(ids[root[some]])})

    return run


def near_vectors(vectors: DataFrame, how: Forest = Forest()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label")
    usable = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    marked = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("print", F.sha2(F.concat_ws(",", "embedding").cast("binary"), 256))
    classes = marked.filter("usable").groupBy("label", "print").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("size"))
    members = frames.cut(marked.join(classes, ["label", "print"], "left").select("vec_id", "usable", F.when(F.col("usable"), F.col("class_id")).alias("class_id"), F.when(F.col("usable"), F.col("size")).alias("size"), "label", F.when(F.col("usable") & (F.col("vec_id") == F.col("class_id")), F.col("embedding")).alias("embedding")))
    chosen = members.filter("embedding is not null").dropDuplicates(["class_id"])
    chosen = chosen.select("class_id", "size", "label", F.size("embedding").alias("width"), F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = frames.cut(chosen.groupBy("label", "width").agg(F.count("*").alias("n")))
    levels = F.greatest(F.ceil(F.log2(F.col("n") / how.leaf_rows)), F.lit(0)).cast("int")
    chosen = chosen.join(sizes.select("label", "width", levels.alias("levels")), ["label", "width"])
    most = sizes.agg(F.max(levels)).first()[0]
    if most is not None:
        drawn = chosen.orderBy(F.xxhash64("class_id")).limit(how.sample_rows).select("embedding").toArrow().column(0).combine_chunks()
        # the sample is split by length; it bounds both the lengths that have trees and their size
        fitted = {}
        for w, _, v in _by_width(drawn):
            tree = lambda t: Subtree((how.seed, 0, t), min(most, how.fitted_levels), w).fit(v, how)
            one = tree(0)
            fitted[w] = [one, *map(tree, range(1, how.trees_for(most, one.spread)))]
        shared = spark.sparkContext.broadcast(fitted)
        index = _first_leaves(shared)
        rounds = max(1, math.ceil(most / how.fitted_levels))
        leaves = chosen.withColumn("leaves", index("embedding", "levels"))
        if rounds > 1:
            rows = _deeper(leaves.withColumn("leaf", F.explode("leaves")).drop("leaves"), how, rounds)
            codes = rows.groupBy("class_id").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
            leaves = chosen.join(codes, "class_id")
        leaves = frames.cut(leaves.drop("levels"))
        in_leaf = leaves.select("label", "width", F.explode("leaves").alias("leaf"), "class_id")
        blocks = in_leaf.groupBy("label", "width", "leaf").agg(F.ceil(F.count("*") / how.block_rows).cast("int").alias("blocks"))
        placed = leaves.withColumn("leaf", F.explode("leaves")).join(blocks, ["label", "width", "leaf"])
        placed = placed.withColumn("block", F.pmod(F.xxhash64("class_id"), "blocks").cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        placed = placed.withColumn("with", other).withColumn("left", F.least("block", "with")).withColumn("right", F.greatest("block", "with"))
        found = placed.groupBy("label", "width", "leaf", "left", "right").applyInArrow(_compare(how), "class_id bigint, links bigint, reach bigint")
        found = frames.cut(found)
        counts = found.groupBy("class_id").agg(F.sum("links").alias("links"))
        labels = graph.components(found.select(F.col("class_id").alias("a"), F.col("reach").alias("b"))).withColumnRenamed("node", "class_id")
        members = members.join(counts, "class_id", "left").join(labels, "class_id", "left")
    else:
        members = members.withColumn("links", F.lit(0)).withColumn("root", F.lit(None).cast("bigint"))
    component = F.coalesce("root", "class_id", "vec_id")
    links = F.when(F.col("usable"), F.coalesce("links", F.lit(0)) + F.col("size") - 1).otherwise(0)
    return members.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(frames.table(spark, sf_dir, "embeddings"))
