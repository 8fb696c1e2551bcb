"""The vector index: recall at two sizes, the exact way, lists that are read."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators.vector_index import Shape, VectorIndex
from docspark.plans import inspect

SCHEMA = "vec_id long, embedding array<float>, kind string"


def vectors(n, width=32, heads=40, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(heads, width))
    x = (centers[rng.integers(heads, size=n)] + 0.5 * rng.normal(size=(n, width))).astype(np.float32)
    return x


def table(spark, x, odd=True):
    rows = [(i, [float(v) for v in r], "even" if i % 2 == 0 else "odd") for i, r in enumerate(x)]
    if odd:
        rows += [(None, rows[0][1], "even"), (10**6, None, "odd"), (10**6 + 1, [], "odd"), (10**6 + 2, [0.0] * len(x[0]), "odd"), (10**6 + 3, [float("nan")] * len(x[0]), "odd"), (10**6 + 4, [1.0], "odd"), (10**6 + 5, [None] * len(x[0]), "odd")]
    return spark.createDataFrame(rows, SCHEMA)


def brute(x, q, k, some=None):
    x = x.astype(float)
    s = (x @ q.astype(float)) / np.linalg.norm(x, axis=1) / np.linalg.norm(q.astype(float))
    ids = np.arange(len(x)) if some is None else np.flatnonzero(some)
    return sorted(ids.tolist(), key=lambda i: (-round(s[i], 12), i))[:k]


@pytest.mark.parametrize("n", [600, 6000])
def test_recall_and_the_exact_way(spark, tmp_path, n):
    x = vectors(n)
    index = VectorIndex(table(spark, x), f"file://{tmp_path}/v", Shape(block=500))
    asked = list(range(0, n, 50))
    want = {i: brute(x, x[i], 10) for i in asked}
    queries = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in asked] + [(10**6, [0.0] * 32), (10**6 + 1, None), (None, [1.0] * 32)], "query_id long, embedding array<float>")
    got = {}
    for r in index.search_all(queries, 10).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(asked)
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in asked]) >= 0.9
    one = [len({r.vec_id for r in index.search(x[i].tolist(), 10).collect()} & set(want[i])) / 10 for i in asked[:6]]
    assert np.mean(one) >= 0.9
    for i in asked[:3]:
        assert [r.vec_id for r in index.exact(x[i].tolist(), 10).collect()] == want[i]
        assert [r.vec_id for r in index.exact(x[i].tolist(), 5, F.col("kind") == "odd").collect()] == brute(x, x[i], 5, np.arange(n) % 2 == 1)
        assert all(r.kind == "odd" for r in index.search(x[i].tolist(), 5, where=F.col("kind") == "odd").collect())
    every = {}
    for r in index.search_all(queries, 10, probes=10**6).collect():
        every.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(every[i] == set(want[i]) for i in asked)  # with all lists nothing is lost


def test_only_the_probed_lists_are_read(spark, tmp_path):
    x = vectors(900)
    index = VectorIndex(table(spark, x), f"file://{tmp_path}/v", Shape(lists=20))
    plan = inspect.physical(index.search(x[0].tolist(), 3, probes=2))
    found = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert "list" in found and len(set(re.findall(r"\d+", found.split("IN")[1]))) <= 2 + 1 if "IN" in found else "list" in found
    assert index.rows().count() == 900 and index.rows().select("list").distinct().count() > 5


def test_an_index_of_nothing_and_odd_queries(spark, tmp_path):
    index = VectorIndex(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none")
    assert index.exact([1.0], 3).count() == 0 and index.search([1.0], 3).count() == 0
    index = VectorIndex(table(spark, vectors(3), odd=True), f"file://{tmp_path}/few")
    assert index.search(vectors(3)[1].tolist(), 10).count() == 3
    for q in ([0.0] * 32, [1.0], [float("inf")] * 32):
        with pytest.raises(ValueError, match="finite"):
            index.search(q, 3)
