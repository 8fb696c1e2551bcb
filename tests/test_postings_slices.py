"""Postings are made of slices of a batch, which hold a bounded number of words."""

import pyarrow as pa

from docspark.operators import postings_index


def batch(counts):
    docs = [[f"w{(i * k) % 11}" for k in range(n)] for i, n in enumerate(counts)]
    sizes = [[n // 3, n - n // 3] for n in counts]
    return pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int64()), pa.array(docs, pa.list_(pa.string())), pa.array(sizes, pa.list_(pa.int32()))], names=["id", "words", "sizes"])


def test_postings_in_slices(monkeypatch):
    counts = [0, 5, 40, 0, 3, 100, 1, 0, 0, 7, 60, 2, 0]
    rows = batch(counts)
    whole = pa.Table.from_batches(postings_index._grouped(iter([rows]))).to_pylist()
    slices = list(postings_index._sliced(iter([rows]), 50))
    assert [s.column("id").to_pylist() for s in slices] == [[0, 1, 2, 3, 4], [5], [6, 7, 8, 9], [10], [11, 12]]
    slice_ = postings_index._sliced
    monkeypatch.setattr(postings_index, "_sliced", lambda batches: slice_(batches, 50))
    key = lambda r: (r["id"], r["token"])
    assert sorted(pa.Table.from_batches(postings_index._grouped(iter([rows]))).to_pylist(), key=key) == sorted(whole, key=key)
