"""The language model's arrays lie in a bounded number of files, whatever the number of parts."""

import glob
import os

import numpy as np
import pyarrow as pa
import pytest
from test_ops import corpus

from docspark.llm import arrays, lm_scoring


def fitted(spark):
    texts = [(r[1] or "").encode() for r in corpus()]
    model = lm_scoring.fit(spark.createDataFrame([(t,) for t in texts], "text binary"))
    return model, lm_scoring.log_probabilities(pa.array(texts, pa.binary()), model)


def test_many_parts_few_files(spark, monkeypatch):
    """As many parts as an input asks for that is much larger: same scores, and few files are open; at 6 GB there were too many."""
    _, want = fitted(spark)
    monkeypatch.setattr(lm_scoring, "PART_ROWS", 40)
    before = len(os.listdir("/proc/self/fd"))
    model, got = fitted(spark)
    opened = len(os.listdir("/proc/self/fd")) - before
    assert len(model.pair_sizes) >= 512 and len(model.vocab_sizes) >= 64 and 0 < opened <= 17 * 32
    for path in glob.glob(f"{arrays.local_path(model.folder)}/*/keys-0.npy"):
        assert len(glob.glob(path.replace("-0.npy", "-*.npy"))) <= 32
    assert not glob.glob(f"{arrays.local_path(model.folder)}/parts/*")
    assert all(np.array_equal(a, b) for a, b in zip(got, want))


def test_join(tmp_path):
    path = lambda name: f"file://{tmp_path}/{name}.npy"
    arrays.save(path("a"), np.array([1, 2], np.uint8))
    arrays.save(path("c"), np.array([3, 70_000], np.uint32))
    arrays.join([path(x) for x in "abc"], [2, 3, 2], path("all"), gaps=True)
    assert arrays.load(path("all")).tolist() == [1, 2, 0, 0, 0, 3, 70_000] and arrays.load(path("all")).dtype == np.uint32
    arrays.join([path("a"), path("c")], [2, 2], path("more"), add=[0, 1 << 20])
    assert arrays.load(path("more")).tolist() == [1, 2, 3 + (1 << 20), 70_000 + (1 << 20)]
    with pytest.raises(FileNotFoundError):
        arrays.join([path("a"), path("b")], [2, 3], path("not"))
    assert not os.path.exists(f"{tmp_path}/not.npy")


def test_files_of_large_models():
    """Few files at 30 GB; more only where a bigram's place and a word would not fit 64 bits."""
    model = lambda each, words: lm_scoring.Model("", 4, np.array([words - 1]), 12, np.full(1 << 12, each, np.int64), 1, (0.5, 1.0, 1.5), 1.0, (1.0, 1.0))
    assert model(500_000, 1 << 28).file_bits == arrays.FILE_BITS
    large = model(1 << 27, 1 << 32)
    files = arrays.in_files(large.pair_sizes, large.file_bits)
    assert int(files.max()).bit_length() + large.word_bits <= 64 and len(files) > 1 << arrays.FILE_BITS
    last = np.array([large.pairs])  # two beginnings
    part, keys = lm_scoring._triple_keys(last, np.array([(1 << 32) - 1]), large, files)
    assert part.tolist() == [len(files) - 1] and int(keys[0]) >> large.word_bits == int(files[-1])
