"""Vectorised word and n-gram hashing over Arrow text batches.

Every text operator of this package works on whole Arrow batches: the UTF-8
bytes of many documents lie in one buffer, words are found with byte masks, and
each word gets a 64-bit multilinear hash with numpy. Nothing is done per word
in Python. Words are maximal runs of bytes other than space and ``\\t`` to
``\\r``, i.e. the pattern ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U64 = np.uint64
_MIX1, _MIX2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)

#: Bytes of text that are hashed at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def _multipliers(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * _GOLD) | U64(1)


class _Table:
    """Multipliers by position in a word, lengthened when a longer word comes."""

    def __init__(self, seed: int):
        self.seed, self.values = seed, _multipliers(256, seed)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.values):
            self.values = _multipliers(max(n, 2 * len(self.values)), self.seed)
        return self.values


_BYTES = {seed: _Table(seed) for seed in (1, 2)}


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column and its n + 1 offsets into them; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` text bytes, or one document."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, size = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


class Words:
    """The words of a batch of documents, in order.

    starts, ends: byte positions in ``data``; first: n_docs + 1 indices, document
    d has words first[d] to first[d + 1] - 1; doc: the document of each word.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        raw, self.offsets = buffer_of(column)
        self.raw = raw
        self.data = _LOWER[raw] if lower else raw
        space = _SPACE[raw]
        word = ~space
        begins = word.copy()
        begins[1:] &= space[:-1]
        at = self.offsets[:-1][self.offsets[:-1] < len(raw)]
        begins[at] = word[at]  # a document's first byte starts a word whatever stands before it
        stops = word.copy()
        stops[:-1] &= space[1:] | begins[1:]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self._word = word

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hash_spans(self.data[self._word], self.ends - self.starts, seed)

    def windows(self, hashes: np.ndarray, k: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows within documents, and the index of their first words."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        rolled = roll(hashes, k, seed)
        inside = np.ones(n, dtype=bool)
        for back in range(1, k):
            cut = self.first[1:-1] - back
            inside[cut[(cut >= 0) & (cut < n)]] = False
        index = np.flatnonzero(inside)
        return rolled[index], index


def hash_spans(data: np.ndarray, lengths: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hashes of spans that fill ``data`` without gaps: sums of bytes times a multiplier for each place, mixed."""
    if not len(lengths):
        return np.zeros(0, U64)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(begin, lengths)
    table = _BYTES[seed].upto(int(lengths.max()))
    terms = (data.astype(U64) + U64(1)) * table[place]
    return mix64(np.add.reduceat(terms, begin) + lengths.astype(U64) * _GOLD)


def roll(hashes: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Hashes of k neighbouring hashes each, in order."""
    n = len(hashes) - k + 1
    multipliers = _multipliers(k, seed)
    total = np.zeros(max(n, 0), U64)
    for j in range(k):
        total += hashes[j : j + n] * multipliers[j]
    return mix64(total)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return start, np.diff(np.append(start, len(values)))


def per_doc(doc: np.ndarray, n_docs: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of weights, by document."""
    return np.bincount(doc, weights=weights, minlength=n_docs)


def sliced(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of a text column with at most ``limit`` bytes, or one document."""
    lengths = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    block = np.cumsum(lengths, dtype=np.int64) // limit
    start, size = runs(block)
    for s, n in zip(start.tolist(), size.tolist()):
        yield column.slice(s, n)
    pa.default_memory_pool().release_unused()  # workers stay for later stages; what they no longer use goes back


def long_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more, as a mask over their places."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    start, size = runs(keys[order])
    mask = np.empty(len(keys), bool)
    mask[order] = np.repeat(size > 1, size)
    return mask


class SpanCache:
    """Encodes distinct spans of bytes once and remembers them between batches.

    ``encode`` maps a list of bytes to a list of integer sequences. Spans are
    known by hash; past ``limit`` spans only those of the latest batch stay.
    """

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.keys = np.zeros(0, U64)
        self.begin = self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def lookup(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and length in ``pool`` of each span's sequence. Spans are bytes starts to starts + lengths of data."""
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys):
            slot = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
            new = np.flatnonzero(self.keys[slot] != unique)
        else:
            new = np.arange(len(unique))
        if len(new):
            raw = data.tobytes()
            at = first[new]
            found = self.encode([raw[s : s + n] for s, n in zip(starts[at].tolist(), lengths[at].tolist())])
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.concatenate([np.asarray(x, np.uint32) for x in found]) if len(found) else np.zeros(0, np.uint32)
            if len(self.keys) + len(new) > self.limit and len(self.keys):
                old = np.setdiff1d(np.arange(len(unique)), new)
                keep = slot[old]
                flat_old = gather(self.pool, self.begin[keep], self.length[keep])
                self.keys, self.length = self.keys[keep], self.length[keep]
                self.begin, self.pool = np.cumsum(self.length) - self.length, flat_old
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(counts) - counts])[order]
            self.length = np.concatenate([self.length, counts])[order]
            self.pool = np.concatenate([self.pool, flat])
        slot = np.searchsorted(self.keys, unique)[inverse]
        return self.begin[slot], self.length[slot]


def gather(pool: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of pool[b : b + n] for all pairs."""
    total = int(length.sum())
    return pool[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(total)]
