"""Sorted key arrays in the shared folder, written by Spark tasks and memory-mapped by workers.

Keys are spread over parts by their top bits, and each part is sorted, so the
parts in order are one sorted array. A part is a set of .npy files. Parts grow in
number with the input; before they are looked up, neighbours are joined to a few files.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np

#: An array lies in at most 2 ** FILE_BITS files: a worker maps all of them, each takes a descriptor, and those are limited.
FILE_BITS = 5


def local_path(uri: str) -> str | None:
    """The path under which every machine sees the folder, if it is mounted; None for another store."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


@contextlib.contextmanager
def _written(uri: str):
    """A file to write, under a name of its own that is then changed: a task that runs twice leaves one whole file."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            yield f
        os.replace(own, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        yield f


def save(uri: str, values: np.ndarray) -> None:
    with _written(uri) as f:
        np.save(f, values)


def load(uri: str) -> np.ndarray:
    """Memory-map the file, or a copy of it that is deleted once mapped."""
    path = local_path(uri)
    if path is not None:
        return np.load(path, mmap_mode="r")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with tempfile.NamedTemporaryFile(suffix=".npy") as copy:
        with store.open_input_stream(path) as f:
            while block := f.read(1 << 20):
                copy.write(block)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")


def in_files(sizes: np.ndarray, bits: int = FILE_BITS) -> np.ndarray:
    """Sizes of the files that parts of these sizes are joined to."""
    return sizes.reshape(1 << bits, -1).sum(axis=1) if len(sizes) > 1 << bits else sizes


def join(uris: list[str], sizes: list[int], uri: str, gaps: bool = False, add: list[int] | None = None) -> None:
    """One file of the values of all, in order, of which one is held at a time; each number of ``add`` goes to the values of one. With gaps, a file that isn't there is zeros."""

    def values(u: str, n: int) -> np.ndarray:
        try:
            return load(u)
        except FileNotFoundError:
            if not gaps:
                raise
            return np.zeros(n, np.uint8)

    kind = np.result_type(*{values(u, n).dtype for u, n in zip(uris, sizes)})
    with _written(uri) as f:
        np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": (sum(sizes),)})
        for u, n, more in zip(uris, sizes, add or [0] * len(uris)):
            f.write((values(u, n).astype(kind) + kind.type(more)).tobytes())


class Parts:
    """The parts of one sorted array; files open when first used."""

    def __init__(self, folder: str, bits: int, sizes: np.ndarray):
        self.folder, self.bits, self.sizes = folder, bits, sizes
        self.base = np.cumsum(sizes) - sizes
        self._open: dict[tuple[str, int], np.ndarray] = {}

    def part(self, name: str, p: int) -> np.ndarray:
        if (name, p) not in self._open:
            self._open[name, p] = load(f"{self.folder}/{name}-{p}.npy")
        return self._open[name, p]

    def find(self, keys: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
        """The place of each key in the whole array, or -1; keys are sorted, by part first where parts are given."""
        found = np.full(len(keys), -1, np.int64)
        for p, lo, hi in self._slices(part_of(keys, self.bits) if part is None else part):
            if self.sizes[p]:
                own = self.part("keys", p)
                slot = np.minimum(np.searchsorted(own, keys[lo:hi]), len(own) - 1)
                found[lo:hi] = np.where(own[slot] == keys[lo:hi], slot + self.base[p], -1)
        return found

    def take(self, name: str, places: np.ndarray) -> np.ndarray:
        """Values of the array ``name`` at sorted places that are all at least 0."""
        out = []
        for p, lo, hi in self._slices(np.searchsorted(self.base + self.sizes, places, side="right")):
            out.append(self.part(name, p)[places[lo:hi] - self.base[p]])
        return np.concatenate(out) if out else np.zeros(0)

    @staticmethod
    def _slices(part: np.ndarray):
        edges = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]):
            if hi > lo:
                yield int(part[lo]), lo, hi


def part_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
