"""Byte-level BPE ids of whole documents, by a given vocabulary file.

A document is first cut at the vocabulary's added tokens, leftmost and longest
first, and then where its pre-tokens surely end: before a blank that follows a
printable ASCII character. Each distinct segment of a batch is encoded once. The
ids are those of the ``tokenizers`` library without the special tokens that it adds
around a text; added tokens that a text spells out get their own ids, as there.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .textops import SpanCache, buffer_of, gather, hash_spans

_CACHES: dict[str, SpanCache] = {}
_ADDED: dict[str, re.Pattern | None] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: those that print stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _encoder(path: str):
    """Encodes a list of byte strings. Where merges stand in the order of ids, a rank-based encoder gives the same ids several times faster."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    level = spec.get("pre_tokenizer") or {}
    if level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and level.get("use_regex", True) and not spec.get("normalizer") and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)):
        import tiktoken

        symbol = _byte_of_symbol()
        ranks = {bytes(symbol[c] for c in token): i for token, i in vocab.items() if i < 256 + len(pairs)}
        one = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        added = {t["content"].encode(): [t["id"]] for t in spec.get("added_tokens") or []}
        return lambda spans: [added.get(s) or one(s.decode("utf-8", "replace")) for s in spans]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda spans: [x.ids for x in tokenizer.encode_batch_fast([s.decode("utf-8", "replace") for s in spans], add_special_tokens=False)]


def _added(path: str) -> re.Pattern | None:
    """A pattern of the added tokens' bytes; at one place the longest comes first."""
    if path not in _ADDED:
        with open(path, encoding="utf-8") as f:
            tokens = json.load(f).get("added_tokens") or []
        if any(t.get(flag) for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added tokens of {path} ask for more than plain matches")
        plain = sorted((t["content"].encode() for t in tokens if t["content"]), key=len, reverse=True)
        _ADDED[path] = re.compile(b"|".join(map(re.escape, plain))) if plain else None
    return _ADDED[path]


def _cuts_at_added(data: np.ndarray, offsets: np.ndarray, path: str) -> list[int]:
    """Where added tokens begin and end, within documents."""
    pattern = _added(path)
    if pattern is None:
        return []
    raw = data.tobytes()
    if not pattern.search(raw):
        return []
    found = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        for hit in pattern.finditer(raw, lo, hi):
            found += [hit.start(), hit.end()]
    return [x for x in found if x < len(data)]


def _cache(path: str) -> SpanCache:
    if path not in _CACHES:
        _CACHES[path] = SpanCache(_encoder(path), 200_000)
    return _CACHES[path]


def encode(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a text column in order, and how many each document has; null counts as empty."""
    data, offsets = buffer_of(column)
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
    blank = np.flatnonzero(data[1:] == 0x20) + 1
    before = data[blank - 1]
    blank = blank[(before > 0x20) & (before < 0x7F)]
    filled = offsets[:-1][np.diff(offsets) > 0]
    starts = np.union1d(blank, filled)
    if added := _cuts_at_added(data, offsets, path):
        starts = np.union1d(starts, np.array(added, np.int64))
    lengths = np.diff(np.append(starts, len(data)))
    begin, count = _cache(path).lookup(data, starts, lengths, hash_spans(data, lengths))
    ids = gather(_cache(path).pool, begin, count)
    edge = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, offsets)]
    return ids, np.diff(edge)
