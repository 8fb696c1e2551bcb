"""Packing (7): shortest-pack-first over the length histogram.

Documents become token ids plus one end id and are cut into full pieces of
``max_tokens`` and a rest. The histogram of piece lengths, at most max_tokens
numbers, goes to the driver, which places lengths from the longest to the
shortest: each joins the open packs with the most room left, or opens new ones,
so that packing patterns with counts come out. Patterns join back to pieces by
length and rank. Ranks are counted in two levels, so a length that a third of
all pieces share is spread over many tasks.

Defined cases. Null or empty text: one piece with the end id alone. Repeated
rows and null ids: each row is packed as a document of its own. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, frames
from .textops import sliced

MAX_TOKENS = 2048
END_ID = 1

_PIECES = "struct<doc_tokens: bigint, pieces: array<struct<start: bigint, length: bigint, ids_crc32: bigint>>>"


def _pieces(path: str, max_tokens: int, end_id: int):
    def cut(text: pa.Array) -> pa.Array:
        tokens, out = [], []
        for part in sliced(text):
            ids, counts = bpe.encode(part, path)
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            at = 0
            for n in (counts + 1).tolist():
                view = memoryview(ids[at : at + n])
                out.append([{"start": s, "length": len(p := view[s : s + max_tokens]), "ids_crc32": zlib.crc32(p)} for s in range(0, n, max_tokens)])
                tokens.append(n)
                at += n
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(out, kind)], names=["doc_tokens", "pieces"])

    return cut


def token_pieces(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of all documents."""
    cut = F.arrow_udf(_pieces(path, max_tokens, end_id), _PIECES)(docs.text.cast("binary"))
    return docs.select("doc_id", cut.alias("t")).select("doc_id", "t.doc_tokens", F.inline("t.pieces")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def shortest_pack_first(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, list[int]]]:
    """Packing patterns (count, lengths). Lengths go from the longest to the shortest into the packs with the most room."""
    room: dict[int, list[list]] = {}  # room left -> [count, lengths]
    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            most = max(room, default=0)
            if most < length:
                room.setdefault(max_tokens - length, []).append([todo, [length]])
                break
            pack = room[most].pop()
            if not room[most]:
                del room[most]
            filled = min(todo, pack[0])
            if pack[0] > filled:
                room.setdefault(most, []).append([pack[0] - filled, pack[1]])
            room.setdefault(most - length, []).append([filled, pack[1] + [length]])
            todo -= filled
    return [(count, lengths) for left in sorted(room) for count, lengths in room[left]]


def _slots(patterns: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """For each place of a pattern: its key (length, first rank), first sequence and offset, sorted by key."""
    next_rank: dict[int, int] = {}
    keys, sequences, offsets, sequence = [], [], [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            keys.append((length << 48) + rank)
            sequences.append(sequence - rank)
            offsets.append(offset)
            next_rank[length] = rank + count
            offset += length
        sequence += count
    order = np.argsort(np.array(keys, np.int64))
    return tuple(np.array(x, np.int64)[order] for x in (keys, sequences, offsets))


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """pieces with ``rank``: 0, 1, ... among those of the same length, in no one task for a hot length."""
    buckets = int(np.ceil(np.sqrt(max(histogram.values(), default=1))))
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    inside = spread.withColumn("place", F.row_number().over(own) - 1)
    return inside.join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("place")).drop("bucket", "base", "place")


def pack(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece."""
    pieces = frames.cut(token_pieces(docs, path or bpe.default_path(), max_tokens, end_id))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most max_tokens rows
    keys, sequences, offsets = _slots(shortest_pack_first(histogram, max_tokens))

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        rank = rank.to_numpy(zero_copy_only=False)
        slot = np.searchsorted(keys, (length.to_numpy(zero_copy_only=False) << 48) + rank, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(sequences[slot] + rank), pa.array(offsets[slot])], names=["sequence_id", "offset"])

    placed = F.arrow_udf(place, "struct<sequence_id: bigint, offset: bigint>")
    return ranked(pieces, histogram).withColumn("at", placed("length", "rank")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(frames.table(spark, sf_dir, "documents").select("doc_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of all documents with their sequences."""
    frames.ship(spark)
    return pack(docs.select("doc_id", "text"))
