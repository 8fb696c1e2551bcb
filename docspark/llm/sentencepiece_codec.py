"""SentencePiece encoding and decoding (5): Aho-Corasick over pieces, single-pass Viterbi.

The pieces of a model file form an Aho-Corasick automaton over UTF-8 bytes, as a
dense transition table. Reading a text byte by byte, the current state and its
output links name all pieces that end here; each relaxes the best score at this
position from the best score where it starts. The distinct segments of a batch
advance together, one numpy step for each byte position, and each segment is
encoded once. Segments begin at a blank after something else; no piece of such a
model reaches over that border, which the loader checks.

The result is the segmentation with the greatest sum of the scores in the model
file; among equal sums the longer last piece wins. A character without a piece
of its own becomes byte pieces. Literal U+2581 counts as a blank, as in the
library, and is the one character that decoding turns into another.

Defined cases. Null or empty text: no ids. Repeated rows are encoded alike. Ids
of control pieces decode to nothing; ids outside the model raise an error.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .textops import SpanCache, buffer_of, gather, hash_spans, long_lists, sliced

BLANK = "▁"
#: How much worse than any piece an unknown character is.
UNKNOWN = -2e9


@dataclass
class Automaton:
    step: np.ndarray  # state, byte -> state
    piece: np.ndarray  # state -> piece that ends here, or -1
    link: np.ndarray  # state -> longest proper suffix that is a piece, or 0
    length: np.ndarray  # piece -> bytes
    score: np.ndarray  # piece -> score
    byte_piece: np.ndarray  # byte -> piece
    pool: np.ndarray  # bytes of all pieces, for decoding
    begin: np.ndarray
    size: np.ndarray


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def build(pieces: list[bytes], ids: list[int], scores: list[float], byte_piece: np.ndarray, decoded: list[bytes]) -> Automaton:
    """The automaton of pieces (blank written as one space) with their ids and scores; decoded: bytes of every id."""
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for piece, i in zip(pieces, ids):
        if b" " in piece.lstrip(b" "):
            raise ValueError(f"a piece reaches over a word border: {piece!r}")
        node = 0
        for b in piece:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
            node = children[node][b]
        ends[node] = i
    n = len(children)
    step, piece_of, link, fail = np.zeros((n, 256), np.int32), np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    for node, i in ends.items():
        piece_of[node] = i
    level = [0]
    while level:
        following = []
        for node in level:
            if node:
                step[node] = step[fail[node]]
                link[node] = fail[node] if piece_of[fail[node]] >= 0 else link[fail[node]]
            for b, child in children[node].items():
                fail[child] = step[node, b] if node else 0
                step[node, b] = child
                following.append(child)
        level = following
    length, score = np.zeros(len(decoded), np.int64), np.zeros(len(decoded))
    for piece, i, s in zip(pieces, ids, scores):
        length[i], score[i] = len(piece), s
    size = np.array([len(x) for x in decoded], np.int64)
    return Automaton(step, piece_of, link, length, score, byte_piece, np.frombuffer(b"".join(decoded), np.uint8), np.cumsum(size) - size, size)


def load(path: str) -> Automaton:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, ids, scores, decoded, byte_piece = [], [], [], [], np.full(256, model.unk_id(), np.int64)
    for i in range(model.vocab_size()):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_piece[int(name[1:-1], 16)] = i
            decoded.append(bytes([int(name[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            decoded.append(b"")
        else:
            decoded.append(name.replace(BLANK, " ").encode())
            pieces.append(decoded[-1])
            ids.append(i)
            scores.append(model.get_score(i))
    return build(pieces, ids, scores, byte_piece, decoded)


def viterbi(spans: list[bytes], a: Automaton) -> list[np.ndarray]:
    """The best segmentation of each span, as piece ids."""
    lengths = np.array([len(s) for s in spans], np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    data = np.frombuffer(b"".join(spans[i] for i in order.tolist()), np.uint8)
    start = np.cumsum(lengths) - lengths
    base = start + np.arange(len(spans))  # a place more than bytes for each span
    best, back = np.full(len(data) + len(spans), -np.inf), np.full(len(data) + len(spans), -1, np.int64)
    best[base] = 0
    char = np.zeros(len(data), np.int64)  # the first byte of each byte's character
    head = (data & 0xC0) != 0x80
    head[start[lengths > 0]] = True
    char[:] = np.maximum.accumulate(np.where(head, np.arange(len(data)), 0))
    last = np.ones(len(data), bool)
    last[:-1] = head[1:]
    state = np.zeros(len(spans), np.int32)
    active = len(spans)
    for t in range(int(lengths[0]) if len(spans) else 0):
        while active and lengths[active - 1] <= t:
            active -= 1
        at = start[:active] + t
        state[:active] = a.step[state[:active], data[at]]
        here = base[:active] + t + 1
        who = np.arange(active)
        now = state[:active]
        now = np.where(a.piece[now] >= 0, now, a.link[now])
        alone = np.zeros(active, bool)
        chars = at - char[at] + 1
        while True:
            some = now > 0
            if not some.all():
                who, now = who[some], now[some]
            if not len(who):
                break
            piece = a.piece[now]
            n = a.length[piece]
            place = here[who]
            value = best[place - n] + a.score[piece]
            alone[who] |= n == chars[who]
            better = value > best[place]
            best[place[better]] = value[better]
            back[place[better]] = piece[better]
            now = a.link[now]
        odd = np.flatnonzero(last[at] & ~alone)
        if len(odd):
            value = best[here[odd] - chars[odd]] + UNKNOWN
            odd = odd[value > best[here[odd]]]
            best[here[odd]] = best[here[odd] - chars[odd]] + UNKNOWN
            for d in range(int(chars[odd].max()) if len(odd) else 0):
                own = odd[chars[odd] > d]
                back[here[own] - d] = -2 - data[at[own] - d].astype(np.int64)
    place, who, found = base + lengths, np.arange(len(spans)), []
    who, place = who[lengths > 0], place[lengths > 0]
    while len(who):
        piece = back[place]
        raw = piece < -1
        found.append((who, np.where(raw, a.byte_piece[np.where(raw, -2 - piece, 0)], piece)))
        place = place - np.where(raw, 1, a.length[np.maximum(piece, 0)])
        more = place > base[who]
        who, place = who[more], place[more]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(spans)
    if found:
        owner, ids = np.concatenate([w for w, _ in found])[::-1], np.concatenate([i for _, i in found])[::-1]
        sort = np.argsort(owner, kind="stable")
        for w, part in enumerate(np.split(ids[sort], np.cumsum(np.bincount(owner, minlength=len(spans)))[:-1])):
            out[order[w]] = part
    return out


def _in_parts(spans: list[bytes], a: Automaton, size: int = 20_000) -> list[np.ndarray]:
    return [ids for i in range(0, len(spans), size) for ids in viterbi(spans[i : i + size], a)]


_LOADED: dict[str, tuple[Automaton, SpanCache]] = {}


def loaded(path: str) -> tuple[Automaton, SpanCache]:
    if path not in _LOADED:
        a = load(path)
        _LOADED[path] = a, SpanCache(lambda spans: _in_parts(spans, a), 200_000)
    return _LOADED[path]


def encode_column(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a text column in order, and how many each text has."""
    _, cache = loaded(path)
    data, offsets = buffer_of(pc.replace_substring(column.cast(pa.binary()), BLANK.encode(), b" "))
    filled = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][filled], 0x20)
    offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) + filled)])
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
    blank = data == 0x20
    opens = np.concatenate([[True], blank[1:] & ~blank[:-1]])
    opens[offsets[:-1][filled]] = True
    starts = np.flatnonzero(opens)
    lengths = np.diff(np.append(starts, len(data)))
    begin, count = cache.lookup(data, starts, lengths, hash_spans(data, lengths))
    edge = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, offsets)]
    return gather(cache.pool, begin, count), np.diff(edge)


def decode_ids(ids: np.ndarray, counts: np.ndarray, path: str) -> pa.Array:
    """The text of each list of ids; the blank that encoding put first goes."""
    a, _ = loaded(path)
    raw = gather(a.pool, a.begin[ids], a.size[ids])
    edge = np.concatenate([[0], np.cumsum(a.size[ids])])[np.concatenate([[0], np.cumsum(counts)])]
    first = edge[:-1][np.diff(edge) > 0]
    first = first[raw[first] == 0x20]
    edge = edge - np.searchsorted(first, edge)
    raw = np.delete(raw, first)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ``ids`` (or a free name like it): the piece ids of ``text``."""
    path = path or default_path()

    def run(text: pa.Array) -> pa.Array:
        done = [encode_column(part, path) for part in sliced(text)]
        if not done:
            return pa.array([], pa.list_(pa.int32()))
        return long_lists(np.concatenate([i for i, _ in done]).astype(np.int32), np.concatenate([n for _, n in done]), pa.int32())

    return docs.withColumn(frames.free_name(docs, "ids"), F.arrow_udf(run, "array<int>")(docs.text.cast("binary")))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """rows with ``decoded`` (or a free name like it): the text of their ids."""
    path = path or default_path()

    def run(column: pa.Array) -> pa.Array:
        return decode_ids(*_flat(column), path)

    return rows.withColumn(frames.free_name(rows, "decoded"), F.arrow_udf(run, "binary")(ids).cast("string"))


def _digest(path: str):
    """Arrow UDF: each text's ids as count and CRC-32, and whether decoding them gives the text back, in one Python worker a task."""

    def run(text: pa.Array) -> pa.Array:
        size, crc, same = [], [], []
        for part in sliced(text):
            ids, counts = encode_column(part, path)
            flat, ends = ids.astype("<u4"), np.cumsum(counts)
            size += counts.tolist()
            crc += [zlib.crc32(memoryview(flat[e - n : e])) for n, e in zip(counts.tolist(), ends.tolist())]
            same += pc.equal(decode_ids(ids, counts, path), part.cast(pa.binary()).fill_null(b"")).to_pylist()
        return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["n_ids", "ids_crc32", "round_trip"])

    return F.arrow_udf(run, "struct<n_ids: bigint, ids_crc32: bigint, round_trip: boolean>")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, as count and CRC-32, and whether decoding gives the text back."""
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", _digest(default_path())(F.col("text").cast("binary")).alias("d")).select("doc_id", "d.*")
