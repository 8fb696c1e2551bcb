"""Substring dedup (3): relative Lempel-Ziv factors against all earlier documents.

Every document is parsed greedily into factors: stretches of words that also
stand in an earlier document, as (start, length, source document, place there).
The reference is the collection itself, cut into blocks of ``block`` words: each
distinct window of ``span`` words is indexed at its first place (smallest id, then
first word). The parser goes from left to right; at a window that the index knows it
compares the words with the source's blocks and takes the longest stretch that
agrees. A factor of ``span`` words or more is a duplicate span. At its border the
windows that reach over its end are checked as well, and the next factor starts at
the first of them that has a source; so a word is removed exactly if some window
over it starts in a document with a smaller id.

Candidates come from two equi-joins in Spark, since most windows occur once. Each
window has an anchor: the smallest hash of its ``gram``-word grams. Equal windows
have equal anchors, and neighbouring windows mostly share theirs, so a fifth as many
rows settle which anchors occur in two documents at all. Only windows on such
anchors are indexed: window hash -> first place. On anchors of very many documents,
neighbouring windows go as one row, a run: equal runs are pre-aggregated, the index is
made of the distinct ones, and each run is joined with what its windows have, which
adaptive execution can split; all other windows go through one shuffle. Exact copies of a whole text (by SHA-256) are one factor
each and not indexed again. The blocks that some factor may need are cut out of their
documents and joined to the documents that ask for them.

Windows are found by 64-bit hashes and verified word by word, so a collision never
removes anything; among 10**9 distinct windows one is hidden behind another's hash
with probability 3 %, and is then kept.

Defined cases. Null or blank text: no words, nothing removed. Fewer words than
``span``: nothing removed. Rows without id: kept whole, no reference. Repeated rows
of one id: none is earlier than the other, both stay. Ids with several texts: each
text is parsed by itself and all of them are references (texts of such an id are told
apart by CRC-32, so two of them are confused with probability 2**-32). Other columns pass through
the stage unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import frames
from .textops import U64, Words, chunks, gather, mix64, roll, runs


@dataclass(frozen=True)
class Parsing:
    span: int = 13
    #: Longer grams are shared by chance less often, but make more anchors; changes the plan, not the result.
    gram: int = 6
    #: Words of a reference block; a power of two.
    block: int = 64
    #: Documents from which on an anchor counts as hot; it changes the plan, not the result.
    hot: int = 3000


#: A place is a text's part (0, but its CRC-32 for ids with several texts) and a word's position, in one number.
_POSITION_BITS = 31


def _hashes(column: pa.Array, how: Parsing) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words, the hash and the anchor of the window that starts at each of them, and the end of each document's windows."""
    words = Words(column)
    own = words.hashes()
    windows = roll(own, how.span)
    grams = roll(own, how.gram, seed=4)
    anchors = grams[: len(windows)].copy()
    for j in range(1, how.span - how.gram + 1):
        np.minimum(anchors, grams[j : j + len(windows)], out=anchors)
    ends = np.maximum(words.first[1:] - how.span + 1, words.first[:-1])
    return words, windows, anchors, ends


def _rows(names: tuple[str, ...], *columns: np.ndarray):
    for i in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=list(names))


def _numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _anchor_rows(how: Parsing):
    """Text batches to (anchor, doc_id, part): each document's anchors, a run of equal ones once."""

    def run(batches):
        for batch in chunks(batches):
            words, _, anchors, ends = _hashes(batch.column("text"), how)
            inside = ends - words.first[:-1]
            doc = np.repeat(np.arange(words.n_docs), inside)
            at = np.repeat(words.first[:-1] - (np.cumsum(inside) - inside), inside) + np.arange(inside.sum())
            key = anchors[at]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            yield from _rows(("anchor", "doc_id", "part"), key[new].view(np.int64), _numpy(batch, "doc_id")[doc[new]], _numpy(batch, "part")[doc[new]])

    return run


def _window_rows(how: Parsing):
    """(doc_id, part, text, anchors) batches to (win, doc_id, place): each document's distinct windows on those anchors, at their first places."""

    def run(batches):
        for batch in chunks(batches):
            words, windows, anchors, ends = _hashes(batch.column("text"), how)
            wanted = batch.column("anchors")
            found, place, count = [], [], []
            for d, part in enumerate(_numpy(batch, "part").tolist()):
                lo, hi = words.first[d], ends[d]
                at = np.flatnonzero(np.isin(anchors[lo:hi], wanted[d].values.to_numpy(zero_copy_only=False).view(U64)))
                first = np.sort(np.unique(windows[lo:hi][at], return_index=True)[1])
                found.append(windows[lo:hi][at[first]])
                place.append(at[first] + (part << _POSITION_BITS))
                count.append(len(first))
            if found:
                yield from _rows(("win", "doc_id", "place"), np.concatenate(found).view(np.int64), np.repeat(_numpy(batch, "doc_id"), count), np.concatenate(place))

    return run


#: Windows of a run.
_LONGEST_RUN = 64


def _run_rows(how: Parsing):
    """(doc_id, part, text, anchors) batches to (run, doc_id, place, wins): neighbouring windows on one of those anchors as one row, each document's distinct runs at their first places."""

    def run(batches):
        for batch in chunks(batches):
            words, windows, anchors, ends = _hashes(batch.column("text"), how)
            wanted = batch.column("anchors")
            rows: list[list[np.ndarray]] = [[], [], [], [], []]
            for d, (doc_id, part) in enumerate(zip(_numpy(batch, "doc_id").tolist(), _numpy(batch, "part").tolist())):
                lo, hi = words.first[d], ends[d]
                at = np.flatnonzero(np.isin(anchors[lo:hi], wanted[d].values.to_numpy(zero_copy_only=False).view(U64)))
                if not len(at):
                    continue
                key, own = anchors[lo:hi][at], windows[lo:hi][at]
                begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])]))
                place = (np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % _LONGEST_RUN
                begin = np.flatnonzero(place == 0)
                size = np.diff(np.append(begin, len(at)))
                name = mix64(np.add.reduceat(mix64(own + place.astype(U64)), begin) + size.astype(U64))
                first = np.sort(np.unique(name, return_index=True)[1])
                own = gather(own, begin[first], size[first])
                for held, x in zip(rows, (name[first], np.full(len(first), doc_id), at[begin[first]] + (part << _POSITION_BITS), size[first], own)):
                    held.append(x)
            if rows[0]:
                name, ids, places, size, own = (np.concatenate(x) for x in rows)
                edge = np.concatenate([[0], np.cumsum(size)])
                for i in range(0, len(name), 20_000):
                    j = min(i + 20_000, len(name))
                    wins = pa.ListArray.from_arrays(pa.array((edge[i : j + 1] - edge[i]).astype(np.int32)), pa.array(own[edge[i] : edge[j]].view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(name[i:j].view(np.int64)), pa.array(ids[i:j]), pa.array(places[i:j]), wins], names=["run", "doc_id", "place", "wins"])

    return run


def _needed(how: Parsing):
    """Arrow UDF of found windows (pos, source, at) to the distinct blocks (source, ref) that their words stand in."""

    def run(found: pa.Array) -> pa.Array:
        values = found.flatten()
        source, at = (values.field(c).to_numpy(zero_copy_only=False) for c in ("source", "at"))
        row = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
        ref = np.concatenate([at, at + how.span - 1]) & ~np.int64(how.block - 1)
        row, source = np.tile(row, 2), np.tile(source, 2)
        order = np.lexsort((ref, source, row))
        row, source, ref = row[order], source[order], ref[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (source[1:] != source[:-1]) | (ref[1:] != ref[:-1])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(found)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(source[new]), pa.array(ref[new])], names=["source", "ref"]))

    return F.arrow_udf(run, "array<struct<source: bigint, ref: bigint>>")


_BLOCKS = pa.list_(pa.struct([("ref", pa.int64()), ("words", pa.binary())]))


def _blocks(how: Parsing):
    """Arrow UDF of texts and lists of refs to those blocks, words joined by one space."""

    def run(text: pa.Array, refs: pa.Array) -> pa.Array:
        out = []
        for data, own in zip(text.to_pylist(), refs.to_pylist()):
            words = (data or b"").split()
            places = ((ref, ref & ((1 << _POSITION_BITS) - 1)) for ref in own)
            out.append([{"ref": ref, "words": b" ".join(words[p : p + how.block])} for ref, p in places])
        return pa.array(out, _BLOCKS)

    return F.arrow_udf(run, "array<struct<ref: bigint, words: binary>>")


def factors(words: list[bytes], starts: list[int], sources: list[tuple[int, int]], blocks: dict[tuple[int, int], list[bytes]], how: Parsing) -> list[tuple[int, int, int, int]]:
    """Greedy factors (first word, words, source document, place there) of one document.

    starts: where its windows with a source begin, ascending; sources: (document, place)
    of each; blocks: words by (document, place of the block's first word).
    """
    out: list[tuple[int, int, int, int]] = []
    end, k = 0, 0
    begins = np.asarray(starts, np.int64)
    while k < len(starts):
        s, (source, place) = starts[k], sources[k]
        length = 0
        while True:
            ref = (place + length) & -how.block
            block = blocks.get((source, ref))
            if block is None:
                break
            theirs = block[place + length - ref :]
            ours = words[s + length : s + length + len(theirs)]
            same = len(ours) if ours == theirs else next((i for i, (a, b) in enumerate(zip(ours, theirs)) if a != b), min(len(ours), len(theirs)))
            length += same
            if same < len(theirs) or len(block) < how.block or not theirs:
                break
        k += 1
        if length >= how.span:
            out.append((s, length, source, place))
            end = s + length
            k = max(k, int(np.searchsorted(begins, end - how.span + 1)))  # windows over the border are still to be checked
    return out


_FACTORS = "array<struct<start: bigint, length: bigint, source: bigint, place: bigint>>"
_PARSED = f"struct<n_words: bigint, n_removed: bigint, kept_sha256: string, text: binary, factors: {_FACTORS}>"
_PARSED_ARROW = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.binary()), ("factors", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "source", "place")])))])


def _parse(how: Parsing, with_text: bool):
    """Arrow UDF of (text, found windows with their sources, reference blocks, source of the whole text) to what is left and the factors."""

    def run(text: pa.Array, found: pa.Array, blocks: pa.Array, copy_of: pa.Array) -> pa.Array:
        out = []
        raw = text.to_pylist()
        whole = copy_of.to_pylist()
        some = np.flatnonzero(~np.asarray(found.is_null()))
        known: dict[int, tuple] = {}
        for lo in range(0, len(some), 256):
            part = some[lo : lo + 256]
            words, windows, _, ends = _hashes(text.take(pa.array(part)), how)
            for d, row in enumerate(part.tolist()):
                own = windows[words.first[d] : ends[d]]
                hits = found[row].values
                pos, source, at = (hits.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "source", "at"))
                keys = own[pos]
                order = np.argsort(keys)
                keys = keys[order]
                slot = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                starts = np.flatnonzero(keys[slot] == own)
                hit = order[slot[starts]]
                known[row] = starts.tolist(), list(zip(source[hit].tolist(), at[hit].tolist()))
        for row, data in enumerate(raw):
            words = (data or b"").split()
            n = len(words)
            parsed = []
            if whole[row] is not None and n >= how.span:
                parsed = [(0, n, whole[row], 0)]
            elif row in known and blocks[row].is_valid:
                own = {(b["source"], b["ref"]): b["words"].split(b" ") for b in blocks[row].as_py()}
                parsed = factors(words, *known[row], own, how)
            keep, cleaned = words, data
            if parsed:
                mask = np.ones(n, bool)
                for start, length, _, _ in parsed:
                    mask[start : start + length] = False
                keep = list(compress(words, mask.tolist()))
                if with_text:
                    cleaned = _without(text.slice(row, 1), mask)
            out.append({"n_words": n, "n_removed": n - len(keep), "kept_sha256": None if with_text else hashlib.sha256(b" ".join(keep)).hexdigest(), "text": cleaned if with_text else None, "factors": [dict(zip(("start", "length", "source", "place"), f)) for f in parsed]})
        return pa.array(out, _PARSED_ARROW)

    return F.arrow_udf(run, _PARSED)


def _without(text: pa.Array, keep: np.ndarray) -> bytes:
    """The text less its words outside ``keep``, each with the white space after it."""
    words = Words(text)
    data = words.raw.tobytes()
    begin, size = runs(keep)
    starts = np.append(words.starts, len(data))
    parts = [data[: starts[0]]] if len(words.starts) else [data]
    parts += [data[starts[b] : starts[b + n]] for b, n in zip(begin.tolist(), size.tolist()) if keep[b]]
    return b"".join(parts)


def _wanted(texts: DataFrame, copies: DataFrame, how: Parsing) -> DataFrame:
    """(doc_id, part, hot, anchors): the anchors of each text that other documents have, copies left out."""
    t, p = texts.columns[1:]
    anchors = texts.withColumnsRenamed({t: "text", p: "part"}).mapInArrow(_anchor_rows(how), "anchor bigint, doc_id bigint, part bigint")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("anchor", (F.col("n") >= how.hot).alias("hot"))
    wanted = anchors.join(shared, "anchor").groupBy("doc_id", "part", "hot").agg(F.collect_set("anchor").alias("anchors"))
    return frames.cut(wanted.join(copies.select("doc_id", "part"), ["doc_id", "part"], "left_anti"))


_HITS = "array<struct<pos: bigint, source: bigint, at: bigint>>"


def _found(texts: DataFrame, copies: DataFrame, how: Parsing) -> DataFrame:
    """(doc_id, part, found): windows of texts (doc_id, text, part) at pos, and the first place of each in a document with a smaller id."""
    wanted = _wanted(texts, copies, how)
    # from here on one job: all its joins with the texts read one shuffle of them
    of = lambda hot: _joined(texts, wanted.filter(F.col("hot") == hot).drop("hot"))
    here = F.struct(F.col("doc_id").alias("source"), F.col("place").alias("at"))
    mine, part = F.col("place").bitwiseAND((1 << _POSITION_BITS) - 1), F.shiftright("place", _POSITION_BITS).alias("part")
    cold = of(False).mapInArrow(_window_rows(how), "win bigint, doc_id bigint, place bigint").withColumn("first", F.min(here).over(Window.partitionBy("win"))).filter("first.source < doc_id")
    cold = cold.groupBy("doc_id", part).agg(F.collect_list(F.struct(mine.alias("pos"), "first.source", "first.at")).alias("found"))
    # windows on hot anchors travel as runs: passages that many documents share are few distinct ones
    many = of(True).mapInArrow(_run_rows(how), "run bigint, doc_id bigint, place bigint, wins array<bigint>")
    runs_ = many.groupBy("run").agg(F.min(here).alias("first"), F.max("doc_id").alias("hi"), F.first("wins").alias("wins"))
    each = runs_.select("run", "hi", "first", F.posexplode("wins").alias("off", "win")).select("run", "hi", "off", "win", F.struct(F.col("first.source"), (F.col("first.at") + F.col("off")).alias("at")).alias("first"))
    # grouped by a second key as well, the joins' sides lie by shuffles of their own, which adaptive execution can split where a key is hot
    lot = lambda c: F.pmod(F.col(c), F.lit(7)).alias("lot")
    index = each.groupBy("win", lot("win")).agg(F.min("first").alias("first"), F.max("hi").alias("hi")).filter("first.source < hi").drop("hi", "lot")
    known = each.select("run", "off", "win").join(index, "win").groupBy("run", lot("run")).agg(F.collect_list(F.struct("off", "first")).alias("known")).drop("lot")
    earlier = F.filter("known", lambda k: k["first"]["source"] < F.col("doc_id"))
    found = F.transform(earlier, lambda k: F.struct((mine + k["off"]).alias("pos"), k["first"]["source"].alias("source"), k["first"]["at"].alias("at"))).cast(_HITS)
    hot = many.select("run", "doc_id", "place").join(known, "run").select("doc_id", part, found.alias("found")).filter("size(found) > 0")
    hot = hot.groupBy("doc_id", "part").agg(F.flatten(F.collect_list("found")).alias("more"))
    none = F.array().cast(_HITS)
    both = F.concat(F.coalesce(F.col("found").cast(_HITS), none), F.coalesce("more", none))
    return cold.join(hot, ["doc_id", "part"], "full_outer").select("doc_id", "part", both.alias("found"))  # both lie by these keys already


def _joined(texts: DataFrame, side: DataFrame) -> DataFrame:
    """(doc_id, text, part, ...) of the texts that side (doc_id, part, ...) names; renamed after the shuffle, so that all joins share it."""
    t, p = texts.columns[1:]
    return texts.join(side.withColumnRenamed("part", p), ["doc_id", p]).withColumnsRenamed({t: "text", p: "part"})


def _with_part(keyed: DataFrame, t: str, p: str) -> DataFrame:
    """keyed with the column p: 0, but the CRC-32 of the text for ids that have several texts."""
    nothing = F.coalesce(F.length(t) * 0, F.lit(0)).cast("long")  # not a literal, which joins would plan away
    print_ = F.crc32(t)
    several = frames.cut(keyed.select("doc_id", print_.alias("x")).groupBy("doc_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter("lo < hi").select("doc_id"))
    if several.isEmpty():
        return keyed.withColumn(p, nothing)
    flag, key = frames.free_name(keyed, "several_"), frames.free_name(keyed, "its_id_")
    marked = keyed.join(several.select(F.col("doc_id").alias(key), F.lit(True).alias(flag)), F.col("doc_id") == F.col(key), "left")
    return marked.withColumn(p, F.when(F.col(flag), F.coalesce(print_, F.lit(0))).otherwise(nothing)).drop(flag, key)


def parse(docs: DataFrame, how: Parsing = Parsing(), with_text: bool = False) -> DataFrame:
    """docs with the struct column ``parsed``: n_words, n_removed, factors, and the hash of the kept words or, with_text, the text that is left."""
    name = frames.free_name(docs, "parsed")
    t, p, f, b, c, k1, k2 = (frames.free_name(docs, x) for x in ("bytes_", "part_", "found_", "blocks_", "copy_of_", "id_", "its_part_"))
    keyed = _with_part(docs.filter("doc_id is not null").withColumn(t, F.col("text").cast("binary")), t, p)
    texts = keyed.select("doc_id", t, p)  # names and order of keyed, so that both share a shuffle
    # exact copies of whole texts, of which only the first is indexed
    prints = texts.select("doc_id", F.col(p).alias("part"), F.sha2(t, 256).alias("print"))
    first = frames.cut(prints.groupBy("print").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    copies = frames.cut(prints.join(first, "print").filter("doc_id > copy_of").groupBy("doc_id", "part").agg(F.min("copy_of").alias("copy_of")))
    by_doc = _found(texts, copies, how)
    asked = by_doc.select("doc_id", "part", F.explode(_needed(how)("found")).alias("x")).select("doc_id", "part", "x.source", "x.ref")
    wanted = asked.select("source", "ref").distinct().groupBy(F.col("source").alias("doc_id"), F.shiftright("ref", _POSITION_BITS).alias("part")).agg(F.collect_list("ref").alias("refs"))
    blocks = _joined(texts, wanted).select(F.col("doc_id").alias("source"), F.explode(_blocks(how)("text", "refs")).alias("x")).select("source", "x.ref", "x.words")
    blocks = asked.join(blocks, ["source", "ref"]).groupBy("doc_id", "part").agg(F.collect_list(F.struct("source", "ref", "words")).alias("blocks"))
    every = keyed
    for side, column, to in ((by_doc, "found", f), (blocks, "blocks", b), (copies, "copy_of", c)):
        side = side.select(F.col("doc_id").alias(k1), F.col("part").alias(k2), F.col(column).alias(to))
        every = every.join(side, (F.col("doc_id") == F.col(k1)) & (F.col(p) == F.col(k2)), "left").drop(k1, k2)
    nameless = docs.filter("doc_id is null").withColumn(t, F.col("text").cast("binary"))
    for to in (f, b, c):
        nameless = nameless.withColumn(to, F.lit(None).cast(every.schema[to].dataType))
    columns = [*("`" + x.replace("`", "``") + "`" for x in docs.columns), t, f, b, c]
    every = every.select(*columns).union(nameless.select(*columns))
    frames.release(docs.sparkSession)  # the shuffles of the anchors are done with
    return every.select(*columns[: len(docs.columns)], _parse(how, with_text)(F.col(t), F.col(f), F.col(b), F.col(c)).alias(name))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(frames.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "parsed.n_words", "parsed.n_removed", "parsed.kept_sha256")


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages cut out of the texts; n_chars follows."""
    frames.ship(spark)
    name = frames.free_name(docs, "parsed")
    changed = parse(docs, with_text=True).withColumn("text", F.col(f"{name}.text").cast("string"))
    return frames.same_columns(frames.with_length(changed), docs)
