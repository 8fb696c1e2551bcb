"""Line dedup (10): a log-template tree of fixed depth; recurring templates are dropped.

A line's tokens with a digit are variable fields from the start. Lines go down a tree
of two levels: the number of tokens, then the leading token. In a leaf a token is
fixed at its place if at least ``least_docs`` lines of the leaf have it there (a line
counts once a document) and variable otherwise; variable places get a wildcard, and
lines with the same fixed tokens at the same places form a template. A template
stands only if enough of it is fixed: ``least_fixed`` tokens and the share
``least_share`` of all, with no more than ``longest_field`` wildcards in a row, since
a field of a log line is short and prose that merely begins alike is not a template.
The line itself, with its digit fields masked, is a template too.

A template that occurs in ``least_docs`` documents or more recurs: its lines are
dropped from all documents but the one with the smallest id. Lines of fewer tokens
than ``least_tokens`` recur by chance; they need ``short_docs`` documents. Where most
tokens are digit fields nothing is masked, so tables of numbers aren't one template.

At scale: equal lines of a chunk of texts are one row with the number of its
documents. Leaves are grouped by a shuffle and worked off with vectorised counts. A
leaf with more rows than both ``leaf_rows`` and a hundred-thousandth of all rows isn't
gathered: its tokens are counted by (leaf, place, token) in Spark, with sums before the
shuffle and joins that adaptive execution can split. Both ways give the same
templates; the names of such leaves, 100 000 at most, go through the driver.

Defined cases. Null, empty or blank text: no lines, unchanged. Rows without id: not
counted, unchanged. Repeated rows of one id count once and keep the same lines. A
text of dropped lines only becomes empty, its row stays. Keys are 64-bit hashes of
lines, tokens are compared by 32 bits within a leaf and place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .textops import U64, Words, _Table, chunks, gather, mix64, sliced


@dataclass(frozen=True)
class Templates:
    least_docs: int = 10
    least_tokens: int = 4
    short_docs: int = 100
    least_fixed: int = 5
    least_share: float = 0.6
    longest_field: int = 3
    #: Lines from which on a leaf may be counted in Spark; it changes the plan, not the result.
    leaf_rows: int = 20_000


_PLACES = _Table(21)
_FIELD = mix64(np.array([0x2A], U64))[0]
_STAR = mix64(np.array([0x5354], U64))[0]
_LOW = U64(0xFFFFFFFF)


class Lines:
    """The lines with a word of a batch of texts: bytes begin to end (past the newline), document, key, and the tokens.

    A key is odd, but even for a line that needs ``short_docs``. leaf: the node of the
    tree, 0 for a line that has no template but itself.
    """

    def __init__(self, column: pa.Array, how: Templates):
        words = Words(column)
        raw, offsets = words.raw, words.offsets
        plain = words.hashes()
        digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
        field = digits[words.ends] > digits[words.starts]
        tokens = np.where(field, _FIELD, plain) if len(plain) else plain
        begin = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(raw == 10) + 1]))
        begin = begin[begin < len(raw)]
        end = np.append(begin[1:], len(raw))
        first = np.searchsorted(words.starts, begin)
        n = np.diff(np.append(first, len(words.starts)))
        some = n > 0
        self.begin, self.end, self.n, self.first = begin[some], end[some], n[some], first[some]
        self.doc = np.searchsorted(offsets, self.begin, side="right") - 1
        self.raw, self.offsets, self.tokens = raw, offsets, tokens
        n, first = self.n, self.first
        self.key = self.leaf = np.zeros(0, U64)
        if not len(n):
            return
        place = np.arange(len(tokens)) - np.repeat(first, n)
        weight = _PLACES.upto(int(n.max()))[place]
        masked = 2 * np.add.reduceat(field.astype(np.int64), first) <= n
        total = np.where(masked, np.add.reduceat(tokens * weight, first), np.add.reduceat(plain * weight, first))
        key = mix64(total + (n.astype(U64) << U64(1)) + masked.astype(U64))
        self.key = np.where(n >= how.least_tokens, key | U64(1), key & ~U64(1))
        leaf = mix64(tokens[first] ^ mix64(n.astype(U64))) | U64(1)
        self.leaf = np.where(masked & (n > how.least_fixed), leaf, U64(0))


def _key_rows(how: Templates):
    """Text batches to (line, leaf, doc_id), each document's lines once; leaf is 0 but at a line's first document in a chunk, as it has one row of tokens there."""

    def run(batches):
        for batch in chunks(batches):
            lines = Lines(batch.column("text"), how)
            order = np.lexsort((lines.key, lines.doc))
            doc, key, leaf = lines.doc[order], lines.key[order], lines.leaf[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc[new]]
            key, leaf = key[new].view(np.int64), leaf[new].view(np.int64)
            again = np.ones(len(key), bool)
            again[np.unique(key, return_index=True)[1]] = False
            leaf[again] = 0
            for i in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (key, leaf, ids)], names=["line", "leaf", "doc_id"])

    return run


_TOKENS = "leaf bigint, line bigint, docs bigint, tokens array<int>"


def _token_rows(how: Templates, big: np.ndarray, of_big: bool):
    """Text batches to (leaf, line, docs, tokens) of the big leaves, or of all others; a row for each distinct line of a chunk."""

    def run(batches):
        for batch in chunks(batches):
            lines = Lines(batch.column("text"), how)
            use = np.flatnonzero((lines.leaf != 0) & (np.isin(lines.leaf, big) == of_big))
            order = use[np.lexsort((lines.doc[use], lines.key[use]))]
            if not len(order):
                continue
            key, doc = lines.key[order], lines.doc[order]
            line = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            other = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            at = order[line]
            docs = np.add.reduceat(other.astype(np.int64), line)
            tokens = (gather(lines.tokens, lines.first[at], lines.n[at]) & _LOW).astype(np.uint32).view(np.int32)
            offsets = np.concatenate([[0], np.cumsum(lines.n[at])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(lines.leaf[at].view(np.int64)), pa.array(lines.key[at].view(np.int64)), pa.array(docs), lists], names=["leaf", "line", "docs", "tokens"])

    return run


def patterns(leaf: np.ndarray, tokens: np.ndarray, n: np.ndarray, fixed: np.ndarray, how: Templates) -> np.ndarray:
    """The template of each line from its leaf, its tokens and which of them are fixed in the leaf; 0 where it isn't fixed enough or holds no wildcard."""
    first = np.cumsum(n) - n
    place = np.arange(len(tokens)) - np.repeat(first, n)
    value = np.where(fixed, tokens.view(np.uint32).astype(U64), _STAR)
    key = mix64(np.add.reduceat(mix64(value) * _PLACES.upto(int(n.max()))[place], first) ^ leaf) | U64(1)
    told = np.add.reduceat((fixed & (tokens.view(np.uint32) != np.uint32(_FIELD & _LOW))).astype(np.int64), first)
    stars = n - np.add.reduceat(fixed.astype(np.int64), first)
    # wildcards from each place on, as far as longest_field + 1 in the same line
    long = ~fixed
    for back in range(1, how.longest_field + 1):
        long[back:] &= ~fixed[:-back]
        long[:back] = False
    long &= place >= how.longest_field
    runs = np.add.reduceat(long.astype(np.int64), first)
    return np.where((stars > 0) & (told >= how.least_fixed) & (told >= how.least_share * n) & (runs == 0), key, U64(0))


def _templates_of_leaves(how: Templates):
    """(leaf, line, docs, tokens) batches in the order of leaves to (line, template) of templates that may recur."""

    def work(table: pa.Table):
        leaf = table.column("leaf").to_numpy().view(U64)
        docs = table.column("docs").to_numpy()
        lists = table.column("tokens").combine_chunks()
        tokens = lists.flatten().to_numpy()
        n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
        at = mix64(np.repeat(leaf, n) ^ mix64(tokens.view(np.uint32).astype(U64) | (place.astype(U64) << U64(32))))
        _, inverse = np.unique(at, return_inverse=True)
        fixed = np.bincount(inverse, weights=np.repeat(docs, n))[inverse] >= how.least_docs
        template = patterns(leaf, tokens, n, fixed, how)
        own, inverse = np.unique(template, return_inverse=True)
        use = (np.bincount(inverse, weights=docs)[inverse] >= how.least_docs) & (template != 0)
        if use.any():
            yield pa.RecordBatch.from_arrays([table.column("line").combine_chunks().filter(pa.array(use)), pa.array(template[use].view(np.int64))], names=["line", "template"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 4000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            leaf = table.column("leaf").to_numpy()
            whole = int(np.flatnonzero(leaf != leaf[-1])[-1]) + 1 if leaf[0] != leaf[-1] else 0
            if whole:  # the last leaf may go on
                yield from work(table.slice(0, whole).combine_chunks())
                held, size = table.slice(whole).combine_chunks().to_batches(), len(table) - whole
        if size:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return run


def _pattern(how: Templates):
    def run(leaf: pa.Array, tokens: pa.Array, fixed: pa.Array) -> pa.Array:
        if not len(leaf):
            return pa.array([], pa.int64())
        flags = fixed.flatten().to_numpy(zero_copy_only=False).astype(bool)
        return pa.array(patterns(leaf.to_numpy().view(U64), tokens.flatten().to_numpy(), np.diff(tokens.offsets.to_numpy()).astype(np.int64), flags, how).view(np.int64))

    return F.arrow_udf(run, "bigint")


def _templates_of_big_leaves(rows: DataFrame, how: Templates) -> DataFrame:
    """The same by counts in Spark: nothing of a leaf is gathered."""
    lines = frames.cut(rows.groupBy("leaf", "line").agg(F.sum("docs").alias("docs"), F.first("tokens").alias("tokens")))
    each = lines.select("leaf", "line", "docs", F.posexplode("tokens").alias("place", "token"))
    often = frames.cut(each.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).filter(F.col("n") >= how.least_docs).select("leaf", "place", "token", F.lit(True).alias("fixed")))
    told = each.join(often, ["leaf", "place", "token"], "left").groupBy("leaf", "line", "docs")
    told = told.agg(F.sort_array(F.collect_list(F.struct("place", "token", F.coalesce("fixed", F.lit(False)).alias("fixed")))).alias("t"))
    found = frames.cut(told.select("line", "docs", _pattern(how)("leaf", "t.token", "t.fixed").alias("template")).filter("template <> 0"))
    enough = frames.cut(found.groupBy("template").agg(F.sum("docs").alias("n")).filter(F.col("n") >= how.least_docs).select("template"))
    return found.join(enough, "template").select("line", "template")


def _counted_again(docs: DataFrame, lines: DataFrame) -> DataFrame | None:
    """(line, over): how often rows of one id hold a line beyond the first of them; None if no id has two rows."""
    ids = frames.cut(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if ids.isEmpty():
        return None
    each = lines.join(ids, "doc_id", "left_semi").groupBy("line", "doc_id").agg((F.count("*") - 1).alias("over"))
    return frames.cut(each.groupBy("line").agg(F.sum("over").alias("over")).filter("over > 0"))


def lines_of(docs: DataFrame, how: Templates = Templates()) -> tuple[DataFrame, DataFrame]:
    """(line, leaf or 0, doc_id) of all lines, and (line, template) of those that generalise."""
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    lines = frames.cut(texts.mapInArrow(_key_rows(how), "line bigint, leaf bigint, doc_id bigint"))
    leaves = lines.filter("leaf <> 0").groupBy("leaf").agg(F.count("*").alias("n"))
    limit = max(how.leaf_rows, (leaves.agg(F.sum("n")).first()[0] or 0) // 100_000)
    big = np.array([r.leaf for r in leaves.filter(F.col("n") > limit).select("leaf").collect()], np.int64).view(U64)  # 100 000 at most
    over = _counted_again(docs, lines)

    def rows(of_big: bool) -> DataFrame:
        found = texts.mapInArrow(_token_rows(how, big, of_big), _TOKENS)
        if over is None:
            return found
        less = found.join(over, "line").groupBy("leaf", "line").agg((-F.first("over")).alias("docs"), F.first("tokens").alias("tokens"))
        return found.unionByName(less)

    members = rows(False).repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_templates_of_leaves(how), "line bigint, template bigint")
    if len(big):
        members = members.union(_templates_of_big_leaves(rows(True), how))
    return lines, frames.cut(members.distinct())


def recurring(docs: DataFrame, how: Templates = Templates()) -> tuple[DataFrame, DataFrame]:
    """(template, line, doc_id) of all lines, each also under its own key, and (template, first_doc, n_docs) of the templates that recur."""
    lines, members = lines_of(docs, how)
    rows = lines.select(F.col("line").alias("template"), "line", "doc_id").union(lines.join(members, "line").select("template", "line", "doc_id"))
    least = F.when(F.col("template") % 2 == 0, how.short_docs).otherwise(how.least_docs)
    # cut, so that the join back is a plain one, whose hot lines adaptive execution can split
    return rows, frames.cut(rows.groupBy("template").agg(F.min("doc_id").alias("first_doc"), F.count_distinct("doc_id").alias("n_docs")).filter(F.col("n_docs") >= least))


_CLEANED = "struct<text: binary, n_lines: bigint, n_dropped: bigint>"


def _clean(how: Templates):
    def run(text: pa.Array, dropped: pa.Array) -> pa.Array:
        out, at = [], 0
        for part in sliced(text):
            lines = Lines(part, how)
            data = lines.raw.tobytes()
            edge = np.searchsorted(lines.doc, np.arange(len(part) + 1))
            for d in range(len(part)):
                lo, hi = edge[d], edge[d + 1]
                start, stop = int(lines.offsets[d]), int(lines.offsets[d + 1])
                gone = dropped[at + d]
                kept, n = data[start:stop], 0
                if gone.is_valid and hi > lo:
                    drop = np.isin(lines.key[lo:hi], gone.values.to_numpy(zero_copy_only=False).view(U64))
                    n = int(drop.sum())
                    pieces, here = [], start
                    for b, e in zip(lines.begin[lo:hi][drop].tolist(), lines.end[lo:hi][drop].tolist()):
                        pieces.append(data[here:b])
                        here = e
                    kept = b"".join([*pieces, data[here:stop]])
                out.append((kept if part[d].is_valid else None, int(hi - lo), n))
            at += len(part)
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["text", "n_lines", "n_dropped"])

    return F.arrow_udf(run, _CLEANED)


def drop_recurring(docs: DataFrame, how: Templates = Templates()) -> DataFrame:
    """docs with the struct column ``lines`` (or a free name like it): the cleaned text, lines with a word, lines dropped."""
    rows, templates = recurring(docs, how)
    frames.release(docs.sparkSession)  # the shuffle of the tokens is done with
    gone = rows.join(templates, "template").filter("doc_id > first_doc").groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
    k, g, name = frames.free_name(docs, "id_"), frames.free_name(docs, "gone_"), frames.free_name(docs, "lines")
    joined = docs.join(gone.select(F.col("doc_id").alias(k), F.col("gone").alias(g)), docs.doc_id == F.col(k), "left")
    return joined.select(*(frames.quoted(docs, c) for c in docs.columns), _clean(how)(docs.text.cast("binary"), F.col(g)).alias(name))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_recurring(frames.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.text", 256).alias("kept_sha256"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without recurring lines; n_chars follows."""
    frames.ship(spark)
    name = frames.free_name(docs, "lines")
    done = drop_recurring(docs).withColumn("text", F.col(f"{name}.text").cast("string"))
    return frames.same_columns(frames.with_length(done), docs)
