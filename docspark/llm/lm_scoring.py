"""LM scoring (8): interpolated modified Kneser-Ney bigrams and trigrams counted in Spark.

Four Spark jobs build the model in the shared folder:
1. word counts: the vocabulary as sorted arrays of word hashes and counts;
2. bigram counts, keyed by a bijective mix of both word numbers, as sorted
   arrays; the same pass returns what each part adds to the statistics of
   contexts (followers seen once, twice, more) and to the continuation counts;
3. for each word its continuation probability and its weight as a context;
4. trigram counts, keyed by (place of the bigram before in its part, word) and dealt by
   that part, so that a part has whole contexts and a key fits 64 bits at any size; each distinct trigram then goes to
   its last two words for the middle order's continuation counts.
Parts are as many as the input asks for, since a task holds one; once written, neighbours are joined, so that an array
lies in a few files at any size. Workers memory-map these and score whole batches with vectorised lookups.

A text's tokens are its words (A-Z lower-cased) and one end; the first word's
context is the beginning of a text. p(w|v) = (c - D(c)) / c(v) + g(v) p(w),
p(w) = (n(w) - D'(n)) / B + g / (V + 1), with n the contexts that w follows, B
all distinct bigrams, and discounts from the counts of counts. That is ``score2``.
``score`` is order three: p(w|u,v) = (c - D3(c)) / c(u,v) + g(u,v) p'(w|v), where
p'(w|v) takes n(v,w), the distinct words before both, in place of the count, and
p(w) is as above; a text begins with two beginnings.

``least_triple`` (1 to 3) is a cutoff: trigrams seen less often are counted like all
others, in every statistic of contexts and lower orders, but their discount is their
whole count and they aren't stored. 1 keeps the model exact. Most trigrams of a corpus
occur once, so 2 makes the stored model several times smaller; probabilities still add
up to 1.

Defined cases. Null or empty text: the end alone. Unknown words get the uniform
share g / (V + 1). Nothing to learn from: every token has probability 1 in V + 1
= 1, score 0. Null ids are not learned from. Repeated rows count each time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .arrays import FILE_BITS, Parts, in_files, join, part_of, save
from .textops import U64, Words, chunks, mix64, runs, sliced

END = mix64(np.array([0x656E64], U64))[0]
#: Keys that a task holds before it passes their counts on.
FLUSH = 3_000_000
#: Rows that a part is planned for.
PART_ROWS = 500_000


@dataclass
class Model:
    folder: str
    vocab_bits: int
    vocab_sizes: np.ndarray
    pair_bits: int
    pair_sizes: np.ndarray
    tokens: int
    discounts: tuple[float, float, float]
    uniform: float
    begin: tuple[float, float]  # count and weight of the beginning as a context
    triple_sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    discounts3: tuple[float, float, float] = (0.5, 1.0, 1.5)
    discounts2: tuple[float, float, float] = (0.5, 1.0, 1.5)  # of the middle order
    begin3: tuple[int, ...] = (0, 0, 0)  # words after two beginnings: seen once, twice, more
    begin2: tuple[int, ...] = (0, 0, 0, 0)  # of the middle order after a beginning: all, once, twice, more
    _parts: dict = field(default_factory=dict, repr=False)

    @property
    def size(self) -> int:
        return int(self.vocab_sizes.sum())

    @property
    def pairs(self) -> int:
        """Distinct bigrams; as a place, two beginnings."""
        return int(self.pair_sizes.sum())

    @property
    def word_bits(self) -> int:
        return self.size.bit_length()

    @property
    def file_bits(self) -> int:
        """Files of bigrams: few, but so many that the place of a bigram in its file and a word fit 64 bits."""
        bits = FILE_BITS
        while bits < self.pair_bits and int(in_files(self.pair_sizes, bits).max()).bit_length() + self.word_bits > 64:
            bits += 1
        return bits

    def triples(self) -> Parts:
        """Trigrams by (place of the first two words in their file, third word), in the file of the first two."""
        if "triples" not in self._parts:
            self._parts["triples"] = Parts(f"{self.folder}/triples", min(self.pair_bits, self.file_bits), in_files(self.triple_sizes, self.file_bits))
        return self._parts["triples"]

    def parts(self) -> tuple[Parts, Parts]:
        if "pairs" not in self._parts:
            self._parts["vocab"] = Parts(f"{self.folder}/vocab", min(self.vocab_bits, FILE_BITS), in_files(self.vocab_sizes))
            self._parts["pairs"] = Parts(f"{self.folder}/pairs", min(self.pair_bits, self.file_bits), in_files(self.pair_sizes, self.file_bits))
        return self._parts["vocab"], self._parts["pairs"]


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each document's end included, and the place of each document's first token."""
    words = Words(column, lower=True)
    return np.insert(words.hashes(), words.first[1:], END), words.first[:-1] + np.arange(words.n_docs)


def numbers_of(vocab: Parts, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes' places in the vocabulary (-1: unknown) and for each token which of them it is."""
    unique, inverse = np.unique(mix64(hashes), return_inverse=True)
    return vocab.find(unique), inverse, unique


def _pairs_of(numbers: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
    """Keys of all bigrams of known tokens: a bijective mix of both numbers. -1 numbers never pair."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[first] = begin
    return before, (before.astype(U64) << U64(32)) | numbers.astype(U64)


def _bits(rows: int) -> int:
    return min(max(0, math.ceil(math.log2(max(rows, 1) / PART_ROWS))), 24) if rows > PART_ROWS else 4


def _by_part(part: np.ndarray, keys: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Rows (part, keys, counts); part is sorted."""
    start, size = runs(part)
    return [(int(part[s]), planes(keys[s : s + z]), planes(n[s : s + z])) for s, z in zip(start.tolist(), size.tolist())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "keys", "counts"])


def _counted(keys_of, grouped, batches):
    """(part, keys, counts) of the keys of text batches, summed over FLUSH keys at a time; a row for each part and flush."""
    held, size = [], 0
    for batch in chunks(batches):
        held.append(keys_of(batch.column("text")))
        size += len(held[-1][0])
        if size >= FLUSH:
            yield _batch(_by_part(*grouped(*map(np.concatenate, zip(*held)))))
            held, size = [], 0
    if size:
        yield _batch(_by_part(*grouped(*map(np.concatenate, zip(*held)))))


def _by_hash(bits: int):
    """Keys whose part is in their mixed bits: (part, distinct keys, counts) by part."""

    def grouped(keys: np.ndarray) -> tuple[np.ndarray, ...]:
        keys, n = np.unique(keys, return_counts=True)
        part = part_of(mix64(keys), bits)
        order = np.argsort(part, kind="stable")
        return part[order], keys[order], n[order].astype(np.uint32)

    return grouped


def _distinct(part: np.ndarray, keys: np.ndarray, inverse: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (part, key) in order, and which of them each row is, or how often each occurs."""
    bits = max(int(keys.max()).bit_length(), 1)
    if bits + int(part.max()).bit_length() <= 64:  # one number holds both: a single sort
        both, told = np.unique((part.astype(U64) << U64(bits % 64)) | keys, return_inverse=inverse, return_counts=not inverse)
        mask = U64((1 << bits) - 1)
        return (both >> U64(bits)).astype(np.int64) if bits < 64 else np.zeros(len(both), np.int64), both & mask, told
    order = np.lexsort((keys, part))
    new = np.ones(len(order), bool)
    new[1:] = (part[order][1:] != part[order][:-1]) | (keys[order][1:] != keys[order][:-1])
    start = np.flatnonzero(new)
    told = np.diff(np.append(start, len(order)))
    if inverse:
        told = np.empty(len(order), np.int64)
        told[order] = np.cumsum(new) - 1
    return part[order][start], keys[order][start], told


def _in_parts(part: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """(part, distinct keys, counts) of keys that say their part beside them."""
    part, keys, n = _distinct(part, keys, inverse=False)
    return part, keys, n.astype(np.uint32)


def planes(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes: the high bytes of sorted numbers change slowly, so that shuffle compression takes them away."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _summed(table: pa.Table, mix=mix64) -> tuple[int, np.ndarray, np.ndarray]:
    """A part's distinct mixed keys in order, and their counts."""
    keys = mix(np.concatenate([from_planes(x, U64) for x in table.column("keys").to_pylist()]))
    n = np.concatenate([from_planes(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start, _ = runs(keys)
    return table.column("part")[0].as_py(), keys[start], np.add.reduceat(n[order], start)


def _small(n: np.ndarray) -> np.ndarray:
    return n.astype(np.min_scalar_type(int(n.max(initial=0))))


_COUNTED = "part int, keys binary, counts binary"


def _home(folder: str, bits: int) -> str:
    """Where parts are written: a folder of their own if they are joined, else they are the files."""
    return f"{folder}/parts" if bits > FILE_BITS else folder


def _join(spark: SparkSession, folder: str, stem: str, names: tuple[str, ...], sizes: np.ndarray, bits: int = FILE_BITS, gaps: tuple[str, ...] = (), add: np.ndarray | None = None) -> None:
    """Join the parts of arrays to files, a task for each; ``add`` is for the first array."""
    if len(sizes) <= 1 << FILE_BITS:
        return
    each, home = len(sizes) >> bits, f"{folder}/parts/{stem}"

    def run(batches):
        for batch in batches:
            for q in batch.column("id").to_pylist():
                own = [p for p in range(q * each, (q + 1) * each) if sizes[p]]
                for name in names if own else ():
                    join([f"{home}/{name}-{p}.npy" for p in own], [int(sizes[p]) for p in own], f"{folder}/{stem}/{name}-{q}.npy", name in gaps, [int(add[p]) for p in own] if add is not None and name == names[0] else None)
        yield from ()

    spark.range(0, 1 << bits, 1, 1 << bits).mapInArrow(run, "id bigint").collect()  # no rows
    frames.delete(spark, home)


def _count_words(texts: DataFrame, folder: str, bits: int) -> tuple[np.ndarray, int]:
    def words(batches):
        yield from _counted(lambda column: (tokens_of(column)[0],), _by_hash(bits), batches)

    def write(table: pa.Table) -> pa.Table:
        part, keys, n = _summed(table)
        save(f"{_home(folder, bits)}/vocab/keys-{part}.npy", keys)
        save(f"{_home(folder, bits)}/vocab/counts-{part}.npy", _small(n))
        return pa.table({"part": pa.array([part], pa.int32()), "size": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    rows = texts.mapInArrow(words, _COUNTED).groupBy("part").applyInArrow(write, "part int, size bigint, tokens bigint").collect()  # a row for each part
    sizes = np.zeros(1 << bits, np.int64)
    for r in rows:
        sizes[r.part] = r["size"]
    _join(texts.sparkSession, folder, "vocab", ("keys", "counts"), sizes)
    return sizes, sum(r.tokens for r in rows)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many counts are 1, 2, 3 and 4; 0.5, 1, 1.5 where too few are seen."""
    n1, n2, n3, n4 = n
    if not min(n):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))


def fit(texts: DataFrame, least_triple: int = 1) -> Model:
    """Count and estimate over all rows of ``text`` (binary); files go to a new folder in the shared one."""
    if least_triple not in (1, 2, 3):
        raise ValueError("least_triple is 1, 2 or 3")
    spark = texts.sparkSession
    folder = frames.new_folder(spark, "kneser-ney")
    frames.ship(spark)
    size = max(texts.agg(F.sum(F.length("text").cast("double"))).first()[0] or 0.0, 1.0)
    guess = int(size / 6)  # tokens, about; sets only how many parts there are
    vocab_bits, pair_bits = _bits(guess // 8), _bits(guess)
    vocab_sizes, tokens = _count_words(texts, folder, vocab_bits)
    model = Model(folder, vocab_bits, vocab_sizes, pair_bits, np.zeros(1 << pair_bits, np.int64), tokens, (0.5, 1.0, 1.5), 1.0, (0.0, 1.0))
    begin = model.size

    if begin >= 1 << 32:
        raise ValueError("a vocabulary beyond 2^32 words")

    def pair_keys(column: pa.Array) -> tuple[np.ndarray]:
        hashes, first = tokens_of(column)
        places, inverse, _ = numbers_of(model.parts()[0], hashes)
        return (_pairs_of(places[inverse], first, begin)[1],)

    def pairs(batches):
        yield from _counted(pair_keys, _by_hash(pair_bits), batches)

    def write(table: pa.Table) -> pa.Table:
        part, keys, n = _summed(table)
        save(f"{_home(folder, pair_bits)}/pairs/keys-{part}.npy", keys)
        save(f"{_home(folder, pair_bits)}/pairs/counts-{part}.npy", _small(n))
        raw = unmix64(keys)
        context, word = (raw >> U64(32)).astype(np.int64), (raw & U64(0xFFFFFFFF)).astype(np.int64)
        ids, inverse = np.unique(context, return_inverse=True)
        sums = [np.bincount(inverse, weights=w).astype(np.int64) for w in (n, n == 1, n == 2, n > 2)]
        followed, times = np.unique(word, return_counts=True)
        zero = np.zeros(len(followed), np.int64)
        of_counts = [int((n == c).sum()) for c in (1, 2, 3, 4)]
        # rows: contexts, then words, then this part's own numbers under id -1
        columns = [np.concatenate([a, b, [c]]) for a, b, c in zip([ids, *sums, np.zeros(len(ids), np.int64)], [followed, zero, zero, zero, zero, times], [-1, *of_counts, len(keys)])]
        return pa.table({"part": pa.array(np.full(len(columns[0]), part, np.int32)), **{c: pa.array(x.astype(np.int64)) for c, x in zip(("id", "total", "once", "twice", "more", "contexts"), columns)}})

    stats = "part int, id bigint, total bigint, once bigint, twice bigint, more bigint, contexts bigint"
    texts.mapInArrow(pairs, _COUNTED).groupBy("part").applyInArrow(write, stats).write.parquet(f"{folder}/stats")
    rows = spark.read.schema(stats).parquet(f"{folder}/stats")
    seen = [0, 0, 0, 0]
    for r in rows.filter("id = -1").collect():  # a row for each part
        model.pair_sizes[r.part] = r.contexts
        seen = [a + b for a, b in zip(seen, (r.total, r.once, r.twice, r.more))]
    _join(spark, folder, "pairs", ("keys", "counts"), model.pair_sizes, model.file_bits)
    model.discounts = d = _discounts(seen)
    words = frames.cut(rows.filter("id >= 0").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("total", "once", "twice", "more", "contexts"))))
    n = words.filter("contexts > 0").agg(*(F.sum((F.col("contexts") == i).cast("long")) for i in (1, 2, 3, 4)), F.sum((F.col("contexts") > 2).cast("long"))).first()
    low = _discounts([x or 0 for x in n[:4]])
    bigrams = max(int(model.pair_sizes.sum()), 1)
    rest = (low[0] * (n[0] or 0) + low[1] * (n[1] or 0) + low[2] * (n[4] or 0)) / bigrams
    model.uniform = rest / (begin + 1) if begin else 1.0
    for r in words.filter(F.col("id") == begin).collect():  # one row
        model.begin = (float(r.total), (d[0] * r.once + d[1] * r.twice + d[2] * r.more) / r.total)
    ends = np.cumsum(vocab_sizes)
    uniform = model.uniform

    def part(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(ends, ids.to_numpy(), side="right").astype(np.int32))

    def estimate(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        own = table.column("id").to_numpy() - (ends[p] - vocab_sizes[p])
        total, once, twice, more, contexts = (table.column(c).to_numpy().astype(float) for c in ("total", "once", "twice", "more", "contexts"))
        weight, lower, totals = np.ones(vocab_sizes[p]), np.full(vocab_sizes[p], uniform), np.zeros(vocab_sizes[p])
        some = total > 0
        weight[own[some]] = ((d[0] * once + d[1] * twice + d[2] * more)[some]) / total[some]
        totals[own] = total
        lower[own] += np.maximum(contexts - np.array([0, *low])[np.minimum(contexts, 3).astype(int)], 0) / bigrams
        for name, values in (("weight", weight), ("total", totals), ("lower", lower)):
            save(f"{_home(folder, vocab_bits)}/vocab/{name}-{p}.npy", values)
        return pa.table({"part": pa.array([p], pa.int32())})

    words.filter(F.col("id") < begin).withColumn("part", F.arrow_udf(part, "int")("id")).groupBy("part").applyInArrow(estimate, "part int").count()
    _join(spark, folder, "vocab", ("weight", "total", "lower"), vocab_sizes)
    model._parts.clear()
    del rows, words
    frames.delete(spark, f"{folder}/stats")
    frames.release(spark)
    _fit_triples(texts, model, least_triple)
    return model


def _places(column: pa.Array, model: Model) -> tuple[np.ndarray, ...]:
    """Each token's word (-1: unknown), the place of the bigram that it ends (-1: none) and of the one before it, and each document's first token."""
    hashes, first = tokens_of(column)
    vocab, pairs = model.parts()
    found, inverse, _ = numbers_of(vocab, hashes)
    numbers = found[inverse]
    before, keys = _pairs_of(numbers, first, model.size)
    return numbers, *_contexts(pairs, numbers, before, keys, first, model), first


def _contexts(pairs: Parts, numbers: np.ndarray, before: np.ndarray, keys: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    at = np.full(len(numbers), -1, np.int64)
    both = np.flatnonzero((before >= 0) & (numbers >= 0))
    if len(both):
        distinct, where = np.unique(mix64(keys[both]), return_inverse=True)
        at[both] = pairs.find(distinct)[where]
    context = np.empty_like(at)
    context[1:] = at[:-1]
    context[first] = model.pairs if model.begin[0] else -1
    return at, context


def _triple_keys(context: np.ndarray, numbers: np.ndarray, model: Model, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The part of each context, or the file if those are the sizes, and the key there; two beginnings come after the last one's bigrams."""
    sizes = model.pair_sizes if sizes is None else sizes
    ends = np.cumsum(sizes)
    part = np.minimum(np.searchsorted(ends, context, side="right"), len(ends) - 1)
    own = context - (ends - sizes)[part]
    return part, (own.astype(U64) << U64(model.word_bits)) | numbers.astype(U64)


def _told(*numbers) -> tuple[int, bytes, bytes]:
    """A row of the part -1, for the driver."""
    return -1, np.array(numbers, np.int64).tobytes(), b""


def _of_counts(n: np.ndarray) -> list[int]:
    return [int((n == c).sum()) for c in (1, 2, 3, 4)]


def _fit_triples(texts: DataFrame, model: Model, least: int) -> None:
    """Count the trigrams and what they add to the middle order; the driver gets a few numbers for each part."""
    folder, begin, sizes = model.folder, model.size, model.pair_sizes
    base, vocab_ends, home = np.cumsum(sizes) - sizes, np.cumsum(model.vocab_sizes), _home(folder, model.pair_bits)

    def keys_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        numbers, _, context, _ = _places(column, model)
        return _triple_keys(context, numbers, model)

    def count(batches):
        yield from _counted(keys_of, _in_parts, batches)

    def write(table: pa.Table) -> pa.Table:
        p, keys, n = _summed(table, mix=lambda x: x)
        kept = n >= least
        save(f"{home}/triples/keys-{p}.npy", keys[kept])
        save(f"{home}/triples/counts-{p}.npy", _small(n[kept]))
        start, followers = runs(keys >> U64(model.word_bits))
        own = (keys[start] >> U64(model.word_bits)).astype(np.int64)
        inner = own < sizes[p]  # the others: two beginnings
        split = [np.add.reduceat(x.astype(np.int64), start) for x in (n == 1, n == 2, n > 2)]
        second = np.full(len(own), begin, U64)
        if inner.any():
            second[inner] = unmix64(model.parts()[1].take("keys", base[p] + own[inner])) & U64(0xFFFFFFFF)
            for name, x in zip(("once", "twice", "more"), split):
                whole = np.zeros(sizes[p], np.int64)
                whole[own[inner]] = x[inner]
                save(f"{home}/pairs/{name}-{p}.npy", _small(whole))
        last, times = np.unique(mix64((np.repeat(second, followers) << U64(32)) | (keys & U64((1 << model.word_bits) - 1))), return_counts=True)
        rows = _by_part(part_of(last, model.pair_bits), model.parts()[1].find(last).astype(U64), times.astype(np.uint32))
        return pa.Table.from_batches([_batch([*rows, _told(3, p, int(kept.sum()), *_of_counts(n), *(int(x[~inner].sum()) for x in split))])])

    def middle(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        if p < 0:
            return table
        _, places, n = _summed(table, mix=lambda x: x)
        whole = np.zeros(sizes[p], np.int64)
        whole[places.astype(np.int64) - base[p]] = n
        save(f"{home}/pairs/behind-{p}.npy", _small(whole))
        ids, inverse = np.unique(unmix64(model.parts()[1].take("keys", base[p] + np.arange(sizes[p]))) >> U64(32), return_inverse=True)
        sums = np.array([np.bincount(inverse, weights=w, minlength=len(ids)) for w in (whole, whole == 1, whole == 2, whole > 2)]).astype(np.uint32)
        inner = ids < U64(begin)
        told = _told(2, *_of_counts(whole), *(int(x[~inner].sum()) for x in sums))
        ids, sums = ids[inner], sums[:, inner]
        start, size = runs(np.searchsorted(vocab_ends, ids.astype(np.int64), side="right"))
        rows = [(int(np.searchsorted(vocab_ends, int(ids[s]), side="right")), planes(ids[s : s + z]), planes(sums[:, s : s + z].ravel())) for s, z in zip(start.tolist(), size.tolist())]
        return pa.Table.from_batches([_batch([*rows, told])])

    def contexts(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        if p < 0:
            return table
        whole = np.zeros((4, model.vocab_sizes[p]), np.int64)
        for keys, n in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist()):
            whole[:, from_planes(keys, U64).astype(np.int64) - (vocab_ends[p] - model.vocab_sizes[p])] += from_planes(n, np.uint32).reshape(4, -1)
        for name, x in zip(("total2", "once2", "twice2", "more2"), whole):
            save(f"{_home(folder, model.vocab_bits)}/vocab/{name}-{p}.npy", _small(x))
        return table.slice(0, 0)

    spark = texts.sparkSession
    texts.mapInArrow(count, _COUNTED).groupBy("part").applyInArrow(write, _COUNTED).write.parquet(f"{folder}/behind")
    frames.release(spark)  # the shuffle of the trigrams is done with
    rows = spark.read.schema(_COUNTED).parquet(f"{folder}/behind")
    for step in (middle, contexts):
        rows = rows.groupBy("part").applyInArrow(step, _COUNTED)
    model.triple_sizes = np.zeros(len(sizes), np.int64)
    told = [np.frombuffer(r["keys"], np.int64) for r in rows.collect()]  # two rows for each part
    frames.delete(spark, f"{folder}/behind")
    for x in told:
        if x[0] == 3:
            model.triple_sizes[x[1]] = x[2]
    bits = model.file_bits
    split, split2 = ("once", "twice", "more"), ("total2", "once2", "twice2", "more2")
    _join(spark, folder, "pairs", (*split, "behind"), sizes, bits, gaps=split)  # of a part whose bigrams end texts there is no file
    _join(spark, folder, "vocab", split2, model.vocab_sizes, gaps=split2)
    files = in_files(sizes, bits)
    inside = base - np.repeat(np.cumsum(files) - files, len(sizes) // len(files))  # a part's first place in its file
    _join(spark, folder, "triples", ("keys", "counts"), model.triple_sizes, bits, add=inside << model.word_bits)
    sums = lambda kind, lo, hi: tuple(sum(int(x[i]) for x in told if x[0] == kind) for i in range(lo, hi))
    d = _discounts(list(sums(3, 3, 7)))
    model.discounts3, model.begin3 = tuple(float(k) if k < least else d[k - 1] for k in (1, 2, 3)), sums(3, 7, 10)
    model.discounts2, model.begin2 = _discounts(list(sums(2, 1, 5))), sums(2, 5, 9)
    model._parts.clear()


def _unshift(x: np.ndarray, by: int) -> np.ndarray:
    out = x
    for _ in range(64 // by):
        out = x ^ (out >> U64(by))
    return out


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of mix64."""
    x = _unshift(x, 31) * U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = _unshift(x, 27) * U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return _unshift(x, 30)


def log_probabilities(column: pa.Array, model: Model) -> tuple[np.ndarray, ...]:
    """For each text: tokens, known tokens, the add-half unigram score and the model's scores of order three and two (log10)."""
    hashes, first = tokens_of(column)
    vocab, pairs = model.parts()
    places, inverse, unique = numbers_of(vocab, hashes)
    known = places >= 0
    count, total, weight, lower = np.zeros(len(unique)), np.zeros(len(unique)), np.ones(len(unique)), np.full(len(unique), model.uniform)
    for name, out in (("counts", count), ("total", total), ("weight", weight), ("lower", lower)):
        out[known] = vocab.take(name, places[known])
    base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.size + 1)))[inverse]
    numbers = places[inverse]
    before, keys = _pairs_of(numbers, first, model.size)
    at, two = _contexts(pairs, numbers, before, keys, first, model)
    seen, behind = _taken(pairs, ("counts", "behind"), at)
    context = np.zeros(len(inverse), np.int64)
    context[1:] = inverse[:-1]
    own_total, own_weight = total[context], weight[context]
    own_total[first], own_weight[first] = model.begin
    cut = np.array([0.0, *model.discounts])[np.minimum(seen, 3).astype(np.int64)]
    p = np.divide(np.maximum(seen - cut, 0), own_total, out=np.zeros(len(seen)), where=own_total > 0)
    p += np.where(own_total > 0, own_weight, 1.0) * lower[inverse]
    # order three: the middle order, then the trigrams
    own = np.zeros((4, len(unique)))
    some = known & (total > 0)
    for name, out in zip(("total2", "once2", "twice2", "more2"), own):
        out[some] = vocab.take(name, places[some])
    own = own[:, context]
    own[:, first] = np.array(model.begin2, float)[:, None]
    middle = _interpolated(behind, own[0], own[1:], model.discounts2, lower[inverse])
    after = np.array(_taken(pairs, ("counts", "once", "twice", "more"), np.where(two < model.pairs, two, -1)))
    after[:, two == model.pairs] = np.array([model.begin[0], *model.begin3], float)[:, None]
    triple = np.full(len(numbers), -1, np.int64)
    both = np.flatnonzero((two >= 0) & (numbers >= 0))
    if len(both):
        part, keys = _triple_keys(two[both], numbers[both], model, pairs.sizes)
        part, keys, where = _distinct(part, keys, inverse=True)
        triple[both] = model.triples().find(keys, part)[where]
    p3 = _interpolated(_taken(model.triples(), ("counts",), triple)[0], after[0], after[1:], model.discounts3, middle)
    sums = lambda x: np.add.reduceat(x, first)  # noqa: E731  every document has a token
    return np.diff(np.append(first, len(hashes))), sums(known[inverse].astype(np.int64)), sums(base), sums(np.log10(p3)), sums(np.log10(p))


def _taken(parts: Parts, names: tuple[str, ...], at: np.ndarray) -> list[np.ndarray]:
    """The arrays' values at places in any order; 0 at place -1."""
    distinct, where = np.unique(at, return_inverse=True)
    lead = int(len(distinct) and distinct[0] < 0)
    return [np.concatenate([np.zeros(lead), parts.take(name, distinct[lead:])])[where] for name in names]


def _interpolated(seen: np.ndarray, total: np.ndarray, split: np.ndarray, d: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    """Discounted share of the context's total, and the rest by the lower order; split: words after the context seen once, twice, more."""
    some = total > 0
    cut = np.array([0.0, *d])[np.minimum(seen, 3).astype(np.int64)]
    p = np.divide(np.maximum(seen - cut, 0), total, out=np.zeros(len(seen)), where=some)
    return p + np.divide(d[0] * split[0] + d[1] * split[1] + d[2] * split[2], total, out=np.ones(len(seen)), where=some) * lower


_SCORES = "struct<n_tokens: bigint, n_known: bigint, base_score: double, score: double, score2: double>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the struct column ``lm`` (or a free name like it)."""

    def run(text: pa.Array) -> pa.Array:
        found = [log_probabilities(part, model) for part in sliced(text)]
        whole = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0)] * 5
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(whole, kinds)], names=["n_tokens", "n_known", "base_score", "score", "score2"])

    return docs.withColumn(frames.free_name(docs, "lm"), F.arrow_udf(run, _SCORES)(docs.text.cast("binary")))


#: Of the query: the exact order three takes more disk than the budget has (figures in the README).
LEAST_TRIPLE = 2


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = frames.unsigned_crc32(F.col("doc_id")) % 5 == 1
    model = fit(docs.filter(~held_out).select(F.col("text").cast("binary").alias("text")), LEAST_TRIPLE)
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lm.n_tokens", "lm.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "lm.base_score", "lm.score", "lm.score2")
