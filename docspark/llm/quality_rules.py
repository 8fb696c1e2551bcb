"""Quality rules (4): divergence of a document's histograms from its language's reference.

For each document two histograms are taken over the whole text: bytes by
character class, and words by membership in a fixed list of common words. The
reference of a language is the mean of the histograms of all its documents. A
document is kept if it passes the base rules and both Jensen-Shannon distances
(square root of the divergence in bits, 0 to 1) stay within their limits.

Defined cases. Null or empty text: no words, base_failed. Null lang: compared to
the reference over documents without a language. Repeated rows: judged alike,
each contributes to the reference. Under ``min_chars`` code points in words the
character test and under ``min_words`` words the word test is not applied. An empty table gives
an empty result. Other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .textops import U64, Words, hash_spans, mix64, per_doc, repeated, sliced

# The most common short words of four languages.
COMMON_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which "
    "der die das und ist nicht ein eine zu den mit von auf für sich dem des im auch als "
    "le la les et est une des que qui dans pour pas sur au plus par ce il elle ne "
    "el los las y es en un una que por con no para su lo del se al como más"
)
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "blank", "newline", "symbol", "stop", "other", "control", "beyond_ascii")


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; distances are Jensen-Shannon distances in [0, 1].

    A limit is distance + noise / sqrt(n_words): a short text strays from its
    language's reference by chance, by an amount that falls with the root of its length.
    """

    least_words: int = 50
    most_repeat_percent: int = 50
    char_distance: float = 0.20
    char_noise: float = 0.5
    word_distance: float = 0.15
    word_noise: float = 1.4
    min_chars: int = 200
    min_words: int = 100


def _class_table() -> np.ndarray:
    kind = np.full(256, CLASSES.index("other"), dtype=np.int64)
    kind[:32] = kind[127] = CLASSES.index("control")
    kind[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    kind[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    kind[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    kind[[0x20, 9]] = CLASSES.index("blank")
    kind[[10, 11, 12, 13]] = CLASSES.index("newline")
    kind[list(SYMBOLS.encode())] = CLASSES.index("symbol")
    kind[list(b".,;:!?'\"()-")] = CLASSES.index("stop")
    kind[128:] = CLASSES.index("beyond_ascii")
    return kind


_CLASS = _class_table()
_COMMON = sorted({w for w in COMMON_WORDS.split()})
_LONGEST = max(len(w.encode()) for w in _COMMON)
_COMMON_HASH = hash_spans(np.frombuffer("".join(_COMMON).encode(), np.uint8), np.array([len(w.encode()) for w in _COMMON]))
_BY_HASH = np.argsort(_COMMON_HASH)
N_COMMON = len(_COMMON) + 1


def histograms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by class and words by common word (last: none of them), a row for each document."""
    n = words.n_docs
    at = np.repeat(np.arange(n) * len(CLASSES), np.diff(words.offsets))
    by_class = np.bincount(at + _CLASS[words.raw], minlength=n * len(CLASSES)).reshape(n, -1)
    lengths, doc = words.ends - words.starts, words.doc
    short = np.flatnonzero(lengths <= _LONGEST)
    spans = lengths[short]
    where = np.repeat(words.starts[short] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
    found = hash_spans(words.data[where], spans)
    slot = np.minimum(np.searchsorted(_COMMON_HASH[_BY_HASH], found), len(_COMMON) - 1)
    word = _BY_HASH[slot]
    hit = _COMMON_HASH[word] == found
    common = np.bincount(doc[short[hit]] * N_COMMON + word[hit], minlength=n * N_COMMON).reshape(n, -1)
    common[:, -1] = words.counts - common.sum(1)
    return by_class, common


def base_counts(column: pa.Array, words: Words) -> dict[str, np.ndarray]:
    n, raw = words.n_docs, words.raw
    byte_doc = np.repeat(np.arange(n), np.diff(words.offsets))
    char = words._word & ((raw & 0xC0) != 0x80)
    symbol = np.isin(raw, np.frombuffer(SYMBOLS.encode(), np.uint8))
    out = {"n_words": words.counts, "word_chars": per_doc(byte_doc[char], n), "n_symbols": per_doc(byte_doc[symbol], n)}
    # lines: from a document's start or after \n, up to the next \n or the document's end
    newline = np.flatnonzero(raw == 10)
    filled = np.flatnonzero(np.diff(words.offsets) > 0)
    begin = np.sort(np.concatenate([words.offsets[:-1][filled], newline + 1]))
    begin = np.unique(begin[begin < len(raw)])
    if len(begin):
        stop = np.append(begin[1:], len(raw))
        content = raw.copy()
        lengths = stop - begin - (content[stop - 1] == 10)
        some = lengths > 0
        begin, lengths = begin[some], lengths[some]
        where = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        line = hash_spans(content[where], lengths)
        doc = np.searchsorted(words.offsets, begin, side="right") - 1
        has_word = np.searchsorted(words.starts, begin + lengths) > np.searchsorted(words.starts, begin)
        line, doc = line[has_word], doc[has_word]
        key = line ^ mix64(doc.astype(U64) + U64(1))
        first = np.unique(key, return_index=True)[1]
        out["n_dup_lines"] = per_doc(doc, n) - per_doc(doc[first], n)
    else:
        out["n_dup_lines"] = np.zeros(n, np.int64)
    rolled, index = words.windows(words.hashes(), 3)
    doc = words.doc
    twice = index[repeated(rolled ^ mix64(doc[index].astype(U64) + U64(1)))]
    covered = np.zeros(len(doc), bool)
    for j in range(3):
        covered[twice + j] = True
    out["n_repeat_words"] = per_doc(doc[covered], n)
    return out


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FEATURES = pa.struct([*(pa.field(c, pa.int64()) for c in _BASE), pa.field("classes", pa.list_(pa.float64())), pa.field("common", pa.list_(pa.float64()))])


def _shares(counts: np.ndarray) -> pa.Array:
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * counts.shape[1]), pa.array((counts / total).ravel()))


_FEATURES_DDL = f"struct<{','.join(f'{c}: bigint' for c in _BASE)}, classes: array<double>, common: array<double>>"


def document_features(text: pa.Array) -> pa.Array:
    out = []
    for part in sliced(text):
        words = Words(part)
        counts = base_counts(part, words)
        by_class, common = histograms(words)
        out.append(pa.StructArray.from_arrays([*(pa.array(counts[c].astype(np.int64)) for c in _BASE), _shares(by_class), _shares(common)], fields=list(_FEATURES)))
    return pa.concat_arrays(out) if out else pa.array([], _FEATURES)


def _partial_sums(batches):
    """Sums of the histograms' shares by language, a few rows for each batch."""
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        langs = [*lang.dictionary.to_pylist(), None]
        code = lang.indices.fill_null(len(langs) - 1).to_numpy(zero_copy_only=False)
        sums, seen = np.zeros((len(langs), len(CLASSES) + N_COMMON)), np.zeros(len(langs), bool)
        for part, start in _with_start(batch.column(1)):
            by_class, common = histograms(Words(part))
            both = np.hstack([x / np.maximum(x.sum(1, keepdims=True), 1) for x in (by_class, common)])
            full = by_class.sum(1) > 0
            own = code[start : start + len(part)][full]
            np.add.at(sums, own, both[full])
            seen[own] = True
        some = np.flatnonzero(seen)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array([langs[k] for k in some], pa.string()), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["lang", "sums"])


def _with_start(column: pa.Array):
    start = 0
    for part in sliced(column):
        yield part, start
        start += len(part)


def references(docs: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common): the mean histograms of each language over all its documents."""
    width = len(CLASSES) + N_COMMON
    parts = docs.select(docs.lang.cast("string").alias("lang"), docs.text.cast("binary").alias("text")).mapInArrow(_partial_sums, "lang string, sums array<double>")
    total = parts.groupBy("lang").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))

    def shares(lo: int, hi: int) -> Column:
        whole = sum((F.col(f"s{i}") for i in range(lo + 1, hi)), F.col(f"s{lo}"))
        return F.array(*(F.col(f"s{i}") / whole for i in range(lo, hi)))

    return total.select("lang", shares(0, len(CLASSES)).alias("ref_classes"), shares(len(CLASSES), width).alias("ref_common"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; 1 where one is missing."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    halves = F.zip_with(p, q, lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    distance = F.sqrt(F.greatest(F.aggregate(halves, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))
    return F.when(p.isNull() | q.isNull(), 1.0).otherwise(distance)


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with a struct column ``quality`` (or a free name like it): the base counts, both distances, base_failed and kept.

    The references are one row for each language that occurs; they join back by
    language, and Spark broadcasts them as long as they are small.
    """
    name = frames.free_name(docs, "quality")
    f, lang = frames.free_name(docs, "f_"), frames.free_name(docs, "lang_key")
    refs = references(docs).select(F.col("lang").alias(lang), F.struct("ref_classes", "ref_common").alias(f + "r"))
    scored = docs.withColumn(f, F.arrow_udf(document_features, _FEATURES_DDL)(docs.text.cast("binary")))
    joined = scored.join(refs, docs.lang.cast("string").eqNullSafe(refs[lang]), "left")
    x, r = F.col(f), F.col(f + "r")
    base = (x.n_words < rules.least_words) | (100 * x.n_repeat_words > rules.most_repeat_percent * x.n_words)
    chars = jensen_shannon(x.classes, r.ref_classes)
    common = jensen_shannon(x.common, r.ref_common)
    limit = lambda base_limit, noise: base_limit + noise / F.sqrt(F.greatest(x.n_words, F.lit(1)).cast("double"))
    far = ((x.word_chars >= rules.min_chars) & (F.col(f + "d").chars > limit(rules.char_distance, rules.char_noise))) | ((x.n_words >= rules.min_words) & (F.col(f + "d").words > limit(rules.word_distance, rules.word_noise)))
    joined = joined.withColumn(f + "d", F.struct(chars.alias("chars"), common.alias("words")))
    verdict = F.struct(*(x[c].alias(c) for c in _BASE), F.col(f + "d").chars.alias("char_distance"), F.col(f + "d").words.alias("word_distance"), base.alias("base_failed"), (~base & ~far).alias("kept"))
    return joined.select(*(frames.quoted(docs, c) for c in docs.columns), verdict.alias(name))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judge(docs).select("doc_id", "quality.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their own columns."""
    frames.ship(spark)
    name = frames.free_name(docs, "quality")
    return judge(docs).filter(F.col(name).kept).drop(name)
