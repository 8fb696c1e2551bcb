"""Texts far beyond a chunk of bytes, and columns with clashing names, through the operators that judge and score."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_ops import SCHEMA

from docspark.llm import lm_scoring, quality_classifier, quality_rules, sentencepiece_codec
from docspark.llm.queries import QUERIES
from docspark.llm.textops import CHUNK_BYTES


def words(seed, n):
    rng = random.Random(seed)
    return [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice(["x", "y", "é"]) + str(k % 977) for k in range(n)]


@pytest.fixture(scope="module")
def long_folder(put):
    long = " ".join(words(1, 260_000))
    assert len(long.encode()) > 1.5 * CHUNK_BYTES
    rows = [(1, "short text of a few words", "en", "s", 1, ""), (2, long, "en", "s", 1, ""), (3, long.upper(), "en", None, 1, ""), (4, None, None, "s", 0, ""), (5, "a b " * 40, "de", "t", 1, "")]
    f = put(rows, SCHEMA)
    put([(1, 1, 0), (2, 0, 0), (5, 0, 1)], "doc_id long, quality int, toxic int", "labels", f)
    return f


def by_id(spark, name, folder):
    return {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}


def test_rules_and_scores_of_long_texts(spark, long_folder):
    own = words(1, 260_000)
    rules = by_id(spark, "op4_quality_rules", long_folder)
    assert (rules[2].n_words, rules[2].word_chars, rules[2].n_repeat_words) == (260_000, sum(map(len, own)), rules[3].n_repeat_words)
    scores = by_id(spark, "op2_quality_classifier", long_folder)
    assert set(scores) == {1, 2, 3, 4, 5} and all(0 <= r.score <= 1 for r in scores.values())
    lm = by_id(spark, "op8_lm_scoring", long_folder)
    assert lm[2].n_tokens == lm[3].n_tokens == 260_001 and lm[4].n_tokens == 1 and all(r.score < 0 for r in lm.values())


def test_ids_and_counts_of_long_texts(spark, long_folder):
    pieces = QUERIES["op7_packing"](spark, long_folder).collect()
    for i in (2, 3):
        mine = sorted((r.start, r.length, r.doc_tokens) for r in pieces if r.doc_id == i)
        assert mine[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(mine, mine[1:])) and mine[-1][0] + mine[-1][1] == mine[-1][2]
    codes = by_id(spark, "op5_sentencepiece", long_folder)
    assert all(r.round_trip for r in codes.values()) and codes[2].n_ids > 260_000
    totals = {(r.source, r.lang, r.tokenizer): r for r in QUERIES["op1_token_counts"](spark, long_folder).collect()}
    assert totals["s", "en", "words-1"].n_tokens == 260_006 and totals[None, "en", "words-1"].n_docs == 1


def test_near_duplicates_of_long_texts(spark, long_folder):
    near = by_id(spark, "op9_minhash_dedup", long_folder)
    text = [w.lower() for w in words(1, 260_000)]
    assert near[2].n_shingles == len(set(zip(text, text[1:])))
    assert near[3].component_id in (2, 3) and near[1].component_id == 1


def test_clashing_columns(spark):
    rows = [(1, "some words here " * 30, "en"), (2, None, None), (3, "", "de"), (1, "some words here " * 30, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = docs.withColumns({"quality": F.lit("q"), "Score": F.lit("s"), "predicted": F.lit(7), "lm": F.lit(8), "f_": F.lit(9), "ids": F.lit(10), "a.b": F.lit(11), "lang_key": F.lit(12)})
    model = quality_classifier.train(docs.select(F.col("text").cast("binary")).toArrow().column(0).combine_chunks().fill_null(b""), __import__("numpy").array([1, 0, 0, 1]), quality_classifier.Training(epochs=1))
    texts = docs.filter("text is not null").select(F.col("text").cast("binary").alias("text"))
    language = lm_scoring.fit(texts)
    for run in (quality_rules.judge, lambda d: quality_classifier.score(d, model), lambda d: lm_scoring.score(d, language), sentencepiece_codec.encode):
        plain, clashing = run(docs), run(odd)
        added = [c for c in clashing.columns if c not in odd.columns]
        assert clashing.columns[: len(odd.columns)] == odd.columns and len(added) == len(plain.columns) - 3
        assert {tuple(r) for r in clashing.select("quality", "Score", "predicted", "lm", "f_", "ids", "`a.b`", "lang_key").collect()} == {("q", "s", 7, 8, 9, 10, 11, 12)}
        told = lambda df, new: sorted(hashlib.sha256(str((r[0], r[1], *(r[c] for c in new))).encode()).hexdigest() for r in df.collect())
        assert told(clashing, added) == told(plain, plain.columns[3:])
