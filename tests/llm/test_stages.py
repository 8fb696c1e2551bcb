"""Pipeline stages: odd columns, empty tables, repeated ids, and what each stage keeps."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_ops import SCHEMA, corpus

import corpus_pipeline
from docspark.llm import line_dedup, minhash_dedup, packing, quality_rules, substring_dedup

STAGES = dict(corpus_pipeline.STAGES)
FILTERS = ["quality_rules", "line_dedup", "minhash_dedup", "substring_dedup"]


@pytest.mark.parametrize("name", FILTERS)
def test_columns_with_odd_names(spark, name):
    docs = spark.createDataFrame(corpus(n=40), SCHEMA)
    odd = docs.withColumn("a.b", F.lit(1)).withColumn("Parsed", F.lit("p")).withColumn("gone_", F.lit(2)).withColumn("c`d", F.lit(3)).withColumn("id_", F.lit(4)).withColumn("bytes_", F.lit(5))
    out = STAGES[name](spark, odd, "")
    plain = STAGES[name](spark, docs, "")
    assert out.columns == odd.columns and plain.columns == docs.columns
    assert sorted(out.select("doc_id", "text").collect(), key=str) == sorted(plain.select("doc_id", "text").collect(), key=str)
    assert {tuple(r) for r in out.select("`a.b`", "Parsed", "gone_", "`c``d`", "id_", "bytes_").collect()} == {(1, "p", 2, 3, 4, 5)}


def test_empty_table(spark, put):
    assert corpus_pipeline.run(spark, put([], SCHEMA)).count() == 0


def test_stages_do_what_their_operators_say(spark, put):
    rows = corpus(seed=9, n=120)
    rows += [(r[0], r[1], *r[2:]) for r in rows[:3]] + [(rows[4][0], "another text of the same id " * 3, *rows[4][2:])]
    folder = put(rows, SCHEMA)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    digest = lambda text: hashlib.sha256(b" ".join((text or "").encode().split())).hexdigest()
    pairs = lambda df: sorted((str(r.doc_id), digest(r.text)) for r in df.select("doc_id", "text").collect())
    for name in FILTERS:
        after = STAGES[name](spark, docs, folder)
        if name == "quality_rules":
            want = pairs(quality_rules.judge(docs).filter("quality.kept"))
        elif name == "line_dedup":
            want = pairs(line_dedup.drop_recurring(docs).select("doc_id", F.col("lines.text").cast("string").alias("text")))
        elif name == "minhash_dedup":
            kept = {r.doc_id for r in minhash_dedup.near_duplicates(docs.select("doc_id", "text")).filter("kept").collect()}
            want = sorted((str(r.doc_id), digest(r.text)) for r in docs.collect() if r.doc_id in kept)
        else:
            want = sorted((str(r.doc_id), r.kept_sha256) for r in substring_dedup.parse(docs).select("doc_id", "parsed.kept_sha256").collect())
        assert pairs(after) == want, name
        assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in after.collect()) or name in ("quality_rules", "minhash_dedup")
        path = f"{folder}/after-{name}"
        after.write.parquet(path)
        docs = spark.read.parquet(path)
    last = sorted(map(str, packing.pack(docs.select("doc_id", "text")).select("doc_id", "start", "length", "ids_crc32").collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())) == last and last
