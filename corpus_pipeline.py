"""Corpus pipeline: quality rules, line dedup, MinHash near-dedup, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import frames
from docspark.llm.line_dedup import line_dedup_stage
from docspark.llm.minhash_dedup import near_dedup_stage
from docspark.llm.packing import packing_stage
from docspark.llm.quality_rules import quality_stage
from docspark.llm.substring_dedup import substring_dedup_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = frames.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{frames.new_folder(spark, f'pipeline-{name}')}/docs"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express BPE token ids or the sketches; the stages are tested against brute force.
ORACLE_SQL = None
