"""Token counts (1): rollups that signed deltas maintain.

The ledger is a folder in the shared store. A batch of changes (op, doc_id,
source, lang, text) is tokenized once and summed to one signed row for each
(source, lang, tokenizer): inserts add, deletes (with the text that goes) subtract,
a revision is a delete of the old text and an insert of the new one under one batch.
Totals are sums of deltas, so batches commute and nothing is ever recounted.

A batch is committed by writing its deltas under its name: a batch name that is
already there is skipped, and Spark's output committer puts the marker file last, so a
batch that failed half-way isn't seen and can be sent again. Sending a batch twice
changes nothing.

``compact`` sums all committed batches into a new base, whose table of batch names is
written last and makes it valid; then their folders go. Names stay known, so a replay
after a compaction still changes nothing, and a compaction that failed half-way is
ignored and can be run again.

Defined cases. Null or empty text: no tokens, one document. Null source or lang: a
group of its own. Repeated rows: each is a change of its own. An op other than
insert or delete raises an error. Groups whose documents and tokens come to 0 stay
in the ledger and are left out of totals. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, frames
from .textops import Words, sliced

KEYS = ("source", "lang", "tokenizer")
INSERT, DELETE = "insert", "delete"


def _counter(path: str):
    """Arrow UDF: tokens of each text, by byte-level BPE and by white space."""

    def run(text: pa.Array) -> pa.Array:
        pieces, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in sliced(text):
            pieces.append(bpe.encode(part, path)[1])
            words.append(Words(part).counts)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(pieces)), pa.array(np.concatenate(words))], names=["bpe", "words"])

    return F.arrow_udf(run, "struct<bpe: bigint, words: bigint>")


def deltas(changes: DataFrame, path: str, version: str) -> DataFrame:
    """Signed sums (source, lang, tokenizer, docs, tokens) of a batch; the rows are summed before they are shuffled."""
    op = F.lower("op")
    sign = F.when(op == INSERT, 1).when(op == DELETE, -1).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))).cast("int"))
    counted = changes.select("source", "lang", sign.alias("sign"), _counter(path)(F.col("text").cast("binary")).alias("n"))
    sums = counted.groupBy("source", "lang").agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("n.bpe")).alias("bpe"), F.sum(F.col("sign") * F.col("n.words")).alias("words"))
    both = F.explode(F.array(F.struct(F.lit(version).alias("tokenizer"), F.col("bpe").alias("tokens")), F.struct(F.lit("words-1").alias("tokenizer"), F.col("words").alias("tokens"))))
    return sums.select("source", "lang", both.alias("t"), "docs").select("source", "lang", "t.tokenizer", "docs", "t.tokens")


class Ledger:
    """Committed batches of deltas in one folder."""

    def __init__(self, spark: SparkSession, folder: str, path: str | None = None, version: str = "byte_bpe_50k-1"):
        self.spark, self.folder, self.path, self.version = spark, folder.rstrip("/"), path or bpe.default_path(), version
        frames.ship(spark)

    def _exists(self, uri: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _folders(self, kind: str, marker: str) -> list[str]:
        """Names of the committed folders of a kind; few, as compaction merges batches."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in store.listStatus(root)] if store.exists(root) else []
        return sorted(n for n in names if n.startswith(f"{kind}=") and self._exists(f"{self.folder}/{n}/{marker}"))

    def _base(self) -> str | None:
        """The latest valid base: bases are numbered."""
        bases = self._folders("base", "names/_SUCCESS")
        return f"{self.folder}/{max(bases, key=lambda n: int(n[5:]))}" if bases else None

    def _merged(self) -> DataFrame | None:
        base = self._base()
        return self.spark.read.parquet(f"{base}/names") if base else None

    def committed(self, batch: str) -> bool:
        if self._exists(f"{self.folder}/batch={batch}/_SUCCESS"):
            return True
        merged = self._merged()
        return merged is not None and not merged.filter(F.col("batch") == batch).isEmpty()

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before."""
        if self.committed(batch):
            return False
        deltas(changes, self.path, self.version).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def revise(self, batch: str, before: DataFrame, after: DataFrame) -> bool:
        """Commit replaced texts: both frames have (source, lang, text), before as it was committed and after as it is now."""
        columns = ("source", "lang", "text")
        return self.apply(batch, before.select(F.lit(DELETE).alias("op"), *columns).union(after.select(F.lit(INSERT).alias("op"), *columns)))

    def _batches(self) -> list[str]:
        """Committed batches that no base holds."""
        names = self._folders("batch", "_SUCCESS")
        merged = self._merged()
        if merged is None or not names:
            return names
        held = {r.batch for r in merged.filter(F.col("batch").isin([n[6:] for n in names])).collect()}  # of the folders listed
        return [n for n in names if n[6:] not in held]

    def _rows(self) -> DataFrame | None:
        """Deltas of the base and of the batches after it."""
        base = self._base()
        parts = ([f"{base}/deltas"] if base else []) + [f"{self.folder}/{b}" for b in self._batches()]
        return self.spark.read.parquet(*parts) if parts else None

    def compact(self) -> bool:
        """Sum all batches into a new base; False if there is none to sum."""
        batches, merged = self._batches(), self._merged()
        if not batches:
            return False
        numbers = [int(n[5:]) for n in self._folders("base", "names/_SUCCESS")]
        base = f"{self.folder}/base={max(numbers, default=0) + 1}"
        sums = self._rows().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{base}/deltas")
        names = self.spark.createDataFrame([(b[6:],) for b in batches], "batch string")
        (names if merged is None else merged.unionByName(names)).write.mode("overwrite").parquet(f"{base}/names")
        for b in batches:
            frames.delete(self.spark, f"{self.folder}/{b}")
        for n in numbers:
            frames.delete(self.spark, f"{self.folder}/base={n}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        rows = self._rows()
        if rows is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint")
        summed = rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return summed.filter("n_docs <> 0 or n_tokens <> 0")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load, its replay, a deletion of exact copies and its replay: the documents that differ, counted once."""
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    ledger = Ledger(spark, frames.new_folder(spark, "token-ledger"))
    load = docs.withColumn("op", F.lit(INSERT))
    ledger.apply("load", load)
    ledger.apply("load", load)
    prints = docs.select("doc_id", F.sha2("text", 256).alias("print"))
    # cut, so that the join back is a plain one, whose hot classes adaptive execution can split
    first = frames.cut(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("print", "first"))
    copies = prints.join(first, "print").filter("doc_id > first").select("doc_id").distinct()
    gone = docs.join(copies, "doc_id", "left_semi").withColumn("op", F.lit(DELETE))
    ledger.apply("copies", gone)
    ledger.apply("copies", gone)
    return ledger.totals()
