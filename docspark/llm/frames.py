"""Small helpers that the operators share: tables, free column names, checkpoints."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch: whole texts make it large, in the JVM and in each Python worker.
ARROW_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application; hold Arrow batches of texts to ARROW_ROWS.

    The setting is the session's and stays, since frames are worked off after this call; a smaller one is left as it is.
    """
    if int(spark.conf.get(_ROWS)) > ARROW_ROWS:
        spark.conf.set(_ROWS, ARROW_ROWS)
    session.ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have, in any case of letters."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name


def quoted(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


def same_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in its order; names may hold dots."""
    return df.select(*(quoted(df, c) for c in like.columns))


def with_length(df: DataFrame) -> DataFrame:
    """n_chars, if there is such a column, set to the length of the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in df.columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all runs in one process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "docspark-checkpoints")
        os.makedirs(path[7:], exist_ok=True)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: ends the lineage, survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, stem: str) -> str:
    """A new folder for a run's own files in the shared folder; it goes when the driver's JVM ends."""
    uri = f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return uri


def delete(spark: SparkSession, uri: str) -> None:
    """Remove a run's own files that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are out of use: it does so in the background, once the driver's garbage is collected."""
    for _ in range(2):  # what Python lets go in the first round is garbage of the JVM's in the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def unsigned_crc32(doc_id: Column) -> Column:
    """crc32 of the id written as text; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary"))
