"""Sessions, and how this package reaches Python workers."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch: whole texts make it large, in the JVM and in each Python worker.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; on a cluster use the cluster's own."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="docspark-")
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(f"{folder}/{root.name}.zip")
    _shipped.add(context.applicationId)


def number(setting: str) -> int:
    """A setting as a number, of bytes if it has a unit (16m, 64MB)."""
    digits, unit = re.fullmatch(r"(-?\d+)([bkmgtp]?)b?", setting.strip().lower()).groups()
    return int(digits) << 10 * "bkmgtp".index(unit or "b")


def bound_batches(spark: SparkSession) -> None:
    """Hold what a Python worker gets at once to ARROW_ROWS and ARROW_BYTES.

    The settings are the session's and stay, since frames are worked off after this call; smaller ones are left as they are.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if not 0 < number(spark.conf.get(key)) <= most:
            spark.conf.set(key, most)
