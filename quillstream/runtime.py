"""Session helpers: shipping this package to Python workers and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Upper bound on one Arrow batch handed to a Python worker; long texts then make batches shorter, not larger.
ARROW_BATCH_BYTES = 32 << 20

#: Lets a plan's shuffle files go when it has run: what was materialised doesn't need them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = threading.Lock()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors (once per application) and bound Arrow batches by bytes."""
    sc = spark.sparkContext
    with _lock:
        if sc.applicationId not in _shipped:
            root = Path(__file__).resolve().parent
            out = Path(tempfile.mkdtemp(prefix="quillstream-")) / f"{root.name}.zip"
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, p.relative_to(root.parent))
            sc.addPyFile(str(out))
            _shipped.add(sc.applicationId)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key).rstrip("b")) > ARROW_BATCH_BYTES:
            spark.conf.set(key, str(ARROW_BATCH_BYTES))
    except Exception:  # noqa: BLE001  a Spark without this setting keeps its own batches
        pass
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, if it comes in fewer partitions than there are; else as it is.

    For work that takes far longer than moving its rows. Large inputs have more partitions than cores and don't move, nor do
    streams.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of rows whose sizes sum to at most `most`, a row at least."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")), at + 1)
        yield at, stop - at
        at = stop


def pieces(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded size, so that what is made of them doesn't grow with the batch."""
    return (batch.slice(at, n) for at, n in cut(sizes, most))


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether no id is there twice; null counts as one. Moves ids only."""
    return df.groupBy(id_col).count().where("count > 1").isEmpty()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise df in the reliable checkpoint folder.

    The folder is the cluster's spark.checkpoint.dir; where none is set (tests, notebooks) a temporary one is made.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or os.path.join(tempfile.gettempdir(), "quillstream-checkpoints"))
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # read when a plan is made, hence the select
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
