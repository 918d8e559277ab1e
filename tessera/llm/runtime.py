"""Shared helpers: checkpoints in the cluster's shared folder and Arrow batch walking."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that one step of a Python operator turns into Python objects at once.
SLICE_ROWS = 512
#: Rows of a checkpoint's file, about, where their number is known.
FILE_ROWS = 1 << 12


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``. Only a local session may do without: a folder of this machine would be lost to a cluster's executors."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoints-"))


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, which outlives executors.

    ``rows`` says how many rows there are, about: few rows then are few files, however many partitions they come in.
    Each file costs its executor calls to the store; on a local disk without Hadoop's native library these are child
    processes, which for a moment count as much memory as the executor itself.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that decoded texts stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
