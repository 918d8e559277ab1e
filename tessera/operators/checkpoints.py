"""Cutting lineage in the cluster's shared folder, and places in an order without a task that sees all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``. Only a local session may do without: a folder of this machine would be lost to a cluster's executors."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoints-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared checkpoint folder and read from there, for loops: a checkpoint hands the
    constraints of its plan on to the next, and those of many rounds take the optimiser longer than the rounds."""
    spark = df.sparkSession
    folder = scratch(spark, "table")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def deleted(spark: SparkSession, folder: str) -> None:
    """Takes away a folder of :func:`scratch` that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def placed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``place`` from 1 in the order of ``key``, by ranges: each range is numbered alone, after the rows of the ranges before it."""
    ranged = checkpointed(rows.repartitionByRange(key).withColumn("__p", F.spark_partition_id()))
    starts, before = [], 0
    for r in ranged.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect():
        starts.append((r["__p"], before))
        before += r["n"]
    first = rows.sparkSession.createDataFrame(starts, "__p int, __before long")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(key))
    return ranged.withColumn("__n", own).join(F.broadcast(first), "__p").withColumn("place", F.col("__n") + F.col("__before")).drop("__p", "__n", "__before")
