"""Where loops cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where none need be set."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(folder)


def keep(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read back: computed once, its lineage cut."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """df as one side of a join that sorts both by key, so that neither is sent whole to the driver and from there to all.

    For sides that grow with the files or links: the planner takes the size of a side from
    that of its table, where exploded keys and made-up paths don't show.
    """
    return df.hint("merge")
