"""The folder that all executors share, and lineage cuts in it."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local run gets a folder of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file:///tmp/attesta-{os.getuid()}-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what came before isn't computed again, whichever executor goes, and later plans prune its columns."""
    path = f"{shared_dir(df.sparkSession)}/attesta/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df over as many partitions as the session shuffles into, which small but costly rows keep (others are put together at run time).

    Rows go by a hash of the columns: where df already lies by the columns themselves, a shuffle by them would be left out and the partitions put together after all."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *([F.xxhash64(*columns)] if columns else []))
