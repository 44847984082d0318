"""The log as a stream: counters that grow with each event, quotas by day, and a sweep of the facts that a batch touched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.expressions import quota_epoch

OBSERVATION = "seq long, ts_ms long, fact string, actor string, outcome boolean, value string, confidence double, ctx map<string,string>"


def read(spark: SparkSession, path: str, schema: str = OBSERVATION, files: int = 16) -> DataFrame:
    """New files of a folder, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def running_counts(stream: DataFrame) -> DataFrame:
    """(fact, actor, n, k) so far. Late events have old timestamps but count as they come, so there is no watermark; state is one row a key."""
    return stream.where("outcome IS NOT NULL").groupBy("fact", "actor").agg(F.count("*").alias("n"), F.count_if("outcome").alias("k"))


def daily_quota(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """(actor, day, used) in event time; days are closed once the watermark has passed them."""
    t = stream.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return t.groupBy("actor", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("used")).select("actor", F.col("w.start").alias("day"), "used")


def over_quota(obs: DataFrame, most: int = 3000) -> DataFrame:
    return obs.groupBy("actor", quota_epoch("ts_ms").alias("epoch")).agg(F.count("*").alias("used")).where(F.col("used") > most)


def each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], once: bool = True):
    """Start a query that calls work for each batch. The checkpoint makes a batch repeat, never vanish, after a failure: work must be idempotent by batch number."""
    w = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def fold_and_sweep(stream: DataFrame, log: str, checkpoint: str, sweep: Callable[[DataFrame, DataFrame], DataFrame], out: str):
    """Append each batch to the log and sweep again only the facts that it touched; the report of batch n replaces what an earlier try of n wrote.

    A batch all of whose observations (by seq) are in the log already says nothing new: it is logged and not swept. What lies beyond the highest seq so far is news without a look at the log."""

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        logged = spark.read.parquet(log)
        earlier, mine = logged.where(F.col("batch") < number), logged.where(F.col("batch") == number)
        progress = earlier.agg(F.max("seq")).first()[0]
        news = mine if progress is None else mine.where(F.col("seq") > progress)
        if progress is not None and not news.head(1):
            news = mine.join(earlier.select("seq"), "seq", "left_anti")
        if news.head(1):
            every = logged.where(F.col("batch") <= number).drop("batch")
            sweep(every, mine.select("fact").distinct()).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each_batch(stream, checkpoint, work)
