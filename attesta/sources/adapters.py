"""Plain tables as observations: (seq, ts_ms, fact, actor, outcome, value, confidence, ctx)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(scan: DataFrame) -> DataFrame:
    """A scan of several splits that are fewer than the cores (a file of one row group is work for one task), spread over all of them; larger tables stay where they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 1 < scan.rdd.getNumPartitions() < cores else scan


def _ms(ts: str):
    """Milliseconds of a timestamp without zone, read as UTC, rounded down."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("long")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each user; purchases and sign-ups are hits; context is a band of k and of value."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        _ms("ts").alias("ts_ms"),
        F.col("user_id").cast("string").alias("fact"),
        F.concat(F.lit("agent:"), (F.col("event_id") % 7).cast("string")).alias("actor"),
        F.col("event_type").isin("purchase", "signup").alias("outcome"),
        F.col("event_type").alias("value"),
        ((F.col("event_id") % 11) / 10.0).cast("double").alias("confidence"),
        F.create_map(F.lit("kbin"), F.floor(k / 25).cast("string"), F.lit("vbin"), F.when(F.col("value") < 5, "low").when(F.col("value") < 20, "mid").otherwise("high")).alias("ctx"),
    )


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each supplier; returned lines are hits. Lines have no arrival order of their own: seq only serves order-free tallies."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        _ms("l_shipdate").alias("ts_ms"),
        F.col("l_suppkey").cast("string").alias("fact"),
        F.concat(F.lit("tool:"), (F.col("l_orderkey") % 5).cast("string")).alias("actor"),
        (F.col("l_returnflag") == "R").alias("outcome"),
        F.col("l_returnflag").alias("value"),
        F.lit(None).cast("double").alias("confidence"),
        F.create_map(F.lit("status"), F.col("l_linestatus"), F.lit("qty"), F.floor(F.col("l_quantity") / 10).cast("int").cast("string")).alias("ctx"),
    )


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A categorical fact for each customer: the order's status."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        _ms("o_orderdate").alias("ts_ms"),
        F.col("o_custkey").cast("string").alias("fact"),
        F.concat(F.lit("agent:"), (F.col("o_orderkey") % 3).cast("string")).alias("actor"),
        F.lit(None).cast("boolean").alias("outcome"),
        F.col("o_orderstatus").alias("value"),
        F.lit(None).cast("double").alias("confidence"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("ctx"),
    )


def from_orders_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categorical facts, one for each 25th of the customers, in which a condition is at work: urgent orders are always finished, the others have their status."""
    o = table(spark, sf_dir, "orders")
    urgent = F.col("o_orderpriority").substr(1, 1).isin("1", "2")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        _ms("o_orderdate").alias("ts_ms"),
        (F.col("o_custkey") % 25).cast("string").alias("fact"),
        F.concat(F.lit("agent:"), (F.col("o_orderkey") % 3).cast("string")).alias("actor"),
        F.lit(None).cast("boolean").alias("outcome"),
        F.when(urgent, "F").otherwise(F.col("o_orderstatus")).alias("value"),
        F.lit(None).cast("double").alias("confidence"),
        F.create_map(F.lit("urgency"), F.when(urgent, "urgent").otherwise("normal"), F.lit("priority"), F.col("o_orderpriority")).alias("ctx"),
    )


def judges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reports, settlements): documents as claims, four simple judges that vote on each, and the quality label as the outcome of those with an odd id."""
    docs = table(spark, sf_dir, "documents")
    votes = {"length": F.col("n_chars") >= 600, "language": F.col("lang") == "en", "shape": ~F.col("text").rlike(r"!!|\*\*\*|###|\|"), "yes": F.lit(True)}
    cells = [F.struct(F.lit(f"verifier:{k}").alias("actor"), F.coalesce(v, F.lit(False)).alias("outcome"), F.lit(i).alias("i")) for i, (k, v) in enumerate(votes.items())]
    reports = docs.select("doc_id", F.explode(F.array(*cells)).alias("v")).select(
        (F.col("doc_id") * 10 + F.col("v.i")).alias("seq"), F.col("doc_id").cast("string").alias("fact"), "v.actor", "v.outcome", F.lit(0).alias("grade"), F.lit(None).cast("string").alias("sig"), F.lit(None).cast("string").alias("value"))
    labels = table(spark, sf_dir, "labels").where("doc_id % 2 = 1")
    settled = labels.select((F.col("doc_id") * 10 + 9).alias("seq"), F.col("doc_id").cast("string").alias("fact"), (F.col("quality") == 1).alias("outcome"), F.lit(None).cast("string").alias("value"))
    return reports, settled
