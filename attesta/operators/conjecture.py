"""Analogy between predicates: signatures of how they take part in rules, cosine neighbours, proposals through a neighbour's known atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR, NEIGHBOURS = 2, 16


def signatures(firings: DataFrame, co_derived: DataFrame | None = None) -> DataFrame:
    """(symbol, feature, w): firings (rule, position, symbol), co_derived (symbol, other)."""
    out = firings.select("symbol", F.concat_ws(":", F.lit("r"), "rule", F.col("position").cast("string")).alias("feature"))
    if co_derived is not None:
        out = out.unionByName(co_derived.select("symbol", F.concat(F.lit("c:"), "other").alias("feature")))
    return out.groupBy("symbol", "feature").agg(F.count("*").cast("double").alias("w"))


def neighbours(sig: DataFrame, targets: DataFrame | None, least: float, limit: int = NEIGHBOURS) -> DataFrame:
    """(symbol, other, sim) at or above least, the limit nearest; symbols with fewer than FLOOR features have none. A join on features: only pairs that share one meet."""
    norm = sig.groupBy("symbol").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count("*").alias("m")).where(F.col("m") >= FLOOR).drop("m")
    own = sig.join(norm, "symbol")
    left = own if targets is None else own.join(targets.select("symbol").distinct(), "symbol", "left_semi")
    right = own.select(F.col("symbol").alias("other"), "feature", F.col("w").alias("w2"), F.col("norm").alias("norm2"))
    dot = left.join(right, "feature").where("symbol <> other").groupBy("symbol", "other").agg(F.sum(F.col("w") * F.col("w2")).alias("dot"), F.first("norm").alias("a"), F.first("norm2").alias("b"))
    sim = dot.select("symbol", "other", (F.col("dot") / (F.col("a") * F.col("b"))).alias("sim")).where(F.col("sim") >= least)
    w = Window.partitionBy("symbol").orderBy(F.desc("sim"), "other")
    return sim.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")


def conjectures(goals: DataFrame, near: DataFrame, atoms: DataFrame) -> DataFrame:
    """(pred, args, via, sim, quality): goals (pred, args) that a neighbour's atom with the same arguments suggests."""
    via = atoms.select(F.col("pred").alias("via"), "args").distinct()
    return goals.join(near.select(F.col("symbol").alias("pred"), F.col("other").alias("via"), "sim"), "pred").join(via, ["via", "args"]).select("pred", "args", "via", "sim", F.lit("conjecture").alias("quality"))
