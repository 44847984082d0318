"""Integer tallies of observations, and what is composed from them on reading.

Observations are rows (seq, ts_ms, fact, actor, outcome, value, confidence, ctx map). Counts stay integers; weights are applied when they are read. All are
commutative counters, so each is one partial aggregation and one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import expressions as E
from attesta.functions.special import beta_quantile_udf

RESIDUAL = "__residual__"


def fact_counts(obs: DataFrame, channel: str = "alea", frozen: DataFrame | None = None, admitted: DataFrame | None = None) -> DataFrame:
    """(fact, actor, channel, n, k). Facts in frozen don't count; admitted (fact, proposer) have a row of their proposer even without observations."""
    if frozen is not None:
        obs = obs.join(frozen.select("fact").distinct(), "fact", "left_anti")
    out = obs.where("outcome IS NOT NULL").groupBy("fact", "actor").agg(F.count("*").alias("n"), F.count_if("outcome").alias("k"))
    if admitted is not None:
        none = F.lit(0).cast("long")
        out = out.unionByName(admitted.select("fact", F.col("proposer").alias("actor"), none.alias("n"), none.alias("k"))).groupBy("fact", "actor").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    return out.select("fact", "actor", F.lit(channel).alias("channel"), "n", "k")


def category_counts(obs: DataFrame) -> DataFrame:
    return obs.where("value IS NOT NULL").groupBy("fact", "actor", "value").agg(F.count("*").alias("n"))


def context_diversity(obs: DataFrame) -> DataFrame:
    """Distinct values of every context key of every fact."""
    return obs.select("fact", F.explode("ctx").alias("key", "val")).groupBy("fact", "key").agg(F.count_distinct("val").alias("n_values"))


def quota_usage(obs: DataFrame) -> DataFrame:
    return obs.groupBy("actor", E.quota_epoch("ts_ms").alias("epoch")).agg(F.count("*").alias("used"))


def alias_counts(counts: DataFrame, members: DataFrame) -> DataFrame:
    """Raw counts over alias components: members (fact, component)."""
    joined = counts.join(members, "fact", "left").withColumn("fact", F.coalesce("component", "fact"))
    return joined.groupBy("fact", "actor", "channel").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def compose(counts: DataFrame, reliability: DataFrame) -> DataFrame:
    """Reliability-weighted counts by channel: (fact, epi_a, epi_b, alea_n, alea_k). Sources without a row have the prior mean."""
    rel = F.coalesce("reliability", F.lit(E.RELIABILITY_PRIOR[0] / sum(E.RELIABILITY_PRIOR)))
    epi = F.col("channel") == "epi"
    part = lambda on, x: F.sum(F.when(on, rel * x).otherwise(0.0))
    return (
        counts.join(reliability.select("actor", "reliability"), "actor", "left")
        .groupBy("fact")
        .agg(part(epi, F.col("k")).alias("epi_a"), part(epi, F.col("n") - F.col("k")).alias("epi_b"), part(~epi, F.col("n")).alias("alea_n"), part(~epi, F.col("k")).alias("alea_k"))
    )


def context_breakdown(obs: DataFrame) -> DataFrame:
    """(fact, key, val, n, k) with a residual group for observations that didn't record a key which the fact has."""
    base = obs.where("outcome IS NOT NULL").withColumn("hit", F.col("outcome").cast("int"))
    total = base.groupBy("fact").agg(F.count("*").alias("tn"), F.sum("hit").alias("tk"))
    groups = base.select("fact", "hit", F.explode("ctx").alias("key", "val")).groupBy("fact", "key", "val").agg(F.count("*").alias("n"), F.sum("hit").alias("k"))
    seen = groups.groupBy("fact", "key").agg(F.sum("n").alias("sn"), F.sum("k").alias("sk"))
    rest = seen.join(total, "fact").where("tn > sn").select("fact", "key", F.lit(RESIDUAL).alias("val"), (F.col("tn") - F.col("sn")).alias("n"), (F.col("tk") - F.col("sk")).alias("k"))
    return groups.unionByName(rest)


def few_keys(obs: DataFrame, most_keys: int = 4) -> DataFrame:
    """Facts that record at most most_keys context keys."""
    return obs.select("fact", F.explode(F.map_keys("ctx")).alias("k")).groupBy("fact").agg(F.count_distinct("k").alias("m")).where(F.col("m") <= most_keys).select("fact")


def pairs(ctx: str) -> Column:
    """(key, val) of all pairs of context keys."""
    entry = F.array_sort(F.map_entries(ctx))
    return F.flatten(F.transform(entry, lambda a: F.transform(F.filter(entry, lambda b: b["key"] > a["key"]), lambda b: F.struct(F.concat(F.lit("derived:"), a["key"], F.lit("x"), b["key"]).alias("key"), F.concat_ws("|", a["value"], b["value"]).alias("val")))))


def interactions(obs: DataFrame, most_keys: int = 4) -> DataFrame:
    """(fact, seq, key, val) of pairs of context keys, for facts that record at most most_keys keys."""
    return obs.join(few_keys(obs, most_keys), "fact", "left_semi").select("fact", "seq", F.explode(pairs("ctx")).alias("p")).select("fact", "seq", "p.key", "p.val")


def open_vocabulary(counts: DataFrame, alpha: float = 1.0, weights: DataFrame | None = None, interval: bool = True) -> DataFrame:
    """Predictive of an open vocabulary: p = n / (N + alpha) for each value and the rest for a value never seen.

    counts (fact, actor, value, n); weights (actor, value, weight) discount reports. The unseen value is the row with is_unknown.
    """
    if weights is not None:
        counts = counts.join(weights, ["actor", "value"], "left").withColumn("n", F.col("n") * F.coalesce("weight", F.lit(1.0)))
    by = counts.groupBy("fact", "value").agg(F.sum(F.col("n").cast("double")).alias("n")).where("n > 0")
    total = by.groupBy("fact").agg(F.sum("n").alias("total"))
    seen = by.join(total, "fact").select("fact", "value", F.lit(False).alias("is_unknown"), F.col("n").alias("a"), (F.col("total") + alpha - F.col("n")).alias("b"))
    rest = total.select("fact", F.lit(None).cast("string").alias("value"), F.lit(True).alias("is_unknown"), F.lit(alpha).alias("a"), F.col("total").alias("b"))
    out = seen.unionByName(rest).withColumn("p", F.col("a") / (F.col("a") + F.col("b")))
    if interval:
        q = beta_quantile_udf()
        out = out.withColumn("ci_lo", q(F.lit(0.05), "a", "b")).withColumn("ci_hi", q(F.lit(0.95), "a", "b"))
    return out.drop("a", "b")


def regime_mixed(obs: DataFrame) -> DataFrame:
    """Facts whose observations mix interventions: a do: key with two values or more, or on only some observations."""
    n = obs.groupBy("fact").agg(F.count("*").alias("n"))
    by = obs.select("fact", F.explode("ctx").alias("key", "val")).where(F.col("key").startswith("do:")).groupBy("fact", "key").agg(F.count_distinct("val").alias("v"), F.count("*").alias("m"))
    mixed = by.join(n, "fact").groupBy("fact").agg(F.bool_or((F.col("v") >= 2) | (F.col("m") < F.col("n"))).alias("regime_mixed"))
    return n.select("fact").join(mixed, "fact", "left").select("fact", F.coalesce("regime_mixed", F.lit(False)).alias("regime_mixed"))


def shared_sources(admissions: DataFrame) -> DataFrame:
    """Sources behind two facts or more: admissions (fact, source)."""
    return admissions.where("source IS NOT NULL").groupBy("source").agg(F.count_distinct("fact").alias("facts")).where("facts >= 2")
