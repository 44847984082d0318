"""Does a rate differ between groups? Statistics over group tallies (fact, key, val, n, k), all facts and keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import expressions as E
from attesta.functions.special import tarone_p_udf
from attesta.sources.shared import spread

MIN_SUPPORT = 8


def overdispersion(groups: DataFrame, by: list[str]) -> DataFrame:
    """by, groups, n, k, z: Tarone's statistic; null where undefined (one group, a rate of 0 or 1, groups of one)."""
    w = groups.where("n > 0").groupBy(*by).agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    p = F.col("tk") / F.col("tn")
    part = groups.where("n > 0").join(w, by).groupBy(*by).agg(F.count("*").alias("groups"), F.first("tn").alias("n"), F.first("tk").alias("k"), F.sum(F.pow(F.col("k") - F.col("n") * p, 2)).alias("ss"), F.sum(2 * F.col("n") * (F.col("n") - 1)).alias("spread"))
    rate = F.col("k") / F.col("n")
    ok = (F.col("groups") >= 2) & (rate > 0) & (rate < 1) & (F.col("spread") > 0)
    return part.withColumn("z", F.when(ok, (F.try_divide("ss", rate * (1 - rate)) - F.col("n")) / F.sqrt(F.col("spread")))).drop("ss", "spread")


def explained_fraction(groups: DataFrame, by: list[str]) -> DataFrame:
    """Share of the outcome's variance that the groups account for."""
    total = groups.where("n > 0").groupBy(*by).agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    p = F.col("tk") / F.col("tn")
    between = groups.where("n > 0").join(total, by).groupBy(*by).agg(F.first("tn").alias("tn"), F.first("tk").alias("tk"), F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2)).alias("b"))
    var = p * (1 - p)
    return between.select(*by, F.when(var > 0, F.try_divide(F.col("b") / F.col("tn"), var)).otherwise(0.0).alias("eta2"))


def mdl(groups: DataFrame, by: list[str]) -> DataFrame:
    """Code lengths with and without the split; accepted if the split pays for naming itself."""
    t = groups.groupBy(*by).agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(E.description_bits(F.col("n"), F.col("k"))).alias("dl_given"))
    out = t.select(*by, (2 + F.log2(F.greatest(F.lit(2), F.col("m")))).alias("dl_guard"), "dl_given", E.description_bits(F.col("n"), F.col("k")).alias("dl_residual"))
    return out.withColumn("accepted", F.col("dl_guard") + F.col("dl_given") < F.col("dl_residual"))


def pvalues(groups: DataFrame, by: list[str], bar: float | None = None) -> DataFrame:
    """by, z, p: with the simulated null beyond the screen. Only tallies reach Python, and only of groups that can be tested. With bar, a p above it may be any other above it."""
    z = overdispersion(groups, by).where("z IS NOT NULL").select(*by, "z")
    # in order of value: draws are made in the order of groups, so another order is another p
    listed = groups.where("n > 0").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("val", "n", "k"))).alias("g"))
    arrays = listed.select(*by, F.col("g.n").alias("ns"), F.col("g.k").alias("ks"))
    return spread(z.join(arrays, by), *by).withColumn("p", tarone_p_udf()("ns", "ks", F.lit(bar).cast("double"))).drop("ns", "ks")


def benjamini_hochberg(tests: DataFrame, family: list[str], order: list[str], alpha: float = 0.05) -> DataFrame:
    """tests with keep: the step-up rule within each family; ties in p by order."""
    w = Window.partitionBy(*family)
    ranked = tests.withColumn("_r", F.row_number().over(w.orderBy("p", *order))).withColumn("_m", F.count("*").over(w))
    cut = F.max(F.when(F.col("p") <= alpha * F.col("_r") / F.col("_m"), F.col("_r"))).over(w)
    return ranked.withColumn("keep", F.coalesce(F.col("_r") <= cut, F.lit(False))).drop("_r", "_m")


def breadth(values: DataFrame, floor: int = 3) -> DataFrame:
    """(fact, breadth, breadth_class): mean normalised entropy of keys with at least floor recorded values (fact, key, val)."""
    by = values.groupBy("fact", "key", "val").agg(F.count("*").alias("c"))
    total = by.groupBy("fact", "key").agg(F.sum("c").alias("n"), F.count("*").alias("m"), F.sum(F.col("c") * F.ln("c")).alias("s")).where(F.col("n") >= floor)
    h = F.when(F.col("m") > 1, (F.ln("n") - F.col("s") / F.col("n")) / F.ln("m")).otherwise(0.0)
    out = total.groupBy("fact").agg(F.avg(h).alias("breadth"))
    return values.select("fact").distinct().join(out, "fact", "left").select("fact", F.coalesce("breadth", F.lit(0.0)).alias("breadth")).withColumn("breadth_class", E.breadth_class("breadth"))
