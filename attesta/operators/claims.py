"""Claims and what surrounds a prediction: how a claim can be settled, whom a miss falls on, what a prediction rests on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import expressions as E
from attesta.operators import dispersion, series, tallies


def triage(claims: DataFrame, oracles: DataFrame, proved: DataFrame) -> DataFrame:
    """claims (claim, fact, criterion) with settlement, verifier and certainty; oracles (oracle, kind), proved (fact): what the closure holds.

    A registered oracle that is named outranks the closure, which outranks tools; everything else waits for observations.
    """
    c = claims.join(oracles.select(F.col("oracle").alias("criterion"), F.col("kind").alias("_kind")), "criterion", "left").join(proved.select("fact").distinct().withColumn("_proved", F.lit(True)), "fact", "left")
    crit, oracle = F.col("criterion"), F.col("_kind").isNotNull()
    refused = crit.isNull() | crit.isin("", "none", "unsettleable")
    tool = crit.startswith("tool:") | crit.startswith("verifier:")
    out = c.withColumn("settlement", F.when(refused, "unsettleable").when(oracle, "tool_decidable").when(F.col("_proved"), "entailed").when(tool, "tool_decidable").otherwise("observation_pending"))
    s = F.col("settlement")
    verifier = F.when(s == "entailed", "verifier:closure").when(s == "tool_decidable", crit).when(s == "observation_pending", F.concat(F.lit("verifier:observation("), crit, F.lit(")")))
    certain = (s == "entailed") | ((s == "tool_decidable") & F.coalesce(F.col("_kind") == "deterministic_total", F.lit(False)))
    return out.select(*claims.columns, "settlement", verifier.alias("verifier"), F.when(refused, None).when(certain, "certain").otherwise("estimated").alias("certainty"))


def settle(claims: DataFrame, resolutions: DataFrame) -> DataFrame:
    """claims with outcome and surprisal of the first resolution of each; a second one changes nothing."""
    first = resolutions.groupBy("claim").agg(F.min_by("outcome", "seq").alias("outcome"))
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p")))
    return claims.join(first, "claim", "left").withColumn("surprisal", F.when(F.col("outcome"), -F.ln(q)).when(~F.col("outcome"), -F.ln(1 - q)))


def blame(sensitivity: DataFrame, facts: DataFrame) -> DataFrame:
    """(claim, component): the eligible component (not definitional, not frozen, known) that the claim's p depends on most; ties by name."""
    known = facts.where("kind <> 'definitional' AND NOT frozen").select(F.col("fact").alias("component"))
    return sensitivity.join(known, "component", "left_semi").groupBy("claim").agg(F.min_by("component", F.struct(-F.col("s"), F.col("component"))).alias("component"))


def caveats(goals: DataFrame, facts: DataFrame, flaky: DataFrame, mixed: DataFrame) -> DataFrame:
    """(goal, caveats) from goals (goal, fact): facts (fact, flagged, breadth_class, source, n), flaky (fact, flaky), mixed (fact, regime_mixed)."""
    j = goals.join(facts, "fact", "left").join(flaky.select("fact", "flaky"), "fact", "left").join(mixed, "fact", "left")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = j.groupBy("goal").agg(any_("flagged").alias("under_specified"), any_(F.col("breadth_class") == "narrow").alias("narrow_breadth"), any_("flaky").alias("unstable"), any_("regime_mixed").alias("regime_mixed"), any_(F.coalesce("n", F.lit(0)) == 0).alias("no_observations"))
    twice = j.where("source IS NOT NULL").groupBy("goal", "source").agg(F.count_distinct("fact").alias("c")).where("c >= 2").select("goal").distinct().withColumn("shared_provenance", F.lit(True))
    names = ["under_specified", "narrow_breadth", "unstable", "regime_mixed", "no_observations", "shared_provenance"]
    per = per.join(twice, "goal", "left").fillna(False, ["shared_provenance"])
    return per.select("goal", F.array_compact(F.array(*[F.when(F.col(n), n) for n in names])).alias("caveats"))


def distribution(obs: DataFrame, report: DataFrame) -> DataFrame:
    """How a fact's outcomes split by each recorded key, and what share of the spread the admitted condition explains: (fact, key, val, n, p, conditioning_key, explained, unexplained)."""
    modes = tallies.context_breakdown(obs)
    eta = dispersion.explained_fraction(modes, ["fact", "key"])
    known = report.select("fact", F.col("key").alias("conditioning_key"), "flagged").join(eta.select("fact", F.col("key").alias("conditioning_key"), "eta2"), ["fact", "conditioning_key"], "left")
    known = known.select("fact", "conditioning_key", F.coalesce("eta2", F.lit(0.0)).alias("explained"), F.when(F.col("flagged"), 1 - F.coalesce("eta2", F.lit(0.0))).otherwise(0.0).alias("unexplained"))
    return modes.join(known, "fact", "left").select("fact", "key", "val", "n", (F.col("k") / F.col("n")).alias("p"), "conditioning_key", "explained", "unexplained")


def why(facts: DataFrame, counts: DataFrame, admissions: DataFrame) -> DataFrame:
    """One row a fact: who reported how often, and which candidate and source it was admitted from."""
    by = counts.groupBy("fact").agg(F.array_sort(F.collect_list(F.struct("actor", "n", "k"))).alias("reports"))
    return facts.select("fact").join(by, "fact", "left").join(admissions.select("fact", "candidate", "source"), "fact", "left")


def baselines(votes: DataFrame, conf: DataFrame) -> DataFrame:
    """(fact, mean_vote, one_coin, two_coin): vote averaging, votes weighted by accuracy, and add-one rates, to hold composition against."""
    n = F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")
    acc = (F.col("tp") + F.col("tn") + 1) / (n + 2)
    sens, fpr = (F.col("tp") + 1) / (F.col("tp") + F.col("fn") + 2), (F.col("fp") + 1) / (F.col("fp") + F.col("tn") + 2)
    lr1 = F.when(F.col("vote"), 1).otherwise(-1) * F.ln(acc / (1 - acc))
    lr2 = F.when(F.col("vote"), F.ln(sens / fpr)).otherwise(F.ln((1 - sens) / (1 - fpr)))
    sig = lambda x: 1 / (1 + F.exp(-x))
    return votes.join(conf, "actor").groupBy("fact").agg(F.avg(F.col("vote").cast("int")).alias("mean_vote"), sig(F.sum(lr1)).alias("one_coin"), sig(F.sum(lr2)).alias("two_coin"))


def current(facts: DataFrame, pins: DataFrame) -> DataFrame:
    """Facts in force: admitted, not closed, not pinned as false by their latest pin (pins: fact, seq, polarity, active)."""
    last = pins.withColumn("r", F.row_number().over(Window.partitionBy("fact").orderBy(F.desc("seq")))).where("r = 1 AND active AND polarity = '-'").select("fact")
    return facts.where("coalesce(structural, '') <> 'candidate' AND valid_to IS NULL").join(last, "fact", "left_anti")


def stability(obs: DataFrame) -> DataFrame:
    """(fact, flaky) of observations as votes."""
    v = obs.select("fact", "seq", "actor", "outcome", E.confidence_grade("confidence").alias("grade"), F.to_json("ctx").alias("sig"))
    return series.flaky(v).select("fact", "flaky")
