"""Source trust learned from settled claims: who said what before an outcome was known, and how often it held.

reports: (seq, fact, actor, outcome, value, grade); settlements: (seq, fact, outcome, value). A report is scored against every later settlement of its fact; a fact
with a third of all reports is split by the join as each side of it is only filtered, and counted by a partial aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import expressions as E

GRADES, RESPONSE_ALPHA, MIN_SCORED, GAMMA = 4, 0.5, 10, 0.5
PRIOR_LOG_LR = math.log(E.SENS_PRIOR[0] / E.FPR_PRIOR[0])


def scored(reports: DataFrame, settlements: DataFrame) -> DataFrame:
    """One row for each report and later settlement of its fact: actor, vote, grade, truth, settled_seq."""
    s = settlements.select("fact", F.col("seq").alias("settled_seq"), F.col("outcome").alias("truth"))
    return reports.join(s, "fact").where("seq < settled_seq AND outcome IS NOT NULL").select("fact", "actor", "seq", "settled_seq", F.col("outcome").alias("vote"), "grade", "truth")


def confusion(votes: DataFrame) -> DataFrame:
    v, t = F.col("vote"), F.col("truth")
    return votes.groupBy("actor").agg(F.count_if(v & t).alias("tp"), F.count_if(~v & t).alias("fn"), F.count_if(v & ~t).alias("fp"), F.count_if(~v & ~t).alias("tn"))


def rates(conf: DataFrame) -> DataFrame:
    """conf with sens, fpr and the weight of a yes and a no in nats."""
    out = conf.withColumn("sens", E.sensitivity("tp", "fn")).withColumn("fpr", E.false_positive_rate("fp", "tn"))
    return out.withColumn("lr_yes", E.vote_log_lr(F.col("sens"), F.col("fpr"), F.lit(True))).withColumn("lr_no", E.vote_log_lr(F.col("sens"), F.col("fpr"), F.lit(False)))


def response_table(votes: DataFrame) -> DataFrame:
    return votes.groupBy("actor", "vote", "grade").agg(F.count_if("truth").alias("n_true"), F.count_if(~F.col("truth")).alias("n_false"))


def response_log_lr(votes: DataFrame) -> DataFrame:
    """(actor, vote, grade, log_lr) of seen cells: smoothed response ratios, or the two rates for sources with few scored votes."""
    cells = response_table(votes)
    w = Window.partitionBy("actor")
    cells = cells.withColumn("t", F.sum("n_true").over(w)).withColumn("f", F.sum("n_false").over(w))
    k = 2 * GRADES * RESPONSE_ALPHA
    own = F.ln(((F.col("n_true") + RESPONSE_ALPHA) / (F.col("t") + k)) / ((F.col("n_false") + RESPONSE_ALPHA) / (F.col("f") + k)))
    r = rates(confusion(votes)).select("actor", "lr_yes", "lr_no")
    fallback = F.when(F.col("vote"), F.col("lr_yes")).otherwise(F.col("lr_no"))
    return cells.join(r, "actor").select("actor", "vote", "grade", F.when(F.col("t") + F.col("f") >= MIN_SCORED, own).otherwise(fallback).alias("log_lr"))


def reliability(votes: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(actor, a, b, reliability). overrides (actor, seq, a, b): the last one replaces the prior, and only settlements after it count."""
    a0, b0 = E.RELIABILITY_PRIOR
    agree = F.col("vote") == F.col("truth")
    if overrides is None:
        base = votes.groupBy("actor").agg((F.count_if(agree) + F.lit(a0)).alias("a"), (F.count_if(~agree) + F.lit(b0)).alias("b"))
    else:
        last = overrides.groupBy("actor").agg(F.max_by(F.struct("seq", "a", "b"), "seq").alias("o")).select("actor", F.col("o.seq").alias("from_seq"), F.col("o.a").alias("a0"), F.col("o.b").alias("b0"))
        counted = votes.join(last, "actor", "left").where("from_seq IS NULL OR settled_seq > from_seq").groupBy("actor").agg(F.count_if(agree).alias("x"), F.count_if(~agree).alias("y"))
        base = counted.join(last, "actor", "full").select("actor", (F.coalesce("a0", F.lit(a0)) + F.coalesce("x", F.lit(0))).alias("a"), (F.coalesce("b0", F.lit(b0)) + F.coalesce("y", F.lit(0))).alias("b"))
    return base.withColumn("reliability", F.col("a") / (F.col("a") + F.col("b")))


def grouped_logodds(votes: DataFrame, conf: DataFrame, gamma: float = GAMMA, prior: float = 0.0) -> DataFrame:
    """(fact, logodds, p): votes (fact, actor, vote, sig) at their sources' mean rates; votes that share a context count as its size to 1 - gamma, those without one fully."""
    r = rates(conf).select("actor", "lr_yes", "lr_no")
    mean = lambda vote: E.vote_log_lr(F.lit(E.SENS_PRIOR[0] / 10), F.lit(E.FPR_PRIOR[0] / 10), vote)
    lr = F.coalesce(F.when(F.col("vote"), F.col("lr_yes")).otherwise(F.col("lr_no")), mean(F.col("vote")))
    parts = votes.join(r, "actor", "left").groupBy("fact", "sig").agg(F.sum(lr).alias("s"), F.count("*").alias("m"))
    part = F.when(F.col("sig").isNull(), F.col("s")).otherwise(F.col("s") / F.pow("m", F.lit(gamma)))
    return parts.groupBy("fact").agg((F.sum(part) + prior).alias("logodds")).withColumn("p", E.sigmoid(F.col("logodds")))


def category_confusion(reports: DataFrame, settlements: DataFrame) -> DataFrame:
    """One-vs-rest confusion by (actor, value): a report is a vote on the realised value, and a false yes for the value it gave if that is another."""
    s = settlements.select("fact", F.col("seq").alias("settled_seq"), F.col("value").alias("real"))
    j = reports.where("value IS NOT NULL").join(s, "fact").where("seq < settled_seq")
    right = F.col("value") == F.col("real")
    cell = lambda v, vote, truth: F.struct(v.alias("value"), vote.alias("vote"), F.lit(truth).alias("truth"))
    both = F.when(right, F.array(cell(F.col("real"), F.lit(True), True))).otherwise(F.array(cell(F.col("real"), F.lit(False), True), cell(F.col("value"), F.lit(True), False)))
    rows = j.select("actor", F.explode(both).alias("c")).select("actor", "c.*")
    v, t = F.col("vote"), F.col("truth")
    return rows.groupBy("actor", "value").agg(F.count_if(v & t).alias("tp"), F.count_if(~v & t).alias("fn"), F.count_if(v & ~t).alias("fp"), F.count_if(~v & ~t).alias("tn"))


def category_weights(conf: DataFrame) -> DataFrame:
    """(actor, value, weight) of a report, at most 1; unscored reports weigh 1."""
    return rates(conf).select("actor", "value", F.least(F.lit(1.0), F.exp(F.col("lr_yes") - PRIOR_LOG_LR)).alias("weight"))
