"""The sweep: which facts depend on a recorded condition, which changed at a date, which vary for reasons nobody logged.

All facts go through one plan. Context keys are joined by derived ones (UTC hour and weekday, the previous outcome, pairs of keys); three quarters of each
series propose, every fourth observation (by a hash of its seq) judges the proposal. Statistics run on group tallies; only tallies reach Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import expressions as E
from attesta.operators import dispersion, series, tallies
from attesta.sources.shared import checkpointed

MIN_OBS, Z_FLAG, ALPHA = 16, 3.0, 0.05
PREV, HOUR, DOW = "derived:prev", "derived:hour", "derived:dow"


def frames(obs: DataFrame, *keep: str, categorical: bool = False) -> DataFrame:
    """(fact, seq, *keep, key, val) of recorded and derived context. Observations are brought together by fact once; the rows are made of them where they lie."""
    hour, dow = E.clock("ts_ms")
    before = F.lag("value" if categorical else "outcome").over(Window.partitionBy("fact").orderBy("seq"))
    prev = before if categorical else F.when(before.isNotNull(), F.when(before, "T").otherwise("F"))
    cell = lambda key, val: F.struct(F.lit(key).alias("key"), val.cast("string").alias("val"))
    made = F.filter(F.array(cell(HOUR, hour), cell(DOW, dow), cell(PREV, F.col("_p"))), lambda s: s["val"].isNotNull())
    own = F.transform(F.map_entries("ctx"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("val")))
    none = F.slice(made, 1, 0)
    marked = obs.withColumn("_p", prev).join(tallies.few_keys(obs).withColumn("_few", F.lit(True)), "fact", "left")
    every = F.concat(F.coalesce(own, none), made, F.coalesce(F.when(F.col("_few"), tallies.pairs("ctx")), none))
    return marked.select("fact", "seq", *keep, F.explode(every).alias("s")).select("fact", "seq", *keep, "s.key", "s.val")


def _derived(key: str = "key"):
    return F.col(key).startswith("derived:")


def _tests(groups: DataFrame, counts: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(usable groups, tests with p, keep, guardable) of groups (by, val, n, k) of the proposing part; counts (fact, n_disc)."""
    total = groups.groupBy(*by).agg(F.count("*").alias("all_groups"))
    usable = groups.where(F.col("n") >= dispersion.MIN_SUPPORT)
    # a p above the level of the correction is never kept, and nothing else is asked of it
    tests = dispersion.pvalues(usable, by, bar=ALPHA).join(total, by).join(counts, "fact")
    tests = tests.withColumn("guardable", F.col("all_groups") <= F.greatest(F.lit(2), F.floor(F.col("n_disc") / (2 * dispersion.MIN_SUPPORT))))
    return usable, dispersion.benjamini_hochberg(tests, ["fact"], by[1:], ALPHA)


def _proposals(judged: DataFrame, hit: Column, usable: DataFrame, tests: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first key whose split survives correction and pays for itself, with its best value and how it did on the held-out part: judged (fact, key, val, m and what hit is made of)."""
    paid = dispersion.mdl(usable, by).where("accepted")
    passing = tests.where("keep AND guardable").join(paid, by)
    first = passing.withColumn("_r", F.row_number().over(Window.partitionBy("fact").orderBy(*order))).where("_r = 1").drop("_r")
    best = usable.withColumn("rate", F.col("k") / F.col("n")).groupBy(*by).agg(F.max_by("val", F.struct("rate", "val")).alias("best"), F.min("n").alias("support"))
    win = first.join(best, by).select(*by, "best", "support", "p", "z", "dl_guard", "dl_given", "dl_residual")
    hold = judged.join(win.select(*by, "best"), ["fact", "key"]).groupBy("fact").agg(F.sum(F.when((F.col("val") == F.col("best")) == hit, F.col("m"))).alias("hits"), F.sum("m").alias("m"))
    out = win.join(hold, "fact", "left").withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("misses", F.coalesce(F.col("m") - F.col("hits"), F.lit(0))).drop("m")
    return out.withColumn("regime_dependent", F.col("key").startswith("do:"))


def sweep(obs: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row a fact: (fact, n, verdict, key, best, hits, misses, regime_dependent, cut_seq, p, flagged, breadth_class).

    verdict: guard (a condition), supersede (a single change at cut_seq), question (varies, unexplained) or none. facts limits it to those touched since.
    """
    obs = obs.where("outcome IS NOT NULL")
    if facts is not None:
        obs = obs.join(facts.select("fact").distinct(), "fact", "left_semi")
    n = obs.groupBy("fact").agg(F.count("*").alias("n"))
    live = checkpointed(obs.join(n.where(F.col("n") >= MIN_OBS).select("fact"), "fact", "left_semi").withColumn("hit", F.col("outcome").cast("int")))
    counts = n.select("fact", (F.col("n") - series.held(F.col("n"))).alias("n_disc"))
    # The rest reads these many times: they are written once, which also keeps the plan small.
    rows = checkpointed(frames(series.holdout(live, ["fact"]), "hit", "held_out"))
    by = ["fact", "key"]
    groups = rows.where("NOT held_out").groupBy(*by, "val").agg(F.count("*").alias("n"), F.sum("hit").alias("k"))
    usable, tests = (checkpointed(t) for t in _tests(groups, counts, by))

    s = live.select("fact", "seq", "hit")
    change = checkpointed(series.changepoints(s, ["fact"]))
    again = series.recurrent(s, change)
    change = change.join(again, "fact", "left").withColumn("one_way", F.col("detected") & ~F.coalesce("recurrent", F.lit(False)))
    # the previous outcome explains a series only if nothing is left of time within each of its values
    prev_rows = rows.where(F.col("key") == PREV).select(F.concat_ws("\u0001", "fact", "val").alias("fact"), "seq", "hit")
    rest = series.temporal_dispersion(prev_rows).select("fact").unionByName(series.changepoints(prev_rows, ["fact"]).where("detected").select("fact"))
    leaves = rest.select(F.split("fact", "\u0001")[0].alias("fact")).distinct().unionByName(change.where("one_way").select("fact")).distinct().withColumn("key", F.lit(PREV))
    judged = rows.where("held_out").groupBy(*by, "val", "hit").agg(F.count("*").alias("m"))
    guards = checkpointed(_proposals(judged, F.col("hit") == 1, usable, tests.join(leaves, by, "left_anti"), by, [_derived(), "key"]))

    zmax = tests.groupBy("fact").agg(F.max("z").alias("zmax"))
    over_time = series.temporal_dispersion(s).select("fact", F.lit(True).alias("over_time"))
    out = n.join(guards, "fact", "left").withColumnRenamed("p", "guard_p").join(change.select("fact", "cut_seq", F.col("p").alias("change_p"), "one_way"), "fact", "left").join(zmax, "fact", "left").join(over_time, "fact", "left")
    loose = F.coalesce(F.col("zmax") > Z_FLAG, F.lit(False)) | F.coalesce("over_time", F.lit(False))
    verdict = F.when(F.col("key").isNotNull(), "guard").when(F.coalesce("one_way", F.lit(False)), "supersede").when(loose, "question").otherwise("none")
    confirming = live.where("outcome").select("fact", F.explode("ctx").alias("key", "val"))
    breadth = dispersion.breadth(confirming).select("fact", "breadth_class")
    out = out.withColumn("verdict", verdict).join(breadth, "fact", "left")
    return out.select("fact", "n", "verdict", "key", "best", "hits", "misses", "regime_dependent", F.when(F.col("verdict") == "supersede", F.col("cut_seq")).alias("cut_seq"), F.when(F.col("verdict") == "guard", F.col("guard_p")).when(F.col("verdict") == "supersede", F.col("change_p")).alias("p"), F.col("verdict").isin("guard", "question").alias("flagged"), F.coalesce("breadth_class", F.when(F.col("n") >= MIN_OBS, "narrow")).alias("breadth_class"))


def sweep_categorical(obs: DataFrame) -> DataFrame:
    """One row a fact with a guard: each value against the rest, corrected over values and keys together."""
    obs = obs.where("value IS NOT NULL")
    n = obs.groupBy("fact").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_OBS)
    live = obs.join(n.select("fact"), "fact", "left_semi")
    counts = n.select("fact", (F.col("n") - series.held(F.col("n"))).alias("n_disc"))
    # one row for each value that a fact takes under a condition: the values are set against the rest in these, not in the observations
    cells = checkpointed(frames(series.holdout(live, ["fact"]), "value", "held_out", categorical=True).groupBy("fact", "key", "val", "held_out", "value").agg(F.count("*").alias("m")))
    values = live.groupBy("fact", "value").agg(F.count("*").alias("_c")).select("fact", F.col("value").alias("target"))
    by = ["fact", "target", "key"]
    split = cells.where("NOT held_out").join(values, "fact")
    groups = split.groupBy(*by, "val").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("value") == F.col("target"), F.col("m")).otherwise(0)).alias("k"))
    usable, tests = (checkpointed(t) for t in _tests(groups, counts, by))
    return _proposals(cells.where("held_out"), F.col("value") == F.col("target"), usable, tests, by, [_derived(), "target", "key"])


def guard_scores(obs: DataFrame, guards: DataFrame, least: int = 16) -> DataFrame:
    """(fact, key, best, hits, misses) on observations after the guard's admission (fact, key, best, admitted_seq); scored from least of them on."""
    j = frames(obs, "outcome").join(guards, ["fact", "key"]).where("seq > admitted_seq")
    hit = (F.col("val") == F.col("best")) == F.col("outcome")
    out = j.groupBy("fact", "key", "best").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses")).where(F.col("hits") + F.col("misses") >= least)
    return out.withColumn("evidence", E.direction_evidence(F.col("hits"), F.col("misses"))).withColumn("stale", F.col("misses") > 2 * F.col("hits"))


def questions(report: DataFrame) -> DataFrame:
    """Open questions of a sweep: what to measure next."""
    text = F.when(F.col("verdict") == "guard", F.concat(F.lit("explained by "), "key")).otherwise(F.lit("record more of the surroundings: no recorded key accounts for the variation"))
    return report.where("flagged").select("fact", F.when(F.col("verdict") == "guard", "explained").otherwise("open").alias("status"), text.alias("suggestion"))
