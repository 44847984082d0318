"""Simulated p-values: the same in any order of groups, exact up to a bar, computed once and where the work was spread."""

import random

import numpy as np
from pyspark.sql import functions as F

from attesta.functions import special
from attesta.operators import dispersion, series, sweep


def test_p_does_not_depend_on_the_order_of_groups(spark):
    rows = [("f", "a", 10, 8), ("f", "b", 20, 4), ("f", "c", 9, 1)]
    got = set()
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame(order, "fact string, val string, n long, k long").coalesce(1)
        got.add(dispersion.pvalues(df, ["fact"]).first().p)
    assert got == {special.tarone_p([10, 20, 9], [8, 4, 1])}


def test_p_up_to_a_bar(spark):
    r = random.Random(5)
    below = 0
    for _ in range(60):
        n = [r.randint(8, 30) for _ in range(6)]
        k = [min(m, max(0, round(m * r.gauss(0.5, 0.15)))) for m in n]
        want, got = special.tarone_p(n, k), special.tarone_p(n, k, bar=0.05)
        below += want is not None and want <= 0.05
        assert got == want if want is None or want <= 0.05 else got > 0.05
    assert below > 5


def test_tests_of_blocks_run_once_behind_the_shuffle(spark):
    s = spark.range(4000).select((F.col("id") % 40).cast("string").alias("fact"), F.col("id").alias("seq"), (F.rand(1) < 0.5).alias("hit"))
    plan = series.temporal_dispersion(s)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_fisher_equals_the_sum_of_the_tail():
    for k1, n1, k2, n2 in ((3, 9, 8, 12), (0, 400, 9, 500), (1, 1, 0, 1), (5, 0, 1, 3)):
        x = np.arange(max(0, k1 + k2 - n2), min(n1, k1 + k2) + 1)
        g = lambda m, r: special.lgamma(m + 1) - special.lgamma(r + 1) - special.lgamma(m - r + 1)
        if n1:
            lp = g(np.full(len(x), n1), x) + g(np.full(len(x), n2), k1 + k2 - x) - g(np.array([n1 + n2]), np.array([k1 + k2]))
            assert special.fisher_p(k1, n1, k2, n2) == float(min(1.0, np.exp(lp[lp <= lp[k1 - x[0]] + 1e-9]).sum()))
        else:
            assert special.fisher_p(k1, n1, k2, n2) == 1.0


def test_held_out_are_as_many_as_said(spark):
    s = spark.range(103).select((F.col("id") % 7).alias("fact"), F.col("id").alias("seq"))
    for r in series.holdout(s, ["fact"]).groupBy("fact").agg(F.count("*").alias("n"), F.count_if("held_out").alias("h")).withColumn("want", series.held(F.col("n"))).collect():
        assert r.h == r.want


def test_frames_bring_observations_together_once(spark):
    rows = [("a", i, i * 3_600_000, bool(i % 3), {"x": str(i % 2), "y": "1"}) for i in range(40)]
    o = spark.createDataFrame(rows, "fact string, seq long, ts_ms long, outcome boolean, ctx map<string,string>")
    out = sweep.frames(o, "outcome")
    assert out.where("seq = 1").select("key", "val").count() == 6 and out.where("seq = 0").count() == 5
    assert out.where("key = 'derived:xxy' AND seq = 3").first().val == "1|1"
    assert out.join(o.select("seq", F.col("outcome").alias("own")), "seq").where("outcome <> own").count() == 0
