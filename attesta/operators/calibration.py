"""Are predicted probabilities honest? Claims are rows (claim, p, outcome) with any grouping columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import expressions as E


def tallies(claims: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, bucket, n, k, p_milli: integers only; p in thousandths, rounded half to even."""
    k = [*(by or []), "bucket"]
    return claims.withColumn("bucket", E.bucket("p")).groupBy(*k).agg(F.count("*").alias("n"), F.count_if("outcome").alias("k"), F.sum(F.bround(F.col("p").cast("double") * 1000).cast("long")).alias("p_milli"))


def report(t: DataFrame, alert_n: int = 50) -> DataFrame:
    return t.withColumn("mean_p", F.col("p_milli") / (1000 * F.col("n"))).withColumn("observed", F.col("k") / F.col("n")).withColumn("alertable", F.col("n") >= alert_n)


def scores(claims: DataFrame, by: list[str] | None = None) -> DataFrame:
    y = F.col("outcome").cast("int")
    out = claims.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - y, 2)).alias("brier"), F.avg(E.surprisal(F.col("p"), F.col("outcome"))).alias("log_loss"), F.avg(((F.col("p") >= 0.5) == F.col("outcome")).cast("int")).alias("accuracy"))
    return out


def ece_slope(claims: DataFrame) -> DataFrame:
    """Expected calibration error over ten buckets, and the slope of outcome on prediction through bucket means."""
    b = claims.withColumn("bucket", E.bucket("p")).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("p").alias("x"), F.avg(F.col("outcome").cast("int")).alias("y"))
    wx, wy, w = F.sum(F.col("n") * F.col("x")), F.sum(F.col("n") * F.col("y")), F.sum("n")
    wxy, wxx = F.sum(F.col("n") * F.col("x") * F.col("y")), F.sum(F.col("n") * F.col("x") * F.col("x"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("x") - F.col("y"))) / w).alias("ece"), F.try_divide(w * wxy - wx * wy, w * wxx - wx * wx).alias("slope"))


def isotonic_fit(claims: DataFrame, digits: int = 3) -> DataFrame:
    """(x, n, y): non-decreasing fit of outcome on p. p is grouped to digits first, so at most 10**digits + 1 rows, whatever the claims, meet in one task."""
    ties = claims.groupBy(F.round(F.col("p"), digits).alias("x")).agg(F.count("*").alias("n"), F.count_if("outcome").alias("k"))

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x").reset_index(drop=True)
        blocks: list[list[float]] = []
        for i, (n, k) in enumerate(zip(pdf.n, pdf.k, strict=True)):
            blocks.append([float(n), float(k), i])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                n2, k2, _ = blocks.pop()
                blocks[-1][0] += n2
                blocks[-1][1] += k2
        ends = [int(b[2]) for b in blocks[1:]] + [len(pdf)]
        pdf["y"] = np.repeat([b[1] / b[0] for b in blocks], np.diff([0, *ends]))
        return pdf[["x", "n", "y"]]

    return ties.groupBy().applyInPandas(pool, "x double, n long, y double")


def isotonic_apply(df: DataFrame, knots: DataFrame, column: str = "p") -> DataFrame:
    """df with calibrated: linear between knots, constant outside. Knots are at most a thousand rows, kept as arrays on every row's side."""
    a = knots.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("k"))
    p, k = F.col(column), F.col("k")
    left, right = F.filter(k, lambda s: s["x"] <= p), F.filter(k, lambda s: s["x"] >= p)
    lo, hi = F.try_element_at(left, F.lit(-1)), F.try_element_at(right, F.lit(1))
    inner = lo["y"] + F.coalesce(F.try_divide((p - lo["x"]) * (hi["y"] - lo["y"]), hi["x"] - lo["x"]), F.lit(0.0))
    return df.crossJoin(F.broadcast(a)).withColumn("calibrated", F.when(lo.isNull(), hi["y"]).when(hi.isNull(), lo["y"]).otherwise(inner)).drop("k")


def paired_bootstrap(pairs: DataFrame, draws: int = 10_000, seed: int = 7) -> DataFrame:
    """(delta, lo, hi) of the mean difference between two losses (a, b) of the same rows. Each row draws its Poisson weights where it lies; only sums travel."""

    # weights of 1 in e, 1 in 1e and so on of 2**64 hash values: the Poisson distribution's steps
    steps = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1.0, 16)]))
    edges = np.array([int(x * 2**64) for x in steps if x < 1 - 2**-60], np.uint64)

    def sums(frames):
        total, n = np.zeros(draws), np.zeros(draws)
        plain, rows = 0.0, 0
        draw = np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        for pdf in frames:
            d, key = (pdf.a - pdf.b).to_numpy(float), pdf.key.to_numpy(np.int64).astype(np.uint64)
            for k in range(0, len(d), 64):  # a block of rows against all draws
                x = key[k : k + 64, None] ^ draw[None, :]
                for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    x ^= x >> np.uint64(shift)
                    x *= np.uint64(by)
                x ^= x >> np.uint64(31)
                w = np.searchsorted(edges, x, "right").astype(float)
                total += d[k : k + 64] @ w
                n += w.sum(0)
            plain += d.sum()
            rows += len(d)
        if rows:
            yield pd.DataFrame({"draw": np.arange(-1, draws), "s": np.r_[plain, total], "n": np.r_[rows, n].astype(float)})

    parts = pairs.select(F.col("a").cast("double"), F.col("b").cast("double"), F.abs(F.xxhash64("key")).alias("key")).mapInPandas(sums, "draw int, s double, n double")
    means = parts.groupBy("draw").agg((F.sum("s") / F.greatest(F.lit(1.0), F.sum("n"))).alias("m"))
    q = lambda x: F.expr(f"percentile(CASE WHEN draw >= 0 THEN m END, {x})")
    return means.agg(F.max(F.when(F.col("draw") < 0, F.col("m"))).alias("delta"), q(0.025).alias("lo"), q(0.975).alias("hi"))


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query, recall, ndcg, mrr) at k: ranked (query, item, rank from 1), gold (query, item)."""
    total = gold.groupBy("query").agg(F.count_distinct("item").alias("g"))
    hits = ranked.where(F.col("rank") <= k).join(gold.distinct(), ["query", "item"]).groupBy("query").agg(F.count("*").alias("h"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.max(1 / F.col("rank")).alias("mrr"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("g")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = total.join(hits, "query", "left").fillna(0, ["h", "dcg", "mrr"])
    return out.select("query", (F.col("h") / F.col("g")).alias("recall"), (F.col("dcg") / ideal).alias("ndcg"), F.col("mrr").cast("double").alias("mrr"))
