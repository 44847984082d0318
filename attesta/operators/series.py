"""Ordered series: rows (fact, seq, hit) in arrival order. Windows run over sorted partitions and spill; no series is gathered into one row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.special import avalanche_udf, fisher_p_udf, tarone_p_udf
from attesta.sources.shared import spread

MIN_SIDE, ALPHA = 8, 0.01
SCALES = (8, 16, 32)


def _order(by: list[str], order: str = "seq"):
    return Window.partitionBy(*by).orderBy(order)


def previous_outcome(obs: DataFrame) -> DataFrame:
    """obs with prev: T or F of the fact's observation before, null for the first."""
    before = F.lag("outcome").over(_order(["fact"]))
    return obs.withColumn("prev", F.when(before.isNotNull(), F.when(before, "T").otherwise("F")))


def locate(series: DataFrame, by: list[str]) -> DataFrame:
    """by, n, k, cut, cut_seq, n1, k1: where the cumulative deviation from the mean is largest, the first such place. cut is its 0-based number."""
    w, whole = _order(by), Window.partitionBy(*by)
    x = F.col("hit").cast("int")
    run = series.select(*by, "seq", x.alias("x"), (F.row_number().over(w) - 1).alias("i"), F.sum(x).over(w).alias("c"), F.count("*").over(whole).alias("n"), F.sum(x).over(whole).alias("k"))
    # the deviation is (c * n - k * (i + 1)) / n: whole numbers decide, so sums of doubles can't move a tie
    dev = F.abs(F.col("c") * F.col("n") - F.col("k") * (F.col("i") + 1))
    best = F.max(F.struct(dev.alias("d"), (-F.col("i")).alias("i"), F.col("seq").alias("seq"), F.col("c").alias("k1")))
    return run.groupBy(*by).agg(F.first("n").alias("n"), F.first("k").alias("k"), best.alias("b")).select(*by, "n", "k", (-F.col("b.i")).cast("int").alias("cut"), F.col("b.seq").alias("cut_seq"), (1 - F.col("b.i")).cast("long").alias("n1"), F.col("b.k1").alias("k1"))


def changepoints(series: DataFrame, by: list[str], alpha: float = ALPHA) -> DataFrame:
    """locate() with p: the exact test of the two sides times the places searched; detected from enough support on both sides and p up to alpha."""
    out = locate(series, by)
    n2 = F.col("n") - F.col("n1")
    out = spread(out, *by).withColumn("fisher", fisher_p_udf()("k1", "n1", F.col("k") - F.col("k1"), n2))
    searched = F.greatest(F.lit(1), F.col("n") - 2 * MIN_SIDE + 1)
    out = out.withColumn("p", F.least(F.lit(1.0), F.col("fisher") * searched))
    return out.withColumn("detected", (F.col("n") >= 2 * MIN_SIDE) & (F.least(F.col("n1"), n2) >= MIN_SIDE) & (F.col("p") <= alpha))


def recurrent(series: DataFrame, found: DataFrame) -> DataFrame:
    """(fact, recurrent): facts with a detected changepoint, one of whose sides changes again."""
    sides = series.join(found.where("detected").select("fact", "cut_seq"), "fact").withColumn("side", F.col("seq") > F.col("cut_seq"))
    return changepoints(sides, ["fact", "side"]).groupBy("fact").agg(F.bool_or("detected").alias("recurrent"))


def time_blocks(series: DataFrame, size: int) -> DataFrame:
    """(fact, block, n, k) of whole blocks of consecutive observations."""
    b = F.floor((F.row_number().over(_order(["fact"])) - 1) / size).cast("long")
    return series.withColumn("block", b).groupBy("fact", "block").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("int")).alias("k")).where(F.col("n") == size)


def temporal_dispersion(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(fact, p, size): the scale at which blocks differ most, if the corrected p is up to alpha."""
    w = _order(["fact"])
    numbered = series.select("fact", F.col("hit").cast("int").alias("x"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("fact")).alias("n"))
    scale = F.filter(F.array(*map(F.lit, SCALES)), lambda s: F.col("n") >= 3 * s)
    blocks = numbered.select("fact", "x", "i", F.size(scale).alias("m"), F.explode(scale).alias("size")).groupBy("fact", "m", "size", F.floor(F.col("i") / F.col("size")).alias("block")).agg(F.count("*").alias("n"), F.sum("x").alias("k")).where("n = size")
    tested = blocks.groupBy("fact", "m", "size").agg(F.collect_list("n").alias("ns"), F.collect_list("k").alias("ks"))
    p = spread(tested, "fact", "size").withColumn("raw", tarone_p_udf()("ns", "ks", F.lit(alpha) / F.col("m"))).where("raw IS NOT NULL").withColumn("p", F.least(F.lit(1.0), F.col("raw") * F.col("m")))
    best = p.where(F.col("p") <= alpha).groupBy("fact").agg(F.min(F.struct("p", "size")).alias("b"))
    return best.select("fact", F.col("b.p").alias("p"), F.col("b.size").alias("size"))


STRIDE = 4


def held(n: Column) -> Column:
    """How many of n observations holdout() holds out."""
    return F.floor(n / STRIDE)


def holdout(obs: DataFrame, by: list[str], stride: int = STRIDE) -> DataFrame:
    """obs with held_out: every stride-th of the series in the order of a hash of seq."""
    mixed = obs.withColumn("_h", avalanche_udf()(F.col("seq")))
    w = Window.partitionBy(*by).orderBy("_h", "seq")
    return mixed.withColumn("held_out", F.row_number().over(w) % stride == 0).drop("_h")


def flaky(votes: DataFrame, factor: int = 2) -> DataFrame:
    """(fact, runs, classes, flaky): more runs of equal votes than factor for each class, votes being ordered by source, context and arrival."""
    w = Window.partitionBy("fact").orderBy("actor", F.col("sig").asc_nulls_first(), "seq")
    key = F.struct("actor", "outcome", "grade", F.coalesce("sig", F.lit("")).alias("sig"))
    marked = votes.select("fact", key.alias("c"), (~F.coalesce(F.lag(key).over(w) == key, F.lit(False))).cast("int").alias("new"))
    out = marked.groupBy("fact").agg(F.sum("new").alias("runs"), F.count_distinct("c").alias("classes"))
    return out.withColumn("flaky", F.col("runs") > factor * F.col("classes"))


def cusum(series: DataFrame, threshold: float = 5.0, drift: float = 0.5) -> DataFrame:
    """(fact, alarm): number of the first observation at which a two-sided cumulative sum of standardised deviations passes the threshold, or null.

    A fold over sorted partitions as they stream by: a series of any length takes the memory of one batch."""
    x = F.col("hit").cast("double")
    mean = series.groupBy("fact").agg(F.avg(x).alias("m")).withColumn("sd", F.sqrt(F.greatest(F.col("m") * (1 - F.col("m")), F.lit(1e-12))))
    rows = spread(series.join(mean, "fact").select("fact", "seq", ((x - F.col("m")) / F.col("sd")).alias("z")), "fact").sortWithinPartitions("fact", "seq")
    kind = series.schema["fact"].dataType.simpleString()

    def fold(batches):
        now, alarm, state = None, None, (0.0, 0.0, 0)
        for b in batches:
            out = []
            for fact, z in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if now != (fact,):
                    if now is not None:
                        out.append((now[0], alarm))
                    now, alarm, state = (fact,), None, (0.0, 0.0, 0)
                if alarm is None:
                    up, down, i = max(0.0, state[0] + z - drift), max(0.0, state[1] - z - drift), state[2]
                    alarm = i if up > threshold or down > threshold else None
                    state = up, down, i + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], b.column(0).type), pa.array([x for _, x in out], pa.int32())], ["fact", "alarm"])
            last = b.column(0).type
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], last), pa.array([alarm], pa.int32())], ["fact", "alarm"])

    return rows.mapInArrow(fold, f"fact {kind}, alarm int")


def pin_tension(obs: DataFrame, pins: DataFrame, threshold: int = 3) -> DataFrame:
    """(fact, seq): the report with which positive ones under an active negative pin (fact, pin_seq) reach the threshold."""
    hits = obs.where("outcome").join(pins, "fact").where("seq > pin_seq")
    return hits.withColumn("c", F.row_number().over(_order(["fact"]))).where(F.col("c") == threshold).select("fact", "seq")
