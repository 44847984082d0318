"""Exact top-k by inner product: columnar branch-and-bound.

Vectors are kept in vertical layout (dimension by row). For a tile of queries, scores grow block of dimensions by block; after each block the
largest score that the rest can still give, by the Cauchy-Schwarz inequality on the remaining mass of query and candidate, is held against the query's
k-th best so far, and candidates that can't reach it for any query of the tile are compacted away. Bounds are rounded up and only strictly smaller
candidates go, so ties and all results are exact.

Plan: queries go out in broadcast blocks of about QUERY_BYTES, measured before; each block is one pass over the candidates, which stay where they are. A task
returns k rows a query, and one shuffle of those takes the best by query. Where there are several blocks, each is a job of its own that writes k rows a query and lets go of
its broadcast. Neither side is ever paired row by row.

Cases: vectors that are null, empty or hold null or non-finite components, and rows with a null vec_id, take no part. Only vectors of the same length are
compared, of any length. All rows with the query's vec_id are its own and are no candidates; rows that repeat another vec_id are candidates each. A repeated query id is
one query whose rows' results are merged. Scores that don't fit 64 bits are ranked exactly and given as the nearest 64-bit value. Empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import BROADCAST_BYTES, chunks, text_table, tune, written

K, EVERY, SCALE = 5, 50, 256
#: Bytes of one broadcast block of queries, at 8 a component, and queries worked on at once.
QUERY_BYTES, TILE = BROADCAST_BYTES // 2, 32
#: Dimensions added before candidates are compacted.
DIM_BLOCK = 16


def _vectors(ids: pa.Array, column: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids, and the floored vectors as doubles, row by row."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    n[~np.asarray(ids.is_valid())] = 0
    flat = column.flatten()  # lengths of nulls are 0 here too
    real = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(real)))[:-1]
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    own = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(n[n > 0]).tolist():
        rows = np.flatnonzero(n == d)
        v = x[at[rows][:, None] + np.arange(d)]
        ok = np.isfinite(v).all(1)
        out[d] = own[rows[ok]], np.floor(scale * v[ok])
    return out


class Best:
    """The k best of each query so far: scores fall, ties by smaller id."""

    def __init__(self, n: int, k: int, kind):
        self.k = k
        self.q, self.s, self.id = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf, kind if kind is object else np.float64)

    def add(self, q: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        q, s, ids = np.concatenate((self.q, q)), np.concatenate((self.s, s)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, -s, q)) if s.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -s[i], ids[i])), np.int64)
        q, s, ids = q[order], s[order], ids[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.q, self.s, self.id = q[keep], s[keep], ids[keep]
        full = np.flatnonzero(np.bincount(self.q, minlength=len(self.least)) >= self.k)
        self.least[full] = self.s[np.searchsorted(self.q, full, "right") - 1]


def _kind(a: float, b: float, d: int):
    """The type in which all partial sums are exact."""
    m = a * b * d
    return np.float32 if m < 1 << 23 else np.float64 if m < 1 << 52 else np.int64 if m < 1 << 62 else object


def search(best: Best, qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, block: int = DIM_BLOCK) -> int:
    """Feed candidates into best; the number of multiplications done, for tests."""
    kind = _kind(np.abs(q).max(initial=0), np.abs(c).max(initial=0), q.shape[1])
    if kind is object:
        qx, cx = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape), np.array([[int(x) for x in r] for r in c], object).reshape(c.shape)
    else:
        qx, cx = q.astype(kind), c.astype(kind)
    cols = np.ascontiguousarray(cx.T)
    d, done = q.shape[1], 0
    with np.errstate(over="ignore"):
        q_rest = np.sqrt(np.cumsum((q * q)[:, ::-1], 1)[:, ::-1])
        c_rest = np.sqrt(np.cumsum((c * c).T[::-1], 0)[::-1])
    for t in range(0, len(q), TILE):
        sl = slice(t, t + TILE)
        part, alive = None, np.arange(len(cid))
        for a in range(0, d, block):
            b = min(a + block, d)
            step = qx[sl, a:b] @ (cols[a:b] if len(alive) == len(cid) else cols[a:b, alive])
            done += step.size * (b - a)
            part = step if part is None else part + step
            if b < d and kind is not object and np.isfinite(best.least[sl]).all():
                top = part + (q_rest[sl, b : b + 1] * c_rest[b, alive]) * (1 + 1e-6) + 1e-3
                ok = (top >= best.least[sl, None]).any(0)
                if ok.mean() < 0.7:
                    alive, part = alive[ok], part[:, ok]
            if not len(alive):
                break
        if not len(alive):
            continue
        ids = cid[alive]
        s = part if kind is object else part.astype(np.int64 if kind is np.int64 else np.float64)
        mine = ids[None, :] == qid[sl, None]
        if kind is object:
            i, j = np.nonzero(~mine)
        else:
            seen = np.where(mine, -np.inf, s)
            least = best.least[sl]
            if seen.shape[1] > best.k:
                least = np.maximum(least, -np.partition(-seen, best.k - 1, axis=1)[:, best.k - 1])
            i, j = np.nonzero((seen >= least[:, None]) & ~mine)
        best.add(i + t, s[i, j] if kind is object else s[i, j].astype(best.s.dtype), ids[j])
    return done


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of floor(scale * x), queries being rows whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = rows.where((F.col("vec_id") % every == 0) & F.col("embedding").isNotNull())
    size = asked.agg(F.sum(8 * F.size("embedding") + 16)).first()[0] or 0
    n_blocks = max(1, -(-int(size) // QUERY_BYTES))
    w = Window.partitionBy("query_id").orderBy(F.desc("approx"), F.desc("digits"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        # A score of up to 38 digits is exact as a decimal; beyond that its order is kept by a double.
        exact = F.expr("try_cast(exact AS decimal(38,0))")
        score = F.coalesce(exact.cast("double"), F.col("exact").cast("double"))
        return found.select("query_id", "vec_id", score.alias("approx"), exact.alias("digits"), "exact").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    out = None
    for n in range(n_blocks):
        block = (asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n_blocks)) == n)).toArrow().combine_chunks()  # about QUERY_BYTES
        column = lambda t, c: t.column(c).chunk(0) if t.column(c).num_chunks else pa.array([], t.schema.field(c).type)
        held = spark.sparkContext.broadcast(_vectors(column(block, "vec_id"), column(block, "embedding"), scale))

        def scan(batches, held=held):
            found: dict = {}
            for b in chunks(batches):
                for d, (cid, c) in _vectors(b.column(0), b.column(1), scale).items():
                    if d in held.value and len(cid):
                        qid, q = held.value[d]
                        wide = _kind(np.abs(q).max(initial=0), np.abs(c).max(initial=0), d) is object
                        best = found.setdefault((d, wide), Best(len(qid), k, object if wide else np.int64))
                        search(best, qid, q, cid, c)
            for (d, _), best in found.items():
                s = pa.array([str(x) for x in best.s], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(held.value[d][0][best.q]), pa.array(best.id), s], ["query_id", "vec_id", "exact"])

        part = rows.mapInArrow(scan, "query_id long, vec_id long, exact string")
        if n_blocks > 1:
            part = written(ranked(part).select("query_id", "vec_id", "exact"), "nearest")
            held.unpersist()
        out = part if out is None else out.unionByName(part)
    bound = F.when(F.col("approx") > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63)))
    return ranked(out).select("query_id", "rank", "vec_id", F.coalesce(F.expr("try_cast(exact AS bigint)"), bound).alias("score"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(text_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
