"""Quality classifier: random Fourier features over document statistics, ridge from partition-summed normal equations, isotonic calibration.

Statistics of whole texts (lengths, character classes, case, repetition of words and lines) are standardised and sent through cosines of random projections, whose
inner products approximate a Gaussian kernel. Ridge coefficients solve the sum of the partitions' normal equations; on a quarter of the training rows that
the ridge didn't see, pool-adjacent-violators turns its output into probabilities of label 1.

Plan: (1) one scan computes the statistics, 30 numbers a document, which meet the labels by doc_id; texts are never shuffled. The sample of labelled rows is bounded by
``max_rows`` (a documented parameter; every labelled row has the same chance, by a hash of its id) and is written. (2) Its ROW_PARTS partitions return one
matrix each. (3) A second scan computes statistics and scores as texts stream by. The model is a few hundred numbers.

Cases: null and empty texts have statistics, all 0 but for the constant, and get the score of such. Labels whose quality is null or other than 0 and 1 are
not learnt from; repeated labels count each (and documents that repeat an id meet each of its labels); labels without a document don't count. Rows with a null doc_id are held out. Without any label every score
is 0.5. Texts of any length are taken whole, in some bytes of memory for each byte. Equal statistics have equal scores. Columns of the input stay, but for score and predicted, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import BROADCAST_BYTES, Hasher, buffers, chunks, held_out, padded, text_table, tune, with_fields, words, written

MAX_ROWS = 200_000
FEATURES, WIDTH, RIDGE, SEED = 384, 1.0, 1e-3, 7
ROW_PARTS = 16
THRESHOLD = 0.3

_CLASSES = 12
_CLASS = np.full(256, 11, np.uint8)  # other symbols
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[128:192], _CLASS[192:] = 3, 4  # continuation and first bytes of other characters
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 5, 6
_CLASS[[46, 44]], _CLASS[[33, 63]], _CLASS[124], _CLASS[[39, 34, 45, 58, 59, 40, 41]] = 7, 8, 9, 10
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
_HASH = Hasher(71)


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes by document, of at most 2**20 documents."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """(texts, numbers) of whole texts."""
    data, off = buffers(column)
    n, size = len(off) - 1, np.diff(off)
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    by = np.bincount(doc * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    chars = np.maximum(1, size - by[:, 3])
    letters = np.maximum(1, by[:, 0] + by[:, 1] + by[:, 4])
    s, e, first = words(data, off, _SPACE)
    w = np.diff(first)
    wdoc = np.repeat(np.arange(n), w)
    some, length = np.maximum(1, w), (e - s).astype(float)
    raw, wide = padded(data)
    h = _HASH.ranges(raw, wide, s, e)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
    last = _CLASS[data[e - 1]] if len(e) else np.zeros(0, np.uint8)
    begin = _CLASS[data[s]] if len(s) else np.zeros(0, np.uint8)
    mean = np.bincount(wdoc, length, n) / some
    square = np.bincount(wdoc, length**2, n) / some
    ls, le, lfirst = words(data, off, _LINE)
    lines = np.diff(lfirst)
    ldoc = np.repeat(np.arange(n), lines)
    share = lambda mask, of: np.bincount(of, mask.astype(float), n)
    out = np.stack(
        [
            np.log1p(size),
            np.log1p(w),
            *(by[:, k] / chars for k in (0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11)),
            by[:, 1] / letters,
            np.sqrt(by[:, 8] / some),
            np.sqrt(by[:, 11] / some),
            np.sqrt(by[:, 9] / some),
            mean,
            np.sqrt(np.maximum(0, square - mean**2)),
            share(again, wdoc) / some,
            share(last == 11, wdoc) / some,
            share((last == 8) | (last == 9), wdoc) / some,
            share(last == 7, wdoc) / some,
            share(begin == 1, wdoc) / some,
            share(length >= 15, wdoc) / some,
            share(length <= 3, wdoc) / some,
            _distinct(wdoc, h, n) / some,
            np.log1p(_distinct(wdoc, h, n)),
            (lines - _distinct(ldoc, _HASH.ranges(raw, wide, ls, le), n)) / np.maximum(1, lines),
            np.log1p(size / np.maximum(1, lines)),
        ],
        1,
    )
    return out.astype(np.float64)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit: block means at block means of x."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(float)
    ux, at = np.unique(x, return_inverse=True)
    n = np.bincount(at).astype(float)
    mean, weight, place = [], [], []
    for a, b, c in zip((np.bincount(at, y) / n).tolist(), n.tolist(), ux.tolist(), strict=True):
        mean.append(a)
        weight.append(b)
        place.append(c)
        while len(mean) > 1 and mean[-2] >= mean[-1]:
            t = weight[-2] + weight[-1]
            mean[-2] = (mean[-2] * weight[-2] + mean[-1] * weight[-1]) / t
            place[-2] = (place[-2] * weight[-2] + place[-1] * weight[-1]) / t
            weight[-2] = t
            for z in (mean, weight, place):
                z.pop()
    return np.array(place), np.clip(np.array(mean), 0, 1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate((np.cos(z @ self.project + self.shift) * np.sqrt(2 / len(self.shift)), z, np.ones((len(x), 1))), 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots[0]):
            return np.full(len(x), 0.5)
        return np.interp(self.features(x) @ self.weights, *self.knots)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, y, x) of the labelled rows outside the held-out fold: all of them, or about max_rows by a hash of doc_id. Written."""
    tune(docs.sparkSession)

    def stats(batches):
        for b in chunks(batches):
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    x = docs.where(~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(stats, "doc_id long, x array<double>")
    y = labels.where("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where(~held_out("doc_id"))
    n = y.count()
    if n > max_rows:
        y = y.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 40)) < int((1 << 40) * max_rows / n))
        n = y.count()
    if 32 * n <= BROADCAST_BYTES:  # else statistics are shuffled
        y = F.broadcast(y)
    return written(x.join(y, "doc_id"), "labelled")


def fit(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE) -> Model:
    """The model of training_rows(). Sums are over ROW_PARTS partitions, in order of doc_id within each."""
    d = statistics(pa.array([""])).shape[1]
    parts = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(4))).repartition(ROW_PARTS, "doc_id")

    def arrays(batches):
        t = pa.Table.from_batches(list(batches))
        if not t.num_rows:
            return None
        t = t.combine_chunks().sort_by([("doc_id", "ascending"), ("y", "ascending")])
        return t.column("fold").to_numpy(), t.column("y").to_numpy(), np.array(t.column("x").to_pylist(), float)

    def sums(of):
        def run(batches):
            batches = list(batches)
            if batches and (a := arrays(batches)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([np.ravel(v) for v in of(*a)]).tobytes()], pa.binary())], ["s"])

        return sorted((np.frombuffer(r["s"]) for r in parts.mapInArrow(run, "s binary").collect()), key=lambda v: v.tobytes())

    r = np.random.default_rng(SEED)
    project, shift = r.normal(size=(d, features)) / (width * np.sqrt(d)), r.uniform(0, 2 * np.pi, features)
    first = sum(sums(lambda _f, _y, x: (np.float64(len(x)), x.sum(0), (x**2).sum(0))), np.zeros(1 + 2 * d))
    n = first[0]
    if not n:
        return Model(np.zeros(d), np.ones(d), project, shift, np.zeros(features + d + 1), (np.zeros(0), np.zeros(0)))
    mean = first[1 : 1 + d] / n
    std = np.sqrt(np.maximum(0, first[1 + d :] / n - mean**2))
    model = Model(mean, np.where(std > 1e-9, std, 1), project, shift, np.zeros(0), (np.zeros(0), np.zeros(0)))
    k = features + d + 1

    def normal(fold, y, x):
        z = model.features(x[fold != 0])
        return z.T @ z, z.T @ y[fold != 0]

    second = sum(sums(normal), np.zeros(k * k + k))
    a, b = second[: k * k].reshape(k, k), second[k * k :]
    model.weights = np.linalg.solve(a + ridge * max(1.0, n) * np.diag(np.r_[np.full(features, 1.0), np.full(d, 1e-2), 1e-9]) + 1e-9 * np.eye(k), b)
    pairs = sums(lambda fold, y, x: (np.stack((model.features(x[fold == 0]) @ model.weights, y[fold == 0]), 1),))
    own = np.concatenate([p.reshape(-1, 2) for p in pairs]) if pairs else np.zeros((0, 2))
    if not len(own):  # too few rows for a calibration quarter
        own = np.concatenate([p.reshape(-1, 2) for p in sums(lambda fold, y, x: (np.stack((model.features(x) @ model.weights, y), 1),))])
    model.knots = isotonic(own[:, 0], own[:, 1])
    return model


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 from the threshold on)."""
    tune(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in {"score", "predicted"}]

    def run(batches):
        for b in chunks(batches):
            s = model.score(statistics(b.column(b.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in own], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*own, "score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(run, with_fields(docs, ("score", "double"), ("predicted", "int")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, text_table(spark, sf_dir, "labels")))
    return score_quality(docs.withColumn("held_out", held_out("doc_id")), model).select("doc_id", "held_out", "score", "predicted")
