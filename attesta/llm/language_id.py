"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound as the product of its letters' vectors, the first rotated by two places and the second
by one; a text is the bundle (sum) of its trigrams' vectors and a language the bundle of its training texts. A text's language is the prototype with
the largest cosine; the score is that cosine, cut to 0..1. Letters are code points that Unicode calls alphabetic, in lower case; whatever else is between
them counts as one boundary symbol, and trigrams have a letter in their middle.

Plan: two scans and no shuffle of texts. Bundling is linear, so texts are taken in tiles of at most TEXTS texts or LETTERS letters (a longer text in several),
whose trigrams are counted and turned into vectors by matrix products over GRAMS trigrams at once: what a task holds doesn't grow with the number, length or
alphabet of its texts. A task hands on one integer vector a language, whatever its share of the rows. All sums are integers, hence independent of partitions.
The prototypes are languages x dims numbers, measured before they are broadcast.

Cases: null text or text without letters is und with score 0, and so is everything when nothing could be learnt. Rows with null lang aren't learnt
from; rows with a null doc_id are held out. Texts of any length count whole; repeated rows count each. Ties go to the first language in code-point order. Columns of the input stay, but for held_out,
lang_pred and score, which are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import BROADCAST_BYTES, buffers, chunks, held_out, text_table, tune, with_fields

DIMS = 1024
#: Code points with a table entry; the few beyond it are looked up one by one.
TABLE = 0x20000
CHUNK = 1 << 20
#: Texts, letters and distinct trigrams that are worked on at once, and different letters up to which trigrams are counted in a cube.
TEXTS, LETTERS, GRAMS, CUBE = 512, 1 << 18, 8_192, 100


@functools.cache
def _fold() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for what is no letter."""
    out = np.zeros(TABLE, np.uint32)
    for c in range(TABLE):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@functools.lru_cache(maxsize=20_000)
def _letter(code: int, dims: int) -> np.ndarray:
    return np.random.default_rng([20_731, code]).integers(0, 2, dims, dtype=np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(grams: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """(n, dims) bound vectors of trigrams given as an (n, 3) array of code points."""
    codes, at = np.unique(grams, return_inverse=True)
    at = at.reshape(-1, 3)
    own = np.stack([_letter(int(c), dims) for c in codes]) if len(codes) else np.zeros((0, dims), np.int8)
    return np.roll(own, 2, 1)[at[:, 0]] * np.roll(own, 1, 1)[at[:, 1]] * own[at[:, 2]]


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points, offsets by text)."""
    data, off = buffers(column)
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]
    if at[-1] != len(code):  # bytes that aren't UTF-8
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(off[:-1], off[1:], strict=True)]
        code, at = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    if len(code) and code.max() >= TABLE:
        out = _fold()[np.minimum(code, TABLE - 1)]
        high = np.flatnonzero(code >= TABLE)
        points, of = np.unique(code[high], return_inverse=True)
        out[high] = np.array([c if chr(c).isalpha() else 0 for c in points.tolist()], np.uint32)[of]
        return out, at
    return _fold()[code], at


def _trigrams(code: np.ndarray, at: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct trigrams as (n, 3) code points, trigram of each letter in p..q, place of each letter); neighbours may lie outside p..q, in the same text."""
    lo, hi = max(0, p - 1), min(len(code), q + 1)
    present, x = np.unique(code[lo:hi], return_inverse=True)
    if not len(present) or present[0] != 0:
        present, x = np.concatenate((np.zeros(1, present.dtype), present)), x + 1
    k = len(present)
    padded = np.zeros(q - p + 2, np.int64)
    padded[lo - p + 1 : hi - p + 1] = x
    before, mid, after = padded[:-2].copy(), padded[1:-1], padded[2:].copy()
    edge = at[(at >= p) & (at <= q)] - p  # texts don't see each other
    before[edge[edge < q - p]] = 0
    after[edge[edge > 0] - 1] = 0
    own = np.flatnonzero(mid)
    gram = (before[own] * k + mid[own]) * k + after[own]
    if k <= CUBE:
        seen = np.flatnonzero(np.bincount(gram, minlength=1))
        place = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.int64)
        place[seen] = np.arange(len(seen))
        gram = place[gram]
    else:
        seen, gram = np.unique(gram, return_inverse=True)
    return present[np.stack([seen // (k * k), seen // k % k, seen % k], 1)], gram, own + p


def bundles(column: pa.Array, dims: int, owner: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, vectors, letters) by tiles of texts; with owner, a small number for each text, vectors are by owner and not by text."""
    code, at = _letters(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = min(first + TEXTS, max(first + 1, int(np.searchsorted(at, at[first] + LETTERS, "right")) - 1))
        rows = last - first if owner is None else int(owner.max()) + 1
        v, letters = np.zeros((rows, dims)), np.zeros(last - first, np.int64)
        for p in range(int(at[first]), int(at[last]), LETTERS):
            points, gram, place = _trigrams(code, at, p, min(p + LETTERS, int(at[last])))
            text = np.searchsorted(at, place, "right") - 1
            letters += np.bincount(text - first, minlength=last - first)
            row = text - first if owner is None else owner[text]
            if len(points) > GRAMS:
                order = np.argsort(gram, kind="stable")
                gram, row = gram[order], row[order]
            for g in range(0, len(points), GRAMS):
                size = min(GRAMS, len(points) - g)
                a, b = (0, len(gram)) if size == len(points) else np.searchsorted(gram, (g, g + size))
                counts = np.bincount(row[a:b] * size + gram[a:b] - g, minlength=rows * size).reshape(rows, size)
                v += counts.astype(np.float32) @ gram_vectors(points[g : g + size], dims).astype(np.float32)  # exact: below 2**24
        yield first, last, v, letters
        first = last


def learn(docs: DataFrame, dims: int = DIMS) -> dict[str, np.ndarray]:
    """Prototypes by language from all rows of docs (text, lang) with a lang: sums of integers."""
    spark = docs.sparkSession
    tune(spark)

    def bundle(batches):
        held: dict[str, np.ndarray] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))], ["lang", "v"])
            held.clear()
            return out

        for b in chunks(batches, CHUNK):
            names, at = np.unique(np.array(b.column(1).to_pylist(), object).astype(str), return_inverse=True)
            few = len(names) <= TEXTS
            for first, last, sums, _ in bundles(b.column(0), dims, at if few else None):
                for name, v in zip(names.tolist() if few else names[at[first:last]].tolist(), sums, strict=True):
                    held[name] = held.get(name, 0) + v.astype(np.int64)
                if len(held) > TEXTS:
                    yield flush()
        if held:
            yield flush()

    parts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(bundle, "lang string, v array<bigint>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    most = BROADCAST_BYTES // (8 * dims)
    rows = sums.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} languages: their prototypes are too large to broadcast")
    return {r["lang"]: np.array(r["v"], np.float64) for r in sorted(rows, key=lambda r: r["lang"]) if any(r["v"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dims: int = DIMS) -> DataFrame:
    """docs with lang_pred and score."""
    spark = docs.sparkSession
    tune(spark)
    names = list(prototypes)
    unit = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]) if names else np.zeros((0, dims))
    held = spark.sparkContext.broadcast(unit)
    own = [c for c in docs.columns if c.lower() not in {"lang_pred", "score"}]
    fields = with_fields(docs, ("lang_pred", "string"), ("score", "double"))

    def run(batches):
        unit = held.value
        for b in chunks(batches, CHUNK):
            pred, score = [], []
            for _, _, v, letters in bundles(b.column(b.schema.get_field_index("text")), dims):
                norm = np.linalg.norm(v, axis=1)
                cos = (v @ unit.T) / np.where(norm > 0, norm, 1)[:, None]
                known = (letters > 0) & (norm > 0) & bool(names)
                best = cos.argmax(1) if names else np.zeros(len(v), np.int64)
                score.append(np.where(known, np.clip(cos[np.arange(len(v)), best], 0, 1) if names else 0.0, 0.0))
                pred += [names[i] if ok else "und" for i, ok in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in own], pa.array(pred, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], [*own, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(run, fields)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents")
    prototypes = learn(docs.where(~held_out("doc_id")).select("text", "lang"))
    return predict(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")
