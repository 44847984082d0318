"""MinHash near-dedup: circulant MinHash, banding, exact Jaccard.

A document's set is its distinct 2-word shingles. Two permutations make all signature coordinates. The first, sigma, scatters shingles: 20 bits of it are a place
on a circle, 32 others tell apart what lies at one place. The second, pi, gives places values; coordinate k is the least value of pi, circularly shifted
by k, combined with those 32 bits, so a shingle's values for all coordinates lie side by side in one table, and texts with more shingles than the circle has places
still have signatures of their own. Bands of ROWS coordinates put documents into buckets; one bit of each coordinate is kept beside them. Links are confirmed on full sets.

Plan: (1) texts are written in chunks (see exchange). (2) One pass computes set size, a 128-bit key of the set, bands and bits, kept by chunk. Documents with equal
sets form a class at once, its smallest doc_id stands for it. (3) Chunks ask which band hashes occur elsewhere too, as packed hashes; only those become rows.
(4) First round: each document is held against one partner, the bucket minimum that it meets in most bands. Nearly all members of a family are linked
then. (5) Second round: pairs within a bucket whose members are still in different components. The largest component of a bucket isn't paired with itself, so a
bucket of m members of which s are strays costs s * m pairs, not m * m. In either round pairs whose bits agree in fewer places than similar sets ever do are refuted
by 56 bytes a document; only the sets of the others are sent: pairs of one family meet in one shard, so that
each set goes there once; a family with more than SPREAD documents on a side is spread over several.
(6) Components.

A pair of similarity 0.75 meets in no band with probability (1 - 0.75**6)**74 = 5e-7, and is refuted by bits (five standard deviations below their mean) with
3e-7; more similar pairs less. Documents of one bucket that aren't similar cost a pair of ids each, which is what is left of all pairs: where a template makes
a large share of a corpus half equal (at 0.5 a pair shares a bucket with probability 0.69), that part grows with the square of the family.

Cases: texts without words have the empty set and are linked with nothing. A doc_id on several rows is one document: it has the links of each row. A null
doc_id is linked with nothing, its component is null and it is kept. near_duplicates returns its four columns; near_dedup all columns of the input, whatever their
names. Empty tables give empty results. Texts of any length are taken whole; they cost some bytes of memory for each byte.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import BATCH_BYTES, Hasher, buffers, mix, padded, text_table, with_fields, words, written
from attesta.llm.components import connected_components
from attesta.llm.exchange import Corpus, Sent, codes, column, fitted, opened, reply

PERCENT, BANDS, ROWS = 75, 74, 6
PLACES = 1 << 20
#: Documents of a side of one family in one shard, and bytes of sets in a shard.
SPREAD, SHARD = 4_000, 24 << 20
#: Standard deviations that the agreement of two signatures' bits may lie below what the least similarity lets expect.
DEVIATIONS = 5
#: Shingles times coordinates that are looked up at once.
BLOCK = 1 << 21

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WORDS = Hasher(51)
_LOW = np.uint64((1 << 48) - 1)


@functools.cache
def _pi(coordinates: int) -> np.ndarray:
    """pi on the circle, in the high 20 bits of 32, its beginning repeated at the end."""
    r = np.random.default_rng(5)
    p = r.permutation(PLACES).astype(np.uint32) << np.uint32(12) | r.integers(0, 1 << 12, PLACES, dtype=np.uint32)
    return np.concatenate((p, p[:coordinates]))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each text; first of each text and the end)."""
    data, off = buffers(column)
    raw, wide = padded(_FOLD[data])
    s, e, first = words(raw[: len(data)], off, _SPACE)
    h = _WORDS.ranges(raw, wide, s, e)
    n = np.diff(first)
    count = np.where(n > 1, n - 1, n)
    row = np.repeat(np.arange(len(n), dtype=np.int32), count)
    start = first[:-1][row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    two = np.minimum(n, 2)[row] > 1
    g = h[start]
    g[two] = _WORDS.pair(g[two], h[start[two] + 1])
    g = mix(g)
    out, size, at = [], np.zeros(len(n), np.int64), np.concatenate(([0], np.cumsum(count)))
    if len(n) and len(g):
        # one sort by (text, hash): 64-bit keys don't hold both, so sort hashes first, then texts stably where the batch has several
        order = np.argsort(g, kind="stable")
        order = order[np.argsort(row[order].astype(np.uint16) if len(n) < 1 << 16 else row[order], kind="stable")]
        g, row = g[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        out, size = g[new], np.bincount(row[new], minlength=len(n))
        at = np.concatenate(([0], np.cumsum(size)))
    return np.asarray(out, np.uint64), at


def _sigma(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place on the circle, 32 bits that tell apart what lies there)."""
    x = mix(sets ^ np.uint64(0xC1AC))
    return (x >> np.uint64(44)).astype(np.int64), x.astype(np.uint32)


def signatures(sets: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """(texts, coordinates) of circulant MinHash; rows of empty sets are 0."""
    view = np.lib.stride_tricks.sliding_window_view(_pi(coordinates), coordinates)
    place, own = _sigma(sets)
    out = np.zeros((len(at) - 1, coordinates), np.uint32)
    full = np.flatnonzero(np.diff(at))
    block, k = max(1, BLOCK // coordinates), 0

    def values(a: int, b: int) -> np.ndarray:
        v = view[place[a:b]]
        v ^= own[a:b, None]
        return v

    while k < len(full):  # whole texts, up to about block shingles at once; longer texts in parts
        j = max(k + 1, int(np.searchsorted(at[full + 1], at[full[k]] + block, "right")))
        a, b = int(at[full[k]]), int(at[full[j - 1] + 1])
        if j == k + 1 and b - a > block:
            least = values(a, a + block).min(0)
            for i in range(a + block, b, block):
                np.minimum(least, values(i, min(b, i + block)).min(0), out=least)
            out[full[k]] = least
        else:
            out[full[k:j]] = np.minimum.reduceat(values(a, b), at[full[k:j]] - a, axis=0)
        k = j
    return out


def least_agreement(percent: int, coordinates: int) -> int:
    """Bits of coordinates in which the signatures of sets that are similar enough agree, but for DEVIATIONS."""
    q = (1 + percent / 100) / 2
    return int(coordinates * q - DEVIATIONS * (coordinates * q * (1 - q)) ** 0.5)


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) 64-bit."""
    x = signature.astype(np.uint64).reshape(len(signature), -1, rows)
    h = np.arange(x.shape[1], dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        h = mix(h + x[:, :, k] + np.uint64(k))
    return h.astype(np.int64)


def _described(corpus: Corpus, bands: int, rows: int) -> Corpus:
    """By chunk, one row a document: doc, n, k1, k2, bands (6 bytes each), bits."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        text = b.column(b.schema.get_field_index("text"))
        parts, first = [], 0
        sizes = np.diff(buffers(text)[1])
        while first < len(text):  # texts of about 256 KB at once
            last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), 1 << 18, "right")))
            sets, at = shingles(text.slice(first, last - first))
            keys = []
            for salt in (1, 2):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(salt)), dtype=np.uint64)))
                keys.append((total[at[1:]] - total[at[:-1]]).astype(np.int64))
            s = signatures(sets, at, bands * rows)
            h = np.ascontiguousarray((band_hashes(s, rows).astype(np.uint64) & _LOW).view("<u2").reshape(len(s), bands, 4)[:, :, :3])
            bits = np.packbits((s & np.uint32(1)).astype(np.uint8), axis=1)
            parts.append((np.diff(at), *keys, h.view(np.uint8).reshape(len(s), -1), bits))
            first = last
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros((0, 6 * bands), np.uint8), np.zeros((0, -(-bands * rows // 8)), np.uint8)]
        fixed = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]) for x in columns[3:]]
        return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")).cast(pa.int64()), *map(pa.array, columns[:3]), *fixed], ["doc", "n", "k1", "k2", "bands", "bits"])

    return corpus.derive("signatures", run)


def _buckets(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """(of each class of the chunk the row with the smallest doc_id, their band hashes as (rows, bands) of uint64)."""
    n, k1, k2 = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("n", "k1", "k2"))
    doc = b.column(b.schema.get_field_index("doc"))
    own = np.flatnonzero((n > 0) & doc.is_valid().to_numpy(zero_copy_only=False))
    own = own[np.lexsort((doc.fill_null(0).to_numpy()[own], n[own], k2[own], k1[own]))]
    new = np.ones(len(own), bool)
    new[1:] = (k1[own][1:] != k1[own][:-1]) | (k2[own][1:] != k2[own][:-1]) | (n[own][1:] != n[own][:-1])
    b = b.take(pa.array(own[new]))
    width = b.schema.field("bands").type.byte_width
    raw = np.frombuffer(b"".join(b.column(b.schema.get_field_index("bands")).to_pylist()), "<u2").reshape(len(b), width // 6, 3)
    wide = np.zeros((len(b), width // 6, 4), "<u2")
    wide[:, :, :3] = raw
    return b, wide.view("<u8").reshape(len(b), width // 6)


def _meet(t: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """Which 48-bit hashes more than one chunk has."""
    every = np.zeros((len(column(t, "one")) // 6, 4), "<u2")
    every[:, :3] = np.frombuffer(column(t, "one"), "<u2").reshape(-1, 3)
    every = every.view("<u8").ravel()
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    out = np.zeros(len(every), np.uint8)
    out[order[1:][same]] = 1
    out[order[:-1][same]] = 1
    return out, t.column("n").to_numpy().astype(np.int64), 1


def _shared(described: Corpus) -> DataFrame:
    """(doc, n, k1, k2, buckets): of each class of each chunk, the band hashes that occur more than once."""
    shards = described.shards

    def ask(b, _):
        h = np.unique(_buckets(b)[1])
        return [Sent(1, h << np.uint64(16), shards).put("one", np.ascontiguousarray(h.astype("<u8").view("<u2").reshape(-1, 4)[:, :3]))]

    def tell(b, given):
        own, h = _buckets(b)
        names, index, count = np.unique(h, return_inverse=True, return_counts=True)
        more = (codes(given, 1, Sent(1, names << np.uint64(16), shards).n).astype(bool) | (count > 1))[index.reshape(h.shape)] if len(names) else np.zeros(h.shape, bool)
        some = more.any(1)
        own, h, more = own.filter(pa.array(some)), h[some], more[some]
        ends = np.concatenate(([0], np.cumsum(more.sum(1))))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[more].astype(np.int64)))
        return pa.RecordBatch.from_arrays([*(own.column(own.schema.get_field_index(c)) for c in ("doc", "n", "k1", "k2")), listed], ["doc", "n", "k1", "k2", "buckets"])

    return described.finish(tell, "doc long, n long, k1 long, k2 long, buckets array<bigint>", reply(described.ask(ask), _meet))


def _likely(described: Corpus, pairs: DataFrame, percent: int, coordinates: int, name: str) -> DataFrame:
    """Of pairs (doc, partner) those whose bits agree often enough."""
    words_ = -(-coordinates // 64)

    def bits(_, b: pa.RecordBatch) -> pa.RecordBatch:
        raw = b"".join(b.column(b.schema.get_field_index("bits")).to_pylist())
        x = np.zeros((len(b), 8 * words_), np.uint8)
        if len(b):
            x[:, : len(raw) // len(b)] = np.frombuffer(raw, np.uint8).reshape(len(b), -1)
        w = x.view("<i8")
        return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc")), *(pa.array(np.ascontiguousarray(w[:, k])) for k in range(words_))], ["doc", *(f"s{k}" for k in range(words_))])

    pairs = written(pairs, f"{name}-pairs")
    every = described.flat(bits, "doc long, " + ", ".join(f"s{k} long" for k in range(words_)))
    needed = pairs.select("doc").unionByName(pairs.select(F.col("partner").alias("doc"))).distinct()
    own = written(every.join(needed, "doc", "left_semi").distinct(), f"{name}-bits")
    other = own.select(F.col("doc").alias("partner"), *[F.col(f"s{k}").alias(f"t{k}") for k in range(words_)])
    differ = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"t{k}"))) for k in range(words_)), F.lit(0))
    return pairs.join(own, "doc").join(other, "partner").where(differ <= coordinates - least_agreement(percent, coordinates)).select("doc", "partner").distinct()


def _asked(pairs: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """(shard, doc, partners, chunk): which sets a shard needs, each once, and which of pairs (doc, partner) it holds them against. Every pair is in one shard.

    Pairs go to the shard of their family, the least document that the partner is paired with: where many documents are paired with each other a set is sent once and not with
    each pair. A family with more than SPREAD documents on a side is a grid of parts of both sides.
    """
    ends = pairs.select(F.col("partner").alias("u"), F.col("doc").alias("v")).unionByName(pairs.select(F.col("doc").alias("u"), F.col("partner").alias("v")))
    low = ends.groupBy("u").agg(F.min(F.least("u", "v")).alias("family")).withColumnRenamed("u", "partner")
    pairs = written(pairs.join(low, "partner"), f"{name}-families")
    grid = pairs.groupBy("family").agg(F.count_distinct("doc").alias("docs"), F.count_distinct("partner").alias("partners"))
    grid = written(grid.withColumns({"across": F.ceil(F.col("docs") / SPREAD), "down": F.ceil(F.col("partners") / SPREAD)}), f"{name}-grid")
    total = grid.agg(F.sum(F.expr("docs * down + partners * across"))).first()[0] or 0
    size = known.agg(F.avg("n")).first()[0] or 1
    shards = max(1, -(-int(6 * total * size) // SHARD))
    cell = [F.pmod(F.xxhash64(c), F.col(n)) for c, n in (("doc", "across"), ("partner", "down"))]
    sent = pairs.join(grid, "family").select("doc", "partner", F.pmod(F.xxhash64("family", *cell), F.lit(shards)).alias("shard"))
    asked = sent.unionByName(sent.select(F.col("partner").alias("doc"), F.lit(None).cast("long").alias("partner"), "shard").distinct())
    return asked.groupBy("shard", "doc").agg(F.collect_list("partner").alias("partners")).join(known.select("chunk", "doc").distinct(), "doc")


def _confirmed(corpus: Corpus, pairs: DataFrame, known: DataFrame, percent: int, name: str) -> DataFrame:
    """Of pairs (doc, partner) those whose sets are similar enough, as edges (a, b)."""
    asked = _asked(written(pairs, f"{name}-likely"), known, name)
    packed_rows = "shard long, doc long, partners array<bigint>, sets binary"
    fit = fitted(packed_rows)
    none = fit(pa.table({"shard": pa.array([], pa.int64()), "doc": pa.array([], pa.int64()), "partners": pa.array([], pa.list_(pa.int64())), "sets": pa.array([], pa.binary())}))

    def send(t: pa.Table, want: pa.Table) -> pa.Table:
        if not t.num_rows or not want.num_rows:
            return none
        b = opened(t.column("body")[0].as_py())
        ids = b.column(b.schema.get_field_index("doc_id")).cast(pa.int64())
        need = pc.is_in(ids, value_set=pc.unique(want.column("doc")))
        b, ids = b.filter(need), ids.filter(need).to_numpy(zero_copy_only=False)
        sets, at = shingles(b.column(b.schema.get_field_index("text")))
        packed = []
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            low = sets[x:y] >> np.uint64(16)  # 48 bits of each, still ascending
            packed.append((low & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (low >> np.uint64(32)).astype(np.uint16).tobytes())
        own: dict[int, list[int]] = {}
        for i, d in enumerate(ids.tolist()):
            own.setdefault(d, []).append(i)
        rows = [(k, i) for k, d in enumerate(want.column("doc").to_pylist()) for i in own.get(d, ())]
        x = [packed[i] for _, i in rows]
        out = fit(want.select(["shard", "doc", "partners"]).take(pa.array([k for k, _ in rows], pa.int64())).append_column("sets", pa.array(x, pa.binary()))).combine_chunks()
        ends = np.searchsorted(np.cumsum([len(y) for y in x]), np.arange(BATCH_BYTES, out.nbytes + BATCH_BYTES, BATCH_BYTES), "right").tolist()
        cuts = sorted({0, len(rows), *(min(len(rows), i + 1) for i in ends)})
        return pa.concat_tables([out.slice(i, j - i) for i, j in zip(cuts, cuts[1:] or [0], strict=False)])  # small batches: executors hold one at a time

    def unpacked(raw: bytes) -> np.ndarray:
        n = len(raw) // 6
        return np.frombuffer(raw, np.uint32, n).astype(np.uint64) | np.frombuffer(raw, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)

    def confirm(t: pa.Table) -> pa.Table:
        doc, raw, listed = (t.column(c).combine_chunks() for c in ("doc", "sets", "partners"))
        doc, partner = doc.to_numpy(), listed.flatten().to_numpy()
        center: dict[int, list[int]] = {}
        for i in np.flatnonzero(np.isin(doc, partner)).tolist():
            center.setdefault(int(doc[i]), []).append(i)
        found = []
        member = np.repeat(np.arange(len(doc)), pc.list_value_length(listed).to_numpy())
        order = np.argsort(partner, kind="stable")
        member, partner = member[order], partner[order]
        for group, p in zip(np.split(member, cut := np.flatnonzero(np.diff(partner)) + 1), partner[np.concatenate(([0], cut))].tolist() if len(partner) else [0], strict=True):
            for c in center.get(p, ()) if len(group) else ():
                own = unpacked(raw[c].as_py())
                for part in range(0, len(group), 256):
                    rows = group[part : part + 256]
                    sets = [unpacked(raw[i].as_py()) for i in rows.tolist()]
                    n = np.array([len(s) for s in sets], np.int64)
                    flat = np.concatenate(sets)
                    at = np.searchsorted(own, flat)
                    hit = own[np.minimum(at, len(own) - 1)] == flat if len(own) else np.zeros(len(flat), bool)
                    total = np.concatenate(([0], np.cumsum(hit)))
                    ends = np.cumsum(n)
                    both = total[ends] - total[ends - n]
                    ok = (both > 0) & (100 * both >= percent * (n + len(own) - both))
                    found.extend((int(doc[i]), p) for i in rows[ok].tolist())
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    made = corpus.rows.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(send, packed_rows)
    return written(made.groupBy("shard").applyInArrow(confirm, "a long, b long").distinct(), f"{name}-links")


def _components(corpus: Corpus, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(one row a document: chunk, doc, n, rep; components (node, component) of documents that are linked with others)."""
    described = _described(corpus, bands, rows)

    def plain(chunk: int, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), chunk, np.int64)), *(b.column(b.schema.get_field_index(c)) for c in ("doc", "n", "k1", "k2"))], ["chunk", "doc", "n", "k1", "k2"])

    known = described.flat(plain, "chunk long, doc long, n long, k1 long, k2 long")
    real = known.where("n > 0 AND doc IS NOT NULL")
    classes = written(real.groupBy("k1", "k2", "n").agg(F.min("doc").alias("rep")), "classes")
    spread = _shared(described).join(classes.withColumnRenamed("rep", "doc"), ["k1", "k2", "n", "doc"], "left_semi").select("doc", "n", F.explode("buckets").alias("bucket"))
    spread = written(spread, "spread")
    shared = spread.groupBy("bucket").agg(F.count("*").alias("m"), F.min("doc").alias("least")).where("m > 1").drop("m")
    members = written(spread.join(shared, "bucket").select("bucket", "least", "doc", "n"), "buckets")

    met = members.where("doc <> least").groupBy("doc", "least").agg(F.count("*").alias("c"))
    first = met.groupBy("doc").agg(F.max_by("least", F.struct("c", -F.col("least"))).alias("partner"))
    first = written(first, "first")
    linked = _confirmed(corpus, _likely(described, first, percent, bands * rows, "first"), real, percent, "first")

    # A doc_id on rows of different classes ties them together.
    ties = real.join(classes, ["k1", "k2", "n"]).where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    several = real.groupBy("doc").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc").alias("a"))
    ties = written(ties.join(several, "a", "left_semi").distinct(), "ties")
    now = connected_components(linked.unionByName(ties))

    labelled = members.drop("least").join(now.withColumnRenamed("node", "doc"), "doc", "left").withColumn("c", F.coalesce("component", "doc")).drop("component")
    open_ = labelled.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("bucket")
    labelled = written(labelled.join(open_, "bucket", "left_semi"), "open-buckets")
    sizes = labelled.groupBy("bucket", "c").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("bucket").agg(F.max_by("c", F.struct("m", "c")).alias("main"))
    strays = labelled.join(largest, "bucket").where("c <> main").select("bucket", F.col("doc").alias("u"), F.col("c").alias("cu"), F.col("n").alias("nu"), "main")
    near = (100 * F.least("n", "nu") >= percent * F.greatest("n", "nu")) & (F.col("c") != F.col("cu"))
    pairs = strays.join(labelled, "bucket").where(near & ((F.col("c") == F.col("main")) | (F.col("u") < F.col("doc"))))
    # The stray is the partner, whose set is sent once; the others come to it. Each unordered pair once, and none that the first round saw.
    pairs = pairs.select("u", "doc").groupBy(F.least("u", "doc").alias("x"), F.greatest("u", "doc").alias("y")).agg(F.min("u").alias("partner"))
    pairs = pairs.select("x", "y", "partner", F.when(F.col("partner") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("doc"))
    seen = first.select(F.least("doc", "partner").alias("x"), F.greatest("doc", "partner").alias("y"))
    pairs = pairs.join(seen, ["x", "y"], "left_anti").select("doc", "partner")
    second = _confirmed(corpus, _likely(described, pairs, percent, bands * rows, "second"), real, percent, "second")
    final = connected_components(now.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second))
    return known.join(classes, ["k1", "k2", "n"], "left"), final


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, chunk: int | None = None) -> DataFrame:
    """One row a document: (doc_id, n_shingles, component_id, kept). Sizes and links are of full sets; see the module's text."""
    corpus = Corpus(docs.select("doc_id", "text"), "near", chunk)
    known, final = _components(corpus, percent, bands, rows)
    c = known.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc")
    return c.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, chunk: int | None = None) -> DataFrame:
    """The rows of docs that are kept, one document of each component, with all their columns; texts aren't shuffled for it."""
    corpus = Corpus(docs, "near", chunk)
    known, final = _components(corpus, percent, bands, rows)
    c = known.where("doc IS NOT NULL").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    gone = c.where(F.coalesce("component", "rep", "doc") != F.col("doc")).select("chunk", "doc").distinct()
    fit = fitted(with_fields(docs))

    def drop(t: pa.Table, out: pa.Table) -> pa.Table:
        if not t.num_rows:
            return None
        b = opened(t.column("body")[0].as_py())
        if out.num_rows:
            ids = b.column(b.schema.get_field_index("doc_id")).cast(pa.int64())
            b = b.filter(pc.invert(pc.fill_null(pc.is_in(ids, value_set=out.column("doc").combine_chunks()), False)))
        return fit(pa.Table.from_batches([b]))

    return corpus.rows.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(drop, with_fields(docs))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(text_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM inter JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM reach r JOIN both_ways l ON r.b = l.x),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN comp ON a = d.doc_id
"""
