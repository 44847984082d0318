"""Line dedup over sharded cuckoo filters that exact reference-count tables back.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. The exact table has, by 128-bit key hash, the number of documents
that hold the key and the largest doc_id among them. Keys of at least ``min_chars`` code points in at least ``min_docs`` documents are *hot*: their
lines go from all documents but that with the largest id.

Plan (see exchange): (1) texts are written in chunks. (2) Each chunk sends its distinct keys, each with its largest doc_ids (up to min_docs of them, enough to
tell how many distinct ones there are), packed, to the shard of the key's hash; a key that fills a third of all rows arrives there once a chunk. (3) A shard
makes the exact table of its keys and a cuckoo filter over the hot ones; keys that the filter refuses need no lookup, the others are looked up. Back go two bits
an entry: not hot, hot with the largest id here, or hot with a larger id elsewhere. (4) The chunk drops lines. Texts are shuffled at no point.

Incremental use: LineIndex keeps the tables and filters, takes documents in and lets go of them again.

Cases: null or empty text is one empty line. Rows that repeat a doc_id are one document for the count, and all rows that hold the largest id keep their lines. A row
without doc_id is a document of its own, smaller than every id. A key that repeats in a document counts once. Empty tables give empty results. Texts of any length
are taken whole. Columns of the input stay, whatever their names, but for text, n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import BROADCAST_BYTES, NULL_ID, SPACE, buffers, mix, text_table, tune, with_fields, written
from attesta.llm.exchange import Corpus, Sent, codes, column, ids_of, reply

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys that one filter shard is made for.
SHARD_KEYS = 1 << 20
#: Text bytes of a shard of the batch operator: some 200,000 lines, and as many keys at most.
SHARD_BYTES = 24 << 20
#: Appended tables of an index that are put together again.
SEGMENTS = 16


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, partial-key cuckoo hashing; inserts and deletes work on whole arrays."""

    SLOTS = 4

    def __init__(self, capacity: int = 1024, table: np.ndarray | None = None):
        n = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.84)))))
        self.table = np.zeros((n, self.SLOTS), np.uint16) if table is None else table

    @property
    def mask(self) -> np.uint64:
        return np.uint64(len(self.table) - 1)

    def _place(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = (lo.astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        return fp, (mix(hi.astype(np.uint64)) & self.mask).astype(np.int64)

    def _other(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (mix(fp.astype(np.uint64)) & self.mask).astype(np.int64)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fp, a = self._place(hi, lo)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[self._other(fp, a)] == fp[:, None]).any(1)

    def _fill(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put what fits into free slots of the buckets; the mask of what didn't."""
        order = np.argsort(at, kind="stable")
        b = at[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        free = self.table[b] == 0
        fits = rank < free.sum(1)
        slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
        self.table[b[fits], slot] = fp[order[fits]]
        left = np.ones(len(fp), bool)
        left[order[fits]] = False
        return left

    def insert(self, hi: np.ndarray, lo: np.ndarray, rounds: int = 400) -> bool:
        """Insert keys that are not held yet (the exact table knows). False: too full, make a larger one from the exact table."""
        fp, at = self._place(hi, lo)
        rng = np.random.default_rng(len(fp))
        left = self._fill(fp, at)
        fp, at = fp[left], self._other(fp[left], at[left])
        for _ in range(rounds):
            if not len(fp):
                return True
            left = self._fill(fp, at)
            fp, at = fp[left], at[left]
            _, one = np.unique(at, return_index=True)  # one eviction a bucket and round
            slot = rng.integers(0, self.SLOTS, len(one))
            out = self.table[at[one], slot].copy()
            self.table[at[one], slot] = fp[one]
            fp[one] = out
            at[one] = self._other(out, at[one])
        return not len(fp)

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Remove one fingerprint for each key; keys must be held."""
        fp, a = self._place(hi, lo)
        b = self._other(fp, a)
        while len(fp):
            at = np.where((self.table[a] == fp[:, None]).any(1), a, b)
            _, one = np.unique(at, return_index=True)  # one key a bucket and round
            hit = self.table[at[one]] == fp[one, None]
            held = hit.any(1)
            self.table[at[one[held]], hit[held].argmax(1)] = 0
            rest = np.ones(len(fp), bool)
            rest[one] = False
            fp, a, b = fp[rest], a[rest], b[rest]

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy())

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        n = len(hi)
        while not (f := cls(n)).insert(hi, lo):
            n *= 2
        return f


def _keys(data: bytes, min_chars: int) -> list[bytes]:
    """The key hash of each line, b"" for lines that are too short to count."""
    out = []
    for line in data.split(b"\n"):
        k = line.strip(SPACE)
        if len(k) < min_chars or (len(k) < 4 * min_chars and not k.isascii() and len(k.decode("utf-8", "replace")) < min_chars):
            out.append(b"")
        else:
            out.append(xxhash.xxh3_128_digest(k.lower()))
    return out


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, off = buffers(column)
    raw = data.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield raw[a:b]


def _split(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def shard_of(n_shards: int):
    return F.pmod(F.col("hi"), F.lit(n_shards))


class _Lines:
    """The long lines of a chunk: their text, place and key."""

    def __init__(self, batch: pa.RecordBatch, min_chars: int, most: int):
        self.ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        self.texts = list(_texts(batch.column(batch.schema.get_field_index("text"))))
        keys, row, place = [], [], []
        for i, text in enumerate(self.texts):
            for j, k in enumerate(_keys(text, min_chars)):
                if k:
                    keys.append(k)
                    row.append(i)
                    place.append(j)
        self.row, self.place = np.array(row, np.int64), np.array(place, np.int64)
        hi, lo = (x.view(np.uint64) for x in _split(keys))
        order = np.lexsort((lo, hi))
        new = np.ones(len(order), bool)
        new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
        self.key = np.empty(len(order), np.int64)
        self.key[order] = np.cumsum(new) - 1
        self.hi, self.lo = hi[order[new]], lo[order[new]]
        # of each key the largest distinct ids, most at most; rows without id are distinct
        own = self.ids[self.row]
        order = np.lexsort((self.row, -1 - own, self.key))  # -1 - x falls as x rises and doesn't overflow
        k, d, r = self.key[order], own[order], self.row[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | ((d[1:] == NULL_ID) & (r[1:] != r[:-1]))
        k, d = k[fresh], d[fresh]
        some = np.arange(len(k)) - np.searchsorted(k, k) < most
        self.of, self.id = k[some], d[some]
        self.head = np.searchsorted(self.of, np.arange(len(self.hi)))

    def sent(self, shards: int) -> Sent:
        return Sent(1, self.hi[self.of], shards).put("one", np.stack((self.hi[self.of], self.lo[self.of]), 1)).put_ids(self.id)


def _hot(min_docs: int):
    def hot(t: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        """For each (key, id): 0 the key isn't hot, 1 it is and the id is the largest, 2 it is and another id is larger."""
        both, ids = np.frombuffer(column(t, "one"), np.uint64).reshape(-1, 2), ids_of(t)
        order = np.lexsort((ids, both[:, 1], both[:, 0]))
        k, d = both[order], ids[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]).any(1)
        head = np.flatnonzero(new)
        fresh = new.copy()
        fresh[1:] |= (d[1:] != d[:-1]) | (d[1:] == NULL_ID)
        # the exact table: hash, documents, largest id
        count, top, keys = np.add.reduceat(fresh.astype(np.int64), head), np.maximum.reduceat(d, head), k[head]
        f = CuckooFilter.of(*(keys[count >= min_docs, i].view(np.int64) for i in (0, 1)))
        at = np.flatnonzero(f.contains(*(np.ascontiguousarray(k[:, i]).view(np.int64) for i in (0, 1))))
        own = (np.cumsum(new) - 1)[at]
        out = np.zeros(len(k), np.uint8)
        out[order[at]] = np.where(count[own] < min_docs, 0, np.where(d[at] == top[own], 1, 2))
        return out, t.column("n").to_numpy().astype(np.int64), 2

    return hot


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, chunk: int | None = None, shards: int | None = None) -> DataFrame:
    """docs with the kept text and n_lines, n_dropped. See the module's text."""
    corpus = Corpus(docs, "lines", chunk, shards, shard_bytes=SHARD_BYTES)
    shards = corpus.shards
    names = [c for c in docs.columns if c.lower() not in {"n_lines", "n_dropped", "text"}]

    def keep(b: pa.RecordBatch, given: dict) -> pa.RecordBatch:
        c = _Lines(b, min_chars, min_docs)
        state = codes(given, 1, c.sent(shards).n, 2)[c.head] if len(c.hi) else np.zeros(0, np.uint8)
        most = c.id[c.head] if len(c.hi) else c.id
        gone = (state[c.key] == 2) | ((state[c.key] == 1) & (c.ids[c.row] < most[c.key])) if len(c.key) else np.zeros(0, bool)
        out: dict[int, set[int]] = {}
        for i, j in zip(c.row[gone].tolist(), c.place[gone].tolist(), strict=True):
            out.setdefault(i, set()).add(j)
        kept = list(c.texts)
        for i, js in out.items():
            kept[i] = b"\n".join([x for j, x in enumerate(c.texts[i].split(b"\n")) if j not in js])
        lines = np.array([t.count(b"\n") + 1 for t in c.texts], np.int64)
        dropped = np.bincount(c.row[gone], minlength=len(kept)).astype(np.int64)
        arrays = [*(b.column(b.schema.get_field_index(x)) for x in names), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines), pa.array(dropped)]
        return pa.RecordBatch.from_arrays(arrays, [*names, "text", "n_lines", "n_dropped"])

    replies = reply(corpus.ask(lambda b, _: [_Lines(b, min_chars, min_docs).sent(shards)]), _hot(min_docs))
    return corpus.finish(keep, with_fields(docs, ("text", "string"), ("n_lines", "long"), ("n_dropped", "long")), replies)


class LineIndex:
    """Incremental line dedup: tables in the shared folder and one filter per shard, reversible by deleting documents.

    postings: (hi, lo, rid, n), a log of appended tables, n = 1 a document and key or, for a deletion, -1; their sum is the exact reference count. A change reads the
    log for its own keys alone: what it joins and sums is in proportion to the change, not to the index. A key enters its shard's filter with its first
    document and leaves it with its last one; shards double when they hold more than SHARD_KEYS keys on average. Inserting a document twice counts it twice;
    deleting one that was never inserted raises nothing and leaves the tables as they were.
    """

    def __init__(self, spark: SparkSession, n_shards: int = 1, min_chars: int = MIN_CHARS):
        tune(spark)
        self.spark, self.n_shards, self.min_chars = spark, n_shards, min_chars
        self.segments = [spark.createDataFrame([], "hi long, lo long, rid long, n long")]
        self.filters = spark.createDataFrame([], "shard long, keys long, filter binary")

    @property
    def postings(self) -> DataFrame:
        out = self.segments[0]
        for s in self.segments[1:]:
            out = out.unionByName(s)
        return out

    def _rows(self, docs: DataFrame) -> DataFrame:
        least = self.min_chars

        def rows(batches):
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                    own = list({k for k in _keys(text, least) if k})
                    hi, lo = _split(own)
                    yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(np.full(len(hi), NULL_ID if doc is None else doc, np.int64))], ["hi", "lo", "rid"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "hi long, lo long, rid long")

    @staticmethod
    def _live(rows: DataFrame) -> DataFrame:
        return rows.groupBy("hi", "lo", "rid").agg(F.sum("n").alias("n")).where("n > 0")

    def counts(self) -> DataFrame:
        """(hi, lo, n_docs, max_id) of the keys that documents hold now."""
        return self._live(self.postings).groupBy("hi", "lo").agg(F.sum("n").alias("n_docs"), F.max("rid").alias("max_id"))

    def _change(self, rows: DataFrame) -> None:
        rows = written(rows.groupBy("hi", "lo", "rid").agg(F.sum("n").alias("n")), "change")
        if not rows.head(1):
            return
        keys = rows.select("hi", "lo").distinct()
        size = rows.count()
        if 32 * size <= BROADCAST_BYTES:
            keys = F.broadcast(keys)
        old = self._live(self.postings.join(keys, ["hi", "lo"], "left_semi"))
        if rows.where("n < 0").head(1):  # only what is held can go
            held = old.withColumnRenamed("n", "m")
            rows = written(rows.join(held, ["hi", "lo", "rid"]).withColumn("n", -F.least(-F.col("n"), F.col("m"))).drop("m"), "change")
        before = old.groupBy("hi", "lo").agg(F.sum("n").alias("b"))
        delta = rows.groupBy("hi", "lo").agg(F.sum("n").alias("d"))
        changed = delta.join(before, ["hi", "lo"], "left").na.fill(0, ["b"]).where("(b = 0) <> (b + d = 0)").select(shard_of(self.n_shards).alias("shard"), "hi", "lo", (F.col("b") == 0).alias("added"))

        def update(key, old: pa.Table, new: pa.Table) -> pa.Table:
            hi, lo, added = (new.column(c).to_numpy(zero_copy_only=False) if c == "added" else new.column(c).to_numpy() for c in ("hi", "lo", "added"))
            n = (old.column("keys")[0].as_py() if old.num_rows else 0) + int(added.sum()) - int((~added).sum())
            f = CuckooFilter.from_bytes(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter(4 * max(1, len(hi)))
            f.delete(hi[~added], lo[~added])
            full = not f.insert(hi[added], lo[added])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "keys": pa.array([n], pa.int64()), "filter": pa.array([None if full else f.to_bytes()], pa.binary())})

        made = written(self.filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInArrow(update, "shard long, keys long, filter binary"), "filters")
        self.segments.append(written(rows.select("hi", "lo", "rid", "n"), "postings"))
        if len(self.segments) > SEGMENTS:
            self.segments = [written(self._live(self.postings).select("hi", "lo", "rid", "n"), "postings")]
        total = made.agg(F.sum("keys")).first()[0] or 0
        if total > SHARD_KEYS * self.n_shards:
            while total > SHARD_KEYS * self.n_shards:
                self.n_shards *= 2
            made = written(self._built(self.counts()), "filters")
        elif made.where("filter IS NULL").head(1):  # a shard outgrew its table: make it again, larger, from the exact table
            full = made.where("filter IS NULL").select("shard")
            again = self._built(self.counts().withColumn("shard", shard_of(self.n_shards)).join(full, "shard", "left_semi"))
            made = written(made.where("filter IS NOT NULL").unionByName(again), "filters")
        self.filters = made

    def _built(self, counts: DataFrame) -> DataFrame:
        def build(table: pa.Table) -> pa.Table:
            f = CuckooFilter.of(table.column("hi").to_numpy(), table.column("lo").to_numpy())
            return pa.table({"shard": table.column("shard")[:1], "keys": pa.array([table.num_rows], pa.int64()), "filter": pa.array([f.to_bytes()], pa.binary())})

        return counts.select(shard_of(self.n_shards).alias("shard"), "hi", "lo").groupBy("shard").applyInArrow(build, "shard long, keys long, filter binary")

    def insert(self, docs: DataFrame) -> None:
        self._change(self._rows(docs).withColumn("n", F.lit(1).cast("long")))

    def delete(self, docs: DataFrame) -> None:
        self._change(self._rows(docs).withColumn("n", F.lit(-1).cast("long")))

    def maybe_seen(self, docs: DataFrame) -> DataFrame:
        """(rid, hi, lo) of the lines of docs that the filters pass: all that are held, and few others. Distinct keys go to their shard; no filter is broadcast."""
        rows = written(self._rows(docs), "asked")

        def probe(key, old: pa.Table, new: pa.Table) -> pa.Table:
            new = new.select(["hi", "lo"])
            if not old.num_rows or not new.num_rows:
                return new.slice(0, 0)
            return new.filter(pa.array(CuckooFilter.from_bytes(old.column("filter")[0].as_py()).contains(new.column("hi").to_numpy(), new.column("lo").to_numpy())))

        keys = rows.select("hi", "lo").distinct().withColumn("shard", shard_of(self.n_shards))
        passed = self.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(probe, "hi long, lo long")
        return rows.join(passed, ["hi", "lo"], "left_semi").select("rid", "hi", "lo")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(text_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM split),
keyed AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, h.top IS NOT NULL AND k.doc_id < h.top AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
