"""Substring dedup over bytes: suffix arrays of shards by external induced sorting.

Every 50-byte string that also starts in a document with a smaller id makes the bytes that it covers go. Each window belongs to its minimizer, the GRAM-byte
string in it with the smallest hash, leftmost among equals, which depends on the window's bytes only: equal windows have equal minimizers, so shards by
minimizer are independent. The windows of one minimizer occurrence lie side by side; their bytes are a *run* (up to 2 * width - GRAM bytes).

Plan (see exchange): (1) texts are written in chunks. (2) Each chunk sends its distinct runs as hashes: minimizer, run, smallest doc_id, and learns which
runs a smaller document has (all their windows go), and which minimizers have other runs too. (3) Of the latter only the distinct runs, with their smallest
document, are sent as bytes; their shard sorts all suffixes by external induced sorting (see induced) and finds, from common prefixes of neighbours, the windows
that a smaller document has. Runs of a minimizer with more than HOT runs, which no shard could hold, are sent as hashes of single windows instead, spread
by those. Minimizers with more than CROWDED distinct runs in any chunk (a phrase that a large share of all texts holds) are found in a pass before (2) and take that way at once. (4) The chunk removes bytes. Texts are shuffled at no point; a copied passage sends nothing but its hashes.

Whole texts can't be sorted as one suffix array on a cluster without moving each suffix with its next 50 bytes; the reduction to runs gives the same result.

Cases: null and empty texts have no bytes. A null doc_id is smaller than every id. Rows that repeat a doc_id aren't smaller than each other. Bytes are removed without
regard to characters, so what is kept is binary. Texts of any length are worked on in blocks of BLOCK bytes; what is held for the whole of a chunk is a few bytes
for each byte. Columns of the input stay, but for kept, n_bytes, n_removed and n_spans, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import NULL_ID, Hasher, buffers, mix, padded, spans, text_table, with_fields, written
from attesta.llm.exchange import Corpus, Sent, codes, column, ids_of, opened, reply, sums
from attesta.llm.induced import repeated_windows

WIDTH, GRAM = 50, 20
#: Distinct runs of one minimizer that a shard sorts.
HOT = 50_000
#: Distinct runs of one minimizer in one chunk from which it is settled by single windows throughout, and the most minimizers for which that is so.
CROWDED, MOST_CROWDED = 64, 1 << 20
#: About 100 bytes of memory go with each byte of a shard's runs.
SHARD_BYTES = 12 << 20
#: Windows whose minimizers are found at once.
BLOCK = 1 << 18
_ONE, _TWO = Hasher(31), Hasher(32)


class _Chunk:
    """Runs of one chunk, and their distinct ones (groups) in order of hash."""

    def __init__(self, batch: pa.RecordBatch, width: int, gram: int, crowded: np.ndarray | None = None):
        data, self.off = buffers(batch.column(batch.schema.get_field_index("text")))
        self.raw, self.wide = padded(data)
        self.ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        self.width, self.size = width, len(data)
        parts = [self._runs(p, min(p + BLOCK, self.size - width + 1), gram) for p in range(0, self.size - width + 1, BLOCK)]
        self.lo, count, one, two = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, k) for k in (np.int64, np.int32, np.uint64, np.uint64))
        del parts
        self.hi = self.lo + count
        self.row = (np.searchsorted(self.off, self.lo, "right") - 1).astype(np.int32)
        order = np.argsort(one, kind="stable")
        one, two = one[order], two[order]
        same = one[1:] == one[:-1]
        if (same & (two[1:] != two[:-1])).any():
            again = np.lexsort((two, one))
            order, one, two = order[again], one[again], two[again]
        new = np.ones(len(order), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        head = np.flatnonzero(new)
        self.one, self.two = one[head], two[head]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        own = self.ids[self.row]
        self.least = np.minimum.reduceat(own[order], head) if len(head) else np.zeros(0, np.int64)
        self.doc = own
        # one run of each group that is in the group's smallest document
        self.some = np.zeros(len(head), np.int64)
        smallest = np.flatnonzero(own == self.least[self.group])
        self.some[self.group[smallest]] = smallest

        none = crowded is None or not len(crowded)
        self.crowded = np.zeros(len(self.one), bool) if none else crowded[np.minimum(np.searchsorted(crowded, self.one), len(crowded) - 1)] == self.one
        self.plain = np.flatnonzero(~self.crowded)

    def _runs(self, p: int, q: int, gram: int) -> tuple[np.ndarray, ...]:
        """Of the windows that begin in p..q: first window of each run, windows after it, hash of its minimizer, hash of its bytes."""
        width, want = self.width, self.width - gram + 1
        h = _ONE.every(self.wide[p:], q - p + want - 1, gram)
        # 32 bits of hash over 32 of position: the smallest hash, leftmost among equals
        m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= want:
            m, size = np.minimum(m[:-size], m[size:]), 2 * size
        if want > size:
            m = np.minimum(m[: len(m) - (want - size)], m[want - size :])
        owner = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del m
        r0, r1 = np.searchsorted(self.off, p, "right") - 1, np.searchsorted(self.off, q, "left")
        lo, hi = np.maximum(self.off[r0:r1], p), np.minimum(self.off[r0 + 1 : r1 + 1] - width + 1, q)  # windows that lie in one text
        edge = np.zeros(q - p + 1, np.int8)
        full = hi > lo
        edge[lo[full] - p] += 1
        edge[hi[full] - p] -= 1
        ok = np.cumsum(edge[:-1], dtype=np.int8) > 0
        moved = owner[1:] != owner[:-1]
        touch = ok[1:] & ok[:-1] & ~moved  # windows of two texts don't touch
        begin, end = ok.copy(), ok
        begin[1:] &= ~touch
        end[:-1] &= ~touch
        lo, hi = np.flatnonzero(begin), np.flatnonzero(end)
        a = owner[lo]
        run = _TWO.ranges(self.raw, self.wide, lo + p, hi + p + width)
        run = mix(run ^ mix((a - lo).astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        return lo + p, (hi - lo).astype(np.int32), mix(h[a]) >> np.uint64(16), run  # minimizers are small hashes: scrambled, they spread evenly over shards

    def many(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(minimizer, distinct runs) of those with more than least runs."""
        one, n = np.unique(self.one, return_counts=True)
        return one[n > least], n[n > least]

    def sent(self, kind: int, groups: np.ndarray, shards: int) -> Sent:
        """Groups, which ascend by minimizer, by the shards of their minimizers."""
        return Sent(kind, self.one[groups] << np.uint64(16), shards)

    def flags(self, given: dict, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By group: a smaller document has the run; to be sent as bytes; to be sent as windows."""
        state = np.zeros(len(self.one), np.uint8)
        state[self.plain] = codes(given, 1, self.sent(1, self.plain, shards).n, 2)
        return state == 1, state == 2, (state == 3) | self.crowded

    def windows(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of each window of the groups' sample runs, windows by group)."""
        r = self.some[groups]
        n = self.hi[r] - self.lo[r] + 1
        return spans(self.lo[r], n), n

    def hashed(self, groups: np.ndarray):
        """Windows of hot groups in order of hash: (order, first hash, second hash, id)."""
        at, n = self.windows(groups)
        one = _ONE.ranges(self.raw, self.wide, at, at + self.width)
        two = (_TWO.ranges(self.raw, self.wide, at, at + self.width) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(one, kind="stable")
        return order, one[order], two[order], np.repeat(self.least[groups], n)[order]


def _six(a: np.ndarray) -> np.ndarray:
    """48 bits each, as rows of three 16-bit numbers."""
    return np.ascontiguousarray(a.astype("<u8").view("<u2").reshape(-1, 4)[:, :3])


def _of_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 4), "<u2")
    out[:, :3] = np.frombuffer(raw, "<u2").reshape(-1, 3)
    return out.view("<u8").ravel()


def _judge(hot: int):
    def judge(t: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        """For each run: 0 nothing to do, 1 a smaller document has it, 2 to be sent as bytes, 3 to be sent as windows."""
        one, two, ids = _of_six(column(t, "one")), np.frombuffer(column(t, "two"), np.uint64), ids_of(t)
        order = np.lexsort((two, one))
        a, b, i = one[order], two[order], ids[order]
        top = np.ones(len(a), bool)
        top[1:] = a[1:] != a[:-1]
        new = top.copy()
        new[1:] |= b[1:] != b[:-1]
        head = np.flatnonzero(new)
        least = np.minimum.reduceat(i, head)[np.cumsum(new) - 1]
        runs = np.bincount(np.cumsum(top)[head] - 1)[np.cumsum(top) - 1]
        out = np.zeros(len(a), np.uint8)
        out[order] = np.where(i > least, 1, np.where(runs > hot, 3, np.where(runs > 1, 2, 0)))
        return out, t.column("n").to_numpy().astype(np.int64), 2

    return judge


def _sort(width: int):
    def sort(t: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        """Which windows a smaller document has: of runs given as bytes (kind 2), or of windows given as hashes."""
        ids, n = ids_of(t), t.column("n").to_numpy().astype(np.int64)
        if t.column("kind")[0].as_py() == 2:
            sizes = np.frombuffer(column(t, "two"), np.uint16).astype(np.int64)
            gone = repeated_windows(np.frombuffer(column(t, "one"), np.uint8), sizes, ids, width)
            return gone.astype(np.uint8), sums(sizes - width + 1, n), 1
        one, two = np.frombuffer(column(t, "one"), np.uint64), np.frombuffer(column(t, "two"), np.uint32)
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        out = np.zeros(len(a), np.uint8)
        out[order] = ids[order] > np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        return out, n, 1

    return sort


def _crowded(corpus: Corpus, width: int, gram: int, least: int) -> np.ndarray:
    """Minimizers, ascending, that have more than least distinct runs in some chunk: the MOST_CROWDED with the most, which is all unless that is too much to broadcast."""
    def count(t: pa.Table) -> pa.Table:
        one, n = _Chunk(opened(t.column("body")[0].as_py()), width, gram).many(least)
        return pa.table({"one": pa.array(one.astype(np.int64)), "n": pa.array(n)})

    found = corpus.rows.groupBy("chunk").applyInArrow(count, "one long, n long").groupBy("one").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "one").limit(MOST_CROWDED).toArrow()
    return np.sort(rows.column("one").to_numpy().astype(np.uint64))


def dedup_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, crowded: int = CROWDED, chunk: int | None = None, shards: int | None = None) -> DataFrame:
    """docs with kept (binary), n_bytes, n_removed and n_spans (maximal removed stretches). See the module's text."""
    if not 8 <= gram <= width < 1 << 14:
        raise ValueError("gram must be from 8 to width")
    corpus = Corpus(docs, "bytes", chunk, shards, shard_bytes=SHARD_BYTES)
    shards = corpus.shards
    held = corpus.spark.sparkContext.broadcast(_crowded(corpus, width, gram, crowded))

    def ask_runs(batch, _):
        c = _Chunk(batch, width, gram, held.value)
        return [c.sent(1, c.plain, shards).put("one", _six(c.one[c.plain])).put("two", c.two[c.plain]).put_ids(c.least[c.plain])]

    known = written(reply(corpus.ask(ask_runs), _judge(hot)), "runs")

    def ask_windows(batch, given):
        c = _Chunk(batch, width, gram, held.value)
        _, as_bytes, as_windows = c.flags(given, shards)
        g = np.flatnonzero(as_bytes)
        r = c.some[g]
        size = c.hi[r] - c.lo[r] + width
        out = [c.sent(2, g, shards).put("one", c.raw[spans(c.lo[r], size)], np.cumsum(size)).put("two", size.astype(np.uint16)).put_ids(c.least[g])]
        if as_windows.any():
            _, one, two, ids = c.hashed(np.flatnonzero(as_windows))
            out.append(Sent(3, one, shards).put("one", one).put("two", two).put_ids(ids))
        return out

    found = reply(corpus.ask(ask_windows, known), _sort(width))
    names = [f for f in docs.columns if f.lower() not in {"kept", "n_bytes", "n_removed", "n_spans"}]

    def drop(batch, given):
        c = _Chunk(batch, width, gram, held.value)
        covered, as_bytes, as_windows = c.flags(given, shards)
        whole = covered[c.group] | (c.doc > c.least[c.group])
        starts, ends = [c.lo[whole]], [c.hi[whole] + width]
        # windows of the groups that were sent, in order of group, then of place in the run
        for kind, groups in ((2, np.flatnonzero(as_bytes)), (3, np.flatnonzero(as_windows))):
            if not len(groups):
                continue
            n = c.hi[c.some[groups]] - c.lo[c.some[groups]] + 1
            place = np.zeros(len(c.one), np.int64)
            place[groups] = np.cumsum(n) - n
            if kind == 2:
                gone = codes(given, 2, sums(n, c.sent(2, groups, shards).n)).astype(bool)
            else:
                order, one, _, _ = c.hashed(groups)
                gone = np.zeros(len(order), bool)
                gone[order] = codes(given, 3, Sent(3, one, shards).n).astype(bool)
            r = np.flatnonzero(~whole & (as_bytes if kind == 2 else as_windows)[c.group])
            size = c.hi[r] - c.lo[r] + 1
            at = spans(c.lo[r], size)[gone[spans(place[c.group[r]], size)]]
            starts.append(at)
            ends.append(at + width)
        start, end = np.concatenate(starts), np.concatenate(ends)
        off = c.off
        if len(start):
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            head = np.ones(len(start), bool)  # stretches that touch are one, but for those of two texts
            head[1:] = (start[1:] > end[:-1]) | ((start[1:] == end[:-1]) & np.isin(start[1:], off))
            tail = np.append(head[1:], True)
            start, end = start[head], end[tail]
        row = np.searchsorted(off, start, "right") - 1
        n_removed = np.bincount(row, weights=end - start, minlength=len(off) - 1).astype(np.int64)
        count = np.bincount(row, minlength=len(off) - 1)
        change = np.zeros(c.size + 1, np.int8)
        change[start] += 1
        change[end] -= 1
        keep = np.cumsum(change[:-1], dtype=np.int8) == 0
        kept_at = np.concatenate(([0], np.cumsum(np.diff(off) - n_removed)))
        kept = pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(kept_at.astype(np.int32)), pa.py_buffer(c.raw[: c.size][keep])])
        arrays = [*[batch.column(batch.schema.get_field_index(x)) for x in names], kept, pa.array(np.diff(off)), pa.array(n_removed), pa.array(count)]
        return pa.RecordBatch.from_arrays(arrays, [*names, "kept", "n_bytes", "n_removed", "n_spans"])

    return corpus.finish(drop, with_fields(docs, ("kept", "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long")), known.unionByName(found))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_bytes(text_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
block AS (SELECT doc_id, k, substr(h, 512 * k + 1, 610) AS p FROM (SELECT doc_id, h, unnest(range(0, len(h) // 512 + 1)) AS k FROM d)),
win AS (SELECT doc_id, 256 * k + j AS i, substr(p, 2 * j - 1, 100) AS g FROM (SELECT doc_id, k, p, unnest(range(1, least(257, len(p) // 2 - 48))) AS j FROM block WHERE len(p) >= 100)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING count(*) > 1),
dup AS (SELECT w.doc_id, w.i FROM win w JOIN least l ON w.g = l.g WHERE w.doc_id > l.m),
cut AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM dup),
span AS (SELECT doc_id, n, min(i) AS a, max(i) + 49 AS b FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM cut) GROUP BY doc_id, n),
piece AS (SELECT s.doc_id, s.n, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - 1 - coalesce(lag(b) OVER w, 0))) AS x FROM span s JOIN d ON s.doc_id = d.doc_id WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.n)),
total AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans, max(b) AS e FROM span GROUP BY doc_id),
head AS (SELECT doc_id, string_agg(x, '' ORDER BY n) AS x FROM piece GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head.x, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN total t ON d.doc_id = t.doc_id LEFT JOIN head ON d.doc_id = head.doc_id
"""
