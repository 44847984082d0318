"""Substring dedup by words with difference-cover anchors.

Positions of a text whose number modulo PERIOD lies in COVER are anchors: for any two positions there is a shift below PERIOD that brings both onto
anchors. Two equal runs of ``width`` words thus share an aligned anchor, whose hash spans the width - PERIOD + 1 words that follow it. Only anchor
hashes, one position in three, are compared across the corpus first; windows around anchors that occur twice are then extended to full width
and compared by 96 bits, of two hashes that are independent from the bytes of the words on.

Plan (see exchange): (1) texts are written in chunks; (2) each chunk sends its distinct anchor hashes, and learns which of them other chunks have; (3) it sends the
distinct windows around repeated anchors with the smallest doc_id that holds each, and learns for which a smaller one exists elsewhere; (4) it drops the
words. Texts are shuffled at no point. Repeats within a chunk and within a document are settled in the chunk. Bytes of a chunk are worked on block by block; what is held
for the whole of it is some numbers a word.

Cases: null and empty texts have no words. A null doc_id is smaller than every id. Rows that repeat a doc_id are texts of their own of which none is
earlier than the other; within each of them the earlier start counts. Texts of fewer than ``width`` words keep all. Columns of the input stay, but for
text, which is the kept words joined by one space, n_words and n_removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import NULL_ID, Hasher, buffers, padded, spans, text_table, with_fields, words, written
from attesta.llm.exchange import Corpus, Sent, codes, column, ids_of, reply

WIDTH = 20
#: {0, 1, 3, 9} is a difference cover modulo 13: every difference modulo 13 is one of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ONE, _TWO = Hasher(91), Hasher(92)
#: Words whose hashes are made at once.
BLOCK = 1 << 17


class _Chunk:
    """Words, anchors and windows of one chunk."""

    def __init__(self, batch: pa.RecordBatch, width: int, period: int, cover: tuple[int, ...]):
        data, off = buffers(batch.column(batch.schema.get_field_index("text")))
        self.raw, self.wide = padded(data)
        self.start, self.end, self.first = words(data, off, _SPACE)
        self.ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        n = self.n = np.diff(self.first)
        self.row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.width, self.period = width, period
        self.span = width - period + 1
        place = np.arange(len(self.row)) - self.first[self.row]
        rest = n[self.row] - place  # words from here to the end of the text
        inside = np.isin(np.arange(period), cover)
        self.window = rest >= width
        self.anchor = np.flatnonzero(inside[place % period] & (rest >= self.span) & (n[self.row] >= width))
        self.hashes: dict[int, np.ndarray] = {}

    def of(self, hasher: Hasher, size: int) -> np.ndarray:
        """Hash of the size words that begin at each word, running over ends of texts; blocks of words, hashed and joined one after another."""
        n = len(self.start)
        out = np.empty(max(0, n - size + 1), np.uint64)
        for a in range(0, len(out), BLOCK):
            b = min(a + BLOCK, len(out)) + size - 1
            out[a : b - size + 1] = hasher.windows(hasher.ranges(self.raw, self.wide, self.start[a:b], self.end[a:b]), size)
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes, index of each anchor's hash, count of each)."""
        return np.unique(self.of(_ONE, self.span)[self.anchor] if len(self.anchor) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)

    def repeated(self, given: dict, shards: int) -> np.ndarray:
        """Starts of the windows that have an anchor which occurs elsewhere too."""
        hashes, index, count = self.anchors()
        twice = codes(given, 1, Sent(1, hashes, shards).n).astype(bool) | (count > 1)
        at = np.zeros(len(self.row) + 1, np.int32)
        at[self.anchor[twice[index]] + 1] = 1
        sums = np.cumsum(at, dtype=np.int32)
        w = np.flatnonzero(self.window)
        return w[sums[w + self.period] > sums[w]]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order of at by hash, then row, then start; group of each in that order; first hash of each group, second, smallest doc_id)."""
        one = self.of(_ONE, self.width)[at] if len(at) else np.zeros(0, np.uint64)
        two = (self.of(_TWO, self.width)[at] >> np.uint64(32)).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        order = np.argsort(one, kind="stable")
        a, b = one[order], two[order]
        same = a[1:] == a[:-1]
        if (same & (b[1:] != b[:-1])).any():
            order = np.lexsort((at, two, one))
            a, b = one[order], two[order]
            same = a[1:] == a[:-1]
        new = np.ones(len(a), bool)
        new[1:] = ~(same & (b[1:] == b[:-1]))
        head = np.flatnonzero(new)
        least = np.minimum.reduceat(self.ids[self.row[at[order]]], head) if len(head) else np.zeros(0, np.int64)
        return order, np.cumsum(new) - 1, a[head], b[head], least


def _many(t: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """Which hashes more than one request has."""
    every = np.frombuffer(column(t, "one"), np.uint64)
    order = np.argsort(every, kind="stable")
    s = every[order]
    more = np.zeros(len(s), bool)
    more[1:] = s[1:] == s[:-1]
    more[:-1] |= more[1:]
    out = np.zeros(len(s), np.uint8)
    out[order] = more
    return out, t.column("n").to_numpy().astype(np.int64), 1


def _smaller(t: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """For which entries another request has a smaller id."""
    one, two, ids = np.frombuffer(column(t, "one"), np.uint64), np.frombuffer(column(t, "two"), np.uint32), ids_of(t)
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.zeros(len(a), np.uint8)
    out[order] = ids[order] > np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out, t.column("n").to_numpy().astype(np.int64), 1


def dedup_windows(docs: DataFrame, width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, chunk: int | None = None, shards: int | None = None) -> DataFrame:
    """docs with the kept words as text, n_words and n_removed: words go that a window covers whose words also start earlier. See the module's text."""
    if width < period or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("cover must be a difference cover modulo period, and width at least period")
    corpus = Corpus(docs, "words", chunk, shards)
    shards = corpus.shards

    def ask_anchors(batch, _):
        hashes, _, _ = _Chunk(batch, width, period, cover).anchors()
        return [Sent(1, hashes, shards).put("one", hashes)]

    known = written(reply(corpus.ask(ask_anchors), _many), "anchors")

    def ask_windows(batch, given):
        c = _Chunk(batch, width, period, cover)
        _, _, one, two, least = c.windows(c.repeated(given, shards))
        return [Sent(2, one, shards).put("one", one).put("two", two).put_ids(least)]

    smaller = reply(corpus.ask(ask_windows, known), _smaller)
    names = [f for f in docs.columns if f.lower() not in {"text", "n_words", "n_removed"}]

    def drop(batch, given):
        c = _Chunk(batch, width, period, cover)
        at = c.repeated(given, shards)
        order, group, one, _, least = c.windows(at)
        elsewhere = codes(given, 2, Sent(2, one, shards).n).astype(bool)
        start = at[order]
        row = c.row[start]
        again = np.zeros(len(start), bool)  # an earlier start in the same row: rows ascend within a group, and starts within rows
        again[1:] = (group[1:] == group[:-1]) & (row[1:] == row[:-1])
        gone = start[again | elsewhere[group] | (c.ids[row] > least[group])]
        delta = np.zeros(len(c.row) + 1, np.int32)
        np.add.at(delta, gone, 1)
        np.add.at(delta, gone + width, -1)
        removed = np.cumsum(delta[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(removed)))
        n_removed = total[c.first[1:]] - total[c.first[:-1]]
        keep = ~removed
        length = c.end - c.start
        # every kept word with the byte before it, which then is made a space; the first of each row loses it
        size = np.where(keep, length + 1, 0)
        raw = np.concatenate((np.full(1, 32, np.uint8), c.raw))
        out = raw[spans(c.start[keep], size[keep])]  # in raw the byte before a word is at the word's start
        heads = np.cumsum(size[keep]) - size[keep]
        out[heads] = 32
        ends = np.concatenate(([0], np.cumsum(size)))
        blob = out.tobytes()
        texts = [blob[a + 1 : b] if b > a else b"" for a, b in zip(ends[c.first[:-1]].tolist(), ends[c.first[1:]].tolist(), strict=True)]
        arrays = [*[batch.column(batch.schema.get_field_index(x)) for x in names], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(c.n, pa.int64()), pa.array(n_removed, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, [*names, "text", "n_words", "n_removed"])

    return corpus.finish(drop, with_fields(docs, ("text", "string"), ("n_words", "long"), ("n_removed", "long")), known.unionByName(smaller))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_windows(text_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM ranked WHERE n > 1),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d)
SELECT d.doc_id, coalesce(any_value(len(d.w)), 0)::BIGINT AS n_words, count(g.i)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(word.x, ' ' ORDER BY word.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN word ON d.doc_id = word.doc_id LEFT JOIN gone g ON word.doc_id = g.doc_id AND word.i = g.i GROUP BY d.doc_id
"""
