"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every window of every document.

Words are maximal runs of ASCII letters and digits and of non-ASCII characters, with A-Z lower-cased. A window is ``width`` consecutive words of an
item; an item with fewer words, but not none, is one window. Documents are scanned as flat byte arrays: word hashes and window hashes come from steps that join
two hashes, a bit table refuses nearly all windows, a binary search most of the rest, and what is left is compared word by word. Windows that several items
share are one entry with a list of items, so a template in many items costs no more at each occurrence.

Plan: no shuffle. The benchmark is measured first and goes out in blocks of about BLOCK_BYTES of text, by a hash of item and text; each block is one pass over the
documents as they stream by (passes are chained, the text is read once), so what a task holds of any benchmark is bounded.

Cases: null text has no words. Items that repeat an item_id count once. Items with a null id hit words, but aren't listed. Empty tables are fine: without
items nothing is hit. Texts of any length are scanned whole. Columns of the input stay, but for n_words, n_hit, items and contaminated, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import Hasher, buffers, chunks, free_name, padded, spans, text_table, tune, with_fields, words

WIDTH = 10
#: Benchmark text in one broadcast: about 5 bytes a window and byte of text follow from it.
BLOCK_BYTES = 4 << 20
_TABLE_BITS = 22

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.ones(256, bool)
_SPACE[48:58] = _SPACE[97:123] = _SPACE[65:91] = _SPACE[128:] = False
_HASH = Hasher(11)


def _words(column: pa.Array):
    """(folded bytes, offsets, word starts, word ends, first word of each text, word hashes)."""
    data, off = buffers(column)
    raw, wide = padded(_FOLD[data])
    data = raw[: len(data)]
    s, e, first = words(data, off, _SPACE)
    return data, off, s, e, first, _HASH.ranges(raw, wide, s, e)


class Windows:
    """The distinct windows of one block of items, by hash, with the items that hold each."""

    def __init__(self, ids: list[str | None], texts: list[str | None], width: int):
        data, _, s, e, first, h = _words(pa.array(texts, pa.string()))
        n = np.diff(first)
        each = np.minimum(n, width)
        count = np.where(n > 0, n - each + 1, 0)
        item = np.repeat(np.arange(len(n)), count)
        start = spans(first[:-1], count)
        size = each[item]
        self.sizes = sorted(set(size.tolist()))
        hashes = np.zeros(len(start), np.uint64)
        for k in self.sizes:
            own = size == k
            hashes[own] = _HASH.windows(h, k)[start[own]]
        lengths = e - s
        self.ids, self.width = ids, width
        self.words = data[spans(s, lengths)].tobytes()  # words end to end; a window is a slice and its words' lengths
        self.ends, self.lengths = np.cumsum(lengths), lengths.astype(np.int32)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.start, self.size = hashes[order], start[order], size[order].astype(np.int16)
        item = item[order]
        # equal windows lie in one stretch of equal hashes; the first of each stands for them
        head, known = np.zeros(len(order), np.int64), {}
        alone = np.ones(len(order), bool)
        alone[1:] &= self.hashes[1:] != self.hashes[:-1]
        alone[:-1] &= self.hashes[1:] != self.hashes[:-1]
        head[alone] = np.flatnonzero(alone)
        for k in np.flatnonzero(~alone).tolist():
            head[k] = known.setdefault((int(self.hashes[k]), self.text(k)), k)
        by = np.argsort(head, kind="stable")
        own, self.at = np.unique(head[by], return_index=True)
        self.at, self.item = np.append(self.at, len(by)), item[by]
        self.hashes, self.start, self.size = self.hashes[own], self.start[own], self.size[own]
        bits = np.zeros(1 << _TABLE_BITS, bool)
        bits[self.hashes >> np.uint64(64 - _TABLE_BITS)] = True
        self.bits = np.packbits(bits)

    def opened(self) -> Windows:
        self.table = np.unpackbits(self.bits).view(bool)
        return self

    def text(self, k: int) -> tuple[bytes, bytes]:
        a, n = int(self.start[k]), int(self.size[k])
        at = int(self.ends[a]) - int(self.lengths[a])
        return self.words[at : int(self.ends[a + n - 1])], self.lengths[a : a + n].tobytes()

    def names(self, found: set[int]) -> list[str]:
        """The ids, sorted, of the items that hold any of the windows found."""
        items = np.unique(np.concatenate([self.item[self.at[k] : self.at[k + 1]] for k in found])) if found else []
        return sorted({self.ids[i] for i in items if self.ids[i] is not None})

    def find(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into hashes, window) candidates of that many words."""
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - _TABLE_BITS)])
        lo, hi = np.searchsorted(self.hashes, hashes[at], "left"), np.searchsorted(self.hashes, hashes[at], "right")
        found, n = np.repeat(at, hi - lo), spans(lo, hi - lo)
        ok = self.size[n] == size
        return found[ok], n[ok]


def _cut(text: bytes, s: np.ndarray, e: np.ndarray, hit: np.ndarray) -> bytes:
    """text without the stretch from the first to the last word of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    out, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(text[at : s[a]])
        at = int(e[b - 1])
    out.append(text[at:])
    return b"".join(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, action: str = "mark") -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of a window), items (array of item_ids as strings, sorted) and contaminated.

    action: mark only adds these columns; drop also drops contaminated documents; spans cuts the hit words out of the text.
    """
    spark = docs.sparkSession
    tune(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-int(size) // BLOCK_BYTES))
    blocks = []
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        rows = block.collect()  # about BLOCK_BYTES
        blocks.append(spark.sparkContext.broadcast(Windows([r["item_id"] for r in rows], [r["text"] for r in rows], width)))

    gone, hits = {"n_words", "n_hit", "items", "contaminated", "text"}, free_name(docs, "hits")
    names = [c for c in docs.columns if c.lower() not in gone]

    def scan(held, head: bool, last: bool):
        def run(batches):
            w = held.value.opened()
            for b in chunks(batches):
                n_docs = b.num_rows
                column = b.column(b.schema.get_field_index("text"))
                data, off, s, e, first, h = _words(column)
                n_words = np.diff(first)
                edge = np.zeros(len(s) + 1, np.int32)
                found: list[set] = [set() for _ in range(n_docs)]
                earlier = [[]] * n_docs
                if not head:
                    old, at = buffers(b.column(b.schema.get_field_index(hits)))
                    bits = [np.unpackbits(old[x:y])[:n] for x, y, n in zip(at[:-1], at[1:], n_words, strict=True)]
                    before = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)
                    earlier = b.column(b.schema.get_field_index("items")).to_pylist()
                else:
                    before = np.zeros(len(s), bool)
                for size in w.sizes:
                    at, k = w.find(_HASH.windows(h, size), size)
                    if not len(at):
                        continue
                    doc = np.searchsorted(first, at, "right") - 1
                    inside = at + size <= first[doc + 1]
                    for i, d, j in zip(at[inside].tolist(), doc[inside].tolist(), k[inside].tolist(), strict=True):
                        raw, lengths = w.text(j)
                        if (e[i : i + size] - s[i : i + size]).astype(np.int32).tobytes() == lengths and b"".join(data[x:y].tobytes() for x, y in zip(s[i : i + size], e[i : i + size], strict=True)) == raw:
                            edge[i] += 1
                            edge[i + size] -= 1
                            found[d].add(j)
                hit = (np.cumsum(edge[:-1]) > 0) | before
                listed = pa.array([sorted({*x, *w.names(y)}) if y else x for x, y in zip(earlier, found, strict=True)], pa.list_(pa.string()))
                base = [b.column(b.schema.get_field_index(c)) for c in names]
                if not last:
                    packed = pa.array([np.packbits(hit[x:y]).tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*base, column, packed, listed], [*names, "text", hits, "items"])
                    continue
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit = total[first[1:]] - total[first[:-1]]
                if action == "spans" and n_hit.any():
                    raw = buffers(column)[0].tobytes()
                    column = pa.array([_cut(raw[off[d] : off[d + 1]], s[x:y] - off[d], e[x:y] - off[d], hit[x:y]) if n_hit[d] else (None if not column[d].is_valid else raw[off[d] : off[d + 1]]) for d, (x, y) in enumerate(zip(first[:-1], first[1:], strict=True))], pa.binary()).cast(pa.string())
                out = pa.RecordBatch.from_arrays([*base, column, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), listed, pa.array(n_hit > 0)], [*names, "text", "n_words", "n_hit", "items", "contaminated"])
                yield out.filter(pa.array(n_hit == 0)) if action == "drop" else out

        return run

    out = docs.select(*[F.col(f"`{c}`") for c in names], "text")
    plain = out
    for k, held in enumerate(blocks):
        last = k == n_blocks - 1
        fields = (("text", "string"), ("n_words", "long"), ("n_hit", "long"), ("items", "array<string>"), ("contaminated", "boolean")) if last else (("text", "string"), (hits, "binary"), ("items", "array<string>"))
        out = out.mapInArrow(scan(held, k == 0, last), with_fields(plain, *fields))
    return out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(text_table(spark, sf_dir, "documents").select("doc_id", "text"), text_table(spark, sf_dir, "benchmark"))
    joined = F.array_join("items", ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
places AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places p ON d.doc_id = p.doc_id LEFT JOIN listed l ON d.doc_id = l.doc_id
"""
