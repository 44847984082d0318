"""Kernels and exchanges of the two span operators: texts of regular build, long texts in blocks, replies."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import byte_spans, common, exchange, near_dedup, word_windows
from tests.llm import brute


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


M, W = thue_morse(1024), thue_morse(1024, "b", "a")


@pytest.fixture(scope="module")
def regular(spark):
    """Words and windows on which polynomial hashes modulo 2**64 collide, and their like."""
    tail = " ".join(f"t{i}" for i in range(19))
    texts = [f"{M} {tail}", f"{W} {tail}", f"{M}{W}", f"{W}{M}", f"{M} x {tail}", " ".join([M, W] * 12), " ".join([W, M] * 12)]
    return list(enumerate(texts))


def test_hashes_of_regular_words_differ():
    for seed in (31, 32, 51, 52, 91, 92):
        h = common.Hasher(seed)
        raw, wide = common.padded(np.frombuffer((M + W + M).encode(), np.uint8))
        a, b, c = h.ranges(raw, wide, np.array([0, 1024, 2048]), np.array([1024, 2048, 3072]))
        assert a == c != b
        for size in (64, 128, 256):
            x = h.ranges(raw, wide, np.array([0, 1024]), np.array([size, 1024 + size]))
            assert x[0] != x[1]
        words = np.array([3, 5], np.uint64)[[bin(i).count("1") % 2 for i in range(1024)]]
        other = np.array([5, 3], np.uint64)[[bin(i).count("1") % 2 for i in range(1024)]]
        assert h.windows(words, 1024)[0] != h.windows(other, 1024)[0]


def test_hash_depends_on_content_only():
    h = common.Hasher(5)
    text = b"abcabcabcx" + b"q" * 300 + b"abcabcabcx" + b"q" * 300
    raw, wide = common.padded(np.frombuffer(text, np.uint8))
    at = np.array([0, 310, 3, 0, 0])
    x = h.ranges(raw, wide, at, at + np.array([310, 310, 3, 3, 4]))
    assert x[0] == x[1] and x[2] == x[3] != x[4]
    w = h.every(wide, len(text) - 19, 20)
    assert len(w) == len(text) - 19 and w[0] == w[310] and w[0] != w[1] and len(h.every(wide, -3, 20)) == 0
    v = h.windows(np.array([1, 2, 3, 1, 2, 3], np.uint64), 3)
    assert v[0] == v[3] and len(set(v.tolist())) == 3 and len(h.windows(np.zeros(2, np.uint64), 3)) == 0


def rows(df, *columns):
    return sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))


def test_regular_texts(spark, regular):
    df = spark.createDataFrame(regular, "doc_id long, text string")
    assert rows(byte_spans.dedup_bytes(df), "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)) == sorted(map(str, brute.byte_spans(regular)))
    assert rows(word_windows.dedup_windows(df), "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256)) == sorted(map(str, brute.word_windows(regular)))
    assert rows(near_dedup.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == sorted(map(str, brute.near(regular)))


@pytest.mark.parametrize("block", [60, 97, 1 << 10])
def test_blocks(spark, docs, docs_list, block, monkeypatch):
    """Chunks in blocks smaller than texts give what whole texts give."""
    r = random.Random(block)
    texts = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 400))) for _ in range(12)]
    texts += [texts[0] + texts[1], texts[2][:90] + texts[3], "ab" * 300, "x " * 200, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])

    def coverage():
        c = byte_spans._Chunk(batch, 50, 20)
        out = {}
        for lo, hi, g in zip(c.lo.tolist(), c.hi.tolist(), c.group.tolist(), strict=True):
            for w in range(lo, hi + 1):
                out[w] = int(c.one[g])
        return out

    whole = coverage(), word_windows._Chunk(batch, 20, 13, (0, 1, 3, 9)).of(word_windows._ONE, 20).tolist()
    monkeypatch.setattr(byte_spans, "BLOCK", block)
    monkeypatch.setattr(word_windows, "BLOCK", block)
    assert (coverage(), word_windows._Chunk(batch, 20, 13, (0, 1, 3, 9)).of(word_windows._ONE, 20).tolist()) == whole
    data = "".join(t or "" for t in texts)
    assert len(whole[0]) == sum(max(0, len(t or "") - 49) for t in texts) and len(data) > max(whole[0])


@pytest.mark.parametrize("width", [1, 2])
def test_requests_and_replies(width):
    r = np.random.default_rng(width)
    h = np.sort(r.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    sent = exchange.Sent(7, h, 64).put("one", h).put_ids(np.arange(500) - 3)
    assert len(sent.shard) <= 64 and (sent.n > 0).all() and sent.n.sum() == 500
    t = sent.table(9)
    assert np.frombuffer(exchange.column(t, "one"), np.uint64).tolist() == h.tolist() and exchange.ids_of(t).tolist() == list(range(-3, 497))
    code = r.integers(0, 1 << width, 500).astype(np.uint8)
    parts = [_reply(t.slice(k, 1), code[sent.first[k] : sent.first[k + 1]], width) for k in r.permutation(len(sent.shard)).tolist()]
    given = exchange.answers(pa.concat_tables(parts))
    assert exchange.codes(given, 7, sent.n, width).tolist() == code.tolist()
    assert exchange.codes({}, 7, [], width).tolist() == []


def _reply(t, code, width):
    class Rows:
        def groupBy(self, *_):
            return self

        def applyInArrow(self, f, _):
            return f(t)

    return exchange.reply(Rows(), lambda x: (code, x.column("n").to_numpy().astype(np.int64), width))


def test_wide_ids_and_long_requests():
    ids = np.array([common.NULL_ID, 5, 1 << 62])
    t = exchange.Sent(1, np.array([1, 2, 1 << 63], np.uint64), 2).put("one", np.frombuffer(b"abcdef", np.uint8), np.array([1, 3, 6])).put_ids(ids).table(0)
    assert exchange.ids_of(t).tolist() == ids.tolist() and t.column("one").to_pylist() == [b"abc", b"def"]
    both = pa.concat_tables([t, exchange.Sent(1, np.array([4], np.uint64), 2).put("one", np.frombuffer(b"z", np.uint8)).put_ids(np.array([77])).table(1)])
    assert exchange.ids_of(both).tolist() == [*ids.tolist(), 77]
