import gc
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import common, induced, near_dedup
from attesta.llm.line_dedup import CuckooFilter


def test_cuckoo_filter_holds_and_lets_go():
    r = np.random.default_rng(1)
    hi, lo = r.integers(-(1 << 62), 1 << 62, 20_000), r.integers(-(1 << 62), 1 << 62, 20_000)
    f = CuckooFilter.of(hi, lo)
    assert f.contains(hi, lo).all()
    other = r.integers(-(1 << 62), 1 << 62, 20_000)
    assert f.contains(other, lo[::-1].copy()).mean() < 0.01
    f.delete(hi[:500], lo[:500])
    assert f.contains(hi[500:], lo[500:]).all() and f.contains(hi[:500], lo[:500]).mean() < 0.05
    assert CuckooFilter.from_bytes(f.to_bytes()).contains(hi[500:], lo[500:]).all()


@pytest.mark.parametrize("budget", [0, 1 << 20])
def test_suffix_order_and_windows(budget):
    r = np.random.default_rng(2)
    for _ in range(80):
        strings = [r.integers(0, r.integers(1, 4), r.integers(3, 40)).astype(np.uint8) for _ in range(r.integers(1, 6))]
        text = np.concatenate([np.r_[s.astype(np.int16) + 1, 0] for s in strings]).astype(np.int16)
        order = np.concatenate(list(induced.suffix_order(text, 60, budget))).tolist()
        assert order == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        ids = r.integers(0, 4, len(strings))
        got = induced.repeated_windows(np.concatenate(strings), np.array([len(s) for s in strings]), ids, 3, budget)
        want = [any(s[i : i + 3].tobytes() in t.tobytes() for t, e in zip(strings, ids, strict=True) if e < d) for s, d in zip(strings, ids, strict=True) for i in range(len(s) - 2)]
        assert got.tolist() == want


def test_signatures_are_circulant_and_estimate_jaccard():
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 1 << 63, 4000).astype(np.uint64))
    b = np.concatenate((a[1000:], r.integers(0, 1 << 63, 1000).astype(np.uint64)))
    sets = np.concatenate((a, np.unique(b), a[:1]))
    at = np.array([0, len(a), len(a) + len(np.unique(b)), len(sets)])
    s = near_dedup.signatures(sets, at, 160)
    many = near_dedup.signatures(sets, at, 1000)
    assert abs((many[0] == many[1]).mean() - 0.6) < 0.06
    place, own = near_dedup._sigma(sets[: len(a)])
    pi = near_dedup._pi(160)
    assert len(np.unique(pi[:-160])) == near_dedup.PLACES and (pi[-160:] == pi[:160]).all()
    for k in (0, 7, 159):
        assert s[0, k] == (pi[place + k] ^ own).min()


def test_signatures_of_sets_larger_than_the_circle():
    r = np.random.default_rng(4)
    a = np.unique(r.integers(0, 1 << 63, 1_200_000).astype(np.uint64))
    sets = np.concatenate((a[:1_000_000], a[200_000:]))
    s = near_dedup.signatures(sets, np.array([0, 1_000_000, len(sets)]), 64)
    assert abs((s[0] == s[1]).mean() - 2 / 3) < 0.25 and len(np.unique(s[0])) > 60


def test_similar_sets_agree_in_bits():
    r = np.random.default_rng(6)
    n, j = 400, 0.75
    shared = int(2 * n * j / (1 + j))
    sets, at = [], [0]
    for _ in range(150):
        x = r.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
        sets += [np.unique(x[:n]), np.unique(x[n - shared :])]
        at += [at[-1] + n, at[-1] + 2 * n]
    k = near_dedup.BANDS * near_dedup.ROWS
    bit = near_dedup.signatures(np.concatenate(sets), np.array(at), k) & 1
    agree = (bit[0::2] == bit[1::2]).sum(1)
    other = (bit[0:-2:2] == bit[2::2]).sum(1)
    assert agree.min() >= near_dedup.least_agreement(75, k) > other.max()


def test_buffers_of_slices_and_nulls():
    a = pa.array(["ab", None, "", "cde"])[1:]
    data, off = common.buffers(a)
    assert data.tobytes() == b"cde" and off.tolist() == [0, 0, 0, 3]


def test_chunk_ids_fall_into_one_bucket(spark):
    from pyspark.sql import functions as F

    from attesta.llm import exchange

    ids = np.concatenate((np.arange(-5, 50), np.random.default_rng(1).integers(0, 1 << 62, 200)))
    df = spark.createDataFrame([(int(i),) for i in ids], "c long").select("c", F.pmod(F.hash("c"), F.lit(51)).alias("b")).collect()
    assert [r["b"] for r in df] == exchange.bucket_of(np.array([r["c"] for r in df]), 51).tolist()
    g = exchange.chunk_ids(7, 51)
    own = [next(g) for _ in range(30)]
    assert len(set(own)) == 30 and set(exchange.bucket_of(np.array(own), 51).tolist()) == {7} and {i >> 32 for i in own} == {7}


def test_shared_folder_can_be_emptied(spark):
    kept = common.written(spark.range(3), "some")
    assert kept.count() == 3
    common.forget(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        spark.catalog.clearCache()
        kept.count()


def test_tables_go_with_what_reads_them(spark):
    folder = Path(common.shared_dir(spark).removeprefix("file://"), "attesta")
    there = lambda: {p.name for p in folder.iterdir()} if folder.exists() else set()

    def collected():
        for _ in range(2):  # Python's objects, then (py4j lets go of them once a second) the driver's
            gc.collect()
            time.sleep(1.5)
            spark.sparkContext._jvm.System.gc()
        common.sweep(spark)

    collected()
    before = there()
    one = common.written(spark.range(3), "some")
    out = near_dedup.near_dedup(spark.createDataFrame([(1, "some words here"), (2, "Some words here"), (3, None)], "doc_id long, text string"))
    ids = out.select("doc_id")
    del out
    collected()
    made = there() - before
    assert {n.rpartition("-")[0] for n in made} >= {"some", "near", "signatures"}
    assert sorted(r["doc_id"] for r in ids.collect()) == [1, 3] and one.count() == 3
    del ids
    collected()
    assert {n.rpartition("-")[0] for n in there() - before} == {"some"}
    assert not any(t.name.removeprefix("attesta_").replace("_", "-") in made for t in spark.catalog.listTables())
