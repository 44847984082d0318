import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import language_id, pieces, quality, topk, url_filter
from attesta.llm.components import connected_components
from attesta.operators import components


def test_language(spark, docs, empty, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id.op2_language_id(spark, sf).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.95 and 0 <= r[1] <= r[2] <= 1
    learnt = language_id.learn(d)
    edge = language_id.predict(docs, learnt)
    assert edge.where("text IS NULL OR text = ''").select("lang_pred").distinct().collect() == [("und",)]
    assert edge.where("lang_pred NOT IN ('de', 'en', 'es', 'fr', 'und')").count() == 0
    assert language_id.learn(empty) == {}
    assert {r["lang_pred"] for r in language_id.predict(docs, {}).collect()} == {"und"}
    assert language_id.predict(empty, learnt).count() == 0


def bundle(text, dims):
    """Brute force: (vector, letters) of a text."""
    x = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "\0" for c in f"\0{text or ''}\0")
    v = np.zeros(dims)
    for i in range(len(x) - 2):
        if x[i + 1] != "\0":
            a, b, c = (language_id._letter(ord(y), dims).astype(int) for y in x[i : i + 3])
            v += np.roll(a, 2) * np.roll(b, 1) * c
    return v, sum(c.isalpha() for c in text or "")


@pytest.mark.parametrize("tile", [{}, {"LETTERS": 7}, {"TEXTS": 2, "GRAMS": 3}, {"CUBE": 1, "LETTERS": 11, "GRAMS": 2}])
def test_language_bundles_are_sums_of_bound_letters(tile, monkeypatch):
    for k, v in tile.items():
        monkeypatch.setattr(language_id, k, v)
    texts = ["Ab b", None, "日本語" * 3, "", "\U000e0100\ue000", "x\U00020000y İz", "1 2 3", "a", "ab" * 20]
    got = list(language_id.bundles(pa.array(texts), 64))
    assert [x for a, b, _, _ in got for x in range(a, b)] == list(range(len(texts)))
    v, letters = np.concatenate([x[2] for x in got]), np.concatenate([x[3] for x in got])
    for i, t in enumerate(texts):
        want, n = bundle(t, 64)
        assert v[i].tolist() == want.tolist() and letters[i] == n, t
    owner = np.array([0, 1, 0, 1, 0, 1, 0, 1, 0])
    by = sum(x[2] for x in language_id.bundles(pa.array(texts), 64, owner))
    assert (by == np.stack([v[::2].sum(0), v[1::2].sum(0)])).all()


def test_language_equals_brute_force(spark):
    r = random.Random(9)
    make = lambda a: " ".join("".join(r.choice(a) for _ in range(r.randint(1, 7))) for _ in range(r.randint(0, 12)))
    rows = [(i, make("abcdé" if i % 2 else "xyzäß"), "one" if i % 2 else "two", "old") for i in range(40)]
    rows += [(100, None, "one", ""), (101, "", "two", ""), (102, "12 !", "one", ""), (None, "abc", None, ""), (3, rows[3][1], "one", ""), (103, "\U000e0100", "two", ""), (104, "abé " * 20_000, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").repartition(3)
    learnt = language_id.learn(df, 64)
    proto = {k: sum((bundle(t, 64)[0] for _, t, g, _ in rows if g == k), np.zeros(64)) for k in ("one", "two")}
    assert {k: v.tolist() for k, v in learnt.items()} == {k: v.tolist() for k, v in proto.items()}
    got = sorted((str(x["doc_id"]), x["text"] or "", x["lang_pred"], round(x["score"], 9)) for x in language_id.predict(df, learnt, 64).collect())
    want = []
    for d, t, _, _ in rows:
        v, n = bundle(t, 64)
        cos = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in proto.items()} if n and v.any() else {}
        best = max(sorted(cos), key=cos.get, default="und")
        want.append((str(d), t or "", best, round(min(1, max(0, cos.get(best, 0))), 9)))
    assert got == sorted(want)
    tie = {"b": np.ones(64), "a": np.ones(64)}
    assert {x["lang_pred"] for x in language_id.predict(df.where("doc_id < 5"), dict(sorted(tie.items())), 64).collect()} <= {"a", "und"}


@pytest.mark.parametrize("texts", [["".join(random.Random(i).choices("abcdefghijklmnopqr", k=21)) for i in range(30_000)], ["".join(chr(0x4E00 + random.Random(3).randrange(20_000)) for _ in range(1)) + "".join(chr(0x4E00 + x % 20_000) for x in range(0, 3_500_000, 10))]])
def test_language_memory_is_bounded(texts):
    import tracemalloc

    column = pa.array(texts)
    language_id._fold()
    list(language_id.bundles(column.slice(0, 1), 1024))
    tracemalloc.start()
    for _ in language_id.bundles(column, 1024):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6


def statistics_by_rule(text):
    """The statistics of a text, written down plainly."""
    b = (text or "").encode()
    size, chars = len(b), max(1, len(text or ""))
    cls = lambda c: 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if 128 <= c < 192 else 4 if c >= 192 else 6 if c == 10 else 5 if c in b" \t\x0b\x0c\r" else 7 if c in b".," else 8 if c in b"!?" else 9 if c == 124 else 10 if c in b"'\"-:;()" else 11
    by = [sum(cls(c) == k for c in b) for k in range(12)]
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", b) if w]
    lines = [x for x in b.split(b"\n") if x]
    some, length = max(1, len(words)), [len(w) for w in words]
    share = lambda f: sum(map(f, words)) / some
    mean = sum(length) / some
    return [
        math.log1p(size), math.log1p(len(words)), *(by[k] / chars for k in (0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11)), by[1] / max(1, by[0] + by[1] + by[4]),
        math.sqrt(by[8] / some), math.sqrt(by[11] / some), math.sqrt(by[9] / some), mean, math.sqrt(max(0, sum(x * x for x in length) / some - mean**2)),
        sum(x == y for x, y in zip(words, words[1:], strict=False)) / some, share(lambda w: cls(w[-1]) == 11), share(lambda w: cls(w[-1]) in (8, 9)), share(lambda w: cls(w[-1]) == 7), share(lambda w: cls(w[0]) == 1),
        share(lambda w: len(w) >= 15), share(lambda w: len(w) <= 3), len(set(words)) / some, math.log1p(len(set(words))), (len(lines) - len(set(lines))) / max(1, len(lines)), math.log1p(size / max(1, len(lines))),
    ]


def test_quality_equals_brute_force(spark, docs_list):
    """Statistics by plain rules, ridge by one solution over all rows, calibration by scikit-like pooling: the same scores."""
    texts = [(i, t) for i, (_, t) in enumerate(docs_list)] + [(900, "a! " * 30_000), (901, ""), (902, None), (None, "no id"), (4, docs_list[4][1])]
    x = quality.statistics(pa.array([t for _, t in texts]))
    assert np.allclose(x, [statistics_by_rule(t) for _, t in texts])
    df = spark.createDataFrame([(d, t, 0.5) for d, t in texts], "doc_id long, text string, SCORE double").repartition(3)
    labels = [(i, i % 2) for i in range(0, 70)] + [(5, 1), (5, 0), (3, None), (None, 1), (777, 1)]
    rows = quality.training_rows(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    model = quality.fit(rows)
    data = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(quality.SEED + 1), "doc_id"), F.lit(4))).orderBy("doc_id", "y").collect()
    held = {i for i, _ in texts if i is None or zlib.crc32(str(i).encode()) % 5 == 0}
    expected = sorted((d, float(q)) for d, q in labels if q is not None and d not in held for e, _ in texts if e == d)
    assert sorted((r["doc_id"], r["y"]) for r in data) == expected
    z, y, fold = np.array([r["x"] for r in data]), np.array([r["y"] for r in data]), np.array([r["fold"] for r in data])
    std = z.std(0)
    plain = quality.Model(z.mean(0), np.where(std > 1e-9, std, 1), model.project, model.shift, np.zeros(0), (np.zeros(0), np.zeros(0)))
    f = plain.features(z)
    k, d = f.shape[1], z.shape[1]
    penalty = quality.RIDGE * len(z) * np.diag(np.r_[np.full(quality.FEATURES, 1.0), np.full(d, 1e-2), 1e-9]) + 1e-9 * np.eye(k)
    weights = np.linalg.solve(f[fold != 0].T @ f[fold != 0] + penalty, f[fold != 0].T @ y[fold != 0])
    own = f[fold == 0] @ weights
    held = y[fold == 0]
    blocks = [[x0, held[own == x0].mean(), int((own == x0).sum())] for x0 in np.unique(own)]
    i = 0
    while i < len(blocks) - 1:  # pool adjacent violators, the slow way
        (a, p, n), (b, q, m) = blocks[i], blocks[i + 1]
        if p >= q:
            blocks[i : i + 2] = [[(a * n + b * m) / (n + m), (p * n + q * m) / (n + m), n + m]]
            i = max(0, i - 1)
        else:
            i += 1
    want = np.interp(plain.features(x) @ weights, [b[0] for b in blocks], [b[1] for b in blocks])
    out = quality.score_quality(df, model)
    got = sorted((str(r["doc_id"]), r["score"]) for r in out.collect())
    for (a, p), (b, q) in zip(got, sorted((str(d), float(w)) for (d, _), w in zip(texts, want, strict=True)), strict=True):
        assert a == b and abs(p - q) < 1e-5, a
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out.collect())


def test_quality(spark, docs, empty, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.op7_quality(spark, sf).join(labels, "doc_id")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9
    bad = spark.createDataFrame([(None, 1), (1, None), (2, 7), (3, 1), (3, 0)], "doc_id long, quality int")
    model = quality.fit(quality.training_rows(docs, bad))
    scored = quality.score_quality(docs, model)
    assert scored.count() == docs.count() and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    none = quality.fit(quality.training_rows(empty, bad))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(empty, none).count() == 0


def test_isotonic_is_monotone_and_keeps_the_mean():
    r = np.random.default_rng(0)
    x = r.normal(size=500).round(2)
    y = (r.random(500) < 1 / (1 + np.exp(-x))).astype(float)
    px, py = quality.isotonic(x, y)
    assert (np.diff(py) > 0).all() and (np.diff(px) > 0).all()


def test_pieces_equal_the_library(spark, docs, docs_list, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    r = random.Random(4)
    pool = ["a", "the", " ", "  ", "▁", "\n", "é", "日", "😀", "\x00", "####", "<s>", "ing", "tion", "1", "", ".", "aaaa", "====", "\t", "�"]
    texts = [t for _, t in docs_list] + ["".join(r.choice(pool) for _ in range(r.randint(1, 50))) for _ in range(300)] + ["a" * 5000, " " * 2500 + "x", "ab" * 1500]
    df = spark.createDataFrame([(i, t, [9], "old") for i, t in enumerate(texts)], "doc_id int, text string, ids array<int>, decoded string")
    out = {x["doc_id"]: x for x in pieces.encode(df, pieces.model_path(), decoded=True).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert out[i]["ids"] == ids, repr(t)
        assert out[i]["decoded"] == lib.decode(ids)
    again = pieces.decode(pieces.encode(df, pieces.model_path()), pieces.model_path())
    assert again.join(pieces.encode(df, pieces.model_path(), decoded=True).select("doc_id", F.col("decoded").alias("d")), "doc_id").where("decoded <> d").count() == 0
    assert pieces.encode(empty, pieces.model_path(), decoded=True).count() == 0


@pytest.mark.parametrize("long", [0, 3, 64])
def test_long_words_equal_the_library(long, monkeypatch):
    """Texts without spaces, by rounds of either kind, in blocks and with words that aren't kept."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    p = pieces.Pieces(open(pieces.model_path(), "rb").read())
    monkeypatch.setattr(pieces, "LONG", long)
    r = random.Random(11)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "的一是不了人我在有他这为之大来以个中上们", "aA1+/=", "▁ ab", "".join(map(chr, range(0x4E00, 0x4F00))), "#=-_.", "th\nein"]
    texts = ["".join(r.choice(a) for _ in range(n)) for a in alphabets for n in (1, 70, 700, 4000)]
    words = [lib.id_to_piece(r.randrange(300, 32000)).replace("▁", "") for _ in range(3000)]
    texts += ["".join(words), "a" * 3001, "=" * 999 + "a", "\U0001f600" * 300]
    for block in (1 << 19, 50):
        monkeypatch.setattr(pieces, "BLOCK", block)
        e = pieces.Encoder(p, kept=100)
        ids, first = e.encode(texts)
        for i, t in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == lib.encode(t), (long, block, i)
        assert max(map(len, e.slot)) <= pieces.KEPT_LENGTH


def test_long_words_are_quick():
    import time

    p = pieces.Pieces(open(pieces.model_path(), "rb").read())
    r = random.Random(12)
    for alphabet in ("etaoinshrdlucmfwyp", "".join(map(chr, range(0x4E00, 0x5800)))):
        text = "".join(r.choice(alphabet) for _ in range(200_000))
        began = time.time()
        pieces.Encoder(p).encode([text])
        assert time.time() - began < 10


def test_pieces_decode_any_ids():
    import sentencepiece

    p = pieces.Pieces(open(pieces.model_path(), "rb").read())
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    r = random.Random(5)
    for _ in range(300):
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randint(1, 12))]
        assert p.decode(np.array(ids), np.array([0, len(ids)]))[0].decode() == lib.decode(ids), ids


def brute_top(rows, k=5, every=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        found = [(-sum(a * b for a, b in zip(x, y, strict=True)), j) for i, x in good if i == q for j, y in good if j != q and len(x) == len(y)]
        out += [(q, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("scale", [1.0, 3000.0, 1e7])
def test_top_k(spark, scale):
    r = np.random.default_rng(6)
    rows = [(i, (r.normal(size=24).round(1) * scale).tolist()) for i in range(240)]
    rows += [(50, None), (100, [1.0, None] + [0.0] * 22), (150, [float("nan")] * 24), (None, [1.0] * 24), (7, rows[7][1]), (50, rows[3][1]), (200, [1.0, 2.0]), (201, [1.0, 2.0]), (202, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, score int").repartition(3)
    out = sorted(map(tuple, topk.top_k(df).collect()))
    assert out == brute_top(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 500)
    r = np.random.default_rng(16)
    rows = [(i, r.normal(size=12).round(1).tolist()) for i in range(160)] + [(50, r.normal(size=12).tolist()), (100, [1.0] * 500), (101, [2.0] * 500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute_top(rows)


def test_top_k_prunes_without_losing(monkeypatch):
    r = np.random.default_rng(7)
    c = np.floor(256 * r.normal(size=(4000, 64)) * np.exp(-np.arange(64) / 8))
    q = c[:8]
    ids = np.arange(4000)
    best = topk.Best(8, 5, np.int64)
    first = topk.search(best, ids[:8], q, ids[:400], c[:400])
    rest = topk.search(best, ids[:8], q, ids[400:], c[400:])
    assert first == 8 * 400 * 64 and rest < 0.9 * 8 * 3600 * 64
    exact = q @ c.T
    exact[np.arange(8), np.arange(8)] = -np.inf
    assert best.s.reshape(8, 5).tolist() == np.sort(exact, 1)[:, ::-1][:, :5].tolist()


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(None, 1), (9, 9), (9, None)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    want = {x: find(x) for x in up}
    for small in (0, 100):  # all by steps, the rest by one task
        assert {r["node"]: r["component"] for r in components.connected_components(df, small=small).collect()} == want
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0
    names = df.selectExpr("concat('n', a) AS a", "concat('n', b) AS b")
    groups = {}
    for x, c in want.items():
        groups.setdefault(c, []).append(f"n{x}")
    assert {r["node"]: r["component"] for r in components.connected_components(names).collect()} == {x: min(g) for g in groups.values() for x in g}


PAGES = [
    (1, "http://A.example.com/en/1?x=1", '<link rel="canonical" href="/fr/1">', "old", 1),
    (2, "https://a.example.com/fr/1#top", None, "old", 1),
    (3, "http://b.example.com/en/71", '<LINK href=http://a.example.com/fr/1 rel=canonical>', "old", 1),
    (4, "http://c.example.org/x", '<meta http-equiv="refresh" content="0; url=http://d.example.org/es/2">', "old", 1),
    (5, "http://d.example.org/es/2", "", "old", 1),
    (6, "http://x.example.net/de/81", None, "old", 1),
    (7, "http://x.example.net/de/7", None, "old", 1),
    (8, None, "<p>", "old", 1),
    (9, "no scheme", '<link rel="canonical" href="http://d.example.org/es/2">', "old", 1),
    (10, "http://xcom/en/", None, "old", 1),
    (10, "http://com/en/", None, "old", 1),
    (11, "a://h.org?/es/", None, "old", 1),
]


def test_urls(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, verdict string, hit int")
    out = url_filter.filter_urls(df)
    assert out.columns.count("hit") == 1 and {r["hit"] for r in out.collect()} == {1}
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in out.collect())
    assert got == sorted([
        (1, "a.example.com", "/en/1", "com/en/", "block"), (2, "a.example.com", "/fr/1", "", "block"), (3, "b.example.com", "/en/71", "example.com/en/7", "allow"), (4, "c.example.org", "/x", "", "block"),
        (5, "d.example.org", "/es/2", "org/es/", "block"), (6, "x.example.net", "/de/81", "example.net/de/8", "block"), (7, "x.example.net", "/de/7", "net/de/", "allow"), (8, "", "", "", "allow"), (9, "", "", "", "allow"),
        (10, "xcom", "/en/", "", "allow"), (10, "com", "/en/", "com/en/", "block"), (11, "h.org", "", "", "allow"),
    ])
    many = [*url_filter.RULES, *[(f"h{i}.test", "/", "block") for i in range(url_filter.MOST_EXPRESSIONS)]]
    again = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filter.filter_urls(df, many).collect())
    assert again == got
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_urls_equal_sql(spark, tmp_path):
    from tests import compare

    df = spark.createDataFrame([p[:3] for p in PAGES], "page_id long, url string, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cur = con.execute(url_filter.OP10_SQL)
    out = url_filter.op10_url_filter(spark, str(tmp_path))
    assert compare.rows(out.columns, out.collect()) == compare.rows([c[0] for c in cur.description], cur.fetchall())
