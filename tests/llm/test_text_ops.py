import pytest
from pyspark.sql import functions as F

from attesta.llm import byte_spans, decontaminate, line_dedup, near_dedup, word_windows
from tests.llm import brute


def got(df, *columns):
    return sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))


def want(rows):
    return sorted(map(str, rows))


def sha(column):
    return F.sha2(F.col(column).cast("binary"), 256)


def test_lines(docs, docs_list, empty):
    out = line_dedup.dedup_lines(docs)
    assert got(out, "doc_id", "n_lines", "n_dropped", sha("text")) == want(brute.lines(docs_list))
    assert {"lang", "score", "kept", "ids"} <= set(out.columns) and out.columns.count("n_lines") == 1
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_in_chunks_and_shards(docs, docs_list):
    assert got(line_dedup.dedup_lines(docs, chunk=1500, shards=7), "doc_id", "n_lines", "n_dropped", sha("text")) == want(brute.lines(docs_list))


def test_lines_of_repeated_ids_and_nulls(spark):
    a = "the very same line in all of them"
    rows = [(1, a), (1, a), (2, a), (1, f"{a}\n{a}"), (7, "x"), (None, "a line of rows without an id"), (None, "a line of rows without an id"), (None, "A LINE OF ROWS WITHOUT AN ID ")]
    for n in (1, 4):
        df = spark.createDataFrame([(d, t, [1], 2, 3) for d, t in rows], "doc_id long, text string, drops array<int>, __rid int, N_LINES int").repartition(n)
        out = line_dedup.dedup_lines(df, chunk=40 if n > 1 else None)
        assert got(out, "doc_id", "n_lines", "n_dropped", sha("text")) == want(brute.lines(rows))
        assert {"drops", "__rid"} <= set(out.columns) and out.select("drops", "__rid").distinct().collect() == [([1], 2)]
    more = [*rows, (3, a)]
    out = line_dedup.dedup_lines(spark.createDataFrame(more, "doc_id long, text string"), chunk=40)
    assert got(out, "doc_id", "n_lines", "n_dropped", sha("text")) == want(brute.lines(more)) and sum(r["n_dropped"] for r in out.collect()) == 5


@pytest.mark.parametrize("args", [{}, {"chunk": 3000, "shards": 5}, {"chunk": 2000, "shards": 3, "hot": 1}, {"chunk": 2000, "shards": 3, "crowded": 1}, {"chunk": 2000, "shards": 2, "crowded": 0}])
def test_bytes(docs, docs_list, empty, args):
    out = byte_spans.dedup_bytes(docs, **args)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)) == want(brute.byte_spans(docs_list))
    assert "ids" in out.columns
    assert byte_spans.dedup_bytes(empty, **args).count() == 0


@pytest.mark.parametrize("args", [{}, {"chunk": 3000, "shards": 5}])
def test_words(docs, docs_list, empty, args):
    out = word_windows.dedup_windows(docs, **args)
    assert got(out, "doc_id", "n_words", "n_removed", sha("text")) == want(brute.word_windows(docs_list))
    assert word_windows.dedup_windows(empty, **args).count() == 0


def test_words_refuses_what_is_no_cover(docs):
    with pytest.raises(ValueError):
        word_windows.dedup_windows(docs, cover=(0, 1))


def test_near(docs, docs_list, empty):
    expected = brute.near(docs_list)
    assert got(near_dedup.near_duplicates(docs, chunk=4000), "doc_id", "n_shingles", "component_id", "kept") == want(expected)
    kept = near_dedup.near_dedup(docs, chunk=4000)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect())
    assert ids == sorted(str(d) for d, _, _, k in expected if k)
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.near_dedup(empty).count() == 0


def test_near_in_parts_of_families(docs, docs_list, monkeypatch):
    monkeypatch.setattr(near_dedup, "SPREAD", 2)
    monkeypatch.setattr(near_dedup, "SHARD", 2_000)
    assert got(near_dedup.near_duplicates(docs, chunk=4000), "doc_id", "n_shingles", "component_id", "kept") == want(brute.near(docs_list))


@pytest.mark.parametrize("spread", [4_000, 8])
def test_near_sends_a_set_once_and_not_with_each_pair(spark, monkeypatch, spread):
    monkeypatch.setattr(near_dedup, "SPREAD", spread)
    monkeypatch.setattr(near_dedup, "SHARD", 6 * 1000)
    families = [range(0, 40), range(100, 110), range(200, 203)]
    pairs = {(y, x) for f in families for x in f for y in f if x < y}
    known = spark.createDataFrame([(d % 7, d, 10) for f in families for d in f], "chunk long, doc long, n long")
    rows = near_dedup._asked(spark.createDataFrame(sorted(pairs), "doc long, partner long"), known, "test").collect()
    there = {(r["shard"], r["doc"]) for r in rows}
    held = sorted((r["doc"], p) for r in rows for p in r["partners"])
    assert held == sorted(pairs) and all((r["shard"], p) in there for r in rows for p in r["partners"])
    assert all(r["chunk"] == r["doc"] % 7 for r in rows) and len(there) == len(rows)
    assert len(rows) == 53 if spread > 40 else 53 < len(rows) < len(pairs)


ITEMS = [(1, " ".join(f"w{i}" for i in range(14))), (2, "Short ITEM, here"), (3, None), (4, "..."), (None, "the Of data rows hot merge sort quick lazy dog it"), (1, "two words"), (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")]


@pytest.mark.parametrize("block", [4 << 20, 40])
def test_leaks(spark, docs, docs_list, empty, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    more = [(900, "intro " + " ".join(f"W{i}" for i in range(2, 13)) + " outro"), (901, "a short, item! HERE it is"), (902, "w0 w1")]
    every = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = brute.leaks(docs_list + more, ITEMS)
    out = decontaminate.decontaminate(every, items)
    assert got(out, "doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), "contaminated") == want(expected)
    clean = decontaminate.decontaminate(every, items, action="drop")
    assert clean.count() == sum(not r[-1] for r in expected)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(every, items, action="spans").collect()}
    assert cut[900] == "intro  outro" and cut[902] == "w0 w1"
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0


def test_incremental_lines(spark):
    row = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    a, b = "the first of the shared lines", "another line that is long enough"
    index = line_dedup.LineIndex(spark)
    index.insert(row((1, a), (2, f"{a}\n{b}"), (3, None), (4, "short")))
    before = sorted(map(tuple, index.counts().select("n_docs", "max_id").collect()))
    index.insert(row((7, f"{b}\n{a}"), (8, f"{a}\n{a}")))
    assert sorted(map(tuple, index.counts().select("n_docs", "max_id").collect())) == [(2, 7), (4, 8)]
    assert index.maybe_seen(row((9, f"{a}\nnothing like it was ever seen"))).count() >= 1
    index.delete(row((7, f"{b}\n{a}"), (8, f"{a}\n{a}"), (99, "a line of a document unknown here")))
    assert sorted(map(tuple, index.counts().select("n_docs", "max_id").collect())) == before
    index.delete(row((1, a), (2, f"{a}\n{b}")))
    assert index.counts().count() == 0 and index.maybe_seen(row((9, a))).count() == 0


def test_index_grows_by_shards_and_segments(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    monkeypatch.setattr(line_dedup, "SEGMENTS", 2)
    row = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    text = lambda a, b: "\n".join(f"line number {i} which is long enough" for i in range(a, b))
    index = line_dedup.LineIndex(spark)
    index.insert(row((1, text(0, 20))))
    index.insert(row((2, text(10, 40)), (3, text(0, 5))))
    assert index.n_shards >= 4 and len(index.segments) <= 2
    index.delete(row((2, text(10, 40))))
    assert sorted(r["n_docs"] for r in index.counts().collect()) == [1] * 15 + [2] * 5
    assert index.maybe_seen(row((9, text(0, 20)))).count() == 20 and index.maybe_seen(row((9, text(20, 40)))).count() < 4
    index.delete(row((2, text(10, 40))))
    assert index.counts().count() == 20
