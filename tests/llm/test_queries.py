import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import common, pieces, quality, queries
from tests import compare
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, name):
    compare.same(spark, sf, queries.QUERIES[name], queries.SQL[name])


def test_tokens_of_the_tables(spark, sf):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in queries.QUERIES["op4_sentencepiece"](spark, sf).collect():
        ids = lib.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))


def test_pipeline_equals_brute_force(spark, docs_list, tmp_path):
    import sentencepiece

    rows = [(d, t, "en", "s", len(t) if t is not None else None, "kept", 7) for d, t in docs_list]  # with nulls and repeated ids
    junk, long = [f"JUNK!! ALL!! CAPS!! NUMBER!! {i * 7}!!" for i in range(40)], "before " + " ".join(f"w{i}" for i in range(14)) + " after"
    bad = [(1000 + i, t, "en", "s", len(t), "kept", 7) for i, t in enumerate(junk)]
    leak = [(2000, long, "en", "s", len(long), "kept", 7)]
    labels = [(d, 1) for d in sorted({r[0] for r in rows if r[0] is not None})] + [(d, 0) for d, *_ in bad]
    spark.createDataFrame(rows + bad + leak, "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(14)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    own = lambda df: {(r["lang"], r["score"], r["n_lines"]) for r in df.collect()} == {("en", "kept", 7)} and df.columns == docs.columns
    scored = quality.score_quality(docs.select("doc_id", "text"), quality.fit(quality.training_rows(docs, spark.read.parquet(f"{sf}/labels.parquet"))))
    now = text(scored.where("score >= 0.3"))
    assert len(now) < len(rows) + len(bad) and (None, None) in now and 2000 in {d for d, _ in now}

    first = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert own(first) and text(first) == now
    second = corpus_pipeline.STAGES[1][1](spark, first, sf)
    assert own(second)
    got = second.collect()
    assert sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got), key=str) == sorted(((d, s) for d, _, _, s in brute.lines(now)), key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    now = text(second)
    kept = {str(d) for d, _, _, k in brute.near(now) if k}
    now = [(d, t) for d, t in now if str(d) in kept]
    third = corpus_pipeline.STAGES[2][1](spark, second, sf)
    assert own(third) and text(third) == now
    leaks = {d for d, *_, bad_ in brute.leaks(now, [(1, " ".join(f"w{i}" for i in range(14)))]) if bad_}
    assert leaks == {2000}
    now = [(d, t) for d, t in now if d not in leaks]
    fourth = corpus_pipeline.STAGES[3][1](spark, third, sf)
    assert own(fourth) and text(fourth) == now
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    out = sorted(((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, sf).collect()), key=str)
    assert out == sorted(((d, lib.encode(t or "")) for d, t in now), key=str)


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, f in queries.QUERIES.items():
        if name not in ("op6_top_k", "op10_url_filter"):
            assert f(spark, str(tmp_path)).select(F.count("*")).first()[0] == 0


def test_pipeline_lets_go_of_tables(spark, sf):
    folder = Path(common.shared_dir(spark).removeprefix("file://"), "attesta")
    there = lambda: {p.name for p in folder.iterdir()} if folder.exists() else set()
    before = there()
    out = corpus_pipeline.run(spark, sf)
    assert {n.rpartition("-")[0] for n in there() - before} == {"stage-decontaminate"} and out.count()
