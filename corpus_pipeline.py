"""From raw documents to tokens: quality filter, line dedup, near-duplicate removal, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of documents, the last one tokens instead. Between stages the
rows are written as Parquet and read again, so a lost executor repeats a part of one stage at most. A stage's tables go once what it returned is written and let go of.

Cases, in every stage: null texts count as empty ones and, unless a line is dropped from them, stay null; empty texts are judged like others; very long texts are taken whole. Rows without
doc_id are documents of their own, and rows that repeat a doc_id are judged each, but for what a stage says below. Equal rows fare alike. Empty tables give
empty results. All columns of docs, whatever their names, go on unchanged, but for text and n_chars where lines are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import decontaminate, line_dedup, near_dedup, pieces, quality
from attesta.llm.common import held_now, sweep, text_table, written


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, so that no name clashes with what an operator adds."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("blank"), *others).alias("row"))


def _columns(carried: DataFrame, docs: DataFrame, cut: bool = False) -> DataFrame:
    """The columns of docs again; with cut, where lines were dropped n_chars (if there is one) is counted again, and a null text stays null elsewhere."""
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col(f"row.c{i}") for i, c in enumerate(docs.columns)}
    if cut:
        own["text"] = F.when((F.col("n_dropped") > 0) | ~F.col("row.blank"), F.col("text"))
        if "n_chars" in own:
            own["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return carried.select(*[x.alias(c) for c, x in own.items()])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, rejects go. Rows without doc_id aren't learnt from, but judged; without labels all stay."""
    model = quality.fit(quality.training_rows(docs, text_table(spark, sf_dir, "labels")))
    return _columns(quality.score_quality(_carried(docs), model).where("predicted = 1"), docs)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the one with the largest doc_id. Rows that repeat a doc_id are one document here; rows without one lose such lines."""
    return _columns(line_dedup.dedup_lines(_carried(docs)), docs, cut=True)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id and all rows of it. Texts without words and rows without doc_id have no duplicates."""
    return near_dedup.near_dedup(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Items without words have no window."""
    return _columns(decontaminate.decontaminate(_carried(docs), text_table(spark, sf_dir, "benchmark"), action="drop"), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, and the hashes of ids and of what they decode to, one row a row of docs."""
    return pieces.digests(pieces.encode(docs.select("doc_id", "text"), pieces.model_path(), decoded=True), "doc_id", "ids")


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_filter),
    ("near_dedup", near_duplicate_filter),
    ("decontaminate", benchmark_filter),
    ("sentencepiece", tokenize),
]

#: The classifier and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = text_table(spark, sf_dir, "documents"), held_now()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, done, but=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
