"""Text evidence: files of blank-line separated entries with @key: value headers, and stored payloads, as one corpus.

A corpus is (entry, content_hash, offset, text, meta map, origin, salience).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.expressions import content_hash, span_ref



def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, text) of the files under a path; whole files, so entries keep their offsets."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def entries(texts: DataFrame) -> DataFrame:
    """The corpus of (file, text): an entry's offset is where its block begins in the file."""
    lines = F.transform(F.split("text", "\n"), F.trim)
    heads = F.filter(lines, lambda x: x.rlike(r"^@\w+:"))
    meta = F.map_from_entries(F.transform(F.array_distinct(F.transform(heads, lambda x: F.regexp_extract(x, r"^@(\w+):", 1))), lambda k: F.struct(k.alias("key"), F.regexp_extract(F.element_at(F.filter(heads, lambda x: x.startswith(F.concat(F.lit("@"), k, F.lit(":")))), -1), r"^@\w+:\s*(.*)$", 1).alias("value"))))
    blocks = F.split("text", "\n\n")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    offsets = F.aggregate(blocks, start, lambda a, b: F.struct((a["at"] + F.length(b) + 2).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]
    b = texts.select("file", meta.alias("meta"), F.posexplode(F.arrays_zip(blocks.alias("b"), offsets.alias("o"))).alias("i", "z"))
    text = F.regexp_replace("z.b", r"^\s+|\s+$", "")
    out = b.select(F.concat_ws("#", "file", F.col("i").cast("string")).alias("entry"), F.col("z.o").alias("offset"), text.alias("text"), "meta").where("text <> ''")
    return out.select("entry", content_hash("text").alias("content_hash"), "offset", "text", "meta", F.lit("evidence").alias("origin"), F.try_element_at("meta", F.lit("salience")).try_cast("double").alias("salience"))


def payload_entries(payloads: DataFrame) -> DataFrame:
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return payloads.select(F.col("payload_hash").alias("entry"), F.col("payload_hash").alias("content_hash"), F.lit(0).alias("offset"), F.col("payload").alias("text"), none.alias("meta"), F.lit("payload").alias("origin"), F.lit(None).cast("double").alias("salience"))


def census(before: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to read, files to evict): by name and modification time."""
    key = ["file", "modified"]
    return now.join(before.select(*key), key, "left_anti"), before.join(now.select(*key), key, "left_anti").select("file")


def build_corpus(texts: DataFrame, shortest: int = 240, longest: int = 6000) -> DataFrame:
    """(entry_id, source, text): blocks between --- lines within the length band, the first of equal ones, by id."""
    b = texts.select("file", F.posexplode(F.split("text", r"\n---\n")).alias("i", "b")).withColumn("text", F.trim(F.regexp_replace("b", r"(?s)<!--.*?-->", "")))
    kept = b.where(F.length("text").between(shortest, longest)).withColumn("entry_id", content_hash("text"))
    return kept.groupBy("entry_id").agg(F.min(F.struct("file", "i")).alias("s"), F.first("text").alias("text")).select("entry_id", F.col("s.file").alias("source"), "text")


def retrieval_log(results: DataFrame, actor: str) -> DataFrame:
    """(actor, query, spans) rows for the side log; write them with mode append."""
    return results.groupBy("query").agg(F.array_sort(F.collect_list(span_ref(F.col("entry"), F.col("content_hash"), F.col("offset")))).alias("spans")).select(F.lit(actor).alias("actor"), "query", "spans")


def extracted(events: DataFrame, predicates: list[str], vocabulary: dict[str, tuple[list[str], str]]) -> DataFrame:
    """Observations that a reader found in texts, cleaned: events (epoch, pred, arg, outcome, ctx map) of known predicates, with a plain argument and an outcome, each once.

    vocabulary: key of ctx -> (values, what others become). Of equal (pred, arg, outcome, epoch) the smallest ctx stays; the result is in order of epoch only when it is sorted by it."""
    arg = F.lower(F.trim(F.col("arg")))
    ctx = F.create_map(*[x for k, (values, other) in vocabulary.items() for x in (F.lit(k), F.when(F.col("ctx")[k].isin(values), F.col("ctx")[k]).otherwise(other))])
    good = events.where(F.col("pred").isin(predicates) & F.col("outcome").isNotNull()).select("epoch", "pred", arg.alias("arg"), "outcome", ctx.alias("ctx")).where(F.col("arg").rlike(r"^\p{Alnum}[\w .-]*$"))
    key = F.to_json("ctx")
    return good.groupBy("pred", "arg", "outcome", "epoch").agg(F.min_by("ctx", key).alias("ctx"))
