"""The event log: an append-only, hash-chained table, its payloads, and the views on it that everything else is derived from.

Events are (seq, ts, kind, actor, payload_hash, source_ref, context_sig, prev_hash, hash); payloads (payload_hash, payload) lie apart, so one can be deleted without
breaking the chain. A log has one writer; readers need no lock.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.canon import canon_json
from attesta.sources.shared import checkpointed, shared_dir

KINDS = {"alias", "assertion", "gate_run", "admission", "observation", "claim", "resolution", "pin", "supersede", "retraction", "redaction", "reliability", "calibration", "demotion"}
GENESIS = "0" * 64
EVENT = "seq long, ts long, kind string, actor string, payload_hash string, source_ref string, context_sig string, prev_hash string, hash string"
PAYLOAD = "payload_hash string, payload string"


def event_hash(seq, ts, kind, actor, payload_hash, source_ref, context_sig, prev_hash) -> str:
    return sha256(canon_json([seq, ts, kind, actor, payload_hash, source_ref, context_sig, prev_hash]).encode()).hexdigest()


def hash_column():
    """event_hash() of the row at hand, in the JVM: the same JSON text, built from its parts."""
    # to_json escapes as canonical JSON does but for "/", which it leaves alone too
    quoted = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.array(F.col(c))), r"(?s)^\[(.*)\]$", 1))
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", F.col("seq").cast("string"), F.col("ts").cast("string"), *[quoted(c) for c in ("kind", "actor", "payload_hash", "source_ref", "context_sig", "prev_hash")]), F.lit("]")).cast("binary"), 256)


def chained(rows: Iterable[tuple], head: tuple[int, str] = (0, GENESIS)) -> tuple[list[tuple], list[tuple]]:
    """(events, payloads) of (ts, kind, actor, payload object, source_ref, context_sig) in order of arrival after head (seq, hash)."""
    seq, prev = head
    events, payloads = [], {}
    for ts, kind, actor, payload, source, sig in rows:
        if kind not in KINDS:
            raise ValueError(f"unknown event kind {kind!r}")
        text = canon_json(payload)
        ref = sha256(text.encode()).hexdigest()
        payloads[ref] = text
        seq += 1
        own = event_hash(seq, ts, kind, actor, ref, source, sig, prev)
        events.append((seq, ts, kind, actor, ref, source, sig, prev, own))
        prev = own
    return events, list(payloads.items())


#: Events that one task links.
SEGMENT = 1 << 21


def _link(rows: DataFrame, order: list[str], head: tuple[int, str]) -> DataFrame:
    """EVENT of rows after head, by one task in a stream."""
    names = [f.split()[0] for f in EVENT.split(", ")]

    def link(batches):
        seq, prev = head
        quote = functools.lru_cache(1 << 14)(canon_json)
        for b in batches:
            first, before, own = seq + 1, [], []
            for ts, kind, actor, ref, source, sig in zip(*(b.column(c).to_pylist() for c in names[1:7]), strict=True):
                seq += 1
                plain = f'"{ref}"' if ref is not None and ref.isascii() and ref.isalnum() else canon_json(ref)
                before.append(prev)
                # the text of canon_json(), see event_hash()
                prev = sha256(f'[{seq},{"null" if ts is None else ts},{quote(kind)},{quote(actor)},{plain},{quote(source)},{quote(sig)},{quote(prev) if seq == first else f'"{prev}"'}]'.encode()).hexdigest()
                own.append(prev)
            if own:
                given = [b.column(c).cast(pa.int64() if c == "ts" else pa.string()) for c in names[1:7]]
                yield pa.RecordBatch.from_arrays([pa.array(range(first, seq + 1), pa.int64()), *given, pa.array(before, pa.string()), pa.array(own, pa.string())], names)

    return rows.repartition(1).sortWithinPartitions(*order).select(F.col("ts").cast("long").alias("ts"), *names[2:7]).mapInArrow(link, EVENT)


def chain(rows: DataFrame, order: list[str], head: tuple[int, str] = (0, GENESIS)) -> DataFrame:
    """EVENT of rows (ts, kind, actor, payload_hash, source_ref, context_sig) after head, in the order of the columns named, as a table in the shared folder.

    Each hash needs the one before, so events are linked one after another; payloads are hashed before, in parallel. Rows are cut into segments of about SEGMENT by ranges of the order, each of
    which one task sorts and links after the head of the one before: no task reads or holds more than a segment, however long the log."""
    names = [*dict.fromkeys([*order, *(f.split()[0] for f in EVENT.split(", ")[1:7])])]
    rows = rows.select(*names)
    segments = -(-rows.count() // SEGMENT)
    if segments <= 1:
        return checkpointed(_link(rows, order, head))
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/attesta/kept-{uuid.uuid4().hex}"
    cut = rows.repartitionByRange(segments, *order).withColumn("_segment", F.spark_partition_id())
    cut.write.partitionBy("_segment").parquet(f"{path}/rows")
    whole = T.StructType([*rows.schema.fields, T.StructField("_segment", T.IntegerType())])
    cut = spark.read.schema(whole).parquet(f"{path}/rows")
    for i in range(segments):
        _link(cut.where(F.col("_segment") == i), order, head).write.mode("append").parquet(f"{path}/events")
        done = spark.read.schema(EVENT).parquet(f"{path}/events")
        last = done.where(F.col("seq") > head[0]).agg(F.max(F.struct("seq", "hash")).alias("h")).first()["h"]
        head = (last["seq"], last["hash"]) if last else head
    return spark.read.schema(EVENT).parquet(f"{path}/events")


class Ledger:
    """A log in a folder. Appending is one writer's job and takes one task, as each hash needs the one before; everything else is parallel."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        return self._read("events", EVENT)

    def payloads(self) -> DataFrame:
        deleted = self._read("deleted", "payload_hash string")
        return self._read("payloads", PAYLOAD).dropDuplicates(["payload_hash"]).join(deleted.distinct(), "payload_hash", "left_anti")

    def head(self) -> tuple[int, str]:
        r = self.events().agg(F.max(F.struct("seq", "hash")).alias("h")).first()["h"]
        return (r["seq"], r["hash"]) if r else (0, GENESIS)

    def append(self, rows: Iterable[tuple]) -> int:
        """Append (ts, kind, actor, payload, source_ref, context_sig); the new head's seq."""
        events, payloads = chained(rows, self.head())
        if events:
            self.spark.createDataFrame(payloads, PAYLOAD).coalesce(1).write.mode("append").parquet(f"{self.path}/payloads")
            self.spark.createDataFrame(events, EVENT).coalesce(1).write.mode("append").parquet(f"{self.path}/events")
        return self.head()[0]

    def delete_payload(self, payload_hash: str) -> None:
        if len(payload_hash) != 64 or set(payload_hash) - set("0123456789abcdef"):
            raise ValueError("a payload is named by 64 hex digits")
        self.spark.createDataFrame([(payload_hash,)], "payload_hash string").write.mode("append").parquet(f"{self.path}/deleted")

    def checkpoint(self, name: str, table: DataFrame) -> str:
        """Write a derived table for the present head."""
        head = self.head()[1]
        table.write.mode("overwrite").parquet(f"{self.path}/derived/{name}/{head}")
        return head

    def restore(self, name: str, head: str, schema: str) -> DataFrame:
        return self._read(f"derived/{name}/{head}", schema)

    def restorable(self, name: str) -> tuple[str, int] | None:
        """(head, seq) of the newest checkpoint of name that this log's chain holds, without a retraction or redaction after it, which would change what it was made from."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/derived/{name}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return None
        heads = [x.getPath().getName() for x in fs.listStatus(folder) if fs.exists(hadoop.Path(x.getPath(), "_SUCCESS"))]  # an unfinished one has no mark
        events = self.events()
        changed = events.where(F.col("kind").isin("retraction", "redaction")).agg(F.max("seq")).first()[0] or 0
        found = events.where(F.col("hash").isin(heads) & (F.col("seq") >= changed)).select("seq", "hash").orderBy(F.desc("seq")).head() if heads else None
        return (found["hash"], found["seq"]) if found else None

    def resume(self, name: str, schema: str) -> tuple[DataFrame, DataFrame]:
        """(checkpointed table, events since): the newest checkpoint that holds, and what is to be added to it; an empty table and the whole log where none does."""
        at = self.restorable(name)
        if at is None:
            return self.spark.createDataFrame([], schema), self.events()
        return self.restore(name, at[0], schema), self.events().where(F.col("seq") > at[1])

    def replay(self, folds: dict[str, tuple]) -> str:
        """Make every derived table again from the log alone, folds (name -> function of (live events), key columns), checkpoint it and return the hash of them all."""
        live_now = live(self.events(), self.payloads())
        tables = {}
        for name, (fold, key) in folds.items():
            table = fold(live_now)
            head = self.checkpoint(name, table)
            tables[name] = (self.restore(name, head, table.schema), key)
        return closure_hash(tables)


def verify_links(events: DataFrame) -> DataFrame:
    """(seq, bad_hash, bad_link, bad_seq) of events that break the chain. Hashes are recomputed in parallel and the predecessor comes by an equi-join on seq: no global sort.

    A seq that several events have is bad for each of them; the first event must follow from nothing."""
    before = events.groupBy((F.col("seq") + 1).alias("seq")).agg(F.min("hash").alias("h"))
    twice = events.groupBy("seq").agg(F.count("*").alias("m"))
    first = events.agg(F.min("seq").alias("s"))
    j = events.withColumn("own", hash_column()).join(before, "seq", "left").join(twice, "seq").crossJoin(F.broadcast(first))
    start = F.col("seq") == F.col("s")
    out = j.select("seq", (F.col("own") != F.col("hash")).alias("bad_hash"), F.when(start, F.col("prev_hash") != GENESIS).otherwise(F.coalesce(F.col("prev_hash") != F.col("h"), F.lit(False))).alias("bad_link"), ((~start & F.col("h").isNull()) | (F.col("m") > 1)).alias("bad_seq"))
    return out.where("bad_hash OR bad_link OR bad_seq")


def longest_valid(events: DataFrame) -> DataFrame:
    """The part before the first event that doesn't verify (a torn tail is cut off)."""
    first = verify_links(events).agg(F.min("seq").alias("bad"))
    return events.crossJoin(F.broadcast(first)).where("bad IS NULL OR seq < bad").drop("bad")


def live(events: DataFrame, payloads: DataFrame, cutoff: int | None = None) -> DataFrame:
    """Events with payload, null for what is deleted, redacted or by a retracted actor. Both sets come from the whole log, whatever the cutoff."""
    parsed = events.join(payloads, "payload_hash", "left")
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    gone = parsed.where("kind = 'retraction'").groupBy(get("actor").alias("actor")).agg(F.max_by(F.coalesce(get("restored"), F.lit("false")) == "true", "seq").alias("restored")).where("NOT restored").select("actor", F.lit(True).alias("_r"))
    hidden = parsed.where("kind = 'redaction'").select(get("payload_hash").alias("payload_hash")).distinct().withColumn("_h", F.lit(True))
    part = parsed if cutoff is None else parsed.where(F.col("seq") <= cutoff)
    out = part.join(gone, "actor", "left").join(hidden, "payload_hash", "left")
    drop = F.coalesce("_h", F.lit(False)) | (F.coalesce("_r", F.lit(False)) & (F.col("kind") != "retraction"))
    return out.withColumn("payload", F.when(~drop, F.col("payload"))).drop("_r", "_h")


def redaction_scope(events: DataFrame) -> DataFrame:
    return events.groupBy("payload_hash").agg(F.count("*").alias("events"), F.array_sort(F.collect_set("actor")).alias("actors"))


def events_since(events: DataFrame, cursor: int, kinds: Iterable[str] | None = None) -> DataFrame:
    out = events.where(F.col("seq") > cursor)
    return out.where(F.col("kind").isin(sorted(kinds))) if kinds else out


def latest(rows: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """The last row of each key."""
    every = F.struct(*[c for c in rows.columns])
    return rows.groupBy(*key).agg(F.max_by(every, order).alias("_l")).select("_l.*")


def as_of(obs: DataFrame, admissions: DataFrame) -> DataFrame:
    """obs (seq, statement) with the fact that its statement stood for when it came: admissions (statement, fact, from_seq, to_seq), to_seq null while open. The earliest fact wins."""
    j = obs.join(admissions, "statement", "left").where("fact IS NULL OR (from_seq < seq AND (to_seq IS NULL OR seq <= to_seq))")
    best = j.groupBy("seq").agg(F.min_by("fact", F.struct("from_seq", "fact")).alias("fact"))
    return obs.join(best, "seq", "left")


def closure_hash(tables: dict[str, tuple[DataFrame, list[str]]]) -> str:
    """One hash of derived tables (name -> table, key), whatever their row order: a hash of each row, summed by table. Nothing is gathered."""
    parts = []
    for name, (df, _) in sorted(tables.items()):
        h = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))).cast("binary"), 256).alias("h"))
        word = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
        r = h.agg(F.count("*").alias("n"), *[word(i).alias(f"w{i}") for i in range(4)]).first()
        parts.append([name, *map(str, r)])
    return sha256(canon_json(parts).encode()).hexdigest()
