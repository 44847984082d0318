"""Packed exchanges between chunks of a corpus and shards of a hash space.

A corpus is written once, in chunks of whole rows, as a table in the shared folder that is bucketed by chunk; every later pass reads it there without shuffling
a text again. What a pass asks about its texts goes out as packed rows, one for each chunk and shard that have something to do with each other (sorted hashes, a few
bytes an entry, each distinct hash of a chunk once), and comes back to the chunk as some bits an entry in the same order. So a hash that fills a third of a
corpus arrives at its shard once a chunk, nothing is gathered that isn't bounded by a chunk or by a shard, and there are at most as many rows as entries:
what a pass sends is linear in the corpus.

Chunks are sized so that there are some thousands of them, between CHUNK_MIN and CHUNK_MAX: what a task holds doesn't grow with the corpus. Rows are made and read as
arrays, without a step of Python for each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attesta.llm.common import chunks, held, shared_path, spans, tune

#: Text bytes of a shard; the least and most of a chunk, and the number of chunks aimed at in between.
SHARD_BYTES = 24 << 20
CHUNK_MIN, CHUNK_MAX, CHUNKS = 2 << 20, 16 << 20, 4_096

REQUEST = "kind int, shard long, chunk long, n int, base long, one binary, two binary, ids binary"
REPLY = "chunk long, kind int, shard long, bits binary"


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket into which a table bucketed by a bigint column puts each value (32-bit Murmur3 with seed 42)."""
    m = np.uint64(0xFFFFFFFF)
    rotate = lambda x, r: ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & m
    x, h = ids.astype(np.uint64), np.uint64(42)
    for word in (x & m, x >> np.uint64(32)):
        k = rotate(word * np.uint64(0xCC9E2D51) & m, 15) * np.uint64(0x1B873593) & m
        h = (rotate(h ^ k, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & m
    h = h ^ np.uint64(8)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by) & m
    h = h ^ (h >> np.uint64(16))
    return h.astype(np.uint32).astype(np.int32) % buckets


def chunk_ids(part: int, buckets: int) -> Iterator[int]:
    """Ids of a task's chunks, chosen so that all fall into one bucket: a task writes one file, not one for each chunk."""
    at = 0
    while True:
        ids = part << 32 | np.arange(at, at + 8 * buckets)
        yield from ids[bucket_of(ids, buckets) == part % buckets].tolist()
        at += 8 * buckets


class Corpus:
    """docs as a written table of chunks."""

    def __init__(self, docs: DataFrame, name: str, chunk: int | None = None, shards: int | None = None, shard_bytes: int = SHARD_BYTES):
        self.spark = spark = docs.sparkSession
        tune(spark)
        self.schema = docs.schema
        if shards is None or chunk is None:
            size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
            shards = shards or max(1, -(-size // shard_bytes))
            chunk = chunk or min(CHUNK_MAX, max(CHUNK_MIN, size // CHUNKS))
        self.shards = shards

        buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # more buckets Spark refuses

        def pack(batches):
            ids = chunk_ids(TaskContext.get().partitionId(), buckets)
            for b in chunks(batches, chunk):
                yield pa.RecordBatch.from_arrays([pa.array([next(ids)], pa.int64()), pa.array([closed(b)], pa.binary())], ["chunk", "body"])

        self._write(docs.mapInArrow(pack, "chunk long, body binary"), name, buckets)

    def _write(self, packed: DataFrame, name: str, buckets: int) -> None:
        self.buckets, self.table = buckets, f"attesta_{name}_{uuid.uuid4().hex}"
        path = shared_path(self.spark, name)
        packed.write.format("parquet").option("path", path).option("compression", "uncompressed").bucketBy(buckets, "chunk").saveAsTable(self.table)
        self.rows = held(self.spark.table(self.table), path, self.table)

    def derive(self, name: str, f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Corpus:
        """Another table of the same chunks, with what f makes of each."""
        out = Corpus.__new__(Corpus)
        out.spark, out.shards = self.spark, self.shards
        made = self.rows.groupBy("chunk").applyInArrow(lambda t: pa.table({"chunk": t.column("chunk"), "body": pa.array([closed(f(opened(t.column("body")[0].as_py())))], pa.binary())}), "chunk long, body binary")
        out._write(made, name, self.buckets)
        return out

    def flat(self, f: Callable[[int, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
        """The rows of f(chunk, batch) of every chunk."""

        def run(batches):
            for b in batches:
                for chunk, body in zip(*(b.column(k).to_pylist() for k in (0, 1)), strict=True):
                    yield f(chunk, opened(body))

        return self.rows.select("chunk", "body").mapInArrow(run, schema)

    def ask(self, question: Callable[[pa.RecordBatch, dict[int, bytes]], list[Sent]], replies: DataFrame | None = None) -> DataFrame:
        """Packed rows (REQUEST) of question(batch, replies by kind) for each chunk."""

        def run(chunk: int, body: bytes, given: dict) -> pa.Table:
            return pa.concat_tables([s.table(chunk) for s in question(opened(body), given)])

        none = _request_schema().empty_table()
        if replies is None:
            return self.rows.groupBy("chunk").applyInArrow(lambda t: run(t.column("chunk")[0].as_py(), t.column("body")[0].as_py(), {}), REQUEST)
        return self._with(replies).applyInArrow(lambda t, r: run(t.column("chunk")[0].as_py(), t.column("body")[0].as_py(), answers(r)) if t.num_rows else none, REQUEST)

    def finish(self, result: Callable[[pa.RecordBatch, dict], pa.RecordBatch], schema: str, replies: DataFrame) -> DataFrame:
        """result(batch, replies) of every chunk; it must have the columns of schema."""
        fit = fitted(schema)
        return self._with(replies).applyInArrow(lambda t, r: fit(pa.Table.from_batches([result(opened(t.column("body")[0].as_py()), answers(r))])), schema)

    def _with(self, replies: DataFrame):
        return self.rows.groupBy("chunk").cogroup(replies.groupBy("chunk"))


def fitted(schema: str) -> Callable[[pa.Table], pa.Table]:
    """A function that gives tables with these columns the types that Spark expects: values that can't be null, in nested columns too, are declared as if they could."""
    want = to_arrow_schema(StructType.fromDDL(schema))
    return lambda t: t.select(want.names).cast(want)


def closed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(body: bytes) -> pa.RecordBatch:
    t = pa.ipc.open_stream(body).read_all().combine_chunks()
    return t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], schema=t.schema)


def _request_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in REQUEST.split(", ")])


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that end at ends (bytes, cumulative) of data."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


class Sent:
    """What a chunk asks of shards: entries in order of hash, one or two columns of equal items (or of bytes with their ends), and ids."""

    def __init__(self, kind: int, hashes: np.ndarray, shards: int):
        self.kind = kind
        shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        new = np.ones(len(shard), bool)
        new[1:] = shard[1:] != shard[:-1]
        self.first = np.append(np.flatnonzero(new), len(shard))
        self.shard, self.n = shard[new], np.diff(self.first)
        self.columns: dict[str, pa.Array] = {}

    def put(self, name: str, data: np.ndarray, ends: np.ndarray | None = None) -> Sent:
        """data has equal rows, one an entry; or it is bytes and ends are the entries' ends."""
        if ends is None:
            width = data.nbytes // max(1, len(data))
            self.columns[name] = _binary(data, self.first[1:] * width)
        else:
            self.columns[name] = _binary(data, np.concatenate(([0], ends))[self.first[1:]])
        return self

    def put_ids(self, ids: np.ndarray) -> Sent:
        """As 4 bytes over the chunk's least id where that is enough, else as 8."""
        low = int(ids.min()) if len(ids) else 0
        narrow = not len(ids) or int(ids.max()) - low < 1 << 32
        self.base = low if narrow else 0
        return self.put("ids", (ids - low).astype(np.uint32) if narrow else ids.astype(np.int64))

    def table(self, chunk: int) -> pa.Table:
        k = len(self.shard)
        fill = {"kind": pa.array(np.full(k, self.kind, np.int32)), "shard": pa.array(self.shard), "chunk": pa.array(np.full(k, chunk, np.int64)), "n": pa.array(self.n.astype(np.int32)), "base": pa.array(np.full(k, getattr(self, "base", 0), np.int64))}
        schema = _request_schema()
        return pa.table([fill.get(f.name, self.columns.get(f.name, pa.nulls(k, f.type))) for f in schema], schema=schema)


def ids_of(t: pa.Table) -> np.ndarray:
    """The ids of all requests of a shard, end to end."""
    raw = column(t, "ids")
    n, base = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "base"))
    size = lengths(t, "ids")
    wide = size == 8 * n
    if not wide.any():
        return np.frombuffer(raw, np.uint32).astype(np.int64) + np.repeat(base, n)
    if wide.all():
        return np.frombuffer(raw, np.int64)
    ends, out = np.cumsum(size), []
    for e, s, b, w in zip(ends.tolist(), size.tolist(), base.tolist(), wide.tolist(), strict=True):
        part = raw[e - s : e]
        out.append(np.frombuffer(part, np.int64) if w else np.frombuffer(part, np.uint32).astype(np.int64) + b)
    return np.concatenate(out)


def column(t: pa.Table, name: str) -> bytes | memoryview:
    """A binary column's values end to end."""
    c = t.column(name).combine_chunks()
    if not len(c):
        return b""
    _, at, data = c.buffers()
    off = np.frombuffer(at, np.int32, len(c) + 1, 4 * c.offset)
    return memoryview(data)[off[0] : off[-1]] if data is not None else b""


def lengths(t: pa.Table, name: str) -> np.ndarray:
    c = t.column(name).combine_chunks()
    return np.diff(np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset)).astype(np.int64) if len(c) else np.zeros(0, np.int64)


def answers(table: pa.Table) -> dict[int, bytes]:
    """By kind, the replies' bits in order of shard."""
    kind, shard = table.column("kind").to_numpy(), table.column("shard").to_numpy()
    out = {}
    for k in np.unique(kind).tolist():
        own = np.flatnonzero(kind == k)
        out[k] = bytes(column(table.select(["bits"]).take(pa.array(own[np.argsort(shard[own])])), "bits"))
    return out


def reply(requests: DataFrame, answer: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, int]]) -> DataFrame:
    """One reply a packed request. answer takes all requests of a kind and shard to (a code an entry, entries by request, bits of a code)."""

    def run(t: pa.Table) -> pa.Table:
        codes, counts, width = answer(t)
        size = -(-counts * width // 8)
        ends = np.cumsum(size)
        bits = np.zeros(8 * int(size.sum()), np.uint8)
        at = spans(8 * (ends - size), counts * width)
        bits[at] = codes if width == 1 else ((codes[:, None] >> np.arange(width, dtype=np.uint8)) & 1).ravel()
        return pa.table({"chunk": t.column("chunk"), "kind": t.column("kind"), "shard": t.column("shard"), "bits": _binary(np.packbits(bits), ends)})

    return requests.groupBy("kind", "shard").applyInArrow(run, REPLY)


def codes(given: dict[int, bytes], kind: int, counts: np.ndarray, width: int = 1) -> np.ndarray:
    """The codes of all entries that a chunk sent as kind, in their order."""
    counts = np.asarray(counts, np.int64)
    if not counts.sum():
        return np.zeros(0, np.uint8)
    size = -(-counts * width // 8)
    bits = np.unpackbits(np.frombuffer(given[kind], np.uint8))
    bits = bits[spans(8 * (np.cumsum(size) - size), counts * width)]
    return bits if width == 1 else (bits.reshape(-1, width) << np.arange(width, dtype=np.uint8)).sum(1, dtype=np.uint8)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values by consecutive groups of given sizes, which may be 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
