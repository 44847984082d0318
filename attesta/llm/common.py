"""What the corpus operators share: session settings, the shared folder, Arrow buffers and numpy hashing.

Text columns cross to Python as Arrow buffers and are worked on as flat byte arrays; no Python object is made per character or word.
"""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in one Arrow batch on its way to Python (a batch ends with the row that reaches them); batches are put together again up to CHUNK_BYTES.
BATCH_BYTES = 1 << 20
CHUNK_BYTES = 3 << 19
#: Bytes a task may receive as a broadcast. Every broadcast in this subpackage is measured against it and has another way beyond it.
BROADCAST_BYTES = 32 << 20
#: Stands for a null doc_id where ids are compared: smaller than every id.
NULL_ID = -(1 << 63)
#: ASCII white space, as the contracts define it.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def tune(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch in this session (the setting is read when a plan runs, so it stays set), and let go of tables that nothing reads any more."""
    sweep(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local run gets a folder of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file:///tmp/attesta-{os.getuid()}-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/attesta/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and a lost executor costs nothing that was finished."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return held(df.sparkSession.read.schema(df.schema).parquet(path), path)


#: Tables in the shared folder: their session, the thread that made them, a weak reference to what reads them, path and name in the catalogue.
_HELD: list[tuple[SparkSession, int, JavaObject, str, str | None]] = []


def held(df: DataFrame, path: str, table: str | None = None) -> DataFrame:
    """df, a plain scan of path, or of a table that lies there. Every plan that is made of df has its relation; once the driver has collected them all, sweep() deletes the files."""
    spark = df.sparkSession
    if table:
        spark.catalog.refreshTable(table)  # else the catalogue's cache has the relation too
    _HELD.append((spark, threading.get_ident(), spark.sparkContext._jvm.java.lang.ref.WeakReference(_relation(df)), path, table))
    return df


def _relation(df: DataFrame) -> JavaObject:
    return df._jdf.queryExecution().analyzed().collectLeaves().head().relation()


def sweep(spark: SparkSession, done: list | None = None, but: DataFrame | None = None) -> None:
    """Delete the tables of this session that no DataFrame reads any more, so far as the driver's garbage was collected: a DataFrame that can be reached keeps its tables (an RDD taken from it needn't).

    done: what held_now() gave. What this thread made since goes at once, but for what but, a plain scan, reads.
    """
    left, ours = [], None if done is None else {id(x) for x in done}
    for x in list(_HELD):
        session, thread, reader, path, table = x
        if session.sparkContext._jsc is None:  # it was stopped, what it left stays
            continue
        own = session.sparkContext is spark.sparkContext
        over = own and ours is not None and id(x) not in ours and thread == threading.get_ident() and not (but is not None and _relation(but).equals(reader.get()))
        if not own or not over and reader.get() is not None:
            left.append(x)
            continue
        if table:
            spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        _delete(spark, path)
    _HELD[:] = left


def held_now() -> list:
    return list(_HELD)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Delete what the operators wrote into the shared folder, once their results are written elsewhere. DataFrames that still read it fail afterwards."""
    for t in spark.catalog.listTables():
        if t.name.startswith("attesta_"):
            spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    _delete(spark, f"{shared_dir(spark)}/attesta")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return wide(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def wide(scan: DataFrame) -> DataFrame:
    """A scan of several splits that are fewer than the cores (a file of one row group is work for one task), spread over all of them; larger tables stay where they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 1 < scan.rdd.getNumPartitions() < cores else scan


def held_out(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 5 = 0; a null id belongs to no fold that may be learnt from, so it is held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about size bytes; only a batch that is larger by itself makes one beyond 1.5 times that."""
    held, n = [], 0
    for b in batches:
        if held and n + b.nbytes > 1.5 * size:
            yield from _joined(held)
            held, n = [], 0
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield from _joined(held)
            held, n = [], 0
    if held:
        yield from _joined(held)


def _joined(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    if len(held) == 1:
        return held
    if sum(b.nbytes for b in held) > 1 << 30:  # 32-bit offsets end at 2 GB
        return held
    return pa.Table.from_batches(held).combine_chunks().to_batches()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty. offsets start at 0."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    off = np.frombuffer(at, dtype=np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def padded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(data with 8 zero bytes after it, the little-endian 64-bit word that begins at each of its bytes, as a view)."""
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = data
    return raw, np.ndarray((len(data) + 1,), "<u8", buffer=raw.data, strides=(1,))


#: Byte ranges beyond so many bytes are hashed one by one by xxh3.
BY_XXH3 = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


class Hasher:
    """64-bit hashes of sequences, by a step that takes two words to one, is a bijection in either of them and isn't linear.

    A polynomial modulo 2**64 has equal values for different sequences of regular build, whatever its base (Thue-Morse words); steps of multiplication and
    shift have no such structure. Hashers with different seeds are independent.
    """

    def __init__(self, seed: int):
        self.seed = seed
        r = np.random.default_rng(seed)
        self.a, self.b, self.c = (np.uint64(int(x) | 1) for x in r.integers(1 << 62, 1 << 63, 3, dtype=np.uint64))

    def __reduce__(self):
        return Hasher, (self.seed,)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * self.a
        x ^= x >> np.uint64(32)
        x += b
        x *= self.b
        x ^= x >> np.uint64(29)
        return x

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """Of every window of width values (uint64), from windows of powers of two that overlap."""
        size = 1
        while 2 * size <= width:
            values, size = self.pair(values[:-size], values[size:]) if len(values) > size else values[:0], 2 * size
        if width > size:
            rest = width - size
            values = self.pair(values[:-rest], values[rest:]) if len(values) > rest else values[:0]
        return mix(values)

    def every(self, wide: np.ndarray, n: int, width: int) -> np.ndarray:
        """Of the windows of width bytes, 8 or more, that begin at the first n places; wide: the 64-bit words at each place."""
        if n <= 0:
            return np.zeros(0, np.uint64)
        wide = np.array(wide[: n + width - 8])
        h = wide[:n] ^ self.c
        for k in [*range(8, width - 7, 8), *([width - 8] if width % 8 else [])]:
            h = self.pair(h, wide[k : k + n])
        return mix(h)

    def ranges(self, raw: np.ndarray, wide: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of byte ranges; raw and wide as padded() gives them. Depends on a range's bytes and their number only."""
        size = end - start
        h = size.astype(np.uint64) * self.c
        live = np.flatnonzero((size > 0) & (size <= BY_XXH3))
        at, left, own = start[live], size[live], h[live]
        while len(live):
            own = self.pair(own, wide[at] & _MASK[np.minimum(left, 8)])
            done = left <= 8
            if done.any():
                h[live[done]] = own[done]
                go = ~done
                live, at, left, own = live[go], at[go], left[go], own[go]
            at, left = at + 8, left - 8
        for i in np.flatnonzero(size > BY_XXH3).tolist():
            h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]], self.seed)
        return mix(h)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges start, start+1, ... of given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    lengths, starts = np.asarray(lengths, np.int64), np.asarray(starts, np.int64)
    keep = lengths > 0
    lengths, starts = lengths[keep], starts[keep]
    at = np.cumsum(lengths)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def words(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text) of the maximal runs of non-space bytes; runs end with their text. first has one more entry than texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~is_space[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(df: DataFrame, *fields: tuple[str, str], drop: tuple[str, ...] = ()) -> str:
    """DDL of df's columns, those named in drop or fields left out, with the fields after them."""
    gone = {x.lower() for x in drop} | {n.lower() for n, _ in fields}
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name.lower() not in gone]
    return ", ".join(own + [f"`{n}` {t}" for n, t in fields])
