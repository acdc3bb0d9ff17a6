"""Shared helpers of the training-data operators: shared tables, Arrow text access, word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step of a Python worker handles (a longer text is a step of its own).
STEP_BYTES = 4 << 20
#: Shuffle partitions for each core, and how many are always allowed.
PER_CORE, LEAST_PARTITIONS = 16, 256
#: Used only where the session names no shared folder (tests, a single machine).
LOCAL_SHARED = "file:///tmp/checkpoints/sparkseek"


# --- shared storage -------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, else what setCheckpointDir was given, else, on a
    single machine only, a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        found = LOCAL_SHARED
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: What this session has written and not removed.
_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def removed(spark: SparkSession, *paths: str) -> None:
    """Removes tables that nothing reads any more: what follows from them is written."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in _MADE:
            _MADE.remove(path)


def release(spark: SparkSession) -> None:
    """Removes all that operators of this session have left in the shared folder, archives and token tables included. For
    callers, once they have stored the results: these are lazy and read the tables."""
    removed(spark, *list(_MADE))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables of `written`."""
    for t in tables:
        removed(t.sparkSession, t.written_path)


def arrow_fs(uri: str):
    """(filesystem, path) of a URI or of a plain local path."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, at = arrow_fs(uri)
    fs.create_dir(at, recursive=True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --- Arrow access ---------------------------------------------------------------------------------------------


def strings(column) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]: offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds at most `limit` bytes of the column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = strings(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def separated(data: np.ndarray, offs: np.ndarray, fill: int = 32, before: int = 0, after: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The texts with `before` and `after` fill bytes around each; also where each text starts."""
    n = len(offs) - 1
    lens = np.diff(offs)
    starts = offs[:-1] + before + np.arange(n) * (before + after)
    out = np.full(len(data) + n * (before + after), fill, np.uint8)
    for s, o, k in zip(starts.tolist(), offs[:-1].tolist(), lens.tolist()):
        out[s: s + k] = data[o: o + k]
    return out, starts


def blocks_of(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `limit` bytes of the column: small batches are joined, large ones are cut."""
    waiting, held = [], 0
    for batch in slices(batches, column, limit):
        size = len(strings(batch.column(batch.schema.get_field_index(column)))[0])
        if waiting and held + size > limit:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, held = [], 0
        waiting.append(batch)
        held += size
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def text_bytes(docs: DataFrame) -> int:
    """The bytes of the column text, for numbers of partitions and buckets only."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def partitions(spark: SparkSession, wanted: int) -> int:
    """A number of shuffle partitions: as wanted, but no more than PER_CORE for each core and LEAST_PARTITIONS at least
    allowed; beyond that a task streams several buckets, one after the other."""
    return max(1, min(int(wanted), max(LEAST_PARTITIONS, PER_CORE * spark.sparkContext.defaultParallelism)))


# --- packed arrays --------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value, the bytes of each in planes."""
    import zstandard

    arrays = tuple(np.ascontiguousarray(a) for a in arrays)
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    kinds = "".join(a.dtype.char for a in arrays).encode()
    return zstandard.ZstdCompressor(level=level).compress(b"".join([head, kinds, *(a.tobytes() if a.itemsize == 1 else np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)]))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    lens = np.frombuffer(raw, np.int64, n, 8).tolist()
    at, out = 8 + 8 * n + n, []
    for size, kind in zip(lens, raw[8 + 8 * n: 8 + 9 * n].decode()):
        dtype = np.dtype(kind)
        part = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(part.T).view(dtype).reshape(size))
        at += size * dtype.itemsize
    return out


def grouped_order(h: np.ndarray) -> np.ndarray:
    """An order in which equal values stand together."""
    n = len(h)
    bits = max(1, (n - 1).bit_length())
    if bits <= 24:  # much faster than an argsort
        low = np.uint64((1 << bits) - 1)
        order = (np.sort((h & ~low) | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
        s = h[order]
        if not (((s[1:] ^ s[:-1]) <= low) & (s[1:] != s[:-1])).any():
            return order
    return np.argsort(h, kind="stable")


# --- words ----------------------------------------------------------------------------------------------------

_seeded = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _seeded.integers(0, 1 << 64, 256 * 64, dtype=np.uint64)
_FAR = _seeded.integers(0, 1 << 64, 1024, dtype=np.uint64) | np.uint64(1)
_FARTHER = _seeded.integers(0, 1 << 64, 4096, dtype=np.uint64) | np.uint64(1)
#: Kinds of bytes: a word is a run of one kind other than 0.
WORDS = np.ones(256, np.uint8)
WORDS[[32, 9, 10, 11, 12, 13]] = 0
#: Letters, digits and all non-ASCII bytes against punctuation.
WORDS_AND_MARKS = WORDS.copy()
WORDS_AND_MARKS[[b for b in range(128) if WORDS[b] and not chr(b).isalnum()]] = 2
_FAR[0] = _FARTHER[0] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's steps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` (or the runs of a kind) of several texts: 64-bit hash, byte start and length, and each text's range."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = True, kinds: np.ndarray = WORDS):
        buf, starts = separated(data, offs)
        self.buf = LOWER[buf] if lower else buf
        kind = kinds[buf]
        begin = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1)).astype(np.int32)
        sizes = np.diff(begin, append=np.int32(len(buf)))
        real = kind[begin] != 0 if len(buf) else np.zeros(1, bool)
        self.start, self.size = begin[real].astype(np.int64), sizes[real].astype(np.int64)
        self.first = np.searchsorted(self.start, np.append(starts, len(buf)))
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        pos = np.arange(len(buf), dtype=np.int32) - np.repeat(begin, sizes)
        part = np.take(_TABLE, (self.buf.astype(np.uint16) << np.uint16(6)) | (pos & 63).astype(np.uint16))
        if self.size.max() > 64:
            far = np.flatnonzero(pos > 63)
            part[far] *= _FAR[(pos[far] >> 6) & 1023] * _FARTHER[(pos[far] >> 16) & 4095]
        self.hash = mix(np.add.reduceat(part, begin)[real] + self.size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __len__(self) -> int:
        return len(self.hash)


def shingles(words: Words, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its k-word shingles; fewer words: the whole sequence as one; none: empty."""
    h, n = words.hash, len(words)
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
    full = np.zeros(0, np.uint64)
    if n >= k:
        full = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            full += h[j: n - k + 1 + j] * odd[j % 5] + np.uint64(j)
            full = mix(full) if j < k - 1 else mix(full + np.uint64(k))
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            s = np.sort(full[a: b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = mix(one * odd[0] + x)
            yield one
        else:
            yield np.zeros(0, np.uint64)


# --- sums of matrices -----------------------------------------------------------------------------------------

TASKS = 4  # for each core
_CHUNK = pa.schema([("chunk", pa.int32()), ("data", pa.binary())])


def accumulate(rows: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], n_rows: int, n_cols: int, dtype: type = np.int64, column: str = "text") -> np.ndarray:
    """The sum over all rows of what `add` adds to an n_rows x n_cols matrix, on the driver.

    Its size is fixed by the two numbers, whatever the input: each task keeps one such matrix and sends it as compressed
    chunks of rows. There are TASKS a core at most, each with many input splits, so what is sent follows the cluster and
    not the input; chunks are summed in groups of tasks and then over the groups, as they stream by, and only the sums go
    to the driver.
    """
    import zlib

    size = max(1, -(-n_rows // 64))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    groups = max(1, cores * TASKS // 256)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros((n_rows, n_cols), dtype)
        for batch in slices(batches, column):
            add(matrix, batch)
        group = TaskContext.get().partitionId() % groups
        for i in range(0, n_rows, size):
            part = matrix[i: i + size]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": [i // size * groups + group], "data": [zlib.compress(part.tobytes(), 1)]}, _CHUNK)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(data), dtype)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        for chunk, part in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "data": [zlib.compress(part.tobytes(), 1)]}, _CHUNK)

    fields = "chunk int, data binary"
    sums = rows.coalesce(TASKS * cores).mapInArrow(work, fields).repartition(min(64 * groups, max(1, cores * 2)), "chunk").mapInArrow(total, fields)
    if groups > 1:
        sums = sums.withColumn("chunk", F.floor(F.col("chunk") / groups).cast("int")).repartition(min(64, cores * 2), "chunk").mapInArrow(total, fields)
    out = np.zeros((n_rows, n_cols), dtype)
    for r in sums.collect():
        part = np.frombuffer(zlib.decompress(r["data"]), dtype).reshape(-1, n_cols)
        out[r["chunk"] * size: r["chunk"] * size + len(part)] += part
    return out
