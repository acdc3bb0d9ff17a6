"""Token ids in sorted-string-table shards.

Documents are put in ascending order of their id by a range partitioning; each partition becomes one table file, or
several of about FILE_BYTES:

    data blocks | index block | Bloom filter | footer

A data block holds entries in key order, each with the number of bytes its key shares with the key before, the rest of
the key, and the ids as little-endian integers of `width` bytes; every RESTART-th entry has its whole key, and the places
of those stand at the block's end. Blocks are zstd-compressed behind a CRC-32. The sparse index has each block's last
key, place, and the number of ids before it in the file. The footer has fixed size.

Key: 0 for a null id, else 1 and the id in big-endian order with its sign bit flipped; then a hash of the text and a
running number, so repeated ids and repeated rows have distinct, stable keys. Order: null ids first, then ascending ids,
then by that hash.

A task writes its file under a name of its own attempt in the shared folder and returns a manifest row; only files named
by the committed manifest count. The manifest (one row a file) gives each file's first id number; nothing else is
gathered. A file is read block by block, and looked up by binary search: manifest, Bloom filter, index, restart points.

Edge cases: null and empty texts have only the end id; an empty table gives no file and no rows. Only the id and text
columns are read.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import arrow_fs, fresh_path, slices, strings, written

END_ID = 2
BLOCK_BYTES = 64 << 10
FILE_BYTES = 256 << 20  # a file is closed at the first document past them
RESTART = 16
BITS_PER_KEY, PROBES = 10, 7
FOOTER = struct.Struct("<QQQQQQII8s")
MAGIC = b"SSTIDS01"

MANIFEST = "part int, number int, path string, bytes long, n_docs long, n_ids long, first_key binary, last_key binary"
_MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("bytes", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())])


def key_of(doc_id: int | None, tie: int, n: int) -> bytes:
    head = b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id & 0xFFFFFFFFFFFFFFFF) ^ (1 << 63))
    return head + struct.pack(">QI", (tie & 0xFFFFFFFFFFFFFFFF) ^ (1 << 63), n)


def id_of(key: bytes) -> int | None:
    return None if not key[0] else struct.unpack(">q", struct.pack(">Q", struct.unpack(">Q", key[1:9])[0] ^ (1 << 63)))[0]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(prefix: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(prefix), zlib.crc32(prefix, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.out, self.width, self.block_bytes, self.zstd = out, width, block_bytes, zstandard.ZstdCompressor(level=1)
        self.at = self.n_docs = self.n_ids = self.block_ids = self.held = 0
        self.block, self.restarts, self.entries, self.index = [], [], 0, []
        self.heads: set[bytes] = set()  # of one file, which has about FILE_BYTES at most
        self.key = self.first = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype(f"<u{self.width}").tobytes()
        if self.entries % RESTART == 0:
            self.restarts.append(self.held)
            shared = 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(self.key, key)) if a != b), min(len(self.key), len(key)))
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.held += len(entry) + len(value)
        self.entries += 1
        self.first = self.first or key
        self.key = key
        self.heads.add(key[:9])
        self.n_docs += 1
        self.block_ids += len(ids)
        if self.held >= self.block_bytes:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if not self.entries:
            return
        data = b"".join(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        packed = self.zstd.compress(data)
        place = self._put(struct.pack("<I", zlib.crc32(packed)) + packed)
        self.index.append((self.key, *place, self.n_ids))
        self.n_ids += self.block_ids
        self.block, self.restarts, self.entries, self.held, self.block_ids = [], [], 0, 0, 0

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) + _varint(ids) for k, a, n, ids in self.index)
        bits = max(64, BITS_PER_KEY * self.n_docs)
        bloom = np.zeros(-(-bits // 8) * 8, np.uint8)
        for head in self.heads:
            bloom[_probes(head, bits)] = 1
        places = self._put(zlib.compress(index)) + self._put(np.packbits(bloom).tobytes())
        self._put(FOOTER.pack(*places, self.n_docs, self.n_ids, self.width, bits, MAGIC))
        self.out.close()


class Table:
    """A table file opened for reading."""

    def __init__(self, path: str, size: int):
        import zstandard

        fs, local = arrow_fs(path)
        self.file, self.zstd = fs.open_input_file(local), zstandard.ZstdDecompressor()
        *places, self.n_docs, self.n_ids, self.width, self.bits, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no table of token ids")
        data, at, self.index = zlib.decompress(self._read(*places[:2])), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at: at + n], at + n
            place, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            before, at = _read_varint(data, at)
            self.index.append((key, place, size, before))
        self.last = [k[:9] for k, *_ in self.index]  # of each block
        self.bloom_at = places[2:]
        self.bloom: np.ndarray | None = None

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def close(self) -> None:
        self.file.close()

    def block(self, i: int) -> bytes:
        _, at, n, _ = self.index[i]
        data = self._read(at, n)
        if zlib.crc32(data[4:]) != struct.unpack("<I", data[:4])[0]:
            raise ValueError("a block is damaged")
        return self.zstd.decompress(data[4:])

    @staticmethod
    def _restarts(data: bytes) -> tuple[list[int], int]:
        n = struct.unpack("<I", data[-4:])[0]
        end = len(data) - 4 - 4 * n
        return list(struct.unpack(f"<{n}I", data[end:-4])), end

    def _entries(self, data: bytes, at: int, end: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < end:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at: at + rest]
            at += rest
            yield key, np.frombuffer(data, f"<u{self.width}", n // self.width, at)
            at += n

    def scan(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the file, ids) of every document in key order."""
        for i, (_, _, _, before) in enumerate(self.index):
            data = self.block(i)
            for key, ids in self._entries(data, 0, self._restarts(data)[1]):
                yield key, before, ids
                before += len(ids)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of the documents with this id: Bloom filter, then binary search in index and restart points."""
        head = key_of(doc_id, 0, 0)[:9]
        if self.bloom is None:
            self.bloom = np.unpackbits(np.frombuffer(self._read(*self.bloom_at), np.uint8))
        if not self.bloom[_probes(head, self.bits)].all():
            return []
        out = []
        for i in range(bisect.bisect_left(self.last, head), len(self.index)):
            data = self.block(i)
            restarts, end = self._restarts(data)
            low, high = 0, len(restarts) - 1
            while low < high:  # the last restart point whose key is before the sought one
                mid = (low + high + 1) // 2
                if next(self._entries(data, restarts[mid], end))[0][:9] < head:
                    low = mid
                else:
                    high = mid - 1
            for key, ids in self._entries(data, restarts[low], end):
                if key[:9] > head:
                    return out
                if key[:9] == head:
                    out.append(ids)
        return out


def _writer(folder: str, tokenizer: str, end_id: int, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparkseek.llm.bpe import Encoder

        encoder = out = None
        before, n, number = None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "number": [number], "path": [f"{folder}/{name}"], "bytes": [out.at], "n_docs": [out.n_docs], "n_ids": [out.n_ids], "first_key": [out.first], "last_key": [out.key]}, _MANIFEST)

        for batch in slices(batches, "text"):
            if encoder is None:
                encoder = Encoder(tokenizer)
                fs, root = arrow_fs(folder)
                fs.create_dir(root, recursive=True)
                width = 2 if max(encoder.n_vocab, end_id + 1) <= 1 << 16 else 4
            ids, bounds = encoder.encode(*strings(batch.column(2)))
            bounds = bounds.tolist()
            for doc_id, tie, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bounds[:-1], bounds[1:]):
                if out is not None and out.at >= file_bytes:
                    yield close()
                    out, number = None, number + 1
                if out is None:
                    name = f"{uuid.uuid4().hex}.sst"
                    out = Writer(fs.open_output_stream(f"{root}/{name}"), width)
                n = n + 1 if (doc_id, tie) == before else 0
                before = (doc_id, tie)
                out.add(key_of(doc_id, tie, n), np.append(ids[a:b], np.uint32(end_id)))
        if out is not None:
            yield close()

    return write


def write_tables(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The manifest of the written tables, with `start`: the number of ids in the tables before."""
    from pyspark.sql import Window

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = written(ordered.mapInArrow(_writer(fresh_path(spark, "sst"), tokenizer, end_id, file_bytes), MANIFEST), "sst-manifest")
    before = F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])


def _scanner(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                table, rows, held = Table(path, size), [], 0
                for key, before, ids in table.scan():
                    rows.append({"doc_id": id_of(key), "start": start + before, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "ids": ids.tolist() if with_ids else None})
                    held += 50 + (8 * len(ids) if with_ids else 0)
                    if held >= 1 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ROWS)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ROWS)
                table.close()

    return read


def read_tables(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document of the tables: doc_id, start, n_tokens, ids_crc32 and, if wanted, the ids."""
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2)
    return manifest.select("path", "bytes", "start").repartition(n, "path").mapInArrow(_scanner(with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def lookup(manifest: list, doc_id: int | None) -> list[np.ndarray]:
    """The ids of the documents with this id, from the manifest's collected rows (one a file) in the order of keys, which
    is that of part and number. An empty manifest holds no document."""
    head, out = key_of(doc_id, 0, 0)[:9], []
    at = bisect.bisect_left(manifest, head, key=lambda row: bytes(row["last_key"])[:9])
    while at < len(manifest) and bytes(manifest[at]["first_key"])[:9] <= head:
        table = Table(manifest[at]["path"], manifest[at]["bytes"])
        out += table.get(doc_id)
        table.close()
        at += 1
    return out


def lookup_many(manifest: list, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids of every document whose id is asked for, from the manifest's rows as `lookup` takes them: an id is
    sent to the files whose keys reach over it, and each file is opened once a task and searched. An id that no file holds
    gives no row; so does an empty manifest."""
    lows, highs = ([bytes(r[c])[:9] for r in manifest] for c in ("first_key", "last_key"))
    places = [(r["path"], r["bytes"]) for r in manifest]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id in batch.column(0).to_pylist():
                head = key_of(doc_id, 0, 0)[:9]
                at = bisect.bisect_left(highs, head)
                while at < len(places) and lows[at] <= head:
                    out.append({"path": places[at][0], "bytes": places[at][1], "doc_id": doc_id})
                    at += 1
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("doc_id", pa.int64())]))

    asked = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    found = asked.mapInArrow(find, "path string, bytes long, doc_id long").repartition("path").sortWithinPartitions("path", "doc_id")
    return found.mapInArrow(_getter, "doc_id long, ids array<long>")


def _getter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of files."""
    table, now = None, None
    for batch in batches:
        rows = []
        for path, size, doc_id in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "doc_id"))):
            if path != now:
                if table is not None:
                    table.close()
                table, now = Table(path, size), path
            rows += [{"doc_id": doc_id, "ids": ids.tolist()} for ids in table.get(doc_id)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))
    if table is not None:
        table.close()
