"""Removal of repeated substrings with a column-wise built multi-document suffix order.

Every byte covered by a string of LENGTH bytes that also starts in a document with a smaller id is removed.

Pieces. The collection Burrows-Wheeler construction needs a round for each symbol of the longest document, so whole
documents of 100 kB would take 100,000 passes. They are cut so that 2 * LENGTH - ANCHOR rounds do for any document: every
string of LENGTH bytes has an anchor, its ANCHOR-gram with the smallest hash, and equal strings have it at the same place.
Around each anchor stands a piece that holds all strings of LENGTH bytes through it, with bytes 255 beyond the document's
ends (UTF-8 never holds 255). So two equal strings always lie at the same offset of two pieces with equal anchors.

Columns. The pieces of a bucket of anchors are written as one sequential file a column. Then one symbol of every piece
is inserted each round, from the last column to the first: a stable sort by the symbol gives the order of the pieces'
suffixes from their order one symbol shorter (the symbols in that order are the column's Burrows-Wheeler transform), and
the common prefixes of neighbours are 0 where the symbols differ, else one more than the smallest common prefix between
the two in the old order. Where the common prefixes reach LENGTH, neighbours hold the same string; its smallest id
decides for all. Memory is the order, the common prefixes and the ids; the symbols stay in the files.

Execution. 1. Documents are packed into blocks; a block lists its distinct anchors for buckets by hash. 2. A bucket tells
which anchors occur in several documents. 3. A block sends its distinct pieces at such anchors, each with its smallest
document id, so copies are sent once a block however many there are. 4. A bucket builds the columns and answers, for each
piece and offset, whether a smaller document has the string. 5. A block marks its documents' bytes. No anchor's
occurrences are ever one row each, and nothing is sent to the driver.

Edge cases: null and empty texts have nothing to remove; a null id counts as larger than all others; documents with equal
ids don't remove each other's strings; an empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import fresh_path, grouped_order, mix, pack, partitions, removed, separated, slices, strings, text_bytes, unpack, written

LENGTH = 50
ANCHOR = 20
BLOCK = 4 << 20
PACKED = 6  # zstd level of the texts, which are stored once and shuffled twice
BUCKET_BYTES = 6 << 20  # of text for each bucket
HOT_BLOCKS = 64  # an anchor that so many blocks hold is hot
ANCHORS, FLAGS, ANSWERS, DOCS = range(4)
LAST_ID = (1 << 63) - 1

FIELDS = "kind int, bucket int, block long, data binary"
_FIELDS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
_LETTERS = np.random.Generator(np.random.PCG64(50)).integers(0, 1 << 64, 256, dtype=np.uint64)
_FACTOR = 0x9E3779B97F4A7C15


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of each `width` values in a row."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = least(out[:-step], out[step:])
        have += step
    return out


class Block:
    """The documents of a block in one buffer with room for pieces around each, and its anchors in the order of places."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offs: np.ndarray, length: int, anchor: int):
        self.ids, self.offs, self.length, self.anchor = ids, offs, length, anchor
        self.before = length - anchor
        self.buf, self.starts = separated(data, offs, fill=255, before=self.before, after=length)
        self.ends = self.starts + np.diff(offs)
        n = len(self.buf)
        self.places, self.hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n < length:
            self.doc = np.zeros(0, np.int64)
            return
        # hashes of all anchor-length strings, by doubling
        parts, size, power, grams = [], 1, _FACTOR, _LETTERS[self.buf]
        whole, done = None, 0
        while size <= anchor:
            if anchor & size:
                if whole is None:
                    whole, done = grams, size
                else:  # whole covers the places before, grams the ones behind
                    m = n - done - size + 1
                    whole, done = whole[:m] * np.uint64(power) + grams[done: done + m], done + size
            if size * 2 > anchor:
                break
            m = n - 2 * size + 1
            grams = grams[:m] * np.uint64(power) + grams[size: size + m]
            power = power * power % (1 << 64)
            size *= 2
        del grams, parts
        whole = mix(whole)
        rank = (whole >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # 0 is for what leaves the document
        lowest = _sliding(rank, length - anchor + 1, np.minimum)  # for every string of `length` bytes
        for s, e in zip(self.starts.tolist(), self.ends.tolist()):
            lowest[max(s, e - length + 1): e + length] = 0  # strings that leave the document
            lowest[s - self.before: s] = 0
            if e - s < length:
                lowest[s - self.before: e] = 0
        width = length - anchor + 1
        reach = _sliding(np.concatenate((np.zeros(width - 1, np.uint32), lowest, np.zeros(width - 1, np.uint32))), width, np.maximum)
        self.places = np.flatnonzero((reach == rank) & (reach > 0))
        self.hash = whole[self.places]
        self.doc = np.searchsorted(self.starts, self.places, "right") - 1

    def distinct(self, n_buckets: int) -> tuple[np.ndarray, ...]:
        """The distinct anchors by (bucket, hash): bucket, hash in the bucket, whether several documents of the block have
        it; and for every place the number of its anchor."""
        order = grouped_order(self.hash)
        s = self.hash[order]
        new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(s)) - 1
        doc = self.doc[order]
        if len(begin):
            # the order keeps places ascending only where values are equal
            several = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
        else:
            several = np.zeros(0, bool)
        del end
        key = s[begin]
        bucket = (key % np.uint64(n_buckets)).astype(np.int32)
        small = (key >> np.uint64(24)).astype(np.uint32)
        by = np.lexsort((small, bucket))
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        of = np.empty(len(s), np.int64)
        of[order] = number[np.cumsum(new) - 1]
        return bucket[by], small[by], several[by], of

    def pieces(self, chosen: np.ndarray) -> np.ndarray:
        at = self.places[chosen][:, None] - self.before + np.arange(2 * self.length - self.anchor)
        return self.buf[at]


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of an ascending column."""
    ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        yield int(bucket[a]), a, b


def _blocks(n_buckets: int, length: int, anchor: int, block_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", block_bytes):
            name = uuid.uuid4().int >> 65
            data, offs = strings(batch.column(1))
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = ids.fill_null(LAST_ID).to_numpy()
            bucket, small, several, _ = Block(ids, data, offs, length, anchor).distinct(n_buckets)
            rows = [{"kind": ANCHORS, "bucket": k, "block": name, "data": pack(np.diff(small[a:b], prepend=np.uint32(0)), several[a:b].astype(np.uint8))} for k, a, b in _cuts(bucket)]
            rows.append({"kind": DOCS, "bucket": -1, "block": name, "data": pack(ids, known, offs, data.copy(), level=PACKED)})
            yield pa.RecordBatch.from_pylist(rows, _FIELDS)

    return work


def _flag(hot_blocks: int):
    """Rows in the order of buckets: for each block's anchors, whether several documents have them, and whether
    `hot_blocks` blocks do."""

    def member(every: np.ndarray, small: np.ndarray) -> np.ndarray:
        return every[np.minimum(np.searchsorted(every, small), len(every) - 1)] == small if len(every) else np.zeros(len(small), bool)

    def done(bucket: int, held: list) -> pa.RecordBatch:
        s = np.sort(np.concatenate([h[1] for h in held]))
        twice = s[1:][s[1:] == s[:-1]]
        hot = np.unique(s[hot_blocks - 1:][s[hot_blocks - 1:] == s[: len(s) - hot_blocks + 1]]) if len(s) >= hot_blocks else s[:0]
        often = np.unique(np.concatenate((twice, *(h[1][h[2] > 0] for h in held)))) if len(s) else s
        rows = [{"kind": FLAGS, "bucket": bucket, "block": block, "data": b"".join(np.packbits(member(x, small)).tobytes() for x in (often, hot))} for block, small, _ in held]
        return pa.RecordBatch.from_pylist(rows, _FIELDS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, block, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if bucket != now:
                    if held:
                        yield done(now, held)
                    now, held = bucket, []
                steps, several = unpack(data)
                held.append((block, np.cumsum(steps, dtype=np.uint32), several))
        if held:
            yield done(now, held)

    return work


class _Chosen:
    """The places of a block whose anchors several documents have, and its distinct pieces there, in the order of buckets.

    A piece is sent to its anchor's bucket. One at a hot anchor is sent to two buckets of its own surroundings instead: by
    the anchor with the bytes before it, where all its strings meet their like that begin early in the piece, and by the
    anchor with the bytes behind it, where those do that end late. Every string does one or the other."""

    def __init__(self, block: Block, flags: dict[int, bytes], n_buckets: int):
        bucket, _, _, of = block.distinct(n_buckets)
        found, hot = np.zeros(len(bucket), bool), np.zeros(len(bucket), bool)
        for k, a, b in _cuts(bucket):
            bits = np.frombuffer(flags[k], np.uint8).reshape(2, -1)
            found[a:b], hot[a:b] = (np.unpackbits(x, count=b - a).astype(bool) for x in bits)
        self.at = np.flatnonzero(found[of])
        self.pieces = block.pieces(self.at)
        self.ids = block.ids[block.doc[self.at]]
        key = self._hash(0, self.pieces.shape[1], np.arange(len(self.at)))
        half = block.before // 2
        own, split = np.flatnonzero(~hot[of[self.at]]), np.flatnonzero(hot[of[self.at]])
        near = [(self._hash(a, b, split) % np.uint64(n_buckets)).astype(np.int32) for a, b in ((block.before - half, block.length), (block.before, block.length + half))]
        self.place = np.concatenate((own, split, split))  # of each sent piece
        self.bucket = np.concatenate((bucket[of[self.at[own]]], *near))
        # of equal pieces in a bucket the first one has the smallest id
        order = np.lexsort((self.ids[self.place], key[self.place], self.bucket))
        k, of_bucket = key[self.place][order], self.bucket[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (of_bucket[1:] != of_bucket[:-1]))) if len(k) else np.zeros(0, bool)
        self.first = order[new]
        self.number = np.empty(len(k), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.split = len(split)

    def _hash(self, a: int, b: int, rows: np.ndarray) -> np.ndarray:
        """Of the bytes from a to b of pieces."""
        wide = -(-(b - a) // 8)
        padded = np.zeros((len(rows), wide * 8), np.uint8)
        padded[:, : b - a] = self.pieces[rows, a:b]
        factors = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 63, wide, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return mix((mix(padded.view(np.uint64)) * factors).sum(1, dtype=np.uint64))

    def masks(self, bits: np.ndarray, offsets: int) -> np.ndarray:
        """For each place the offsets, as bits, of its repeated strings, from the answers to the sent pieces."""
        got = bits[self.number]
        ids = self.ids[self.place]
        # a document behind the smallest one of its block with the very same piece has all its strings from there
        got = np.where(ids > ids[self.first][self.number], np.uint64((1 << offsets) - 1), got) if len(got) else got
        out, n = np.zeros(len(self.at), np.uint64), len(got) - 2 * self.split
        out[self.place[:n]] = got[:n]
        for part in (slice(n, n + self.split), slice(n + self.split, None)):
            out[self.place[part]] |= got[part]
        return out


def _opened(batches: Iterator[pa.RecordBatch], length: int, anchor: int):
    """Rows in the order of (block, kind): (name, block, id mask, rows of the kinds before)."""
    now, held = None, {}
    for batch in batches:
        for kind, bucket, name, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if name != now:
                now, held = name, {FLAGS: {}, ANSWERS: {}}
            if kind != DOCS:
                held[kind][bucket] = data
                continue
            ids, known, offs, text = unpack(data)
            yield name, Block(ids, text, offs, length, anchor), known == 0, held


def _send(n_buckets: int, length: int, anchor: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, _, held in _opened(batches, length, anchor):
            c = _Chosen(block, held[FLAGS], n_buckets)
            rows = []
            for k, a, b in _cuts(c.bucket[c.first]):
                part = c.first[a:b]
                rows.append({"kind": ANCHORS, "bucket": k, "block": name, "data": pack(c.ids[c.place[part]], c.pieces[c.place[part]].ravel())})
            yield pa.RecordBatch.from_pylist(rows, _FIELDS)

    return work


class Columns:
    """The pieces of a bucket as one sequential file a column; `repeats` inserts a symbol of every piece a round."""

    def __init__(self, folder: str, width: int):
        self.paths = [os.path.join(folder, f"column-{j}") for j in range(width)]
        self.files = [open(p, "wb") for p in self.paths]  # noqa: SIM115
        self.ids: list[np.ndarray] = []

    def add(self, ids: np.ndarray, pieces: np.ndarray) -> None:
        self.ids.append(ids)
        for f, column in zip(self.files, np.ascontiguousarray(pieces.T)):
            f.write(column.tobytes())

    def repeats(self, length: int) -> np.ndarray:
        """For each piece the offsets, as bits, at which a smaller id has the same string of `length` bytes."""
        for f in self.files:
            f.close()
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        n, width = len(ids), len(self.paths)
        out = np.zeros(n, np.uint64)
        if not n:
            return out
        order = np.arange(n)
        common = np.full(n + 1, 0, np.uint8)  # common[i]: of the suffixes at i - 1 and i; all are empty yet
        left, right, edge = np.full(n, 0, np.int32), np.full(n, width, np.int32), np.zeros(n, bool)
        for j in range(width - 1, -1, -1):
            symbol = np.fromfile(self.paths[j], np.uint8)
            outside = symbol == 255
            edge = outside  # a string is whole if it has no byte 255: these stand at a piece's ends only
            left[edge & (left == 0) & (j < width // 2)] = j + 1
            right[edge & (j >= width // 2)] = j
            bwt = symbol[order]
            move = np.argsort(bwt, kind="stable")
            s = bwt[move]
            same = np.flatnonzero(s[1:] == s[:-1]) + 1
            fresh = np.zeros(n + 1, np.uint8)
            if len(same):
                bounds = np.empty(2 * len(same), np.int64)
                bounds[0::2], bounds[1::2] = move[same - 1] + 1, move[same] + 1
                fresh[same] = np.minimum.reduceat(common, bounds)[::2] + 1
            common, order = fresh, order[move]
            if j <= width - length:
                begin = np.flatnonzero(common[:n] < length)
                own = ids[order]
                least = np.repeat(np.minimum.reduceat(own, begin), np.diff(np.append(begin, n)))
                hit = order[own > least]
                whole = right[hit] >= j + length
                out[hit[whole]] |= np.uint64(1 << j)
        # what begins before the document's first byte is no string of it
        return out & ~((np.uint64(1) << left.astype(np.uint64)) - np.uint64(1))


def _answer(length: int, anchor: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * length - anchor
        now, folder, columns, blocks = None, None, None, []

        def done() -> pa.RecordBatch:
            bits, at, rows = columns.repeats(length), 0, []
            for name, n in blocks:
                rows.append({"kind": ANSWERS, "bucket": now, "block": name, "data": pack(bits[at: at + n])})
                at += n
            folder.cleanup()
            return pa.RecordBatch.from_pylist(rows, _FIELDS)

        try:
            for batch in batches:
                for bucket, name, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                    if bucket != now:
                        if columns is not None:
                            yield done()
                        now, folder, blocks = bucket, tempfile.TemporaryDirectory(), []
                        columns = Columns(folder.name, width)
                    ids, pieces = unpack(data)
                    columns.add(ids, pieces.reshape(len(ids), width))
                    blocks.append((name, len(ids)))
            if columns is not None:
                yield done()
        finally:
            if folder is not None:
                folder.cleanup()

    return work


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(n_buckets: int, length: int, anchor: int, with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, no_id, held in _opened(batches, length, anchor):
            c = _Chosen(block, held[FLAGS], n_buckets)
            n, offsets = len(block.buf), length - anchor + 1
            bits = np.zeros(len(c.first), np.uint64)
            for k, a, b in _cuts(c.bucket[c.first]):
                bits[a:b] = unpack(held[ANSWERS][k])[0]
            mask = c.masks(bits, offsets)
            place, doc = block.places[c.at], block.doc[c.at]
            begins = np.zeros(n, bool)
            for j in range(offsets):
                on = (mask >> np.uint64(j)) & np.uint64(1) == 1
                at = place[on] - block.before + j
                inside = (at >= block.starts[doc[on]]) & (at + length <= block.ends[doc[on]])
                begins[at[inside]] = True
            count = np.cumsum(begins, dtype=np.int32)
            count[length:] -= count[:-length].copy()
            gone = count > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            rise = np.concatenate(([0], np.cumsum(gone & ~np.concatenate(([False], gone[:-1])))))
            rows = []
            for i, (s, e) in enumerate(zip(block.starts.tolist(), block.ends.tolist())):
                removed = int(total[e] - total[s])
                kept = block.buf[s:e][~gone[s:e]].tobytes() if removed else block.buf[s:e].tobytes()
                rows.append({"doc_id": None if no_id[i] else int(block.ids[i]), "n_bytes": e - s, "n_removed": removed, "n_spans": int(rise[e] - rise[s]), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if with_text else None})
            yield pa.RecordBatch.from_pylist(rows, _RESULT)

    return work


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = True, block_bytes: int = BLOCK, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the kept bytes of every document."""
    if not 2 <= anchor < length or length - anchor >= 63:
        raise ValueError("anchors are shorter than the strings, by at most 62 bytes")
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = max(48, text_bytes(docs) // BUCKET_BYTES)  # several buckets a task, so that tasks are alike
    path = fresh_path(spark, "suffix-blocks")
    docs.mapInArrow(_blocks(n, length, anchor, block_bytes), FIELDS).write.option("compression", "none").partitionBy("kind").parquet(path)
    table = spark.read.schema(FIELDS).parquet(path).select("kind", "bucket", "block", "data")
    blocks = table.where(F.col("kind") == DOCS)
    by_bucket = lambda df: df.repartition(partitions(spark, n // 2), "bucket").sortWithinPartitions("bucket", "block")
    by_block = lambda df: df.repartition(partitions(spark, n), "block").sortWithinPartitions("block", "kind", "bucket")
    flags = written(by_bucket(table.where(F.col("kind") == ANCHORS)).mapInArrow(_flag(hot_blocks), FIELDS), "suffix-flags")
    removed(spark, f"{path}/kind={ANCHORS}")
    sent = by_block(flags.unionByName(blocks)).mapInArrow(_send(n, length, anchor), FIELDS)
    answers = by_bucket(sent).mapInArrow(_answer(length, anchor), FIELDS)
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return by_block(answers.unionByName(flags).unionByName(blocks)).mapInArrow(_remove(n, length, anchor, with_text), fields)
