"""LM scoring by context-tree weighting over bytes, beside a unigram base score.

Model. Every byte is eight binary decisions, each in a node of the byte's decision tree (its leading bits). For each node
there is a context tree over the DEPTH bytes before; a context holds the node's bit counts from the training texts. With
KT the Krichevsky-Trofimov estimate, the weighted probability of a context is (KT + product over its longer contexts) / 2,
and KT at DEPTH. After training the tree is fixed: a bit's probability mixes the KT estimates of all depths, each with
its posterior share KT / (KT + product); a context that training never saw adds nothing, the mixture ends above it. A
text is scored byte by byte, then an end mark (byte 255, which UTF-8 never holds); before a text stand DEPTH bytes 0.
The score is log10 of the product; the code length is in bits per byte, the end mark counted.

Execution. Documents are packed into blocks of BLOCK bytes; a block lists its distinct strings of DEPTH + 1 bytes and its
distinct words, with their training counts, once each. The lists go to buckets (strings by the three bytes before, words
by hash), which sum them, build their part of the trees and answer every block's list in its own order; then each block
scores its documents. A block's texts are one file of the shared folder, which counts only if the written lists name it, so
they are stored once and never shuffled. All steps are numpy on packed rows: a bucket sums its lists as they stream by and holds only its
distinct keys; a block holds its own texts. Nothing is sent to the driver but three totals and the contexts of two bytes
(65,536 x 255 nodes at most, whatever the input), from which those of one byte and of none follow. Because every block's
list is used, what is gathered grows with the input. Answers are sent as 32-bit floats and summed as 64-bit ones.

Edge cases: null and empty texts are an end mark and one end token; a null id is learned from and not held out; without
training texts all estimates are those of no counts (probability 1/2 a bit); repeated rows count and are scored each.
Only the id and text columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import Words, arrow_fs, blocks_of, fresh_path, grouped_order, make_dir, pack, partitions, separated, strings, text_bytes, unpack, written

DEPTH = 7  # by held-out code length, see README; a key has eight bytes
BLOCK = 32 << 20
STEP = 1 << 20  # bytes whose strings are sorted at once
BUCKET_BYTES = 16 << 20  # of text for each bucket
GRAMS, WORDS, DOCS = 0, 1, 2
END_WORD = np.uint64(1)
FIELDS = "kind int, bucket int, block long, n long, data binary"
_FIELDS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
_LOW = np.uint64(255)


# --- strings and words of a block -----------------------------------------------------------------------------


def places(data: np.ndarray, offs: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The string of depth + 1 bytes that ends at each byte and end mark of the texts, in their order, as a key: the
    nearest context byte highest, the farthest and then the byte itself lowest."""
    buf, starts = separated(data, offs, fill=0, before=7, after=1)
    ends = starts + np.diff(offs)
    buf[ends] = 255
    window = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))  # the byte itself highest
    keys = window << np.uint64(8) | window >> np.uint64(56)
    if depth < 7:
        keys = keys >> np.uint64(8 * (8 - depth)) << np.uint64(8) | keys & _LOW
    own = np.ones(len(keys), bool)
    own[(starts[1:, None] - np.arange(7, 0, -1) - 7).ravel()] = False  # windows that end in the bytes before a text
    return keys[own]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and how often each stands there."""
    s = np.sort(keys)
    begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return s[begin], np.diff(begin, append=len(s))


def merged(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct keys of all parts, ascending."""
    s = np.concatenate(parts)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def _steps(offs: np.ndarray, limit: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def grams(data: np.ndarray, offs: np.ndarray, learn: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct keys, ascending, and how often training texts hold each."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    steps = list(_steps(offs))
    for i, j in steps:
        found = places(data[offs[i]: offs[j]], offs[i: j + 1] - offs[i], depth)
        trained = np.repeat(learn[i:j], np.diff(offs[i: j + 1]) + 1)
        waiting.append(distinct(found[trained]))
        waiting.append((distinct(found[~trained])[0], np.zeros(0, np.int64)))
        del found, trained
        if sum(len(w[0]) for w in waiting) > max(1 << 20, len(keys) // 2) or j == steps[-1][1]:
            waiting.append((keys, counts))
            keys = merged([w[0] for w in waiting])
            counts = np.zeros(len(keys), np.uint32)
            for own, n in waiting:
                if len(n):
                    counts[np.searchsorted(keys, own)] += n.astype(np.uint32)
            waiting = []
    return keys, counts


def ranked(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys, and each place's rank among them. Two sorts of keys with their places in the low bits,
    first by the low three bytes; an argsort takes several times as long."""
    n = len(places)
    width = np.uint64(max(1, (n - 1).bit_length()))
    if width > 24:
        order = np.argsort(places, kind="stable")
    else:
        at, mask = np.arange(n, dtype=np.uint64), (np.uint64(1) << width) - np.uint64(1)
        order = (np.sort((places & np.uint64(0xFFFFFF)) << width | at) & mask).astype(np.int64)
        order = order[(np.sort(places[order] >> np.uint64(24) << width | at) & mask).astype(np.int64)]
    s = places[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return s[new], rank


class Tokens:
    """The words of a block with one END_WORD after each document: distinct hashes ascending, and each word's rank."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        w = Words(data, offs)
        n = len(offs) - 1
        self.first = w.first + np.arange(n + 1)
        hashes = np.full(len(w) + n, END_WORD, np.uint64)
        real = np.ones(len(hashes), bool)
        real[self.first[1:] - 1] = False
        hashes[real] = w.hash
        order = grouped_order(hashes)
        s = hashes[order]
        new = np.concatenate(([True], s[1:] != s[:-1])) if n else np.zeros(0, bool)
        keys = s[new]
        by = np.argsort(keys)  # grouped_order only puts equal values together
        rank = np.empty(len(keys), np.int64)
        rank[by] = np.arange(len(keys))
        self.keys = keys[by]
        self.ids = np.empty(len(order), np.int32)
        self.ids[order] = rank[np.cumsum(new) - 1]


def _gram_bucket(keys: np.ndarray, n: int, depth: int = DEPTH) -> np.ndarray:
    near = keys >> np.uint64(8 * (depth - 2))
    return ((near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.int32)


def _word_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.int32)


def _lister(folder: str, n_grams: int, n_words: int, depth: int, block_bytes: int):
    def rows(kind: int, block: int, of: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        order = np.argsort(of, kind="stable")
        ends = np.flatnonzero(np.diff(of[order].astype(np.int32), append=-1)) + 1
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            part = order[a:b]
            yield {"kind": kind, "bucket": int(of[part[0]]), "block": block, "n": 0, "data": pack(keys[part], counts[part], level=3)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in blocks_of(batches, "text", block_bytes):
            block, number = TaskContext.get().partitionId() << 20 | number, number + 1
            data, offs = strings(batch.column(2))
            learn = ~np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            keys, counts = grams(data, offs, learn, depth)
            out = list(rows(GRAMS, block, _gram_bucket(keys, n_grams, depth), keys, counts))
            del keys, counts
            trained, words = 0, []
            for i, j in _steps(offs):
                t = Tokens(data[offs[i]: offs[j]], offs[i: j + 1] - offs[i])
                own = np.repeat(learn[i:j], np.diff(t.first))
                words.append((t.keys, np.bincount(t.ids[own], minlength=len(t.keys))))
                trained += int(own.sum())
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*words)))
            out += rows(WORDS, block, _word_bucket(keys, n_words), keys, counts.astype(np.uint32))
            ids = batch.column(0)
            known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), np.uint8)
            name = f"{folder}/{uuid.uuid4().hex}"  # of this attempt
            fs, at = arrow_fs(name)
            with fs.open_output_stream(at) as f:
                f.write(pack(ids.fill_null(0).to_numpy(), known, (~learn).astype(np.uint8), offs, data, level=3))
            out.append({"kind": DOCS, "bucket": 0, "block": block, "n": trained, "data": name.encode()})
            yield pa.RecordBatch.from_pylist(out, _FIELDS)

    return work


# --- buckets --------------------------------------------------------------------------------------------------


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _sum_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (kind, bucket): one row for each with all distinct keys, the sums of their counts, and, in n,
    how many keys have a count."""
    now, keys, counts, waiting, held = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def merge() -> None:
        nonlocal keys, counts, waiting, held
        keys, counts = _summed(np.concatenate([keys, *(w[0] for w in waiting)]), np.concatenate([counts, *(w[1].astype(np.int64) for w in waiting)]))
        waiting, held = [], 0

    def done() -> pa.RecordBatch:
        merge()
        return pa.RecordBatch.from_pylist([{"kind": now[0], "bucket": now[1], "block": -1, "n": int((counts > 0).sum()), "data": pack(keys, counts)}], _FIELDS)

    for batch in batches:
        for kind, bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist()):
            if (kind, bucket) != now:
                if now is not None:
                    yield done()
                now, keys, counts = (kind, bucket), keys[:0], counts[:0]
            waiting.append(unpack(data))
            held += len(waiting[-1][0])
            if held > max(1 << 20, len(keys)):
                merge()
    if now is not None:
        yield done()


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for large x."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


#: log Gamma(n + 1/2) and log Gamma(n + 1) of the counts that occur most.
_AT_HALF = 0.5723649429247001 + np.concatenate(([0.0], np.cumsum(np.log(np.arange((1 << 16) - 1) + 0.5))))
_AT_ONE = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 1 << 16)))))
_HALF = 2 * 0.5723649429247001  # 2 log Gamma(1/2)
_LOG2 = float(np.log(2.0))


def _from_table(n: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1)]
    far = n >= len(table)
    if far.any():
        out[far] = _log_gamma(n[far] + add)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _from_table(n0, _AT_HALF, 0.5) + _from_table(n1, _AT_HALF, 0.5) - _HALF - _from_table(n0 + n1, _AT_ONE, 1.0)


class _Level:
    """The nodes of one depth and one bit, from ascending keys (context << 8 | byte) and counts: each key's node, each
    node's first key, its counts, KT estimate, weighted probability and share."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bit: int):
        node = keys >> np.uint64(8 - bit)
        first = np.concatenate(([True], node[1:] != node[:-1])) if len(keys) else np.zeros(0, bool)
        self.begin = np.flatnonzero(first)
        self.of = np.cumsum(first, dtype=np.int32) - np.int32(1)
        self.one = (keys >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        if len(keys):
            self.total, self.ones = np.add.reduceat(counts, self.begin), np.add.reduceat(counts * self.one, self.begin)
        else:
            self.total = self.ones = np.zeros(0, np.int64)
        self.weighted = self.kt = log_kt(self.total - self.ones, self.ones)
        self.share = None

    def weight(self, product: np.ndarray) -> None:
        self.weighted = np.logaddexp(self.kt, product) - _LOG2
        self.share = np.exp(self.kt - _LOG2 - self.weighted)

    def estimate(self) -> np.ndarray:
        """The KT estimate of each key's bit."""
        p = (self.ones + 0.5) / (self.total + 1)
        return np.where(self.one, p[self.of], 1 - p[self.of])


class Mixture:
    """The mixture of the estimates of the depths so far, as its sum, the weight that is left, and what it is if it ends
    here."""

    def __init__(self, n: int):
        self.sum, self.left, self.end = np.zeros(n), np.ones(n), np.full(n, 0.5)

    def deeper(self, at: np.ndarray) -> Mixture:
        out = Mixture(0)
        out.sum, out.left, out.end = self.sum[at], self.left[at], self.end[at]
        return out

    def add(self, seen: np.ndarray, p: np.ndarray, share: np.ndarray | None) -> None:
        """Training has seen the context, or nothing changes; without a share it is the last depth."""
        self.end = np.where(seen, self.sum + self.left * p, self.end)
        if share is not None:
            self.sum = np.where(seen, self.sum + self.left * share * p, self.sum)
            self.left = np.where(seen, self.left * (1 - share), 0.0)


class Tree:
    """The part of the context trees whose contexts are at least three bytes long, from ascending keys and counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH):
        self.depth = depth
        self.grams = {depth: (keys, counts.astype(np.int64))}
        self.up: dict[int, np.ndarray] = {}  # of each key its place among those of a shorter context
        for d in range(depth, 3, -1):
            keys, counts = self.grams[d]
            short = keys >> np.uint64(16) << np.uint64(8) | keys & _LOW
            order = np.argsort(short, kind="stable")
            s = short[order]
            new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            self.up[d] = np.empty(len(keys), np.int32)
            self.up[d][order] = np.cumsum(new, dtype=np.int32) - 1
            self.grams[d - 1] = s[begin], np.add.reduceat(counts[order], begin) if len(s) else counts

    def levels(self, bit: int) -> dict[int, _Level]:
        """By depth; the bits don't meet, so only one bit's nodes are held at once."""
        out: dict[int, _Level] = {}
        for d in range(self.depth, 2, -1):
            out[d] = level = _Level(*self.grams[d], bit)
            if d < self.depth:
                below = out[d + 1]
                level.weight(np.bincount(level.of[self.up[d + 1][below.begin]], below.weighted, len(level.begin)))
        return out

    def scores(self, near: Near) -> np.ndarray:
        """log10 of each key's last byte after its context."""
        out = np.ones(len(self.grams[self.depth][0]))
        for bit in range(8):
            levels = self.levels(bit)
            mixed = near.mixture(self.grams[3][0], bit)
            for d in range(3, self.depth + 1):
                level = levels.pop(d)
                if d > 3:
                    mixed = mixed.deeper(self.up[d])
                mixed.add(level.total[level.of] > 0, level.estimate(), None if level.share is None else level.share[level.of])
            out *= mixed.end
        return np.log10(out)

    def to_near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the contexts of two bytes need: distinct (context << 8 | node) with the weighted log probabilities of the
        three-byte contexts, and distinct (context << 8 | byte) with counts."""
        keys, counts = self.grams[3]
        nodes, weights = [], []
        for bit in range(8):
            level = self.levels(bit)[3]
            first = keys[level.begin]
            nodes.append(first >> np.uint64(16) << np.uint64(8) | np.uint64(1 << bit) | (first & _LOW) >> np.uint64(8 - bit))
            weights.append(level.weighted)
        return *_summed(np.concatenate(nodes), np.concatenate(weights)), *_summed(keys >> np.uint64(16) << np.uint64(8) | keys & _LOW, counts)


class Near:
    """The contexts of two bytes, of one and of none, from the sums of what `Tree.to_near` gives."""

    def __init__(self, nodes: np.ndarray, products: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.levels: list[tuple[np.ndarray, ...]] = []
        table = np.zeros((256, 256), np.int64)
        np.add.at(table, ((keys >> np.uint64(16)).astype(np.int64), (keys & _LOW).astype(np.int64)), counts)
        product1 = np.zeros((256, 256))
        for bit in range(8):
            level = _Level(keys, counts, bit)
            first = keys[level.begin]
            node = first >> np.uint64(8) << np.uint64(8) | np.uint64(1 << bit) | (first & _LOW) >> np.uint64(8 - bit)
            level.weight(products[np.searchsorted(nodes, node)] if len(node) else np.zeros(0))
            np.add.at(product1, ((node >> np.uint64(16)).astype(np.int64), (node & _LOW).astype(np.int64)), level.weighted)
            self.levels.append((node, level.total, level.ones, level.share))
        self.total1, self.ones1 = self._nodes(table)
        kt1 = log_kt(self.total1 - self.ones1, self.ones1)
        weighted1 = np.logaddexp(kt1, product1) - _LOG2
        self.share1 = np.exp(kt1 - _LOG2 - weighted1)
        self.total0, self.ones0 = self.total1.sum(0), self.ones1.sum(0)
        kt0 = log_kt(self.total0 - self.ones0, self.ones0)
        self.share0 = np.exp(kt0 - np.logaddexp(kt0, weighted1.sum(0)))

    @staticmethod
    def _nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Total and ones of the nodes 1 to 255 of each row of byte counts."""
        total, ones = np.zeros((len(counts), 256), np.int64), np.zeros((len(counts), 256), np.int64)
        for bit in range(8):
            halves = counts.reshape(len(counts), 1 << bit, 2, -1).sum(-1)
            total[:, 1 << bit: 2 << bit], ones[:, 1 << bit: 2 << bit] = halves.sum(-1), halves[..., 1]
        return total, ones

    def mixture(self, keys: np.ndarray, bit: int) -> Mixture:
        """For keys with contexts of three bytes."""
        out = Mixture(len(keys))
        near, sym = (keys >> np.uint64(24)).astype(np.int64), (keys & _LOW).astype(np.int64)
        node, one = (1 << bit) | sym >> (8 - bit), (sym >> (7 - bit)) & 1
        nodes, totals, ones, shares = self.levels[bit]
        at = np.searchsorted(nodes, keys >> np.uint64(16) << np.uint64(8) | node.astype(np.uint64))
        for total, ones, share in ((self.total0[node], self.ones0[node], self.share0[node]), (self.total1[near, node], self.ones1[near, node], self.share1[near, node]), (totals[at], ones[at], shares[at])):
            out.add(total > 0, (np.where(one == 1, ones, total - ones) + 0.5) / (total + 1), share)
        return out


NEAR_PARTS = 64


def _near_parts(depth: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(4).to_pylist():
                found = Tree(*unpack(data), depth).to_near()
                of = [(x >> np.uint64(8)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58) for x in found[::2]]
                for part in range(NEAR_PARTS):
                    a, b = of[0] == part, of[1] == part
                    if a.any():
                        yield pa.RecordBatch.from_pylist([{"kind": part, "bucket": 0, "block": 0, "n": 0, "data": pack(found[0][a], found[1][a], found[2][b], found[3][b])}], _FIELDS)

    return work


def _near_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of parts; a part is summed as its rows stream by."""
    now, held = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"kind": now, "bucket": 0, "block": 0, "n": 0, "data": pack(*held)}], _FIELDS)

    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
            found = unpack(data)
            if part != now:
                if now is not None:
                    yield done()
                now, held = part, found
            else:
                held = [*_summed(*(np.concatenate(x) for x in zip(held[:2], found[:2]))), *_summed(*(np.concatenate(x) for x in zip(held[2:], found[2:])))]
    if now is not None:
        yield done()


def _near(sums: DataFrame, depth: int) -> Near:
    parts = sums.mapInArrow(_near_parts(depth), FIELDS).repartition(NEAR_PARTS, "kind").sortWithinPartitions("kind").mapInArrow(_near_sums, FIELDS)
    got = [unpack(r["data"]) for r in parts.select("data").collect()]
    if not got:
        return Near(*_summed(np.zeros(0, np.uint64), np.zeros(0)), *_summed(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    a, b, c, d = (np.concatenate(x) for x in zip(*got))
    return Near(*_summed(a, b), *_summed(c, d))


def _answerer(near, depth: int):
    """Rows in the order of (kind, bucket, block): the bucket's sums first, then every block's list, which is answered in
    its order: scores of strings, counts of words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = values = None
        for batch in batches:
            out = []
            for kind, bucket, block, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                part = unpack(data)
                if block < 0:
                    keys, values = part[0], (Tree(*part, depth).scores(near.value).astype(np.float32) if kind == GRAMS else part[1])
                else:
                    out.append({"kind": kind, "bucket": bucket, "block": block, "n": 0, "data": pack(values[np.searchsorted(keys, part[0])])})
            if out:
                yield pa.RecordBatch.from_pylist(out, _FIELDS)

    return work


# --- scoring --------------------------------------------------------------------------------------------------

_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("score", pa.float64())])


def _scorer(n_grams: int, n_words: int, depth: int):
    """Rows in the order of (block, kind, bucket): a block's answers, then its documents."""

    def spread(answers: dict[int, np.ndarray], of: np.ndarray) -> np.ndarray:
        order = np.argsort(of, kind="stable")
        found = np.concatenate([answers[b] for b in sorted(answers)])
        out = np.empty(len(of), found.dtype)
        out[order] = found
        return out

    def scored(doc: list[np.ndarray], by_gram: dict[int, np.ndarray], by_word: dict[int, np.ndarray]) -> pa.RecordBatch:
        ids, known, held, offs, text = doc
        steps = [(i, j, text[offs[i]: offs[j]], offs[i: j + 1] - offs[i]) for i, j in _steps(offs)]
        keys, waiting = np.zeros(0, np.uint64), []
        for _, j, own, part in steps:  # twice over the text, so that only one step's places are held
            waiting.append(distinct(places(own, part, depth))[0])
            if sum(map(len, waiting)) > max(1 << 20, len(keys) // 2) or j == len(ids):
                keys, waiting = merged([keys, *waiting]), []
        logp = spread(by_gram, _gram_bucket(keys, n_grams, depth))
        score, n_tokens, n_known, log_counts = (np.zeros(len(ids), t) for t in (float, np.int64, np.int64, float))
        for i, j, own, part in steps:
            own_keys, rank = ranked(places(own, part, depth))
            score[i:j] = np.add.reduceat(logp[np.searchsorted(keys, own_keys)][rank], part[:-1] + np.arange(j - i), dtype=float)
        del keys, logp
        words = [Tokens(own, part) for _, _, own, part in steps]
        every = merged([t.keys for t in words])
        count = spread(by_word, _word_bucket(every, n_words))
        for (i, j, _, _), t in zip(steps, words):
            c = count[np.searchsorted(every, t.keys)][t.ids]
            n_tokens[i:j] = np.diff(t.first)
            n_known[i:j], log_counts[i:j] = np.add.reduceat((c > 0).astype(np.int64), t.first[:-1]), np.add.reduceat(np.log10(c + 0.5), t.first[:-1])
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(held.astype(bool)), pa.array(np.diff(offs)), pa.array(n_tokens), pa.array(n_known), pa.array(log_counts), pa.array(score)], schema=_SCORES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, ({}, {})
        for batch in batches:
            for kind, bucket, block, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if block != now:
                    now, got = block, ({}, {})
                if kind != DOCS:
                    got[kind][bucket] = unpack(data)[0]
                    continue
                fs, at = arrow_fs(data.decode())
                with fs.open_input_stream(at) as f:
                    doc = unpack(f.read())
                yield scored(doc, *got)
                got = ({}, {})

    return work


def score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document."""
    if not 3 <= depth <= 7:
        raise ValueError("the depth is from 3 to 7")
    spark = documents.sparkSession
    key = F.col(id_col).cast("long")
    docs = documents.select(key.alias("doc_id"), F.coalesce(F.crc32(key.cast("string")) % 5 == 1, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    n = max(16, text_bytes(docs) // BUCKET_BYTES)
    n_grams, n_words = n, max(16, n // 4)
    parts = partitions(spark, n_grams + n_words)
    path, folder = fresh_path(spark, "ctw-lists"), fresh_path(spark, "ctw-texts")
    make_dir(folder)
    docs.mapInArrow(_lister(folder, n_grams, n_words, depth, block_bytes), FIELDS).write.option("compression", "none").partitionBy("kind").parquet(path)
    lists = spark.read.schema(FIELDS).parquet(path).select("kind", "bucket", "block", "n", "data")
    by_bucket = lists.where(F.col("kind") != DOCS)
    n_train = lists.where(F.col("kind") == DOCS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("train_tokens"))

    sums = written(by_bucket.repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_sum_lists, FIELDS), "ctw-sums")
    near = spark.sparkContext.broadcast(_near(sums.where(F.col("kind") == GRAMS), depth))
    answers = sums.unionByName(by_bucket).repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket", "block").mapInArrow(_answerer(near, depth), FIELDS)
    blocks = answers.unionByName(lists.where(F.col("kind") == DOCS))
    # a block is numbered by its task, so the blocks are dealt evenly
    turn = F.pmod(F.shiftright("block", 20) + F.col("block").bitwiseAND(F.lit((1 << 20) - 1)) * 7919, F.lit(parts)).cast("int")
    blocks = blocks.repartitionById(parts, turn).sortWithinPartitions("block", "kind", "bucket")
    scored = blocks.mapInArrow(_scorer(n_grams, n_words, depth), "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, log_counts double, score double")
    types = sums.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("v"))
    totals = n_train.join(F.broadcast(types))  # one row each
    full = scored.join(F.broadcast(totals))
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("v") + 1))
    bits = -F.col("score") * F.log2(F.lit(10.0)) / (F.col("n_bytes") + 1)
    return full.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score", bits.alias("bits_per_byte"))
