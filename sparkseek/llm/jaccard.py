"""N-gram Jaccard join by vertical partitioning.

Sets. A document's set is its distinct k-word shingles (64-bit hashes). Documents with equal sets form a class, named by
64 bits of a 128-bit signature; all that follows works on classes, so copies are never paired. Should two signatures share
their name, which the written members show, their classes get other names and the first pass is done again.

Order. The global n-gram order is by frequency, then hash. Frequencies are counted over all documents in COUNTERS hashed
counters (a fixed size); any order gives the same result, a good one puts common n-grams last.

Candidates. Two sets that reach the threshold share one of the first n - ceil(t n) + 1 n-grams of each. These prefixes
go to buckets by n-gram; a bucket holds the classes of each n-gram once. Lists are not turned into all their pairs:
  1. each class of a list is paired with one centre of the list only; these pairs are checked and linked to components;
  2. then only the pairs of a list whose classes are not yet in one component are checked, all of them, so no link that
     joins components is lost; inside a component further links change nothing.

Checks. Pairs are dealt into groups by centre (a hot centre over several). For the checks the global order is that of
the hashes, cut into FRAGMENTS at fixed pivots; each (group, fragment) counts the partial overlaps of its pairs from the sets' segments alone, and a group sums them per pair.

Edge cases: a text with fewer than k words has its whole word sequence as one shingle; null, empty and blank texts have
an empty set, are linked with nothing and keep their own id; a null id is never the smallest of its component unless all
are null; repeated rows are equal sets; an empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import Words, accumulate, drop, mix, pack, partitions, shingles, slices, strings, text_bytes, unpack, written
from sparkseek.llm.components import components

COUNTERS = 1 << 22
FIRST = 5
FRAGMENTS = 4
BUCKET_BYTES = 48 << 20  # of text for each bucket
GROUP_PAIRS = 1 << 15
PAIRS = 1 << 20  # that wait in a task
STAR = 2000  # leaves of a centre in one group
BROADCAST_CLASSES = 200_000
BROADCAST_ENTRIES = 2_000_000  # of 4 bytes

_ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])
ROW = "bucket int, kind int, n long, data binary"


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(42)).astype(np.int64)


def signature(s: np.ndarray, taken: frozenset[int] = frozenset()) -> tuple[int, int]:
    """The name of a set's class, and the rest of its signature. `taken`: names that several signatures share."""
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    name, rest = (int.from_bytes(digest[i: i + 8], "little", signed=True) for i in (0, 8))
    if name in taken:
        name = int.from_bytes(hashlib.blake2b(digest, digest_size=8, person=b"again").digest(), "little", signed=True)
    return name, rest


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    return shingles(Words(*strings(batch.column(batch.schema.get_field_index("text")))), k)


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    def add(matrix: np.ndarray, batch: pa.RecordBatch) -> None:
        parts = list(_sets(batch, k))
        matrix[:, 0] += np.bincount(_slot(np.concatenate(parts)), minlength=COUNTERS)

    return np.minimum(accumulate(docs, add, COUNTERS, 1)[:, 0], (1 << 32) - 1).astype(np.uint32)


def ordered(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set in the global order."""
    return s[np.lexsort((s, counts[_slot(s)]))]


def _prefixes(k: int, num: int, den: int, counts: np.ndarray, n_buckets: int, taken: frozenset[int]):
    """One row for each document (kind 0: n is its set's size, data its id and signature), and for each bucket the
    prefixes' n-grams with signature and size (kind 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            members, grams, sigs, sizes, lows, seen = [], [], [], [], [], set()
            for s in _sets(batch, k):
                sig, rest = signature(s, taken) if len(s) else (0, 0)
                members.append((sig, len(s), rest))
                if len(s) and sig not in seen:
                    seen.add(sig)
                    n = len(s)
                    size = n - (-(-num * n // den)) + 1
                    # the first ones in the order: only what is at most as frequent as the last of them is sorted
                    c = counts[_slot(s)]
                    part = s[c <= np.partition(c, size - 1)[size - 1]]
                    grams.append(ordered(part, counts)[:size])
                    sigs.append(np.full(size, sig, np.int64))
                    sizes.append(np.full(size, n, np.uint32))
                    lows.append(np.full(size, s[0] >> np.uint64(32), np.uint32))
            ids = batch.column(0)
            m = np.array(members, np.int64).reshape(-1, 3)
            out = [{"bucket": -1, "kind": 0, "n": len(m), "data": pack(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), m[:, 0], m[:, 1], m[:, 2])}]
            if grams:
                g, s, z, m = (np.concatenate(x) for x in (grams, sigs, sizes, lows))
                of = (g % np.uint64(n_buckets)).astype(np.int32)
                order = np.lexsort((g, of))
                ends = np.flatnonzero(np.diff(of[order], append=-1)) + 1
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    p = order[a:b]
                    out.append({"bucket": int(of[p[0]]), "kind": 1, "n": len(p), "data": pack(g[p], s[p], z[p], m[p])})
            yield pa.RecordBatch.from_pylist(out, _ROW)

    return work


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(3).to_pylist():
            ids, known, sig, n, rest = unpack(data)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(sig), pa.array(n), pa.array(rest)], names=["doc_id", "sig", "n", "rest"])


def _distinct(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct (n-gram, signature) in this order, with sizes and smallest hashes."""
    cols = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort((cols[1], cols[0]))
    g, s = cols[0][order], cols[1][order]
    order = order[np.concatenate(([True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])))]
    return tuple(c[order] for c in cols)


def _grouped(batches: Iterator[pa.RecordBatch], merge) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(bucket, merged arrays) of rows in the order of buckets; held lists are merged as they grow."""
    now, parts, held, kept = None, [], 0, 0
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if bucket != now:
                if now is not None:
                    yield now, merge(parts)
                now, parts, held, kept = bucket, [], 0, 0
            parts.append(tuple(unpack(data)))
            held += len(parts[-1][0])
            if held > max(1 << 21, kept):
                parts = [merge(parts)]
                held, kept = 0, len(parts[0][0])
    if now is not None:
        yield now, merge(parts)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket the lists with at least two classes: list number, signature, size, smallest hash."""
    for bucket, (g, s, z, m) in _grouped(batches, _distinct):
        begin = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.append(begin, len(g)))
        of = np.repeat(np.arange(len(begin)), size)
        keep = np.repeat(size > 1, size)
        # lists of equal classes (n-grams that always occur together) are needed once
        h = np.add.reduceat(mix(s.view(np.uint64)), begin)
        _, first = np.unique(np.where(size > 1, h, np.uint64(0)), return_index=True)
        once = np.zeros(len(begin), bool)
        once[first] = True
        keep &= once[of]
        if keep.any():
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "kind": 2, "n": int(keep.sum()), "data": pack(of[keep], s[keep], z[keep], m[keep])}], _ROW)


def _near(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether two sizes can reach the threshold."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    return np.minimum(a, b) * den >= np.maximum(a, b) * num


def _pair_rows(a, b, na, nb, low, n_groups: int) -> Iterator[dict]:
    """Pairs, dealt into groups by the smallest hash of centre a; a centre with many leaves is dealt into several."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    a, b, na, nb, low = a[keep], b[keep], na[order][keep], nb[order][keep], low[order][keep]
    begin = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    salts = 1 + np.diff(np.append(begin, len(a))) // STAR
    salt = mix(b.view(np.uint64)) % np.repeat(salts, np.diff(np.append(begin, len(a)))).astype(np.uint64)
    of = (mix(mix(low.astype(np.uint64)) + salt) % np.uint64(n_groups)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    ends = np.flatnonzero(np.diff(of[order], append=-1)) + 1
    for i, j in zip([0, *ends[:-1].tolist()], ends.tolist()):
        p = order[i:j]
        yield {"bucket": int(of[p[0]]), "kind": 3, "n": len(p), "data": pack(a[p], b[p], na[p], nb[p])}


def _stars(num: int, den: int, n_groups: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(3).to_pylist():
                of, s, z, m = unpack(data)
                # the centre of a list is its class that is in most lists of the bucket
                _, inverse, often = np.unique(s, return_inverse=True, return_counts=True)
                order = np.lexsort((s, -often[inverse], of))
                begin = np.flatnonzero(np.concatenate(([True], np.diff(of[order]) != 0)))
                size = np.diff(np.append(begin, len(of)))
                centre = np.repeat(order[begin], size)
                a, b = centre, order
                ok = (s[a] != s[b]) & _near(z[a], z[b], num, den)
                if ok.any():
                    yield pa.RecordBatch.from_pylist(list(_pair_rows(s[a[ok]], s[b[ok]], z[a[ok]], z[b[ok]], m[a[ok]], n_groups)), _ROW)

    return work


TILE = 4096  # classes of a list on one side of a task's pairs


def _flat_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, list, sig, n, low; side: which TILE of its list a class is in, by size; sides: how many tiles there are."""
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            of, s, z, m = unpack(data)
            order = np.lexsort((s, z, of))
            of, s, z, m = of[order], s[order], z[order], m[order]
            begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            size = np.diff(np.append(begin, len(of)))
            side = (np.arange(len(of)) - np.repeat(begin, size)) // TILE
            columns = (np.full(len(of), bucket, np.int32), of, s, z.astype(np.int64), m.astype(np.int64), side.astype(np.int32), np.repeat(-(-size // TILE), size).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "list", "sig", "n", "low", "side", "sides"])


def _cross(num: int, den: int, n_groups: int):
    """Rows (bucket, list, a, b, sig, n, low, component, side), those of a list's tile (a, b) together: the pairs of a class
    of side a with one of side b that no component joins yet. Pairs leave as they are made, PAIRS at a time."""

    def pairs(s: np.ndarray, z: np.ndarray, m: np.ndarray, c: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        order = np.lexsort((s, z))  # by size, so that those near enough in size stand together
        s, z, m, c, side = s[order], z[order], m[order], c[order], side[order]
        last = np.searchsorted(z, z * den // num, "right")
        one = side[0] == side[-1] and (side == side[0]).all()
        for i in range(len(s) - 1):
            j = np.arange(i + 1, last[i])
            j = j[(c[j] != c[i]) & (one | (side[j] != side[i]))]
            if len(j):
                yield np.full(len(j), s[i]), s[j], np.full(len(j), z[i]), z[j], np.full(len(j), m[i])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile, done, waiting, held = None, [], set(), [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(list(_pair_rows(*(np.concatenate(x) for x in zip(*waiting)), n_groups)), _ROW)

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held
            s, z, m, c, side = (np.concatenate(x) for x in zip(*tile))
            if len(s) < 2 or not (c != c[0]).any():
                return
            key = hashlib.blake2b(np.sort(s).tobytes(), digest_size=16).digest()  # lists of equal classes are needed once
            if key in done:
                return
            done.add(key)
            for p in pairs(s, z, m, c, side):
                waiting.append(p)
                held += len(p[0])
                if held > PAIRS:
                    yield rows()
                    waiting, held = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            b, of, x, y, s, z, m, c, side = (batch.column(i).to_numpy() for i in range(9))
            begin = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (of[1:] != of[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(b)]):
                key = (int(b[i]), int(of[i]), int(x[i]), int(y[i]))
                if key != now:
                    if tile:
                        yield from finish()
                    if now is None or key[0] != now[0]:
                        done = set()
                    now, tile = key, []
                tile.append((s[i:j], z[i:j], m[i:j], c[i:j], side[i:j]))
        if tile:
            yield from finish()
        if waiting:
            yield rows()

    return work


def _tiles(marked: DataFrame) -> DataFrame:
    """The classes of each list once for every tile (a, b) of it that they are in: a list of up to TILE classes has one."""
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other")
    tiled = marked.select("bucket", "list", "sig", "n", "low", "component", "side", other)
    return tiled.select("bucket", "list", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "sig", "n", "low", "component", "side")


def _merged_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group with its distinct pairs, in ascending order."""

    def merge(parts: list) -> tuple[np.ndarray, ...]:
        cols = [np.concatenate(x) for x in zip(*parts)]
        order = np.lexsort((cols[1], cols[0]))
        cols = [c[order] for c in cols]
        keep = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
        return tuple(c[keep].astype(np.int64) for c in cols)

    for group, cols in _grouped(batches, merge):
        yield pa.RecordBatch.from_pylist([{"bucket": group, "kind": 3, "n": len(cols[0]), "data": pack(*cols)}], _ROW)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            a, b, _, _ = unpack(data)
            sig = np.unique(np.concatenate((a, b)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), group, np.int32)), pa.array(sig)], names=["bucket", "sig"])


_SEGMENT = pa.schema([("bucket", pa.int32()), ("fragment", pa.int32()), ("sig", pa.int64()), ("data", pa.binary())])


_PIVOT = np.uint64((1 << 64) // FIRST)


def _segments(k: int, ahead: bool):
    """The sets cut by the fragments of the order, or only the first fragment, with 32 bits of each hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = np.array([(i << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], np.uint64)
        for batch in slices(batches, "text"):
            groups, sigs, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for of, sig, s in zip(groups, sigs, _sets(batch, k)):
                parts = [(s[: np.searchsorted(s, _PIVOT)] >> np.uint64(30)).astype(np.uint32)] if ahead else np.split(s, np.searchsorted(s, pivots))
                for f, part in enumerate(parts):
                    out += [{"bucket": g, "fragment": f, "sig": sig, "data": part.tobytes()} for g in of]
            yield pa.RecordBatch.from_pylist(out, _SEGMENT)

    return work


def _own_text(k: int, taken: frozenset[int]):
    """Rows whose text has the wanted signature: rows with equal ids may have other texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keep = [len(s) > 0 and signature(s, taken)[0] == sig for s, sig in zip(_sets(batch, k), batch.column(0).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return work


def _overlaps(a: np.ndarray, b: np.ndarray, held: dict[int, np.ndarray]) -> np.ndarray:
    """The intersections' sizes of pairs in the order of a; a's leaves are looked up many at a time."""
    out = np.zeros(len(a), np.int64)
    begin = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(a)]):
        one = held[int(a[i])]
        if not len(one):
            continue
        for c in range(i, j, 256):
            parts = [held[x] for x in b[c: min(j, c + 256)].tolist()]
            sizes = np.array([len(p) for p in parts])
            full = np.flatnonzero(sizes)
            if len(full):
                every = np.concatenate(parts)
                hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
                out[c + full] = np.add.reduceat(hit, (np.cumsum(sizes) - sizes)[full], dtype=np.int64)
    return out


def _survivors(num: int, den: int):
    """Rows in the order of (group, sig), the group's pairs last (sig null): the pairs that may still reach the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for group, sig, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if group != now:
                    now, held = group, {}
                if sig is not None:
                    held[sig] = np.frombuffer(data, np.uint32)
                    continue
                a, b, na, nb = unpack(data)
                size = {x: len(v) for x, v in held.items()}
                differ = np.array([size[x] for x in a.tolist()], np.int64) + np.array([size[x] for x in b.tolist()], np.int64) - 2 * _overlaps(a, b, held)
                # den * i >= num * u and i + u = na + nb bound u - i, the number of differing n-grams
                ok = differ * (den + num) <= (na + nb) * (den - num)
                if ok.any():
                    yield pa.RecordBatch.from_pylist([{"bucket": group, "kind": 3, "n": int(ok.sum()), "data": pack(a[ok], b[ok], na[ok], nb[ok])}], _ROW)

    return work


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (group, fragment, sig), the group's pairs last (sig null): the partial overlap of each pair."""
    now, held = None, {}
    for batch in batches:
        for group, fragment, sig, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (group, fragment) != now:
                now, held = (group, fragment), {}
            if sig is not None:
                held[sig] = np.frombuffer(data, np.uint64)
                continue
            a, b, _, _ = unpack(data)
            out = _overlaps(a, b, held).astype(np.uint32)
            yield pa.RecordBatch.from_pylist([{"bucket": group, "kind": 4, "n": len(out), "data": pack(out)}], _ROW)


def _linked(num: int, den: int):
    """Rows in the order of (group, kind): the pairs, then their partial overlaps, which are summed per pair."""

    def links(pairs, total) -> pa.RecordBatch:
        a, b, na, nb = pairs
        ok = total * den >= num * (na + nb - total)
        return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = total = None
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if kind == 3:
                    if pairs is not None:
                        yield links(pairs, total)
                    pairs = unpack(data)
                    total = np.zeros(len(pairs[0]), np.int64)
                else:
                    total += unpack(data)[0]
        if pairs is not None:
            yield links(pairs, total)

    return work


def _sent(pairs: DataFrame, texts: DataFrame, n_groups: int, k: int, ahead: bool) -> DataFrame:
    """Segments of the classes that each group's pairs ask for, and the pairs behind them (sig null)."""
    ends = pairs.mapInArrow(_ends, "bucket int, sig long").groupBy("sig").agg(F.collect_set("bucket").alias("buckets"))
    wanted = written(ends, "jaccard-wanted")
    classes, entries = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("buckets")), F.lit(0))).first()
    few = classes <= BROADCAST_CLASSES and entries <= BROADCAST_ENTRIES
    rows = texts.join(F.broadcast(wanted) if few else wanted, "sig").select("buckets", "sig", "text")
    segments = rows.mapInArrow(_segments(k, ahead), "bucket int, fragment int, sig long, data binary")
    fragments = 1 if ahead else FRAGMENTS
    asked = pairs.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("fragment"), F.lit(None).cast("long").alias("sig"), "data")
    both = segments.unionByName(asked).repartition(partitions(texts.sparkSession, n_groups * fragments), "bucket", "fragment")
    return both.sortWithinPartitions("bucket", "fragment", F.col("sig").asc_nulls_last())


def _check(pairs: DataFrame, n_groups: int, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The links (a, b) among the pairs."""
    n = partitions(texts.sparkSession, n_groups)
    pairs = written(pairs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_merged_pairs, ROW), "jaccard-pairs")
    left = written(_sent(pairs, texts, n_groups, k, True).mapInArrow(_survivors(num, den), ROW), "jaccard-survivors")
    drop(pairs)
    partial = _sent(left, texts, n_groups, k, False).mapInArrow(_partial, ROW)
    summed = left.unionByName(partial).repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
    links = written(summed.mapInArrow(_linked(num, den), "a long, b long"), "jaccard-links")
    drop(left)
    return links


def _groups(pairs: DataFrame) -> int:
    """By the pairs, without a ceiling: a group is what a task holds, and it streams several."""
    return max(12, int(pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // GROUP_PAIRS)


def with_set_name(docs: DataFrame, k: int, column: str) -> DataFrame:
    """docs (with a column text) and, in a long column, the name of each text's set (0 without words): within one doc_id
    it tells rows apart."""
    from pyspark.sql.types import LongType, StructType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names = [signature(s)[1] if len(s) else 0 for s in _sets(batch, k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(work, StructType([*docs.schema.fields]).add(column, LongType()))


def near_duplicates(documents: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", with_sets: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id: documents whose sets have den * intersection >= num * union are linked; the
    id of a component is its smallest doc_id. With `with_sets` also set_name (of `with_set_name`) and component (a long
    that names it, null without words), which tell rows with one id, or with none, apart."""
    if not 0 < num <= den or k < 1:
        raise ValueError("the threshold is in (0, 1], the shingles have words")
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = frequencies(docs, k)
    n = max(12, text_bytes(docs) // BUCKET_BYTES)
    parts = partitions(spark, n)
    taken: frozenset[int] = frozenset()
    while True:
        rows = written(docs.mapInArrow(_prefixes(k, num, den, counts, n, taken), ROW), "jaccard-prefixes")
        members = written(rows.where("kind = 0").mapInArrow(_members, "doc_id long, sig long, n long, rest long"), "jaccard-members")
        reps = members.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        reps = written(reps, "jaccard-classes")
        clash = frozenset(r[0] for r in reps.where("low <> high").select("sig").collect())  # n^2 / 2^65 of n classes
        if not clash:
            break
        taken |= clash
        drop(rows, members, reps)
    reps = reps.select("sig", "doc_id")
    lists = written(rows.where("kind = 1").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_lists, ROW), "jaccard-lists")
    drop(rows)

    flat = lists.mapInArrow(_flat_lists, "bucket int, list long, sig long, n long, low long, side int, sides int")
    listed = written(flat.select("sig").distinct().join(reps, "sig").select("sig", F.col("doc_id").alias("rep")), "jaccard-listed")
    few = listed.count() <= BROADCAST_CLASSES
    own = docs.join(F.broadcast(listed) if few else listed, F.col("doc_id").eqNullSafe(F.col("rep"))).select("sig", "text")
    texts = written(own.mapInArrow(_own_text(k, taken), "sig long, text string"), "jaccard-texts")
    drop(listed)

    groups = _groups(lists)
    links = _check(lists.mapInArrow(_stars(num, den, groups), ROW), groups, texts, k, num, den)
    joined = written(components(links), "jaccard-components")
    drop(links)
    marked = flat.join(joined.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    tiles = _tiles(marked).repartition(parts, "bucket", "a", "b").sortWithinPartitions("bucket", "list", "a", "b")
    rest = written(tiles.mapInArrow(_cross(num, den, groups), ROW), "jaccard-cross")
    more = _check(rest, groups, texts, k, num, den)
    drop(lists, rest, texts)
    joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    drop(more)

    named = reps.join(joined.withColumnRenamed("node", "sig"), "sig", "left").withColumn("class", F.coalesce("component", "sig"))
    least = named.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    # only classes of several members or several sets need the join back
    of_class = written(named.join(least, "class").select("sig", "component_id", "class"), "jaccard-classes")
    out = members.join(of_class, "sig", "left")
    full = F.col("n") > 0
    more = [F.col("rest").alias("set_name"), F.when(full, F.col("class")).alias("component")] if with_sets else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(full, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *more)
