"""Benchmark decontamination by latent semantic retrieval.

1. Weights. Words (lower-cased A-Z, runs of letters and digits) are hashed to BUCKETS; document frequencies of all
   documents and benchmark texts give the inverse frequencies.
2. Space. Passages of PASSAGE words are TF-IDF rows (a word counts once) of a matrix X that is never built: each task adds
   its part of the sketch X'X R, R random, to a BUCKETS x RANK matrix of its own, and the sums are a randomised SVD's
   range; its singular vectors, those of the strongest DROP set aside (they tell languages apart, not passages), are the
   latent space.
3. Candidates. Benchmark items fall into classes of like length; windows of a class's length slide over every document
   by a STRIDE-th of it. A window and an item with a cosine of at least COSINE in the space are a candidate.
4. Checks. The longest common subsequence of the words of the window, with a margin on both sides, and of the item's:
   the item is found if it covers FULL of its words and SPARE more, or PARAPHRASE of them and SPARE more together with
   ANSWER of its answer, which is its last sentence. SPARE is for short items, of which unrelated text holds a larger
   share by chance. Items under SHORT words must be there whole.

The space has a fixed size whatever the corpus. The benchmark is sent to all tasks in blocks of at most ITEMS items; a
larger one takes several passes over the documents. Every document's whole text is searched.

Edge cases: null and empty texts and items without words match nothing; documents shorter than a window are one window;
repeated rows are judged each; an empty benchmark leaves all documents clean. Items with a null id are searched like the others
and stand as one null at the end of the ids found. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import WORDS_AND_MARKS, Words, accumulate, slices, strings, unused, written

BUCKET_BITS = 13
BUCKETS = 1 << BUCKET_BITS
RANK, DROP, PASSAGE = 44, 4, 32
COSINE, STRIDE, RATIO = 0.55, 6, 1.2
FULL, PARAPHRASE, SPARE, ANSWER, SHORT = 0.45, 0.35, 3.5, 0.8, 8  # set from measured scores of unrelated windows, see README
ENOUGH = 0.8, 0.6  # shares that do whatever SPARE says, alone and with the answer
ITEMS = 4000
STEP, BATCH = 1 << 20, 16 << 20  # bytes of text whose windows, and whose candidates, are held at once
WINDOWS = 1 << 15
NUMBER_BITS = 18  # first bits of a word's hash by which the items' words are looked up
MEMBERS = 512  # items that one product compares


_LETTERS = (WORDS_AND_MARKS == 1).astype(np.uint8)


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, marks left out, and each text's range."""
    w = Words(data, offs, kinds=_LETTERS)
    return w.hash, w.first


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return words_of(*strings(batch.column(batch.schema.get_field_index("text"))))


def latent_space(texts: DataFrame, seed: int = 11) -> np.ndarray:
    """BUCKETS x at most RANK - DROP: the place of each bucket's word, its weight included.

    One pass. With B the passages' rows of 0 and 1, D the inverse frequencies and X = B D, the sum over the tasks is
    B'B R; D times it is X'X D^-1 R, a sketch of X by the random matrix D^-1 R. So frequencies and sketch are counted
    together.
    """
    random = np.random.Generator(np.random.PCG64(seed)).standard_normal((RANK, BUCKETS)).astype(np.float32)

    def add(matrix: np.ndarray, batch: pa.RecordBatch) -> None:
        for part in slices(iter([batch]), "text", STEP):  # what stays in the cache
            count(matrix, part)

    def count(matrix: np.ndarray, batch: pa.RecordBatch) -> None:
        h, first = _texts(batch)
        size = np.diff(first)
        matrix[BUCKETS, RANK] += len(size)
        if not len(h):
            return
        passages = -(-size // PASSAGE)
        base = np.cumsum(passages) - passages
        at = np.arange(len(h)) - np.repeat(first[:-1], size)
        key = np.sort((np.repeat(base, size) + at // PASSAGE) << BUCKET_BITS | _bucket(h))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        row, bucket = key >> BUCKET_BITS, key & (BUCKETS - 1)
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        for j in range(RANK):  # a column at a time stays in the cache
            y = np.add.reduceat(np.take(random[j], bucket, mode="clip"), begin)
            matrix[:BUCKETS, j] += np.bincount(bucket, np.take(y, row, mode="clip"), BUCKETS)
        doc = np.repeat(np.arange(len(size)), passages)[row]
        pairs = np.sort(doc << BUCKET_BITS | bucket)
        matrix[:BUCKETS, RANK] += np.bincount(pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] & (BUCKETS - 1), minlength=BUCKETS)

    sums = accumulate(texts, add, BUCKETS + 1, RANK + 1, np.float64)
    idf = np.log(1 + sums[BUCKETS, RANK] / (sums[:BUCKETS, RANK] + 1.0))
    u, s, _ = np.linalg.svd(idf[:, None] * sums[:BUCKETS, :RANK], full_matrices=False)
    rank = int((s > 1e-6 * max(s[0], 1e-30)).sum())
    skip = min(DROP, rank // 8)
    # the singular values here are squares of those of X: dividing by their roots gives each direction the same weight
    return (idf[:, None] * (u[:, skip:rank] / np.sqrt(s[skip:rank]))).astype(np.float32)


# --- items ----------------------------------------------------------------------------------------------------


def bars(n: int) -> tuple[float, float]:
    """How many of an item's n words are enough alone, and with the answer."""
    return (n, n) if n < SHORT else (min(ENOUGH[0] * n, FULL * n + SPARE), min(ENOUGH[1] * n, PARAPHRASE * n + SPARE))


def last_sentence(text: str) -> str:
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text) if re.search(r"\w", p)]
    return parts[-1] if parts else ""


class Items:
    """Benchmark items by classes of length, with what the checks need."""

    def __init__(self, rows: list[tuple[int | None, str]], space: np.ndarray):
        self.ids, self.words, self.answer = [], [], []
        raw = [t.encode() for _, t in rows]
        h, first = words_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64))))
        for (item, text), a, b in zip(rows, first[:-1].tolist(), first[1:].tolist()):
            if b > a:
                tail = np.frombuffer(last_sentence(text).encode(), np.uint8)
                self.ids.append(item)
                self.words.append(h[a:b])
                self.answer.append(max(1, len(words_of(tail, np.array([0, len(tail)]))[0])))
        self.vectors = np.array([space[_bucket(w)].sum(0) for w in self.words], np.float32).reshape(len(self.ids), space.shape[1])
        self.vectors /= np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-9)
        self.classes: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            size = 4.0
            while round(size) < len(w):
                size *= RATIO
            self.classes.setdefault(round(size), []).append(i)

        every = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.vocabulary = every
        top = (every >> np.uint64(64 - NUMBER_BITS)).astype(np.int64)
        self.begin = np.searchsorted(top, np.arange(1 << NUMBER_BITS))  # the first word of each beginning
        self.most = int(np.bincount(top, minlength=1).max())
        self.numbers = [np.searchsorted(every, w) + 1 for w in self.words]

    def number(self, h: np.ndarray) -> np.ndarray:
        """Words as numbers: their place among the items' words from 1, or 0."""
        out, at = np.zeros(len(h), np.int32), self.begin[h >> np.uint64(64 - NUMBER_BITS)]
        for k in range(self.most):
            place = np.minimum(at + k, len(self.vocabulary) - 1)
            hit = np.take(self.vocabulary, place) == h
            out[hit] = place[hit] + 1
        return out

    def found(self, item: int, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row of words (as numbers) holds the item, and the share of its words in the longest common
        subsequence, where that can be enough."""
        words, n = self.numbers[item], len(self.words[item])
        alone, least = bars(n)
        own = np.zeros(len(self.vocabulary) + 1, bool)
        own[words] = True
        some = np.flatnonzero(own[region].sum(1) >= least)  # no fewer words can be common
        ok, share = np.zeros(len(region), bool), np.zeros(len(region))
        whole = common_subsequence(words, region[some])
        share[some] = whole / n
        ok[some] = whole >= alone
        maybe = some[(whole >= least) & (whole < alone)]
        if len(maybe):
            tail = words[n - self.answer[item]:]
            ok[maybe] = common_subsequence(tail, region[maybe]) >= ANSWER * len(tail)
        return ok, share


def common_subsequence(words: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the words with each row; bit-parallel over rows, 62 words a limb."""
    vocabulary, at = np.unique(words, return_inverse=True)
    limbs = -(-len(words) // 62)
    match = np.zeros((len(vocabulary) + 1, limbs), np.uint64)
    for i, v in enumerate(at.tolist()):
        match[v, i // 62] |= np.uint64(1 << (i % 62))
    full = np.array([(1 << min(62, len(words) - 62 * k)) - 1 for k in range(limbs)], np.uint64)
    place = np.searchsorted(vocabulary, region)
    place = np.where(vocabulary[np.minimum(place, len(vocabulary) - 1)] == region, place, len(vocabulary)).T
    state = np.tile(full[:, None], (1, len(region)))
    for column in place:
        carry = np.zeros(len(region), np.uint64)
        for k in range(limbs):
            s = state[k]
            u = s & match[:, k][column]
            total = s + u + carry
            carry = total >> np.uint64(min(62, len(words) - 62 * k))
            state[k] = (total | (s - u)) & full[k]
    zeros = ~state & full[:, None]
    return sum(np.bitwise_count(z).astype(np.int64) for z in zeros)


def grid(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, their documents, places a window spans): every STRIDE-th of the size from each document's begin on, and
    its end. Windows go from a place to the one so many further, or, in a shorter document, from its first to its last."""
    n = np.diff(first)
    stride = max(1, size // STRIDE)
    count = np.where(n > 0, -(-n // stride) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    i = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return np.minimum(first[doc] + i * stride, first[doc + 1]), doc, max(1, round(size / stride))


class Search:
    """Candidates of many texts, then their checks item by item, so that each step has many rows."""

    def __init__(self, items: Items, space: np.ndarray):
        self.items, self.space = items, np.ascontiguousarray(space.T, np.float64)
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, h: np.ndarray, first: np.ndarray, base: int) -> None:
        """Texts whose numbers start at `base`."""
        items = self.items
        if not len(h) or not items.ids:
            return
        bucket, number = _bucket(h), items.number(h)
        lines = np.empty((len(self.space), len(h) + 1), np.float32)
        lines[:, 0] = 0
        total = np.empty(len(h))
        for line, place in zip(lines, self.space):
            line[1:] = np.cumsum(np.take(place, bucket, mode="clip", out=total), out=total)
        sums = np.empty(lines.shape[::-1], np.float32)  # a row a place: what a window needs stands together
        for c in range(0, len(sums), 512):
            sums[c: c + 512] = lines[:, c: c + 512].T
        del lines
        for size, members in items.classes.items():
            place, doc, span = grid(first, size)
            ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]), len(doc) - 1) if len(doc) else np.zeros(0, np.int64)
            begins = np.concatenate(([0], ends[:-1] + 1)) if len(doc) else ends
            small = ends - begins < span
            if small.any():
                self._candidates(members, size, np.take(sums, place[ends[small]], 0) - np.take(sums, place[begins[small]], 0), place[begins[small]], place[ends[small]], doc[ends[small]], doc[ends[small]], number, first, base)
            for c in range(0, len(place) - span, WINDOWS):
                at, own = place[c: c + WINDOWS + span], doc[c: c + WINDOWS + span]
                x = np.take(sums, at, 0, mode="clip")
                self._candidates(members, size, x[span:] - x[:-span], at[:-span], at[span:], own[:-span], own[span:], number, first, base)

    def _candidates(self, members: list[int], size: int, v: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray, last: np.ndarray, number: np.ndarray, first: np.ndarray, base: int) -> None:
        """Keeps the windows (rows of v, from a in document d to b) that are near an item and end in the same document."""
        least = np.float32(COSINE) * np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), np.float32(1e-9))
        least[d != last] = np.inf  # from one document into another
        parts = []
        for k in range(0, len(members), MEMBERS):
            near = v @ self.items.vectors[members[k: k + MEMBERS]].T >= least[:, None]
            row, column = np.divmod(np.flatnonzero(near), near.shape[1])
            parts.append((column + k, row))
        column, row = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        if not len(row):
            return
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        margin = size // 3 + 1
        left, right = np.maximum(a[row] - margin, first[d[row]]), np.minimum(b[row] + margin, first[d[row] + 1])
        at = left[:, None] + np.arange(size + 2 * margin + size // STRIDE)
        region = np.where(at < right[:, None], number[np.minimum(at, len(number) - 1)], 0)
        cuts = np.flatnonzero(np.diff(column, prepend=-1))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(row)]):
            self.waiting.setdefault(members[int(column[i])], []).append((base + d[row[i:j]], region[i:j]))

    def finish(self) -> dict[int, dict[int | None, float]]:
        """For each text the items found in it with the share of their words."""
        out: dict[int, dict[int | None, float]] = {}
        for item, parts in self.waiting.items():
            docs, region = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            ok, share = self.items.found(item, region)
            for r, x in zip(docs[ok].tolist(), share[ok].tolist()):
                got = out.setdefault(r, {})
                got[self.items.ids[item]] = max(x, got.get(self.items.ids[item], 0.0))
        self.waiting = {}
        return out


def _nulls_last(item: int | None) -> tuple[bool, int]:
    return item is None, item or 0


def _searcher(rows: list[tuple[int | None, str]], space: np.ndarray, names: tuple[str, str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(Items(rows, space), space)
        for batch in slices(batches, "text", BATCH):
            at = 0
            for part in slices(iter([batch]), "text", STEP):
                search.add(*_texts(part), at)
                at += part.num_rows
            found = search.finish()
            ids = [sorted(found.get(i, ()), key=_nulls_last) for i in range(batch.num_rows)]
            shares = [max(found[i].values()) if i in found else 0.0 for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int64())), pa.array(shares, pa.float64())], names=[*batch.schema.names, *names])

    return work


def find_items(docs: DataFrame, benchmark: DataFrame, names: tuple[str, str] = ("__items", "__share")) -> DataFrame:
    """The rows of docs (with a column text) and two columns of the given names: the ids found, ascending, null last, and
    the largest share of an item's words. benchmark: item_id, text."""
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

    found, share = names
    items = written(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")), "benchmark")
    texts = docs.select("text").unionByName(items.select("text"))
    space = latent_space(texts)
    blocks = max(1, -(-items.count() // ITEMS))
    out = docs
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = sorted((tuple(r) for r in part.collect()), key=lambda r: (_nulls_last(r[0]), r[1]))  # about ITEMS of them
        own = (unused(out, f"{found}_{k}"), unused(out, f"{share}_{k}")) if k else names
        schema = StructType([*out.schema.fields]).add(own[0], ArrayType(LongType())).add(own[1], DoubleType())
        out = out.mapInArrow(_searcher(rows, space, own), schema)
        if k:
            both = F.array_sort(F.array_distinct(F.concat(F.col(f"`{found}`"), F.col(f"`{own[0]}`"))))
            out = out.withColumns({found: both, share: F.greatest(F.col(f"`{share}`"), F.col(f"`{own[1]}`"))}).drop(*own)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, contaminated, item_ids and lcs_share of every document."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    found = find_items(docs, items)
    return found.select("doc_id", (F.size("__items") > 0).alias("contaminated"), F.col("__items").alias("item_ids"), F.col("__share").alias("lcs_share"))
