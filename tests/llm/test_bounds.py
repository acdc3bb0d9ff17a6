"""What must hold at any size: no string without an anchor, documented bounds, pairs of long lists in tiles, files of
bounded size, forms of images, recall of the candidate search; each on small data against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def sentence(rng, n):
    return " ".join(rng.choice(["stone", "river", "walks", "night", "sings", "glass", "leaf", "wind"]) + str(rng.randint(0, 60)) for _ in range(n))


# --- shared folder


def test_shared_folder_and_removal(spark, tmp_path, monkeypatch):
    from sparkseek.llm import common

    class Conf:
        def __init__(self, found):
            self.found = found

        def get(self, key, default=None):
            return self.found

    class Context:
        def __init__(self, master, folder):
            self.master, self.folder = master, folder

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, conf, master, folder):
            self.conf, self.sparkContext = Conf(conf), Context(master, folder)

    assert common.shared_dir(Session("hdfs://a/b/", "yarn", "x")) == "hdfs://a/b"
    assert common.shared_dir(Session(None, "yarn", "hdfs://c/d")) == "hdfs://c/d"
    assert common.shared_dir(Session(None, "local[4]", None)) == common.LOCAL_SHARED
    for master in ("yarn", "spark://a:1", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(Session(None, master, None))
    before = list(common._MADE)
    table = common.written(spark.range(3), "probe")
    path = table.written_path.removeprefix("file://")
    assert __import__("os").path.isdir(path) and common._MADE == [*before, table.written_path]
    common.drop(table)
    assert not __import__("os").path.exists(path) and common._MADE == before


def test_sums_in_two_levels(spark, monkeypatch):
    from sparkseek.llm import common

    monkeypatch.setattr(common, "TASKS", 200)  # 4 cores: groups of tasks
    docs = spark.range(500, numPartitions=9).select(F.col("id").cast("string").alias("text"))

    def add(matrix, batch):
        for t in batch.column(0).to_pylist():
            matrix[int(t) % 130, 1] += int(t)

    want = np.zeros((130, 2), np.int64)
    for i in range(500):
        want[i % 130, 1] += i
    assert (common.accumulate(docs, add, 130, 2) == want).all()


# --- 1


def test_every_string_has_an_anchor(monkeypatch):
    """Also where the smallest hash of a string is 0."""
    from sparkseek.llm import suffix_dedup as s

    rng = random.Random(1)
    text = sentence(rng, 80).encode()
    real = s.mix
    for zero in (60, 200, 333):
        monkeypatch.setattr(s, "mix", lambda h, k=zero: np.where(np.arange(len(h)) == k, h & np.uint64(0), real(h)) if len(h) > 300 else real(h))
        block = s.Block(np.array([1]), np.frombuffer(text, np.uint8), np.array([0, len(text)]), 50, 20)
        at = block.places - block.starts[0]
        for i in range(len(text) - 49):
            assert ((at >= i) & (at + 20 <= i + 50)).any(), i


def test_hot_anchors_are_split(spark):
    """With every anchor hot that two blocks hold, the result is that of brute force."""
    from sparkseek.llm.suffix_dedup import remove_repeats

    rng = random.Random(3)
    common = "all rights reserved; no part of this may be copied."  # in many surroundings
    texts = [f"{sentence(rng, rng.randint(1, 6))} {common} {sentence(rng, rng.randint(0, 6))}" for _ in range(60)]
    texts += [texts[k][rng.randint(0, 8):] + sentence(rng, 3) for k in range(0, 60, 4)] + [common, common + "!", "x" + common, texts[7]]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(5)
    first: dict = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 49):
            first.setdefault(t[i: i + 50], d)
    want = {}
    for d, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if first[t[i: i + 50]] < d:
                gone[i: i + 50] = True
        want[d] = (int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(t.encode(), np.uint8)[~gone])).hexdigest())
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in remove_repeats(docs, block_bytes=400, hot_blocks=2).collect()}
    assert got == want and sum(n for n, _ in want.values()) > 2000


# --- 2


def test_forms_of_images():
    """Every form is read back by both readers, and the streams hold what their form says."""
    from sparkseek.llm import webp

    rng = np.random.Generator(np.random.PCG64(4))
    words = [b"river ", b"stone, ", b"the night ", b"and\n"]
    text = b"".join(words[i] for i in rng.integers(0, 4, 4000))
    images = [np.frombuffer(text[i: i + 9216], np.uint8) for i in range(0, 9216, 4608)]
    images += [rng.integers(0, 256, 9216).astype(np.uint8), np.full(576, 255, np.uint8), np.tile(np.arange(17, dtype=np.uint8), 34)[:576], rng.integers(0, 5, 1152).astype(np.uint8)]
    kinds = {webp.PLAIN: [webp.GREEN], webp.CROSSED: [webp.CROSS], webp.PREDICTED: [webp.PREDICTOR, webp.GREEN], webp.CACHED: [], webp.INDEXED: [webp.PALETTE]}
    copies = 0
    for form, kind in kinds.items():
        medias = [webp.encode_grey(x, 576, form) for x in images]
        for x, y, m in zip(images, webp.decode_samples(medias), medias):
            assert (x == y).all()
            d = webp.Decoder(webp.split(m)[0])
            assert [t[0] for t in d.transforms] == kind and bool(d.cache_bits) == (form == webp.CACHED)
            copies += d.groups[0][4][1] > 0
            px = d.pixels()
            assert (px[..., 0] == 255).all() and all((px[..., c].ravel() == x).all() for c in (1, 2, 3))
    assert copies > 10  # distances take bits
    refs = webp.references(images[0])
    assert sum(n for _, n, _ in refs) > 7000 and all(n >= webp.SHORTEST and (images[0][i: i + n] == np.resize(images[0][i - d: i], n)).all() for i, n, d in refs)
    assert webp.form_of(images[3]) == webp.INDEXED and {webp.form_of(rng.integers(0, 256, 576).astype(np.uint8)) for _ in range(600)} == set(kinds)


# --- 3


def test_recall_of_the_candidate_search(spark):
    """Against all windows of the items' lengths: what shares 80 % of an item's words in order is found."""
    from sparkseek.llm.decontam import decontaminate

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text")
    rows = [(r["doc_id"], (r["text"] or "").split()) for r in docs.collect()]
    wanted = [(r["item_id"], r["text"].split()) for r in items.collect() if len((r["text"] or "").split()) >= 12]
    rng = random.Random(5)
    hosts = [sentence(rng, 60).split() for _ in range(60)]
    planted = []
    for k, host in enumerate(hosts):  # a tenth of the words replaced
        item, text = wanted[k % len(wanted)]
        changed = [sentence(rng, 1) if rng.random() < 0.1 else w for w in text]
        planted.append((100_000 + k, host[:30] + changed + host[30:]))

    def longest(a, b):
        line = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                line[j + 1], last = (last + 1 if x == y else max(line[j + 1], line[j])), line[j + 1]
        return line[-1]

    true = set()
    for d, ws in rows + planted:
        ws = [w.lower() for w in ws]
        held = set(ws)
        for item, text in wanted:
            text = [w.lower() for w in text]
            if sum(w in held for w in text) < 0.8 * len(text):
                continue
            step = max(1, len(text) // 2)
            if any(longest(text, ws[i: i + 2 * len(text)]) >= 0.8 * len(text) for i in range(0, max(1, len(ws) - len(text) + 1), step)):
                true.add((d, item))
    both = docs.unionByName(spark.createDataFrame([(d, " ".join(ws)) for d, ws in planted], "doc_id long, text string"))
    found = {(r["doc_id"], i) for r in decontaminate(both, items).collect() for i in r["item_ids"]}
    assert len(true) > 50 and len(true & found) >= 0.9 * len(true)


# --- 5


def test_vocabulary_from_a_table(spark):
    from sparkseek.llm.url_vocab import judge_urls, vocabulary

    rows = [(f"term{i}", 0.5) for i in range(3000)] + [("evil", None), ("EVIL", 0.1), ("Bad", 1.5), ("bad", 0.5), ("", 9.0), (None, 9.0)]
    strict, soft = vocabulary(spark.createDataFrame(rows, "term string, weight double"))
    assert strict == ("evil",) and soft["bad"] == 1.5 and len(soft) == 3001
    urls = ["http://a/evil", "http://a/evils", "http://a/term7", "http://a/term7/term7/term8/term9", "http://a/term7/term8/term9/term10", "http://a/bad-term1", "http://a/\nbad\nterm2999", None, "évil bad", "BAD.evil"]
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["n_strict"], r["n_soft"], r["soft_weight"], r["verdict"]) for r in judge_urls(pages, strict=strict, soft=soft).collect()}
    assert got == {0: (1, 0, 0.0, "block"), 1: (0, 0, 0.0, "allow"), 2: (0, 1, 0.5, "allow"), 3: (0, 3, 1.5, "allow"), 4: (0, 4, 2.0, "block"), 5: (0, 2, 2.0, "block"), 6: (0, 2, 2.0, "block"), 7: (0, 0, 0.0, "allow"), 8: (0, 1, 1.5, "allow"), 9: (1, 1, 1.5, "block")}
    assert {r["verdict"] for r in judge_urls(pages, strict=(), soft=(), rules=()).collect()} == {"allow"}


# --- 6


def test_archives_of_other_writers(spark, tmp_path):
    from sparkseek.llm.warc import read_archives

    body = b"<html>x</html>"
    sha = hashlib.sha256(body).digest()
    records = [
        b"WARC/1.0\r\nwarc-type:response\r\nWARC-Target-URI:  <http://a/>\r\nContent-Type: application/http;\r\n msgtype=response\r\nContent-Length: %d\r\n\r\nHTTP/1.0 200 OK\r\n\r\n%s\r\n\r\n" % (19 + len(body), body),
        b"WARC/1.1\r\nWARC-Type: resource\r\nCONTENT-LENGTH: %d\r\n\r\n%s\r\n\r\n" % (len(body), body),
        b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Payload-Digest: sha-256:" + base64.b32encode(sha).rstrip(b"=") + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
        b"WARC/1.0\r\nno colon here\r\nContent-Length: zero\r\n\r\n" + body + b"\r\n\r\n",
    ]
    data = b"".join(gzip.compress(r) for r in records)
    (tmp_path / "a.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", len(data))], "path string, bytes long")
    got = sorted(read_archives(files, range_bytes=100).collect(), key=lambda r: r["offset"])
    assert [(r["record_type"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in got] == [("response", sha.hex(), body), ("resource", sha.hex(), body), ("revisit", "sha1:ABC", None), ("revisit", sha.hex(), None), (None, sha.hex(), body)]
    assert got[0]["target_uri"] == "http://a/"


def test_only_repeated_pages_are_shuffled(spark):
    from sparkseek.llm import warc

    pages = spark.createDataFrame([(i, "u", f"{i % 50 if i < 100 else i}" * 120) for i in range(400)], "page_id long, url string, html string")
    digests = pages.select(F.sha2("html", 256).alias("digest"))
    some = digests.limit(20).distinct()
    bits = {r["page"]: bytes(r["bits"]) for r in warc._bit_map(some).collect()}
    slots = {r[0] for r in some.select(F.pmod(F.xxhash64("digest"), F.lit(warc.SLOTS))).collect()}
    assert {p * 32768 + 8 * i + k for p, b in bits.items() for i, x in enumerate(b) for k in range(8) if x >> k & 1} == slots
    got = {r["page_id"]: r["refers_to"] for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert got == {i: i - 50 if 50 <= i < 100 else None for i in range(400)}


# --- 7


def test_bound_of_the_training_rows(spark):
    from sparkseek.llm.quality import fit

    docs = spark.createDataFrame([(i if i < 80 else 7, f"{'good' if i % 2 else 'BAD!!'} {i} word") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(7, 0)], "doc_id long, quality int")
    seen = {}
    from sparkseek.llm import quality

    real = quality.train
    quality.train = lambda x, y: seen.update(n=len(y)) or real(x, y)
    try:
        fit(docs, labels, max_train=30)
    finally:
        quality.train = real
    assert seen["n"] == 30


# --- 9


def test_names_of_classes():
    from sparkseek.llm.jaccard import signature

    s = np.arange(5, dtype=np.uint64)
    name, rest = signature(s)
    other = signature(s, frozenset([name]))
    assert other[0] != name and other[1] == rest and signature(s, frozenset([name + 1])) == (name, rest)


def test_pairs_of_long_lists_in_tiles(monkeypatch):
    """All pairs near enough in size that no component joins, each once, whatever the tiles."""
    from sparkseek.llm import jaccard as j

    monkeypatch.setattr(j, "TILE", 7)
    monkeypatch.setattr(j, "PAIRS", 11)
    rng = np.random.Generator(np.random.PCG64(2))
    of = np.repeat([0, 1, 2], [30, 5, 17])
    sig = np.concatenate([rng.permutation(100)[:30], rng.permutation(100)[:5], rng.permutation(100)[:17]]).astype(np.int64)
    size, low = (50 + sig % 9).astype(np.uint32), sig.astype(np.uint32)
    row = pa.RecordBatch.from_pylist([{"bucket": 3, "kind": 2, "n": len(of), "data": j.pack(of, sig, size, low)}], j._ROW)
    flat = [r for b in j._flat_lists(iter([row])) for r in b.to_pylist()]
    tiles = []
    for r in flat:
        r["component"] = r["sig"] % 6
        for other in range(r["sides"]):
            tiles.append((r["bucket"], r["list"], min(r["side"], other), max(r["side"], other), r["sig"], r["n"], r["low"], r["component"], r["side"]))
    tiles.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*tiles[i: i + 13])], names=[f"c{k}" for k in range(9)]) for i in range(0, len(tiles), 13)]
    got = [frozenset(p) for b in j._cross(90, 100, 12)(iter(batches)) for d in b.column(3).to_pylist() for p in zip(*(x.tolist() for x in j.unpack(d)[:2]))]
    want = set()
    for k in range(3):
        members = sig[of == k].tolist()
        want |= {frozenset((a, b)) for a, b in itertools.combinations(members, 2) if a % 6 != b % 6 and min(50 + a % 9, 50 + b % 9) * 100 >= max(50 + a % 9, 50 + b % 9) * 90}
    assert set(got) == want and len(want) > 200


# --- 10


def test_files_of_bounded_size_and_lookups(spark):
    from sparkseek.llm import sst
    from sparkseek.llm.queries import byte_bpe_path

    rng = random.Random(4)
    texts = {i * 3: sentence(rng, rng.randint(1, 80)) for i in range(1500)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    manifest = sst.write_tables(docs, byte_bpe_path(), file_bytes=10_000)
    files = sorted(manifest.collect(), key=lambda r: (r["part"], r["number"]))
    assert len(files) > 3 and max(r["number"] for r in files) >= 1 and all(r["bytes"] < 100_000 for r in files)
    found = {r["doc_id"]: r for r in sst.read_tables(manifest).collect()}
    at = 0
    for d in sorted(texts):
        assert found[d]["start"] == at
        at += found[d]["n_tokens"]
    asked = [rng.randint(-10, 4600) for _ in range(1000)]
    got = {r["doc_id"]: list(r["ids"]) for r in sst.lookup_many(files, spark.createDataFrame([(d,) for d in asked], "doc_id long")).collect()}
    assert got == {d: list(found[d]["ids"]) for d in set(asked) if d in texts}
    opened = []
    real = sst.Table
    sst.Table = lambda *a: opened.append(a) or real(*a)
    try:
        assert [x.tolist() for x in sst.lookup(files, 300)] == [list(found[300]["ids"])] and sst.lookup(files, 301) == []
    finally:
        sst.Table = real
    assert len(opened) <= 2 and sst.lookup([], 3) == []
