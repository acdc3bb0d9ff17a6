"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns with the names that the operators use themselves."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
CLASH = ("bucket", "block", "kind", "sig", "n", "data", "score", "copy", "rate", "start", "media", "quality", "buckets", "low")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def sentence(rng, n):
    parts = ["the", "and", "of", "stone", "river", "élan", "mountain", "walks", "über", "Night", "sings", "42", "glass", "wind,", "leaf."]
    return " ".join(rng.choice(parts) + rng.choice(["", "", "s", "ing", "er"]) for _ in range(n))


def rows():
    rng = random.Random(4)
    base = [sentence(rng, rng.randint(20, 120)) for _ in range(24)]
    shared = sentence(rng, 30)
    texts = list(base)
    texts += [base[0], base[0], base[1].upper(), base[2] + " end", " ".join(["x"] + base[3].split()[1:])]  # copies and near copies
    texts += [b + "\n" + shared for b in base[4:9]]  # a passage that several documents share
    texts += [None, "", " \t\n", "one", "two words", "two words", "a" * 200, "a" * 150, "spam " * 60, "日本語 テキスト " * 8, sentence(rng, 9000)]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), *("x",) * len(CLASH)) for i, t in enumerate(texts)]
    out += [out[5], (None, base[10], None, "s0", 1, *(None,) * len(CLASH)), (None, None, None, None, None, *(None,) * len(CLASH))]
    return out


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def utf8(t):
    return (t or "").encode()


def by_row(found, key):
    """Rows in a fixed order, for multisets."""
    return sorted((tuple(r[k] for k in key) for r in found), key=repr)


# --- 1


def test_suffix_dedup(docs, data, none):
    from sparkseek.llm.suffix_dedup import remove_repeats

    length, want = 50, []
    first: dict = {}
    big = 1 << 62
    for d, t, *_ in data:
        b = utf8(t)
        for i in range(len(b) - length + 1):
            s = b[i: i + length]
            first[s] = min(first.get(s, big), big if d is None else d)
    for d, t, *_ in data:
        b = utf8(t)
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i: i + length]] < (big if d is None else d):
                gone[i: i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    key = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    got = [r.asDict() | {"kept": bytes(r["kept"])} for r in remove_repeats(docs).collect()]
    assert by_row(got, key) == sorted(want, key=repr)
    assert remove_repeats(none).count() == 0


def test_columns_order_is_the_suffix_order(tmp_path):
    from sparkseek.llm.suffix_dedup import Columns

    rng = np.random.Generator(np.random.PCG64(0))
    pieces = rng.integers(97, 99, (200, 14)).astype(np.uint8)
    ids = rng.integers(0, 40, 200)
    c = Columns(str(tmp_path), 14)
    c.add(ids[:90], pieces[:90])
    c.add(ids[90:], pieces[90:])
    got = c.repeats(8)
    for i in range(200):
        for j in range(7):
            smaller = any((pieces[k, j: j + 8] == pieces[i, j: j + 8]).all() and ids[k] < ids[i] for k in range(200))
            assert bool(int(got[i]) >> j & 1) == smaller


# --- 2


def test_webp_round_trip_of_columns(docs, data, none):
    from sparkseek.llm.webp import media_column, read_media

    found = read_media(media_column(docs)).collect()
    want = []
    for d, t, *_ in data:
        b = utf8(t)
        payload = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want.append((d, len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), payload))
    got = [r.asDict() | {"pixels": bytes(r["pixels"])} for r in found]
    assert by_row(got, ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "pixels")) == sorted(want, key=repr)
    same = collections.defaultdict(set)
    for r in found:
        same[r["payload_sha256"]].add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in same.values())
    assert read_media(media_column(none)).count() == 0


def test_webp_features_of_the_format():
    from sparkseek.llm import webp as w

    rng = np.random.Generator(np.random.PCG64(1))
    px = rng.integers(0, 40, (13, 21, 4)).astype(np.uint8)
    px[3:9, 4:9] = 7

    def same(image, **options):
        (stream,) = w.split(w.encode(image, **options))
        assert (w.Decoder(stream).pixels() == image).all()

    same(px)
    same(px, cache_bits=6)
    same(px, references=False)
    for mode in range(14):
        same(px, transforms=((w.PREDICTOR, 2, np.full((4, 6), mode)),))
    same(px, transforms=((w.PREDICTOR, 2, rng.integers(0, 14, (4, 6))), (w.CROSS, 3, rng.integers(0, 256, (2, 3, 3))), (w.GREEN,)), cache_bits=3)
    for n in (1, 2, 3, 5, 16, 17, 200):
        colours = rng.integers(0, 256, (n, 4)).astype(np.uint8)
        same(colours[rng.integers(0, n, (13, 21))], transforms=((w.PALETTE,),))
    with pytest.raises(ValueError):
        w.Decoder(b"\x00" * 20)


# --- 3


def test_decontamination(spark, docs, data, none):
    from sparkseek.llm.decontam import decontaminate

    rng = random.Random(9)
    unique = [" ".join(f"{rng.choice('bcdfgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.randint(0, 99)}" for _ in range(25)) + ". " + " ".join(f"ans{rng.randint(0, 999)}" for _ in range(5)) + "." for _ in range(6)]
    words = unique[1].split()
    for i in (3, 11, 17):
        words[i] = "other"
    extra = [(1001, "intro " + unique[0] + " outro"), (1002, sentence(rng, 200) + " " + " ".join(words) + " " + sentence(rng, 200)), (1003, " ".join(unique[2].split()[:12])), (1004, unique[3].upper())]
    items = spark.createDataFrame([*enumerate(unique), (50, None), (51, ""), (None, unique[5]), (52, "short answer")], "item_id long, text string")
    both = docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(d, t, "x") for d, t in extra], "doc_id long, text string, score string"))
    found = {r["doc_id"]: r for r in decontaminate(both, items).collect() if r["doc_id"] is not None}
    assert {d: list(r["item_ids"]) for d, r in found.items() if r["contaminated"]} == {1001: [0], 1002: [1], 1004: [3]}
    assert len(decontaminate(both, items).collect()) == len(data) + 4
    assert decontaminate(none, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate(docs, items.limit(0)).collect())


def test_decontamination_of_paraphrases(spark):
    """Words replaced at random: found well below four fifths of the item, also where the last sentence is hit."""
    from sparkseek.llm.decontam import bars, decontaminate

    rng = random.Random(12)
    word = lambda k: f"{rng.choice('bcdfgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.choice('aeiou')}{k}"
    items = [" ".join(word(rng.randint(0, 40)) for _ in range(34)) + ". " + " ".join(word(rng.randint(0, 40)) for _ in range(6)) + "." for _ in range(12)]

    def changed(text, places):
        return " ".join(sentence(rng, 1) if i in places else w for i, w in enumerate(text.split()))

    hosts = [sentence(rng, 150) for _ in range(60)]
    planted = [changed(t, {*rng.sample(range(34), 6), 35, 36, 38, 39}) for t in items[:6]]  # 30 of 40 words, 2 of 6 of the answer
    kept = [changed(t, set(rng.sample(range(34), 20))) for t in items[6:]]  # 20 of 40 words, the answer whole
    texts = hosts + [f"{sentence(rng, 40)} {t} {sentence(rng, 40)}" for t in planted + kept]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: (r["item_ids"], r["lcs_share"]) for r in decontaminate(docs, spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()}
    assert all(found[i] == ([], 0.0) for i in range(60))
    caught = [i for i in range(12) if found[60 + i][0]]
    assert all(found[60 + i] == ([i], 0.75 if i < 6 else 0.5) for i in caught)
    assert sum(i < 6 for i in caught) >= 5 and sum(i >= 6 for i in caught) >= 3  # the others miss the cosine
    assert all(a <= 0.8 * n and b <= 0.6 * n for n in range(8, 200) for a, b in [bars(n)]) and bars(7) == (7, 7)


def test_decontamination_with_null_item_ids(spark, monkeypatch):
    from sparkseek.llm import decontam

    rng = random.Random(3)
    unique = [" ".join(f"{rng.choice('bcdfgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.randint(0, 99)}" for _ in range(24)) for _ in range(4)]
    texts = [sentence(rng, 80), "a " + unique[0] + " z", unique[1] + " . " + unique[3], unique[2] + " . " + unique[1]]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(None, unique[0]), (None, unique[1]), (None, unique[2]), (7, unique[3]), (None, None)], "item_id long, text string")
    for most in (decontam.ITEMS, 2):  # in one block and in several
        monkeypatch.setattr(decontam, "ITEMS", most)
        found = {r["doc_id"]: (r["contaminated"], r["item_ids"], r["lcs_share"]) for r in decontam.decontaminate(docs, items).collect()}
        assert found == {0: (False, [], 0.0), 1: (True, [None], 1.0), 2: (True, [7, None], 1.0), 3: (True, [None], 1.0)}


def test_common_subsequence_over_limbs():
    from sparkseek.llm.decontam import common_subsequence

    rng = np.random.Generator(np.random.PCG64(3))

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for n in (1, 5, 61, 62, 63, 124, 150):
        words = rng.integers(1, 12, n).astype(np.uint64)
        region = rng.integers(1, 14, (7, 90)).astype(np.uint64)
        assert common_subsequence(words, region).tolist() == [plain(words.tolist(), r.tolist()) for r in region]


# --- 4


def test_context_tree_weighting(docs, data, none):
    from sparkseek.llm.ctw import score

    learned = [(d, utf8(t)) for d, t, *_ in data if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    words = collections.Counter(w for _, b in learned for w in WORD.findall(b.translate(LOW)))
    words["end"] = len(learned)
    total, distinct = sum(words.values()), len(words)
    counts = collections.defaultdict(lambda: [0, 0])

    def bits(b):
        b = b"\0" * 4 + b + b"\xff"
        for i in range(4, len(b)):
            node = 1
            for k in range(7, -1, -1):
                yield b[i - 4: i], node, b[i] >> k & 1
                node = node << 1 | b[i] >> k & 1

    for _, b in learned:
        for context, node, bit in bits(b):
            for k in range(5):
                counts[context[4 - k:], node][bit] += 1
    children = collections.defaultdict(list)
    for context, node in counts:
        if context:
            children[context[1:], node].append((context, node))
    lg = math.lgamma
    kt = {k: lg(a + 0.5) + lg(b + 0.5) - 2 * lg(0.5) - lg(a + b + 1) for k, (a, b) in counts.items()}
    weighted = {}
    for size in range(4, -1, -1):
        for k in counts:
            if len(k[0]) == size:
                weighted[k] = kt[k] if size == 4 else math.log(0.5) + np.logaddexp(kt[k], sum(weighted[c] for c in children[k]))

    def p(context, node, bit):
        out = None
        for k in range(4, -1, -1):
            key = (context[4 - k:], node)
            n = counts.get(key, [0, 0])
            if not sum(n) and k:
                continue
            own = (n[bit] + 0.5) / (sum(n) + 1)
            share = 1 if out is None else math.exp(math.log(0.5) + kt[key] - weighted[key])
            out = own if out is None else share * own + (1 - share) * out
        return out

    found = score(docs, block_bytes=1 << 12, depth=4).collect()
    assert len(found) == len(data) and {r["train_tokens"] for r in found} == {total}
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for d, t, *_ in data[:46]:
        b, r = utf8(t), by_id[d]
        ws = [*WORD.findall(b.translate(LOW)), "end"]
        assert (r["n_tokens"], r["n_known"], r["held_out"]) == (len(ws), sum(words[w] > 0 for w in ws), zlib.crc32(str(d).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws))
        if len(b) < 2000:
            assert r["score"] == pytest.approx(sum(math.log10(p(*x)) for x in bits(b)), rel=1e-5)
    assert score(none).count() == 0


def test_context_tree_is_deeper_than_a_word(spark):
    """Against brute force at the default depth, and what the contexts past the fourth byte are worth."""
    from sparkseek.llm.ctw import DEPTH, score

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["xabcdeP", "yabcdeQ", "zabcdeR", "night"]) for _ in range(30)) for _ in range(40)]
    learned = [t.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    assert DEPTH == 7

    def bits(b):
        b = b"\0" * 7 + b + b"\xff"
        for i in range(7, len(b)):
            for k in range(8):
                yield b[i - 7: i], (1 << k) | b[i] >> (8 - k), b[i] >> (7 - k) & 1

    counts = collections.defaultdict(lambda: [0, 0])
    for b in learned:
        for context, node, bit in bits(b):
            for k in range(8):
                counts[context[7 - k:], node][bit] += 1
    lg = math.lgamma
    kt = {k: lg(a + 0.5) + lg(b + 0.5) - 2 * lg(0.5) - lg(a + b + 1) for k, (a, b) in counts.items()}
    product, weighted = collections.defaultdict(float), {}
    for (context, node) in sorted(counts, key=lambda k: -len(k[0])):
        key = context, node
        weighted[key] = kt[key] if len(context) == 7 else math.log(0.5) + np.logaddexp(kt[key], product[key])
        product[context[1:], node] += weighted[key] if context else 0.0

    def p(context, node, bit):
        out = None
        for k in range(7, -1, -1):
            key = (context[7 - k:], node)
            n = counts.get(key, [0, 0])
            if sum(n) or not k:
                own = (n[bit] + 0.5) / (sum(n) + 1)
                share = 1 if out is None else math.exp(math.log(0.5) + kt[key] - weighted[key])
                out = own if out is None else share * own + (1 - share) * out
        return out

    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in score(docs).collect()}
    for i in range(12):
        assert found[i]["score"] == pytest.approx(sum(math.log10(p(*x)) for x in bits(texts[i].encode())), rel=1e-5)
    held = [i for i, r in found.items() if r["held_out"]]
    shallow = {r["doc_id"]: r for r in score(docs, depth=4).collect()}
    assert held and sum(found[i]["bits_per_byte"] for i in held) < 0.8 * sum(shallow[i]["bits_per_byte"] for i in held)


# --- 5


def test_urls(spark):
    from sparkseek.llm.url_vocab import judge_urls

    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/casino": ("", "", None, "block"),
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
        "https://example.org/en/2/casino": ("example.org", "/en/2/casino", "org/", "allow"),
        "http://x.org": ("x.org", "", None, "allow"), "http://xorg/": ("xorg", "/", None, "allow"), "http://org/": ("org", "/", "org/", "allow"),
        "http://b.com/fr/casino": ("b.com", "/fr/casino", "com/fr/", "allow"), "http://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
        "http://b.com/casinos": ("b.com", "/casinos", None, "allow"), "http://my-CASINO.net#x": ("my-casino.net", "", None, "block"),
        "http://free.net/free": ("free.net", "/free", None, "allow"), "http://free.net/bets": ("free.net", "/bets", None, "block"),
        "http://é.net/ü?x=://y": ("é.net", "/ü", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", "x", "y") for i, u in enumerate([*cases, "http://x.org"])], "page_id long, url string, host string, text string, n string")
    got = judge_urls(pages).collect()
    assert len(got) == len(cases) + 1
    assert {list(cases)[r["page_id"]]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got if r["page_id"] < len(cases)} == cases
    assert judge_urls(pages.limit(0)).count() == 0


# --- 6


def test_warc(spark):
    from sparkseek.llm.warc import read_archives, write_archives

    rng = random.Random(2)
    big = "".join(rng.choice("abcdé\n") for _ in range(3_000_000))
    html = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é" * 50, "é" * 50, big, "WARC/1.1\r\n\r\n" * 20, "y" * 100]
    pages = [(i, "http://a/ b\n", h, "c") for i, h in enumerate(html)] + [(4, None, "y" * 100, "c"), (None, "u", "z" * 300, "c"), (None, "u", "y" * 100, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    files = write_archives(df, file_bytes=1 << 16)
    want = []
    first = {}
    for i, _, h, _ in pages:
        if len(utf8(h)) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    for i, _, h, _ in pages:
        b = utf8(h)
        other = first.get(h) if len(b) >= 100 else None
        revisit = other is not None and other != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    for size in (1 << 10, 5_000, 1 << 23):
        got = read_archives(files, range_bytes=size).collect()
        assert by_row(got, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == sorted(want, key=repr)
    texts = {bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert texts == {utf8(h) for _, _, h, _ in pages}
    assert read_archives(write_archives(df.limit(0))).count() == 0


# --- 7


def test_quality(spark, docs, none):
    from sparkseek.llm.quality import classify

    rng = random.Random(3)
    made = []
    for i in range(400):
        bad = i % 3 == 0
        text = sentence(rng, 40)
        made.append((i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text, int(not bad)))
    table = spark.createDataFrame([(d, t, "s") for d, t, _ in made], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, q) for d, _, q in made] + [(3, None), (None, 1), (10_000, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in classify(table, labels).collect()}
    held = [d for d, *_ in made if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r["held_out"]} == set(held)
    assert np.mean([got[d]["predicted"] == made[d][2] for d in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    odd = classify(docs, labels).collect()
    assert len(odd) == len(rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in classify(docs, labels.limit(0)).collect()}) == 1
    assert classify(none, labels).count() == 0


# --- 8


def test_poisson_mix(spark, docs, data, none):
    from sparkseek.llm.poisson_mix import replicate

    n = 6000
    table = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 30 == 1, "c").otherwise("b").alias("source"), F.lit("x").alias("copy"), F.lit("t").alias("rate"))
    out = replicate(table, weights={"a": 1.0, "b": 2.0, "c": 1.0}, default_weight=0.0, epochs=2.0).collect()
    share = collections.Counter(r["source"] for r in out)
    assert len(out) == pytest.approx(2 * n, rel=0.06) and share["b"] / len(out) == pytest.approx(0.5, abs=0.04)
    copies = collections.defaultdict(list)
    for r in out:
        copies[r["doc_id"]].append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())
    keys = [r["shuffle_key"] for r in out]
    assert keys == sorted(keys) and [r["doc_id"] for r in out] != sorted(r["doc_id"] for r in out)
    one = {r["doc_id"]: r["n_copies"] for r in out}
    assert {r["doc_id"]: r["n_copies"] for r in replicate(table.repartition(7), weights={"a": 1.0, "b": 2.0, "c": 1.0}, default_weight=0.0, epochs=2.0).collect()} == one
    # a mean of 1200 is drawn in pieces
    many = replicate(spark.range(200).select("id", F.lit("s").alias("source")), id_col="id", epochs=1200.0, shuffle=False).groupBy("id").count().collect()
    mean = np.mean([r["count"] for r in many])
    assert abs(mean - 1200) < 12 and 20 < np.std([r["count"] for r in many]) < 52
    odd = replicate(docs, epochs=3.0)
    assert {r["source"] for r in odd.collect()} == {"s0", "s1", "s2", None}
    assert replicate(none).count() == 0


# --- 9


def shingle_sets(data, k):
    out = []
    for d, t, *_ in data:
        w = WORD.findall(utf8(t).translate(LOW))
        out.append((d, frozenset(tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    return out


def classes(sets, num):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = collections.defaultdict(lambda: None)
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = d if least[r] is None else least[r] if d is None else min(least[r], d)
    return sorted(((d, len(s), least[find(i)] if s else d) for i, (d, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_join(docs, data, none, k, num):
    from sparkseek.llm.jaccard import near_duplicates

    got = by_row(near_duplicates(docs, k, num, 100).collect(), ("doc_id", "n_shingles", "component_id"))
    assert got == classes(shingle_sets(data, k), num)
    if k == 3:
        assert near_duplicates(none, k, num, 100).count() == 0


def test_jaccard_chain_of_near_copies(spark):
    """Links that only hold between neighbours of a chain: a centre alone would not join it."""
    from sparkseek.llm.jaccard import near_duplicates

    rng = random.Random(8)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    table = []
    for i in range(40):
        words[(i * 3) % 120] = f"n{i}"
        table.append((i, " ".join(words)))
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = by_row(near_duplicates(df, 3, 90, 100).collect(), ("doc_id", "n_shingles", "component_id"))
    assert got == classes(shingle_sets(table, 3), 90)


def test_components(spark):
    from sparkseek.llm.components import components

    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    touched = {x for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(x, find(x)) for x in touched} and len(got) == len(touched)


# --- 10


def test_token_tables(docs, data, none):
    from tokenizers import Tokenizer

    from sparkseek.llm import sst
    from sparkseek.llm.queries import byte_bpe_path

    tokenizer = Tokenizer.from_file(byte_bpe_path())
    manifest = sst.write_tables(docs, byte_bpe_path())
    found = sst.read_tables(manifest).collect()
    by_id = collections.defaultdict(list)
    for d, t, *_ in data:
        by_id[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    order = sorted(by_id, key=lambda d: (d is not None, d or 0))
    at = 0
    for d in order:
        own = sorted((r for r in found if r["doc_id"] == d), key=lambda r: r["start"])
        assert sorted(r["ids"] for r in own) == sorted(by_id[d])
        for r in own:
            assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["n_tokens"]
    files = manifest.collect()
    for d in (5, 20, None, 10_000):
        assert sorted(x.tolist() for x in sst.lookup(files, d)) == sorted(by_id.get(d, []))
    assert sst.read_tables(sst.write_tables(none, byte_bpe_path())).count() == 0


def test_encoder_cuts_like_the_library():
    from sparkseek.llm.bpe import Encoder
    from sparkseek.llm.queries import byte_bpe_path

    e = Encoder(byte_bpe_path())
    rng = random.Random(1)
    texts = ["", "don't  'street we'll\n\n x", "'s 's", "x'ree l'l 've ''s", "日本 語123abc!?", "<|endoftext|> hi<|endoftext|>", "\t\tx  \t y ", "a'", "é" * 3000]
    texts += ["".join(rng.choice(" \n\t'sremvldtl1é!日 ½²") for _ in range(rng.randint(0, 30))) for _ in range(800)]
    raw = [t.encode() for t in texts]
    for _ in range(2):
        ids, bounds = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
        for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
            assert ids[a:b].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


# --- the whole


def test_word_hashes_do_not_depend_on_neighbours():
    from sparkseek.llm.common import Words

    def hashes(texts):
        raw = [t.encode() for t in texts]
        w = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
        return [w.hash[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])]

    texts = ["Hello World", "", "x" * 70_000 + " hello", "  ", "world"]
    together = hashes(texts)
    assert together == [hashes([t])[0] for t in texts]
    assert together[0] == [together[2][1], together[4][0]] and len(together[2]) == 2


def test_item_words_are_numbered_by_the_first_bits_of_their_hash(monkeypatch):
    from sparkseek.llm import decontam

    monkeypatch.setattr(decontam, "NUMBER_BITS", 3)  # several words with one beginning
    items = decontam.Items([(1, " ".join(f"w{i}" for i in range(60))), (None, "x y z")], np.ones((decontam.BUCKETS, 2), np.float32))
    h = np.concatenate((items.vocabulary, items.vocabulary + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)))
    plain = {int(v): i + 1 for i, v in enumerate(items.vocabulary)}
    assert items.most > 1 and items.number(h).tolist() == [plain.get(int(x), 0) for x in h]


def test_symbols_of_lengths_and_distances_have_their_least_value():
    from sparkseek.llm import webp

    for v in range(1, 5000):
        symbol, extra, value = webp.value_code(v)
        assert (webp._EXTRA[symbol], webp._LEAST[symbol] + value) == (extra, v)
