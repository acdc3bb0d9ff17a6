"""The sparse text encoder: tokens, their 32-bit index, query and BM25 document weights."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek.semantics import BM25_AVERAGE, BM25_B, BM25_K1

_RUN = regex.compile(r"[\p{Alphabetic}0-9_]+")
SPARSE_TYPE = "struct<indices: array<bigint>, values: array<float>>"


def tokens(text: str) -> list[str]:
    """Lower-cased runs of letters, ASCII digits and _ (so a hyphen divides) of two bytes at least, or the letter c."""
    return [t for t in _RUN.findall(text.lower()) if len(t.encode()) >= 2 or t == "c"]


@lru_cache(1 << 16)
def token_index(token: str) -> int:
    """FNV-1a over the token's byte length as eight little-endian bytes and then its bytes."""
    data = token.encode()
    h = 0x811C9DC5
    for b in len(data).to_bytes(8, "little") + data:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def _vector(weights: dict[int, float]) -> tuple[list[int], list[float]]:
    items = sorted(weights.items())
    return [i for i, _ in items], [w for _, w in items]


def query_vector(text: str) -> tuple[list[int], list[float]]:
    """Weights 1 + ln(tf)."""
    counts = Counter(map(token_index, tokens(text)))
    return _vector({i: 1 + math.log(n) for i, n in counts.items()})


def document_vector(text: str, k1: float = BM25_K1, b: float = BM25_B, average: float = BM25_AVERAGE) -> tuple[list[int], list[float]]:
    """Saturated term frequencies."""
    words = tokens(text)
    counts = Counter(map(token_index, words))
    norm = k1 * (1 - b + b * len(words) / average)
    return _vector({i: n * (k1 + 1) / (n + norm) for i, n in counts.items()})


def word_runs(text: Column) -> Column:
    """`tokens` of a text column, by the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_\p{IsAlphabetic}]{2,}|[\p{IsAlphabetic}&&[^\x00-\x7F]]|c"), F.lit(0))


def document_weight(times: Column, size: Column, weights: str) -> Column:
    """The weight of a word that occurs `times` times among `size`, as the vectors have it."""
    if weights == "bm25":
        out = times * (BM25_K1 + 1) / (times + BM25_K1 * (1 - BM25_B + BM25_B * size / BM25_AVERAGE))
    else:
        out = F.lit(1.0) + F.log(times)
    return out.cast("float").cast("double")


def sparse_column(text: Column, weights: str = "query") -> Column:
    """The sparse vector of a text column, Arrow batches at a time; null for a text without tokens."""
    encode = document_vector if weights == "bm25" else query_vector

    @F.pandas_udf(SPARSE_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [encode(t) if t else ([], []) for t in batch]
            yield pd.DataFrame({"indices": [r[0] for r in rows], "values": [r[1] for r in rows]})

    out = run(text)
    return F.when(F.size(out["indices"]) > 0, out)


def word_list(text: Column) -> Column:
    """Words of MATCH: lower-cased runs of letters, digits and _."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def words(text: str) -> list[str]:
    return regex.findall(r"[\p{L}\p{N}_]+", text.lower())
