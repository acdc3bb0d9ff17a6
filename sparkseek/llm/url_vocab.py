"""URL filter with a weighted vocabulary: an Aho-Corasick automaton finds strict and soft terms in one pass.

A term counts where no ASCII letter or digit stands directly before or after it. One strict term rejects a URL; so do
distinct soft terms whose weights reach `soft_limit` together (each weighs 1 unless told otherwise, so that is a number of
terms). Host rules, where one fits, take precedence over the vocabulary. The vocabulary is a parameter, and `vocabulary`
reads one of any size up to MAX_TERMS from a table.

The automaton runs once over all URLs of an Arrow batch, joined; Python sees its hits only, and the boundary checks and
sums are numpy.

Edge cases: a null, empty or scheme-less URL has an empty host and path, fits no rule and is judged on its text (null
as empty: allow). Repeated rows each get their row. An empty vocabulary rejects nothing. Only the id and the URL column are read, so other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Default vocabulary (parameters of `judge_urls`).
STRICT = ("porn", "xxx", "casino", "viagra", "escort", "hentai", "warez", "torrent", "keygen", "jackpot")
SOFT = ("adult", "bet", "bets", "betting", "bonus", "cheap", "dating", "deal", "deals", "free", "gambling", "hot", "lottery", "pills", "poker", "replica", "sex", "sexy", "slots", "spam", "win", "winner")
SOFT_LIMIT = 2
MAX_TERMS = 100_000

#: (host, path, verdict) of the default rules.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased. Path: from there up to ? # or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return lowered(host), path


def best_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is the outermost condition
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def vocabulary(table: DataFrame, term_col: str = "term", weight_col: str = "weight") -> tuple[tuple[str, ...], dict[str, float]]:
    """(strict terms, weights of soft terms) of a table with a row a term: a null weight is strict. A repeated term is strict
    if one of its rows is, else has its largest weight; null and empty terms are left out. At most MAX_TERMS terms."""
    term = F.trim(lowered(F.col(term_col)))
    rows = table.select(term.alias("term"), F.col(weight_col).cast("double").alias("weight")).where("term <> ''").groupBy("term").agg(F.max("weight").alias("weight"), F.count_if(F.col("weight").isNull()).alias("n"))
    found = rows.orderBy("term").limit(MAX_TERMS + 1).collect()
    if len(found) > MAX_TERMS:
        raise ValueError(f"the vocabulary has more than {MAX_TERMS} terms")
    return tuple(r["term"] for r in found if r["n"]), {r["term"]: r["weight"] for r in found if not r["n"]}


def _counter(strict: tuple[str, ...], soft: dict[str, float]):
    terms = [*strict, *(t for t in soft if t not in set(strict))]  # a term in both lists is strict

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            machine.add_word(term, i)
        if terms:
            machine.make_automaton()
        size = np.array([len(t) for t in terms], np.int64)
        weight = np.array([0.0] * len(strict) + [soft[t] for t in terms[len(strict):]])
        edge = np.zeros(128, bool)
        edge[[*range(48, 58), *range(97, 123)]] = True
        for batch in batches:
            urls = batch.tolist()
            starts = np.cumsum([0] + [len(u) + 1 for u in urls])
            text = "\n".join(urls) + "\n"
            hits = np.array(list(machine.iter(text)) if terms else [], np.int64).reshape(-1, 2)
            end, term = hits[:, 0], hits[:, 1]
            begin = end - size[term]  # the place before the term
            letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            alone = lambda at: ~edge[np.where(letters[at] < 128, letters[at], 0)]
            ok = ((begin < 0) | alone(np.maximum(begin, 0))) & alone(end + 1)
            pairs = np.unique(np.stack((np.searchsorted(starts, end[ok], "right") - 1, term[ok]), 1), axis=0)
            url, term = pairs[:, 0], pairs[:, 1]
            hard = term < len(strict)
            yield pd.DataFrame({
                "n_strict": np.bincount(url[hard], minlength=len(urls)).astype(np.int64), "n_soft": np.bincount(url[~hard], minlength=len(urls)).astype(np.int64),
                "soft_weight": np.bincount(url[~hard], weight[term[~hard]], minlength=len(urls)).astype(float),
            })

    return F.pandas_udf(count, "n_strict long, n_soft long, soft_weight double")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", strict: Iterable[str] = STRICT, soft: Iterable[str] | Mapping[str, float] = SOFT, soft_limit: float = SOFT_LIMIT, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """id, host, path, rule, verdict, n_strict, n_soft (distinct terms) and soft_weight of every row."""
    strict, soft = tuple(dict.fromkeys(strict)), dict(soft) if isinstance(soft, Mapping) else dict.fromkeys(soft, 1.0)
    if not all(t and t == t.lower() and t.isascii() and t.isalnum() for t in (*strict, *soft)):
        raise ValueError("terms are non-empty lower-case ASCII letters and digits")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"), lowered(F.coalesce("url", F.lit(""))).alias("text"))
    rows = rows.withColumn("n", _counter(strict, soft)("text"))
    rule, given = best_rule(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("n.n_strict") > 0) | (F.col("n.soft_weight") >= soft_limit), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(given, method).alias("verdict"), "n.n_strict", "n.n_soft", "n.soft_weight")
