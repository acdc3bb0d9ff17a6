"""The registered queries of the training-data operators, and DuckDB SQL where SQL can express one.

Each query applies its operator to its whole table and derives the digest columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkseek.llm.webp import media_column, read_media

    features = read_media(media_column(_table(spark, sf_dir, "documents")), with_pixels=False)
    return features.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


@_query
def op5_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkseek.llm.url_vocab import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def _url_sql() -> str:
    from sparkseek.llm.url_vocab import RULES, SOFT, SOFT_LIMIT, STRICT

    term = lambda t: f"(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))::BIGINT"
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH a AS (SELECT page_id, {low.format("coalesce(url, '')")} AS u,
                      CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, u, {low.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    c AS (SELECT *, {" + ".join(map(term, STRICT))} AS n_strict, {" + ".join(map(term, SOFT))} AS n_soft FROM b)
    SELECT page_id, host, path, {rule} AS rule,
           {verdict} WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft, n_soft::DOUBLE AS soft_weight FROM c"""


ORACLE["op5_url_vocabulary"] = _url_sql()


@_query
def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkseek.llm.warc import read_archives, write_archives

    files = write_archives(_table(spark, sf_dir, "pages"))
    return read_archives(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op6_warc_archive"] = """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first_id <> page_id THEN first_id END AS refers_to
    FROM p LEFT JOIN f USING (payload_digest)"""


@_query
def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkseek.llm.poisson_mix import replicate

    copies = replicate(_table(spark, sf_dir, "documents"))
    # the digests are taken behind the shuffle, so whole documents are what it deals out
    return copies.select("doc_id", "source", F.round("rate", 9).alias("rate"), F.col("n_copies").cast("long").alias("n_copies"), F.col("copy").cast("long").alias("copy"), "shuffle_key", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


ORACLE["op8_poisson_mix"] = """
    WITH n AS (SELECT source AS s, count(*) AS n FROM documents GROUP BY 1),
    r AS (SELECT s, 1.0::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE * 1.0::DOUBLE / (SELECT count(*) FROM n)::DOUBLE / n::DOUBLE AS rate FROM n),
    d AS (SELECT *, coalesce(doc_id::VARCHAR, 'null|' || md5(concat_ws('|', text, lang, source))) AS k FROM documents JOIN r ON source IS NOT DISTINCT FROM s),
    u AS (SELECT *, (('0x' || substr(md5('17|' || k || '|1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM d),
    g AS (SELECT u.doc_id AS doc_id, u.k AS k, any_value(u.u) AS u, i, exp(-any_value(rate)) AS p0, any_value(rate) AS rate
          FROM u, range(0, 200) t(i) GROUP BY u.doc_id, u.k, i),
    c AS (SELECT doc_id, k, u, sum(exp(i * ln(rate) - rate - lgamma(i + 1))) OVER (PARTITION BY doc_id ORDER BY i) AS cdf FROM g),
    n_c AS (SELECT doc_id, count(*) FILTER (WHERE cdf < u) AS n_copies FROM c GROUP BY 1)
    SELECT d.doc_id, source, round(rate, 9) AS rate, n_copies, copy, ('0x' || substr(md5('17|order|' || k || '|' || copy), 1, 15))::BIGINT AS shuffle_key, md5(coalesce(text, '')) AS text_md5
    FROM d JOIN n_c USING (doc_id), range(1, 200) t(copy) WHERE copy <= n_copies"""


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op10_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkseek.llm.sst import read_tables, write_tables

    return read_tables(write_tables(_table(spark, sf_dir, "documents"), byte_bpe_path()), with_ids=False).drop("ids")


#: CRC-32 of a list of bytes, bit by bit from a table of 256 entries.
_CRC_TABLE = "(SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, r: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)))"


def _crc_sql(data: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"


def _hex_bytes(digits: str, n: str) -> str:
    return f"list_transform(range(0, {n}), lambda i: ('0x' || substr({digits}, (2 * i + 1)::BIGINT, 2))::BIGINT)"


@_query
def webp_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL can follow: what is read back from the stored images."""
    return op2_lossless_webp(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


ORACLE["webp_payloads"] = f"""
    WITH c AS (SELECT {_CRC_TABLE} AS crc_table),
    h AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
    p AS (SELECT doc_id, n, greatest(576, (n + 575) // 576 * 576) AS m, x || repeat('FF', (greatest(576, (n + 575) // 576 * 576) - n)::BIGINT) AS x FROM h)
    SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(unhex(x)) AS payload_sha256,
           {_crc_sql(_hex_bytes("right(x, 64)", "32"))}::BIGINT AS tail_crc32
    FROM p, c"""


@_query
def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can follow: all but the score of the trees."""
    scored = op4_context_tree(spark, sf_dir)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


ORACLE["lm_base_scores"] = f"""
    WITH c AS (SELECT {_CRC_TABLE} AS crc_table),
    d AS (SELECT doc_id, coalesce({_crc_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)")} % 5 = 1, false) AS held_out,
                 list_append(list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda w: 'w' || w), 'end') AS ws FROM documents, c),
    t AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d),
    k AS (SELECT w, count(*) AS n FROM t WHERE NOT held_out GROUP BY w),
    s AS (SELECT sum(n)::BIGINT AS total, count(*) AS types FROM k)
    SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(n)::BIGINT AS n_known, any_value(total) AS train_tokens,
           round(sum(log10((coalesce(n, 0) + 0.5::DOUBLE) / (total + 0.5::DOUBLE * (types + 1)))), 6) AS base_score
    FROM t LEFT JOIN k USING (w), s GROUP BY doc_id, held_out"""


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkseek.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkseek.llm.ctw import score

    return score(_table(spark, sf_dir, "documents"))


@_query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkseek.llm.jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), 3, 90, 100)


ORACLE["op9_jaccard_join"] = """
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                              ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS grams FROM d),
    u AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM s),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS i FROM u a JOIN u b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p WHERE 100 * i >= 90 * (nx + ny - i)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c)
    SELECT doc_id, len(grams)::BIGINT AS n_shingles, c AS component_id FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) USING (doc_id)"""


#: The places where a string of 50 bytes starts that also starts in a document with a smaller id; runs of what they
#: cover; and what is left between the runs. Bytes are pairs of hexadecimal digits.
ORACLE["op1_suffix_dedup"] = """
    WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
    s AS (SELECT doc_id, p, substr(x, 2 * p - 1, 100) AS g FROM h, unnest(range(1, n - 48)) AS t(p) WHERE n >= 50),
    f AS (SELECT g, min(doc_id) AS first_id FROM s GROUP BY g HAVING count(*) > 1),
    r AS (SELECT doc_id, p FROM s JOIN f USING (g) WHERE first_id < doc_id),
    b AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM r),
    i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM b),
    runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 49 AS z FROM i GROUP BY 1, 2),
    parts AS (SELECT doc_id, a, z, substr(x, 2 * coalesce(lag(z) OVER w, 0) + 1, 2 * (a - 1 - coalesce(lag(z) OVER w, 0))) AS before FROM runs JOIN h USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
    k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed, max(z) AS last, string_agg(before, '' ORDER BY a) AS kept FROM parts GROUP BY 1)
    SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM h LEFT JOIN k USING (doc_id)"""


@_query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkseek.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@_query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkseek.llm.decontam import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
