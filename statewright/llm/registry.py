"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from statewright.llm import bpe, exact_dedup, licenses, minhash, mixing, pii, quality, substring_dedup, token_files, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query(
    r"""WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)"""
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


@_query(
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
        q AS (SELECT doc_id, len(l) AS n, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM w),
        s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, i, n, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o) AS x FROM q WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE i <= greatest(1, n - 3)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
        SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""
)
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_documents(spark, sf_dir), size=4, threshold=80)


@_query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM w),
        v AS (SELECT doc_id, i, string_agg(x, ' ') OVER o AS run, count(*) OVER o AS n FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
        s AS (SELECT doc_id, i, count(*) OVER (PARTITION BY run) > 1 AS again FROM v WHERE n = 35),
        c AS (SELECT doc_id, p.i, x, max(coalesce(again, false)::INTEGER) OVER (PARTITION BY doc_id ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM p LEFT JOIN s USING (doc_id, i)),
        k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
        SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""
)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_documents(spark, sf_dir), window=35, with_text=False)


@_query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.scores(docs, toxicity.train(docs, labels), threshold=0.3)


_SPACED = r"[^\x20\x09-\x0D]+"
_PHRASES = "|".join(p.decode() for p in quality.BOILERPLATE)
_ENDS = ", ".join("'" + c.replace("'", "''") + "'" for c in (*""".!?;:)"'""", *quality._LONG_ENDS))
_PARTING = ", ".join(f"'{c}'" for c in ("|", ">", "/", "-", "=", "~", "_", *quality._LONG_SEPARATORS))


@_query(
    rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '{_SPACED}') AS l FROM d),
        q AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM w),
        z AS (SELECT doc_id, i, CASE WHEN lead(x, 2) OVER o IS NOT NULL THEN concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o) END AS run FROM q WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        a AS (SELECT doc_id, i, run IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, run) > 1 AS again FROM z),
        c AS (SELECT doc_id, max(again::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM a),
        r AS (SELECT doc_id, sum(hit)::BIGINT AS n_repeat_words FROM c GROUP BY 1),
        m AS (SELECT doc_id, k, line, regexp_extract_all(line, '{_SPACED}') AS l FROM (SELECT doc_id, unnest(range(1, len(s) + 1)) AS k, unnest(s) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS s FROM d))),
        f AS (SELECT doc_id, len(l) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS dup,
            len(list_filter(l, lambda x: right(x, 1) IN ({_ENDS}))) = 0 OR len(list_filter(l, lambda x: x IN ({_PARTING}))) > 0.2::DOUBLE * len(l) OR len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > 0.3::DOUBLE * len(l)
            OR (len(l) >= 4 AND len(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) > 0.7::DOUBLE * len(regexp_replace(line, '[^\p{{Lu}}\p{{Ll}}]', '', 'g'))) OR (len(l) >= 4 AND len(list_distinct(l)) < 0.2::DOUBLE * len(l))
            OR (len(l) <= {quality.PHRASE_WORDS} AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PHRASES}')) AS bad FROM m WHERE len(l) > 0),
        g AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (bad OR dup) AS n_failed_lines, coalesce(sum(n) FILTER (NOT (bad OR dup)), 0)::BIGINT AS n_kept_words FROM f GROUP BY 1),
        b AS (SELECT doc_id, len(l) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
            coalesce(n_kept_words, 0) AS n_kept_words, coalesce(n_failed_lines, 0) AS n_failed_lines FROM w LEFT JOIN g USING (doc_id) LEFT JOIN r USING (doc_id)),
        y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b) SELECT *, NOT base_failed AND n_kept_words >= 0.5::DOUBLE * n_words AS kept FROM y"""
)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cleaned(_documents(spark, sf_dir), with_text=False)


@_query()
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@_query()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_and_read(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@_query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.findings(_documents(spark, sf_dir)).drop("row", "found")


@_query(mixing.SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicated(_documents(spark, sf_dir))


@_query()
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))
