"""The registered queries of this package, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, decontamination, exact_dedup, html_render, pii_surrogates, secret_scan, simhash, token_counts, token_files, toxicity
from .runtime import table

#: Folder of the public vocabulary files; the package that ships them tells it.
def vocab(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Stands in for the secret that a production run passes.
SURROGATE_KEY = b"cinderspark surrogate key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocab("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digest_documents(table(spark, sf_dir, "documents"), vocab("byte_bpe_50k.json"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_check(table(spark, sf_dir, "documents"), vocab("word_bpe_49k.json"))


def op7_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.render_pages(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii_surrogates, op2_token_counts, op3_toxicity, op4_bpe_codec, op5_secret_scan, op6_token_files, op7_html_render, op8_simhash, op9_decontamination, op10_exact_dedup)
}

_SECRETS = {"assign": secret_scan.ASSIGN, "access": secret_scan.ACCESS, "hex": secret_scan.HEX, "candidate": "[A-Za-z0-9+/_=-]{20,}"}


def _matches_sql(kind: str, rank: int, group: int = 0) -> str:
    """Matches of a kind with their places: what lies between the matches gives them."""
    p = _SECRETS[kind].replace("'", "''")
    return f"""
        SELECT doc_id, {rank} AS kind_rank, ms[k] AS m, gs[k] AS g, between_ + before_ AS s, between_ + before_ + length(ms[k]) AS e
        FROM (
            SELECT *, list_sum(list_transform(bs[1:k], lambda x: length(x))) AS between_,
                   coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS before_
            FROM (
                SELECT *, unnest(range(1, len(ms) + 1)) AS k
                FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS gs,
                             regexp_split_to_array(t, '{p}') AS bs FROM texts)
            )
        )"""


_LIMIT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN {bits}" for p, bits in secret_scan.ENTROPY_LIMITS[:-1]) + (
    f" ELSE {secret_scan.ENTROPY_LIMITS[-1][1]} END"
)
_SECRET_SQL = f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    assign AS ({_matches_sql("assign", 0, 1)}),
    access AS ({_matches_sql("access", 1)}),
    hexes AS ({_matches_sql("hex", 2)}),
    candidate AS (
        SELECT * FROM ({_matches_sql("candidate", 3)})
        WHERE regexp_matches(m, '[0-9]') AND NOT regexp_matches(m, '{secret_scan.ALLOWED}')
    ),
    windows AS (
        SELECT doc_id, s, m, unnest(range(0, length(m) - {secret_scan.WINDOW} + 1)) AS o, {_LIMIT_SQL} AS bits FROM candidate
    ),
    entropy AS (
        SELECT doc_id, 3 AS kind_rank, windows.s + min(o) AS s, windows.s + max(o) + {secret_scan.WINDOW} AS e
        FROM windows WHERE list_entropy(string_split(substr(m, o + 1, {secret_scan.WINDOW}), '')) > bits
        GROUP BY doc_id, windows.s
    ),
    spans AS (
        SELECT doc_id, kind_rank, s, e FROM assign WHERE length(g) >= {secret_scan.ASSIGN_VALUE}
        UNION ALL SELECT doc_id, kind_rank, s, e FROM access
        UNION ALL SELECT doc_id, kind_rank, s, e FROM hexes
        UNION ALL SELECT * FROM entropy
    ),
    named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind_rank + 1] || ':' || s || ':' || e AS w FROM spans)
    SELECT d.doc_id,
           count(w) FILTER (kind_rank = 0) AS n_assign, count(w) FILTER (kind_rank = 1) AS n_access,
           count(w) FILTER (kind_rank = 2) AS n_hex, count(w) FILTER (kind_rank = 3) AS n_entropy,
           sha256(coalesce(string_agg(w, ',' ORDER BY s, kind_rank) FILTER (kind_rank < 3), '')) AS base_sha256,
           coalesce(string_agg(w, ',' ORDER BY s, kind_rank), '') AS spans
    FROM documents d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op5_secret_scan": _SECRET_SQL,
    "op10_exact_dedup": """
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body
            FROM documents
        ), g AS (
            SELECT body, count(*) AS group_size,
                   arg_max(doc_id, CAST(n AS HUGEINT) * 18446744073709551616 - doc_id) AS keep_id
            FROM d GROUP BY body
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.body) AS text_sha256
        FROM d JOIN g USING (body)""",
}
