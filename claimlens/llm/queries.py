"""The opN_<name> queries over the test tables: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_count, brown_lm, html_text, licenses, line_crf, mtree, nbest, packing, quality_rules, simhash
from .common import table


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file lies; the library that knows is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.score(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.rate(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(table(spark, sf_dir, "documents"))


def op6_bpe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.nbest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{licenses.COPYRIGHT_LINE}', '\\1', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '{licenses.BETWEEN_WORDS}', ' ', 'g')) || ' '"
    for spelling, usual in licenses.SPELLINGS.items():
        out = f"replace({out}, ' {spelling} ', ' {usual} ')"
    return f"trim({out})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Where SQL can express a query over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_mtree": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 10
    """,
    "op7_licenses": f"""
        WITH known AS (
            SELECT min(license_id) AS license_id, sha256({_canonical_sql("text")}) AS digest
            FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.KNOWN)}) AS t(license_id, text)
            GROUP BY 2
            UNION ALL
            FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.DIGESTS.items())}) AS t(license_id, digest)
        ), named AS (
            SELECT {_canonical_sql("text")} AS form, license
            FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.NOTICES.items())}) AS t(text, license)
        ), d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
        ), lines AS (
            SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
        ), found AS (
            SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
            FROM (SELECT r, {_canonical_sql("line")} AS form FROM lines WHERE contains(lower(line), 'licen')) JOIN named USING (form)
            GROUP BY r
        )
        SELECT doc_id, digest, license_id, coalesce(notices, '') AS notices
        FROM (SELECT r, doc_id, sha256({_canonical_sql("text")}) AS digest FROM d)
        LEFT JOIN known USING (digest) LEFT JOIN found USING (r)
    """,
}
