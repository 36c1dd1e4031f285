"""Queries of the training-data operators: each applies one to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from risemeter.llm import conversation_sql
from risemeter.llm.decontaminate import benchmark_hits
from risemeter.llm.inner import top_inner_products
from risemeter.llm.language import languages
from risemeter.llm.licenses import scan_licenses
from risemeter.llm.overlap import overlap_components
from risemeter.llm.packing import packed
from risemeter.llm.personal import personal_spans
from risemeter.llm.quality import quality_scores
from risemeter.llm.repair import damaged_repairs
from risemeter.llm.secrets import secret_spans
from risemeter.llm.simhash import near_duplicates
from risemeter.llm.tables import read
from risemeter.llm.trie import conversation_trie
from risemeter.llm.urls import LISTED_WORDS, RULES, parts, url_verdicts


def op1_norm_sorted_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_inner_products(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_factorisation_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op3_weak_supervision_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal_spans(read(spark, folder, "documents")).drop("found")


def op4_bloom_cascade_urls(spark: SparkSession, folder: str) -> DataFrame:
    return url_verdicts(read(spark, folder, "pages"))


def op5_cgk_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_hits(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op6_power_of_two_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(read(spark, folder, "documents"), with_tokens=False)


def op7_shingle_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_components(read(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_license_inheritance(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    found = parts(pages.select(F.struct("page_id", "html").alias("page_id"), "url"))
    files = found.select(F.col("page_id.page_id").alias("id"), F.concat("host", "path").alias("path"), F.col("page_id.html").alias("text"))
    return scan_licenses(files).withColumnRenamed("id", "page_id")


def op9_viterbi_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages(read(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op10_multipart_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_spans(read(spark, folder, "documents")).drop("found")


def op11_zfast_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(read(spark, folder, "conversations"))


def op12_idastar_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return damaged_repairs(read(spark, folder, "conversations"))


def op13_covering_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_norm_sorted_topk,
        op2_factorisation_quality,
        op3_weak_supervision_pii,
        op4_bloom_cascade_urls,
        op5_cgk_decontamination,
        op6_power_of_two_packing,
        op7_shingle_jaccard,
        op8_license_inheritance,
        op9_viterbi_languages,
        op10_multipart_secrets,
        op11_zfast_prefix_trie,
        op12_idastar_conversation_repair,
        op13_covering_simhash,
    )
}

_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in RULES)
_WORDS = ", ".join(f"'{w}'" for w in LISTED_WORDS)

ORACLES: dict[str, str] = {
    "op11_zfast_prefix_trie": conversation_sql.TRIE,
    "op12_idastar_conversation_repair": conversation_sql.REPAIR,
    "op4_bloom_cascade_urls": f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), part AS (
            SELECT row_number() OVER () AS n, page_id,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), fit AS (
            SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
            FROM part JOIN (VALUES {_RULES}) AS r(verdict, host, path)
              ON (part.host = r.host OR ends_with(part.host, '.' || r.host)) AND starts_with(part.path, r.path)
            GROUP BY n
        )
        SELECT page_id, part.host, part.path, fit.rule,
               coalesce(fit.verdict, CASE WHEN len([w for w in regexp_split_to_array(part.host, '[^a-z0-9]+') if w IN ({_WORDS})]) > 0 THEN 'block' ELSE 'allow' END) AS verdict
        FROM part LEFT JOIN fit USING (n)
    """,
    "op1_norm_sorted_topk": """
        WITH cell AS (
            SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS place, unnest(embedding) AS x FROM embeddings WHERE vec_id IS NOT NULL
        ), valid AS (
            SELECT vec_id FROM cell GROUP BY vec_id HAVING count(x) = count(*) AND bool_and(coalesce(isfinite(x), false))
        ), v AS (
            SELECT vec_id, place, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM cell JOIN valid USING (vec_id)
        ), score AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.place = c.place AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM score QUALIFY rank <= 5
    """,
    "op7_shingle_jaccard": """
        WITH RECURSIVE words AS (
            SELECT doc_id, [w for w in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if w <> ''] AS w
            FROM documents
        ), word AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words
        ), five AS (
            SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g
            FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY place)
        ), gram AS (
            SELECT DISTINCT doc_id, g FROM five WHERE g IS NOT NULL
            UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4
        ), size AS (
            SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id
        ), pair AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM gram AS a JOIN gram AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
        ), link AS (
            SELECT a, b FROM pair JOIN size AS x ON x.doc_id = a JOIN size AS y ON y.doc_id = b WHERE 100 * pair.n >= 75 * (x.n + y.n - pair.n)
        ), reach AS (
            SELECT doc_id, doc_id AS seen FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.seen
        )
        SELECT d.doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(reach.seen) AS component_id
        FROM documents AS d LEFT JOIN size USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
    """,
}
