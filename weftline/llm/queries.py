"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import brown, chat, language, mixing, quality, simhash, surrogates, topk, urls, wumanber
from weftline.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_of_ids(table(spark, sf_dir, "documents"))


URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def op3_url_host_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_brown_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.brown_scores(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), max_bits=2, words=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), ["doc_id"], folds=4, held=2)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


def op8_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wumanber.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"], size=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_source_mixing": op2_source_mixing,
    "op3_url_host_segmentation": op3_url_host_segmentation,
    "op4_brown_lm_scoring": op4_brown_lm_scoring,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_hierarchical_language_id": op6_hierarchical_language_id,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_wu_manber_decontamination": op8_wu_manber_decontamination,
    "op9_chat_snapshot_collapse": op9_chat_snapshot_collapse,
    "op10_pii_surrogates": op10_pii_surrogates,
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(coalesce(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]), 0) AS BIGINT) AS score
            FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_chat_snapshot_collapse": chat.COLLAPSE_SQL,
    "op2_source_mixing": mixing.mixture_sql(),
    "op8_wu_manber_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), i AS (
            SELECT item_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), p AS (
            SELECT DISTINCT item_id, array_to_string(w[k : k + 9], ' ') AS win, least(len(w), 10) AS n
            FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0
        ), sizes AS (
            SELECT DISTINCT n FROM p
        ), dw AS (
            SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win
            FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n
        ), occ AS (
            SELECT DISTINCT doc_id, k, dw.n, item_id FROM dw JOIN p USING (win, n)
        ), hit AS (
            SELECT doc_id, count(DISTINCT pos) AS n_hit FROM occ, unnest(range(k, k + n)) AS t(pos) GROUP BY doc_id
        ), own AS (
            SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
    """.replace("lower_az(coalesce(text, ''))", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"),
}
