"""The thin queries over the standard tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import read

#: The rules (host, path, verdict) that op3 applies.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE_KINDS, detect_pii, span_list

    found = detect_pii(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    def count(kind: str):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *(count(k) for k in BASE_KINDS),
        F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"), span_list(F.col("pii")).alias("spans"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, q, v) AS (VALUES ('com','/','allow'), ('example.com','/en/','block'), ('www.example.com','/en/','allow'), ('net','/es/','block'), ('net','/fr/','block')),
m AS (
  SELECT p.*, (SELECT max_by({'rule': h || q, 'v': v}, length(h || q)) FROM r
               WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q)) AS b
  FROM p)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict FROM m
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rule_quality import score_quality

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import exact_topk

    return exact_topk(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP10_SQL = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES = {
    "op1_pii": op1_pii,
    "op2_near_dedup": op2_near_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_html_extraction": op7_html_extraction,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_topk_search": op10_topk_search,
}
ORACLE_SQL = {"op3_url_filter": OP3_SQL, "op10_topk_search": OP10_SQL}
