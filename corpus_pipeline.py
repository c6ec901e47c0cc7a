"""Corpus preparation: quality, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; its result is written as Parquet and read again as the next one's
documents. All but the last return the columns of ``documents``.

Defined results: a null text counts as empty; rows without an id, and rows that
repeat an id, are documents of their own to the near-duplicate stage, and leaks
are known by their text, so such rows are neither spared nor lost; an empty table
passes through as empty; extra columns pass through the first four stages
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._shared import drop_tables, durable, join_groups, read, tables_made
from graphloom.llm.decontaminate import drop_leaks
from graphloom.llm.near_dedup import BROADCAST_IDS, near_duplicates
from graphloom.llm.packing import pack_documents
from graphloom.llm.pii import detect_pii, redact
from graphloom.llm.rule_quality import keep_quality

#: Probability of good quality from which a document stays.
QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is QUALITY at least."""
    return keep_quality(docs, read(spark, sf_dir, "labels"), cut=QUALITY)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    rows = _own_keys(docs)
    dropped = durable(near_duplicates(rows.select(F.col("__key").alias("doc_id"), "text")).where("NOT kept").select(F.col("doc_id").alias("__copy")))
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, F.col("__key") == F.col("__copy"), "left_anti").select(*docs.columns)


def _own_keys(docs: DataFrame) -> DataFrame:
    """Add ``__key``: the id, or a number above all ids for rows without one and for all but one of the rows that repeat one."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    repeated = durable(ids.where("__n > 1 OR __id IS NULL"))
    if repeated.isEmpty():
        return docs.withColumn("__key", F.col("doc_id").cast("long"))
    top = ids.agg(F.max("__id")).first()[0] or 0
    numbered = durable(docs.withColumn("__row", F.monotonically_increasing_id()))
    first = numbered.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    total = numbered.count()
    marked = join_groups(numbered.where("doc_id IS NOT NULL").withColumn("__id", F.col("doc_id").cast("long")), first, ["__id"], "__n", total)
    own = marked.withColumn("__key", F.when(F.col("__row") == F.col("__first"), F.col("__id")).otherwise(F.lit(top) + 1 + F.col("__row")))
    bare = numbered.where("doc_id IS NULL").withColumn("__key", F.lit(top) + 1 + F.col("__row"))
    return own.select(*docs.columns, "__key").unionByName(bare.select(*docs.columns, "__key"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the new text."""
    clean = redact(detect_pii(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's pieces in training sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has left in the shared folder goes once its result, or the next one's, is written."""
    docs, before = read(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        with tables_made() as made:
            docs = stage(spark, docs, sf_dir)
            if i == len(STAGES) - 1:
                return docs
            docs = durable(docs)
        drop_tables(spark, [*before, *made[:-1]])
        before = made[-1:]
    return docs


#: Tokens, fitted rules and latent spaces can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None
