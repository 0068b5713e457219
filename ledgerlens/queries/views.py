"""The store's families derived from the driver's tables, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def works(spark: SparkSession, sf_dir: str, *, text: bool = False) -> DataFrame:
    """Documents as works, their labels as review states and blockers."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    state = F.when(F.col("quality") == 1, "reviewed").when(F.col("quality") == 0, "needs_review").otherwise("proposed")
    columns = [
        F.col("doc_id").alias("work_id"),
        F.substring("text", 1, 80).alias("title"),
        F.col("source").alias("work_type"),
        F.col("lang").alias("workspace_id"),
        F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("confidence_score"),
        state.alias("review_state"),
        F.when(F.col("toxic") == 1, "blocked").alias("public_blocker"),
        F.when(F.col("quality") == 1, "published").otherwise("draft").alias("publication_state"),
    ]
    return joined.select(*columns, *([F.col("text").alias("body")] if text else []))


WORKS = """works AS (
  SELECT doc_id AS work_id, substr(text, 1, 80) AS title, source AS work_type, lang AS workspace_id, least(n_chars / 4000.0, 1.0) AS confidence_score,
    CASE WHEN quality = 1 THEN 'reviewed' WHEN quality = 0 THEN 'needs_review' ELSE 'proposed' END AS review_state,
    CASE WHEN toxic = 1 THEN 'blocked' END AS public_blocker,
    CASE WHEN quality = 1 THEN 'published' ELSE 'draft' END AS publication_state, text AS body
  FROM documents LEFT JOIN labels USING (doc_id)
)"""

FAMILIES = ["work", "source_claim", "source_relationship", "extraction_detected_entity"]


def family_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rows of four families with a review state; the order is the cycle's event."""
    names = F.array(*map(F.lit, FAMILIES))
    state = F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "N", "needs_review").otherwise("rejected")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_key"), names[F.col("l_linenumber") % 4].alias("family"), state.alias("review_state"), F.col("l_linenumber").alias("line"))


FAMILY_ROWS = """family_rows AS (
  SELECT l_orderkey AS event_key, (['work', 'source_claim', 'source_relationship', 'extraction_detected_entity'])[l_linenumber % 4 + 1] AS family,
    CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'needs_review' ELSE 'rejected' END AS review_state, l_linenumber AS line
  FROM lineitem
)"""


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_key"), F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("ts"))


def micros(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp"))
