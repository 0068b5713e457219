"""Candidate batches, execution artifacts, ledgers, seeds and assembled records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.states import first_nonblank
from ..functions.values import instant, is_json

CANDIDATE = "struct<candidate_id:string,candidate_type:string,origin:string,persistence_status:string,review_status:string,text:string>"
BATCH = f"schema_version string, run_id string, created_at string, mode string, phase string, subject struct<subject_id:string,workspace_root:string>, domain_pack struct<pack_id:string,selected_facet:string>, facet struct<name:string,phase:string,candidate_type_hint:string>, candidates array<{CANDIDATE}>"
CAPTURE = "run_id string, workspace_id string, adapter_id string, capture_id string, capture_method string, captured_at string, content_hash string, content_type string, byte_count bigint, handoff_sequences array<int>, status string, verification_status string"
EXTRACTION = "extraction_id string, capture_id string, input_hash string, content_hash string, extraction_method string, encoding_result string, truncation_status string, status string, byte_count_in bigint, byte_count_out bigint, handoff_sequence int, hostile_replay_flags array<string>, failure_reason string"
LEDGER = "event_id string, run_id string, workspace_id string, event_type string, occurred_at string, command string, status string"
LOCUS = "locus_id string, label string, locus_type string, parent_locus_id string, languages array<string>, review_state string, is_deprecated boolean, productivity_leads bigint, productivity_captures bigint, productivity_works bigint, productivity_queries bigint"

#: Which family a candidate type is ingested into.
FAMILY = {"source": "source_access", "work": "work", "entity": "extraction_detected_entity", "claim": "source_claim", "relationship": "source_relationship"}


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per candidate of the batches at ``path``, with its family and payload if its text is a JSON object."""
    batch = spark.read.schema(BATCH).option("multiLine", "true").json(path)
    rows = batch.select("run_id", "created_at", F.col("subject.subject_id").alias("subject_id"), F.col("facet.name").alias("facet"), F.posexplode("candidates").alias("sequence", "candidate")).select("run_id", "created_at", "subject_id", "facet", "sequence", "candidate.*")
    family = F.create_map(*[F.lit(x) for p in FAMILY.items() for x in p])[F.col("candidate_type")]
    parsed = F.try_parse_json("text")
    is_object = is_json(F.col("text")) & F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return rows.withColumn("family", F.coalesce(family, F.lit("unrouted"))).withColumn("payload_json", F.when(is_object, F.col("text")))


def execution(spark: SparkSession, captures: str, extractions: str) -> DataFrame:
    """Extractions with their captures; a capture without an extraction stays."""
    c = spark.read.schema(CAPTURE).json(captures)
    e = spark.read.schema(EXTRACTION).json(extractions).withColumnRenamed("content_hash", "output_hash").withColumnRenamed("status", "extraction_status")
    return c.join(e, "capture_id", "left")


def ledger(spark: SparkSession, path: str, workspace: str | None = None) -> DataFrame:
    """Events of a runtime or migration log with their instant; lines without a valid one have a null ``ts``."""
    rows = spark.read.schema(LEDGER).json(path).withColumn("ts", instant(F.col("occurred_at")))
    return rows.filter(F.col("workspace_id") == workspace) if workspace else rows


def loci(spark: SparkSession, path: str) -> DataFrame:
    """Source loci with the defaults filled in."""
    rows = spark.read.schema(LOCUS).json(path)
    zero = {c: F.coalesce(c, F.lit(0)) for c in rows.columns if c.startswith("productivity_")}
    return rows.withColumns({**zero, "review_state": first_nonblank(F.col("review_state"), F.lit("needs_review")), "is_deprecated": F.coalesce("is_deprecated", F.lit(False)), "languages": F.coalesce("languages", F.array().cast("array<string>"))})


def capture_rows(handoffs: DataFrame, payloads: DataFrame, run_id: str) -> DataFrame:
    """Capture and extraction columns of planned handoffs (path, sequence) from classified payloads; a path without one failed."""
    joined = handoffs.join(payloads, "path", "left")
    return joined.select(
        F.concat_ws(":", F.lit("capture"), F.lit(run_id), F.col("sequence").cast("string")).alias("capture_id"), "path", "sequence", F.col("sha256").alias("content_hash"), "byte_count",
        F.when(F.col("status").isNull(), "missing").when(F.col("status") == "text", "captured").otherwise("captured_unreadable").alias("capture_status"),
        F.when(F.col("status") == "text", "completed").when(F.col("status") == "oversized", "truncated").when(F.col("status").isNotNull(), "failed").alias("extraction_status"),
    )
