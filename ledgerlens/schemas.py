"""Schemas of the canonical tables and of the cycle ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENVELOPE = "review_state string, publication_state string, authority_level string, public_blocker string, workspace_id string, confidence_score double, provenance_event_ref string, created_at string, record_last_updated string"

_COLUMNS = {
    "provenance_event": "provenance_event_id bigint, provenance_event_key_v1 string, object_namespace string, object_id string, event_type string, actor string, tool string, run_id string, source_object_namespace string, source_object_id string, event_timestamp string, note_text string",
    "authority_record": f"authority_record_id bigint, authority_key_v1 string, authority_type string, preferred_label string, label_norm string, sort_label string, reconciliation_status string, merged_into_authority_record_id bigint, {_ENVELOPE}",
    "work": f"work_id bigint, work_key_v1 string, work_type string, title string, rights_posture string, raw_cite_text string, accepted_for_citation boolean, first_seen_at string, last_seen_at string, {_ENVELOPE}",
    "capture_event": f"capture_event_id bigint, original_locator string, captured_at string, capture_method string, content_hash string, byte_count bigint, mime_type string, source_locus_ref string, {_ENVELOPE}",
    "extraction_record": f"extraction_id bigint, capture_event_id bigint, extractor string, input_hash string, output_hash string, byte_count bigint, extraction_status string, {_ENVELOPE}",
    "extraction_detected_entity": f"detected_entity_id bigint, extraction_id bigint, capture_event_id bigint, entity_label string, normalized_label string, entity_type string, source_span_start int, source_span_end int, authority_record_id bigint, {_ENVELOPE}",
    "work_subject": f"work_subject_id bigint, work_id bigint, authority_record_id bigint, subject_object_ref string, subject_role string, {_ENVELOPE}",
    "source_relationship": f"source_relationship_id bigint, from_object_ref string, to_object_ref string, predicate string, target_label string, evidence_note string, {_ENVELOPE}",
    "source_claim": f"source_claim_id bigint, source_claim_key_v1 string, about_object_ref string, claim_text string, public_summary string, claim_type string, capture_event_id bigint, extraction_id bigint, is_open_question boolean, {_ENVELOPE}",
    "review_state_history": "history_id string, target_namespace string, target_id string, previous_state string, new_state string, changed_by string, changed_at string, reason string",
    "authority_reconciliation": f"authority_reconciliation_id bigint, reconciliation_key_v1 string, detected_entity_id bigint, raw_label string, candidate_authority_record_id bigint, target_namespace string, target_id string, method string, match_score double, rejected_candidate_ids_json string, accepted_authority_id bigint, {_ENVELOPE}",
    "topic_extension": f"topic_extension_id bigint, topic_id string, extension_type string, summary_short string, {_ENVELOPE}",
    "authority_identifier": "authority_identifier_id bigint, authority_record_id bigint, scheme string, value string, normalized_value string, normalized_uri string, validity_status string, is_primary boolean",
    "work_identifier": "work_identifier_id bigint, work_id bigint, scheme string, value string, normalized_value string, normalized_uri string, validity_status string, is_primary boolean",
    "source_access": f"source_access_id bigint, work_id bigint, source_locus_id bigint, source_lead_id string, original_locator string, canonical_url string, citation_hint string, access_class string, first_seen_at string, last_seen_at string, {_ENVELOPE}",
    "work_metadata": "work_metadata_id bigint, work_id bigint, meta_key string, meta_value string, meta_type string",
    "work_url": "work_url_id bigint, work_id bigint, url string, url_role string",
    "authority_merge_event": "authority_merge_event_id bigint, from_authority_record_id bigint, into_authority_record_id bigint, merge_reason string",
    "schema_version": "namespace string, version int",
    "schema_migration_history": "migration_id string, applied_at string, ddl_hash string",
    "cycle_event": "cycle_event_id string, workspace_id string, subject_id string, run_id string, cycle_depth int, status string, previous_run_ids_json string, occurred_at string, created_at string",
    "cycle_stage": "cycle_stage_id string, cycle_event_id string, stage_name string, status string, started_at string, completed_at string, is_retryable boolean, detail_json string",
    "cycle_artifact": "cycle_artifact_id string, cycle_event_id string, artifact_role string, artifact_path string, content_hash string",
    "cycle_candidate": "cycle_candidate_id string, cycle_event_id string, candidate_id string, candidate_type string, score double, selected boolean",
    "cycle_decision": "cycle_decision_id string, cycle_event_id string, decision_type string, reason_codes_json string, decided_at string",
    "cycle_failure": "cycle_failure_id string, cycle_event_id string, failure_code string, is_retryable boolean, message string",
    "cycle_operator_override": "cycle_operator_override_id string, cycle_event_id string, override_type string, actor string, reason string, created_at string",
}

_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


TABLES: dict[str, T.StructType] = {name: _schema(columns) for name, columns in _COLUMNS.items()}

#: Natural identity of each table: rows with equal values are one record.
IDENTITY = {
    "provenance_event": ["provenance_event_key_v1"],
    "authority_record": ["authority_key_v1"],
    "work": ["work_key_v1"],
    "capture_event": ["original_locator", "captured_at", "content_hash", "workspace_id"],
    "extraction_record": ["capture_event_id", "extractor", "input_hash", "output_hash"],
    "extraction_detected_entity": ["extraction_id", "capture_event_id", "normalized_label", "entity_type", "source_span_start", "source_span_end"],
    "source_relationship": ["from_object_ref", "to_object_ref", "predicate", "target_label", "evidence_note", "workspace_id"],
    "source_claim": ["source_claim_key_v1"],
    "authority_reconciliation": ["reconciliation_key_v1"],
    "authority_identifier": ["scheme", "value"],
    "work_identifier": ["scheme", "value"],
    "work_metadata": ["work_id", "meta_key", "meta_value"],
    "work_url": ["work_id", "url"],
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the table's columns: absent ones are null."""
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in TABLES[table].fields))


def opt_col(df: DataFrame, name: str, kind: str = "string"):
    """A column, or null where the frame has none."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
