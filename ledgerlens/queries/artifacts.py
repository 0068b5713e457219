"""Contracts of JSON artifacts over the driver's tables: each row's document has one defect, or none."""

from __future__ import annotations

import copy
import json

from pyspark.sql import functions as F

from ..plans import artifacts, contracts
from .views import read

#: A change: (path of keys and places, new value), or ``GONE`` to take the key away; then what it breaks: (path, code).
GONE = object()


def changed(base: dict, changes: list[tuple[tuple, object]]) -> dict:
    out = copy.deepcopy(base)
    for path, value in changes:
        at, value = out, value if value is GONE else copy.deepcopy(value)
        for step in path[:-1]:
            at = at[step]
        if value is GONE:
            del at[path[-1]]
        elif isinstance(at, list) and path[-1] == len(at):
            at.append(value)
        else:
            at[path[-1]] = value
    return out


def documents_of(base: dict, defects: list) -> list[str]:
    return [json.dumps(base), *(d[0] if isinstance(d[0], str) else json.dumps(changed(base, d[0])) for d in defects)]


def expected(defects: list) -> str:
    """VALUES of (defect, path, code)."""
    rows = [(i, path, code) for i, (_, found) in enumerate(defects, 1) for path, code in found]
    return ", ".join(f"({i}, '{path}', '{code}')" for i, path, code in rows)


def _planted(table, key: str, label, base: dict, defects: list):
    """(key, document) of a table's rows, defects in turn, with the row's key and label inside.

    Rows are dealt by key before they become documents of many times their size: a small file is read by one task.
    """
    texts = F.array(*(F.lit(t) for t in documents_of(base, defects)))
    which = F.element_at(texts, (F.col(key) % (len(defects) + 1) + 1).cast("int"))
    return table.select(key, label.alias("label")).repartition(key).select(F.col(key).alias("key"), F.replace(F.replace(which, F.lit("@key"), F.col(key).cast("string")), F.lit("@label"), F.col("label")).alias("document"))


def _oracle(table: str, key: str, defects: list) -> str:
    return f"SELECT {key} AS key, path, code FROM {table} JOIN (VALUES {expected(defects)}) AS x (defect, path, code) ON {key} % {len(defects) + 1} = defect"


# --- source adapters --------------------------------------------------------------------------------------------------

ADAPTER = {
    "schema_version": "source-adapter.v1", "adapter_id": "a@key", "display_name": "@label", "workspace_id": "w", "input_family": "local_directory",
    "locator": {"local_path": "data/@key", "include_globs": ["*.csv"], "format_hint": "csv"}, "content_profile": {"content_kinds": ["table"], "hazard_flags": []},
    "provenance": {"discovery_provenance": "listed", "acquisition_method": "copied", "source_description": "parts"},
    "rights_and_storage": {"payload_storage_policy_class": "private_only", "metadata_storage_policy_class": "private_only", "rights_posture": "private_local_only"},
    "automation_posture": "unattended_safe",
    "normalized_handoff": {"record_family": "part", "batch_unit": "row", "preserve_fields": ["original_locator"], "source_specific_fields": ["relative_path"]},
    "transform_lineage": [
        {"step_id": "read", "step_kind": "parse", "description": "reads", "deterministic": True, "review_required": False},
        {"step_id": "emit", "step_kind": "emit_handoff", "description": "emits", "deterministic": True, "review_required": False},
    ],
}
_R, _T, _H = ("rights_and_storage",), ("transform_lineage",), ("normalized_handoff",)
_REMOTE = [(("input_family",), "remote_url_manifest"), (("locator",), {"manifest_url": "https://example.org/list"})]
ADAPTER_DEFECTS = [
    ('{"a": 1, "a": 2}', [("$", "DUPLICATE_JSON_KEY")]),
    ('{"a": NaN}', [("$", "NON_STANDARD_JSON_CONSTANT")]),
    ('{"a": }', [("$", "JSON_PARSE_ERROR")]),
    ("[]", [("$", "OBJECT_REQUIRED")]),
    ([(("extra",), 1)], [("$.extra", "UNKNOWN_FIELD")]),
    ([(("display_name",), GONE)], [("$.display_name", "MISSING_REQUIRED_KEY")]),
    ([(("schema_version",), "v0")], [("$.schema_version", "INVALID_SCHEMA_VERSION")]),
    ([(("adapter_id",), "A b")], [("$.adapter_id", "INVALID_ADAPTER_ID")]),
    ([(("workspace_id",), 7)], [("$.workspace_id", "INVALID_WORKSPACE_ID")]),
    ([(("display_name",), "  ")], [("$.display_name", "INVALID_STRING")]),
    ([(("description",), " ")], [("$.description", "INVALID_STRING")]),
    ([(("description",), None)], []),
    ([(("input_family",), "tape")], [("$.input_family", "INVALID_INPUT_FAMILY")]),
    ([(("automation_posture",), "fast")], [("$.automation_posture", "INVALID_AUTOMATION_POSTURE")]),
    ([(("locator",), [])], [("$.locator", "LOCATOR_NOT_OBJECT")]),
    ([(("locator", "ref"), "main")], [("$.locator.ref", "LOCATOR_FIELD_NOT_ALLOWED")]),
    ([(("locator", "local_path"), " ")], [("$.locator", "MISSING_LOCATOR_KEY")]),
    ([(("locator", "include_globs"), "x")], [("$.locator.include_globs", "FIELD_NOT_ARRAY")]),
    ([(("locator", "exclude_globs"), ["a", " "])], [("$.locator.exclude_globs[1]", "INVALID_ARRAY_ITEM")]),
    ([(("locator", "format_hint"), "xls")], [("$.locator.format_hint", "INVALID_FORMAT_HINT")]),
    ([(("locator", "record_path"), "")], [("$.locator.record_path", "INVALID_STRING")]),
    (_REMOTE, []),
    ([*_REMOTE, (("locator", "manifest_url"), "ftp://example.org/x")], [("$.locator", "INVALID_REMOTE_URL")]),
    ([*_REMOTE, (("locator", "manifest_url"), "https://user:pass@example.org")], [("$.locator", "INVALID_REMOTE_URL")]),
    ([*_REMOTE, (("locator", "base_url"), "https://example.org")], [("$.locator.base_url", "LOCATOR_FIELD_NOT_ALLOWED")]),
    ([(("content_profile",), 1)], [("$.content_profile", "CONTENT_PROFILE_NOT_OBJECT")]),
    ([(("content_profile", "x"), 1)], [("$.content_profile.x", "UNKNOWN_CONTENT_PROFILE_FIELD")]),
    ([(("content_profile", "hazard_flags"), GONE)], [("$.content_profile.hazard_flags", "MISSING_CONTENT_PROFILE_KEY")]),
    ([(("content_profile", "content_kinds"), [])], [("$.content_profile.content_kinds", "EMPTY_ARRAY")]),
    ([(("provenance",), "x")], [("$.provenance", "PROVENANCE_NOT_OBJECT")]),
    ([(("provenance", "x"), 1)], [("$.provenance.x", "UNKNOWN_PROVENANCE_FIELD")]),
    ([(("provenance", "acquisition_method"), GONE)], [("$.provenance.acquisition_method", "MISSING_PROVENANCE_KEY")]),
    ([(("provenance", "upstream_reference"), 3)], [("$.provenance.upstream_reference", "INVALID_STRING")]),
    ([(_R, None)], [("$.rights_and_storage", "RIGHTS_NOT_OBJECT")]),
    ([((*_R, "x"), 1)], [("$.rights_and_storage.x", "UNKNOWN_RIGHTS_FIELD")]),
    ([((*_R, "rights_posture"), GONE)], [("$.rights_and_storage.rights_posture", "MISSING_RIGHTS_KEY")]),
    ([((*_R, "payload_storage_policy_class"), "shelf")], [("$.rights_and_storage.payload_storage_policy_class", "INVALID_PAYLOAD_STORAGE_POLICY_CLASS"), ("$.rights_and_storage", "INVALID_RIGHTS_RETENTION_COMBINATION")]),
    ([((*_R, "metadata_storage_policy_class"), 1)], [("$.rights_and_storage.metadata_storage_policy_class", "INVALID_METADATA_STORAGE_POLICY_CLASS")]),
    ([((*_R, "metadata_storage_policy_class"), "external_later")], [("$.rights_and_storage", "INVALID_METADATA_RETENTION_COMBINATION")]),
    ([((*_R, "rights_posture"), "free")], [("$.rights_and_storage.rights_posture", "INVALID_RIGHTS_POSTURE")]),
    ([((*_R, "contains_personal_data"), "no")], [("$.rights_and_storage.contains_personal_data", "INVALID_CONTAINS_PERSONAL_DATA")]),
    ([((*_R, "rights_posture"), "unknown_review_required")], [("$.rights_and_storage.rights_posture", "RIGHTS_POSTURE_REQUIRES_REVIEW")]),
    ([((*_T, 0, "review_required"), True)], [("$.transform_lineage", "REVIEW_REQUIRED_STEP_NOT_ALLOWED")]),
    ([((*_T, 0, "review_required"), True), (("automation_posture",), "operator_review_required")], []),
    ([(_H, [])], [("$.normalized_handoff", "HANDOFF_NOT_OBJECT")]),
    ([((*_H, "x"), 1)], [("$.normalized_handoff.x", "UNKNOWN_HANDOFF_FIELD")]),
    ([((*_H, "batch_unit"), GONE)], [("$.normalized_handoff.batch_unit", "MISSING_HANDOFF_KEY")]),
    ([((*_H, "preserve_fields", 1), "colour")], [("$.normalized_handoff.preserve_fields", "INVALID_PRESERVE_FIELD")]),
    ([(_T, {})], [("$.transform_lineage", "TRANSFORM_LINEAGE_NOT_ARRAY")]),
    ([(_T, [])], [("$.transform_lineage", "TRANSFORM_LINEAGE_EMPTY")]),
    ([((*_T, 0), 1)], [("$.transform_lineage[0]", "TRANSFORM_STEP_NOT_OBJECT")]),
    ([((*_T, 0, "x"), 1)], [("$.transform_lineage[0].x", "UNKNOWN_TRANSFORM_STEP_FIELD")]),
    ([((*_T, 0, "description"), GONE)], [("$.transform_lineage[0].description", "MISSING_TRANSFORM_STEP_KEY")]),
    ([((*_T, 0, "step_id"), "Read it")], [("$.transform_lineage[0].step_id", "INVALID_STEP_ID")]),
    ([((*_T, 0, "deterministic"), 1)], [("$.transform_lineage[0].deterministic", "INVALID_DETERMINISTIC")]),
    ([((*_T, 1, "review_required"), "x")], [("$.transform_lineage[1].review_required", "INVALID_REVIEW_REQUIRED")]),
    ([((*_T, 1, "step_id"), "read")], [("$.transform_lineage[1]", "DUPLICATE_STEP_ID")]),
    ([((*_T, 1), GONE)], [("$.transform_lineage", "MISSING_HANDOFF_STEP")]),
    ([((*_T, 0, "step_kind"), "emit_handoff"), ((*_T, 1, "step_kind"), "parse")], [("$.transform_lineage", "EMIT_HANDOFF_NOT_TERMINAL")]),
]


def adapter_findings(spark, d):
    """A source adapter for each part."""
    docs = _planted(read(spark, d, "part"), "p_partkey", F.col("p_name"), ADAPTER, ADAPTER_DEFECTS)
    return contracts.findings(docs, artifacts.source_adapter())


# --- search projections -----------------------------------------------------------------------------------------------

PROJECTION = {
    "schema_version": "local-search-projection.v1", "generated_at": "2024-05-01T10:00:00Z", "profile": "public_preview", "warnings": [], "errors": [],
    "source": {"database_name": "@label", "schema_version": 3, "correction_ledger_applied": True},
    "policy": {"raw_payload_indexed": False, "full_text_indexed": False, "private_paths_exposed": False, "superseded_records_included": False, "blocked_records_included": False},
    "counts": {"candidate_records": 3, "projected_records": 1, "excluded_records": 1, "indexed_rows": 1},
    "excluded_records": [{"object_ref": "work:9", "reason": "blocked"}],
    "records": [{
        "projection_id": "p@key", "object_ref": "work:@key", "object_type": "work", "object_pk": 1, "title": "@label", "subtitle": None, "review_state": "accepted", "publication_state": "public_preview", "authority_level": None,
        "public_blocker": None, "lineage_state": "current", "visible_profiles": ["public_preview"], "suppressed_fields": [], "indexed_fields": [{"field": "title", "text": "@label", "display_policy": "public"}],
    }],
}
_REC, _FLD, _LOCAL = ("records", 0), ("records", 0, "indexed_fields", 0), (("profile",), "local")
_AT, _IN = "$.records[0]", "$.records[0].indexed_fields[0]"
_NONE = [("$.counts.projected_records", "COUNT_MISMATCH"), ("$.counts.indexed_rows", "COUNT_MISMATCH")]
PROJECTION_DEFECTS = [
    ("{'a': 1}", [("$", "JSON_PARSE_ERROR")]),
    ([(("extra",), 1)], [("$.extra", "UNKNOWN_FIELD")]),
    ([(("_projection_records_digest",), "x")], []),
    ([(("warnings",), GONE)], [("$.warnings", "MISSING_REQUIRED_KEY")]),
    ([(("schema_version",), 1)], [("$.schema_version", "INVALID_SCHEMA_VERSION")]),
    ([(("generated_at",), "2024-05-01T10:00:00")], [("$.generated_at", "INVALID_GENERATED_AT")]),
    ([(("generated_at",), "2024-02-30T10:00:00Z")], [("$.generated_at", "INVALID_GENERATED_AT")]),
    ([(("profile",), "everyone")], [("$.profile", "INVALID_PROFILE")]),
    ([(("source",), [])], [("$.source", "SOURCE_NOT_OBJECT")]),
    ([(("source", "schema_version"), GONE)], [("$.source.schema_version", "MISSING_SOURCE_KEY")]),
    ([(("source", "database_name"), "")], [("$.source.database_name", "INVALID_SOURCE_FIELD")]),
    ([(("source", "correction_ledger_applied"), "yes")], [("$.source.correction_ledger_applied", "INVALID_SOURCE_FIELD")]),
    ([(("policy",), None)], [("$.policy", "POLICY_NOT_OBJECT")]),
    ([(("policy", "blocked_records_included"), GONE)], [("$.policy.blocked_records_included", "MISSING_POLICY_KEY")]),
    ([(("policy", "superseded_records_included"), 0)], [("$.policy.superseded_records_included", "INVALID_POLICY_FIELD")]),
    ([(("policy", "raw_payload_indexed"), True)], [("$.policy.raw_payload_indexed", "RAW_PAYLOAD_INDEXED")]),
    ([(("policy", "full_text_indexed"), True)], [("$.policy.full_text_indexed", "FULL_TEXT_INDEXED")]),
    ([(("policy", "private_paths_exposed"), True)], [("$.policy.private_paths_exposed", "PRIVATE_PATH_POLICY_MISMATCH")]),
    ([(("counts",), 1)], [("$.counts", "COUNTS_NOT_OBJECT")]),
    ([(("counts", "x"), 1)], [("$.counts.x", "UNKNOWN_FIELD")]),
    ([(("counts", "candidate_records"), GONE)], [("$.counts.candidate_records", "MISSING_COUNT_KEY"), ("$.counts.candidate_records", "INVALID_COUNT_VALUE")]),
    ([(("counts", "candidate_records"), 1)], [("$.counts.candidate_records", "COUNT_MISMATCH")]),
    ([(("counts", "projected_records"), 2)], [("$.counts.projected_records", "COUNT_MISMATCH")]),
    ([(("counts", "excluded_records"), -1)], [("$.counts.excluded_records", "INVALID_COUNT_VALUE"), ("$.counts.excluded_records", "COUNT_MISMATCH")]),
    ([(("counts", "indexed_rows"), 1.5)], [("$.counts.indexed_rows", "INVALID_COUNT_VALUE"), ("$.counts.indexed_rows", "COUNT_MISMATCH")]),
    ([(("excluded_records",), {})], [("$.excluded_records", "EXCLUDED_NOT_ARRAY"), ("$.counts.excluded_records", "COUNT_MISMATCH")]),
    ([(("excluded_records", 0), "x")], [("$.excluded_records[0]", "EXCLUDED_NOT_OBJECT")]),
    ([(("excluded_records", 0, "x"), 1)], [("$.excluded_records[0].x", "UNKNOWN_FIELD")]),
    ([(("excluded_records", 0, "reason"), GONE)], [("$.excluded_records[0].reason", "INVALID_EXCLUDED_RECORD")]),
    ([(("records",), None)], [("$.records", "RECORDS_NOT_ARRAY"), *_NONE]),
    ([(_REC, 5)], [(_AT, "RECORD_NOT_OBJECT"), *_NONE]),
    ([((*_REC, "x"), 1)], [(f"{_AT}.x", "UNKNOWN_FIELD")]),
    ([((*_REC, "authority_level"), GONE)], [(f"{_AT}.authority_level", "MISSING_RECORD_KEY")]),
    ([((*_REC, "projection_id"), " ")], [(f"{_AT}.projection_id", "INVALID_PROJECTION_ID"), *_NONE]),
    ([((*_REC, "object_ref"), "Work:1")], [(f"{_AT}.object_ref", "INVALID_OBJECT_REF")]),
    ([((*_REC, "object_type"), "shelf")], [(f"{_AT}.object_type", "INVALID_OBJECT_TYPE")]),
    ([((*_REC, "object_pk"), 0)], [(f"{_AT}.object_pk", "INVALID_OBJECT_PK"), *_NONE]),
    ([((*_REC, "title"), 4)], [(f"{_AT}.title", "INVALID_TITLE"), *_NONE]),
    ([((*_REC, "title"), "api_key = 1")], [(f"{_AT}.title", "SECRET_MARKER_EXPOSED")]),
    ([((*_REC, "subtitle"), " ")], [(f"{_AT}.subtitle", "INVALID_SUBTITLE")]),
    ([((*_REC, "subtitle"), "see /home/me/x")], [(f"{_AT}.subtitle", "PRIVATE_PATH_EXPOSED")]),
    ([((*_REC, "review_state"), None)], [(f"{_AT}.review_state", "INVALID_REVIEW_STATE"), *_NONE]),
    ([((*_REC, "publication_state"), "printed")], [(f"{_AT}.publication_state", "INVALID_PUBLICATION_STATE")]),
    ([((*_REC, "publication_state"), "blocked")], [(f"{_AT}.publication_state", "PUBLIC_VISIBILITY_CONTRADICTION")]),
    ([((*_REC, "publication_state"), "blocked"), _LOCAL], []),
    ([((*_REC, "public_blocker"), "rights")], [(f"{_AT}.public_blocker", "PUBLIC_BLOCKER_VISIBLE")]),
    ([((*_REC, "lineage_state"), "old")], [(f"{_AT}.lineage_state", "INVALID_LINEAGE_STATE")]),
    ([((*_REC, "lineage_state"), "superseded")], [(f"{_AT}.lineage_state", "SUPERSEDED_PUBLIC_RECORD")]),
    ([((*_REC, "visible_profiles", 1), "all")], [(f"{_AT}.visible_profiles[1]", "INVALID_VISIBLE_PROFILE")]),
    ([((*_REC, "suppressed_fields"), "x")], [(f"{_AT}.suppressed_fields", "INVALID_SUPPRESSED_FIELD")]),
    ([((*_REC, "confidence_score"), "high")], [(f"{_AT}.confidence_score", "INVALID_CONFIDENCE_SCORE")]),
    ([((*_REC, "indexed_fields"), 1)], [(f"{_AT}.indexed_fields", "INDEXED_FIELDS_NOT_ARRAY"), (_AT, "INDEXED_FIELDS_EMPTY")]),
    ([(_FLD, 1)], [(_IN, "INDEXED_FIELD_NOT_OBJECT"), (_AT, "INDEXED_FIELDS_EMPTY")]),
    ([((*_FLD, "x"), 1)], [(f"{_IN}.x", "UNKNOWN_FIELD")]),
    ([((*_FLD, "text"), GONE)], [(f"{_IN}.text", "MISSING_INDEXED_FIELD_KEY"), (f"{_IN}.text", "INVALID_INDEXED_FIELD"), (_AT, "INDEXED_FIELDS_EMPTY")]),
    ([((*_FLD, "display_policy"), "hidden")], [(f"{_IN}.display_policy", "INVALID_DISPLAY_POLICY"), (_AT, "INDEXED_FIELDS_EMPTY")]),
    ([((*_FLD, "display_policy"), "local_only")], [(f"{_IN}.display_policy", "LOCAL_ONLY_FIELD_IN_PUBLIC_PROFILE")]),
    ([((*_FLD, "field"), " Raw_Text ")], [(f"{_IN}.field", "RAW_PAYLOAD_FIELD_INDEXED")]),
    ([((*_FLD, "field"), "operator_note")], [(f"{_IN}.field", "PRIVATE_NOTE_FIELD_INDEXED")]),
    ([((*_FLD, "field"), "evidence_note")], [(f"{_IN}.field", "RESTRICTED_EVIDENCE_FIELD_IN_PUBLIC_PROFILE")]),
    ([((*_FLD, "text"), "token = x")], [(f"{_IN}.text", "SECRET_MARKER_EXPOSED")]),
    ([((*_FLD, "text"), "/home/me/x")], [(f"{_IN}.text", "PRIVATE_PATH_EXPOSED"), ("$.policy.private_paths_exposed", "PRIVATE_PATH_POLICY_MISMATCH")]),
]


def projection_findings(spark, d):
    """A search projection for each customer."""
    docs = _planted(read(spark, d, "customer"), "c_custkey", F.col("c_name"), PROJECTION, PROJECTION_DEFECTS)
    return contracts.findings(docs, artifacts.local_search_projection())


# --- correction ledgers -----------------------------------------------------------------------------------------------


def ledger_document_findings(spark, d):
    """Each customer's orders as the events of a correction ledger, in one JSON document."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    none = F.array().cast("array<string>")
    event = F.struct(
        F.when(order % 40 == 0, F.lit("cle:again")).when(order % 41 == 0, text("event ", order)).otherwise(text("cle:", order)).alias("event_id"),
        F.when(F.col("o_orderstatus") == "P", "split").when(order % 43 == 0, "rename").otherwise("merge").alias("action"),
        F.when(order % 37 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("changed_at"),
        F.when(order % 31 != 0, F.lit("operator")).alias("changed_by"),
        F.when(order % 13 == 0, " ").otherwise("same record").alias("rationale"),
        F.when(order % 17 == 0, "").otherwise("noted").alias("note"),
        F.array(text("work:", order % 50)).alias("source_object_refs"),
        F.when(order % 23 == 0, none).when(order % 29 == 0, F.array(text("shelf:", order))).otherwise(F.array(text("work:", order % 50 + 7))).alias("result_object_refs"),
        F.when(order % 19 == 0, F.array(F.lit("work:1"), F.lit("work:1"))).otherwise(none).alias("review_queue_refs"),
        F.when(order % 11 == 0, none).otherwise(F.array(F.lit("prov:a"))).alias("provenance_event_refs"),
        none.alias("evidence_locator_refs"),
        F.when(order % 7 != 0, none).alias("field_review_entry_refs"),
    )
    events = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), event.alias("e")))).alias("rows"))  # an account's orders
    stated = F.to_json(F.struct(F.lit("correction-ledger.v1").alias("schema_version"), text("w", customer).alias("workspace_id"), F.transform("rows", lambda r: r["e"]).alias("events")), {"ignoreNullFields": "false"})
    document = F.when(customer % 9 == 0, F.replace(stated, F.lit('"note":'), F.lit('"remark":'))).otherwise(stated)
    return artifacts.ledger_findings(events.select(customer.alias("key"), document.alias("document")))


LEDGER_DOCUMENTS = """WITH e AS (
  SELECT o_custkey AS key, o_orderkey AS k, o_orderdate AS ts, o_orderstatus = 'P' AS split, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i,
    CASE WHEN o_orderkey % 40 = 0 THEN 'cle:again' WHEN o_orderkey % 41 = 0 THEN 'event ' || o_orderkey ELSE 'cle:' || o_orderkey END AS id, o_orderkey % 50 AS src,
    CASE WHEN o_orderkey % 23 = 0 OR o_orderkey % 29 = 0 THEN NULL ELSE o_orderkey % 50 + 7 END AS res, o_custkey % 9 = 0 AS remarked FROM orders
), u AS (SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY i) AS nth FROM e WHERE k % 37 <> 0
), kept AS (SELECT * FROM u WHERE nth = 1
), f AS (SELECT key, src AS ref, min(i) AS first FROM kept GROUP BY ALL
), c AS (
  SELECT key, i, '.event_id' AS place, 'INVALID_EVENT_ID' AS code FROM e WHERE k % 40 <> 0 AND k % 41 = 0
  UNION ALL SELECT key, i, '.action', 'INVALID_ACTION' FROM e WHERE NOT split AND k % 43 = 0
  UNION ALL SELECT key, i, '.changed_at', 'INVALID_CHANGED_AT' FROM e WHERE k % 37 = 0
  UNION ALL SELECT key, i, '.changed_by', 'INVALID_CHANGED_BY' FROM e WHERE k % 31 = 0
  UNION ALL SELECT key, i, '.rationale', 'INVALID_RATIONALE' FROM e WHERE k % 13 = 0
  UNION ALL SELECT key, i, '.note', 'INVALID_NOTE' FROM e WHERE k % 17 = 0 AND NOT remarked
  UNION ALL SELECT key, i, '.remark', 'UNKNOWN_EVENT_FIELD' FROM e WHERE remarked
  UNION ALL SELECT key, i, '.note', 'MISSING_EVENT_KEY' FROM e WHERE remarked
  UNION ALL SELECT key, i, '.result_object_refs', 'INVALID_OBJECT_REF' FROM e WHERE k % 23 = 0
  UNION ALL SELECT key, i, '.result_object_refs[0]', 'INVALID_OBJECT_REF' FROM e WHERE k % 23 <> 0 AND k % 29 = 0
  UNION ALL SELECT key, i, '.review_queue_refs[1]', 'DUPLICATE_ARRAY_ITEM' FROM e WHERE k % 19 = 0
  UNION ALL SELECT key, i, '', 'PROVENANCE_REF_REQUIRED' FROM e WHERE k % 11 = 0
  UNION ALL SELECT key, i, '.field_review_entry_refs', 'INVALID_FIELD_REVIEW_ENTRY_REF' FROM e WHERE k % 7 = 0
  UNION ALL SELECT key, i, '', 'INVALID_RESULT_CARDINALITY' FROM e WHERE split OR (k % 43 <> 0 AND res IS NULL)
  UNION ALL SELECT key, i, '', 'DUPLICATE_EVENT_ID' FROM u WHERE nth > 1
  UNION ALL SELECT key, i, '', 'EVENTS_OUT_OF_ORDER' FROM (SELECT *, lag(ts) OVER (PARTITION BY key ORDER BY i) AS b FROM kept) WHERE ts < b
  UNION ALL SELECT kept.key, i, '', 'SOURCE_OBJECT_NOT_CURRENT' FROM kept JOIN f ON f.key = kept.key AND ref = src AND i > first
  UNION ALL SELECT kept.key, i, '', 'RESULT_OBJECT_ALREADY_SUPERSEDED' FROM kept JOIN f ON f.key = kept.key AND ref = res AND i >= first
) SELECT key, '$.events[' || i || ']' || place AS path, code FROM c"""


# --- JSON Schema ------------------------------------------------------------------------------------------------------

ROW_SCHEMA = {
    "type": "object",
    "required": ["doc_id", "text", "lang", "source", "size"],
    "additionalProperties": False,
    "properties": {
        "doc_id": {"type": "integer", "minimum": 100},
        "text": {"$ref": "#/definitions/text"},
        "lang": {"enum": ["en", "fr", "de"]},
        "source": {"type": "string", "pattern": "src[0-9]"},
        "n_chars": {"type": "integer", "maximum": 5000},
        "lines": {"type": "array", "minItems": 2, "maxItems": 20, "items": {"type": ["string", "null"], "minLength": 1}},
    },
    "definitions": {"text": {"type": "string", "minLength": 500}},
}


def schema_findings(spark, d):
    """Each document as a JSON object against a JSON Schema."""
    docs = read(spark, d, "documents")
    row = F.struct("doc_id", "text", "lang", "source", "n_chars", F.when(F.col("doc_id") % 3 != 0, F.split("text", "\n")).alias("lines"), F.when(F.col("doc_id") % 5 == 0, 1).alias("extra"))
    return contracts.findings(docs.select(F.col("doc_id").alias("key"), F.to_json(row).alias("document")), contracts.from_schema(ROW_SCHEMA))


SCHEMA_FINDINGS = r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id AS key, '$.doc_id' AS path, 'NUMBER_TOO_SMALL' AS code FROM documents WHERE doc_id < 100 UNION ALL SELECT doc_id, '$.text', 'STRING_TOO_SHORT' FROM documents WHERE length(text) < 500
UNION ALL SELECT doc_id, '$.lang', 'ENUM_MISMATCH' FROM documents WHERE lang NOT IN ('en', 'fr', 'de') UNION ALL SELECT doc_id, '$.source', 'PATTERN_MISMATCH' FROM documents WHERE NOT regexp_full_match(source, 'src[0-9]')
UNION ALL SELECT doc_id, '$.n_chars', 'NUMBER_TOO_LARGE' FROM documents WHERE n_chars > 5000 UNION ALL SELECT doc_id, '$.extra', 'UNKNOWN_FIELD' FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, '$.size', 'MISSING_REQUIRED_KEY' FROM documents UNION ALL SELECT doc_id, '$.lines', 'ARRAY_TOO_SHORT' FROM l WHERE len(lines) < 2 UNION ALL SELECT doc_id, '$.lines', 'ARRAY_TOO_LONG' FROM l WHERE len(lines) > 20
UNION ALL SELECT doc_id, '$.lines[' || i || ']', 'STRING_TOO_SHORT' FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l) WHERE line = ''
UNION ALL SELECT doc_id, '$.' || c, 'MISSING_REQUIRED_KEY' FROM (SELECT doc_id, unnest(['text', 'lang', 'source']) AS c, unnest([text IS NULL, lang IS NULL, source IS NULL]) AS gone FROM documents) WHERE gone"""


QUERIES = {f.__name__: f for f in (adapter_findings, projection_findings, ledger_document_findings, schema_findings)}

ORACLE = {
    "adapter_findings": _oracle("part", "p_partkey", ADAPTER_DEFECTS),
    "projection_findings": _oracle("customer", "c_custkey", PROJECTION_DEFECTS),
    "ledger_document_findings": LEDGER_DOCUMENTS,
    "schema_findings": SCHEMA_FINDINGS,
}
