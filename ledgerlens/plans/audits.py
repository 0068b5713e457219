"""Closure, rebuild, readiness and artifact audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import PRIVATE_PATH, SECRET
from ..functions.values import is_json
from ..operators import graph
from ..operators.fingerprint import fingerprint
from ..operators.scan import check_references, check_rules, check_unique
from . import corrections

#: Reference columns of each table: (column, how it names its target).
REFERENCES = {
    "source_relationship": ["from_object_ref", "to_object_ref"],
    "source_claim": ["about_object_ref"],
    "work_subject": ["subject_object_ref"],
}
PRIMARY = {
    "work": "work_id",
    "authority_record": "authority_record_id",
    "source_claim": "source_claim_id",
    "source_relationship": "source_relationship_id",
    "capture_event": "capture_event_id",
    "extraction_record": "extraction_id",
    "extraction_detected_entity": "detected_entity_id",
    "source_access": "source_access_id",
    "topic_extension": "topic_extension_id",
    "provenance_event": "provenance_event_id",
}
NATURAL = {"work": "work_key_v1", "authority_record": "authority_key_v1", "source_claim": "source_claim_key_v1", "provenance_event": "provenance_event_key_v1"}


def object_directory(tables: dict[str, DataFrame]) -> DataFrame:
    """Every object's reference, by surrogate id and by natural key."""
    known = graph.directory({t: (df, PRIMARY[t]) for t, df in tables.items() if t in PRIMARY})
    named = [df.select(F.concat(F.lit(f"{t}:"), F.col(NATURAL[t])).alias("ref")) for t, df in tables.items() if t in NATURAL]
    return reduce(DataFrame.union, named, known)


def closure_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Per referring column: totals by fate and verdict; a labelled target without an object is tracked, not lost."""
    rows = []
    for table, columns in REFERENCES.items():
        if table in tables:
            df = tables[table]
            label = F.col("target_label") if "target_label" in df.columns else F.lit(None).cast("string")
            rows += [df.filter(F.col(c).isNotNull()).select(F.lit(f"{table}.{c}").alias("family"), F.col(c).alias("ref"), label.alias("label")) for c in columns]
    refs = reduce(DataFrame.unionByName, rows)
    return graph.closure_report(refs, object_directory(tables), F.col("ref").startswith("external:"), F.col("label").isNotNull())


def rebuild_audit(original: dict[str, DataFrame], rebuilt: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, rebuilt_rows, equal) of two stores by order-insensitive fingerprints without surrogate ids."""
    rows = []
    for name, df in original.items():
        skip = ["record_last_updated", "created_at", *([PRIMARY[name]] if name in PRIMARY else [])]
        a, b = (fingerprint(x, skip).select("n_rows", "fingerprint") for x in (df, rebuilt.get(name, df.limit(0))))
        joined = a.select(F.lit(name).alias("table"), F.col("n_rows").alias("rows"), F.col("fingerprint").alias("f")).crossJoin(b.select(F.col("n_rows").alias("rebuilt_rows"), F.col("fingerprint").alias("g")))  # one row each
        rows.append(joined.select("table", "rows", "rebuilt_rows", (F.col("f") == F.col("g")).alias("equal")))
    return reduce(DataFrame.unionByName, rows)


def rollup(checks: DataFrame) -> DataFrame:
    """(status, passed, warned, failed) of (check, status) rows: the worst status wins."""
    s = F.col("status")
    return checks.agg(F.when(F.count_if(s.isin("fail", "block")) > 0, "fail").when(F.count_if(s == "warn") > 0, "warn").otherwise("pass").alias("status"), F.count_if(s == "pass").alias("passed"), F.count_if(s == "warn").alias("warned"), F.count_if(s.isin("fail", "block")).alias("failed"))


def _has(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))


def _in(c: str, *values: str) -> Column:
    return F.col(c).isin(*values)


def _clean(c: str) -> Column:
    return F.coalesce(~F.col(c).rlike(SECRET) & ~F.col(c).rlike(PRIVATE_PATH), F.lit(True))


def _sha(c: str) -> Column:
    return F.col(c).rlike("^[0-9a-f]{64}$")


def _relative(c: str) -> Column:
    return _has(c) & ~F.col(c).startswith("/") & ~F.col(c).rlike(r"(^|/)\.\.(/|$)")


def contracts() -> dict[str, tuple[str, dict[str, Column]]]:
    """Row rules of each artifact contract: (key column, rules by error code).

    Each artifact is a DataFrame of its exploded rows with the columns that the rules name.
    """
    return {
        "candidate_feedback_plan": ("candidate_id", {"SCORE_RANGE": F.col("score").between(-100, 100), "RANK": F.col("rank") >= 1, "KIND": _in("kind", "facet", "lead", "deferred", "next_action"), "REASON": _has("reason")}),
        "canonical_graph_model_outline": ("family", {"TABLE": _has("table_name"), "SIDECAR": _has("sidecar") | ~F.col("requires_sidecar")}),
        "correction_ledger": ("event_id", corrections.rules()),
        "crown_jewel_backup_manifest": ("path", {"PATH": _relative("path"), "HASH": _sha("sha256")}),
        "crown_jewel_store_manifest": ("store_key", {"KEY": _has("store_key"), "PATH": _relative("path")}),
        "crown_jewel_store_policy": ("store_key", {"KEY": _has("store_key"), "RETENTION": F.col("retain_days") > 0}),
        "evidence_locator": ("locator_id", {"KIND": _in("locator_kind", "page", "span", "section", "timestamp", "record"), "SPAN": F.coalesce(F.col("span_start") <= F.col("span_end"), F.lit(True)), "PRIVATE": _clean("label")}),
        "field_review_state": ("field_key", {"STATE": _in("review_state", *vocab.REVIEW_STATES), "SUPERSEDE": (F.col("review_state") != "deprecated") | _has("superseded_by")}),
        "gather_candidate_batch": ("candidate_id", {"ID": _has("candidate_id"), "TYPE": _in("candidate_type", "source", "work", "entity", "claim", "relationship"), "TEXT": _has("text")}),
        "jsonl": ("line_no", {"JSON": is_json(F.col("line"))}),
        "knowledge_tree_build_manifest": ("route", {"ROUTE": _relative("route"), "HASH": _sha("sha256")}),
        "knowledge_tree_export": ("claim_id", {"REVIEWED": _in("review_state", *vocab.ESTABLISHED), "SUMMARY": _has("public_summary") & _clean("public_summary")}),
        "legacy_subject_substrate": ("path", {"PRESENT": F.col("present")}),
        "llm_prompt_fixture": ("fixture_id", {"WRAPPED": F.col("text").rlike("(?s)^<<<.*>>>$")}),
        "local_search_projection": ("projection_id", {"TITLE": _has("title"), "STATE": _in("review_state", *vocab.ESTABLISHED), "PUBLIC": (F.col("profile") == "local") | _in("publication_state", *vocab.PUBLIC_STATES), "LEAK": _clean("indexed_text")}),
        "local_search_results": ("object_ref", {"RANK": F.col("rank") >= 1, "CLASS": _in("result_class", *sorted(set(vocab.RESULT_CLASS.values()))), "LEAK": _clean("snippet")}),
        "migration_ledger": ("event_id", {"TYPE": _has("migration_type"), "ROLLBACK": (F.col("migration_type") != "rollback") | _has("rollback_of_event_id")}),
        "public_knowledge_tree_presentation": ("page_id", {"TITLE": _has("title"), "ROUTE": _relative("route")}),
        "public_safekeeping_manifest": ("path", {"PATH": _relative("path"), "HASH": _sha("sha256"), "CLASS": _in("visibility", "public")}),
        "release_readiness": ("gate", {"STATUS": _in("status", "pass", "warn", "block")}),
        "scheduler_failure_state_reconciliation": ("workspace_id", {"STATE": _in("state", "healthy", "retryable_failure", "blocked"), "STREAK": (F.col("state") != "healthy") | (F.col("failure_streak") == 0)}),
        "source_acquisition_execution": ("capture_id", {"CAPTURE": _has("content_hash") | (F.col("status") != "captured"), "BYTES": F.coalesce(F.col("byte_count") >= 0, F.lit(True))}),
        "source_adapter": ("step_id", {"FAMILY": _in("input_family", "local_file", "local_directory", "local_git_repo", "remote_url_manifest", "structured_data"), "RIGHTS": _has("rights_posture")}),
        "source_adapter_handoff": ("sequence", {"SEQUENCE": F.col("sequence") >= 1, "LOCATOR": _has("locator")}),
        "source_locus_jsonl": ("locus_id", {"TYPE": _has("locus_type"), "STATE": _in("review_state", *vocab.REVIEW_STATES), "SCORE": F.coalesce(F.col("productivity_score").between(0, 1), F.lit(True))}),
        "static_knowledge_tree_output": ("path", {"PATH": _relative("path"), "LEAK": _clean("content")}),
        "static_page_family_query_contract": ("family", {"QUERY": _has("query"), "VISIBILITY": _in("visibility", "public", "withheld")}),
        "subject_manifest": ("subject_id", {"ID": F.col("subject_id").rlike("^[a-z0-9][a-z0-9-]*$"), "LABEL": _has("label")}),
        "topic_workspace_registry": ("workspace_id", {"LIFECYCLE": _in("lifecycle_state", "active", "paused", "archived"), "POSTURE": _in("schedule_posture", "scheduled", "manual", "disabled"), "ROOT": _relative("workspace_root")}),
    }


#: Contracts whose key occurs once, and references inside one artifact (column, the column that it names).
UNIQUE = {"crown_jewel_backup_manifest", "crown_jewel_store_manifest", "evidence_locator", "field_review_state", "gather_candidate_batch", "knowledge_tree_build_manifest", "migration_ledger", "source_adapter_handoff", "source_locus_jsonl", "subject_manifest", "topic_workspace_registry"}
INNER = {"source_locus_jsonl": ("parent_locus_id", "locus_id"), "migration_ledger": ("rollback_of_event_id", "event_id"), "field_review_state": ("superseded_by", "field_key"), "source_adapter": ("after_step_id", "step_id")}


#: Columns that the rules of a contract read, besides its key; absent ones are null.
FIELDS = {
    "candidate_feedback_plan": "score rank kind reason",
    "canonical_graph_model_outline": "table_name sidecar requires_sidecar",
    "correction_ledger": " ".join(corrections.FIELDS),
    "crown_jewel_backup_manifest": "sha256",
    "crown_jewel_store_manifest": "path",
    "crown_jewel_store_policy": "retain_days",
    "evidence_locator": "locator_kind span_start span_end label",
    "field_review_state": "review_state superseded_by",
    "gather_candidate_batch": "candidate_type text",
    "jsonl": "line",
    "knowledge_tree_build_manifest": "sha256",
    "knowledge_tree_export": "review_state public_summary",
    "legacy_subject_substrate": "present",
    "llm_prompt_fixture": "text",
    "local_search_projection": "title review_state profile publication_state indexed_text",
    "local_search_results": "rank result_class snippet",
    "migration_ledger": "migration_type rollback_of_event_id",
    "public_knowledge_tree_presentation": "title route",
    "public_safekeeping_manifest": "sha256 visibility",
    "release_readiness": "status",
    "scheduler_failure_state_reconciliation": "state failure_streak",
    "source_acquisition_execution": "content_hash status byte_count",
    "source_adapter": "input_family rights_posture",
    "source_adapter_handoff": "locator",
    "source_locus_jsonl": "locus_type review_state productivity_score",
    "static_knowledge_tree_output": "content",
    "static_page_family_query_contract": "query visibility",
    "subject_manifest": "label",
    "topic_workspace_registry": "lifecycle_state schedule_posture workspace_root",
}
TYPES = {
    "score": "double", "rank": "int", "requires_sidecar": "boolean", **dict.fromkeys(corrections.ARRAYS, "array<string>"), "seq": "long", "retain_days": "int", "span_start": "long",
    "span_end": "long", "present": "boolean", "failure_streak": "int", "byte_count": "long", "sequence": "int", "productivity_score": "double",
}


def validate(artifact: str, rows: DataFrame) -> DataFrame:
    """(key, code) of everything that an artifact's rows break; a rule on a column that is absent is broken by every row."""
    key, rules = contracts()[artifact]
    fields = FIELDS.get(artifact, "").split() + ([INNER[artifact][0]] if artifact in INNER else [])
    needed = {c: F.lit(None).cast(TYPES.get(c, "string")) for c in [key, *fields] if c not in rows.columns}
    full = rows.withColumns(needed) if needed else rows
    found = check_rules(full, key, rules)
    if artifact in UNIQUE:
        found = found.unionByName(check_unique(full, [key]))
    if artifact in INNER:
        column, target = INNER[artifact]
        found = found.unionByName(check_references(full, key, column, full, target))
    if artifact == "correction_ledger":
        found = found.unionByName(corrections.lineage_findings(full))
    return found


def report(artifact: str, rows: DataFrame) -> DataFrame:
    """(artifact, inspected, rejected, status, codes) of a validation."""
    found = validate(artifact, rows)
    bad = found.agg(F.count_distinct("key").alias("rejected"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))
    return rows.agg(F.lit(artifact).alias("artifact"), F.count("*").alias("inspected")).crossJoin(bad).withColumn("status", F.when(F.col("rejected") > 0, "fail").otherwise("pass"))  # one row each
