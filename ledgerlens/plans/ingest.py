"""Candidate batches, execution artifacts and cycle manifests into the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.states import first_nonblank
from ..functions.text import identifier, label
from ..functions.values import content_id, year
from ..operators import identity
from ..operators.upsert import ENVELOPE, WORK_RULES, Snapshot, assign_ids, insert_new, merge

UNKNOWN_LOCUS = "locus:unknown"


class IngestError(ValueError):
    """A batch that the store refuses, found before anything is written."""


def field(name: str) -> Column:
    return F.get_json_object("payload_json", f"$.{name}")


def refuse_bad_years(candidates: DataFrame) -> None:
    """A year that is given but is none aborts the whole batch before a commit."""
    given = F.coalesce(F.trim(field("year")) != "", F.lit(False))
    bad = candidates.filter(given & year(field("year")).isNull()).select("candidate_id").take(5)
    if bad:
        raise IngestError(f"invalid year in candidates {[r[0] for r in bad]}")


def route(candidates: DataFrame) -> dict[str, DataFrame]:
    """The candidates of each family as rows of its table."""
    event = content_id("prov", F.col("run_id"), F.col("facet"))
    base = candidates.withColumn("provenance_event_ref", event).withColumn("workspace_id", F.col("subject_id"))
    state = first_nonblank(F.col("review_status"), F.lit("proposed"))
    none = F.lit(None).cast("string")
    key = identity.work_key(field("work_key"), field("identifiers[0].scheme"), field("identifiers[0].value"), field("title"), field("work_type"), field("original_locator"), year(field("year")), F.col("text"))
    envelope = {"review_state": state, "confidence_score": field("confidence_score").try_cast("double"), "created_at": F.col("created_at"), "record_last_updated": F.col("created_at")}
    family = lambda name: base.filter(F.col("family") == name).withColumns(envelope)
    claim_text = first_nonblank(field("claim_text"), F.col("text"))
    lead = F.concat_ws(":", F.lit("source-lead"), F.sha2("run_id", 256).substr(1, 16), F.col("candidate_id"))
    return {
        "work": family("work").withColumns({"work_key_v1": key, "title": first_nonblank(field("title"), F.substring_index(F.trim("text"), "\n", 1)), "work_type": field("work_type"), "rights_posture": field("rights_posture"), "first_seen_at": F.col("created_at"), "last_seen_at": F.col("created_at")}),
        "source_access": family("source_access").withColumns({"source_lead_id": F.coalesce(field("source_lead_id"), lead), "original_locator": field("original_locator"), "canonical_url": field("canonical_url"), "citation_hint": first_nonblank(field("citation_hint"), F.col("text")), "access_class": field("access_class"), "first_seen_at": F.col("created_at"), "last_seen_at": F.col("created_at")}),
        "source_claim": family("source_claim").withColumns({"source_claim_key_v1": identity.claim_key(F.col("workspace_id"), field("claim_type"), field("about_object_ref"), claim_text), "about_object_ref": field("about_object_ref"), "claim_text": claim_text, "claim_type": field("claim_type"), "is_open_question": F.coalesce(claim_text.contains("?"), F.lit(False)) | (F.col("facet") == "open_questions")}),
        "extraction_detected_entity": family("extraction_detected_entity").withColumns({"entity_label": first_nonblank(field("entity_label"), F.col("text")), "normalized_label": label(first_nonblank(field("entity_label"), F.col("text"))), "entity_type": field("entity_type"),
            "extraction_id": field("extraction_id").try_cast("bigint"), "capture_event_id": field("capture_event_id").try_cast("bigint"),
            "source_span_start": field("source_span_start").try_cast("int"), "source_span_end": field("source_span_end").try_cast("int")}),
        "source_relationship": family("source_relationship").withColumns({"from_object_ref": field("from_object_ref"), "to_object_ref": field("to_object_ref"), "predicate": field("predicate"), "target_label": field("target_label"), "evidence_note": F.coalesce(field("evidence_note"), none)}),
    }


KEYS = {
    "work": ("work_id", ["work_key_v1"], WORK_RULES),
    "source_access": ("source_access_id", ["source_lead_id", "original_locator", "workspace_id"], {"last_seen_at": "latest", "first_seen_at": "earliest", "review_state": "review_state", **ENVELOPE}),
    "source_claim": ("source_claim_id", ["source_claim_key_v1"], {"claim_text": "text", "review_state": "review_state", **ENVELOPE}),
    "extraction_detected_entity": ("detected_entity_id", ["provenance_event_ref", *schemas.IDENTITY["extraction_detected_entity"], "workspace_id"], {"review_state": "review_state", **ENVELOPE}),
    "source_relationship": ("source_relationship_id", ["from_object_ref", "to_object_ref", "predicate", "target_label", "evidence_note", "workspace_id"], {"review_state": "review_state", **ENVELOPE}),
}


def upsert_family(store: Snapshot, table: str, rows: DataFrame, arrival: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """(the merged table, a report of inserted, updated and deduplicated rows)."""
    pk, key, rules = KEYS[table]
    old = store.table(table)
    new = rows.select(*(F.col(c) for c in rows.columns if c in old.columns), arrival)
    same = [old[k].eqNullSafe(new[k]) for k in key]
    hits = new.join(old.select(*key).distinct(), [a for a in same], "left_semi")
    distinct = new.select(*key).distinct()
    report = new.agg(F.count("*").alias("incoming")).crossJoin(hits.select(*key).distinct().agg(F.count("*").alias("updated"))).crossJoin(distinct.agg(F.count("*").alias("keys")))  # one row each
    report = report.select(F.lit(table).alias("table"), (F.col("keys") - F.col("updated")).alias("inserted"), "updated", (F.col("incoming") - F.col("keys")).alias("deduped"))
    merged = merge(old, new, key, {**{c: "first" for c in (pk, "created_at")}, **rules}, arrival)
    top = old.agg(F.max(pk)).first()[0] or 0
    fresh = assign_ids(schemas.conform(merged.filter(F.col(pk).isNull()), table), pk, top + 1, key)
    kept = merged.filter(F.col(pk).isNotNull())
    return schemas.conform(kept, table).unionByName(schemas.conform(fresh, table)), report


def ingest_candidates(store: Snapshot, candidates: DataFrame) -> DataFrame:
    """Merge a batch into its families and record its provenance, in one commit; the report.

    Running a batch again changes nothing: every key is found and the first provenance record stays.
    """
    refuse_bad_years(candidates)
    tables, reports = {}, None
    for table, rows in route(candidates).items():
        merged, report = upsert_family(store, table, rows)
        tables[table] = merged
        reports = report if reports is None else reports.unionByName(report)
    event = candidates.select(
        content_id("prov", F.col("run_id"), F.col("facet")).alias("provenance_event_key_v1"), F.lit("gather_candidate_batch_ingest").alias("event_type"), "run_id", F.col("subject_id").alias("source_object_id"), F.col("created_at").alias("event_timestamp"),
        F.to_json(F.struct("subject_id", "facet")).alias("note_text"),
    ).distinct()
    old = store.table("provenance_event")
    top = old.agg(F.max("provenance_event_id")).first()[0] or 0
    fresh = assign_ids(schemas.conform(insert_new(old, event, ["provenance_event_key_v1"], ["event_timestamp"]), "provenance_event"), "provenance_event_id", top + 1, ["provenance_event_key_v1"])
    tables["provenance_event"] = old.unionByName(schemas.conform(fresh, "provenance_event"))
    report = store.spark.createDataFrame(reports.collect(), reports.schema)  # five rows, taken before the commit changes what they count
    store.commit(tables)
    return report


def work_identifiers(candidates: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(identifier rows, conflicts): an identifier that two works claim is a conflict, an invalid one is kept as such."""
    given = candidates.select(F.col("work_key_v1"), F.explode(F.from_json(F.get_json_object("payload_json", "$.identifiers"), "array<struct<scheme:string,value:string>>")).alias("i"))
    named = given.select("work_key_v1", identifier(F.col("i.scheme"), F.col("i.value")).alias("x")).select("work_key_v1", "x.*").join(works.select("work_key_v1", "work_id"), "work_key_v1")
    rows = named.groupBy("scheme", "value").agg(F.min("work_id").alias("work_id"), F.count_distinct("work_id").alias("claimants"), F.first("uri").alias("normalized_uri"), F.first("status").alias("validity_status"))
    return rows.drop("claimants"), rows.filter((F.col("claimants") > 1) & (F.col("validity_status") == "valid")).select("scheme", "value")


def execution_rows(execution: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(capture_event, extraction_record) rows of joined execution artifacts."""
    captures = execution.select("capture_id", F.col("captured_at"), "capture_method", "content_hash", "byte_count", F.col("content_type").alias("mime_type"), "workspace_id").distinct()
    done = execution.filter("extraction_id IS NOT NULL").select("capture_id", F.col("extraction_method").alias("extractor"), "input_hash", "output_hash", F.col("byte_count_out").alias("byte_count"), "extraction_status")
    return captures, done


def record_cycle(manifest: DataFrame) -> dict[str, DataFrame]:
    """Rows of the cycle tables from manifests with arrays of stages, artifacts and decisions."""
    event = F.sha2(F.concat_ws("|", "workspace_id", "subject_id", "run_id"), 256)
    base = manifest.withColumn("cycle_event_id", event)
    part = lambda column, prefix, *cols: base.select("cycle_event_id", F.posexplode(column).alias("n", "x")).select(F.concat_ws(":", F.lit(prefix), F.substring("cycle_event_id", 1, 16), F.col("n").cast("string")).alias(f"cycle_{prefix}_id"), "cycle_event_id", *(F.col(f"x.{c}").alias(c) for c in cols))
    return {
        "cycle_event": schemas.conform(base, "cycle_event"),
        "cycle_stage": schemas.conform(part("stages", "stage", "stage_name", "status"), "cycle_stage"),
        "cycle_artifact": schemas.conform(part("artifacts", "artifact", "artifact_role", "artifact_path", "content_hash"), "cycle_artifact"),
        "cycle_decision": schemas.conform(part("decisions", "decision", "decision_type", "decided_at"), "cycle_decision"),
    }


def cycle_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(cycle_event_id, one count for each cycle table)."""
    events = tables["cycle_event"].select("cycle_event_id")
    for name, df in tables.items():
        if name != "cycle_event":
            events = events.join(df.groupBy("cycle_event_id").agg(F.count("*").alias(f"n_{name}")), "cycle_event_id", "left").fillna(0, [f"n_{name}"])
    return events


def assign_loci(access: DataFrame, loci: DataFrame) -> DataFrame:
    """Accesses with a known locus, or the unknown one."""
    known = loci.select(F.col("locus_id").alias("source_locus_ref"), F.lit(True).alias("_known"))
    return access.join(known, "source_locus_ref", "left").withColumn("source_locus_ref", F.when(F.col("_known"), F.col("source_locus_ref")).otherwise(UNKNOWN_LOCUS)).drop("_known")


def without_structured_counterparts(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Edges that no claim of the same event, ends and predicate says already."""
    said = claims.select(F.col("provenance_event_ref"), F.col("about_object_ref").alias("from_object_ref"), F.get_json_object("claim_text", "$.to_object_ref").alias("to_object_ref"), F.col("claim_type").alias("predicate"))
    return edges.join(said, ["provenance_event_ref", "from_object_ref", "to_object_ref", "predicate"], "left_anti")


def contradiction_edges(pairs: DataFrame, namespace: str = "source_claim") -> DataFrame:
    """Contradiction relationships of (low_id, high_id) pairs, waiting for review."""
    ref = lambda c: F.concat(F.lit(f"{namespace}:"), F.col(c).cast("string"))
    return schemas.conform(pairs.select(ref("low_id").alias("from_object_ref"), ref("high_id").alias("to_object_ref"), F.lit("contradicts").alias("predicate"), F.lit("needs_review").alias("review_state"), F.lit(1.0).alias("confidence_score")), "source_relationship")


def backfill_legacy(leads: DataFrame) -> dict[str, DataFrame]:
    """Works and accesses of old lead rows (lead_id, title, locator, url, workspace_id)."""
    titled = leads.filter(F.coalesce(F.trim("title") != "", F.lit(False)))
    works = titled.select(F.concat_ws("|", F.lit("title"), label(F.col("title"))).alias("work_key_v1"), "title", "workspace_id", F.lit("needs_review").alias("review_state")).dropDuplicates(["work_key_v1"])
    access = leads.select(F.col("lead_id").alias("source_lead_id"), F.col("locator").alias("original_locator"), F.col("url").alias("canonical_url"), "workspace_id", F.lit("needs_review").alias("review_state"))
    return {"work": schemas.conform(works, "work"), "source_access": schemas.conform(access, "source_access")}


def entities_with_workspace(entities: DataFrame, extractions: DataFrame, captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities with a workspace from themselves, their extraction or their capture; those whose sources disagree)."""
    e = extractions.select("extraction_id", F.col("workspace_id").alias("_we"))
    c = captures.select("capture_event_id", F.col("workspace_id").alias("_wc"))
    joined = entities.join(e, "extraction_id", "left").join(c, "capture_event_id", "left")
    named = F.array_distinct(F.array_compact(F.array("workspace_id", "_we", "_wc")))
    bad = joined.filter(F.size(named) > 1).select(*entities.columns)
    return joined.withColumn("workspace_id", F.coalesce("workspace_id", "_we", "_wc")).select(*entities.columns), bad


#: Where a reconciliation may go from each of its states.
LIFECYCLE = {"proposed": ["accepted", "rejected", "ambiguous"], "ambiguous": ["accepted", "rejected"], "rejected": ["proposed"], "accepted": []}


def advance_reconciliations(rows: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reconciliations after the moves (reconciliation_key_v1, to_state), moves that the lifecycle refuses)."""
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, bs in LIFECYCLE.items() for b in bs))
    joined = rows.join(moves, "reconciliation_key_v1", "left")
    step = F.concat_ws(">", "review_state", "to_state")
    fine = F.col("to_state").isNotNull() & F.array_contains(allowed, step)
    after = joined.withColumn("review_state", F.when(fine, F.col("to_state")).otherwise(F.col("review_state"))).select(*rows.columns)
    refused = joined.filter(F.col("to_state").isNotNull() & ~fine & (F.col("to_state") != F.col("review_state"))).select("reconciliation_key_v1", "review_state", "to_state")
    return after, refused
