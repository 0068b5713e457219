"""Loop health of every scope (a workspace or subject) at once.

Cycles come from the cycle ledger where it has figures of the scope, otherwise
from gather events.  Decisions count from the first considered cycle to the
evaluation, and only those on the scope's own objects.  The backlog has all
eight reviewable families of the workspace.  Instants are compared as the texts
that the store holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.values import instant, json_number, json_text, ratio
from ..operators import cycles as op
from .loop import GATHER

FAMILIES = ["work", "source_claim", "source_relationship", "extraction_detected_entity"]
#: Reviewable families and the column that says since when a row waits.
REVIEWABLE = {
    "work": "created_at",
    "source_claim": "created_at",
    "source_relationship": "created_at",
    "extraction_detected_entity": "record_last_updated",
    "authority_reconciliation": "created_at",
    "source_access": "first_seen_at",
    "capture_event": "captured_at",
    "extraction_record": "created_at",
}
FIGURES = ["reviewable", "accepted", "claims", "contradictions"]
#: What the cycle ledger's JSON calls them.
LEDGER_FIGURES = {"reviewable": "new_reviewable_count", "accepted": "new_accepted_count", "claims": "new_source_claim_count", "contradictions": "new_contradiction_count"}


def _state() -> Column:
    return F.coalesce("review_state", F.lit(""))


def gather_cycles(tables: dict[str, DataFrame], lookback: int) -> DataFrame:
    """(scope, at, nth, *FIGURES) of each scope's newest gather events; an event counts for its workspace and for its subject."""
    note = F.col("note_text")
    scopes = F.array_distinct(F.filter(F.array(json_text(note, "workspace_id"), json_text(note, "subject_id")), lambda s: F.coalesce(F.trim(s) != "", F.lit(False))))
    events = tables["provenance_event"].filter(F.col("event_type") == GATHER).select(F.explode(scopes).alias("scope"), F.col("provenance_event_key_v1").alias("event_key"), F.col("event_timestamp").alias("at"), "provenance_event_id")
    newest = op.newest(events, ["scope"], [F.desc("at"), F.desc("provenance_event_id")], lookback)
    waits, kept = _state().isin(vocab.HEALTH_PENDING), _state().isin(vocab.ESTABLISHED)
    rows = []
    for family in FAMILIES:
        if family in tables:
            against = F.col("predicate") == "contradicts" if family == "source_relationship" else F.lit(False)
            ones = {"reviewable": waits, "accepted": kept, "claims": F.lit(family == "source_claim"), "contradictions": F.coalesce(against, F.lit(False))}
            rows.append(tables[family].select(F.col("provenance_event_ref").alias("event_key"), *(c.cast("long").alias(n) for n, c in ones.items())))
    counts = reduce(DataFrame.unionByName, rows).groupBy("event_key").agg(*(F.sum(n).alias(n) for n in FIGURES))
    return newest.join(counts, "event_key", "left").fillna(0, FIGURES).select("scope", "at", F.col("rn").alias("nth"), *FIGURES)


def ledger_cycles(ledger: DataFrame, lookback: int) -> DataFrame:
    """(scope, at, nth, *FIGURES) of each scope's newest ledger rows that hold figures; a row without a workspace is its subject's.

    Rows without figures take their place among the newest, then go.
    """
    figures = F.col("row_count_delta_json")
    known = F.coalesce(F.size(F.json_object_keys(figures)) > 0, F.lit(False))
    scoped = ledger.withColumn("scope", F.coalesce("workspace_id", "subject_key")).filter("scope IS NOT NULL")
    newest = op.newest(scoped, ["scope"], [F.desc("started_at"), F.desc("cycle_event_id")], lookback).filter(known)
    counted = [F.coalesce(json_number(figures, name, "long"), F.lit(0)).cast("long").alias(n) for n, name in LEDGER_FIGURES.items()]
    return newest.select("scope", F.coalesce(json_text(figures, "event_timestamp"), "started_at").alias("at"), F.col("rn").alias("nth"), *counted)


def with_workspace(tables: dict[str, DataFrame], family: str) -> DataFrame:
    """A family's rows with the workspace that they belong to: entities and reconciliations take it from what they come from."""
    rows = tables[family]
    if family not in ("extraction_detected_entity", "authority_reconciliation"):
        return rows.withColumn("scope", F.col("workspace_id"))
    capture = tables["capture_event"].select("capture_event_id", F.col("workspace_id").alias("of_capture"))
    extraction = tables["extraction_record"].select("extraction_id", F.col("workspace_id").alias("of_extraction"))
    if family == "extraction_detected_entity":
        return rows.join(capture, "capture_event_id", "left").join(extraction, "extraction_id", "left").withColumn("scope", F.coalesce("workspace_id", "of_capture", "of_extraction"))
    entity = tables["extraction_detected_entity"].select("detected_entity_id", F.col("workspace_id").alias("of_entity"), "capture_event_id", "extraction_id")
    entity = entity.join(capture, "capture_event_id", "left").join(extraction, "extraction_id", "left").drop("capture_event_id", "extraction_id")
    authority = tables["authority_record"].select(F.col("authority_record_id").cast("string").alias("id"), "workspace_id")
    target = authority.select(F.lit("authority_record").alias("target_namespace"), F.col("id").alias("target_id"), F.col("workspace_id").alias("of_target"))
    candidate = authority.select(F.col("id").cast("long").alias("candidate_authority_record_id"), F.col("workspace_id").alias("of_candidate"))
    joined = rows.join(entity, "detected_entity_id", "left").join(target, ["target_namespace", "target_id"], "left").join(candidate, "candidate_authority_record_id", "left")
    return joined.withColumn("scope", F.coalesce("of_entity", "of_target", "of_candidate", "of_capture", "of_extraction"))


def pending_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(scope, family, since) of every row that waits for review."""
    rows = [with_workspace(tables, f).filter(_state().isin(vocab.HEALTH_PENDING)).select("scope", F.lit(f).alias("family"), instant(F.col(at)).alias("since")) for f, at in REVIEWABLE.items() if f in tables]
    return reduce(DataFrame.unionByName, rows).filter("scope IS NOT NULL")


def scoped_decisions(tables: dict[str, DataFrame]) -> DataFrame:
    """(scope, decided_at) of review decisions on claims, relationships and reconciliations."""
    made = tables["provenance_event"].filter(F.col("event_type").startswith("review_decision_")).select("object_namespace", F.expr("try_cast(object_id AS BIGINT)").alias("id"), F.col("event_timestamp").alias("decided_at"))
    arms = []
    for family, pk in {"source_claim": "source_claim_id", "source_relationship": "source_relationship_id", "authority_reconciliation": "authority_reconciliation_id"}.items():
        if family in tables:
            owner = with_workspace(tables, family).select(F.col(pk).alias("id"), "scope").distinct()  # a decision counts once for a scope
            arms.append(made.filter(F.col("object_namespace") == family).join(owner, "id").select("scope", "decided_at"))
    return reduce(DataFrame.unionByName, arms).filter("scope IS NOT NULL")


def health_status(cycles: Column, per_claim: Column, coverage: Column, least_age: Column, backlog: Column, trend: Column, reviewable: Column) -> Column:
    """The first condition that holds."""
    return (
        F.when(cycles == 0, "insufficient_data")
        .when(F.coalesce(per_claim > 0.25, F.lit(False)), "contradiction_spike")
        .when(F.coalesce(coverage < 0.5, F.lit(False)) | F.coalesce(least_age > 30, F.lit(False)), "review_lagging")
        .when(backlog > 25, "accumulating")
        .when((cycles >= 2) & trend.isin("flat", "declining") & (reviewable == 0), "stalled")
        .otherwise("healthy")
    )


def loop_health(tables: dict[str, DataFrame], scopes: DataFrame, evaluated_at: str, lookback: int = 5) -> DataFrame:
    """One row for each ``scope``: its cycles, yields, contradictions, resolution, backlog with its ages, trend and status.

    The least pending age is the contract's figure for how old the backlog is.
    """
    cycles = gather_cycles(tables, lookback)
    if "cycle_event" in tables and "row_count_delta_json" in tables["cycle_event"].columns:
        ledger = ledger_cycles(tables["cycle_event"], lookback)
        cycles = cycles.join(ledger.select("scope").distinct(), "scope", "left_anti").unionByName(ledger)
    facts = cycles.groupBy("scope").agg(F.count("*").alias("cycles"), *(F.sum(n).alias(n) for n in FIGURES), F.max_by("at", "nth").alias("since"))
    trend = op.yield_trend(cycles.withColumn("place", -F.col("nth")), ["scope"], "place", "reviewable")

    decisions = scoped_decisions(tables)
    ends = facts.select("scope", "since")
    inside = F.col("since").isNull() | ((F.col("decided_at") >= F.col("since")) & (F.col("decided_at") <= evaluated_at))
    decided = decisions.join(ends, "scope", "left").groupBy("scope").agg(F.lit(True).alias("decisions_known"), F.count_if(inside).alias("decisions"))

    edges = tables["source_relationship"].filter(F.col("predicate") == "contradicts").groupBy(F.col("workspace_id").alias("scope"))
    edges = edges.agg(F.count("*").alias("all_contradictions"), F.count_if(_state().isin(vocab.HEALTH_PENDING)).alias("unresolved"))
    pending = pending_rows(tables)
    ages = op.pending_ages(pending.filter("since IS NOT NULL"), F.lit(evaluated_at).cast("timestamp"), "since", ["scope"]).drop("pending")
    backlog = pending.groupBy("scope").agg(F.count("*").alias("backlog"), *(F.count_if(F.col("family") == f).alias(f"pending_{f}") for f in REVIEWABLE))

    out = scopes.select("scope").distinct()
    for part in (facts.drop("since"), trend, decided, edges, backlog, ages):
        out = out.join(part, "scope", "left")
    counts = ["cycles", *FIGURES, "all_contradictions", "unresolved", "backlog", *(f"pending_{f}" for f in REVIEWABLE)]
    out = out.fillna(0, counts).fillna("insufficient_data", ["trend"]).fillna(False, ["decisions_known"])
    per_claim = ratio(F.col("contradictions"), F.col("claims"))
    coverage = F.when(F.col("decisions_known"), ratio(F.col("decisions"), F.col("reviewable")))
    aged = [F.round(f"{n}_age_days", 2).alias(f"{n}_age_days") for n in ("least", "median", "p90")]
    least = F.round("least_age_days", 2)
    status = health_status(F.col("cycles"), per_claim, coverage, least, F.col("backlog"), F.col("trend"), F.col("reviewable"))
    return out.select(
        "scope", *(F.col(c).cast("long").alias(c) for c in counts), ratio(F.col("contradictions"), F.col("cycles")).alias("contradictions_per_cycle"), per_claim.alias("contradictions_per_claim"),
        "decisions_known", F.col("decisions").cast("long").alias("decisions"), coverage.alias("resolution_coverage"), *aged, "trend", status.alias("status"),
    )
