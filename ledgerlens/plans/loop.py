"""Saturation and the feedback plan of every subject, from the store's tables.

``tables`` maps table names to DataFrames (``Snapshot.table`` gives them).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.states import entity_facet, extraction_outcome, is_open_question, locator_label
from ..functions.text import question_quality
from ..functions.values import bounded_score, instant, json_number, json_text
from ..operators import cycles as op

COUNTED = ["work", "source_claim", "extraction_detected_entity", "source_relationship", "capture_event", "extraction_record"]
BACKLOG = ["work", "source_claim", "extraction_detected_entity", "source_relationship", "source_access"]
GATHER = "gather_candidate_batch_ingest"


def gather_events(provenance: DataFrame, raw_text_order: bool = False) -> DataFrame:
    """Cycle events with the fields of their notes; ``at`` orders them by instant, or by the raw text."""
    note = F.col("note_text")
    at = F.col("event_timestamp") if raw_text_order else instant(F.col("event_timestamp"))
    return provenance.filter(F.col("event_type") == GATHER).select(
        F.col("provenance_event_key_v1").alias("event_key"), F.coalesce(json_text(note, "subject_id"), "source_object_id").alias("subject"), json_text(note, "facet").alias("facet"),
        json_number(note, "cycle_depth").alias("cycle_depth"), json_text(note, "artifact_hash").alias("artifact_hash"), "run_id", "event_timestamp", at.alias("at"), "provenance_event_id",
    )


def access_counts(access: DataFrame, works: DataFrame, events: DataFrame, direct: bool = True) -> DataFrame:
    """Distinct accesses per event: of its works, stamped with it, or under a lead that begins with its artifact hash."""
    via_work = access.join(works.select("work_id", F.col("provenance_event_ref").alias("event_key")), "work_id").select("event_key", "source_access_id", "review_state")
    hashed = access.withColumn("artifact_hash", F.nullif(F.regexp_extract("source_lead_id", "^source-lead:([^:]+):", 1), F.lit("")))
    via_lead = hashed.join(events.select("artifact_hash", "event_key"), "artifact_hash").select("event_key", "source_access_id", "review_state")
    arms = [via_work, via_lead]
    if direct:
        arms.append(access.filter("provenance_event_ref IS NOT NULL").select(F.col("provenance_event_ref").alias("event_key"), "source_access_id", "review_state"))
    return reduce(DataFrame.union, arms).distinct()


def reconciliation_rows(tables: dict[str, DataFrame]) -> DataFrame:
    entity = tables["extraction_detected_entity"].select("detected_entity_id", F.col("provenance_event_ref").alias("event_key"))
    return tables["authority_reconciliation"].select("detected_entity_id", "review_state").join(entity, "detected_entity_id").select("event_key", "review_state")


def cycle_yields(tables: dict[str, DataFrame], events: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Events with their yield vectors and useful yields; an event without rows has zeros."""
    families = {t: tables[t].select(F.col("provenance_event_ref").alias("event_key"), "review_state").filter("event_key IS NOT NULL") for t in COUNTED if t in tables}
    if "source_access" in tables:
        families["source_access"] = access_counts(tables["source_access"], tables["work"], events).select("event_key", "review_state")
    if "authority_reconciliation" in tables:
        families["authority_reconciliation"] = reconciliation_rows(tables)
    counts = op.family_counts(families)
    names = [*families, "accepted_record", "reviewable_record"]
    full = events.join(counts, "event_key", "left").fillna(0, names)
    return full.withColumn("useful", op.useful_yield(full, list(families), weights))


def backlog(tables: dict[str, DataFrame], pending: Sequence[str] = tuple(vocab.SATURATION_REVIEWABLE)) -> DataFrame:
    """(workspace_id, backlog): pending rows of all families; entities take their workspace from extraction or capture."""
    rows = []
    for t in BACKLOG:
        if t in tables:
            df = tables[t]
            if t == "extraction_detected_entity" and {"extraction_record", "capture_event"} <= set(tables):
                e = tables["extraction_record"].select("extraction_id", F.col("workspace_id").alias("we"))
                c = tables["capture_event"].select("capture_event_id", F.col("workspace_id").alias("wc"))
                df = df.join(e, "extraction_id", "left").join(c, "capture_event_id", "left").withColumn("workspace_id", F.coalesce("workspace_id", "wc", "we"))
            rows.append(df.filter(F.col("review_state").isin(*pending)).select("workspace_id"))
    return reduce(DataFrame.union, rows).groupBy("workspace_id").agg(F.count("*").alias("backlog"))


def topic_saturation(tables: dict[str, DataFrame], workspaces: DataFrame, policy: dict | None = None) -> DataFrame:
    """State of each (workspace_id, subject) under a policy; a subject without a cycle is in bootstrap."""
    p = {"lookback_cycles": 3, "max_consecutive_low_yield_cycles": 2, "review_backlog_pressure_threshold": 25, "scheduler_action_on_saturated": "deprioritize", "mode": "mixed", "cooldown_cycles": 1} | (policy or {})
    events = gather_events(tables["provenance_event"])
    newest = op.newest(events, ["subject"], [F.desc_nulls_last("at"), F.desc("provenance_event_id")], p["lookback_cycles"])
    yields = cycle_yields(tables, newest).withColumn("low_yield", op.low_yield(F.col("accepted_record"), F.col("reviewable_record"), F.col("useful"), p["mode"]))
    depth = yields.groupBy("subject").agg(F.max("cycle_depth").alias("depth"))
    groups = workspaces.select("workspace_id", "subject").join(op.streaks(yields, ["subject"]), "subject", "left").join(depth, "subject", "left")
    groups = groups.join(backlog(tables), "workspace_id", "left").fillna(0, ["cycles", "low_cycles", "streak", "backlog"])
    out = op.saturation(groups, p["lookback_cycles"], p["max_consecutive_low_yield_cycles"], p["review_backlog_pressure_threshold"], p["scheduler_action_on_saturated"])
    return out.withColumn("next_eligible_cycle", F.when(F.col("state") == "cooldown", F.coalesce("depth", F.lit(0)) + p["cooldown_cycles"] + 1)).drop("depth")


def scoped_works(tables: dict[str, DataFrame], subject: str) -> DataFrame:
    """(work_id) of the subject's workspace, and of other workspaces' works about it."""
    ids = tables["work"].filter(F.col("workspace_id") == subject).select("work_id")
    if "work_subject" in tables:
        ids = ids.union(tables["work_subject"].filter(F.col("subject_object_ref") == subject).select("work_id"))
    return ids.distinct()


def _source_signals(tables: dict[str, DataFrame], subject: str, access: DataFrame, history: DataFrame) -> DataFrame:
    """(source_access_id, captures, ok, bad, entities, runs) of the subject's captures under any locator of each access."""
    key = "source_access_id"
    locators = access.select(key, F.explode(F.array_distinct(F.array(F.col("source_locus_id").cast("string"), "original_locator", "canonical_url"))).alias("locator")).filter("locator != ''")
    captured = tables["capture_event"].filter(F.col("workspace_id") == subject)
    by = lambda c: locators.join(captured.select(F.col(c).alias("locator"), "capture_event_id", "provenance_event_ref"), "locator").select(key, "capture_event_id", "provenance_event_ref")
    matched = by("source_locus_ref").union(by("original_locator")).distinct()
    outcome = extraction_outcome(F.col("extraction_status"))
    extracted = matched.select(key, "capture_event_id").join(tables["extraction_record"].select("capture_event_id", "extraction_status", "provenance_event_ref"), "capture_event_id")
    detected = tables["extraction_detected_entity"].filter(F.col("review_state").isin(vocab.ESTABLISHED)).select("capture_event_id")
    runs = tables["provenance_event"].select(F.col("provenance_event_key_v1").alias("provenance_event_ref"), "run_id")
    of_work = access.join(tables["work"].select("work_id", F.col("provenance_event_ref").alias("event_key")), "work_id").join(history, "event_key").select(key, "run_id")
    ran = matched.select(key, "provenance_event_ref").union(extracted.select(key, "provenance_event_ref")).join(runs, "provenance_event_ref").select(key, "run_id").union(of_work)
    counts = [
        matched.groupBy(key).agg(F.count("*").alias("captures")),
        extracted.groupBy(key).agg(F.count_if(outcome == "success").alias("ok"), F.count_if(outcome == "failed").alias("bad")),
        matched.join(detected, "capture_event_id").groupBy(key).agg(F.count("*").alias("entities")),
        ran.groupBy(key).agg(F.count_distinct("run_id").alias("runs")),
    ]
    return reduce(lambda x, y: x.join(y, key, "left"), counts, access.select(key)).fillna(0, ["captures", "ok", "bad", "entities", "runs"])


def lead_candidates(tables: dict[str, DataFrame], subject: str, facets: Sequence[str]) -> DataFrame:
    """The subject's open leads of four kinds (sources, questions, entities, works) with facet, score and extraction outcomes."""
    w = vocab.SCORING_WEIGHTS
    history = gather_events(tables["provenance_event"], raw_text_order=True).filter(F.col("subject") == subject).select("event_key", F.col("facet").alias("event_facet"), "run_id")
    facet_of = history.select(F.col("event_key").alias("provenance_event_ref"), "event_facet")
    here, is_open = F.col("workspace_id") == subject, F.col("review_state").isin(vocab.FEEDBACK_LEADS)
    scope = scoped_works(tables, subject)
    within = lambda rows, ids, by: rows.join(ids.withColumn("_in", F.lit(True)), by, "left").filter(here | F.col("_in")).drop("_in")
    refs = scope.select(F.concat(F.lit("work:"), F.col("work_id").cast("string")).alias("about_object_ref"))
    none = [F.lit(0).cast("long").alias("ok"), F.lit(0).cast("long").alias("bad")]

    access = within(tables["source_access"].filter(is_open), scope, "work_id")
    claims = tables["source_claim"].filter(F.col("review_state").isin(vocab.ESTABLISHED)).groupBy(F.col("about_object_ref").alias("work_ref")).agg(F.count("*").alias("claims"))
    sources = access.withColumn("work_ref", F.concat(F.lit("work:"), F.col("work_id").cast("string"))).join(claims, "work_ref", "left").join(_source_signals(tables, subject, access, history), "source_access_id").fillna(0, ["claims"])
    sources = sources.join(tables["work"].select("work_id", F.col("provenance_event_ref").alias("event_key")), "work_id", "left").join(history.drop("run_id"), "event_key", "left")
    works = F.when(F.col("work_id").isNotNull(), 1).otherwise(0)
    zero = F.when(works + F.col("claims") + F.col("entities") == 0, F.col("captures")).otherwise(0)
    base = w["open_lead"] + w["work_yield"] * works - w["zero_yield_penalty"] * F.least(zero, F.lit(3))
    source_rows = sources.select(
        F.concat(F.lit("source_access:"), F.col("source_access_id").cast("string")).alias("candidate_id"), F.when(F.col("event_facet").isNotNull(), F.col("event_facet")).otherwise("sources").alias("facet"),
        locator_label(F.col("canonical_url"), F.col("original_locator"), F.col("citation_hint")).alias("label"), op.lead_score(base, F.col("ok"), F.col("bad"), F.col("claims"), F.col("entities"), F.col("runs")).alias("score"), "ok", "bad",
    )
    open_claims = within(tables["source_claim"].filter(is_open & is_open_question(F.col("claim_text"), F.col("claim_type"))), refs, "about_object_ref").join(facet_of, "provenance_event_ref", "left")
    question_rows = open_claims.select(
        F.concat(F.lit("source_claim:"), F.col("source_claim_id").cast("string")).alias("candidate_id"), F.lit("open_questions").alias("facet"), F.col("claim_text").alias("label"),
        bounded_score(w["open_lead"] + w["claim_yield"] + question_quality(F.col("claim_text"), F.col("claim_type"), F.col("event_facet"))).alias("score"), *none,
    )
    entities = tables["extraction_detected_entity"].filter(here & is_open).join(tables["extraction_record"].select("extraction_id", "extraction_status"), "extraction_id", "left")
    got = lambda x: F.when(extraction_outcome(F.col("extraction_status")) == x, 1).otherwise(0).cast("long")
    entity_rows = entities.select(
        F.concat(F.lit("detected_entity:"), F.col("detected_entity_id").cast("string")).alias("candidate_id"), entity_facet(F.col("entity_type"), facets).alias("facet"), F.col("entity_label").alias("label"),
        bounded_score(w["open_lead"] + w["entity_yield"] + w["successful_extraction"] * got("success") - w["failed_extraction_penalty"] * got("failed")).alias("score"), got("success").alias("ok"), got("failed").alias("bad"),
    )
    work_rows = tables["work"].filter(is_open).join(scope, "work_id", "left_semi").select(
        F.concat(F.lit("work:"), F.col("work_id").cast("string")).alias("candidate_id"), F.lit("works").alias("facet"), F.col("title").alias("label"), bounded_score(F.lit(w["open_lead"] + w["work_yield"])).alias("score"), *none
    )
    return reduce(DataFrame.unionByName, [source_rows, question_rows, entity_rows, work_rows]).filter(F.col("facet").isin(*facets))


def feedback_plan(tables: dict[str, DataFrame], subject: str, facets: Sequence[str], max_leads: int = 12, max_deferred: int = 24) -> DataFrame:
    """One table of the plan: kind (facet, lead, deferred, next_action), rank, candidate_id, facet, score, reason."""
    events = gather_events(tables["provenance_event"], raw_text_order=True).filter(F.col("subject") == subject)
    yields = cycle_yields(tables, events)
    total = yields["work"] + yields["source_claim"] + yields["extraction_detected_entity"] + yields["source_relationship"]
    order = F.struct("at", "provenance_event_id")
    history = yields.withColumn("total", total).groupBy("facet").agg(
        F.count_if(F.col("total") > 0).alias("productive_runs"), F.count_if(F.col("total") == 0).alias("zero_yield_runs"), F.sum("work").alias("works"), F.sum("source_claim").alias("claims"),
        F.sum("extraction_detected_entity").alias("entities"), F.sum("source_relationship").alias("relationships"), F.count_distinct("run_id").alias("distinct_runs"), (F.max_by("total", order) == 0).alias("last_run_zero"),
    )
    leads = lead_candidates(tables, subject, facets)
    open_leads = leads.groupBy("facet").agg(F.count("*").alias("open_leads"), F.sum("ok").alias("successful_extractions"), F.sum("bad").alias("failed_extractions"))
    known = events.sparkSession.createDataFrame([(f,) for f in facets], "facet string")
    signals = known.join(history, "facet", "left").join(open_leads, "facet", "left")
    signals = signals.fillna(0, [*op.FACET_SIGNALS, "distinct_runs"]).fillna(False, ["last_run_zero"])
    scored = op.facet_scores(signals, facets, no_history=events.isEmpty())
    place = F.array_position(F.array(*map(F.lit, facets)), F.col("facet"))
    page = leads.orderBy(F.desc("score"), place, "candidate_id").limit(max_leads + max_deferred)
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), place, "candidate_id")))  # a page
    rows = lambda df, kind, reason: df.select(F.lit(kind).alias("kind"), F.col("rank").cast("long").alias("rank"), "candidate_id", "facet", "score", reason.alias("reason"))
    facet_rows = rows(scored.withColumn("candidate_id", F.concat(F.lit("facet:"), F.col("facet"))), "facet", F.col("reason_codes"))
    kept = rows(ranked.filter(F.col("rank") <= max_leads), "lead", F.lit("open_lead"))
    waiting = rows(ranked.filter(F.col("rank") > max_leads), "deferred", F.lit("rank_below_limit"))
    first = facet_rows.filter("rank = 1").withColumn("kind", F.lit("next_action")).withColumn("reason", F.lit("highest_ranked_facet"))
    return facet_rows.unionByName(kept).unionByName(waiting).unionByName(first)
