"""The correction ledger's contract: rules of each event, and of the lineage that events build in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import instant

#: Actions, reference prefixes and reference forms of the contract.
ACTIONS = ["dedupe", "merge", "split", "supersede"]
OBJECTS = [
    "authority",
    "authority_identifier",
    "claim",
    "detected_entity",
    "highlight",
    "lead",
    "relationship",
    "source_access",
    "topic_extension",
    "work",
    "work_identifier",
    "work_subject",
]
EVENT_ID = "^cle:[a-z0-9][a-z0-9._:-]*$"
OBJECT_REF = f"^({'|'.join(OBJECTS)}):[0-9]+$"
PROVENANCE_REF = "^prov:[a-z0-9-]+$"
LOCATOR_REF = "^evl:[a-z0-9][a-z0-9._:-]*$"
FIELD_REVIEW_REF = "^frs:[a-z0-9][a-z0-9._:-]*$"

ARRAYS = ["source_object_refs", "result_object_refs", "review_queue_refs", "provenance_event_refs", "evidence_locator_refs", "field_review_entry_refs"]
FIELDS = ["action", "changed_at", "changed_by", "rationale", "note", "workspace_id", "seq", *ARRAYS]


def _stated(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) != "", F.lit(False))


def _refs(c: str, form: str) -> Column:
    """An array whose items all have the form; an absent one breaks the rule."""
    return F.forall(F.col(c), lambda x: F.coalesce(x.rlike(form), F.lit(False)))


def rules() -> dict[str, Column]:
    """What each event must hold, by error code."""
    sources, results, action = F.size("source_object_refs"), F.size("result_object_refs"), F.coalesce("action", F.lit(""))
    objects = _refs("source_object_refs", OBJECT_REF) & _refs("result_object_refs", OBJECT_REF)
    distinct = [F.coalesce(F.size(F.array_distinct(c)) == F.size(c), F.lit(True)) for c in ARRAYS]
    return {
        "INVALID_EVENT_ID": F.col("event_id").rlike(EVENT_ID),
        "INVALID_ACTION": action.isin(*ACTIONS),
        "INVALID_CHANGED_AT": instant(F.col("changed_at")).isNotNull(),
        "INVALID_CHANGED_BY": _stated("changed_by"),
        "INVALID_RATIONALE": _stated("rationale"),
        "INVALID_NOTE": F.col("note").isNull() | _stated("note"),
        "INVALID_OBJECT_REF": objects & (sources > 0) & (results > 0),
        "INVALID_REVIEW_QUEUE_REF": _refs("review_queue_refs", OBJECT_REF),
        "INVALID_PROVENANCE_EVENT_REF": _refs("provenance_event_refs", PROVENANCE_REF),
        "INVALID_EVIDENCE_LOCATOR_REF": _refs("evidence_locator_refs", LOCATOR_REF),
        "INVALID_FIELD_REVIEW_ENTRY_REF": _refs("field_review_entry_refs", FIELD_REVIEW_REF),
        "DUPLICATE_ARRAY_ITEM": reduce(lambda x, y: x & y, distinct),
        "INVALID_RESULT_CARDINALITY": F.when(action == "split", results >= 2).when(action.isin(*ACTIONS), results == 1).otherwise(True),
        "INVALID_SOURCE_CARDINALITY": (action != "split") | (sources == 1),
        "OVERLAPPING_OBJECT_REFS": ~F.coalesce(F.arrays_overlap("source_object_refs", "result_object_refs"), F.lit(False)),
        "PROVENANCE_REF_REQUIRED": F.size("provenance_event_refs") > 0,
    }


def lineage_findings(events: DataFrame) -> DataFrame:
    """(key, code) of events against those before them in their workspace's ledger, in the order of ``seq``.

    Events without an id, action or instant take no part; of events with one id only the first does.  References meet
    by equi-joins and windows of a reference, and the order of a ledger is checked by its workspace's window.
    """
    known = events.filter(_stated("event_id") & _stated("action") & instant(F.col("changed_at")).isNotNull())
    ledger = Window.partitionBy("workspace_id", "event_id").orderBy("seq", "changed_at")
    known = known.withColumn("_nth", F.row_number().over(ledger)).withColumn("_at", instant(F.col("changed_at")))
    finding = lambda rows, code: rows.select(F.col("event_id").alias("key"), F.lit(code).alias("code"))
    kept = known.filter("_nth = 1")
    before = F.lag("_at").over(Window.partitionBy("workspace_id").orderBy("seq", "_at", "event_id"))
    place = F.struct("seq", "_at", "event_id").alias("place")
    each = lambda c: kept.select("workspace_id", "event_id", place, F.explode(F.array_distinct(c)).alias("ref"))
    taken = each("source_object_refs")
    first = taken.groupBy(F.col("workspace_id").alias("_workspace"), F.col("ref").alias("_ref")).agg(F.min("place").alias("first"))
    late = lambda rows, after: rows.join(first, F.col("workspace_id").eqNullSafe(F.col("_workspace")) & (F.col("ref") == F.col("_ref"))).filter(after)
    return reduce(
        DataFrame.unionByName,
        [
            finding(known.filter("_nth > 1"), "DUPLICATE_EVENT_ID"),
            finding(kept.withColumn("_before", before).filter("_at < _before"), "EVENTS_OUT_OF_ORDER"),
            finding(late(taken, F.col("place") > F.col("first")), "SOURCE_OBJECT_NOT_CURRENT"),
            finding(late(each("result_object_refs"), F.col("place") >= F.col("first")), "RESULT_OBJECT_ALREADY_SUPERSEDED"),
        ],
    )
