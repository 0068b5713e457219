"""Review queue, prior state, scheduling, publication and standards exports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.states import is_public, pending, state_label
from ..functions.values import backoff


def queue(targets: dict[str, DataFrame], state: str | None = None, limit: int = 50) -> DataFrame:
    """The most confident pending rows of all targets (columns pk, label, review_state, confidence_score, public_blocker).

    Each target is cut to the limit before the union, so the merge reads a bounded number of rows.
    """
    order = [F.asc("no_confidence"), F.desc("confidence_score"), F.asc("target_type"), F.asc("pk")]

    def cut(name: str, df: DataFrame) -> DataFrame:
        rows = df.filter(pending(F.col("review_state"), state)).select(F.lit(name).alias("target_type"), F.col("pk").cast("string").alias("pk"), "label", "review_state", "confidence_score", "public_blocker")
        return rows.withColumn("no_confidence", F.col("confidence_score").isNull()).orderBy(*order).limit(limit)

    merged = reduce(DataFrame.unionByName, (cut(n, df) for n, df in targets.items()))
    return merged.orderBy(*order).limit(limit).drop("no_confidence")


def prior_state(rows: DataFrame, scope: Column, noun: str, limit: int = 5, threshold: float = 0.8) -> DataFrame:
    """The first ``limit`` rows in scope, established and confident first, with labels and the total in scope."""
    kept = rows.filter(scope & ~F.coalesce(F.col("review_state"), F.lit("")).isin(vocab.EXCLUDED))
    total = kept.agg(F.count("*").alias("total"))
    order = [F.desc(F.col("review_state").isin(vocab.ESTABLISHED)), F.desc(F.coalesce("confidence_score", F.lit(-1.0))), F.desc_nulls_last("last_updated"), F.asc("pk")]
    page = kept.orderBy(*order).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("label", state_label(F.col("review_state"), F.col("confidence_score"), noun, threshold))  # total: one row


def within_budget(lines: DataFrame, order: Sequence[str], text: str, budget: int) -> DataFrame:
    """The leading lines whose lengths, a line end each, stay within the budget; for a page of lines."""
    upto = F.sum(F.length(text) + 1).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("upto", upto).filter(F.col("upto") <= budget).drop("upto")


def ineligibility(now: Column, backoff_seconds: int = 3600, max_attempts: int = 5) -> Column:
    """Ordered reasons why a workspace does not run now (columns of a workspace with its failure state)."""
    waiting = F.col("last_failure_at").isNotNull() & (backoff(F.col("last_failure_at"), F.lit(backoff_seconds)) > now)
    return F.array_compact(
        F.array(
            F.when(F.col("lifecycle_state") != "active", "lifecycle_not_active"),
            F.when(F.col("schedule_posture") != "scheduled", "posture_not_scheduled"),
            F.when(F.col("failure_state") == "blocked", "blocked"),
            F.when(F.col("failure_streak") >= max_attempts, "max_attempts_reached"),
            F.when(waiting, "backoff_active"),
            F.when(F.col("scheduler_action") == "halt", "saturation_halt"),
            F.when(F.col("scheduler_action") == "cooldown", "saturation_cooldown"),
        )
    )


def select_workspaces(workspaces: DataFrame, now: Column, limit: int) -> DataFrame:
    """Which workspaces run: eligible ones first, deprioritized ones after, the rest deferred with reasons.

    The order is global over workspaces, of which there are few; ranks come from a sorted top-k and a join.
    """
    judged = workspaces.withColumn("reasons", ineligibility(now)).withColumn("behind", F.col("scheduler_action") == "deprioritize")
    top = judged.filter(F.size("reasons") == 0).orderBy("behind", "workspace_id").limit(limit).select("workspace_id", F.lit(True).alias("chosen"))
    reason = F.when(F.col("chosen"), "").when(F.size("reasons") > 0, F.array_join("reasons", ", ")).otherwise("selection limit reached")
    return judged.join(top, "workspace_id", "left").select("workspace_id", F.coalesce("chosen", F.lit(False)).alias("selected"), reason.alias("deferral"))


def terminal_outcomes(events: DataFrame, by: str, run: str, ts: str, event: str, kind: str, success: Sequence[str], failure: Sequence[str]) -> DataFrame:
    """Per run: its last terminal event decides between success, failure and unknown."""
    last = events.groupBy(by, run).agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(event).alias("event"), F.col(kind).alias("kind"))).alias("last"))
    outcome = F.when(F.col("last.kind").isin(*success), "success").when(F.col("last.kind").isin(*failure), "failure").otherwise("unknown")
    return last.select(by, run, F.col("last.ts").alias("ts"), F.col("last.event").alias("event"), outcome.alias("outcome"))


def failure_state(outcomes: DataFrame, by: str, backoff_seconds: int = 3600, max_failures: int = 5) -> DataFrame:
    """Per group: state, the trailing failures and when the next retry is.

    The trailing streak is what came after the last run that did not fail, so one aggregation by group does it.
    """
    at = F.struct("ts", "event")
    ends = outcomes.groupBy(by).agg(
        F.max_by("outcome", at).alias("latest"), F.max(F.when(F.col("outcome") != "failure", at)).alias("last_good"), F.max(F.when(F.col("outcome") == "failure", F.col("ts"))).alias("last_failure_at")
    )
    after = outcomes.join(ends, by).filter((F.col("outcome") == "failure") & (F.col("last_good").isNull() | (at > F.col("last_good"))))
    counted = ends.join(after.groupBy(by).agg(F.count("*").alias("n")), by, "left")
    streak = F.coalesce("n", F.lit(0))
    state = F.when(F.col("latest") == "success", "healthy").when(F.col("latest") == "unknown", "blocked").when(streak >= max_failures, "blocked").otherwise("retryable_failure")
    retry = F.when(state == "retryable_failure", backoff(F.col("last_failure_at"), F.lit(backoff_seconds)))
    return counted.select(by, state.alias("state"), streak.cast("long").alias("failure_streak"), retry.alias("next_retry_at"))


def publication_counts(families: dict[str, DataFrame]) -> DataFrame:
    """Per family: public rows and withheld rows."""
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("family"), is_public(F.col("review_state"), F.col("publication_state"), F.col("public_blocker")).alias("public")) for n, df in families.items()))
    return rows.groupBy("family").agg(F.count_if("public").alias("public_rows"), F.count_if(~F.col("public")).alias("withheld_rows"))


def timeline(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(ts, kind, ref) of dated rows of several kinds."""
    return reduce(DataFrame.union, (df.select(F.col(ts).alias("ts"), F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}:"), F.col(pk).cast("string")).alias("ref")) for kind, (df, ts, pk) in sources.items()))


def assemble(records: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Records with an ordered array of structs for each kind of child."""
    out = records
    for name, child in children.items():
        columns = [c for c in child.columns if c != key]
        grouped = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return out


def attribute_map(rows: DataFrame, key: str, name: Column, value: Column) -> DataFrame:
    """(key, attributes): name-value rows as one map; of several values of a name the greatest."""
    single = rows.groupBy(key, name.alias("_name")).agg(F.max(value).alias("_value"))
    return single.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_name", "_value")))).alias("attributes"))


#: Crosswalk of work fields to the DCMI element set.
DCMI = {"title": "dcterms:title", "work_type": "dcterms:type", "rights_posture": "dcterms:rights", "raw_cite_text": "dcterms:bibliographicCitation", "first_seen_at": "dcterms:created", "last_seen_at": "dcterms:modified", "work_key_v1": "dcterms:identifier"}
PREMIS = {"event_type": "premis:eventType", "event_timestamp": "premis:eventDateTime", "provenance_event_key_v1": "premis:eventIdentifierValue", "actor": "premis:linkingAgentIdentifierValue", "note_text": "premis:eventDetail"}
RIC = {"preferred_label": "rico:name", "authority_type": "rico:hasOrHadAgentType", "authority_key_v1": "rico:identifier"}


def crosswalk(rows: DataFrame, mapping: dict[str, str], key: str) -> DataFrame:
    """(key, record): a JSON object of the mapped elements that have a value, in the mapping's order."""
    have = {c: e for c, e in mapping.items() if c in rows.columns}
    return rows.select(F.col(key).alias("key"), F.to_json(F.struct(*(F.col(c).cast("string").alias(e) for c, e in have.items()))).alias("record"))


def mapping_report(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(element, column, filled, total, status) of each element: satisfied, partial or missing."""
    have = [c for c in mapping if c in rows.columns]
    counts = rows.agg(F.count("*").alias("total"), *(F.count_if(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))).alias(c) for c in have))
    entries = F.array(*(F.struct(F.lit(e).alias("element"), F.lit(c).alias("column"), (F.col(c) if c in have else F.lit(0)).cast("long").alias("filled")) for c, e in mapping.items()))
    flat = counts.select("total", F.explode(entries).alias("x")).select("x.*", "total")
    return flat.withColumn("status", F.when(F.col("filled") == 0, "missing").when(F.col("filled") < F.col("total"), "partial").otherwise("satisfied"))
