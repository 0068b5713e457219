"""Review decisions of six actions, applied in their order.

Decisions hold target (``type:id``), action, reviewer, reason, expected_state,
decided_at and arrival.  They apply in the order of (decided_at, arrival), so the
order of rows means nothing.  Each target's decisions fold over its state: one
pass of sorted rows, a target in one task.

A decision is refused (with a reason) where its target, action, reviewer,
expected state or merge doesn't hold; one that finds its state already there is
``already_applied``; an established state stays, though the decision is recorded.
Of merges of one authority the first counts, others into another winner are
refused.  References follow merges in the order of time: what was moved to an
authority before that one was merged moves on with it.  The authority that an
entity's reconciliation stands for is the one before the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import vocab
from ..functions.values import content_id, instant
from ..session import use_checkpoint_dir

#: The aliases of target types, each action's target types and the state that it leads to.
TARGETS = {
    "authority_reconciliation": "authority_reconciliation",
    "authrec": "authority_reconciliation",
    "claim": "source_claim",
    "source_claim": "source_claim",
    "relationship": "source_relationship",
    "source_relationship": "source_relationship",
}
ACTIONS = {
    "accept_merge": (["authority_reconciliation"], "accepted"),
    "reject_merge": (["authority_reconciliation"], "rejected"),
    "reject_claim": (["source_claim"], "rejected"),
    "mark_contradicted": (["source_claim", "source_relationship"], "needs_review"),
    "reject_relationship": (["source_relationship"], "rejected"),
    "resolve_contradiction": (["source_relationship"], "reviewed"),
}
MERGES = ["accept_merge", "reject_merge"]
KEYS = {"source_claim": "source_claim_id", "source_relationship": "source_relationship_id", "authority_reconciliation": "authority_reconciliation_id"}


def _lookup(name: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), name)


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "-", "_")


def merge_decisions(decisions: DataFrame) -> DataFrame:
    """Those that merge or refuse to: no other action fits a reconciliation, so merges come out the same without the rest."""
    return decisions.filter(_clean(F.col("action")).isin(*MERGES))


def _targets(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, state, predicate, winner, loser) of everything that may be decided on."""
    entity = tables["extraction_detected_entity"].select("detected_entity_id", F.col("authority_record_id").alias("of_entity"))
    rec = tables["authority_reconciliation"].join(entity, "detected_entity_id", "left")
    loser = F.when(F.col("target_namespace") == "authority_record", F.expr("try_cast(target_id AS BIGINT)")).when(F.col("target_namespace") == "extraction_detected_entity", F.col("of_entity"))
    none = F.lit(None).cast("long")
    rows = rec.select(F.lit("authority_reconciliation").alias("kind"), F.col("authority_reconciliation_id").alias("id"), "review_state", F.lit(None).cast("string").alias("predicate"), F.coalesce("candidate_authority_record_id", "accepted_authority_id").alias("winner"), loser.alias("loser"))
    for kind, predicate in (("source_claim", F.lit(None).cast("string")), ("source_relationship", F.col("predicate"))):
        rows = rows.unionByName(tables[kind].select(F.lit(kind).alias("kind"), F.col(KEYS[kind]).alias("id"), "review_state", predicate.alias("predicate"), none.alias("winner"), none.alias("loser")))
    authority = tables["authority_record"].select("authority_record_id", "authority_type", "merged_into_authority_record_id")
    named = lambda side: authority.select(F.col("authority_record_id").alias(side), F.col("authority_type").alias(f"{side}_type"), F.col("merged_into_authority_record_id").alias(f"{side}_into"))
    return rows.join(named("winner"), "winner", "left").join(named("loser"), "loser", "left")


def _judged(decisions: DataFrame, targets: DataFrame) -> DataFrame:
    """Decisions with their targets and what refuses them whatever their turn."""
    given = F.regexp_extract("target", r"^(.*):\s*([+-]?\d+)\s*$", 1)
    d = decisions.withColumn("action", _clean(F.col("action"))).withColumn("kind", _lookup(_clean(given), TARGETS)).withColumn("id", F.expr(r"try_cast(trim(regexp_extract(target, '^(.*):\\s*([+-]?\\d+)\\s*$', 2)) AS BIGINT)"))
    d = d.withColumn("new_state", _lookup(F.col("action"), {a: s for a, (_, s) in ACTIONS.items()})).withColumn("at", instant(F.col("decided_at")))
    fits = F.lit(False)
    for action, (kinds, _) in ACTIONS.items():
        fits = fits | ((F.col("action") == action) & F.col("kind").isin(*kinds))
    joined = d.join(targets.withColumn("found", F.lit(True)), ["kind", "id"], "left")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    merge = F.col("action") == "accept_merge"
    refusal = (
        F.when(blank("reviewer"), "reviewer is required")
        .when(blank("reason"), "reason is required")
        .when(F.col("kind").isNull() | F.col("id").isNull(), "unsupported target")
        .when(F.col("new_state").isNull(), "unsupported action")
        .when(F.col("at").isNull(), "decided_at is no instant")
        .when(~fits, "action does not fit the target")
        .when(F.col("found").isNull(), "unknown target")
        .when((F.col("action") == "resolve_contradiction") & ~F.coalesce(F.col("predicate") == "contradicts", F.lit(False)), "not a contradiction")
        .when(merge & (F.col("winner").isNull() | F.col("loser").isNull()), "no authorities to merge")
        .when(merge & (F.col("winner") == F.col("loser")), "cannot merge an authority into itself")
        .when(merge & (F.col("winner_type").isNull() | F.col("loser_type").isNull()), "unknown authority")
        .when(merge & (F.col("winner_type") != F.col("loser_type")), "authority types are incompatible")
        .when(merge & F.col("loser_into").isNotNull() & (F.col("loser_into") != F.col("winner")), "already merged into another authority")
    )
    order = F.struct("at", "arrival", F.xxhash64("target", "action", "reviewer", "reason", "expected_state", "decided_at").alias("tie"))
    return joined.withColumn("refusal", refusal).withColumn("turn", order)


#: What a row of the fold is read by, in this order.
_READ = ["kind", "id", "refusal", "action", "expected_state", "new_state", "review_state", "loser_into", "winner"]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds before, after and status to decisions in the order of kind, id and turn; a target may go on in the next batch."""
    target, now, merged = None, None, False
    for batch in batches:
        rows: list[tuple] = []
        for kind, key, refusal, action, expected, new, first, into, winner in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _READ), strict=True):
            if refusal is not None:
                rows.append((None, None, None))
                continue
            if (kind, key) != target:
                target, now, merged = (kind, key), first, False
            before, merge = now, action == "accept_merge"
            if expected is not None and expected != now:
                status = "refused: expected another state"
            elif (now == "accepted" and (merged or into == winner)) if merge else now == new:
                status = "already_applied"
            elif action not in MERGES and now is not None and now.strip(" ").lower() in vocab.ESTABLISHED:
                status = "recorded"
            else:
                status, now, merged = "completed", new, merged or merge
            rows.append((before, now, status))
        more = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *_ADDED])


_ADDED = ["before", "after", "status"]


def _folded(judged: DataFrame) -> DataFrame:
    """Decisions with before, after and status, which are null where a decision is refused by itself.

    One shuffle and one sort, and a pass that holds a target's state alone, however many decide on it.
    """
    dealt = judged.repartition("kind", "id", F.when(F.col("refusal").isNotNull(), F.col("arrival"))).sortWithinPartitions("kind", "id", "turn")
    return dealt.mapInArrow(_apply, StructType([*judged.schema.fields, *(StructField(c, StringType()) for c in _ADDED)]))


def outcomes(tables: dict[str, DataFrame], decisions: DataFrame) -> DataFrame:
    """Every decision with its target, turn, ``before``, ``after``, ``status`` and ``refusal``; equal rows are one.

    A merge that comes too late is refused, which may change what its target's
    later decisions meet: reconciliations fold again until no more are refused.
    """
    use_checkpoint_dir(decisions.sparkSession)
    found = _folded(_judged(decisions.distinct(), _targets(tables))).checkpoint()
    merges = F.coalesce(F.col("kind") == "authority_reconciliation", F.lit(False))
    settled, out = found.filter(~merges), found.filter(merges)
    while True:
        accepts = out.filter((F.col("action") == "accept_merge") & F.col("refusal").isNull())
        first = accepts.filter(F.col("status") == "completed").groupBy("loser").agg(F.min(F.struct("turn", "winner")).alias("first"))
        late = accepts.join(first, "loser").filter((F.col("winner") != F.col("first.winner")) & (F.col("turn") > F.col("first.turn"))).select("kind", "id", "turn", F.lit(True).alias("late"))
        if late.isEmpty():
            return settled.unionByName(out).withColumn("status", F.coalesce("status", F.concat(F.lit("refused: "), "refusal")))
        again = out.drop(*_ADDED).join(late, ["kind", "id", "turn"], "left")
        out = _folded(again.withColumn("refusal", F.coalesce("refusal", F.when(F.col("late"), "already merged into another authority"))).drop("late")).checkpoint()


def merge_edges(found: DataFrame) -> DataFrame:
    """(loser, winner, turn, decided_at, reviewer, reason): each merged authority's first merge."""
    merged = found.filter((F.col("action") == "accept_merge") & (F.col("status") == "completed"))
    return merged.groupBy("loser").agg(F.min(F.struct("turn", "winner", "decided_at", "reviewer", "reason")).alias("x")).select("loser", "x.*")


def final_authorities(edges: DataFrame) -> DataFrame:
    """(loser, authority, decided_at): where a merged authority's references end, by merges in the order of time."""
    edges = edges.select("loser", "winner", "turn", "decided_at").checkpoint()
    now = edges.select("loser", F.col("winner").alias("authority"), "turn", "decided_at")
    step = edges.select(F.col("loser").alias("authority"), F.col("winner").alias("next"), F.col("turn").alias("next_turn"), F.col("decided_at").alias("next_at"))
    while True:
        moved = now.join(step, "authority", "left").withColumn("on", F.coalesce(F.col("next_turn") > F.col("turn"), F.lit(False)))
        moves = moved.filter("on").isEmpty()
        if moves:
            return now.select("loser", "authority", "decided_at")
        pick = lambda new, old: F.when(F.col("on"), F.col(new)).otherwise(F.col(old)).alias(old)
        now = moved.select("loser", pick("next", "authority"), pick("next_turn", "turn"), pick("next_at", "decided_at")).checkpoint()


def apply_decisions(tables: dict[str, DataFrame], decisions: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """(changed tables, rows to append by table, outcome of every decision).

    ``tables`` has the three decided families, extraction_detected_entity, work_subject and authority_record.
    """
    found = outcomes(tables, decisions)
    done = found.filter(F.col("status") == "completed")
    changed: dict[str, DataFrame] = {}
    candidates = tables["authority_reconciliation"].select(F.lit("authority_reconciliation").alias("kind"), F.col("authority_reconciliation_id").alias("id"), F.col("candidate_authority_record_id").alias("candidate"))
    last = done.join(candidates, ["kind", "id"], "left").groupBy("kind", "id").agg(
        F.max_by("after", "turn").alias("decided_state"), F.max_by("decided_at", "turn").alias("decided"), F.max_by("winner", F.when(F.col("action") == "accept_merge", F.col("turn"))).alias("accepted"), F.max(F.when(F.col("action") == "reject_merge", F.col("candidate"))).alias("turned_down"),
    )
    for kind, pk in KEYS.items():
        rows = tables[kind].join(last.filter(F.col("kind") == kind).drop("kind"), F.col(pk) == F.col("id"), "left")
        hit = F.col("decided").isNotNull()
        new = {"review_state": F.when(hit, F.col("decided_state")), "record_last_updated": F.col("decided")}
        if kind == "authority_reconciliation":
            listed = F.coalesce(F.from_json("rejected_candidate_ids_json", "array<bigint>"), F.array().cast("array<bigint>"))
            more = F.when(F.array_contains(listed, F.col("turned_down")), listed).otherwise(F.array_append(listed, F.col("turned_down")))
            new |= {"accepted_authority_id": F.col("accepted"), "rejected_candidate_ids_json": F.when(F.col("turned_down").isNotNull(), F.to_json(more))}
        changed[kind] = rows.select(*(F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in tables[kind].columns))

    edges = merge_edges(found)
    ends = final_authorities(edges)
    for name in ("extraction_detected_entity", "work_subject"):
        moved = tables[name].join(ends.withColumnRenamed("decided_at", "moved_at"), F.col("authority_record_id") == F.col("loser"), "left")
        new = {"authority_record_id": F.col("authority"), "record_last_updated": F.col("moved_at")}
        changed[name] = moved.select(*(F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in tables[name].columns))
    authority = tables["authority_record"].join(edges.select(F.col("loser").alias("authority_record_id"), "winner", "decided_at", "turn"), "authority_record_id", "left")
    demoted = F.col("winner").isNotNull() & ~F.coalesce(F.lower(F.trim("review_state")).isin(*vocab.ESTABLISHED, "demoted"), F.lit(False))
    new = {"merged_into_authority_record_id": F.col("winner"), "reconciliation_status": F.when(F.col("winner").isNotNull(), "merged"), "record_last_updated": F.col("decided_at"), "review_state": F.when(demoted, "demoted")}
    changed["authority_record"] = authority.select(*(F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in tables["authority_record"].columns))

    known = found.filter(F.col("status").isin("completed", "recorded"))
    key = content_id("review-decision", F.col("kind"), F.col("id"), F.col("action"), F.col("reviewer"), F.col("reason"), F.col("decided_at"))
    events = known.select(
        key.alias("provenance_event_key_v1"), F.col("kind").alias("object_namespace"), F.col("id").cast("string").alias("object_id"), F.concat(F.lit("review_decision_"), "action").alias("event_type"), F.col("reviewer").alias("actor"),
        F.col("kind").alias("source_object_namespace"), F.col("id").cast("string").alias("source_object_id"), F.col("decided_at").alias("event_timestamp"), F.col("reason").alias("note_text"),
    )
    changes = done.filter(~F.col("before").eqNullSafe(F.col("after"))).select(F.col("kind").alias("target_namespace"), F.col("id").cast("string").alias("target_id"), F.col("before").alias("previous_state"), F.col("after").alias("new_state"), F.col("reviewer").alias("changed_by"), F.col("decided_at").alias("changed_at"), F.col("action").alias("reason"))
    losers = authority.filter(demoted).select(F.lit("authority_record").alias("target_namespace"), F.col("authority_record_id").cast("string").alias("target_id"), F.col("review_state").alias("previous_state"), F.lit("demoted").alias("new_state"), F.lit("canonical_reconciliation").alias("changed_by"), F.col("decided_at").alias("changed_at"), F.lit("accept_merge").alias("reason"))
    history = changes.unionByName(losers)
    history = history.withColumn("history_id", content_id("history", *(F.col(c) for c in history.columns)))
    merges = edges.select(F.col("loser").alias("from_authority_record_id"), F.col("winner").alias("into_authority_record_id"), F.lit("review_decision_accept_merge").alias("merge_reason"))
    return changed, {"provenance_event": events, "review_state_history": history, "authority_merge_event": merges}, found
