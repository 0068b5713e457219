"""Keys, duplicates, merges and contradictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.states import first_nonblank, is_searchable
from ..functions.text import label


def work_key(explicit: Column, scheme: Column, value: Column, title: Column, work_type: Column, source: Column, year: Column, text: Column) -> Column:
    """The identity of a work: its key, an identifier, title with type and source, title and year, title, the first line."""
    named = label(title)
    has = lambda c: F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))
    part = lambda *cs: F.concat_ws("|", *cs)
    return F.coalesce(
        first_nonblank(explicit),
        F.when(has(scheme) & has(value), part(F.lit("identifier"), F.lower(scheme), F.lower(F.trim(value)))),
        F.when(has(title) & has(work_type) & has(source), part(F.lit("source"), named, work_type, source)),
        F.when(has(title) & has(year), part(F.lit("dated"), named, year.cast("string"))),
        F.when(has(title), part(F.lit("title"), named)),
        F.when(has(text), part(F.lit("line"), label(F.substring_index(F.trim(text), "\n", 1)))),
    )


def claim_key(scope: Column, claim_type: Column, about: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.coalesce(scope, F.lit("")), F.coalesce(claim_type, F.lit("")), F.coalesce(about, F.lit("")), label(F.coalesce(text, F.lit("")))), 256)


def keep_first(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_nth = 1").drop("_nth")


def match_works(candidates: DataFrame, identifiers: DataFrame, works: DataFrame) -> DataFrame:
    """candidate_id with the one work that its valid identifiers name, and whether they name several."""
    usable = works.filter(is_searchable(F.col("review_state")) & F.col("confidence_score").isNotNull()).select("work_id")
    valid = identifiers.filter("validity_status = 'valid'").select("scheme", "value", "work_id").join(usable, "work_id", "left_semi")
    hits = candidates.join(valid, ["scheme", "value"])
    return hits.groupBy("candidate_id").agg(F.min_by("work_id", "candidate_index").alias("work_id"), (F.count_distinct("work_id") > 1).alias("ambiguous"))


def match_by_locator(candidates: DataFrame, access: DataFrame) -> DataFrame:
    """(candidate_id, work_id) where the URL or the locator is the candidate's: two equi-joins, no nested loop."""
    by = lambda c: candidates.join(access.select(F.col(c).alias("locator"), "work_id").filter("locator IS NOT NULL"), "locator").select("candidate_id", "work_id")
    return by("canonical_url").union(by("original_locator")).distinct()


def match_authorities(entities: DataFrame, authorities: DataFrame) -> DataFrame:
    """Authority candidates by normal label and type: one is reviewable (0.75), several are ambiguous (0.5).

    Authorities are counted by label and type before the join, so an entity with one label and type meets one row;
    only entities with several are joined with the authorities themselves, as these may have several labels too.
    """
    key = ["label_norm", "entity_type"]
    usable = authorities.filter("merged_into_authority_record_id IS NULL").select("label_norm", F.col("authority_type").alias("entity_type"), "authority_record_id")
    counted = lambda rows, by: rows.groupBy(*by).agg(F.count_distinct("authority_record_id").alias("matches"), F.min("authority_record_id").alias("candidate"))
    named = entities.groupBy("entity_id").agg(F.collect_set(F.struct(*key)).alias("keys"))
    one = named.filter("size(keys) = 1").select("entity_id", F.col("keys")[0].alias("k")).select("entity_id", "k.*").join(counted(usable, key), key)
    several = named.filter("size(keys) > 1").select("entity_id", F.inline("keys")).join(usable, key)
    by = one.select("entity_id", "matches", "candidate").unionByName(counted(several, ["entity_id"]))
    return by.select("entity_id", "matches", F.when(F.col("matches") == 1, F.col("candidate")).alias("candidate"), F.when(F.col("matches") == 1, 0.75).otherwise(0.5).alias("match_score"), F.when(F.col("matches") == 1, "proposed").otherwise("ambiguous").alias("status"))


def repoint(rows: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    """Rows with merged ids in ``column`` replaced by their winners."""
    renamed = merges.select(F.col("loser").alias(column), F.col("winner").alias("_winner"))
    return rows.join(renamed, column, "left").withColumn(column, F.coalesce("_winner", column)).drop("_winner")


def conflicting_values(claims: DataFrame, key: Sequence[str], claim_id: str, value: str, workspace: str | None = None) -> DataFrame:
    """(low_id, high_id) of claims about one thing with different numbers.

    A null workspace on one side meets every workspace of the other; a set one meets its own and null.
    """
    rows = claims.select(*key, F.col(claim_id).alias("id"), F.col(value).alias("number"), *([F.col(workspace).alias("ws")] if workspace else []))
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    differ = (F.col("a.number") != F.col("b.number")) & (F.col("a.id") != F.col("b.id"))
    pair = [F.least("a.id", "b.id").alias("low_id"), F.greatest("a.id", "b.id").alias("high_id")]
    if not workspace:
        return a.join(b, [*same, F.col("a.id") < F.col("b.id"), F.col("a.number") != F.col("b.number")]).select(*pair)
    anywhere = a.filter("a.ws IS NULL").join(b, [*same, differ]).select(*pair)
    within = a.filter("a.ws IS NOT NULL").join(b, [*same, F.col("a.ws") == F.col("b.ws"), differ]).select(*pair)
    return anywhere.unionByName(within).distinct()


def life_facts(claims: DataFrame, birth_types: Sequence[str], death_types: Sequence[str]) -> DataFrame:
    """(ref, birth_min, birth_max, death_min, death_max) from dated claims."""
    when = lambda kinds: F.when(F.col("claim_type").isin(*kinds), F.col("year"))
    known = claims.filter(F.col("claim_type").isin(*birth_types, *death_types) & F.col("year").isNotNull() & ~F.coalesce(F.col("review_state"), F.lit("")).isin(vocab.EXCLUDED))
    return known.groupBy(F.col("about_object_ref").alias("ref")).agg(F.min(when(birth_types)).alias("birth_min"), F.max(when(birth_types)).alias("birth_max"), F.min(when(death_types)).alias("death_min"), F.max(when(death_types)).alias("death_max"))


def impossible_relations(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """(edge_id, problem): a teacher dead before the pupil's birth, lives that don't meet, an event outside a life."""
    side = lambda p: facts.select(*(F.col(c).alias(f"{p}_{c}") for c in facts.columns))
    joined = edges.join(side("from"), F.col("from_object_ref") == F.col("from_ref"), "left").join(side("to"), F.col("to_object_ref") == F.col("to_ref"), "left")
    apart = (F.col("from_birth_min") > F.col("to_death_max")) | (F.col("to_birth_min") > F.col("from_death_max"))
    outside = lambda p: (F.col("year") < F.col(f"{p}_birth_min")) | (F.col("year") > F.col(f"{p}_death_max"))
    problem = (
        F.when((F.col("predicate") == "taught_by") & (F.col("from_birth_max") > F.col("to_death_min")), "teacher_dead_before_birth")
        .when((F.col("predicate") == "teacher_of") & (F.col("to_birth_max") > F.col("from_death_min")), "teacher_dead_before_birth")
        .when((F.col("predicate") == "met") & apart, "lives_do_not_meet")
        .when(F.col("year").isNotNull() & (outside("from") | outside("to")), "event_outside_life")
    )
    return joined.select("edge_id", problem.alias("problem")).filter("problem IS NOT NULL")


def first_per_group(pairs: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first hit of each group; the rest of a group's hits are not reported."""
    return keep_first(pairs, group, [F.col(c) for c in order])


def correction_lineage(events: DataFrame) -> DataFrame:
    """(ref, status, superseded_by): current unless some event took it as a source; the earliest event counts.

    ``events`` has event_id, changed_at, sources and results (arrays of references).
    """
    taken = events.select(F.explode("sources").alias("ref"), "changed_at", "event_id").groupBy("ref").agg(F.min_by("event_id", F.struct("changed_at", "event_id")).alias("superseded_by"))
    seen = events.select(F.explode(F.array_union("sources", "results")).alias("ref")).distinct()
    return seen.join(taken, "ref", "left").select("ref", F.when(F.col("superseded_by").isNull(), "current").otherwise("superseded").alias("status"), "superseded_by")
