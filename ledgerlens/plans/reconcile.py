"""The reconciliation pass after an ingest: contradictions of the claims and relationships that it brought.

Evaluation is semi-naive: the rows of one provenance event (the delta) are joined with the stored state on the keys
that the event touched; the rest of the store is only scanned.  A pass that has run already finds its own edges and
states in the store and commits nothing.

Defined results: payloads that are no JSON object, and blank or unreadable numbers, years and references, take no part.
A workspace that is null on the event's side meets every workspace; a set one meets only itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas, vocab
from ..functions.states import first_nonblank
from ..functions.values import year
from ..operators.upsert import Snapshot, assign_ids, insert_new
from ..session import use_checkpoint_dir

# Fixed values of the contract: states, rules, claim types and predicates.
STATE = "needs_review"
CONTRADICTS = "contradicts"
QUANTITY_CONFLICT = "structured_quantity_conflict"
TAUGHT_BY_IMPOSSIBLE = "structured_taught_by_impossible_life_overlap"
LIFESPAN_OVERLAP = "relational_temporal_lifespan_overlap"
EVENT_OUTSIDE = "relational_temporal_event_year_outside_lifespan"
BIRTH_TYPES = ["birth_year", "birth_date", "date_of_birth", "born"]
DEATH_TYPES = ["death_year", "death_date", "date_of_death", "died"]
TAUGHT_BY_TYPES = ["taught_by", "relationship_taught_by"]
CONSTRAINED = ["taught_by", "teacher_of", "met", "influenced"]

_FACT_YEARS = ["year", "value", "date", "birth_year", "death_year", "event_year", "event_date"]
_EDGE_YEARS = ["event_year", "event_date", "year", "date"]
_PAYLOAD = [*_FACT_YEARS, "numeric_value", "about_object_ref", "from_object_ref", "subject_object_ref", "to_object_ref", "object_object_ref", "claim_type", "predicate"]
#: What a finding says: the edge that records it and the rows that go back to review.
FINDING = ["rule", "namespace", "offending_id", "target_claim_id", "workspace_id", "provenance_event_ref", "rationale", "second_namespace", "second_id"]


def _first(payload: str, keys: list[str]) -> Column:
    return F.coalesce(*(F.get_json_object(payload, f"$.{k}") for k in keys))


def _folded(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _excluded(c: str = "review_state") -> Column:
    return F.coalesce(F.lower(F.trim(F.col(c))).isin(vocab.EXCLUDED), F.lit(False))


def _whole(number: Column) -> Column:
    return F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def _scope(workspace: str = "workspace_id") -> Column:
    """The workspace that a row of the event looks in: its own, or all of them."""
    return F.coalesce(F.concat(F.lit("="), F.col(workspace)), F.lit("*"))


def _scopes(rows: DataFrame) -> DataFrame:
    """Stored rows once for their own workspace and once for those that look everywhere, so that one equi-join finds them."""
    return rows.withColumn("scope", F.explode(F.array_compact(F.array(F.concat(F.lit("="), F.col("workspace_id")), F.lit("*")))))


def _touched(rows: DataFrame, event: str | None) -> DataFrame:
    return rows if event is None else rows.filter(F.col("provenance_event_ref") == event)


def structured(claims: DataFrame) -> DataFrame:
    """Claims whose text is a JSON object, with the fields that the rules read; each text is parsed once."""
    text = lambda *keys: first_nonblank(*(F.col(f"_p.{k}") for k in keys))
    number = F.coalesce(*(F.col(f"_p.{k}").try_cast("double") for k in ("value", "numeric_value", "year")))
    dated = lambda keys: year(F.coalesce(*(F.col(f"_p.{k}") for k in keys)))
    parsed = claims.filter(F.ltrim("claim_text").startswith("{")).withColumn("_p", F.from_json("claim_text", ", ".join(f"{k} string" for k in _PAYLOAD)))
    return parsed.select(
        "source_claim_id", "workspace_id", "provenance_event_ref", "about_object_ref", F.col("claim_type").alias("stored_type"), _excluded().alias("excluded"),
        first_nonblank(F.col("about_object_ref"), text("about_object_ref", "from_object_ref", "subject_object_ref")).alias("about"), first_nonblank(F.col("claim_type"), text("claim_type")).alias("claim_type"), _folded(text("predicate")).alias("predicate"),
        text("from_object_ref", "about_object_ref").alias("from_ref"), text("to_object_ref", "object_object_ref").alias("to_ref"), number.alias("number"), dated(["year", "value"]).alias("plain_year"), dated(_FACT_YEARS).alias("fact_year"),
    )


def _finding(rule: str | Column, namespace: str, rationale: Column, second_namespace: str | None = None, second_id: str | None = None) -> list[Column]:
    none = F.lit(None)
    return [
        F.lit(rule).alias("rule"), F.lit(namespace).alias("namespace"), "offending_id", "target_claim_id", "workspace_id", "provenance_event_ref", rationale.alias("rationale"),
        F.lit(second_namespace).cast("string").alias("second_namespace"), (F.col(second_id) if second_id else none).cast("bigint").alias("second_id"),
    ]


def quantity_conflicts(claims: DataFrame, event: str | None = None) -> DataFrame:
    """Findings for claims of the event and stored claims about the same thing, of the same type, with another number."""
    known = structured(claims).filter("number IS NOT NULL AND NOT excluded")
    left = _touched(known, event).filter("about IS NOT NULL AND claim_type IS NOT NULL").select("source_claim_id", "workspace_id", "provenance_event_ref", "about", "claim_type", "number", _scope().alias("scope"))
    peers = _scopes(known.filter("about_object_ref IS NOT NULL")).select(F.col("source_claim_id").alias("peer_id"), "about", F.col("stored_type").alias("claim_type"), F.col("number").alias("peer_number"), "scope")
    pairs = left.join(peers, ["about", "claim_type", "scope"]).filter("peer_id != source_claim_id AND peer_number != number")
    low = F.col("source_claim_id") < F.col("peer_id")
    a, b = (F.when(low, F.col(x)).otherwise(F.col(y)) for x, y in (("number", "peer_number"), ("peer_number", "number")))
    placed = pairs.withColumns({"offending_id": F.least("source_claim_id", "peer_id"), "target_claim_id": F.greatest("source_claim_id", "peer_id")})
    rationale = F.concat(F.lit("structured claim conflict for "), "about", F.lit(" "), "claim_type", F.lit(": "), _whole(a), F.lit(" versus "), _whole(b))
    found = placed.select(*_finding(QUANTITY_CONFLICT, "source_claim", rationale, "source_claim", "target_claim_id"))
    key = [c for c in FINDING if c != "provenance_event_ref"]
    return found.groupBy(*key).agg(F.min("provenance_event_ref").alias("provenance_event_ref")).select(*FINDING)


def impossible_teachers(claims: DataFrame, relationships: DataFrame, event: str | None = None) -> DataFrame:
    """One finding for each group of teacher claims (event, workspace, subject, type): the first claim whose subject was born after the teacher's death.

    A claim's first such birth is one that is later than the least death, so births meet one row for each teacher and
    no birth is paired with every death.
    """
    known = structured(claims)
    taught = _folded(F.col("claim_type")).isin(TAUGHT_BY_TYPES) | (F.col("predicate") == "taught_by")
    left = _touched(known, event).filter(taught & F.col("about").isNotNull() & F.col("to_ref").isNotNull()).withColumn("scope", _scope())
    dated = known.filter("plain_year IS NOT NULL AND NOT excluded AND about_object_ref IS NOT NULL")
    lives = lambda kind, ref: _scopes(dated.filter(F.col("stored_type") == kind)).select("scope", F.col("about_object_ref").alias(ref), F.col("source_claim_id").alias("fact_id"), F.col("plain_year").alias("fact_year"))
    births, deaths = lives("birth_year", "about"), lives("death_year", "to_ref")
    least = deaths.groupBy("scope", "to_ref").agg(F.min("fact_year").alias("least_death"))
    base = left.select("source_claim_id", "scope", "about", "to_ref", "workspace_id", "provenance_event_ref", "about_object_ref", "stored_type", "excluded").join(least, ["scope", "to_ref"])
    late = base.join(births, ["scope", "about"]).filter("fact_year > least_death")
    group = ["provenance_event_ref", "workspace_id", "about_object_ref", "stored_type"]
    first = late.groupBy(*group).agg(F.min_by(F.struct("source_claim_id", "scope", "about", "to_ref", "excluded", F.col("fact_year").alias("born")), F.struct("source_claim_id", "fact_id")).alias("x"))
    first = first.select(*group, "x.*").filter("NOT excluded")
    dead = first.join(deaths, ["scope", "to_ref"]).filter("fact_year < born").groupBy("source_claim_id", "about", "to_ref", "born", "workspace_id", "provenance_event_ref").agg(F.min_by(F.struct("fact_id", "fact_year"), "fact_id").alias("d"))
    edges = relationships.filter("predicate = 'taught_by'").select("provenance_event_ref", F.col("from_object_ref").alias("about"), F.col("to_object_ref").alias("to_ref"), "source_relationship_id")
    edge = dead.join(edges, ["provenance_event_ref", "about", "to_ref"], "left").groupBy("source_claim_id", "about", "to_ref", "born", "workspace_id", "provenance_event_ref", "d").agg(F.min("source_relationship_id").alias("edge_id"))
    rationale = F.concat(F.lit("claim says "), "about", F.lit(" was taught_by "), "to_ref", F.lit(", but subject birth year "), F.col("born").cast("string"), F.lit(" is after object death year "), F.col("d.fact_year").cast("string"))
    named = edge.withColumns({"offending_id": F.col("source_claim_id"), "target_claim_id": F.col("d.fact_id")})
    return named.select(*_finding(TAUGHT_BY_IMPOSSIBLE, "source_claim", rationale, "source_relationship", "edge_id"))


def constrained_edges(claims: DataFrame, relationships: DataFrame, event: str | None = None) -> DataFrame:
    """Relationships of the event that a rule constrains, each with whether a structured teacher claim of its event says the same."""
    edges = _touched(relationships, event).withColumn("kind", _folded(F.col("predicate"))).filter(F.col("kind").isin(CONSTRAINED) & F.col("to_object_ref").isNotNull())
    said = structured(_touched(claims, event)).filter(F.col("stored_type").isin(TAUGHT_BY_TYPES))
    said = said.select("provenance_event_ref", F.col("from_ref").alias("from_object_ref"), F.col("to_ref").alias("to_object_ref"), F.when(F.col("predicate") != "", F.col("predicate")).otherwise(F.lower("stored_type")).alias("kind"), F.lit(True).alias("said")).distinct()
    when = F.when(F.ltrim("evidence_note").startswith("{"), year(_first("evidence_note", _EDGE_YEARS)))
    joined = edges.join(said, ["provenance_event_ref", "from_object_ref", "to_object_ref", "kind"], "left")
    return joined.select(F.col("source_relationship_id").alias("edge_id"), "kind", "from_object_ref", "to_object_ref", "workspace_id", "provenance_event_ref", when.alias("event_year"), F.coalesce("said", F.lit(False)).alias("counterpart"))


def _lives(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """(edge_id, role, kind, year, fact_id, event_year): the dated births and deaths of an edge's ends."""
    ends = [edges.select("edge_id", "event_year", F.lit(role).alias("role"), F.col(c).alias("ref"), _scope().alias("scope")) for role, c in (("subject", "from_object_ref"), ("object", "to_object_ref"))]
    dated = claims.filter(F.col("claim_type").isin(BIRTH_TYPES + DEATH_TYPES) & F.col("about_object_ref").isNotNull())
    facts = _scopes(structured(dated).filter("fact_year IS NOT NULL AND NOT excluded"))
    kind = F.when(F.col("stored_type").isin(BIRTH_TYPES), "birth").otherwise("death")
    return ends[0].unionByName(ends[1]).join(facts.select(F.col("about_object_ref").alias("ref"), "scope", kind.alias("fact"), F.col("fact_year").alias("year"), F.col("source_claim_id").alias("fact_id")), ["ref", "scope"])


def impossible_edges(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Findings for ``constrained_edges``: a pupil born after the teacher's death, people that met without common years, an event outside a life."""
    checked = edges.filter("NOT counterpart AND kind != 'influenced' AND trim(to_object_ref) != ''")
    lives = _lives(checked, claims)
    start = F.concat(F.lit("relationship "), F.col("edge_id").cast("string"), F.lit(" predicate "), "kind")
    info = checked.withColumns({"offending_id": F.col("edge_id")})
    number = lambda c: F.col(c).cast("string")

    # teacher and pupil: distinct years of birth against each claim of a death
    born = lives.filter("fact = 'birth'").select("edge_id", "role", F.col("year").alias("born")).distinct()
    died = lives.filter("fact = 'death'").select("edge_id", F.col("role").alias("dead_role"), F.col("year").alias("died"), F.col("fact_id").alias("target_claim_id"))
    pupil = F.when(F.col("kind") == "taught_by", "subject").when(F.col("kind") == "teacher_of", "object")
    taught = info.withColumn("role", pupil).filter("role IS NOT NULL").join(born, ["edge_id", "role"]).join(died, "edge_id").filter("role != dead_role AND born > died")
    told = F.concat(start, F.lit(" is impossible: "), "role", F.lit(" birth year "), number("born"), F.lit(" is after "), "dead_role", F.lit(" death year "), number("died"))
    first = taught.select(*_finding(LIFESPAN_OVERLAP, "source_relationship", told))

    # lives as a whole, an aggregation for each edge
    at = lambda role, fact: (F.col("role") == role) & (F.col("fact") == fact)
    one = lambda agg, role, fact: agg(F.when(at(role, fact), F.col("year")))
    beyond = lambda role, fact, test: F.min_by(F.when(at(role, fact) & test, F.struct("fact_id", "year")), F.when(at(role, fact) & test, F.col("fact_id")))
    measures = {}
    for role in ("subject", "object"):
        measures |= {f"{role}_born": one(F.min, role, "birth"), f"{role}_died": one(F.max, role, "death"), f"{role}_death": F.min(F.when(at(role, "death"), F.col("fact_id")))}
        measures |= {f"{role}_before": beyond(role, "birth", F.col("event_year") < F.col("year")), f"{role}_after": beyond(role, "death", F.col("event_year") > F.col("year"))}
    whole = info.join(lives.groupBy("edge_id").agg(*(c.alias(name) for name, c in measures.items())), "edge_id")
    ahead = F.col("subject_born") > F.col("object_died")
    behind = ~F.coalesce(ahead, F.lit(False)) & (F.col("object_born") > F.col("subject_died"))
    said = []
    for test, born_role, dead_role in ((ahead, "subject", "object"), (behind, "object", "subject")):
        told = F.concat(F.lit("relationship "), number("edge_id"), F.lit(f" predicate met is impossible: {born_role} birth year "), number(f"{born_role}_born"), F.lit(f" is after {dead_role} death year "), number(f"{dead_role}_died"))
        said.append(F.when((F.col("kind") == "met") & test, F.struct(F.lit(LIFESPAN_OVERLAP).alias("rule"), F.col(f"{dead_role}_death").alias("target"), told.alias("told"))))
    for role, ref in (("subject", "from_object_ref"), ("object", "to_object_ref")):
        before, after = F.col(f"{role}_before"), F.col(f"{role}_after")
        fact = F.coalesce(before, after)
        told = F.concat(start, F.lit(" has event year "), number("event_year"), F.when(before.isNotNull(), " before birth year ").otherwise(" after death year "), fact["year"].cast("string"), F.lit(f" for {role} "), ref)
        said.append(F.when(fact.isNotNull(), F.struct(F.lit(EVENT_OUTSIDE).alias("rule"), fact["fact_id"].alias("target"), told.alias("told"))))
    each = whole.withColumn("x", F.explode(F.array_compact(F.array(*said)))).withColumn("target_claim_id", F.col("x.target"))
    return first.unionByName(each.select(*_finding(F.col("x.rule"), "source_relationship", F.col("x.told"))))


def findings(claims: DataFrame, relationships: DataFrame, event: str | None = None) -> DataFrame:
    """Every contradiction that the event brought (without an event: those of the whole store), in columns ``FINDING``."""
    parts = [quantity_conflicts(claims, event), impossible_teachers(claims, relationships, event), impossible_edges(constrained_edges(claims, relationships, event), claims)]
    return reduce(DataFrame.unionByName, parts)


def edges_of(found: DataFrame, changed_at: str) -> DataFrame:
    """Findings as rows of ``source_relationship`` that wait for review."""
    ref = lambda namespace, c: F.concat(namespace, F.lit(":"), F.col(c).cast("string"))
    rows = found.select(
        ref(F.col("namespace"), "offending_id").alias("from_object_ref"), ref(F.lit("source_claim"), "target_claim_id").alias("to_object_ref"), F.lit(CONTRADICTS).alias("predicate"), F.col("rule").alias("target_label"), F.col("rationale").alias("evidence_note"), F.lit(STATE).alias("review_state"),
        "workspace_id", F.lit(1.0).alias("confidence_score"), "provenance_event_ref", F.lit(changed_at).alias("created_at"), F.lit(changed_at).alias("record_last_updated"),
    )
    return schemas.conform(rows, "source_relationship")


def reopened(found: DataFrame) -> DataFrame:
    """(target_namespace, id, reason, note): the rows that findings send back to review, each by its first finding in the order of rule and rationale."""
    sides = [found.select(F.col(n).alias("target_namespace"), F.col(i).alias("id"), "rule", "rationale") for n, i in (("namespace", "offending_id"), ("second_namespace", "second_id"))]
    named = sides[0].unionByName(sides[1]).filter("id IS NOT NULL")
    first = named.groupBy("target_namespace", "id").agg(F.min(F.struct("rule", "rationale")).alias("x"))
    return first.select("target_namespace", "id", F.col("x.rule").alias("reason"), F.col("x.rationale").alias("note"))


def _reopen(rows: DataFrame, targets: DataFrame, namespace: str, changed_at: str) -> tuple[DataFrame, DataFrame]:
    """(rows with reopened states, history rows); established rows and those in review already stay."""
    pk = f"{namespace}_id"
    mine = targets.filter(F.col("target_namespace") == namespace).select(F.col("id").alias(pk), "reason")
    moves = ~F.coalesce(F.lower(F.trim("review_state")).isin(vocab.ESTABLISHED), F.lit(False)) & ~F.col("review_state").eqNullSafe(F.lit(STATE))
    joined = rows.join(mine, pk, "left").withColumn("_moves", F.col("reason").isNotNull() & moves)
    after = {"review_state": F.when(F.col("_moves"), STATE).otherwise(F.col("review_state")), "record_last_updated": F.when(F.col("_moves"), changed_at).otherwise(F.col("record_last_updated"))}
    history = joined.filter("_moves").select(
        F.sha2(F.concat_ws("|", F.lit(namespace), F.col(pk).cast("string"), F.coalesce("review_state", F.lit("")), F.lit(STATE), F.lit(changed_at)), 256).alias("history_id"), F.lit(namespace).alias("target_namespace"), F.col(pk).cast("string").alias("target_id"),
        F.col("review_state").alias("previous_state"), F.lit(STATE).alias("new_state"), F.lit("reconciliation").alias("changed_by"), F.lit(changed_at).alias("changed_at"), "reason",
    )
    return joined.withColumns(after).select(*rows.columns), schemas.conform(history, "review_state_history")


def reconcile(store: Snapshot, event: str, changed_at: str) -> dict[str, int]:
    """Record what an ingest contradicts, in one commit; the counts of the pass.

    Edges that the store holds and states that need no change are left alone; where nothing is left, nothing is committed.
    """
    use_checkpoint_dir(store.spark)
    claims, relationships, history = (store.table(t) for t in ("source_claim", "source_relationship", "review_state_history"))
    edges = constrained_edges(claims, relationships, event)
    found = findings(claims, relationships, event).checkpoint()
    key = schemas.IDENTITY["source_relationship"]
    fresh = insert_new(relationships, edges_of(found, changed_at), key, ["provenance_event_ref"]).checkpoint()
    targets = reopened(found)
    claims_after, claim_moves = _reopen(claims, targets, "source_claim", changed_at)
    edges_after, edge_moves = _reopen(relationships, targets, "source_relationship", changed_at)
    moves = claim_moves.unionByName(edge_moves).checkpoint()
    counted = edges.agg(F.count_if(~F.col("counterpart")).alias("checked"), F.count_if(F.col("counterpart")).alias("suppressed")).first()
    by_family = {r["from_claim"]: r["n"] for r in fresh.groupBy(F.col("from_object_ref").startswith("source_claim:").alias("from_claim")).agg(F.count("*").alias("n")).collect()}  # two rows
    moved = moves.count()
    if by_family or moved:
        top = relationships.agg(F.max("source_relationship_id")).first()[0] or 0
        new = assign_ids(fresh, "source_relationship_id", top + 1, key)
        store.commit({"source_claim": claims_after, "source_relationship": edges_after.unionByName(new), "review_state_history": history.unionByName(moves)})
    return {"claims_contradicted": by_family.get(True, 0), "relationships_contradicted": by_family.get(False, 0), "relational_constraints_checked": counted["checked"], "relational_constraints_suppressed": counted["suppressed"], "states_reopened": moved}
