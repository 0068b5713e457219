"""The reconciliation pass: what an event contradicts, what is written, and that a second pass writes nothing."""

import json

import pytest

from ledgerlens import schemas
from ledgerlens.operators.upsert import Snapshot
from ledgerlens.plans import reconcile

COLUMNS = "source_claim_id bigint, about_object_ref string, claim_type string, claim_text string, review_state string, workspace_id string, provenance_event_ref string"
EDGES = "source_relationship_id bigint, from_object_ref string, to_object_ref string, predicate string, evidence_note string, review_state string, workspace_id string, provenance_event_ref string"


def claims(spark, *rows):
    text = lambda p: json.dumps(p) if isinstance(p, dict) else p
    return schemas.conform(spark.createDataFrame([(i, a, k, text(p), s, w, e) for i, a, k, p, s, w, e in rows], COLUMNS), "source_claim")


def edges(spark, *rows):
    return schemas.conform(spark.createDataFrame(list(rows), EDGES), "source_relationship")


def test_quantities(spark):
    rows = claims(
        spark,
        (1, "w:1", "quantity", {"value": 3}, "recorded", "a", "old"),
        (2, "w:1", "quantity", {"value": "3.0"}, "recorded", "a", "new"),  # the same number
        (3, "w:1", "quantity", {"numeric_value": 4.5}, "recorded", "a", "new"),
        (4, "w:1", "quantity", {"value": 9}, "Rejected ", "a", "old"),
        (5, "w:1", "quantity", {"value": 7}, None, "b", "old"),
        (6, "w:1", "quantity", {"value": 7}, None, None, "new"),  # no workspace: meets all
        (7, "w:1", "quantity", '{"value": 8', "recorded", "a", "old"),
        (8, "w:1", "quantity", "8", "recorded", "a", "old"),
        (9, "w:1", "birth_year", {"value": 8}, "recorded", "a", "old"),
        (10, None, "quantity", {"value": 5, "about_object_ref": "w:1"}, "recorded", "a", "new"),  # named in the payload alone: asks, isn't found
        (11, None, None, None, None, None, "new"),
    )
    got = reconcile.quantity_conflicts(rows, "new")
    want = set()
    numbers = {1: (3, "a", True), 2: (3, "a", True), 3: (4.5, "a", True), 5: (7, "b", True), 6: (7, None, True), 10: (5, "a", False)}
    for i in (2, 3, 6, 10):
        for j, (n, ws, stored) in numbers.items():
            if j != i and stored and n != numbers[i][0] and (numbers[i][1] is None or numbers[i][1] == ws):
                want.add((min(i, j), max(i, j), numbers[i][1]))
    assert {(r.offending_id, r.target_claim_id, r.workspace_id) for r in got.collect()} == want
    note = {r.rationale for r in got.filter("offending_id = 1 AND target_claim_id = 3").collect()}
    assert note == {"structured claim conflict for w:1 quantity: 3 versus 4.5"}
    assert reconcile.quantity_conflicts(rows.limit(0), "new").count() == 0


def life(spark):
    return claims(
        spark,
        (1, "p:pupil", "birth_year", {"year": 1900}, "recorded", "a", "old"),
        (2, "p:pupil", "born", {"date": "1890-01-02"}, "recorded", "a", "old"),
        (3, "p:master", "death_year", {"value": 1880}, "recorded", "a", "old"),
        (4, "p:master", "died", {"death_year": "1895"}, "reviewed", "a", "old"),
        (5, "p:master", "death_year", {"value": 1700}, "rejected", "a", "old"),
        (6, "p:master", "death_year", {"value": 1600}, "recorded", "b", "old"),
        (7, "p:pupil", "taught_by", {"to_object_ref": "p:master", "from_object_ref": "p:pupil"}, "recorded", "a", "new"),
        (8, "p:pupil", "taught_by", {"to_object_ref": "p:master"}, "recorded", "a", "new"),
        (9, "p:pupil", "death_year", {"value": "unknown"}, "recorded", "a", "old"),
    )


def test_teachers(spark):
    relations = edges(spark, (40, "p:pupil", "p:master", "taught_by", None, "recorded", "a", "new"), (30, "p:pupil", "p:master", "taught_by", None, "recorded", "a", "old"))
    got = reconcile.impossible_teachers(life(spark), relations, "new").collect()
    assert [(r.offending_id, r.target_claim_id, r.second_namespace, r.second_id) for r in got] == [(7, 3, "source_relationship", 40)]  # one for the group
    assert got[0].rationale == "claim says p:pupil was taught_by p:master, but subject birth year 1900 is after object death year 1880"
    assert reconcile.impossible_teachers(life(spark), relations, "old").count() == 0


def test_relationships(spark):
    relations = edges(
        spark,
        (1, "p:pupil", "p:master", "Taught_By ", None, "recorded", "a", "one"),
        (2, "p:master", "p:pupil", "teacher_of", None, "recorded", "a", "one"),
        (3, "p:master", "p:pupil", "met", json.dumps({"event_year": 1899}), "recorded", "a", "one"),
        (4, "p:master", "p:pupil", "met", None, "recorded", "b", "one"),  # nothing known of the pupil there
        (5, "p:pupil", "p:master", "taught_by", None, "recorded", None, "one"),
        (6, "p:pupil", "p:master", "influenced", None, "recorded", "a", "one"),
        (7, "p:pupil", None, "met", None, "recorded", "a", "one"),
        (8, "p:pupil", "p:master", "taught_by", None, "recorded", "a", "new"),  # claim 7 says the same
        (9, "p:pupil", "p:master", "contradicts", None, "recorded", "a", "one"),
    )
    facts = life(spark)
    got = reconcile.impossible_edges(reconcile.constrained_edges(facts, relations), facts)
    assert {(r.offending_id, r.target_claim_id, r.rationale.split(" ", 2)[2]) for r in got.collect()} == (
        {(1, t, f"predicate taught_by is impossible: subject birth year {b} is after object death year {d}") for b, t, d in [(1900, 3, 1880), (1890, 3, 1880), (1900, 4, 1895)]}
        | {(2, t, f"predicate teacher_of is impossible: object birth year {b} is after subject death year {d}") for b, t, d in [(1900, 3, 1880), (1890, 3, 1880), (1900, 4, 1895)]}
        | {(3, 3, "predicate met has event year 1899 after death year 1880 for subject p:master"), (3, 1, "predicate met has event year 1899 before birth year 1900 for object p:pupil")}
        | {(5, t, f"predicate taught_by is impossible: subject birth year {b} is after object death year {d}") for b, t, d in [(1900, 3, 1880), (1890, 3, 1880), (1900, 4, 1895), (1900, 6, 1600), (1890, 6, 1600)]}
    )
    apart = claims(spark, (1, "x", "birth_year", {"year": 1900}, None, "a", "e"), (2, "y", "death_year", {"year": 1800}, None, "a", "e"), (3, "y", "death_year", {"year": 1700}, None, "a", "e"))
    for ends in (("x", "y", "subject", "object"), ("y", "x", "object", "subject")):
        one = edges(spark, (1, ends[0], ends[1], "met", None, None, "a", "e"))
        found = reconcile.impossible_edges(reconcile.constrained_edges(apart, one, "e"), apart).collect()
        assert [(r.target_claim_id, r.rationale) for r in found] == [(2, f"relationship 1 predicate met is impossible: {ends[2]} birth year 1900 is after {ends[3]} death year 1800")]
    assert reconcile.findings(facts.limit(0), relations.limit(0)).count() == 0


@pytest.fixture
def store(spark, tmp_path):
    store = Snapshot(spark, f"file://{tmp_path}/store")
    rows = claims(
        spark,
        (1, "w:1", "quantity", {"value": 3}, "reviewed", "a", "old"),
        (2, "w:1", "quantity", {"value": 4}, "recorded", "a", "new"),
        (3, "w:2", "quantity", {"value": 4}, "recorded", "a", "old"),
        (4, "w:2", "quantity", {"value": 5}, "recorded", "a", "old"),  # an old conflict: no work of this event
        (5, "x", "birth_year", {"year": 1900}, None, "a", "old"),
        (6, "y", "death_year", {"year": 1800}, None, "a", "old"),
    )
    relations = edges(spark, (1, "x", "y", "met", None, "proposed", "a", "new"), (2, "y", "x", "met", None, "proposed", "a", "old"))
    store.commit({"source_claim": rows, "source_relationship": relations, "review_state_history": store.table("review_state_history")})
    return store


def test_pass_writes_once(spark, store):
    got = reconcile.reconcile(store, "new", "2026-01-01T00:00:00Z")
    assert got == {"claims_contradicted": 1, "relationships_contradicted": 1, "relational_constraints_checked": 1, "relational_constraints_suppressed": 0, "states_reopened": 2}
    states = {r.source_claim_id: r.review_state for r in store.table("source_claim").collect()}
    assert states == {1: "reviewed", 2: "needs_review", 3: "recorded", 4: "recorded", 5: None, 6: None}  # an established claim stays
    written = {r.source_relationship_id: (r.from_object_ref, r.to_object_ref, r.predicate, r.review_state, r.confidence_score) for r in store.table("source_relationship").collect()}
    assert written[1][3] == "needs_review" and written[2][3] == "proposed"
    assert sorted(written[k] for k in written if k > 2) == [("source_claim:1", "source_claim:2", "contradicts", "needs_review", 1.0), ("source_relationship:1", "source_claim:6", "contradicts", "needs_review", 1.0)]
    assert sorted((r.target_namespace, r.target_id, r.previous_state, r.reason) for r in store.table("review_state_history").collect()) == [("source_claim", "2", "recorded", reconcile.QUANTITY_CONFLICT), ("source_relationship", "1", "proposed", reconcile.LIFESPAN_OVERLAP)]
    before = store.manifest()
    again = reconcile.reconcile(store, "new", "2026-01-02T00:00:00Z")
    assert (again["claims_contradicted"], again["relationships_contradicted"], again["states_reopened"]) == (0, 0, 0)
    assert store.manifest() == before
