"""Ingest, saturation, feedback, closure and artifact contracts end to end on small stores."""

import json

import pytest
from pyspark.sql import functions as F


def batch(run, facet, candidates, day="2024-01-01"):
    return {"schema_version": "v1", "run_id": run, "created_at": f"{day}T00:00:00Z", "subject": {"subject_id": "demo"}, "facet": {"name": facet}, "candidates": candidates}


def candidate(i, kind, text, state=None):
    return {"candidate_id": str(i), "candidate_type": kind, "review_status": state, "text": text if isinstance(text, str) else json.dumps(text)}


FIRST = [
    candidate(1, "work", {"title": "A  Book", "identifiers": [{"scheme": "doi", "value": "10.1234/x"}], "confidence_score": 0.9}, "accepted"),
    candidate(2, "work", {"title": "Other", "year": "1999"}),
    candidate(3, "work", {"title": "other ", "year": "1999", "work_type": "book"}),
    candidate(4, "claim", {"claim_text": "Who taught whom?", "claim_type": "open_question", "about_object_ref": "work:1"}),
    candidate(5, "claim", {"claim_text": "born", "claim_type": "birth_year", "about_object_ref": "authority_record:9", "year": 1900}),
    candidate(6, "entity", {"entity_label": "Ada", "entity_type": "person"}),
    candidate(7, "relationship", {"from_object_ref": "work:1", "to_object_ref": "work:2", "predicate": "cites"}),
    candidate(8, "relationship", {"from_object_ref": "work:1", "to_object_ref": "work:99", "predicate": "cites"}),
    candidate(9, "source", {"canonical_url": "https://example.org/a"}),
    candidate(10, "unknown", "prose"),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    from ledgerlens.operators.upsert import Snapshot
    from ledgerlens.plans.ingest import ingest_candidates
    from ledgerlens.sources.artifacts import candidates

    base = tmp_path_factory.mktemp("plans")
    (base / "one.json").write_text(json.dumps(batch("run1", "works", FIRST)))
    (base / "two.json").write_text(json.dumps(batch("run2", "people", [candidate(1, "work", {"title": "Other", "year": "1999"}, "reviewed")], "2024-02-01")))
    store = Snapshot(spark, f"file://{base}/store")
    reports = [ingest_candidates(store, candidates(spark, f"{base}/{f}.json")).collect() for f in ("one", "two")]
    return store, base, reports


def test_ingest_reports_and_keys(store):
    snapshot, _, reports = store
    first = {r.table: (r.inserted, r.updated, r.deduped) for r in reports[0]}
    assert first["work"] == (2, 0, 1) and first["source_claim"] == (2, 0, 0) and first["source_relationship"] == (2, 0, 0)
    assert {r.table: (r.inserted, r.updated, r.deduped) for r in reports[1]}["work"] == (0, 1, 0)
    works = {r.title: r for r in snapshot.table("work").collect()}
    assert works["Other"].review_state == "reviewed" and works["Other"].work_type == "book"
    assert sorted(r.work_id for r in works.values()) == [1, 2]
    assert works["Other"].first_seen_at.startswith("2024-01") and works["Other"].last_seen_at.startswith("2024-02")
    claims = {r.claim_type: r for r in snapshot.table("source_claim").collect()}
    assert claims["open_question"].is_open_question and not claims["birth_year"].is_open_question


def test_ingest_again_changes_nothing(spark, store):
    from ledgerlens.plans.audits import rebuild_audit
    from ledgerlens.plans.ingest import ingest_candidates
    from ledgerlens.sources.artifacts import candidates

    snapshot, base, _ = store
    names = ["work", "source_claim", "extraction_detected_entity", "source_relationship", "source_access", "provenance_event"]
    before = {n: snapshot.table(n) for n in names}
    ingest_candidates(snapshot, candidates(spark, f"{base}/two.json"))
    audit = rebuild_audit(before, {n: snapshot.table(n) for n in names}).collect()
    assert all(r.equal for r in audit), audit


def test_bad_year_refuses_the_batch(spark, store, tmp_path):
    from ledgerlens.plans.ingest import IngestError, ingest_candidates
    from ledgerlens.sources.artifacts import candidates

    snapshot, _, _ = store
    (tmp_path / "bad.json").write_text(json.dumps(batch("run3", "works", [candidate(1, "work", {"title": "New", "year": "soon"})])))
    manifest = snapshot.manifest()
    with pytest.raises(IngestError):
        ingest_candidates(snapshot, candidates(spark, f"{tmp_path}/bad.json"))
    assert snapshot.manifest() == manifest


def tables(snapshot):
    names = ["work", "source_claim", "extraction_detected_entity", "source_relationship", "source_access", "provenance_event", "capture_event", "extraction_record", "authority_reconciliation", "authority_record"]
    return {n: snapshot.table(n) for n in names}


def test_saturation_health_and_feedback(spark, store):
    from ledgerlens.plans.health import loop_health
    from ledgerlens.plans.loop import feedback_plan, topic_saturation

    snapshot, _, _ = store
    t = tables(snapshot)
    spaces = spark.createDataFrame([("demo", "demo"), ("idle", "idle")], "workspace_id string, subject string")
    got = {r.subject: r for r in topic_saturation(t, spaces).collect()}
    assert (got["demo"].state, got["demo"].cycles) == ("active_bootstrap", 2) and (got["idle"].state, got["idle"].cycles) == ("active_bootstrap", 0)
    short = {r.subject: r for r in topic_saturation(t, spaces, {"lookback_cycles": 2}).collect()}
    assert short["demo"].state in ("active", "saturated") and short["demo"].backlog > 0
    health = {h.scope: h for h in loop_health(t, spaces.select(F.col("workspace_id").alias("scope")), "2024-03-01T00:00:00Z").collect()}
    assert (health["demo"].cycles, health["idle"].cycles, health["idle"].status) == (2, 0, "insufficient_data")
    plan = feedback_plan(t, "demo", ["works", "people", "sources", "open_questions"], max_leads=2, max_deferred=5).collect()
    kinds = {}
    for r in plan:
        kinds.setdefault(r.kind, []).append(r)
    assert len(kinds["facet"]) == 4 and len(kinds["lead"]) == 2 and len(kinds["next_action"]) == 1 and kinds["deferred"]
    assert [r.rank for r in sorted(kinds["facet"], key=lambda r: r.rank)] == [1, 2, 3, 4]
    assert all(a.score >= b.score for a, b in zip(*(lambda x: (x, x[1:]))(sorted(kinds["facet"], key=lambda r: r.rank)), strict=False))


def test_closure(store):
    from ledgerlens.plans.audits import closure_audit

    snapshot, _, _ = store
    got = {r.family: r for r in closure_audit(tables(snapshot)).collect()}
    assert got["source_relationship.from_object_ref"].status == "pass"
    assert got["source_relationship.to_object_ref"].status == "fail" and got["source_relationship.to_object_ref"].orphan == 1
    assert got["source_claim.about_object_ref"].orphan == 1


def test_correction_ledger(spark):
    from ledgerlens.plans.audits import validate

    def event(n, sources, results, **other):
        base = {"event_id": f"cle:{n}", "action": "merge", "changed_at": f"2024-01-{n:02}T00:00:00Z", "changed_by": "op", "rationale": "same", "note": None, "workspace_id": "w", "seq": n, "source_object_refs": sources, "result_object_refs": results}
        return {**base, "review_queue_refs": [], "provenance_event_refs": ["prov:a-1"], "evidence_locator_refs": ["evl:x"], "field_review_entry_refs": [], **other}

    schema = "event_id string, action string, changed_at string, changed_by string, rationale string, note string, workspace_id string, seq long, " + ", ".join(f"{c} array<string>" for c in ("source_object_refs", "result_object_refs", "review_queue_refs", "provenance_event_refs", "evidence_locator_refs", "field_review_entry_refs"))
    check = lambda *events: sorted((r.key, r.code) for r in validate("correction_ledger", spark.createDataFrame(list(events), schema)).collect())
    assert check(event(1, ["work:1", "work:2"], ["work:3"]), event(2, ["work:3"], ["work:4", "work:5"], action="split")) == []
    assert check(event(1, ["work:1"], ["work:2"]), event(2, ["work:1"], ["work:9"]), event(3, ["work:8"], ["work:1"]), event(4, ["work:1"], ["work:7"], workspace_id="v")) == [("cle:2", "SOURCE_OBJECT_NOT_CURRENT"), ("cle:3", "RESULT_OBJECT_ALREADY_SUPERSEDED")]
    assert check(event(1, ["work:1"], ["work:2"], seq=2), event(2, ["work:5"], ["work:6"], seq=1), event(1, ["work:7"], ["work:8"], seq=3)) == [("cle:1", "DUPLICATE_EVENT_ID"), ("cle:1", "EVENTS_OUT_OF_ORDER")]
    assert check(event(1, ["work:1"], ["work:1"])) == [("cle:1", "OVERLAPPING_OBJECT_REFS"), ("cle:1", "RESULT_OBJECT_ALREADY_SUPERSEDED")]
    assert check(event(1, ["work:1", "work:2"], ["work:3"], action="split")) == [("cle:1", "INVALID_RESULT_CARDINALITY"), ("cle:1", "INVALID_SOURCE_CARDINALITY")]
    bad = event(1, ["page:1"], ["work:2"], event_id="E1", action="drop", changed_at="soon", changed_by=" ", rationale=None, note=" ", review_queue_refs=["x"], provenance_event_refs=None, evidence_locator_refs=["evl:"], field_review_entry_refs=["frs:a", "frs:a"])
    assert [c for _, c in check(bad)] == [
        "DUPLICATE_ARRAY_ITEM", "INVALID_ACTION", "INVALID_CHANGED_AT", "INVALID_CHANGED_BY", "INVALID_EVENT_ID", "INVALID_EVIDENCE_LOCATOR_REF", "INVALID_NOTE", "INVALID_OBJECT_REF", "INVALID_PROVENANCE_EVENT_REF", "INVALID_RATIONALE", "INVALID_REVIEW_QUEUE_REF", "PROVENANCE_REF_REQUIRED",
    ]
    assert validate("correction_ledger", spark.createDataFrame([("cle:1",)], "event_id string")).count() > 5


def test_contracts(spark):
    from ledgerlens.plans.audits import contracts, report, rollup, validate

    assert len(contracts()) == 29
    loci = spark.createDataFrame([("a", "archive", "accepted", None, 0.5), ("b", "archive", "odd", "z", 2.0), ("b", None, "accepted", "a", None)], "locus_id string, locus_type string, review_state string, parent_locus_id string, productivity_score double")
    assert {(r.key, r.code) for r in validate("source_locus_jsonl", loci).collect()} == {("b", "STATE"), ("b", "SCORE"), ("b", "TYPE"), ("b", "DUPLICATE_KEY"), ("b", "UNKNOWN_REFERENCE")}
    lines = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 1, "a": 2}'), (3, "{")], "line_no int, line string")
    assert {(r.key, r.code) for r in validate("jsonl", lines).collect()} == {("2", "JSON"), ("3", "JSON")}
    manifest = spark.createDataFrame([("a/b", "0" * 64), ("/abs", "0" * 64), ("a/../b", "x")], "path string, sha256 string")
    bad = report("crown_jewel_backup_manifest", manifest).first()
    assert (bad.inspected, bad.rejected, bad.status, bad.codes) == (3, 2, "fail", "HASH,PATH")
    checks = spark.createDataFrame([("a", "pass"), ("b", "warn")], "check string, status string")
    assert tuple(rollup(checks).first()) == ("warn", 1, 1, 0)


def test_identity_of_locators_and_lineage(spark):
    from ledgerlens.operators.identity import match_by_locator
    from ledgerlens.plans.ingest import UNKNOWN_LOCUS, assign_loci, backfill_legacy, contradiction_edges, cycle_summary, execution_rows, record_cycle, without_structured_counterparts, work_identifiers

    access = spark.createDataFrame([(1, "u1", "l1"), (2, None, "u1")], "work_id int, canonical_url string, original_locator string")
    cands = spark.createDataFrame([("c", "u1"), ("d", "nope")], "candidate_id string, locator string")
    assert {tuple(r) for r in match_by_locator(cands, access).collect()} == {("c", 1), ("c", 2)}
    loci = spark.createDataFrame([("x",)], "locus_id string")
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "gone")], "i int, source_locus_ref string")
    assert [r.source_locus_ref for r in assign_loci(rows, loci).orderBy("i").collect()] == ["x", UNKNOWN_LOCUS, UNKNOWN_LOCUS]
    edges = contradiction_edges(spark.createDataFrame([(1, 2)], "low_id int, high_id int")).first()
    assert (edges.from_object_ref, edges.predicate, edges.review_state, edges.confidence_score) == ("source_claim:1", "contradicts", "needs_review", 1.0)
    rel = spark.createDataFrame([("e", "a", "b", "taught_by"), ("e", "a", "c", "taught_by")], "provenance_event_ref string, from_object_ref string, to_object_ref string, predicate string")
    claim = spark.createDataFrame([("e", "a", '{"to_object_ref": "b"}', "taught_by")], "provenance_event_ref string, about_object_ref string, claim_text string, claim_type string")
    assert [r.to_object_ref for r in without_structured_counterparts(rel, claim).collect()] == ["c"]
    manifest = spark.createDataFrame([("w", "s", "r", [("gather", "ok"), ("review", "ok")], [("out", "p", "h")], [])], "workspace_id string, subject_id string, run_id string, stages array<struct<stage_name:string,status:string>>, artifacts array<struct<artifact_role:string,artifact_path:string,content_hash:string>>, decisions array<struct<decision_type:string,decided_at:string>>")
    summary = cycle_summary(record_cycle(manifest)).first()
    assert (summary.n_cycle_stage, summary.n_cycle_artifact, summary.n_cycle_decision) == (2, 1, 0)
    legacy = backfill_legacy(spark.createDataFrame([("l1", "A  title", "loc", None, "w"), ("l2", "a title", None, "u", "w"), ("l3", None, None, "v", "w")], "lead_id string, title string, locator string, url string, workspace_id string"))
    assert legacy["work"].count() == 1 and legacy["source_access"].count() == 3
    payload = '{"identifiers": [{"scheme": "doi", "value": "10.1234/X"}, {"scheme": "isbn", "value": "1"}]}'
    found, conflicts = work_identifiers(spark.createDataFrame([("k1", payload), ("k2", payload)], "work_key_v1 string, payload_json string"), spark.createDataFrame([("k1", 1), ("k2", 2)], "work_key_v1 string, work_id int"))
    assert {(r.scheme, r.validity_status) for r in found.collect()} == {("doi", "valid"), ("isbn", "invalid")}
    assert [tuple(r) for r in conflicts.collect()] == [("doi", "10.1234/x")]
    captures, done = execution_rows(spark.createDataFrame([("c", "t", "m", "h", 3, "text", "w", None, None, None, None, None, None)], "capture_id string, captured_at string, capture_method string, content_hash string, byte_count long, content_type string, workspace_id string, extraction_id string, extraction_method string, input_hash string, output_hash string, byte_count_out long, extraction_status string"))
    assert captures.count() == 1 and done.count() == 0


def test_every_contract_takes_rows_of_its_key_alone(spark):
    from ledgerlens.plans import audits

    assert set(audits.FIELDS) == set(audits.contracts())
    for artifact, (key, rules) in audits.contracts().items():
        rows = spark.createDataFrame([(None,)], f"{key} {audits.TYPES.get(key, 'string')}")
        codes = {r.code for r in audits.validate(artifact, rows).collect()}
        assert codes and codes <= {*rules, "DUPLICATE_KEY"}, artifact
        assert audits.report(artifact, rows.limit(0)).first().status == "pass", artifact


def test_lineage_of_any_length(spark):
    from ledgerlens.operators.graph import lineage

    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(30)] + [("n30", "n0"), ("n2", "x")], "src string, dst string")
    seeds = spark.createDataFrame([("n0",)], "node string")
    first = lineage(edges, seeds)
    other = lineage(edges.filter("src = 'n2'"), spark.createDataFrame([("n2",)], "node string"))
    assert {(r.node, r.depth) for r in first.collect()} == {(f"n{i}", i) for i in range(31)} | {("x", 3)}
    assert {(r.node, r.depth) for r in other.collect()} == {("n2", 0), ("n3", 1), ("x", 1)}
    assert {r.depth for r in lineage(edges, seeds, depth=4).collect()} == {0, 1, 2, 3, 4}


def test_equal_labels_of_two_extractions_are_two_entities(spark):
    import json

    from ledgerlens.plans import ingest

    rows = [(f"c{i}", "entity", json.dumps({"entity_label": "Ada", "entity_type": "person", "extraction_id": e, "capture_event_id": 7, "source_span_start": s, "source_span_end": s + 3})) for i, (e, s) in enumerate([(1, 0), (2, 0), (1, 9), (1, 0)])]
    assert ingest.KEYS["extraction_detected_entity"][1][1:5] == ["extraction_id", "capture_event_id", "normalized_label", "entity_type"]
    columns = "candidate_id string, candidate_type string, payload_json string"
    frame = spark.createDataFrame(rows, columns)
    for name in ("run_id", "facet", "subject_id", "review_status", "text", "created_at"):
        frame = frame.selectExpr("*", f"'x' AS {name}")
    routed = ingest.route(frame.selectExpr("*", "1 AS sequence", "'extraction_detected_entity' AS family"))["extraction_detected_entity"]
    key = ingest.KEYS["extraction_detected_entity"][1]
    assert routed.count() == 4 and routed.select(*key).distinct().count() == 3
