"""Diagnostics, doctor, backups, intake, bibliography, standards and lifecycles."""

from pyspark.sql import functions as F

from ledgerlens.functions.text import normalize_extracted
from ledgerlens.plans import ingest, reports
from ledgerlens.schemas import conform


def table(spark, name, rows, ddl):
    return conform(spark.createDataFrame(rows, ddl), name)


def tables(spark):
    return {
        "work": table(spark, "work", [(1, "A", "reviewed"), (2, "B", " ")], "work_id int, title string, review_state string"),
        "source_access": table(spark, "source_access", [(1, 1, "https://H.org/private/x", "open"), (2, 2, None, None)], "source_access_id int, work_id int, canonical_url string, access_class string"),
        "source_claim": table(spark, "source_claim", [(1, "work:1", "t", "c")], "source_claim_id int, about_object_ref string, claim_type string, claim_text string"),
        "source_relationship": table(spark, "source_relationship", [(1, "work:1", "work:2", "cites"), (2, "work:2", "work:2", "self")], "source_relationship_id int, from_object_ref string, to_object_ref string, predicate string"),
        "work_identifier": table(spark, "work_identifier", [(1, "doi", "10.1/b"), (1, "doi", "10.1/a")], "work_id int, scheme string, value string"),
        "work_metadata": table(spark, "work_metadata", [(1, "k", "v"), (1, "l", "w")], "work_id int, meta_key string, meta_value string"),
        "provenance_event": table(spark, "provenance_event", [(1, "k", "gather")], "provenance_event_id int, provenance_event_key_v1 string, event_type string"),
    }


def test_diagnostics_and_doctor(spark):
    t = tables(spark)
    out = reports.diagnostics(t)
    assert {tuple(r) for r in out["hosts"].collect()} == {("h.org", 1), ("[none]", 1)}
    assert ("work", "[blank]", 1) in {tuple(r) for r in out["states"].collect()}
    assert {tuple(r) for r in out["edge_families"].collect()} == {("work", "from", 2), ("work", "to", 2)}
    assert not any("private" in str(r) for r in out["detail"].collect())
    assert reports.doctor(t, ["work", "source_claim"]).first().status == "pass"
    assert reports.doctor(t, ["work", "topic_extension"]).first().status == "fail"


def test_bibliography_and_standards(spark):
    t = tables(spark)
    got = {r.work_id: r for r in reports.bibliography(t).collect()}
    assert [i.value for i in got[1].identifiers] == ["10.1/a", "10.1/b"] and got[1].attributes == {"k": "v", "l": "w"}
    assert [r.predicate for r in got[2].relationships] == ["cites", "self"] and got[2].claims == [] and len(got[1].claims) == 1
    out = reports.standards(t)
    assert set(out) == {"dcmi_records", "dcmi_mapping", "premis_records", "premis_mapping"}
    assert {r.element: r.status for r in out["premis_mapping"].collect()}["premis:eventType"] == "satisfied"


def test_backups_and_intake(spark):
    files = spark.createDataFrame([("db/a.sqlite", "1"), ("x.txt", "2"), ("n.txt", "3")], "relative_path string, sha256 string")
    assert {tuple(r) for r in reports.backup_plan(files, [("store", "db/**"), ("text", "*.txt")]).collect()} == {("db/a.sqlite", "store"), ("x.txt", "text"), ("n.txt", "text")}
    manifest = spark.createDataFrame([("db/a.sqlite", "1"), ("x.txt", "9"), ("gone", "4")], "relative_path string, sha256 string")
    assert {tuple(r) for r in reports.backup_mismatches(files, manifest).collect()} == {("x.txt", "changed"), ("n.txt", "not_in_manifest"), ("gone", "missing")}
    ids = lambda *a: spark.createDataFrame([(x,) for x in a], "adapter_id string")
    got = {r.adapter_id: r.stage for r in reports.intake_status(ids("a", "a", "b", "c", "d"), ids("a", "b", "c"), ids("c")).collect()}
    assert got == {"a": "capturing", "b": "extracting", "c": "complete", "d": "planned"}


def test_entity_workspaces_and_lifecycle(spark):
    entities = spark.createDataFrame([(1, 1, 1, None), (2, None, 2, "w"), (3, 2, None, "w")], "detected_entity_id int, extraction_id int, capture_event_id int, workspace_id string")
    extractions = spark.createDataFrame([(1, "w"), (2, "other")], "extraction_id int, workspace_id string")
    captures = spark.createDataFrame([(1, "w"), (2, None)], "capture_event_id int, workspace_id string")
    good, bad = ingest.entities_with_workspace(entities, extractions, captures)
    assert {r.detected_entity_id: r.workspace_id for r in good.collect()}[1] == "w" and [r.detected_entity_id for r in bad.collect()] == [3]
    rows = spark.createDataFrame([("a", "proposed"), ("b", "accepted"), ("c", "ambiguous")], "reconciliation_key_v1 string, review_state string")
    moves = spark.createDataFrame([("a", "accepted"), ("b", "rejected"), ("c", "ambiguous")], "reconciliation_key_v1 string, to_state string")
    after, refused = ingest.advance_reconciliations(rows, moves)
    assert {tuple(r) for r in after.collect()} == {("a", "accepted"), ("b", "accepted"), ("c", "ambiguous")}
    assert [tuple(r) for r in refused.collect()] == [("b", "accepted", "rejected")]


def test_extracted_text(spark):
    df = spark.createDataFrame([("a  b \n\n\n\nc\fd\t e ",)], "t string")
    assert df.select(normalize_extracted(F.col("t"))).first()[0] == "a b\n\nc\n\nd e"
