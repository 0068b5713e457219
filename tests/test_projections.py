"""Policies, handoffs, explanations, payloads, pages and migration."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import projections as op


def test_policies_and_urls(spark):
    rows = spark.createDataFrame([("keep", "local_file"), ("odd", None)], "policy_class string, family string")
    got = rows.select(op.byte_retention(F.col("policy_class"), {"keep": "retained"}), op.refetchability(F.col("family"), {"local_file": "yes"})).collect()
    assert [tuple(r) for r in got] == [("retained", "yes"), ("retention_unknown", "unknown")]
    policies = spark.createDataFrame([("keep", False)], "policy_class string, public_export_blocked boolean")
    assert {r.policy_class: r.export_blocked for r in op.export_blocked(rows, policies).collect()} == {"keep": False, "odd": True}
    urls = spark.createDataFrame([("https://a.Example.org:8080/x",), ("https://badexample.org/",), ("http://h.net/docs/1",), ("ftp://example.org/",), (None,)], "u string")
    assert [r[0] for r in urls.select(op.allowed_url(F.col("u"), ["example.org"], ["http://h.net/docs/"])).collect()] == [True, False, True, False, False]


def test_handoffs_and_explanations(spark):
    planned = spark.createDataFrame([("b", "x"), ("a", "y")], "relative_path string, adapter_local_path string")
    got = op.handoffs(planned, "local_file", "ad", ["relative_path"]).orderBy("sequence").collect()
    assert [(r.sequence, json.loads(r.locator)["relative_path"]) for r in got] == [(1, "a"), (2, "b")]
    assert len({r.handoff_hash for r in got}) == 2
    ranked = spark.createDataFrame([("c1", "L", 1.23456, 1, ["x"]), ("c2", "M", 0.5, 2, None)], "candidate_id string, label string, score double, rank int, reason_codes array<string>")
    first, second = op.explanations(ranked, 1, "lead").orderBy("candidate_id").collect()
    assert (first.score, first.selected, first.eligibility_status) == (1.2346, True, "eligible") and (second.reason_codes, second.eligibility_status) == ([], "deferred")


def test_payloads_and_blocks(spark):
    rows = spark.createDataFrame([("a", None, "line  one\nline two")], "action_id string, subject_id string, raw string")
    row = rows.select(op.prompt_payload(rows).alias("p"), op.bounded_claim(F.col("raw")).alias("c"), op.unwrap("x", F.concat(op.wrap("x", F.lit("in\nside")), F.lit(" "), op.wrap("x", F.lit("two")))).alias("u"), op.holds_sentinel(F.struct(F.array(F.lit("a SECRET b")).alias("k")), "SECRET").alias("s")).first()
    assert (json.loads(row.p), row.c, row.u, row.s) == ({"action_id": "a"}, "line one", ["in\nside", "two"], True)
    assert rows.select(op.bounded_claim(F.lit(" \nx"))).first()[0] == "claim-fallback-empty"


def test_pages_and_closure(spark):
    rows = spark.createDataFrame([(1, "accepted", "published", None), (2, "proposed", "published", None), (3, "accepted", "draft", None), (4, "accepted", "published", "no")], "id int, review_state string, publication_state string, public_blocker string")
    built = op.pages(rows, "work", "id", F.lit("t"), F.lit("b"))
    assert [r.route for r in built.collect()] == ["work/1"]
    links = spark.createDataFrame([("work/1", "work/1"), ("work/1", "work/2")], "route string, target string")
    assert [r.target for r in op.route_closure(built, links).collect()] == ["work/2"]


def test_migration_and_population(spark):
    old = spark.createDataFrame([(1, "k", "extra")], "work_id int, work_key_v1 string, dropped string")
    drift = dict(op.schema_drift(old, "work"))
    assert drift["work_id"] == "int instead of bigint" and drift["dropped"] == "unknown" and drift["title"] == "missing"
    new = op.migrate(old, "work", 1, 8)
    assert op.schema_drift(new, "work") == [] and new.first().work_key_v1 == "k"
    with pytest.raises(ValueError):
        op.migrate(old, "work", 9, 8)
    assert {tuple(r) for r in op.population({"a": old, "b": old.limit(0)}).collect()} == {("a", 1, "populated"), ("b", 0, "empty")}


def test_directory_joins(spark):
    decisions = spark.createDataFrame([("source_claim", "1"), ("source_claim", "2"), ("work", "1")], "object_namespace string, object_id string")
    claims = spark.createDataFrame([(1, "w"), (2, "v")], "source_claim_id int, workspace_id string")
    works = spark.createDataFrame([(1, "w")], "work_id int, workspace_id string")
    got = op.decisions_in_workspace(decisions, {"source_claim": claims, "work": works}, {"source_claim": "source_claim_id", "work": "work_id"}, "w")
    assert {tuple(r) for r in got.collect()} == {("source_claim", "1"), ("work", "1")}
    files = spark.createDataFrame([("f", "k"), ("g", None)], "path string, artifact_key string")
    artifacts = spark.createDataFrame([("k", "json")], "artifact_key string, format string")
    io = spark.createDataFrame([("k", "s1", "write"), ("k", "s2", "read")], "artifact_key string, surface_key string, direction string")
    assert {r.path: (r.producers, r.consumers) for r in op.file_overview(files, artifacts, io).collect()} == {"f": (1, 1), "g": (0, 0)}
    events = spark.createDataFrame([(1, "a", "k1", "2024-01-01"), (2, "a", "k2", "2024-01-02")], "provenance_event_id int, event_type string, provenance_event_key_v1 string, event_timestamp string")
    assert tuple(op.latest_by_type(events).first()) == ("a", 2, "k2")
