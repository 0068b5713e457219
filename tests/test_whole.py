"""Queries that read all rows of their tables, held to plain Python over the same tables or to small fixtures."""

from collections import defaultdict

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.01"  # more rows than any earlier id limit


def table(name: str, *columns: str) -> list[tuple]:
    read = pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).to_pydict()
    return list(zip(*(read[c] for c in columns), strict=True))


def test_authority_matches_of_all_documents(spark):
    from ledgerlens.queries.relations import authority_matches

    known = defaultdict(set)
    for part, brand, kind in table("part", "p_partkey", "p_brand", "p_type"):
        if part % 4:
            known[brand.lower(), kind].add(part)
    want = {}
    for (doc,) in table("documents", "doc_id"):
        if hits := known.get((f"brand#{doc % 30}", "PROMO" if doc % 2 else "ECONOMY")):
            want[doc] = (len(hits), min(hits) if len(hits) == 1 else None, 0.75 if len(hits) == 1 else 0.5, "proposed" if len(hits) == 1 else "ambiguous")
    got = authority_matches(spark, SF).collect()
    assert len(got) == len(want) and max(want) >= 500
    assert {r.entity_id: (r.matches, r.candidate, r.match_score, r.status) for r in got} == want


def test_authorities_of_entities_with_several_labels(spark):
    from ledgerlens.operators.identity import match_authorities

    entities = spark.createDataFrame([(1, "a", "p"), (1, "b", "p"), (2, "a", "p"), (2, "a", "p"), (3, "b", "p"), (4, "a", None), (5, "c", "p"), (5, "d", "p")], "entity_id int, label_norm string, entity_type string")
    authorities = spark.createDataFrame([("a", "p", 7, None), ("b", "p", 7, None), ("b", "p", 8, None), ("c", "p", 9, 7), ("d", "p", 9, None), ("a", "p", 7, None)], "label_norm string, authority_type string, authority_record_id int, merged_into_authority_record_id int")
    got = {r.entity_id: (r.matches, r.candidate) for r in match_authorities(entities, authorities).collect()}
    assert got == {1: (2, None), 2: (1, 7), 3: (2, None), 5: (1, 9)}


def test_selection_records_of_all_parts(spark):
    from ledgerlens.queries.contracts import selection_records

    parts = [p for (p,) in table("part", "p_partkey")]
    got = {r.candidate_id: r for r in selection_records(spark, SF).collect()}
    assert got.keys() == {f"part:{p}" for p in parts} and max(parts) >= 60
    for p in parts:
        r = got[f"part:{p}"]
        assert (r.selected, r.eligibility_status, r.rationale) == ((True, "eligible", f"rank {p + 1}") if p < 12 else (False, "deferred", "rank below limit"))


def test_facet_scores_of_all_users(spark, tmp_path):
    from datetime import datetime

    from ledgerlens.queries.cycles import facet_scores

    rows = [(1, 1, "click", 98), (2, 2, "click", 1), (3, 3, "click", 1), (4, 11, "error", 0), (5, 12, "error", 7), (6, 13, "view", 2), (7, 10, "view", 3), (8, 50, "signup", 6), (9, 9, "purchase", 0)]
    events = spark.createDataFrame([(i, u, kind, datetime(2001, 1, i), f'{{"k": {k}}}') for i, u, kind, k in rows], "event_id long, user_id long, event_type string, ts timestamp, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.facet: (r.score, r.reason_codes, r["rank"]) for r in facet_scores(spark, str(tmp_path)).collect()}
    assert got == {
        "click": (3.0 + 2 * 2.5 + 0.25 * 2, "productive_history,open_lead_yield", 1),
        "view": (2.0 + 1.5 + 0.25, "fallback_facet", 2),
        "signup": (1.25 - 1.0, "recent_low_yield_penalty", 3),
        "purchase": (-2.0 - 1.0, "repeated_zero_yield,recent_low_yield_penalty", 4),
        "error": (-2.0 - 1.5 + 0.25, "repeated_zero_yield", 5),
    }


def test_question_quality_and_first_url_of_whole_texts(spark, tmp_path):
    from ledgerlens.queries.texts import first_urls, question_quality

    long = "short words are set here up to the sixty first letter of it all. " + "Where does everything after that belong?"
    spark.createDataFrame([("c", 1, "user", long), ("c", 5, "user", "")], "conv_id string, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: (r.bonus, r.is_open) for r in question_quality(spark, str(tmp_path)).collect()}
    # 20 words: ten count; five of over four letters, four count; a question mark; no question word among the first four; eight words or more
    assert got == {1: (0.8 + 0.2 + 0.25 + 0.15, True), 5: (-0.75, False)}
    spark.createDataFrame([(1, "x" * 60 + " at https://own.example.net/a, and more"), (2, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.url for r in first_urls(spark, str(tmp_path)).collect()} == {1: "https://own.example.net/a", 2: "https://example.org/2"}


def test_stream_of_more_than_a_thousand_runs(spark, tmp_path):
    from ledgerlens.operators.review import failure_state, terminal_outcomes
    from ledgerlens.streaming.failures import failure_states, stream_ledger

    schema = "event_id string, run_id string, workspace_id string, event_type string, ts timestamp"
    log = str(tmp_path / "log")
    at = lambda i: f"2024-01-{2 + i // 1440:02d} {i // 60 % 24:02d}:{i % 60:02d}:00"
    first = [(f"{i:05d}", f"r{i}", "w", "run_failed", at(i)) for i in range(1500)]
    late = [("a", "r-late", "w", "run_succeeded", "2024-01-01 00:00:00"), ("b", "r3", "w", "run_failed", "2024-01-01 00:00:01")]
    for rows in (first, late):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).coalesce(1).write.mode("append").json(log)
    query = failure_states(stream_ledger(spark, log, schema, 1)).writeStream.outputMode("update").format("memory").queryName("many_runs").trigger(availableNow=True).start()
    query.awaitTermination()
    got = max((r.runs, r.failure_streak, r.state) for r in spark.table("many_runs").collect())
    batch = failure_state(terminal_outcomes(spark.read.schema(schema).json(log), "workspace_id", "run_id", "ts", "event_id", "event_type", ["run_succeeded"], ["run_failed"]), "workspace_id").first()
    assert got == (1501, 1500, "blocked") and (batch.failure_streak, batch.state) == got[1:]


def test_feedback_plan_of_extraction_outcomes(spark):
    from ledgerlens.plans.loop import feedback_plan, lead_candidates
    from ledgerlens.schemas import TABLES

    def table(name, *rows):
        assert all(k in TABLES[name].names for r in rows for k in r)
        return spark.createDataFrame([tuple(r.get(n) for n in TABLES[name].names) for r in rows], TABLES[name])

    t = {
        "work": table("work", {"work_id": 1, "workspace_id": "s", "review_state": "accepted", "title": "a"}, {"work_id": 2, "workspace_id": "other", "review_state": "proposed", "title": "b"}, {"work_id": 3, "workspace_id": "s", "review_state": "proposed", "title": "c"}),
        "source_claim": table("source_claim", {"source_claim_id": 1, "workspace_id": "s", "about_object_ref": "work:1", "claim_type": "note", "claim_text": "x", "review_state": "accepted"}),
        "source_access": table(
            "source_access",
            {"source_access_id": 1, "work_id": 1, "original_locator": "l1", "workspace_id": "s", "review_state": "proposed"},
            {"source_access_id": 2, "source_locus_id": 7, "canonical_url": "u2", "workspace_id": "s", "review_state": "proposed"},
            {"source_access_id": 3, "original_locator": "l1", "workspace_id": "other", "review_state": "proposed"},
        ),
        "capture_event": table("capture_event", {"capture_event_id": 1, "original_locator": "l1", "source_locus_ref": "l1", "workspace_id": "s"}, {"capture_event_id": 2, "source_locus_ref": "7", "workspace_id": "s"}, {"capture_event_id": 3, "original_locator": "u2", "workspace_id": "s"}, {"capture_event_id": 4, "original_locator": "l1", "workspace_id": "other"}),
        "extraction_record": table("extraction_record", {"extraction_id": 1, "capture_event_id": 1, "extraction_status": "ok"}, {"extraction_id": 2, "capture_event_id": 2, "extraction_status": "failed"}, {"extraction_id": 3, "capture_event_id": 4, "extraction_status": "ok"}),
        "extraction_detected_entity": table(
            "extraction_detected_entity",
            {"detected_entity_id": 1, "extraction_id": 1, "capture_event_id": 1, "entity_type": "person", "entity_label": "p", "workspace_id": "s", "review_state": "accepted"},
            {"detected_entity_id": 2, "extraction_id": 2, "capture_event_id": 2, "entity_type": "person", "entity_label": "q", "workspace_id": "s", "review_state": "proposed"},
            {"detected_entity_id": 3, "extraction_id": 1, "capture_event_id": 1, "entity_type": "person", "entity_label": "r", "workspace_id": "other", "review_state": "proposed"},
        ),
        "source_relationship": table("source_relationship"),
        "provenance_event": table("provenance_event"),
    }
    facets = ["works", "people", "sources", "open_questions"]
    got = {r.candidate_id: (r.facet, r.score, r.ok, r.bad) for r in lead_candidates(t, "s", facets).collect()}
    assert got == {
        "source_access:1": ("sources", 2.5 + 2.0 + 1.5 + 1.5 + 1.25, 1, 0),  # a work, a claim, an entity, a success
        "source_access:2": ("sources", 2.5 - 1.5 - 2 * 2.0, 0, 1),  # two captures without yield, one failure
        "detected_entity:2": ("people", 2.5 + 1.5 - 1.5, 0, 1),
        "work:3": ("works", 4.5, 0, 0),
    }
    plan = {r.facet: r.score for r in feedback_plan(t, "s", facets).filter("kind = 'facet'").collect()}
    assert plan == {"works": 2.5 + 4 * 0.25, "people": 2.5 - 1.5 + 3 * 0.25, "sources": 2 * 2.5 + 1.25 - 1.5 + 2 * 0.25, "open_questions": 0.25}
