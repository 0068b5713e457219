"""Merges, the snapshot store, sources, sinks and functions on small rows."""

import json
import uuid

import pytest
from pyspark.sql import functions as F


def test_merge_folds_arrivals_in_order(spark):
    from ledgerlens.operators.upsert import WORK_RULES, merge

    schema = "k string, title string, review_state string, confidence_score double, first_seen_at string"
    old = spark.createDataFrame([("a", "A", "accepted", 0.9, "2024-01-02T00:00:00Z"), ("b", "B", "proposed", 0.1, "2024-01-02T00:00:00Z"), (None, "N", "proposed", 0.2, "x")], schema)
    new = spark.createDataFrame(
        [
            (1, "a", " ", "proposed", 0.5, "2024-01-01T23:00:00-05:00"),
            (2, "a", "A3", "proposed", 0.4, "2024-01-01T00:00:00Z"),
            (1, "b", "B2", "reviewed", 0.6, "2024-01-03T00:00:00Z"),
            (2, "b", "B3", "proposed", 0.7, None),
            (1, None, "N2", "needs_review", None, "y"),
            (1, "c", "C", "proposed", 0.3, "2024-05-01T00:00:00Z"),
        ],
        "at int, " + schema,
    )
    got = {r.k: r for r in merge(old, new, ["k"], WORK_RULES, arrival="at").collect()}
    assert set(got) == {"a", "b", "c", None}
    assert (got["a"].title, got["a"].review_state, got["a"].confidence_score, got["a"].first_seen_at) == ("A3", "accepted", 0.9, "2024-01-01T00:00:00Z")
    assert (got["b"].title, got["b"].review_state, got["b"].confidence_score) == ("B3", "reviewed", 0.6)
    assert (got[None].title, got[None].confidence_score) == ("N2", 0.2)


def test_merge_of_many_arrivals_is_merges_one_by_one(spark):
    """Random states, blanks, nulls and ties: one pass gives what a merge for each arrival gives."""
    import random

    from ledgerlens.operators.upsert import WORK_RULES, merge

    r = random.Random(5)
    states = ["proposed", "needs_review", "accepted", "reviewed", "rejected", "superseded", None]
    stamps = ["2024-01-01T00:00:00Z", "2024-01-01T01:00:00+01:00", "2024-03-01T00:00:00Z", "no date", None]
    schema = "k string, title string, review_state string, confidence_score double, publication_state string, first_seen_at string, last_seen_at string, accepted_for_citation int, note string"

    def row(k):
        return (k, r.choice(["", " ", None, "T1 ", "T2"]), r.choice(states), r.choice([None, 0.1, 0.5, 0.9]), r.choice([None, "a", "b"]), r.choice(stamps), r.choice(stamps), r.choice([None, 0, 1]), r.choice([None, "x", "y"]))

    keys = [f"k{i}" for i in range(60)] + [None]
    old = spark.createDataFrame([row(k) for k in keys[::2]], schema)
    new = [(n, *row(k)) for k in keys for n in range(r.randrange(6))]
    got = merge(old, spark.createDataFrame(new, "at int, " + schema), ["k"], WORK_RULES, arrival="at")
    want = old
    for n in range(6):
        want = merge(want, spark.createDataFrame([x[1:] for x in new if x[0] == n], schema), ["k"], WORK_RULES)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_merge_twice_is_once(spark):
    from ledgerlens.operators.fingerprint import fingerprint
    from ledgerlens.operators.upsert import WORK_RULES, merge

    schema = "k int, title string, review_state string"
    old = spark.createDataFrame([(i, f"t{i}", "proposed") for i in range(20)], schema)
    new = spark.createDataFrame([(i, f"n{i}", "accepted") for i in range(10, 30)], schema)
    once = merge(old, new, ["k"], WORK_RULES)
    assert fingerprint(once).first() == fingerprint(merge(once, new, ["k"], WORK_RULES)).first()
    assert once.count() == 30


def test_snapshot_keeps_both_writers_or_refuses_one(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from ledgerlens.operators.upsert import CommitConflict, Snapshot

    path = f"file://{tmp_path}/store"
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    Snapshot(spark, path).commit({"t": rows(0)})
    names = [f"t{i}" for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda n: Snapshot(spark, path).commit({n: rows(1, 2)}), names))
    assert set(Snapshot(spark, path).manifest()) == {"t", *names}
    first, second = Snapshot(spark, path), Snapshot(spark, path)
    a, b = first.table("t").union(rows(1)), second.table("t").union(rows(2))
    first.commit({"t": a})
    with pytest.raises(CommitConflict, match="t"):
        second.commit({"t": b})
    second.commit({"t": second.table("t").union(rows(2))})
    assert sorted(x for (x,) in Snapshot(spark, path).table("t").collect()) == [0, 1, 2]


def test_snapshot_commits_all_tables_or_none(spark, tmp_path):
    from ledgerlens.operators.upsert import Snapshot
    from ledgerlens.schemas import conform

    store = Snapshot(spark, f"file://{tmp_path}/store")
    assert store.table("work").count() == 0
    works = conform(spark.createDataFrame([(1, "w:1")], "work_id long, work_key_v1 string"), "work")
    claims = conform(spark.createDataFrame([(1, "c:1"), (2, "c:2")], "source_claim_id long, source_claim_key_v1 string"), "source_claim")
    before = store.commit({"work": works, "source_claim": claims})
    assert store.table("work").count() == 1 and store.table("source_claim").count() == 2
    after = store.commit({"work": store.table("work").union(works)})
    assert after["source_claim"] == before["source_claim"] and after["work"] != before["work"]
    assert store.table("work").count() == 2
    with pytest.raises(ZeroDivisionError):

        class Bad:
            @property
            def write(self):
                raise ZeroDivisionError

        store.commit({"work": works, "source_claim": Bad()})
    assert store.manifest() == after and store.table("work").count() == 2


def test_assign_ids(spark):
    from ledgerlens.operators.upsert import assign_ids

    rows = spark.createDataFrame([(None, c) for c in "dacb"], "id long, k string")
    assert [(r.id, r.k) for r in assign_ids(rows, "id", 10, ["k"]).orderBy("id").collect()] == [(10, "a"), (11, "b"), (12, "c"), (13, "d")]


def test_review_decisions_are_idempotent(spark):
    from ledgerlens.operators.upsert import review_decisions

    targets = spark.createDataFrame([(1, "proposed"), (2, "accepted"), (3, "proposed")], "id int, review_state string")
    decisions = spark.createDataFrame([(1, "proposed", "accepted", "x", "t", "r"), (2, "proposed", "rejected", "x", "t", "r"), (3, None, "rejected", "x", "t", "r")], "id int, expected_state string, new_state string, changed_by string, changed_at string, reason string")
    now, history = review_decisions(targets, decisions, "id")
    assert {(r.id, r.review_state) for r in now.collect()} == {(1, "accepted"), (2, "accepted"), (3, "rejected")}
    assert history.count() == 2
    assert review_decisions(now, decisions, "id")[1].count() == 0


def test_records_with_locators(spark, tmp_path):
    from ledgerlens.sources.records import quarantine, read_records

    (tmp_path / "a.csv").write_text("id,title\n1,One\n2\n3,Three,x\n4,Four\n")
    (tmp_path / "dup.csv").write_text("id,id\n1,2\n")
    (tmp_path / "b.json").write_text('{"records": [{"id": 1}, [2], "s"], "one": {"x": 1}}')
    (tmp_path / "c.jsonl").write_text('{"id": 1}\n\n{"id": 2\n{"a": 1, "a": 2}\n{"n": NaN}\n[3]\n')
    (tmp_path / "d.xml").write_text("<records><record id='7'><t>x</t></record><other/><record id='8'/></records>")
    (tmp_path / "e.bin").write_bytes(b"\xff")
    good, bad = quarantine(read_records(spark, f"file://{tmp_path}", record_path=""))
    where = {(r.path.rsplit("/", 1)[1], r.locator): json.loads(r.record_json) for r in good.collect()}
    assert where[("a.csv", "row:1")] == {"id": "1", "title": "One"} and where[("a.csv", "row:4")]["title"] == "Four"
    assert where[("c.jsonl", "line:1")] == {"id": 1} and where[("c.jsonl", "line:6")] == [3]
    assert where[("d.xml", "/records[1]/record[2]")] == {"@id": "8"} and where[("d.xml", "/records[1]/record[1]")] == {"@id": "7", "t": "x"}
    errors = {(r.path.rsplit("/", 1)[1], r.locator): r.error for r in bad.collect()}
    assert errors[("a.csv", "row:2")] == "missing fields" and errors[("a.csv", "row:3")] == "extra fields"
    assert errors[("dup.csv", "row:0")] == "duplicate header"
    assert "column" in errors[("c.jsonl", "line:3")] and "duplicate key" in errors[("c.jsonl", "line:4")] and "NaN" in errors[("c.jsonl", "line:5")]
    assert errors[("e.bin", "file")] == "unsupported format"
    nested = read_records(spark, f"file://{tmp_path}/b.json", record_path="records").orderBy("locator").collect()
    assert [(r.locator, r.record_kind) for r in nested] == [("index:0", "object"), ("index:1", "array"), ("index:2", "scalar")]
    assert read_records(spark, f"file://{tmp_path}/b.json", record_path="one").first().locator == "object:1"
    assert read_records(spark, f"file://{tmp_path}/b.json", record_path="none.0").first().error is not None


def test_folder_listing_and_payloads(spark, tmp_path):
    from ledgerlens.sources.listing import inventory_kinds, list_folder, missing_references, plan_rollup
    from ledgerlens.sources.records import classify_payloads

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("hello\n")
    (tmp_path / "in/sub/b.txt").write_bytes(b"a\x00b")
    (tmp_path / "in/sub/c.md").write_bytes(b"\xff\xfe bad")
    (tmp_path / "in/sub/skip.txt").write_text("x" * 70000)
    listed = list_folder(spark, f"{tmp_path}/in", exclude=["**/skip.*"], suffixes=[".txt"])
    assert {r.relative_path: r.skip_reason for r in listed.collect()} == {"a.txt": None, "sub/b.txt": None, "sub/c.md": "unsupported_suffix", "sub/skip.txt": "excluded"}
    assert tuple(plan_rollup(listed).first()) == ("ready", 2, 2)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/in").select("path", "content")
    status = {r.path.rsplit("/", 1)[1]: r.status for r in classify_payloads(files).collect()}
    assert status == {"a.txt": "text", "b.txt": "binary", "c.md": "bad_utf8", "skip.txt": "oversized"}
    rules = [(2, "**", "text"), (1, "**/*.md", "notes")]
    assert {r.relative_path: r.kind for r in inventory_kinds(listed, rules).collect()}["sub/c.md"] == "notes"
    gone = missing_references(spark.createDataFrame([("a.txt",), ("z.txt",)], "relative_path string"), listed, "relative_path")
    assert [r[0] for r in gone.collect()] == ["z.txt"]


def test_url_manifest(spark, tmp_path):
    from ledgerlens.sources.listing import url_manifest

    lines = ['{"url": "https://Example.org/x", "title": "t"}', '{"url": "ftp://example.org/x"}', '{"url": "http://other.net/docs/1"}', "{bad"]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    got = [(r.host, r.action) for r in url_manifest(spark, f"{tmp_path}/m.jsonl", hosts=["example.org"]).collect()]
    assert sorted(a for _, a in got) == ["allow", "corrupt", "deny_host", "deny_scheme"]


def test_git_files(spark, tmp_path):
    import subprocess

    from ledgerlens.sources.listing import git_files

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x")
    (tmp_path / "b.txt").write_text("yy")
    run("add", "a.py", "b.txt")
    run("commit", "-qm", "m")
    (tmp_path / "c.py").write_text("untracked")
    assert [(r.path, r.byte_count) for r in git_files(spark, str(tmp_path), include=["*.py"]).collect()] == [("a.py", 1)]


def test_candidates_and_execution(spark, tmp_path):
    from ledgerlens.sources.artifacts import candidates, capture_rows, execution, ledger, loci

    batch = {"run_id": "r", "created_at": "2024-01-01", "subject": {"subject_id": "s"}, "facet": {"name": "people"}, "candidates": [{"candidate_id": "1", "candidate_type": "claim", "text": '{"value": 1}'}, {"candidate_id": "2", "candidate_type": "odd", "text": "prose"}, {"candidate_id": "3", "candidate_type": "work", "text": "[1]"}]}
    (tmp_path / "b.json").write_text(json.dumps(batch))
    got = {r.candidate_id: r for r in candidates(spark, f"{tmp_path}/b.json").collect()}
    assert (got["1"].family, got["1"].payload_json) == ("source_claim", '{"value": 1}')
    assert (got["2"].family, got["2"].payload_json) == ("unrouted", None) and got["3"].payload_json is None
    (tmp_path / "c.jsonl").write_text('{"capture_id": "c1", "status": "captured"}\n{"capture_id": "c2"}\n')
    (tmp_path / "x.jsonl").write_text('{"extraction_id": "e1", "capture_id": "c1", "status": "completed"}\n')
    assert {(r.capture_id, r.extraction_status) for r in execution(spark, f"{tmp_path}/c.jsonl", f"{tmp_path}/x.jsonl").collect()} == {("c1", "completed"), ("c2", None)}
    (tmp_path / "l.jsonl").write_text('{"event_id": "1", "occurred_at": "2024-01-01T00:00:00+02:00", "workspace_id": "w"}\n{"event_id": "2", "occurred_at": "soon", "workspace_id": "v"}\n')
    assert [r.ts is None for r in ledger(spark, f"{tmp_path}/l.jsonl").orderBy("event_id").collect()] == [False, True]
    assert ledger(spark, f"{tmp_path}/l.jsonl", "w").count() == 1
    (tmp_path / "s.jsonl").write_text('{"locus_id": "a"}\n')
    row = loci(spark, f"{tmp_path}/s.jsonl").first()
    assert (row.review_state, row.is_deprecated, row.productivity_leads, row.languages) == ("needs_review", False, 0, [])
    planned = spark.createDataFrame([("p", 1), ("q", 2)], "path string, sequence int")
    payloads = spark.createDataFrame([("p", "abc", 3, "text")], "path string, sha256 string, byte_count long, status string")
    assert {(r.path, r.capture_status, r.extraction_status) for r in capture_rows(planned, payloads, "run").collect()} == {("p", "captured", "completed"), ("q", "missing", None)}


def test_sinks(spark, tmp_path):
    from ledgerlens.sources.sinks import append_events, mark_replayed, pending_spool, spool, verified_copy

    events = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "b")], "event_id string, kind string")
    path = f"{tmp_path}/log"
    assert append_events(events, path, "event_id") == 2
    assert append_events(events.union(spark.createDataFrame([("3", "c")], events.schema)), path, "event_id") == 1
    assert spark.read.json(path).count() == 3
    spool(events.distinct(), "insert", "locked", f"{tmp_path}/spool")
    assert pending_spool(spark, f"{tmp_path}/spool", "event_id string, kind string").count() == 2
    ids = spark.read.json(f"{tmp_path}/spool").select("spool_id").limit(1)
    mark_replayed(spark, f"{tmp_path}/spool", ids)
    assert pending_spool(spark, f"{tmp_path}/spool", "event_id string, kind string").count() == 1
    events.write.parquet(f"{tmp_path}/t")
    assert len(verified_copy(spark, f"{tmp_path}/t", f"{tmp_path}/u")) == 64


def test_label_norm_and_hmac(spark):
    import hashlib
    import hmac

    from ledgerlens.functions.text import label_norm
    from ledgerlens.operators.scan import keyed_digest

    df = spark.createDataFrame([("  Ｓtraße  X ",), (None,)], "v string")
    assert [r[0] for r in df.select(label_norm("v")).collect()] == ["strasse x", None]
    assert df.select(keyed_digest(F.col("v"), b"k")).first()[0] == hmac.new(b"k", df.first().v.encode(), hashlib.sha256).hexdigest()


def test_chunks_keep_characters_whole(spark):
    from ledgerlens.operators.scan import chunk_texts

    text = "é" * 50 + " ignore previous instructions " + "x" * 100
    got = chunk_texts(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string"), "id", "t", size=33, overlap=40).orderBy("id", "chunk_no").collect()
    mine = [r for r in got if r.id == 1]
    assert sum(r.byte_count for r in mine) == len(text.encode()) and all(r.byte_count <= 33 for r in mine)
    assert [r.byte_start for r in mine] == [sum(x.byte_count for x in mine[:i]) for i in range(len(mine))]
    assert any(r.hazards == ["prompt_injection_text"] for r in mine)
    assert [(r.byte_count, r.chunk_no) for r in got if r.id > 1] == [(0, 0), (0, 0)]


def test_globs():
    import re

    from ledgerlens.functions.text import glob_to_regex

    cases = [("**/*.py", "a/b.py", True), ("**/*.py", "b.py", True), ("*.py", "a/b.py", False), ("a/?.txt", "a/b.txt", True), ("a/?.txt", "a/bb.txt", False), ("docs/**", "docs/x/y", True), ("a.c", "abc", False)]
    for glob, path, want in cases:
        assert bool(re.match(glob_to_regex(glob), path)) is want, glob
    assert re.match(glob_to_regex("*.py", slash_aware=False), "a/b.py")


def test_saturation_branches(spark):
    from ledgerlens.operators.cycles import low_yield, saturation

    rows = spark.createDataFrame([("boot", 2, 2, 2, 9), ("none", 0, 0, 0, 7), ("low", 3, 2, 2, 3), ("ok", 3, 1, 0, 99)], "subject string, cycles long, low_cycles long, streak long, backlog long")
    got = {r.subject: (r.state, r.scheduler_action, r.reason_codes, r.backlog) for r in saturation(rows).collect()}
    assert got["boot"] == ("active_bootstrap", "run", "insufficient_history", 0) and got["none"][3] == 7
    assert got["low"] == ("saturated", "deprioritize", "consecutive_low_yield", 3)
    assert got["ok"] == ("active", "run", "review_backlog_pressure,recent_useful_yield", 99)
    assert saturation(rows, action="cooldown").filter("subject = 'low'").first().state == "cooldown"
    one = spark.createDataFrame([(0, 1, 0.5)], "a int, r int, u double")
    modes = {m: one.select(low_yield(F.col("a"), F.col("r"), F.col("u"), m)).first()[0] for m in ("mixed", "accepted_only", "reviewable_yield")}
    assert modes == {"mixed": False, "accepted_only": True, "reviewable_yield": False}


def test_stream_equals_batch_over_late_files(spark, tmp_path):
    from ledgerlens.operators.review import failure_state, terminal_outcomes
    from ledgerlens.streaming.failures import failure_states, stream_ledger

    schema = "event_id string, run_id string, workspace_id string, event_type string, ts timestamp"
    rows = [(str(i), f"r{i % 9}", f"w{i % 3}", ("run_failed", "run_succeeded", "run_failed", "run_odd")[i * 7 % 4], f"2024-01-{1 + (i * 11) % 28:02d} 00:00:00") for i in range(60)]
    log = tmp_path / "log"
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema.replace("timestamp", "string")).coalesce(1).write.mode("append").json(str(log))
    name = f"states_{uuid.uuid4().hex}"
    query = failure_states(stream_ledger(spark, str(log), schema, 1)).writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    seen = {}
    for r in spark.table(name).collect():
        seen.setdefault(r.workspace_id, []).append((r.runs, r.state, r.failure_streak))
    batch = failure_state(terminal_outcomes(spark.read.schema(schema).json(str(log)), "workspace_id", "run_id", "ts", "event_id", "event_type", ["run_succeeded"], ["run_failed"]), "workspace_id").collect()
    for r in batch:
        assert (r.state, r.failure_streak) in [(s, n) for _, s, n in seen[r.workspace_id]]


def test_json_is_one_value(spark):
    from ledgerlens.functions.values import is_json, json_number

    texts = ['{"k": 1}', '{"k": 1}x', '{"k": 1},{"k": 2}', "[1, 2]", '{"k": 1, "k": 2}', '{"k": NaN}', "", " ", None, "null", '"s"', '{"k": "7"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(is_json(F.col("t")).alias("ok"), json_number(F.col("t"), "k").alias("k")).collect()
    assert [r.ok for r in got] == [True, False, False, True, False, False, False, False, False, True, True, True]
    assert [r.k for r in got] == [1, None, None, None, None, None, None, None, None, None, None, 7]


def test_labels_are_composed_and_folded(spark):
    import unicodedata

    from ledgerlens.functions.text import label

    texts = ["  A\tB\x1cc ", "\uff26\uff55\uff4c\uff4c  Width", "e\u0301tude", "\u00e9tude", "STRASSE", "Stra\u00dfe", "\ufb01n", "\u00a0x\u2003y", "", None]
    got = [r.got for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", label(F.col("t")).alias("got")).orderBy("i").collect()]
    assert got == [None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in texts]
    assert got[2] == got[3] and got[4] == got[5]


def test_append_only_counts_the_same_however_rows_lie(spark):
    from ledgerlens.operators.scan import check_append_only

    rows = [(1, "u", 5, 10), (2, "u", 5, 30), (3, "u", 6, 20), (4, "u", 6, 20), (5, "v", 1, 9), (6, "v", 1, 8)]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        events = spark.createDataFrame(order, "event int, user string, seq int, ts int").coalesce(1)
        assert [(x.key, x.code) for x in check_append_only(events, "event", "ts", ["user"]).collect()] == [("3", "OUT_OF_ORDER")]
