"""Plans and store operators over canonical tables that are derived from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import schemas
from ..operators import projections as prj
from ..plans import audits, health, ingest, loop, reports
from .views import FAMILY_ROWS, family_rows, read


def _ref(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _store(spark, d):
    """Orders as gather events of customers, order lines as the rows that they brought."""
    events = read(spark, d, "orders").select(
        F.col("o_orderkey").alias("provenance_event_id"), _ref("prov:", "o_orderkey").alias("provenance_event_key_v1"), F.lit(loop.GATHER).alias("event_type"), _ref("run-", "o_orderkey").alias("run_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_timestamp"), F.to_json(F.struct(F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderpriority").alias("facet"), (F.col("o_orderkey") % 9).alias("cycle_depth"))).alias("note_text"),
    )
    lines = family_rows(spark, d).join(read(spark, d, "orders").select(F.col("o_orderkey").alias("event_key"), F.col("o_custkey").cast("string").alias("workspace_id")), "event_key").withColumn("provenance_event_ref", _ref("prov:", "event_key"))
    tables = {name: schemas.conform(lines.filter(F.col("family") == name), name) for name in ("work", "source_claim", "source_relationship", "extraction_detected_entity")}
    return {"provenance_event": schemas.conform(events, "provenance_event"), **tables}


def _spaces(spark, d):
    name = F.col("c_custkey").cast("string")
    return read(spark, d, "customer").select(name.alias("workspace_id"), name.alias("subject"))


def store_saturation(spark, d):
    return loop.topic_saturation(_store(spark, d), _spaces(spark, d)).select("subject", "cycles", "low_cycles", "streak", "backlog", "state", "scheduler_action", "reason_codes")


STORE_SATURATION = f"""WITH {FAMILY_ROWS}, n AS (SELECT o_orderkey, o_custkey, o_orderdate, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT o_custkey, n = 0 AS low, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM n QUALIFY rn <= 3),
s AS (SELECT c_custkey AS subject, count(rn) AS cycles, count(*) FILTER (low) AS low_cycles, coalesce(min(rn) FILTER (NOT low) - 1, count(rn)) AS streak FROM customer LEFT JOIN r ON o_custkey = c_custkey GROUP BY c_custkey),
b AS (SELECT o_custkey, count(*) AS backlog FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' GROUP BY o_custkey)
SELECT CAST(subject AS VARCHAR) AS subject, cycles, low_cycles, streak, CASE WHEN cycles >= 3 OR cycles = 0 THEN coalesce(backlog, 0) ELSE 0 END AS backlog,
  CASE WHEN cycles < 3 THEN 'active_bootstrap' WHEN streak >= 2 THEN 'saturated' ELSE 'active' END AS state, CASE WHEN cycles >= 3 AND streak >= 2 THEN 'deprioritize' ELSE 'run' END AS scheduler_action,
  CASE WHEN cycles < 3 THEN 'insufficient_history' ELSE (CASE WHEN coalesce(backlog, 0) >= 25 THEN 'review_backlog_pressure,' ELSE '' END) || (CASE WHEN streak >= 2 THEN 'consecutive_low_yield' ELSE 'recent_useful_yield' END) END AS reason_codes
FROM s LEFT JOIN b ON o_custkey = subject"""


def store_cycle_yields(spark, d):
    tables = _store(spark, d)
    return loop.cycle_yields(tables, loop.gather_events(tables["provenance_event"])).select("event_key", "subject", "facet", "cycle_depth", "work", "source_claim", "source_relationship", "extraction_detected_entity", "accepted_record", "reviewable_record", "useful")


def store_loop_health(spark, d):
    """Health of every customer: orders are cycles, some of them in the ledger; half the claims and relationships were decided, at times before the window."""
    tables = _store(spark, d)
    since = F.concat(F.lit("2001-0"), (F.col("event_key") % 9 + 1).cast("string"), F.lit("-01T00:00:00Z"))
    for name in ("work", "source_claim", "source_relationship", "extraction_detected_entity"):
        rows = family_rows(spark, d).filter(F.col("family") == name).join(read(spark, d, "orders").select(F.col("o_orderkey").alias("event_key"), F.col("o_custkey").cast("string").alias("workspace_id")), "event_key")
        rows = rows.withColumn("provenance_event_ref", _ref("prov:", "event_key")).withColumn("created_at", since).withColumn("record_last_updated", since)
        rows = rows.withColumn("predicate", F.when(F.col("review_state") == "accepted", "mentions").otherwise("contradicts")).withColumn(f"{name}_id", F.col("event_key") * 10 + F.col("line"))
        tables[name] = schemas.conform(rows, name)
    decided = []
    for name in ("source_claim", "source_relationship", "work"):
        id_ = F.col(f"{name}_id")
        odd = tables[name].filter(id_ % 2 == 1).select(F.lit("review_decision_accept").alias("event_type"), F.lit(name).alias("object_namespace"), id_.cast("string").alias("object_id"), F.concat(F.lit("199"), (id_ % 9).cast("string"), F.lit("-06-01T00:00:00Z")).alias("event_timestamp"))
        decided.append(schemas.conform(odd, "provenance_event"))
    tables["provenance_event"] = reduce(lambda a, b: a.unionByName(b), decided, tables["provenance_event"])
    tables["capture_event"], tables["extraction_record"] = (schemas.conform(read(spark, d, "region").limit(0), t) for t in ("capture_event", "extraction_record"))
    figures = F.when(F.col("c_custkey") % 6 != 0, F.to_json(F.struct((F.col("c_custkey") % 4).alias("new_reviewable_count"), F.lit(10).alias("new_source_claim_count"), (F.col("c_custkey") % 5).alias("new_contradiction_count"))))
    ledger = read(spark, d, "customer").filter(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").cast("string").alias("cycle_event_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).alias("workspace_id"), F.col("c_custkey").cast("string").alias("subject_key"), F.lit("1998-01-01T00:00:00Z").alias("started_at"), figures.alias("row_count_delta_json"))
    tables["cycle_event"] = ledger
    return health.loop_health(tables, read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("scope")), "2002-01-10T00:00:00Z")


STORE_HEALTH = f"""WITH {FAMILY_ROWS}, r AS (SELECT family, event_key, line, review_state, o_custkey AS scope, event_key * 10 + line AS id, make_timestamp(2001, CAST(event_key % 9 + 1 AS BIGINT), 1, 0, 0, 0) AS since FROM family_rows JOIN orders ON o_orderkey = event_key),
g AS (SELECT o_custkey AS scope, o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at_, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders QUALIFY nth <= 5),
gc AS (SELECT g.scope, at_, nth, count(*) FILTER (review_state = 'needs_review') AS reviewable, count(*) FILTER (review_state = 'accepted') AS accepted, count(*) FILTER (family = 'source_claim') AS claims,
    count(*) FILTER (family = 'source_relationship' AND review_state <> 'accepted') AS contradictions FROM g LEFT JOIN r ON r.event_key = o_orderkey GROUP BY g.scope, at_, nth, o_orderkey),
lc AS (SELECT c_custkey AS scope, '1998-01-01T00:00:00Z' AS at_, 1 AS nth, c_custkey % 4 AS reviewable, 0 AS accepted, 10 AS claims, c_custkey % 5 AS contradictions FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 6 <> 0),
cy AS (SELECT * FROM gc WHERE scope NOT IN (SELECT scope FROM lc) UNION ALL SELECT * FROM lc),
f AS (SELECT scope, count(*) AS cycles, CAST(sum(reviewable) AS BIGINT) AS reviewable, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(claims) AS BIGINT) AS claims, CAST(sum(contradictions) AS BIGINT) AS contradictions, max_by(at_, nth) AS since,
    max_by(reviewable, nth) AS a, min_by(reviewable, nth) AS b FROM cy GROUP BY scope),
d AS (SELECT r.scope, '199' || (id % 9) || '-06-01T00:00:00Z' AS decided_at FROM r WHERE family IN ('source_claim', 'source_relationship') AND id % 2 = 1),
dc AS (SELECT d.scope, count(*) FILTER (f.since IS NULL OR (decided_at >= f.since AND decided_at <= '2002-01-10T00:00:00Z')) AS decisions FROM d LEFT JOIN f ON f.scope = d.scope GROUP BY d.scope),
e AS (SELECT scope, count(*) AS all_contradictions, count(*) FILTER (review_state = 'needs_review') AS unresolved FROM r WHERE family = 'source_relationship' AND review_state <> 'accepted' GROUP BY scope),
p AS (SELECT scope, family, epoch_us(TIMESTAMP '2002-01-10') / 86400000000.0 - epoch_us(since) / 86400000000.0 AS age, row_number() OVER (PARTITION BY scope ORDER BY since DESC) AS k, count(*) OVER (PARTITION BY scope) AS n FROM r WHERE review_state = 'needs_review'),
b AS (SELECT scope, count(*) AS backlog, count(*) FILTER (family = 'work') AS pw, count(*) FILTER (family = 'source_claim') AS pc, count(*) FILTER (family = 'source_relationship') AS pr, count(*) FILTER (family = 'extraction_detected_entity') AS pe, min(age) AS least,
    (min(age) FILTER (k = (n + 1) // 2) + min(age) FILTER (k = (n + 2) // 2)) / 2 AS median, min(age) FILTER (k = floor((n - 1) * 0.9 + 0.5) + 1) AS p90 FROM p GROUP BY scope),
j AS (SELECT c_custkey, coalesce(cycles, 0) AS cycles, coalesce(reviewable, 0) AS reviewable, coalesce(accepted, 0) AS accepted, coalesce(claims, 0) AS claims, coalesce(contradictions, 0) AS contradictions, coalesce(all_contradictions, 0) AS all_contradictions,
    coalesce(unresolved, 0) AS unresolved, coalesce(backlog, 0) AS backlog, coalesce(pw, 0) AS pw, coalesce(pc, 0) AS pc, coalesce(pr, 0) AS pr, coalesce(pe, 0) AS pe, decisions, round(least, 2) AS least_age_days, round(median, 2) AS median_age_days, round(p90, 2) AS p90_age_days,
    round(contradictions / nullif(cycles, 0), 4) AS per_cycle, round(contradictions / nullif(claims, 0), 4) AS per_claim, round(decisions / nullif(reviewable, 0), 4) AS coverage,
    CASE WHEN coalesce(cycles, 0) < 2 THEN 'insufficient_data' WHEN b > a THEN 'rising' WHEN b < a THEN 'declining' ELSE 'flat' END AS trend
  FROM customer LEFT JOIN f ON f.scope = c_custkey LEFT JOIN dc ON dc.scope = c_custkey LEFT JOIN e ON e.scope = c_custkey LEFT JOIN b ON b.scope = c_custkey)
SELECT CAST(c_custkey AS VARCHAR) AS scope, cycles, reviewable, accepted, claims, contradictions, all_contradictions, unresolved, backlog, pw AS pending_work, pc AS pending_source_claim, pr AS pending_source_relationship, pe AS pending_extraction_detected_entity,
  CAST(0 AS BIGINT) AS pending_authority_reconciliation, CAST(0 AS BIGINT) AS pending_source_access, CAST(0 AS BIGINT) AS pending_capture_event, CAST(0 AS BIGINT) AS pending_extraction_record, per_cycle AS contradictions_per_cycle, per_claim AS contradictions_per_claim,
  decisions IS NOT NULL AS decisions_known, decisions, coverage AS resolution_coverage, least_age_days, median_age_days, p90_age_days, trend,
  CASE WHEN cycles = 0 THEN 'insufficient_data' WHEN per_claim > 0.25 THEN 'contradiction_spike' WHEN coverage < 0.5 OR least_age_days > 30 THEN 'review_lagging' WHEN backlog > 25 THEN 'accumulating'
    WHEN cycles >= 2 AND trend IN ('flat', 'declining') AND reviewable = 0 THEN 'stalled' ELSE 'healthy' END AS status FROM j"""


def store_population(spark, d):
    return prj.population({**_store(spark, d), "topic_extension": schemas.conform(read(spark, d, "region").limit(0), "topic_extension")})


def latest_events(spark, d):
    rows = read(spark, d, "events").select("event_type", F.col("event_id").alias("provenance_event_id"), _ref("e", "event_id").alias("provenance_event_key_v1"), F.col("ts").alias("event_timestamp"))
    return prj.latest_by_type(rows)


def access_counts_by_event(spark, d):
    """Accesses of events in three ways: lines by their part's supplier, stamped lines and lines under a hashed lead."""
    access = read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_access_id"), F.col("l_partkey").alias("work_id"), F.lit("proposed").alias("review_state"), F.when(F.col("l_linenumber") == 1, _ref("prov:", "l_suppkey")).alias("provenance_event_ref"),
        F.when(F.col("l_linenumber") == 2, F.concat(F.lit("source-lead:h"), F.col("l_suppkey").cast("string"), F.lit(":x"))).alias("source_lead_id"),
    )
    works = read(spark, d, "part").select(F.col("p_partkey").alias("work_id"), F.when(F.col("p_size") < 3, F.concat(F.lit("prov:"), (F.col("p_partkey") % 50).cast("string"))).alias("provenance_event_ref")).filter("provenance_event_ref IS NOT NULL")
    events = read(spark, d, "supplier").select(_ref("prov:", "s_suppkey").alias("event_key"), _ref("h", "s_suppkey").alias("artifact_hash"))
    return loop.access_counts(access, works, events).groupBy("event_key").agg(F.count("*").alias("accesses"))


def allowed_pages(spark, d):
    ok = prj.allowed_url(F.col("url"), ["the.example.com", "org"], ["http://th"])
    return read(spark, d, "pages").select("page_id", ok.alias("allowed"))


def export_blocks(spark, d):
    policies = spark.createDataFrame([("AUTOMOBILE", False), ("BUILDING", True)], "policy_class string, public_export_blocked boolean")
    return prj.export_blocked(read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("policy_class")), policies).groupBy("policy_class", "export_blocked").agg(F.count("*").alias("n"))


def handoff_rows(spark, d):
    planned = read(spark, d, "pages").select("url")
    return prj.handoffs(planned, "remote_url_manifest", "web", ["url"]).select("sequence", "locator")


def selection_records(spark, d):
    ranked = read(spark, d, "part").select(_ref("part:", "p_partkey").alias("candidate_id"), F.col("p_name").alias("label"), (F.col("p_retailprice") / 7).alias("score"), (F.col("p_partkey") + 1).alias("rank"), F.when(F.col("p_size") > 25, F.array("p_brand")).alias("reason_codes"))
    return prj.explanations(ranked, 12, "lead").withColumn("reason_codes", F.array_join("reason_codes", ","))


def bounded_claims(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", prj.bounded_claim(F.col("text")).alias("claim"), F.size(prj.unwrap("t", F.concat(prj.wrap("t", F.col("role")), prj.wrap("t", F.lit("x"))))).cast("long").alias("blocks"))


def workspace_decisions(spark, d):
    decisions = read(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "part").otherwise("supplier").alias("object_namespace"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).otherwise(F.col("l_suppkey")).cast("string").alias("object_id"), "l_orderkey")
    parts = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("workspace_id"))
    suppliers = read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")).alias("workspace_id"))
    return prj.decisions_in_workspace(decisions, {"part": parts, "supplier": suppliers}, {"part": "p_partkey", "supplier": "s_suppkey"}, "Brand#7").groupBy("object_namespace").agg(F.count("*").alias("n"))


def artifact_overview(spark, d):
    files = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_brand")).alias("artifact_key"))
    artifacts = read(spark, d, "part").groupBy(F.col("p_brand").alias("artifact_key")).agg(F.max("p_type").alias("format"))
    io = read(spark, d, "supplier").select(F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")).alias("artifact_key"), F.when(F.col("s_suppkey") % 3 == 0, "read").when(F.col("s_suppkey") % 3 == 1, "write").otherwise("read_write").alias("direction"))
    return prj.file_overview(files, artifacts, io)


def entity_workspaces(spark, d):
    entities = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("extraction_id"), F.col("l_partkey").alias("capture_event_id"), "l_linenumber", F.when(F.col("l_linenumber") == 1, "F").alias("workspace_id"))
    extractions = read(spark, d, "orders").filter("o_orderpriority != '5-LOW'").select(F.col("o_orderkey").alias("extraction_id"), F.col("o_orderstatus").alias("workspace_id"))
    captures = read(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("capture_event_id"), F.when(F.col("p_size") < 5, "F").otherwise("O").alias("workspace_id"))
    good, bad = ingest.entities_with_workspace(entities, extractions, captures)
    counts = good.groupBy(F.coalesce("workspace_id", F.lit("[none]")).alias("workspace")).agg(F.count("*").alias("n"))
    return counts.unionByName(bad.agg(F.lit("[mismatch]").alias("workspace"), F.count("*").alias("n")))


def reconciliation_moves(spark, d):
    state = F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "N", "proposed").otherwise("rejected")
    rows = read(spark, d, "lineitem").filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.max(state).alias("review_state")).select(F.col("l_orderkey").alias("reconciliation_key_v1"), "review_state")
    moves = read(spark, d, "orders").select(F.col("o_orderkey").alias("reconciliation_key_v1"), F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "proposed").otherwise("ambiguous").alias("to_state"))
    after, refused = ingest.advance_reconciliations(rows, moves)
    return after.groupBy("review_state").agg(F.count("*").alias("n")).unionByName(refused.groupBy(F.concat_ws(">", "review_state", "to_state").alias("review_state")).agg(F.count("*").alias("n")))


def locus_defaults(spark, d):
    access = read(spark, d, "lineitem").select(F.when(F.col("l_linenumber") < 6, _ref("s", "l_suppkey")).alias("source_locus_ref"))
    return ingest.assign_loci(access, read(spark, d, "supplier").filter("s_acctbal > 0").select(_ref("s", "s_suppkey").alias("locus_id"))).groupBy("source_locus_ref").agg(F.count("*").alias("n"))


def structured_counterparts(spark, d):
    edges = read(spark, d, "lineitem").select(_ref("o", "l_orderkey").alias("provenance_event_ref"), _ref("p", "l_partkey").alias("from_object_ref"), _ref("s", "l_suppkey").alias("to_object_ref"), F.lit("taught_by").alias("predicate"), "l_returnflag")
    claims = edges.filter("l_returnflag = 'A'").select("provenance_event_ref", F.col("from_object_ref").alias("about_object_ref"), F.to_json(F.struct("to_object_ref")).alias("claim_text"), F.lit("taught_by").alias("claim_type"))
    return ingest.without_structured_counterparts(edges, claims).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def backup_differences(spark, d):
    files = read(spark, d, "part").filter("p_size < 40").select(_ref("f", "p_partkey").alias("relative_path"), F.col("p_size").cast("string").alias("sha256"))
    manifest = read(spark, d, "part").filter("p_size > 10").select(_ref("f", "p_partkey").alias("relative_path"), F.when(F.col("p_size") % 7 == 0, "0").otherwise(F.col("p_size").cast("string")).alias("sha256"))
    return reports.backup_mismatches(files, manifest)


def intake_stages(spark, d):
    lines = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("adapter_id"), "l_linenumber", "l_returnflag")
    return reports.intake_status(lines.filter("l_linenumber <= 2"), lines.filter("l_linenumber = 1"), lines.filter("l_linenumber = 1 AND l_returnflag = 'A'"))


def bibliography(spark, d):
    number = F.col("p_partkey").alias("work_id")
    parts = read(spark, d, "part")
    tables = {
        "work": schemas.conform(parts.select(number, F.col("p_name").alias("title"), F.col("p_type").alias("work_type"), F.lit("reviewed").alias("review_state")), "work"),
        "work_identifier": schemas.conform(parts.filter("p_size > 25").select(number, F.lit("local").alias("scheme"), F.col("p_brand").alias("value")), "work_identifier"),
        "source_access": schemas.conform(read(spark, d, "lineitem").filter("l_linenumber = 7").select(F.col("l_partkey").alias("work_id"), _ref("o", "l_orderkey").alias("original_locator")), "source_access"),
        "source_claim": schemas.conform(parts.filter("p_size < 10").select(_ref("work:", "p_partkey").alias("about_object_ref"), F.lit("size").alias("claim_type"), F.col("p_size").cast("string").alias("claim_text")), "source_claim"),
        "source_relationship": schemas.conform(parts.filter("p_partkey % 10 = 0").select(_ref("work:", "p_partkey").alias("from_object_ref"), F.concat(F.lit("work:"), (F.col("p_partkey") % 100).cast("string")).alias("to_object_ref"), F.lit("cites").alias("predicate")), "source_relationship"),
        "work_metadata": schemas.conform(parts.select(number, F.lit("brand").alias("meta_key"), F.col("p_brand").alias("meta_value")), "work_metadata"),
    }
    out = reports.bibliography(tables)
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return out.select("work_id", "title", size("identifiers"), size("accesses"), size("claims"), size("relationships"), F.try_element_at("attributes", F.lit("brand")).alias("brand"))


def closure_of_store(spark, d):
    parts = read(spark, d, "part")
    tables = {
        "work": schemas.conform(parts.filter("p_size < 40").select(F.col("p_partkey").alias("work_id"), _ref("w", "p_partkey").alias("work_key_v1")), "work"),
        "source_claim": schemas.conform(parts.select(F.col("p_partkey").alias("source_claim_id"), _ref("c", "p_partkey").alias("source_claim_key_v1"), F.when(F.col("p_size") % 2 == 0, _ref("work:", "p_partkey")).otherwise(_ref("work:w", "p_partkey")).alias("about_object_ref")), "source_claim"),
        "source_relationship": schemas.conform(parts.select(_ref("source_claim:", "p_partkey").alias("from_object_ref"), F.when(F.col("p_size") < 45, _ref("work:", "p_partkey")).otherwise(F.lit("external:x")).alias("to_object_ref"), F.when(F.col("p_size") >= 40, "label").alias("target_label")), "source_relationship"),
    }
    return audits.closure_audit(tables)


def correction_findings(spark, d):
    """Orders as correction events of ten workspaces' ledgers: the rows of each code."""
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    no_refs = F.array().cast("array<string>")
    events = read(spark, d, "orders").select(
        F.when(order % 40 == 0, text("cle:c", customer)).otherwise(text("cle:", order)).alias("event_id"), (customer % 10).cast("string").alias("workspace_id"), order.alias("seq"),
        F.when(F.col("o_orderstatus") == "P", "split").otherwise("merge").alias("action"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("changed_at"), F.lit("operator").alias("changed_by"),
        F.when(order % 13 == 0, " ").otherwise("same record").alias("rationale"), F.lit(None).cast("string").alias("note"), F.array(text("work:", customer)).alias("source_object_refs"),
        F.array(F.when(order % 7 == 0, text("work:", customer + 10)).otherwise(text("work:", order + 100000000))).alias("result_object_refs"), F.when(order % 11 == 0, no_refs).otherwise(F.array(F.lit("prov:a"))).alias("provenance_event_refs"),
        *(no_refs.alias(c) for c in ("review_queue_refs", "evidence_locator_refs", "field_review_entry_refs")),
    )
    return audits.validate("correction_ledger", events).groupBy("code").agg(F.count("*").alias("n"))


CORRECTIONS = """WITH e AS (SELECT CASE WHEN o_orderkey % 40 = 0 THEN 'cle:c' || o_custkey ELSE 'cle:' || o_orderkey END AS id, o_custkey % 10 AS ws, o_orderkey AS seq, o_orderdate AS ts, o_orderstatus AS st, 'work:' || o_custkey AS src,
    CASE WHEN o_orderkey % 7 = 0 THEN 'work:' || (o_custkey + 10) ELSE 'work:' || (o_orderkey + 100000000) END AS res FROM orders),
k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY ws, id ORDER BY seq) = 1), f AS (SELECT ws, src AS ref, min(seq) AS first_seq FROM k GROUP BY ALL), l AS (SELECT ts, lag(ts) OVER (PARTITION BY ws ORDER BY seq) AS b FROM k),
c AS (SELECT 'INVALID_RATIONALE' AS code FROM e WHERE seq % 13 = 0 UNION ALL SELECT 'PROVENANCE_REF_REQUIRED' FROM e WHERE seq % 11 = 0 UNION ALL SELECT 'INVALID_RESULT_CARDINALITY' FROM e WHERE st = 'P'
  UNION ALL (SELECT 'DUPLICATE_EVENT_ID' FROM e EXCEPT ALL SELECT 'DUPLICATE_EVENT_ID' FROM k) UNION ALL SELECT 'EVENTS_OUT_OF_ORDER' FROM l WHERE ts < b
  UNION ALL SELECT 'SOURCE_OBJECT_NOT_CURRENT' FROM k JOIN f ON f.ws = k.ws AND ref = src AND seq > first_seq UNION ALL SELECT 'RESULT_OBJECT_ALREADY_SUPERSEDED' FROM k JOIN f ON f.ws = k.ws AND ref = res AND seq >= first_seq)
SELECT code, count(*) AS n FROM c GROUP BY code"""


def contract_report(spark, d):
    lines = read(spark, d, "events").select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 10 == 0, F.concat("props", F.lit("x"))).otherwise(F.col("props")).alias("line"))
    spaces = read(spark, d, "customer").select(F.concat(F.lit("w"), (F.col("c_custkey") % 1490).cast("string")).alias("workspace_id"), F.when(F.col("c_nationkey") > 2, "active").otherwise("odd").alias("lifecycle_state"), F.lit("scheduled").alias("schedule_posture"), F.when(F.col("c_nationkey") > 1, "a/b").otherwise("/a").alias("workspace_root"))
    return audits.report("jsonl", lines).unionByName(audits.report("topic_workspace_registry", spaces))


QUERIES = {
    f.__name__: f
    for f in (
        store_saturation, store_cycle_yields, store_loop_health, store_population, latest_events, access_counts_by_event, allowed_pages, export_blocks, handoff_rows, selection_records, bounded_claims, workspace_decisions, artifact_overview,
        entity_workspaces, reconciliation_moves, locus_defaults, structured_counterparts, backup_differences, intake_stages, bibliography, closure_of_store, contract_report, correction_findings,
    )
}

ORACLE = {
    "store_saturation": STORE_SATURATION,
    "store_loop_health": STORE_HEALTH,
    "correction_findings": CORRECTIONS,
    "store_cycle_yields": f"""WITH {FAMILY_ROWS} SELECT 'prov:' || o_orderkey AS event_key, CAST(o_custkey AS VARCHAR) AS subject, o_orderpriority AS facet, CAST(o_orderkey % 9 AS INTEGER) AS cycle_depth, count(*) FILTER (family = 'work') AS work, count(*) FILTER (family = 'source_claim') AS source_claim,
  count(*) FILTER (family = 'source_relationship') AS source_relationship, count(*) FILTER (family = 'extraction_detected_entity') AS extraction_detected_entity, count(*) FILTER (review_state = 'accepted') AS accepted_record, count(*) FILTER (review_state = 'needs_review') AS reviewable_record,
  CAST(count(family) + 2 * count(*) FILTER (review_state = 'accepted') + count(*) FILTER (review_state = 'needs_review') AS DOUBLE) AS useful FROM orders LEFT JOIN family_rows ON event_key = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderpriority""",
    "store_population": f"""WITH {FAMILY_ROWS} SELECT family AS "table", count(*) AS rows, 'populated' AS status FROM family_rows GROUP BY family UNION ALL SELECT 'provenance_event', count(*), 'populated' FROM orders UNION ALL SELECT 'topic_extension', 0, 'empty'""",
    "latest_events": "SELECT event_type, count(*) AS n, 'e' || max_by(event_id, (ts, event_id)) AS latest FROM events GROUP BY event_type",
    "access_counts_by_event": """WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS id, * FROM lineitem), u AS (SELECT 'prov:' || (p_partkey % 50) AS k, id FROM a JOIN part ON p_partkey = l_partkey AND p_size < 3
  UNION SELECT 'prov:' || s_suppkey, id FROM a JOIN supplier ON s_suppkey = l_suppkey AND l_linenumber = 2 UNION SELECT 'prov:' || l_suppkey, id FROM a WHERE l_linenumber = 1) SELECT k AS event_key, count(*) AS accesses FROM u GROUP BY k""",
    "allowed_pages": r"SELECT page_id, regexp_matches(h, '(^|\.)(the\.example\.com|org)$') OR starts_with(url, 'http://th') AS allowed FROM (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), ':[0-9]+$', '') AS h FROM pages)",
    "export_blocks": "SELECT c_mktsegment AS policy_class, c_mktsegment <> 'AUTOMOBILE' AS export_blocked, count(*) AS n FROM customer GROUP BY ALL",
    "handoff_rows": """SELECT row_number() OVER (ORDER BY url) AS sequence, '{"url":"' || url || '"}' AS locator FROM pages""",
    "selection_records": """SELECT 'part:' || p_partkey AS candidate_id, 'lead' AS candidate_type, p_name AS label, round(p_retailprice / 7, 4) AS score, p_partkey < 12 AS selected, CASE WHEN p_partkey < 12 THEN 'eligible' ELSE 'deferred' END AS eligibility_status,
  CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS reason_codes, CASE WHEN p_partkey < 12 THEN 'rank ' || (p_partkey + 1) ELSE 'rank below limit' END AS rationale FROM part""",
    "bounded_claims": r"SELECT conv_id, turn, coalesce(nullif(substr(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')), 1, 240), ''), 'claim-fallback-empty') AS claim, CAST(2 AS BIGINT) AS blocks FROM conversations",
    "workspace_decisions": "SELECT 'part' AS object_namespace, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber % 2 = 0 AND p_brand = 'Brand#7' UNION ALL SELECT 'supplier', count(*) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber % 2 = 1 AND s_nationkey = 7 HAVING count(*) > 0",
    "artifact_overview": """WITH a AS (SELECT p_brand AS k, max(p_type) AS format FROM part GROUP BY p_brand), io AS (SELECT 'Brand#' || s_nationkey AS k, count(*) FILTER (s_suppkey % 3 <> 0) AS p, count(*) FILTER (s_suppkey % 3 <> 1) AS c FROM supplier GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size > 5 THEN p_brand END AS artifact_key, a.format, coalesce(p, 0) AS producers, coalesce(c, 0) AS consumers FROM part LEFT JOIN a ON a.k = p_brand AND p_size > 5 LEFT JOIN io ON io.k = p_brand AND p_size > 5""",
    "entity_workspaces": """WITH e AS (SELECT CASE WHEN l_linenumber = 1 THEN 'F' END AS w0, o_orderstatus AS w1, CASE WHEN p_size < 5 THEN 'F' WHEN p_partkey IS NOT NULL THEN 'O' END AS w2 FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderpriority <> '5-LOW' LEFT JOIN part ON p_partkey = l_partkey AND p_size < 10)
SELECT coalesce(w0, w1, w2, '[none]') AS workspace, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT '[mismatch]', count(*) FROM e WHERE w0 <> w1 OR w0 <> w2 OR w1 <> w2""",
    "reconciliation_moves": """WITH r AS (SELECT l_orderkey AS k, max(CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'proposed' ELSE 'rejected' END) AS st FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey),
m AS (SELECT k, st, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'proposed' ELSE 'ambiguous' END AS t FROM r JOIN orders ON o_orderkey = k), j AS (SELECT *, (st = 'proposed' AND t IN ('accepted', 'ambiguous')) OR (st = 'rejected' AND t = 'proposed') AS ok FROM m)
SELECT CASE WHEN ok THEN t ELSE st END AS review_state, count(*) AS n FROM j GROUP BY 1 UNION ALL SELECT st || '>' || t, count(*) FROM j WHERE NOT ok AND st <> t GROUP BY 1""",
    "locus_defaults": "SELECT CASE WHEN l_linenumber < 6 AND s_suppkey IS NOT NULL THEN 's' || l_suppkey ELSE 'locus:unknown' END AS source_locus_ref, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 GROUP BY 1",
    "structured_counterparts": "SELECT l_returnflag, count(*) AS n FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'A' AND b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey) GROUP BY 1",
    "backup_differences": "SELECT 'f' || p_partkey AS relative_path, CASE WHEN p_size <= 10 THEN 'not_in_manifest' WHEN p_size >= 40 THEN 'missing' ELSE 'changed' END AS problem FROM part WHERE p_size <= 10 OR p_size >= 40 OR p_size % 7 = 0",
    "intake_stages": """WITH c AS (SELECT l_suppkey AS adapter_id, count(*) FILTER (l_linenumber <= 2) AS planned, count(*) FILTER (l_linenumber = 1) AS captured, count(*) FILTER (l_linenumber = 1 AND l_returnflag = 'A') AS extracted FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN captured = 0 THEN 'planned' WHEN captured < planned THEN 'capturing' WHEN extracted < captured THEN 'extracting' ELSE 'complete' END AS stage FROM c WHERE planned > 0""",
    "bibliography": """SELECT p_partkey AS work_id, p_name AS title, CAST(p_size > 25 AS BIGINT) AS n_identifiers, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber = 7) AS n_accesses, CAST(p_size < 10 AS BIGINT) AS n_claims,
  (SELECT count(*) FROM part q WHERE q.p_partkey % 10 = 0 AND (q.p_partkey = p.p_partkey OR q.p_partkey % 100 = p.p_partkey)) AS n_relationships, p_brand AS brand FROM part p""",
    "closure_of_store": """WITH f AS (SELECT 'source_claim.about_object_ref' AS family, CASE WHEN p_size < 40 THEN 'resolved' ELSE 'orphan' END AS fate FROM part UNION ALL SELECT 'source_relationship.from_object_ref', 'resolved' FROM part
  UNION ALL SELECT 'source_relationship.to_object_ref', CASE WHEN p_size < 40 THEN 'resolved' WHEN p_size < 45 THEN 'unresolved_tracked' ELSE 'exempt' END FROM part),
c AS (SELECT family, count(*) AS total, count(*) FILTER (fate = 'resolved') AS resolved, count(*) FILTER (fate = 'exempt') AS exempt, count(*) FILTER (fate = 'unresolved_tracked') AS unresolved_tracked, count(*) FILTER (fate = 'orphan') AS orphan FROM f GROUP BY family)
SELECT *, CASE WHEN orphan > 0 THEN 'fail' WHEN unresolved_tracked > 0 THEN 'pass_with_unresolved' ELSE 'pass' END AS status FROM c""",
    "contract_report": """WITH w AS (SELECT 'w' || (c_custkey % 1490) AS k, c_nationkey AS n FROM customer), bad AS (SELECT k, 'LIFECYCLE' AS c FROM w WHERE n <= 2 UNION ALL SELECT k, 'ROOT' FROM w WHERE n <= 1 UNION ALL SELECT k, 'DUPLICATE_KEY' FROM w GROUP BY k HAVING count(*) > 1)
SELECT 'jsonl' AS artifact, count(*) AS inspected, count(*) FILTER (event_id % 10 = 0) AS rejected, 'JSON' AS codes, 'fail' AS status FROM events UNION ALL
SELECT 'topic_workspace_registry', (SELECT count(*) FROM w), count(DISTINCT k), array_to_string(list_sort(list(DISTINCT c)), ','), 'fail' FROM bad""",
}
