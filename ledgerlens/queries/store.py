"""Review queue, prior state, scheduling, publication, merges, registry views and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import states, values
from ..operators import fingerprint as fp
from ..operators import review, scan, upsert
from .views import WORKS, read, works


def review_queue_topk(spark, d):
    w = works(spark, d).select(F.col("work_id").alias("pk"), F.col("title").alias("label"), "review_state", "confidence_score", "public_blocker")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("pk"), F.col("c_name").alias("label"), F.when(F.col("c_nationkey") < 20, "proposed").otherwise("accepted").alias("review_state"), F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") / 10000, 4)).alias("confidence_score"), F.lit(None).cast("string").alias("public_blocker"))
    return review.queue({"work": w, "authority": c})


QUEUE = f"""{WORKS}, t AS (SELECT 'work' AS target_type, CAST(work_id AS VARCHAR) AS pk, title AS label, review_state, confidence_score, public_blocker FROM works WHERE review_state <> 'reviewed'
  UNION ALL SELECT 'authority', CAST(c_custkey AS VARCHAR), c_name, 'proposed', CASE WHEN c_acctbal > 0 THEN round(c_acctbal / 10000, 4) END, NULL FROM customer WHERE c_nationkey < 20)"""


def prior_state_paged(spark, d):
    rows = works(spark, d).select(F.col("work_id").alias("pk"), "title", "review_state", "confidence_score", "workspace_id", F.col("work_type").alias("last_updated"))
    page = review.prior_state(rows, F.col("workspace_id") == "en", "work", limit=5)
    return page.select("pk", "title", "label", F.col("total"))


def context_budget(spark, d):
    """The leading lines of one page of titles that fit a prompt's budget."""
    page = works(spark, d).orderBy("work_id").limit(50).select("work_id", "title")
    return review.within_budget(page, ["work_id"], "title", 1500)


def selection_with_deferral(spark, d):
    now = F.lit("2001-08-01 00:00:00").cast("timestamp")
    last = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_failure_at"), F.count_if(F.col("o_orderstatus") == "F").alias("failure_streak"))
    rows = read(spark, d, "customer").join(last, "c_custkey", "left").select(
        F.col("c_custkey").alias("workspace_id"), F.when(F.col("c_nationkey") == 0, "archived").otherwise("active").alias("lifecycle_state"), F.when(F.col("c_mktsegment") == "BUILDING", "manual").otherwise("scheduled").alias("schedule_posture"),
        F.when(F.col("c_custkey") % 50 == 0, "blocked").otherwise("healthy").alias("failure_state"), F.coalesce("failure_streak", F.lit(0)).alias("failure_streak"), F.col("last_failure_at").cast("timestamp").alias("last_failure_at"),
        F.when(F.col("c_custkey") % 4 == 0, "deprioritize").when(F.col("c_custkey") % 9 == 0, "halt").when(F.col("c_custkey") % 9 == 1, "cooldown").otherwise("run").alias("scheduler_action"),
    )
    return review.select_workspaces(rows, now, 40)


SELECTION_SQL = """WITH last AS (SELECT o_custkey, max(o_orderdate) FILTER (o_orderstatus = 'F') AS failed_at, count(*) FILTER (o_orderstatus = 'F') AS streak FROM orders GROUP BY o_custkey),
w AS (SELECT c_custkey AS id, c_custkey % 4 = 0 AS behind, list_filter([CASE WHEN c_nationkey = 0 THEN 'lifecycle_not_active' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'posture_not_scheduled' END, CASE WHEN c_custkey % 50 = 0 THEN 'blocked' END,
  CASE WHEN coalesce(streak, 0) >= 5 THEN 'max_attempts_reached' END, CASE WHEN failed_at + INTERVAL 3600 SECOND > TIMESTAMP '2001-08-01' THEN 'backoff_active' END,
  CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 9 = 0 THEN 'saturation_halt' END, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 9 = 1 THEN 'saturation_cooldown' END], lambda x: x IS NOT NULL) AS r FROM customer LEFT JOIN last ON o_custkey = c_custkey),
top AS (SELECT id FROM w WHERE len(r) = 0 ORDER BY behind, id LIMIT 40)
SELECT id AS workspace_id, id IN (SELECT id FROM top) AS selected, CASE WHEN id IN (SELECT id FROM top) THEN '' WHEN len(r) > 0 THEN array_to_string(r, ', ') ELSE 'selection limit reached' END AS deferral FROM w"""


def _outcomes(spark, d):
    events = read(spark, d, "events").select("user_id", F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("run_id"), "ts", "event_id", "event_type").filter("event_type IN ('purchase', 'error', 'signup')")
    return review.terminal_outcomes(events, "user_id", "run_id", "ts", "event_id", "event_type", ["purchase"], ["error"])


def run_outcomes(spark, d):
    return _outcomes(spark, d).select("user_id", "run_id", "event", "outcome")


def failure_streak_state(spark, d):
    out = review.failure_state(_outcomes(spark, d), "user_id", 600, 3)
    return out.select("user_id", "state", "failure_streak", F.unix_micros("next_retry_at").alias("next_retry_us"))


OUTCOMES = """last AS (SELECT user_id, user_id || '-' || (event_id % 7) AS run_id, max_by(event_type, (ts, event_id)) AS kind, max((ts, event_id)) AS k FROM events WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY 1, 2),
outcomes AS (SELECT user_id, run_id, k[1] AS ts, k[2] AS event, CASE kind WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'unknown' END AS outcome FROM last)"""


def blank_bucket_counts(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy(states.blank_bucket(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "  ")).alias("bucket")).agg(F.count("*").alias("n"))


def touch_summary(spark, d):
    key = lambda c, ok: F.coalesce(F.when(ok, F.col(c).cast("string")), F.lit("<none>")).alias(c)
    return read(spark, d, "lineitem").groupBy(key("l_returnflag", F.col("l_linenumber") != 1), key("l_linestatus", F.col("l_linenumber") != 2), key("l_linenumber", F.col("l_linenumber") < 4)).agg(F.count("*").alias("touches"))


def table_counts(spark, d):
    parts = [read(spark, d, t).agg(F.lit(t).alias("table"), F.count("*").alias("n")) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_PRINTED = {"region": "r_regionkey r_name", "customer": "c_custkey c_name c_nationkey c_mktsegment", "part": "p_partkey p_name p_brand p_type p_size", "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus"}


def table_fingerprint(spark, d):
    """Whole tables by the columns whose text is the same in every engine."""
    parts = [fp.fingerprint(read(spark, d, t).select(*columns.split())).select(F.lit(t).alias("table"), "n_rows", "fingerprint") for t, columns in _PRINTED.items()]
    return reduce(lambda x, y: x.union(y), parts)


def _canonical_sql(columns: list[str]) -> str:
    return " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


def _fp_sql(table: str, columns: list[str]) -> str:
    sums = " || ':' || ".join(f"sum(CAST('0x' || substr(g, {1 + 15 * i}, 15) AS HUGEINT))" for i in range(4))
    return f"""SELECT '{table}' AS "table", count(*) AS n_rows, sha256(count(*) || ':' || {sums}) AS fingerprint FROM (SELECT sha256({_canonical_sql(sorted(columns))}) AS g FROM {table})"""


def surface_summary_distinct(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_orderkey").alias("orders"))


def publication_snapshot_counts(spark, d):
    w = works(spark, d).select("review_state", "publication_state", "public_blocker")
    c = read(spark, d, "customer").select(F.when(F.col("c_nationkey") % 2 == 0, "Accepted ").otherwise("proposed").alias("review_state"), F.when(F.col("c_nationkey") % 3 == 0, "previewable").when(F.col("c_nationkey") % 3 == 1, "blocked").otherwise("?").alias("publication_state"), F.when(F.col("c_nationkey") == 6, " ").alias("public_blocker"))
    return review.publication_counts({"work": w, "authority": c})


def timeline_union(spark, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    orders = read(spark, d, "orders").withColumn("at", us("o_orderdate"))
    events = read(spark, d, "events").filter("event_type = 'signup'").withColumn("at", us("ts"))
    return review.timeline({"order": (orders, "at", "o_orderkey"), "event": (events, "at", "event_id")})


def readiness_metrics(spark, d):
    pages, docs = read(spark, d, "pages"), read(spark, d, "documents")
    p = pages.agg(F.count("*").alias("pages"), F.count_if(F.trim("url") != "").alias("with_url"), F.count_if(F.length("html") > 500).alias("long_pages"))
    q = docs.agg(F.count("*").alias("docs"), F.count_if(F.col("n_chars") > 0).alias("with_text"))
    both = p.crossJoin(q)  # one row each
    return both.withColumn("status", F.when(F.col("with_url") < F.col("pages"), "fail").when(F.col("long_pages") < F.col("pages"), "warn").otherwise("pass"))


def registered_records(spark, d):
    """Customers with their orders of one status as child records."""
    children = read(spark, d, "orders").filter("o_orderstatus = 'F' AND o_orderpriority = '5-LOW'").select("o_custkey", "o_orderkey")
    out = review.assemble(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", {"orders": children})
    return out.select("o_custkey", F.size("orders").cast("long").alias("n"), F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


def metadata_maps(spark, d):
    meta = review.attribute_map(read(spark, d, "lineitem"), "l_orderkey", F.col("l_linenumber").cast("string"), F.col("l_returnflag"))
    return meta.select("l_orderkey", F.coalesce(F.try_element_at("attributes", F.lit("1")), F.lit("-")).alias("first_flag"), F.size("attributes").cast("long").alias("keys"))


def dcmi_mapping_report(spark, d):
    rows = works(spark, d).select("title", F.when(F.col("work_id") % 2 == 0, F.col("work_type")).alias("work_type"), F.lit(None).cast("string").alias("rights_posture"), F.col("work_id").cast("string").alias("work_key_v1"))
    return review.mapping_report(rows, review.DCMI)


def dcmi_records(spark, d):
    rows = works(spark, d).select("work_id", F.when(F.col("work_id") % 2 == 0, F.col("work_type")).alias("work_type"), F.col("work_id").cast("string").alias("work_key_v1"))
    return review.crosswalk(rows, review.DCMI, "work_id")


def upsert_envelope(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    state = F.when(F.col("doc_id") % 4 == 0, "accepted").when(F.col("doc_id") % 4 == 1, "rejected").otherwise("proposed")
    old = docs.select(F.col("doc_id").alias("work_id"), F.col("source").alias("title"), state.alias("review_state"), F.lit(0.5).alias("confidence_score"), F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("T00:00:00Z")).alias("first_seen_at"), (F.col("doc_id") % 2 == 0).alias("accepted_for_citation"))
    new = labels.select((F.col("doc_id") * 2).alias("work_id"), F.when(F.col("doc_id") % 3 > 0, "renamed").otherwise(" ").alias("title"), F.when(F.col("quality") == 1, "reviewed").otherwise("needs_review").alias("review_state"), (F.col("toxic") / 4.0).alias("confidence_score"), F.lit("2024-01-05T01:00:00+01:00").alias("first_seen_at"), F.lit(False).alias("accepted_for_citation"))
    return upsert.merge(old, new, ["work_id"], upsert.WORK_RULES)


UPSERT_SQL = """WITH a AS (SELECT doc_id AS id, source AS title, CASE doc_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'proposed' END AS st, 0.5::DOUBLE AS conf, doc_id % 9 + 1 AS day, doc_id % 2 = 0 AS cite FROM documents),
b AS (SELECT doc_id * 2 AS id, CASE WHEN doc_id % 3 > 0 THEN 'renamed' ELSE ' ' END AS title, CASE WHEN quality = 1 THEN 'reviewed' ELSE 'needs_review' END AS st, toxic / 4.0 AS conf FROM labels)
SELECT coalesce(a.id, b.id) AS work_id, CASE WHEN a.id IS NULL THEN b.title WHEN b.id IS NULL THEN a.title ELSE coalesce(nullif(trim(b.title), ''), a.title) END AS title,
  CASE WHEN a.id IS NULL THEN b.st WHEN b.id IS NULL THEN a.st WHEN a.st <> 'proposed' AND b.st = 'needs_review' THEN a.st ELSE b.st END AS review_state,
  CAST(CASE WHEN a.id IS NULL THEN b.conf WHEN b.id IS NULL THEN a.conf WHEN (a.st <> 'proposed' AND b.st = 'needs_review') OR a.st = 'accepted' THEN a.conf ELSE coalesce(b.conf, a.conf) END AS DOUBLE) AS confidence_score,
  CASE WHEN a.id IS NULL THEN '2024-01-05T01:00:00+01:00' WHEN b.id IS NULL OR day <= 5 THEN '2024-01-0' || day || 'T00:00:00Z' ELSE '2024-01-05T01:00:00+01:00' END AS first_seen_at,
  CASE WHEN a.id IS NULL THEN false ELSE a.cite END AS accepted_for_citation
FROM a FULL JOIN b ON a.id = b.id"""


def insert_or_ignore(spark, d):
    old = read(spark, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("k"))
    new = read(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))
    return upsert.insert_new(old, new, ["k"])


def replay_conflicts(spark, d):
    old = read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.lit("2024").alias("created_at"))
    new = read(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 9 == 0, F.lit(None).cast("int")).otherwise(F.col("s_nationkey")).alias("s_nationkey"), F.lit("2025").alias("created_at"))
    return upsert.replay_conflicts(old, new, ["s_suppkey"])


def _decided(spark, d):
    targets = works(spark, d).select("work_id", "review_state")
    decisions = read(spark, d, "labels").select(F.col("doc_id").alias("work_id"), F.when(F.col("doc_id") % 2 == 0, "needs_review").alias("expected_state"), F.when(F.col("toxic") == 1, "rejected").otherwise("accepted").alias("new_state"), F.lit("reviewer").alias("changed_by"), F.lit("2024-01-01").alias("changed_at"), F.lit("").alias("reason"))
    return upsert.review_decisions(targets, decisions, "work_id")


def review_decisions(spark, d):
    return _decided(spark, d)[0]


def review_history(spark, d):
    return _decided(spark, d)[1]


DECIDED = f"{WORKS}, j AS (SELECT w.work_id, w.review_state AS was, CASE WHEN toxic = 1 THEN 'rejected' ELSE 'accepted' END AS becomes, l.doc_id IS NOT NULL AND (l.doc_id % 2 = 1 OR w.review_state = 'needs_review') AS hit FROM works w LEFT JOIN labels l ON l.doc_id = w.work_id)"


def query_plan_simulation(spark, d):
    """Plans of suppliers as loci, simulated candidates by count and their duplicate clusters."""
    plans = read(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") < 0, "blocked").when(F.col("s_nationkey") % 5 == 0, "needs_review").otherwise("ready").alias("status"), (F.col("s_suppkey") % 5).alias("duplicates"))
    n = F.when(F.col("status") == "ready", 3).when(F.col("status") == "needs_review", 1).otherwise(0)
    rows = plans.withColumn("n", n).filter("n > 0").select("s_suppkey", "status", "duplicates", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return rows.select("s_suppkey", "status", "i", F.when((F.col("duplicates") > 0) & (F.col("i") <= 2), F.concat(F.lit("dup-"), F.col("s_suppkey").cast("string"))).alias("cluster"))


def plan_counts(spark, d):
    plans = query_plan_simulation(spark, d)
    return plans.groupBy("status", F.coalesce("cluster", F.lit("(missing)")).startswith("dup").alias("clustered")).agg(F.count("*").alias("n"), F.sum("i").alias("ranks"))


def entity_facets(spark, d):
    kinds = F.array(*map(F.lit, ["Person", "persons", "org", "Places", "widget", "concept", "event", "work", "", "products"]))
    facets = ["people", "places", "concepts", "sources"]
    rows = read(spark, d, "supplier").select("s_suppkey", kinds[(F.col("s_suppkey") % 10).cast("int")].alias("kind"))
    return rows.select("s_suppkey", "kind", states.entity_facet(F.col("kind"), facets).alias("facet"), states.entity_facet_prefilter(F.col("kind"), facets).alias("prefilter"))


def visibility(spark, d):
    rows = works(spark, d)
    blocker = states.public_blocker(F.col("public_blocker"), F.col("work_id") % 7 == 0, F.when(F.col("work_id") % 5 == 0, "blocked"))
    return rows.select("work_id", states.publication_state(F.col("publication_state")).alias("state"), blocker.alias("blocker"), states.is_public(F.col("review_state"), F.col("publication_state"), F.col("public_blocker")).alias("public"), states.is_public_lenient(F.when(F.col("work_id") % 3 == 0, F.col("publication_state")), F.col("public_blocker")).alias("lenient"), states.extraction_outcome(F.when(F.col("work_id") % 4 == 0, "OK ").when(F.col("work_id") % 4 == 1, "odd").when(F.col("work_id") % 4 == 2, "")).alias("outcome"))


def locator_labels(spark, d):
    return read(spark, d, "pages").select("page_id", states.locator_label(F.when(F.col("page_id") % 3 == 0, F.col("url")), F.when(F.col("page_id") % 3 == 1, F.lit("file:/x")).when(F.col("page_id") % 3 == 2, F.col("url")), F.when(F.col("page_id") % 2 == 0, F.lit(" hint"))).alias("label"))


def artifact_checks(spark, d):
    """Rule, uniqueness and reference checks of orders as artifact rows."""
    orders = read(spark, d, "orders")
    rules = {"PRICE_RANGE": F.col("o_totalprice").between(1000, 450000), "STATUS_VOCABULARY": F.col("o_orderstatus").isin("F", "O"), "DATE_MISSING": F.col("o_orderdate").isNotNull()}
    found = scan.check_rules(orders, "o_orderkey", rules).unionByName(scan.check_unique(orders.select((F.col("o_orderkey") % 14900).alias("k")), ["k"])).unionByName(scan.check_references(orders, "o_orderkey", "o_custkey", read(spark, d, "customer").filter("c_nationkey < 24"), "c_custkey"))
    return found.groupBy("code").agg(F.count("*").alias("n"))


def append_only_checks(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id", "ts", ((F.col("event_id") * 7919) % 10007).alias("seq"))
    return scan.check_append_only(events, "event_id", "ts", ["user_id"]).agg(F.count("*").alias("out_of_order"))


def check_rollup(spark, d):
    orders = read(spark, d, "orders")
    return scan.rollup(scan.check_rules(orders, "o_orderkey", {"PRICE_RANGE": F.col("o_totalprice") < 450000}), orders)


def diagnostics_hosts(spark, d):
    rows = read(spark, d, "pages").select(scan.redact_url(F.col("url")).alias("host"), "page_id")
    counted = rows.groupBy("host").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))
    return counted.orderBy(F.desc("n"), "host").limit(10)


def newest_then_forward(spark, d):
    """The newest twenty events, given back oldest first with their place."""
    top = read(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    return top.select("event_id", F.row_number().over(Window.orderBy("ts", "event_id")).cast("long").alias("place"))


def page_with_total(spark, d):
    total = read(spark, d, "part").filter("p_size > 10").agg(F.count("*").alias("total"))
    page = read(spark, d, "part").filter("p_size > 10").orderBy(F.desc("p_retailprice"), "p_partkey").offset(20).limit(10)
    return page.select("p_partkey", "p_retailprice").crossJoin(F.broadcast(total))  # total: one row


def note_fields(spark, d):
    bad = F.when(F.col("event_id") % 5 == 0, '{"k": 1, "k": 2}').when(F.col("event_id") % 5 == 1, '{"k": NaN}').when(F.col("event_id") % 5 == 2, "not json").otherwise(F.col("props"))
    return read(spark, d, "events").groupBy((F.col("event_id") % 5).alias("kind")).agg(F.count(values.json_number(bad, "k")).alias("readable"))


QUERIES = {
    f.__name__: f
    for f in (
        review_queue_topk, prior_state_paged, context_budget, selection_with_deferral, run_outcomes, failure_streak_state, blank_bucket_counts, touch_summary, table_counts, table_fingerprint, surface_summary_distinct,
        publication_snapshot_counts, timeline_union, readiness_metrics, registered_records, metadata_maps, dcmi_mapping_report, dcmi_records, upsert_envelope, insert_or_ignore, replay_conflicts, review_decisions,
        review_history, query_plan_simulation, plan_counts, entity_facets, visibility, locator_labels, artifact_checks, append_only_checks, check_rollup, diagnostics_hosts, newest_then_forward, page_with_total, note_fields,
    )
}

_PLANS = "p AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'blocked' WHEN s_nationkey % 5 = 0 THEN 'needs_review' ELSE 'ready' END AS status, s_suppkey % 5 AS dup FROM supplier), x AS (SELECT s_suppkey, status, i, CASE WHEN dup > 0 AND i <= 2 THEN 'dup-' || s_suppkey END AS cluster FROM p JOIN (VALUES (1), (2), (3)) AS t(i) ON i <= CASE status WHEN 'ready' THEN 3 WHEN 'needs_review' THEN 1 ELSE 0 END)"

ORACLE = {
    "review_queue_topk": f"WITH {QUEUE} SELECT * FROM t ORDER BY confidence_score IS NULL, confidence_score DESC, target_type, pk LIMIT 50",
    "prior_state_paged": f"""WITH {WORKS}, k AS (SELECT * FROM works WHERE workspace_id = 'en') SELECT work_id AS pk, title, CASE WHEN review_state = 'reviewed' THEN 'work context' WHEN confidence_score >= 0.8 THEN 'high-confidence work lead' ELSE 'work lead' END AS label, (SELECT count(*) FROM k) AS total
  FROM k ORDER BY review_state = 'reviewed' DESC, confidence_score DESC, work_type DESC, work_id LIMIT 5""",
    "context_budget": f"WITH {WORKS}, c AS (SELECT work_id, title, sum(length(title) + 1) OVER (ORDER BY work_id) AS s FROM (SELECT * FROM works ORDER BY work_id LIMIT 50)) SELECT work_id, title FROM c WHERE s <= 1500",
    "selection_with_deferral": SELECTION_SQL,
    "run_outcomes": f"WITH {OUTCOMES} SELECT user_id, run_id, event, outcome FROM outcomes",
    "failure_streak_state": f"""WITH {OUTCOMES}, e AS (SELECT user_id, max_by(outcome, (ts, event)) AS latest, max((ts, event)) FILTER (outcome <> 'failure') AS good, max(ts) FILTER (outcome = 'failure') AS failed FROM outcomes GROUP BY user_id),
s AS (SELECT e.user_id, latest, failed, (SELECT count(*) FROM outcomes o WHERE o.user_id = e.user_id AND outcome = 'failure' AND (good IS NULL OR (o.ts, o.event) > good)) AS streak FROM e),
t AS (SELECT *, CASE WHEN latest = 'success' THEN 'healthy' WHEN latest = 'unknown' OR streak >= 3 THEN 'blocked' ELSE 'retryable_failure' END AS state FROM s)
SELECT user_id, state, streak AS failure_streak, CASE WHEN state = 'retryable_failure' THEN epoch_us(failed) + 600000000 END AS next_retry_us FROM t""",
    "blank_bucket_counts": "SELECT CASE WHEN quality = 1 THEN 'good' ELSE '[blank]' END AS bucket, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "touch_summary": "SELECT CASE WHEN l_linenumber <> 1 THEN l_returnflag ELSE '<none>' END AS l_returnflag, CASE WHEN l_linenumber <> 2 THEN l_linestatus ELSE '<none>' END AS l_linestatus, CASE WHEN l_linenumber < 4 THEN CAST(l_linenumber AS VARCHAR) ELSE '<none>' END AS l_linenumber, count(*) AS touches FROM lineitem GROUP BY ALL",
    "table_counts": " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS n FROM {t}""" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
    "table_fingerprint": " UNION ALL ".join(_fp_sql(t, columns.split()) for t, columns in _PRINTED.items()),
    "surface_summary_distinct": "SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY ALL",
    "publication_snapshot_counts": f"""WITH {WORKS}, r AS (SELECT 'work' AS family, review_state = 'reviewed' AND public_blocker IS NULL AS ok FROM works UNION ALL SELECT 'authority', c_nationkey % 2 = 0 AND c_nationkey % 3 = 0 FROM customer)
SELECT family, count(*) FILTER (ok) AS public_rows, count(*) FILTER (NOT ok) AS withheld_rows FROM r GROUP BY family""",
    "timeline_union": "SELECT epoch_us(o_orderdate) AS ts, 'order' AS kind, 'order:' || o_orderkey AS ref FROM orders UNION ALL SELECT epoch_us(ts), 'event', 'event:' || event_id FROM events WHERE event_type = 'signup'",
    "readiness_metrics": "SELECT *, CASE WHEN with_url < pages THEN 'fail' WHEN long_pages < pages THEN 'warn' ELSE 'pass' END AS status FROM (SELECT count(*) AS pages, count(*) FILTER (trim(url) <> '') AS with_url, count(*) FILTER (length(html) > 500) AS long_pages FROM pages), (SELECT count(*) AS docs, count(*) FILTER (n_chars > 0) AS with_text FROM documents)",
    "registered_records": "SELECT c_custkey AS o_custkey, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '5-LOW' GROUP BY c_custkey",
    "dcmi_mapping_report": f"""WITH {WORKS}, n AS (SELECT count(*) AS total, count(*) FILTER (trim(title) <> '') AS a, count(*) FILTER (work_id % 2 = 0) AS b FROM works)
SELECT element, "column", CAST(filled AS BIGINT) AS filled, total, CASE WHEN filled = 0 THEN 'missing' WHEN filled < total THEN 'partial' ELSE 'satisfied' END AS status FROM (
  SELECT total, unnest([{{'element': 'dcterms:title', 'column': 'title', 'filled': a}}, {{'element': 'dcterms:type', 'column': 'work_type', 'filled': b}}, {{'element': 'dcterms:rights', 'column': 'rights_posture', 'filled': 0}}, {{'element': 'dcterms:bibliographicCitation', 'column': 'raw_cite_text', 'filled': 0}},
    {{'element': 'dcterms:created', 'column': 'first_seen_at', 'filled': 0}}, {{'element': 'dcterms:modified', 'column': 'last_seen_at', 'filled': 0}}, {{'element': 'dcterms:identifier', 'column': 'work_key_v1', 'filled': total}}], recursive := true) FROM n)""",
    "dcmi_records": f"""WITH {WORKS} SELECT work_id AS key, '{{' || CASE WHEN work_id % 2 = 0 THEN '"dcterms:type":"' || work_type || '",' ELSE '' END || '"dcterms:identifier":"' || work_id || '"}}' AS record FROM works""",
    "upsert_envelope": UPSERT_SQL,
    "insert_or_ignore": "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20)",
    "replay_conflicts": "SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 = 0",
    "review_decisions": f"WITH {DECIDED} SELECT work_id, CASE WHEN hit AND becomes <> was THEN becomes ELSE was END AS review_state FROM j",
    "review_history": f"WITH {DECIDED} SELECT sha256(work_id || '|' || was || '|' || becomes || '|2024-01-01') AS history_id, CAST(work_id AS VARCHAR) AS target_id, was AS previous_state, becomes AS new_state, 'reviewer' AS changed_by, '2024-01-01' AS changed_at, '' AS reason FROM j WHERE hit AND becomes <> was",
    "query_plan_simulation": f"WITH {_PLANS} SELECT s_suppkey, status, i, cluster FROM x",
    "plan_counts": f"WITH {_PLANS} SELECT status, cluster IS NOT NULL AS clustered, count(*) AS n, CAST(sum(i) AS BIGINT) AS ranks FROM x GROUP BY 1, 2",
    "entity_facets": """SELECT s_suppkey, (['Person', 'persons', 'org', 'Places', 'widget', 'concept', 'event', 'work', '', 'products'])[s_suppkey % 10 + 1] AS kind,
  (['people', 'people', 'sources', 'places', 'sources', 'concepts', 'sources', 'sources', 'sources', 'sources'])[s_suppkey % 10 + 1] AS facet,
  (['people', 'people', 'organizations', 'people', 'people', 'concepts', 'events', 'works', 'people', 'people'])[s_suppkey % 10 + 1] AS prefilter FROM supplier""",
    "visibility": f"""WITH {WORKS} SELECT work_id, CASE publication_state WHEN 'published' THEN 'public_release_allowed' ELSE 'private_working' END AS state, coalesce(public_blocker, CASE WHEN work_id % 7 = 0 THEN 'public_blocked' WHEN work_id % 5 = 0 THEN 'publication_blocked' END) AS blocker,
  review_state = 'reviewed' AND public_blocker IS NULL AS public, public_blocker IS NULL AND (work_id % 3 <> 0 OR publication_state = 'published') AS lenient, (['success', 'failed', 'neutral', 'neutral'])[work_id % 4 + 1] AS outcome FROM works""",
    "locator_labels": "SELECT page_id, CASE WHEN page_id % 3 IN (0, 2) THEN url WHEN page_id % 2 = 0 THEN 'hint' ELSE '[internal locator withheld]' END AS label FROM pages",
    "artifact_checks": """SELECT code, count(*) AS n FROM (SELECT 'PRICE_RANGE' AS code FROM orders WHERE NOT (o_totalprice BETWEEN 1000 AND 450000) UNION ALL SELECT 'STATUS_VOCABULARY' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
  UNION ALL SELECT 'DUPLICATE_KEY' FROM (SELECT 1 FROM orders GROUP BY o_orderkey % 14900 HAVING count(*) > 1) UNION ALL SELECT 'UNKNOWN_REFERENCE' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 24)) GROUP BY code""",
    "append_only_checks": "SELECT count(*) AS out_of_order FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY (event_id * 7919) % 10007) AS before FROM events) WHERE ts < before",
    "check_rollup": "SELECT count(*) AS inspected, count(*) FILTER (o_totalprice >= 450000) AS rejected, CASE WHEN count(*) FILTER (o_totalprice >= 450000) > 0 THEN 'fail' ELSE 'pass' END AS status FROM orders",
    "diagnostics_hosts": "SELECT lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1), '')) AS host, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10",
    "newest_then_forward": "WITH t AS (SELECT ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20) SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM t",
    "page_with_total": "SELECT p_partkey, p_retailprice, (SELECT count(*) FROM part WHERE p_size > 10) AS total FROM part WHERE p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 20",
    "metadata_maps": "SELECT l_orderkey, coalesce(max(l_returnflag) FILTER (l_linenumber = 1), '-') AS first_flag, count(DISTINCT l_linenumber) AS keys FROM lineitem GROUP BY l_orderkey",
    "note_fields": "SELECT event_id % 5 AS kind, CASE WHEN event_id % 5 >= 3 THEN count(*) ELSE 0 END AS readable FROM events GROUP BY event_id % 5",
}
