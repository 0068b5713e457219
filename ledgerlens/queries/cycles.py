"""Events, cycle yields, saturation, health and feedback."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.values import age_days, json_number
from ..operators import cycles as op
from ..plans.health import health_status
from .views import FAMILIES, FAMILY_ROWS, cycles, family_rows, micros, read


def recent_events_per_subject(spark, d):
    rows = op.newest(read(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)
    return rows.select("user_id", "event_id", "event_type", micros().alias("ts_us"), json_number(F.col("props"), "k").alias("k"), F.col("rn").cast("long").alias("rn"))


def state_counts_by_event(spark, d):
    state = F.col("review_state")
    return family_rows(spark, d).groupBy("event_key").agg(
        F.count("*").alias("n_rows"), F.count_if(state.isin(vocab.ESTABLISHED)).alias("accepted"), F.count_if(state.isin(vocab.SATURATION_REVIEWABLE)).alias("reviewable"), F.count_if(state == "rejected").alias("rejected")
    )


def _yields(spark, d):
    rows = family_rows(spark, d)
    counts = op.family_counts({f: rows.filter(F.col("family") == f) for f in FAMILIES})
    names = [*FAMILIES, "accepted_record", "reviewable_record"]
    full = cycles(spark, d).join(counts, "event_key", "left").fillna(0, names)
    full = full.withColumn("useful", op.useful_yield(full, FAMILIES))
    return full.withColumn("low_yield", op.low_yield(F.col("accepted_record"), F.col("reviewable_record"), F.col("useful")))


YIELDS = f"""{FAMILY_ROWS}, counts AS (
  SELECT event_key, count(*) FILTER (family = 'work') AS work, count(*) FILTER (family = 'source_claim') AS source_claim,
    count(*) FILTER (family = 'source_relationship') AS source_relationship, count(*) FILTER (family = 'extraction_detected_entity') AS extraction_detected_entity,
    count(*) FILTER (review_state = 'accepted') AS accepted_record, count(*) FILTER (review_state = 'needs_review') AS reviewable_record
  FROM family_rows GROUP BY event_key
), yields AS (
  SELECT o_orderkey AS event_key, o_custkey AS subject, o_orderdate AS ts, coalesce(work, 0) AS work, coalesce(source_claim, 0) AS source_claim, coalesce(source_relationship, 0) AS source_relationship,
    coalesce(extraction_detected_entity, 0) AS extraction_detected_entity, coalesce(accepted_record, 0) AS accepted_record, coalesce(reviewable_record, 0) AS reviewable_record,
    CAST(coalesce(work + source_claim + source_relationship + extraction_detected_entity + 2 * accepted_record + reviewable_record, 0) AS DOUBLE) AS useful
  FROM orders LEFT JOIN counts ON event_key = o_orderkey
)"""


def cycle_yield_scores(spark, d):
    return _yields(spark, d).select("event_key", *FAMILIES, "accepted_record", "reviewable_record", "useful", "low_yield")


def _ranked(spark, d, few=3):
    """Each subject's newest three cycles; low is fewer than ``few`` accepted and reviewable rows."""
    rows = _yields(spark, d).withColumn("low_yield", F.col("accepted_record") + F.col("reviewable_record") < few)
    return op.newest(rows, ["subject"], [F.desc("ts"), F.desc("event_key")], 3)


RANKED = f"""{YIELDS}, ranked AS (
  SELECT *, accepted_record + reviewable_record < 3 AS low, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, event_key DESC) AS rn FROM yields QUALIFY rn <= 3
), streaks AS (
  SELECT subject, count(*) AS cycles, count(*) FILTER (low) AS low_cycles, coalesce(min(rn) FILTER (NOT low) - 1, count(*)) AS streak FROM ranked GROUP BY subject
)"""


def low_yield_streaks(spark, d):
    return op.streaks(_ranked(spark, d), ["subject"])


def _backlog(spark, d):
    waiting = family_rows(spark, d).filter(F.col("review_state").isin(vocab.SATURATION_REVIEWABLE))
    return cycles(spark, d).select("event_key", "subject").join(waiting, "event_key").groupBy("subject").agg(F.count("*").alias("backlog"))


BACKLOG = "backlog AS (SELECT o_custkey AS subject, count(*) AS backlog FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' GROUP BY o_custkey)"


def topic_saturation(spark, d):
    groups = op.streaks(_ranked(spark, d), ["subject"]).join(_backlog(spark, d), "subject", "left").fillna(0, ["backlog"])
    return op.saturation(groups)


def backlog_by_family(spark, d):
    lines = family_rows(spark, d).filter("review_state = 'needs_review'").groupBy("family").agg(F.count("*").alias("pending"))
    labels = read(spark, d, "labels").filter("quality = 0").agg(F.lit("label").alias("family"), F.count("*").alias("pending"))
    return lines.unionByName(labels)


def now():
    return F.lit("2002-01-01 00:00:00").cast("timestamp")


def pending_age_stats(spark, d):
    return op.pending_ages(read(spark, d, "orders").filter("o_orderstatus = 'P'"), now(), "o_orderdate", ["o_orderpriority"])


def pending_age_overall(spark, d):
    return op.pending_ages(read(spark, d, "orders").filter("o_orderstatus = 'P'"), now(), "o_orderdate")


def _ages_sql(by: str) -> str:
    part, group, cols = (f"PARTITION BY {by}", f"GROUP BY {by}", f"{by}, ") if by else ("", "", "")
    return f"""
WITH aged AS (
  SELECT {cols}(epoch_us(TIMESTAMP '2002-01-01') - epoch_us(o_orderdate)) / 86400000000.0 AS age FROM orders WHERE o_orderstatus = 'P'
), placed AS (
  SELECT *, row_number() OVER ({part} ORDER BY age) AS rn, count(*) OVER ({part}) AS n FROM aged
)
SELECT {cols}CAST(max(n) AS BIGINT) AS pending, min(age) AS least_age_days,
  (min(age) FILTER (rn = (n + 1) // 2) + min(age) FILTER (rn = (n + 2) // 2)) / 2 AS median_age_days,
  min(age) FILTER (rn = CAST(floor((n - 1) * 0.9 + 0.5) AS BIGINT) + 1) AS p90_age_days
FROM placed {group}"""


def _trends(spark, d):
    rows = _yields(spark, d).withColumn("at", F.struct("ts", "event_key"))
    return op.yield_trend(rows, ["subject"], "at", "reviewable_record")


TRENDS = """ends AS (
  SELECT subject, count(*) AS n, first(reviewable_record ORDER BY ts, event_key) AS a, last(reviewable_record ORDER BY ts, event_key) AS b FROM yields GROUP BY subject
), trends AS (
  SELECT subject, CASE WHEN n < 2 THEN 'insufficient_data' WHEN b > a THEN 'rising' WHEN b < a THEN 'declining' ELSE 'flat' END AS trend FROM ends
)"""


def yield_trend(spark, d):
    return _trends(spark, d)


def loop_health_status(spark, d):
    rows = family_rows(spark, d)
    by_cycle = rows.groupBy("event_key").agg(F.count_if(F.col("review_state") == "needs_review").alias("pending"), F.count_if(F.col("review_state") == "rejected").alias("contradictions"), F.count("*").alias("n"))
    facts = cycles(spark, d).join(by_cycle, "event_key", "left").groupBy("subject").agg(
        F.count("*").alias("cycles"), F.coalesce(F.sum("pending"), F.lit(0)).alias("backlog"), F.coalesce(F.sum("contradictions"), F.lit(0)).alias("contradictions"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.max(age_days(now(), F.col("ts"))).alias("oldest"),
    )
    rate = F.when(F.col("n") > 0, F.round(F.col("contradictions") / F.col("n") - 0.2, 4))
    coverage = F.when(F.col("n") > 0, (F.col("n") - F.col("backlog")) / F.col("n"))
    joined = facts.join(_trends(spark, d), "subject")
    status = health_status(F.col("cycles"), rate, coverage, F.col("oldest") - 2400, F.col("backlog"), F.col("trend"), F.col("backlog"))
    return joined.select("subject", "cycles", "backlog", "contradictions", "trend", status.alias("status"))


HEALTH_SQL = f"""WITH {YIELDS}, {TRENDS}, facts AS (
  SELECT o_custkey AS subject, count(DISTINCT o_orderkey) AS cycles, count(*) FILTER (l_returnflag = 'N') AS backlog, count(*) FILTER (l_returnflag = 'R') AS contradictions, count(l_orderkey) AS n,
    max((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(o_orderdate)) / 86400000000.0) AS oldest
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey
)
SELECT subject, cycles, backlog, contradictions, trend, CASE WHEN cycles = 0 THEN 'insufficient_data'
  WHEN coalesce(round(contradictions / nullif(n, 0) - 0.2, 4), 0.0) > 0.25 THEN 'contradiction_spike'
  WHEN coalesce((n - backlog) / nullif(n, 0), 1.0) < 0.5 OR oldest - 2400 > 30 THEN 'review_lagging'
  WHEN backlog > 25 THEN 'accumulating' WHEN cycles >= 2 AND trend IN ('flat', 'declining') AND backlog = 0 THEN 'stalled' ELSE 'healthy' END AS status
FROM facts JOIN trends USING (subject)"""


def contradiction_rates(spark, d):
    facts = family_rows(spark, d).groupBy("family").agg(F.count_if(F.col("review_state") == "rejected").alias("bad"), F.count_if(F.col("review_state") == "needs_review").alias("open"), F.count_distinct("event_key").alias("cycles"), F.count("*").alias("claims"))
    return facts.select("family", *op.contradiction_rates(F.col("bad"), F.col("open"), F.col("cycles"), F.col("claims")))


FACETS = ["click", "error", "purchase", "signup", "view"]


def facet_scores(spark, d):
    k = json_number(F.col("props"), "k")
    events = read(spark, d, "events").select(F.col("event_type").alias("facet"), "user_id", "event_id", "ts", k.alias("k"))
    last = F.max_by("k", F.struct("ts", "event_id"))
    counts = {"productive_runs": F.col("k") > 97, "zero_yield_runs": F.col("k") == 0, "open_leads": F.col("k") == 1, "works": F.col("k") == 2, "claims": F.col("k") == 3, "entities": F.col("k") == 4, "relationships": F.col("k") == 5, "successful_extractions": F.col("k") == 6, "failed_extractions": F.col("k") == 7}
    signals = events.groupBy("facet").agg(*(F.count_if(c).alias(n) for n, c in counts.items()), F.count_distinct("user_id").alias("distinct_runs"), (last % 2 == 0).alias("last_run_zero"))
    return op.facet_scores(signals, FACETS).select("facet", "score", "reason_codes", F.col("rank").cast("long").alias("rank"))


FACET_SQL = """WITH e AS (
  SELECT event_type AS facet, user_id, event_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), s AS (
  SELECT facet, count(*) FILTER (k > 97) AS p, count(*) FILTER (k = 0) AS z, count(*) FILTER (k = 1) AS l, count(*) FILTER (k = 2) AS w,
    count(*) FILTER (k = 3) AS c, count(*) FILTER (k = 4) AS n, count(*) FILTER (k = 5) AS r, count(*) FILTER (k = 6) AS s,
    count(*) FILTER (k = 7) AS f, count(DISTINCT user_id) AS u, last(k ORDER BY ts, event_id) % 2 = 0 AS last_zero
  FROM e GROUP BY facet
), scored AS (
  SELECT facet, round(greatest(-100.0, least(100.0, 3.0 * least(p, 5) + 2.5 * least(l, 5) + 2.0 * least(w, 5) + 1.5 * least(c, 5) + 1.5 * least(n, 5) + 1.0 * least(r, 5) + 1.25 * least(s, 5)
      - 1.5 * least(f, 5) - 2.0 * least(z, 5) - CASE WHEN last_zero AND p = 0 AND l = 0 THEN 1.0 ELSE 0.0 END + 0.25 * least(greatest(u - 1, 0), 4))), 4) AS score,
    array_to_string(list_filter([CASE WHEN p > 0 THEN 'productive_history' END, CASE WHEN l > 0 THEN 'open_lead_yield' END, CASE WHEN z > 0 THEN 'repeated_zero_yield' END,
      CASE WHEN last_zero AND p = 0 AND l = 0 THEN 'recent_low_yield_penalty' END], lambda x: x IS NOT NULL), ',') AS codes
  FROM s WHERE facet IN ('click', 'error', 'purchase', 'signup', 'view')
)
SELECT facet, CAST(score AS DOUBLE) AS score, CASE WHEN codes = '' THEN 'fallback_facet' ELSE codes END AS reason_codes, row_number() OVER (ORDER BY score DESC, facet) AS rank FROM scored"""


def _leads(spark, d):
    lines = read(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    signals = lines.groupBy(F.col("l_partkey").alias("lead_id")).agg(F.count_if(flag == "A").alias("successes"), F.count_if(flag == "R").alias("failures"), F.count_if(F.col("l_linestatus") == "O").alias("claims"), F.count_if(F.col("l_discount") > 0.09).alias("entities"), F.count_distinct("l_suppkey").alias("runs"))
    score = op.lead_score(2.5, F.col("successes"), F.col("failures"), F.col("claims"), F.col("entities"), F.col("runs"))
    return signals.select("lead_id", score.alias("score"), F.when(F.col("failures") > 20, 2).otherwise(0).alias("streak"))


LEADS = """leads AS (
  SELECT l_partkey AS lead_id, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 20 THEN 2 ELSE 0 END AS streak,
    CAST(round(greatest(-100.0, least(100.0, 2.5 + 1.25 * least(count(*) FILTER (l_returnflag = 'A'), 3) - 1.5 * least(count(*) FILTER (l_returnflag = 'R'), 3) + 1.5 * least(count(*) FILTER (l_linestatus = 'O'), 3)
      + 1.5 * least(count(*) FILTER (l_discount > 0.09), 3) + 0.25 * least(greatest(count(DISTINCT l_suppkey) - 1, 0), 4))), 4) AS DOUBLE) AS score
  FROM lineitem GROUP BY l_partkey
)"""


def lead_scores(spark, d):
    return _leads(spark, d).select("lead_id", "score")


def top_leads(spark, d):
    top = _leads(spark, d).orderBy(F.desc("score"), "lead_id").limit(12)
    return top.select("lead_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "lead_id")).cast("long").alias("rank"))


def deferred_leads(spark, d):
    page = _leads(spark, d).orderBy(F.desc("score"), "lead_id").limit(36)
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "lead_id")))
    return op.deferred(ranked, 12).select("lead_id", F.col("rank").cast("long").alias("rank"), "reason_code", "retryable")


def access_count_union_distinct(spark, d):
    lines, orders = read(spark, d, "lineitem"), read(spark, d, "orders")
    direct = lines.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("access"))
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("access"))
    return direct.union(urgent).groupBy("part").agg(F.count_distinct("access").alias("accesses"))


QUERIES = {
    f.__name__: f
    for f in (
        recent_events_per_subject, state_counts_by_event, cycle_yield_scores, low_yield_streaks, topic_saturation, backlog_by_family, pending_age_stats, pending_age_overall, yield_trend,
        loop_health_status, contradiction_rates, facet_scores, lead_scores, top_leads, deferred_leads, access_count_union_distinct,
    )
}

ORACLE = {
    "recent_events_per_subject": "SELECT user_id, event_id, event_type, epoch_us(ts) AS ts_us, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events QUALIFY rn <= 3",
    "state_counts_by_event": f"WITH {FAMILY_ROWS} SELECT event_key, count(*) AS n_rows, count(*) FILTER (review_state = 'accepted') AS accepted, count(*) FILTER (review_state = 'needs_review') AS reviewable, count(*) FILTER (review_state = 'rejected') AS rejected FROM family_rows GROUP BY event_key",
    "cycle_yield_scores": f"WITH {YIELDS} SELECT event_key, work, source_claim, source_relationship, extraction_detected_entity, accepted_record, reviewable_record, useful, accepted_record < 1 AND reviewable_record < 1 AND useful < 1 AS low_yield FROM yields",
    "low_yield_streaks": f"WITH {RANKED} SELECT * FROM streaks",
    "topic_saturation": f"""WITH {RANKED}, {BACKLOG}
SELECT s.subject, cycles, low_cycles, streak, CASE WHEN cycles >= 3 THEN coalesce(backlog, 0) ELSE 0 END AS backlog,
  CASE WHEN cycles < 3 THEN 'active_bootstrap' WHEN streak >= 2 THEN 'saturated' ELSE 'active' END AS state,
  CASE WHEN cycles >= 3 AND streak >= 2 THEN 'deprioritize' ELSE 'run' END AS scheduler_action,
  CASE WHEN cycles < 3 THEN 'insufficient_history' ELSE (CASE WHEN coalesce(backlog, 0) >= 25 THEN 'review_backlog_pressure,' ELSE '' END) || (CASE WHEN streak >= 2 THEN 'consecutive_low_yield' ELSE 'recent_useful_yield' END) END AS reason_codes
FROM streaks s LEFT JOIN backlog b ON b.subject = s.subject""",
    "backlog_by_family": f"WITH {FAMILY_ROWS} SELECT family, count(*) AS pending FROM family_rows WHERE review_state = 'needs_review' GROUP BY family UNION ALL SELECT 'label', count(*) FROM labels WHERE quality = 0",
    "pending_age_stats": _ages_sql("o_orderpriority"),
    "pending_age_overall": _ages_sql(""),
    "yield_trend": f"WITH {YIELDS}, {TRENDS} SELECT * FROM trends",
    "loop_health_status": HEALTH_SQL,
    "contradiction_rates": f"""WITH {FAMILY_ROWS} SELECT family, count(*) FILTER (review_state = 'rejected') AS contradictions, count(*) FILTER (review_state = 'needs_review') AS unresolved,
  round(count(*) FILTER (review_state = 'rejected') / count(DISTINCT event_key), 4) AS per_cycle, round(count(*) FILTER (review_state = 'rejected') / count(*), 4) AS per_claim FROM family_rows GROUP BY family""",
    "facet_scores": FACET_SQL,
    "lead_scores": f"WITH {LEADS} SELECT lead_id, score FROM leads",
    "top_leads": f"WITH {LEADS} SELECT lead_id, score, row_number() OVER (ORDER BY score DESC, lead_id) AS rank FROM leads QUALIFY rank <= 12",
    "deferred_leads": f"WITH {LEADS}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, lead_id) AS rank FROM leads) SELECT lead_id, rank, CASE WHEN streak >= 2 THEN 'repeated_low_yield' ELSE 'rank_below_limit' END AS reason_code, streak < 2 AS retryable FROM r WHERE rank > 12 AND rank <= 36",
    "access_count_union_distinct": """SELECT part, count(DISTINCT access) AS accesses FROM (SELECT l_partkey AS part, l_orderkey AS access FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_partkey, l_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT') GROUP BY part""",
}
