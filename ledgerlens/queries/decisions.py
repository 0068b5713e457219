"""Review decisions of six actions: orders decide on parts as claims, suppliers as relationships and customers as reconciliations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import decisions as op
from .views import read


def _tables(spark, d):
    part, supplier, customer = (read(spark, d, t) for t in ("part", "supplier", "customer"))
    states = lambda c: F.element_at(F.array(*map(F.lit, ("proposed", "needs_review", "rejected", "reviewed", "recorded"))), (c % 5 + 1).cast("int"))
    key = F.col("c_custkey")
    claims = part.select(F.col("p_partkey").alias("source_claim_id"), states(F.col("p_size")).alias("review_state"))
    relations = supplier.select(F.col("s_suppkey").alias("source_relationship_id"), states(F.col("s_nationkey")).alias("review_state"), F.when(F.col("s_suppkey") % 3 != 0, "contradicts").otherwise("mentions").alias("predicate"))
    people = customer.select(key.alias("authority_record_id"), F.when(F.col("c_nationkey") % 5 == 0, "place").otherwise("person").alias("authority_type"), F.lit("proposed").alias("review_state"))
    pairs = customer.select(key.alias("authority_reconciliation_id"), F.lit("authority_record").alias("target_namespace"), (key - key % 3).cast("string").alias("target_id"), F.when(key % 11 != 0, key - key % 4).alias("candidate_authority_record_id"), F.lit("proposed").alias("review_state"))
    entities = customer.select(key.alias("detected_entity_id"), key.alias("authority_record_id"))
    given = {"source_claim": claims, "source_relationship": relations, "authority_record": people, "authority_reconciliation": pairs, "extraction_detected_entity": entities, "work_subject": customer.select(key.alias("work_subject_id"), key.alias("authority_record_id"))}
    return {name: schemas.conform(df, name) for name, df in given.items()}


def _decisions(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    action = F.element_at(F.array(*map(F.lit, op.ACTIONS)), (key % 6 + 1).cast("int"))
    target = F.when(key % 6 < 2, text("authrec:", cust)).when((key % 6 == 2) | (key % 12 == 3), text("claim:", cust)).otherwise(text("relationship:", cust % 120))
    return read(spark, d, "orders").select(
        target.alias("target"), action.alias("action"), F.when(key % 17 == 0, " ").otherwise("ann").alias("reviewer"), F.lit("looked at").alias("reason"), F.when((key % 6 > 1) & (key % 5 == 0), "proposed").alias("expected_state"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("decided_at"), key.alias("arrival"),
    )


def decision_outcomes(spark, d):
    """What became of every decision."""
    found = op.outcomes(_tables(spark, d), _decisions(spark, d))
    return found.select("arrival", "action", F.col("kind").alias("target_type"), F.col("id").alias("target_id"), F.col("before").alias("state_before"), F.col("after").alias("state_after"), F.regexp_replace("status", ":.*", "").alias("status"))


def final_authorities(spark, d):
    """Where the references of merged authorities end."""
    return op.final_authorities(op.merge_edges(op.outcomes(_tables(spark, d), op.merge_decisions(_decisions(spark, d))))).select("loser", "authority")


_SQL = """
WITH RECURSIVE targets AS (
  SELECT 'source_claim' AS kind, p_partkey AS id, (['proposed', 'needs_review', 'rejected', 'reviewed', 'recorded'])[p_size % 5 + 1] AS state, CAST(NULL AS VARCHAR) AS predicate, CAST(NULL AS BIGINT) AS winner, CAST(NULL AS BIGINT) AS loser FROM part
  UNION ALL SELECT 'source_relationship', s_suppkey, (['proposed', 'needs_review', 'rejected', 'reviewed', 'recorded'])[s_nationkey % 5 + 1], CASE WHEN s_suppkey % 3 <> 0 THEN 'contradicts' ELSE 'mentions' END, NULL, NULL FROM supplier
  UNION ALL SELECT 'authority_reconciliation', c_custkey, 'proposed', NULL, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey - c_custkey % 4 END, c_custkey - c_custkey % 3 FROM customer
), people AS (SELECT c_custkey AS id, c_nationkey % 5 = 0 AS place FROM customer
), given AS (
  SELECT o_orderkey AS arrival, o_orderkey % 6 AS a, o_orderdate AS at_, o_orderkey % 17 = 0 AS anonymous, o_orderkey % 6 > 1 AND o_orderkey % 5 = 0 AS expects,
    CASE WHEN o_orderkey % 6 < 2 THEN 'authority_reconciliation' WHEN o_orderkey % 6 = 2 OR o_orderkey % 12 = 3 THEN 'source_claim' ELSE 'source_relationship' END AS kind,
    CASE WHEN o_orderkey % 6 < 3 OR o_orderkey % 12 = 3 THEN o_custkey ELSE o_custkey % 120 END AS id FROM orders
), judged AS (
  SELECT g.*, t.state, winner, loser, anonymous OR t.id IS NULL OR (a = 5 AND coalesce(predicate, '') <> 'contradicts') OR (a = 0 AND (winner IS NULL OR winner = loser OR w.place IS NULL OR l.place IS NULL OR w.place <> l.place)) AS refused
  FROM given g LEFT JOIN targets t ON t.kind = g.kind AND t.id = g.id LEFT JOIN people w ON w.id = winner LEFT JOIN people l ON l.id = loser
), firsts AS (SELECT loser AS lost, arg_min(winner, (at_, arrival)) AS won, min((at_, arrival)) AS turn FROM judged WHERE a = 0 AND NOT refused GROUP BY loser
), turns AS (
  SELECT *, refused OR late AS out, row_number() OVER (PARTITION BY kind, id, refused OR late ORDER BY at_, arrival) AS nth
  FROM (SELECT j.*, coalesce(a = 0 AND NOT refused AND winner <> won, false) AS late FROM judged j LEFT JOIN firsts ON lost = loser)
), fold AS (
  SELECT kind, id, CAST(0 AS BIGINT) AS nth, state AS before, state AS after, CAST('' AS VARCHAR) AS status, CAST(0 AS BIGINT) AS arrival FROM targets
  UNION ALL
  SELECT kind, id, nth, before, CASE WHEN status = 'completed' THEN becomes ELSE before END, status, arrival FROM (
    SELECT t.kind, t.id, t.nth, f.after AS before, becomes, t.arrival, CASE WHEN expects AND f.after <> 'proposed' THEN 'refused' WHEN f.after = becomes THEN 'already_applied' WHEN t.a > 1 AND f.after IN ('accepted', 'approved', 'curated', 'reviewed') THEN 'recorded' ELSE 'completed' END AS status
    FROM fold f JOIN (SELECT *, (['accepted', 'rejected', 'rejected', 'needs_review', 'rejected', 'reviewed'])[a + 1] AS becomes FROM turns WHERE NOT out) t ON t.kind = f.kind AND t.id = f.id AND t.nth = f.nth + 1)
)"""

OUTCOMES = f"""{_SQL} SELECT t.arrival, (['accept_merge', 'reject_merge', 'reject_claim', 'mark_contradicted', 'reject_relationship', 'resolve_contradiction'])[t.a + 1] AS action, t.kind AS target_type, CAST(t.id AS BIGINT) AS target_id,
  f.before AS state_before, f.after AS state_after, coalesce(f.status, 'refused') AS status FROM turns t LEFT JOIN fold f ON f.arrival = t.arrival AND f.nth > 0 AND NOT t.out"""

FINAL = f"""{_SQL}, moves AS (
  SELECT lost, won, turn FROM firsts UNION ALL SELECT m.lost, f.won, f.turn FROM moves m JOIN firsts f ON f.lost = m.won AND f.turn > m.turn
) SELECT CAST(lost AS BIGINT) AS loser, CAST(arg_max(won, turn) AS BIGINT) AS authority FROM moves GROUP BY lost"""

QUERIES = {f.__name__: f for f in (decision_outcomes, final_authorities)}
ORACLE = {"decision_outcomes": OUTCOMES, "final_authorities": FINAL}
