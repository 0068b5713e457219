"""The reconciliation pass over the whole store: orders as claims about customers, customers as people who taught or met others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import reconcile
from .views import read


def _store(spark, d):
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    person = lambda c: F.concat(F.lit("person:"), c.cast("string"))
    event = lambda c: F.concat(F.lit("run-"), (c % 50).cast("string"))
    kind = F.when(order % 13 == 0, "taught_by").when(F.col("o_orderstatus") == "O", "birth_year").otherwise("death_year")
    payload = F.when(order % 13 == 0, F.to_json(F.struct(person(customer).alias("from_object_ref"), person(customer + 1).alias("to_object_ref")))).otherwise(F.to_json(F.struct(F.year("o_orderdate").alias("value"))))
    claims = read(spark, d, "orders").select(
        order.alias("source_claim_id"), F.when(order % 5 > 0, (order % 2).cast("string")).alias("workspace_id"), event(order).alias("provenance_event_ref"), person(customer).alias("about_object_ref"),
        kind.alias("claim_type"), payload.alias("claim_text"), F.when(F.col("o_orderpriority") == "5-LOW", "rejected").otherwise("recorded").alias("review_state"),
    )
    key = F.col("c_custkey")
    predicate = F.element_at(F.array(*map(F.lit, ("taught_by", "teacher_of", "met", "influenced"))), (key % 4 + 1).cast("int"))
    edges = read(spark, d, "customer").select(
        key.alias("source_relationship_id"), person(key).alias("from_object_ref"), person(key + 1).alias("to_object_ref"), predicate.alias("predicate"), F.when(key % 3 > 0, (key % 2).cast("string")).alias("workspace_id"), event(key).alias("provenance_event_ref"),
        F.when(key % 7 == 0, F.to_json(F.struct((F.lit(1990) + key % 12).alias("event_year")))).alias("evidence_note"),
    )
    return claims, edges


def reconciliation_findings(spark, d):
    """Every contradiction that a pass over all events records: rule, edge, workspace and why."""
    return reconcile.findings(*_store(spark, d)).select("rule", "namespace", "offending_id", "target_claim_id", "workspace_id", "rationale")


def reopened_rows(spark, d):
    """The claims and relationships that these contradictions send back to review, with the first reason of each."""
    return reconcile.reopened(reconcile.findings(*_store(spark, d))).select("target_namespace", "id", "reason", "note")


_FOUND = """claims AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 2 AS VARCHAR) END AS ws, o_orderkey % 50 AS event, o_custkey AS about, o_custkey + 1 AS teacher,
    CASE WHEN o_orderkey % 13 = 0 THEN 'taught_by' WHEN o_orderstatus = 'O' THEN 'birth_year' ELSE 'death_year' END AS kind, CASE WHEN o_orderkey % 13 <> 0 THEN year(CAST(o_orderdate AS DATE)) END AS y, o_orderpriority = '5-LOW' AS rejected FROM orders
), facts AS (SELECT * FROM claims WHERE y IS NOT NULL AND NOT rejected
), numbers AS (
  SELECT DISTINCT least(a.id, b.id) AS offending_id, greatest(a.id, b.id) AS target_claim_id, a.ws AS workspace_id,
    'structured claim conflict for person:' || a.about || ' ' || a.kind || ': ' || CASE WHEN a.id < b.id THEN a.y ELSE b.y END || ' versus ' || CASE WHEN a.id < b.id THEN b.y ELSE a.y END AS rationale
  FROM facts a JOIN facts b ON a.about = b.about AND a.kind = b.kind AND a.y <> b.y AND (a.ws IS NULL OR a.ws = b.ws)
), taught AS (
  SELECT c.id, c.ws, c.event, c.about, c.teacher, c.rejected, b.y AS born, e.y AS died, e.id AS death, row_number() OVER (PARTITION BY c.event, c.ws, c.about ORDER BY c.id, b.id, e.id) AS n
  FROM claims c JOIN facts b ON b.about = c.about AND b.kind = 'birth_year' AND (c.ws IS NULL OR b.ws = c.ws) JOIN facts e ON e.about = c.teacher AND e.kind = 'death_year' AND (c.ws IS NULL OR e.ws = c.ws) AND b.y > e.y WHERE c.kind = 'taught_by'
), edges AS (
  SELECT c_custkey AS id, c_custkey AS f, c_custkey + 1 AS t, (['taught_by', 'teacher_of', 'met', 'influenced'])[c_custkey % 4 + 1] AS predicate, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 2 AS VARCHAR) END AS ws, c_custkey % 50 AS event,
    CASE WHEN c_custkey % 7 = 0 THEN 1990 + c_custkey % 12 END AS y FROM customer
), checked AS (SELECT * FROM edges r WHERE predicate <> 'influenced' AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.kind = 'taught_by' AND r.predicate = 'taught_by' AND c.event = r.event AND c.about = r.f)
), lives AS (SELECT r.id, side, facts.kind, facts.y, facts.id AS claim FROM (SELECT *, 's' AS side, f AS ref FROM checked UNION ALL SELECT *, 'o', t FROM checked) r JOIN facts ON facts.about = r.ref AND (r.ws IS NULL OR r.ws = facts.ws)
), whole AS (
  SELECT c.id, c.f, c.t, c.ws, c.y, c.predicate, min(l.y) FILTER (side = 's' AND kind = 'birth_year') AS sb, max(l.y) FILTER (side = 's' AND kind = 'death_year') AS sd, min(l.y) FILTER (side = 'o' AND kind = 'birth_year') AS ob, max(l.y) FILTER (side = 'o' AND kind = 'death_year') AS od,
    min(claim) FILTER (side = 's' AND kind = 'death_year') AS s_death, min(claim) FILTER (side = 'o' AND kind = 'death_year') AS o_death
  FROM checked c JOIN lives l ON l.id = c.id GROUP BY ALL
), outside AS (
  SELECT c.id, c.f, c.t, c.ws, c.y, c.predicate, side, l.y AS fact_year, claim, kind, row_number() OVER (PARTITION BY c.id, side ORDER BY kind, claim) AS n
  FROM checked c JOIN lives l ON l.id = c.id AND ((kind = 'birth_year' AND c.y < l.y) OR (kind = 'death_year' AND c.y > l.y))
), found AS (
  SELECT 'structured_quantity_conflict' AS rule, 'source_claim' AS namespace, *, 'source_claim' AS second, target_claim_id AS second_id FROM numbers
  UNION ALL SELECT 'structured_taught_by_impossible_life_overlap', 'source_claim', id, death, ws, 'claim says person:' || about || ' was taught_by person:' || teacher || ', but subject birth year ' || born || ' is after object death year ' || died, 'source_relationship',
    CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.id = about AND e.event = taught.event AND e.predicate = 'taught_by') THEN about END FROM taught WHERE n = 1 AND NOT rejected
  UNION ALL SELECT DISTINCT 'relational_temporal_lifespan_overlap', 'source_relationship', c.id, e.claim, c.ws, 'relationship ' || c.id || ' predicate ' || predicate || ' is impossible: ' || CASE b.side WHEN 's' THEN 'subject' ELSE 'object' END || ' birth year ' || b.y || ' is after '
    || CASE e.side WHEN 's' THEN 'subject' ELSE 'object' END || ' death year ' || e.y, NULL, NULL
    FROM checked c JOIN lives b ON b.id = c.id AND b.kind = 'birth_year' JOIN lives e ON e.id = c.id AND e.kind = 'death_year' AND b.y > e.y WHERE (predicate = 'taught_by' AND b.side = 's' AND e.side = 'o') OR (predicate = 'teacher_of' AND b.side = 'o' AND e.side = 's')
  UNION ALL SELECT 'relational_temporal_lifespan_overlap', 'source_relationship', id, CASE WHEN sb > od THEN o_death ELSE s_death END, ws,
    CASE WHEN sb > od THEN 'relationship ' || id || ' predicate met is impossible: subject birth year ' || sb || ' is after object death year ' || od ELSE 'relationship ' || id || ' predicate met is impossible: object birth year ' || ob || ' is after subject death year ' || sd END, NULL, NULL
    FROM whole WHERE predicate = 'met' AND (sb > od OR ob > sd)
  UNION ALL SELECT 'relational_temporal_event_year_outside_lifespan', 'source_relationship', id, claim, ws, 'relationship ' || id || ' predicate ' || predicate || ' has event year ' || y || CASE kind WHEN 'birth_year' THEN ' before birth year ' ELSE ' after death year ' END || fact_year
    || CASE side WHEN 's' THEN ' for subject person:' || f ELSE ' for object person:' || t END, NULL, NULL FROM outside WHERE n = 1
)"""

QUERIES = {f.__name__: f for f in (reconciliation_findings, reopened_rows)}
ORACLE = {
    "reconciliation_findings": f"WITH {_FOUND} SELECT rule, namespace, offending_id, target_claim_id, workspace_id, rationale FROM found",
    "reopened_rows": f"""WITH {_FOUND}, sides AS (SELECT namespace AS target_namespace, offending_id AS id, rule, rationale FROM found UNION ALL SELECT second, second_id, rule, rationale FROM found WHERE second_id IS NOT NULL)
SELECT target_namespace, id, arg_min(rule, (rule, rationale)) AS reason, arg_min(rationale, (rule, rationale)) AS note FROM sides GROUP BY ALL""",
}
