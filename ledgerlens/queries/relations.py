"""Scopes, joins, identity, contradictions and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import label_ascii, ref_key, ref_namespace
from ..functions.values import content_id, uuid5
from ..operators import graph, identity
from .views import WORKS, read, works

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def scope_union_distinct(spark, d):
    near = read(spark, d, "customer").filter("c_nationkey = 1").select(F.col("c_custkey").alias("id"))
    rich = read(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return near.union(rich).distinct()


def exists_or_scope(spark, d):
    scoped = read(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("in_scope"))
    rows = read(spark, d, "orders").join(scoped, "o_custkey", "left")
    return rows.filter((F.col("o_orderpriority") == "1-URGENT") | F.coalesce("in_scope", F.lit(False))).select("o_orderkey", "o_custkey")


def left_join_chain_coalesce(spark, d):
    part = read(spark, d, "part").filter("p_size > 25").select("p_partkey", "p_type")
    orders = read(spark, d, "orders").filter("o_orderstatus != 'P'").select("o_orderkey", "o_orderstatus", "o_custkey")
    customer = read(spark, d, "customer").filter("c_nationkey < 12").select("c_custkey", "c_mktsegment")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"), "left").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rows = rows.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy(F.coalesce("p_type", "o_orderstatus", "c_mktsegment", F.lit("[none]")).alias("workspace")).agg(F.count("*").alias("n"))


def or_join_rewrite(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.col("page_id").alias("locus"), (F.length("html") % 500).cast("long").alias("locator"))
    docs = read(spark, d, "documents").select("doc_id")
    by = lambda c: pages.join(docs, F.col(c) == F.col("doc_id")).select("page_id", "doc_id")
    return by("locus").union(by("locator")).distinct()


def prefix_join_rewrite(spark, d):
    leads = read(spark, d, "events").select("event_id", F.concat_ws(":", F.lit("source-lead"), F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id").cast("string")).alias("lead"))
    hashed = leads.withColumn("hash", F.regexp_extract("lead", "^source-lead:([^:]+):", 1))
    targets = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("hash"), "c_mktsegment")
    return hashed.join(targets, "hash").groupBy("c_mktsegment").agg(F.count("*").alias("leads"), F.min("event_id").alias("first_event"))


def _claims(spark, d):
    about = F.concat_ws("|", "p_brand", "p_type", "p_name")
    workspace = F.when(F.col("p_partkey") % 5 > 0, (F.col("p_partkey") % 3).cast("string"))
    return read(spark, d, "part").select("p_partkey", about.alias("about"), "p_size", workspace.alias("workspace"))


def conflicting_numeric_claims(spark, d):
    return identity.conflicting_values(_claims(spark, d), ["about"], "p_partkey", "p_size")


def conflicting_claims_by_workspace(spark, d):
    return identity.conflicting_values(_claims(spark, d), ["about"], "p_partkey", "p_size", "workspace")


def _day(c):
    return F.unix_date(F.col(c).cast("date"))


def impossible_interval_pairs(spark, d):
    """Customers as persons whose first order is their birth and last one their death; each is linked with the next two."""
    orders = read(spark, d, "orders").filter("o_custkey % 3 != 0 OR o_orderstatus = 'F'")
    claim = lambda kind, agg: orders.groupBy("o_custkey").agg(agg(_day("o_orderdate")).alias("year")).select(F.col("o_custkey").alias("about_object_ref"), F.lit(kind).alias("claim_type"), "year", F.lit("accepted").alias("review_state"))
    facts = identity.life_facts(claim("birth", F.min).unionByName(claim("death", F.max)), ["birth"], ["death"])
    people = read(spark, d, "customer").select("c_custkey")
    predicate = F.when(F.col("c_custkey") % 3 == 0, "taught_by").when(F.col("c_custkey") % 3 == 1, "teacher_of").otherwise("met")
    year = F.when(F.col("c_custkey") % 7 == 0, F.lit(9300))
    edges = people.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("hop"), "c_custkey").select((F.col("c_custkey") * 10 + F.col("hop")).alias("edge_id"), F.col("c_custkey").alias("from_object_ref"), (F.col("c_custkey") + F.col("hop")).alias("to_object_ref"), predicate.alias("predicate"), year.alias("year"))
    return identity.impossible_relations(edges, facts)


LIFE_SQL = """WITH o AS (SELECT o_custkey AS ref, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders WHERE o_custkey % 3 <> 0 OR o_orderstatus = 'F'),
facts AS (SELECT ref, min(day) AS b, max(day) AS e FROM o GROUP BY ref),
edges AS (SELECT c_custkey * 10 + hop AS edge_id, c_custkey AS f, c_custkey + hop AS t, CASE c_custkey % 3 WHEN 0 THEN 'taught_by' WHEN 1 THEN 'teacher_of' ELSE 'met' END AS predicate,
  CASE WHEN c_custkey % 7 = 0 THEN 9300 END AS year FROM customer CROSS JOIN (VALUES (1), (2)) AS h(hop)),
judged AS (SELECT edge_id, CASE WHEN predicate = 'taught_by' AND x.b > y.e THEN 'teacher_dead_before_birth' WHEN predicate = 'teacher_of' AND y.b > x.e THEN 'teacher_dead_before_birth'
  WHEN predicate = 'met' AND (x.b > y.e OR y.b > x.e) THEN 'lives_do_not_meet'
  WHEN year IS NOT NULL AND (year < x.b OR year > x.e OR year < y.b OR year > y.e) THEN 'event_outside_life' END AS problem
  FROM edges LEFT JOIN facts x ON x.ref = f LEFT JOIN facts y ON y.ref = t)
SELECT edge_id, problem FROM judged WHERE problem IS NOT NULL"""


def life_facts(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("about_object_ref"), F.when(F.col("o_orderstatus") == "O", "birth_year").when(F.col("o_orderstatus") == "F", "death_year").otherwise("other").alias("claim_type"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderpriority") == "5-LOW", "rejected").otherwise("accepted").alias("review_state"))
    return identity.life_facts(orders, ["birth_year"], ["death_year"])


def first_contradiction_per_group(spark, d):
    pairs = identity.conflicting_values(_claims(spark, d), ["about"], "p_partkey", "p_size").join(read(spark, d, "part").select(F.col("p_partkey").alias("low_id"), "p_brand"), "low_id")
    return identity.first_per_group(pairs, ["p_brand"], ["low_id", "high_id"])


def _refs(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("ref"))


def _known_parts(spark, d):
    return graph.directory({"part": (read(spark, d, "part").filter("p_size < 25"), "p_partkey"), "supplier": (read(spark, d, "supplier"), "s_suppkey")})


def semi_join_resolved_refs(spark, d):
    return graph.resolved(_refs(spark, d), _known_parts(spark, d)).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def anti_join_orphans(spark, d):
    return graph.orphans(_refs(spark, d), _known_parts(spark, d)).select("l_orderkey", "l_linenumber", "ref")


def closure_status_rollup(spark, d):
    refs = _refs(spark, d).withColumn("family", F.col("l_returnflag"))
    customers = read(spark, d, "orders").select(F.lit("orders").alias("family"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("ref"), F.lit("-").alias("l_linestatus"))
    known = _known_parts(spark, d).union(graph.directory({"customer": (read(spark, d, "customer"), "c_custkey")}))
    both = refs.select("family", "ref", "l_linestatus").unionByName(customers)
    return graph.closure_report(both, known, F.col("l_linestatus") == "O", (F.col("family") == "A") & F.col("ref").endswith("1") | (F.col("family") == "N"))


def reference_parts(spark, d):
    return _refs(spark, d).groupBy(ref_namespace(F.col("ref")).alias("namespace")).agg(F.count("*").alias("n"), F.count_distinct(ref_key(F.col("ref"))).alias("keys"))


def degree_distribution(spark, d):
    edges = read(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")).distinct()
    return graph.degree_buckets(edges, "a", "b")


def _nation_edges(spark, d):
    ref = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    supplier = read(spark, d, "supplier").select(ref("s", "s_suppkey").alias("a"), ref("n", "s_nationkey").alias("b"))
    return supplier.union(read(spark, d, "customer").select(ref("c", "c_custkey"), ref("n", "c_nationkey")))


def connected_components(spark, d):
    return graph.components(_nation_edges(spark, d), "a", "b")


def component_sizes(spark, d):
    return graph.component_sizes(graph.components(_nation_edges(spark, d), "a", "b"))


COMPONENTS = """edges AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
centre AS (SELECT b, least(min(a), b) AS component FROM edges GROUP BY b),
labels AS (SELECT a AS node, component FROM edges JOIN centre USING (b) UNION ALL SELECT b, component FROM centre)"""


def lineage_recursive(spark, d):
    ref = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations = read(spark, d, "nation").select(ref("r", "n_regionkey").alias("src"), ref("n", "n_nationkey").alias("dst"))
    edges = nations.union(read(spark, d, "supplier").select(ref("n", "s_nationkey"), ref("s", "s_suppkey"))).union(read(spark, d, "supplier").filter("s_suppkey % 10 = 0").select(ref("s", "s_suppkey"), ref("n", "s_nationkey")))
    return graph.lineage(edges, read(spark, d, "region").select(ref("r", "r_regionkey").alias("node")), depth=4)


LINEAGE_SQL = """WITH RECURSIVE edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier WHERE s_suppkey % 10 = 0),
walk AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node, 0 AS depth, '|r' || r_regionkey || '|' AS chain FROM region
  UNION ALL SELECT seed, dst, depth + 1, chain || dst || '|' FROM walk JOIN edges ON src = node WHERE instr(chain, '|' || dst || '|') = 0 AND depth < 4)
SELECT seed, node, depth, chain FROM walk"""


def _key(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def artifact_chains(spark, d):
    """Customers write orders that suppliers read, who append to their nation's sheet, which the nation reads; segments are prompts."""
    orders, suppliers = read(spark, d, "orders"), read(spark, d, "supplier")
    lines = read(spark, d, "lineitem").select(_key("o", "l_orderkey").alias("artifact_key"), _key("s", "l_suppkey").alias("surface_key"), F.lit("read").alias("direction"))
    io = lines.union(orders.select(_key("o", "o_orderkey"), _key("c", "o_custkey"), F.lit("write")))
    io = io.union(suppliers.select(_key("sheet", "s_nationkey"), _key("s", "s_suppkey"), F.lit("append")))
    io = io.union(read(spark, d, "nation").select(_key("sheet", "n_nationkey"), _key("n", "n_nationkey"), F.lit("read")))
    prompts = read(spark, d, "customer").select(F.col("c_mktsegment").alias("prompt"), _key("c", "c_custkey").alias("surface"))
    return graph.artifact_chains(graph.producer_consumer(io), prompts)


CHAINS_SQL = """WITH RECURSIVE links AS (SELECT DISTINCT 'c' || o_custkey AS producer, 'o' || o_orderkey AS artifact_key, 's' || l_suppkey AS consumer
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION SELECT 's' || s_suppkey, 'sheet' || s_nationkey, 'n' || n_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
walk AS (SELECT producer AS start, 1 AS depth, producer, artifact_key, consumer, producer || ' --' || artifact_key || '--> ' || consumer AS chain,
    '|' || producer || '|' || consumer || '|' AS seen FROM links
  UNION ALL SELECT c_mktsegment, 1, producer, artifact_key, consumer, c_mktsegment || ' --uses_prompt--> ' || producer || ' --' || artifact_key || '--> ' || consumer,
    '|' || c_mktsegment || '|' || producer || '|' || consumer || '|' FROM customer JOIN links ON producer = 'c' || c_custkey
  UNION ALL SELECT w.start, w.depth + 1, l.producer, l.artifact_key, l.consumer, w.chain || ' --' || l.artifact_key || '--> ' || l.consumer, w.seen || l.consumer || '|'
    FROM walk w JOIN links l ON l.producer = w.consumer WHERE instr(w.seen, '|' || l.consumer || '|') = 0)
SELECT start, depth, producer, artifact_key, consumer, chain FROM walk"""


def reach_depths(spark, d):
    """What each market segment reaches: its customers, their suppliers, those suppliers' nations and all customers there, round again."""
    customers = read(spark, d, "customer")
    sold = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = customers.select(F.col("c_mktsegment").alias("src"), _key("c", "c_custkey").alias("dst"))
    edges = edges.union(sold.select(_key("c", "o_custkey"), _key("s", "l_suppkey")))
    edges = edges.union(read(spark, d, "supplier").select(_key("s", "s_suppkey"), _key("n", "s_nationkey")))
    edges = edges.union(customers.select(_key("n", "c_nationkey"), _key("c", "c_custkey")))
    return graph.reach(edges, customers.select(F.col("c_mktsegment").alias("node")))


REACH_SQL = """WITH RECURSIVE edges AS (SELECT c_mktsegment AS src, 'c' || c_custkey AS dst FROM customer
  UNION SELECT 'c' || o_custkey, 's' || l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
walk AS (SELECT DISTINCT c_mktsegment AS seed, c_mktsegment AS node, 0 AS depth FROM customer
  UNION SELECT seed, dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 12)
SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node"""


def _io(spark, d):
    lines = read(spark, d, "lineitem").select(F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("artifact_key"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("surface_key"), F.when(F.col("l_returnflag") == "A", "write").when(F.col("l_returnflag") == "N", "read").otherwise("append").alias("direction"))
    return lines


def producer_consumer_blast(spark, d):
    return graph.blast_radius(graph.producer_consumer(_io(spark, d)))


def inverse_edges(spark, d):
    edges = read(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("from_object_ref"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("to_object_ref"), F.when(F.col("n_nationkey") % 4 > 0, "part_of").otherwise("near").alias("predicate"))
    return graph.inverse_edges(edges, spark.createDataFrame([("part_of", "has_part"), ("taught_by", "teacher_of")], "predicate string, inverse string"))


def departed_inventory(spark, d):
    before = read(spark, d, "part").select("p_partkey")
    now = read(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return graph.departed(before, now, "p_partkey")


def exact_duplicate_groups(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.md5(F.encode(label_ascii(F.col("text")), "UTF-8")).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def authority_matches(spark, d):
    entities = read(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), F.concat(F.lit("brand#"), (F.col("doc_id") % 30).cast("string")).alias("label_norm"), F.when(F.col("doc_id") % 2 == 0, "ECONOMY").otherwise("PROMO").alias("entity_type"))
    authorities = read(spark, d, "part").select(F.lower("p_brand").alias("label_norm"), F.col("p_type").alias("authority_type"), F.col("p_partkey").alias("authority_record_id"), F.when(F.col("p_partkey") % 4 == 0, F.lit(1)).alias("merged_into_authority_record_id"))
    return identity.match_authorities(entities, authorities)


def work_matches(spark, d):
    candidates = read(spark, d, "documents").select(F.col("doc_id").alias("candidate_id"), F.posexplode(F.array(F.col("doc_id"), F.col("doc_id") + 300)).alias("candidate_index", "v")).select("candidate_id", "candidate_index", F.lit("local").alias("scheme"), F.col("v").cast("string").alias("value"))
    identifiers = read(spark, d, "documents").select(F.lit("local").alias("scheme"), F.col("doc_id").cast("string").alias("value"), F.col("doc_id").alias("work_id"), F.when(F.col("doc_id") % 3 == 0, "invalid").otherwise("valid").alias("validity_status"))
    return identity.match_works(candidates, identifiers, works(spark, d))


def merge_repoint(spark, d):
    merges = read(spark, d, "supplier").filter("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("loser"), (F.col("s_suppkey") + 1).alias("winner"))
    return identity.repoint(read(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), merges, "l_suppkey").groupBy("l_suppkey").agg(F.count("*").alias("n"))


def correction_lineage(spark, d):
    ref = lambda c: F.concat(F.lit("order:"), c.cast("string"))
    events = read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("event_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("changed_at"), F.array(ref(F.col("o_custkey"))).alias("sources"), F.array(ref(F.col("o_custkey") + 1)).alias("results"))
    return identity.correction_lineage(events)


def content_keys(spark, d):
    rows = read(spark, d, "customer")
    return rows.select("c_custkey", content_id("customer", F.col("c_name"), F.col("c_nationkey")).alias("content_id"), uuid5(NAMESPACE, F.col("c_name")).alias("uuid"))


def work_keys(spark, d):
    rows = works(spark, d, text=True)
    none = F.lit(None).cast("string")
    key = identity.work_key(F.when(F.col("work_id") % 5 == 0, F.concat(F.lit("key-"), F.col("work_id").cast("string"))), F.when(F.col("work_id") % 5 == 1, "DOI"), F.when(F.col("work_id") % 5 == 1, F.concat(F.lit(" 10.1000/X"), F.col("work_id").cast("string"))),
                            F.when(F.col("work_id") % 5 < 4, F.concat(F.lit("Title  "), F.col("workspace_id"))), F.when(F.col("work_id") % 5 == 2, F.col("work_type")), F.when(F.col("work_id") % 5 == 2, F.lit("src")), F.when(F.col("work_id") % 10 == 3, F.lit(1999)), none)
    return rows.select("work_id", key.alias("identity"), identity.claim_key(F.col("workspace_id"), F.col("work_type"), F.col("work_id").cast("string"), F.lit("A  Claim ")).alias("claim_key"))


QUERIES = {
    f.__name__: f
    for f in (
        scope_union_distinct, exists_or_scope, left_join_chain_coalesce, or_join_rewrite, prefix_join_rewrite, conflicting_numeric_claims, conflicting_claims_by_workspace, impossible_interval_pairs, life_facts,
        first_contradiction_per_group, semi_join_resolved_refs, anti_join_orphans, closure_status_rollup, reference_parts, degree_distribution, connected_components, component_sizes, lineage_recursive, artifact_chains, reach_depths,
        producer_consumer_blast, inverse_edges, departed_inventory, exact_duplicate_groups, authority_matches, work_matches, merge_repoint, correction_lineage, content_keys, work_keys,
    )
}

CLAIMS = "claims AS (SELECT p_partkey AS id, p_brand || '|' || p_type || '|' || p_name AS about, p_brand AS brand, p_size AS n, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 3 AS VARCHAR) END AS ws FROM part)"
KNOWN = "known AS (SELECT 'part:' || p_partkey AS ref FROM part WHERE p_size < 25 UNION SELECT 'supplier:' || s_suppkey FROM supplier)"
IO = "io AS (SELECT 'part-' || l_partkey AS k, 's' || l_suppkey AS s, CASE l_returnflag WHEN 'N' THEN 'read' ELSE 'write' END AS dir FROM lineitem)"

CONTENT_KEYS = f"""WITH s AS (SELECT *, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(c_name)) AS s FROM customer)
SELECT c_custkey, 'customer:' || substr(sha256(c_name || chr(31) || c_nationkey), 1, 24) AS content_id,
  substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(s, 17, 1)) - 1) % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS uuid FROM s"""

ORACLE = {
    "content_keys": CONTENT_KEYS,
    "scope_union_distinct": "SELECT c_custkey AS id FROM customer WHERE c_nationkey = 1 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000",
    "exists_or_scope": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 3)",
    "left_join_chain_coalesce": """SELECT coalesce(p_type, o_orderstatus, c_mktsegment, '[none]') AS workspace, count(*) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25
  LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P' LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 12 GROUP BY 1""",
    "or_join_rewrite": "SELECT DISTINCT page_id, doc_id FROM pages JOIN documents ON page_id = doc_id OR length(html) % 500 = doc_id",
    "prefix_join_rewrite": "SELECT c_mktsegment, count(*) AS leads, min(event_id) AS first_event FROM (SELECT event_id, 'source-lead:' || user_id || ':' || event_type || ':' || event_id AS lead FROM events) JOIN customer ON starts_with(lead, 'source-lead:' || c_custkey || ':') GROUP BY 1",
    "conflicting_numeric_claims": f"WITH {CLAIMS} SELECT a.id AS low_id, b.id AS high_id FROM claims a JOIN claims b ON a.about = b.about AND a.id < b.id AND a.n <> b.n",
    "conflicting_claims_by_workspace": f"WITH {CLAIMS} SELECT DISTINCT least(a.id, b.id) AS low_id, greatest(a.id, b.id) AS high_id FROM claims a JOIN claims b ON a.about = b.about AND a.id <> b.id AND a.n <> b.n AND (a.ws IS NULL OR a.ws = b.ws)",
    "impossible_interval_pairs": LIFE_SQL,
    "life_facts": """SELECT o_custkey AS ref, CAST(min(year(o_orderdate)) FILTER (o_orderstatus = 'O') AS INTEGER) AS birth_min, CAST(max(year(o_orderdate)) FILTER (o_orderstatus = 'O') AS INTEGER) AS birth_max,
  CAST(min(year(o_orderdate)) FILTER (o_orderstatus = 'F') AS INTEGER) AS death_min, CAST(max(year(o_orderdate)) FILTER (o_orderstatus = 'F') AS INTEGER) AS death_max FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus IN ('O', 'F') GROUP BY o_custkey""",
    "first_contradiction_per_group": f"WITH {CLAIMS}, pairs AS (SELECT a.id AS low_id, b.id AS high_id, a.brand AS p_brand FROM claims a JOIN claims b ON a.about = b.about AND a.id < b.id AND a.n <> b.n) SELECT low_id, high_id, p_brand FROM pairs QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY low_id, high_id) = 1",
    "semi_join_resolved_refs": f"WITH {KNOWN} SELECT l_returnflag, count(*) AS n FROM lineitem WHERE 'part:' || l_partkey IN (SELECT ref FROM known) GROUP BY 1",
    "anti_join_orphans": f"WITH {KNOWN} SELECT l_orderkey, l_linenumber, 'part:' || l_partkey AS ref FROM lineitem WHERE 'part:' || l_partkey NOT IN (SELECT ref FROM known)",
    "closure_status_rollup": f"""WITH {KNOWN}, refs AS (SELECT l_returnflag AS family, 'part:' || l_partkey AS ref, l_linestatus AS st FROM lineitem),
fates AS (SELECT family, CASE WHEN ref IN (SELECT ref FROM known) THEN 'resolved' WHEN st = 'O' THEN 'exempt' WHEN (family = 'A' AND ref LIKE '%1') OR family = 'N' THEN 'tracked' ELSE 'orphan' END AS fate FROM refs
  UNION ALL SELECT 'orders', 'resolved' FROM orders),
c AS (SELECT family, count(*) AS total, count(*) FILTER (fate = 'resolved') AS resolved, count(*) FILTER (fate = 'exempt') AS exempt, count(*) FILTER (fate = 'tracked') AS unresolved_tracked, count(*) FILTER (fate = 'orphan') AS orphan FROM fates GROUP BY family)
SELECT *, CASE WHEN orphan > 0 THEN 'fail' WHEN unresolved_tracked > 0 THEN 'pass_with_unresolved' WHEN total = 0 THEN 'no_rows' ELSE 'pass' END AS status FROM c""",
    "reference_parts": "SELECT 'part' AS namespace, count(*) AS n, count(DISTINCT l_partkey) AS keys FROM lineitem",
    "degree_distribution": """WITH e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), g AS (SELECT node, count(*) AS g FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node)
SELECT CASE WHEN g = 1 THEN '1' WHEN g <= 3 THEN '2-3' WHEN g <= 10 THEN '4-10' ELSE '11+' END AS bucket, count(*) AS nodes FROM g GROUP BY 1""",
    "connected_components": f"WITH {COMPONENTS} SELECT node, component FROM labels",
    "component_sizes": f"WITH {COMPONENTS} SELECT component, count(*) AS size FROM labels GROUP BY component ORDER BY size DESC, component LIMIT 10",
    "lineage_recursive": LINEAGE_SQL,
    "artifact_chains": CHAINS_SQL,
    "reach_depths": REACH_SQL,
    "producer_consumer_blast": f"WITH {IO}, l AS (SELECT DISTINCT a.k, a.s AS p, b.s AS c FROM io a JOIN io b ON a.k = b.k AND a.dir = 'write' AND b.dir = 'read' AND a.s <> b.s) SELECT k AS artifact_key, count(DISTINCT p) AS producers, count(DISTINCT c) AS consumers FROM l GROUP BY k",
    "inverse_edges": "SELECT 'region:' || n_regionkey AS from_object_ref, 'nation:' || n_nationkey AS to_object_ref, 'has_part' AS predicate FROM nation WHERE n_nationkey % 4 > 0",
    "departed_inventory": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)",
    "exact_duplicate_groups": r"SELECT md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "authority_matches": """WITH e AS (SELECT doc_id AS entity_id, 'brand#' || (doc_id % 30) AS l, CASE WHEN doc_id % 2 = 0 THEN 'ECONOMY' ELSE 'PROMO' END AS t FROM documents),
a AS (SELECT lower(p_brand) AS l, p_type AS t, count(DISTINCT p_partkey) AS m, min(p_partkey) AS c FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1, 2)
SELECT entity_id, m AS matches, CASE WHEN m = 1 THEN c END AS candidate, CASE WHEN m = 1 THEN 0.75 ELSE 0.5 END::DOUBLE AS match_score, CASE WHEN m = 1 THEN 'proposed' ELSE 'ambiguous' END AS status FROM e JOIN a USING (l, t)""",
    "work_matches": f"""WITH {WORKS}, ok AS (SELECT work_id FROM works WHERE review_state = 'reviewed' AND work_id % 3 <> 0), c AS (SELECT doc_id AS candidate_id, i, doc_id + 300 * i AS v FROM documents CROSS JOIN (VALUES (0), (1)) AS t(i))
SELECT candidate_id, min_by(v, i) AS work_id, count(DISTINCT v) > 1 AS ambiguous FROM c JOIN ok ON v = work_id GROUP BY candidate_id""",
    "merge_repoint": "SELECT CASE WHEN l_suppkey % 7 = 0 THEN l_suppkey + 1 ELSE l_suppkey END AS l_suppkey, count(*) AS n FROM lineitem GROUP BY 1",
    "correction_lineage": """WITH e AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) AS ts, o_custkey AS s FROM orders WHERE o_orderstatus = 'P'), taken AS (SELECT s, min_by(id, (ts, id)) AS by_id FROM e GROUP BY s),
seen AS (SELECT s AS r FROM e UNION SELECT s + 1 FROM e) SELECT 'order:' || r AS ref, CASE WHEN by_id IS NULL THEN 'current' ELSE 'superseded' END AS status, by_id AS superseded_by FROM seen LEFT JOIN taken ON s = r""",
    "work_keys": f"""WITH {WORKS} SELECT work_id, CASE work_id % 5 WHEN 0 THEN 'key-' || work_id WHEN 1 THEN 'identifier|doi|10.1000/x' || work_id WHEN 2 THEN 'source|title ' || workspace_id || '|' || work_type || '|src'
  WHEN 3 THEN CASE WHEN work_id % 10 = 3 THEN 'dated|title ' || workspace_id || '|1999' ELSE 'title|title ' || workspace_id END END AS identity,
  sha256(workspace_id || chr(31) || work_type || chr(31) || work_id || chr(31) || 'a claim') AS claim_key FROM works""",
}
