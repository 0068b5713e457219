"""The rebuild audit over whole tables: orders lost, changed and added by a rebuild, and lines that it gives again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import rebuild
from .views import read

KEYS = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "part": ["p_brand", "p_type"]}


def _stores(spark, d):
    columns = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], "part": ["p_partkey", "p_brand", "p_type", "p_size"]}
    original = {t: read(spark, d, t).select(*c) for t, c in columns.items()}
    key = F.col("o_orderkey")
    status, customer = F.when(key % 97 == 0, "X").otherwise(F.col("o_orderstatus")), F.when(key % 89 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    orders = original["orders"]
    kept = orders.filter(key % 101 != 0).withColumns({"o_orderstatus": status, "o_custkey": customer})
    added = orders.filter(key % 103 == 0).withColumn("o_orderkey", -key)
    parts = original["part"].withColumn("p_size", F.when(F.col("p_partkey") % 500 == 0, None).otherwise(F.col("p_size")))
    return original, {"orders": kept.unionByName(added), "lineitem": original["lineitem"].repartition("l_partkey"), "part": parts}


def rebuild_report(spark, d):
    """Rows, unequal buckets and verdict of each table."""
    original, rebuilt = _stores(spark, d)
    return reduce(DataFrame.unionByName, (rebuild.compare_table(t, original[t], rebuilt[t], key) for t, key in KEYS.items()))


def rebuild_differences(spark, d):
    """The orders that the rebuild misses, adds or changes, and where."""
    original, rebuilt = _stores(spark, d)
    return rebuild.differences(original["orders"], rebuilt["orders"], KEYS["orders"])


def rebuild_group_differences(spark, d):
    """Parts by brand and type, many rows to a key: the groups whose rows are no longer the same multiset."""
    original, rebuilt = _stores(spark, d)
    return rebuild.differences(original["part"], rebuilt["part"], KEYS["part"])


_ORDERS = """old AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders), new AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM old WHERE o_orderkey % 101 <> 0
  UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM old WHERE o_orderkey % 103 = 0),
differ AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey IS NOT NULL AS l, b.o_orderkey IS NOT NULL AS r, concat_ws(',', CASE WHEN a.o_custkey <> b.o_custkey THEN 'o_custkey' END, CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' END) AS columns
  FROM old a FULL JOIN new b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_custkey <> b.o_custkey OR a.o_orderstatus <> b.o_orderstatus)"""
_PARTS = "groups AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL HAVING bool_or(p_partkey % 500 = 0 AND p_size IS NOT NULL))"

QUERIES = {f.__name__: f for f in (rebuild_report, rebuild_differences, rebuild_group_differences)}
ORACLE = {
    "rebuild_report": f"""WITH {_ORDERS}, {_PARTS}, counted AS (
  SELECT 'orders' AS "table", (SELECT count(*) FROM old) AS rows, (SELECT count(*) FROM new) AS rebuilt_rows, (SELECT count(DISTINCT substr(sha256(length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey), 1, 4)) FROM differ) AS unequal_buckets
  UNION ALL SELECT 'lineitem', count(*), count(*), 0 FROM lineitem
  UNION ALL SELECT 'part', count(*), count(*), (SELECT count(DISTINCT substr(sha256(length(p_brand) || ':' || p_brand || length(p_type) || ':' || p_type), 1, 4)) FROM groups) FROM part)
SELECT *, CASE WHEN unequal_buckets = 0 THEN 'match' ELSE 'different' END AS status FROM counted""",
    "rebuild_differences": f"""WITH {_ORDERS} SELECT o_orderkey, CAST(l AS BIGINT) AS left_rows, CAST(r AS BIGINT) AS right_rows, CASE WHEN NOT r THEN 'missing' WHEN NOT l THEN 'extra' ELSE 'changed' END AS status, CASE WHEN l AND r THEN columns ELSE '' END AS columns FROM differ""",
    "rebuild_group_differences": f"WITH {_PARTS} SELECT p_brand, p_type, n AS left_rows, n AS right_rows, 'changed' AS status, 'p_size' AS columns FROM groups",
}
