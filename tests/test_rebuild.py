"""Additive fingerprints, trees of them, and the rebuild audit against replayed candidates."""

import random

from pyspark.sql import functions as F
from test_plans import FIRST, batch, candidate

from ledgerlens.operators.fingerprint import differing_keys, fingerprint, hash_tree, unequal_buckets
from ledgerlens.plans import rebuild


def test_fingerprint(spark):
    rows = [(i, random.Random(i).choice([None, "", "a", "-", "1:a", "ü" * i])) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, v string")
    shuffled = spark.createDataFrame(rows[::-1], "k int, v string").repartition(7).select("v", "k")
    assert fingerprint(df).first() == fingerprint(shuffled).first()
    assert fingerprint(df).first() == fingerprint(df.withColumn("record_last_updated", F.lit("now"))).first()
    for other in (df.filter("k > 0"), df.union(df.limit(1)), df.withColumn("v", F.coalesce("v", F.lit("-")))):
        assert fingerprint(df).first().fingerprint != fingerprint(other).first().fingerprint
    pair = lambda a, b: fingerprint(spark.createDataFrame([(a, b)], "a string, b string")).first().fingerprint
    assert pair("a|b=", "c") != pair("a", "b=|c") and pair(None, "") != pair("", None) and pair("-", None) != pair(None, "-")
    assert fingerprint(df.limit(0)).first().n_rows == 0
    plan = fingerprint(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "collect_list" not in plan


def brute(left, right, key, columns):
    """Differing keys by plain counters."""
    out = {}
    names = [*key, *columns]
    by = lambda rows: {k: sorted((r for r in rows if tuple(r[i] for i in range(len(key))) == k), key=repr) for k in {tuple(r[: len(key)]) for r in rows}}
    a, b = by(left), by(right)
    for k in set(a) | set(b):
        x, y = a.get(k, []), b.get(k, [])
        if x != y:
            moved = [c for i, c in enumerate(names) if i >= len(key) and sorted((r[i] for r in x), key=repr) != sorted((r[i] for r in y), key=repr)]
            out[k] = (len(x), len(y), "missing" if not y else "extra" if not x else "changed", ",".join(moved) if x and y else "")
    return out


def test_differing_keys_against_counters(spark):
    r = random.Random(3)
    row = lambda: (r.choice([None, 1, 2, 3, 4, 5, 6, 7, 8]), r.choice([None, "", "a"]), r.choice([None, "x", "y"]), r.choice([0, 1]))
    left = [row() for _ in range(200)]
    right = [x if r.random() > 0.1 else row() for x in left if r.random() > 0.02] + [(9, "new", "x", 1)] * 2
    schema = "k int, l string, v string, w int"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    for levels in ((0, 1), (0, 2, 4), (0, 1, 2, 3)):
        buckets = unequal_buckets(hash_tree(a, ["k", "l"], levels=levels), hash_tree(b, ["k", "l"], levels=levels), levels=levels)
        got = differing_keys(a, b, ["k", "l"], buckets, levels[-1]).collect()
        assert {(x.k, x.l): (x.left_rows, x.right_rows, x.status, x.columns) for x in got} == brute(left, right, ["k", "l"], ["v", "w"])
    assert rebuild.differences(a, a.repartition(5), ["k", "l"]).count() == 0
    assert rebuild.differences(a.limit(0), b, ["k", "l"]).filter("status != 'extra'").count() == 0
    assert rebuild.differences(a.limit(0), b.limit(0), ["k", "l"]).count() == 0


def test_equal_subtrees_are_not_descended(spark, tmp_path):
    a = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    b = a.withColumn("v", F.when(F.col("k") == 77, 99).otherwise(F.col("v")))
    for name, df in (("a", a), ("b", b)):
        hash_tree(df, ["k"]).write.partitionBy("level").parquet(f"{tmp_path}/{name}")
    trees = [spark.read.schema("path string, n long, h1 decimal(38,0), h2 decimal(38,0), h3 decimal(38,0), h4 decimal(38,0), level int").parquet(f"{tmp_path}/{n}") for n in "ab"]
    found = unequal_buckets(*trees).collect()
    assert len(found) == 1 and found[0].left_rows == found[0].right_rows >= 1
    # a leaf that differs below an equal parent is never asked: the parent's sums decide
    torn = trees[1].filter("level < 4").unionByName(trees[1].filter("level = 4").withColumn("h1", F.col("h1") + 1))
    assert unequal_buckets(trees[0], trees[0].filter("level < 4").unionByName(torn.filter("level = 4"))).count() == 0
    assert [(x.k, x.status, x.columns) for x in rebuild.differences(a, b, ["k"]).collect()] == [(77, "changed", "v")]


def test_replay_and_verdict(spark, tmp_path):
    import json

    from ledgerlens.operators.upsert import Snapshot
    from ledgerlens.plans.ingest import ingest_candidates
    from ledgerlens.sources.artifacts import candidates

    other = batch("run2", "people", [candidate(1, "work", {"title": "Other", "year": "1999"}, "reviewed")], "2024-02-01")
    bad = batch("run3", "people", [candidate(1, "work", {"title": "Third", "year": "soon"}, "reviewed"), candidate(2, "work", {"title": "Fourth"}, "reviewed")], "2024-03-01")
    for name, content in (("one", batch("run1", "works", FIRST)), ("two", other), ("bad", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    store, scratch = (Snapshot(spark, f"file://{tmp_path}/{name}") for name in ("store", "scratch"))
    batches = {name: candidates(spark, f"{tmp_path}/{name}.json") for name in ("one", "two", "bad")}
    for name in ("one", "two"):
        ingest_candidates(store, batches[name])
    given = batches["two"].unionByName(batches["bad"]).unionByName(batches["one"])
    runs, compared, verdict = rebuild.audit(store, scratch, given, ["work", "provenance_event"])
    assert {x.run_id: (x.invalid, x.codes) for x in runs.collect()} == {"run1": (0, ""), "run2": (0, ""), "run3": (1, "year_invalid")}
    found = compared.collect()  # two runs in one merge give what one after the other gave, and the bad run left nothing
    assert verdict == "not_rebuildable" and {x.status for x in found} == {"match"}, found
    short = rebuild.compare_stores({"work": store.table("work")}, {"work": scratch.table("work").filter("title != 'Other'")}).first()
    assert (short.rows, short.rebuilt_rows, short.unequal_buckets, short.status) == (2, 1, 1, "different")


def test_final_status():
    say = rebuild.final_status
    assert say("validate_only", 0) == "validation_only" and say("validate_only", 1) == "not_rebuildable" and say("validate_only", 0, 2) == "incomplete_support"
    assert say("replay", 0) == "rebuildable" and say("replay", 0, closure="warning") == "rebuildable_with_warnings"
    assert say("compare_existing", 0, closure="fail") == say("compare_existing", 0, different=1) == "not_rebuildable"
