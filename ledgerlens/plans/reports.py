"""Diagnostics, health rollups, backups, intake views and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.states import blank_bucket
from ..functions.text import glob_to_regex, host
from ..operators import graph, review
from ..operators.projections import population
from .audits import closure_audit, rollup


def diagnostics(tables: Mapping[str, DataFrame], detail: int = 100) -> dict[str, DataFrame]:
    """What may leave the machine: table sizes, hosts, states, edge families, degree buckets and capped detail without private values."""
    access = tables["source_access"]
    edges = tables["source_relationship"]
    states = reduce(DataFrame.unionByName, (df.select(F.lit(t).alias("table"), blank_bucket(F.col("review_state")).alias("state")) for t, df in tables.items() if "review_state" in df.columns))
    ends = edges.select(F.substring_index("from_object_ref", ":", 1).alias("family"), F.lit("from").alias("end")).union(edges.select(F.substring_index("to_object_ref", ":", 1), F.lit("to")))
    shown = access.select("source_access_id", F.coalesce(host(F.col("canonical_url")), F.lit("[none]")).alias("host"), blank_bucket(F.col("access_class")).alias("access_class"))
    return {
        "population": population(tables),
        "hosts": shown.groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(detail),
        "states": states.groupBy("table", "state").agg(F.count("*").alias("n")),
        "edge_families": ends.groupBy("family", "end").agg(F.count("*").alias("n")),
        "degrees": graph.degree_buckets(edges, "from_object_ref", "to_object_ref"),
        "detail": shown.orderBy("source_access_id").limit(detail),
    }


def doctor(tables: Mapping[str, DataFrame], required: Sequence[str]) -> DataFrame:
    """(status, passed, warned, failed) over the closure of references and the presence of the required tables."""
    closure = closure_audit(dict(tables)).select(F.concat(F.lit("closure:"), F.col("family")).alias("check"), F.when(F.col("status") == "fail", "fail").when(F.col("status") == "pass", "pass").otherwise("warn").alias("status"))
    counts = population({t: df for t, df in tables.items() if t in required}).select(F.concat(F.lit("rows:"), F.col("table")).alias("check"), F.when(F.col("status") == "empty", "warn").otherwise("pass").alias("status"))
    spark = closure.sparkSession
    absent = [(f"table:{t}", "fail") for t in required if t not in tables]
    both = closure.unionByName(counts)
    return rollup(both.unionByName(spark.createDataFrame(absent, "check string, status string")) if absent else both)


def backup_plan(files: DataFrame, policies: Sequence[tuple[str, str]]) -> DataFrame:
    """(relative_path, store_key) of each file that a policy's glob names; the first policy counts, the rest are ``[unmatched]``."""
    key = F.lit("[unmatched]")
    for name, glob in reversed(policies):
        key = F.when(F.col("relative_path").rlike(glob_to_regex(glob)), name).otherwise(key)
    return files.select("relative_path", key.alias("store_key"))


def backup_mismatches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(relative_path, problem) where files and a manifest of (relative_path, sha256) differ."""
    both = files.alias("f").join(manifest.alias("m"), "relative_path", "full_outer")
    problem = F.when(F.col("m.sha256").isNull(), "not_in_manifest").when(F.col("f.sha256").isNull(), "missing").when(F.col("f.sha256") != F.col("m.sha256"), "changed")
    return both.select("relative_path", problem.alias("problem")).filter("problem IS NOT NULL")


def intake_status(plans: DataFrame, captures: DataFrame, extractions: DataFrame) -> DataFrame:
    """Per adapter: planned, captured and extracted rows and the stage that it has reached."""
    counted = lambda df, name: df.groupBy("adapter_id").agg(F.count("*").alias(name))
    out = counted(plans, "planned").join(counted(captures, "captured"), "adapter_id", "left").join(counted(extractions, "extracted"), "adapter_id", "left").fillna(0, ["captured", "extracted"])
    stage = F.when(F.col("captured") == 0, "planned").when(F.col("captured") < F.col("planned"), "capturing").when(F.col("extracted") < F.col("captured"), "extracting").otherwise("complete")
    return out.withColumn("stage", stage)


def standards(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Crosswalk records and mapping reports of works (DCMI), events (PREMIS) and authorities (RiC)."""
    named = {"dcmi": ("work", review.DCMI, "work_id"), "premis": ("provenance_event", review.PREMIS, "provenance_event_id"), "ric": ("authority_record", review.RIC, "authority_record_id")}
    out = {}
    for name, (table, mapping, key) in named.items():
        if table in tables:
            out[f"{name}_records"] = review.crosswalk(tables[table], mapping, key)
            out[f"{name}_mapping"] = review.mapping_report(tables[table], mapping)
    return out


def bibliography(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Works with their identifiers, accesses, claims and relationships as ordered arrays, and their metadata as a map."""
    works = tables["work"].select("work_id", "title", "work_type", "review_state")
    about = tables["source_claim"].filter(F.col("about_object_ref").startswith("work:")).select(F.regexp_extract("about_object_ref", "^work:([0-9]+)$", 1).try_cast("long").alias("work_id"), "claim_type", "claim_text")
    edge = tables["source_relationship"]
    ends = edge.select(F.explode(F.array_distinct(F.array("from_object_ref", "to_object_ref"))).alias("ref"), "predicate", "from_object_ref", "to_object_ref").select(F.regexp_extract("ref", "^work:([0-9]+)$", 1).try_cast("long").alias("work_id"), "predicate", "from_object_ref", "to_object_ref")
    children = {
        "identifiers": tables["work_identifier"].select("work_id", "scheme", "value"),
        "accesses": tables["source_access"].select("work_id", "canonical_url", "original_locator"),
        "claims": about,
        "relationships": ends,
    }
    full = review.assemble(works, "work_id", {n: df.filter("work_id IS NOT NULL") for n, df in children.items()})
    meta = review.attribute_map(tables["work_metadata"], "work_id", F.col("meta_key"), F.col("meta_value"))
    return full.join(meta, "work_id", "left")
