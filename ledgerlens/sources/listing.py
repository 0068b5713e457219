"""Folders, URL manifests and git repositories as planned source rows."""

from __future__ import annotations

import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_to_regex, host
from ..operators.projections import allowed_url

SUFFIXES = {"csv": [".csv"], "json": [".json"], "jsonl": [".jsonl", ".ndjson"], "xml": [".xml"], "text": [".txt", ".md"]}


def _any(column, globs: Sequence[str]):
    out = F.lit(False)
    for glob in globs:
        out = out | column.rlike(glob_to_regex(glob))
    return out


def list_folder(spark: SparkSession, root: str, include: Sequence[str] = ("**/*",), exclude: Sequence[str] = (), suffixes: Sequence[str] = ()) -> DataFrame:
    """(relative_path, byte_count, modified_at, skip_reason) of every file below ``root``; a null reason means it is planned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("byte_count"), F.col("modificationTime").alias("modified_at"))
    base = root.rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    listed = files.select(relative.alias("relative_path"), "byte_count", "modified_at")
    known = F.lit(True)
    if suffixes:
        known = F.lit(False)
        for s in suffixes:
            known = known | F.lower("relative_path").endswith(s)
    reason = F.when(_any(F.col("relative_path"), exclude), "excluded").when(~_any(F.col("relative_path"), include), "not_included").when(~known, "unsupported_suffix")
    return listed.withColumn("skip_reason", reason)


def url_manifest(spark: SparkSession, path: str, hosts: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    """(url, title, notes, source_id, host, action): allow, deny_host, deny_scheme or corrupt for each manifest line; nothing is fetched."""
    rows = spark.read.schema("url string, title string, notes string, source_id string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    name = host(F.col("url"))
    allowed = allowed_url(F.col("url"), hosts, prefixes) if hosts or prefixes else F.lit(True)
    action = F.when(F.col("_bad").isNotNull() | F.col("url").isNull(), "corrupt").when(~F.col("url").rlike("^https?://[^/]"), "deny_scheme").when(F.coalesce(allowed, F.lit(False)), "allow").otherwise("deny_host")
    return rows.select("url", "title", "notes", "source_id", name.alias("host"), action.alias("action"))


def git_files(spark: SparkSession, repo: str, ref: str = "HEAD", include: Sequence[str] = ("**/*",), exclude: Sequence[str] = ()) -> DataFrame:
    """(commit, path, blob, byte_count) of the files that a ref tracks; a driver-side listing of a local clone."""
    run = lambda *a: subprocess.run(["git", "-C", repo, *a], capture_output=True, text=True, check=True).stdout
    commit = run("rev-parse", f"{ref}^{{commit}}").strip()
    rows = []
    for entry in filter(None, run("ls-tree", "-r", "-l", "-z", commit).split("\0")):
        meta, path = entry.split("\t", 1)
        _, kind, blob, size = meta.split()
        if kind == "blob":
            rows.append((commit, path, blob, int(size)))
    listed = spark.createDataFrame(rows, "commit string, path string, blob string, byte_count long")
    return listed.filter(_any(F.col("path"), include) & ~_any(F.col("path"), exclude))


def plan_rollup(rows: DataFrame, reason: str = "skip_reason") -> DataFrame:
    """(status, planned, skipped): ready with anything planned, blocked otherwise."""
    planned = F.count_if(F.col(reason).isNull())
    return rows.agg(F.when(planned > 0, "ready").otherwise("blocked").alias("status"), planned.alias("planned"), F.count_if(F.col(reason).isNotNull()).alias("skipped"))


def inventory_kinds(files: DataFrame, rules: Sequence[tuple[int, str, str]], path: str = "relative_path") -> DataFrame:
    """Each file with the kind of the first rule (priority, glob, kind) that fits it; the contract's rules become one expression, not a join."""
    kind = F.lit("unmapped")
    for _, glob, name in sorted(rules, reverse=True):
        kind = F.when(F.col(path).rlike(glob_to_regex(glob)), name).otherwise(kind)
    return files.select(path, kind.alias("kind"))


def missing_references(referenced: DataFrame, present: DataFrame, path: str) -> DataFrame:
    return referenced.select(path).distinct().join(present.select(path), path, "left_anti")
