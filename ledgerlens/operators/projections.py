"""Policies, handoffs, explanations, pages, prompt payloads and schema migration as projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.states import is_public, lookup
from ..functions.text import host, squeeze
from ..schemas import TABLES, conform


def byte_retention(policy_class: Column, registry: Mapping[str, str]) -> Column:
    """The retention status of a storage policy class; unknown classes are ``retention_unknown``."""
    return F.coalesce(lookup(policy_class, dict(registry)), F.lit("retention_unknown"))


def refetchability(input_family: Column, registry: Mapping[str, str]) -> Column:
    return F.coalesce(lookup(input_family, dict(registry)), F.lit("unknown"))


def export_blocked(rows: DataFrame, policies: DataFrame, column: str = "policy_class") -> DataFrame:
    """Rows with whether their policy class (policy_class, public_export_blocked) keeps them from exports; unknown classes do."""
    known = policies.select(F.col("policy_class").alias(column), F.col("public_export_blocked").alias("_blocked"))
    return rows.join(known, column, "left").withColumn("export_blocked", F.coalesce("_blocked", F.lit(True))).drop("_blocked")


def allowed_url(url: Column, hosts: Sequence[str], prefixes: Sequence[str]) -> Column:
    """Whether a web address is of an allowed host, one below it, or under an allowed prefix."""
    name = F.regexp_replace(F.regexp_replace(host(url), "^[^@]*@", ""), ":[0-9]+$", "")
    out = F.lit(False)
    for h in hosts:
        out = out | (name == h.lower()) | name.endswith("." + h.lower())
    for p in prefixes:
        out = out | url.startswith(p)
    return F.coalesce(url.rlike("(?i)^https?://[^/]") & out, F.lit(False))


HANDOFF = {
    "local_file": ["adapter_local_path", "relative_path"],
    "structured_data": ["adapter_local_path", "relative_path", "record_locator"],
    "remote_url_manifest": ["url"],
    "local_git_repo": ["repo_path", "commit", "relative_path"],
}


def handoffs(planned: DataFrame, variant: str, adapter_id: str, order: Sequence[str]) -> DataFrame:
    """(sequence, adapter_id, variant, locator, handoff_hash) of planned rows; the locator keeps the variant's fields that the rows have."""
    from .upsert import assign_ids

    have = [c for c in HANDOFF[variant] if c in planned.columns]
    locator = F.to_json(F.struct(*(F.col(c) for c in have)))
    rows = planned.select(F.lit(None).cast("long").alias("sequence"), F.lit(adapter_id).alias("adapter_id"), F.lit(variant).alias("variant"), locator.alias("locator"), *[F.col(c).alias(f"_{c}") for c in order])
    numbered = assign_ids(rows, "sequence", 1, [f"_{c}" for c in order]).drop(*(f"_{c}" for c in order))
    return numbered.withColumn("handoff_hash", F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), "adapter_id", "variant", "locator"), 256))


def explanations(ranked: DataFrame, keep: int, candidate_type: str) -> DataFrame:
    """Selection records of ranked candidates (candidate_id, label, score, rank, reason_codes)."""
    chosen = F.col("rank") <= keep
    return ranked.select(
        "candidate_id", F.lit(candidate_type).alias("candidate_type"), "label", F.round("score", 4).alias("score"), chosen.alias("selected"),
        F.when(chosen, "eligible").otherwise("deferred").alias("eligibility_status"), F.coalesce("reason_codes", F.array().cast("array<string>")).alias("reason_codes"),
        F.when(chosen, F.concat(F.lit("rank "), F.col("rank").cast("string"))).otherwise("rank below limit").alias("rationale"),
    )


PROMPT_FIELDS = ["action_id", "action_kind", "subject_id", "selected_facet", "selected_prompt_bundle_id", "should_call_llm", "selected_object_ref", "selected_lead_kind", "cycle_depth", "use_prior_state"]


def prompt_payload(rows: DataFrame) -> Column:
    """The fields of an action that a prompt shows, as JSON without empty ones."""
    return F.to_json(F.struct(*(F.col(c) for c in PROMPT_FIELDS if c in rows.columns)))


def bounded_claim(raw_output: Column) -> Column:
    """The first line of an output, one blank between words and 240 characters at most."""
    return F.coalesce(F.nullif(F.substring(squeeze(F.substring_index(raw_output, "\n", 1)), 1, 240), F.lit("")), F.lit("claim-fallback-empty"))


def pages(records: DataFrame, family: str, key: str, title: Column, body: Column) -> DataFrame:
    """(route, family, title, body) of public records: a page for each."""
    public = records.filter(is_public(F.col("review_state"), F.col("publication_state"), F.col("public_blocker")))
    return public.select(F.concat_ws("/", F.lit(family), F.col(key).cast("string")).alias("route"), F.lit(family).alias("family"), title.alias("title"), body.alias("body"))


def route_closure(built: DataFrame, links: DataFrame) -> DataFrame:
    """Links (route, target) to pages that were not built."""
    return links.join(built.select(F.col("route").alias("target")), "target", "left_anti")


def wrap(name: str, body: Column) -> Column:
    """A delimited block of text."""
    return F.concat(F.lit(f"<<<{name}\n"), body, F.lit(f"\n{name}>>>"))


def unwrap(name: str, text: Column) -> Column:
    """The bodies of all blocks of a name."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<<<{name}\n(.*?)\n{name}>>>"), 1)


def holds_sentinel(row: Column, sentinel: str) -> Column:
    """Whether a private marker is anywhere in a nested value."""
    return F.contains(F.to_json(row), F.lit(sentinel))


def migrate(df: DataFrame, table: str, applied: int, latest: int) -> DataFrame:
    """A table of an older schema version with the present columns; versions only go forward."""
    if applied > latest:
        raise ValueError(f"schema version {applied} of {table} is newer than {latest}")
    return conform(df, table)


def schema_drift(df: DataFrame, table: str) -> list[tuple[str, str]]:
    """(column, problem) where a frame disagrees with the table's contract."""
    have, want = dict(df.dtypes), {f.name: f.dataType.simpleString() for f in TABLES[table].fields}
    return [(c, "missing") for c in want if c not in have] + [(c, f"{have[c]} instead of {want[c]}") for c in want if c in have and have[c] != want[c]] + [(c, "unknown") for c in have if c not in want]


def population(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows, status) of each table: populated or empty."""
    from functools import reduce

    return reduce(DataFrame.union, (df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.when(F.count("*") > 0, "populated").otherwise("empty").alias("status")) for name, df in tables.items()))


def latest_by_type(events: DataFrame) -> DataFrame:
    """The newest event of each type, with how many there are."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.max_by("provenance_event_key_v1", F.struct("event_timestamp", "provenance_event_id")).alias("latest"))


def decisions_in_workspace(decisions: DataFrame, tables: Mapping[str, DataFrame], keys: Mapping[str, str], workspace: str) -> DataFrame:
    """Review decisions on objects of a workspace, over all families by one directory join instead of an OR of EXISTS."""
    from functools import reduce

    owned = reduce(DataFrame.union, (df.select(F.lit(ns).alias("object_namespace"), F.col(keys[ns]).cast("string").alias("object_id"), "workspace_id") for ns, df in tables.items()))
    return decisions.join(owned.filter(F.col("workspace_id") == workspace).select("object_namespace", "object_id").distinct(), ["object_namespace", "object_id"], "left_semi")


def file_overview(files: DataFrame, artifacts: DataFrame, io: DataFrame) -> DataFrame:
    """Files with their artifact and the numbers of surfaces that write and read it."""
    counts = io.groupBy("artifact_key").agg(F.count_if(F.col("direction") != "read").alias("producers"), F.count_if(F.col("direction").isin("read", "read_write")).alias("consumers"))
    return files.join(artifacts, "artifact_key", "left").join(counts, "artifact_key", "left").fillna(0, ["producers", "consumers"])
