"""The rebuild audit: candidates replayed into a store of their own, compared with the one that is there, row by row where they differ.

Tables are compared by natural keys, without surrogate ids and instants of writing: a replay gives its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.values import year
from ..operators.fingerprint import LEVELS, bucket_differences, differing_keys
from ..operators.upsert import Snapshot
from .audits import PRIMARY
from .ingest import field, ingest_candidates

# Fixed values of the contract: tables compared by their natural keys alone, and tables not compared.
KEYS_ONLY = {"authority_record": "authority_key_v1", "authority_reconciliation": "reconciliation_key_v1", "provenance_event": "provenance_event_key_v1"}
IGNORED = ["schema_version", "schema_migration_history"]
#: Columns of a replay that are its own.
OWN = ["record_last_updated", "created_at"]


def natural_key(table: str) -> list[str]:
    return [KEYS_ONLY[table]] if table in KEYS_ONLY else schemas.IDENTITY[table]


def comparable(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table that a rebuild has to give again."""
    if table in KEYS_ONLY:
        return df.select(KEYS_ONLY[table]).filter(F.col(KEYS_ONLY[table]).isNotNull())
    return df.drop(*OWN, *([PRIMARY[table]] if table in PRIMARY else []))


def compare_table(name: str, original: DataFrame, rebuilt: DataFrame, key: Sequence[str], digits: int = LEVELS[-1]) -> DataFrame:
    """(table, rows, rebuilt_rows, unequal_buckets, status) of one table, in one exchange of bucket sums."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    summed = bucket_differences(original, rebuilt, key, digits).agg(total("left_rows")("rows"), total("right_rows")("rebuilt_rows"), F.count_if(~F.col("equal")).alias("unequal_buckets"))
    return summed.select(F.lit(name).alias("table"), "rows", "rebuilt_rows", "unequal_buckets", F.when(F.col("unequal_buckets") == 0, "match").otherwise("different").alias("status"))


def differences(original: DataFrame, rebuilt: DataFrame, key: Sequence[str], digits: int = LEVELS[-1]) -> DataFrame:
    """The keys whose rows a rebuild misses, adds or changes: ``differing_keys`` in the unequal buckets.

    Of tables whose ``hash_tree`` is stored, ``unequal_buckets`` finds these from the trees alone.
    """
    buckets = bucket_differences(original, rebuilt, key, digits).filter("NOT equal")
    return differing_keys(original, rebuilt, key, buckets, digits)


def compare_stores(original: dict[str, DataFrame], rebuilt: dict[str, DataFrame]) -> DataFrame:
    """``compare_table`` of every table with a natural key; a table on one side alone differs by all its rows."""
    parts = []
    for name in sorted((set(original) | set(rebuilt)) - set(IGNORED)):
        a, b = (comparable(x[name] if name in x else other[name].limit(0), name) for x, other in ((original, rebuilt), (rebuilt, original)))
        parts.append(compare_table(name, a, b, natural_key(name)))
    return reduce(DataFrame.unionByName, parts)


def candidate_fault(candidates: DataFrame) -> Column:
    """Why a candidate can't be replayed, else null."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    bad_year = F.coalesce(F.trim(field("year")) != "", F.lit(False)) & year(field("year")).isNull()
    return F.when(blank("run_id"), "run_missing").when(blank("candidate_id"), "id_missing").when(blank("family"), "family_missing").when(bad_year, "year_invalid")


def replay(scratch: Snapshot, candidates: DataFrame) -> DataFrame:
    """Ingest the candidates that can be replayed into an empty store; (run_id, replayed, invalid, codes) by run.

    A fault makes its whole run invalid: a run is ingested as one, or not at all.  Runs follow one another by the
    instant of their creation, and all of them fold into each table in one merge.
    """
    judged = candidates.withColumn("_fault", candidate_fault(candidates))
    runs = judged.groupBy("run_id").agg(F.count("*").alias("n"), F.count("_fault").alias("invalid"), F.array_join(F.array_sort(F.collect_set("_fault")), ",").alias("codes"))
    valid = candidates.join(runs.filter("invalid = 0").select("run_id"), "run_id", "left_semi")
    ingest_candidates(scratch, valid.withColumn("sequence", F.struct("created_at", "run_id", "sequence")))
    return runs.select("run_id", F.when(F.col("invalid") == 0, F.col("n")).otherwise(0).alias("replayed"), "invalid", "codes")


def final_status(mode: str, faults: int, unsupported: int = 0, closure: str = "pass", different: int = 0) -> str:
    """The verdict of an audit: what stops a rebuild, then what it lacks, then what it warns of.

    ``faults`` counts invalid and missing artifacts and failed replays, ``unsupported`` artifacts without a way to replay them.
    """
    if faults:
        return "not_rebuildable"
    if unsupported:
        return "incomplete_support"
    if mode == "validate_only":
        return "validation_only"
    if closure == "fail" or different:
        return "not_rebuildable"
    return "rebuildable_with_warnings" if closure in ("pass_with_unresolved", "warning") else "rebuildable"


def audit(store: Snapshot, scratch: Snapshot, candidates: DataFrame, tables: Sequence[str], closure: str = "pass", unsupported: int = 0) -> tuple[DataFrame, DataFrame, str]:
    """(runs replayed, tables compared, verdict) of a store against the candidates that it is said to come from."""
    runs = replay(scratch, candidates)
    compared = compare_stores({t: store.table(t) for t in tables}, {t: scratch.table(t) for t in tables})
    faults = runs.agg(F.coalesce(F.sum("invalid"), F.lit(0))).first()[0]
    different = compared.filter("status = 'different'").count()
    return runs, compared, final_status("compare_existing", faults, unsupported, closure, different)
