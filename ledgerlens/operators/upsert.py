"""Merges with per-column rules, append-only inserts and the snapshot store."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.states import keeps_envelope, merge_review_state
from ..functions.values import instant
from ..schemas import TABLES
from ..session import use_checkpoint_dir

#: A rule gives the merged value from (old, new) columns and whether the old envelope stays.
Rule = Callable[[Column, Column, Column], Column]


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


RULES: dict[str, Rule] = {
    "text": lambda old, new, keep: F.coalesce(blank_to_null(new), old),
    "replace": lambda old, new, keep: F.coalesce(new, old),
    "first": lambda old, new, keep: F.coalesce(old, new),
    "envelope": lambda old, new, keep: F.when(keep, old).otherwise(F.coalesce(new, old)),
    "review_state": lambda old, new, keep: merge_review_state(old, new),
    "earliest": lambda old, new, keep: F.when(instant(new).isNull() | (instant(old) <= instant(new)), old).otherwise(new),
    "latest": lambda old, new, keep: F.when(instant(new).isNull() | (instant(old) >= instant(new)), old).otherwise(new),
    "max": lambda old, new, keep: F.greatest(old, new),
}

ENVELOPE = {c: "envelope" for c in ("confidence_score", "provenance_event_ref", "publication_state", "authority_level", "public_blocker")}
WORK_RULES = {"work_type": "text", "title": "text", "rights_posture": "text", "raw_cite_text": "text", "accepted_for_citation": "max", "first_seen_at": "earliest", "last_seen_at": "latest", "review_state": "review_state", **ENVELOPE}


def merge(old: DataFrame, new: DataFrame, key: Sequence[str], rules: dict[str, str], arrival: str | None = None) -> DataFrame:
    """``old`` with ``new`` merged in by a null-safe key; columns without a rule are replaced.

    Keys of ``old`` are unique.  Several new rows of one key fold in, in the order
    of ``arrival``, as if they came one after another: a running window finds the
    state that each row met, one aggregation folds every column, one join merges.
    """
    if arrival is None:
        return _merge_once(old, new, key, rules)
    folded = _fold(old, new, key, rules, arrival)
    both = old.withColumn("_old", F.lit(True)).alias("a").join(folded.alias("b"), _same(key), "full_outer")
    is_old, is_new = F.col("_old").isNotNull(), F.col("b._new").isNotNull()

    def merged(c: str) -> Column:
        if c in key:
            return F.when(is_old, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
        if c not in new.columns:
            return F.col(f"a.{c}")
        was = F.when(is_old, F.col(f"a.{c}")).otherwise(F.col(f"b._base.{c}"))
        return F.when(is_new, RULES[rules.get(c, "replace")](was, F.col(f"b._rest.{c}"), F.lit(False))).otherwise(was)

    return both.select(*(merged(c).alias(c) for c in old.columns))


def _same(key: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key))


def _fold(old: DataFrame, new: DataFrame, key: Sequence[str], rules: dict[str, str], arrival: str) -> DataFrame:
    """A row for each key of ``new``: ``_base``, its first row where the table has none, and ``_rest``, all others folded."""
    columns = [c for c in old.columns if c in new.columns and c not in key]
    stated = "review_state" in columns
    met = F.col("review_state").alias("_met") if stated else F.lit(None).cast("string").alias("_met")
    had = old.select(*key, met, F.lit(True).alias("_had")).alias("b")
    rows = new.alias("a").join(had, _same(key), "left").select("a.*", "_met", "_had")
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(arrival)))
    before = Window.partitionBy(*key).orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    decided = F.when(~F.col("review_state").isin(*vocab.LEADS), F.col("review_state")) if stated else F.lit(None).cast("string")
    met = F.coalesce(F.last(decided, ignorenulls=True).over(before), F.col("_met"))
    keep = keeps_envelope(met, F.col("review_state")) if stated else F.lit(False)
    rows = rows.withColumn("_keep", keep).withColumn("_rest", F.col("_had").isNotNull() | (F.col("_nth") > 1))

    def last(value: Column, ok: Column | None = None) -> Column:
        counts = F.col("_rest") & value.isNotNull() & (F.lit(True) if ok is None else ok)
        return F.max_by(value, F.when(counts, F.col("_nth")))

    def folded(c: str) -> Column:
        value, rule, nth = F.col(c), rules.get(c, "replace"), F.col("_nth")
        at = F.when(F.col("_rest"), instant(value)) if rule in ("earliest", "latest") else None
        match rule:
            case "text":
                return last(blank_to_null(value))
            case "first":
                return F.min_by(value, F.when(F.col("_rest") & value.isNotNull(), nth))
            case "envelope":
                return last(value, ~F.col("_keep"))
            case "review_state":
                return F.coalesce(last(decided), last(value))
            case "earliest":
                return F.min_by(value, F.when(at.isNotNull(), F.struct(at, nth)))
            case "latest":
                return F.max_by(value, F.when(at.isNotNull(), F.struct(at, -nth)))
            case "max":
                return F.max(F.when(F.col("_rest"), value))
        return last(value)

    base = F.first(F.when(~F.col("_rest"), F.struct(*columns)), ignorenulls=True)
    return rows.groupBy(*key).agg(F.lit(True).alias("_new"), base.alias("_base"), F.struct(*(folded(c).alias(c) for c in columns)).alias("_rest"))


def _merge_once(old: DataFrame, new: DataFrame, key: Sequence[str], rules: dict[str, str]) -> DataFrame:
    a = old.withColumn("_old", F.lit(True)).alias("a")
    b = new.withColumn("_new", F.lit(True)).alias("b")
    both = a.join(b, _same(key), "full_outer")
    is_old, is_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    keep = keeps_envelope(F.col("a.review_state"), F.col("b.review_state")) if "review_state" in old.columns and "review_state" in new.columns else F.lit(False)

    def merged(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"a.{c}")
        was, now = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in key:
            return F.when(is_old, was).otherwise(now)
        return F.when(is_old & is_new, RULES[rules.get(c, "replace")](was, now, keep)).when(is_new, now).otherwise(was)

    return both.select(*(merged(c).alias(c) for c in old.columns))


def first_rows(rows: DataFrame, key: Sequence[str], arrival: Sequence[str] = ()) -> DataFrame:
    """The first row of each key by ``arrival``, then by the row's contents, so that the order of rows means nothing."""
    if set(rows.columns) == set(key):
        return rows.distinct()
    columns = [F.col(c) for c in rows.columns]
    order = F.struct(*(F.col(c).alias(f"a{i}") for i, c in enumerate(arrival)), F.to_json(F.struct(*columns)).alias("row"))
    picked = rows.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(key))).agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return picked.select("_row.*")


def insert_new(old: DataFrame, new: DataFrame, key: Sequence[str], arrival: Sequence[str] = ()) -> DataFrame:
    """The rows of ``new`` whose key the table does not hold; the first writer by ``arrival`` wins."""
    fresh = first_rows(new, key, arrival)
    same = reduce(lambda x, y: x & y, (fresh[k].eqNullSafe(old[k]) for k in key))
    return fresh.join(old, same, "left_anti")


def replay_conflicts(old: DataFrame, new: DataFrame, key: Sequence[str], ignore: Sequence[str] = ("created_at", "updated_at")) -> DataFrame:
    """Keys that come again with other contents: an append-only table refuses them."""
    compared = [c for c in new.columns if c in old.columns and c not in key and c not in ignore]
    differs = reduce(lambda x, y: x | y, (~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in compared), F.lit(False))
    return old.alias("a").join(new.alias("b"), list(key)).filter(differs).select(*key)


def assign_ids(rows: DataFrame, pk: str, start: int, order: Sequence[str]) -> DataFrame:
    """Surrogate ids from ``start`` in the order of the natural key.

    Rows are range-partitioned and numbered within their partition; a row for
    each partition carries the numbers on.  The checkpoint keeps the places as
    they are when a task runs again.
    """
    use_checkpoint_dir(rows.sparkSession)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumn("_part", F.shiftright("_place", 33)).withColumn("_nth", F.col("_place").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # a row for each partition
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn(pk, (F.lit(start) + F.col("_before") + F.col("_nth")).cast("long"))
    return numbered.select(*rows.columns)


def review_decisions(targets: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(targets with the decided states, history rows) for decisions of key, expected_state, new_state, changed_by, changed_at, reason.

    A decision applies where the expected state is the present one (or none was expected) and the state changes; a second run changes nothing.
    Of several decisions on a target the first by ``changed_at`` counts; ``operators.decisions`` folds all of them.
    """
    d = first_rows(decisions, [key], ["changed_at"]).alias("d")
    t = targets.alias("t")
    hit = (F.col("d.expected_state").isNull() | (F.col("d.expected_state") == F.col("t.review_state"))) & (F.col("d.new_state") != F.col("t.review_state"))
    joined = t.join(d, F.col(f"t.{key}") == F.col(f"d.{key}"), "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    updated = joined.select(*(F.when(F.col("_hit"), F.col("d.new_state")).otherwise(F.col("t.review_state")).alias(c) if c == "review_state" else F.col(f"t.{c}") for c in targets.columns))
    history = joined.filter("_hit").select(
        F.sha2(F.concat_ws("|", F.col(f"t.{key}").cast("string"), F.col("t.review_state"), F.col("d.new_state"), F.col("d.changed_at")), 256).alias("history_id"),
        F.col(f"t.{key}").cast("string").alias("target_id"), F.col("t.review_state").alias("previous_state"), F.col("d.new_state").alias("new_state"), F.col("d.changed_by").alias("changed_by"), F.col("d.changed_at").alias("changed_at"), F.col("d.reason").alias("reason"),
    )
    return updated, history


class CommitConflict(RuntimeError):
    """Another writer committed a table since this one read it."""


class Snapshot:
    """A store of Parquet tables: each commit writes new versions and then the next numbered manifest that names them.

    Readers see the manifest before or after a commit, never between; old
    versions stay readable.  A manifest is put in place by a rename that never
    replaces a file, so of two writers one is first: the other goes on with the
    next number, or gets ``CommitConflict`` where its tables were built on
    versions that are no longer the newest.  Paths go through Hadoop's file
    systems; the store needs a rename that is atomic.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._read: dict[str, str | None] = {}

    def _fs(self):
        root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _newest(self) -> int:
        """The number of the newest manifest, 0 before the first."""
        found = self._fs().globStatus(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-*.json"))
        return max((int(f.getPath().getName()[9:-5]) for f in found or ()), default=0)

    def _manifest(self, number: int) -> dict[str, str]:
        if not number:
            return {}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest-{number:012d}.json").collect()))

    def manifest(self) -> dict[str, str]:
        return self._manifest(self._newest())

    def table(self, name: str) -> DataFrame:
        """The newest version; a later commit of the table holds only while it still is the newest."""
        version = self._read[name] = self.manifest().get(name)
        schema = TABLES.get(name)
        if version is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.path}/{name}/{version}")

    def commit(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        version = f"v={uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{name}/{version}")
        while True:
            number = self._newest()
            now = self._manifest(number)
            stale = sorted(t for t in tables if now.get(t) != self._read.get(t, now.get(t)))
            if stale:
                raise CommitConflict(f"committed by another writer since they were read: {', '.join(stale)}")
            manifest = now | dict.fromkeys(tables, version)
            if self._publish(number + 1, manifest, version):
                self._read |= dict.fromkeys(tables, version)
                return manifest

    def _publish(self, number: int, manifest: dict[str, str], version: str) -> bool:
        """Put the manifest in place; False where another writer took its number."""
        fs, Path = self._fs(), self._jvm.org.apache.hadoop.fs.Path
        staged, final = Path(f"{self.path}/staged.{version}"), Path(f"{self.path}/manifest-{number:012d}.json")
        stream = fs.create(staged, True)
        stream.write(json.dumps(manifest, sort_keys=True).encode())
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(staged, final, self._no_options())
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            fs.delete(staged, False)
            return False
        return True

    def _no_options(self):
        return self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
