"""Writers: idempotent appends, spool of failed writes and verified copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fingerprint import fingerprint
from ..operators.upsert import first_rows
from ..session import use_checkpoint_dir


def append_events(df: DataFrame, path: str, key: str, arrival: Sequence[str] = ()) -> int:
    """Append rows whose key the JSON log does not hold yet, the first of each by ``arrival``; the number written.

    What is new is settled once, before it is counted and written.
    """
    spark = df.sparkSession
    try:
        have = spark.read.schema(df.schema).json(path).select(key)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        have = df.limit(0).select(key)
    use_checkpoint_dir(spark)
    fresh = first_rows(df, [key], arrival).join(have, key, "left_anti").checkpoint()
    fresh.write.mode("append").json(path)
    return fresh.count()


def spool(df: DataFrame, operation: str, failure: str, path: str) -> None:
    """Keep rows whose write failed, as JSON with what to do with them."""
    rows = df.select(F.lit(operation).alias("operation_kind"), F.to_json(F.struct(*df.columns)).alias("payload_json"), F.lit(failure).alias("failure"), F.lit("pending").alias("status"))
    rows.withColumn("spool_id", F.sha2(F.concat_ws("|", "operation_kind", "payload_json"), 256)).write.mode("append").json(path)


def pending_spool(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The spooled rows of a schema that still wait, once each."""
    rows = spark.read.schema("operation_kind string, payload_json string, failure string, status string, spool_id string").json(path)
    latest = rows.groupBy("spool_id").agg(F.max(F.col("status") == "replayed").alias("done"), F.first("payload_json").alias("payload_json"))
    return latest.filter("NOT done").select(F.from_json("payload_json", schema).alias("row")).select("row.*")


def mark_replayed(spark: SparkSession, path: str, ids: DataFrame) -> None:
    ids.select("spool_id", F.lit("replayed").alias("status"), F.lit("").alias("payload_json"), F.lit("").alias("operation_kind"), F.lit("").alias("failure")).write.mode("append").json(path)


def verified_copy(spark: SparkSession, source: str, target: str) -> str:
    """Copy a Parquet table and compare fingerprints; the fingerprint."""
    df = spark.read.parquet(source)
    df.write.parquet(target)
    a, b = (fingerprint(x, skip=()).first() for x in (df, spark.read.parquet(target)))
    if a != b:
        raise ValueError(f"copy of {source} differs")
    return a["fingerprint"]
