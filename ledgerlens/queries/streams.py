"""The streaming twin of the failure reducer, run over the event log to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import use_checkpoint_dir
from ..streaming.failures import failure_states
from ..streaming.run_state import run_states
from .store import OUTCOMES
from .views import read


def stream_failure_state(spark, d):
    """States after the whole log, from a stream that reads it as files; equal to the batch reducer's."""
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    log = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    events = log.filter("event_type IN ('purchase', 'error', 'signup')").select(
        F.col("event_id").cast("string").alias("event_id"), F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("run_id"), F.col("user_id").cast("string").alias("workspace_id"), "event_type", F.col("ts").cast("timestamp").alias("ts")
    )
    states = failure_states(events, ["purchase"], ["error"], max_failures=3)

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/states")

    query = states.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/states").groupBy("workspace_id").agg(F.max_by("state", "batch").alias("state"), F.max_by("failure_streak", "batch").alias("failure_streak"), F.max_by("runs", "batch").alias("runs"))


def stream_run_state(spark, d):
    """The same states with an entry of state for each run."""
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/runs-{uuid.uuid4().hex}"
    log = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").filter("event_type IN ('purchase', 'error', 'signup')")
    user = F.col("user_id").cast("string")
    events = log.select(F.col("event_id").cast("string").alias("event_id"), F.concat_ws("-", user, (F.col("event_id") % 7).cast("string")).alias("run_id"), user.alias("workspace_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    states = run_states(events, ["purchase"], ["error"], max_failures=3).select("workspace_id", "state", "failure_streak", "runs")

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/states")

    states.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    newest = spark.read.parquet(f"{folder}/states").groupBy("workspace_id").agg(F.max_by(F.struct("state", "failure_streak", "runs"), "batch").alias("s"))
    return newest.select("workspace_id", "s.*")


QUERIES = {"stream_failure_state": stream_failure_state, "stream_run_state": stream_run_state}

ORACLE = {
    "stream_failure_state": f"""WITH {OUTCOMES}, e AS (SELECT user_id, count(*) AS runs, max_by(outcome, (ts, event)) AS latest, max((ts, event)) FILTER (outcome <> 'failure') AS good FROM outcomes GROUP BY user_id),
s AS (SELECT e.user_id, latest, runs, (SELECT count(*) FROM outcomes o WHERE o.user_id = e.user_id AND outcome = 'failure' AND (good IS NULL OR (o.ts, o.event) > good)) AS streak FROM e)
SELECT CAST(user_id AS VARCHAR) AS workspace_id, CASE WHEN latest = 'success' THEN 'healthy' WHEN latest = 'unknown' OR streak >= 3 THEN 'blocked' ELSE 'retryable_failure' END AS state, streak AS failure_streak, runs FROM s""",
}
ORACLE["stream_run_state"] = ORACLE["stream_failure_state"]
