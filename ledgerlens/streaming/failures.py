"""Run outcomes and failure state over an append-only event log, as a stream.

Late events are legal, since the batch reducer sorts the whole log; so the
state of a workspace holds the last terminal event of every run of it, and each
micro-batch emits the state that the batch reducer would give for the events
seen so far.  The state grows with the number of runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "workspace_id string, state string, failure_streak long, runs long"
STATE = "run_id array<string>, ts array<double>, event_id array<string>, outcome array<string>"


def reduce_runs(runs: dict[str, tuple[float, str, str]], max_failures: int) -> tuple[str, int]:
    """(state, trailing failures) of run -> (ts, event_id, outcome)."""
    ordered = sorted(runs.values(), key=lambda r: (r[0], r[1]), reverse=True)
    streak = 0
    for _, _, outcome in ordered:
        if outcome != "failure":
            break
        streak += 1
    latest = ordered[0][2]
    if latest == "success":
        return "healthy", 0
    if latest == "unknown" or streak >= max_failures:
        return "blocked", streak
    return "retryable_failure", streak


def failure_states(events: DataFrame, success: Sequence[str] = ("run_succeeded",), failure: Sequence[str] = ("run_failed",), max_failures: int = 5) -> DataFrame:
    """(workspace_id, state, failure_streak, runs) of each workspace that a micro-batch touches.

    ``events`` streams event_id, run_id, workspace_id, event_type and ts (timestamp).
    """
    good, bad = set(success), set(failure)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs: dict[str, tuple[float, str, str]] = {}
        if state.exists:
            for run, ts, event, outcome in zip(*state.get, strict=True):
                runs[run] = (ts, event, outcome)
        for frame in frames:
            for run, ts, event, kind in zip(frame["run_id"], frame["ts"], frame["event_id"], frame["event_type"], strict=True):
                seen = (ts.timestamp(), event, "success" if kind in good else "failure" if kind in bad else "unknown")
                if run not in runs or seen[:2] > runs[run][:2]:
                    runs[run] = seen
        state.update(([*runs], [r[0] for r in runs.values()], [r[1] for r in runs.values()], [r[2] for r in runs.values()]))
        status, streak = reduce_runs(runs, max_failures)
        yield pd.DataFrame({"workspace_id": [key[0]], "state": [status], "failure_streak": [streak], "runs": [len(runs)]})

    return events.groupBy("workspace_id").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def stream_ledger(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of JSON lines as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str, ts: str, delay: str = "1 day"):
    """Append a stream to a Parquet log, each key once within the watermark; runs over what is there and ends."""
    distinct = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return distinct.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
