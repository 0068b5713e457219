"""State by run against the batch reducer, with late events and repeated runs."""

import random
import time
import uuid

SCHEMA = "event_id string, run_id string, workspace_id string, event_type string, ts timestamp"


def written(spark, batches, path):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).coalesce(1).write.mode("append").json(path)


def finished(spark, path, **options):
    from ledgerlens.streaming.failures import stream_ledger
    from ledgerlens.streaming.run_state import run_states

    name = f"runs_{uuid.uuid4().hex}"
    query = run_states(stream_ledger(spark, path, SCHEMA, 1), **options).writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    return [r for r in spark.table(name).collect()]


def test_runs_equal_the_batch_reducer(spark, tmp_path):
    from ledgerlens.operators.review import failure_state, terminal_outcomes

    r = random.Random(7)
    rows = [(f"{i:04d}", f"r{r.randrange(25)}", f"w{r.randrange(4)}", r.choice(["run_failed"] * 6 + ["run_succeeded", "run_odd"]), f"2024-01-{1 + r.randrange(28):02d} {r.randrange(24):02d}:00:00") for i in range(240)]
    path = str(tmp_path / "log")
    written(spark, [rows[i::8] for i in range(8)], path)
    last = {}
    for row in finished(spark, path):
        if row.state != "retry_due":
            last[row.workspace_id] = row  # the memory sink keeps the order of batches
    log = spark.read.schema(SCHEMA).json(path)
    batch = failure_state(terminal_outcomes(log, "workspace_id", "run_id", "ts", "event_id", "event_type", ["run_succeeded"], ["run_failed"]), "workspace_id").collect()
    runs = {x.workspace_id: x.n for x in log.groupBy("workspace_id").agg({"run_id": "count"}).withColumnRenamed("count(run_id)", "n").collect()}
    assert set(runs) == set(last) and all(last[w].runs <= runs[w] for w in runs)
    for row in batch:
        got = last[row.workspace_id]
        assert (got.state, got.failure_streak if got.state != "healthy" else 0) == (row.state, row.failure_streak), row
        assert got.next_retry_at == row.next_retry_at


def test_a_backoff_that_has_ended_is_told(spark, tmp_path):
    from ledgerlens.streaming.failures import stream_ledger
    from ledgerlens.streaming.run_state import run_states

    path = str(tmp_path / "log")
    written(spark, [[("1", "a", "w", "run_failed", "2024-01-01 00:00:00"), ("2", "b", "x", "run_succeeded", "2024-01-01 00:00:00")]], path)
    name = f"due_{uuid.uuid4().hex}"
    query = run_states(stream_ledger(spark, path, SCHEMA, 1), backoff_seconds=60, timers=True).writeStream.outputMode("update").format("memory").queryName(name).trigger(processingTime="1 second").start()
    due, until = [], time.monotonic() + 60
    while not due and time.monotonic() < until and query.isActive:
        time.sleep(1)
        due = [r for r in spark.table(name).collect() if r.state == "retry_due"]
    query.stop()
    assert [(r.workspace_id, r.failure_streak, str(r.next_retry_at)) for r in due] == [("w", 1, "2024-01-01 00:01:00")]
    assert ("x", "healthy") in {(r.workspace_id, r.state) for r in spark.table(name).collect()}
