"""The failure reducer with state by run: a micro-batch reads and writes the runs that it brings, whatever the workspace's history.

State of a workspace: a map entry for each run (its last terminal event), an
entry for each failed run since the last one that did not fail, and one summary
row.  New events move their run and the summary.  Only where a late event moves
the last run that did not fail are the trailing failures gone through, entry by
entry; only where that very run fails after all are all runs.  Nothing is held
whole.  A timer can say when a backoff ends.

The store must be RocksDB (``STATE_STORE``), which keeps map entries apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUTPUT = "workspace_id string, state string, failure_streak long, runs long, last_failure_at timestamp, next_retry_at timestamp, reason string"

#: (micros, event id) of nothing.
_NEVER = (-(1 << 62), "")
Place = tuple[int, str]


class RunStates(StatefulProcessor):
    def __init__(self, success: Sequence[str], failure: Sequence[str], max_failures: int, backoff_seconds: int, timers: bool):
        self.good, self.bad, self.most, self.backoff, self.timers = set(success), set(failure), max_failures, backoff_seconds, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        entry = "micros long, event string, outcome string"
        self.runs = handle.getMapState("runs", "run string", entry)
        self.trailing = handle.getMapState("trailing", "run string", "micros long, event string")
        self.summary = handle.getValueState("summary", "good_micros long, good_event string, good_run string, micros long, event string, outcome string, streak long, runs long, failed_micros long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[str, tuple[Place, str]] = {}  # of the batch, by run
        for frame in rows:
            for run, ts, event, kind in zip(frame["run_id"], frame["ts"], frame["event_id"], frame["event_type"], strict=True):
                place = (ts.value // 1000 if hasattr(ts, "value") else int(ts), event)
                if run not in newest or place > newest[run][0]:
                    newest[run] = (place, "success" if kind in self.good else "failure" if kind in self.bad else "unknown")
        good, good_run, streak, count, failed, timer = _NEVER, None, 0, 0, None, None
        last: tuple[Place, str] | None = None
        if self.summary.exists():
            s = self.summary.get()
            good, good_run, last, streak, count, failed, timer = (s[0], s[1]), s[2], ((s[3], s[4]), s[5]), s[6], s[7], s[8], s[9]
        lost_good = moved_good = False
        for run, (place, outcome) in newest.items():
            was = None
            if self.runs.containsKey((run,)):
                m, e, o = self.runs.getValue((run,))
                was = ((m, e), o)
                if place <= was[0]:
                    continue
            else:
                count += 1
            self.runs.updateValue((run,), (place[0], place[1], outcome))
            if last is None or place > last[0]:
                last = (place, outcome)
            if outcome == "failure":
                lost_good |= run == good_run
                if place > good or lost_good:
                    streak += not self.trailing.containsKey((run,))
                    self.trailing.updateValue((run,), place)
            else:
                if self.trailing.containsKey((run,)):
                    self.trailing.removeKey((run,))
                    streak -= 1
                if run == good_run or place > good:
                    moved_good |= place > good
                    good, good_run = max(good, place), run
        if lost_good:  # the last run that did not fail has failed since: look through all
            good, good_run = max(((m, e), r) for r, m, e in self._others()) if self._any_other() else (_NEVER, None)
            streak = 0
            for (run,), (m, e, o) in self.runs.iterator():
                if o == "failure" and (m, e) > good:
                    self.trailing.updateValue((run,), (m, e))
                    streak += 1
            moved_good = True
        if moved_good:  # failures before it no longer trail
            stale = [run for (run,), (m, e) in self.trailing.iterator() if (m, e) < good]
            for run in stale:
                self.trailing.removeKey((run,))
            streak = sum(1 for _ in self.trailing.keys())
        yield self._settle(key, good, good_run, last, streak, count, failed, timer)

    def _any_other(self) -> bool:
        return next(self._others(), None) is not None

    def _others(self) -> Iterator[tuple[str, int, str]]:
        """Runs that did not fail."""
        return ((run, m, e) for (run,), (m, e, o) in self.runs.iterator() if o != "failure")

    def _settle(self, key, good, good_run, last, streak, count, failed, timer) -> pd.DataFrame:
        place, outcome = last
        if outcome == "failure":
            failed = place[0]
        blocked = outcome == "unknown" or (outcome == "failure" and streak >= self.most)
        state = "healthy" if outcome == "success" else "blocked" if blocked else "retryable_failure"
        due = failed // 1000 + self.backoff * 1000 if state == "retryable_failure" else None
        if self.timers and due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.summary.update((good[0], good[1], good_run, place[0], place[1], outcome, streak, count, failed, due))
        return self._row(key, state, streak, count, failed if state != "healthy" else None, due, "events")

    def _row(self, key, state, streak, count, failed, due, reason) -> pd.DataFrame:
        at = lambda micros: pd.NaT if micros is None else pd.Timestamp(micros, unit="us")
        return pd.DataFrame({"workspace_id": [key[0]], "state": [state], "failure_streak": [streak], "runs": [count], "last_failure_at": [at(failed)], "next_retry_at": [at(None if due is None else due * 1000)], "reason": [reason]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A backoff has ended: the workspace may run again."""
        s = self.summary.get()
        if s[9] is not None and s[9] <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._row(key, "retry_due", s[6], s[7], s[8], s[9], "backoff ended")

    def close(self) -> None:
        pass


def run_states(events: DataFrame, success: Sequence[str] = ("run_succeeded",), failure: Sequence[str] = ("run_failed",), max_failures: int = 5, backoff_seconds: int = 3600, timers: bool = False) -> DataFrame:
    """A row for each workspace that a micro-batch touches; with ``timers`` also one when its backoff has ended.

    Timers go by the clock, so they are for a stream that keeps running: one that
    ends when all is read would wait for them.

    ``events`` streams event_id, run_id, workspace_id, event_type and ts (timestamp).
    """
    for name, value in STATE_STORE.items():
        events.sparkSession.conf.set(name, value)
    processor = RunStates(success, failure, max_failures, backoff_seconds, timers)
    return events.groupBy("workspace_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=StructType.fromDDL(OUTPUT), outputMode="Update", timeMode="ProcessingTime" if timers else "None")
