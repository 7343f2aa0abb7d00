"""Admission control over a stream of attempts: budgets and circuit breakers as keyed state.

The batch forms (queries ``x01_budget`` and ``x03_circuit_breaker``) are windows over finished tables.  Here the same
rules hold per key while events arrive; state is a few numbers a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISIONS = "user_id bigint, event_id bigint, admitted boolean, reason string"
_STATE = "sent int, history string, blocked boolean"


def decide(failed: bool, sent: int, history: str, blocked: bool, budget: int) -> tuple[bool, str, int, str, bool]:
    """(admitted, reason, sent, history, blocked) after one attempt; ``history`` holds the last ten outcomes, 1 for a failure."""
    if blocked:
        return False, "circuit_open", sent, history, True
    if sent >= budget:
        return False, "budget", sent, history, False
    history = (history + ("1" if failed else "0"))[-10:]
    opens = history.endswith("111") or (len(history) == 10 and history.count("1") >= 2)
    return True, "", sent + 1, history, opens


def admit(events: DataFrame, budget: int = 50) -> DataFrame:
    """Decision on every event of a stream with user_id, event_id and event_type, in order of event_id within a batch."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent, history, blocked = state.get if state.exists else (0, "", False)
        for frame in frames:
            rows = []
            for event_id, kind in sorted(zip(frame["event_id"], frame["event_type"])):
                admitted, reason, sent, history, blocked = decide(kind == "error", sent, history, blocked, budget)
                rows.append((key[0], event_id, admitted, reason))
            yield pd.DataFrame(rows, columns=["user_id", "event_id", "admitted", "reason"])
        state.update((sent, history, blocked))

    keyed = events.select("user_id", "event_id", "event_type").groupBy("user_id")
    return keyed.applyInPandasWithState(update, DECISIONS, _STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_failures(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Failures per event type and window of event time; events later than ``late`` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"))
