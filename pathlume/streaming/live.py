"""Streams of activity: windowed counts with late data, running funnels, sessions kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathlume.functions.normalize import col
from pathlume.operators.sessions import SessionTable, local_sessions

FUNNEL_OUTPUT = "group_id string, step int, reached_at bigint"
FUNNEL_STATE = "step int, reached_at bigint"


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per time window and ``by``. Rows later than ``late`` behind the latest time seen are dropped; a window comes out once it can no
    longer change."""
    return events.withWatermark(time, late).groupBy(F.window(col(time), width), *(col(b) for b in by)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *(col(b) for b in by), "n")


def running_funnel(events: DataFrame, group: Column, time_ms: Column, steps: list[Column], forget_after_ms: int | None = None) -> DataFrame:
    """A row (``group_id, step, reached_at``) whenever a group reaches a further step, strictly later than the step before.

    State is two numbers a group; with ``forget_after_ms`` that of a group without rows for so long (by the clock) is dropped and the group
    starts anew, without it state stays. Rows of a group must come in order of time from batch to batch; within a batch they may come in any.
    Rows without group or time are passed over; equal times count as one instant.
    """
    marks = [s.alias(f"s{i}") for i, s in enumerate(steps)]
    rows = events.select(group.cast("string").alias("group_id"), time_ms.cast("bigint").alias("t"), *marks).filter(F.col("group_id").isNotNull() & F.col("t").isNotNull())
    rows = rows.filter(" or ".join(f"s{i}" for i in range(len(steps))))
    n = len(steps)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        step, at = state.get if state.exists else (0, -(2**62))
        reached = []
        rows = pd.concat(list(batches)).sort_values("t")
        for t, *marked in rows[["t", *(f"s{i}" for i in range(n))]].itertuples(index=False):
            if step < n and t > at and marked[step]:
                reached.append((key[0], step, int(t)))
                step, at = step + 1, int(t)
        state.update((step, at))
        if forget_after_ms:
            state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame(reached, columns=["group_id", "step", "reached_at"])

    return rows.groupBy("group_id").applyInPandasWithState(advance, FUNNEL_OUTPUT, FUNNEL_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if forget_after_ms else GroupStateTimeout.NoTimeout)


def session_sink(table: SessionTable, dataset_name: str, group: Column, time_ms: Column, stream: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: takes every batch into a session table, once even where it is sent again after a failure.

    ``stream`` names the query (by default the dataset); a query that starts anew with an empty checkpoint needs another name, as its batches
    count from 0 again.
    """

    def take(batch: DataFrame, number: int) -> None:
        table.apply(local_sessions(batch, dataset_name, group, time_ms, table.pause_ms), stream or dataset_name, number)

    return take
