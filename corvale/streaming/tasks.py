"""Task state from a stream of progress events, and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TERMINAL = ("completed", "failed", "cancelled")
STATUSES = ("running", *TERMINAL)


def progress(current: Column, total: Column) -> Column:
    """Percent done, at most 100; without a total the current number counts as percent."""
    return F.least(F.lit(100.0), F.when(total > 0, current / total * 100).otherwise(current.cast("double")))


def latest_state(events: DataFrame) -> DataFrame:
    """Per task its latest status and numbers; after a terminal status a task changes no more."""
    done = events.where(F.col("status").isin(*TERMINAL)).groupBy("task_id").agg(F.min("ts").alias("end"))
    live = events.join(done, "task_id", "left").where(F.col("end").isNull() | (F.col("ts") <= F.col("end")))
    best = live.groupBy("task_id").agg(F.max_by(F.struct("status", "current_item", "total_items"), F.struct("ts", F.col("status").isin(*TERMINAL).cast("int"), "current_item")).alias("s"), F.max("ts").alias("updated_at"))
    return best.select("task_id", "s.*", "updated_at", progress(F.col("s.current_item"), F.col("s.total_items")).alias("percent"))


def active(states: DataFrame) -> DataFrame:
    return states.where(F.col("status") == "running")


def active_counts(states: DataFrame) -> DataFrame:
    """One row: running tasks and all."""
    return states.agg(F.count_if(F.col("status") == "running").alias("running"), F.count(F.lit(1)).alias("total"))


def evicted(states: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """States without the terminal ones that are older than ``hours`` or have no time."""
    if not 1 <= hours <= 168:
        raise ValueError("hours must lie between 1 and 168")
    old = F.col("updated_at").isNull() | (F.col("updated_at") < now - F.make_interval(hours=F.lit(hours)))
    return states.where(~(F.col("status").isin(*TERMINAL) & old))


def cancel(states: DataFrame, task_id: str) -> DataFrame:
    return states.withColumn("status", F.when((F.col("task_id") == task_id) & (F.col("status") == "running"), "cancelled").otherwise(F.col("status")))


def task_states(events: DataFrame, hours: int = 24, late: str = "10 minutes") -> DataFrame:
    """A streaming DataFrame of state changes: (task_id, status, current_item, total_items, percent).

    The state of a task is kept by its key, and removed when the watermark (``late`` behind the events) is ``hours`` past its last event.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, current, total = state.get if state.exists else ("running", 0, 0)
        rows = pd.concat(list(frames))
        changed = status not in TERMINAL
        if changed:  # as in latest_state: the last event up to the first terminal one, terminal ones and higher numbers last in a tie
            ended = rows["status"].isin(TERMINAL)
            rows = rows.assign(ended=ended)
            upto = rows[rows["ts"] <= rows.loc[ended, "ts"].min()] if ended.any() else rows
            best = upto.sort_values(["ts", "ended", "current_item"]).iloc[-1]
            status, current, total = best["status"], int(best["current_item"]), int(best["total_items"])
        state.update((status, current, total))
        until = int(rows["ts"].max().timestamp() * 1000) + hours * 3_600_000
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if changed:
            percent = min(100.0, current / total * 100 if total > 0 else float(current))
            yield pd.DataFrame([(key[0], status, current, total, percent)], columns=["task_id", "status", "current_item", "total_items", "percent"])

    return events.withWatermark("ts", late).groupBy("task_id").applyInPandasWithState(
        step, "task_id string, status string, current_item long, total_items long, percent double", "status string, current_item long, total_items long", "update", "EventTimeTimeout"
    )


def ingest_stream(stream: DataFrame, ingest: Callable[[DataFrame], None], checkpoint: str, on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Run ``ingest`` on each micro-batch (it drops what is stored by anti-joins, so a batch may come twice).

    Errors of the progress callback are ignored, those of the ingest are not.
    """

    def each(batch: DataFrame, number: int) -> None:
        ingest(batch)
        if on_batch:
            try:
                on_batch(number)
            except Exception:  # noqa: BLE001 - a progress callback must not stop the ingest
                pass

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type and tumbling window, with a watermark for late rows."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return own.select(F.col("window.start").alias("start"), "event_type", "n", "total")
