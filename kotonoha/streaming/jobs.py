"""The job account over a stream of events, by keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kotonoha.plans.jobs import job_stats

#: What an event adds to the account; the columns of job_stats().
COUNTS = ("files_converted", "files_skipped", "errors", "files_with_remaining_notes", "remaining_notes", "cancelled_files", "artifact_files", "saved_files")
_DELTA = ", ".join(f"{c} bigint" for c in COUNTS)


def distinct_events(events: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events without replays of (type, file, attempt) that come within the delay; the state is bounded by the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["type", "file_id", "attempt_id"])


def event_counts(events: DataFrame, time: str = "ts", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events of each type in each window of time, replays left out."""
    return distinct_events(events, time, delay).groupBy(F.window(time, window), "type").count()


def account_changes(events: DataFrame, keep: str | None = "30 days") -> DataFrame:
    """(file_id, counts): what each file's new events add to the account, of a stream of (ord, type, file_id, attempt_id, delivery, remaining).

    A file's state are the kinds of events that have counted once, and the attempts that have failed. The first commit of a file counts,
    whether others come later or again, also beyond any watermark. keep bounds the state: it goes when a file has not been heard of for so long
    (None: never). Such a query runs on to let states go, so it takes a trigger of its own pace, not availableNow; late events are not
dropped, as the time is that of the clock. A state is handed over once a batch, not once an event."""
    ms = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(json.loads(state.get[0])) if state.exists else set()
        total = dict.fromkeys(COUNTS, 0)
        for e in pd.concat(frames).sort_values("ord").itertuples():
            once = e.type in ("WriteCommitted", "Skipped", "Cancelled")  # these count once a file, failures once an attempt
            mark = e.type if once else f"{e.type} {e.attempt_id}"
            if e.type is None or mark in seen:
                continue
            seen.add(mark)
            total["files_skipped"] += e.type == "Skipped"
            total["cancelled_files"] += e.type == "Cancelled"
            total["errors"] += e.type in ("WriteFailed", "ArchiveFailed")
            if e.type == "WriteCommitted":
                left = 0 if pd.isna(e.remaining) else int(e.remaining)
                total["files_converted"] += 1
                total["files_with_remaining_notes"] += left > 0
                total["remaining_notes"] += left
                total["artifact_files" if e.delivery == "browser-artifact" else "saved_files"] += 1
        state.update((json.dumps(sorted(seen)),))
        if ms:
            state.setTimeoutDuration(ms)
        if any(total.values()):
            yield pd.DataFrame([{"file_id": key[0], **total}])

    thin = events.select("ord", "type", "file_id", "attempt_id", "delivery", "remaining")
    out = f"file_id {events.schema['file_id'].dataType.simpleString()}, {_DELTA}"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ms else GroupStateTimeout.NoTimeout
    return thin.groupBy("file_id").applyInPandasWithState(fold, out, "seen string", "append", timeout)


def fold_into(events: DataFrame, path: str, checkpoint: str, keep: str | None = "30 days"):
    """A query that appends what events add to the account to a table, of which account() gives the sum at any time."""
    return account_changes(events, keep).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def account(spark, path: str) -> DataFrame:
    """The account so far, in one row."""
    return spark.read.parquet(path).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS))


__all__ = ["account", "account_changes", "distinct_events", "event_counts", "fold_into", "job_stats"]
