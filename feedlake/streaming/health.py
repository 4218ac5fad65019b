"""Health of sources on a stream of fetch runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from feedlake import config as C
from feedlake.sinks.tables import read_runs, write_run

_STATE = (
    "ok_ts long, ok_run long, settled long, settled_to long, fail_ts long, fail_run long, error string, "
    "open_ts array<long>, open_run array<long>, late long, seen long"
)
_HEALTH = (
    "source_id long, last_fetched_at timestamp, error_count long, last_error string, "
    "late_successes long, silent boolean"
)
_NEVER = -(1 << 62)
_EMPTY = (_NEVER, _NEVER, 0, _NEVER, _NEVER, _NEVER, None, [], [], 0, _NEVER)


def _fold(kept: tuple, runs: pd.DataFrame) -> tuple:
    """A source's state after more runs, in whatever order they come."""
    ok_ts, ok_run, settled, settled_to, fail_ts, fail_run, error, open_ts, open_run, late, seen = kept
    ts, run, ok = runs["micros"].to_numpy(), runs["run_id"].to_numpy(), runs["ok"].to_numpy(bool)
    seen = max(seen, int(ts.max()))

    good = np.flatnonzero(ok)
    if len(good):
        # The settled failures have lost their times: a success among them has no place.
        unplaced = (ts[good] <= settled_to) & ((ts[good] > ok_ts) | ((ts[good] == ok_ts) & (run[good] > ok_run)))
        unplaced &= settled > 0
        late += int(unplaced.sum())
        good = good[~unplaced]
    if len(good):
        last = good[np.lexsort((run[good], ts[good]))[-1]]
        if (ts[last], run[last]) > (ok_ts, ok_run):
            ok_ts, ok_run = int(ts[last]), int(run[last])
            if ok_ts > settled_to:
                settled = 0

    bad = np.flatnonzero(~ok)
    times = np.concatenate([np.array(open_ts, np.int64), ts[bad]])
    ids = np.concatenate([np.array(open_run, np.int64), run[bad]])
    after = (times > ok_ts) | ((times == ok_ts) & (ids > ok_run))
    times, ids = times[after], ids[after]
    if len(bad):
        last = bad[np.lexsort((run[bad], ts[bad]))[-1]]
        if (ts[last], run[last]) > (fail_ts, fail_run):
            fail_ts, fail_run = int(ts[last]), int(run[last])
            text = runs["error"].iloc[last]
            error = None if pd.isna(text) else str(text)[: C.ERROR_MAX_LEN]
    return (ok_ts, ok_run, settled, settled_to, fail_ts, fail_run, error, times.tolist(), ids.tolist(), late, seen)


def _settle(kept: tuple, watermark: int) -> tuple:
    """Failures behind the watermark become a number: nothing comes between them any more."""
    ok_ts, ok_run, settled, settled_to, fail_ts, fail_run, error, open_ts, open_run, late, seen = kept
    watermark = max(watermark, settled_to)
    times, ids = np.array(open_ts, np.int64), np.array(open_run, np.int64)
    still = times > watermark
    settled += int((~still).sum())
    return (ok_ts, ok_run, settled, watermark, fail_ts, fail_run, error, times[still].tolist(), ids[still].tolist(), late, seen)


def stream_health(runs: DataFrame, delay: str = "1 hour", silence: str = "1 day") -> DataFrame:
    """Health per source, updated with every micro-batch; write it in update mode.

    ``runs``: a stream with source_id, run_id, ts, ok, error. Runs that arrive in any
    order within ``delay`` give what :func:`feedlake.operators.catalog.source_health` gives
    for the whole log. A source's state is its last success, the number of failures since,
    and the times of those that are newer than the watermark, so it stays small however
    long a source fails. A success that comes too late to be placed among failures already
    summed up is counted in ``late_successes`` and changes nothing else. A source without
    runs for ``silence`` of event time is reported once as ``silent``. Runs without a
    source, an id, a time or an outcome are left out.
    """
    wait = int(pd.Timedelta(silence).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else _EMPTY
        for batch in batches:
            if len(batch):
                kept = _fold(kept, batch)
        watermark = state.getCurrentWatermarkMs()
        kept = _settle(kept, watermark * 1000 if watermark > 0 else _NEVER)
        silent = state.hasTimedOut
        state.update(kept)
        if not silent:
            state.setTimeoutTimestamp(max(kept[10] // 1000 + wait, watermark + 1))
        ok_ts, failures = kept[0], kept[2] + len(kept[7])
        yield pd.DataFrame(
            {
                "source_id": [key[0]],
                "last_fetched_at": [pd.NaT if ok_ts == _NEVER else pd.Timestamp(ok_ts, unit="us")],
                "error_count": [failures],
                "last_error": [kept[6] if failures else None],
                "late_successes": [kept[9]],
                "silent": [silent],
            }
        )

    placed = runs.where("source_id is not null and run_id is not null and ts is not null and ok is not null")
    placed = placed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(
        F.col("source_id").cast("long").alias("source_id"),
        F.col("run_id").cast("long").alias("run_id"),
        "ts",
        F.unix_micros("ts").alias("micros"),
        "ok",
        "error",
    )
    return placed.groupBy("source_id").applyInPandasWithState(
        step, _HEALTH, _STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def follow_health(
    runs: DataFrame, table: str, checkpoint: str, delay: str = "1 hour", silence: str = "1 day", every: str | None = None
) -> StreamingQuery:
    """Keep the health of all sources below ``table``: a run folder per micro-batch, with
    the sources it changed; a batch replayed after a failure replaces its own. ``every``
    polls; by default the query drains what is there and stops."""

    def store(batch: DataFrame, batch_id: int) -> None:
        write_run(batch, table, f"{batch_id:012d}")

    writer = stream_health(runs, delay, silence).writeStream.outputMode("update").foreachBatch(store)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current_health(spark: SparkSession, table: str) -> DataFrame:
    """The last line of every source in a table that :func:`follow_health` keeps."""
    lines = read_runs(spark, table, T.StructType.fromDDL(_HEALTH))
    last = lines.groupBy("source_id").agg(F.max("run").alias("run"))
    return lines.join(last, ["source_id", "run"]).drop("run")
