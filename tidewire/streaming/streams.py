"""Streaming forms: for what batch does by running frames and lookups, which Structured Streaming does not allow.

Filters, projections, decoding, dimension joins and formats are the same functions as in batch.
All take a stream with an event time ``ts`` (timestamp) and put a watermark on it; rows later than
its delay are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELAY = "10 seconds"


def files(spark: SparkSession, path: str, schema: str, per_batch: int = 64) -> DataFrame:
    """Parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def windowed(rows: DataFrame, keys: list[str], value: str, window: str, slide: str | None = None, delay: str = DELAY) -> DataFrame:
    """Sum, count and rate by key over tumbling or sliding windows."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    sums = rows.withWatermark("ts", delay).groupBy(w.alias("w"), *keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    seconds = F.unix_micros("w.end") - F.unix_micros("w.start")
    return sums.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "n", (F.col("total") * 1e6 / seconds).alias("rate"))


def sessions(packets: DataFrame, keys: list[str], idle: str | Column, delay: str = DELAY) -> DataFrame:
    """Flows ended by idle time, once the watermark has passed it; idle may be a column, so that it differs by protocol."""
    s = packets.withWatermark("ts", delay).groupBy(F.session_window("ts", idle).alias("s"), *keys)
    return s.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("packets"), F.sum("len").alias("bytes")).drop("s")


def not_followed(a: DataFrame, b: DataFrame, keys: list[str], ttl: str, delay: str = DELAY) -> DataFrame:
    """Rows of a without a row of b of their key later by at most the time to live; told when the watermark is past it."""
    left, right = a.withWatermark("ts", delay).alias("l"), b.select(*(F.col(k).alias(f"{k}_b") for k in keys), F.col("ts").alias("ts_b")).withWatermark("ts_b", delay)
    on = (F.col("ts_b") > F.col("l.ts")) & (F.col("ts_b") <= F.col("l.ts") + F.expr(f"INTERVAL {ttl}"))
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"{k}_b"))
    return left.join(right, on, "left_outer").filter("ts_b IS NULL").select("l.*")


def _stateful(rows: DataFrame, keys: list[str], out: str, state: str, step: Callable, forget_ms: int, delay: str) -> DataFrame:
    """step(state or None, sorted frame) gives (state, frame). A key's state goes once the watermark is forget_ms past its last row."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable", ignore_index=True)
        new, got = step(held.get if held.exists else None, rows)
        held.update(new)
        held.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + forget_ms + 1)
        if len(got):
            yield got.reset_index(drop=True)

    return rows.withWatermark("ts", delay).groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def first_in_window(rows: DataFrame, keys: list[str], window_us: int, delay: str = DELAY) -> DataFrame:
    """Rows less those within the window since the last one that was kept, across micro-batches.

    A key's rows of one micro-batch are held together: bound them by the files a trigger takes.
    """

    def step(state, frame: pd.DataFrame):
        last, kept = state[0] if state else None, []
        for t in (frame["ts"].astype("int64") // (1000 if frame["ts"].dtype.str.endswith("[ns]") else 1)).tolist():
            fine = last is None or t - last >= window_us
            kept.append(fine)
            last = t if fine else last
        return (last,), frame[kept]

    return _stateful(rows, keys, rows.schema.simpleString().removeprefix("struct<").removesuffix(">"), "last long", step, window_us // 1000, delay)


def edges(rows: DataFrame, keys: list[str], value: str, enter: float, leave: float, calm: int, forget_ms: int = 3_600_000, delay: str = DELAY) -> DataFrame:
    """"enter" and "leave" rows of hysteresis on a value, across micro-batches."""

    def step(state, frame: pd.DataFrame):
        active, quiet = state or (False, 0)
        told = []
        for x in frame[value].tolist():
            edge = None
            if not active:
                active, quiet, edge = (True, 0, "enter") if x >= enter else (False, 0, None)
            else:
                quiet = quiet + 1 if x < leave else 0
                if quiet >= calm:
                    active, quiet, edge = False, 0, "leave"
            told.append(edge)
        out = frame[[*keys, "ts"]].assign(edge=told)
        return (active, quiet), out[out["edge"].notna()]

    types = dict(rows.dtypes)
    return _stateful(rows, keys, ", ".join(f"{c} {types[c]}" for c in [*keys, "ts"]) + ", edge string", "active boolean, quiet int", step, forget_ms, delay)


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", timeout_s: int | None = None) -> None:
    """Process all that is there in micro-batches, then stop; write gets each batch and its number."""
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(timeout_s)


def with_indicators(stream: DataFrame, load: Callable[[], DataFrame], match: Callable[[DataFrame, DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Matches of each micro-batch with the indicators as they are then: load() reads them afresh, so a swap takes effect at the next batch."""
    run(stream, lambda batch, n: write(match(batch, load()), n), checkpoint)
