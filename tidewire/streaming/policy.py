"""What becomes of broken messages, and how a stream fares: rows that do not parse go to a table of their own with the reason; a listener tells ready, live, counters and lag."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

KINDS = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
REASON = 200


def checked(rows: DataFrame, payload: str, read: Callable[[bytes], dict | None], schema: str) -> DataFrame:
    """rows with the fields that ``read`` tells of their payload and ``error``: null where it did; else why not, the first ``REASON`` characters of it. A null payload is an error; so is one of which it tells nothing."""
    fields = T._parse_datatype_string(schema).fields
    at = rows.columns.index(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, errors = [], []
            for data in batch.column(at).to_pylist():
                got, error = {}, None
                try:
                    got = read(data) if data is not None else None
                    if got is None:
                        got, error = {}, "no payload" if data is None else "no such message"
                except Exception as e:  # noqa: BLE001  whatever a reader raises is the reason
                    error = f"{type(e).__name__}: {e}"[:REASON]
                told.append(got)
                errors.append(error)
            more = [pa.array([t.get(f.name) for t in told], KINDS[f.dataType.simpleString()]) for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array(errors, pa.string())], [*batch.schema.names, *(f.name for f in fields), "error"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields, T.StructField("error", T.StringType())]))


def parted(stream: DataFrame, good: str, bad: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that writes rows of ``checked`` without an error to one folder and the others to another, as Parquet by batch.

    A batch that is done again after a failure overwrites its own folders, so nothing is written twice.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            batch.filter("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{good}/batch={n}")
            batch.filter("error IS NOT NULL").write.mode("overwrite").parquet(f"{bad}/batch={n}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Health(StreamingQueryListener):
    """States of a session's streams by their names (or ids): ready after the first batch, live until ended, failed with its error, rows and batches so far, and lag in seconds behind the newest event."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.lock, self.clock = threading.Lock(), clock
        self.streams: dict[str, dict] = {}
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        with self.lock:
            name = event.name or str(event.id)
            self.names[str(event.id)] = name
            # counters of a stream that is started again go on
            before = self.streams.get(name, {"rows": 0, "batches": 0, "lag_s": None, "watermark": None})
            self.streams[name] = before | {"ready": False, "live": True, "error": None, "at": self.clock()}

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        with self.lock:
            s = self.streams.get(self.names.get(str(p.id), ""))
            if s is None:
                return
            s["ready"], s["at"] = True, self.clock()
            s["rows"] += p.numInputRows
            s["batches"] += 1
            times = dict(p.eventTime or {})
            if times.get("max"):
                s["lag_s"] = self.clock() - datetime.fromisoformat(times["max"].replace("Z", "+00:00")).timestamp()
            s["watermark"] = times.get("watermark", s["watermark"])

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        with self.lock:
            s = self.streams.get(self.names.get(str(event.id), ""))
            if s is not None:
                s["ready"], s["at"] = True, self.clock()

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        with self.lock:
            s = self.streams.get(self.names.get(str(event.id), ""))
            if s is not None:
                s["live"], s["error"] = False, event.exception

    def told(self, stale_s: float | None = None) -> dict[str, dict]:
        """The states; with ``stale_s`` a stream that has told nothing for so long is not live."""
        with self.lock:
            out = {n: dict(s) for n, s in self.streams.items()}
        for s in out.values():
            if stale_s is not None and self.clock() - s["at"] > stale_s:
                s["live"] = False
        return out

    def healthy(self, stale_s: float | None = None) -> bool:
        return all(s["ready"] and s["error"] is None and (s["live"] or stale_s is None) for s in self.told(stale_s).values())


def watch(spark: SparkSession) -> Health:
    """A listener that is registered with the session."""
    health = Health()
    spark.streams.addListener(health)
    return health


def lag(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: the newest event's time and how far it is behind now, in seconds."""
    return rows.agg(F.max(ts).alias("newest")).withColumn("lag_s", (F.unix_micros(F.current_timestamp()) - F.unix_micros("newest")) / 1e6)
