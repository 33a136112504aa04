"""Which packets a recorder keeps: rotation, retention, and what came before a trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rotated(packets: DataFrame, by: str = "source_idx", most_bytes: int = 128 << 20, period_us: int = 3_600_000_000) -> DataFrame:
    """packets with ``file``: a new one with each period, and within it with each most_bytes of packets.

    Bytes are summed by source, period and second before they are put in order, so files change between seconds.
    """
    second = F.floor(F.col("ts_us") / 1_000_000)
    period = F.floor(F.col("ts_us") / period_us)
    sums = packets.groupBy(by, period.alias("period"), second.alias("second")).agg(F.sum("len").alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy(by, "period").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.select(F.col(by).alias("by_"), F.col("second").alias("second_"), F.concat_ws("-", F.col(by), "period", F.floor(before / most_bytes)).alias("file"))
    return packets.join(parts, (F.col(by) == F.col("by_")) & (second == F.col("second_"))).drop("by_", "second_")


def retained(files: DataFrame, by: str = "source_idx", most_files: int = 16, most_bytes: int | None = None) -> DataFrame:
    """Of files (source, file, end_us, bytes) the newest of each source: so many, and so many bytes; the newest always stays."""
    w = Window.partitionBy(by).orderBy(F.desc("end_us"), F.desc("file"))
    f = files.withColumns({"nth": F.row_number().over(w), "sum": F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    fits = F.col("sum") <= most_bytes if most_bytes is not None else F.lit(True)
    return f.filter((F.col("nth") == 1) | ((F.col("nth") <= most_files) & fits)).drop("nth", "sum")


def around_trigger(packets: DataFrame, triggers: DataFrame, by: str = "source_idx", most_bytes: int = 8 << 20) -> DataFrame:
    """All packets from a source's first trigger on, and before it the last ones that fit in most_bytes, one at least.

    Only packets within reach are put in order: bytes are first summed by second, from the trigger backwards.
    """
    first = triggers.groupBy(by).agg(F.min("ts_us").alias("trigger_us"))
    p = packets.join(first, by)
    after, early = p.filter("ts_us >= trigger_us"), p.filter("ts_us < trigger_us")
    second = F.floor(F.col("ts_us") / 1_000_000)
    sums = early.groupBy(by, second.alias("second")).agg(F.sum("len").alias("bytes"))
    later = F.coalesce(F.sum("bytes").over(Window.partitionBy(by).orderBy(F.desc("second")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = sums.withColumn("later", later).filter(F.col("later") <= most_bytes).select(F.col(by).alias("by_"), F.col("second").alias("second_"))
    reach = early.join(near, (F.col(by) == F.col("by_")) & (second == F.col("second_"))).drop("by_", "second_")
    w = Window.partitionBy(by).orderBy(F.desc("ts_us"), F.desc("seq"))
    ring = reach.withColumns({"nth": F.row_number().over(w), "sum": F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return after.unionByName(ring.filter((F.col("nth") == 1) | (F.col("sum") <= most_bytes)).drop("nth", "sum")).drop("trigger_us")
