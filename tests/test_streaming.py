from pyspark.sql import functions as F

from tidewire.streaming import streams

#: Times are from second 1000 on: at 0, where the first watermark stands, rows would be late.
SCHEMA = "k string, ts timestamp, len long, rate double"


def _land(spark, at, rows, name):
    df = spark.createDataFrame(rows, "k string, s long, len long, rate double").select("k", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "len", "rate")
    df.coalesce(1).write.mode("append").parquet(f"{at}/in")
    return name


def _all(spark, stream, at, name):
    got = []
    streams.run(stream, lambda b, n: got.extend(tuple(r) for r in b.collect()), f"{at}/check-{name}", timeout_s=120)
    return got


def _source(spark, at):
    return streams.files(spark, f"{at}/in", SCHEMA, 1)


def test_streams(spark, tmp_path):
    at = str(tmp_path)
    _land(spark, at, [("a", 0, 1, 0.0), ("a", 5, 2, 0.1), ("b", 6, 4, 0.0)], 0)
    _land(spark, at, [("a", 40, 8, 0.0), ("z", 100000, 1, 0.0)], 1)  # the last row moves the watermark on
    _land(spark, at, [("z", 200000, 1, 0.0), ("y", 300000, 2, 0.0)], 2)  # of both sides of the join
    s = _all(spark, streams.sessions(_source(spark, at), ["k"], "10 seconds").select("k", "packets", "bytes"), at, "sessions")
    assert {x for x in s if x[0] not in "yz"} == {("a", 2, 3), ("b", 1, 4), ("a", 1, 8)}
    w = _all(spark, streams.windowed(_source(spark, at), ["k"], "len", "10 seconds").select("k", "total", "n", "rate"), at, "windows")
    assert {x for x in w if x[0] not in "yz"} == {("a", 3, 2, 0.3), ("b", 4, 1, 0.4), ("a", 8, 1, 0.8)}
    kept = _all(spark, streams.first_in_window(_source(spark, at), ["k"], 40_000_000).select("k", F.col("ts").cast("long") - 1000), at, "first")
    assert sorted(kept) == [("a", 0), ("a", 40), ("b", 6), ("y", 300000), ("z", 100000), ("z", 200000)]
    told = _all(spark, streams.edges(_source(spark, at), ["k"], "rate", 0.05, 0.01, 1).select("k", F.col("ts").cast("long") - 1000, "edge"), at, "edges")
    assert sorted(told) == [("a", 5, "enter"), ("a", 40, "leave")]
    a, b = _source(spark, at).filter("len = 1"), _source(spark, at).filter("len = 2")
    alone = _all(spark, streams.not_followed(a, b, ["k"], "8 seconds").select("k", F.col("ts").cast("long") - 1000), at, "anti")
    assert ("a", 0) not in alone and ("z", 100000) in alone
