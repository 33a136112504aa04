"""Registered queries of streams and sketches, each with its DuckDB twin beside it. Streams read the driver's tables as they would land, in micro-batches, and write to the shared folder."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..operators import sketches
from ..sources import formats, services
from ..streaming import policy, streams
from .frames import be, raw
from .tables import DAY, HOUR, P, packets, read, two_way

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one (``spark.checkpoint.dir``); a session on one machine that has none set gets a temporary one, any other is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidewire-")
    return f"{at.rstrip('/')}/tidewire-{name}-{uuid.uuid4().hex}"


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of packets. Streams read folders or patterns; this pattern is the one file."""
    e = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/[e]vents.parquet")
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id"), F.col("event_type").alias("kind"), (F.lit(40) + F.round(F.col("value") * 10).cast("long")).alias("len"))


def written(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives of all that is there. Batches write their own folders, so one that is done again overwrites itself."""
    at = scratch(spark, name)
    streams.run(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/state")
    return spark.read.schema(stream.schema).parquet(f"{at}/out/batch=*")


@query(f"""WITH {P}, w AS (SELECT kind, ts_us // {DAY} AS day, count(*) AS n, sum(len)::BIGINT AS total FROM p GROUP BY ALL) SELECT kind, day, n, total FROM w WHERE (day + 1) * {DAY} <= (SELECT max(ts_us) FROM p) - {HOUR}""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days by kind, told once the watermark, an hour behind, has passed them."""
    w = written(spark, streams.windowed(landed(spark, sf_dir), ["kind"], "len", "1 day", delay="1 hour"), "windows")
    return w.select("kind", F.floor(F.unix_micros("start") / DAY).alias("day"), "n", "total")


@query(f"""WITH {P}, q AS (SELECT *, coalesce(ts_us - lag(ts_us) OVER w >= {6 * HOUR}, true)::INT AS new FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, seq)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS nth FROM q)
SELECT user_id, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS packets, sum(len)::BIGINT AS bytes FROM n GROUP BY user_id, nth HAVING max(ts_us) + {6 * HOUR} <= (SELECT max(ts_us) FROM p) - {HOUR}""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = written(spark, streams.sessions(landed(spark, sf_dir), ["user_id"], "6 hours", "1 hour"), "sessions")
    return s.select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "packets", "bytes")


@query(f"""WITH RECURSIVE {P}, o AS (SELECT user_id, seq, ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, seq) AS i FROM p), k AS (
  SELECT user_id, i, seq, true AS kept, ts_us AS last FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, o.seq, o.ts_us - k.last >= {12 * HOUR}, CASE WHEN o.ts_us - k.last >= {12 * HOUR} THEN o.ts_us ELSE k.last END FROM k JOIN o ON o.user_id = k.user_id AND o.i = k.i + 1
) SELECT user_id, seq FROM k WHERE kept""")
def stream_first_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State a user: rows less those within twelve hours of the last one kept."""
    return written(spark, streams.first_in_window(landed(spark, sf_dir), ["user_id"], 12 * HOUR, "1 hour"), "first").select("user_id", "seq")


@query(f"""WITH {P} SELECT seq, CASE seq % 3 WHEN 0 THEN '1/get' WHEN 1 THEN '2c/set' END AS told, CASE seq % 3 WHEN 2 THEN CASE WHEN seq % 2 = 0 THEN 'no payload' ELSE 'no such message' END END AS error FROM p WHERE kind = 'error'""")
def stream_broken_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Management messages of which every third is missing or of no known version: good and bad ones go to tables of their own, read back together."""
    e = landed(spark, sf_dir).filter("kind = 'error'").select("seq", "ts")
    n = F.col("seq") % 3
    known = F.concat(raw("300d0201"), be(n, 1), raw("04067075626c6963"), F.when(n == 0, raw("a000")).otherwise(raw("a300")))
    payload = F.when(n < 2, known).when(F.col("seq") % 2 == 1, raw("30050201090400"))
    c = policy.checked(e.withColumn("payload", payload), "payload", services.snmp_message, "snmp_version string, snmp_op string")
    at = scratch(spark, "broken")
    policy.parted(c, f"{at}/good", f"{at}/bad", f"{at}/state").awaitTermination()
    kept, bad = (spark.read.schema(c.schema).parquet(f"{at}/{x}/batch=*") for x in ("good", "bad"))
    return kept.unionByName(bad).select("seq", F.when(F.col("error").isNull(), F.concat_ws("/", "snmp_version", "snmp_op")).alias("told"), "error")


_GAMMA = 1.02 / 0.98


@query(f"""WITH {P}, c AS (SELECT kind, ts_us // {DAY} AS day, CASE WHEN len = 0 THEN 0 ELSE ceil(ln(len) / {math.log(_GAMMA)!r}) END::BIGINT AS i FROM p), s AS (SELECT kind, day + d AS bucket, i, count(*) AS n FROM c, unnest(range(0, 7)) AS u(d) GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY kind, bucket ORDER BY i) AS upto, sum(n) OVER (PARTITION BY kind, bucket) AS total FROM s)
SELECT kind, bucket, max(total)::BIGINT AS n, round(min(2 * pow({_GAMMA!r}, i) / {_GAMMA + 1!r}) FILTER (WHERE upto > floor(0.5 * (total - 1))), 3) AS q50, round(min(2 * pow({_GAMMA!r}, i) / {_GAMMA + 1!r}) FILTER (WHERE upto > floor(0.95 * (total - 1))), 3) AS q95 FROM r GROUP BY kind, bucket""")
def sliding_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of sizes over sliding weeks, told to within 2 %, by merging days."""
    counts = sketches.log_counts(packets(spark, sf_dir), ["kind"], "len", DAY, 0.02)
    q = sketches.quantiles(counts, ["kind"], [0.5, 0.95], 0.02, 7)
    return q.select("kind", "bucket", "n", F.round("q50", 3).alias("q50"), F.round("q95", 3).alias("q95"))


@query(f"""WITH {P}, c AS (SELECT ts_us // {DAY} + d AS bucket, src_ip4::VARCHAR AS item, count(*) AS n FROM p, unnest(range(0, 3)) AS u(d) GROUP BY ALL), t AS (SELECT *, rank() OVER (PARTITION BY bucket ORDER BY n DESC) AS r, count(*) OVER (PARTITION BY bucket, n) AS ties FROM c)
SELECT bucket, count(*) AS n_items, sum(n)::BIGINT AS total, max(n) AS most FROM c GROUP BY bucket""")
def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All senders of sliding three days by merging counts a day, summed up a window."""
    p = packets(spark, sf_dir).withColumn("item", F.col("src_ip4").cast("string"))
    top = sketches.heaviest(sketches.item_counts(p, [], "item", DAY), [], None, 3)
    return top.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n").alias("total"), F.max("n").alias("most"))


@query(f"""WITH {P}, m AS (SELECT ts_us // {DAY} AS day, kind, count(*) AS n, sum(len)::BIGINT AS total FROM p GROUP BY ALL)
SELECT day * {DAY} * 1000 AS time_ns, kind, '{{"name":"packets","sum":{{"dataPoints":[{{"asInt":"' || n || '","timeUnixNano":"' || day * {DAY} * 1000 || '","attributes":[{{"key":"kind","value":{{"stringValue":"' || kind || '"}}}}]}}],"aggregationTemporality":1,"isMonotonic":true}}}}' AS metric FROM m""")
def metric_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts a day as metrics of the open telemetry protocol."""
    c = packets(spark, sf_dir).groupBy(F.floor(F.col("ts_us") / DAY).alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("time_ns", F.col("day") * (DAY * 1000))
    return c.select("time_ns", "kind", formats.telemetry_sum("packets", F.col("n"), F.col("time_ns"), {"kind": F.col("kind")}).alias("metric"))


@query(f"""WITH {P}, h AS (SELECT seq, proto, src_ip4, dst_ip4, src_port, dst_port FROM p), b AS (
  SELECT seq, list_concat(list_concat(list_concat(list_transform(range(0, 32), lambda i: (src_ip4 >> (31 - i)) & 1), list_transform(range(0, 32), lambda i: (dst_ip4 >> (31 - i)) & 1)), list_transform(range(0, 16), lambda i: (src_port >> (15 - i)) & 1)), list_transform(range(0, 16), lambda i: (dst_port >> (15 - i)) & 1)) AS bits FROM h)
SELECT seq, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 97), lambda i: bits[i] * CASE (i - 1) % 16 {" ".join(f"WHEN {k} THEN {((0x6D5A6D5A6D5A << k) >> 16) & 0xFFFFFFFF}" for k in range(16))} END)), lambda a, x: xor(a, x)) AS hash FROM b""")
def symmetric_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash that both ways of a flow share, told of every third packet the other way round."""
    ends = [F.col(c) for c in ("src_ip4", "dst_ip4", "src_port", "dst_port")]
    return two_way(packets(spark, sf_dir)).select("seq", net.rss_hash(*ends, net.SYMMETRIC_KEY).alias("hash"))


def queries() -> dict:
    return dict(QUERIES)
