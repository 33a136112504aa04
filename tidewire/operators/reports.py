"""Rolling and periodic reports. Rows are always summed by key and bucket before anything is put in order, so a hot key is combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net


def bucket(ts_us: str, width_us: int) -> Column:
    return F.floor(F.col(ts_us) / width_us).cast("long")


def rolling(rows: DataFrame, keys: list[str], value: str | None, window_us: int, bucket_us: int, ts_us: str = "ts_us") -> DataFrame:
    """Per key and bucket with rows: ``total`` over the last window_us / bucket_us buckets, and ``rate`` a second. value None counts rows."""
    n = window_us // bucket_us
    what = F.count(F.lit(1)) if value is None else F.sum(value)
    sums = rows.groupBy(*keys, bucket(ts_us, bucket_us).alias("bucket")).agg(what.alias("own"))
    w = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(-(n - 1), 0)
    return sums.withColumn("total", F.sum("own").over(w)).withColumn("rate", F.col("total") / F.lit(window_us / 1e6)).drop("own")


def rolling_distinct(rows: DataFrame, keys: list[str], value: str, window_us: int, bucket_us: int, ts_us: str = "ts_us") -> DataFrame:
    """Per key and bucket with rows: ``n_distinct`` values over the window; null is no value. A value seen in a bucket counts in that one and the n - 1 after it.

    Stretches in which a value counts without a break begin with a step up and end with a step down; the running sum of a key's steps is the number of
    values that count. A row makes two steps at most, however many buckets the window has.
    """
    n = window_us // bucket_us
    seen = rows.select(*keys, F.col(value).alias("v_"), bucket(ts_us, bucket_us).alias("bucket")).dropna(subset=[*keys, "bucket"]).distinct()
    w = Window.partitionBy(*keys, "v_").orderBy("bucket")
    breaks = lambda gap: F.col("v_").isNotNull() & F.coalesce(gap >= n, F.lit(True))
    step = lambda at, size, own: F.struct(at.alias("bucket"), size.cast("long").alias("step_"), F.lit(own).alias("own_"))
    begins, ends = breaks(F.col("bucket") - F.lag("bucket").over(w)), breaks(F.lead("bucket").over(w) - F.col("bucket"))
    seen = seen.select(*keys, "bucket", begins.alias("begins_"), ends.alias("ends_"))
    both = F.array(step(F.col("bucket"), F.col("begins_").cast("int"), True), F.when(F.col("ends_"), step(F.col("bucket") + n, F.lit(-1), False)))
    steps = seen.select(*keys, F.inline(F.array_compact(both))).groupBy(*keys, "bucket").agg(F.sum("step_").alias("step_"), F.max("own_").alias("own_"))
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*keys, "bucket", F.sum("step_").over(upto).alias("n_distinct"), "own_").filter("own_").drop("own_")


def top(rows: DataFrame, within: list[str], score: str, n: int, ties: list[str]) -> DataFrame:
    """The n rows of largest score a group, ``rank`` from 1; ties go by the columns named."""
    w = Window.partitionBy(*within).orderBy(F.desc(score), *ties)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def talkers(packets: DataFrame, period_us: int, n: int, key: str = "src_ip4") -> DataFrame:
    """Top senders by bytes of each period."""
    sums = packets.groupBy(bucket("ts_us", period_us).alias("period"), key).agg(F.sum("len").alias("bytes"), F.count(F.lit(1)).alias("packets"))
    return top(sums, ["period"], "bytes", n, [key])


def matrix(packets: DataFrame) -> DataFrame:
    """Bytes and packets of each pair of hosts, whoever sends: IPv4 addresses as numbers; where there are IPv6 ends all as text."""
    ends = ["src_ip4", "dst_ip4"]
    if "src_ip6" in packets.columns:
        packets = packets.withColumns({f"{x}_host_": net.ip_text(F.col(f"{x}_ip4"), F.col(f"{x}_ip6")) for x in ("src", "dst")})
        ends = ["src_host_", "dst_host_"]
    return packets.groupBy(F.least(*ends).alias("host_a"), F.greatest(*ends).alias("host_b")).agg(F.sum("len").alias("bytes"), F.count(F.lit(1)).alias("packets"))


def bandwidth_by(packets: DataFrame, label: Column, window_us: int = 10_000_000, bucket_us: int = 1_000_000) -> DataFrame:
    """Rolling rate by label, with its share of what all labels have in the bucket's window."""
    by = rolling(packets.withColumn("label", label), ["label"], "len", window_us, bucket_us)
    share = net.ratio(F.col("total"), F.sum("total").over(Window.partitionBy("bucket")))
    return by.withColumn("share", share)


def owner_bandwidth(packets: DataFrame, owners: DataFrame, on: str, owner: str, period_us: int) -> DataFrame:
    """Bytes by owner and period; rows without an owner are kept apart as null. ``unknown_share`` is theirs of the period.

    owners has one row a key; packets are summed by key first, so the join moves sums.
    """
    sums = packets.groupBy(bucket("ts_us", period_us).alias("period"), on).agg(F.sum("len").alias("bytes"))
    by = sums.join(owners.select(on, owner), on, "left").groupBy("period", owner).agg(F.sum("bytes").alias("bytes"))
    w = Window.partitionBy("period")
    return by.withColumn("unknown_share", net.ratio(F.coalesce(F.sum(F.when(F.col(owner).isNull(), F.col("bytes"))).over(w), F.lit(0)), F.sum("bytes").over(w)))


def red(rows: DataFrame, by: list[str], is_error: Column, duration: str, period_us: int, accuracy: int | None = None) -> DataFrame:
    """Rate, errors and durations by group and period: requests, errors, error_ratio (at most 1), p50, p95, p99.

    Quantiles are exact and linear, which holds each distinct duration of a group; with an ``accuracy`` they come from
    mergeable sketches of bounded size, off by at most 1 / accuracy in rank.
    """
    quantile = (lambda q: F.percentile(duration, q)) if accuracy is None else (lambda q: F.percentile_approx(duration, q, accuracy))
    r = rows.withColumn("error_", F.coalesce(is_error, F.lit(False)).cast("long"))
    out = r.groupBy(*by, bucket("ts_us", period_us).alias("period")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("error_").alias("errors"), *(quantile(q / 100).alias(f"p{q}") for q in (50, 95, 99))
    )
    return out.withColumns({"rate": F.col("requests") / F.lit(period_us / 1e6), "error_ratio": F.least(F.lit(1.0), net.ratio(F.col("errors"), F.col("requests")))})


def red_flows(flows: DataFrame, by: list[str], period_us: int, accuracy: int | None = None) -> DataFrame:
    """Rate, errors and durations of ended flows: those ended by a reset are the errors, their length in seconds the duration."""
    f = flows.withColumns({"ts_us": F.col("end_us"), "seconds": (F.col("end_us") - F.col("start_us")) / F.lit(1e6)})
    return red(f, by, F.col("reason") == "rst", "seconds", period_us, accuracy)


def red_answers(pairs: DataFrame, by: list[str], failed: Column, period_us: int, accuracy: int | None = None) -> DataFrame:
    """The same of requests with their answers (``correlate.paired``): unanswered or failed ones are the errors, rtt_us the duration."""
    return red(pairs.withColumn("seconds", F.col("rtt_us") / F.lit(1e6)), by, F.col("rtt_us").isNull() | failed, "seconds", period_us, accuracy)


def drop_breakdown(telemetry: DataFrame, causes: list[str]) -> DataFrame:
    """Cumulative counters of drops by cause as one row a source and cause: ``dropped`` in all, and its ``share`` of the source's drops."""
    w = Window.partitionBy("source_idx").orderBy("ts_us")
    delta = lambda c: F.when(F.col(c) >= F.lag(c).over(w), F.col(c) - F.lag(c).over(w)).otherwise(F.col(c))
    sums = telemetry.withColumns({c: delta(c) for c in causes}).groupBy("source_idx").agg(*(F.sum(c).alias(c) for c in causes))
    whole = sum((F.coalesce(F.col(c), F.lit(0)) for c in causes), F.lit(0))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("cause"), F.coalesce(F.col(c), F.lit(0)).alias("dropped"), net.ratio(F.col(c), whole).alias("share")) for c in causes)))
    return sums.select("source_idx", each.alias("x")).select("source_idx", "x.*")


def first_seen(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("n"))


def bursts(rows: DataFrame, keys: list[str], threshold: int, window_us: int, bucket_us: int) -> DataFrame:
    """Buckets in which a key's rolling count comes to the threshold, having been below it in the bucket before."""
    r = rolling(rows, keys, None, window_us, bucket_us)
    w = Window.partitionBy(*keys).orderBy("bucket")
    before = F.when(F.lag("bucket").over(w) == F.col("bucket") - 1, F.lag("total").over(w))
    return r.withColumn("before", F.coalesce(before, F.lit(0))).filter((F.col("before") < threshold) & (F.col("total") >= threshold)).select(*keys, "bucket", "total")


def capture_deltas(telemetry: DataFrame) -> DataFrame:
    """Cumulative packets and drops of each source as differences, with the share dropped; a counter that falls back starts anew."""
    w = Window.partitionBy("source_idx").orderBy("ts_us")
    delta = lambda c: F.when(F.col(c) >= F.lag(c).over(w), F.col(c) - F.lag(c).over(w)).otherwise(F.col(c))
    t = telemetry.withColumns({"d_packets": delta("packets"), "d_drops": delta("drops")})
    return t.withColumn("drop_rate", net.ratio(F.col("d_drops"), F.col("d_packets") + F.col("d_drops")))


def flow_features(packets: DataFrame, by: list[str], idle_us: int = 5_000_000) -> DataFrame:
    """Per flow: totals, sizes, seconds between packets, and time spent idle (in gaps over idle_us)."""
    w = Window.partitionBy(*by).orderBy("ts_us", "seq")
    p = packets.withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(w))
    stats = lambda c, name: [f(c).cast("double").alias(f"{name}_{n}") for n, f in (("mean", F.mean), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    out = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("len").alias("bytes"), (F.max("ts_us") - F.min("ts_us")).alias("duration_us"), *stats("len", "len"), *stats(F.col("gap") / F.lit(1e6), "gap"),
        F.coalesce(F.sum(F.when(F.col("gap") > idle_us, F.col("gap"))), F.lit(0)).alias("idle_us"),
    )
    return out.withColumn("bytes_per_s", net.ratio(F.col("bytes"), F.col("duration_us") / 1e6))


def inventory(observations: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """What is known of each key over all sources (key, ts_us, source, and any of the fields, null where not told).

    first_us, last_us, the sources in order, and of each field its latest value, of values at one time the largest.
    A key's rows are summed before the shuffle.
    """
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts_us", c))).alias(c)
    rows = observations.filter(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.array_sort(F.collect_set("source")).alias("sources"), *(latest(c) for c in fields))


def changes(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows at which a key is new or one of its fields, last known value carried on, differs from before: what an inventory announces."""
    w = Window.partitionBy(key).orderBy("ts_us", "seq")
    known = {c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in fields}
    r = rows.withColumns(known)
    same = lambda c: F.col(c).eqNullSafe(F.lag(c).over(w))
    new = F.row_number().over(w) == 1
    differs = ~F.lit(True)
    for c in fields:
        differs = differs | ~same(c)
    return r.withColumn("changed", new | differs).filter("changed").drop("changed")


def rolled_up(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Totals over every subset of the keys; ``level`` tells which are summed away."""
    return packets.cube(*keys).agg(F.grouping_id().alias("level"), F.sum("len").alias("bytes"), F.count(F.lit(1)).alias("packets"))
