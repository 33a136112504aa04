"""Registered queries over the driver's tables. Their DuckDB twins are in oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import net
from ..operators import correlate, detect, filters, flows, folds, layers, reports
from ..sources import formats
from . import frames, live, more, wire
from .oracle import SQL
from .tables import DAY, HOUR, owners, packets, read, two_way, web

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = two_way(packets(spark, sf_dir))
    return p, flows.flows(p, F.lit(6 * HOUR))


@query
def top_talkers_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.talkers(filters.select(packets(spark, sf_dir), filters.port(443) | filters.port(53)), HOUR, 3)


@query
def cidr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = filters.all_of(filters.network("192.168.1.16/28", "dst"), ~filters.udp, filters.more_than("len", 500))
    return filters.select(packets(spark, sf_dir), keep).select("seq", "src_ip4", "dst_ip4", "len")


@query
def session_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = (filters.matches("http_host", "*.example.net") | filters.matches("http_host", "www.*ple.com")) & ~filters.matches("http_path", "/en/*")
    return filters.select(web(spark, sf_dir), keep).select("page_id", "http_host")


@query
def flow_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flows(spark, sf_dir)[1].withColumns({"nth": F.col("nth").cast("long"), "bits_per_s": F.round("bits_per_s", 4), "packets_per_s": F.round("packets_per_s", 6)})


@query
def flow_interim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.interim(two_way(packets(spark, sf_dir)), HOUR, F.lit(6 * HOUR)).drop("reason")


@query
def flow_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.lifecycle(_flows(spark, sf_dir)[1]).groupBy("event", "proto", reports.bucket("ts_us", DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if("zero_payload").alias("n_empty"))


@query
def flow_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.active_at(_flows(spark, sf_dir)[1], 1_705_000_000_000_000, F.lit(6 * HOUR)).select("a_ip4", "b_ip4", "b_port", "start_us", "end_us")


@query
def flow_conn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.conn_log(_flows(spark, sf_dir)[1])


@query
def flow_export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.export_records(_flows(spark, sf_dir)[1])


@query
def flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = reports.flow_features(packets(spark, sf_dir), ["src_ip4", "dst_ip4"], DAY)
    return f.select(*(F.round(c, 3 if c == "bytes_per_s" else 1).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes))


@query
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rolling(packets(spark, sf_dir), ["src_ip4"], "len", 12 * HOUR, HOUR).withColumn("rate", F.round("rate", 6))


@query
def rolling_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rolling_distinct(packets(spark, sf_dir), ["src_ip4"], "dst_ip4", 12 * HOUR, HOUR)


@query
def traffic_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.matrix(two_way(packets(spark, sf_dir)))


@query
def traffic_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rolled_up(packets(spark, sf_dir), ["kind", "proto"])


@query
def top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = web(spark, sf_dir).groupBy(F.lit(0).cast("long").alias("period"), "http_host").agg(F.count(F.lit(1)).alias("n"))
    return reports.top(counts, ["period"], "n", 10, ["http_host"]).drop("period")


@query
def bandwidth_by_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    app = F.when(F.col("dst_port").isin(443, 8443), "tls").when(F.col("dst_port") == 80, "http").when(F.col("dst_port") == 53, "dns").otherwise("other")
    return reports.bandwidth_by(packets(spark, sf_dir), app, 6 * HOUR, HOUR).withColumns({"rate": F.round("rate", 6), "share": F.round("share", 6)})


@query
def owner_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.owner_bandwidth(packets(spark, sf_dir), owners(spark, sf_dir), "user_id", "owner", DAY).withColumn("unknown_share", F.round("unknown_share", 6))


@query
def red_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).withColumn("app", F.col("user_id") % 5)
    r = reports.red(p, ["app"], F.col("kind") == "error", "value", DAY)
    return r.select("app", "period", "requests", "errors", *(F.round(c, 4).alias(c) for c in ("p50", "p95", "p99", "error_ratio")), F.round("rate", 8).alias("rate"))


@query
def ewma_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = folds.ewma(packets(spark, sf_dir), ["src_ip4"], ["ts_us", "seq"], "value", 0.3)
    return e.groupBy("src_ip4").agg(F.round(F.max_by("ewma", F.struct("ts_us", "seq")), 6).alias("ewma"))


@query
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.token_bucket(packets(spark, sf_dir), ["src_ip4"], ["ts_us", "seq"], "ts_us", 1 / 14_400, 2.0).select("seq", F.round("tokens", 6).alias("tokens"))


@query
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_seen(packets(spark, sf_dir), ["src_ip4", "dst_ip4"])


@query
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bursts(packets(spark, sf_dir), ["kind"], 24, 6 * HOUR, HOUR)


@query
def burst_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.count_alarm(packets(spark, sf_dir), ["kind"], 22, 6 * HOUR, HOUR)


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative packets and drops (errors) of four sources, a row a day."""
    p = packets(spark, sf_dir)
    day = p.groupBy((F.col("user_id") % 4).alias("source_idx"), (reports.bucket("ts_us", DAY) * DAY).alias("ts_us")).agg(F.count_if(F.col("kind") != "error").alias("n"), F.count_if(F.col("kind") == "error").alias("d"))
    run = Window.partitionBy("source_idx").orderBy("ts_us")
    return day.select("source_idx", "ts_us", F.sum("n").over(run).alias("packets"), F.sum("d").over(run).alias("drops"))


@query
def capture_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.capture_deltas(_telemetry(spark, sf_dir)).withColumn("drop_rate", F.round("drop_rate", 6))


@query
def overload_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.overload(reports.capture_deltas(_telemetry(spark, sf_dir)), enter=0.25, leave=0.2, calm=1).select("source_idx", "ts_us", "edge")


@query
def asset_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).select("seq", "ts_us", "src_ip4", F.when(F.col("kind") != "error", F.col("kind")).alias("os"), (F.col("dst_port") > 100).alias("high"))
    return reports.changes(p, "src_ip4", ["os", "high"])


@query
def running_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).withColumn("source_idx", F.col("user_id") % 4)
    return flows.running_clock(p).select("seq", "source_idx", "clock_us")


@query
def lookup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    updates = p.filter("kind = 'view'").select("src_ip4", "ts_us", F.col("len").alias("size"))
    return correlate.latest(p.filter("kind = 'purchase'").select("seq", "src_ip4", "ts_us"), updates, ["src_ip4"], "size", 12 * HOUR)


@query
def not_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).select("seq", "src_ip4", "ts_us", "kind")
    return correlate.not_followed(p.filter("kind = 'signup'"), p.filter("kind = 'purchase'"), ["src_ip4"], 2 * DAY).drop("kind")


@query
def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).select("seq", "src_ip4", "ts_us", "len", "kind")
    return correlate.paired(p.filter("kind = 'click'").drop("kind", "len"), p.filter("kind = 'view'").select("src_ip4", "ts_us", "len"), ["src_ip4"], 12 * HOUR, ["len"])


@query
def errors_within_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    length = F.when(F.col("seq") % 3 == 0, 5 * DAY).otherwise(F.lit(6 * HOUR))  # so that long ones hold short ones
    periods = p.filter("kind = 'signup'").select("src_ip4", F.col("ts_us").alias("from_us"), (F.col("ts_us") + length).alias("to_us"), F.col("seq").alias("period_seq"))
    return correlate.within(p.filter("kind = 'error'").select("seq", "src_ip4", "ts_us"), periods, ["src_ip4"], "from_us", "to_us", ["period_seq"])


@query
def sequence_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.sequences(packets(spark, sf_dir), ["src_ip4"], F.substring("kind", 1, 1), "vcp", 2 * DAY)


@query
def indicator_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = spark.createDataFrame([("Cheap-Pills.example.com.", 90), ("example.net", 20), ("blog.tionsh.example.net", 70)], "domain string, reputation long")
    return correlate.indicator_hosts(web(spark, sf_dir).select("page_id", "http_host"), "http_host", bad)


@query
def indicator_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    bad = p.select(F.explode(F.array("src_ip4", "dst_ip4")).alias("ip4")).distinct().filter("ip4 % 11 = 0").withColumn("reputation", F.col("ip4") % 100)
    return correlate.indicator_addresses(p.select("seq", "src_ip4", "dst_ip4"), bad)


@query
def port_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.port_scan(packets(spark, sf_dir), 4, DAY)


@query
def scan_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.walk(packets(spark, sf_dir), "src_ip4", F.col("kind").isin("view", "click"))


@query
def beacon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = detect.beacons(packets(spark, sf_dir), ["src_ip4"])
    return b.select("src_ip4", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "score")))


@query
def regular_beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = detect.regular_beacons(packets(spark, sf_dir), ["src_ip4"], "len")
    return b.select("src_ip4", "n", *(F.round(c, 5).alias(c) for c in ("gap_skew", "gap_mad", "size_skew", "size_mad", "score")))


@query
def host_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web(spark, sf_dir).select("page_id", F.round(net.entropy(F.col("url")), 6).alias("entropy"), net.second_level(F.col("http_host")).alias("sld"))


@query
def generated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = web(spark, sf_dir).withColumn("label", F.regexp_extract("http_host", r"([^.]+)\.example\.", 1)).withColumn("name", F.concat("label", F.lit(".com")))
    return detect.generated_names(w, "name", detect.bigram_table(w, "label"), -1.5).withColumn("score", F.round("score", 6))


@query
def neighbour_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets(spark, sf_dir).select("seq", "ts_us", net.ip4_text(F.col("dst_ip4")).alias("ip"), F.concat(F.lit("mac-"), (F.floor(F.col("user_id") / 50)).cast("string")).alias("mac"), net.ip4_text(F.col("dst_ip4") - F.col("seq") % 2).alias("target_ip"), (F.col("value") > 95).alias("odd"))
    return detect.neighbours(rows, 6 * HOUR, DAY, {"192.168.1.5": "mac-0"}, True, True, F.col("odd")).select("seq", "ip", "mac", "kind")


@query
def flow_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"cleartext": F.col("dst_port") == 80, "odd_port": F.col("dst_port") == 8443, "exfiltration": F.col("len") > 900, "known_bad": F.col("dst_ip4") == 3_232_235_783}
    return detect.flow_risk(packets(spark, sf_dir), flags).select("seq", "risks", "risk_bits", "risk_score", "risk_severity")


RULES = [
    {"title": "pills", "level": "high", "logsource": {"category": "http"}, "detection": {"sel": {"cs-host|contains": ["pills", "casino"]}, "old": {"c-uri|endswith": ".html"}, "condition": "sel and not old"}},
    {"title": "blogs", "logsource": {"category": "http"}, "detection": {"sel_a": {"cs-host|startswith": "blog."}, "sel_b": {"c-uri|re": "^/(fr|de)/", "cs-host": "*.example.org"}, "condition": "1 of sel_*"}},
]


@query
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.rule_matches(web(spark, sf_dir), RULES, "page_id")


@query
def packet_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).withColumn("size", F.floor(F.col("len") / 100))
    return folds.first_in_window(p, ["dst_ip4", "size"], ["ts_us", "seq"], "ts_us", DAY, inclusive=True).select("seq", "dst_ip4", "size")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    severity = F.when(F.col("len") > 900, "critical").when(F.col("len") > 500, "error").when(F.col("len") > 200, "warning").otherwise("info")
    by_kind = [detect.finding(p.filter(F.col("kind") == k), k, severity, "src_ip4", {"dst": F.col("dst_port"), "note": F.lit('a "b" ]')}, {"len": F.col("len")}) for k in ("error", "signup")]
    return by_kind[0].unionByName(by_kind[1])


@query
def finding_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layers.through(_findings(spark, sf_dir), layers.min_severity("warning"), layers.dedupe(3 * DAY), layers.rate_limit(5, DAY))
    return out.select("kind", "key", "ts_us", "severity", F.col("sev_rank").cast("long"))


@query
def finding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    return f.select("kind", "key", "ts_us", formats.json_line(f).alias("line"), formats.syslog(f).alias("syslog"), formats.eve(f).alias("eve"))


@query
def finding_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    return f.select(formats.finding_record(f).alias("record"))


@query
def finding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.metric_values(_findings(spark, sf_dir))


@query
def conversation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumn("size", F.length("text").cast("long"))
    return flows.stretches(c, ["conv_id"], ["turn", "role", "text"], "role", "size").withColumn("run", F.col("run").cast("long"))


def queries() -> dict:
    return QUERIES | frames.QUERIES | more.QUERIES | wire.QUERIES | live.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in QUERIES} | frames.SQL | more.SQL | wire.SQL | live.SQL
