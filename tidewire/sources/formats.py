"""What sinks write: findings and flows as JSON lines, event, finding and log records, and export records. All are columns; writing is Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net

#: Ids of the open finding schema by our severity, and of syslog.
FINDING_SEVERITY = {"info": 1, "warning": 3, "error": 4, "critical": 5}
SYSLOG_SEVERITY = {"info": 6, "warning": 4, "error": 3, "critical": 2}
EVE_SEVERITY = {"info": 4, "warning": 3, "error": 2, "critical": 1}
#: Information elements of flow export by our column.
EXPORT_NAMES = {
    "start_us": "flowStartMicroseconds", "end_us": "flowEndMicroseconds", "proto": "protocolIdentifier",
    "src_ip4": "sourceIPv4Address", "src_port": "sourceTransportPort", "dst_ip4": "destinationIPv4Address", "dst_port": "destinationTransportPort",
    "packets_initiator": "initiatorPackets", "bytes_initiator": "initiatorOctets", "packets_responder": "responderPackets", "bytes_responder": "responderOctets",
    "src_ip6": "sourceIPv6Address", "dst_ip6": "destinationIPv6Address",
    "packets": "packetTotalCount", "bytes": "octetTotalCount", "reason": "originalEndReason", "community_id": "communityId",
}
#: Severity numbers of telemetry logs.
LOG_SEVERITY = {"info": 9, "warning": 13, "error": 17, "critical": 21}
END_REASONS = {"idle": 1, "active": 2, "fin": 3, "rst": 3, "forced": 4, "resources": 5}


def _code(column: Column, table: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), column)


def iso_time(ts_us: Column) -> Column:
    """UTC time with microseconds, whatever the session's zone."""
    days, rest = F.floor(ts_us / 86_400_000_000).cast("int"), F.pmod(ts_us, F.lit(86_400_000_000))
    seconds = F.floor(rest / 1_000_000)
    day = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    return F.concat(day, F.lit("T"), *(p for h in ((seconds / 3600, ":"), (seconds % 3600 / 60, ":"), (seconds % 60, ".")) for p in (F.lpad(F.floor(h[0]).cast("string"), 2, "0"), F.lit(h[1]))), F.lpad(F.pmod(ts_us, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("Z"))


def _finite(metrics: Column) -> Column:
    """Numbers that JSON has no sign for become null."""
    return F.transform_values(metrics, lambda k, v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v))


def _sorted(m: Column, kind: str) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m))).cast(f"map<string,{kind}>")


def json_line(f: DataFrame) -> Column:
    """severity, kind, ts_secs, ts_nanos, key (if any), observations, metrics."""
    secs = F.floor(F.col("ts_us") / 1_000_000)
    return F.to_json(
        F.struct("severity", "kind", secs.cast("long").alias("ts_secs"), (F.pmod("ts_us", F.lit(1_000_000)) * 1000).cast("long").alias("ts_nanos"), "key", _sorted(F.col("observations"), "string").alias("observations"), _finite(_sorted(F.col("metrics"), "double")).alias("metrics")),
        {"ignoreNullFields": "true"},
    )


def eve(f: DataFrame) -> Column:
    """An event record of type anomaly."""
    detail = F.struct(F.lit("custom").alias("app_proto"), F.lit("applayer").alias("type"), F.col("kind").alias("event"), _code(F.col("severity"), EVE_SEVERITY).alias("severity"))
    return F.to_json(F.struct(iso_time(F.col("ts_us")).alias("timestamp"), F.lit("anomaly").alias("event_type"), "key", detail.alias("anomaly")))


def finding_record(f: DataFrame) -> Column:
    """A detection finding of the open cybersecurity schema: class 2004, activity 1."""
    info = F.struct(F.col("kind").alias("title"), F.concat_ws("|", "kind", "key", F.col("ts_us").cast("string")).alias("uid"))
    unmapped = F.struct("key", _sorted(F.col("observations"), "string").alias("observations"), _finite(_sorted(F.col("metrics"), "double")).alias("metrics"))
    return F.to_json(
        F.struct(
            F.lit(2).alias("category_uid"), F.lit(2004).alias("class_uid"), F.lit(1).alias("activity_id"), F.lit(200401).alias("type_uid"),
            F.floor(F.col("ts_us") / 1000).alias("time"), _code(F.col("severity"), FINDING_SEVERITY).alias("severity_id"), info.alias("finding_info"), unmapped.alias("unmapped"),
        )
    )


def syslog(f: DataFrame, facility: int = 16, host: str = "-", app: str = "tidewire") -> Column:
    """An RFC 5424 line, with key, observations and metrics as structured data."""
    quoted = lambda c: F.regexp_replace(c, r'(["\\\]])', r"\\$1")
    field = lambda e: F.concat(e["key"], F.lit('="'), quoted(e["value"].cast("string")), F.lit('"'))
    more = F.concat(F.transform(F.array_sort(F.map_entries("observations")), field), F.transform(F.array_sort(F.map_entries("metrics")), field))
    data = F.concat(F.lit('[finding@32473 key="'), quoted(F.coalesce("key", F.lit(""))), F.lit('"'), F.array_join(F.transform(more, lambda x: F.concat(F.lit(" "), x)), ""), F.lit("]"))
    return F.concat(F.lit("<"), (_code(F.col("severity"), SYSLOG_SEVERITY) + facility * 8).cast("string"), F.lit(">1 "), iso_time(F.col("ts_us")), F.lit(f" {host} {app} - "), F.col("kind"), F.lit(" "), data)


def eve_tls(hellos: DataFrame) -> Column:
    """An event record of type tls of client hellos (ts_us, the ends as text, sni, ja3, ja4)."""
    detail = F.struct("sni", F.struct(F.col("ja3").alias("hash")).alias("ja3"), "ja4")
    ends = ("src_ip", "src_port", F.col("dst_ip").alias("dest_ip"), F.col("dst_port").alias("dest_port"))
    return F.to_json(F.struct(iso_time(F.col("ts_us")).alias("timestamp"), F.lit("tls").alias("event_type"), *ends, F.lit("TCP").alias("proto"), detail.alias("tls")))


def messages(f: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """Findings as the columns that Spark's Kafka sink takes: findings with one key go to one partition; kind and severity are headers. ``more`` are columns beside them."""
    header = lambda c: F.struct(F.lit(c).alias("key"), F.encode(c, "UTF-8").alias("value"))
    return f.select(F.coalesce("key", "kind").alias("key"), json_line(f).alias("value"), F.array(header("kind"), header("severity")).alias("headers"), *(c.alias(n) for n, c in (more or {}).items()))


def telemetry_log(f: DataFrame) -> Column:
    """A finding as a log record of the open telemetry protocol, in JSON: the kind is its body, key, observations and metrics its attributes."""
    text = lambda k, v: F.struct(k.alias("key"), F.struct(v.cast("string").alias("stringValue"), F.lit(None).cast("double").alias("doubleValue")).alias("value"))
    real = lambda k, v: F.struct(k.alias("key"), F.struct(F.lit(None).cast("string").alias("stringValue"), v.cast("double").alias("doubleValue")).alias("value"))
    own = F.when(F.col("key").isNotNull(), F.array(text(F.lit("key"), F.col("key"))))
    seen = F.transform(F.array_sort(F.map_entries("observations")), lambda e: text(e["key"], e["value"]))
    told = F.transform(F.array_sort(F.map_entries("metrics")), lambda e: real(e["key"], F.when(~F.isnan(e["value"]) & (F.abs(e["value"]) != float("inf")), e["value"])))
    none = F.array().cast("array<struct<key:string,value:struct<stringValue:string,doubleValue:double>>>")
    attributes = F.concat(*(F.coalesce(a, none) for a in (own, seen, told)))
    fields = ((F.col("ts_us") * 1000).cast("string").alias("timeUnixNano"), _code(F.col("severity"), LOG_SEVERITY).alias("severityNumber"), F.upper("severity").alias("severityText"), F.struct(F.col("kind").alias("stringValue")).alias("body"))
    return F.to_json(F.struct(*fields, attributes.alias("attributes")))


def telemetry_sum(name: str, value: Column, time_ns: Column, attributes: dict[str, Column]) -> Column:
    """A count as a metric of the open telemetry protocol, in JSON: a sum of the time since the point before."""
    own = F.array(*(F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value")) for k, v in attributes.items()))
    point = F.struct(value.cast("long").cast("string").alias("asInt"), time_ns.cast("string").alias("timeUnixNano"), own.alias("attributes"))
    return F.to_json(F.struct(F.lit(name).alias("name"), F.struct(F.array(point).alias("dataPoints"), F.lit(1).alias("aggregationTemporality"), F.lit(True).alias("isMonotonic")).alias("sum")))


def telemetry_gauge(name: str, value: Column, time_ns: Column, attributes: dict[str, Column]) -> Column:
    """A measure as a metric of the open telemetry protocol, in JSON; numbers that JSON has no sign for have none."""
    own = F.array(*(F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value")) for k, v in attributes.items()))
    v = value.cast("double")
    point = F.struct(F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).alias("asDouble"), time_ns.cast("string").alias("timeUnixNano"), own.alias("attributes"))
    return F.to_json(F.struct(F.lit(name).alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("gauge")))


def metric_counts(f: DataFrame) -> DataFrame:
    return f.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


def metric_values(f: DataFrame) -> DataFrame:
    """Count, sum and exact median of each metric by kind."""
    each = f.select("kind", F.explode("metrics").alias("metric", "v"))
    return each.groupBy("kind", "metric").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.percentile("v", 0.5).alias("p50"))


def export_records(f: DataFrame) -> DataFrame:
    """Flows under the names of the flow export standard, their initiator as the source, with the standard's code for why they ended and the reason itself.

    Flows with IPv6 ends (a_ip6, b_ip6) have those as text, and null IPv4 ends.
    """
    own = F.col("a_initiated")
    six = "a_ip6" in f.columns
    pick = lambda yes, no: F.when(own, yes).otherwise(no)
    ends = {f"{to}_{c}": pick(F.col(f"{yes}_{c}"), F.col(f"{no}_{c}")) for to, yes, no in (("src", "a", "b"), ("dst", "b", "a")) for c in ("ip4", "port")}
    if six:
        ends |= {f"{to}_ip6": pick(net.ip6_text(F.col(f"{yes}_ip6")), net.ip6_text(F.col(f"{no}_ip6"))) for to, yes, no in (("src", "a", "b"), ("dst", "b", "a"))}
    totals = {c: F.col(f"{c}_initiator") + F.col(f"{c}_responder") for c in ("packets", "bytes")}
    f = f.withColumns(ends | totals | {"community_id": flow_id(f)})
    names = {c: n for c, n in EXPORT_NAMES.items() if six or not c.endswith("ip6")}
    return f.select(*(F.col(c).alias(n) for c, n in names.items()), F.coalesce(_code(F.col("reason"), END_REASONS), F.lit(2)).cast("long").alias("flowEndReason"))


def flow_id(f: DataFrame) -> Column:
    """The community id of flows of either family."""
    ends = [net.ip_octets(F.col(f"{x}_ip4"), F.col(f"{x}_ip6") if f"{x}_ip6" in f.columns else None) for x in "ab"]
    return net.community_id_of(F.col("proto"), ends[0], F.col("a_port"), ends[1], F.col("b_port"))


#: States of the connection log by our states of a connection.
LOG_STATES = {"reset": "RSTO", "closed": "SF", "half_closed": "S2", "established": "S1", "opening": "S0", "midstream": "OTH"}


def conn_log(f: DataFrame) -> DataFrame:
    """Flows of either family as a connection log; write it with ``csv(sep="\\t")``. Without states of connections they are told by the reason and by whether there was an answer."""
    own = F.col("a_initiated")
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(F.col(b))
    text = {x: net.ip_text(F.col(f"{x}_ip4"), F.col(f"{x}_ip6") if f"{x}_ip6" in f.columns else None) for x in "ab"}
    state = F.when(F.col("reason") == "rst", "RSTO").when((F.col("packets_responder") > 0) & (F.col("reason") == "fin"), "SF").when(F.col("packets_responder") > 0, "S1").otherwise("S0")
    if "state" in f.columns:
        told = F.when((F.col("state") == "opening") & (F.col("packets_responder") > 0), "S1").otherwise(_code(F.col("state"), LOG_STATES))
        state = F.coalesce(told, state)
    return f.select(
        (F.col("start_us") / 1e6).alias("ts"), F.when(own, text["a"]).otherwise(text["b"]).alias("orig_h"), pick("a_port", "b_port").alias("orig_p"), F.when(own, text["b"]).otherwise(text["a"]).alias("resp_h"), pick("b_port", "a_port").alias("resp_p"),
        net.proto_label(F.col("proto")).alias("proto"), ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration"), F.col("bytes_initiator").alias("orig_bytes"), F.col("bytes_responder").alias("resp_bytes"), state.alias("conn_state"),
    )


def write_flows(f: DataFrame, path: str, format: str = "parquet") -> None:
    """Flows as zstd Parquet, JSON lines or tab-separated text."""
    writer = f.write.mode("errorifexists")
    if format == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif format == "json":
        writer.json(path)
    elif format == "tsv":
        conn_log(f).write.mode("errorifexists").csv(path, sep="\t", header=True)
    else:
        raise ValueError(f"no such format: {format}")
