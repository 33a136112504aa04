"""Findings straight from parsed messages and flows: filters with a kind, a severity and a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import detect, reports

#: kind: (severity, the columns that it reads, condition over parsed messages).
LATERAL = {
    "smb_admin_share": ("warning", ["smb_share"], "lower(smb_share) IN ('admin$', 'c$', 'ipc$')"),
    "smb_remote_service": ("error", ["smb_pipe"], "lower(smb_pipe) IN ('svcctl', 'atsvc', 'winreg')"),
    "directory_replication": ("critical", ["smb_pipe"], "lower(smb_pipe) = 'drsuapi'"),
    "kerberoast": ("error", ["kerberos_type", "kerberos_etype"], "kerberos_type = 'TGS-REQ' AND kerberos_etype = 23"),
    "kerberos_failures": ("warning", ["kerberos_error"], "kerberos_error IN (18, 24)"),
    "ldap_service_names": ("warning", ["ldap_filter"], "lower(ldap_filter) LIKE '%serviceprincipalname=%'"),
    "rdp_login": ("info", ["rdp_user"], "rdp_user IS NOT NULL"),
}


def lateral_movement(messages: DataFrame, key: str = "src_ip4") -> DataFrame:
    """Findings of all conditions whose columns the table has (``services.windows`` has them all), in one pass over it."""
    there = {c.lower() for c in messages.columns}
    held = [F.when(F.expr(condition), F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))) for kind, (severity, columns, condition) in LATERAL.items() if there >= set(columns)]
    hits = F.array_compact(F.array(*held)) if held else F.array().cast("array<struct<kind:string,severity:string>>")
    return _named(messages.withColumn("hit_", F.explode(hits)), F.col("hit_.kind"), F.col("hit_.severity"), key)


def _named(rows: DataFrame, kind: Column, severity: Column, key: str) -> DataFrame:
    r = detect.finding(rows.withColumns({"kind_": kind, "severity_": severity}), "", F.col("severity_"), key, {"kind_": F.col("kind_")})
    return r.withColumn("kind", F.col("observations")["kind_"]).withColumn("observations", F.map_filter("observations", lambda k, v: k != "kind_"))


def resets(flows: DataFrame, key: str = "a_ip4") -> DataFrame:
    """Flows ended by a reset: a warning where no payload went by, else information."""
    r = flows.filter("reason = 'rst'").withColumn("ts_us", F.col("end_us"))
    empty = F.col("bytes_initiator") + F.col("bytes_responder") == 0
    return detect.finding(r, "tcp_reset", F.when(empty, "warning").otherwise("info"), key, {"port": F.col("b_port")}, {"bytes": F.col("bytes_initiator") + F.col("bytes_responder")})


def icmp_errors(messages: DataFrame) -> DataFrame:
    """ICMP errors by what they say: a blocked or missing path is a warning, the rest information."""
    bad = F.col("icmp_kind").isin("admin_prohibited", "fragmentation_needed", "net_unreachable")
    return detect.finding(messages, "icmp_error", F.when(bad, "warning").otherwise("info"), "src_ip4", {"kind": F.col("icmp_kind")})


def hidden_names(hellos: DataFrame) -> DataFrame:
    """Encrypted client hellos: accepted is information, rejected a warning."""
    r = hellos.filter("ech IN ('accepted', 'rejected')")
    return detect.finding(r, "ech", F.when(F.col("ech") == "rejected", "warning").otherwise("info"), "src_ip4", {"ech": F.col("ech"), "sni": F.col("sni")})


def floods(packets: DataFrame, threshold: int, window_us: int, bucket_us: int, source: str = "src_ip4") -> DataFrame:
    """Sources whose rolling count of opening packets comes to the threshold."""
    opening = packets.filter(F.col("tcp_flags").bitwiseAND(F.lit(18)) == 2) if "tcp_flags" in packets.columns else packets
    r = reports.bursts(opening, [source], threshold, window_us, bucket_us).withColumn("ts_us", F.col("bucket") * bucket_us)
    return detect.finding(r, "syn_flood", "critical", source, {}, {"count": F.col("total")})


def exfiltration(flows: DataFrame, least_bytes: int, least_ratio: float = 10.0) -> DataFrame:
    """Flows whose initiator sent much, and many times what came back."""
    r = flows.filter((F.col("bytes_initiator") >= least_bytes) & (F.col("bytes_initiator") >= F.col("bytes_responder") * least_ratio)).withColumn("ts_us", F.col("end_us"))
    return detect.finding(r, "exfiltration", "error", F.when(F.col("a_initiated"), F.col("a_ip4")).otherwise(F.col("b_ip4")), {"port": F.col("b_port")}, {"bytes": F.col("bytes_initiator")})


def summaries(flows: DataFrame, messages: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """Flows with the least and the number of distinct values of each fact in their messages (ts_us within the flow)."""
    inside = [F.col(f"f.{k}") == F.col(f"m.{k}") for k in keys] + [F.col("m.ts_us").between(F.col("f.start_us"), F.col("f.end_us"))]
    both = flows.alias("f").join(messages.select(*keys, "ts_us", *facts).alias("m"), inside)
    told = both.groupBy(*(F.col(f"f.{k}").alias(k) for k in keys), F.col("f.start_us").alias("start_us")).agg(*(x for c in facts for x in (F.min(c).alias(c), F.count_distinct(c).alias(f"n_{c}"))))
    return flows.join(told, [*keys, "start_us"], "left")


def union(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)
