"""Registered queries of triage, retention, lookups and scalar functions, each with its DuckDB twin beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..operators import correlate, detect, flows, folds, layers, reports, retention, triage
from ..sources import decoders, formats
from .frames import FLAG_FLOWS, FLAGGED, _flagged, flag_flows, flagged_packets
from .tables import DAY, HOUR, WEB, P, packets, read, web

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _told(findings: DataFrame) -> DataFrame:
    """Findings with their maps as text."""
    pairs = lambda c, t: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast(t).cast("string"))), ",")
    return findings.select("kind", "severity", F.col("sev_rank").cast("long").alias("sev_rank"), "ts_us", "key", pairs("observations", "string").alias("observations"), pairs("metrics", "long").alias("metrics"))


_RANK = "CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 WHEN 'error' THEN 2 ELSE 3 END::BIGINT AS sev_rank"


@query(f"""WITH RECURSIVE {FLAG_FLOWS}, x AS (
SELECT 'tcp_reset' AS kind, CASE WHEN ba + bb = 0 THEN 'warning' ELSE 'info' END AS severity, end_us AS ts_us, a_ip4 AS key, b_port, ba + bb AS bytes FROM fr WHERE reason = 'rst'
UNION ALL SELECT 'exfiltration', 'error', end_us, CASE WHEN a_initiated THEN a_ip4 ELSE b_ip4 END, b_port, bytes_initiator FROM fr WHERE bytes_initiator >= 900 AND bytes_initiator >= bytes_responder * 10)
SELECT kind, severity, {_RANK}, ts_us, key::VARCHAR AS key, 'port=' || b_port AS observations, 'bytes=' || bytes AS metrics FROM x""")
def triage_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flag_flows(spark, sf_dir)
    return _told(triage.union(triage.resets(f), triage.exfiltration(f, 900)))


_LATERAL = [("smb_admin_share", "warning", "kind = 'click' AND seq % 4 = 0"), ("smb_remote_service", "error", "kind = 'view' AND seq % 4 = 1"), ("directory_replication", "critical", "kind = 'view' AND seq % 4 = 2"), ("kerberoast", "error", "kind = 'purchase' AND seq % 2 = 0"), ("rdp_login", "info", "kind = 'signup'")]


@query(f"""WITH {P}, x AS ({" UNION ALL ".join(f"SELECT '{k}' AS kind, '{s}' AS severity, ts_us, src_ip4 FROM p WHERE {c}" for k, s, c in _LATERAL)}
UNION ALL SELECT 'ech', CASE WHEN seq % 5 = 1 THEN 'warning' ELSE 'info' END, ts_us, src_ip4 FROM p WHERE kind = 'error' AND seq % 5 < 2)
SELECT kind, severity, {_RANK}, ts_us, src_ip4::VARCHAR AS key FROM x""")
def triage_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    at = lambda kind, n, k, value: F.when((F.col("kind") == kind) & (F.col("seq") % n == k), F.lit(value))
    m = p.withColumns({
        "smb_share": at("click", 4, 0, "ADMIN$"), "smb_pipe": F.coalesce(at("view", 4, 1, "svcctl"), at("view", 4, 2, "drsuapi")), "kerberos_type": at("purchase", 2, 0, "TGS-REQ"), "kerberos_etype": F.lit(23),
        "rdp_user": at("signup", 1, 0, "u"), "ech": F.coalesce(at("error", 5, 0, "accepted"), at("error", 5, 1, "rejected"), at("error", 5, 2, "grease")), "sni": F.lit("x"),
    })
    return triage.union(triage.lateral_movement(m), triage.hidden_names(m)).select("kind", "severity", F.col("sev_rank").cast("long").alias("sev_rank"), "ts_us", "key")


@query(f"""WITH {FLAGGED}, b AS (SELECT src_ip4, ts_us // {HOUR} AS bucket, count(*) AS own FROM t WHERE tcp_flags & 18 = 2 GROUP BY ALL),
r AS (SELECT *, sum(own) OVER (PARTITION BY src_ip4 ORDER BY bucket RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)::BIGINT AS total FROM b),
z AS (SELECT *, CASE WHEN lag(bucket) OVER w = bucket - 1 THEN lag(total) OVER w ELSE 0 END AS before FROM r WINDOW w AS (PARTITION BY src_ip4 ORDER BY bucket))
SELECT src_ip4::VARCHAR AS key, bucket * {HOUR} AS ts_us, 'count=' || total AS metrics FROM z WHERE before < 2 AND total >= 2""")
def syn_floods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(triage.floods(_flagged(packets(spark, sf_dir)), 2, DAY, HOUR)).select("key", "ts_us", "metrics")


@query(f"""WITH RECURSIVE {FLAG_FLOWS} SELECT fr.proto, fr.a_ip4, fr.b_ip4, fr.start_us, min(fn.kind) AS kind, count(DISTINCT fn.kind) AS n_kind FROM fr JOIN fn ON fn.k = fr.k AND fn.nth = fr.nth GROUP BY ALL""")
def flow_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with what their messages (here: their packets' kinds) say."""
    m = flows.with_key(flagged_packets(spark, sf_dir))
    return triage.summaries(flag_flows(spark, sf_dir), m, flows.KEY, ["kind"]).select("proto", "a_ip4", "b_ip4", "start_us", "kind", "n_kind")


@query(f"""WITH {P}, q AS (SELECT *, user_id % 4 AS source_idx, ts_us // 1000000 AS s, ts_us // {DAY} AS period FROM p),
b AS (SELECT source_idx, period, s, sum(len) AS bytes FROM q GROUP BY ALL), r AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY source_idx, period ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b)
SELECT seq, q.source_idx || '-' || q.period || '-' || (before // 20000) AS file FROM q JOIN r USING (source_idx, s)""")
def rotated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).withColumn("source_idx", F.col("user_id") % 4)
    return retention.rotated(p, most_bytes=20_000, period_us=DAY).select("seq", "file")


@query(f"""WITH {P}, f AS (SELECT user_id % 4 AS source_idx, ts_us // {DAY} AS day, max(ts_us) AS end_us, sum(len)::BIGINT AS bytes FROM p GROUP BY ALL),
w AS (SELECT *, row_number() OVER w AS nth, sum(bytes) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM f WINDOW w AS (PARTITION BY source_idx ORDER BY end_us DESC, 'day-' || day DESC))
SELECT source_idx, 'day-' || day AS file, end_us, bytes FROM w WHERE nth = 1 OR (nth <= 7 AND run <= 200000)""")
def retained_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    files = p.groupBy((F.col("user_id") % 4).alias("source_idx"), F.concat(F.lit("day-"), reports.bucket("ts_us", DAY).cast("string")).alias("file")).agg(F.max("ts_us").alias("end_us"), F.sum("len").alias("bytes"))
    return retention.retained(files, most_files=7, most_bytes=200_000)


@query(f"""WITH {P}, q AS (SELECT seq, ts_us, len, user_id % 4 AS source_idx, kind, user_id FROM p), t AS (SELECT source_idx, min(ts_us) AS at_us FROM q WHERE kind = 'purchase' AND user_id > 140 GROUP BY ALL),
e AS (SELECT q.*, at_us, row_number() OVER w AS nth, sum(len) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM q JOIN t USING (source_idx) WHERE ts_us < at_us WINDOW w AS (PARTITION BY source_idx ORDER BY ts_us DESC, seq DESC))
SELECT seq, source_idx FROM q JOIN t USING (source_idx) WHERE ts_us >= at_us UNION ALL SELECT seq, source_idx FROM e WHERE nth = 1 OR run <= 10000""")
def trigger_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).withColumn("source_idx", F.col("user_id") % 4)
    return retention.around_trigger(p, p.filter("kind = 'purchase' AND user_id > 140"), most_bytes=10_000).select("seq", "source_idx")


@query(f"""WITH {WEB}, n AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN substr(md5(url), 1, 24) ELSE 'www' END AS label FROM web), c AS (SELECT page_id, label, unnest(string_split(label, '')) AS c FROM n),
k AS (SELECT page_id, label, c, count(*) AS k FROM c GROUP BY ALL), e AS (SELECT page_id, label, round(-sum(k / 24 * log2(k / 24)), 6) AS entropy FROM k WHERE length(label) = 24 GROUP BY ALL)
SELECT page_id, label, entropy FROM e WHERE entropy >= 3.5""")
def dns_tunnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("page_id") % 3 == 0, F.substring(F.md5("url"), 1, 24)).otherwise("www")
    return detect.tunnels(web(spark, sf_dir).withColumn("name", F.concat(label, F.lit(".t.example"))), "name").select("page_id", "label", F.round("entropy", 6).alias("entropy"))


@query("""WITH h AS (SELECT page_id, contains(html, '<script') AS a, contains(html, 'example.org') AS b, contains(html, 'cookie') AS c FROM pages)
SELECT page_id, concat_ws(',', CASE WHEN a THEN 'script' END, CASE WHEN b THEN 'org' END, CASE WHEN c THEN 'cookie' END) AS hits FROM h WHERE a OR b OR c""")
def signature_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").withColumn("body", F.encode("html", "UTF-8"))
    return detect.signatures(rows, "body", {"script": b"<script", "org": b"example.org", "cookie": b"cookie"}, "page_id").withColumn("hits", F.array_join("hits", ","))


@query(f"""WITH {P}, v AS (SELECT 40000 + user_id % 1000 AS domain, min(ts_us) AS since_us, CASE WHEN user_id % 2 = 0 THEN min(ts_us) + {5 * DAY} END AS until_us FROM p WHERE user_id % 3 = 0 GROUP BY user_id)
SELECT seq, p.ts_us, 'd' || p.src_port AS domain FROM p JOIN v ON v.domain = p.src_port WHERE ts_us >= since_us AND (until_us IS NULL OR ts_us < until_us)""")
def indicators_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).withColumn("domain", F.concat(F.lit("d"), F.col("src_port").cast("string")))
    v = p.filter("user_id % 3 = 0").groupBy("domain", "user_id").agg(F.min("ts_us").alias("since_us")).withColumn("until_us", F.when(F.col("user_id") % 2 == 0, F.col("since_us") + 5 * DAY))
    return correlate.reloaded(p.select("seq", "ts_us", "domain"), v).select("seq", "ts_us", "domain")


@query(f"""WITH {P} SELECT kind, severity, count(*) AS n FROM (SELECT 'port_scan' AS kind, CASE WHEN len > 500 THEN 'error' ELSE 'info' END AS severity FROM p) GROUP BY ALL""")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    return formats.metric_counts(detect.finding(p, "port_scan", F.when(F.col("len") > 500, "error").otherwise("info"), "src_ip4"))


@query(f"""WITH {P} SELECT seq, 'attack_technique=' || CASE WHEN kind = 'error' THEN 'T1046' ELSE 'T1071' END || ',n=' || seq AS observations FROM p WHERE kind IN ('error', 'click')""")
def finding_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).filter("kind IN ('error', 'click')")
    f = detect.finding(p, "", "info", F.col("seq"), {"n": F.col("seq"), "k": F.col("kind")})
    named = f.withColumn("kind", F.when(F.col("observations")["k"] == "error", "port_scan").otherwise("beacon")).withColumn("observations", F.map_filter("observations", lambda k, v: k != "k"))
    return _told(detect.tagged(named)).select(F.col("key").cast("long").alias("seq"), "observations")


@query(f"""WITH {P}, b AS (SELECT DISTINCT dst_ip4 FROM p WHERE kind = 'error' AND len < 100), c AS (SELECT DISTINCT dst_ip4 FROM p WHERE kind = 'click' AND len < 100)
SELECT 'both' AS side, dst_ip4 FROM (FROM b INTERSECT FROM c) UNION ALL SELECT 'errors only', dst_ip4 FROM (FROM b EXCEPT FROM c) UNION ALL SELECT 'all', dst_ip4 FROM (FROM b UNION FROM c)""")
def host_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).filter("len < 100")
    a, b = (p.filter(F.col("kind") == k).select("dst_ip4").distinct() for k in ("error", "click"))
    side = lambda name, rows: rows.select(F.lit(name).alias("side"), "dst_ip4")
    return side("both", a.intersect(b)).unionByName(side("errors only", a.exceptAll(b))).unionByName(side("all", a.union(b).distinct()))


@query(f"""WITH RECURSIVE {P}, n AS (SELECT *, row_number() OVER (PARTITION BY src_ip4 ORDER BY ts_us, seq) AS k FROM p),
r AS (SELECT src_ip4, k, value AS mean, 0.0::DOUBLE AS var FROM n WHERE k = 1
UNION ALL SELECT n.src_ip4, n.k, r.mean + 0.3 * (n.value - r.mean), 0.7 * (r.var + 0.3 * (n.value - r.mean) * (n.value - r.mean)) FROM r JOIN n ON n.src_ip4 = r.src_ip4 AND n.k = r.k + 1)
SELECT src_ip4, round(arg_max(mean, k), 6) AS ewma, round(arg_max(var, k), 6) AS ewma_var FROM r GROUP BY ALL""")
def ewma_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = folds.ewma_var(packets(spark, sf_dir), ["src_ip4"], ["ts_us", "seq"], "value", 0.3)
    last = lambda c: F.round(F.max_by(c, F.struct("ts_us", "seq")), 6).alias(c)
    return e.groupBy("src_ip4").agg(last("ewma"), last("ewma_var"))


@query(f"""WITH {P}, s AS (SELECT user_id % 4 AS source_idx, count(*) FILTER (WHERE kind = 'error') AS ring, count(*) FILTER (WHERE kind = 'signup') AS filter FROM p GROUP BY ALL)
SELECT source_idx, 'ring' AS cause, ring AS dropped, round(ring / (ring + filter), 6) AS share FROM s UNION ALL SELECT source_idx, 'filter', filter, round(filter / (ring + filter), 6) FROM s""")
def drop_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("source_idx").orderBy("ts_us")
    day = packets(spark, sf_dir).groupBy((F.col("user_id") % 4).alias("source_idx"), reports.bucket("ts_us", DAY).alias("ts_us")).agg(F.count_if(F.col("kind") == "error").alias("ring"), F.count_if(F.col("kind") == "signup").alias("filter"))
    t = day.withColumns({c: F.sum(c).over(w) for c in ("ring", "filter")})
    return reports.drop_breakdown(t, ["ring", "filter"]).withColumn("share", F.round("share", 6))


@query(f"""WITH {P} SELECT seq, {"concat_ws('.', (src_ip4 >> 24) & 255, (src_ip4 >> 16) & 255, (src_ip4 >> 8) & 255, src_ip4 & 255)"} AS ip, src_ip4 AS back, CASE WHEN proto = 6 THEN 'tcp' ELSE 'udp' END AS proto_label,
CASE dst_port WHEN 443 THEN 'tls' WHEN 80 THEN 'http' WHEN 8443 THEN 'tls' WHEN 22 THEN 'ssh' WHEN 53 THEN 'dns' END AS app, '1:' || base64(unhex(sha1(unhex('0000' || printf('%08x', src_ip4) || printf('%08x', dst_ip4) || printf('%02x', proto) || '00' || printf('%04x', src_port) || printf('%04x', dst_port))))) AS community_id,
CASE seq % 6 WHEN 0 THEN 'ok' WHEN 2 THEN 'servfail' WHEN 3 THEN 'nxdomain' WHEN 5 THEN 'refused' ELSE 'other' END AS rcode, CASE WHEN kind = 'error' THEN 'reset' ELSE 'clean' END AS flow_class, md5('curve' || user_id || ';aes,chacha;sha2;none') AS hassh,
CASE seq % 3 WHEN 0 THEN 'elf' WHEN 1 THEN 'png' END AS file_type, seq % 12 < 2 AS doh, CASE seq % 4 WHEN 0 THEN 'host_unreachable' WHEN 1 THEN 'time_exceeded' WHEN 2 THEN 'parameter_problem' END AS icmp FROM p""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = packets(spark, sf_dir), F.col("seq")
    types = F.when(n % 4 == 0, 3).when(n % 4 == 1, 11).when(n % 4 == 2, 12).otherwise(5)
    body = F.when(n % 3 == 0, F.lit(b"\x7fELF..")).when(n % 3 == 1, F.lit(b"\x89PNG\r\n")).otherwise(F.lit(b"text"))
    name = F.when(n % 12 == 0, "DNS.Google.").when(n % 12 == 1, "doh.mullvad.net").otherwise("dns.example")
    ip = net.ip4_text(F.col("src_ip4"))
    return p.select(
        "seq", ip.alias("ip"), net.ip4_number(ip).alias("back"), net.proto_label(F.col("proto")).alias("proto_label"), decoders.app_label(F.col("dst_port")).alias("app"),
        net.community_id(F.col("proto"), F.col("dst_ip4"), F.col("dst_port"), F.col("src_ip4"), F.col("src_port")).alias("community_id"), net.rcode_class(n % 6).alias("rcode"),
        net.flow_class(F.when(F.col("kind") == "error", "rst").otherwise("fin")).alias("flow_class"), net.hassh(F.array(F.concat(F.lit("curve"), F.col("user_id"))), F.array(F.lit("aes"), F.lit("chacha")), F.array(F.lit("sha2")), F.array(F.lit("none"))).alias("hassh"),
        net.file_type(body).alias("file_type"), net.is_doh_resolver(name).alias("doh"), net.icmp_kind(types, F.lit(1)).alias("icmp"),
    )


@query(f"WITH {P} SELECT dst_port, count(*) AS n FROM p WHERE proto = 6 AND (dst_port IN (22, 80, 8443) OR len > 1000) AND NOT (dst_ip4 BETWEEN 3232235776 AND 3232235783) GROUP BY ALL")
def filter_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms joined with and, or and not, and a condition kept as text."""
    from ..operators import filters

    keep = filters.all_of(filters.tcp, filters.ports([80, 22, 8443], "dst") | filters.where("len > 1000"), ~filters.network("192.168.1.0/29", "dst"))
    return filters.select(packets(spark, sf_dir), keep).groupBy("dst_port").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT unnest(['all', 'none']) AS sampled, unnest([count(*), 0]) AS n, unnest([count(DISTINCT user_id), 0]) AS n_keys FROM events")
def finding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of rate 1 and 0."""
    f = detect.finding(packets(spark, sf_dir), "port_scan", "info", "src_ip4")
    each = [layers.sample(rate)(f).agg(F.lit(name).alias("sampled"), F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys")) for name, rate in (("all", 1.0), ("none", 0.0))]
    return each[0].unionByName(each[1])
