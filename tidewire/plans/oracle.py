"""DuckDB twins of the registered queries."""

from __future__ import annotations

from .tables import OWNERS, WEB, P

_H, _D = 3_600_000_000, 86_400_000_000

#: Two-way packets: every third is an answer, so the user's end is always a, and forward tells the direction.
_FLOWS = f"""{P}, q AS (
  SELECT *, seq % 3 <> 0 AS forward, ts_us - lag(ts_us) OVER w AS gap FROM p WINDOW w AS (PARTITION BY proto, src_ip4, src_port, dst_ip4, dst_port ORDER BY ts_us, seq)
), h AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > {6 * _H} THEN 1 ELSE 0 END) OVER (PARTITION BY proto, src_ip4, src_port, dst_ip4, dst_port ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS nth FROM q
), f0 AS (
  SELECT proto, src_ip4 AS a_ip4, src_port AS a_port, dst_ip4 AS b_ip4, dst_port AS b_port, nth, min(ts_us) AS start_us, max(ts_us) AS end_us,
         first(forward ORDER BY ts_us, seq) AS a_initiated, count(*) FILTER (WHERE forward) AS pa, count(*) FILTER (WHERE NOT forward) AS pb,
         coalesce(sum(len) FILTER (WHERE forward), 0)::BIGINT AS ba, coalesce(sum(len) FILTER (WHERE NOT forward), 0)::BIGINT AS bb FROM h GROUP BY ALL
), f AS (
  SELECT proto, a_ip4, a_port, b_ip4, b_port, start_us, end_us, nth, a_initiated,
         CASE WHEN a_initiated THEN pa ELSE pb END AS packets_initiator, CASE WHEN a_initiated THEN pb ELSE pa END AS packets_responder,
         CASE WHEN a_initiated THEN ba ELSE bb END AS bytes_initiator, CASE WHEN a_initiated THEN bb ELSE ba END AS bytes_responder, 'idle' AS reason,
         coalesce(round((ba + bb) * 8 / nullif((end_us - start_us) / 1e6, 0), 4), 0.0) AS bits_per_s,
         coalesce(round((pa + pb) / nullif((end_us - start_us) / 1e6, 0), 6), 0.0) AS packets_per_s FROM f0
)"""


def _ip(c: str) -> str:
    return f"concat_ws('.', ({c} >> 24) & 255, ({c} >> 16) & 255, ({c} >> 8) & 255, {c} & 255)"


_ROLL = f"""{P}, s AS (SELECT kind, ts_us // {_H} AS bucket, count(*) AS own FROM p GROUP BY ALL),
r AS (SELECT kind, bucket, sum(own) OVER (PARTITION BY kind ORDER BY bucket RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)::BIGINT AS total FROM s)"""

_TELEMETRY = f"""{P}, d AS (
  SELECT user_id % 4 AS source_idx, ts_us // {_D} * {_D} AS ts_us, count(*) FILTER (WHERE kind <> 'error') AS d_packets, count(*) FILTER (WHERE kind = 'error') AS d_drops FROM p GROUP BY ALL
), t AS (
  SELECT source_idx, ts_us, sum(d_packets) OVER w::BIGINT AS packets, sum(d_drops) OVER w::BIGINT AS drops, d_packets, d_drops, d_drops / (d_packets + d_drops) AS drop_rate
  FROM d WINDOW w AS (PARTITION BY source_idx ORDER BY ts_us)
)"""

_FINDINGS = f"""{P}, a AS (
  SELECT kind, CASE WHEN len > 900 THEN 'critical' WHEN len > 500 THEN 'error' WHEN len > 200 THEN 'warning' ELSE 'info' END AS severity,
         (CASE WHEN len > 900 THEN 3 WHEN len > 500 THEN 2 WHEN len > 200 THEN 1 ELSE 0 END)::BIGINT AS sev_rank, ts_us, src_ip4::VARCHAR AS key, dst_port, len
  FROM p WHERE kind IN ('error', 'signup')
)"""

_ISO = "strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ')"

SQL = {
    "top_talkers_filtered": f"""WITH {P}, s AS (SELECT ts_us // {_H} AS period, src_ip4, sum(len)::BIGINT AS bytes, count(*) AS packets FROM p WHERE dst_port IN (443, 53) OR src_port IN (443, 53) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY period ORDER BY bytes DESC, src_ip4) AS rank FROM s QUALIFY rank <= 3""",
    "cidr_filter": f"WITH {P} SELECT seq, src_ip4, dst_ip4, len FROM p WHERE dst_ip4 BETWEEN 3232235792 AND 3232235807 AND proto <> 17 AND len > 500",
    "session_globs": f"WITH {WEB} SELECT page_id, http_host FROM web WHERE (http_host LIKE '%.example.net' OR http_host LIKE 'www.%ple.com') AND NOT coalesce(http_path LIKE '/en/%', false)",
    "flow_build": f"WITH {_FLOWS} SELECT * FROM f",
    "flow_interim": f"""WITH {_FLOWS}, t AS (SELECT f.*, unnest(range(1, (end_us - start_us) // {_H} + 1)) AS k FROM f WHERE end_us - start_us >= {_H})
SELECT t.proto, a_ip4, a_port, b_ip4, b_port, start_us, start_us + k * {_H} AS at_us, count(*) AS packets, sum(len)::BIGINT AS bytes
FROM t JOIN h ON h.proto = t.proto AND src_ip4 = a_ip4 AND src_port = a_port AND dst_ip4 = b_ip4 AND dst_port = b_port AND h.nth = t.nth AND ts_us < start_us + k * {_H} GROUP BY ALL""",
    "flow_lifecycle": f"""WITH {_FLOWS}, e AS (SELECT 'started' AS event, start_us AS ts_us, * FROM f UNION ALL SELECT 'ended', end_us, * FROM f)
SELECT event, proto, ts_us // {_D} AS day, count(*) AS n, count(*) FILTER (WHERE bytes_initiator + bytes_responder = 0) AS n_empty FROM e GROUP BY ALL""",
    "flow_active": f"WITH {_FLOWS} SELECT a_ip4, b_ip4, b_port, start_us, end_us FROM f WHERE start_us <= 1705000000000000 AND end_us > 1705000000000000 - {6 * _H}",
    "flow_conn_log": f"""WITH {_FLOWS} SELECT start_us / 1e6 AS ts, CASE WHEN a_initiated THEN {_ip("a_ip4")} ELSE {_ip("b_ip4")} END AS orig_h, CASE WHEN a_initiated THEN a_port ELSE b_port END AS orig_p,
CASE WHEN a_initiated THEN {_ip("b_ip4")} ELSE {_ip("a_ip4")} END AS resp_h, CASE WHEN a_initiated THEN b_port ELSE a_port END AS resp_p, CASE proto WHEN 6 THEN 'tcp' ELSE 'udp' END AS proto,
(end_us - start_us) / 1e6 AS duration, bytes_initiator AS orig_bytes, bytes_responder AS resp_bytes, CASE WHEN packets_responder > 0 THEN 'S1' ELSE 'S0' END AS conn_state FROM f""",
    "flow_export_records": f"""WITH {_FLOWS}, c AS (SELECT *, '1:' || base64(unhex(sha1(unhex('0000' || printf('%08x', a_ip4) || printf('%08x', b_ip4) || printf('%02x', proto) || '00' || printf('%04x', a_port) || printf('%04x', b_port))))) AS x FROM f)
SELECT start_us AS flowStartMicroseconds, end_us AS flowEndMicroseconds, proto AS protocolIdentifier, CASE WHEN a_initiated THEN a_ip4 ELSE b_ip4 END AS sourceIPv4Address, CASE WHEN a_initiated THEN a_port ELSE b_port END AS sourceTransportPort,
CASE WHEN a_initiated THEN b_ip4 ELSE a_ip4 END AS destinationIPv4Address, CASE WHEN a_initiated THEN b_port ELSE a_port END AS destinationTransportPort, packets_initiator AS initiatorPackets, bytes_initiator AS initiatorOctets,
packets_responder AS responderPackets, bytes_responder AS responderOctets, packets_initiator + packets_responder AS packetTotalCount, bytes_initiator + bytes_responder AS octetTotalCount, reason AS originalEndReason, x AS communityId, 1::BIGINT AS flowEndReason FROM c""",
    "flow_features": f"""WITH {P}, g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY src_ip4, dst_ip4 ORDER BY ts_us, seq) AS gap FROM p)
SELECT src_ip4, dst_ip4, count(*) AS packets, sum(len)::BIGINT AS bytes, max(ts_us) - min(ts_us) AS duration_us,
round(avg(len), 1) AS len_mean, round(stddev_pop(len), 1) AS len_std, min(len)::DOUBLE AS len_min, max(len)::DOUBLE AS len_max,
round(avg(gap / 1e6), 1) AS gap_mean, round(stddev_pop(gap / 1e6), 1) AS gap_std, round(min(gap / 1e6), 1) AS gap_min, round(max(gap / 1e6), 1) AS gap_max,
coalesce(sum(gap) FILTER (WHERE gap > {_D}), 0)::BIGINT AS idle_us, coalesce(round(sum(len) / nullif((max(ts_us) - min(ts_us)) / 1e6, 0), 3), 0.0) AS bytes_per_s FROM g GROUP BY ALL""",
    "rolling_rate": f"""WITH {P}, s AS (SELECT src_ip4, ts_us // {_H} AS bucket, sum(len) AS own FROM p GROUP BY ALL),
r AS (SELECT src_ip4, bucket, sum(own) OVER (PARTITION BY src_ip4 ORDER BY bucket RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)::BIGINT AS total FROM s) SELECT *, round(total / 43200.0, 6) AS rate FROM r""",
    "rolling_distinct": f"""WITH {P}, s AS (SELECT DISTINCT src_ip4, dst_ip4, ts_us // {_H} AS bucket FROM p), x AS (SELECT DISTINCT src_ip4, bucket FROM s)
SELECT x.src_ip4, x.bucket, count(DISTINCT s.dst_ip4) AS n_distinct FROM x JOIN s ON s.src_ip4 = x.src_ip4 AND s.bucket BETWEEN x.bucket - 11 AND x.bucket GROUP BY ALL""",
    "traffic_matrix": f"WITH {P} SELECT least(src_ip4, dst_ip4) AS host_a, greatest(src_ip4, dst_ip4) AS host_b, sum(len)::BIGINT AS bytes, count(*) AS packets FROM p GROUP BY ALL",
    "traffic_cube": f"WITH {P} SELECT kind, proto, grouping(kind, proto)::BIGINT AS level, sum(len)::BIGINT AS bytes, count(*) AS packets FROM p GROUP BY CUBE (kind, proto)",
    "top_names": f"WITH {WEB}, s AS (SELECT http_host, count(*) AS n FROM web GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY n DESC, http_host) AS rank FROM s QUALIFY rank <= 10",
    "bandwidth_by_app": f"""WITH {P}, s AS (SELECT CASE WHEN dst_port IN (443, 8443) THEN 'tls' WHEN dst_port = 80 THEN 'http' WHEN dst_port = 53 THEN 'dns' ELSE 'other' END AS label, ts_us // {_H} AS bucket, sum(len) AS own FROM p GROUP BY ALL),
r AS (SELECT label, bucket, sum(own) OVER (PARTITION BY label ORDER BY bucket RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)::BIGINT AS total FROM s)
SELECT *, round(total / 21600.0, 6) AS rate, round(total / sum(total) OVER (PARTITION BY bucket), 6) AS share FROM r""",
    "owner_bandwidth": f"""WITH {P}, {OWNERS}, s AS (SELECT ts_us // {_D} AS period, owner, sum(len)::BIGINT AS bytes FROM p LEFT JOIN owners USING (user_id) GROUP BY ALL)
SELECT *, round(coalesce(sum(bytes) FILTER (WHERE owner IS NULL) OVER w, 0) / sum(bytes) OVER w, 6) AS unknown_share FROM s WINDOW w AS (PARTITION BY period)""",
    "red_metrics": f"""WITH {P} SELECT user_id % 5 AS app, ts_us // {_D} AS period, count(*) AS requests, count(*) FILTER (WHERE kind = 'error') AS errors, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95,
round(quantile_cont(value, 0.99), 4) AS p99, round(count(*) FILTER (WHERE kind = 'error') / count(*), 4) AS error_ratio, round(count(*) / 86400.0, 8) AS rate FROM p GROUP BY ALL""",
    "ewma_last": f"WITH {P} SELECT src_ip4, round(list_reduce(list(value ORDER BY ts_us, seq), lambda a, x: 0.3 * x + 0.7 * a), 6) AS ewma FROM p GROUP BY ALL",
    "token_bucket": f"""WITH RECURSIVE {P}, n AS (SELECT *, row_number() OVER (PARTITION BY src_ip4 ORDER BY ts_us, seq) AS k FROM p),
r AS (SELECT k, src_ip4, seq, ts_us, 1.0::DOUBLE AS tokens FROM n WHERE k = 1
UNION ALL SELECT n.k, n.src_ip4, n.seq, n.ts_us, least(2.0, r.tokens + (n.ts_us - r.ts_us) / 1e6 / 14400) - 1 FROM r JOIN n ON n.src_ip4 = r.src_ip4 AND n.k = r.k + 1)
SELECT seq, round(tokens, 6) AS tokens FROM r""",
    "first_seen": f"WITH {P} SELECT src_ip4, dst_ip4, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n FROM p GROUP BY ALL",
    "bursts": f"WITH {_ROLL}, b AS (SELECT *, CASE WHEN lag(bucket) OVER w = bucket - 1 THEN lag(total) OVER w ELSE 0 END AS before FROM r WINDOW w AS (PARTITION BY kind ORDER BY bucket)) SELECT kind, bucket, total FROM b WHERE before < 24 AND total >= 24",
    "burst_alarm": f"""WITH RECURSIVE {_ROLL}, n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY bucket) AS k FROM r),
z AS (SELECT kind, bucket, total, k, total > 22 AS live, total > 22 AS entered FROM n WHERE k = 1
UNION ALL SELECT n.kind, n.bucket, n.total, n.k, CASE WHEN z.live THEN n.total > 11 ELSE n.total > 22 END, NOT z.live AND n.total > 22 FROM z JOIN n ON n.kind = z.kind AND n.k = z.k + 1)
SELECT kind, bucket, total FROM z WHERE entered""",
    "capture_deltas": f"WITH {_TELEMETRY} SELECT source_idx, ts_us, packets, drops, d_packets, d_drops, round(drop_rate, 6) AS drop_rate FROM t",
    "overload_edges": f"""WITH RECURSIVE {_TELEMETRY}, n AS (SELECT *, row_number() OVER (PARTITION BY source_idx ORDER BY ts_us) AS k FROM t),
s AS (SELECT source_idx, ts_us, k, drop_rate >= 0.25 AS live, CASE WHEN drop_rate >= 0.25 THEN 'enter' END AS edge FROM n WHERE k = 1
UNION ALL SELECT n.source_idx, n.ts_us, n.k, CASE WHEN s.live THEN n.drop_rate >= 0.2 ELSE n.drop_rate >= 0.25 END, CASE WHEN s.live AND n.drop_rate < 0.2 THEN 'leave' WHEN NOT s.live AND n.drop_rate >= 0.25 THEN 'enter' END
FROM s JOIN n ON n.source_idx = s.source_idx AND n.k = s.k + 1) SELECT source_idx, ts_us, edge FROM s WHERE edge IS NOT NULL""",
    "asset_changes": f"""WITH {P}, a AS (SELECT seq, ts_us, src_ip4, last_value(CASE WHEN kind <> 'error' THEN kind END IGNORE NULLS) OVER (PARTITION BY src_ip4 ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS os, dst_port > 100 AS high FROM p),
b AS (SELECT *, row_number() OVER w AS k, lag(os) OVER w AS os_, lag(high) OVER w AS high_ FROM a WINDOW w AS (PARTITION BY src_ip4 ORDER BY ts_us, seq))
SELECT seq, ts_us, src_ip4, os, high FROM b WHERE k = 1 OR os IS DISTINCT FROM os_ OR high IS DISTINCT FROM high_""",
    "running_clock": f"WITH {P} SELECT seq, user_id % 4 AS source_idx, max(ts_us) OVER (PARTITION BY user_id % 4 ORDER BY seq ROWS UNBOUNDED PRECEDING) AS clock_us FROM p",
    "lookup_latest": f"""WITH {P}, a AS (SELECT seq, src_ip4, ts_us FROM p WHERE kind = 'purchase'), b AS (SELECT src_ip4, ts_us, max(len) AS size FROM p WHERE kind = 'view' GROUP BY ALL)
SELECT a.*, CASE WHEN a.ts_us - b.ts_us <= {12 * _H} THEN b.size END AS size, CASE WHEN a.ts_us - b.ts_us <= {12 * _H} THEN b.ts_us END AS size_us FROM a ASOF LEFT JOIN b ON a.src_ip4 = b.src_ip4 AND a.ts_us >= b.ts_us""",
    "not_followed": f"WITH {P} SELECT seq, src_ip4, ts_us FROM p a WHERE kind = 'signup' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.kind = 'purchase' AND b.src_ip4 = a.src_ip4 AND b.ts_us > a.ts_us AND b.ts_us <= a.ts_us + {2 * _D})",
    "transactions": f"""WITH {P}, u AS (SELECT seq, src_ip4, ts_us, len, CASE WHEN kind = 'view' THEN 1 ELSE 0 END AS tag FROM p WHERE kind IN ('click', 'view')),
x AS (SELECT *, lead(tag) OVER w AS tag_, lead(ts_us) OVER w AS ts_, lead(len) OVER w AS len_ FROM u WINDOW w AS (PARTITION BY src_ip4 ORDER BY ts_us, tag))
SELECT seq, src_ip4, ts_us, CASE WHEN tag_ = 1 AND ts_ - ts_us <= {12 * _H} THEN ts_ - ts_us END AS rtt_us, CASE WHEN tag_ = 1 AND ts_ - ts_us <= {12 * _H} THEN len_ END AS answer_len FROM x WHERE tag = 0""",
    "errors_within_periods": f"""WITH {P}, a AS (SELECT seq, src_ip4, ts_us FROM p WHERE kind = 'error'), b AS (SELECT src_ip4, ts_us AS from_us, ts_us + CASE WHEN seq % 3 = 0 THEN {5 * _D} ELSE {6 * _H} END AS to_us, seq AS period_seq FROM p WHERE kind = 'signup')
SELECT a.seq, a.src_ip4, a.ts_us, arg_max(period_seq, from_us) AS period_seq FROM a LEFT JOIN b ON a.src_ip4 = b.src_ip4 AND a.ts_us BETWEEN from_us AND to_us GROUP BY ALL""",
    "sequence_pattern": f"""WITH {P}, l AS (SELECT *, left(kind, 1) AS c, lag(left(kind, 1)) OVER w AS c1, lag(left(kind, 1), 2) OVER w AS c2, ts_us - lag(ts_us, 2) OVER w AS took_us FROM p WINDOW w AS (PARTITION BY src_ip4 ORDER BY ts_us, seq))
SELECT src_ip4, seq, ts_us, took_us FROM l WHERE c2 = 'v' AND c1 = 'c' AND c = 'p' AND took_us <= {2 * _D}""",
    "indicator_hosts": f"""WITH {WEB}, i(domain, reputation) AS (VALUES ('cheap-pills.example.com', 90::BIGINT), ('example.net', 20), ('blog.tionsh.example.net', 70))
SELECT page_id, http_host, domain, reputation FROM web JOIN i ON http_host = domain OR http_host LIKE '%.' || domain QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) = 1""",
    "indicator_addresses": f"""WITH {P} SELECT dst_ip4 AS ip4, seq, src_ip4, dst_ip4, 'dst' AS side, dst_ip4 % 100 AS reputation FROM p WHERE dst_ip4 % 11 = 0
UNION ALL SELECT src_ip4, seq, src_ip4, dst_ip4, 'src', src_ip4 % 100 FROM p WHERE src_ip4 % 11 = 0""",
    "port_scan": f"WITH {P} SELECT src_ip4, ts_us // {_D} AS period, count(DISTINCT dst_port) AS n_ports FROM p GROUP BY ALL HAVING n_ports >= 4",
    "scan_walk": f"""WITH {P}, s AS (SELECT src_ip4, row_number() OVER w AS nth, sum(CASE WHEN kind IN ('view', 'click') THEN -1 ELSE 1 END) OVER w * ln(4) AS score FROM p WINDOW w AS (PARTITION BY src_ip4 ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING)),
c AS (SELECT src_ip4, nth, CASE WHEN score >= ln(99) THEN 'scanner' WHEN score <= -ln(99) THEN 'benign' END AS verdict FROM s),
f AS (SELECT src_ip4, min(nth) AS nth, arg_min(verdict, nth) AS verdict FROM c WHERE verdict IS NOT NULL GROUP BY ALL)
SELECT DISTINCT p.src_ip4, coalesce(verdict, 'inconclusive') AS verdict, nth AS after FROM p LEFT JOIN f ON f.src_ip4 = p.src_ip4""",
    "beacon_scores": f"""WITH {P}, g AS (SELECT src_ip4, (ts_us - lag(ts_us) OVER (PARTITION BY src_ip4 ORDER BY ts_us, seq)) / 1e6 AS gap FROM p)
SELECT src_ip4, count(gap) AS n, round(avg(gap), 4) AS mean, round(stddev_pop(gap), 4) AS std, round(greatest(0.0, 1 - coalesce(stddev_pop(gap) / nullif(avg(gap), 0), 0)), 4) AS score FROM g GROUP BY ALL HAVING n >= 10""",
    "regular_beacons": f"""WITH {P}, g AS (SELECT src_ip4, (ts_us - lag(ts_us) OVER (PARTITION BY src_ip4 ORDER BY ts_us, seq)) / 1e6 AS gap, len FROM p),
q AS (SELECT src_ip4, count(gap) AS n, quantile_cont(gap, 0.25) AS a1, quantile_cont(gap, 0.5) AS a2, quantile_cont(gap, 0.75) AS a3, quantile_cont(len::DOUBLE, 0.25) AS b1, quantile_cont(len::DOUBLE, 0.5) AS b2, quantile_cont(len::DOUBLE, 0.75) AS b3 FROM g GROUP BY ALL),
m AS (SELECT src_ip4, quantile_cont(abs(gap - a2), 0.5) AS ma, quantile_cont(abs(len - b2), 0.5) AS mb FROM g JOIN q USING (src_ip4) GROUP BY ALL),
s AS (SELECT src_ip4, n, 1 - abs(coalesce((a1 + a3 - 2 * a2) / nullif(a3 - a1, 0), 0)) AS gap_skew, greatest(0, 1 - coalesce(ma / nullif(a2, 0), 0)) AS gap_mad,
1 - abs(coalesce((b1 + b3 - 2 * b2) / nullif(b3 - b1, 0), 0)) AS size_skew, greatest(0, 1 - coalesce(mb / nullif(b2, 0), 0)) AS size_mad FROM q JOIN m USING (src_ip4) WHERE n >= 10)
SELECT src_ip4, n, round(gap_skew, 5) AS gap_skew, round(gap_mad, 5) AS gap_mad, round(size_skew, 5) AS size_skew, round(size_mad, 5) AS size_mad, round((gap_skew + gap_mad + size_skew + size_mad) / 4, 5) AS score FROM s""",
    "host_entropy": f"""WITH {WEB}, c AS (SELECT page_id, unnest(string_split(url, '')) AS c FROM web), n AS (SELECT page_id, c, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT page_id, sum(n) AS t FROM n GROUP BY ALL),
e AS (SELECT page_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM n JOIN t USING (page_id) GROUP BY ALL)
SELECT page_id, entropy, string_split(http_host, '.')[-2] AS sld FROM web JOIN e USING (page_id)""",
    "generated_names": f"""WITH {WEB}, l AS (SELECT regexp_extract(http_host, '([^.]+)\\.example\\.', 1) AS label FROM web), x AS (SELECT '^' || label || '$' AS x, label FROM l),
b AS (SELECT substr(x, i, 2) AS pair FROM x, unnest(range(1, length(x))) AS u(i)), k AS (SELECT pair, count(*) AS c FROM b GROUP BY ALL),
w AS (SELECT pair, log10((c + 1) / (sum(c) OVER () + 1444)) AS weight FROM k), d AS (SELECT DISTINCT x, label || '.com' AS name FROM x),
s AS (SELECT name, avg(weight) AS score FROM (SELECT name, substr(x, i, 2) AS pair FROM d, unnest(range(1, length(x))) AS u(i)) JOIN w USING (pair) GROUP BY ALL)
SELECT name, round(score, 6) AS score FROM s WHERE score < -1.5""",
    "neighbour_watch": f"""WITH {P}, r AS (SELECT seq, ts_us, {_ip("dst_ip4")} AS ip, 'mac-' || (user_id // 50) AS mac, {_ip("(dst_ip4 - seq % 2)")} AS target_ip, value > 95 AS odd FROM p),
k AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= {6 * _H} THEN lag(mac) OVER w END AS known, ts_us - min(ts_us) OVER () < {_D} AS warm FROM r WINDOW w AS (PARTITION BY ip ORDER BY ts_us, seq)),
f AS (SELECT seq, ip, mac, CASE WHEN ip = '192.168.1.5' AND mac = 'mac-0' THEN NULL WHEN odd THEN 'spoof' WHEN warm THEN NULL WHEN known <> mac THEN 'binding_changed' WHEN known IS NULL THEN 'new_binding' WHEN ip = target_ip THEN 'gratuitous' END AS kind FROM k)
SELECT * FROM f WHERE kind IS NOT NULL""",
    "flow_risk": f"""WITH {P}, b AS (SELECT seq, dst_port = 80 AS c, dst_port = 8443 AS o, len > 900 AS e, dst_ip4 = 3232235783 AS k FROM p)
SELECT seq, concat_ws(',', CASE WHEN c THEN 'cleartext' END, CASE WHEN o THEN 'odd_port' END, CASE WHEN k THEN 'known_bad' END, CASE WHEN e THEN 'exfiltration' END) AS risks,
(c::INT * 1 + o::INT * 2 + k::INT * 128 + e::INT * 512)::BIGINT AS risk_bits, (c::INT * 10 + o::INT * 10 + k::INT * 100 + e::INT * 60)::BIGINT AS risk_score,
CASE WHEN k THEN 'critical' WHEN e THEN 'error' WHEN c OR o THEN 'info' END AS risk_severity FROM b""",
    "rule_matches": f"""WITH {WEB} SELECT page_id, 'pills' AS rule, 'high' AS level FROM web WHERE (http_host LIKE '%pills%' OR http_host LIKE '%casino%') AND NOT http_path LIKE '%.html'
UNION ALL SELECT page_id, 'blogs', 'medium' FROM web WHERE http_host LIKE 'blog.%' OR (regexp_matches(http_path, '^/(fr|de)/') AND http_host LIKE '%.example.org')""",
    "packet_dedup": f"""WITH RECURSIVE {P}, n AS (SELECT *, len // 100 AS size, row_number() OVER (PARTITION BY dst_ip4, len // 100 ORDER BY ts_us, seq) AS k FROM p),
r AS (SELECT k, dst_ip4, size, seq, ts_us AS last, true AS kept FROM n WHERE k = 1
UNION ALL SELECT n.k, n.dst_ip4, n.size, n.seq, CASE WHEN n.ts_us - r.last <= {_D} THEN r.last ELSE n.ts_us END, n.ts_us - r.last > {_D} FROM r JOIN n ON n.dst_ip4 = r.dst_ip4 AND n.size = r.size AND n.k = r.k + 1)
SELECT seq, dst_ip4, size FROM r WHERE kept""",
    "finding_layers": f"""WITH RECURSIVE {_FINDINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY ts_us, sev_rank) AS k FROM a WHERE sev_rank >= 1),
d AS (SELECT k, kind, key, severity, sev_rank, ts_us, ts_us AS last, true AS kept FROM n WHERE k = 1
UNION ALL SELECT n.k, n.kind, n.key, n.severity, n.sev_rank, n.ts_us, CASE WHEN n.ts_us - d.last < {3 * _D} THEN d.last ELSE n.ts_us END, n.ts_us - d.last >= {3 * _D} FROM d JOIN n ON n.kind = d.kind AND n.key = d.key AND n.k = d.k + 1),
m AS (SELECT kind, key, severity, sev_rank, ts_us, row_number() OVER (PARTITION BY kind ORDER BY ts_us, key, sev_rank) AS k FROM d WHERE kept),
l AS (SELECT *, ts_us AS begin, 1 AS c FROM m WHERE k = 1
UNION ALL SELECT m.*, CASE WHEN m.ts_us - l.begin >= {_D} THEN m.ts_us ELSE l.begin END, CASE WHEN m.ts_us - l.begin >= {_D} THEN 1 ELSE l.c + 1 END FROM l JOIN m ON m.kind = l.kind AND m.k = l.k + 1)
SELECT kind, key, ts_us, severity, sev_rank FROM l WHERE c <= 5""",
    "finding_lines": f"""WITH {_FINDINGS} SELECT kind, key, ts_us,
'{{"severity":"' || severity || '","kind":"' || kind || '","ts_secs":' || (ts_us // 1000000) || ',"ts_nanos":' || (ts_us % 1000000 * 1000) || ',"key":"' || key || '","observations":{{"dst":"' || dst_port || '","note":"a \\"b\\" ]"}},"metrics":{{"len":' || len::DOUBLE || '}}}}' AS line,
'<' || (128 + CASE severity WHEN 'info' THEN 6 WHEN 'warning' THEN 4 WHEN 'error' THEN 3 ELSE 2 END) || '>1 ' || {_ISO} || ' - tidewire - ' || kind || ' [finding@32473 key="' || key || '" dst="' || dst_port || '" note="a \\"b\\" \\]" len="' || len::DOUBLE || '"]' AS syslog,
'{{"timestamp":"' || {_ISO} || '","event_type":"anomaly","key":"' || key || '","anomaly":{{"app_proto":"custom","type":"applayer","event":"' || kind || '","severity":' || (4 - sev_rank) || '}}}}' AS eve FROM a""",
    "finding_records": f"""WITH {_FINDINGS} SELECT '{{"category_uid":2,"class_uid":2004,"activity_id":1,"type_uid":200401,"time":' || (ts_us // 1000) || ',"severity_id":' || CASE severity WHEN 'info' THEN 1 WHEN 'warning' THEN 3 WHEN 'error' THEN 4 ELSE 5 END ||
',"finding_info":{{"title":"' || kind || '","uid":"' || kind || '|' || key || '|' || ts_us || '"}},"unmapped":{{"key":"' || key || '","observations":{{"dst":"' || dst_port || '","note":"a \\"b\\" ]"}},"metrics":{{"len":' || len::DOUBLE || '}}}}}}' AS record FROM a""",
    "finding_metrics": f"WITH {_FINDINGS} SELECT kind, 'len' AS metric, count(*) AS n, sum(len)::DOUBLE AS total, quantile_cont(len::DOUBLE, 0.5) AS p50 FROM a GROUP BY ALL",
    "conversation_runs": """WITH c AS (SELECT *, length(text) AS size, lag(role) OVER w IS DISTINCT FROM role AS turned FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
d AS (SELECT *, sum(turned::INT) OVER (PARTITION BY conv_id ORDER BY turn, role, text)::BIGINT AS run FROM c) SELECT conv_id, run, role, count(*) AS n_rows, sum(size)::BIGINT AS size FROM d GROUP BY ALL""",
}
