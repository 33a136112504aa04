"""Detectors: tables in, findings out. Constants that no public source fixes are parameters with our own defaults."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from . import folds, reports

SEVERITIES = ("info", "warning", "error", "critical")


def severity_rank(severity: Column) -> Column:
    out = None
    for i, s in enumerate(SEVERITIES):
        out = (F if out is None else out).when(severity == s, F.lit(i))
    return out


def finding(rows: DataFrame, kind: str, severity: Column | str, key: Column | str, observations: dict[str, Column] | None = None, metrics: dict[str, Column] | None = None) -> DataFrame:
    """rows (with ts_us) as findings: kind, severity, sev_rank, ts_us, key, observations, metrics."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    pairs = lambda d, t: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), v.cast(t)))) if d else F.create_map().cast(f"map<string,{t}>")
    return rows.select(F.lit(kind).alias("kind"), sev.alias("severity"), severity_rank(sev).cast("int").alias("sev_rank"), "ts_us", (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), pairs(observations or {}, "string").alias("observations"), pairs(metrics or {}, "double").alias("metrics"))


def count_alarm(rows: DataFrame, keys: list[str], threshold: int, window_us: int, bucket_us: int) -> DataFrame:
    """Buckets at which a key's rolling count exceeds the threshold; silent until it has come down to half of it."""
    r = reports.rolling(rows, keys, None, window_us, bucket_us)
    edges = folds.hysteresis(r, keys, ["bucket"], "total", threshold + 1, math.floor(threshold / 2) + 1)
    return edges.filter("edge = 'enter'").select(*keys, "bucket", "total")


def port_scan(packets: DataFrame, threshold: int, window_us: int, source: str = "src_ip4", port: str = "dst_port") -> DataFrame:
    """Sources with so many distinct ports within a tumbling window."""
    w = reports.bucket("ts_us", window_us).alias("period")
    return packets.select(source, w, port).distinct().groupBy(source, "period").agg(F.count(F.lit(1)).alias("n_ports")).filter(F.col("n_ports") >= threshold)


def walk(attempts: DataFrame, source: str, success: Column, p_good: float = 0.8, p_bad: float = 0.2, false_alarm: float = 0.01, detect: float = 0.99) -> DataFrame:
    """Sequential hypothesis test on connection attempts: the first crossing of a source's likelihood ratio, and its verdict.

    A success multiplies the ratio by p_bad / p_good, a failure by (1 - p_bad) / (1 - p_good).
    """
    step = F.when(success, F.lit(math.log(p_bad / p_good))).otherwise(F.lit(math.log((1 - p_bad) / (1 - p_good))))
    up, down = math.log(detect / false_alarm), math.log((1 - detect) / (1 - false_alarm))
    w = Window.partitionBy(source).orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    r = attempts.withColumn("score", F.sum(step).over(w)).withColumn("nth", F.row_number().over(Window.partitionBy(source).orderBy("ts_us", "seq")))
    verdict = F.when(F.col("score") >= up, "scanner").when(F.col("score") <= down, "benign")
    crossed = r.withColumn("verdict", verdict).filter("verdict IS NOT NULL")
    first = crossed.groupBy(source).agg(F.min_by(F.struct("nth", "verdict"), "nth").alias("x"))
    return attempts.select(source).distinct().join(first, source, "left").select(source, F.coalesce("x.verdict", F.lit("inconclusive")).alias("verdict"), F.col("x.nth").cast("long").alias("after"))


def _gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts_us", "seq")
    return rows.withColumn("gap", (F.col("ts_us") - F.lag("ts_us").over(w)) / F.lit(1e6))


def beacons(rows: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Per key: 1 less the coefficient of variation of the times between its rows, at least 0; only keys with so many gaps."""
    g = _gaps(rows, keys).groupBy(*keys).agg(F.count("gap").alias("n"), F.mean("gap").alias("mean"), F.stddev_pop("gap").alias("std"))
    return g.filter(F.col("n") >= least).withColumn("score", F.greatest(F.lit(0.0), F.lit(1.0) - net.ratio(F.col("std"), F.col("mean"))))


def _shape(parts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Bowley skewness and median absolute deviation of a value by key, as two scores in [0, 1]."""
    q = parts.groupBy(*keys).agg(*(F.percentile(value, p).alias(f"q{i}") for i, p in enumerate((0.25, 0.5, 0.75), 1)), F.count(value).alias("n"))
    skew = net.ratio(F.col("q1") + F.col("q3") - 2 * F.col("q2"), F.col("q3") - F.col("q1"))
    far = parts.join(q.select(*keys, "q2"), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("q2")), 0.5).alias("mad"))
    return q.withColumn("skew", F.lit(1.0) - F.abs(skew)).join(far, keys).select(*keys, "n", F.col("skew").alias(f"{value}_skew"), F.greatest(F.lit(0.0), F.lit(1.0) - net.ratio(F.col("mad"), F.col("q2"))).alias(f"{value}_mad"))


def regular_beacons(rows: DataFrame, keys: list[str], size: str, least: int = 10) -> DataFrame:
    """Beacons by the shape of their gaps and sizes: the mean of four scores."""
    gaps = _gaps(rows, keys).filter("gap IS NOT NULL")
    both = _shape(gaps, keys, "gap").join(_shape(rows.withColumn("size", F.col(size).cast("double")), keys, "size").drop("n"), keys)
    return both.filter(F.col("n") >= least).withColumn("score", (F.col("gap_skew") + F.col("gap_mad") + F.col("size_skew") + F.col("size_mad")) / 4)


def bigram_table(names: DataFrame, name: str) -> DataFrame:
    """log10 frequency of letter pairs (with ^ and $ at the ends) of benign names, add-one smoothed over 38 x 38 pairs."""
    pairs = names.select(F.explode(_pairs(F.col(name))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("c"))
    total = (counts.agg(F.sum("c")).first()[0] or 0) + 38 * 38
    return counts.select("pair", F.log10((F.col("c") + 1) / F.lit(float(total))).alias("weight"), F.lit(-math.log10(total)).alias("unseen"))


def _pairs(label: Column) -> Column:
    x = F.concat(F.lit("^"), F.lower(label), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))


def generated_names(names: DataFrame, name: str, table: DataFrame, below: float = -2.6) -> DataFrame:
    """Names whose second-level label's mean pair weight lies below a limit. Distinct names are scored once."""
    unseen = table.agg(F.min("unseen")).first()[0] or -math.log10(38 * 38)
    each = names.select(name).distinct().withColumn("pair", F.explode(_pairs(net.second_level(F.col(name)))))
    scored = each.join(F.broadcast(table.select("pair", "weight")), "pair", "left").groupBy(name).agg(F.mean(F.coalesce("weight", F.lit(unseen))).alias("score"))
    return scored.filter(F.col("score") < below)


def tunnels(names: DataFrame, name: str, least_entropy: float = 3.5, least_chars: int = 20) -> DataFrame:
    """Names whose first label is long, encoded-looking and of high entropy."""
    label = F.get(F.split(F.col(name), r"\."), 0)
    r = names.withColumns({"label": label, "entropy": net.entropy(label)})
    return r.filter((F.length("label") >= least_chars) & F.col("label").rlike(r"^[A-Za-z0-9+/=_-]+$") & (F.col("entropy") >= least_entropy))


def neighbours(rows: DataFrame, ttl_us: int = 1_200_000_000, warm_us: int = 5_000_000, allow: dict[str, str] | None = None, gratuitous: bool = False, new: bool = False, is_spoof: Column | None = None) -> DataFrame:
    """Address bindings (seq, ts_us, ip, mac, target_ip, ...) as findings, at most one a row: spoof, then changed, then new, then gratuitous.

    A binding older than ttl_us is forgotten. Within warm_us of the table's first row only spoofs
    are told. An allowed pair is silent. A spoof still teaches its binding.
    """
    w = Window.partitionBy("ip").orderBy("ts_us", "seq")
    known = F.when(F.col("ts_us") - F.lag("ts_us").over(w) <= ttl_us, F.lag("mac").over(w))
    begin = rows.agg(F.min("ts_us")).first()[0] or 0
    r = rows.withColumn("known", known)
    warm = F.col("ts_us") - begin < warm_us
    allowed = F.lit(False)
    for ip, mac in (allow or {}).items():
        allowed = allowed | ((F.col("ip") == ip) & (F.col("mac") == mac))
    spoof = F.coalesce(is_spoof, F.lit(False)) if is_spoof is not None else F.lit(False)
    kind = F.when(allowed, None).when(spoof, "spoof").when(warm, None).when(F.col("known") != F.col("mac"), "binding_changed")
    kind = kind.when(F.col("known").isNull() & F.lit(new), "new_binding").when((F.col("ip") == F.col("target_ip")) & F.lit(gratuitous), "gratuitous")
    return r.withColumn("kind", kind).filter("kind IS NOT NULL")


#: name: (weight, severity); a flow's score is the sum of its weights.
RISKS = {"cleartext": (10, "info"), "odd_port": (10, "info"), "self_signed": (40, "warning"), "old_tls": (40, "warning"), "no_sni": (20, "info"), "reset": (10, "info"), "long_name": (30, "warning"), "known_bad": (100, "critical"), "generated_name": (60, "error"), "exfiltration": (60, "error"), "doh": (20, "info"), "beacon": (60, "error"), "scan": (60, "error"), "tunnel": (70, "error")}


def flow_risk(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """rows with ``risks`` (names joined), ``risk_bits``, ``risk_score`` and ``risk_severity``, the highest of all flags that hold."""
    order = list(RISKS)
    held = {n: F.coalesce(c, F.lit(False)) for n, c in sorted(flags.items(), key=lambda x: order.index(x[0]))}
    names = F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in held.items()))), ",")
    bits, score, rank = F.lit(0), F.lit(0), F.lit(-1)
    for n, c in held.items():
        bits = bits + F.when(c, F.lit(1 << order.index(n))).otherwise(F.lit(0))
        score = score + F.when(c, F.lit(RISKS[n][0])).otherwise(F.lit(0))
        rank = F.greatest(rank, F.when(c, F.lit(SEVERITIES.index(RISKS[n][1]))).otherwise(F.lit(-1)))
    label = F.get(F.array(*map(F.lit, SEVERITIES)), rank)
    return rows.withColumns({"risks": names, "risk_bits": bits.cast("long"), "risk_score": score.cast("long"), "risk_severity": F.when(rank >= 0, label)})


#: Categories and the fields their rules may name, with the column that holds each.
SIGMA_FIELDS = {
    "dns": {"query": "dns_qname", "rcode": "dns_rcode"},
    "http": {"c-uri": "http_path", "cs-host": "http_host", "cs-method": "http_method", "c-useragent": "http_agent"},
    "tls": {"sni": "sni", "ja3": "ja3"},
}


def _test(column: Column, modifiers: list[str], value) -> Column:
    text = F.lower(column.cast("string"))
    low = str(value).lower()
    if "re" in modifiers:
        return column.rlike(str(value))
    if "cidr" in modifiers:
        return net.in_cidr(column, str(value))
    for name, test in (("contains", text.contains), ("startswith", text.startswith), ("endswith", text.endswith)):
        if name in modifiers:
            return test(low)
    return column.isNull() if value is None else net.glob(column.cast("string"), str(value))


def rule_condition(rule: dict, name: str) -> tuple[Column, str]:
    """A detection rule (logsource.category, detection with selections and a condition) as a struct of selections and a Spark SQL condition over column ``name``.

    A selection is a mapping of field|modifier to a value or a list of them (any; all with the
    modifier ``all``), or a list of such mappings (any). The condition joins selections by and, or,
    not and parentheses, with ``1 of x*`` and ``all of x*``; Spark itself reads it.
    """
    category = rule["logsource"]["category"]
    if category not in SIGMA_FIELDS:
        raise ValueError(f"no such category: {category}")

    def mapping(body: dict) -> Column:
        out = F.lit(True)
        for key, values in body.items():
            field, *modifiers = key.split("|")
            column = F.col(SIGMA_FIELDS[category].get(field, field))
            tests = [F.coalesce(_test(column, modifiers, v), F.lit(False)) for v in (values if isinstance(values, list) else [values])]
            one = tests[0]
            for t in tests[1:]:
                one = one & t if "all" in modifiers else one | t
            out = out & one
        return out

    columns = {}
    for n, body in rule["detection"].items():
        if n != "condition":
            parts = [mapping(b) for b in (body if isinstance(body, list) else [body])]
            columns[n] = parts[0]
            for p in parts[1:]:
                columns[n] = columns[n] | p
    text = rule["detection"]["condition"]

    def spread(m: re.Match) -> str:
        names = [n for n in columns if m[2] == "them" or re.fullmatch(m[2].replace("*", ".*"), n)]
        if not names:
            raise ValueError(f"no selection is named {m[2]}")
        return "(" + (" or " if m[1] == "1" else " and ").join(names) + ")"

    text = re.sub(r"\b(1|all) of ([\w*]+)", spread, text)
    if unknown := set(re.findall(r"\w+", text)) - set(columns) - {"and", "or", "not"}:
        raise ValueError(f"unknown in the condition: {sorted(unknown)}")
    return F.struct(*(c.alias(n) for n, c in columns.items())), re.sub(r"\b(?!(?:and|or|not)\b)(\w+)\b", rf"{name}.\1", text)


def rule_matches(rows: DataFrame, rules: list[dict], key: str) -> DataFrame:
    """One row a row and rule that holds: the key, rule's title and level. One pass over the rows for all rules."""
    made = [rule_condition(r, f"rule_{i}_") for i, r in enumerate(rules)]
    state = rows.withColumns({f"rule_{i}_": c for i, (c, _) in enumerate(made)})
    hits = F.array_compact(F.array(*(F.when(F.expr(text), F.struct(F.lit(r["title"]).alias("rule"), F.lit(r.get("level", "medium")).alias("level"))) for r, (_, text) in zip(rules, made, strict=True))))
    return state.select(key, F.explode(hits).alias("r")).select(key, "r.*")


def signatures(rows: DataFrame, body: str, strings: dict[str, bytes], key: str) -> DataFrame:
    """Rows whose binary body holds any of the byte strings: key and the names that hit."""
    found = F.array_compact(F.array(*(F.when(F.col(body).contains(F.lit(s)), F.lit(n)) for n, s in strings.items())))
    return rows.select(key, found.alias("hits")).filter(F.size("hits") > 0)


def overload(samples: DataFrame, by: str = "source_idx", value: str = "drop_rate", enter: float = 0.05, leave: float = 0.01, calm: int = 3) -> DataFrame:
    """Edges of overload: entered at a drop rate, left after so many calm samples."""
    return folds.hysteresis(samples, [by], ["ts_us"], value, enter, leave, calm).filter("edge IS NOT NULL")


def shed(rows: DataFrame, key: Column, keep: float) -> DataFrame:
    """The share ``keep`` of keys, told by their hash: a key is kept whole or not at all."""
    return rows.filter(net.unit_interval(F.xxhash64(key)) < keep)


#: Techniques of a public catalogue of attacks.
TECHNIQUES = {"port_scan": "T1046", "beacon": "T1071", "dga": "T1568.002", "dns_tunnel": "T1071.004", "arp_spoof": "T1557.002", "brute_force": "T1110", "exfiltration": "T1041", "syn_flood": "T1498", "smb_admin_share": "T1021.002", "kerberoast": "T1558.003", "rdp_login": "T1021.001"}


def tagged(findings: DataFrame) -> DataFrame:
    technique = F.try_element_at(F.create_map(*(F.lit(x) for kv in TECHNIQUES.items() for x in kv)), F.col("kind"))
    added = F.map_concat("observations", F.when(technique.isNotNull(), F.create_map(F.lit("attack_technique"), technique)).otherwise(F.create_map().cast("map<string,string>")))
    return findings.withColumn("observations", added)
