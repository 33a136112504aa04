"""Correlation of two tables, or of a table with itself, by key and time.

Everything that looks back no further than a time to live is dealt by key and stretch of time, the
looked-up side copied to the stretch after its own. So a hot key is split over time, and no pairs
of rows are emitted where one match per row is asked for.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from . import folds

#: Tables of up to so many rows are broadcast when joined as a dimension; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def dimension(table: DataFrame) -> DataFrame:
    """The table, broadcast if it is small; it is counted only as far as the limit."""
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(table) if few else table


def latest(rows: DataFrame, updates: DataFrame, keys: list[str], value: str, ttl_us: int) -> DataFrame:
    """rows with the ``value`` and ``value_us`` of the last update of their key not older than the time to live (inclusive); null without one.

    An update at a row's own time counts. Of updates at the same time the largest value is the last.
    """
    stretch = F.floor(F.col("ts_us") / (ttl_us + 1))
    left = rows.withColumn("row_", F.struct(*rows.columns)).select(*keys, "ts_us", stretch.alias("stretch"), F.lit(1).alias("tag"), "row_", F.lit(None).cast(updates.schema[value].dataType).alias("value_"))
    right = updates.select(*keys, "ts_us", F.explode(F.array(stretch, stretch + 1)).alias("stretch"), F.lit(0).alias("tag"), F.lit(None).cast(left.schema["row_"].dataType).alias("row_"), F.col(value).alias("value_"))
    w = Window.partitionBy(*keys, "stretch").orderBy("ts_us", "tag", "value_").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("tag") == 0, F.struct("ts_us", "value_")), ignorenulls=True).over(w)
    fresh = F.when(F.col("ts_us") - F.col("at.ts_us") <= ttl_us, F.col("at"))
    out = left.unionByName(right).withColumn("at", at).filter("tag = 1").withColumn("at", fresh)
    return out.select("row_.*", F.col("at.value_").alias(value), F.col("at.ts_us").alias(f"{value}_us"))


def not_followed(a: DataFrame, b: DataFrame, keys: list[str], ttl_us: int) -> DataFrame:
    """Rows of a whose key has no row of b later than it by at most the time to live.

    Both go by once from the latest time on, each row of a with the time of b last met; b is thinned to distinct times first.
    """
    stretch = F.floor(F.col("ts_us") / (ttl_us + 1))
    left = a.select(*keys, "ts_us", stretch.alias("stretch"), F.lit(0).alias("tag"), F.struct(*a.columns).alias("row_"))
    right = b.select(*keys, "ts_us").distinct().select(*keys, "ts_us", F.explode(F.array(stretch, stretch - 1)).alias("stretch"), F.lit(1).alias("tag"), F.col("ts_us").alias("b_us"))
    w = Window.partitionBy(*keys, "stretch").orderBy(F.desc("ts_us"), "tag").rowsBetween(Window.unboundedPreceding, 0)
    met = left.unionByName(right, allowMissingColumns=True).withColumn("met", F.last("b_us", ignorenulls=True).over(w)).filter("tag = 0")
    return met.filter(~F.coalesce(F.col("met") - F.col("ts_us") <= ttl_us, F.lit(False))).select("row_.*")


def paired(a: DataFrame, b: DataFrame, keys: list[str], timeout_us: int, keep: list[str]) -> DataFrame:
    """Requests a with their response: the first row of b of the key in [ts, ts + timeout] before the key's next request; else null.

    A row of b answers one request only. Both sides go by in order once, by key and stretch of the timeout, with
    copies of the stretch after it: the next row can lie there.
    """
    first = a.select(*keys, "ts_us", F.lit(0).alias("tag"), F.struct(*a.columns).alias("row_"), F.lit(None).cast("struct<" + ",".join(f"{c}:{b.schema[c].dataType.simpleString()}" for c in ["ts_us", *keep]) + ">").alias("answer_"))
    second = b.select(*keys, "ts_us", F.lit(1).alias("tag"), F.lit(None).cast(first.schema["row_"].dataType).alias("row_"), F.struct("ts_us", *keep).alias("answer_"))
    own = F.floor(F.col("ts_us") / (timeout_us + 1))
    both = first.unionByName(second).withColumn("own_", own).withColumn("stretch_", F.explode(F.array("own_", F.col("own_") - 1)))
    w = Window.partitionBy(*keys, "stretch_").orderBy("ts_us", "tag", F.col("row_").isNull(), F.hash("row_", "answer_"))
    both = both.withColumns({"next_tag": F.lead("tag").over(w), "next_": F.lead("answer_").over(w)})
    got = F.when((F.col("next_tag") == 1) & (F.col("next_.ts_us") - F.col("ts_us") <= timeout_us), F.col("next_"))
    out = both.filter("tag = 0 AND stretch_ = own_").withColumn("got", got)
    return out.select("row_.*", (F.col("got.ts_us") - F.col("row_.ts_us")).alias("rtt_us"), *(F.col(f"got.{c}").alias(f"answer_{c}") for c in keep))


def _uppermost(state: list, at: int, opens: bool, begin: int, number: int) -> tuple[list, tuple]:
    """A step over the bounds of periods: the latest begun of those open, in order of begin and number."""
    if opens:
        bisect.insort(state, (begin, number))
    else:
        state.remove((begin, number))
    return state, (state[-1][1] if state else None,)


#: The last microsecond there is: periods may end there, that is, until further notice.
FOREVER = (1 << 63) - 1


def within(rows: DataFrame, periods: DataFrame, keys: list[str], start: str, end: str, keep: list[str], stretch_us: int = 86_400_000_000) -> DataFrame:
    """rows with the columns ``keep`` of the latest begun period of their key that holds their time, ends included; null without one.

    Of periods begun at once any may be the latest, but the same for all rows; those that end before they begin hold nothing. An end may be as far as ``FOREVER``; a null one
    is that. The bounds of a key's periods, in order, say where which one is uppermost: a table of segments, in which rows look up
    the last one begun. Rows are dealt by key and stretch of time, so those of a hot key are split: a stretch is handed the segments that begin in it and the one that
    reaches into it, which is found for each stretch that has rows, not for each that a period touches.
    """
    p = periods.withColumn("until_", F.coalesce(F.col(end).cast("long"), F.lit(FOREVER))).filter(F.col("until_") >= F.col(start))
    p = p.select(*keys, F.col(start).cast("long").alias("begin_"), F.col("until_").alias("end_"), F.struct(*keep).alias("kept_"))
    p = p.withColumn("number_", F.xxhash64("end_", "kept_"))
    bound = lambda at, opens: F.struct(at.alias("at_"), F.lit(opens).alias("opens_"))
    closing = F.when(F.col("end_") < FOREVER, bound(F.when(F.col("end_") < FOREVER, F.col("end_")).otherwise(0) + 1, False))
    bounds = p.withColumn("bound_", F.explode(F.array_compact(F.array(bound(F.col("begin_"), True), closing)))).select(*keys, "bound_.*", "begin_", "number_")
    top = folds.fold(bounds, keys, ["at_", "opens_", "begin_", "number_"], ["at_", "opens_", "begin_", "number_"], list, _uppermost, {"top_": "long"})
    by_time = Window.partitionBy(*keys).orderBy("at_")
    # of bounds at one time the last in the fold's order tells what is uppermost then
    segments = top.groupBy(*keys, "at_").agg(F.max_by("top_", F.struct("opens_", "begin_", "number_")).alias("top_"))
    segments = segments.withColumn("until_", F.coalesce(F.lead("at_").over(by_time) - 1, F.lit(FOREVER))).filter("top_ IS NOT NULL")
    stretch = lambda c: F.floor(F.col(c) / stretch_us)
    segments = segments.join(p.dropDuplicates([*keys, "number_"]).select(*keys, F.col("number_").alias("top_"), "kept_"), [*keys, "top_"])
    segments = segments.select(*keys, F.col("at_").alias("ts_us"), F.struct("until_", "kept_").alias("period_"))
    left = rows.select(*keys, "ts_us", F.struct(*rows.columns).alias("row_"), stretch("ts_us").alias("stretch"), F.lit(1).alias("tag"))
    touched = left.select(*keys, "stretch").distinct().select(*keys, (F.col("stretch") * stretch_us).alias("ts_us"), "stretch")
    running = Window.partitionBy(*keys).orderBy("ts_us", F.col("stretch").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    reaching = segments.unionByName(touched, allowMissingColumns=True).withColumn("period_", F.last("period_", ignorenulls=True).over(running)).filter("stretch IS NOT NULL AND period_ IS NOT NULL")
    right = segments.withColumn("stretch", stretch("ts_us")).unionByName(reaching).withColumn("tag", F.lit(0))
    w = Window.partitionBy(*keys, "stretch").orderBy("ts_us", "tag").rowsBetween(Window.unboundedPreceding, 0)
    at = left.unionByName(right, allowMissingColumns=True).withColumn("at", F.last("period_", ignorenulls=True).over(w)).filter("tag = 1")
    inside = F.col("ts_us") <= F.col("at.until_")
    return at.select("row_.*", *(F.when(inside, F.col(f"at.kept_.{c}")).alias(c) for c in keep))


def indicator_hosts(rows: DataFrame, name: str, indicators: DataFrame) -> DataFrame:
    """rows whose name is an indicator's domain or lies below one, with the longest such ``domain`` and its ``reputation``.

    Names are made distinct before they are expanded to their parents, so a frequent one is looked up once.
    """
    names = rows.select(name).filter(F.col(name).isNotNull()).distinct()
    bad = indicators.select(net.bare_name(F.col("domain")).alias("domain"), "reputation")
    hits = names.withColumn("domain", F.explode(net.label_suffixes(F.col(name)))).join(dimension(bad), "domain")
    best = hits.groupBy(name).agg(F.max_by(F.struct("domain", "reputation"), F.struct(F.length("domain"), "reputation")).alias("hit"))
    return rows.join(best, name).select(*rows.columns, "hit.*")


def indicator_addresses(rows: DataFrame, indicators: DataFrame) -> DataFrame:
    """One row a side of rows whose address is an indicator's: the destination's and the source's. Indicators have ``ip4`` numbers, or ``ip`` as text of either family."""
    side = lambda name, *columns: F.struct(F.lit(name).alias("side"), *columns)
    if "ip" not in indicators.columns:
        sides = F.array(*(side(x, F.col(f"{x}_ip4").alias("ip4")) for x in ("dst", "src")))
        return rows.withColumn("s", F.explode(sides)).select(*rows.columns, "s.side", "s.ip4").join(dimension(indicators), "ip4")
    octets = lambda x: net.ip_octets(F.col(f"{x}_ip4"), F.col(f"{x}_ip6") if f"{x}_ip6" in rows.columns else None)
    bad = indicators.withColumn("octets_", F.coalesce(net.ip_octets(net.ip4_number(F.col("ip"))), net.ip6_bytes(F.col("ip"))))
    each = rows.withColumn("s_", F.explode(F.array(*(side(x, octets(x).alias("octets_")) for x in ("dst", "src"))))).select(*rows.columns, "s_.*")
    return each.join(dimension(bad), "octets_").drop("octets_")


def indicator_fingerprints(rows: DataFrame, kinds: list[str], indicators: DataFrame) -> DataFrame:
    """One row a fingerprint of rows (columns named by ``kinds``, such as ja3 and ja4) that is an indicator's (fingerprint, reputation); case does not count."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("fingerprint_kind"), F.lower(k).alias("fingerprint")) for k in kinds)))
    bad = indicators.select(F.lower("fingerprint").alias("fingerprint"), "reputation").groupBy("fingerprint").agg(F.max("reputation").alias("reputation"))
    return rows.withColumn("f_", each).select(*rows.columns, "f_.*").join(dimension(bad), "fingerprint").select(*rows.columns, "fingerprint_kind", "fingerprint", "reputation")


def reloaded(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Indicators as they stood at each row's time: versions (domain, since_us, until_us or null) on rows (ts_us, domain)."""
    v = versions.select("domain", "since_us", F.coalesce("until_us", F.lit((1 << 63) - 1)).alias("until_us"))
    return rows.join(dimension(v), "domain").filter("ts_us >= since_us AND ts_us < until_us").drop("since_us", "until_us")


def sequences(rows: DataFrame, keys: list[str], letter: Column, pattern: str, window_us: int) -> DataFrame:
    """Events that end the pattern, a string of letters, within the window.

    Only adjacent events of a key match, one letter each in order: another event in between breaks the pattern. With other events between: ``patterns.matches``.
    """
    if not re.fullmatch(r"[A-Za-z]+", pattern):
        raise ValueError("a pattern is a string of letters")
    n = len(pattern)
    w = Window.partitionBy(*keys).orderBy("ts_us", "seq")
    recent = F.concat_ws("", *(F.lag("letter_", k).over(w) for k in range(n - 1, 0, -1)), F.col("letter_"))
    r = rows.withColumn("letter_", letter).withColumns({"recent_": recent, "since_": F.col("ts_us") - F.lag("ts_us", n - 1).over(w) if n > 1 else F.lit(0)})
    return r.filter((F.col("recent_") == pattern) & (F.col("since_") <= window_us)).select(*keys, "seq", "ts_us", F.col("since_").cast("long").alias("took_us"))
