"""What findings go through before a sink. Applied in the order given; times are event times, so reruns agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import net
from . import detect, folds

Layer = Callable[[DataFrame], DataFrame]


def min_severity(floor: str) -> Layer:
    rank = detect.SEVERITIES.index(floor)
    return lambda a: a.filter(F.col("sev_rank") >= rank)


def dedupe(window_us: int) -> Layer:
    """One finding of a kind and key within the window since the last one let through."""
    return lambda a: folds.first_in_window(a, ["kind", "key"], ["ts_us", "sev_rank"], "ts_us", window_us)


def rate_limit(most: int, period_us: int) -> Layer:
    return lambda a: folds.limit_in_window(a, ["kind"], ["ts_us", "key", "sev_rank"], "ts_us", most, period_us)


def sample(rate: float, seed: int = 0) -> Layer:
    """A share of findings by a hash of what they say, whatever their order."""
    return lambda a: a.filter(net.unit_interval(F.xxhash64(F.lit(seed), "kind", "key", "ts_us", "severity")) < rate)


def tee(write: Callable[[DataFrame], None]) -> Layer:
    """Hands the findings to a second sink as well."""

    def both(a: DataFrame) -> DataFrame:
        write(a)
        return a

    return both


def through(findings: DataFrame, *layers: Layer) -> DataFrame:
    for layer in layers:
        findings = layer(findings)
    return findings
