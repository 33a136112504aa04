"""Sequential folds by key, for state that later rows depend on: limits, hysteresis, smoothing.

Rows are dealt by key and sorted within their partition, which spills; the fold then sees one row
at a time and holds one state, so a key of any size needs no more memory than a small one. Such a
fold is a chain: one key's rows go through one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
_SPARK = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}


def fold(rows: DataFrame, keys: list[str], order: list[str], fields: list[str], start: Callable, step: Callable, out: dict[str, str]) -> DataFrame:
    """rows with the columns ``out`` (name: long, double, boolean or string).

    step(state, *fields) gives the next state and the row's values of out; start() is a key's first state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        fresh = True
        for batch in batches:
            if not batch.num_rows:
                continue
            got = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, *fields)]
            for row in zip(*columns, strict=True):
                if fresh or row[: len(keys)] != key:
                    key, state, fresh = row[: len(keys)], start(), False
                state, values = step(state, *row[len(keys) :])
                got.append(values)
            more = [pa.array(v, _ARROW[t]) for v, t in zip(zip(*got, strict=True), out.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *out])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, _SPARK[t]) for n, t in out.items())])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def ewma(rows: DataFrame, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """rows with ``ewma``: alpha x + (1 - alpha) times the one before; a key's first value seeds it."""

    def step(v, x):
        v = float(x) if v is None else alpha * x + (1 - alpha) * v
        return v, (v,)

    return fold(rows, keys, order, [value], lambda: None, step, {"ewma": "double"})


def ewma_var(rows: DataFrame, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """rows with ``ewma`` and ``ewma_var``, the exponentially weighted variance about it: (1 - alpha) (var + alpha (x - mean)^2)."""

    def step(state, x):
        if state is None:
            return (float(x), 0.0), (float(x), 0.0)
        mean, var = state
        d = x - mean
        mean, var = mean + alpha * d, (1 - alpha) * (var + alpha * d * d)
        return (mean, var), (mean, var)

    return fold(rows, keys, order, [value], lambda: None, step, {"ewma": "double", "ewma_var": "double"})


def token_bucket(rows: DataFrame, keys: list[str], order: list[str], ts_us: str, rate: float, burst: float) -> DataFrame:
    """rows with ``delay_us``, the wait until a token is there, and ``tokens`` left after taking one (below 0: owed)."""

    def step(state, t):
        left, last = state
        left = burst if last is None else min(burst, left + (t - last) / 1e6 * rate)
        left -= 1
        return (left, t), (int(max(0.0, -left) / rate * 1e6), left)

    return fold(rows, keys, order, [ts_us], lambda: (burst, None), step, {"delay_us": "long", "tokens": "double"})


def hysteresis(rows: DataFrame, keys: list[str], order: list[str], value: str, enter: float, leave: float, calm: int = 1) -> DataFrame:
    """rows with ``edge``: "enter" when value reaches ``enter``, "leave" when it has stayed below ``leave`` for ``calm`` rows; else null."""

    def step(state, x):
        active, quiet = state
        if not active:
            return ((True, 0), ("enter",)) if x is not None and x >= enter else ((False, 0), (None,))
        quiet = quiet + 1 if x is not None and x < leave else 0
        return ((False, 0), ("leave",)) if quiet >= calm else ((True, quiet), (None,))

    return fold(rows, keys, order, [value], lambda: (False, 0), step, {"edge": "string"})


def first_in_window(rows: DataFrame, keys: list[str], order: list[str], ts_us: str, window_us: int, inclusive: bool = False) -> DataFrame:
    """rows less those within the window since the last one that was kept; dropped rows do not extend it.

    inclusive: a row exactly one window later is dropped as well.
    """

    def step(last, t):
        dropped = last is not None and (t - last <= window_us if inclusive else t - last < window_us)
        return (last if dropped else t), (not dropped,)

    return fold(rows, keys, order, [ts_us], lambda: None, step, {"kept": "boolean"}).filter("kept").drop("kept")


def limit_in_window(rows: DataFrame, keys: list[str], order: list[str], ts_us: str, most: int, period_us: int) -> DataFrame:
    """The first ``most`` rows of each window; a window starts at the first row after the last one's end."""

    def step(state, t):
        begin, n = state
        if begin is None or t - begin >= period_us:
            begin, n = t, 0
        return (begin, n + 1), (n < most,)

    return fold(rows, keys, order, [ts_us], lambda: (None, 0), step, {"kept": "boolean"}).filter("kept").drop("kept")
