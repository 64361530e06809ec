"""Rolling functions along one code's history (partition = code, order = dt).

A panel holds one row per (code, dt), so a code's group is never longer than the
calendar: these windows stay bounded however many raw rows a code has.

``length`` (see :func:`history_length`) turns on the short-history rule: a code with fewer
rows than the window uses its whole history as the window.
``compat`` turns on the zero-filled family: nulls count as 0 and the first n-1 rows are 0.
``over`` places one window expression; the formula frame passes its own to compute each
distinct window once per level and to finish the arithmetic on plain columns. If it has a method
``rolled(kernel, inputs, n)``, statistics whose frames cost n steps a row come from there
(see :mod:`tessera.functions.kernels`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CODE, DT = "code", "dt"
NOISE = 1e-9


@lru_cache(maxsize=None)
def _spec(session: int, n: int | None) -> WindowSpec:
    ordered = Window.partitionBy(CODE).orderBy(DT)
    return ordered if n is None else ordered.rowsBetween(-(n - 1), 0)


def spread(df: DataFrame, keys: Sequence[str] = (CODE,)) -> DataFrame:
    """Rows by code, or other keys, in as many tasks as the session shuffles to: windows and folds cost far more than their rows' bytes say."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def history() -> WindowSpec:
    return _spec(id(SparkContext._active_spark_context), None)


def rows(n: float) -> WindowSpec:
    return _spec(id(SparkContext._active_spark_context), int(n))


def upto() -> WindowSpec:
    return history().rowsBetween(Window.unboundedPreceding, 0)


def place(value: Column, n: float | None) -> Column:
    """``value`` over the last n rows, or over the ordered history when n is None."""
    return value.over(history() if n is None else rows(n))


def history_length() -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(CODE))


def _need(n: float, length: Column | None) -> Column:
    return F.lit(int(n)) if length is None else F.least(F.lit(int(n)), length)


def _rolled(over, kernel: str, inputs: Sequence[Column], n: float) -> Column | None:
    """The statistic from the frame's kernels, if it has any."""
    return over.rolled(kernel, inputs, int(n)) if hasattr(over, "rolled") else None


def when_full(x: Column, n: float, value: Column, length: Column | None = None, over=place, kernel: str | None = None) -> Column:
    """``value`` over the last n rows, NULL unless all of them carry an ``x``; ``kernel`` names the same statistic."""
    found = _rolled(over, kernel, [x], n) if kernel else None
    if found is not None:
        return F.when(_rolled(over, "count", [x], n) == _need(n, length), found)
    return F.when(over(F.count(x), n) == _need(n, length), over(value, n))


def _zero_until(n: float, value: Column, length: Column | None, over) -> Column:
    return F.when(over(F.row_number(), None) < _need(n, length), F.lit(0.0)).otherwise(value)


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def delay(x: Column, k: float = 1, over=place) -> Column:
    return over(F.lag(x, int(k)), None)


def delta(x: Column, k: float = 1, over=place) -> Column:
    return x - delay(x, k, over)


def ts_sum(x: Column, n: float = 10, length: Column | None = None, over=place) -> Column:
    return when_full(x, n, F.sum(x), length, over, "sum")


def mean(x: Column, n: float = 10, length: Column | None = None, over=place) -> Column:
    return when_full(x, n, F.avg(x), length, over, "mean")


def stddev(x: Column, n: float = 10, length: Column | None = None, over=place) -> Column:
    return when_full(x, n, F.stddev_pop(x), length, over, "stddev")


def ts_min(x: Column, n: float = 10, length: Column | None = None, over=place) -> Column:
    return when_full(x, n, F.min(x), length, over, "min")


def ts_max(x: Column, n: float = 10, length: Column | None = None, over=place) -> Column:
    return when_full(x, n, F.max(x), length, over, "max")


def ts_argmax(x: Column, n: float = 10, length: Column | None = None, over=place) -> Column:
    """Rows since the maximum; the most recent one wins a tie."""
    values = over(F.collect_list(x), n)
    since = F.array_position(F.reverse(values), F.array_max(values)) - 1
    return F.when(F.size(values) == _need(n, length), since.cast("double"))


def ts_argmin(x: Column, n: float = 10, length: Column | None = None, over=place) -> Column:
    values = over(F.collect_list(x), n)
    since = F.array_position(F.reverse(values), F.array_min(values)) - 1
    return F.when(F.size(values) == _need(n, length), since.cast("double"))


def _less_equal(x: Column, n: float, over) -> tuple[Column, Column, Column]:
    values = over(F.collect_list(x), n)
    less = F.size(F.filter(values, lambda v: v < x))
    same = F.size(F.filter(values, lambda v: v == x))
    return less, same, F.size(values)


def ts_rank(x: Column, n: float = 10, length: Column | None = None, over=place) -> Column:
    """Rank of the last value inside its window, scaled to [-1, 1]."""
    found = _rolled(over, "rank", [x], n)
    if found is not None:
        return F.when((_rolled(over, "count", [x], n) == _need(n, length)) & x.isNotNull(), found)
    less, same, size = _less_equal(x, n, over)
    scaled = 2 * (F.try_divide(less + (same - 1) / 2.0, (size - 1).cast("double")) - 0.5)
    return F.when((size == _need(n, length)) & x.isNotNull(), F.coalesce(scaled, F.lit(0.0)))


def rolling_rank(x: Column, n: float = 10, length: Column | None = None, over=place) -> Column:
    less, same, size = _less_equal(x, n, over)
    return F.when(size == _need(n, length), less + (same + 1) / 2.0)


def _pairs(x: Column, y: Column, n: float, over) -> Column:
    return over(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)), n) == int(n)


def correlation(x: Column, y: Column, n: float = 10, over=place) -> Column:
    """Rolling Pearson; NULL until n complete pairs and where a side does not vary.

    Rounded to nine decimals so that float noise cannot split ties in a later rank.
    """
    found = _rolled(over, "correlation", [x, y], n)
    if found is not None:
        return F.round(found, 9)
    sx, sy = over(F.stddev_pop(x), n), over(F.stddev_pop(y), n)
    value = F.try_divide(over(F.covar_pop(x, y), n), sx * sy)
    return F.when(_pairs(x, y, n, over) & (sx > NOISE) & (sy > NOISE), F.round(value, 9))


def covariance(x: Column, y: Column, n: float = 10, over=place) -> Column:
    found = _rolled(over, "covariance", [x, y], n)
    if found is not None:
        return F.round(found, 11)
    return F.when(_pairs(x, y, n, over), F.round(over(F.covar_samp(x, y), n), 11))


def product(x: Column, n: float = 10, length: Column | None = None, compat: bool = False, over=place) -> Column:
    if not compat:
        return when_full(x, n, F.product(x), length, over)
    return _zero_until(n, over(F.product(zero(x)), n), length, over)


def _weighted(values: Column, weight) -> Column:
    """Sum of the window's values times ``weight(position)``, oldest value first."""
    return F.aggregate(F.transform(values, lambda v, i: v * weight(i)), F.lit(0.0), lambda total, v: total + v)


def decay_linear(
    x: Column, n: float = 10, length: Column | None = None, compat: bool = False, newest_heavy: bool = False, over=place
) -> Column:
    """Linearly weighted mean. The oldest row weighs most unless ``newest_heavy``."""
    size = _need(n, length)
    total = _rolled(over, "decay", [zero(x)], n) if compat and not newest_heavy else None
    if total is None:
        values = over(F.collect_list(zero(x) if compat else x), n)
        total = _weighted(values, (lambda i: i + 1) if newest_heavy else (lambda i: size - i))
    value = F.round(total / (size * (size + 1) / 2.0), 11)  # as in correlation: keep ties
    if compat:
        return _zero_until(n, value, length, over)
    return F.when(F.size(values) == size, value)


wma = decay_linear


def lowday(x: Column, n: float = 10, length: Column | None = None, compat: bool = False, over=place) -> Column:
    """Rows since the lowest value; the earliest one wins a tie."""
    values = over(F.collect_list(zero(x) if compat else x), n)
    since = (F.size(values) - F.array_position(values, F.array_min(values))).cast("double")
    if compat:
        return _zero_until(n, since, length, over)
    return F.when(F.size(values) == _need(n, length), since)


def highday(x: Column, n: float = 10, length: Column | None = None, compat: bool = False, over=place) -> Column:
    """Rows since the highest value; the latest one wins a tie."""
    values = over(F.collect_list(zero(x) if compat else x), n)
    since = (F.array_position(F.reverse(values), F.array_max(values)) - 1).cast("double")
    if compat:
        return _zero_until(n, since, length, over)
    return F.when(F.size(values) == _need(n, length), since)


def sumif(
    x: Column, n: float, condition: Column, length: Column | None = None, compat: bool = False, over=place
) -> Column:
    total = over(F.sum(F.when(condition, zero(x)).otherwise(0.0)), n)
    if compat:
        return _zero_until(n, total, length, over)
    return F.when(over(F.count(x), n) == _need(n, length), total)


def min_periods(n: int) -> int:
    """Looser warm-up of :func:`count` and :func:`sumac`."""
    return n - 1 if n <= 10 else n * 2 // 3


def count(condition: Column, n: float, over=place) -> Column:
    n = int(n)
    hits = over(F.sum(F.when(condition, 1.0).otherwise(0.0)), n)
    return F.when(over(F.row_number(), None) >= min_periods(n), hits)


def sumac(x: Column, n: float = 10, over=place) -> Column:
    """Rolling sum with loose warm-up; carry forward with :func:`ffill` in a next step."""
    n = int(n)
    return F.when(over(F.count(x), n) >= F.lit(min_periods(n)), over(F.sum(x), n))


def regbeta(x: Column, n: int, length: Column | None = None, compat: bool = False, over=place) -> Column:
    """Slope of x on 1..n with the sample-covariance over population-variance factor n/(n-1)."""
    size = _need(n, length).cast("double")
    total = _rolled(over, "slope", [zero(x)], n) if compat else None
    if total is None:
        values = over(F.collect_list(zero(x) if compat else x), n)
        total = _weighted(values, lambda i: i - (size - 1) / 2.0)
    slope = F.try_divide(total * 12.0, size * (size * size - 1)) * F.try_divide(size, size - 1)
    if compat:
        return _zero_until(n, slope, length, over)
    return F.when(F.size(values) == size, slope)


def position() -> Column:
    """1-based row index inside the code's history."""
    return F.row_number().over(history())


def sma(x: Column, n: float, m: float = 2, over=place) -> Column:
    """Two-tap smoothing of the input and its predecessor; the first row passes through."""
    previous = over(F.lag(x, 1), None)
    first = over(F.row_number(), None) == 1
    return F.when(first, x).otherwise((x * m + previous * (n - m)) / float(n))


def ffill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(upto())


def bfill(x: Column) -> Column:
    backwards = Window.partitionBy(CODE).orderBy(F.desc(DT)).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(x, ignorenulls=True).over(backwards)


def future(x: Column, k: int) -> Column:
    return F.lead(x, k).over(history())
