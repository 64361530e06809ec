"""Rolling statistics of many rows at once, in numpy.

A window frame of the engine goes over its n rows again for every row, at up to a microsecond a value. Here a batch of rows,
sorted by code and day, is shifted n times, which is a few nanoseconds a value. Sums run from the oldest row to the newest, as
in the engine's frames, so that they agree to the last digit; moments are taken about the window's newest value, so that a flat
window has exactly no variance. A task holds one batch and the rows before it that windows reach back to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Kernel = tuple[str, tuple[Column, ...], int]  # name, inputs, rows of the window


class Rows:
    """One input over consecutive rows: values (0 where null), which are known, and the place inside the code's history from 0."""

    def __init__(self, values: np.ndarray, known: np.ndarray, place: np.ndarray):
        self.values, self.known, self.place = values, known, place

    def back(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For the rows from the k-th on: the value k rows before, and whether that row is of the same code."""
        return self.values[: len(self.values) - k], self.place[k:] >= k

    def sizes(self, n: int) -> np.ndarray:
        return np.minimum(self.place + 1, n)


def _count(n: int, x: Rows) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(x.known)])
    last = np.arange(1, len(x.known) + 1)
    return (upto[last] - upto[np.maximum(last - x.sizes(n), 0)]).astype(float)


def _weighted(n: int, x: Rows, weight: Callable[[int], float | np.ndarray]) -> np.ndarray:
    out = np.zeros(len(x.values))
    for k in range(min(n, len(x.values)) - 1, -1, -1):
        value, same = x.back(k)
        out[k:] += np.where(same, value * weight(k), 0.0)
    return out


def _sum(n: int, x: Rows) -> np.ndarray:
    return _weighted(n, x, lambda k: 1.0)


def _mean(n: int, x: Rows) -> np.ndarray:
    return _sum(n, x) / np.maximum(_count(n, x), 1)


def _best(n: int, x: Rows, pick: Callable, worst: float) -> np.ndarray:
    z = np.where(x.known, x.values, worst)
    out = z.copy()
    for k in range(1, min(n, len(z))):
        out[k:] = pick(out[k:], np.where(x.place[k:] >= k, z[: len(z) - k], worst))
    return out


def _moments(n: int, *inputs: Rows) -> list[np.ndarray]:
    """Per window: the sums of squares about the mean of each input and, of two inputs, of products; rows of another code are left out."""
    size = inputs[0].sizes(n)
    pairs = [(i, j) for i in range(len(inputs)) for j in range(i, len(inputs))]
    first = [np.zeros(len(size)) for _ in inputs]
    second = [np.zeros(len(size)) for _ in pairs]
    for k in range(1, min(n, len(size))):
        off = []
        for x in inputs:
            value, same = x.back(k)
            off.append(np.where(same, value - x.values[k:], 0.0))
        for total, d in zip(first, off):
            total[k:] += d
        for total, (i, j) in zip(second, pairs):
            total[k:] += off[i] * off[j]
    return [total - first[i] * first[j] / size for total, (i, j) in zip(second, pairs)]


def _stddev(n: int, x: Rows) -> np.ndarray:
    return np.sqrt(np.maximum(_moments(n, x)[0], 0.0) / x.sizes(n))


NOISE = 1e-9


def _full(n: int, x: Rows, y: Rows) -> np.ndarray:
    return _count(n, Rows(x.values, x.known & y.known, x.place)) == n


def _correlation(n: int, x: Rows, y: Rows) -> np.ndarray:
    xx, xy, yy = _moments(n, x, y)
    sx, sy = (np.sqrt(np.maximum(s, 0.0) / n) for s in (xx, yy))
    good = _full(n, x, y) & (sx > NOISE) & (sy > NOISE)
    return np.where(good, xy / n / np.where(good, sx * sy, 1.0), np.nan)


def _covariance(n: int, x: Rows, y: Rows) -> np.ndarray:
    return np.where(_full(n, x, y) & (n > 1), _moments(n, x, y)[1] / max(n - 1, 1), np.nan)


def _rank(n: int, x: Rows) -> np.ndarray:
    """The newest value's place among the window's known values, from -1 to 1."""
    less, same = np.zeros(len(x.values)), x.known.astype(float)
    for k in range(1, min(n, len(x.values))):
        value, inside = x.back(k)
        inside = inside & x.known[: len(value)]
        less[k:] += inside & (value < x.values[k:])
        same[k:] += inside & (value == x.values[k:])
    size = _count(n, x)
    scaled = 2 * ((less + (same - 1) / 2.0) / np.maximum(size - 1, 1) - 0.5)
    return np.where(x.known, np.where(size > 1, scaled, 0.0), np.nan)


def _slope(n: int, x: Rows) -> np.ndarray:
    """Sum of the values times their distance from the window's middle, oldest first."""
    size, out = x.sizes(n), np.zeros(len(x.values))
    for k in range(min(n, len(x.values)) - 1, -1, -1):
        value, same = x.back(k)
        out[k:] += np.where(same, value * ((size[k:] - 1 - k) - (size[k:] - 1) / 2.0), 0.0)
    return out


KERNELS: dict[str, Callable[..., np.ndarray]] = {
    "count": _count,
    "sum": _sum,
    "mean": _mean,
    "min": lambda n, x: _best(n, x, np.minimum, np.inf),
    "max": lambda n, x: _best(n, x, np.maximum, -np.inf),
    "stddev": _stddev,
    "correlation": _correlation,
    "covariance": _covariance,
    "rank": _rank,
    "decay": lambda n, x: _weighted(n, x, lambda k: k + 1.0),  # the oldest row weighs most
    "slope": _slope,
}


def _column(parts: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    whole = pa.chunked_array(parts)
    known = np.asarray(whole.is_valid())
    return np.where(known, whole.to_numpy(), 0.0), known


def add_rolling(df: DataFrame, kernels: Mapping[str, Kernel]) -> DataFrame:
    """Append the rolling statistics of ``kernels`` along each code's history. NaN counts as a value.

    Statistics are NULL where the function has none; what a window with gaps gives is for the caller to tell by its count.
    """
    inputs: dict[str, Column] = {}
    number: dict[str, int] = {}
    for _, columns, _ in kernels.values():
        for c in columns:
            if (text := c._jc.toString()) not in number:
                number[text] = len(inputs)
                inputs[f"_in{len(inputs)}"] = c.cast("double")
    plan = [(KERNELS[kind], n, [number[c._jc.toString()] for c in columns]) for kind, columns, n in kernels.values()]
    reach, width, names = max(n for _, n, _ in plan) - 1, len(inputs), list(kernels)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        before: list[tuple[pa.Array, ...]] = []  # the rows that the next batch's windows reach back to
        last = 0
        for batch in batches:
            place = batch[0].to_numpy()
            steps = np.diff(np.concatenate([[last], place]))
            if len(place) and not ((steps == 1) | (place == 1)).all():
                raise ValueError("rows do not come by code and day")
            last = place[-1] if len(place) else last
            before.append(batch)
            kept = sum(len(b[0]) for b in before) - len(place)
            at = np.concatenate([b[0].to_numpy() for b in before]) - 1
            rows = [Rows(*_column([b[i + 1] for b in before]), at) for i in range(width)]
            with np.errstate(all="ignore"):
                found = [kernel(n, *[rows[i] for i in used])[kept:] for kernel, n, used in plan]
            yield pa.StructArray.from_arrays([pa.array(x, mask=np.isnan(x)) for x in found], names=names)
            tail = [b[-reach:] if reach else b[:0] for b in (pa.concat_arrays([b[i] for b in before]) for i in range(len(batch)))]
            before = [tuple(tail)] if reach else []

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    rolled = F.arrow_udf(run, ", ".join(f"{name} double" for name in kernels))
    place = F.row_number().over(Window.partitionBy("code").orderBy("dt"))
    sorted_rows = df.select("*", place.alias("_place"), *[v.alias(k) for k, v in inputs.items()])
    out = sorted_rows.withColumn("_rolled", rolled("_place", *inputs))
    return out.select(*df.columns, *[F.col(f"_rolled.{name}").alias(name) for name in kernels])
