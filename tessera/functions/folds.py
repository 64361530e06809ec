"""Recursions along a code's history, as folds over arrays inside the JVM.

``History`` gathers a code's rows, in date order, into one array; a history is never longer than the calendar. Series are
arrays of doubles with null where there is no value. ``scan`` runs any recursion whose state is a struct; the averages below
are linear recurrences y -> a * y + b and use it. No row goes to Python.

A null input leaves a recursion's state as it is, unless stated otherwise; an average has no value before its seed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.windows import spread

BLOCK = 64  # appending copies an array, so results are gathered in blocks of this many rows


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def scan(
    items: Column,
    state: str,
    start: dict[str, object],
    step: Callable[[Column, Column], dict[str, Column] | Column],
    emit: Callable[[Column], Column],
) -> Column:
    """Array of ``emit(state)`` after each item, the state going from ``start`` through ``step(state, item)``.

    ``state`` is the state's schema, like ``"k int, y double"``; ``step`` gives every field of it, by name or as a struct.
    The states are gathered, block by block, each block from the last state of the one before; the last state gathered is
    the current one, so each step is evaluated once and nothing else is carried.
    """
    kind = f"struct<{','.join(f.strip().replace(' ', ':') for f in state.split(','))}>"

    def packed(fields):
        if isinstance(fields, Column):
            return fields.cast(kind)
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]).cast(kind)

    def last(states):
        return F.element_at(states, -1)

    def one(states, item):
        return F.array_append(states, packed(step(last(states), item)))

    def block(done, part):
        first = F.array(last(last(done))).cast(f"array<{kind}>")
        return F.array_append(done, F.aggregate(part, first, one))

    def blocks(x):
        starts = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(BLOCK))
        return F.transform(starts, lambda i: F.slice(x, i, F.lit(BLOCK)))

    def emitted(states):
        """A block's results, without the state it began with."""
        return F.transform(F.slice(states, F.lit(2), F.size(states)), emit)

    zero = F.array(F.array(packed(start))).cast(f"array<array<{kind}>>")
    return F.aggregate(let(items, blocks), zero, block, lambda done: F.flatten(F.transform(done, emitted)))


def zipped(**series: Column) -> Column:
    """One array of structs from series of the same length."""
    fields = ",".join(f"{name}:double" for name in series)
    return F.arrays_zip(*series.values()).cast(f"array<struct<{fields}>>")


def each(f: Callable[..., Column], *series: Column) -> Column:
    """``f`` row by row over one or more series."""
    if len(series) == 1:
        return F.transform(series[0], lambda v: f(v))
    names = [f"v{i}" for i in range(len(series))]
    return F.transform(zipped(**dict(zip(names, series))), lambda row: f(*[row[n] for n in names]))


def shift(x: Column, k: int = 1) -> Column:
    """The series ``k`` rows later; null in the first ``k``."""
    lead = F.array_repeat(F.lit(None).cast("double"), int(k))
    return let(x, lambda s: F.slice(F.concat(lead, s), F.lit(1), F.size(s)))


def blank(x: Column, k: int) -> Column:
    """The series with its first ``k`` rows null."""
    return F.transform(x, lambda v, i: F.when(i >= int(k), v))


def ratio(top: Column, bottom: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def _unless_null(s: Column, v: Column, moved: Column) -> dict[str, Column]:
    """State of ``k`` values seen and the value ``y``, which a null leaves alone."""
    return {"k": s["k"] + v.isNotNull().cast("int"), "y": F.when(v.isNull(), s["y"]).otherwise(moved)}


def smooth(x: Column, n: int, alpha: float | None = None) -> Column:
    """Exponential average seeded with the mean of the first ``n`` values."""
    n = int(n)
    a = 2.0 / (n + 1) if alpha is None else alpha

    def step(s, v):
        seeding = F.when(s["k"] + 1 < n, s["y"] + v).otherwise((s["y"] + v) / n)
        return _unless_null(s, v, F.when(s["k"] >= n, s["y"] + a * (v - s["y"])).otherwise(seeding))

    return scan(x, "k int, y double", {"k": 0, "y": 0.0}, step, lambda s: F.when(s["k"] >= n, s["y"]))


def wilder(x: Column, n: int) -> Column:
    return smooth(x, n, 1.0 / int(n))


def wilder_sum(x: Column, n: int) -> Column:
    """Decaying sum y - y/n + x, seeded with the sum of the first n-1 values; the series itself for n = 1."""
    n = int(n)
    if n < 2:
        return x

    def step(s, v):
        moved = F.when(s["k"] + 1 < n, s["y"] + v).otherwise(s["y"] - s["y"] / n + v)
        return _unless_null(s, v, moved)

    return scan(x, "k int, y double", {"k": 0, "y": 0.0}, step, lambda s: F.when(s["k"] >= n - 1, s["y"]))


def decayed(x: Column, span: int, least: int) -> Column:
    """Exponential mean with weights renormalised from the first value on, from the ``least``-th value.

    A null has no weight, but older values lose theirs over it as over any row.
    """
    d = 1 - 2.0 / (int(span) + 1)

    def step(s, v):
        seen = v.isNotNull().cast("int")
        return {"k": s["k"] + seen, "top": d * s["top"] + F.coalesce(v, F.lit(0.0)), "weight": d * s["weight"] + seen}

    def emit(s):
        return F.when(s["k"] >= max(int(least), 1), F.try_divide(s["top"], s["weight"]))

    return scan(x, "k int, top double, weight double", {"k": 0, "top": 0.0, "weight": 0.0}, step, emit)


class History:
    """A code's rows as one array, with the series named in ``inputs``; ``keep`` computes a series that is used again."""

    def __init__(self, bars: DataFrame, inputs):
        self.columns = bars.columns
        rows = F.sort_array(F.collect_list(F.struct("dt", *[c for c in bars.columns if c not in ("code", "dt")])))
        self.frame = spread(bars).groupBy("code").agg(rows.alias("_rows"))
        self.kept = 0
        self.inputs = [self.keep(self._series(name)) for name in inputs]

    def _series(self, name: str) -> Column:
        return F.transform("_rows", lambda row: row[name].cast("double"))

    def keep(self, series: Column) -> Column:
        name = f"_s{self.kept}"
        self.kept += 1
        self.frame = self.frame.withColumn(name, series)
        return F.col(name)

    def rows(self, **outputs: Column) -> DataFrame:
        """The rows again, with the series appended as columns; NaN and infinities become null."""
        named = self.frame.select("code", "_rows", *[s.alias(f"_o_{name}") for name, s in outputs.items()])
        flat = named.select("code", F.explode(F.arrays_zip("_rows", *[f"_o_{name}" for name in outputs])).alias("_r"))

        def value(name):
            v = F.col(f"_r._o_{name}")
            return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).alias(name)

        fields = [F.col("code") if c == "code" else F.col(f"_r._rows.`{c}`").alias(c) for c in self.columns]
        return flat.select(*fields, *[value(name) for name in outputs])


def scan_by_code(bars: DataFrame, build: Callable[..., list[Column]], inputs, outputs) -> DataFrame:
    """Append ``outputs`` = ``build(history, *input series)`` over each code in date order."""
    history = History(bars, inputs)
    found = build(history, *history.inputs)
    return history.rows(**dict(zip(outputs, found)))
