"""Folds along a code against plain loops, and their plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import folds as L
from tessera.operators.indicators import recursive as R
from tessera.operators.registry import INDICATORS
from tests.conftest import day

LONG = 3 * L.BLOCK + 5


def table(spark, *codes):
    """One code per list of rows (x, y)."""
    rows = [(code, day(i), *r) for code, series in enumerate(codes) for i, r in enumerate(series)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "code long, dt date, x double, y double")


def run(df, build):
    out = L.scan_by_code(df, build, ["x", "y"], ["out"])
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r.code, r.dt)):
        found.setdefault(r.code, []).append(r.out)
    return found


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None), (got, want)
        assert g is None or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9)


def slow_average(x, n, alpha):
    out, seen, y = [], [], None
    for v in x:
        if v is not None:
            seen.append(v)
            if len(seen) == n:
                y = sum(seen) / n
            elif len(seen) > n:
                y = alpha * v + (1 - alpha) * y
        out.append(y)
    return out


def slow_sum(x, n):
    out, seen, y = [], [], None
    for v in x:
        if v is not None:
            seen.append(v)
            if len(seen) == n - 1:
                y = sum(seen)
            elif len(seen) >= n:
                y = y - y / n + v
        out.append(y)
    return out


def slow_decay(x, span, least):
    """Every row's mean from its own weights."""
    d, out = 1 - 2 / (span + 1), []
    for t in range(len(x)):
        known = [(d ** (t - i), v) for i, v in enumerate(x[: t + 1]) if v is not None]
        weight = sum(w for w, _ in known)
        enough = len(known) >= max(least, 1) and weight > 0
        out.append(sum(w * v for w, v in known) / weight if enough else None)
    return out


def slow_parabolic(high, low, step, limit):
    """The published rules for long and short positions, written out one by one; (value, long) per row."""
    out = [(None, None)]
    if len(high) < 2:
        return out
    fell = low[0] - low[1]
    long = not (fell > 0 and fell > high[1] - high[0])
    extreme, stop, pace = (high[1], low[0], step) if long else (low[1], high[0], step)
    for t in range(1, len(high)):
        near = (t - 1, t) if t > 1 else (1, 1)
        top, bottom = max(high[i] for i in near), min(low[i] for i in near)
        if long and low[t] <= stop:
            value, long = max(extreme, top), False
            extreme, pace = low[t], step
            stop = max(value + pace * (extreme - value), top)
        elif not long and high[t] >= stop:
            value, long = min(extreme, bottom), True
            extreme, pace = high[t], step
            stop = min(value + pace * (extreme - value), bottom)
        else:
            value = stop
            if (long and high[t] > extreme) or (not long and low[t] < extreme):
                extreme, pace = high[t] if long else low[t], min(pace + step, limit)
            stop = stop + pace * (extreme - stop)
            stop = min(stop, bottom) if long else max(stop, top)
        out.append((value, long))
    return out


def noisy(n, seed, holes=0.0):
    rng, level, out = random.Random(seed), 100.0, []
    for _ in range(n):
        level += rng.gauss(0, 2)
        out.append((None if rng.random() < holes else level, level + rng.random()))
    return out


@pytest.mark.parametrize("n", [1, 3, 20])
def test_averages_equal_loops(spark, n):
    series = [noisy(LONG, 1), noisy(L.BLOCK, 2), noisy(2, 3), [(None, None)] * 4, [(None, 0.0)] * 5 + noisy(30, 4, 0.3)]
    df = table(spark, *series)
    for build, slow in (
        (lambda h, x, y: [L.smooth(x, n)], lambda x: slow_average(x, n, 2 / (n + 1))),
        (lambda h, x, y: [L.wilder(x, n)], lambda x: slow_average(x, n, 1 / n)),
        (lambda h, x, y: [L.wilder_sum(x, n)], lambda x: slow_sum(x, n) if n > 1 else x),
        (lambda h, x, y: [L.decayed(x, n, n - 1)], lambda x: slow_decay(x, n, n - 1)),
    ):
        got = run(df, build)
        for code, rows in enumerate(series):
            same(got[code], slow([x for x, _ in rows]))


def test_hand_values(spark):
    rows = [(v, None) for v in (2.0, 4.0, 6.0, 8.0, 10.0)]
    same(run(table(spark, rows), lambda h, x, y: [L.smooth(x, 3)])[0], [None, None, 4.0, 6.0, 8.0])
    rows = [(v, None) for v in (None, 1.0, 2.0, 3.0, 4.0)]
    want = [None, None, 3.0, 5.0, 5 - 5 / 3 + 4]
    same(run(table(spark, rows), lambda h, x, y: [L.wilder_sum(x, 3)])[0], want)


def test_shift_blank_each(spark):
    df = table(spark, [(float(i), 1.0) for i in range(5)], [(7.0, None)])
    got = run(df, lambda h, x, y: [L.each(lambda a, b, d: a * 10 + b + d, L.shift(x, 2), L.blank(x, 1), y)])
    same(got[0], [None, None, 3.0, 14.0, 25.0])
    same(got[1], [None])


@pytest.mark.parametrize("step, limit", [(0.02, 0.2), (0.3, 0.1)])
def test_parabolic_equals_the_rules(spark, step, limit):
    series = []
    for seed, n in ((1, LONG), (2, 40), (3, 2), (4, 1)):
        rng = random.Random(seed)
        series.append([(v + 2 * rng.random(), v - 2 * rng.random()) for v, _ in noisy(n, seed)])
    df = table(spark, *series)
    plain = run(df, lambda h, x, y: [R._parabolic(x, y, step, limit, False)])
    signed = run(df, lambda h, x, y: [R._parabolic(x, y, step, limit, True)])
    for code, rows in enumerate(series):
        want = slow_parabolic([h for h, _ in rows], [l for _, l in rows], min(step, limit), limit)
        same(plain[code], [v for v, _ in want])
        same(signed[code], [v if v is None or long else -v for v, long in want])


def test_parabolic_passes_over_missing_rows(spark):
    rows = [(h + 1, h - 1) for h, _ in noisy(30, 9)]
    holes = [*rows[:1], (None, 3.0), *rows[1:20], (None, None), *rows[20:]]
    whole = run(table(spark, rows), lambda h, x, y: [R._parabolic(x, y, 0.02, 0.2, False)])[0]
    got = run(table(spark, holes), lambda h, x, y: [R._parabolic(x, y, 0.02, 0.2, False)])[0]
    assert got[1] is None and got[21] is None
    same([v for i, v in enumerate(got) if i not in (1, 21)], whole)


def test_rows_and_columns_survive(spark):
    df = spark.createDataFrame(
        [(None, day(0), 1.0, "a"), (5, day(0), 2.0, "b"), (5, day(0), 4.0, "c"), (5, None, 8.0, None)],
        "code long, dt date, x double, `_rows` string",
    )
    out = L.scan_by_code(df, lambda h, x: [L.smooth(x, 1)], ["x"], ["_s0"])
    assert out.columns == ["code", "dt", "x", "_rows", "_s0"]
    got = sorted((r["x"], r["_rows"], r["_s0"]) for r in out.collect() if r["code"] == 5 and r["dt"])
    assert [(x, t) for x, t, _ in got] == [(2.0, "b"), (4.0, "c")]
    assert out.count() == 4
    assert L.scan_by_code(df.limit(0), lambda h, x: [L.smooth(x, 3)], ["x"], ["e"]).count() == 0


FOLDED = "EMA DEMA TEMA T3 TRIX MACD MACDFIX RSI CMO STOCHRSI PLUS_DM MINUS_DM PLUS_DI MINUS_DI DX ADX ADXR ATR NATR ADOSC SAR SAREXT MASSI TSI COPP".split()


@pytest.mark.parametrize("name", FOLDED)
def test_no_python_and_one_exchange(spark, name):
    df = spark.range(1).select(
        F.col("id").alias("code"),
        F.current_date().alias("dt"),
        *[F.lit(1.0).alias(k) for k in ("open", "high", "low", "close", "volume", "amount")],
    ).repartition(3)
    entry = INDICATORS[name]
    plan = entry.build(df, *entry.defaults)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan
    assert plan.count("Exchange hashpartitioning(code") == 1


@pytest.mark.parametrize("name", ["DX", "T3", "HT_PHASOR", "CDLMORNINGSTAR"])
def test_work_along_codes_is_spread_over_the_tasks(spark, name):
    """Tasks were merged by the bytes of their rows, to about one a core, of which the longest took several times its share."""
    bars = spark.createDataFrame(
        [(c, day(i), 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, 10.0) for c in range(40) for i in range(60)],
        "code long, dt date, open double, high double, low double, close double, volume double",
    )
    out = INDICATORS[name].build(bars, *INDICATORS[name].defaults)
    assert out.count() == 2400
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 1
