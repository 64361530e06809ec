"""Indicators with a recursion along time.

A code's date-sorted history is one array (never longer than the calendar) and the recursions are folds over it inside the
JVM (``tessera.functions.folds``). Only the cycle filters still run a Python kernel. Everything that is not recursive stays
a window expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import windows as W
from tessera.functions.folds import blank, each, let, ratio, scan, scan_by_code, shift, smooth, wilder, wilder_sum, zipped
from tessera.operators.indicators.rolling import N, fast_k, money_flow_volume
from tessera.operators.registry import indicator


TOGETHER = 256  # codes that a kernel takes at once; their tables are a few MB each


def fold_by_code(
    bars: DataFrame, kernel: Callable[..., Sequence[np.ndarray]], inputs: Sequence[str], outputs: Sequence[str]
) -> DataFrame:
    """Append ``outputs`` = ``kernel(*input tables)`` computed over each code in date order.

    The kernel gets up to ``TOGETHER`` codes at once, one to a column; shorter series are padded with 0 at their end, so it
    must not look ahead.

    A code's rows stay in the JVM as one array, bounded by the calendar; only the arrays of the inputs go to Python,
    many codes in one Arrow batch.
    """
    columns = [c for c in bars.columns if c not in ("code", "dt")]
    rows = W.spread(bars).groupBy("code").agg(F.sort_array(F.collect_list(F.struct("dt", *columns))).alias("_rows"))

    @F.pandas_udf(T.StructType([T.StructField(o, T.ArrayType(T.DoubleType())) for o in outputs]))
    def run(*inputs: pd.Series) -> pd.DataFrame:
        found = [[None] * len(inputs[0]) for _ in outputs]
        lengths = np.array([len(a) for a in inputs[0]], dtype="int64")
        order = np.argsort(lengths, kind="stable")  # series of like length share a table
        for part in (order[i : i + TOGETHER] for i in range(0, len(order), TOGETHER)):
            tables = [np.zeros((lengths[part[-1]], len(part))) for _ in inputs]
            for table, series in zip(tables, inputs):
                for j, i in enumerate(part):
                    table[: lengths[i], j] = np.asarray(series.iloc[i], dtype="float64")
            for column, values in zip(found, kernel(*tables)):
                for j, i in enumerate(part):
                    v = values[: lengths[i], j]
                    column[i] = np.where(np.isfinite(v), v, np.nan)
        return pd.DataFrame(dict(zip(outputs, found)))

    def series(name):
        return F.transform("_rows", lambda s: s[name].cast("double"))

    folded = rows.withColumn("_out", run(*map(series, inputs)))

    def row(s, i):
        values = [F.get(F.col(f"_out.{o}"), i) for o in outputs]
        cleaned = [F.when(~F.isnan(v), v).alias(o) for v, o in zip(values, outputs)]
        return F.struct(*[s[c].alias(c) for c in ("dt", *columns)], *cleaned)

    return folded.select("code", F.inline(F.transform("_rows", row))).select(*bars.columns, *outputs)


def _folded(name: str, outputs: str, inputs: str, *defaults):
    """Register ``fn(history, *series, *args) -> series`` as an indicator computed by folds in the JVM."""

    def wrap(fn):
        @indicator(name, outputs, *defaults)
        def build(bars, *args):
            return scan_by_code(bars, lambda h, *series: fn(h, *series, *args), inputs.split(), outputs.split())

        return fn

    return wrap


def _filter(name: str, outputs: str, inputs: str, *defaults):
    """Register ``fn(*tables, *args) -> tables`` as an indicator computed by a Python kernel on many codes at once."""

    def wrap(fn):
        @indicator(name, outputs, *defaults)
        def build(bars, *args):
            return fold_by_code(bars, lambda *arrays: fn(*arrays, *args), inputs.split(), outputs.split())

        return fn

    return wrap


@_folded("EMA", "EMA", "close", N)
def ema(h, x, n):
    return [smooth(x, n)]


@_folded("DEMA", "DEMA", "close", N)
def dema(h, x, n):
    e1 = h.keep(smooth(x, n))
    return [each(lambda a, b: 2 * a - b, e1, smooth(e1, n))]


@_folded("TEMA", "TEMA", "close", N)
def tema(h, x, n):
    e1 = h.keep(smooth(x, n))
    e2 = h.keep(smooth(e1, n))
    return [each(lambda a, b, d: 3 * a - 3 * b + d, e1, e2, smooth(e2, n))]


@_folded("T3", "T3", "close", N, 0.7)
def t3(h, x, n, v):
    e = [x]
    for _ in range(6):
        e.append(h.keep(smooth(e[-1], n)))
    weights = [(1 + v) ** 3, -3 * v * (2 * v + 1 + v * v), 3 * v * v * (1 + v), -(v**3)]
    return [each(lambda *line: sum(w * y for w, y in zip(weights, line)), *e[3:])]


@_folded("TRIX", "TRIX", "close", N)
def trix(h, x, n):
    e = h.keep(smooth(smooth(smooth(x, n), n), n))
    return [each(lambda now, before: 100 * (ratio(now, before) - 1), e, shift(e))]


def _macd(h, x, fast, slow, signal, fast_alpha=None, slow_alpha=None):
    fast, slow = sorted((int(fast), int(slow)))
    # The fast average is seeded so that both averages begin on the same row.
    late = smooth(blank(x, slow - fast), fast, fast_alpha)
    line = h.keep(each(lambda a, b: a - b, late, smooth(x, slow, slow_alpha)))
    trigger = h.keep(smooth(line, signal))
    return [
        each(lambda a, t: F.when(t.isNotNull(), a), line, trigger),
        trigger,
        each(lambda a, t: a - t, line, trigger),
    ]


@_folded("MACD", "MACD MACDSIGNAL MACDHIST", "close", 12, 26, 9)
def macd(h, x, fast, slow, signal):
    return _macd(h, x, fast, slow, signal)


@_folded("MACDFIX", "MACDFIX MACDSIGNALFIX MACDHISTFIX", "close", N)
def macdfix(h, x, signal):
    return _macd(h, x, 12, 26, signal, 0.15, 0.075)


def _positive(v):
    return F.when(v.isNotNull(), F.greatest(v, F.lit(0.0)))


def _gains(h, x, n):
    step = h.keep(each(lambda now, before: now - before, x, shift(x)))
    return wilder(each(_positive, step), n), wilder(each(lambda v: _positive(-v), step), n)


@_folded("RSI", "RSI", "close", N)
def rsi(h, x, n):
    return [each(lambda up, down: 100 * ratio(up, up + down), *_gains(h, x, n))]


@_folded("CMO", "CMO", "close", N)
def cmo(h, x, n):
    return [each(lambda up, down: 100 * ratio(up - down, up + down), *_gains(h, x, n))]


@indicator("STOCHRSI", "FASTKRSI FASTDRSI", N, 5, 3)
def stochrsi(bars, n, fast, signal):
    out = scan_by_code(bars, lambda h, x: rsi(h, x, n), ["close"], ["_rsi"])
    out = out.withColumn("_k", fast_k(fast, "_rsi", "_rsi", "_rsi")).withColumn("FASTDRSI", W.mean(F.col("_k"), signal))
    out = out.withColumn("FASTKRSI", F.when(F.col("FASTDRSI").isNotNull(), F.col("_k")))
    return out.select(*bars.columns, "FASTKRSI", "FASTDRSI")


def _moves(high, low):
    """Upward and downward directional moves; null on the first row."""

    def move(wanted, other):
        return F.when(wanted.isNotNull(), F.when((wanted > 0) & (wanted > other), wanted).otherwise(0.0))

    before = shift(high), shift(low)
    plus = each(lambda a, b, pa, pb: move(a - pa, pb - b), high, low, *before)
    return plus, each(lambda a, b, pa, pb: move(pb - b, a - pa), high, low, *before)


def _range(high, low, close):
    """True range; null on the first row."""

    def span(a, b, last):
        return F.when(last.isNotNull(), F.greatest(a - b, F.abs(a - last), F.abs(b - last)))

    return each(span, high, low, shift(close))


@_folded("PLUS_DM", "PLUSDM", "high low", N)
def plus_dm(h, high, low, n):
    return [wilder_sum(_moves(high, low)[0], n)]


@_folded("MINUS_DM", "MINUSDM", "high low", N)
def minus_dm(h, high, low, n):
    return [wilder_sum(_moves(high, low)[1], n)]


def _directional(h, high, low, close, n):
    """Both direction lines; they start one decay step after their seed."""
    span = h.keep(wilder_sum(_range(high, low, close), n))

    def line(move):
        return each(
            lambda m, s, before: F.when(before.isNotNull(), 100 * ratio(m, s)), wilder_sum(move, n), span, shift(span)
        )

    return [line(m) for m in _moves(high, low)]


@_folded("PLUS_DI", "PLUSDI", "high low close", N)
def plus_di(h, high, low, close, n):
    return [_directional(h, high, low, close, n)[0]]


@_folded("MINUS_DI", "MINUSDI", "high low close", N)
def minus_di(h, high, low, close, n):
    return [_directional(h, high, low, close, n)[1]]


@_folded("DX", "DX", "high low close", N)
def dx(h, high, low, close, n):
    return [each(lambda p, m: 100 * ratio(F.abs(p - m), p + m), *_directional(h, high, low, close, n))]


@_folded("ADX", "ADX", "high low close", N)
def adx(h, high, low, close, n):
    return [wilder(dx(h, high, low, close, n)[0], n)]


@_folded("ADXR", "ADXR", "high low close", N)
def adxr(h, high, low, close, n):
    line = h.keep(adx(h, high, low, close, n)[0])
    return [each(lambda now, before: (now + before) / 2, line, shift(line, int(n) - 1))]


@_folded("ATR", "ATR", "high low close", N)
def atr(h, high, low, close, n):
    return [wilder(_range(high, low, close), n)]


@_folded("NATR", "NATR", "high low close", N)
def natr(h, high, low, close, n):
    return [each(lambda a, last: 100 * ratio(a, last), atr(h, high, low, close, n)[0], close)]


@indicator("ADOSC", "ADOSC", 3, 10)
def adosc(bars, fast, slow):
    out = bars.withColumn("_ad", F.sum(money_flow_volume()).over(W.upto()))

    def lines(h, x):
        value = each(lambda a, b: a - b, smooth(x, 1, 2.0 / (fast + 1)), smooth(x, 1, 2.0 / (slow + 1)))
        return [blank(value, max(fast, slow) - 1)]

    return scan_by_code(out, lines, ["_ad"], ["ADOSC"]).select(*bars.columns, "ADOSC")


def _parabolic(high, low, step, limit, signed):
    """Stop-and-reverse line: trails the extreme by an acceleration that grows with new extremes.

    The state keeps the side (1 long, -1 short). A short position is the long rule on negated prices with high and low
    exchanged, so one rule serves both. A row without high or low has no value and changes nothing.
    """
    start, most = float(min(step, limit)), float(limit)

    def begin(s, row):
        """State before the second row: the side from the first two rows, the extreme already on the second."""
        fall = s["low"] - row["low"]
        side = F.when((fall > 0) & (fall > row["high"] - s["high"]), -1).otherwise(1)
        return F.struct(
            F.lit(2).alias("k"),
            side.alias("side"),
            F.when(side > 0, row["high"]).otherwise(row["low"]).alias("extreme"),
            F.when(side > 0, s["low"]).otherwise(s["high"]).alias("stop"),
            F.lit(start).alias("pace"),
            row["high"].alias("high"),
            row["low"].alias("low"),
        )

    def go(s, row):
        """Prices turned to the long side."""
        side = s["side"]

        def turned(up, down):
            return F.when(side > 0, up).otherwise(-down)

        return F.struct(
            side.alias("side"),
            (side * s["extreme"]).alias("extreme"),
            (side * s["stop"]).alias("stop"),
            s["pace"].alias("pace"),
            turned(row["high"], row["low"]).alias("top"),
            turned(row["low"], row["high"]).alias("bottom"),
            turned(s["high"], s["low"]).alias("last_top"),
            turned(s["low"], s["high"]).alias("last_bottom"),
        )

    def reversed_(t):
        line = F.greatest(t["extreme"], t["last_top"], t["top"])
        next_stop = F.greatest(line + start * (t["bottom"] - line), t["last_top"], t["top"])
        return F.struct(
            (-t["side"]).alias("side"),
            (t["side"] * t["bottom"]).alias("extreme"),
            (t["side"] * next_stop).alias("stop"),
            F.lit(start).alias("pace"),
            (t["side"] * line).alias("value"),
        )

    def held(t):
        higher = t["top"] > t["extreme"]
        pace = F.when(higher, F.least(t["pace"] + float(min(step, limit)), F.lit(most))).otherwise(t["pace"])
        extreme = F.greatest(t["extreme"], t["top"])
        next_stop = F.least(t["stop"] + pace * (extreme - t["stop"]), t["last_bottom"], t["bottom"])
        return F.struct(
            t["side"].alias("side"),
            (t["side"] * extreme).alias("extreme"),
            (t["side"] * next_stop).alias("stop"),
            pace.alias("pace"),
            (t["side"] * t["stop"]).alias("value"),
        )

    kind = "struct<side:int,extreme:double,stop:double,pace:double,value:double>"

    def moved(s, row):
        return let(
            let(
                go(s, row),
                lambda t: F.when(t["bottom"] <= t["stop"], reversed_(t).cast(kind)).otherwise(held(t).cast(kind)),
            ),
            lambda m: _state(
                F.lit(3), m["side"], m["extreme"], m["stop"], m["pace"], row["high"], row["low"], m["value"]
            ),
        )

    fields = "k int, side int, extreme double, stop double, pace double, high double, low double, value double"
    names = [f.split()[0] for f in fields.split(", ")]
    whole = "struct<" + fields.replace(", ", ",").replace(" ", ":") + ">"

    def _state(*values):
        return F.struct(*[v.alias(name) for name, v in zip(names, values)]).cast(whole)

    def step_(s, row):
        none = F.lit(None).cast("double")
        missing = row["high"].isNull() | row["low"].isNull()
        same = _state(*[s[name] for name in names[:-1]], none)
        first = _state(F.lit(1), F.lit(0), none, none, none, row["high"], row["low"], none)
        second = let(begin(s, row), lambda b: moved(b, row))
        after = F.when(missing, same).when(s["k"] == 0, first).when(s["k"] == 1, second).otherwise(moved(s, row))
        return after

    def emit(s):
        return F.when(s["side"] < 0, -s["value"]).otherwise(s["value"]) if signed else s["value"]

    zero = {name: 0 if name in ("k", "side") else None for name in names}
    return scan(zipped(high=high, low=low), fields, zero, step_, emit)


@_folded("SAR", "SAR", "high low", 0.02, 0.2)
def sar(h, high, low, step, limit):
    return [_parabolic(high, low, step, limit, False)]


@_folded("SAREXT", "SAREXT", "high low", 0.02, 0.2)
def sarext(h, high, low, step, limit):
    """As SAR, negative while short."""
    return [_parabolic(high, low, step, limit, True)]


def _hilbert(price, start):
    """Dominant-cycle state per row: smoothed price, in-phase, quadrature, period, smoothed period.

    ``price`` is one code's series, or many of the same length, one to a column; each row is one step for all of them.
    The four-tap transform looks back 2, 4 and 6 rows; ``start`` is the first row it runs on.
    """
    n, x = len(price), np.asarray(price, dtype="float64")
    keys = ("smooth", "detrend", "i1", "q1", "ji", "jq", "i2", "q2", "re", "im", "period", "smooth_period")
    s = {k: np.zeros(x.shape) for k in keys}
    none = np.zeros(x.shape[1:])

    def back(k, t, lag):
        return s[k][t - lag] if t - lag >= start else none

    def transform(k, t, gain):
        return gain * (
            0.0962 * s[k][t] + 0.5769 * back(k, t, 2) - 0.5769 * back(k, t, 4) - 0.0962 * back(k, t, 6)
        )

    if n > 3:
        s["smooth"][3:] = (4 * x[3:] + 3 * x[2:-1] + 2 * x[1:-2] + x[:-3]) / 10
    with np.errstate(all="ignore"):
        for t in range(start, n):
            last = back("period", t, 1)
            gain = 0.075 * last + 0.54
            s["detrend"][t] = transform("smooth", t, gain)
            s["i1"][t] = back("detrend", t, 3)
            s["q1"][t] = transform("detrend", t, gain)
            s["ji"][t] = transform("i1", t, gain)
            s["jq"][t] = transform("q1", t, gain)
            i2b, q2b = back("i2", t, 1), back("q2", t, 1)
            i2 = s["i2"][t] = 0.2 * (s["i1"][t] - s["jq"][t]) + 0.8 * i2b
            q2 = s["q2"][t] = 0.2 * (s["q1"][t] + s["ji"][t]) + 0.8 * q2b
            re = s["re"][t] = 0.2 * (i2 * i2b + q2 * q2b) + 0.8 * back("re", t, 1)
            im = s["im"][t] = 0.2 * (i2 * q2b - q2 * i2b) + 0.8 * back("im", t, 1)
            angle = np.degrees(np.arctan(im / re))
            period = np.where((im != 0) & (re != 0) & (angle != 0), 360 / angle, last)
            low, high = 0.67 * last, 1.5 * last
            # As min(max(...)) of plain numbers: what compares false, like a missing value, leaves the first one.
            held = np.where(low > period, low, period)
            held = np.where(high < held, high, held)
            period = np.where(last != 0, held, period)
            period = np.where(6.0 > period, 6.0, period)
            period = np.where(50.0 < period, 50.0, period)
            s["period"][t] = 0.2 * period + 0.8 * last
            s["smooth_period"][t] = 0.33 * s["period"][t] + 0.67 * back("smooth_period", t, 1)
    return s


SHORT_START, LONG_START = 12, 37  # first transformed row of the period and of the phase outputs
SHORT_LOOKBACK, LONG_LOOKBACK = 32, 63


def _after(x, lookback):
    x = np.asarray(x, dtype="float64").copy()
    x[:lookback] = np.nan
    return x


@_filter("HT_DCPERIOD", "HTDCPERIOD", "close")
def ht_dcperiod(x):
    return [_after(_hilbert(x, SHORT_START)["smooth_period"], SHORT_LOOKBACK)]


@_filter("HT_PHASOR", "INPHASE QUADRATURE", "close")
def ht_phasor(x):
    s = _hilbert(x, SHORT_START)
    return [_after(s["i1"], SHORT_LOOKBACK), _after(s["q1"], SHORT_LOOKBACK)]


@_filter("MAMA", "MAMA FAMA", "close", 0.5, 0.05)
def mama(x, fast, slow):
    s = _hilbert(x, SHORT_START)
    lines, slow_lines = np.zeros(x.shape), np.zeros(x.shape)
    line = follow = last_phase = np.zeros(x.shape[1:])
    with np.errstate(all="ignore"):
        for t in range(SHORT_START, len(x)):
            phase = np.where(s["i1"][t] != 0, np.degrees(np.arctan(s["q1"][t] / s["i1"][t])), 0.0)
            step = last_phase - phase
            last_phase = phase
            pace = fast / step
            alpha = np.where(step > 1, np.where(slow > pace, slow, pace), fast)
            line = alpha * x[t] + (1 - alpha) * line
            follow = 0.5 * alpha * line + (1 - 0.5 * alpha) * follow
            lines[t], slow_lines[t] = line, follow
    return [_after(lines, SHORT_LOOKBACK), _after(slow_lines, SHORT_LOOKBACK)]


def _by_code(fn):
    """A kernel for many codes that transforms them all at once and calls ``fn(series, state) -> arrays`` on each."""

    @wraps(fn)
    def run(x):
        if x.ndim == 1:
            return [v[:, 0] for v in run(x[:, None])]
        s = _hilbert(x, LONG_START)
        states = ({k: s[k][:, j].tolist() for k in ("smooth", "smooth_period")} for j in range(x.shape[1]))
        return [np.stack(v, axis=1) for v in zip(*[fn(x[:, j], state) for j, state in enumerate(states)])]

    return run


def _phase(x, s):
    """Dominant-cycle phase in degrees per row."""
    phase, out = 0.0, [0.0] * len(x)
    for t in range(LONG_START, len(x)):
        length = int(s["smooth_period"][t] + 0.5)
        re = im = 0.0
        for i in range(length):
            value = s["smooth"][t - i] if t - i >= LONG_START else 0.0
            re += math.sin(math.radians(i * 360.0 / length)) * value
            im += math.cos(math.radians(i * 360.0 / length)) * value
        if abs(im) > 0:
            phase = math.degrees(math.atan(re / im))
        elif abs(im) <= 0.01:
            phase += -90.0 if re < 0 else 90.0 if re > 0 else 0.0
        phase += 90.0
        if s["smooth_period"][t]:
            phase += 360.0 / s["smooth_period"][t]
        if im < 0:
            phase += 180.0
        if phase > 315.0:
            phase -= 360.0
        out[t] = phase
    return np.array(out)


@_filter("HT_DCPHASE", "HTDCPHASE", "close")
@_by_code
def ht_dcphase(x, s):
    return [_after(_phase(x, s), LONG_LOOKBACK)]


def _sines(phase):
    return np.sin(np.radians(phase)), np.sin(np.radians(phase + 45))


@_filter("HT_SINE", "SINE LEADSINE", "close")
@_by_code
def ht_sine(x, s):
    return [_after(v, LONG_LOOKBACK) for v in _sines(_phase(x, s))]


def _trendline(x, s):
    """Mean price over the dominant cycle, then a four-row weighted mean."""
    n = len(x)
    cycle = np.zeros(n)
    for t in range(LONG_START, n):
        length = int(s["smooth_period"][t] + 0.5)
        cycle[t] = x[max(0, t - length + 1) : t + 1].sum() / length if length else 0.0
    lag = [np.concatenate([np.zeros(k), cycle[: n - k]]) if k <= n else np.zeros(n) for k in range(4)]
    return (4 * lag[0] + 3 * lag[1] + 2 * lag[2] + lag[3]) / 10


@_filter("HT_TRENDLINE", "HTTRENDLINE", "close")
@_by_code
def ht_trendline(x, s):
    return [_after(_trendline(x, s), LONG_LOOKBACK)]


@_filter("HT_TRENDMODE", "HTTRENDMODE", "close")
@_by_code
def ht_trendmode(x, s):
    """1 while price trends: no recent sine crossing, or price far from the trend line."""
    phase = _phase(x, s)
    sine, lead = _sines(phase)
    trend_line = _trendline(x, s)
    days, out = 0, np.zeros(len(x))
    for t in range(LONG_START, len(x)):
        before_sine, before_lead = (sine[t - 1], lead[t - 1]) if t > LONG_START else (0.0, 0.0)
        trend = 1
        if (sine[t] > lead[t] and before_sine <= before_lead) or (sine[t] < lead[t] and before_sine >= before_lead):
            days, trend = 0, 0
        days += 1
        period = s["smooth_period"][t]
        if days < 0.5 * period:
            trend = 0
        turn = phase[t] - (phase[t - 1] if t > LONG_START else 0.0)
        if period and 0.67 * 360 / period < turn < 1.5 * 360 / period:
            trend = 0
        if trend_line[t] and abs((s["smooth"][t] - trend_line[t]) / trend_line[t]) >= 0.015:
            trend = 1
        out[t] = trend
    return [_after(out, LONG_LOOKBACK)]
