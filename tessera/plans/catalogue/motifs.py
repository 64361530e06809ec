"""Expressions several formulas share."""

from __future__ import annotations


def step(p, x, k=1):
    """Ratio to the value k rows back."""
    return x / p.delay(x, k)


def growth(p, x, k=1):
    return (x - p.delay(x, k)) / p.delay(x, k)


def rises(p):
    return p.close > p.delay(p.close, 1)


def falls(p):
    return p.close < p.delay(p.close, 1)


def mid(p):
    return (p.high + p.low) / 2


def typical(p):
    return (p.close + p.high + p.low) / 3


def close_position(p):
    """Close inside the day's range, from -1 to 1."""
    return ((p.close - p.low) - (p.high - p.close)) / (p.high - p.low)


def blend(a, b, weight):
    return a * weight + b * (1 - weight)


def stochastic(p, n):
    return (p.close - p.ts_min(p.low, n)) / (p.ts_max(p.high, n) - p.ts_min(p.low, n)) * 100


def headroom(p, n):
    """Distance of the close from the n-row high, in percent of the range."""
    return (p.ts_max(p.high, n) - p.close) / (p.ts_max(p.high, n) - p.ts_min(p.low, n)) * 100


def adv(p, n=20):
    """Average volume."""
    return p.mean(p.volume, n)


def relative_volume(p):
    return p.volume / adv(p)


def gain_share(p, x, n):
    """Smoothed rises over smoothed moves, in percent."""
    move = x - p.delay(x, 1)
    return p.sma(p.max(move, 0), n, 1) / p.sma(p.abs(move), n, 1) * 100


def signed_volume(p):
    return p.where(rises(p), p.volume, p.where(falls(p), -p.volume, 0))


def bias(p, x, n):
    return (x - p.mean(x, n)) / p.mean(x, n)


def close_slope(p):
    """Change of the ten-row average slope of the close."""
    c = p.close
    return (p.delay(c, 20) - p.delay(c, 10)) / 10 - (p.delay(c, 10) - c) / 10


def direction_count(p):
    """Signs of the last three daily moves, added."""
    d = [p.close] + [p.delay(p.close, k) for k in (1, 2, 3)]
    return p.sign(d[0] - d[1]) + p.sign(d[1] - d[2]) + p.sign(d[2] - d[3])


def trend_band(p, otherwise):
    """-1 above and 1 below the 8-row band around the 2-row mean, else by relative volume."""
    middle, width, fast = p.sum(p.close, 8) / 8, p.stddev(p.close, 8), p.sum(p.close, 2) / 2
    busy = (relative_volume(p) > 1) | relative_volume(p).same(1)
    return p.where((middle + width) < fast, -1, p.where(fast < (middle - width), 1, p.where(busy, 1, otherwise)))


def drift_switch(p):
    """Distance above the 100-row low while the 100-row mean is flat or falling, else a short reversal."""
    rate = p.delta(p.sum(p.close, 100) / 100, 100) / p.delay(p.close, 100)
    flat = (rate < 0.05) | rate.same(0.05)
    return p.where(flat, -(p.close - p.ts_min(p.close, 100)), -p.delta(p.close, 3))


def volume_breakout(p, otherwise):
    move = p.delta(p.close, 7)
    return p.where(adv(p) < p.volume, -p.ts_rank(p.abs(move), 60) * p.sign(move), otherwise)


def price_volume_product(p):
    """Five-row close sum against returns, less its value ten rows ago."""
    x = p.sum(p.open, 5) * p.sum(p.returns, 5)
    return x - p.delay(x, 10)


def true_range(p):
    last = p.delay(p.close, 1)
    return p.max(p.max(p.high - p.low, p.abs(last - p.high)), p.abs(last - p.low))


def swing(p):
    """Swing index of the day: weighted move over the dominating range, times the larger gap."""
    last, before = p.delay(p.close, 1), p.delay(p.open, 1)
    up, down, span = p.abs(p.high - last), p.abs(p.low - last), p.abs(p.high - p.delay(p.low, 1))
    body = p.abs(last - before) / 4
    weight = p.where(
        (up > down) & (up > span), up + down / 2 + body, p.where((down > span) & (down > up), down + up / 2 + body, span + body)
    )
    move = p.close - last + (p.close - p.open) / 2 + last - before
    return 16 * move / weight * p.max(up, down)


def range_moves(p, up: bool):
    """Larger of the two gaps on days whose mid price did not go up (or down), 12-row sum."""
    now, before = p.high + p.low, p.delay(p.high, 1) + p.delay(p.low, 1)
    gap = p.max(p.abs(p.high - p.delay(p.high, 1)), p.abs(p.low - p.delay(p.low, 1)))
    return p.sum(p.where(now >= before if up else now <= before, 0, gap), 12)


def directional_index(p):
    """Six-row mean of the normalised difference of both directional moves over 14 rows."""
    down, up = p.delay(p.low, 1) - p.low, p.high - p.delay(p.high, 1)
    span = p.sum(true_range(p), 14)
    minus = p.sum(p.where((down > 0) & (down > up), down, 0), 14) * 100 / span
    plus = p.sum(p.where((up > 0) & (up > down), up, 0), 14) * 100 / span
    return p.mean(p.abs(minus - plus) / (minus + plus) * 100, 6)


def up_volatility(p):
    return p.sma(p.where(rises(p), p.stddev(p.close, 20), 0), 20, 1)


def down_volatility(p):
    return p.sma(p.where(p.close <= p.delay(p.close, 1), p.stddev(p.close, 20), 0), 20, 1)


def accumulation(p):
    """Close against yesterday's close or the day's extreme on its side."""
    last = p.delay(p.close, 1)
    return p.where(p.close.same(last), 0, p.close - p.where(p.close > last, p.min(p.low, last), p.max(p.high, last)))
