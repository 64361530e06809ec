"""Catalogue of 191 formulas: those that need no benchmark, own-history or filter operator."""

from __future__ import annotations

from tessera.plans.catalogue.motifs import (
    accumulation,
    adv,
    bias,
    blend,
    close_position,
    close_slope,
    direction_count,
    directional_index,
    down_volatility,
    drift_switch,
    falls,
    gain_share,
    growth,
    headroom,
    mid,
    price_volume_product,
    range_moves,
    relative_volume,
    rises,
    signed_volume,
    step,
    stochastic,
    swing,
    trend_band,
    true_range,
    typical,
    up_volatility,
    volume_breakout,
)


def _net_moves(p, x):
    """Difference of the 13- and 27-row smoothings, and its own smoothing."""
    line = p.sma(x, 13, 2) - p.sma(x, 27, 2)
    return line, p.sma(line, 10, 2)


def _ema_log(p):
    x = p.log(p.close)
    for _ in range(3):
        x = p.sma(x, 13, 2)
    return x


def _lagged_means(p, x):
    """Gap of the 12- and 26-row means of a smoothed series, one row late."""
    late = p.delay(p.sma(x, 9, 1), 1)
    return p.mean(late, 12) - p.mean(late, 26)


def _day_moves(p):
    """Directional moves of the open; see also the reverse side."""
    before = p.delay(p.open, 1)
    up = p.where(p.open <= before, 0, p.max(p.high - p.open, p.open - before))
    down = p.where(p.open >= before, 0, p.max(p.open - p.low, p.open - before))
    return up, down


def _balance(p):
    up, down = (p.sum(x, 20) for x in _day_moves(p))
    return p.where(up > down, (up - down) / up, p.where(up.same(down), 0, (up - down) / down))


def _gap(p, up: bool):
    """Close-to-close rises, or the size of falls; zero otherwise."""
    move = p.close - p.delay(p.close, 1)
    return p.where(move > 0, move, 0) if up else p.where(move < 0, p.abs(move), 0)


def _directed_flow(p, up: bool):
    t = typical(p)
    last = p.delay(t, 1)
    return p.sum(p.where(t > last if up else t < last, t * p.volume, 0), 14)


def _relative_strength_band(p):
    x = gain_share(p, p.close, 12)
    return (x - p.min(x, 12)) / (p.max(x, 12) - p.min(x, 12))


def _range_position(p, n):
    """Close above the summed true lows, relative to the summed true range."""
    last = p.delay(p.close, 1)
    low, high = p.min(p.low, last), p.max(p.high, last)
    return (p.close - p.sum(low, n)) / p.sum(high - low, n)


def _return_gap(p):
    x = growth(p, p.close)
    return x, p.sma(x, 61, 2)


def _asymmetry(p):
    """Log ratio of the frequency and size of returns above and below the 20-row growth rate."""
    x = p.close / p.delay(p.close, 1) - 1
    rate = (p.close / p.delay(p.close, 19)) ** (1 / 20)
    above, below = x > rate - 1, x < rate - 1
    top = (p.count(above, 20) - 1) * p.sumif((x - rate - 1) ** 2, 20, below)
    bottom = p.count(below, 20) * p.sumif((x - (rate - 1)) ** 2, 20, above)
    return p.log(top / bottom)


def _reciprocal_rise(p):
    return p.where(rises(p), 1 / (p.close - p.delay(p.close, 1)), 1)


def _mean_ladder(p):
    return p.mean(p.close, 3) + p.mean(p.close, 6) + p.mean(p.close, 12) + p.mean(p.close, 24)


def _skew(p):
    x = p.close / p.delay(p.close, 1)
    move = x - 1
    return -20 * 19**1.5 * p.sum(move - p.mean(move, 20), 20) / (19 * 18 * p.sum(x**2, 20) ** 1.5)


FORMULAS = {
    1: lambda p: -p.corr(p.rank(p.delta(p.log(p.volume), 1)), p.rank((p.close - p.open) / p.open), 6),
    2: lambda p: -p.delta(close_position(p), 1),
    3: lambda p: p.sum(accumulation(p), 6),
    4: lambda p: trend_band(p, -1),
    5: lambda p: -p.ts_max(p.corr(p.ts_rank(p.volume, 5), p.ts_rank(p.high, 5), 5), 3),
    6: lambda p: p.rank(p.sign(p.delta(blend(p.open, p.high, 0.85), 4))) * -1,
    7: lambda p: (p.rank(p.max(p.vwap - p.close, 3)) + p.rank(p.min(p.vwap - p.close, 3))) * p.rank(p.delta(p.volume, 3)),
    8: lambda p: p.rank(p.delta(mid(p) * 0.2 + p.vwap * 0.8, 4) - 1),
    9: lambda p: p.sma((mid(p) - (p.delay(p.high, 1) + p.delay(p.low, 1)) / 2) * (p.high - p.low) / p.volume, 7, 2),
    10: lambda p: p.rank(p.max(p.where(p.returns < 0, p.stddev(p.returns, 20), p.close) ** 2, 5)),
    11: lambda p: p.sum(close_position(p) * p.volume, 6),
    12: lambda p: p.rank(p.open - p.sum(p.vwap, 10) / 10) * (-1 * p.rank(p.abs(p.close - p.vwap))),
    13: lambda p: (p.high * p.low) ** 0.5 - p.vwap,
    14: lambda p: p.close - p.delay(p.close, 5),
    15: lambda p: p.open / p.delay(p.close, 1) - 1,
    16: lambda p: -p.ts_max(p.rank(p.corr(p.rank(p.volume), p.rank(p.vwap), 5)), 5),
    17: lambda p: p.rank(p.vwap - p.max(p.vwap, 15)) ** p.delta(p.close, 5),
    18: lambda p: step(p, p.close, 5),
    19: lambda p: p.where(
        p.close < p.delay(p.close, 5),
        growth(p, p.close, 5),
        p.where(p.close.same(p.delay(p.close, 5)), 0, (p.close - p.delay(p.close, 5)) / p.close),
    ),
    20: lambda p: growth(p, p.close, 6) * 100,
    21: lambda p: p.regbeta(p.mean(p.close, 6), 6),
    22: lambda p: p.sma(bias(p, p.close, 6) - p.delay(bias(p, p.close, 6), 3), 12, 1),
    23: lambda p: up_volatility(p) / (up_volatility(p) + down_volatility(p)) * 100,
    24: lambda p: p.sma(p.close - p.delay(p.close, 5), 5, 1),
    25: lambda p: -p.rank(p.delta(p.close, 7) * (1 - p.rank(p.decay(relative_volume(p), 9)))) * (1 + p.rank(p.sum(p.returns, 250))),
    26: lambda p: (p.sum(p.close, 7) / 7 - p.close) + p.corr(p.vwap, p.delay(p.close, 5), 230),
    27: lambda p: p.decay(growth(p, p.close, 3) * 100 + growth(p, p.close, 6) * 100, 12),
    28: lambda p: 3 * p.sma(stochastic(p, 9), 3, 1)
    - 2 * p.sma(p.sma((p.close - p.ts_min(p.low, 9)) / (p.max(p.high, 9) - p.ts_max(p.low, 9)) * 100, 3, 1), 3, 1),
    29: lambda p: growth(p, p.close, 6) * p.volume,
    30: lambda p: p.close,
    31: lambda p: bias(p, p.close, 12) * 100,
    32: lambda p: -p.sum(p.rank(p.corr(p.rank(p.high), p.rank(p.volume), 3)), 3),
    33: lambda p: (-p.ts_min(p.low, 5) + p.delay(p.ts_min(p.low, 5), 5))
    * p.rank((p.sum(p.returns, 240) - p.sum(p.returns, 20)) / 220)
    * p.ts_rank(p.volume, 5),
    34: lambda p: p.mean(p.close, 12) / p.close,
    35: lambda p: p.min(
        p.rank(p.decay(p.delta(p.open, 1), 15)), p.rank(p.decay(p.corr(p.volume, p.open * 0.65 + p.open * 0.35, 17), 7))
    )
    * -1,
    36: lambda p: p.rank(p.sum(p.corr(p.rank(p.volume), p.rank(p.vwap), 6), 2)),
    37: lambda p: -p.rank(price_volume_product(p)),
    38: lambda p: p.where(p.sum(p.high, 20) / 20 < p.high, -p.delta(p.high, 2), 0),
    39: lambda p: (
        p.rank(p.decay(p.delta(p.close, 2), 8)) - p.rank(p.decay(p.corr(p.vwap * 0.3 + p.open * 0.7, p.sum(adv(p, 180), 37), 14), 12))
    )
    * -1,
    40: lambda p: p.sum(p.where(rises(p), p.volume, 0), 26) / p.sum(p.where(p.close <= p.delay(p.close, 1), p.volume, 0), 26) * 100,
    41: lambda p: p.rank(p.max(p.delta(p.vwap, 3), 5)) * -1,
    42: lambda p: -p.rank(p.stddev(p.high, 10)) * p.corr(p.high, p.volume, 10),
    43: lambda p: p.sum(signed_volume(p), 6),
    44: lambda p: p.ts_rank(p.decay(p.corr(p.low, adv(p, 10), 7), 6), 4) + p.ts_rank(p.decay(p.delta(p.vwap, 3), 10), 15),
    45: lambda p: p.rank(p.delta(p.close * 0.6 + p.open * 0.4, 1)) * p.rank(p.corr(p.vwap, adv(p, 150), 15)),
    46: lambda p: _mean_ladder(p) / (4 * p.close),
    47: lambda p: p.sma(headroom(p, 6), 9, 1),
    48: lambda p: -1 * (p.rank(direction_count(p)) * p.sum(p.volume, 5)) / p.sum(p.volume, 20),
    49: lambda p: range_moves(p, True) / (range_moves(p, True) + range_moves(p, False)),
    50: lambda p: range_moves(p, False) / (range_moves(p, False) + range_moves(p, True))
    - range_moves(p, True) / (range_moves(p, True) + range_moves(p, False)),
    51: lambda p: range_moves(p, False) / (range_moves(p, False) + range_moves(p, True)),
    52: lambda p: p.sum(p.max(0, p.high - p.delay(typical(p), 1)), 26) / p.sum(p.max(0, p.delay(typical(p), 1) - p.low), 26) * 100,
    53: lambda p: p.count(rises(p), 12) / 12 * 100,
    54: lambda p: -p.rank(p.stddev(p.abs(p.close - p.open)) + (p.close - p.open) + p.corr(p.close, p.open, 10)),
    55: lambda p: p.sum(swing(p), 20),
    56: lambda p: p.rank(p.open - p.ts_min(p.open, 12)) < p.rank(p.rank(p.corr(p.sum(mid(p), 19), p.sum(adv(p, 40), 19), 13)) ** 5),
    57: lambda p: p.sma(stochastic(p, 9), 3, 1),
    58: lambda p: p.count(rises(p), 20) / 20 * 100,
    59: lambda p: p.sum(accumulation(p), 20),
    60: lambda p: p.sum(close_position(p) * p.volume, 20),
    61: lambda p: p.max(p.rank(p.decay(p.delta(p.vwap, 1), 12)), p.rank(p.decay(p.rank(p.corr(p.low, adv(p, 80), 8)), 17))) * -1,
    62: lambda p: -p.corr(p.high, p.rank(p.volume), 5),
    63: lambda p: gain_share(p, p.close, 6),
    64: lambda p: p.max(
        p.rank(p.decay(p.corr(p.rank(p.vwap), p.rank(p.volume), 4), 4)),
        p.rank(p.decay(p.max(p.corr(p.rank(p.close), p.rank(adv(p, 60)), 4), 13), 14)),
    )
    * -1,
    65: lambda p: p.mean(p.close, 6) / p.close,
    66: lambda p: bias(p, p.close, 6) * 100,
    67: lambda p: gain_share(p, p.close, 24),
    68: lambda p: p.sma((mid(p) - (p.delay(p.high, 1) + p.delay(p.low, 1)) / 2) * (p.high - p.low) / p.volume, 15, 2),
    69: _balance,
    70: lambda p: p.stddev(p.amount, 6),
    71: lambda p: bias(p, p.close, 24) * 100,
    72: lambda p: p.sma(headroom(p, 6), 15, 1),
    73: lambda p: (
        p.ts_rank(p.decay(p.decay(p.corr(p.close, p.volume, 10), 16), 4), 5) - p.rank(p.decay(p.corr(p.vwap, adv(p, 30), 4), 3))
    )
    * -1,
    74: lambda p: p.rank(p.corr(p.sum(p.low * 0.35 + p.vwap * 0.65, 20), p.sum(adv(p, 40), 20), 7))
    + p.rank(p.corr(p.rank(p.vwap), p.rank(p.volume), 6)),
    76: lambda p: p.stddev(p.abs(step(p, p.close) - 1) / p.volume, 20) / p.mean(p.abs(step(p, p.close) - 1) / p.volume, 20),
    77: lambda p: p.min(p.rank(p.decay((mid(p) + p.high) - (p.vwap + p.high), 20)), p.rank(p.decay(p.corr(mid(p), adv(p, 40), 3), 6))),
    78: lambda p: (typical(p) - p.mean(typical(p), 12)) / (0.015 * p.mean(p.abs(p.close - p.mean(typical(p), 12)), 12)),
    79: lambda p: gain_share(p, p.close, 12),
    80: lambda p: growth(p, p.volume, 5) * 100,
    81: lambda p: p.sma(p.volume, 21, 2),
    82: lambda p: p.sma(headroom(p, 6), 20, 1),
    83: lambda p: -p.rank(p.cov(p.rank(p.high), p.rank(p.volume), 5)),
    84: lambda p: p.sum(signed_volume(p), 20),
    85: lambda p: p.ts_rank(relative_volume(p), 20) * p.ts_rank(-p.delta(p.close, 7), 8),
    86: lambda p: p.where(0.25 < close_slope(p), -1, p.where(close_slope(p) < 0, 1, -(p.close - p.delay(p.close, 1)))),
    87: lambda p: (
        p.rank(p.decay(p.delta(p.vwap, 4), 7)) + p.ts_rank(p.decay((p.low * 0.9 + p.low * 0.1 - p.vwap) / (p.open - mid(p)), 11), 7)
    )
    * -1,
    88: lambda p: growth(p, p.close, 20) * 100,
    89: lambda p: 2 * (_net_moves(p, p.close)[0] - _net_moves(p, p.close)[1]),
    90: lambda p: p.rank(p.corr(p.rank(p.vwap), p.rank(p.volume), 5)) * -1,
    91: lambda p: p.rank(p.close - p.max(p.close, 5)) * p.rank(p.corr(adv(p, 40), p.low, 5)) * -1,
    92: lambda p: p.max(
        p.rank(p.decay(p.delta(p.close * 0.35 + p.vwap * 0.65, 2), 3)), p.ts_rank(p.decay(p.abs(p.corr(adv(p, 180), p.close, 13)), 5), 15)
    )
    * -1,
    93: lambda p: p.sum(p.where(p.open >= p.delay(p.open, 1), 0, p.max(p.open - p.low, p.open - p.delay(p.open, 1))), 20),
    94: lambda p: p.sum(signed_volume(p), 30),
    95: lambda p: p.stddev(p.amount, 20),
    96: lambda p: p.sma(p.sma(stochastic(p, 9), 3, 1), 3, 1),
    97: lambda p: p.stddev(p.volume, 10),
    98: drift_switch,
    99: lambda p: -p.rank(p.cov(p.rank(p.close), p.rank(p.volume), 5)),
    100: lambda p: p.stddev(p.volume, 20),
    101: lambda p: (
        p.rank(p.corr(p.close, p.sum(adv(p, 30), 37), 15)) < p.rank(p.corr(p.rank(p.high * 0.1 + p.vwap * 0.9), p.rank(p.volume), 11))
    )
    * -1,
    102: lambda p: gain_share(p, p.volume, 6),
    103: lambda p: (20 - p.lowday(p.low, 20)) / 20 * 100,
    104: lambda p: -(p.delta(p.corr(p.high, p.volume, 5), 5) * p.rank(p.stddev(p.close, 20))),
    105: lambda p: -p.corr(p.rank(p.open), p.rank(p.volume), 10),
    106: lambda p: p.close - p.delay(p.close, 20),
    107: lambda p: -p.rank(p.open - p.delay(p.high, 1)) * p.rank(p.open - p.delay(p.close, 1)) * p.rank(p.open - p.delay(p.low, 1)),
    108: lambda p: p.rank(p.high - p.min(p.high, 2)) ** p.rank(p.corr(p.vwap, adv(p, 120), 6)) * -1,
    109: lambda p: p.sma(p.high - p.low, 10, 2) / p.sma(p.sma(p.high - p.low, 10, 2), 10, 2),
    110: lambda p: p.sum(p.max(0, p.high - p.delay(p.close, 1)), 20) / p.sum(p.max(0, p.delay(p.close, 1) - p.low), 20) * 100,
    111: lambda p: p.sma(p.volume * close_position(p), 11, 2) - p.sma(p.volume * close_position(p), 4, 2),
    112: lambda p: (p.sum(_gap(p, True), 12) - p.sum(_gap(p, False), 12)) / (p.sum(_gap(p, True), 12) + p.sum(_gap(p, False), 12)) * 100,
    113: lambda p: -(
        p.rank(p.sum(p.delay(p.close, 5), 20) / 20) * p.corr(p.close, p.volume, 2) * p.rank(p.corr(p.sum(p.close, 5), p.sum(p.close, 20), 2))
    ),
    114: lambda p: p.rank(p.delay((p.high - p.low) / (p.sum(p.close, 5) / 5), 2))
    * p.rank(p.rank(p.volume))
    / ((p.high - p.low) / (p.sum(p.close, 5) / 5) / (p.vwap - p.close)),
    115: lambda p: p.rank(p.corr(p.high * 0.9 + p.close * 0.1, adv(p, 30), 10)) ** p.rank(p.corr(p.ts_rank(mid(p), 4), p.ts_rank(p.volume, 10), 7)),
    116: lambda p: p.regbeta(p.close, 20),
    117: lambda p: p.ts_rank(p.volume, 32) * (1 - p.ts_rank(p.close + p.high - p.low, 16)) * (1 - p.ts_rank(p.returns, 32)),
    118: lambda p: p.sum(p.high - p.open, 20) / p.sum(p.open - p.low, 20) * 100,
    119: lambda p: p.rank(p.decay(p.corr(p.vwap, p.sum(adv(p, 5), 26), 5), 7))
    - p.rank(p.decay(p.ts_rank(p.min(p.corr(p.rank(p.open), p.rank(adv(p, 15)), 21), 9), 7), 8)),
    120: lambda p: p.rank(p.vwap - p.close) / p.rank(p.vwap + p.close),
    121: lambda p: p.rank(p.vwap - p.min(p.vwap, 12)) ** p.ts_rank(p.corr(p.ts_rank(p.vwap, 20), p.ts_rank(adv(p, 60), 2), 18), 3) * -1,
    122: lambda p: growth(p, _ema_log(p)),
    123: lambda p: (p.rank(p.corr(p.sum(mid(p), 20), p.sum(adv(p, 60), 20), 9)) < p.rank(p.corr(p.low, p.volume, 6))) * -1,
    124: lambda p: (p.close - p.vwap) / p.decay(p.rank(p.ts_max(p.close, 30)), 2),
    125: lambda p: p.rank(p.decay(p.corr(p.vwap, adv(p, 80), 17), 20)) / p.rank(p.decay(p.delta(p.close * 0.5 + p.vwap * 0.5, 3), 16)),
    126: typical,
    127: lambda p: p.mean((100 * (p.close - p.max(p.close, 12)) / p.max(p.close, 12)) ** 2) ** 0.5,
    128: lambda p: 100 - 100 / (1 + _directed_flow(p, True) / _directed_flow(p, False)),
    129: lambda p: p.sum(_gap(p, False), 12),
    130: lambda p: p.rank(p.decay(p.corr(mid(p), adv(p, 40), 9), 10)) / p.rank(p.decay(p.corr(p.rank(p.vwap), p.rank(p.volume), 7), 3)),
    131: lambda p: p.rank(p.delta(p.vwap, 1)) ** p.ts_rank(p.corr(p.close, adv(p, 50), 18), 18),
    132: lambda p: p.mean(p.amount, 20),
    133: lambda p: (20 - p.highday(p.high, 20)) / 20 * 100 - (20 - p.lowday(p.low, 20)) / 20 * 100,
    134: lambda p: growth(p, p.close, 12) * p.volume,
    135: lambda p: p.sma(p.delay(step(p, p.close, 20), 1), 20, 1),
    136: lambda p: -p.rank(p.delta(p.returns, 3)) * p.corr(p.open, p.volume, 10),
    137: swing,
    138: lambda p: (
        p.rank(p.decay(p.delta(p.low * 0.7 + p.vwap * 0.3, 3), 20))
        - p.ts_rank(p.decay(p.ts_rank(p.corr(p.ts_rank(p.low, 8), p.ts_rank(adv(p, 60), 17), 5), 19), 16), 7)
    )
    * -1,
    139: lambda p: -p.corr(p.open, p.volume, 10),
    140: lambda p: p.min(
        p.rank(p.decay((p.rank(p.open) + p.rank(p.low)) - (p.rank(p.high) + p.rank(p.close)), 8)),
        p.ts_rank(p.decay(p.corr(p.ts_rank(p.close, 8), p.ts_rank(adv(p, 60), 20), 8), 7), 3),
    ),
    141: lambda p: p.rank(p.corr(p.rank(p.high), p.rank(adv(p, 15)), 9)) * -1,
    142: lambda p: -p.rank(p.ts_rank(p.close, 10)) * p.rank(p.delta(p.delta(p.close, 1), 1)) * p.rank(p.ts_rank(relative_volume(p), 5)),
    144: lambda p: p.sumif(p.abs(step(p, p.close) - 1) / p.amount, 20, falls(p)) / p.count(falls(p), 20),
    145: lambda p: (adv(p, 9) - adv(p, 26)) / adv(p, 12) * 100,
    146: lambda p: p.mean(_return_gap(p)[0] - _return_gap(p)[1], 20)
    * (_return_gap(p)[0] - _return_gap(p)[1])
    / p.sma((_return_gap(p)[0] - (_return_gap(p)[0] - _return_gap(p)[1])) ** 2, 60, 2),
    147: lambda p: p.regbeta(p.mean(p.close, 12), 12),
    148: lambda p: (p.rank(p.corr(p.open, p.sum(adv(p, 60), 9), 6)) < p.rank(p.open - p.ts_min(p.open, 14))) * -1,
    150: lambda p: typical(p) * p.volume,
    151: lambda p: p.sma(p.close - p.delay(p.close, 20), 20, 1),
    152: lambda p: p.sma(_lagged_means(p, p.delay(step(p, p.close, 9), 1)), 9, 1),
    153: lambda p: _mean_ladder(p) / 4,
    154: lambda p: (p.vwap - p.min(p.vwap, 16)) < p.corr(p.vwap, adv(p, 180), 18),
    155: lambda p: _net_moves(p, p.volume)[0] - _net_moves(p, p.volume)[1],
    156: lambda p: p.max(
        p.rank(p.decay(p.delta(p.vwap, 5), 3)),
        p.rank(p.decay(p.delta(p.open * 0.15 + p.low * 0.85, 2) / (p.open * 0.15 + p.low * 0.85) * -1, 3)),
    )
    * -1,
    157: lambda p: p.min(p.product(p.rank(p.rank(p.log(p.sum(p.ts_min(p.rank(p.rank(-p.rank(p.delta(p.close - 1, 5)))), 2), 1)))), 1), 5)
    + p.ts_rank(p.delay(-p.returns, 6), 5),
    158: lambda p: ((p.high - p.sma(p.close, 15, 2)) - (p.low - p.sma(p.close, 15, 2))) / p.close,
    159: lambda p: (_range_position(p, 6) * 12 * 24 + _range_position(p, 12) * 6 * 24 + _range_position(p, 24) * 6 * 24) * 100 / (6 * 12 + 6 * 24 + 12 * 24),
    160: down_volatility,
    161: lambda p: p.mean(true_range(p), 12),
    162: _relative_strength_band,
    163: lambda p: p.rank(-p.returns * adv(p) * p.vwap * (p.high - p.close)),
    164: lambda p: p.sma((_reciprocal_rise(p) - p.min(_reciprocal_rise(p), 12)) / (p.high - p.low) * 100, 13, 2),
    165: lambda p: p.close,
    166: _skew,
    167: lambda p: p.sum(_gap(p, True), 12),
    168: lambda p: -p.volume / adv(p),
    169: lambda p: p.sma(_lagged_means(p, p.close - p.delay(p.close, 1)), 10, 1),
    170: lambda p: p.rank(1 / p.close) * p.volume / adv(p) * (p.high * p.rank(p.high - p.close) / (p.sum(p.high, 5) / 5))
    - p.rank(p.vwap - p.delay(p.vwap, 5)),
    171: lambda p: -((p.low - p.close) * p.open**5) / ((p.close - p.high) * p.close**5),
    172: directional_index,
    173: lambda p: 3 * p.sma(p.close, 13, 2) - 2 * p.sma(p.sma(p.close, 13, 2), 13, 2) + _ema_log(p),
    174: up_volatility,
    175: lambda p: p.mean(true_range(p), 6),
    176: lambda p: p.corr(p.rank((p.close - p.ts_min(p.low, 12)) / (p.ts_max(p.high, 12) - p.ts_min(p.low, 12))), p.rank(p.volume), 6),
    177: lambda p: (20 - p.highday(p.high, 20)) / 20 * 100,
    178: lambda p: growth(p, p.close) * p.volume,
    179: lambda p: p.rank(p.corr(p.vwap, p.volume, 4)) * p.rank(p.corr(p.rank(p.low), p.rank(adv(p, 50)), 12)),
    180: lambda p: volume_breakout(p, -p.volume),
    183: lambda p: p.close,
    184: lambda p: p.rank(p.corr(p.delay(p.open - p.close, 1), p.close, 200)) + p.rank(p.open - p.close),
    185: lambda p: p.rank(-((1 - p.open / p.close) ** 2)),
    186: lambda p: (directional_index(p) + p.delay(directional_index(p), 6)) / 2,
    187: lambda p: p.sum(p.where(p.open <= p.delay(p.open, 1), 0, p.max(p.high - p.open, p.open - p.delay(p.open, 1))), 20),
    188: lambda p: (p.high - p.low - p.sma(p.high - p.low, 11, 2)) / p.sma(p.high - p.low, 11, 2) * 100,
    189: lambda p: p.mean(p.abs(p.close - p.mean(p.close, 6)), 6),
    190: _asymmetry,
    191: lambda p: (p.corr(adv(p), p.low, 5) + mid(p)) - p.close,
}
