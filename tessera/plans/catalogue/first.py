"""Catalogue of 101 formulas: those that need no group neutralisation or market cap."""

from __future__ import annotations

from tessera.plans.catalogue.motifs import (
    adv,
    blend,
    close_position,
    close_slope,
    direction_count,
    drift_switch,
    mid,
    price_volume_product,
    relative_volume,
    trend_band,
    volume_breakout,
)


def _streak(p, n):
    """The day's move, reversed unless the last n moves share a sign."""
    d = p.delta(p.close, 1)
    return p.where(p.ts_min(d, n) > 0, d, p.where(p.ts_max(d, n) < 0, d, -d))


FORMULAS = {
    1: lambda p: p.rank(p.ts_argmax(p.signedpower(p.where(p.returns < 0, p.stddev(p.returns, 20), p.close), 2), 5)) - 0.5,
    2: lambda p: -p.corr(p.rank(p.delta(p.log(p.volume), 2)), p.rank((p.close - p.open) / p.open), 6),
    3: lambda p: -p.corr(p.rank(p.open), p.rank(p.volume), 10),
    4: lambda p: -p.ts_rank(p.rank(p.low), 9),
    5: lambda p: p.rank(p.open - p.sum(p.vwap, 10) / 10) * (-1 * p.abs(p.rank(p.close - p.vwap))),
    6: lambda p: -p.corr(p.open, p.volume, 10),
    7: lambda p: volume_breakout(p, -1),
    8: lambda p: -p.rank(price_volume_product(p)),
    9: lambda p: _streak(p, 5),
    10: lambda p: p.rank(_streak(p, 4)),
    11: lambda p: (p.rank(p.ts_max(p.vwap - p.close, 3)) + p.rank(p.ts_min(p.vwap - p.close, 3)))
    * p.rank(p.delta(p.volume, 3)),
    12: lambda p: p.sign(p.delta(p.volume, 1)) * (-p.delta(p.close, 1)),
    13: lambda p: -p.rank(p.cov(p.rank(p.close), p.rank(p.volume), 5)),
    14: lambda p: -p.rank(p.delta(p.returns, 3)) * p.corr(p.open, p.volume, 10),
    15: lambda p: -p.sum(p.rank(p.corr(p.rank(p.high), p.rank(p.volume), 3)), 3),
    16: lambda p: -p.rank(p.cov(p.rank(p.high), p.rank(p.volume), 5)),
    17: lambda p: -p.rank(p.ts_rank(p.close, 10)) * p.rank(p.delta(p.delta(p.close, 1), 1)) * p.rank(p.ts_rank(relative_volume(p), 5)),
    18: lambda p: -p.rank(p.stddev(p.abs(p.close - p.open), 5) + (p.close - p.open) + p.corr(p.close, p.open, 10)),
    19: lambda p: -p.sign((p.close - p.delay(p.close, 7)) + p.delta(p.close, 7)) * (1 + p.rank(1 + p.sum(p.returns, 250))),
    20: lambda p: -p.rank(p.open - p.delay(p.high, 1)) * p.rank(p.open - p.delay(p.close, 1)) * p.rank(p.open - p.delay(p.low, 1)),
    21: lambda p: trend_band(p, -1),
    22: lambda p: -(p.delta(p.corr(p.high, p.volume, 5), 5) * p.rank(p.stddev(p.close, 20))),
    23: lambda p: p.where(p.sum(p.high, 20) / 20 < p.high, -p.delta(p.high, 2), 0),
    24: drift_switch,
    25: lambda p: p.rank(-p.returns * adv(p) * p.vwap * (p.high - p.close)),
    26: lambda p: -p.ts_max(p.corr(p.ts_rank(p.volume, 5), p.ts_rank(p.high, 5), 5), 3),
    27: lambda p: p.where(0.5 < p.rank(p.sum(p.corr(p.rank(p.volume), p.rank(p.vwap), 6), 2) / 2.0), -1, 1),
    28: lambda p: p.scale(p.corr(adv(p), p.low, 5) + mid(p) - p.close),
    29: lambda p: p.min(
        p.product(p.rank(p.rank(p.scale(p.log(p.sum(p.ts_min(p.rank(p.rank(-p.rank(p.delta(p.close - 1, 5)))), 2), 1))))), 1), 5
    )
    + p.ts_rank(p.delay(-p.returns, 6), 5),
    30: lambda p: (1.0 - p.rank(direction_count(p))) * p.sum(p.volume, 5) / p.sum(p.volume, 20),
    31: lambda p: p.rank(p.rank(p.rank(p.decay(-p.rank(p.rank(p.delta(p.close, 10))), 10))))
    + p.rank(-p.delta(p.close, 3))
    + p.sign(p.scale(p.corr(adv(p), p.low, 12))),
    32: lambda p: p.scale(p.sum(p.close, 7) / 7 - p.close) + 20 * p.scale(p.corr(p.vwap, p.delay(p.close, 5), 230)),
    33: lambda p: p.rank(-((1 - p.open / p.close) ** 1)),
    34: lambda p: p.rank((1 - p.rank(p.stddev(p.returns, 2) / p.stddev(p.returns, 5))) + (1 - p.rank(p.delta(p.close, 1)))),
    35: lambda p: p.ts_rank(p.volume, 32) * (1 - p.ts_rank(p.close + p.high - p.low, 16)) * (1 - p.ts_rank(p.returns, 32)),
    36: lambda p: 2.21 * p.rank(p.corr(p.close - p.open, p.delay(p.volume, 1), 15))
    + 0.7 * p.rank(p.open - p.close)
    + 0.73 * p.rank(p.ts_rank(p.delay(-p.returns, 6), 5))
    + p.rank(p.abs(p.corr(p.vwap, adv(p), 6)))
    + 0.6 * p.rank((p.sum(p.close, 200) / 200 - p.open) * (p.close - p.open)),
    37: lambda p: p.rank(p.corr(p.delay(p.open - p.close, 1), p.close, 200)) + p.rank(p.open - p.close),
    38: lambda p: -p.rank(p.ts_rank(p.close, 10)) * p.rank(p.close / p.open),
    39: lambda p: -p.rank(p.delta(p.close, 7) * (1 - p.rank(p.decay(relative_volume(p), 9)))) * (1 + p.rank(p.sum(p.returns, 250))),
    40: lambda p: -p.rank(p.stddev(p.high, 10)) * p.corr(p.high, p.volume, 10),
    41: lambda p: (p.high * p.low) ** 0.5 - p.vwap,
    42: lambda p: p.rank(p.vwap - p.close) / p.rank(p.vwap + p.close),
    43: lambda p: p.ts_rank(relative_volume(p), 20) * p.ts_rank(-p.delta(p.close, 7), 8),
    44: lambda p: -p.corr(p.high, p.rank(p.volume), 5),
    45: lambda p: -(
        p.rank(p.sum(p.delay(p.close, 5), 20) / 20) * p.corr(p.close, p.volume, 2) * p.rank(p.corr(p.sum(p.close, 5), p.sum(p.close, 20), 2))
    ),
    46: lambda p: p.where(0.25 < close_slope(p), -1, p.where(close_slope(p) < 0, 1, -(p.close - p.delay(p.close, 1)))),
    47: lambda p: p.rank(1 / p.close) * p.volume / adv(p) * (p.high * p.rank(p.high - p.close) / (p.sum(p.high, 5) / 5))
    - p.rank(p.vwap - p.delay(p.vwap, 5)),
    49: lambda p: p.where(close_slope(p) < -0.1, 1, -(p.close - p.delay(p.close, 1))),
    50: lambda p: -p.ts_max(p.rank(p.corr(p.rank(p.volume), p.rank(p.vwap), 5)), 5),
    51: lambda p: p.where(close_slope(p) < -0.05, 1, -(p.close - p.delay(p.close, 1))),
    52: lambda p: (-p.ts_min(p.low, 5) + p.delay(p.ts_min(p.low, 5), 5))
    * p.rank((p.sum(p.returns, 240) - p.sum(p.returns, 20)) / 220)
    * p.ts_rank(p.volume, 5),
    53: lambda p: -p.delta(((p.close - p.low) - (p.high - p.close)) / (p.close - p.low), 9),
    54: lambda p: -((p.low - p.close) * p.open**5) / ((p.low - p.high) * p.close**5),
    55: lambda p: -p.corr(
        p.rank((p.close - p.ts_min(p.low, 12)) / (p.ts_max(p.high, 12) - p.ts_min(p.low, 12))), p.rank(p.volume), 6
    ),
    57: lambda p: 0 - (p.close - p.vwap) / p.decay(p.rank(p.ts_argmax(p.close, 30)), 2),
    60: lambda p: 0 - (2 * p.scale(p.rank(close_position(p) * p.volume)) - p.scale(p.rank(p.ts_argmax(p.close, 10)))),
    61: lambda p: p.rank(p.vwap - p.ts_min(p.vwap, 16)) < p.rank(p.corr(p.vwap, adv(p, 180), 17)),
    62: lambda p: (
        p.rank(p.corr(p.vwap, p.sum(adv(p), 22), 9)) < p.rank((p.rank(p.open) + p.rank(p.open)) < (p.rank(mid(p)) + p.rank(p.high)))
    )
    * -1,
    64: lambda p: (
        p.rank(p.corr(p.sum(blend(p.open, p.low, 0.178404), 12), p.sum(adv(p, 120), 12), 16)) < p.rank(p.delta(blend(mid(p), p.vwap, 0.178404), 3))
    )
    * -1,
    65: lambda p: (
        p.rank(p.corr(blend(p.open, p.vwap, 0.00817205), p.sum(adv(p, 60), 8), 6)) < p.rank(p.open - p.ts_min(p.open, 13))
    )
    * -1,
    66: lambda p: (
        p.rank(p.decay(p.delta(p.vwap, 3), 7)) + p.ts_rank(p.decay((blend(p.low, p.low, 0.96633) - p.vwap) / (p.open - mid(p)), 11), 6)
    )
    * -1,
    68: lambda p: (p.ts_rank(p.corr(p.rank(p.high), p.rank(adv(p, 15)), 8), 13) < p.rank(p.delta(blend(p.close, p.low, 0.518371), 1))) * -1,
    71: lambda p: p.max(
        p.ts_rank(p.decay(p.corr(p.ts_rank(p.close, 3), p.ts_rank(adv(p, 180), 12), 18), 4), 15),
        p.ts_rank(p.decay(p.rank((p.low + p.open) - (p.vwap + p.vwap)) ** 2, 16), 4),
    ),
    72: lambda p: p.rank(p.decay(p.corr(mid(p), adv(p, 40), 8), 10)) / p.rank(p.decay(p.corr(p.ts_rank(p.vwap, 3), p.ts_rank(p.volume, 18), 6), 2)),
    73: lambda p: p.max(
        p.rank(p.decay(p.delta(p.vwap, 4), 2)),
        p.ts_rank(p.decay(p.delta(blend(p.open, p.low, 0.147155), 2) / blend(p.open, p.low, 0.147155) * -1, 3), 16),
    )
    * -1,
    74: lambda p: (
        p.rank(p.corr(p.close, p.sum(adv(p, 30), 37), 15)) < p.rank(p.corr(p.rank(blend(p.high, p.vwap, 0.0261661)), p.rank(p.volume), 11))
    )
    * -1,
    75: lambda p: p.rank(p.corr(p.vwap, p.volume, 4)) < p.rank(p.corr(p.rank(p.low), p.rank(adv(p, 50)), 12)),
    77: lambda p: p.min(
        p.rank(p.decay((mid(p) + p.high) - (p.vwap + p.high), 20)), p.rank(p.decay(p.corr(mid(p), adv(p, 40), 3), 5))
    ),
    78: lambda p: p.rank(p.corr(p.sum(blend(p.low, p.vwap, 0.352233), 19), p.sum(adv(p, 40), 19), 6))
    ** p.rank(p.corr(p.rank(p.vwap), p.rank(p.volume), 5)),
    81: lambda p: (
        p.rank(p.log(p.product(p.rank(p.rank(p.corr(p.vwap, p.sum(adv(p, 10), 49), 8)) ** 4), 14)))
        < p.rank(p.corr(p.rank(p.vwap), p.rank(p.volume), 5))
    )
    * -1,
    83: lambda p: p.rank(p.delay((p.high - p.low) / (p.sum(p.close, 5) / 5), 2))
    * p.rank(p.rank(p.volume))
    / ((p.high - p.low) / (p.sum(p.close, 5) / 5) / (p.vwap - p.close)),
    84: lambda p: p.signedpower(p.ts_rank(p.vwap - p.ts_max(p.vwap, 15), 20), p.delta(p.close, 4)),
    85: lambda p: p.rank(p.corr(blend(p.high, p.close, 0.876703), adv(p, 30), 9))
    ** p.rank(p.corr(p.ts_rank(mid(p), 3), p.ts_rank(p.volume, 10), 7)),
    86: lambda p: (p.ts_rank(p.corr(p.close, p.sum(adv(p), 14), 6), 20) < p.rank((p.open + p.close) - (p.vwap + p.open))) * -1,
    88: lambda p: p.min(
        p.rank(p.decay((p.rank(p.open) + p.rank(p.low)) - (p.rank(p.high) + p.rank(p.close)), 8)),
        p.ts_rank(p.decay(p.corr(p.ts_rank(p.close, 8), p.ts_rank(adv(p, 60), 20), 8), 6), 2),
    ),
    92: lambda p: p.min(
        p.ts_rank(p.decay((mid(p) + p.close) < (p.low + p.open), 14), 18),
        p.ts_rank(p.decay(p.corr(p.rank(p.low), p.rank(adv(p, 30)), 7), 6), 6),
    ),
    94: lambda p: p.rank(p.vwap - p.ts_min(p.vwap, 11)) ** p.ts_rank(p.corr(p.ts_rank(p.vwap, 19), p.ts_rank(adv(p, 60), 4), 18), 2) * -1,
    95: lambda p: p.rank(p.open - p.ts_min(p.open, 12)) < p.ts_rank(p.rank(p.corr(p.sum(mid(p), 19), p.sum(adv(p, 40), 19), 12)) ** 5, 11),
    96: lambda p: p.max(
        p.ts_rank(p.decay(p.corr(p.rank(p.vwap), p.rank(p.volume), 3), 4), 8),
        p.ts_rank(p.decay(p.ts_argmax(p.corr(p.ts_rank(p.close, 7), p.ts_rank(adv(p, 60), 4), 3), 12), 14), 13),
    )
    * -1,
    98: lambda p: p.rank(p.decay(p.corr(p.vwap, p.sum(adv(p, 5), 26), 4), 7))
    - p.rank(p.decay(p.ts_rank(p.ts_argmin(p.corr(p.rank(p.open), p.rank(adv(p, 15)), 20), 8), 6), 8)),
    99: lambda p: (p.rank(p.corr(p.sum(mid(p), 19), p.sum(adv(p, 60), 19), 8)) < p.rank(p.corr(p.low, p.volume, 6))) * -1,
    101: lambda p: (p.close - p.open) / ((p.high - p.low) + 0.001),
}
