"""Recursions and candles against direct computations on short series."""

import math

import numpy as np
import pytest

from tessera.operators.indicators import recursive as R
from tessera.operators.indicators.candles import candles
from tessera.operators.registry import INDICATORS, factor, parse
from tests.conftest import day


def wave(n=160):
    t = np.arange(n)
    return 100 + 10 * np.sin(2 * np.pi * t / 20) + 0.05 * t


def test_dominant_cycle_finds_the_period():
    period = R.ht_dcperiod(wave())[0]
    assert np.isnan(period[:32]).all()
    assert abs(np.nanmean(period[80:]) - 20) < 1.5


def test_sine_follows_a_clean_cycle():
    sine, lead = R.ht_sine(wave())
    assert np.isnan(sine[:63]).all()
    assert np.nanmax(np.abs(sine)) <= 1
    crossings = np.sum(np.diff(np.sign(sine[70:] - lead[70:])) != 0)
    assert 6 <= crossings <= 12  # two per 20-row cycle over 90 rows


def test_trend_mode_of_a_steep_line():
    assert R.ht_trendmode(np.linspace(100, 300, 160))[0][-20:].min() == 1


def test_trendline_of_a_constant_is_the_constant():
    assert np.allclose(R.ht_trendline(np.full(120, 7.0))[0][63:], 7.0)


def test_mama_stays_in_range_and_fama_lags():
    mama, fama = R.mama(np.linspace(100, 200, 200), 0.5, 0.05)
    assert np.nanmax(mama) <= 200 and (mama[100:] >= fama[100:]).all()


def test_name_syntax():
    assert parse("close") == ("close", [], 0)
    assert parse("EMA_14_2") == ("EMA", [14], 2)
    assert parse("MACD_0") == ("MACD", [], 0)


def bars(spark, rows):
    return spark.createDataFrame(
        [(1, day(i), *map(float, r)) for i, r in enumerate(rows)],
        "code long, dt date, open double, high double, low double, close double, volume double, amount double",
    )


@pytest.mark.parametrize("name", sorted(n for n in INDICATORS if not n.startswith("CDL")))
def test_every_indicator_survives_short_and_flat_history(spark, name):
    df = bars(spark, [(5, 5, 5, 5, 10, 50)] * 3)
    entry = INDICATORS[name]
    out = entry.build(df, *entry.defaults)
    assert out.count() == 3
    assert set(entry.outputs) <= set(out.columns)


def test_shifted_factor(spark):
    df = bars(spark, [(i, i + 1, i - 1, i, 10, 50) for i in range(1, 8)])
    got = [r["MOM_2_1"] for r in factor(df, "MOM_2_1").orderBy("dt").collect()]
    assert got == [None, None, None, 2.0, 2.0, 2.0, 2.0]


def test_candles_on_hand_made_bars(spark):
    calm = [(10, 11.5, 9.5, 11, 1, 1), (11, 11.5, 9.5, 10, 1, 1)] * 6  # body 1, range 2
    doji = bars(spark, [*calm, (10, 11, 9, 10.05, 1, 1)])
    row = candles(doji, ["DOJI", "MARUBOZU"]).orderBy("dt").collect()[-1]
    assert (row.CDLDOJI, row.CDLMARUBOZU) == (100, 0)
    full = bars(spark, [*calm, (10, 14.01, 9.99, 14, 1, 1)])
    row = candles(full, ["DOJI", "MARUBOZU", "ENGULFING"]).orderBy("dt").collect()[-1]
    assert (row.CDLDOJI, row.CDLMARUBOZU) == (0, 100)
    engulf = bars(spark, [*calm, (11, 11.2, 9.8, 10, 1, 1), (9.5, 12.2, 9.4, 12, 1, 1)])
    assert candles(engulf, ["ENGULFING"]).orderBy("dt").collect()[-1].CDLENGULFING == 100


def test_confirmed_hikkake(spark):
    calm = [(10, 12, 8, 11, 1, 1)] * 3
    rows = [*calm, (10, 11, 9, 10, 1, 1), (9, 10.5, 8.5, 9, 1, 1), (10, 12, 9.5, 11.8, 1, 1)]
    got = [r.CDLHIKKAKE for r in candles(bars(spark, rows), ["HIKKAKE"]).orderBy("dt").collect()]
    assert got[-2:] == [100, 200]


@pytest.mark.parametrize("name", ["MAMA", "HT_DCPERIOD", "HT_PHASOR", "HT_DCPHASE", "HT_SINE", "HT_TRENDLINE", "HT_TRENDMODE"])
def test_cycle_filters_on_many_codes_equal_single_codes(name):
    """The filters went code by code, row by row; now a step is taken for many codes at once."""
    rng, lengths = np.random.default_rng(3), [120, 90, 70, 40, 13, 3, 1]
    series = [100 + rng.normal(0, 2, n).cumsum() for n in lengths]
    together = np.zeros((max(lengths), len(lengths)))
    for j, x in enumerate(series):
        together[: len(x), j] = x
    kernel, args = getattr(R, name.lower()), INDICATORS[name].defaults
    many = kernel(together, *args)
    for j, x in enumerate(series):
        for got, want in zip(many, kernel(x[:, None], *args)):
            assert np.allclose(got[: len(x), j], want[:, 0], rtol=1e-12, equal_nan=True)
    assert all(np.isfinite(v[-1, 0]) and np.isnan(v[0]).all() for v in many)
