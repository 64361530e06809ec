"""Rolling functions against a direct loop over each code's values."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import windows as W


def series(df, column):
    out = {}
    for r in df.select("code", "dt", F.col(column)).orderBy("code", "dt").collect():
        out.setdefault(r.code, []).append(r[column])
    return out


def loop(values, n, fn, short=False):
    """fn over the last n values, None unless all are present."""
    n = min(n, len(values)) if short else n
    out = []
    for i in range(len(values)):
        w = values[max(0, i - n + 1) : i + 1]
        out.append(fn(w) if len(w) == n and all(v is not None for v in w) else None)
    return out


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, abs_tol=1e-9))


def check(df, column, expression, fn, n, short=False):
    got = series(df.withColumn("v", expression), "v")
    for code, values in series(df, column).items():
        want = loop(values, n, fn, short)
        assert all(close(a, b) for a, b in zip(got[code], want)), (code, got[code], want)


def pstd(w):
    m = sum(w) / len(w)
    return math.sqrt(sum((v - m) ** 2 for v in w) / len(w))


def rank_last(w):
    less, same = sum(v < w[-1] for v in w), sum(v == w[-1] for v in w)
    return 2 * ((less + (same - 1) / 2) / (len(w) - 1) - 0.5) if len(w) > 1 else 0.0


CASES = [
    (W.ts_sum, sum),
    (W.mean, lambda w: sum(w) / len(w)),
    (W.stddev, pstd),
    (W.ts_min, min),
    (W.ts_max, max),
    (W.ts_argmax, lambda w: w[::-1].index(max(w))),
    (W.ts_argmin, lambda w: w[::-1].index(min(w))),
    (W.ts_rank, rank_last),
    (W.product, math.prod),
    (W.lowday, lambda w: len(w) - 1 - w.index(min(w))),
    (W.highday, lambda w: w[::-1].index(max(w))),
    (W.decay_linear, lambda w: sum(v * (len(w) - i) for i, v in enumerate(w)) / (len(w) * (len(w) + 1) / 2)),
]


@pytest.mark.parametrize("fn,direct", CASES, ids=[f.__name__ for f, _ in CASES])
@pytest.mark.parametrize("column", ["x", "z"])
def test_full_window(tiny, fn, direct, column):
    check(tiny, column, fn(F.col(column), 4), direct, 4)


@pytest.mark.parametrize("fn,direct", CASES, ids=[f.__name__ for f, _ in CASES])
def test_short_history_uses_all_of_it(tiny, fn, direct):
    check(tiny, "x", fn(F.col("x"), 40, length=W.history_length()), direct, 40, short=True)


def test_zero_filled_family(tiny):
    got = series(tiny.withColumn("v", W.decay_linear(F.col("z"), 3, compat=True)), "v")
    for code, values in series(tiny, "z").items():
        v = [x or 0.0 for x in values]
        want = [0.0, 0.0] + [(v[i - 2] * 3 + v[i - 1] * 2 + v[i]) / 6 for i in range(2, len(v))]
        assert all(close(a, b) for a, b in zip(got[code], want))


def test_two_tap_smoothing(tiny):
    got = series(tiny.withColumn("v", W.sma(F.col("x"), 5, 2)), "v")
    for code, v in series(tiny, "x").items():
        want = [v[0]] + [(v[i] * 2 + v[i - 1] * 3) / 5 for i in range(1, len(v))]
        assert all(close(a, b) for a, b in zip(got[code], want))


def test_regbeta_is_scaled_slope(tiny):
    def slope(w):
        n = len(w)
        centre = (n - 1) / 2
        return sum((i - centre) * v for i, v in enumerate(w)) / (n * (n * n - 1) / 12) * n / (n - 1)

    check(tiny, "x", W.regbeta(F.col("x"), 5), slope, 5)


def test_fill_directions(tiny):
    df = tiny.withColumns({"f": W.ffill(F.col("z")), "b": W.bfill(F.col("z"))})
    forward, backward = series(df, "f"), series(df, "b")
    for code, values in series(tiny, "z").items():
        for i in range(len(values)):
            before = [v for v in values[: i + 1] if v is not None]
            after = [v for v in values[i:] if v is not None]
            assert forward[code][i] == (before[-1] if before else None)
            assert backward[code][i] == (after[0] if after else None)


def test_input_order_does_not_matter(tiny):
    shuffled = tiny.orderBy(F.rand(3)).repartition(3)
    left = tiny.select("code", "dt", W.ts_rank(F.col("x"), 5).alias("v"))
    right = shuffled.select("code", "dt", W.ts_rank(F.col("x"), 5).alias("v"))
    assert left.exceptAll(right).count() == 0
