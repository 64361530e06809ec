"""Candlestick patterns.

Every pattern is one SQL condition over the last few bars, named by how many rows back they
lie: o1 is the previous open. Per bar k: o h l c, body (size of the body), up/dn (shadows),
top/bot (body ends), g (+1 white, -1 black) and the trailing thresholds long, doji, tiny,
shade, near, far, same.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import windows as W
from tessera.operators.registry import indicator

DEPTH = 5

# Threshold name -> (measure, rows averaged, factor). The average covers the rows
# before the bar itself.
THRESHOLDS = {
    "long": ("body", 10, 1.0),  # also the limit of a short body
    "doji": ("span", 10, 0.1),
    "tiny": ("span", 10, 0.1),  # very short shadow
    "shade": ("shadows", 10, 0.5),  # short shadow: half the average of both
    "near": ("span", 5, 0.2),
    "far": ("span", 5, 0.6),
    "same": ("span", 5, 0.05),
}


def _gap_up(a: int, b: int) -> str:
    return f"bot{a} > top{b}"


def _gap_down(a: int, b: int) -> str:
    return f"top{a} < bot{b}"


def _colours(**bars: int) -> str:
    return " and ".join(f"g{k[1:]} = {v}" for k, v in bars.items())


def _bare(k: int) -> str:
    return f"up{k} < tiny{k} and dn{k} < tiny{k}"


_WHITE3 = _colours(b2=1, b1=1, b0=1) + " and c0 > c1 and c1 > c2"
_BLACK3 = _colours(b2=-1, b1=-1, b0=-1)
_KICK = f"g1 = -g0 and body1 > long1 and {_bare(1)} and body0 > long0 and {_bare(0)} and ((g1 = -1 and l0 > h1) or (g1 = 1 and h0 < l1))"
_INSIDE = "top0 < top1 and bot0 > bot1"
_TOUCH = "top0 <= top1 and bot0 >= bot1"
_BELOW = "g1 = -1 and body1 > long1 and g0 = 1 and o0 < l1"

# name -> (bars, condition, value)
PATTERNS: dict[str, tuple[int, str, str]] = {
    # one bar
    "BELTHOLD": (1, "body0 > long0 and ((g0 = 1 and dn0 < tiny0) or (g0 = -1 and up0 < tiny0))", "g0 * 100"),
    "CLOSINGMARUBOZU": (1, "body0 > long0 and ((g0 = 1 and up0 < tiny0) or (g0 = -1 and dn0 < tiny0))", "g0 * 100"),
    "DOJI": (1, "body0 <= doji0", "100"),
    "DRAGONFLYDOJI": (1, "body0 <= doji0 and up0 < tiny0 and dn0 > tiny0", "100"),
    "GRAVESTONEDOJI": (1, "body0 <= doji0 and dn0 < tiny0 and up0 > tiny0", "100"),
    "HIGHWAVE": (1, "body0 < long0 and up0 > 2 * body0 and dn0 > 2 * body0", "g0 * 100"),
    "LONGLEGGEDDOJI": (1, "body0 <= doji0 and (dn0 > body0 or up0 > body0)", "100"),
    "LONGLINE": (1, "body0 > long0 and up0 < shade0 and dn0 < shade0", "g0 * 100"),
    "MARUBOZU": (1, f"body0 > long0 and {_bare(0)}", "g0 * 100"),
    "RICKSHAWMAN": (
        1,
        "body0 <= doji0 and dn0 > body0 and up0 > body0 and bot0 <= l0 + (h0 - l0) / 2 + near0 "
        "and top0 >= l0 + (h0 - l0) / 2 - near0",
        "100",
    ),
    "SHORTLINE": (1, "body0 < long0 and up0 < shade0 and dn0 < shade0", "g0 * 100"),
    "SPINNINGTOP": (1, "body0 < long0 and up0 > body0 and dn0 > body0", "g0 * 100"),
    "TAKURI": (1, "body0 <= doji0 and up0 < tiny0 and dn0 > 2 * body0", "100"),
    # two bars
    "COUNTERATTACK": (2, "g1 = -g0 and body1 > long1 and body0 > long0 and c0 between c1 - same1 and c1 + same1", "g0 * 100"),
    "DARKCLOUDCOVER": (2, "g1 = 1 and body1 > long1 and g0 = -1 and o0 > h1 and c0 > o1 and c0 < c1 - body1 * 0.5", "-100"),
    "DOJISTAR": (
        2,
        f"body1 > long1 and body0 <= doji0 and ((g1 = 1 and {_gap_up(0, 1)}) or (g1 = -1 and {_gap_down(0, 1)}))",
        "-g1 * 100",
    ),
    "ENGULFING": (
        2,
        "(g0 = 1 and g1 = -1 and ((c0 >= o1 and o0 < c1) or (c0 > o1 and o0 <= c1))) or "
        "(g0 = -1 and g1 = 1 and ((o0 >= c1 and c0 < o1) or (o0 > c1 and c0 <= o1)))",
        "g0 * case when o0 <> c1 and c0 <> o1 then 100 else 80 end",
    ),
    "HAMMER": (2, "body0 < long0 and dn0 > body0 and up0 < tiny0 and bot0 <= l1 + near1", "100"),
    "HANGINGMAN": (2, "body0 < long0 and dn0 > body0 and up0 < tiny0 and bot0 >= h1 - near1", "-100"),
    "HARAMI": (2, f"body1 > long1 and body0 <= long0 and {_TOUCH}", f"-g1 * case when {_INSIDE} then 100 else 80 end"),
    "HARAMICROSS": (2, f"body1 > long1 and body0 <= doji0 and {_TOUCH}", f"-g1 * case when {_INSIDE} then 100 else 80 end"),
    "HOMINGPIGEON": (2, "g1 = -1 and g0 = -1 and body1 > long1 and body0 <= long0 and o0 < o1 and c0 > c1", "100"),
    "INNECK": (2, f"{_BELOW} and c0 >= c1 and c0 <= c1 + same1", "-100"),
    "INVERTEDHAMMER": (2, f"body0 < long0 and up0 > body0 and dn0 < tiny0 and {_gap_down(0, 1)}", "100"),
    "KICKING": (2, _KICK, "g0 * 100"),
    "KICKINGBYLENGTH": (2, _KICK, "case when body0 > body1 then g0 else g1 end * 100"),
    "MATCHINGLOW": (2, "g1 = -1 and g0 = -1 and c0 between c1 - same1 and c1 + same1", "100"),
    "ONNECK": (2, f"{_BELOW} and c0 between l1 - same1 and l1 + same1", "-100"),
    "PIERCING": (2, f"{_BELOW} and body0 > long0 and c0 < o1 and c0 > c1 + body1 * 0.5", "100"),
    "SEPARATINGLINES": (
        2,
        "g1 = -g0 and o0 between o1 - same1 and o1 + same1 and body0 > long0 "
        "and ((g0 = 1 and dn0 < tiny0) or (g0 = -1 and up0 < tiny0))",
        "g0 * 100",
    ),
    "SHOOTINGSTAR": (2, f"body0 < long0 and up0 > body0 and dn0 < tiny0 and {_gap_up(0, 1)}", "-100"),
    "THRUSTING": (2, f"{_BELOW} and c0 > c1 + same1 and c0 <= c1 + body1 * 0.5", "-100"),
    # three bars and more
    "2CROWS": (
        3,
        f"g2 = 1 and body2 > long2 and g1 = -1 and {_gap_up(1, 2)} and g0 = -1 and o0 < o1 and o0 > c1 and c0 > o2 and c0 < c2",
        "-100",
    ),
    "3BLACKCROWS": (
        3,
        f"g3 = 1 and {_BLACK3} and dn2 < tiny2 and dn1 < tiny1 and dn0 < tiny0 and o1 < o2 and o1 > c2 "
        "and o0 < o1 and o0 > c1 and h3 > c2 and c2 > c1 and c1 > c0",
        "-100",
    ),
    "3INSIDE": (
        3,
        "body2 > long2 and body1 <= long1 and top1 < top2 and bot1 > bot2 "
        "and ((g2 = 1 and g0 = -1 and c0 < o2) or (g2 = -1 and g0 = 1 and c0 > o2))",
        "-g2 * 100",
    ),
    "3LINESTRIKE": (
        3,
        "g3 = g2 and g2 = g1 and g0 = -g1 and o2 between bot3 - near3 and top3 + near3 and o1 between bot2 - near2 and top2 + near2 "
        "and ((g1 = 1 and c1 > c2 and c2 > c3 and o0 > c1 and c0 < o3) or (g1 = -1 and c1 < c2 and c2 < c3 and o0 < c1 and c0 > o3))",
        "g1 * 100",
    ),
    "3OUTSIDE": (
        3,
        "(g1 = 1 and g2 = -1 and c1 > o2 and o1 < c2 and c0 > c1) or (g1 = -1 and g2 = 1 and o1 > c2 and c1 < o2 and c0 < c1)",
        "g1 * 100",
    ),
    "3STARSINSOUTH": (
        3,
        f"{_BLACK3} and body2 > long2 and dn2 > body2 and body1 < body2 and o1 > c2 and o1 <= h2 and l1 < c2 and l1 >= l2 "
        f"and dn1 > tiny1 and body0 < long0 and {_bare(0)} and l0 > l1 and h0 < h1",
        "100",
    ),
    "3WHITESOLDIERS": (
        3,
        f"{_WHITE3} and up2 < tiny2 and up1 < tiny1 and up0 < tiny0 and o1 > o2 and o1 <= c2 + near2 and o0 > o1 "
        "and o0 <= c1 + near1 and body1 > body2 - far2 and body0 > body1 - far1 and body0 > long0",
        "100",
    ),
    "ABANDONEDBABY": (
        3,
        "body2 > long2 and body1 <= doji1 and body0 > long0 and ((g2 = 1 and g0 = -1 and c0 < c2 - body2 * 0.3 and l1 > h2 and h0 < l1) "
        "or (g2 = -1 and g0 = 1 and c0 > c2 + body2 * 0.3 and h1 < l2 and l0 > h1))",
        "g0 * 100",
    ),
    "ADVANCEBLOCK": (
        3,
        f"{_WHITE3} and o1 > o2 and o1 <= c2 + near2 and o0 > o1 and o0 <= c1 + near1 and body2 > long2 and up2 < shade2 "
        "and ((body1 < body2 - far2 and body0 < body1 + near1) or body0 < body1 - far1 "
        "or (body0 < body1 and body1 < body2 and (up0 > shade0 or up1 > shade1)) or (body0 < body1 and up0 > body0))",
        "-100",
    ),
    "BREAKAWAY": (
        3,
        f"body4 > long4 and g4 = g3 and g3 = g1 and g1 = -g0 and ((g4 = -1 and {_gap_down(3, 4)} and h2 < h3 and l2 < l3 and h1 < h2 "
        f"and l1 < l2 and c0 > o3 and c0 < c4) or (g4 = 1 and {_gap_up(3, 4)} and h2 > h3 and l2 > l3 and h1 > h2 and l1 > l2 and c0 < o3 and c0 > c4))",
        "g0 * 100",
    ),
    "CONCEALBABYSWALL": (
        3,
        f"g3 = -1 and {_BLACK3} and {_bare(3)} and {_bare(2)} and {_gap_down(1, 2)} and up1 > tiny1 and h1 > c2 and h0 > h1 and l0 < l1",
        "100",
    ),
    "EVENINGDOJISTAR": (
        3,
        f"body2 > long2 and g2 = 1 and body1 <= doji1 and {_gap_up(1, 2)} and body0 > long0 and g0 = -1 and c0 < c2 - body2 * 0.3",
        "-100",
    ),
    "EVENINGSTAR": (
        3,
        f"body2 > long2 and g2 = 1 and body1 <= long1 and {_gap_up(1, 2)} and body0 > long0 and g0 = -1 and c0 < c2 - body2 * 0.3",
        "-100",
    ),
    "GAPSIDESIDEWHITE": (
        3,
        f"(({_gap_up(1, 2)} and {_gap_up(0, 2)}) or ({_gap_down(1, 2)} and {_gap_down(0, 2)})) and g1 = 1 and g0 = 1 "
        "and body0 between body1 - near1 and body1 + near1 and o0 between o1 - same1 and o1 + same1",
        f"case when {_gap_up(1, 2)} then 100 else -100 end",
    ),
    "HIKKAKE": (3, "hikkake0 <> 0", "hikkake0"),
    "HIKKAKEMOD": (3, "hikkakemod0 <> 0", "hikkakemod0"),
    "IDENTICAL3CROWS": (
        3,
        f"{_BLACK3} and dn2 < tiny2 and dn1 < tiny1 and dn0 < tiny0 and c2 > c1 and c1 > c0 "
        "and o1 between c2 - same2 and c2 + same2 and o0 between c1 - same1 and c1 + same1",
        "-100",
    ),
    "LADDERBOTTOM": (
        3,
        "g4 = -1 and g3 = -1 and g2 = -1 and o4 > o3 and o3 > o2 and c4 > c3 and c3 > c2 and g1 = -1 and up1 > tiny1 "
        "and g0 = 1 and o0 > o1 and c0 > h1",
        "100",
    ),
    "MATHOLD": (
        3,
        f"body4 > long4 and body3 < long3 and body2 < long2 and body1 < long1 and g4 = 1 and g3 = -1 and g0 = 1 and {_gap_up(3, 4)} "
        "and bot2 < c4 and bot1 < c4 and bot2 > c4 - body4 * 0.5 and bot1 > c4 - body4 * 0.5 and top2 < o3 and top1 < top2 "
        "and o0 > c1 and c0 > greatest(h3, h2, h1)",
        "100",
    ),
    "MORNINGDOJISTAR": (
        3,
        f"body2 > long2 and g2 = -1 and body1 <= doji1 and {_gap_down(1, 2)} and body0 > long0 and g0 = 1 and c0 > c2 + body2 * 0.3",
        "100",
    ),
    "MORNINGSTAR": (
        3,
        f"body2 > long2 and g2 = -1 and body1 <= long1 and {_gap_down(1, 2)} and body0 > long0 and g0 = 1 and c0 > c2 + body2 * 0.3",
        "100",
    ),
    "RISEFALL3METHODS": (
        3,
        "body4 > long4 and body3 < long3 and body2 < long2 and body1 < long1 and body0 > long0 and g4 = -g3 and g3 = g2 and g2 = g1 "
        "and g1 = -g0 and bot3 < h4 and top3 > l4 and bot2 < h4 and top2 > l4 and bot1 < h4 and top1 > l4 "
        "and c2 * g4 < c3 * g4 and c1 * g4 < c2 * g4 and o0 * g4 > c1 * g4 and c0 * g4 > c4 * g4",
        "g4 * 100",
    ),
    "STALLEDPATTERN": (
        3,
        f"{_WHITE3} and body2 > long2 and body1 > long1 and up1 < tiny1 and o1 > o2 and o1 <= c2 + near2 and body0 < long0 "
        "and o0 >= c1 - body0 - near1",
        "-100",
    ),
    "STICKSANDWICH": (3, "g2 = -1 and g1 = 1 and g0 = -1 and l1 > c2 and c0 between c2 - same2 and c2 + same2", "100"),
    "TASUKIGAP": (
        3,
        f"abs(body1 - body0) < near1 and (({_gap_up(1, 2)} and g1 = 1 and g0 = -1 and o0 < c1 and o0 > o1 and c0 < o1 and c0 > top2) "
        f"or ({_gap_down(1, 2)} and g1 = -1 and g0 = 1 and o0 < o1 and o0 > c1 and c0 > o1 and c0 < bot2))",
        "g1 * 100",
    ),
    "TRISTAR": (
        3,
        f"body2 <= doji2 and body1 <= doji2 and body0 <= doji2 and (({_gap_up(1, 2)} and top0 < top1) or ({_gap_down(1, 2)} and bot0 > bot1))",
        f"case when {_gap_up(1, 2)} then -100 else 100 end",
    ),
    "UNIQUE3RIVER": (
        3,
        "body2 > long2 and g2 = -1 and g1 = -1 and c1 > c2 and o1 <= o2 and l1 < l2 and body0 < long0 and g0 = 1 and o0 > l1",
        "100",
    ),
    "UPSIDEGAP2CROWS": (
        3,
        f"g2 = 1 and body2 > long2 and g1 = -1 and body1 <= long1 and {_gap_up(1, 2)} and g0 = -1 and o0 > o1 and c0 < c1 and c0 > c2",
        "-100",
    ),
    "XSIDEGAP3METHODS": (
        3,
        f"g2 = g1 and g1 = -g0 and o0 < top1 and o0 > bot1 and c0 < top2 and c0 > bot2 "
        f"and ((g2 = 1 and {_gap_up(1, 2)}) or (g2 = -1 and {_gap_down(1, 2)}))",
        "g2 * 100",
    ),
}

# A false break out of an inside bar, before confirmation.
RAW_HIKKAKE = "case when h1 < h2 and l1 > l2 and ((h0 < h1 and l0 < l1) or (h0 > h1 and l0 > l1)) then case when h0 < h1 then 100 else -100 end else 0 end"
RAW_HIKKAKEMOD = (
    "case when h2 < h3 and l2 > l3 and h1 < h2 and l1 > l2 and ((h0 < h1 and l0 < l1 and c2 <= l2 + near2) "
    "or (h0 > h1 and l0 > l1 and c2 >= h2 - near2)) then case when h0 < h1 then 100 else -100 end else 0 end"
)


def confirmed(raw: str) -> str:
    """Pattern value of a bar: its own signal, or double that of a signal up to three bars back
    whose inside bar this close is the first to leave in the signalled direction."""

    def leaves(bar: int, signal: int) -> str:
        return f"(({raw}{signal} > 0 and c{bar} > h{signal + 1}) or ({raw}{signal} < 0 and c{bar} < l{signal + 1}))"

    return (
        f"case when {raw}0 <> 0 then {raw}0 "
        f"when {raw}1 <> 0 then case when {leaves(0, 1)} then 2 * {raw}1 else 0 end "
        f"when {raw}2 <> 0 then case when {leaves(0, 2)} and not {leaves(1, 2)} then 2 * {raw}2 else 0 end "
        f"when {raw}3 <> 0 then case when {leaves(0, 3)} and not {leaves(2, 3)} and not {leaves(1, 3)} then 2 * {raw}3 else 0 end "
        "else 0 end"
    )


def bar_columns(bars: DataFrame) -> DataFrame:
    """Append the named columns of the last five bars."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    top, bot = F.greatest(o, c), F.least(o, c)
    now = {
        "o": o, "h": h, "l": l, "c": c, "top": top, "bot": bot, "body": top - bot, "up": h - top, "dn": bot - l,
        "g": F.when(c >= o, 1).otherwise(-1), "span": h - l, "shadows": (h - top) + (bot - l),
    }
    df = W.spread(bars).select("*", *[v.alias(f"{k}0") for k, v in now.items()])
    before = {n: W.history().rowsBetween(-n, -1) for n in (5, 10)}
    df = df.select(
        "*",
        *[
            F.when(F.count(f"{m}0").over(before[n]) == n, F.avg(f"{m}0").over(before[n]) * f).alias(f"{k}0")
            for k, (m, n, f) in THRESHOLDS.items()
        ],
    )
    names = [k for k in now if k not in ("span", "shadows")] + list(THRESHOLDS)
    df = df.select("*", *[W.delay(F.col(f"{k}0"), i).alias(f"{k}{i}") for k in names for i in range(1, DEPTH)])
    df = df.select("*", F.expr(RAW_HIKKAKE).alias("rawh0"), F.expr(RAW_HIKKAKEMOD).alias("rawm0"))
    raws = [W.delay(F.col(f"{k}0"), i).alias(f"{k}{i}") for k in ("rawh", "rawm") for i in range(1, 4)]
    df = df.select("*", *raws)
    return df.select("*", F.expr(confirmed("rawh")).alias("hikkake0"), F.expr(confirmed("rawm")).alias("hikkakemod0"))


def pattern_sql(name: str) -> str:
    _, condition, value = PATTERNS[name]
    return f"case when {condition} then {value} else 0 end"


def candles(bars: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Append one integer column ``CDL<name>`` per pattern; unused inputs are pruned by Spark."""
    df = bar_columns(bars)
    chosen = list(names or PATTERNS)
    return df.select(*bars.columns, *[F.expr(pattern_sql(n)).cast("int").alias(f"CDL{n}") for n in chosen])


for _name in PATTERNS:
    indicator(f"CDL{_name}", f"CDL{_name}")(lambda bars, _n=_name: candles(bars, [_n]))
