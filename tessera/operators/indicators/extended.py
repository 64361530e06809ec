"""Further indicators: pivots, stochastics, mass index, vortex, KST, TSI and channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions import windows as W
from tessera.functions.folds import decayed, each, scan_by_code, shift
from tessera.operators.indicators.rolling import _keep, simple
from tessera.operators.registry import indicator

c = F.col


@simple("PPSR", "PPSR PPR1 PPS1 PPR2 PPS2 PPR3 PPS3")
def ppsr():
    return tuple(S.pivot_points(c("high"), c("low"), c("close")).values())


@simple("STOK", "STOK")
def stok():
    return F.try_divide(c("close") - c("low"), c("high") - c("low"))


@indicator("STO", "STOSK STOSD", 14, 3, 1)
def sto(bars, n, signal, slowing):
    lowest = W.ts_min(c("low"), n)
    out = bars.withColumn("_k", F.try_divide(c("close") - lowest, W.ts_max(c("high"), n) - lowest))
    out = out.withColumn("_d", W.mean(c("_k"), signal))
    out = out.withColumns({"STOSK": W.mean(c("_k"), slowing), "STOSD": W.mean(c("_d"), slowing)})
    return _keep(bars, out, "STOSK", "STOSD")


@indicator("MASSI", "MASSI", 9, 25)
def mass_index(bars, span, n):
    def lines(h, high, low):
        first = h.keep(decayed(each(lambda a, b: a - b, high, low), span, span - 1))
        return [each(F.try_divide, first, decayed(first, span, span - 1))]

    out = scan_by_code(bars, lines, ["high", "low"], ["_mass"])
    return _keep(bars, out.withColumn("MASSI", W.ts_sum(c("_mass"), n)), "MASSI")


@indicator("VORTEX", "VORTEX", 14)
def vortex(bars, n):
    """Vortex movement over true range; the first row of a code counts as zero in both."""
    h1, l1, c1 = (W.delay(c(x)) for x in ("high", "low", "close"))
    span = F.greatest(c("high"), c1) - F.least(c("low"), c1)
    move = F.abs(c("high") - l1) - F.abs(c("low") - h1)
    out = bars.withColumns({"_tr": F.when(c1.isNull(), 0.0).otherwise(span), "_vm": F.coalesce(move, F.lit(0.0))})
    return _keep(bars, out.withColumn("VORTEX", F.try_divide(W.ts_sum(c("_vm"), n), W.ts_sum(c("_tr"), n))), "VORTEX")


def change_rate(x, n):
    """Relative change over n-1 rows."""
    return F.try_divide(W.delta(x, n - 1), W.delay(x, n - 1))


@indicator("KST", "KST", 10, 15, 20, 30, 10, 10, 10, 15)
def kst(bars, r1, r2, r3, r4, n1, n2, n3, n4):
    rates = {f"_r{i}": change_rate(c("close"), n) for i, n in enumerate((r1, r2, r3, r4))}
    out = bars.withColumns(rates)
    total = sum((W.ts_sum(c(f"_r{i}"), n) * (i + 1) for i, n in enumerate((n1, n2, n3, n4))), F.lit(0.0))
    return _keep(bars, out.withColumn("KST", total), "KST")


@indicator("TSI", "TSI", 25, 13)
def tsi(bars, r, s):
    def lines(h, x):
        move = h.keep(each(lambda now, before: now - before, x, shift(x)))
        top, bottom = (decayed(decayed(m, r, r - 1), s, s - 1) for m in (move, each(F.abs, move)))
        return [each(F.try_divide, top, bottom)]

    return scan_by_code(bars, lines, ["close"], ["TSI"])


@indicator("ACCDIST", "ACCDIST", 14)
def accdist(bars, n):
    spread = c("high") - c("low")
    out = bars.withColumn("_ad", F.try_divide(2 * c("close") - c("high") - c("low"), spread) * c("volume"))
    return _keep(bars, out.withColumn("ACCDIST", change_rate(c("_ad"), n)), "ACCDIST")


@simple("FORCE", "FORCE", 1)
def force(n):
    return W.delta(c("close"), n) * W.delta(c("volume"), n)


@indicator("EOM", "EMO", 10)
def ease_of_movement(bars, n):
    move = (W.delta(c("high")) + W.delta(c("low"))) * (c("high") - c("low"))
    out = bars.withColumn("_e", F.try_divide(move, 2 * c("volume")))
    return _keep(bars, out.withColumn("EMO", W.mean(c("_e"), n)), "EMO")


@indicator("COPP", "COPP", 10)
def coppock(bars, n):
    rates = change_rate(c("close"), n * 11 // 10) + change_rate(c("close"), n * 14 // 10)
    out = scan_by_code(bars.withColumn("_r", rates), lambda h, x: [decayed(x, n, n)], ["_r"], ["COPP"])
    return _keep(bars, out, "COPP")


@simple("KELCH", "KELCHM KELCHU KELCHD", 20)
def keltner(n):
    h, l, close = c("high"), c("low"), c("close")
    return (
        W.mean((h + l + close) / 3, n),
        W.mean((4 * h - 2 * l + close) / 3, n),
        W.mean((-2 * h + 4 * l + close) / 3, n),
    )


@simple("DONCH", "DONCHLOW DONCHHIGH", 20)
def donchian(n):
    return W.ts_min(c("low"), n), W.ts_max(c("high"), n)
