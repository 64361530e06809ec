"""Indicators that are plain window expressions (no recursion along time)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import windows as W
from tessera.operators.registry import indicator

c = F.col
N = 90  # default period when a factor name carries no argument


def safe(top: Column, bottom: Column) -> Column:
    """Ratio that is 0, not NULL, where the denominator is 0."""
    return F.when(bottom == 0, 0.0).otherwise(F.try_divide(top, bottom))


def previous(name: str) -> Column:
    return W.delay(c(name))


def true_range() -> Column:
    pc = previous("close")
    return F.when(pc.isNotNull(), F.greatest(c("high") - c("low"), F.abs(c("high") - pc), F.abs(c("low") - pc)))


def typical() -> Column:
    return (c("high") + c("low") + c("close")) / 3


def _keep(bars: DataFrame, out: DataFrame, *names: str) -> DataFrame:
    return out.select(*bars.columns, *names)


def simple(name: str, outputs: str, *defaults):
    """Register an indicator given as a function from arguments to output columns."""

    def wrap(fn):
        @indicator(name, outputs, *defaults)
        def build(bars, *args):
            values = fn(*args)
            values = values if isinstance(values, tuple) else (values,)
            return bars.select("*", *[v.alias(k) for k, v in zip(outputs.split(), values)])

        return fn

    return wrap


@simple("BBANDS", "UPPER MIDDLE LOWER", N)
def bbands(n):
    middle, spread = W.mean(c("close"), n), W.stddev(c("close"), n)
    return middle + 2 * spread, middle, middle - 2 * spread


@simple("MA", "MA", N)
def ma(n):
    return W.mean(c("close"), n)


simple("SMA", "SMA", N)(ma)


@simple("MIDPOINT", "MIDPOINT", N)
def midpoint(n):
    return (W.ts_max(c("close"), n) + W.ts_min(c("close"), n)) / 2


@simple("MIDPRICE", "MIDPRICE", N)
def midprice(n):
    return (W.ts_max(c("high"), n) + W.ts_min(c("low"), n)) / 2


@indicator("TRIMA", "TRIMA", N)
def trima(bars, n):
    first, second = ((n + 1) // 2, (n + 1) // 2) if n % 2 else (n // 2, n // 2 + 1)
    inner = bars.withColumn("_a", W.mean(c("close"), first))
    return _keep(bars, inner.withColumn("TRIMA", W.mean(c("_a"), second)), "TRIMA")


@indicator("WMA", "WMA", N)
def wma(bars, n):
    # The weighted sum by position: newest weighs n, so sum((i - i0) * x) with a running index i.
    out = bars.withColumn("_i", W.position())
    weighted = F.sum(c("_i") * c("close")).over(W.rows(n)) - (c("_i") - n) * F.sum("close").over(W.rows(n))
    value = F.when(F.count("close").over(W.rows(n)) == n, weighted / (n * (n + 1) / 2.0))
    return _keep(bars, out.withColumn("WMA", value), "WMA")


@simple("APO", "APO", 30, N)
def apo(fast, slow):
    return W.mean(c("close"), fast) - W.mean(c("close"), slow)


@simple("PPO", "PPO", 30, N)
def ppo(fast, slow):
    return 100 * safe(apo(fast, slow), W.mean(c("close"), slow))


@simple("AROON", "AROONDOWN ARRONUP", N)
def aroon(n):
    down = 100 * (n - W.ts_argmin(c("low"), n + 1)) / n
    up = 100 * (n - W.ts_argmax(c("high"), n + 1)) / n
    return down, up


@simple("AROONOSC", "AROONOSC", N)
def aroonosc(n):
    down, up = aroon(n)
    return up - down


@simple("BOP", "BOP")
def bop():
    return safe(c("close") - c("open"), c("high") - c("low"))


@indicator("CCI", "CCI", N)
def cci(bars, n):
    out = bars.withColumn("_tp", typical()).withColumn("_m", W.mean(c("_tp"), n))
    values = F.collect_list("_tp").over(W.rows(n))
    spread = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.abs(v - c("_m"))) / n
    value = F.when(c("_m").isNotNull(), safe(c("_tp") - c("_m"), 0.015 * spread))
    return _keep(bars, out.withColumn("CCI", value), "CCI")


@indicator("MACDEXT", "MACDX MACDSIGNALX MACDHISTX", 12, 26, 9)
def macdext(bars, fast, slow, signal):
    out = bars.withColumn("_m", W.mean(c("close"), fast) - W.mean(c("close"), slow))
    out = out.withColumn("MACDSIGNALX", W.mean(c("_m"), signal))
    out = out.withColumn("MACDX", F.when(c("MACDSIGNALX").isNotNull(), c("_m")))
    out = out.withColumn("MACDHISTX", c("MACDX") - c("MACDSIGNALX"))
    return _keep(bars, out, "MACDX", "MACDSIGNALX", "MACDHISTX")


@indicator("MFI", "MFI", N)
def mfi(bars, n):
    out = bars.withColumn("_tp", typical())
    move = W.delta(c("_tp"))
    out = out.withColumns(
        {
            "_up": F.when(move > 0, c("_tp") * c("volume")).when(move.isNotNull(), 0.0),
            "_dn": F.when(move < 0, c("_tp") * c("volume")).when(move.isNotNull(), 0.0),
        }
    )
    up, down = W.ts_sum(c("_up"), n), W.ts_sum(c("_dn"), n)
    return _keep(bars, out.withColumn("MFI", F.when(up + down < 1, 0.0).otherwise(100 * F.try_divide(up, up + down))), "MFI")


@simple("MOM", "MOM", N)
def mom(n):
    return W.delta(c("close"), n)


@simple("ROC", "ROC", N)
def roc(n):
    return 100 * (rocr(n) - 1)


@simple("ROCR", "ROCR", N)
def rocr(n):
    return safe(c("close"), W.delay(c("close"), n))


@simple("ROCR100", "ROCR100", N)
def rocr100(n):
    return 100 * rocr(n)


def fast_k(n, high="high", low="low", close="close") -> Column:
    lowest = W.ts_min(c(low), n)
    return 100 * safe(c(close) - lowest, W.ts_max(c(high), n) - lowest)


@indicator("STOCH", "SLOWK SLOWD", 5, 3, 3)
def stoch(bars, fast, slow, signal):
    out = bars.withColumn("_k", fast_k(fast)).withColumn("_s", W.mean(c("_k"), slow))
    out = out.withColumn("SLOWD", W.mean(c("_s"), signal)).withColumn("SLOWK", F.when(c("SLOWD").isNotNull(), c("_s")))
    return _keep(bars, out, "SLOWK", "SLOWD")


@indicator("STOCHF", "FASTK FASTD", 5, 3)
def stochf(bars, fast, signal):
    out = bars.withColumn("_k", fast_k(fast)).withColumn("FASTD", W.mean(c("_k"), signal))
    return _keep(bars, out.withColumn("FASTK", F.when(c("FASTD").isNotNull(), c("_k"))), "FASTK", "FASTD")


@indicator("ULTOSC", "ULTOSC", 7, 14, 28)
def ultosc(bars, n1, n2, n3):
    pc = previous("close")
    floor_ = F.when(pc.isNotNull(), F.least(c("low"), pc))
    out = bars.withColumns({"_bp": c("close") - floor_, "_tr": true_range()})
    part = [safe(W.ts_sum(c("_bp"), n), W.ts_sum(c("_tr"), n)) for n in (n1, n2, n3)]
    return _keep(bars, out.withColumn("ULTOSC", 100 * (4 * part[0] + 2 * part[1] + part[2]) / 7), "ULTOSC")


@simple("WILLR", "WILLR", N)
def willr(n):
    highest = W.ts_max(c("high"), n)
    return -100 * safe(highest - c("close"), highest - W.ts_min(c("low"), n))


def money_flow_volume() -> Column:
    spread = c("high") - c("low")
    return safe((c("close") - c("low")) - (c("high") - c("close")), spread) * c("volume")


@simple("AD", "AD")
def ad():
    return F.sum(money_flow_volume()).over(W.upto())


@indicator("OBV", "OBV")
def obv(bars):
    step = F.when(previous("close").isNull(), c("volume")).otherwise(F.signum(W.delta(c("close"))) * c("volume"))
    return _keep(bars, bars.withColumn("_s", step).withColumn("OBV", F.sum("_s").over(W.upto())), "OBV")


@simple("TRANGE", "TRANGE")
def trange():
    return true_range()


@simple("AVGPRICE", "AVGPRICE")
def avgprice():
    return (c("open") + c("high") + c("low") + c("close")) / 4


@simple("MEDPRICE", "MEDPRICE")
def medprice():
    return (c("high") + c("low")) / 2


@simple("TYPPRICE", "TYPPRICE")
def typprice():
    return typical()


@simple("WCLPRICE", "WCLPRICE")
def wclprice():
    return (c("high") + c("low") + 2 * c("close")) / 4


@indicator("BETA", "BETA", N)
def beta(bars, n):
    move = {f"_{k}": F.try_divide(c(k), previous(k)) - 1 for k in ("high", "low")}
    out = bars.withColumns(move)
    w = W.rows(n)
    spread = F.var_pop("_high").over(w)
    value = F.when(spread > 1e-18, F.try_divide(F.covar_pop("_high", "_low").over(w), spread)).otherwise(0.0)
    return _keep(bars, out.withColumn("BETA", F.when(F.count("_high").over(w) == n, value)), "BETA")


@simple("CORREL", "CORREL", N)
def correl(n):
    full = F.count("close").over(W.rows(n)) == n
    return F.when(full, F.coalesce(W.correlation(c("high"), c("low"), n), F.lit(0.0)))


def _regression(bars, n, output, value):
    """Least squares of close on 0..n-1 inside the window; ``value(slope, intercept)``."""
    out = bars.withColumn("_i", W.position())
    w = W.rows(n)
    slope = F.when(F.count("close").over(w) == n, F.regr_slope("close", "_i").over(w))
    out = out.withColumns({"_m": slope, "_b": F.avg("close").over(w)})
    intercept = c("_b") - c("_m") * (n - 1) / 2
    return _keep(bars, out.withColumn(output, value(c("_m"), intercept, n)), output)


for _name, _value in {
    "LINEARREG": lambda m, b, n: b + m * (n - 1),
    "LINEARREG_ANGLE": lambda m, b, n: F.degrees(F.atan(m)),
    "LINEARREG_INTERCEPT": lambda m, b, n: b,
    "LINEARREG_SLOPE": lambda m, b, n: m,
    "TSF": lambda m, b, n: b + m * n,
}.items():
    _out = _name.replace("_", "")
    indicator(_name, _out, N)(lambda bars, n, _o=_out, _v=_value: _regression(bars, n, _o, _v))


@simple("STDDEV", "STDDEV", N, 1)
def stddev(n, multiplier=1):
    return W.stddev(c("close"), n) * multiplier


@simple("VAR", "VAR", N, 1)
def var(n, _=1):
    return W.when_full(c("close"), n, F.var_pop("close"))


@simple("MAX", "MAX", N)
def maximum(n):
    return W.ts_max(c("close"), n)


@simple("MIN", "MIN", N)
def minimum(n):
    return W.ts_min(c("close"), n)


def _index(since: Column) -> Column:
    return (W.position() - 1 - since).cast("int")


@simple("MAXINDEX", "MAXINDEX", N)
def maxindex(n):
    return _index(W.ts_argmax(c("close"), n))


@simple("MININDEX", "MININDEX", N)
def minindex(n):
    return _index(W.ts_argmin(c("close"), n))


@simple("MINMAXINDEX", "MINIDX MAXIDX", N)
def minmaxindex(n):
    return minindex(n), maxindex(n)


@simple("SUM", "SUM", N)
def total(n):
    return W.ts_sum(c("close"), n)


def weighted(parts: list[tuple[Column, float]]) -> Column:
    return reduce(lambda a, b: a + b, (v * w for v, w in parts))
