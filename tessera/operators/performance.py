"""Performance ratios of return series: columns (strategy, dt, r, b) for return and benchmark.

A series has one row per strategy and open day, so its windows are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252  # fixed value: trading days per year
KEYS = ("strategy",)
TINY = 1e-12


def safe(top: Column, bottom: Column) -> Column:
    return F.when(F.abs(bottom) > TINY, top / bottom)


def _along(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("dt")


def with_curves(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Growth of 1 for strategy and benchmark, the excess curve and the drawdown."""
    through = _along(keys).rowsBetween(Window.unboundedPreceding, 0)

    def growth(x: str) -> Column:
        return F.exp(F.sum(F.ln(1 + F.col(x))).over(through))

    out = df.withColumns({"value": growth("r"), "bench": growth("b"), "row": F.row_number().over(_along(keys))})
    peak = F.greatest(F.max("value").over(through), F.lit(1.0))
    excess_ = F.col("value") - F.col("bench") + 1
    out = out.withColumns({"drawdown": F.col("value") / peak - 1, "excess": excess_})
    excess_peak = F.greatest(F.max("excess").over(through), F.lit(1.0))
    return out.withColumn("excess_drawdown", F.col("excess") / excess_peak - 1)


def annual_growth(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.pow(F.product(1 + x), F.lit(float(YEAR)) / n) - 1


def downside(x: Column) -> Column:
    return F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2.0)))) * YEAR**0.5


def ratios(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All headline ratios in one aggregation; missing values become 0."""
    curves = with_curves(df, keys)
    r, b = F.col("r"), F.col("b")
    active = r - b
    beta = safe(F.covar_samp(r, b), F.var_samp(b))
    stats = curves.groupBy(*keys).agg(
        F.avg(r).alias("mean"),
        F.avg(b).alias("bench_mean"),
        F.stddev_samp(r).alias("std"),
        beta.alias("beta"),
        annual_growth(r).alias("annual_return"),
        safe(F.avg(active), F.stddev_samp(active)).alias("info_ratio"),
        downside(r).alias("downside_risk"),
        F.when(F.var_pop(F.ln("value")) > TINY, F.regr_r2(F.ln("value"), F.col("row").cast("double"))).alias("r2"),
        safe(F.sum(F.greatest(r, F.lit(0.0))), F.sum(F.greatest(-r, F.lit(0.0)))).alias("omega"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_down"),
        (F.product(1 + r) - 1).alias("total_return"),
    )
    mean, drift = F.col("mean"), F.col("mean") - F.col("beta") * F.col("bench_mean")
    out = stats.select(
        *keys,
        (F.pow(1 + drift, F.lit(float(YEAR))) - 1).alias("alpha"),
        "beta",
        "annual_return",
        F.col("annual_return").alias("cagr"),
        F.col("annual_return").alias("rnorm"),
        (F.col("std") * YEAR**0.5).alias("annual_volatility"),
        "info_ratio",
        "downside_risk",
        "r2",
        (safe(mean, F.col("std")) * YEAR**0.5).alias("sharpe"),
        safe(mean * YEAR, F.col("downside_risk")).alias("sortino"),
        safe(F.col("annual_return"), F.abs("max_down")).alias("calmar"),
        "omega",
        "max_down",
        F.col("total_return").alias("roto"),
    )
    return clean(out, keys)


def clean(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NULL, NaN and infinite metrics become 0."""
    def fixed(c: str) -> Column:
        bad = F.isnan(c) | (F.abs(c) == float("inf")) | F.col(c).isNull()
        return F.when(bad, 0.0).otherwise(F.col(c)).alias(c)

    return df.select(*keys, *[fixed(c) for c in df.columns if c not in keys])


def yearly(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys, F.year("dt").alias("year")).agg((F.product(1 + F.col("r")) - 1).alias("ret"))


def resample(df: DataFrame, unit: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Compound both series to weeks or months."""
    return df.groupBy(*keys, F.trunc("dt", unit).alias("dt")).agg(
        (F.product(1 + F.col("r")) - 1).alias("r"), (F.product(1 + F.col("b")) - 1).alias("b")
    )


def extended(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tracking error, excess volatility, drawdown and win rate, value at risk, profit/loss rate,
    longest drawdown and ulcer index."""
    curves = with_curves(df, keys)
    # a drawdown lasts from the last row at the peak: rows since then, 0 on a peak
    last_peak = F.max(F.when(F.col("drawdown") >= 0, F.col("row"))).over(_along(keys).rowsBetween(Window.unboundedPreceding, 0))
    curves = curves.withColumn("under", F.col("row") - F.coalesce(last_peak, F.lit(0)))
    r, active = F.col("r"), F.col("r") - F.col("b")
    gain, loss = F.avg(F.when(r > 0, r)), F.avg(F.when(r < 0, -r))
    return curves.groupBy(*keys).agg(
        (F.stddev_samp(active) * YEAR**0.5).alias("tracking_error"),
        F.stddev_samp(F.col("excess")).alias("excess_spread"),
        F.least(F.min("excess_drawdown"), F.lit(0.0)).alias("excess_max_down"),
        F.avg((active > 0).cast("double")).alias("excess_win_rate"),
        F.percentile(r, F.lit(0.05)).alias("var_5"),
        safe(gain, loss).alias("profit_loss_rate"),
        F.max("under").alias("max_down_days"),
        F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer_index"),
    )
