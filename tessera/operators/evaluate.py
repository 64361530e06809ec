"""Factor evaluation: forward returns, information coefficients, quantile returns, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.functions import windows as W
from tessera.operators import aggregates as A

HORIZONS = (1, 2, 3, 5, 8, 13, 21)


def stratified_pool(stocks: DataFrame, metrics: Sequence[str], size: int = 300) -> DataFrame:
    """Pick about ``size`` codes: an equal share per market, and inside a market the smallest
    codes of the low, middle and high third of every metric."""
    long = stocks.unpivot(["code", "market"], list(metrics), "metric", "v").where("v is not null")
    cuts = X.group_percentiles(long, F.col("v"), [1 / 3, 2 / 3], ["market", "metric"], "cuts")
    stratum = F.when(F.col("v") <= F.get("cuts", F.lit(0)), 0).when(F.col("v") <= F.get("cuts", F.lit(1)), 1).otherwise(2)
    long = long.join(cuts, ["market", "metric"]).withColumn("stratum", stratum)
    markets = stocks.agg(F.count_distinct("market")).scalar()
    share = F.greatest(F.lit(1), F.floor(F.floor(F.lit(size) / markets) / (3 * len(metrics))))
    picked = X.top_n(long, size, [F.col("v"), F.col("code")], ["market", "metric", "stratum"])
    return picked.where(F.col("place") <= share).select("code", "market").distinct()


def forward_return(d: int) -> Column:
    """Ratio of the close d rows ahead to the next open."""
    return F.try_divide(W.future(F.col("close"), d), W.future(F.col("open"), 1))


def _ratio(mean: Column, spread: Column) -> Column:
    return F.coalesce(F.when(spread > A.TINY, mean / spread), F.lit(0.0))


def ic_ir(
    df: DataFrame, keys: Sequence[str], returns: Sequence[str], period: int = 120, value: str = "value", first: Column | None = None
) -> DataFrame:
    """Mean and mean/std of the per-bin correlation of ``value`` with each return column. Bins count from the first day, or from ``first``.

    One aggregation for all factors and horizons: (keys, bin) first, then keys.
    """
    bins = df.withColumn("bin", A.day_bucket(df, period, first))
    per_bin = bins.groupBy(*keys, "bin").agg(*[A.pearson(F.col(value), F.col(x)).alias(x) for x in returns])
    return _summarise(per_bin, keys, returns)


def rank_ic_ir(df: DataFrame, keys: Sequence[str], ret: str, period: int = 120, value: str = "value") -> DataFrame:
    """:func:`ic_ir` on average ranks inside the bin."""
    bins = df.withColumn("bin", A.day_bucket(df, period))
    per_bin = A.rank_correlation(bins, value, ret, [*keys, "bin"], ret)
    return _summarise(per_bin, keys, [ret])


def _summarise(per_bin: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    out = []
    for x in names:
        mean = F.coalesce(F.avg(x), F.lit(0.0))
        out += [mean.alias(f"ic_{x}"), _ratio(F.avg(x), F.stddev_samp(x)).alias(f"ir_{x}")]
    return per_bin.groupBy(*keys).agg(*out)


def quantile_sharpe(
    df: DataFrame, keys: Sequence[str], returns: Sequence[str], n: int = 10, value: str = "value"
) -> DataFrame:
    """Sharpe ratio of the n quantile portfolios, weighted by their final net value.

    The z-score step of the definition does not move a value across a quantile edge, so the
    buckets are cut on the raw values.
    """
    keys = list(keys)
    cut = X.add_buckets(df, value, n, "q", [*keys, "dt"]).where("q is not null")
    daily = cut.groupBy(*keys, "dt", "q").agg(*[F.avg(x).alias(x) for x in returns])
    aggs = []
    for x in returns:
        aggs += [_ratio(F.avg(F.col(x) - 1), F.stddev_pop(F.col(x) - 1)).alias(f"s_{x}"), F.product(x).alias(f"n_{x}")]
    per_bucket = daily.groupBy(*keys, "q").agg(*aggs)
    return per_bucket.groupBy(*keys).agg(
        *[
            F.coalesce(F.try_divide(F.sum(F.col(f"n_{x}") * F.col(f"s_{x}")), F.sum(f"n_{x}")), F.lit(0.0)).alias(f"sharpe_{x}")
            for x in returns
        ]
    )


def factor_score(
    panel: DataFrame, factors: Sequence[str], horizons: Sequence[int] = HORIZONS, first: Column | None = None
) -> DataFrame:
    """One row per factor: mean IC and IR over the horizons, best Sharpe and the score.

    All factors go through one job in long form; null and constant factors are left out. Factors that are scored in
    several jobs need the same ``first`` day of the bins.
    """
    names = [f"r{d}" for d in horizons]
    wide = W.spread(panel).select("code", "dt", *factors, *[forward_return(d).alias(x) for d, x in zip(horizons, names)])
    long = wide.unpivot(["code", "dt", *names], list(factors), "factor", "value").where("value is not null")
    usable = long.groupBy("factor").agg((F.min("value") < F.max("value")).alias("_ok")).where("_ok").select("factor")
    long = long.join(usable, "factor", "left_semi")
    ic = ic_ir(long, ["factor"], names, first=first)
    sharpe = quantile_sharpe(long, ["factor"], names)

    def mean(prefix: str) -> Column:
        total = F.lit(0.0)
        for x in names:
            total = total + F.col(f"{prefix}_{x}")
        return total / len(names)

    best = F.greatest(*[F.col(f"sharpe_{x}") for x in names]) if len(names) > 1 else F.col(f"sharpe_{names[0]}")
    out = ic.join(sharpe, "factor").select("factor", mean("ic").alias("ic"), mean("ir").alias("ir"), best.alias("sharpe"))
    score = 10 * F.abs("ic") + F.abs("ir") + F.abs("sharpe")
    return out.withColumn("score", score)


REPORT_PERIODS = (1, 5, 10)


def _report_frame(panel: DataFrame, factor: str, periods: Sequence[int]) -> DataFrame:
    """Industry-neutral factor, its 5 quantiles and the close-to-close returns ahead."""
    ahead = {f"p{d}": F.try_divide(W.future(F.col("close"), d), F.col("close")) - 1 for d in periods}
    df = panel.select("code", "dt", "industry", factor, *[v.alias(k) for k, v in ahead.items()])
    df = X.add_zscore(df, factor, "_f", ["dt", "industry"], population=True).where("_f is not null")
    df = df.withColumn("_f", F.round("_f", 9))  # equal scores of different industries stay ties
    return X.add_buckets(df, "_f", 5, "q")


def report_quantiles(panel: DataFrame, factor: str, periods: Sequence[int] = REPORT_PERIODS) -> DataFrame:
    """Mean, standard error and one-day-equivalent mean return per quantile and period."""
    df = _report_frame(panel, factor, periods).where("q is not null")
    aggs = []
    for d in periods:
        x = f"p{d}"
        aggs += [
            F.avg(x).alias(f"mean_{d}"),
            F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x).cast("double"))).alias(f"stderr_{d}"),
            (F.pow(1 + F.avg(x), F.lit(1.0 / d)) - 1).alias(f"rate_{d}"),
        ]
    return df.groupBy("q").agg(*aggs)


def report_rank_ic(panel: DataFrame, factor: str, period: int = 1) -> DataFrame:
    """Rank correlation of the neutral factor with the return ahead, per date."""
    return A.rank_correlation(_report_frame(panel, factor, [period]), "_f", f"p{period}", ["dt"], "ic")


def report_monthly_ic(panel: DataFrame, factor: str, period: int = 1) -> DataFrame:
    daily = report_rank_ic(panel, factor, period)
    return daily.groupBy(F.trunc("dt", "month").alias("month")).agg(F.avg("ic").alias("ic"))


def report_autocorrelation(panel: DataFrame, factor: str) -> DataFrame:
    """Correlation of a date's factor ranks with the previous row's, per date."""
    ranked = X.add_ranks(_report_frame(panel, factor, [1]), {"_r": F.col("_f")})
    lagged = ranked.select("dt", "_r", W.delay(F.col("_r")).alias("_b"))
    return lagged.groupBy("dt").agg(A.pearson(F.col("_r"), F.col("_b")).alias("autocorrelation"))


def prefix_differences(bars: DataFrame, build, columns: Sequence[str], cut: str) -> DataFrame:
    """Look-ahead test: rows up to ``cut`` whose value changes when later bars are removed."""
    day = F.lit(cut).cast("date")
    whole = build(bars).where(F.col("dt") <= day)
    part = build(bars.where(F.col("dt") <= day)).select("code", "dt", *[F.col(c).alias(f"_{c}") for c in columns])
    both = whole.join(part, ["code", "dt"], "full")

    def differs(c: str) -> Column:
        same = F.abs(F.col(c) - F.col(f"_{c}")) <= 1e-9 * F.greatest(F.abs(c), F.lit(1.0))
        return ~F.coalesce(same, F.col(c).isNull() & F.col(f"_{c}").isNull())

    counts = both.agg(*[F.count_if(differs(c)).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "factor", "differing")


def streaks(flags: DataFrame, calendar: DataFrame, shortest: int) -> DataFrame:
    """Longest run of flagged days on consecutive open days per code, with its first day.

    ``flags`` holds the flagged (code, dt) rows. The calendar is numbered once; its length is
    the number of open days, so that window stays small however large the panel is.
    """
    numbered = calendar.select("dt", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("dt")).alias("_day"))
    runs = flags.join(numbered, "dt").withColumn("_run", F.col("_day") - F.row_number().over(W.history()))
    lengths = runs.groupBy("code", "_run").agg(F.count(F.lit(1)).alias("days"), F.min("dt").alias("first_day"))
    best = X.top_n(lengths, 1, [F.desc("days"), F.col("first_day")], ["code"])
    return best.where(F.col("days") >= shortest).select("code", "days", "first_day")
