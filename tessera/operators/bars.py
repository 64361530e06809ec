"""The bar builder: raw bars to clean, adjusted bars on the trading calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions import windows as W

PRICES = ("open", "high", "low", "close", "pre_close", "upLimit", "downLimit")


def adjust(bars: DataFrame, prices: Sequence[str] = PRICES, mode: str = "forward", factor: str = "adj_factor") -> DataFrame:
    """Forward (to the last factor), backward (to the first) or no price adjustment."""
    if mode == "raw":
        return bars
    whole = W.history().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = {"forward": F.last, "backward": F.first}[mode]
    based = bars.withColumn("_base", pick(F.col(factor), ignorenulls=True).over(whole))
    scaled = {p: (F.col(p) * F.col(factor) / F.col("_base")).alias(p) for p in prices}
    return based.select(*[scaled.get(c, F.col(c)) for c in bars.columns])


def align_to_calendar(
    bars: DataFrame, calendar: DataFrame, keys: Sequence[str] = ("code",), until: Column | None = None
) -> DataFrame:
    """One row per key and open day between the key's first and last bar (or ``until``).

    The days are cut from the calendar as one row. Days and bars are stacked on the keys, and a day stays where no bar has it: one exchange by
    the keys, which later windows by them use again, and no join on the day.
    """
    keys = list(keys)
    span = bars.groupBy(*keys).agg(F.min("dt").alias("_from"), F.max("dt").alias("_to"))
    if until is not None:
        span = span.withColumn("_to", until)
    open_days = calendar.agg(F.sort_array(F.collect_set("dt")).alias("_days"))  # one row
    inside = F.filter("_days", lambda d: (d >= F.col("_from")) & (d <= F.col("_to")))
    days = span.join(F.broadcast(open_days)).select(*keys, F.explode(inside).alias("dt"), F.lit(0).alias("_kind"))
    known = bars.where(" and ".join(f"`{k}` is not null" for k in keys)).withColumn("_kind", F.lit(1))
    stacked = W.spread(days.unionByName(known, allowMissingColumns=True), keys)
    day = Window.partitionBy(*keys, "dt").orderBy("_kind").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = stacked.withColumns({"_first": F.first("_kind").over(day), "_last": F.last("_kind").over(day)})
    return marked.where("_first = 0 and _kind = _last").select(*keys, "dt", *[c for c in bars.columns if c not in (*keys, "dt")])


def carry_events(bars: DataFrame, events: DataFrame, columns: Sequence[str], back: bool = False) -> DataFrame:
    """Backward as-of: each bar takes the latest event at or before its day.

    Both sides are stacked per code, events before bars of the same day, and carried forward;
    ``back`` also fills the bars before the first event.
    """
    marked = bars.select("*", *[F.lit(None).cast(events.schema[c].dataType).alias(f"_e_{c}") for c in columns])
    marked = marked.withColumn("_bar", F.lit(1))
    stacked = marked.unionByName(
        events.select("code", "dt", *[F.col(c).alias(f"_e_{c}") for c in columns], F.lit(0).alias("_bar")),
        allowMissingColumns=True,
    )
    stacked = W.spread(stacked)
    order = Window.partitionBy("code").orderBy("dt", "_bar")
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    # Bars before the first event take that event. The whole-history frame is evaluated once per
    # code, where a frame from each row on to the end would be quadratic in the history.
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def value(c: str) -> Column:
        v = F.last(F.col(f"_e_{c}"), ignorenulls=True).over(seen)
        return F.coalesce(v, F.first(F.col(f"_e_{c}"), ignorenulls=True).over(whole)) if back else v

    out = stacked.select("*", *[value(c).alias(c) for c in columns])
    return out.where("_bar = 1").select(*bars.columns, *columns)


def build_bars(
    bars: DataFrame,
    calendar: DataFrame,
    adjustments: DataFrame,
    names: DataFrame,
    limits: DataFrame,
    mode: str = "forward",
    board: Column | None = None,
) -> DataFrame:
    """Adjusted bars with name, limits, vwap and suspension flag, one row per open day.

    ``adjustments``: (code, dt, adj_factor); ``names``: (code, dt, name), both carried forward;
    ``limits``: (code, dt, up_limit, down_limit) where the exchange published them, one row per code and day. Missing
    limits follow the board rule on ``board`` (the code itself by default).
    """
    aligned = align_to_calendar(bars, calendar)
    # All event tables ride in one stack, so carrying them costs one exchange. A limit is for its own day only.
    events = adjustments.select("code", "dt", "adj_factor").unionByName(
        names.select("code", "dt", "name"), allowMissingColumns=True
    )
    limit = F.struct("dt", "up_limit", "down_limit").alias("_limit")
    events = events.unionByName(limits.where("code is not null").select("code", "dt", limit), allowMissingColumns=True)
    aligned = carry_events(aligned, events, ["adj_factor", "name", "_limit"], back=True)
    today = F.col("_limit.dt") == F.col("dt")
    aligned = aligned.withColumns({x: F.when(today, F.col(f"_limit.{x}")) for x in ("up_limit", "down_limit")})
    priced = aligned.select(
        "code",
        "dt",
        *[W.ffill(F.col(p)).alias(p) for p in ("open", "high", "low", "close")],
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
        "adj_factor",
        F.coalesce("name", F.lit("")).alias("name"),
        S.suspended(F.col("close")).alias("stop"),
        "up_limit",
        "down_limit",
    )
    pre = W.delay(F.col("close"))
    priced = priced.withColumn("pre_close", pre)
    code = F.col("code").cast("string") if board is None else board
    rate = S.limit_rate(code, F.col("dt"), F.col("name"))
    up, down = S.price_limits(F.col("pre_close"), rate, F.col("up_limit"), F.col("down_limit"))
    priced = priced.withColumns({"upLimit": up, "downLimit": down}).drop("up_limit", "down_limit")
    adjusted = adjust(priced, PRICES, mode)
    change = F.col("close") - F.col("pre_close")
    return adjusted.select(
        "code", "dt", "open", "high", "low", "close", "pre_close",
        change.alias("change"),
        F.try_divide(change, F.col("pre_close")).alias("returns"),
        "volume", "amount", "name",
        S.vwap(F.col("amount"), F.col("volume")).alias("vwap"),
        "stop", "upLimit", "downLimit", "adj_factor",
    )
