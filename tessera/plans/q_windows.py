"""Queries for the window, scalar, filter and cross-section functions."""

from __future__ import annotations

import inspect

from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.functions import scalar as S
from tessera.functions import windows as W
from tessera.plans.registry import P, UPTO, over, query, r, register, with_views
from tessera.sources import panel as src

c = F.col


def panel(spark, path):
    gaps = F.when(c("volume") > 45, None).otherwise(c("close"))
    return src.bars_daily(spark, path).select("*", c("close").alias("x"), c("volume").alias("y"), gaps.alias("z"))


def panel_m(spark, path):
    bars = src.bars_monthly(spark, path).join(src.listing(spark, path), "code")
    gaps = F.when(c("volume") > 300, None).otherwise(c("close"))
    return bars.select("*", c("close").alias("x"), c("volume").alias("y"), gaps.alias("z"))


def _full(agg, n, v="x"):
    return f"case when count({v}) {over(n)} = {n} then {agg} {over(n)} end"


# Window functions: outputs as (spark column, sql expression).
def _zero(n, sql):
    return f"case when row_number() {P} < {n} then 0.0 else {sql} end"


def _decay(v, n, newest=False):
    weight = (lambda k: n - k) if newest else (lambda k: k + 1)
    terms = " + ".join(f"coalesce(lag({v}, {k}) {P}, 0) * {weight(k)}" for k in range(n))
    return f"({terms}) / {n * (n + 1) / 2.0}"


def _last_index(v, n, best):
    """Rows since the latest best value, by comparing values and row numbers in one list."""
    return (
        f"case when count({v}) {over(n)} = {n} then cast(list_position(list_reverse(list({v}) {over(n)}), "
        f"{best}({v}) {over(n)}) - 1 as double) end"
    )


def _rank_list(v, n, expr):
    l = f"list({v}) {over(n)}"
    g, e = f"len(list_filter(l, lambda v: v < {v}))", f"len(list_filter(l, lambda v: v = {v}))"
    return l, expr.format(g=g, e=e)


def _columns(build):
    """Call ``build`` with the columns its parameters name (o, h, l for open, high, low)."""
    short = {"o": "open", "h": "high", "l": "low"}
    return build(**{p: c(short.get(p, p)) for p in inspect.signature(build).parameters})


def _window(name, build, outputs, inner=None, view="p", digits=6):
    """Register one window query; ``inner`` adds helper SQL columns computed first."""
    body = ", ".join(f'round({sql}, {digits}) as "{k}"' for k, sql in outputs.items())
    source = view if inner is None else f"(select *, {inner} from {view})"
    sql = with_views(f"select code, dt, {body} from {source}", view)

    def run(spark, path):
        base = panel(spark, path) if view == "p" else panel_m(spark, path)
        return base.select("code", "dt", *[r(v, digits).alias(k) for k, v in _columns(build).items()])

    register(name, run, sql)


_window(
    "W01_delay",
    lambda x, z: {"d1": W.delay(x), "d7": W.delay(z, 7), "ahead2": W.delay(x, -2)},
    {"d1": f"lag(x, 1) {P}", "d7": f"lag(z, 7) {P}", "ahead2": f"lead(x, 2) {P}"},
)
_window("W02_delta", lambda x, z: {"v": W.delta(x, 5), "vz": W.delta(z, 1)},
    {"v": f"x - lag(x, 5) {P}", "vz": f"z - lag(z, 1) {P}"})
_window("W03_ts_sum", lambda x, z: {"v": W.ts_sum(x, 10), "vz": W.ts_sum(z, 3)},
    {"v": _full("sum(x)", 10), "vz": _full("sum(z)", 3, "z")})
_window("W04_mean", lambda x, z: {"v": W.mean(x, 12), "vz": W.mean(z, 3)},
    {"v": _full("avg(x)", 12), "vz": _full("avg(z)", 3, "z")})
_window(
    "W05_stddev",
    lambda x, z: {"v": W.stddev(x, 20), "vz": W.stddev(z, 4)},
    {"v": _full("stddev_pop(x)", 20), "vz": _full("stddev_pop(z)", 4, "z")},
)
_window("W06_ts_min", lambda x, z: {"v": W.ts_min(x, 9), "vz": W.ts_min(z, 3)},
    {"v": _full("min(x)", 9), "vz": _full("min(z)", 3, "z")})
_window("W07_ts_max", lambda x, z: {"v": W.ts_max(x, 9), "vz": W.ts_max(z, 3)},
    {"v": _full("max(x)", 9), "vz": _full("max(z)", 3, "z")})
_window("W08_ts_argmax", lambda x, y: {"v": W.ts_argmax(x, 10), "vy": W.ts_argmax(y, 5)},
    {"v": _last_index("x", 10, "max"), "vy": _last_index("y", 5, "max")})
_window("W09_ts_argmin", lambda x, y: {"v": W.ts_argmin(x, 10), "vy": W.ts_argmin(y, 5)},
    {"v": _last_index("x", 10, "min"), "vy": _last_index("y", 5, "min")})
_l10, _scaled = _rank_list("x", 10, "2 * (({g} + ({e} - 1) / 2.0) / 9.0 - 0.5)")
_window(
    "W10_ts_rank",
    lambda x: {"v": W.ts_rank(x, 10)},
    {"v": f"case when len(l) = 10 then {_scaled} end"},
    inner=f"{_l10} as l",
)
_l6, _raw = _rank_list("y", 6, "{g} + ({e} + 1) / 2.0")
_window(
    "W11_rolling_rank",
    lambda y: {"v": W.rolling_rank(y, 6)},
    {"v": f"case when len(l) = 6 then {_raw} end"},
    inner=f"{_l6} as l",
)


def corr_sql(a, b, n):
    sa, sb = f"stddev_pop({a}) {over(n)}", f"stddev_pop({b}) {over(n)}"
    both = f"count(case when {a} is not null and {b} is not null then 1 end) {over(n)}"
    return (
        f"case when {both} = {n} and {sa} > 1e-9 and {sb} > 1e-9 "
        f"then round(covar_pop({a}, {b}) {over(n)} / ({sa} * {sb}), 9) end"
    )


_window("W12_correlation", lambda x, y, z: {"v": W.correlation(x, y, 10), "vz": W.correlation(z, y, 4)},
    {"v": corr_sql("x", "y", 10), "vz": corr_sql("z", "y", 4)})
_window(
    "W13_covariance",
    lambda x, y: {"v": W.covariance(x, y, 5)},
    {"v": f"case when count(case when x is not null and y is not null then 1 end) {over(5)} = 5 then covar_samp(x, y) {over(5)} end"},
    digits=4,
)
_window(
    "W14_product",
    lambda x, z: {"v": W.product(x / 1000, 4), "vc": W.product(z / 1000, 4, compat=True)},
    {"v": _full("product(x / 1000)", 4), "vc": _zero(4, f"product(coalesce(z / 1000, 0)) {over(4)}")},
)
_window(
    "W15_decay_linear",
    lambda x, z: {"v": W.decay_linear(x, 8), "vc": W.decay_linear(z, 8, compat=True), "vn": W.decay_linear(x, 8, newest_heavy=True)},
    {"v": f"case when count(x) {over(8)} = 8 then {_decay('x', 8)} end", "vc": _zero(8, _decay("coalesce(z, 0)", 8)), "vn": f"case when count(x) {over(8)} = 8 then {_decay('x', 8, True)} end"},
    digits=4,
)
_window("W16_wma", lambda x: {"v": W.wma(x, 6, compat=True)},
    {"v": _zero(6, _decay("x", 6))})
_low = f"cast({{n}} - list_position(list(coalesce({{v}}, 0)) {over(20)}, min(coalesce({{v}}, 0)) {over(20)}) as double)"
_window(
    "W17_lowday",
    lambda x, z: {"vc": W.lowday(z, 20, compat=True), "v": W.lowday(x, 20)},
    {"vc": _zero(20, _low.format(n=20, v="z")), "v": f"case when count(x) {over(20)} = 20 then {_low.format(n=20, v='x')} end"},
)
_high = (
    f"cast(list_position(list_reverse(list(coalesce({{v}}, 0)) {over(20)}), max(coalesce({{v}}, 0)) {over(20)}) - 1 as double)"
)
_window(
    "W18_highday",
    lambda x, z: {"vc": W.highday(z, 20, compat=True), "v": W.highday(x, 20)},
    {"vc": _zero(20, _high.format(v="z")), "v": f"case when count(x) {over(20)} = 20 then {_high.format(v='x')} end"},
)
_window(
    "W19_sumif",
    lambda y, z: {"v": W.sumif(z, 6, y > 20, compat=True)},
    {"v": _zero(6, f"sum(case when y > 20 then coalesce(z, 0) else 0 end) {over(6)}")},
)
_window(
    "W20_count",
    lambda x, y: {"v": W.count(x > c("open"), 12), "v9": W.count(y > 20, 9)},
    {"v": f"case when row_number() {P} >= 8 then sum(case when x > open then 1.0 else 0 end) {over(12)} end", "v9": f"case when row_number() {P} >= 8 then sum(case when y > 20 then 1.0 else 0 end) {over(9)} end"},
)
_window("W23_sequence", lambda : {"v": W.position().cast("double")},
    {"v": f"cast(row_number() {P} as double)"})
_regr = f"regr_slope(coalesce(z, 0), i) {over(6)} * 6 / 5.0"
_window(
    "W22_regbeta",
    lambda x, z: {"vc": W.regbeta(z, 6, compat=True), "v": W.regbeta(x, 20)},
    {"vc": f"case when i < 6 then 0.0 else {_regr} end", "v": f"case when count(x) {over(20)} = 20 then regr_slope(x, i) {over(20)} * 20 / 19.0 end"},
    inner=f"row_number() {P} as i",
    digits=4,
)
_window("W24_sma", lambda x: {"v": W.sma(x, 9, 1)},
    {"v": f"case when row_number() {P} = 1 then x else (x * 1 + lag(x) {P} * 8) / 9.0 end"})


@query(
    "W21_sumac",
    with_views(
        f"select code, dt, round(last_value(s ignore nulls) {UPTO}, 6) as v from (select code, dt, "
        f"case when count(z) {over(5)} >= 4 then sum(z) {over(5)} end as s from p)",
        "p",
    ),
)
def w21(spark, path):
    return panel(spark, path).withColumn("s", W.sumac(c("z"), 5)).select("code", "dt", r(W.ffill(c("s"))).alias("v"))


@query("W25_total", with_views("select round(sum(volume), 4) as volume, round(sum(amount), 4) as amount from bars_d", "bars_d"))
def w25(spark, path):
    return src.bars_daily(spark, path).agg(r(F.sum("volume"), 4).alias("volume"), r(F.sum("amount"), 4).alias("amount"))


# -- filters and cleaning -----------------------------------------------------------------
@query(
    "F01_coerce_numeric",
    """select event_id, event_type, try_cast(event_type as double) as junk,
       try_cast(regexp_extract(props, '([0-9]+)', 1) as double) as k from events""",
)
def f01(spark, path):
    return src.table(spark, path, "events").select(
        "event_id",
        "event_type",
        S.number(c("event_type")).alias("junk"),
        S.number(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"),
    )


@query(
    "F02_date_range",
    with_views(
        """select code, dt, close, dt >= date '1998-01-01' and dt < date '1998-06-30' as half_open from bars_d
        where dt between date '1998-01-01' and date '1998-06-30'""",
        "bars_d",
    ),
)
def f02(spark, path):
    start, end = F.lit("1998-01-01").cast("date"), F.lit("1998-06-30").cast("date")
    bars = src.bars_daily(spark, path).where(c("dt").between(start, end))
    return bars.select("code", "dt", "close", ((c("dt") >= start) & (c("dt") < end)).alias("half_open"))


@query(
    "F03_code_filter",
    with_views(
        """select b.code, b.dt, b.close, b.code in (1, 5, 9) as listed from bars_d b
        where b.code in (select code from dim where market in ('ASIA', 'EUROPE'))""",
        "bars_d",
        "dim",
    ),
)
def f03(spark, path):
    wanted = src.listing(spark, path).where(c("market").isin("ASIA", "EUROPE")).select("code")
    bars = src.bars_daily(spark, path).join(wanted, "code", "left_semi")
    return bars.select("code", "dt", "close", c("code").isin(1, 5, 9).alias("listed"))


_dirty = "case when volume > 45 then 'NaN'::double when volume > 40 then 'Infinity'::double when volume < 3 then '-Infinity'::double else close end"


def _dirty_column():
    v = c("volume")
    return (
        F.when(v > 45, float("nan")).when(v > 40, float("inf")).when(v < 3, float("-inf")).otherwise(c("close"))
    )


@query(
    "F04_nan_inf_to_null",
    with_views(
        f"select code, dt, case when isfinite(d) then d end as v from (select *, {_dirty} as d from bars_d)", "bars_d"
    ),
)
def f04(spark, path):
    return src.bars_daily(spark, path).select("code", "dt", S.clean(_dirty_column()).alias("v"))


@query("F05_drop_incomplete", with_views("select code, dt, z from p where z is not null and code is not null", "p"))
def f05(spark, path):
    return panel(spark, path).select("code", "dt", "z").dropna(subset=["code", "z"])


@query(
    "F06_fill_const",
    with_views(
        """select code, dt, coalesce(z, 0) as z, coalesce(case when industry <> 'NATION_1' then industry end, 'other')
        as industry from p left join dim using (code)""",
        "p",
        "dim",
    ),
)
def f06(spark, path):
    df = panel(spark, path).join(src.listing(spark, path), "code", "left")
    df = df.select("code", "dt", "z", F.when(c("industry") != "NATION_1", c("industry")).alias("industry"))
    return df.fillna({"z": 0.0, "industry": "other"})


@query(
    "F07_ffill_bfill",
    with_views(
        f"""select code, dt, round(last_value(z ignore nulls) {UPTO}, 6) as forward, round(first_value(z ignore nulls)
        over (partition by code order by dt rows between current row and unbounded following), 6) as backward from p""",
        "p",
    ),
)
def f07(spark, path):
    return panel(spark, path).select("code", "dt", r(W.ffill(c("z"))).alias("forward"), r(W.bfill(c("z"))).alias("backward"))


@query(
    "F08_dedupe",
    """select user_id, cast(ts as date) as dt, arg_min(event_type, struct_pack(a := ts, b := event_id)) as first_type,
       arg_max(event_type, struct_pack(a := ts, b := event_id)) as last_type from events group by 1, 2""",
)
def f08(spark, path):
    events = src.table(spark, path, "events").withColumn("dt", src.day("ts"))
    order = F.struct("ts", "event_id")
    return events.groupBy("user_id", "dt").agg(
        F.min_by("event_type", order).alias("first_type"), F.max_by("event_type", order).alias("last_type")
    )


@query("F09_drop_limit_locked", with_views("select code, dt, high, low from bars_d where high <> low", "bars_d"))
def f09(spark, path):
    return src.bars_daily(spark, path).where("high <> low").select("code", "dt", "high", "low")


@query(
    "F10_screen",
    with_views(
        f"""select code, dt, round(close, 6) as close, round(m, 6) as ma from (select *, {_full('avg(close)', 20, 'close')} as m,
        close / lag(close) {P} as g from bars_d) where close > m and g > 1 and volume between 5 and 40 and amount > 10000""",
        "bars_d",
    ),
)
def f10(spark, path):
    bars = src.bars_daily(spark, path)
    bars = bars.withColumn("m", W.mean(c("close"), 20)).withColumn("g", c("close") / W.delay(c("close")))
    kept = bars.where("close > m and g > 1 and volume between 5 and 40 and amount > 10000")
    return kept.select("code", "dt", r("close").alias("close"), r("m").alias("ma"))


@query(
    "F11_valid_factors",
    """select distinct e.event_type || '_' || cast(e.user_id % 3 as varchar) || '_0' as factor
       from events e where e.event_type in (select event_type from events group by 1 having sum(value) > 0)
       and e.event_type like 'p%'""",
)
def f11(spark, path):
    events = src.table(spark, path, "events")
    names = events.select(F.concat_ws("_", "event_type", (c("user_id") % 3).cast("string"), F.lit("0")).alias("factor"))
    valid = events.groupBy(c("event_type").alias("base")).agg(F.sum("value").alias("v")).where("v > 0")
    bases = names.distinct().withColumn("base", F.split("factor", "_")[0])
    return bases.join(valid, "base", "left_semi").where(c("factor").like("p%")).select("factor")


@query(
    "F12_vwap",
    with_views("select code, dt, round(amount * 1000 / (volume * 100 + 1), 6) as vwap from bars_d", "bars_d"),
)
def f12(spark, path):
    return src.bars_daily(spark, path).select("code", "dt", r(S.vwap(c("amount"), c("volume"))).alias("vwap"))


@query("F13_suspended_flag", with_views("select code, dt, case when z is null then 1 else 0 end as stop from p", "p"))
def f13(spark, path):
    return panel(spark, path).select("code", "dt", S.suspended(c("z")).alias("stop"))


def price_macros():
    """Directional moves and true range against the previous bar."""
    o, h, l = c("open"), c("high"), c("low")
    o1, c1 = W.delay(o), W.delay(c("close"))
    return {
        "dtm": F.when(o <= o1, 0.0).when(o1.isNotNull(), F.greatest(h - o, o - o1)),
        "dbm": F.when(o >= o1, 0.0).when(o1.isNotNull(), F.greatest(o - l, o - o1)),
        "tr": F.greatest(F.greatest(h - l, F.abs(h - c1)), F.abs(l - c1)),
        "hd": h - W.delay(h),
        "ld": W.delay(l) - l,
    }


@query(
    "F14_macros",
    with_views(
        f"""select code, dt, round(case when o1 is null then null when open <= o1 then 0 else greatest(high - open, open - o1) end, 6) as dtm,
        round(case when o1 is null then null when open >= o1 then 0 else greatest(open - low, open - o1) end, 6) as dbm,
        round(greatest(high - low, coalesce(abs(high - c1), 0), coalesce(abs(low - c1), 0)), 6) as tr,
        round(high - lag(high) {P}, 6) as hd, round(lag(low) {P} - low, 6) as ld
        from (select *, lag(open) {P} as o1, lag(close) {P} as c1 from bars_d)""",
        "bars_d",
    ),
)
def f14(spark, path):
    macros = price_macros()
    return src.bars_daily(spark, path).select("code", "dt", *[r(v).alias(k) for k, v in macros.items()])


@query(
    "F15_shift_factor",
    with_views(f"select code, dt, round(lag(m, 3) {P}, 6) as \"MA_10_3\" from (select code, dt, {_full('avg(close)', 10, 'close')} as m from bars_d)", "bars_d"),
)
def f15(spark, path):
    from tessera.operators.registry import factor

    return factor(src.bars_daily(spark, path), "MA_10_3").select("code", "dt", r("MA_10_3").alias("MA_10_3"))


# -- scalars ------------------------------------------------------------------------------
_window(
    "M01_arithmetic",
    lambda x, y, o: {"a": x + o, "s": x - o, "m": x * y, "d": S.divide(x, y - 10)},
    {"a": "x + open", "s": "x - open", "m": "x * y", "d": "x / nullif(y - 10, 0)"},
    4,
)
_window(
    "M02_power",
    lambda x, o: {"v": S.power(x / 1000, F.lit(1.5)), "n": S.power(x - o, F.lit(0.5))},
    {"v": "pow(x / 1000, 1.5)", "n": "case when x >= open then pow(x - open, 0.5) end"},
)
_window("M03_signedpower", lambda x, o: {"v": S.signedpower(x - o, 0.5)},
    {"v": "sign(x - open) * pow(abs(x - open), 0.5)"})
_window("M04_log", lambda x, o: {"v": S.log(x - o), "p": S.log(x)},
    {"v": "case when x > open then ln(x - open) end", "p": "ln(x)"})
_window(
    "M05_elementary",
    lambda x, y, o: {"sq": S.sqrt(x - o), "ab": F.abs(x - o), "co": F.cos(y), "ta": F.tan(y / 50)},
    {"sq": "case when x >= open then sqrt(x - open) end", "ab": "abs(x - open)", "co": "cos(y)", "ta": "tan(y / 50)"},
)
_window("M06_sin", lambda y: {"v": F.sin(y)},
    {"v": "sin(y)"})
_window("M07_sign", lambda x, o: {"v": F.signum(x - o)},
    {"v": "cast(sign(x - open) as double)"})
_window(
    "M08_min_max",
    lambda x, z, o: {"lo": F.least(x, z, o), "hi": F.greatest(z, F.lit(1500.0))},
    {"lo": "least(x, z, open)", "hi": "greatest(z, 1500.0)"},
)
_window("M09_where", lambda x, z, o: {"v": F.when(x > o, z).otherwise(-o)},
    {"v": "case when x > open then z else -open end"})
_window(
    "M10_logic",
    lambda x, y, o: {"v": F.when(((x > o) & (y > 20)) | (y < 5), 1.0).otherwise(0.0)},
    {"v": "case when (x > open and y > 20) or y < 5 then 1.0 else 0.0 end::double"},
)
_window("M11_scale", lambda x: {"v": S.scale(x)},
    {"v": "x / 1000.0"})
_pp = "((high + low + close) / 3)"
_pivot_sql = {
    "PPSR": _pp,
    "PPR1": f"2 * {_pp} - low",
    "PPS1": f"2 * {_pp} - high",
    "PPR2": f"{_pp} + (high - low)",
    "PPS2": f"{_pp} - (high - low)",
    "PPR3": f"high + 2 * ({_pp} - low)",
    "PPS3": f"low - 2 * (high - {_pp})",
}
_window("M12_pivot_points", lambda h, l, close: S.pivot_points(h, l, close), _pivot_sql)
_window("E01_PPSR", lambda h, l, close: S.pivot_points(h, l, close), _pivot_sql)


@query(
    "M11_cs_scale",
    with_views("select code, dt, round(x / nullif(sum(abs(x)) over (partition by dt), 0), 8) as v from pm", "pm"),
)
def m11b(spark, path):
    return X.add_cs_scale(panel_m(spark, path), "x", "v").select("code", "dt", r("v", 8).alias("v"))


@query(
    "M13_transaction_cost",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 0.001 + greatest(l_extendedprice * 0.0003, 5.0), 6)
       as cost from lineitem""",
)
def m13(spark, path):
    cost = S.trade_cost(c("l_extendedprice"), tax=0.001, commission=0.0003, minimum=5.0)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return src.table(spark, path, "lineitem").select(*keys, r(cost).alias("cost"))


# Board codes and special-treatment names derived from the numeric code, the same rule on both sides.
BOARD = ("300", "688", "7", "600")
_board_sql = """case code % 4 when 0 then '300' when 1 then '688' when 2 then '7' else '600' end || lpad(cast(code as varchar), 4, '0')"""
_name_sql = "case when code % 7 = 0 then 'ST ' else '' end || 'Supplier ' || cast(code as varchar)"


def board_code():
    m = c("code") % 4
    board = F.when(m == 0, "300").when(m == 1, "688").when(m == 2, "7").otherwise("600")
    return F.concat(board, F.lpad(c("code").cast("string"), 4, "0"))


def short_name():
    return F.concat(F.when(c("code") % 7 == 0, "ST ").otherwise(""), F.lit("Supplier "), c("code").cast("string"))


@query(
    "M14_price_limit",
    with_views(
        f"""select code, dt, rate, round(coalesce(up, floor(pc * (1 + rate) * 100 + 0.5) / 100), 6) as up_limit, round(coalesce(dn, floor(pc * (1 - rate) * 100 + 0.5) / 100), 6) as down_limit
        from (select *, case when board like '300%' then case when dt >= date '2020-08-24' then 0.2 else 0.1 end
          when board like '688%' then 0.2 when board like '7%' or board like '8%' then 0.3
          when nm like '%ST%' then 0.05 else 0.1 end::double as rate
        from (select code, dt, lag(close) {P} as pc, case when volume > 30 then high end as up,
          case when volume > 30 then low end as dn, {_board_sql} as board, {_name_sql} as nm from bars_d))""",
        "bars_d",
    ),
)
def m14(spark, path):
    v = c("volume") > 30
    bars = src.bars_daily(spark, path)
    rate = S.limit_rate(board_code(), c("dt"), short_name())
    bars = bars.select("code", "dt", W.delay(c("close")).alias("pc"), rate.alias("rate"), F.when(v, c("high")).alias("up"), F.when(v, c("low")).alias("dn"))
    up, down = S.price_limits(c("pc"), c("rate"), c("up"), c("dn"))
    return bars.select("code", "dt", "rate", r(up).alias("up_limit"), r(down).alias("down_limit"))


@query(
    "M15_price_adjustment",
    with_views(
        """select code, dt, round(close, 6) as raw, round(close * adj_factor / last_value(adj_factor) over w, 6) as forward,
        round(close * adj_factor / first_value(adj_factor) over w, 6) as backward from bars_m join adj using (code, dt)
        window w as (partition by code order by dt rows between unbounded preceding and unbounded following)""",
        "bars_m",
        "adj",
    ),
)
def m15(spark, path):
    from tessera.operators.bars import adjust

    bars = src.bars_monthly(spark, path).join(src.adjustments(spark, path), ["code", "dt"])
    raw = bars.select("code", "dt", "adj_factor", c("close").alias("raw"), c("close").alias("forward"), c("close").alias("backward"))
    out = adjust(adjust(raw, ["forward"], "forward"), ["backward"], "backward")
    return out.select("code", "dt", r("raw").alias("raw"), r("forward").alias("forward"), r("backward").alias("backward"))


@query(
    "M16_strings",
    f"""select code, replace(replace(s, '.SH', '.XSHG'), '.SZ', '.XSHE') as exchange_code, nm like '%ST%' as special,
       b like '300%' as growth_board, replace(cast(d as varchar), '-', '') as compact from
       (select s_suppkey as code, lpad(cast(s_suppkey as varchar), 6, '0') || case when s_suppkey % 2 = 0 then '.SH' else '.SZ' end as s,
        {_name_sql.replace('code', 's_suppkey')} as nm, {_board_sql.replace('code', 's_suppkey')} as b,
        date '2020-01-01' + cast(s_suppkey % 300 as integer) as d from supplier)""",
)
def m16(spark, path):
    codes = src.table(spark, path, "supplier").select(c("s_suppkey").alias("code"))
    suffix = F.when(c("code") % 2 == 0, ".SH").otherwise(".SZ")
    s = F.concat(F.lpad(c("code").cast("string"), 6, "0"), suffix)
    d = F.date_add(F.lit("2020-01-01").cast("date"), (c("code") % 300).cast("int")).cast("string")
    return codes.select(
        "code",
        S.exchange_code(s).alias("exchange_code"),
        short_name().contains("ST").alias("special"),
        board_code().startswith("300").alias("growth_board"),
        F.replace(d, F.lit("-"), F.lit("")).alias("compact"),
    )


@query(
    "M17_dates",
    """select o_orderkey, cast(o_orderdate as date) as parsed, cast(cast(o_orderdate as date) + 1 as date) as next_day,
       last_day(cast(o_orderdate as date)) as month_end, cast(cast(o_orderdate as date) + interval 3 year as date) as horizon,
       strftime(o_orderdate, '%Y-%m-%d 09:30:00') as bar_time from orders""",
)
def m17(spark, path):
    d = src.day("o_orderdate")
    parsed = S.compact_date(F.date_format(d, "yyyyMMdd"))
    return src.table(spark, path, "orders").select(
        "o_orderkey",
        parsed.alias("parsed"),
        F.date_add(parsed, 1).alias("next_day"),
        F.last_day(parsed).alias("month_end"),
        F.add_months(parsed, 36).alias("horizon"),
        F.date_format(parsed, "yyyy-MM-dd 09:30:00").alias("bar_time"),
    )


@query(
    "M18_json",
    """select event_id, cast(json_extract_string(props, '$.k') as integer) as k,
       '{"type":"' || event_type || '","user":' || cast(user_id as varchar) || '}' as packed from events""",
)
def m18(spark, path):
    return src.table(spark, path, "events").select(
        "event_id",
        F.from_json("props", "k int")["k"].alias("k"),
        F.to_json(F.struct(c("event_type").alias("type"), c("user_id").alias("user"))).alias("packed"),
    )


_t = "(y / 25 - 1)"
_math_sql = {
    "ACOS": f"case when abs({_t}) <= 1 then acos({_t}) end", "ASIN": f"case when abs({_t}) <= 1 then asin({_t}) end",
    "ATAN": f"atan({_t})", "CEIL": f"ceil({_t})", "COS": f"cos({_t})", "COSH": f"cosh({_t})", "EXP": f"exp({_t})",
    "FLOOR": f"floor({_t})", "LN": f"case when {_t} > 0 then ln({_t}) end", "LOG10": f"case when {_t} > 0 then log10({_t}) end",
    "SIN": f"sin({_t})", "SINH": f"sinh({_t})", "SQRT": f"case when {_t} >= 0 then sqrt({_t}) end", "TAN": f"tan({_t})",
    "TANH": f"tanh({_t})", "ADD": "high + low / 1000000", "SUB": "high - low / 1000000", "MULT": "high * (low / 1000000)", "DIV": "high / nullif(low / 1000000, 0)",
}
_window("M19_math_transforms", lambda y, h, l: S.math_transforms(y / 25 - 1) | S.math_pairs(h, l / 1000000), _math_sql)


# -- cross-section ----------------------------------------------------------------------------
def rank_sql(v, keys="dt"):
    return (
        f"case when {v} is not null then (rank() over (partition by {keys} order by {v} nulls last) + "
        f"(count(*) over (partition by {keys}, {v}) - 1) / 2.0) / nullif(count({v}) over (partition by {keys}), 0) end"
    )


@query(
    "X01_cs_rank",
    with_views(f"select code, dt, round({rank_sql('x')}, 6) as rx, round({rank_sql('y')}, 6) as ry, round({rank_sql('z')}, 6) as rz from pm", "pm"),
)
def x01(spark, path):
    df = X.add_ranks(panel_m(spark, path), {"rx": c("x"), "ry": c("y"), "rz": c("z")})
    return df.select("code", "dt", *[r(k).alias(k) for k in ("rx", "ry", "rz")])


_std = "case when {v} is not null then coalesce(case when {s}({v}) over w > 1e-12 then ({v} - avg({v}) over w) / {s}({v}) over w end, 0) end"


@query(
    "X02_cs_zscore",
    with_views(f"select code, dt, round({_std.format(v='z', s='stddev_samp')}, 6) as v from pm window w as (partition by dt)", "pm"),
)
def x02(spark, path):
    return X.add_zscore(panel_m(spark, path), "z", "v").select("code", "dt", r("v").alias("v"))


@query(
    "X03_cs_industry_zscore",
    with_views(f"select code, dt, industry, round({_std.format(v='x', s='stddev_pop')}, 6) as v from pm window w as (partition by dt, industry)", "pm"),
)
def x03(spark, path):
    out = X.add_zscore(panel_m(spark, path), "x", "v", ["dt", "industry"], population=True)
    return out.select("code", "dt", "industry", r("v").alias("v"))


@query(
    "X04_cs_minmax",
    with_views(
        """select code, dt, round((x - min(x) over w) / nullif(max(x) over w - min(x) over w, 0), 6) as x,
        round((y - min(y) over w) / nullif(max(y) over w - min(y) over w, 0), 6) as y from pm window w as (partition by dt)""",
        "pm",
    ),
)
def x04(spark, path):
    return X.add_minmax(panel_m(spark, path), ["x", "y"]).select("code", "dt", r("x").alias("x"), r("y").alias("y"))


def buckets_sql(v, n, view):
    points = ", ".join(repr(i / n) for i in range(n + 1))
    return f"""select p.*, case when {v} is not null and len(edges) > 1 then
        greatest(len(list_filter(edges, lambda e: e < {v})), 1) end as q from {view} p
        left join (select dt, list_distinct(quantile_cont({v}, [{points}])) as edges from {view} where {v} is not null group by dt) using (dt)"""


@query("X05_cs_qcut", with_views(f"select code, dt, cast(q as integer) as q from ({buckets_sql('z', 10, 'pm')})", "pm"))
def x05(spark, path):
    return X.add_buckets(panel_m(spark, path), "z", 10, "q").select("code", "dt", c("q").cast("int").alias("q"))


@query("X07_cs_quantile5", with_views(f"select code, dt, cast(q as integer) as q from ({buckets_sql('y', 5, 'pm')})", "pm"))
def x07(spark, path):
    return X.add_buckets(panel_m(spark, path), "y", 5, "q").select("code", "dt", c("q").cast("int").alias("q"))


@query(
    "X06_top_n",
    with_views(
        """select code, dt, round(x, 6) as x, place from (select *, row_number() over (partition by dt order by x desc, code) as place from pm)
        where place <= 10""",
        "pm",
    ),
)
def x06(spark, path):
    top = X.top_n(panel_m(spark, path), 10, [c("x").desc(), c("code")])
    return top.select("code", "dt", r("x").alias("x"), c("place").cast("long").alias("place"))


@query(
    "X08_stratified_pool",
    with_views(
        """, f as (select code, arg_max(market, dt) as market, arg_max(close, dt) as m1, arg_max(volume, dt) as m2,
          arg_max(amount, dt) as m3, arg_max(high / low, dt) as m4 from pm group by code),
        long as (unpivot f on m1, m2, m3, m4 into name metric value v),
        cuts as (select market, metric, quantile_cont(v, [1.0/3, 2.0/3]) as t, count(distinct code) as codes from long group by 1, 2),
        ranked as (select code, market, metric, row_number() over (partition by market, metric, stratum order by v, code) as place from
          (select *, case when v <= t[1] then 0 when v <= t[2] then 1 else 2 end as stratum from long join cuts using (market, metric)))
        select distinct code, market from ranked where place <= greatest(1, (30 // (select count(distinct market) from f)) // 12)""".lstrip(", "),
        "pm",
    ).replace(" f as (", ", f as (", 1),
)
def x08(spark, path):
    from tessera.operators.evaluate import stratified_pool

    latest = panel_m(spark, path).groupBy("code").agg(
        *[F.max_by(v, "dt").alias(k) for k, v in {"market": c("market"), "m1": c("close"), "m2": c("volume"), "m3": c("amount"), "m4": c("high") / c("low")}.items()]
    )
    return stratified_pool(latest, ["m1", "m2", "m3", "m4"], 30)


@query(
    "X09_decreasing_weights",
    with_views(
        """select code, dt, place, round((10 - (place - 1) * (10.0 / place)) / 50.0, 6) as weight from
        (select *, row_number() over (partition by dt order by x desc, code) as place from pm) where place <= 10""",
        "pm",
    ),
)
def x09(spark, path):
    top = X.top_n(panel_m(spark, path), 10, [c("x").desc(), c("code")])
    return top.select("code", "dt", c("place").cast("long").alias("place"), r(X.decreasing_weight(c("place"), 10)).alias("weight"))


@query(
    "X10_tilted_index_weight",
    with_views(
        """select index_code, dt, code, round(case when place > 20 then 0 else weight * pow(pred, 2) end, 8) as weight from
        (select *, row_number() over (partition by index_code, dt order by pred desc, code) as place from
         (select w.*, b.close / b.open as pred from weights w join bars_m b using (code, dt)))""",
        "weights",
    ),
)
def x10(spark, path):
    pred = src.bars_monthly(spark, path).select("code", "dt", (c("close") / c("open")).alias("pred"))
    both = src.index_weights(spark, path).join(pred, ["code", "dt"])
    best = X.top_n(both, 20, [c("pred").desc(), c("code")], ["index_code", "dt"]).select("index_code", "dt", "code", F.lit(True).alias("kept"))
    weight = F.when(c("kept"), c("weight") * F.pow("pred", F.lit(2.0))).otherwise(0.0)
    out = both.join(best, ["index_code", "dt", "code"], "left")
    return out.select("index_code", "dt", "code", r(weight, 8).alias("weight"))
