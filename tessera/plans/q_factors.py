"""Queries for adjusted bars, event-aligned factor groups and factor evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import windows as W
from tessera.operators import align as G
from tessera.operators import bars as B
from tessera.operators import evaluate as V
from tessera.plans.q_tables import _aligned_cte, _fr_cte, _names_cte, bars_d, bars_m, corr_agg_sql, factor_returns, name_history
from tessera.plans.q_windows import _board_sql, board_code, panel_m, rank_sql
from tessera.plans.registry import P, query, r, register, with_views
from tessera.sources import panel as src

c = F.col


# -- adjusted bars ------------------------------------------------------------------------------
def exchange_limits(bars):
    """Published limits for the busier half of the bars; the rest follow the board rule."""
    busy = bars.where("volume > 25")
    return busy.select("code", "dt", (c("close") * 1.1).alias("up_limit"), (c("close") * 0.9).alias("down_limit"))


def adjusted_bars(spark, path, mode="forward"):
    bars = bars_d(spark, path)
    return B.build_bars(
        bars,
        src.calendar(spark, path),
        src.adjustments(spark, path),
        name_history(spark, path),
        exchange_limits(bars),
        mode,
        board_code(),
    )


_PRICES = ("open", "high", "low", "close", "pre_close", "upLimit", "downLimit")


def adjusted_sql(mode):
    pick = {"forward": "last_value", "backward": "first_value"}[mode]
    base = f"{pick}(adj_factor) over (partition by code order by dt rows between unbounded preceding and unbounded following)"
    scaled = ", ".join(f'"{p}" * adj_factor / base as "{p}"' for p in _PRICES)
    up = "over (partition by al.code order by al.dt rows between unbounded preceding and current row)"
    ctes = _aligned_cte | _names_cte | {
        "a1": f"""select al.code, al.dt, last_value(open ignore nulls) {up} as open, last_value(high ignore nulls) {up} as high,
            last_value(low ignore nulls) {up} as low, last_value(close ignore nulls) {up} as close,
            coalesce(volume, 0) as volume, coalesce(amount, 0) as amount, case when al.close is null then 1 else 0 end as stop,
            case when volume > 25 then al.close * 1.1 end as xu, case when volume > 25 then al.close * 0.9 end as xd,
            coalesce(j.adj_factor, j0.f) as adj_factor, coalesce(n.name, n0.f) as name
            from al asof left join adj j on j.code = al.code and j.dt <= al.dt
            left join (select code, arg_min(adj_factor, dt) as f from adj group by code) j0 on j0.code = al.code
            asof left join nm n on n.code = al.code and n.dt <= al.dt
            left join (select code, arg_min(name, dt) as f from nm group by code) n0 on n0.code = al.code""",
        "a2": f"""select *, lag(close) {P} as pre_close, case when {_board_sql} like '300%' then case when dt >= date '2020-08-24' then 0.2 else 0.1 end
            when {_board_sql} like '688%' then 0.2 when {_board_sql} like '7%' then 0.3 when name like '%ST%' then 0.05 else 0.1 end::double as rate from a1""",
        "a3": f"""select *, coalesce(xu, floor(pre_close * (1 + rate) * 100 + 0.5) / 100) as "upLimit",
            coalesce(xd, floor(pre_close * (1 - rate) * 100 + 0.5) / 100) as "downLimit", {base} as base from a2""",
        "a4": f"select code, dt, {scaled}, volume, amount, name, stop, adj_factor from a3",
    }
    numbers = ", ".join(f'round("{p}", 4) as "{p}"' for p in _PRICES)
    body = f"""select code, dt, {numbers}, round(close - pre_close, 4) as change, round((close - pre_close) / nullif(pre_close, 0), 6) as returns,
        volume, round(amount, 4) as amount, name, round(amount * 1000 / (volume * 100 + 1), 4) as vwap, stop, round(adj_factor, 6) as adj_factor from a4"""
    return with_views(body, "bars_d", "cal", "adj", "fund", extra=ctes)


def rounded_bars(df):
    digits = {"returns": 6, "adj_factor": 6} | {k: 4 for k in (*_PRICES, "change", "amount", "vwap")}
    return df.select(*[r(k, digits[k]).alias(k) if k in digits else c(k) for k in df.columns])


register("G07_adjusted_bars", lambda s, p: rounded_bars(adjusted_bars(s, p)), adjusted_sql("forward"))
register("G08_bars_many", lambda s, p: rounded_bars(adjusted_bars(s, p, "backward")).orderBy("code", "dt"), adjusted_sql("backward"))


# -- factor groups --------------------------------------------------------------------------------
@query(
    "G01_finance_factors",
    with_views(
        """select b.code, b.dt, round(a.eps, 6) as eps, round(a.shares, 4) as "totalShares" from bars_d b
        asof left join fund a on a.code = b.code and a.ann_date < b.dt""",
        "bars_d",
        "fund",
    ),
)
def g01(spark, path):
    table = src.statements(spark, path).select("code", "ann_date", "eps", c("shares").alias("total_shares"))
    out = G.factor_group(bars_d(spark, path), table, ["eps", "total_shares"], "ann_date", 3)
    return out.select("code", "dt", r("eps").alias("eps"), r("totalShares", 4).alias("totalShares"))


_UP = "over (partition by b.code order by b.dt rows between unbounded preceding and current row)"


@query(
    "G02_basic_factors",
    with_views(
        f"""select b.code, b.dt, round(last_value(m.close / m.open ignore nulls) {_UP}, 6) as "peTtm", round(last_value(m.volume ignore nulls) {_UP}, 4) as "totalMv"
        from bars_d b left join bars_m m on m.code = b.code and m.dt = b.dt""",
        "bars_d",
        "bars_m",
    ),
)
def g02(spark, path):
    table = bars_m(spark, path).select("code", c("dt").alias("trade_date"), (c("close") / c("open")).alias("pe_ttm"), c("volume").alias("total_mv"))
    out = G.factor_group(bars_d(spark, path), table, ["pe_ttm", "total_mv"], "trade_date", 0)
    return out.select("code", "dt", r("peTtm").alias("peTtm"), r("totalMv", 4).alias("totalMv"))


_flow_cte = {
    "mf": """select l_suppkey as code, cast(l_shipdate as date) as dt, sum(case when l_returnflag <> 'R' and l_quantity <= 25 then l_quantity else 0 end) as buy_sm_vol,
        sum(case when l_returnflag <> 'R' and l_quantity > 25 then l_quantity else 0 end) as buy_lg_vol, sum(case when l_returnflag = 'R' then l_extendedprice else 0 end) as sell_amount,
        sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end) as net_mf_vol from lineitem group by 1, 2"""
}


@query(
    "G03_moneyflow_factors",
    with_views(
        f"""select b.code, b.dt, {', '.join(f'round(last_value(mf.{a} ignore nulls) {_UP}, 4) as "{b}"' for a, b in
          (('buy_sm_vol', 'buySmVol'), ('buy_lg_vol', 'buyLgVol'), ('sell_amount', 'sellAmount'), ('net_mf_vol', 'netMfVol')))}
        from bars_d b left join mf on mf.code = b.code and mf.dt = b.dt""",
        "bars_d",
        extra=_flow_cte,
    ),
)
def g03(spark, path):
    lines = src.table(spark, path, "lineitem")
    returned, small = c("l_returnflag") == "R", c("l_quantity") <= 25
    q = c("l_quantity")
    table = lines.groupBy(c("l_suppkey").alias("code"), src.day().alias("trade_date")).agg(
        F.sum(F.when(~returned & small, q).otherwise(0.0)).alias("buy_sm_vol"),
        F.sum(F.when(~returned & ~small, q).otherwise(0.0)).alias("buy_lg_vol"),
        F.sum(F.when(returned, c("l_extendedprice")).otherwise(0.0)).alias("sell_amount"),
        F.sum(F.when(returned, -q).otherwise(q)).alias("net_mf_vol"),
    )
    columns = ["buy_sm_vol", "buy_lg_vol", "sell_amount", "net_mf_vol"]
    out = G.factor_group(bars_d(spark, path), table, columns, "trade_date", 0)
    return out.select("code", "dt", *[r(G.camel(k), 4).alias(G.camel(k)) for k in columns])


@query(
    "G04_limit_list_factors",
    with_views(
        f"""select b.code, b.dt, round(e.amp, 6) as amp, e.dir as "limit" from bars_d b left join (select * from
        (select code, dt, high / low - 1 as amp, case when close > pc then 'U' else 'D' end as dir, close / pc as g from
        (select *, lag(close) {P} as pc from bars_d)) where g > 1.5 or g < 0.6) e on e.code = b.code and e.dt = b.dt""",
        "bars_d",
    ),
)
def g04(spark, path):
    bars = bars_d(spark, path)
    marked = bars.withColumn("pc", W.delay(c("close")))
    events = marked.where("close / pc > 1.5 or close / pc < 0.6").select(
        "code", c("dt").alias("trade_date"), (c("high") / c("low") - 1).alias("amp"), F.when(c("close") > c("pc"), "U").otherwise("D").alias("limit")
    )
    out = G.factor_group(bars, events, ["amp", "limit"], "trade_date", 2)
    return out.select("code", "dt", r("amp").alias("amp"), "limit")


@query(
    "G05_valuation_factors",
    with_views(
        f"""select b.code, b.dt, d.industry, round(last_value(m.close ignore nulls) {_UP}, 4) as value, round(last_value(m.high ignore nulls) {_UP}, 4) as "valueMax"
        from bars_d b join dim d on d.code = b.code left join bars_m m on m.code = b.code and m.dt = b.dt""",
        "bars_d",
        "bars_m",
        "dim",
    ),
)
def g05(spark, path):
    text = F.date_format("dt", "yyyy-MM-dd").alias("day")
    table = bars_m(spark, path).select("code", text, c("close").alias("value"), c("high").alias("value_max"))
    out = G.factor_group(bars_d(spark, path), table, ["value", "value_max"], "day", 1)
    out = out.join(src.listing(spark, path).select("code", "industry"), "code")
    return out.select("code", "dt", "industry", r("value", 4).alias("value"), r("valueMax", 4).alias("valueMax"))


@query("G06_passthrough", with_views('select code, dt, round(close, 6) as close, 123 as xx123 from bars_d', "bars_d"))
def g06(spark, path):
    return bars_d(spark, path).select("code", "dt", r("close").alias("close"), F.lit(123).alias("xx123"))


# -- evaluation ---------------------------------------------------------------------------------------
@query(
    "V01_forward_return",
    with_views(
        f"select code, dt, {', '.join(f'round(lead(close, {d}) {P} / nullif(lead(open) {P}, 0), 6) as r{d}' for d in V.HORIZONS)} from bars_d", "bars_d"
    ),
)
def v01(spark, path):
    return bars_d(spark, path).select("code", "dt", *[r(V.forward_return(d)).alias(f"r{d}") for d in V.HORIZONS])


def _summary_sql(x, source, keys):
    spread = f"coalesce(stddev_samp({x}), 0)"
    return (
        f"select {keys}, round(coalesce(avg({x}), 0), 6) as ic_{x}, round(case when {spread} > 1e-12 then avg({x}) / {spread} else 0 end, 6) as ir_{x} "
        f"from {source} group by {keys}"
    )


_BIN = "cast(floor((dt - (select min(dt) from fr)) / 120) as integer) as bin"


@query(
    "V02_ic_ir",
    with_views(
        _summary_sql("ret", f"(select market, bin, {corr_agg_sql('f', 'ret')} as ret from (select *, {_BIN} from fr) group by 1, 2)", "market"),
        "bars_m",
        "dim",
        extra=_fr_cte,
    ),
)
def v02(spark, path):
    out = V.ic_ir(factor_returns(spark, path), ["market"], ["ret"], value="f")
    return out.select("market", r("ic_ret").alias("ic_ret"), r("ir_ret").alias("ir_ret"))


@query(
    "V03_rank_ic_ir",
    with_views(
        _summary_sql(
            "ret",
            f"""(select market, bin, {corr_agg_sql('rf', 'rr')} as ret from (select *, {rank_sql('f', 'market, bin')} as rf, {rank_sql('ret', 'market, bin')} as rr
            from (select *, {_BIN} from fr)) group by 1, 2)""",
            "market",
        ),
        "bars_m",
        "dim",
        extra=_fr_cte,
    ),
)
def v03(spark, path):
    out = V.rank_ic_ir(factor_returns(spark, path), ["market"], "ret", value="f")
    return out.select("market", r("ic_ret").alias("ic_ret"), r("ir_ret").alias("ir_ret"))


def _edges(n):
    return "[" + ", ".join(repr(i / n) for i in range(n + 1)) + "]"


def sharpe_sql(source, keys, x, value, n):
    """Net-value-weighted quantile Sharpe of return column x."""
    return f"""select {keys}, coalesce(sum(net * s) / nullif(sum(net), 0), 0) as sharpe_{x} from (
        select {keys}, q, product(m) as net, case when coalesce(stddev_pop(m - 1), 0) > 1e-12 then avg(m - 1) / stddev_pop(m - 1) else 0 end as s from (
          select {keys}, dt, q, avg({x}) as m from (
            select t.*, greatest(len(list_filter(edges, lambda e: e < {value})), 1) as q from {source} t join
            (select {keys}, dt, list_distinct(quantile_cont({value}, {_edges(n)})) as edges from {source} where {value} is not null group by {keys}, dt) using ({keys}, dt)
            where len(edges) > 1 and {value} is not null) group by {keys}, dt, q) group by {keys}, q) group by {keys}"""


@query(
    "V04_quantile_sharpe",
    with_views(f"select market, round(sharpe_ret, 6) as sharpe_ret from ({sharpe_sql('fr', 'market', 'ret', 'f', 10)})", "bars_m", "dim", extra=_fr_cte),
)
def v04(spark, path):
    out = V.quantile_sharpe(factor_returns(spark, path), ["market"], ["ret"], value="f")
    return out.select("market", r("sharpe_ret").alias("sharpe_ret"))


_HOR = (1, 2, 5)
_score_cte = {
    "w0": f"select code, dt, close / open as gain, high - low as spread, volume as lots, {', '.join(f'lead(close, {d}) {P} / nullif(lead(open) {P}, 0) as r{d}' for d in _HOR)} from bars_m",
    "fr": "select 'gain' as factor, gain as value, * exclude (gain, spread, lots) from w0 union all select 'spread', spread, * exclude (gain, spread, lots) from w0 union all select 'lots', lots, * exclude (gain, spread, lots) from w0",
    "bins": f"select *, {_BIN} from fr",
    **{f"ic{d}": f"select factor, coalesce(avg(c), 0) as ic, case when coalesce(stddev_samp(c), 0) > 1e-12 then avg(c) / stddev_samp(c) else 0 end as ir from (select factor, bin, {corr_agg_sql(f'(case when r{d} is not null then value end)', f'r{d}')} as c from bins group by 1, 2) group by 1" for d in _HOR},
    **{f"sh{d}": sharpe_sql("fr", "factor", f"r{d}", "value", 10) for d in _HOR},
}
_mean = {k: "(" + " + ".join(f"ic{d}.{k}" for d in _HOR) + f") / {len(_HOR)}" for k in ("ic", "ir")}
_best = "greatest(" + ", ".join(f"sharpe_r{d}" for d in _HOR) + ")"


@query(
    "V05_factor_score",
    with_views(
        f"""select ic1.factor, round({_mean['ic']}, 6) as ic, round({_mean['ir']}, 6) as ir, round({_best}, 6) as sharpe,
        round(10 * abs({_mean['ic']}) + abs({_mean['ir']}) + abs({_best}), 4) as score from ic1 """
        + " ".join(f"join ic{d} on ic{d}.factor = ic1.factor" for d in _HOR[1:])
        + " "
        + " ".join(f"join sh{d} on sh{d}.factor = ic1.factor" for d in _HOR),
        "bars_m",
        extra=_score_cte,
    ),
)
def v05(spark, path):
    from tessera.plans.q_tables import factor_table

    panel = bars_m(spark, path).join(factor_table(spark, path), ["code", "dt"])
    out = V.factor_score(panel, ["gain", "spread", "lots"], _HOR)
    return out.select("factor", r("ic").alias("ic"), r("ir").alias("ir"), r("sharpe").alias("sharpe"), r("score", 4).alias("score"))


_z = "case when gain is not null then coalesce(case when stddev_pop(gain) over w > 1e-12 then (gain - avg(gain) over w) / stddev_pop(gain) over w end, 0) end"
_report_cte = {
    "g0": f"select *, close / open as gain, {', '.join(f'lead(close, {d}) {P} / nullif(close, 0) - 1 as p{d}' for d in V.REPORT_PERIODS)} from bars_m join dim using (code)",
    "g1": f"select *, round({_z}, 9) as f from g0 window w as (partition by dt, industry)",
    "g2": f"""select g1.*, case when len(edges) > 1 then greatest(len(list_filter(edges, lambda e: e < f)), 1) end as q from g1
        left join (select dt, list_distinct(quantile_cont(f, {_edges(5)})) as edges from g1 group by dt) using (dt) where f is not null""",
}


def report_panel(spark, path):
    return panel_m(spark, path).withColumn("gain", c("close") / c("open"))


_agg = ", ".join(
    f"round(avg(p{d}), 6) as mean_{d}, round(stddev_samp(p{d}) / nullif(sqrt(count(p{d})), 0), 6) as stderr_{d}, round(pow(1 + avg(p{d}), {1 / d!r}) - 1, 6) as rate_{d}"
    for d in V.REPORT_PERIODS
)


@query("V06_factor_report", with_views(f"select cast(q as integer) as q, {_agg} from g2 where q is not null group by q", "bars_m", "dim", extra=_report_cte))
def v06(spark, path):
    out = V.report_quantiles(report_panel(spark, path), "gain")
    return out.select(c("q").cast("int").alias("q"), *[r(k).alias(k) for k in out.columns if k != "q"])


_ic_daily = f"select dt, {corr_agg_sql('rf', 'rr')} as ic from (select dt, {rank_sql('f')} as rf, {rank_sql('p1')} as rr from g2 where p1 is not null) group by dt"


@query("V06_rank_ic", with_views(f"select dt, round(ic, 6) as ic from ({_ic_daily})", "bars_m", "dim", extra=_report_cte))
def v06b(spark, path):
    return V.report_rank_ic(report_panel(spark, path), "gain").select("dt", r("ic").alias("ic"))


@query(
    "V06_monthly_ic",
    with_views(f"select cast(date_trunc('month', dt) as date) as month, round(avg(ic), 6) as ic from ({_ic_daily}) group by 1", "bars_m", "dim", extra=_report_cte),
)
def v06c(spark, path):
    return V.report_monthly_ic(report_panel(spark, path), "gain").select("month", r("ic").alias("ic"))


@query(
    "V06_autocorrelation",
    with_views(
        f"""select dt, round({corr_agg_sql('a', 'b')}, 6) as autocorrelation from (select dt, case when b is not null then rk end as a, b from
        (select dt, rk, lag(rk) {P} as b from (select code, dt, {rank_sql('f')} as rk from g2))) group by dt""",
        "bars_m",
        "dim",
        extra=_report_cte,
    ),
)
def v06d(spark, path):
    out = V.report_autocorrelation(report_panel(spark, path), "gain")
    return out.select("dt", r("autocorrelation").alias("autocorrelation"))


@query(
    "V07_prefix_invariance",
    with_views(
        "select 'honest' as factor, cast(0 as bigint) as differing union all select 'ahead', count(*) from (select code, max(dt) as last from bars_m "
        "where dt <= date '1998-06-30' group by code) l where exists (select 1 from bars_m b where b.code = l.code and b.dt > l.last)",
        "bars_m",
    ),
)
def v07(spark, path):
    def build(bars):
        return bars.select("code", "dt", W.mean(c("close"), 10).alias("honest"), W.future(c("close"), 1).alias("ahead"))

    return V.prefix_differences(bars_m(spark, path), build, ["honest", "ahead"], "1998-06-30")


@query(
    "V08_limit_streaks",
    with_views(
        f""", cm as (select dt, row_number() over (order by dt) as day from (select distinct dt from bars_m)),
        hit as (select code, dt from (select code, dt, close / lag(close) {P} as g from bars_m) where g > 1.1),
        runs as (select code, dt, day - row_number() over (partition by code order by dt) as run from hit join cm using (dt)),
        lens as (select code, run, count(*) as days, min(dt) as first_day from runs group by 1, 2)
        select code, days, first_day from lens where days >= 2 qualify row_number() over (partition by code order by days desc, first_day) = 1""".lstrip(", "),
        "bars_m",
    ).replace(" cm as (", ", cm as (", 1),
)
def v08(spark, path):
    bars = bars_m(spark, path)
    hits = bars.withColumn("g", c("close") / W.delay(c("close"))).where("g > 1.1").select("code", "dt")
    return V.streaks(hits, bars.select("dt").distinct(), 2)


@query(
    "J15_streak_dim",
    with_views(
        f""", cm as (select dt, row_number() over (order by dt) as day from (select distinct dt from bars_m)),
        hit as (select code, dt from (select code, dt, close / lag(close) {P} as g from bars_m) where g > 1.1),
        runs as (select code, dt, day - row_number() over (partition by code order by dt) as run from hit join cm using (dt)),
        lens as (select code, run, count(*) as days, min(dt) as first_day from runs group by 1, 2)
        select code, days, industry, market from (select code, days, first_day from lens where days >= 3
        qualify row_number() over (partition by code order by days desc, first_day) = 1) left join dim using (code)""".lstrip(", "),
        "bars_m",
        "dim",
    ).replace(" cm as (", ", cm as (", 1),
)
def j15(spark, path):
    bars = bars_m(spark, path)
    hits = bars.withColumn("g", c("close") / W.delay(c("close"))).where("g > 1.1").select("code", "dt")
    runs = V.streaks(hits, bars.select("dt").distinct(), 3)
    return runs.join(src.listing(spark, path), "code", "left").select("code", "days", "industry", "market")
