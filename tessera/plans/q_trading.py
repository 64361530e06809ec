"""Queries for order rules, ledgers, performance ratios, labels and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.functions import windows as W
from tessera.operators import labels as M
from tessera.operators import ledger as L
from tessera.operators import performance as R
from tessera.plans.q_tables import _div_cte, _fr_cte, _pred_cte, bars_d, bars_m, corr_agg_sql, dividend_table, factor_returns, predictions
from tessera.plans.q_windows import _board_sql, _name_sql, board_code, short_name
from tessera.plans.registry import P, digits, digits_sql, query, r, with_views
from tessera.sources import panel as src

c = F.col

# -- orders --------------------------------------------------------------------------------------
_orders_cte = {
    "pb": f"select *, lag(close) {P} as pc from bars_d",
    "od": f"""select f.account, f.code, f.dt, f.l_orderkey, f.l_linenumber, f.qty > 0 as is_buy, abs(f.qty) * 37 as amount, f.price, b.high, b.low, b.pc, b.open, b.close, b.volume,
        case when f.code % 5 = 0 and b.volume < 10 then 1 else 0 end as stop, b.pc * 1.1 as up_limit, b.pc * 0.9 as down_limit,
        {_name_sql.replace('code', 'f.code')} || case when f.code % 11 = 3 then '退' else '' end as name, {_board_sql.replace('code', 'f.code')} as board
        from fills f join pb b on b.code = f.code and b.dt = f.dt""",
}


def order_table(spark, path):
    """Each fill as an order of 37 lots per unit, with its day's bar, name and limits."""
    bars = bars_d(spark, path).withColumn("pc", W.delay(c("close")))
    fills = src.fills(spark, path)
    df = fills.join(bars, ["code", "dt"])
    return df.select(
        "account", "code", "dt", "l_orderkey", "l_linenumber", (c("qty") > 0).alias("is_buy"), (F.abs("qty") * 37).alias("amount"), "price",
        "high", "low", "pc", "open", "close", "volume",
        F.when((c("code") % 5 == 0) & (c("volume") < 10), 1).otherwise(0).alias("stop"),
        (c("pc") * 1.1).alias("up_limit"), (c("pc") * 0.9).alias("down_limit"),
        F.concat(short_name(), F.when(c("code") % 11 == 3, "退").otherwise("")).alias("name"),
        board_code().alias("board"),
    )


_ORDER = ("account", "code", "dt", "l_orderkey", "l_linenumber")
_order_keys = ", ".join(_ORDER)
_top = "(is_buy and price >= up_limit and price = high)"
_bottom = "(not is_buy and price <= down_limit and price = low)"


@query(
    "L01_rules",
    with_views(
        f"""select {_order_keys}, amount, case when name like '%退%' then 'delist' when price is null or stop = 1 or price = 0 then 'stop'
        when name like '%ST%' then 'st' when {_top} or {_bottom} then 'limit'
        when substr(board, 1, 3) not in ('600', '601', '603', '000', '002') then 'mainboard' end as reject_reason from od""",
        "bars_d",
        "fills",
        extra=_orders_cte,
    ),
)
def l01(spark, path):
    return order_table(spark, path).select(*_ORDER, "amount", L.reject_reason().alias("reject_reason"))


@query(
    "L02_lot_rounding",
    with_views(
        f"""select {_order_keys}, amount, floor(amount / 100) * 100 as lots, case when not is_buy and held <= 0 then 0 when not is_buy and sale = held then sale
        when board like '688%' then case when asked < 200 then 0 else least(asked, 50000) end else floor(asked / 100) * 100 end::double as size from
        (select *, case when is_buy then amount else sale end as asked from (select *, least(amount, available) as sale from
          (select *, volume * 41 as held, volume * 29 as available from od)))""",
        "bars_d",
        "fills",
        extra=_orders_cte,
    ),
)
def l02(spark, path):
    held, available = c("volume") * 41, c("volume") * 29
    size = L.order_quantity(c("amount"), c("is_buy"), c("board"), held, available)
    return order_table(spark, path).select(*_ORDER, "amount", L.round_lots(c("amount")).cast("double").alias("lots"), size.alias("size"))


@query(
    "L03_volume_ratio",
    with_views(f"select {_order_keys}, amount, round(least(amount, volume * 0.1), 6) as filled from od", "bars_d", "fills", extra=_orders_cte),
)
def l03(spark, path):
    return order_table(spark, path).select(*_ORDER, "amount", r(L.volume_cap(c("amount"), c("volume"))).alias("filled"))


@query(
    "L04_order_cost",
    with_views(
        f"""select {_order_keys}, round(amount * price, 4) as value, round(amount * price * 0.005, 4) as slip,
        round(case when is_buy then 0 else amount * price * 0.001 end + greatest(amount * price * 0.0003, 5), 4) as cost from od""",
        "bars_d",
        "fills",
        extra=_orders_cte,
    ),
)
def l04(spark, path):
    value = c("amount") * c("price")
    return order_table(spark, path).select(
        *_ORDER, r(value, 4).alias("value"), r(value * L.SLIP, 4).alias("slip"), r(L.order_cost(value, c("is_buy")), 4).alias("cost")
    )


_clock = "case l_linenumber % 3 when 0 then '08:00' when 1 then '10:30' else '15:30' end"


@query(
    "L05_execution_price",
    with_views(
        f"select {_order_keys}, amount, round(case {_clock} when '08:00' then pc when '10:30' then open else close end, 6) as fill_price from od",
        "bars_d",
        "fills",
        extra=_orders_cte,
    ),
)
def l05(spark, path):
    m = c("l_linenumber") % 3
    clock = F.when(m == 0, "08:00").when(m == 1, "10:30").otherwise("15:30")
    return order_table(spark, path).select(*_ORDER, "amount", r(L.execution_price(clock, c("pc"), c("open"), c("close"))).alias("fill_price"))


# -- ledgers ------------------------------------------------
_AC = "over (partition by account, code order by dt rows between unbounded preceding and {})"
_ledger_cte = {
    "fv": """select account, code, dt, qty, abs(qty) * price as value,
        case when qty > 0 then 0 else abs(qty) * price * 0.001 end + greatest(abs(qty) * price * 0.0003, 5) as cost from fills""",
    "dl": """select account, code, dt, sum(case when qty > 0 then qty else 0 end) as bought, sum(case when qty > 0 then 0 else -qty end) as sold,
        sum(case when qty > 0 then value else 0 end) as buy_value, sum(case when qty > 0 then 0 else value end) as sell_value,
        sum(case when qty > 0 then cost else 0 end) as buy_cost, sum(case when qty > 0 then 0 else cost end) as sell_cost from fv group by 1, 2, 3""",
    "l1": f"select *, sum(bought - sold) {_AC.format('current row')} as qty, coalesce(sum(bought - sold) {_AC.format('1 preceding')}, 0) as available from dl",
    "l2": f"select *, coalesce(sum(case when qty = 0 then 1 else 0 end) {_AC.format('1 preceding')}, 0) as episode from l1",
    "l3": """select *, case when qty <> 0 then sum(buy_value + buy_cost + sell_cost - sell_value) over (partition by account, code, episode order by dt
        rows between unbounded preceding and current row) else 0 end as total_cost from l2""",
    "lg": "select *, total_cost / nullif(qty, 0) as cost_basis from l3",
}


def portfolios(spark, path):
    return L.daily_fills(src.fills(spark, path))


@query("L06_available_qty", with_views("select account, code, dt, available from lg", "fills", extra=_ledger_cte))
def l06(spark, path):
    return L.available_quantity(portfolios(spark, path))


@query(
    "L07_position_ledger",
    with_views("select account, code, dt, qty, round(total_cost, 2) as total_cost, round(cost_basis, 4) as cost_basis from lg", "fills", extra=_ledger_cte),
)
def l07(spark, path):
    out = L.position_ledger(portfolios(spark, path))
    return out.select("account", "code", "dt", "qty", r("total_cost", 2).alias("total_cost"), r("cost_basis", 4).alias("cost_basis"))


_credit_cte = {
    "cr": """select account, code, record_date, coalesce(pay_date, ex_date) as dt, qty * cash as credit from
        (select account, code, dt as a, coalesce(lead(dt) over (partition by account, code order by dt), date '9999-12-31') as b, qty from lg) s
        join (select * from dv where div_proc = 'implemented') d using (code) where qty > 0 and a <= record_date and record_date < b""",
}


def implemented(spark, path):
    return dividend_table(spark, path).where("div_proc = 'implemented'")


def credits(spark, path, by="code"):
    return L.dividend_credits(L.position_ledger(portfolios(spark, path)), implemented(spark, path), by)


@query(
    "L08_cash_ledger",
    with_views(
        """select account, dt, round(1000000 + sum(flow) over (partition by account order by dt), 2) as cash from (select account, dt, sum(flow) as flow from
        (select account, dt, sell_value - buy_value - buy_cost - sell_cost - 0.005 * (buy_value + sell_value) as flow from dl union all select account, dt, credit from cr)
        group by 1, 2)""",
        "fills",
        "adj",
        extra=_ledger_cte | _div_cte | _credit_cte,
    ),
)
def l08(spark, path):
    out = L.cash_ledger(portfolios(spark, path), credits(spark, path, by="account"))
    return out.select("account", "dt", r("cash", 2).alias("cash"))


@query(
    "L09_dividend_credit",
    with_views("select code, dt, round(sum(credit), 4) as credit, count(*) as holders from cr group by 1, 2", "fills", "adj", extra=_ledger_cte | _div_cte | _credit_cte),
)
def l09(spark, path):
    return credits(spark, path).groupBy("code", "dt").agg(r(F.sum("credit"), 4).alias("credit"), F.count(F.lit(1)).alias("holders"))


# Marked to market on every open day.
_nav_cte = _ledger_cte | {
    "ch": """select account, dt, 1000000 + sum(flow) over (partition by account order by dt) as cash from (select account, dt,
        sum(sell_value - buy_value - buy_cost - sell_cost - 0.005 * (buy_value + sell_value)) as flow from dl group by 1, 2)""",
    "sp": """select * from (select account, code, qty, dt as f, coalesce(lead(dt) over (partition by account, code order by dt), date '9999-12-31') as t from lg)
        where qty <> 0""",
    "qi": "select code, close, dt as a, coalesce(lead(dt) over (partition by code order by dt), date '9999-12-31') as b from bars_d",
    "ev": """select account, unnest([greatest(a, f), least(b, t)]) as dt, unnest([qty * close, -qty * close]) as v from sp join qi using (code)
        where a < t and b > f""",
    "pe": "select account, dt, sum(v) as v from ev group by 1, 2",
    "ds": """select account, dt, true as o from (select account, min(dt) as lo from lg group by 1) join (select distinct dt from bars_d) on dt >= lo""",
    "nr": """select account, dt, coalesce(sum(v) over w, 0) as positions, coalesce(sum(v) over w, 0) + last_value(cash ignore nulls) over w as nav
        from ds left join pe using (account, dt) left join ch using (account, dt)
        window w as (partition by account order by dt rows between unbounded preceding and current row)""",
    "nv": "select *, nav / nullif(lag(nav) over (partition by account order by dt), 0) as ratio from nr",
}


def day_nav(spark, path):
    daily = portfolios(spark, path)
    bars = src.bars_daily(spark, path)
    return daily, L.daily_nav(L.position_ledger(daily), L.cash_ledger(daily), bars, bars.select("dt").distinct())


@query(
    "L10_daily_nav",
    with_views(
        f"""select account, cast(date_trunc('month', dt) as date) as month, count(*) as days, round(arg_max(positions, dt), 2) as positions,
        round(arg_max(nav, dt), 2) as nav, round(avg(nav), 2) as mean_nav, {digits_sql('min(ratio)')} as least, {digits_sql('max(ratio)')} as most from nv group by 1, 2""",
        "fills",
        "bars_d",
        extra=_nav_cte,
    ),
)
def l10(spark, path):
    """Monthly statement of the daily net values."""
    _, nav = day_nav(spark, path)
    return nav.groupBy("account", F.trunc("dt", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("days"),
        r(F.max_by("positions", "dt"), 2).alias("positions"),
        r(F.max_by("nav", "dt"), 2).alias("nav"),
        r(F.avg("nav"), 2).alias("mean_nav"),
        digits(F.min("ratio")).alias("least"),
        digits(F.max("ratio")).alias("most"),
    )


@query(
    "L11_turnover",
    with_views(
        f"select account, dt, {digits_sql('t * 100 / nullif(nav, 0)')} as turnover from (select account, dt, sum(buy_value + sell_value) as t from dl group by 1, 2) join nv using (account, dt)",
        "fills",
        "bars_d",
        extra=_nav_cte,
    ),
)
def l11(spark, path):
    return L.turnover(*day_nav(spark, path)).select("account", "dt", digits("turnover").alias("turnover"))


_trades = {
    "tr": """select account, (sell_value - sell_cost) / sold / basis - 1 as ret, (sell_value - sell_cost - 0.005 * sell_value) / sold > basis as win from
        (select *, lag(cost_basis) over (partition by account, code order by dt) as basis from lg) where sold > 0 and basis > 0""",
}


@query(
    "L12_trade_stats",
    with_views(
        """select account, count(*) as trades, count(*) filter (win) as wins, round(count(*) filter (win) / count(*), 6) as win_ratio,
        round(case when stddev_pop(ret) > 1e-12 then sqrt(count(*)) * avg(ret) / stddev_pop(ret) else 0 end, 6) as sqn from tr group by 1""",
        "fills",
        extra=_ledger_cte | _trades,
    ),
)
def l12(spark, path):
    out = L.trade_stats(L.closed_trades(L.position_ledger(portfolios(spark, path))))
    return out.select("account", "trades", "wins", r("win_ratio").alias("win_ratio"), r("sqn").alias("sqn"))


@query(
    "L13_rebalance_targets",
    with_views(
        f""", due as (select dt from (select dt, row_number() over (order by dt) - 1 as day from (select distinct dt from bars_m)) where day % 3 = 0),
        pk as (select * from pr join bars_m using (code, dt) join due using (dt) qualify row_number() over (partition by dt order by pred desc, code) <= 10)
        select code, dt, round(1.0 / count(*) over (partition by dt), 6) as weight, coalesce(close / lag(close) {P} < 0.9, false) as stopped from pk""".lstrip(", "),
        "bars_m",
        extra=_pred_cte,
    ).replace(" due as (", ", due as (", 1),
)
def l13(spark, path):
    bars = bars_m(spark, path)
    pred = predictions(spark, path).join(bars, ["code", "dt"])
    out = L.rebalance_targets(pred, bars.select("dt").distinct(), every=3, n=10, stop_loss=0.9)
    return out.select("code", "dt", r("weight").alias("weight"), "stopped")


# -- performance -----------------------------------------------------------------------------------------
_rs_cte = {
    "rt": f"select code, dt, close / lag(close) {P} - 1 as g from bars_m",
    "rs": "select market as strategy, dt, 0.002 * avg(g) as r, any_value(0.002 * ret) as b from rt join dim using (code) join bench using (dt) where g is not null group by 1, 2",
    "cv": """select *, exp(sum(ln(1 + r)) over w) as value, exp(sum(ln(1 + b)) over w) as bm, row_number() over (partition by strategy order by dt) as row from rs
        window w as (partition by strategy order by dt rows between unbounded preceding and current row)""",
    "cd": """select *, value / greatest(max(value) over w, 1) - 1 as drawdown, value - bm + 1 as excess from cv
        window w as (partition by strategy order by dt rows between unbounded preceding and current row)""",
}


def strategy_returns(spark, path):
    """Damped equal-weighted monthly return of each market against that of all codes."""
    bars = bars_m(spark, path)
    moves = bars.select("code", "dt", (F.try_divide(c("close"), W.delay(c("close"))) - 1).alias("g")).where("g is not null")
    by_market = moves.join(src.listing(spark, path), "code").groupBy(c("market").alias("strategy"), "dt").agg((0.002 * F.avg("g")).alias("r"))
    return by_market.join(src.benchmark_returns(bars).select("dt", (0.002 * c("ret")).alias("b")), "dt")


def _metric(name, columns, sql):
    body = ", ".join(f"round(coalesce({v}, 0), 6) as {k}" for k, v in sql.items())
    source = with_views(f"select strategy, {body} from cd group by strategy", "bench", "dim", extra=_rs_cte)

    @query(name, source)
    def run(spark, path):
        return R.ratios(strategy_returns(spark, path)).select("strategy", *[r(k).alias(k) for k in columns])


_beta = "covar_samp(r, b) / nullif(var_samp(b), 0)"
_annual = "pow(product(1 + r), 252.0 / count(r)) - 1"
_down = "sqrt(avg(pow(least(r, 0), 2))) * sqrt(252)"
_metric("R01_alpha_beta", ["alpha", "beta"], {"alpha": f"pow(1 + avg(r) - {_beta} * avg(b), 252) - 1", "beta": _beta})
_metric("R03_volatility", ["annual_volatility", "downside_risk"], {"annual_volatility": "stddev_samp(r) * sqrt(252)", "downside_risk": _down})
_metric("R04_info_ratio", ["info_ratio"], {"info_ratio": "avg(r - b) / nullif(stddev_samp(r - b), 0)"})
_metric("R05_stability", ["r2"], {"r2": "regr_r2(ln(value), row)"})
_metric(
    "R06_risk_ratios",
    ["sharpe", "sortino", "calmar", "omega"],
    {
        "sharpe": "avg(r) / stddev_samp(r) * sqrt(252)",
        "sortino": f"avg(r) * 252 / nullif({_down}, 0)",
        "calmar": f"({_annual}) / nullif(abs(least(min(drawdown), 0)), 0)",
        "omega": "sum(greatest(r, 0)) / nullif(sum(greatest(-r, 0)), 0)",
    },
)
_metric("R07_max_drawdown", ["max_down"], {"max_down": "least(min(drawdown), 0)"})
_metric("R02_annual_return", ["annual_return", "cagr", "rnorm"], {k: _annual for k in ("annual_return", "cagr", "rnorm")})


@query(
    "R02_yearly_returns",
    with_views("select strategy, year(dt)::integer as year, round(product(1 + r) - 1, 6) as ret from rs group by 1, 2", "bench", "dim", extra=_rs_cte),
)
def r02(spark, path):
    return R.yearly(strategy_returns(spark, path)).select("strategy", "year", r("ret").alias("ret"))


@query(
    "R08_trade_summary",
    with_views(
        """select trades, win_ratio, sqn, roto from (select 1 as j, count(*) as trades, round(count(*) filter (win) / count(*), 6) as win_ratio,
        round(sqrt(count(*)) * avg(ret) / stddev_pop(ret), 6) as sqn from tr) join (select 1 as j, round(sum(nav) / (1000000.0 * count(*)) - 1, 6) as roto from nv
        where dt = (select max(dt) from nv)) using (j)""",
        "fills",
        "bars_d",
        extra=_nav_cte | _trades,
    ),
)
def r08(spark, path):
    daily, nav = day_nav(spark, path)
    trades = L.trade_stats(L.closed_trades(L.position_ledger(daily)), keys=())
    by_day = nav.groupBy("dt").agg((F.sum("nav") / (L.START_CASH * F.count(F.lit(1))) - 1).alias("roto"))
    total = by_day.orderBy(F.desc("dt")).limit(1).select("roto")
    return trades.select("trades", r("win_ratio").alias("win_ratio"), r("sqn").alias("sqn"), r(total.scalar()).alias("roto"))


@query(
    "R09_value_curves",
    with_views("select strategy, dt, round(value - 1, 6) as total, round(bm - 1, 6) as bench, round(excess, 6) as excess from cd", "bench", "dim", extra=_rs_cte),
)
def r09(spark, path):
    out = R.with_curves(strategy_returns(spark, path))
    return out.select("strategy", "dt", r(c("value") - 1).alias("total"), r(c("bench") - 1).alias("bench"), r("excess").alias("excess"))


_flat_cte = _rs_cte | {"rs": _rs_cte["rs"].replace("0.002 * avg(g) as r", "case when market = 'ASIA' then 0.0::double else 0.002 * avg(g) end as r")}


@query(
    "R10_clean_metrics",
    with_views(
        """select strategy, round(coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0), 6) as sharpe,
        round(coalesce(sum(greatest(r, 0)) / nullif(sum(greatest(-r, 0)), 0), 0), 6) as omega from cd group by 1""",
        "bench",
        "dim",
        extra=_flat_cte,
    ),
)
def r10(spark, path):
    flat = strategy_returns(spark, path).withColumn("r", F.when(c("strategy") == "ASIA", 0.0).otherwise(c("r")))
    return R.ratios(flat).select("strategy", r("sharpe").alias("sharpe"), r("omega").alias("omega"))


_ext_cte = _rs_cte | {
    "ce": """select *, excess / greatest(max(excess) over w, 1) - 1 as xd, row - coalesce(max(case when drawdown >= 0 then row end) over w, 0) as under from cd
        window w as (partition by strategy order by dt rows between unbounded preceding and current row)""",
}
_ext = {
    "tracking_error": "stddev_samp(r - b) * sqrt(252)", "excess_spread": "stddev_samp(excess)", "excess_max_down": "least(min(xd), 0)",
    "excess_win_rate": "avg(case when r - b > 0 then 1.0 else 0.0 end)", "var_5": "quantile_cont(r, 0.05)",
    "profit_loss_rate": "avg(case when r > 0 then r end) / avg(case when r < 0 then -r end)", "ulcer_index": "sqrt(avg(drawdown * drawdown))",
}


@query(
    "R11_extended_metrics",
    with_views(
        f"select strategy, {', '.join(f'round({v}, 6) as {k}' for k, v in _ext.items())}, cast(max(under) as bigint) as max_down_days from ce group by 1",
        "bench",
        "dim",
        extra=_ext_cte,
    ),
)
def r11(spark, path):
    out = R.extended(strategy_returns(spark, path))
    return out.select("strategy", *[r(k).alias(k) for k in _ext], c("max_down_days").cast("long").alias("max_down_days"))


@query(
    "R11_resampled",
    with_views(
        """select strategy, round(avg(r) / nullif(stddev_samp(r), 0), 6) as quarter_sharpe from (select strategy, date_trunc('quarter', dt) as q, product(1 + r) - 1 as r
        from rs group by 1, 2) group by 1""",
        "bench",
        "dim",
        extra=_rs_cte,
    ),
)
def r11b(spark, path):
    quarters = R.resample(strategy_returns(spark, path), "quarter")
    return quarters.groupBy("strategy").agg(r(R.safe(F.avg("r"), F.stddev_samp("r"))).alias("quarter_sharpe"))


# -- labels and models ------------------------------------------------------------------------------------
@query(
    "T01_label_abs",
    with_views(f"select code, dt, round(lead(close, 10) {P} / nullif(lead(open) {P}, 0), 6) as label from bars_d", "bars_d"),
)
def t01(spark, path):
    return bars_d(spark, path).select("code", "dt", r(M.label_abs(10)).alias("label"))


_next = "over (partition by code order by dt rows between 1 following and 5 following)"


@query(
    "T02_label_mv",
    with_views(f"select code, dt, round(case when count(close) {_next} = 5 then avg(close) {_next} end / nullif(lead(open) {P}, 0), 6) as label from bars_d", "bars_d"),
)
def t02(spark, path):
    return bars_d(spark, path).select("code", "dt", r(M.label_mean(5)).alias("label"))


@query(
    "T03_train_valid_split",
    with_views(
        """select code, dt, case when dt < date '1999-01-01' then 'train' when dt < date '2000-06-01' then 'valid' else 'pred' end as part, false as overlapping from bars_m
        union all select code, dt, 'train', true from bars_m where dt < date '1999-01-01' union all select code, dt, 'valid', true from bars_m where dt < date '2000-06-01'
        union all select code, dt, 'pred', true from bars_m where dt >= date '2000-06-01'""",
        "bars_m",
    ),
)
def t03(spark, path):
    bars = bars_m(spark, path).select("code", "dt")
    apart = M.split(bars, "1999-01-01", "2000-06-01").withColumn("overlapping", F.lit(False))
    shared = M.split(bars, "1999-01-01", "2000-06-01", overlapping=True).withColumn("overlapping", F.lit(True))
    return apart.unionByName(shared)


@query(
    "T04_normalise",
    with_views(
        "select code, dt, round((f - min(f) over w) / nullif(max(f) over w - min(f) over w, 0), 6) as f, round((g - min(g) over w) / nullif(max(g) over w - min(g) over w, 0), 6) as g "
        "from fr window w as (partition by dt)",
        "bars_m",
        "dim",
        extra=_fr_cte,
    ),
)
def t04(spark, path):
    out = X.add_minmax(factor_returns(spark, path), ["f", "g"])
    return out.select("code", "dt", r("f").alias("f"), r("g").alias("g"))


@query(
    "T05_feature_prune",
    with_views(
        f"""select unnest(['open'] || case when abs({corr_agg_sql('open', 'close')}) <= 0.3 then ['close'] else [] end
        || case when abs({corr_agg_sql('open', 'volume')}) <= 0.3 and not (abs({corr_agg_sql('open', 'close')}) <= 0.3 and abs({corr_agg_sql('close', 'volume')}) > 0.3)
           then ['volume'] else [] end) as factor from bars_m""",
        "bars_m",
    ),
)
def t05(spark, path):
    bars = bars_m(spark, path)
    kept = M.prune_features(bars, ["open", "close", "volume"], 0.3)
    # one row per kept factor, carried by the table the choice was computed from
    picked = F.explode(F.array(*[F.lit(k) for k in kept])).alias("factor")
    return bars.agg(F.count(F.lit(1)).alias("n")).select(picked)


def model_panel(spark, path):
    bars = bars_m(spark, path)
    rows = bars.select(
        "code", "dt", (c("close") / c("open")).alias("gain"), c("volume").alias("lots"), (c("close") / W.delay(c("close"))).alias("move"), M.label_abs(2).alias("label")
    )
    return M.split(rows.where("move is not null"), "1999-01-01", "2000-06-01")


@query(
    "T06_train_model",
    with_views(
        f"""select code, dt, true as scored from (select code, dt, close / lag(close) {P} as move from bars_m)
        where move is not null and dt >= date '2000-06-01'""",
        "bars_m",
    ),
)
def t06(spark, path):
    panel = model_panel(spark, path)
    assembler, model = M.train(panel, ["gain", "lots", "move"], "label", depth=3, rounds=5)
    out = M.predict(assembler, model, panel.where("part = 'pred'"))
    return out.select("code", "dt", c("pred").isNotNull().alias("scored"))  # the trees' values have no SQL form


@query(
    "T07_linex_loss",
    with_views(
        "select round(avg(100 * exp(-(ret - f) / 100) + 100 * (ret - f) / 100 - 100), 6) as loss from fr", "bars_m", "dim", extra=_fr_cte
    ),
)
def t07(spark, path):
    return factor_returns(spark, path).agg(r(M.linex_loss(c("ret") / 100, c("f") / 100)).alias("loss"))


@query(
    "T08_predict_next_day",
    with_views(
        f"""select code, dt, round(pred, 6) as pred from (select code, dt, lag(pred) {P} as pred from (select code, dt, pred from pr union all
        select code, cast(dt + 1 as date), pred from pr where dt = (select max(dt) from pr))) where pred is not null""",
        "bars_m",
        extra=_pred_cte,
    ),
)
def t08(spark, path):
    return M.predict_next_day(predictions(spark, path)).select("code", "dt", r("pred").alias("pred"))


@query(
    "T09_model_score",
    with_views(
        f"""select round(avg(label - pred) / stddev_samp(label - pred), 6) as score, count(*) filter (pred > label) as over, count(*) as n from pr
        join (select code, dt, lead(close, 3) {P} / nullif(lead(open) {P}, 0) as label from bars_m) using (code, dt) where label is not null""",
        "bars_m",
        extra=_pred_cte,
    ),
)
def t09(spark, path):
    out = M.model_score(predictions(spark, path), bars_m(spark, path), 3)
    return out.select(r("score").alias("score"), "over", "n")


@query(
    "T10_param_grid",
    with_views(
        """select market, n, side, round(avg(ret), 6) as ret from (select market, dt, ret, n, side, row_number() over (partition by market, dt, n, side
        order by f * side desc, code) as place from fr, (values (3), (8)) a(n), (values (1), (-1)) b(side)) where place <= n group by 1, 2, 3""",
        "bars_m",
        "dim",
        extra=_fr_cte,
    ),
)
def t10(spark, path):
    grid = M.param_grid(factor_returns(spark, path), n=[3, 8], side=[1, -1])
    top = X.top_n(grid, 8, [(c("f") * c("side")).desc(), c("code")], ["market", "dt", "n", "side"]).where("place <= n")
    return top.groupBy("market", "n", "side").agg(r(F.avg("ret")).alias("ret"))
