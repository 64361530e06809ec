"""Queries for the technical indicators."""

from __future__ import annotations

from tessera.operators.indicators import candles as K
from tessera.operators.registry import INDICATORS
from tessera.plans.q_windows import corr_sql
from tessera.plans.registry import UPTO, P, over, r, register, with_views
from tessera.sources import panel as src


def _run(name, args, digits=6):
    entry = INDICATORS[name]

    def run(spark, path):
        bars = src.bars_daily(spark, path)
        return entry.build(bars, *args).select("code", "dt", *[r(o, digits).alias(o) for o in entry.outputs])

    return run


def _ta(name, args, outputs, *stages, query=None, digits=6):
    """``outputs``: SQL per output column; ``stages``: extra columns added one after another."""
    source = "bars_d"
    for stage in stages:
        source = f"(select *, {stage} from {source})"
    body = ", ".join(f'round({sql}, {digits}) as "{k}"' for k, sql in outputs.items())
    register(query or f"ta_{name.lower()}", _run(name, args, digits), with_views(f"select code, dt, {body} from {source}", "bars_d"))


def full(agg, n, v="close"):
    return f"case when count({v}) {over(n)} = {n} then {agg} {over(n)} end"


def avg(n, v="close"):
    return full(f"avg({v})", n, v)


def div(a, b):
    return f"case when ({b}) = 0 then 0 else ({a}) / nullif({b}, 0) end"


TP = "(high + low + close) / 3"
PC = f"lag(close) {P}"
TR = f"case when {PC} is not null then greatest(high - low, abs(high - {PC}), abs(low - {PC})) end"
n = 20
_mid, _sd = avg(n), full("stddev_pop(close)", n)
_ta("BBANDS", [n], {"UPPER": f"{_mid} + 2 * {_sd}", "MIDDLE": _mid, "LOWER": f"{_mid} - 2 * {_sd}"})
_ta("MA", [90], {"MA": avg(90)})
_ta("SMA", [30], {"SMA": avg(30)})
_ta("MIDPOINT", [n], {"MIDPOINT": f"({full('max(close)', n)} + {full('min(close)', n)}) / 2"})
_ta("MIDPRICE", [n], {"MIDPRICE": f"({full('max(high)', n, 'high')} + {full('min(low)', n, 'low')}) / 2"})
_ta("TRIMA", [21], {"TRIMA": avg(11, "a")}, f"{avg(11)} as a")
_wma = " + ".join(f"lag(close, {k}) {P} * {30 - k}" for k in range(30))
_ta("WMA", [30], {"WMA": f"({_wma}) / {30 * 31 / 2}"})
_ta("APO", [10, 30], {"APO": f"{avg(10)} - {avg(30)}"})
_ta("PPO", [10, 30], {"PPO": f"100 * ({avg(10)} - {avg(30)}) / {avg(30)}"})


def since(v, n, best):
    return (
        f"case when count({v}) {over(n)} = {n} then list_position(list_reverse(list({v}) {over(n)}), {best}({v}) {over(n)}) - 1 end"
    )


_down, _up = f"100 * ({n} - {since('low', n + 1, 'min')}) / {n}.0", f"100 * ({n} - {since('high', n + 1, 'max')}) / {n}.0"
_ta("AROON", [n], {"AROONDOWN": _down, "ARRONUP": _up})
_ta("AROONOSC", [n], {"AROONOSC": f"{_up} - {_down}"})
_ta("BOP", [], {"BOP": div("close - open", "high - low")})
_ta(
    "CCI",
    [n],
    {"CCI": f"case when m is not null then {div('tp - m', '0.015 * list_sum(list_transform(ls, lambda v: abs(v - m))) / 20')} end"},
    f"{TP} as tp",
    f"{avg(n, 'tp')} as m, list(tp) {over(n)} as ls",
)
_ta(
    "MACDEXT",
    [12, 26, 9],
    {"MACDX": "case when s is not null then m end", "MACDSIGNALX": "s", "MACDHISTX": "m - s"},
    f"{avg(12)} - {avg(26)} as m",
    f"{avg(9, 'm')} as s",
)
_ta(
    "MFI",
    [14],
    {"MFI": "case when u + d < 1 then 0 else 100 * u / nullif(u + d, 0) end"},
    f"{TP} as tp",
    f"tp - lag(tp) {P} as mv",
    "case when mv > 0 then tp * volume when mv is not null then 0 end as pu, case when mv < 0 then tp * volume when mv is not null then 0 end as pd",
    f"{full('sum(pu)', 14, 'pu')} as u, {full('sum(pd)', 14, 'pd')} as d",
)
_ta("MOM", [n], {"MOM": f"close - lag(close, {n}) {P}"})
_ta("ROC", [n], {"ROC": f"100 * (close / lag(close, {n}) {P} - 1)"})
_ta("ROCR", [n], {"ROCR": f"close / lag(close, {n}) {P}"})
_ta("ROCR100", [n], {"ROCR100": f"100 * close / lag(close, {n}) {P}"})


def fastk(n):
    lo, hi = full("min(low)", n, "low"), full("max(high)", n, "high")
    return f"100 * {div(f'close - {lo}', f'{hi} - {lo}')}"


_ta(
    "STOCH",
    [5, 3, 3],
    {"SLOWK": "case when d is not null then s end", "SLOWD": "d"},
    f"{fastk(5)} as k",
    f"{avg(3, 'k')} as s",
    f"{avg(3, 's')} as d",
)
_ta("STOCHF", [5, 3], {"FASTK": "case when d is not null then k end", "FASTD": "d"}, f"{fastk(5)} as k", f"{avg(3, 'k')} as d")
_part = [div(full("sum(bp)", k, "bp"), full("sum(tr)", k, "tr")) for k in (7, 14, 28)]
_ta(
    "ULTOSC",
    [7, 14, 28],
    {"ULTOSC": f"100 * (4 * {_part[0]} + 2 * {_part[1]} + {_part[2]}) / 7"},
    f"case when {PC} is not null then close - least(low, {PC}) end as bp, {TR} as tr",
)
_hi, _lo = full("max(high)", 14, "high"), full("min(low)", 14, "low")
_ta("WILLR", [14], {"WILLR": f"-100 * {div(f'{_hi} - close', f'{_hi} - {_lo}')}"})
CLV = f"{div('(close - low) - (high - close)', 'high - low')}"
_ta("AD", [], {"AD": f"sum(f) {UPTO}"}, f"({CLV}) * volume as f")
_ta("OBV", [], {"OBV": f"sum(s) {UPTO}"}, f"case when {PC} is null then volume else sign(close - {PC}) * volume end as s")
_ta("TRANGE", [], {"TRANGE": TR})
_ta("AVGPRICE", [], {"AVGPRICE": "(open + high + low + close) / 4"})
_ta("MEDPRICE", [], {"MEDPRICE": "(high + low) / 2"})
_ta("TYPPRICE", [], {"TYPPRICE": TP})
_ta("WCLPRICE", [], {"WCLPRICE": "(high + low + 2 * close) / 4"})
_ta(
    "BETA",
    [n],
    {"BETA": f"case when count(rh) {over(n)} = {n} then case when var_pop(rh) {over(n)} > 1e-18 then covar_pop(rh, rl) {over(n)} / var_pop(rh) {over(n)} else 0 end end"},
    f"high / lag(high) {P} - 1 as rh, low / lag(low) {P} - 1 as rl",
)
_ta("CORREL", [n], {"CORREL": f"case when count(close) {over(n)} = {n} then coalesce({corr_sql('high', 'low', n)}, 0) end"})
_slope, _mean = f"case when count(close) {over(n)} = {n} then regr_slope(close, i) {over(n)} end", f"avg(close) {over(n)}"
_base = f"(({_mean}) - ({_slope}) * {(n - 1) / 2})"
_i = f"row_number() {P} as i"
_ta("LINEARREG", [n], {"LINEARREG": f"{_base} + ({_slope}) * {n - 1}"}, _i)
_ta("LINEARREG_ANGLE", [n], {"LINEARREGANGLE": f"degrees(atan({_slope}))"}, _i)
_ta("LINEARREG_INTERCEPT", [n], {"LINEARREGINTERCEPT": _base}, _i)
_ta("LINEARREG_SLOPE", [n], {"LINEARREGSLOPE": _slope}, _i)
_ta("TSF", [n], {"TSF": f"{_base} + ({_slope}) * {n}"}, _i)
_ta("STDDEV", [n, 1], {"STDDEV": _sd})
_ta("VAR", [n, 1], {"VAR": f"{full('var_pop(close)', n)}"}, digits=0)
_ta("MAX", [n], {"MAX": full("max(close)", n)})
_ta("MIN", [n], {"MIN": full("min(close)", n)})
_maxi, _mini = (f"cast(row_number() {P} - 1 - ({since('close', n, b)}) as double)" for b in ("max", "min"))
_ta("MAXINDEX", [n], {"MAXINDEX": _maxi})
_ta("MININDEX", [n], {"MININDEX": _mini})
_ta("MINMAXINDEX", [n], {"MINIDX": _mini, "MAXIDX": _maxi})
_ta("SUM", [n], {"SUM": full("sum(close)", n)})

# -- extended ------------------------------------------------------------------------------
_ta("STOK", [], {"STOK": "(close - low) / nullif(high - low, 0)"}, query="E02_STOK")
_lo14, _hi14 = full("min(low)", 14, "low"), full("max(high)", 14, "high")
_ta(
    "STO",
    [14, 3, 2],
    {"STOSK": avg(2, "k"), "STOSD": avg(2, "d")},
    f"(close - {_lo14}) / nullif({_hi14} - {_lo14}, 0) as k",
    f"{avg(3, 'k')} as d",
    query="E03_STO",
)
_h1, _l1 = f"lag(high) {P}", f"lag(low) {P}"
_ta(
    "VORTEX",
    [14],
    {"VORTEX": f"{full('sum(vm)', 14, 'vm')} / nullif({full('sum(tr)', 14, 'tr')}, 0)"},
    f"case when {PC} is null then 0 else greatest(high, {PC}) - least(low, {PC}) end as tr, coalesce(abs(high - {_l1}) - abs(low - {_h1}), 0) as vm",
    query="E05_Vortex",
)


def rate(v, n):
    return f"({v} - lag({v}, {n - 1}) {P}) / nullif(lag({v}, {n - 1}) {P}, 0)"


_rs, _ns = (10, 15, 20, 30), (10, 10, 10, 15)
_ta(
    "KST",
    [*_rs, *_ns],
    {"KST": " + ".join(f"{full(f'sum(r{k})', m, f'r{k}')} * {k + 1}" for k, m in enumerate(_ns))},
    ", ".join(f"{rate('close', m)} as r{k}" for k, m in enumerate(_rs)),
    query="E06_KST",
)
_ta(
    "ACCDIST",
    [14],
    {"ACCDIST": rate("ad", 14)},
    "(2 * close - high - low) / nullif(high - low, 0) * volume as ad",
    query="E08_ACCDIST",
)
_ta("FORCE", [3], {"FORCE": f"(close - lag(close, 3) {P}) * (volume - lag(volume, 3) {P})"}, query="E09_FORCE")
_ta(
    "EOM",
    [10],
    {"EMO": avg(10, "e")},
    f"((high - {_h1}) + (low - {_l1})) * (high - low) / nullif(2 * volume, 0) as e",
    query="E10_EOM",
)
_ta(
    "KELCH",
    [n],
    {"KELCHM": avg(n, "a"), "KELCHU": avg(n, "b"), "KELCHD": avg(n, "d")},
    f"{TP} as a, (4 * high - 2 * low + close) / 3 as b, (-2 * high + 4 * low + close) / 3 as d",
    query="E12_KELCH",
)
_ta("DONCH", [n], {"DONCHLOW": full("min(low)", n, "low"), "DONCHHIGH": full("max(high)", n, "high")}, query="E13_DONCH")


# -- recursions: the closed form y(t) = d^(t-m) seed + g sum d^(t-j) x(j), as a self-join ---------
def rec(source, m, seed, d, g):
    return f"""select a.code, a.dt, a.i - {m} + 1 as i, pow({d}, a.i - {m}) * s.seed
        + {g} * coalesce(sum(pow({d}, a.i - b.i) * b.v), 0) as v
        from {source} a join (select code, {seed}(v) as seed from {source} where i <= {m} group by code having count(*) = {m}) s
        on s.code = a.code left join {source} b on b.code = a.code and b.i > {m} and b.i <= a.i
        where a.i >= {m} group by a.code, a.dt, a.i, s.seed"""


def ema(source, n, alpha=None):
    alpha = alpha or 2 / (n + 1)
    return rec(source, n, "avg", 1 - alpha, alpha)


def wilder(source, n):
    return rec(source, n, "avg", 1 - 1 / n, 1 / n)


def wsum(source, n):
    return rec(source, n - 1, "sum", 1 - 1 / n, 1)


def series(value, source="bars_d"):
    """Non-null values of one expression, numbered from the first one."""
    return f"select code, dt, row_number() {P} as i, v from (select code, dt, {value} as v from {source}) where v is not null"


def _tr(name, args, ctes, outputs, joins, query=None, digits=4):
    """``joins``: names of (code, dt, v) CTEs whose values the outputs use as <name>.v."""
    body = ", ".join(f'round({sql}, {digits}) as "{k}"' for k, sql in outputs.items())
    join = " ".join(f"left join {j} on {j}.code = b.code and {j}.dt = b.dt" for j in joins)
    sql = with_views(f"select b.code, b.dt, {body} from bars_d b {join}", "bars_d", extra=ctes)
    register(query or f"ta_{name.lower()}", _run(name, args, digits), sql)


_close = series("close")
m = 14
_tr("EMA", [m], {"x": _close, "e1": ema("x", m)}, {"EMA": "e1.v"}, ["e1"])
_three = {"x": _close, "e1": ema("x", m), "e2": ema("e1", m), "e3": ema("e2", m)}
_tr("DEMA", [m], {k: _three[k] for k in ("x", "e1", "e2")}, {"DEMA": "2 * e1.v - e2.v"}, ["e1", "e2"])
_tr("TEMA", [m], _three, {"TEMA": "3 * e1.v - 3 * e2.v + e3.v"}, ["e1", "e2", "e3"])
_six = {"x": _close} | {f"e{k}": ema("x" if k == 1 else f"e{k - 1}", 8) for k in range(1, 7)}
_c1, _c2, _c3, _c4 = -(0.7**3), 3 * 0.49 + 3 * 0.7**3, -6 * 0.49 - 3 * 0.7 - 3 * 0.7**3, 1 + 3 * 0.7 + 0.7**3 + 3 * 0.49
_tr("T3", [8, 0.7], _six, {"T3": f"{_c1} * e6.v + {_c2} * e5.v + {_c3} * e4.v + {_c4} * e3.v"}, ["e3", "e4", "e5", "e6"])
_tr(
    "TRIX",
    [m],
    _three | {"t": f"select code, dt, v / lag(v) {P} as v from e3"},
    {"TRIX": "100 * (t.v - 1)"},
    ["t"],
)
_late = "select code, dt, i - 14 as i, v from x where i > 14"


def _macd(fast, slow, signal, fa=None, sa=None):
    return {
        "x": _close,
        "late": _late,
        "f": ema("late", fast, fa),
        "s": ema("x", slow, sa),
        "line": series("f.v - s.v", "f join s using (code, dt)"),
        "sig": ema("line", signal),
    }


for _name, _args, _cte, _suffix in (
    ("MACD", [12, 26, 9], _macd(12, 26, 9), ""),
    ("MACDFIX", [20], _macd(12, 26, 20, 0.15, 0.075), "FIX"),
):
    _tr(
        _name,
        _args,
        _cte,
        {
            f"MACD{_suffix}": "case when sig.v is not null then line.v end",
            f"MACDSIGNAL{_suffix}": "sig.v",
            f"MACDHIST{_suffix}": "line.v - sig.v",
        },
        ["line", "sig"],
    )

_gain = {
    "up0": series(f"greatest(close - {PC}, 0) + 0 * {PC}"),
    "dn0": series(f"greatest({PC} - close, 0) + 0 * {PC}"),
    "up": wilder("up0", m),
    "dn": wilder("dn0", m),
}
_rsi = div("100 * up.v", "up.v + dn.v")
_tr("RSI", [m], _gain, {"RSI": f"case when up.v is not null then {_rsi} end"}, ["up", "dn"])
_tr("CMO", [m], _gain, {"CMO": f"case when up.v is not null then {div('100 * (up.v - dn.v)', 'up.v + dn.v')} end"}, ["up", "dn"])
_rlo, _rhi = full("min(v)", 5, "v"), full("max(v)", 5, "v")
_tr(
    "STOCHRSI",
    [m, 5, 3],
    _gain
    | {
        "rs": f"select code, dt, {_rsi} as v from up join dn using (code, dt)",
        "ks": f"select code, dt, 100 * {div(f'v - {_rlo}', f'{_rhi} - {_rlo}')} as v from rs",
        "ds": f"select code, dt, {avg(3, 'v')} as v from ks",
    },
    {"FASTKRSI": "case when ds.v is not null then ks.v end", "FASTDRSI": "ds.v"},
    ["ks", "ds"],
)
_um, _dm = f"(high - {_h1})", f"({_l1} - low)"
_move = {
    "p0": series(f"case when {_um} is null then null when {_um} > 0 and {_um} > {_dm} then {_um} else 0 end"),
    "m0": series(f"case when {_um} is null then null when {_dm} > 0 and {_dm} > {_um} then {_dm} else 0 end"),
    "t0": series(TR),
    "p": wsum("p0", m),
    "mn": wsum("m0", m),
    "t": wsum("t0", m),
}
_tr("PLUS_DM", [m], {k: _move[k] for k in ("p0", "p")}, {"PLUSDM": "p.v"}, ["p"])
_tr("MINUS_DM", [m], {k: _move[k] for k in ("m0", "mn")}, {"MINUSDM": "mn.v"}, ["mn"])
_pdi, _mdi = (f"case when t.i > 1 then {div(f'100 * {k}.v', 't.v')} end" for k in ("p", "mn"))
_tr("PLUS_DI", [m], _move, {"PLUSDI": _pdi}, ["p", "mn", "t"])
_tr("MINUS_DI", [m], _move, {"MINUSDI": _mdi}, ["p", "mn", "t"])
_dx = f"case when t.i > 1 then {div('100 * abs(p.v - mn.v)', 'p.v + mn.v')} end"
_tr("DX", [m], _move, {"DX": _dx}, ["p", "mn", "t"])
_adx = _move | {
    "d0": series(_dx, "p join mn using (code, dt) join t using (code, dt)"),
    "ad": wilder("d0", m),
    "al": f"select code, dt, lag(v, {m - 1}) {P} as v from ad",
}
_tr("ADX", [m], {k: v for k, v in _adx.items() if k != "al"}, {"ADX": "ad.v"}, ["ad"])
_tr("ADXR", [m], _adx, {"ADXR": "(ad.v + al.v) / 2"}, ["ad", "al"])
_atr = {"t0": series(TR), "t": wilder("t0", m)}
_tr("ATR", [m], _atr, {"ATR": "t.v"}, ["t"])
_tr("NATR", [m], _atr, {"NATR": "100 * t.v / nullif(b.close, 0)"}, ["t"])
_flow = f"sum(f) {UPTO}"
_tr(
    "ADOSC",
    [3, 10],
    {
        "x": series(_flow, f"(select *, ({CLV}) * volume as f from bars_d)"),
        "a": rec("x", 1, "avg", 0.5, 0.5),
        "z": rec("x", 1, "avg", 1 - 2 / 11, 2 / 11),
    },
    {"ADOSC": "case when a.i >= 10 then a.v - z.v end"},
    ["a", "z"],
)


def adjusted(source, span, least):
    """Exponential mean with weights renormalised from the first value on."""
    d = 1 - 2 / (span + 1)
    return f"""select a.code, a.dt, row_number() over (partition by a.code order by a.dt) as i,
        sum(pow({d}, a.i - b.i) * b.v) / sum(pow({d}, a.i - b.i)) as v
        from {source} a join {source} b on b.code = a.code and b.i <= a.i where a.i >= {least} group by a.code, a.dt, a.i"""


_tr(
    "MASSI",
    [9, 25],
    {
        "x": series("high - low"),
        "e1": adjusted("x", 9, 8),
        "e2": adjusted("e1", 9, 8),
        "ms": "select e1.code, e1.dt, e1.v / nullif(e2.v, 0) as v from e1 join e2 using (code, dt)",
        "s": f"select code, dt, {full('sum(v)', 25, 'v')} as v from ms",
    },
    {"MASSI": "s.v"},
    ["s"],
    query="E04_MassI",
)
_step = f"close - {PC}"
_tr(
    "TSI",
    [25, 13],
    {
        "x": series(_step),
        "y": series(f"abs({_step})"),
        "e1": adjusted("x", 25, 24),
        "e2": adjusted("e1", 13, 12),
        "f1": adjusted("y", 25, 24),
        "f2": adjusted("f1", 13, 12),
    },
    {"TSI": "e2.v / nullif(f2.v, 0)"},
    ["e2", "f2"],
    query="E07_TSI",
)
_tr(
    "COPP",
    [10],
    {"x": series(f"{rate('close', 11)} + {rate('close', 14)}"), "e": adjusted("x", 10, 10)},
    {"COPP": "e.v"},
    ["e"],
    query="E11_COPP",
)

# Parabolic stop: one row per code and step of a recursive query.
_sar = f"""with recursive bars_d as ({{bars}}),
 b as (select *, row_number() {P} as t, lag(high) {P} as h1, lag(low) {P} as l1 from bars_d),
 s as (
  select code, t, dt, high, low, not (l1 - low > 0 and l1 - low > high - h1) as up,
    case when not (l1 - low > 0 and l1 - low > high - h1) then high else low end as ep,
    case when not (l1 - low > 0 and l1 - low > high - h1) then l1 else h1 end as sar,
    0.02::double as af, null::double as o, true as fresh, false as was_up from b where t = 2
  union all
  select n.code, n.t, n.dt, n.high, n.low,
    case when up then n.low > sar else n.high >= sar end,
    case when up and n.low <= sar then n.low when not up and n.high >= sar then n.high
         when up then greatest(ep, n.high) else least(ep, n.low) end,
    case when up and n.low <= sar then greatest(greatest(ep, n.h1, n.high) + 0.02 * (n.low - greatest(ep, n.h1, n.high)), n.h1, n.high)
         when not up and n.high >= sar then least(least(ep, n.l1, n.low) + 0.02 * (n.high - least(ep, n.l1, n.low)), n.l1, n.low)
         when up then least(sar + (case when n.high > ep then least(af + 0.02, 0.2) else af end) * (greatest(ep, n.high) - sar), n.l1, n.low)
         else greatest(sar + (case when n.low < ep then least(af + 0.02, 0.2) else af end) * (least(ep, n.low) - sar), n.h1, n.high) end,
    case when up and n.low <= sar then 0.02 when not up and n.high >= sar then 0.02
         when up and n.high > ep then least(af + 0.02, 0.2) when not up and n.low < ep then least(af + 0.02, 0.2) else af end,
    case when up and n.low <= sar then greatest(ep, n.h1, n.high) when not up and n.high >= sar then least(ep, n.l1, n.low) else sar end,
    false, case when up then n.low > sar else n.high >= sar end
  from s join (select code, t + case when t = 2 then 0 else 0 end as t, dt, high, low,
     case when t = 2 then high else h1 end as h1, case when t = 2 then low else l1 end as l1 from b) n
   on n.code = s.code and n.t = case when s.fresh then 2 else s.t + 1 end)
 select b.code, b.dt, round({{value}}, 6) as "{{name}}" from b left join s on s.code = b.code and s.t = b.t and not s.fresh"""


def _register_sar():
    from tessera.plans.registry import VIEWS

    for name, value in (("SAR", "s.o"), ("SAREXT", "case when s.was_up then s.o else -s.o end")):
        register(f"ta_{name.lower()}", _run(name, [0.02, 0.2]), _sar.format(bars=VIEWS["bars_d"], value=value, name=name))


_register_sar()
for _name in ("HT_TRENDLINE", "MAMA", "HT_DCPERIOD", "HT_DCPHASE", "HT_PHASOR", "HT_SINE", "HT_TRENDMODE"):
    # Adaptive cycle filters: no SQL form; tests compare them with a direct loop.
    register(f"ta_{_name.lower()}", _run(_name, list(INDICATORS[_name].defaults)))


# -- candles ---------------------------------------------------------------------------------
def _candle_views():
    now = {
        "o": "open", "h": "high", "l": "low", "c": "close", "top": "greatest(open, close)", "bot": "least(open, close)",
        "body": "greatest(open, close) - least(open, close)", "up": "high - greatest(open, close)",
        "dn": "least(open, close) - low", "g": "case when close >= open then 1 else -1 end",
    }
    measure = {"body": now["body"], "span": "high - low", "shadows": f"({now['up']}) + ({now['dn']})"}
    first = ", ".join(f"{v} as {k}0" for k, v in now.items())
    parts = []
    for k, (what, rows, factor) in K.THRESHOLDS.items():
        w = f"over (partition by code order by dt rows between {rows} preceding and 1 preceding)"
        parts.append(f"case when count(*) {w} = {rows} then avg({measure[what]}) {w} * {factor} end as {k}0")
    names = [*now, *K.THRESHOLDS]
    lags = ", ".join(f"lag({k}0, {i}) {P} as {k}{i}" for k in names for i in range(1, 5))
    raws = ", ".join(f"lag({k}0, {i}) {P} as {k}{i}" for k in ("rawh", "rawm") for i in (1, 2, 3))
    return {
        "k1": f"select code, dt, {first}, {', '.join(parts)} from bars_d",
        "k2": f"select *, {lags} from k1",
        "k3": f"select *, {K.RAW_HIKKAKE} as rawh0, {K.RAW_HIKKAKEMOD} as rawm0 from k2",
        "k4": f"select *, {raws} from k3",
        "k5": f"select *, {K.confirmed('rawh')} as hikkake0, {K.confirmed('rawm')} as hikkakemod0 from k4",
    }


def _candle_query(group):
    names = [k for k, v in K.PATTERNS.items() if v[0] == group]
    body = ", ".join(f'cast({K.pattern_sql(k)} as integer) as "CDL{k}"' for k in names)
    sql = with_views(f"select code, dt, {body} from k5", "bars_d", extra=_candle_views())
    register(
        f"ta_candles_{group}bar",
        lambda spark, path: K.candles(src.bars_daily(spark, path).drop("volume", "amount"), names).select(
            "code", "dt", *[f"CDL{k}" for k in names]
        ),
        sql,
    )


for _g in (1, 2, 3):
    _candle_query(_g)
