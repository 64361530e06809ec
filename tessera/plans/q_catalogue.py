"""Queries for the formula catalogues, in batches, and for the user-function surface."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import windows as W
from tessera.functions.folds import scan_by_code, smooth
from tessera.operators import evaluate as V
from tessera.operators.registry import factor
from tessera.plans.catalogue import recipes
from tessera.plans.formula_sql import formulas_sql
from tessera.plans.q_factors import _edges, corr_agg_sql
from tessera.plans.q_indicators import ema, series
from tessera.plans.registry import P, digits, over, query, r, register, with_views
from tessera.plans.staging import evaluate, formula_panel
from tessera.session import materialise
from tessera.sources import panel as src
from tessera.sources import storage as st

c = F.col
BATCH = 20  # formulas per job: wide enough to share levels, small enough for code generation


def _catalogue_queries(catalogue):
    named = list(recipes(catalogue).items())
    for start in range(0, len(named), BATCH):
        batch = dict(named[start : start + BATCH])
        ctes, body = formulas_sql(batch)
        first, last = next(iter(batch))[-3:], list(batch)[-1][-3:]

        def run(spark, path, batch=batch):
            out = evaluate(formula_panel(src.bars_daily(spark, path)), batch)
            return out.select("code", "dt", *[digits(k).alias(k) for k in batch])

        register(f"O04_{catalogue}_{first}_{last}", run, with_views(body, "bars_d", extra=ctes))


for _name in ("alpha101", "alpha191"):
    _catalogue_queries(_name)


@query(
    "O01_incremental_factor",
    with_views(
        f"""select code, dt, round(m, 6) as m from (select code, dt, case when count(close) {over(5)} = 5 then avg(close) {over(5)} end as m from bars_m
        where dt >= (select max(dt) from bars_m) - 700) where dt > (select max(dt) from bars_m where dt < (select max(dt) from bars_m) - 60)""",
        "bars_m",
    ),
)
def o01(spark, path):
    newest = src.table(spark, path, "lineitem").agg(F.trunc(F.max("l_shipdate"), "month")).first()[0]
    stored = src.bars_monthly(spark, path).where(c("dt") < F.date_sub(F.lit(newest), 60))
    build = lambda b: b.select("code", "dt", W.mean(c("close"), 5).alias("m"))
    out = st.incremental_factor(lambda day: src.bars_monthly(spark, path, day), stored, build, newest)
    return out.select("code", "dt", r("m").alias("m"))


@query(
    "O02_fold_by_code",
    with_views(
        "select b.code, b.dt, round(e.v, 4) as smoothed from bars_m b left join e on e.code = b.code and e.dt = b.dt",
        "bars_m",
        extra={"x": series("close", "bars_m"), "e": ema("x", 10)},
    ),
)
def o02(spark, path):
    bars = src.bars_monthly(spark, path).select("code", "dt", "close")
    out = scan_by_code(bars, lambda h, x: [smooth(x, 10)], ["close"], ["smoothed"])
    return out.select("code", "dt", r("smoothed", 4).alias("smoothed"))


@query("W26_ema", with_views("select b.code, b.dt, round(e.v, 4) as ema from bars_m b left join e on e.code = b.code and e.dt = b.dt", "bars_m", extra={"x": series("close", "bars_m"), "e": ema("x", 1, 0.3)}))
def w26(spark, path):
    bars = src.bars_monthly(spark, path).select("code", "dt", "close")
    out = scan_by_code(bars, lambda h, x: [smooth(x, 1, 0.3)], ["close"], ["ema"])
    return out.select("code", "dt", r("ema", 4).alias("ema"))


@query(
    "O03_register_indicator",
    with_views(
        f'select code, dt, round(lag(m, 1) {P}, 6) as "MA_10_1", round(close - lag(close, 5) {P}, 6) as "MOM_5_0" from mm',
        "bars_m",
        extra={"mm": f"select *, case when count(close) {over(10)} = 10 then avg(close) {over(10)} end as m from bars_m"},
    ),
)
def o03(spark, path):
    out = src.bars_monthly(spark, path)
    for name in ("MA_10_1", "MOM_5_0"):
        out = factor(out, name)
    return out.select("code", "dt", r("MA_10_1").alias("MA_10_1"), r("MOM_5_0").alias("MOM_5_0"))


def _score_catalogue_sql(batch):
    ctes, body = formulas_sql(batch)
    returns = ", ".join(f"lead(close, {d}) {P} / nullif(lead(open) {P}, 0) as r{d}" for d in V.HORIZONS)
    ctes = ctes | {
        "fv": body,
        "rt": f"select code, dt, {returns} from bars_d",
        "fl": "unpivot fv on columns(* exclude (code, dt)) into name factor value value",  # leaves nulls out
        "fr": "select factor, code, dt, value, rt.* exclude (code, dt) from fl join rt using (code, dt)",
        "bins": "select *, cast(floor((dt - (select min(dt) from fr)) / 120) as integer) as bin from fr",
        **{f"ic{d}": f"select factor, coalesce(avg(c), 0) as ic, case when coalesce(stddev_samp(c), 0) > 1e-12 then avg(c) / stddev_samp(c) else 0 end as ir from (select factor, bin, {corr_agg_sql(f'(case when r{d} is not null then value end)', f'r{d}')} as c from bins group by 1, 2) group by 1" for d in V.HORIZONS},
        "cut": f"select factor, dt, list_distinct(quantile_cont(value, {_edges(10)})) as edges from fr group by 1, 2",
        "fq": "select fr.*, greatest(len(list_filter(edges, lambda e: e < value)), 1) as q from fr join cut using (factor, dt) where len(edges) > 1",
        "qm": "select factor, dt, q, " + ", ".join(f"avg(r{d}) as m{d}" for d in V.HORIZONS) + " from fq group by 1, 2, 3",
        "qs": "select factor, q, " + ", ".join(f"product(m{d}) as net{d}, case when coalesce(stddev_pop(m{d} - 1), 0) > 1e-12 then avg(m{d} - 1) / stddev_pop(m{d} - 1) else 0 end as s{d}" for d in V.HORIZONS) + " from qm group by 1, 2",
        "sh": "select factor, " + ", ".join(f"coalesce(sum(net{d} * s{d}) / nullif(sum(net{d}), 0), 0) as sharpe{d}" for d in V.HORIZONS) + " from qs group by 1",
    }
    ic, ir = ("(" + " + ".join(f"ic{d}.{k}" for d in V.HORIZONS) + f") / {len(V.HORIZONS)}" for k in ("ic", "ir"))
    best = "greatest(" + ", ".join(f"sharpe{d}" for d in V.HORIZONS) + ")"
    joined = " ".join(f"join ic{d} using (factor)" for d in V.HORIZONS)
    return with_views(
        f"select factor, round({ic}, 6) as ic, round({ir}, 6) as ir, round({best}, 6) as sharpe, round(10 * abs({ic}) + abs({ir}) + abs({best}), 4) as score from sh {joined}",
        "bars_d",
        extra=ctes,
    )


def _score_catalogue(spark, path, formulas):
    """Scores of all formulas, a batch at a time: a batch's values are dropped once its scores are written."""
    bars = materialise(src.bars_daily(spark, path), "bars")
    # Some formulas have a value on every bar, so the bins of all factors count from the first one.
    first = F.lit(bars.where("code is not null").agg(F.min("dt")).first()[0]).cast("date")
    scores, named = [], list(formulas.items())
    for start in range(0, len(named), BATCH):
        batch, written = dict(named[start : start + BATCH]), []
        values = evaluate(formula_panel(bars), batch, written)
        values = values.select("code", "dt", *[digits(k).alias(k) for k in batch])
        scores.append(materialise(V.factor_score(values.join(bars, ["code", "dt"]), list(batch), first=first), "scores"))
        for stages in written:
            stages.drop()
    out = reduce(DataFrame.unionByName, scores)
    return out.select("factor", r("ic").alias("ic"), r("ir").alias("ir"), r("sharpe").alias("sharpe"), r("score", 4).alias("score"))


def _register_scores():
    formulas = recipes("alpha101") | recipes("alpha191")
    register("O05_score_catalogue", lambda spark, path: _score_catalogue(spark, path, formulas), _score_catalogue_sql(formulas))


_register_scores()
