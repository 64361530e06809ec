"""Joins, ledgers, evaluation and storage on hand-made tables."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import windows as W
from tessera.operators import aggregates as A
from tessera.operators import align as G
from tessera.operators import bars as B
from tessera.operators import evaluate as V
from tessera.operators import labels as M
from tessera.operators import ledger as L
from tessera.operators import performance as R
from tessera.plans.catalogue import recipes
from tessera.plans.staging import evaluate, formula_panel
from tessera.session import materialise
from tessera.sources import panel as src
from tessera.sources import storage as st
from tests.conftest import day


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_announcement_counts_from_the_next_open_day(spark):
    keys = spark.createDataFrame([(1, day(i)) for i in (0, 1, 4, 5)], "code long, dt date")  # days 2 and 3 closed
    events = spark.createDataFrame([(1, day(1), 7.0), (1, day(3), 9.0)], "code long, ann date, eps double")
    got = rows(G.align_events(keys, events, "ann", ["eps"], 3), "dt")
    assert [r[2] for r in got] == [None, None, 9.0, 9.0]


def test_strictly_before(spark):
    dates = spark.createDataFrame([("a", day(3)), ("a", day(5))], "k string, dt date")
    events = spark.createDataFrame([("a", day(3), 1.0), ("a", day(1), 2.0)], "k string, dt date, w double")
    got = G.before_strictly(dates, events, ["k"]).collect()
    assert {(r.dt, r.as_of, r.w) for r in got} == {(day(3), day(1), 2.0), (day(5), day(3), 1.0)}


def test_carry_back_fills_the_start(spark):
    keys = spark.createDataFrame([(1, day(i)) for i in range(4)], "code long, dt date")
    events = spark.createDataFrame([(1, day(2), "x")], "code long, dt date, name string")
    assert [r[2] for r in rows(B.carry_events(keys, events, ["name"], back=True), "dt")] == ["x"] * 4
    assert [r[2] for r in rows(B.carry_events(keys, events, ["name"]), "dt")] == [None, None, "x", "x"]


def test_calendar_alignment_keeps_to_the_span(spark):
    bars = spark.createDataFrame([(1, day(1), 5.0), (1, day(4), 6.0)], "code long, dt date, close double")
    cal = spark.createDataFrame([(day(i),) for i in (0, 1, 2, 4, 5)], "dt date")
    got = B.align_to_calendar(bars, cal).orderBy("dt").collect()
    assert [(r.dt, r.close) for r in got] == [(day(1), 5.0), (day(2), None), (day(4), 6.0)]


def test_position_restarts_after_closing(spark):
    fills = spark.createDataFrame(
        [(1, 1, day(0), 100.0, 10.0), (1, 1, day(1), -100.0, 12.0), (1, 1, day(2), 50.0, 20.0)],
        "account long, code long, dt date, qty double, price double",
    )
    got = L.position_ledger(L.daily_fills(fills)).orderBy("dt").collect()
    assert [r.qty for r in got] == [100, 0, 50]
    assert math.isclose(got[0].total_cost, 1005) and got[1].total_cost == 0 and math.isclose(got[2].cost_basis, 1005 / 50)
    trades = L.closed_trades(L.position_ledger(L.daily_fills(fills))).collect()
    assert len(trades) == 1 and trades[0].win


def test_dividend_reaches_the_holder_of_the_record_date(spark):
    ledger = spark.createDataFrame(
        [(1, 1, day(0), 10.0), (1, 1, day(40), 0.0), (2, 1, day(35), 4.0)], "account long, code long, dt date, qty double"
    )
    due = spark.createDataFrame([(1, day(36), None, day(38), 0.5)], "code long, record_date date, pay_date date, ex_date date, cash double")
    assert {(r.account, r.dt, r.credit) for r in L.dividend_credits(ledger, due).collect()} == {(1, day(38), 5.0), (2, day(38), 2.0)}


def test_first_failing_rule_wins(spark):
    df = spark.createDataFrame(
        [("ST x退", 1.0, 1, "600001"), ("ST x", 1.0, 0, "600001"), ("x", 1.0, 0, "300001"), ("x", 1.0, 0, "600001"), ("x", 2.0, 0, "600001")],
        "name string, price double, stop int, board string",
    ).select("*", F.lit(True).alias("is_buy"), F.lit(2.0).alias("up_limit"), F.lit(0.5).alias("down_limit"), F.lit(2.0).alias("high"), F.lit(0.5).alias("low"))
    got = [r.why for r in df.select(L.reject_reason().alias("why")).collect()]
    assert got == ["delist", "st", "mainboard", None, "limit"]


def test_drawdown_counts_a_loss_on_the_first_day(spark):
    df = spark.createDataFrame([("s", day(i), r, 0.01) for i, r in enumerate((-0.1, 0.05, 0.2))], "strategy string, dt date, r double, b double")
    assert math.isclose(R.ratios(df).first().max_down, -0.1)


def test_constant_returns_give_zero_not_null(spark):
    df = spark.createDataFrame([("s", day(i), 0.0, 0.0) for i in range(3)], "strategy string, dt date, r double, b double")
    assert all(v == 0 for k, v in R.ratios(df).first().asDict().items() if k not in ("strategy",))


def test_streak_breaks_on_an_open_day(spark):
    cal = spark.createDataFrame([(day(i),) for i in (0, 1, 4, 5, 6)], "dt date")
    flags = spark.createDataFrame([(1, day(i)) for i in (0, 1, 4, 6)] + [(2, day(5))], "code long, dt date")
    assert [(r.code, r.days, r.first_day) for r in V.streaks(flags, cal, 2).collect()] == [(1, 3, day(0))]


def test_prune_keeps_the_first_of_a_pair(spark):
    df = spark.createDataFrame([(float(i), float(2 * i + 1), float((i * 7) % 5)) for i in range(30)], "a double, b double, c double")
    assert M.prune_features(df, ["a", "b", "c"]) == ["a", "c"]


def test_written_stage_keeps_the_rows_and_cuts_the_plan(spark):
    df = materialise(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 20
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("catalogue", ["alpha101", "alpha191"])
def test_catalogue_sizes(catalogue):
    assert len(recipes(catalogue)) == {"alpha101": 82, "alpha191": 186}[catalogue]


def test_formulas_do_not_look_ahead(spark, sf):
    """Every formula of a mixed sample keeps its value when later bars are removed."""
    names = ["alpha101_002", "alpha101_012", "alpha101_017", "alpha101_041", "alpha101_101", "alpha191_009", "alpha191_027", "alpha191_057", "alpha191_161"]
    picked = {k: f for c in ("alpha101", "alpha191") for k, f in recipes(c).items() if k in names}
    bars = src.bars_monthly(spark, sf)
    got = V.prefix_differences(bars, lambda b: evaluate(formula_panel(b), picked), list(picked), "1999-12-31")
    assert {r.factor: r.differing for r in got.collect()} == dict.fromkeys(names, 0)


def test_export_replaces_only_its_year(spark, tmp_path):
    bars = spark.createDataFrame([(1, datetime.date(y, 5, 1), float(y)) for y in (2019, 2020)], "code long, dt date, close double")
    path = str(tmp_path / "bars")
    st.export_by_code(bars, path)
    st.export_by_code(bars.where("year(dt) = 2020").withColumn("close", F.lit(1.0)), path)
    got = {r.year: r.close for r in spark.read.parquet(path).collect()}
    assert got == {2019: 2019.0, 2020: 1.0}


def test_incremental_factor_recomputes_a_stale_store(spark):
    bars = spark.createDataFrame([(1, day(i), float(i)) for i in range(200)], "code long, dt date, close double")

    def build(b):
        return b.select("code", "dt", W.ts_sum(F.col("close"), 150).alias("s"))

    def since(first):
        return bars if first is None else bars.where(F.col("dt") >= first)

    fresh = st.incremental_factor(since, bars.where(F.col("dt") <= day(195)), build, day(199), days=20)
    stale = st.incremental_factor(since, bars.where(F.col("dt") <= day(50)), build, day(199), days=20)
    assert fresh.count() == 4 and fresh.where("s is not null").count() == 0
    assert stale.where("s is not null").count() == 51


def test_replace_table_keeps_the_old_content_when_a_write_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    st.replace_table(spark.range(3), path)
    with pytest.raises(Exception):
        st.replace_table(spark.range(5).select(F.raise_error(F.lit("stop")).alias("id")), path)
    assert st.read_table(spark, path).count() == 3
    st.replace_table(spark.range(7), path)
    assert st.read_table(spark, path).count() == 7


def test_correlation_matrix_over_pairs_with_both_values(spark):
    rows = [(float(i), None if i % 4 == 0 else float(i * i % 17) + 1e9, float(-i)) for i in range(40)]
    got = {(r.a, r.b): r.corr for r in A.corr_matrix(spark.createDataFrame(rows, "x double, y double, z double"), ["x", "y", "z"]).collect()}
    have = np.array([r[:2] for r in rows if r[1] is not None])
    assert set(got) == {("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")}
    assert math.isclose(got["x", "y"], np.corrcoef(have.T)[0, 1], abs_tol=1e-6) and math.isclose(got["x", "z"], -1)


def test_bars_are_aligned_by_one_exchange(spark):
    """Days were joined to the calendar and to their bars by day, and to their limits, which moved every day of every code three times more."""
    on = lambda i: datetime.date(2024, 3, 1) + datetime.timedelta(days=i)
    rows = [(1, on(0), 1.0), (1, on(4), 2.0), (1, on(4), 3.0), (1, on(3), 9.0), (None, on(0), 5.0), (None, on(2), 5.0), (2, None, 7.0), (3, on(4), 8.0)]
    bars = spark.createDataFrame(rows, "code long, dt date, close double")
    cal = spark.createDataFrame([(on(i),) for i in (0, 1, 2, 2, 4, 5)] + [(None,)], "dt date")
    out = B.align_to_calendar(bars, cal)
    want = [(1, on(0), 1.0), (1, on(1), None), (1, on(2), None), (1, on(4), 2.0), (1, on(4), 3.0), (3, on(4), 8.0)]
    want += [(None, on(i), None) for i in (0, 1, 2)]
    assert out.columns == ["code", "dt", "close"] and sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert "left" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
