"""Cross-section operators against direct loops."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.operators.evaluate import factor_score
from tessera.session import ALL_KEYS_KEY, CLEAN_SHUFFLE_KEY, materialise
from tests.conftest import day


@pytest.fixture(scope="module")
def panel(spark):
    """A hot date with a third of the rows and one value a third of those share; nulls; a null date."""
    rng = random.Random(5)
    rows = []
    for code in range(900):
        rows.append((code, day(0), 1.0 if code % 3 == 0 else rng.gauss(0, 1)))
        rows.append((code, day(1 + code % 6), None if code % 10 == 0 else float(rng.randint(0, 4))))
        rows.append((code, day(8 + code % 5), rng.random()))
    rows += [(c, day(30), None) for c in range(4)]
    return spark.createDataFrame(rows, "code long, dt date, x double")


def by_date(panel):
    groups = {}
    for r in panel.collect():
        groups.setdefault(r.dt, {})[r.code] = r.x
    return groups


def direct_rank(values):
    have = [v for v in values.values() if v is not None]
    out = {}
    for code, v in values.items():
        out[code] = None
        if v is not None:
            out[code] = (sum(w < v for w in have) + (sum(w == v for w in have) + 1) / 2) / len(have)
    return out


def assert_ranks(panel):
    got = by_date(X.add_ranks(panel, {"r": F.col("x")}).select("code", "dt", F.col("r").alias("x")))
    for dt, values in by_date(panel).items():
        want = direct_rank(values)
        assert all((got[dt][k] is None and v is None) or abs(got[dt][k] - v) < 1e-12 for k, v in want.items())


def test_ranks(panel):
    assert_ranks(panel)


def test_ranks_of_several_columns(panel):
    both = X.add_ranks(panel, {"up": F.col("x"), "down": -F.col("x")})
    for r in both.collect():
        if r.x is not None:
            n = both.where((F.col("dt") == F.lit(r.dt)) & F.col("x").isNotNull()).count() if r.code == 5 else None
            assert n is None or abs(r.up + r.down - 1 - 1 / n) < 1e-9
        else:
            assert r.up is None and r.down is None


def test_value_classes_follow_the_order(spark):
    rng = random.Random(9)
    values = sorted({0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, *(rng.choice([-1, 1]) * 2.0 ** rng.uniform(-60, 60) for _ in range(2000)), *(2.0**k for k in range(-40, 40)), *(2.0**k * (1 - 2**-53) for k in range(-40, 40))})
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", X.value_class(F.col("x")).alias("k")).orderBy("x").collect()
    assert [r.k for r in got] == sorted(r.k for r in got)


def assert_buckets(panel, n):
    got = by_date(X.add_buckets(panel, "x", n, "q").select("code", "dt", F.col("q").alias("x")))
    for dt, values in by_date(panel).items():
        have = [v for v in values.values() if v is not None]
        if not have:
            assert set(got[dt].values()) == {None}
            continue
        edges = list(dict.fromkeys(np.percentile(have, [100 * i / n for i in range(n + 1)])))
        for code, v in values.items():
            want = None if v is None or len(edges) < 2 else max(1, sum(e < v - 1e-12 for e in edges))
            assert got[dt][code] == want, (dt, code, v, edges)


def test_buckets(panel):
    assert_buckets(panel, 5)


@pytest.mark.parametrize("population", [True, False])
def test_zscore(panel, population):
    got = by_date(X.add_zscore(panel, "x", "v", population=population).select("code", "dt", F.col("v").alias("x")))
    for dt, values in by_date(panel).items():
        have = np.array([v for v in values.values() if v is not None])
        spread = have.std(ddof=0 if population else 1) if len(have) > 1 else 0
        for code, v in values.items():
            want = None if v is None else ((v - have.mean()) / spread if spread > 1e-12 else 0.0)
            assert (got[dt][code] is None) == (want is None) and (want is None or abs(got[dt][code] - want) < 1e-8)


def test_rank_bounds(panel):
    r = X.add_ranks(panel, {"r": F.col("x")}).agg(F.min("r").alias("lo"), F.max("r").alias("hi")).first()
    assert 0 < r.lo and r.hi <= 1


def test_cells_hold_edges_alone(spark):
    rng = random.Random(4)
    values = sorted({0.0, 1.0, -1.0, 3.0, 31.0, -0.5, 5e-324, *(rng.uniform(-40, 40) for _ in range(2000)), *(2.0**k * (1 - 2**-53) for k in range(-40, 40))})
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", X.value_cell(F.col("x")).alias("k")).orderBy("x").collect()
    cells = [r.k for r in got]
    assert cells == sorted(cells)
    assert all(cells.count(k) == 1 for k in cells if k % 2 == 0)
    assert all({r.x: r.k for r in got}[v] % 2 == 0 for v in (0.0, 1.0, -1.0, 3.0, 31.0, -0.5))


def test_ranks_of_repeated_rows_and_missing_keys(spark):
    rows = [(1, day(0), 2.0), (1, day(0), 3.0), (2, day(0), 3.0), (None, day(0), 0.1), (3, None, 1.0), (4, day(0), None), (5, day(1), 0.0), (6, day(1), -0.0)]
    got = X.add_ranks(spark.createDataFrame(rows, "code long, dt date, x double"), {"r": F.col("x")}).collect()
    found = sorted((r.code or 0, r.x, r.r) for r in got if r.x is not None)
    assert found == [(0, 0.1, None), (1, 2.0, 0.875), (1, 3.0, 0.875), (2, 3.0, 0.875), (3, 1.0, None), (5, 0.0, 0.75), (6, 0.0, 0.75)]
    assert len(got) == len(rows)


def test_rows_are_exchanged_twice(spark, panel):
    """Values were combined, cut into classes, joined, gathered by row: five exchanges of all values."""
    plan = X.add_ranks(panel, {"r": F.col("x")})._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning(") <= 6  # two of the values, two of counts, the join's two
    assert not [line for line in plan.splitlines() if "SortMergeJoin" in line and "_x" in line]


def test_bucketed_tables_do_not_move(spark, panel):
    before = [spark.conf.get(k, None) for k in (ALL_KEYS_KEY, CLEAN_SHUFFLE_KEY)]
    table = materialise(panel, "bucketed", by="code")
    assert [spark.conf.get(k, None) for k in (ALL_KEYS_KEY, CLEAN_SHUFFLE_KEY)] in (before, ["true", "false"])
    assert sorted(map(repr, table.collect())) == sorted(map(repr, panel.collect()))
    windowed = table.withColumn("n", F.count("x").over(Window.partitionBy("code").orderBy("dt")))
    assert "Exchange" not in windowed._jdf.queryExecution().executedPlan().toString()


def test_values_are_counted_and_scored_in_all_tasks(spark):
    """Merged by bytes, a few tasks held all values of a large table."""
    rows = [(c, day(i), 1.0 + (7 * c + 3 * i) % 11, 2.0 + (c + i) % 5, float(c % 3)) for c in range(8) for i in range(30)]
    panel = spark.createDataFrame(rows, "code long, dt date, open double, close double, f double")
    found = X.value_positions(panel.select("dt", F.col("close").alias("_x")))
    exchanges = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_NUM" in x]
    assert any("_x" in x for x in exchanges(found))
    assert any("code" in x for x in exchanges(factor_score(panel, ["f"], (1,))))
    assert found.agg(F.sum("_same")).first()[0] == len(rows)
    assert found.where("_less + _same > _total or _total <> 8").count() == 0
