"""Rolling kernels against the engine's windows, ranks of whole dates against ranks by classes, digits against their text."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.functions import kernels as K
from tessera.functions import windows as W
from tessera.plans import registry, staging
from tessera.plans.staging import FormulaFrame, evaluate, formula_panel
from tests.test_stages import bars, nested


def panel(spark):
    rows = [(c, i, None if (i * 7 + c) % 11 == 0 else float((i * i * 3 + c * 5) % 17) / 7, float((i * 5 + c) % 9 - 4)) for c in range(5) for i in range(3 + 9 * c)]
    rows += [(7, i, 2.5e6, 1.0 + i) for i in range(30)]  # a flat stretch of large values
    rows += [(None, i, float(i), 1.0) for i in range(4)]
    return spark.createDataFrame(rows, "code long, dt int, x double, y double")


CASES = {
    "sum": lambda x, y, n, m, over: W.ts_sum(x, n, m, over),
    "mean": lambda x, y, n, m, over: W.mean(x, n, m, over),
    "stddev": lambda x, y, n, m, over: W.stddev(x, n, m, over),
    "min": lambda x, y, n, m, over: W.ts_min(x, n, m, over),
    "max": lambda x, y, n, m, over: W.ts_max(x, n, m, over),
    "rank": lambda x, y, n, m, over: W.ts_rank(x, n, m, over),
    "correlation": lambda x, y, n, m, over: W.correlation(x, y, n, over),
    "covariance": lambda x, y, n, m, over: W.covariance(x, y, n, over),
    "decay": lambda x, y, n, m, over: W.decay_linear(x, n, m, compat=True, over=over),
    "regbeta": lambda x, y, n, m, over: W.regbeta(x, n, m, compat=True, over=over),
}


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_kernels_equal_windows(spark, batch, monkeypatch):
    """A correlation over 200 rows went over them again for each row: about 45 s for a million bars."""
    df = panel(spark).withColumn("_length", W.history_length())
    frame = FormulaFrame(df)
    x, y = F.col("x"), F.col("y")
    sizes = (1, 2, 5, 12, 40)
    plain = {f"{k}_{n}": f(x, y, n, F.col("_length"), W.place) for k, f in CASES.items() for n in sizes}
    rolled = {f"{k}_{n}": f(x, y, n, F.col("_length"), frame._placer(1)) for k, f in CASES.items() for n in sizes}
    assert len({kind for kind, _, _ in frame.kernels[1].values()}) == len(K.KERNELS)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        step = K.add_rolling(df.select("*", *[v.alias(k) for k, v in frame.parts[1].items()]), frame.kernels[1])
        got = {(r.code, r.dt): r.asDict() for r in step.select("code", "dt", *[v.alias(k) for k, v in rolled.items()]).collect()}
        want = {(r.code, r.dt): r.asDict() for r in df.select("code", "dt", *[v.alias(k) for k, v in plain.items()]).collect()}
    finally:
        spark.conf.set(key, before)
    assert len(got) == len(want) == 139
    for row, values in want.items():
        for name, value in values.items():
            found = got[row][name]
            assert (found is None) == (value is None), (row, name, found, value)
            assert value is None or found == pytest.approx(value, rel=1e-9, abs=1e-9), (row, name)


def test_whole_dates_rank_as_classes_do(spark, monkeypatch):
    rows = [(c, d, None if (c + d) % 6 == 0 else float((c * c + d) % 7) - 3, float(c % 3)) for c in range(40) for d in range(3)]
    rows += [(None, 1, 0.5, 2.0), (3, None, 1.0, 1.0), (5, 2, 9.0, 9.0)]  # no code, no date, a code and date twice
    df = spark.createDataFrame(rows, "code long, dt int, x double, y double")
    columns = {"a": F.col("x"), "b": -F.col("y")}
    want = {(r.code, r.dt): (r.a, r.b) for r in X.rank_table(df, columns).collect() if r.code is not None}
    got = {(r.code, r.dt): (r.a, r.b) for r in X.date_ranks(df, columns).collect()}
    assert got == want and len(got) == 120

    formulas = {"n": nested, "r": lambda p: p.rank(p.close), "d": lambda p: p.delay(p.rank(p.open * p.volume), 2)}
    found = []
    for size in (0, 250_000):
        monkeypatch.setattr(staging, "DATE_ROWS", size)
        found.append(sorted(map(tuple, evaluate(formula_panel(bars(spark)), formulas).collect())))
    assert found[0] == found[1] and len(found[0]) == 48


def test_rows_out_of_order_are_refused(spark):
    def broken(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c[1:], c[:1]]) for c in b.columns], schema=b.schema)

    df = panel(spark).coalesce(1)
    assert K.add_rolling(df, {"s": ("sum", (F.col("x"),), 3)}).count() == 139
    mixed = df.mapInArrow(broken, df.schema)
    assert K.add_rolling(mixed, {"s": ("sum", (F.col("x"),), 3)}).count() == 139  # the window sorts them


def test_digits_equal_the_decimal_text(spark):
    values = [0.0, -0.0, 1e-11, 1e-10, 0.1, 0.3, 5e-4, 99999.96863, 999999.5, 1e6, -123456.7, 9.9e26, 1e27, 1e28, 1e300, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double").union(spark.range(2000).selectExpr("(id - 1000) * pow(10.0D, id % 40 - 12) / 7"))
    x, tens = F.col("x"), F.floor(F.log10(F.abs("x")))
    lead = F.floor(x * F.pow(F.lit(10.0), registry.LEADING - tens) + registry.GRID_EDGE)
    text = F.concat(lead.cast("long").cast("string"), F.lit("e"), (tens - registry.LEADING).cast("string"))
    want = F.when(F.abs(x) < registry.NOISE, 0.0).otherwise(text.cast("double"))
    assert df.where(~registry.digits("x").eqNullSafe(want)).count() == 0
