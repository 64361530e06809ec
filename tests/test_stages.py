"""What a staged formula batch leaves on disk."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.plans import staging
from tessera.plans.staging import evaluate, formula_panel
from tests.conftest import day


def bars(spark):
    rows = [(c, day(i), *[10.0 + (7 * c + 3 * i) % 11 + k for k in (0, 2, -2, 1)], 100.0 + c * i, 1000.0 + c) for c in range(6) for i in range(8)]
    return spark.createDataFrame(rows, "code long, dt date, open double, high double, low double, close double, volume double, amount double")


def nested(p):
    return p.rank(p.delay(p.rank(p.close + p.rank(p.volume)))) + p.rank(p.open)


@pytest.fixture
def scratch(monkeypatch, tmp_path):
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    return tmp_path


def test_levels_that_were_read_are_dropped(spark, scratch):
    """All written levels stayed until the scratch folder was cleared."""
    out = evaluate(formula_panel(bars(spark)), {"a": nested})
    assert out.where(F.col("a").isNotNull()).count() == 6 * 7
    folders = {f.parent.name for f in scratch.rglob("*.parquet")}
    assert len(folders) == 1 and next(iter(folders)).startswith("values")


def test_ranks_in_groups_equal_ranks_together(spark, monkeypatch):
    formulas = {f"f{i}": (lambda p, i=i: p.rank(p.close * (i + 1) - p.open * i)) for i in range(5)} | {"n": nested}
    found = []
    for size in (1, 2, 100):
        monkeypatch.setattr(staging, "RANKED", size)
        found.append(sorted(map(tuple, evaluate(formula_panel(bars(spark)), formulas).collect())))
    assert found[0] == found[1] == found[2]
    assert len(found[0]) == 48


def test_formulas_are_staged_in_chunks(spark, scratch, monkeypatch):
    """All formulas of a batch were staged at once: their levels and long ranks lay on disk together."""
    rows = [*bars(spark).collect(), (None, day(0), *[3.0] * 6), (None, day(1), *[5.0] * 6), (2, None, *[4.0] * 6)]
    table = spark.createDataFrame(rows, bars(spark).schema)
    formulas = {"n": nested, "d": lambda p: p.delay(p.close)} | {f"f{i}": (lambda p, i=i: p.rank(p.close * (i + 1) - p.open * i)) for i in range(3)}
    found = []
    for size in (100, 2):
        monkeypatch.setattr(staging, "CHUNK", size)
        out = evaluate(formula_panel(table), formulas)
        found.append((out.columns, sorted(map(tuple, out.collect()), key=str)))
    assert found[0] == found[1]
    assert len(found[0][1]) == 51
    after = list(scratch.rglob("*.parquet"))
    values = {f.parent for f in after if f.parent.name.startswith("values")}
    assert len(values) == 1 + 3 and {f.parent for f in after} == values  # one table, then one a chunk; the panel and the levels are gone


def test_formulas_without_ranks_are_not_written(spark, scratch):
    assert evaluate(formula_panel(bars(spark)), {"a": lambda p: p.delay(p.close)}).count() == 48
    assert not list(scratch.iterdir())
