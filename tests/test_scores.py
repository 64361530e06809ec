"""The catalogue's scores: every formula over every horizon, in batches, against SQL."""

import pytest

from tessera.plans import ORACLE, q_catalogue
from tessera.plans.catalogue import recipes
from tessera.plans.registry import on_grid
from tests.compare import compare, connect


def test_every_formula_is_scored():
    """Four of the formulas were scored, over one horizon."""
    sql = ORACLE["O05_score_catalogue"]
    every = recipes("alpha101") | recipes("alpha191")
    assert len(every) > 200
    assert all(f" as {name}" in sql for name in every)
    assert all(f"as r{d}" in sql for d in q_catalogue.V.HORIZONS)


@pytest.mark.parametrize("batch", [2])
def test_scores_in_batches_equal_sql(spark, sf, monkeypatch, batch):
    monkeypatch.setattr(q_catalogue, "BATCH", batch)
    chosen = {k: f for k, f in (recipes("alpha101") | recipes("alpha191")).items() if k in ("alpha101_012", "alpha101_101", "alpha191_014")}
    assert len(chosen) == 3
    got = q_catalogue._score_catalogue(spark, sf, chosen)
    assert got.count() == 3
    assert compare(got, connect(sf), on_grid(q_catalogue._score_catalogue_sql(chosen))) == ""
