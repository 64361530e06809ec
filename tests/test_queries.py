"""A cross-section of the registered queries against their DuckDB SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tessera.plans import ORACLE, QUERIES
from tests.compare import compare, connect

SAMPLE = [
    "W03_ts_sum", "W10_ts_rank", "W12_correlation", "X01_cs_rank", "X05_cs_qcut", "J04_asof_name", "J06_asof_strict",
    "A06_rank_corr_agg", "S08_read_factors", "S18_incremental_append", "G07_adjusted_bars", "V05_factor_score",
    "L07_position_ledger", "L09_dividend_credit", "R06_risk_ratios", "T03_train_valid_split", "ta_macd", "ta_adx", "ta_sar",
    "ta_candles_2bar", "O04_alpha191_061_081",
]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, sf, name):
    assert compare(queries()[name](spark, sf), con, oracle_sql()[name]) == ""


def test_entry_has_a_stable_schema(spark):
    df = entry(spark)
    assert df.columns[:2] == ["code", "dt"] and df.count() > 0


def test_only_queries_without_an_sql_form_lack_one():
    without = set(QUERIES) - set(ORACLE)
    assert without == {
        "ta_mama", "ta_ht_trendline", "ta_ht_dcperiod", "ta_ht_dcphase", "ta_ht_phasor",
        "ta_ht_sine", "ta_ht_trendmode",
    }
