import datetime

import pandas as pd
import pytest
from pyspark.sql import SparkSession

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = local_session("4", "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


def day(i):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=i)


@pytest.fixture(scope="session")
def tiny(spark):
    """Two codes of twelve days with known integers, gaps and a flat stretch."""
    a = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]
    b = [2, 7, 1, 8, 2, 8, 1, 8, 2, 8, 4, 5]
    rows = [(c, day(i), float(v), float(v if (i + c) % 5 else float("nan"))) for c, vs in ((1, a), (2, b)) for i, v in enumerate(vs)]
    pdf = pd.DataFrame(rows, columns=["code", "dt", "x", "z"])
    pdf["z"] = pdf["z"].astype("Float64").where(~pdf["z"].isna(), None)
    return spark.createDataFrame(
        [(r.code, r.dt, r.x, None if pd.isna(r.z) else float(r.z)) for r in pdf.itertuples()], "code long, dt date, x double, z double"
    )


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
