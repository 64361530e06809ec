"""Grouped statistics that Spark has no single function for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import cross as X

TINY = 1e-12


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate; NULL when a side does not vary."""
    pair = x.isNotNull() & y.isNotNull()
    a, b = F.when(pair, x), F.when(pair, y)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sa > TINY) & (sb > TINY), F.try_divide(F.covar_pop(a, b), sa * sb))


def rank_correlation(df: DataFrame, x: str, y: str, keys: Sequence[str], name: str) -> DataFrame:
    """Correlation of average ranks inside each group, over rows that have both values."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = X.add_ranks(pairs, {"_rx": F.col(x), "_ry": F.col(y)}, keys)
    return ranked.groupBy(*keys).agg(pearson(F.col("_rx"), F.col("_ry")).alias(name))


def day_bucket(df: DataFrame, days: int = 120, first: Column | None = None) -> Column:
    """Calendar bins of ``days`` days from the first day of the table, or from ``first``."""
    return F.floor(F.datediff("dt", df.agg(F.min("dt")).scalar() if first is None else first) / days).cast("int")


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise correlations over rows that have both values, as (a, b, corr) rows with a before b.

    Every row adds its products to one array of sums per column, combined on the map side: the plan has one
    aggregate whatever the number of columns, and what is shuffled is (columns)^2 numbers per task. Columns are
    centred on their means first, so that large levels cost no digits.
    """
    k = len(columns)
    means = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    centred = df.join(F.broadcast(means)).select(*[(F.col(c) - F.col(f"_m{i}")).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])  # one row
    vector = F.array(*[F.col(f"_v{i}") for i in range(k)])
    cells = centred.select(F.posexplode(vector).alias("i", "x"), vector.alias("v")).where("x is not null")
    cells = cells.select("i", "x", F.posexplode("v").alias("j", "y")).where("y is not null and j >= i")
    sums = cells.groupBy("i", "j").agg(pearson(F.col("x"), F.col("y")).alias("corr"))
    names = F.array(*map(F.lit, columns))
    every = df.sparkSession.range(k * k).select(F.floor(F.col("id") / k).cast("int").alias("i"), (F.col("id") % k).cast("int").alias("j")).where("j >= i")
    return every.join(sums, ["i", "j"], "left").select(F.get(names, "i").alias("a"), F.get(names, "j").alias("b"), "corr")


def describe(df: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles, max. The quartiles are exact."""
    stats = df.groupBy(*keys).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")
    )
    points = X.group_percentiles(df, F.col(x), [0.25, 0.5, 0.75], keys, "_q")
    out = stats.join(points, list(keys), "left") if keys else stats.withColumn("_q", points.scalar())
    quarters = [F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    return out.select(*keys, "count", "mean", "std", "min", *quarters, "max")


def quality_class(long: DataFrame) -> DataFrame:
    """Class per factor: 2 all null, 4 all zero, 5 one value, 1 usable."""
    stats = long.groupBy("factor").agg(
        F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    kind = (
        F.when(F.col("n") == 0, 2)
        .when((F.col("lo") == 0) & (F.col("hi") == 0), 4)
        .when(F.col("lo") == F.col("hi"), 5)
        .otherwise(1)
    )
    return stats.select("factor", kind.alias("kind"))


def row_hash(*columns: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))
