"""Cross-section operators (partition = date).

A date holds every traded code, so unlike a code's history its size grows with the data and no task
may hold a whole date. Statistics are partial aggregates joined back. Ranks and percentiles come from
value counts: equal values are combined before the exchange, values are cut into classes by their
leading bits, and a value's place is its place inside the class plus the counts of the classes below.
The classes are a pure function of the value, so nothing is sampled and a lost task cuts them the same way again.
Ranks go back to their rows, so there the rows themselves are dealt out by class, once, and the counts come to them.
A caller who has counted the rows of the largest date may have dates that are small ranked whole (:func:`date_ranks`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import spread

DT = "dt"
FINE = 512  # classes between a power of two and the next
COARSE = 32  # of rows: a class is a share of a date, and the counts are few against the rows
SALTS = 16


def group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Append per-group aggregates to every row."""
    totals = df.groupBy(*keys).agg(*[v.alias(k) for k, v in stats.items()])
    if not keys:
        return df.join(F.broadcast(totals)).select(*df.columns, *stats)  # one row
    return df.join(totals, list(keys), "left").select(*df.columns, *stats)


def _leading(x: Column, fine: int) -> tuple[Column, Column, Column]:
    size = F.abs(x.cast("double"))
    exponent = F.floor(F.log2(size))
    return size, exponent, F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * fine)


def value_class(x: Column, fine: int = FINE) -> Column:
    """Class of a number by sign, exponent and leading bits: never falls as the number grows."""
    size, exponent, step = _leading(x, fine)
    return F.when(size == 0, F.lit(0)).otherwise(F.signum(x.cast("double")) * ((exponent + 1100) * fine + step + 1)).cast("long")


def value_cell(x: Column, fine: int = COARSE) -> Column:
    """Class of a number in which its edge stands alone: even for the edges (0, small whole numbers, ...), which are one value each."""
    size, exponent, step = _leading(x, fine)
    edge = (size == 0) | (size == F.pow(F.lit(2.0), exponent) * (1 + step / fine))
    return 2 * value_class(x, fine) + F.when(edge, 0).otherwise(F.signum(x.cast("double"))).cast("long")


def value_positions(values: DataFrame, keys: Sequence[str] = (DT,), x: str = "_x") -> DataFrame:
    """One row per (keys, distinct value of ``x``): its count, how many are smaller, group total."""
    keys = list(keys)
    # The planner would merge partitions by bytes, and a task's memory would grow with the values.
    counts = spread(values.where(F.col(x).isNotNull()), [*keys, x]).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_same"))
    counts = counts.withColumn("_class", value_class(F.col(x)))
    upto = Window.partitionBy(*keys).orderBy("_class")
    sums = counts.groupBy(*keys, "_class").agg(F.sum("_same").alias("_n"))
    below = sums.select(
        *keys, "_class", (F.sum("_n").over(upto) - F.col("_n")).alias("_below"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_total")
    )
    inside = Window.partitionBy(*keys, "_class").orderBy(x)
    local = counts.withColumn("_inside", F.sum("_same").over(inside) - F.col("_same"))
    return local.join(below, [*keys, "_class"]).select(*keys, x, "_same", (F.col("_inside") + F.col("_below")).alias("_less"), "_total")


def add_ranks(
    df: DataFrame, columns: Mapping[str, Column], keys: Sequence[str] = (DT,), row: Sequence[str] = ("code", DT), by: Sequence[str] = ()
) -> DataFrame:
    """Append percentile ranks (average ties) of each column inside its group; NULL stays NULL, and so does a row with a NULL key.

    ``row`` and ``by`` as for :func:`rank_table`.
    """
    row = list(dict.fromkeys([*row, *keys]))
    return df.join(rank_table(df, columns, keys, row, by), row, "left").select(*df.columns, *columns)


def rank_table(
    df: DataFrame, columns: Mapping[str, Column], keys: Sequence[str] = (DT,), row: Sequence[str] = ("code", DT), by: Sequence[str] = ()
) -> DataFrame:
    """The ranks of :func:`add_ranks` by ``row``, of rows that have any.

    ``row`` names the columns that tell rows apart; ``by`` some of them by which ``df`` lies in as many parts as the session shuffles to, so
    that it need not move. All columns asked for are ranked together, in one long table of (row, column number, value). It is exchanged
    twice: to the cells of values, where the counts of the cells below are stacked on top, and back to the rows. Only equal values that
    are no cell's edge are not split further.
    """
    names, row = list(columns), list(dict.fromkeys([*row, *keys]))
    entries = [F.struct(F.lit(i).alias("i"), columns[n].cast("double").alias("x")) for i, n in enumerate(names)]
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys)) if keys else df
    long = known.select(*row, F.explode(F.filter(F.array(*entries), lambda e: e["x"].isNotNull())).alias("e"))
    long = long.select(*row, F.col("e.i").alias("_i"), F.col("e.x").alias("_x"), value_cell(F.col("e.x")).alias("_cell"))
    alone = F.col("_cell") % 2 == 0
    group = ["_i", *keys]
    sums = long.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto, whole = Window.partitionBy(*group).orderBy("_cell"), Window.partitionBy(*group)
    at = F.struct((F.sum("_n").over(upto) - F.col("_n")).alias("less"), F.col("_n").alias("same"), F.sum("_n").over(whole).alias("total"))
    salts = F.when(alone, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    tops = sums.select(*group, "_cell", at.alias("_at")).withColumn("_salt", F.explode(salts))
    salted = long.withColumn("_salt", F.when(alone, F.pmod(F.xxhash64(*row), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    cell = [*group, "_cell", "_salt"]
    inside = Window.partitionBy(*cell).orderBy(F.col("_x").asc_nulls_first())
    placed = salted.unionByName(tops, allowMissingColumns=True).select(
        *row, "_i", "_cell", "_salt", "_x",
        F.first("_at").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_at"),
        (F.rank().over(inside) - 2).alias("_less"),
    )
    equal = F.count(F.lit(1)).over(Window.partitionBy(*cell, "_x"))
    placed = placed.withColumn("_same", F.when(alone, F.col("_at.same")).otherwise(equal)).where("_x is not null")
    less = F.col("_at.less") + F.when(alone, 0).otherwise(F.col("_less"))
    ranks = placed.select(*row, "_i", ((less + (F.col("_same") + 1) / 2.0) / F.col("_at.total")).alias("_rank"))
    if by:
        ranks = ranks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    return ranks.groupBy(*row).agg(*[F.max(F.when(F.col("_i") == i, F.col("_rank"))).alias(n) for i, n in enumerate(names)])


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Percentile ranks with average ties; NaN is the largest value."""
    n = len(x)
    order = np.argsort(x)
    s = x[order]
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))])) if n else np.empty(0, np.int64)
    same = np.diff(np.append(first, n))
    out = np.empty(n)
    out[order] = np.repeat((first + (same + 1) / 2.0) / n, same)
    return out


def largest_group(df: DataFrame, keys: Sequence[str] = (DT,)) -> int:
    """Rows of the largest group."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def date_ranks(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """The table of :func:`rank_table` by code and date, for dates that a task may hold whole: all columns go once to their date.

    Rows without a code count but have no rank, rows that repeat a code and date share the largest one.
    """
    names = list(columns)
    inputs = df.where("dt is not null").select("code", DT, *[columns[n].cast("double").alias(n) for n in names])

    def rank(table: pa.Table) -> pa.Table:
        ranked = {"code": table.column("code"), DT: table.column(DT)}
        for n in names:
            x = table.column(n).to_numpy()
            known = ~table.column(n).is_null().to_numpy()
            out = np.zeros(len(x))
            out[known] = average_ranks(x[known])
            ranked[n] = pa.array(out, mask=~known)
        found = pa.table(ranked).filter(table.column("code").is_valid())
        if len(found.column("code").unique()) < found.num_rows:
            found = found.group_by(["code", DT]).aggregate([(n, "max") for n in names]).select(["code", DT, *[f"{n}_max" for n in names]])
        return found.rename_columns(["code", DT, *names])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return inputs.repartition(parts, DT).groupBy(DT).applyInArrow(rank, inputs.schema).repartition(parts, "code")


def add_zscore(df: DataFrame, x: str, name: str, keys: Sequence[str] = (DT,), population: bool = False) -> DataFrame:
    """(x - mean) / std; 0 where the group does not vary."""
    spread = F.stddev_pop(x) if population else F.stddev_samp(x)
    kept = df.columns
    out = group_stats(df, keys, {"_mean": F.avg(x), "_std": spread})
    z = F.when(F.col("_std") > 1e-12, (F.col(x) - F.col("_mean")) / F.col("_std"))
    return out.select(*kept, F.when(F.col(x).isNotNull(), F.coalesce(z, F.lit(0.0))).alias(name))


def add_minmax(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (DT,)) -> DataFrame:
    """Scale each column to [0, 1] inside its group, in place."""
    stats = {f"_{f}_{c}": getattr(F, f)(c) for c in columns for f in ("min", "max")}
    out = group_stats(df, keys, stats)
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_min_{c}"), F.col(f"_max_{c}") - F.col(f"_min_{c}")) for c in columns}
    return out.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def add_cs_scale(df: DataFrame, x: str, name: str, keys: Sequence[str] = (DT,)) -> DataFrame:
    kept = df.columns
    out = group_stats(df, keys, {"_abs": F.sum(F.abs(F.col(x)))})
    return out.select(*kept, F.try_divide(F.col(x), F.col("_abs")).alias(name))


def group_percentiles(df: DataFrame, x: Column, points: Sequence[float], keys: Sequence[str], name: str) -> DataFrame:
    """Exact linear-interpolated percentiles per group as one array column.

    The value at index k is the largest one with at most k smaller rows: a plain maximum, combined on the map side.
    """
    index = [F.lit(p) * (F.col("_total") - 1) for p in points]
    lower = [F.max(F.when(F.col("_less") <= F.floor(i), F.col("_x"))) for i in index]
    upper = [F.max(F.when(F.col("_less") <= F.ceil(i), F.col("_x"))) for i in index]
    found = value_positions(df.select(*keys, x.alias("_x")), keys).groupBy(*keys).agg(
        F.max("_total").alias("_total"), F.array(*lower).alias("_lo"), F.array(*upper).alias("_hi")
    )
    parts = []
    for j, i in enumerate(index):
        lo, hi = F.get("_lo", F.lit(j)), F.get("_hi", F.lit(j))
        parts.append(F.when(lo == hi, lo).otherwise((F.ceil(i) - i) * lo + (i - F.floor(i)) * hi))
    return found.select(*keys, F.array(*parts).alias(name))


def add_buckets(df: DataFrame, x: str, n: int, name: str, keys: Sequence[str] = (DT,)) -> DataFrame:
    """Quantile buckets 1..n: interpolated edges, duplicate edges dropped, first bucket closed left."""
    points = [i / n for i in range(n + 1)]
    edges = group_percentiles(df, F.col(x), points, keys, "_edges").withColumn("_edges", F.array_distinct("_edges"))
    kept = df.columns
    below = F.greatest(F.size(F.filter("_edges", lambda e: e < F.col(x))), F.lit(1))
    bucket = F.when(F.col(x).isNotNull() & (F.size("_edges") > 1), below)
    return df.join(edges, list(keys), "left").select(*kept, bucket.alias(name))


def top_n(df: DataFrame, n: int, order: Sequence[Column], keys: Sequence[str] = (DT,), place: str = "place") -> DataFrame:
    """First n rows per group. Spark limits each map partition to n rows before the exchange."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)


def decreasing_weight(place: Column, n: int) -> Column:
    """Position weight of the i-th of n picks."""
    return (n - (place - 1) * (F.lit(float(n)) / place)) / (n * n / 2.0)
