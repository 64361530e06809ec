"""Attach lower-frequency tables to a panel."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions import windows as W
from tessera.operators.bars import carry_events


def first_per_date(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("code", "dt").orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def align_events(
    panel: DataFrame, events: DataFrame, date: str, columns: Sequence[str], conv: int = 0, order: Sequence[Column] = ()
) -> DataFrame:
    """Attach ``columns`` of an event table to the panel.

    conv 0: same-day join, carried forward; 1: the same with text dates; 2: same-day join only;
    3: known from the day after the announcement on (as-of, so a weekend announcement counts
    from the next open day). The first row per date wins; columns of the panel with the same
    name are replaced.
    """
    day = S.compact_date(F.col(date)) if conv == 1 else F.col(date)
    if conv == 3:
        day = F.date_add(day, 1)
    events = first_per_date(events.withColumn("dt", day).where("dt is not null"), order or [F.col(c) for c in columns])
    panel = panel.drop(*[c for c in columns if c in panel.columns])
    if conv == 3:
        return carry_events(panel, events, columns)
    joined = panel.join(events.select("code", "dt", *columns), ["code", "dt"], "left")
    if conv == 2:
        return joined
    carried = {c: W.ffill(F.col(c)).alias(c) for c in columns}
    return joined.select(*[carried.get(c, F.col(c)) for c in joined.columns])


def before_strictly(dates: DataFrame, events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """For each of ``dates`` (keys, dt): the event rows of the latest event date before it.

    Only the distinct dates are matched as-of; the event rows follow by an equi-join.
    """
    keys = list(keys)
    known = events.select(*keys, F.col("dt").alias("_at")).distinct()
    stacked = dates.select(*keys, "dt", F.lit(None).cast("date").alias("_at")).distinct()
    stacked = stacked.unionByName(known.select(*keys, F.col("_at").alias("dt"), "_at"))
    order = Window.partitionBy(*keys).orderBy("dt", F.col("_at").asc_nulls_first())
    seen = F.last("_at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    matched = stacked.withColumn("_use", seen).where("_at is null").select(*keys, "dt", F.col("_use").alias("_at"))
    return matched.join(events.withColumnRenamed("dt", "_at"), [*keys, "_at"]).withColumnRenamed("_at", "as_of")


def camel(name: str) -> str:
    """Factor name of a table column: net_mf_vol becomes netMfVol."""
    return re.sub(r"_([a-z0-9])", lambda m: m.group(1).upper(), name)


def factor_group(
    panel: DataFrame, table: DataFrame, columns: Sequence[str], date: str, conv: int, order: Sequence[Column] = ()
) -> DataFrame:
    """Event-aligned factors under their camel-case names."""
    out = align_events(panel.select("code", "dt"), table, date, columns, conv, order)
    return out.select("code", "dt", *[F.col(c).alias(camel(c)) for c in columns])
