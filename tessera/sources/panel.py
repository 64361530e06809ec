"""Panel views over the raw trade tables: bars, listing, calendar, adjustments, statements."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def _bars(trades: DataFrame, first_key: list[str], dt: Column) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    ticks = trades.select(
        F.col("l_suppkey").alias("code"),
        dt.alias("dt"),
        price.alias("px"),
        "l_quantity",
        "l_extendedprice",
        F.struct(*first_key, "l_orderkey", "l_linenumber", "l_partkey", price.alias("px")).alias("k"),
    )
    return ticks.groupBy("code", "dt").agg(
        F.min_by("px", "k").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "k").alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
    )


def day(column: str = "l_shipdate") -> Column:
    return F.col(column).cast("date")


def month(column: str = "l_shipdate") -> Column:
    return F.trunc(day(column), "month")


def bars_daily(spark: SparkSession, path: str) -> DataFrame:
    """One bar per code and day. Trades are combined on the map side, so a code that holds a
    third of all trades still leaves one row per day."""
    return _bars(table(spark, path, "lineitem"), [], day())


def bars_monthly(spark: SparkSession, path: str, since: datetime.date | None = None) -> DataFrame:
    """Monthly bars, of the months that start on ``since`` or later; the scan reads only their trades."""
    lines = table(spark, path, "lineitem")
    if since:
        first = since if since.day == 1 else (since.replace(day=1) + datetime.timedelta(days=32)).replace(day=1)
        lines = lines.where(F.col("l_shipdate") >= F.lit(first))
    return _bars(lines, ["l_shipdate"], month())


def listing(spark: SparkSession, path: str) -> DataFrame:
    supplier, nation, region = (table(spark, path, t) for t in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("code"), F.col("n_name").alias("industry"), F.col("r_name").alias("market"))
    )


def calendar(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "lineitem").select(day().alias("dt")).distinct()


def adjustments(spark: SparkSession, path: str) -> DataFrame:
    """Adjustment factor per code and month, to be carried forward over the days."""
    return (
        table(spark, path, "lineitem")
        .groupBy(F.col("l_suppkey").alias("code"), month().alias("dt"))
        .agg((1 + F.avg("l_discount")).alias("adj_factor"))
    )


def statements(spark: SparkSession, path: str) -> DataFrame:
    """Quarterly figures with an announcement date after the period."""
    quarter = F.trunc(day(), "quarter")
    value = F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")
    return (
        table(spark, path, "lineitem")
        .groupBy(F.col("l_suppkey").alias("code"), quarter.alias("period"))
        .agg(F.avg(value).alias("eps"), F.sum("l_quantity").alias("shares"))
        .select("code", "period", F.date_add("period", 110).alias("ann_date"), "eps", "shares")
    )


def fills(spark: SparkSession, path: str) -> DataFrame:
    """Trades per account; returned lots count as sales."""
    lineitem, orders = table(spark, path, "lineitem"), table(spark, path, "orders")
    quantity = F.col("l_quantity")
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("account"),
        F.col("l_suppkey").alias("code"),
        day().alias("dt"),
        F.when(F.col("l_returnflag") == "R", -quantity).otherwise(quantity).alias("qty"),
        (F.col("l_extendedprice") / quantity).alias("price"),
        "l_orderkey",
        "l_linenumber",
    )


def index_weights(spark: SparkSession, path: str) -> DataFrame:
    """Weight of each code in its market's monthly volume."""
    bars = bars_monthly(spark, path).join(listing(spark, path), "code").select("market", "dt", "code", "volume")
    totals = bars.groupBy("market", "dt").agg(F.sum("volume").alias("total"))
    return bars.join(totals, ["market", "dt"]).select(
        F.col("market").alias("index_code"), "dt", "code", (F.col("volume") / F.col("total")).alias("weight")
    )


def benchmark_returns(bars: DataFrame) -> DataFrame:
    """Equal-weighted one-row return per date."""
    from tessera.functions.windows import delay

    returns = bars.select("dt", (F.try_divide(F.col("close"), delay(F.col("close"))) - 1).alias("ret"))
    return returns.groupBy("dt").agg(F.avg("ret").alias("ret")).where("ret is not null")
