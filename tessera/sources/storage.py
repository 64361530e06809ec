"""Storage layouts and batch maintenance of tables: factors, exports, appends, upserts."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions import windows as W

# -- factor store ---------------------------------------------------------------------------
def to_long(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    return df.unpivot(["code", "dt"], list(factors), "factor", "value")


def write_factors(long: DataFrame, path: str, mode: str = "append") -> None:
    """(factor, code, dt, value) in one folder per factor and year, sorted by date inside the files.

    Folders are rebalanced by size: a large one is written by many tasks, small ones share tasks.
    """
    (
        long.withColumn("year", F.year("dt"))
        .hint("rebalance", F.col("factor"), F.col("year"))
        .sortWithinPartitions("factor", "year", "dt")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("factor", "year")
        .parquet(path)
    )


def read_factors(
    spark: SparkSession,
    path: str,
    factors: Sequence[str],
    start: str | None = None,
    end: str | None = None,
    codes: DataFrame | None = None,
) -> DataFrame:
    """Wide (code, dt, factors) for an inclusive date range; factor and year folders are pruned, dates pushed down."""
    long = spark.read.parquet(path).where(F.col("factor").isin(list(factors)))
    if start:
        long = long.where((F.col("dt") >= F.lit(start).cast("date")) & (F.col("year") >= int(start[:4])))
    if end:
        long = long.where((F.col("dt") <= F.lit(end).cast("date")) & (F.col("year") <= int(end[:4])))
    if codes is not None:
        long = long.join(codes.select("code"), "code", "left_semi")
    return long.groupBy("code", "dt").pivot("factor", list(factors)).agg(F.first("value"))


def last_date(df: DataFrame) -> Column:
    """The table's latest date as a scalar subquery."""
    return df.agg(F.max("dt")).scalar()


def latest_snapshot(df: DataFrame) -> DataFrame:
    return df.where(F.col("dt") == last_date(df))


def aligned(keys: DataFrame, factor: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Factor values on the master keys, carried forward per code."""
    joined = keys.select("code", "dt").join(factor, ["code", "dt"], "left")
    return joined.select("code", "dt", *[W.ffill(F.col(c)).alias(c) for c in columns])


def min_last_date(long: DataFrame) -> DataFrame:
    """Refresh watermark: the earliest of the factors' latest dates."""
    return long.groupBy("factor").agg(F.max("dt").alias("dt")).agg(F.min("dt").alias("dt"))


def delete_date(df: DataFrame, day: str) -> DataFrame:
    return df.where(F.col("dt") != F.lit(day).cast("date"))


def thin_dates(df: DataFrame, limit: int) -> DataFrame:
    """Dates with at most ``limit`` rows."""
    return df.groupBy("dt").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= limit).select("dt")


def backfill_dates(spark: SparkSession, stored: DataFrame, source: DataFrame, path: str, limit: int) -> None:
    """Rewrite only the per-date folders whose stored day is thin."""
    fresh = source.join(thin_dates(stored, limit), "dt", "left_semi")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


# -- exports ------------------------------------------------------------------------------------
def export_by_code(bars: DataFrame, path: str, buckets: int | None = None) -> None:
    """One folder per year and code, or per year and code bucket when codes are many.

    Only the years present in ``bars`` are replaced, so a run over the current year leaves
    finished years alone.
    """
    part = "code" if buckets is None else "bucket"
    out = bars.withColumn("year", F.year("dt"))
    if buckets is not None:
        out = out.withColumn("bucket", F.pmod(F.xxhash64("code"), F.lit(buckets)).cast("int"))
    (
        out.hint("rebalance", F.col("year"), F.col(part))
        .sortWithinPartitions("year", part, "code", "dt")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", part)
        .parquet(path)
    )


def export_by_date(bars: DataFrame, path: str) -> None:
    """One folder per year, month and day; only days present in ``bars`` are replaced."""
    out = bars.withColumns({"year": F.year("dt"), "month": F.month("dt"), "day": F.dayofmonth("dt")})
    (
        out.hint("rebalance", F.col("year"), F.col("month"), F.col("day"))
        .sortWithinPartitions("year", "month", "day", "code")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month", "day")
        .parquet(path)
    )


def latest_partition(df: DataFrame) -> DataFrame:
    """Newest (year, month, day) folder; reads partition values only."""
    newest = F.max(F.struct("year", "month", "day")).alias("p")
    return df.select("year", "month", "day").distinct().agg(newest).select("p.year", "p.month", "p.day")


def normalise_bars(
    df: DataFrame, names: dict[str, str], time: str, session_open: str = "09:30:00", zone: str = "+08:00"
) -> DataFrame:
    """Source columns to (time, code, open, high, low, close, volume, amount); absent numbers are 0."""
    fields = ("open", "high", "low", "close", "volume", "amount")
    stamp = F.concat(F.date_format(F.col(time), f"yyyy-MM-dd {session_open}"), F.lit(zone)).alias("time")

    def number(field: str) -> Column:
        if field not in names:
            return F.lit(0.0).alias(field)
        return F.coalesce(S.number(F.col(names[field]).cast("string")), F.lit(0.0)).alias(field)

    return df.select(stamp, F.col(names.get("code", "code")).cast("string").alias("code"), *map(number, fields))


# -- appends and upserts -----------------------------------------------------------------------
def append_evolve(old: DataFrame, new: DataFrame, text: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Union with schema evolution: text columns get '' for null, number columns 0 for junk."""

    def coerce(df: DataFrame) -> DataFrame:
        fixed = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text if c in df.columns}
        fixed |= {c: F.coalesce(S.number(F.col(c).cast("string")), F.lit(0.0)) for c in numbers if c in df.columns}
        return df.withColumns(fixed)

    return coerce(coerce(old).unionByName(coerce(new), allowMissingColumns=True))


VERSION = "version="


def replace_table(df: DataFrame, path: str) -> None:
    """Write the new content as the table's next version; readers keep the last one until it is complete.

    A version counts once its writer has committed it, so a failed write leaves the old content in place. The
    version before the last one is kept for readers that still hold it; older ones are removed.
    """
    spark = df.sparkSession
    known, begun = _versions(spark, path)
    df.write.parquet(f"{path.rstrip('/')}/{VERSION}{max(begun, default=-1) + 1:010d}")  # fails if another writer has it
    fs, root = _folder(spark, path)
    for old in known[:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"{VERSION}{old:010d}"), True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a table written by :func:`replace_table`."""
    known, _ = _versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no complete version in {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{VERSION}{known[-1]:010d}")


def _folder(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _versions(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the complete versions, in order, and of all that were begun."""
    fs, root = _folder(spark, path)
    if not fs.exists(root):
        return [], []
    folders = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith(VERSION)]
    done = [f for f in folders if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    number = lambda f: int(f.getName().removeprefix(VERSION))
    return sorted(map(number, done)), list(map(number, folders))


def incremental_append(old: DataFrame, new: DataFrame, per_code: bool = False) -> DataFrame:
    """Drop the last stored date and take everything from it on out of the new rows."""
    if not per_code:
        last = last_date(old)
        return old.where(F.col("dt") < last).unionByName(new.where(F.col("dt") >= last))
    last = old.groupBy("code").agg(F.max("dt").alias("_last"))
    kept = old.join(last, "code").where("dt < _last").drop("_last")
    fresh = new.join(last, "code", "left").where("_last is null or dt >= _last").drop("_last")
    return kept.unionByName(fresh)


def missing_periods(disclosed: DataFrame, stored: DataFrame) -> DataFrame:
    return disclosed.select("code", "period").join(stored.select("code", "period"), ["code", "period"], "left_anti")


def restated_periods(disclosed: DataFrame, stored: DataFrame) -> DataFrame:
    """Periods stored with fewer rows than were disclosed."""
    want = disclosed.groupBy("code", "period").agg(F.count(F.lit(1)).alias("disclosed"))
    have = stored.groupBy("code", "period").agg(F.count(F.lit(1)).alias("stored"))
    return want.join(have, ["code", "period"]).where("stored < disclosed")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], hash_name: str = "hash") -> DataFrame:
    """Insert or replace by the md5 of the key columns; the new row wins."""

    def keyed(df: DataFrame, rank: int) -> DataFrame:
        text = [F.col(k).cast("string") for k in key]
        return df.withColumns({hash_name: F.md5(F.concat_ws(",", *text)), "_age": F.lit(rank)})

    both = keyed(old, 1).unionByName(keyed(new, 0))
    newest = F.row_number().over(Window.partitionBy(hash_name).orderBy("_age"))
    return both.withColumn("_n", newest).where("_n = 1").drop("_n", "_age")


def dividend_events(df: DataFrame) -> DataFrame:
    """Implemented dividends, the latest row per record date and code."""
    order = Window.partitionBy("record_date", "code").orderBy(F.desc("ann_date"))
    done = df.where("div_proc = 'implemented'").withColumn("_n", F.row_number().over(order))
    return done.where("_n = 1").drop("_n")


def month_slices(span: DataFrame) -> DataFrame:
    """(start, end) spans cut into calendar months."""
    months = F.explode(F.sequence(F.trunc("start", "month"), F.col("end"), F.expr("interval 1 month"))).alias("m")
    cut = span.select(*span.columns, months)
    return cut.select(
        *[c for c in span.columns if c not in ("start", "end")],
        F.greatest("start", "m").alias("start"),
        F.least("end", F.last_day("m")).alias("end"),
    )


def incremental_factor(bars_from: Callable[[datetime.date | None], DataFrame], store: DataFrame, build, newest: datetime.date, days: int = 700, stale: int = 100) -> DataFrame:
    """Rows newer than the stored ones, recomputed from the last ``days`` days only.

    ``bars_from(day)`` gives the bars from a day on (all for None); the day is a plain date, so it reaches the scan
    of whatever the bars are built from. A store more than ``stale`` days behind ``newest`` is recomputed from all history.
    """
    last = store.agg(F.max("dt")).first()[0]
    behind = last is None or (newest - last).days > stale
    out = build(bars_from(None if behind else newest - datetime.timedelta(days=days)))
    return out if last is None else out.where(F.col("dt") > F.lit(last))
