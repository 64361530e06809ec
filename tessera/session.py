"""Session settings, the shared scratch folder and written stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEAN_SHUFFLE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ALL_KEYS_KEY = "spark.sql.requireAllClusterKeysForCoPartition"


def local_session(cores: str = "8", name: str = "tessera") -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter's session is used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.debug.maxToStringFields", "200")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder of ``spark.checkpoint.dir``.

    Only a local session may do without that setting: there all tasks share the machine's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage", by: str | None = None, managed: str | None = None) -> DataFrame:
    """Cut lineage by a written table: it outlives lost executors and is read back by column.

    The shuffle files of the write are removed with it, since nothing reads them again. With ``by`` the table lies in buckets
    of that column, as many as the session shuffles to, and joins on more keys in the plan that is written may use such buckets, so
    that tables do not move for each join and window by it. It is external, or the managed table ``managed``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = managed or f"tessera_{path.rsplit('/', 1)[-1]}".replace("-", "_")
    given = {CLEAN_SHUFFLE_KEY: "true"} | ({ALL_KEYS_KEY: "false"} if by else {})
    before = {k: spark.conf.get(k, "true" if k == ALL_KEYS_KEY else "false") for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        if by:
            writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("compression", "zstd")
            (writer if managed else writer.option("path", path)).saveAsTable(table, format="parquet")
        else:
            df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.table(table) if by else spark.read.schema(df.schema).parquet(path)


class Stages:
    """Written tables of one plan, in buckets of one column. A table goes once those that were made from it are written.

    They are managed tables of a schema in the scratch folder, so that dropping one removes its files.
    """

    def __init__(self, spark: SparkSession, by: str):
        self.spark, self.by, self.schema, self.written = spark, by, None, 0
        self.tables: list[str] = []

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``by``: the column of the buckets, if it is another one; the rows are already dealt out by it."""
        if self.schema is None:
            path = scratch_path(self.spark, "stages")
            self.schema = f"tessera_{path.rsplit('/', 1)[-1]}".replace("-", "_")
            place = path.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"create schema {self.schema} location '{place}'")
        self.written += 1
        self.tables.append(f"{self.schema}.{name}_{self.written}")
        return materialise(df, name, by or self.by, self.tables[-1])

    def keep_last(self) -> None:
        """Drop all tables but the newest."""
        self.drop(1)

    def drop(self, left: int = 0) -> None:
        """Drop the oldest tables until so many are left."""
        while len(self.tables) > left:
            self.spark.sql(f"drop table {self.tables.pop(0)}")
