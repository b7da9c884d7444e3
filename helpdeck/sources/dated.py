"""Tables kept by day, of which a change rewrites only the days that it touches.

A version is a manifest: one row per day with the folder that holds the day's rows and what is in it (rows, and how many
meet a condition that later changes ask about, here: unread). A change picks days by the manifest alone, reads
those, writes their new rows into a folder of its own and publishes a manifest that takes the other days over as they are. Their files are
neither read nor written. The marker is written last, so a job that dies half-way changes nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "day string, folder string, rows bigint, open bigint"
DAY = "_day"


def _publish(spark: SparkSession, base: str, version: str, manifest: DataFrame) -> None:
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{base}/_manifests/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("errorifexists").json(f"{base}/_published/{version}")


def _write_days(df: DataFrame, base: str, version: str, day: Column, is_open: Column) -> DataFrame:
    """Write ``df`` by day below ``base/v=<version>``; the manifest rows of what was written."""
    spark, folder = df.sparkSession, f"v={version}"
    df.withColumn(DAY, day).repartition(DAY, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.partitionBy(DAY).parquet(f"{base}/{folder}")
    schema = T.StructType([*df.schema.fields, T.StructField(DAY, T.StringType())])
    written = spark.read.schema(schema).parquet(f"{base}/{folder}")
    return written.groupBy(F.col(DAY).alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_open).alias("open")).select(
        "day", F.concat(F.lit(f"{folder}/{DAY}="), "day").alias("folder"), "rows", "open")


def _version() -> str:
    return f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"


def publish_by_day(df: DataFrame, base: str, day: Column, is_open: Column) -> None:
    """A first version of a table by ``day`` (text, not NULL); ``is_open`` is what changes ask about."""
    version = _version()
    _publish(df.sparkSession, base, version, _write_days(df, base, version, day, is_open))


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """The newest manifest: one row a day."""
    version = spark.read.schema("version string").json(f"{base}/_published/*").agg(F.max("version")).first()[0]
    if version is None:
        raise FileNotFoundError(f"no published version under {base}")
    return spark.read.schema(MANIFEST).parquet(f"{base}/_manifests/{version}")


def read_days(spark: SparkSession, base: str, schema, days: DataFrame) -> DataFrame:
    """The rows of the days of (a part of) a manifest."""
    folders = [f"{base}/{r['folder']}" for r in days.select("folder").collect()]  # one row a day
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def change_days(spark: SparkSession, base: str, schema, touched: Column, change: Callable[[DataFrame], DataFrame], day: Column, is_open: Column) -> DataFrame:
    """Publish a version in which ``change`` was applied to the days that ``touched`` picks from the manifest (``day, rows, open``).

    ``change`` maps the rows of those days to their new rows, each staying in its day; a day without rows goes. Returns the days read.
    """
    now = manifest(spark, base)
    picked = now.filter(touched)
    days = read_days(spark, base, schema, picked)
    version = _version()
    new = _write_days(change(days), base, version, day, is_open)
    _publish(spark, base, version, now.filter(~F.coalesce(touched, F.lit(False))).unionByName(new))
    return days


# ------------------------------------------------------------------ notifications
def notification_day() -> Column:
    return F.coalesce(F.substring("created_at", 1, 10), F.lit("none"))


def unread() -> Column:
    return F.coalesce(F.col("is_read") == 0, F.lit(False))


def purge_by_day(spark: SparkSession, base: str, schema, now: str, days: int = 3, clock: str = "utc") -> DataFrame:
    """I9 on a table by day: only days up to the cut-off that hold read notifications are opened. Returns the days read."""
    from helpdeck.operators.notify import retention_cutoff, retention_purge

    old = (F.col("day") <= F.substring(retention_cutoff(now, days, clock), 1, 10)) & (F.col("rows") > F.col("open"))
    return change_days(spark, base, schema, old, lambda n: retention_purge(n, now, days, clock), notification_day(), unread())


def mark_read_by_day(spark: SparkSession, base: str, schema, **marks) -> DataFrame:
    """I10 on a table by day: only days with unread notifications are opened. ``marks``: see ``operators.notify.mark_read``. Returns the days read."""
    from helpdeck.operators.notify import mark_read

    return change_days(spark, base, schema, F.col("open") > 0, lambda n: mark_read(n, **marks), notification_day(), unread())
