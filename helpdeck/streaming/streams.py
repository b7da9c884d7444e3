"""Structured Streaming versions of three polled/timed rules.

* J1 ``stream_unread``: running unread count per recipient (a user id or a
  role) over the notification log - 'created' adds one, 'read' takes one away.
* J1 ``stream_unread_counts``: the same per user, who sees what is addressed to the own id or role: signed
  counts for ids, roles and (id, role) pairs are kept, and combined per user when the table is read.
* J2 ``stream_burst_failures``: failed attempts per address in 15-minute
  tumbling windows (event time, watermark), reported at >= 10: the simple form.
* J2 ``stream_login_blocks``: the exact limiter (a success clears the count, counting stops once blocked). The state
  of an address and period is its attempts in that period, until the watermark has passed it; each micro-batch walks
  them in order again. Rows later than the watermark are not counted in either form, and their number is logged.
* J3 ``stream_latest_status``: current ticket status from the approval log
  (latest by (created_at, id)).

Streams run in *update* mode into a ``foreachBatch`` sink that writes each
micro-batch's changed rows to its own Parquet folder (``batch_<id>``,
overwritten on replay, so a retried batch is idempotent). The current table
is "latest row per key over all batches". Every ``COMPACT_EVERY`` batches the sink merges the last merged version and the
batches since into a new version, marked when complete; older folders are removed one version later, so a read
opens a bounded number of folders however long the stream runs. Nothing is collected to the
driver (no memory sink). Checkpoints live in the shared checkpoint folder,
so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpdeck.operators.delivery import LIMIT_FAILURES, LIMIT_PERIOD_SECONDS
from helpdeck.session import scratch_path
from helpdeck.sources.fixtures import shape_approval_logs, shape_attempts, shape_notification_log
from helpdeck.sources.io import list_names, remove_folder

WATERMARK = "15 minutes"
COMPACT_EVERY = 16
log = logging.getLogger(__name__)


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A table as a file stream, be it one file or a folder of parts (new Parquet files become new micro-batches)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if is_folder(spark, path):
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table is a folder of parts: then its files lie below its own path."""
    files = spark.read.parquet(path).inputFiles()
    return not files or any(not f.rstrip("/").endswith("/" + path.rstrip("/").rsplit("/", 1)[-1]) for f in files)


# ------------------------------------------------------------------ transformations (batch or stream)
def recipients(notifications: DataFrame) -> Column:
    """The keys a notification counts under: 'user:<id>' and/or 'role:<role>'."""
    return F.explode(F.array_compact(F.array(
        F.when(F.col("user_id").isNotNull(), F.concat(F.lit("user:"), F.col("user_id").cast("string"))),
        F.when(F.col("role").isNotNull(), F.concat(F.lit("role:"), F.col("role"))))))


def unread_by_recipient(notifications: DataFrame) -> DataFrame:
    """J1 unread count per recipient key of the notifications table as it is."""
    delta = F.lit(1) - F.col("is_read")
    return (notifications.select(recipients(notifications).alias("recipient"), delta.alias("delta"))
            .groupBy("recipient").agg(F.sum("delta").cast("long").alias("unread")))


def unread_from_log(log_rows: DataFrame) -> DataFrame:
    """J1 unread count per recipient key from the notification log (user_id, role, event): +1 for 'created', -1 for
    'read'. The log holds one 'read' row per notification that turns from unread to read (what ``mark_read`` changes),
    so the state is one number per recipient and the rows may come in any order."""
    delta = F.when(F.col("event") == "created", 1).when(F.col("event") == "read", -1).otherwise(0)
    return (log_rows.select(recipients(log_rows).alias("recipient"), delta.alias("delta"))
            .groupBy("recipient").agg(F.sum("delta").cast("long").alias("unread")))


def latest_status(approval_logs: DataFrame) -> DataFrame:
    """J3 current status per ticket: the newest log row by (created_at, id)."""
    last = F.max_by(F.struct("new_status", "created_at", "id"), F.struct("created_at", "id"))
    return (approval_logs.groupBy("ticket_id").agg(last.alias("l"))
            .select("ticket_id", F.col("l.new_status").alias("status"), F.col("l.created_at").alias("changed_at"),
                    F.col("l.id").alias("log_id")))


def failure_windows(attempts: DataFrame, threshold: int = 10, period: str = "15 minutes",
                    watermark: str | None = WATERMARK) -> DataFrame:
    """J2 simple: failures per (address, tumbling period), kept when >= threshold.

    Test Parquet timestamps are TIMESTAMP_NTZ; ``withWatermark`` needs
    TIMESTAMP, so the column is cast first."""
    a = attempts.filter(F.col("ok") != 1).withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        a = a.withWatermark("ts", watermark)
    return (a.groupBy("address", F.window("ts", period).alias("w"))
            .agg(F.count(F.lit(1)).alias("failures"))
            .filter(F.col("failures") >= threshold)
            .select("address", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("period_start"), "failures"))


def unread_parts_from_log(log_rows: DataFrame) -> DataFrame:
    """J1 signed counts from the notification log by what they are addressed to: an id (``role`` NULL), a role (``user_id``
    NULL), or both at once. See ``unread_from_log`` for the log."""
    delta = F.when(F.col("event") == "created", 1).when(F.col("event") == "read", -1).otherwise(0)
    uid, role = F.col("user_id").cast("long"), F.col("role")
    keys = F.array_compact(F.array(
        F.when(uid.isNotNull(), F.struct(uid.alias("u"), F.lit(None).cast("string").alias("r"))),
        F.when(role.isNotNull(), F.struct(F.lit(None).cast("long").alias("u"), role.alias("r"))),
        F.when(uid.isNotNull() & role.isNotNull(), F.struct(uid.alias("u"), role.alias("r")))))
    return (log_rows.select(F.explode(keys).alias("k"), delta.alias("delta"))
            .groupBy(F.col("k.u").alias("user_id"), F.col("k.r").alias("role")).agg(F.sum("delta").cast("long").alias("unread")))


def unread_of_users(parts: DataFrame, users: DataFrame) -> DataFrame:
    """D13 ``user_id, unread`` of every user from ``unread_parts_from_log``: own id and role, less what is addressed to both."""
    uid, role = F.col("user_id"), F.col("role")
    a = parts.filter(role.isNull()).select(uid.alias("id"), F.col("unread").alias("_a"))
    b = parts.filter(uid.isNull()).select("role", F.col("unread").alias("_b"))
    c = parts.filter(uid.isNotNull() & role.isNotNull()).select(uid.alias("id"), "role", F.col("unread").alias("_c"))
    j = users.select("id", "role").join(a, "id", "left").join(b, "role", "left").join(c, ["id", "role"], "left")
    zero = F.lit(0)
    return j.select(F.col("id").alias("user_id"),
                    (F.coalesce("_a", zero) + F.coalesce("_b", zero) - F.coalesce("_c", zero)).cast("long").alias("unread"))


def login_periods(attempts: DataFrame, threshold: int = LIMIT_FAILURES, seconds: int = LIMIT_PERIOD_SECONDS,
                  watermark: str | None = WATERMARK) -> DataFrame:
    """J2 exact, per address and period of its attempts: ``n`` (most failures without a success between them, up to
    ``threshold``) and ``tenth_at`` (when it was reached; NULL where it was not). A period is blocked from then on, so later rows of it count no more."""
    a = attempts.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        a = a.withWatermark("ts", watermark)
    steps = F.array_sort(F.collect_list(F.struct("ts", "id", (F.col("ok") == 1).alias("ok"))))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("n"), F.lit(None).cast("timestamp").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x["ok"], F.lit(0)).otherwise(acc["run"] + 1)
        return F.when(acc["at"].isNotNull(), acc).otherwise(F.struct(
            run.alias("run"), F.greatest(acc["n"], run).alias("n"), F.when(run == threshold, x["ts"]).alias("at")))

    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return (a.groupBy("address", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.aggregate(steps, start, step).alias("x"))
            .select("address", text("w.start").alias("period_start"), F.col("x.n").cast("long").alias("n"), text("x.at").alias("tenth_at")))


# ------------------------------------------------------------------ running a stream to a table
def _newest(names: list[str], prefix: str) -> int:
    return max((int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit()), default=-1)


def _folders(spark: SparkSession, data: str) -> tuple[int, list[str]]:
    """The newest complete merged version and the folders that hold the current table: it and the batches after it."""
    base = _newest(list_names(spark, f"{data}/_complete"), "merged_")
    batches = sorted(n for n in list_names(spark, data) if n.startswith("batch_") and n[6:].isdigit() and int(n[6:]) > base)
    return base, [f"{data}/{n}" for n in ([f"merged_{base:012d}"] if base >= 0 else []) + batches]


def _current(spark: SparkSession, data: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The latest row per key, with its ``_batch``."""
    paths = _folders(spark, data)[1]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    cols = [f.name for f in schema.fields if f.name not in (*keys, "_batch")]
    last = F.max_by(F.struct(*cols), F.col("_batch"))
    return rows.groupBy(*keys).agg(last.alias("_r"), F.max("_batch").alias("_batch")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in cols], "_batch")


def compact(spark: SparkSession, data: str, schema: T.StructType, keys: list[str], batch_id: int) -> None:
    """Merge everything up to ``batch_id`` into ``merged_<batch_id>``; mark it when it is complete, then retire what the version
    before it replaced. A run that dies half-way leaves the old version valid; a repeated one does nothing more."""
    name = f"merged_{batch_id:012d}"
    base = _newest(list_names(spark, f"{data}/_complete"), "merged_")
    if base >= batch_id:
        return
    _current(spark, data, schema, keys).select(*schema.names).write.mode("overwrite").parquet(f"{data}/{name}")
    spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("overwrite").json(f"{data}/_complete/{name}")
    for old in list_names(spark, data):  # readers of the version before (base) may still be at work
        kind, _, number = old.partition("_")
        if number.isdigit() and (kind == "batch" and int(number) <= base or kind == "merged" and int(number) < base):
            remove_folder(spark, f"{data}/{old}")


def run_update_stream(spark: SparkSession, agg: DataFrame, keys: list[str], name: str,
                      path: str | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Run an update-mode aggregation until the source is drained
    (``availableNow``); return the current table: latest row per key.

    ``path`` (default: a new folder under the shared checkpoint location)
    holds the batches and the stream checkpoint: running again on the same
    path resumes after the last committed batch and only adds new batches.
    """
    out = (path or scratch_path(spark, f"stream-{name}")).rstrip("/")
    data = f"{out}/data"
    schema = T.StructType(list(agg.schema.fields) + [T.StructField("_batch", T.LongType())])

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")) \
            .write.mode("overwrite").parquet(f"{data}/batch_{batch_id:012d}")
        if (batch_id + 1) % compact_every == 0:
            compact(spark, data, schema, keys, batch_id)

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True)
         .start())
    q.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    if dropped:
        log.warning("%s: %d rows came later than the watermark and are not counted", name, dropped)
    return _current(spark, data, schema, keys).select(*agg.columns)


def stream_unread(spark: SparkSession, sf_dir: str, path: str | None = None, max_files: int | None = None) -> DataFrame:
    n = shape_notification_log(read_table_stream(spark, sf_dir, "events", max_files))
    return run_update_stream(spark, unread_from_log(n), ["recipient"], "unread", path)


def stream_unread_counts(spark: SparkSession, sf_dir: str, users: DataFrame, path: str | None = None, max_files: int | None = None,
                         compact_every: int = COMPACT_EVERY) -> DataFrame:
    """D13 + J1 unread notifications that each of ``users`` sees, from the log of created and read events."""
    n = shape_notification_log(read_table_stream(spark, sf_dir, "events", max_files))
    parts = run_update_stream(spark, unread_parts_from_log(n), ["user_id", "role"], "unread-counts", path, compact_every)
    return unread_of_users(parts, users)


def stream_latest_status(spark: SparkSession, sf_dir: str, path: str | None = None,
                         max_files: int | None = None) -> DataFrame:
    logs = shape_approval_logs(read_table_stream(spark, sf_dir, "events", max_files))
    return run_update_stream(spark, latest_status(logs), ["ticket_id"], "latest_status", path)


def stream_burst_failures(spark: SparkSession, sf_dir: str, threshold: int = 10,
                          path: str | None = None, max_files: int | None = None,
                          watermark: str | None = WATERMARK) -> DataFrame:
    """``watermark``: how late a row may come; None counts every row and keeps every window's state."""
    a = shape_attempts(read_table_stream(spark, sf_dir, "events", max_files))
    return run_update_stream(spark, failure_windows(a, threshold, watermark=watermark), ["address", "period_start"], "bursts", path)


def stream_login_blocks(spark: SparkSession, sf_dir: str, threshold: int = LIMIT_FAILURES, path: str | None = None,
                        max_files: int | None = None, watermark: str | None = WATERMARK) -> DataFrame:
    """J2 exact: the blocked periods, as ``operators.delivery.burst_failures`` finds them."""
    a = shape_attempts(read_table_stream(spark, sf_dir, "events", max_files))
    seen = run_update_stream(spark, login_periods(a, threshold, watermark=watermark), ["address", "period_start"], "blocks", path)
    return seen.filter(F.col("tenth_at").isNotNull()).select("address", "period_start", "n", "tenth_at")
