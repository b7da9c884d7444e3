"""Streams resume from their checkpoint and equal their batch twins."""

import os

from pyspark.sql import functions as F

from helpdeck.sources.fixtures import TicketViews
from helpdeck.streaming import streams as S

SF = "/root/testdata/sf0.001"


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    path = str(tmp_path / "unread")
    first = sorted(map(tuple, S.stream_unread(spark, SF, path).collect()))
    batches = sorted(os.listdir(os.path.join(path, "data")))
    again = sorted(map(tuple, S.stream_unread(spark, SF, path).collect()))
    assert again == first
    assert sorted(os.listdir(os.path.join(path, "data"))) == batches   # nothing re-processed
    batch = sorted(map(tuple, S.unread_by_recipient(TicketViews(spark, SF).notifications).collect()))
    assert first == batch


def test_latest_status_stream_equals_batch(spark, tmp_path):
    got = sorted(map(tuple, S.stream_latest_status(spark, SF, str(tmp_path / "ls")).collect()))
    want = sorted(map(tuple, S.latest_status(TicketViews(spark, SF).approval_logs).collect()))
    assert got == want


def test_streams_over_several_micro_batches(spark, tmp_path):
    """A table of three parts, one per micro-batch, newest events first."""
    src = tmp_path / "src"
    events = spark.read.parquet(f"{SF}/events.parquet")
    cut = sorted(r.ts for r in events.select("ts").collect())
    lo, hi = cut[len(cut) // 3], cut[2 * len(cut) // 3]
    for part in (events.ts > hi, (events.ts > lo) & (events.ts <= hi), events.ts <= lo):
        events.filter(part).coalesce(1).write.mode("append").parquet(str(src / "events.parquet"))
    v = TicketViews(spark, SF)
    unread = S.stream_unread(spark, str(src), str(tmp_path / "u"), max_files=1)
    assert len(os.listdir(tmp_path / "u" / "data")) == 3        # one folder a batch
    assert sorted(map(tuple, unread.collect())) == sorted(map(tuple, S.unread_by_recipient(v.notifications).collect()))
    status = S.stream_latest_status(spark, str(src), str(tmp_path / "s"), max_files=1)
    assert sorted(map(tuple, status.collect())) == sorted(map(tuple, S.latest_status(v.approval_logs).collect()))
    bursts = S.stream_burst_failures(spark, str(src), 1, str(tmp_path / "b"), max_files=1, watermark=None)
    want = S.failure_windows(v.attempts, 1, watermark=None)
    assert sorted(map(tuple, bursts.collect())) == sorted(map(tuple, want.collect()))


def test_read_events_take_unread_away(spark):
    rows = [(1, 7, None, "created"), (2, 7, None, "created"), (3, None, "admin", "created"), (1, 7, None, "read"),
            (3, None, "admin", "read")]
    df = spark.createDataFrame(rows, "id long, user_id long, role string, event string")
    assert sorted(map(tuple, S.unread_from_log(df).collect())) == [("role:admin", 0), ("user:7", 1)]


def test_user_counts_and_limiter_over_several_micro_batches(spark, tmp_path):
    """Newest events first, compacted after every second batch: equal to the batch operators on the whole tables."""
    from helpdeck.operators.delivery import burst_failures
    from helpdeck.operators.notify import unread_counts

    src = str(tmp_path / "src")
    events = spark.read.parquet(f"{SF}/events.parquet")
    cut = sorted(r.ts for r in events.select("ts").collect())
    edges = [cut[len(cut) * i // 5] for i in range(1, 5)]
    for lo, hi in reversed(list(zip([None, *edges], [*edges, None]))):
        part = events.filter((F.lit(True) if lo is None else events.ts >= lo) & (F.lit(True) if hi is None else events.ts < hi))
        part.coalesce(1).write.mode("append").parquet(src + "/events.parquet")
    v = TicketViews(spark, SF)
    got = S.stream_unread_counts(spark, src, v.users, str(tmp_path / "u"), max_files=1, compact_every=2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, unread_counts(v.notifications, v.users).collect()))
    assert S._folders(spark, str(tmp_path / "u" / "data"))[0] == 3
    for threshold in (1, 2):
        got = S.stream_login_blocks(spark, src, threshold, str(tmp_path / f"b{threshold}"), max_files=1, watermark=None)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, burst_failures(v.attempts, threshold).collect()))
    assert S.stream_login_blocks(spark, SF, 1).count() == burst_failures(v.attempts, 1).count()  # all in time: one batch


def test_pairs_addressed_to_id_and_role_count_once(spark):
    rows = [(7, "admin", "created"), (7, None, "created"), (None, "admin", "created"), (7, "admin", "read"), (8, "cs", "created"), (None, "cs", "created")]
    log = spark.createDataFrame(rows, "user_id long, role string, event string")
    users = spark.createDataFrame([(7, "admin"), (8, "admin"), (9, "cs"), (10, "none")], "id long, role string")
    got = S.unread_of_users(S.unread_parts_from_log(log), users)
    assert dict(map(tuple, got.collect())) == {7: 2, 8: 2, 9: 2, 10: 0}


def test_limiter_stops_counting_once_blocked(spark):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", 5, int(i == 2)) for i in range(8)] + [(9, "2024-01-01 00:00:30", 5, 1)] + [
        (10 + i, f"2024-01-01 00:16:{i:02d}", 5, 0) for i in range(2)]
    a = spark.createDataFrame(rows, "id long, ts string, address long, ok int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sorted(map(tuple, S.login_periods(a, 3, watermark=None).collect()))
    assert got == [(5, "2024-01-01 00:00:00", 3, "2024-01-01 00:00:05"), (5, "2024-01-01 00:15:00", 2, None)]


def test_a_long_stream_is_read_from_few_folders(spark, tmp_path):
    """After 100 micro-batches the table is a merged version and the batches after it; a half-written version is not read."""
    from pyspark.sql import types as T

    data = str(tmp_path / "data")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("_batch", T.LongType())])
    want = {}
    for b in range(100):
        rows = [(b % 7, b), (100 + b // 10, b)]
        want.update(rows)
        spark.createDataFrame([(k, n, b) for k, n in rows], schema).coalesce(1).write.mode("overwrite").parquet(f"{data}/batch_{b:012d}")
        if (b + 1) % 16 == 0:
            S.compact(spark, data, schema, ["k"], b)
            S.compact(spark, data, schema, ["k"], b)  # a repeated batch merges nothing twice
    assert {r.k: r.n for r in S._current(spark, data, schema, ["k"]).collect()} == want
    base, folders = S._folders(spark, data)
    assert base == 95 and len(folders) == 5 and len(os.listdir(data)) < 2 * 16 + 8
    spark.createDataFrame([(1, -1, 99)], schema).write.parquet(f"{data}/merged_{99:012d}")  # died before its marker
    assert {r.k: r.n for r in S._current(spark, data, schema, ["k"]).collect()} == want
    S.compact(spark, data, schema, ["k"], 99)
    assert {r.k: r.n for r in S._current(spark, data, schema, ["k"]).collect()} == want and S._folders(spark, data)[0] == 99
