"""Snapshots, restore validation and file inventories."""

import os

from pyspark.sql import functions as F

from helpdeck.sources import io as IO

SF = "/root/testdata/sf0.001"


def test_snapshot_roundtrip_and_broken_snapshot_refused(spark, tmp_path):
    t = {"users": spark.range(3).selectExpr("id", "'admin' AS role"),
         "tickets": spark.range(5).selectExpr("id", "'waiting' AS status")}
    root = IO.snapshot_export(t, base=str(tmp_path / "snaps"), label="a")
    expected = {k: v.schema for k, v in t.items()}
    ok = IO.snapshot_restore_check(spark, root, expected).collect()
    assert all(r.restorable for r in ok) and [r.rows for r in ok if r.table_name == "users"] == [3]
    # a snapshot whose marker is missing (export interrupted) is refused
    root_b = str(tmp_path / "snaps" / "snapshot=b")
    t["users"].write.parquet(root_b + "/users")
    t["tickets"].write.parquet(root_b + "/tickets")
    assert not any(r.restorable for r in IO.snapshot_restore_check(spark, root_b, expected).collect())
    # a table with a different schema is refused
    root_c = str(tmp_path / "snaps" / "snapshot=c")
    t["users"].withColumn("id", F.col("id").cast("string")).write.parquet(root_c + "/users")
    t["tickets"].write.parquet(root_c + "/tickets")
    spark.createDataFrame([("c", 2)], "label string, tables int").write.json(root_c + "/" + IO.MARKER)
    bad = {r.table_name: r for r in IO.snapshot_restore_check(spark, root_c, expected).collect()}
    assert not bad["users"].schema_ok and not bad["users"].restorable


def test_file_inventory_size_matches_stat(spark):
    inv = IO.file_inventory(spark, SF, "*.parquet")
    got = IO.file_inventory_size(inv).first()
    files = [f for f in os.listdir(SF) if f.endswith(".parquet")]
    assert got.files == len(files)
    assert got.bytes == sum(os.stat(os.path.join(SF, f)).st_size for f in files)
    assert got.kb_display == f"{got.bytes / 1024:.1f} KB"


def test_file_accept_rules(spark):
    inv = spark.createDataFrame([("a.jpg", "image/jpeg", 100), ("b.pdf", "application/pdf", 11 * 1024 * 1024),
                                 ("c.exe", "application/octet-stream", 5)], "name string, mime string, bytes long")
    got = {r.name: (r.accepted, r.reason) for r in IO.file_accept(inv).collect()}
    assert got == {"a.jpg": (True, "ok"), "b.pdf": (False, "size"), "c.exe": (False, "mime")}


def test_publish_keeps_readers_on_the_last_complete_version(spark, tmp_path):
    base = str(tmp_path / "tickets")
    IO.publish(spark.range(3), base)
    second = IO.publish(spark.range(5), base)
    assert IO.read_published(spark, base).count() == 5 and second.startswith(base + "/v=")
    # a version written without its marker (a job that died) is never read
    spark.range(9).write.parquet(base + "/v=9999999999999-dead")
    assert IO.read_published(spark, base).count() == 5


def test_restore_replaces_all_tables_or_none(spark, tmp_path):
    import pytest

    old = {"users": spark.range(3).selectExpr("id", "'admin' AS role"), "tickets": spark.range(5).selectExpr("id", "'waiting' AS status")}
    new = {"users": spark.range(7).selectExpr("id", "'cs' AS role"), "tickets": spark.range(2).selectExpr("id", "'closed' AS status")}
    expected = {k: v.schema for k, v in old.items()}
    base = str(tmp_path / "set")
    with pytest.raises(Exception):  # nothing published yet
        IO.read_published_set(spark, base)
    IO.publish_set(old, base)

    def now():
        return {t: df.count() for t, df in IO.read_published_set(spark, base).items()}

    good = IO.snapshot_export(new, base=str(tmp_path / "s"), label="good")
    lacking = IO.snapshot_export({"users": new["users"]}, base=str(tmp_path / "s"), label="lacking")
    wrong = IO.snapshot_export({"users": new["users"], "tickets": spark.range(2).selectExpr("id", "1 AS status")}, base=str(tmp_path / "s"), label="wrong")
    for root in (lacking, wrong, str(tmp_path / "s" / "nowhere")):
        with pytest.raises(IO.RestoreRefused):
            IO.snapshot_restore(spark, root, expected, base)
        assert now() == {"users": 3, "tickets": 5}
    with pytest.raises(IO.RestoreRefused, match="bytes"):
        IO.snapshot_restore(spark, good, expected, base, max_bytes=10)
    spark.range(9).write.parquet(base + "/v=9999999999999-dead/users")  # a restore that died while it copied
    assert now() == {"users": 3, "tickets": 5}
    IO.snapshot_restore(spark, good, expected, base, max_bytes=IO.MAX_RESTORE_BYTES)
    assert now() == {"users": 7, "tickets": 2} and IO.read_published_set(spark, base)["users"].first().role == "cs"


def test_scratch_folders_are_removed(spark):
    from helpdeck import session

    session.clear_scratch(spark)
    path = session.scratch_path(spark, "some")
    spark.range(3).write.parquet(path)
    session.scratch_path(spark, "never-written")
    assert os.path.isdir(path) and session.clear_scratch(spark) == 1 and not os.path.exists(path)
