"""Changes of a table kept by day read and write only the days that they touch."""

import re

from pyspark.sql import functions as F

from helpdeck import schemas as S
from helpdeck.operators import notify as N
from helpdeck.sources import dated as DT

NOW = "2024-01-10 12:00:00"


def rows():
    return [{"id": i, "user_id": i % 5 if i % 3 else None, "role": "admin" if i % 4 == 0 else None, "message": "m", "link": "l",
             "is_read": int(i % 12 < 6 or i // 20 == 8), "created_at": f"2024-01-{i // 20 + 1:02d} 00:00:{i % 20:02d}"} for i in range(200)] + [
        {"id": 900, "user_id": 1, "role": None, "message": "m", "link": "l", "is_read": 0, "created_at": None}]


def opened(df):
    return sorted({re.search(r"_day=([^/]*)/", f)[1] for f in df.inputFiles()})


def test_purge_and_marks_leave_other_days_alone(spark, tmp_path):
    n = S.rows(spark, S.NOTIFICATIONS, rows())
    base = str(tmp_path / "n")
    DT.publish_by_day(n, base, DT.notification_day(), DT.unread())

    def table():
        return sorted(map(str, DT.read_days(spark, base, n.schema, DT.manifest(spark, base)).collect()))

    def folders():
        return {r.day: r.folder for r in DT.manifest(spark, base).collect()}

    assert table() == sorted(map(str, n.collect())) and len(folders()) == 11
    before = folders()
    read = DT.purge_by_day(spark, base, n.schema, NOW, days=3)
    want = N.retention_purge(n, NOW, days=3)
    assert opened(read) == [f"2024-01-{d:02d}" for d in range(1, 8)]
    assert table() == sorted(map(str, want.collect()))
    assert {d for d, f in folders().items() if before.get(d) == f} == {"2024-01-08", "2024-01-09", "2024-01-10", "none"}
    assert DT.purge_by_day(spark, base, n.schema, NOW, days=3).inputFiles() == [] or opened(
        DT.purge_by_day(spark, base, n.schema, NOW, days=3)) == ["2024-01-07"]  # a day at the cut-off keeps some read ones
    before = folders()
    readers = spark.createDataFrame([(1, "admin"), (1, None)], "user_id long, role string")
    read = DT.mark_read_by_day(spark, base, n.schema, readers=readers)
    assert "2024-01-09" not in opened(read) and "none" in opened(read)  # the ninth has nothing unread
    assert table() == sorted(map(str, N.mark_read(want, readers=readers).collect()))
    assert folders()["2024-01-09"] == before["2024-01-09"]
    spark.createDataFrame([("x", "nowhere", 1, 1)], DT.MANIFEST).write.parquet(base + "/_manifests/9999999999999-dead")  # no marker
    assert len(table()) == want.count()


def test_a_table_can_lose_all_rows(spark, tmp_path):
    n = S.rows(spark, S.NOTIFICATIONS, rows()).filter(F.col("is_read") == 1)
    base = str(tmp_path / "n")
    DT.publish_by_day(n, base, DT.notification_day(), DT.unread())
    DT.purge_by_day(spark, base, n.schema, "2030-01-01 00:00:00")
    assert DT.manifest(spark, base).count() == 0 and DT.read_days(spark, base, n.schema, DT.manifest(spark, base)).count() == 0
