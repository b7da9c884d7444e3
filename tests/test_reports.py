"""Report semantics on hand-made rows and plan shape."""

from helpdeck import schemas as S
from helpdeck.operators import notify as N
from helpdeck.operators import reports as R


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_marketplace_grouping_keeps_null_and_literal_unknown(spark):
    t = S.rows(spark, S.TICKETS, [{"id": 1, "marketplace": None}, {"id": 2, "marketplace": "Unknown"},
                                  {"id": 3, "marketplace": ""}, {"id": 4, "marketplace": ""}])
    got = sorted(tuple(r) for r in R.marketplace_complaints(t).collect())
    assert got == [("", 2), ("Unknown", 1), ("Unknown", 1)]


def test_product_complaints_group_by_id(spark):
    p = S.rows(spark, S.PRODUCTS, [{"id": 1, "nama_produk": "Fan", "tipe": "A"},
                                   {"id": 2, "nama_produk": "Fan", "tipe": "B"}])
    t = S.rows(spark, S.TICKETS, [{"id": 1, "product_id": 1}, {"id": 2, "product_id": 2}, {"id": 3, "product_id": 2},
                                  {"id": 4, "product_id": 98}, {"id": 5, "product_id": 99}, {"id": 6}])
    got = sorted((r.product_id or 0, r.nama_produk, r.tipe, r.total) for r in R.product_complaints(t, p).collect())
    assert got == [(0, "Unknown", "", 1), (1, "Fan", "A", 1), (2, "Fan", "B", 2), (98, "Unknown", "", 1),
                   (99, "Unknown", "", 1)]


def test_avg_resolution_rounding_and_empty(spark):
    t = S.rows(spark, S.TICKETS, [
        {"id": 1, "status": "completed", "created_at": "2024-01-01 10:00:00", "closed_at": "2024-01-02 01:00:00"},
        {"id": 2, "status": "completed", "created_at": "2024-01-01 23:00:00", "closed_at": "2024-01-01 23:30:00"},
        {"id": 3, "status": "completed", "created_at": "2024-01-01 00:00:00", "closed_at": "2024-01-01 00:00:00"},
        {"id": 4, "status": "completed", "created_at": "2024-01-01 00:00:00", "closed_at": "2024-01-01 00:00:00"}])
    # whole days 1, 0, 0, 0 -> 0.25 -> 0.3 (halves up)
    assert R.avg_resolution_closed(t).first().avg_hari == 0.3
    assert R.avg_resolution_closed(t.limit(0)).first().avg_hari == 0.0


def test_overdue_threshold(spark):
    now = "2024-01-10 12:00:00"
    t = S.rows(spark, S.TICKETS, [
        {"id": 1, "status": "waiting", "created_at": "2024-01-07 12:00:00"},    # exactly 3 days: excluded
        {"id": 2, "status": "waiting", "created_at": "2024-01-07 11:59:51"},    # 3.0001 days: included
        {"id": 3, "status": None, "created_at": "2024-01-01 00:00:00"},         # NULL status: NOT IN drops it
        {"id": 4, "status": "completed", "created_at": "2024-01-01 00:00:00"}])
    assert [r.id for r in R.overdue_tickets(t, now).collect()] == [2]


def test_status_kpis_is_one_scan(spark):
    t = S.rows(spark, S.TICKETS, [{"id": 1, "status": "approval"}])
    plan = _plan(R.status_kpis(t, "2024-01-01 00:00:00"))
    assert plan.count("Scan") == 1


def test_visibility_uses_no_nested_loop(spark):
    u = S.rows(spark, S.USERS, [{"id": 1, "role": "admin"}, {"id": 2, "role": "cs"}])
    n = S.rows(spark, S.NOTIFICATIONS, [{"id": 10, "user_id": 1, "role": "admin", "is_read": 0},
                                        {"id": 11, "role": "cs", "is_read": 0}, {"id": 12, "user_id": 2, "is_read": 1}])
    df = N.notification_visibility(n, u)
    assert "NestedLoop" not in _plan(df)
    assert sorted((r.viewer_id, r.id) for r in df.collect()) == [(1, 10), (2, 11), (2, 12)]
    assert sorted(tuple(r) for r in N.unread_counts(n, u).collect()) == [(1, 1), (2, 1)]


def test_retention_clock(spark):
    now = "2024-01-10 00:00:00"   # UTC clock; created_at is UTC+7 text
    n = S.rows(spark, S.NOTIFICATIONS, [
        {"id": 1, "is_read": 1, "created_at": "2024-01-06 23:59:59"},   # older than 3 days: purged
        {"id": 2, "is_read": 1, "created_at": "2024-01-07 00:00:01"},   # newer: kept
        {"id": 3, "is_read": 0, "created_at": "2023-01-01 00:00:00"},   # unread: kept
        {"id": 4, "is_read": 1, "created_at": "2024-01-07 06:59:59"},   # before the UTC+7 cut-off
        {"id": 5, "is_read": 1, "created_at": "2024-01-07 07:00:01"}])  # after both cut-offs: kept
    assert sorted(r.id for r in N.retention_purge(n, now, 3).collect()) == [2, 3, 4, 5]
    # 'local' cut-off is 2024-01-07 07:00:00: rows 2 and 4 go as well
    assert sorted(r.id for r in N.retention_purge(n, now, 3, clock="local").collect()) == [3, 5]
    once = N.retention_purge(n, now, 3)
    assert sorted(r.id for r in N.retention_purge(once, now, 3).collect()) == sorted(r.id for r in once.collect())


def test_key_join_salted_path_equals_broadcast(spark):
    from pyspark.sql import functions as F

    from helpdeck.operators.joins import key_join

    big = spark.range(0, 3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("role"))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("zz", 4)], "role string, viewer long")
    for how in ("inner", "left"):
        a = sorted(map(tuple, key_join(big, small, ["role"], how).select("id", "role", "viewer").collect()),
                   key=repr)
        b = sorted(map(tuple, key_join(big, small, ["role"], how, max_broadcast_rows=0, salt=8,
                                       salt_source=F.hash("id")).select("id", "role", "viewer").collect()), key=repr)
        assert a == b and len(a) > 0


def test_fanout_texts_are_built_before_the_join(spark):
    u = S.rows(spark, S.USERS, [{"id": 1, "role": "admin"}, {"id": 2, "role": "cs"}, {"id": 3, "role": "teknisi"}])
    t = S.rows(spark, S.TICKETS, [{"id": 5, "ticket_no": "SC-1"}])
    a = S.rows(spark, S.APPROVAL_LOGS, [{"id": 10, "ticket_id": 5, "action": "approve"}, {"id": 11, "ticket_id": 6, "action": "reject"}])
    df = N.notification_fanout(a, t, u)
    assert "concat" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert sorted((r.user_id, r.source_id, r.message, r.link) for r in df.collect()) == [
        (1, 10, "Ticket disetujui Management, silakan buat jadwal", "/admin/tickets/5"),
        (1, 11, "Ticket ditolak oleh Management", "/admin/tickets/6"),
        (2, 10, "Ticket SC-1 disetujui Management", "/admin/tickets/5"), (2, 11, "Ticket #6 ditolak Management", "/admin/tickets/6")]
