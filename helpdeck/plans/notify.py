"""Notification and delivery queries (SURVEY 2.3 C10/C11, 2.4 D13/D18, 2.5 E5/E7,
2.6 F2/F3, 2.9 I9/I10, 2.10 J2 batch) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpdeck.operators import delivery as D
from helpdeck.operators import notify as N
from helpdeck.plans.catalog import query, views
from helpdeck.plans.oracle_views import sql_changes
from helpdeck.session import scratch_path
from helpdeck.sources import dated as DT
from helpdeck.sources.fixtures import EVENT_NOW

EV_NOW_SQL = f"TIMESTAMP '{EVENT_NOW}'"
TS = "'%Y-%m-%d %H:%M:%S'"


@query("notification_visibility", """
SELECT u.id AS viewer_id, n.id, n.message, n.link, n.is_read, n.created_at
FROM notifications n JOIN users u ON n.user_id = u.id OR n.role = u.role
""")
def notification_visibility(spark, sf_dir):
    v = views(spark, sf_dir)
    return N.notification_visibility(v.notifications, v.users)


@query("unread_counts", """
SELECT u.id AS user_id, count(n.id) AS unread
FROM users u LEFT JOIN notifications n ON (n.user_id = u.id OR n.role = u.role) AND n.is_read = 0
GROUP BY u.id
""")
def unread_counts(spark, sf_dir):
    v = views(spark, sf_dir)
    return N.unread_counts(v.notifications, v.users)


@query("notification_inbox", """
SELECT * FROM (
  SELECT u.id AS viewer_id, n.id, n.message, n.link, n.is_read, n.created_at,
         CAST(row_number() OVER (PARTITION BY u.id ORDER BY n.created_at DESC, n.id DESC) AS INTEGER) AS rank
  FROM notifications n JOIN users u ON n.user_id = u.id OR n.role = u.role
) WHERE rank <= 10
""")
def notification_inbox(spark, sf_dir):
    v = views(spark, sf_dir)
    return N.notification_inbox(v.notifications, v.users, k=10)


@query("user_notifications", """
, addressed AS (SELECT u.id AS viewer_id, n.id AS nid FROM users u JOIN notifications n ON n.user_id = u.id
                UNION SELECT u.id, n.id FROM users u JOIN notifications n ON n.role = u.role),
ranked AS (SELECT viewer_id, id, message, link, is_read, created_at,
    row_number() OVER (PARTITION BY viewer_id ORDER BY is_read, created_at DESC, id DESC)::INTEGER AS rank
  FROM addressed JOIN notifications ON id = nid)
SELECT * FROM ranked WHERE rank <= 50
""")
def user_notifications(spark, sf_dir):
    v = views(spark, sf_dir)
    return N.user_notifications(v.notifications, v.users, k=50)


@query("role_inbox", """
SELECT * FROM notifications WHERE role = 'management'
ORDER BY is_read ASC, created_at DESC, id DESC LIMIT 50
""")
def role_inbox(spark, sf_dir):
    return N.role_inbox(views(spark, sf_dir).notifications, "management", k=50)


@query("notification_fanout", """
SELECT u.id AS user_id, al.id AS source_id, u.role,
       CASE WHEN al.action = 'reject' THEN
              CASE WHEN u.role = 'admin' THEN 'Ticket ditolak oleh Management'
                   ELSE 'Ticket ' || COALESCE(t.ticket_no, '#' || CAST(al.ticket_id AS VARCHAR)) || ' ditolak Management' END
            ELSE
              CASE WHEN u.role = 'admin' THEN 'Ticket disetujui Management, silakan buat jadwal'
                   ELSE 'Ticket ' || COALESCE(t.ticket_no, '#' || CAST(al.ticket_id AS VARCHAR)) || ' disetujui Management' END
       END AS message,
       '/admin/tickets/' || CAST(al.ticket_id AS VARCHAR) AS link
FROM approval_logs al LEFT JOIN tickets t ON al.ticket_id = t.id
JOIN users u ON u.role IN ('admin', 'cs')
WHERE al.action IN ('approve', 'reject')
""")
def notification_fanout(spark, sf_dir):
    v = views(spark, sf_dir)
    return N.notification_fanout(v.approval_logs, v.tickets, v.users)


def _readers(v):
    """Read-all requests: every user who has a 'view' activity (derived from the log)."""
    a = v.activity_log.filter(F.col("action") == "view").select("user_id")
    return a.join(v.users.select(F.col("id").alias("user_id"), "role"), "user_id")


@query("mark_read", """
, readers AS (SELECT u.id AS user_id, u.role FROM activity_log a JOIN users u ON a.user_id = u.id
              WHERE a.action = 'view')
SELECT n.id, n.user_id, n.role, n.message, n.link,
       CASE WHEN n.is_read = 0 AND (n.user_id IN (SELECT user_id FROM readers) OR n.role IN (SELECT role FROM readers))
            THEN 1 ELSE n.is_read END AS is_read,
       n.created_at
FROM notifications n
""")
def mark_read(spark, sf_dir):
    v = views(spark, sf_dir)
    return N.mark_read(v.notifications, readers=_readers(v))


@query("mark_read_role", """
SELECT id, user_id, role, message, link,
       CASE WHEN is_read = 0 AND role = 'management' THEN 1 ELSE is_read END AS is_read, created_at
FROM notifications
""")
def mark_read_role(spark, sf_dir):
    return N.mark_read(views(spark, sf_dir).notifications, roles=["management"])


@query("retention_purge", f"""
SELECT * FROM notifications
WHERE NOT (is_read = 1 AND created_at < strftime({EV_NOW_SQL} - INTERVAL 3 DAY, {TS}))
""")
def retention_purge(spark, sf_dir):
    return N.retention_purge(views(spark, sf_dir).notifications, EVENT_NOW, days=3)


@query("retention_purge_manual", f"""
SELECT * FROM notifications
WHERE NOT (is_read = 1 AND created_at < strftime({EV_NOW_SQL} - INTERVAL 7 DAY, {TS}))
""")
def retention_purge_manual(spark, sf_dir):
    return N.retention_purge(views(spark, sf_dir).notifications, EVENT_NOW, days=7)


def _by_day(spark, sf_dir):
    """The notifications written by day: base folder and schema."""
    n = views(spark, sf_dir).notifications
    base = scratch_path(spark, "notifications-by-day")
    DT.publish_by_day(n, base, DT.notification_day(), DT.unread())
    return base, n.schema


@query("retention_purge_by_day", f"""
SELECT * FROM notifications
WHERE NOT (is_read = 1 AND created_at < strftime({EV_NOW_SQL} - INTERVAL 3 DAY, {TS}))
""")
def retention_purge_by_day(spark, sf_dir):
    """I9 where only the touched days are read and written; the result is the table read back."""
    base, schema = _by_day(spark, sf_dir)
    DT.purge_by_day(spark, base, schema, EVENT_NOW, days=3)
    return DT.read_days(spark, base, schema, DT.manifest(spark, base))


@query("mark_read_by_day", """
, readers AS (SELECT DISTINCT u.id, u.role FROM activity_log a JOIN users u ON a.user_id = u.id WHERE a.action = 'view')
SELECT n.* REPLACE (if(is_read = 0 AND (list_contains((SELECT list(id) FROM readers), user_id)
                                        OR list_contains((SELECT list(role) FROM readers), role)), 1, is_read) AS is_read) FROM notifications n
""")
def mark_read_by_day(spark, sf_dir):
    """I10 where only the days with unread notifications are read and written."""
    base, schema = _by_day(spark, sf_dir)
    DT.mark_read_by_day(spark, base, schema, readers=_readers(views(spark, sf_dir)))
    return DT.read_days(spark, base, schema, DT.manifest(spark, base))


# ------------------------------------------------------------------ delivery
_DIALLED = """
, digits AS (SELECT *, regexp_replace(address, '[^0-9]', '', 'g') AS dg FROM deliveries),
dialled AS (SELECT id, ts, message, ok, dg LIKE '0%' OR dg LIKE '62%' AS is_phone,
              CASE WHEN dg LIKE '0%' THEN '62' || substr(dg, 2) WHEN dg LIKE '62%' THEN dg ELSE address END AS address
            FROM digits)
"""
_OUTCOME = _DIALLED + f"""
, outcome AS (
  SELECT address, message, count(*) AS attempts, count_if(ok = 1) > 0 AS delivered,
         strftime(min(ts), {TS}) AS first_at, strftime(max(ts), {TS}) AS last_at
  FROM dialled GROUP BY address, message)
"""


@query("delivery_outcome", _OUTCOME + "SELECT * FROM outcome")
def delivery_outcome(spark, sf_dir):
    return D.delivery_outcome(views(spark, sf_dir).deliveries)


@query("delivery_summary", _OUTCOME + """
SELECT substr(first_at, 1, 10) AS day, CAST(count_if(delivered) AS BIGINT) AS ok,
       CAST(count_if(NOT delivered) AS BIGINT) AS failed, count(*) AS total
FROM outcome GROUP BY substr(first_at, 1, 10)
""")
def delivery_summary(spark, sf_dir):
    return D.delivery_summary(D.delivery_outcome(views(spark, sf_dir).deliveries))


# the oracle keeps each message's list and applies its attempts one by one
@query("dead_letter", _DIALLED + f"""
, steps AS (SELECT *, address || chr(10) || message AS k, row_number() OVER (ORDER BY ts, id) AS n FROM dialled WHERE is_phone),
list_after AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, k VARCHAR)[]) AS entries
  UNION ALL
  SELECT n, CASE WHEN ok <> 1 THEN list_prepend({{'id': id, 'k': k}}, entries)[1:50] WHEN pos IS NULL OR pos = 0 THEN entries
                 ELSE list_concat(entries[1:pos - 1], entries[pos + 1:]) END
  FROM (SELECT s.n, s.ok, s.id, s.k, l.entries, list_position(list_transform(l.entries, lambda e: e.k), s.k) AS pos
        FROM list_after l JOIN steps s ON s.n = l.n + 1)),
kept AS (SELECT unnest(entries).id AS id FROM list_after QUALIFY n = max(n) OVER ())
SELECT id, address, message, strftime(ts, {TS}) AS failed_at FROM dialled JOIN kept USING (id)
ORDER BY ts DESC, id DESC
""", builder=lambda body: sql_changes(body, recursive=True))
def dead_letter(spark, sf_dir):
    return D.dead_letter(views(spark, sf_dir).deliveries)


_PERIOD_START = f"strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(period * 900), {TS})"


@query("burst_failures", f"""
, bp AS (SELECT *, CAST(floor(epoch(ts) / 900) AS BIGINT) AS period FROM attempts),
bq AS (SELECT *, COALESCE(sum(ok) OVER (PARTITION BY address, period ORDER BY ts, id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM bp),
br AS (SELECT *, row_number() OVER (PARTITION BY address, period, grp ORDER BY ts, id) AS pos FROM bq)
SELECT address, {_PERIOD_START} AS period_start, CAST(least(max(pos), 10) AS BIGINT) AS n,
       strftime(min(CASE WHEN pos = 10 THEN ts END), {TS}) AS tenth_at
FROM br WHERE ok <> 1 GROUP BY address, period
HAVING min(CASE WHEN pos = 10 THEN ts END) IS NOT NULL
""")
def burst_failures(spark, sf_dir):
    return D.burst_failures(views(spark, sf_dir).attempts)


@query("burst_failures_simple", f"""
SELECT address, {_PERIOD_START} AS period_start, count(*) AS failures
FROM (SELECT *, CAST(floor(epoch(ts) / 900) AS BIGINT) AS period FROM attempts WHERE ok <> 1)
GROUP BY address, period HAVING count(*) >= 10
""")
def burst_failures_simple(spark, sf_dir):
    return D.burst_failures_simple(views(spark, sf_dir).attempts)


@query("mark_read_ids", """
SELECT id, user_id, role, message, link,
       CASE WHEN is_read = 0 AND id IN (SELECT id FROM activity_log WHERE action = 'click') THEN 1 ELSE is_read END
         AS is_read,
       created_at
FROM notifications
""")
def mark_read_ids(spark, sf_dir):
    """I10 read marks by notification id (one per 'click' activity)."""
    v = views(spark, sf_dir)
    ids = v.activity_log.filter(F.col("action") == "click").select("id")
    return N.mark_read(v.notifications, read_ids=ids)
