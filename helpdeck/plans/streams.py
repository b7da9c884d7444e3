"""Streaming queries and their batch twins.

A stream key and its batch twin share one oracle: drained with
``availableNow``, the stream's current table must equal the batch result.
"""

from __future__ import annotations

from helpdeck.plans.catalog import query, views
from helpdeck.plans.oracle_views import sql
from helpdeck.streaming import streams as S

_UNREAD = """
SELECT recipient, CAST(sum(1 - is_read) AS BIGINT) AS unread FROM (
  SELECT 'user:' || CAST(user_id AS VARCHAR) AS recipient, is_read FROM notifications WHERE user_id IS NOT NULL
  UNION ALL
  SELECT 'role:' || role, is_read FROM notifications WHERE role IS NOT NULL)
GROUP BY recipient
"""
_LATEST = """
SELECT ticket_id, new_status AS status, created_at AS changed_at, id AS log_id FROM (
  SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, id DESC) AS rn FROM approval_logs)
WHERE rn = 1
"""
_BURSTS = """
SELECT address, strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(period * 900), '%Y-%m-%d %H:%M:%S')
         AS period_start, count(*) AS failures
FROM (SELECT *, CAST(floor(epoch(ts) / 900) AS BIGINT) AS period FROM attempts WHERE ok <> 1)
GROUP BY address, period HAVING count(*) >= 10
"""


@query("unread_by_recipient", _UNREAD)
def unread_by_recipient(spark, sf_dir):
    return S.unread_by_recipient(views(spark, sf_dir).notifications)


@query("stream_unread", _UNREAD)
def stream_unread(spark, sf_dir):
    return S.stream_unread(spark, sf_dir)


_USER_UNREAD = """
SELECT u.id AS user_id, (SELECT count(*) FROM notifications n WHERE n.is_read = 0 AND (n.user_id = u.id OR n.role = u.role)) AS unread
FROM users u
"""


@query("stream_unread_counts", _USER_UNREAD)
def stream_unread_counts(spark, sf_dir):
    return S.stream_unread_counts(spark, sf_dir, views(spark, sf_dir).users)


@query("latest_status", _LATEST)
def latest_status(spark, sf_dir):
    return S.latest_status(views(spark, sf_dir).approval_logs)


@query("stream_latest_status", _LATEST)
def stream_latest_status(spark, sf_dir):
    return S.stream_latest_status(spark, sf_dir)


@query("stream_burst_failures", _BURSTS)
def stream_burst_failures(spark, sf_dir):
    return S.stream_burst_failures(spark, sf_dir)


_BLOCKS = """
, lim AS (SELECT address, CAST(floor(epoch(ts) / 900) AS BIGINT) AS period, ts, ok,
             row_number() OVER (PARTITION BY address, floor(epoch(ts) / 900) ORDER BY ts, id) AS k FROM attempts),
walk AS (SELECT address, period, k, CASE WHEN ok = 1 THEN 0 ELSE 1 END AS run, CASE WHEN ok <> 1 THEN 1 ELSE 0 END AS top, CAST(NULL AS TIMESTAMP) AS hit
      FROM lim WHERE k = 1
      UNION ALL
      SELECT t.address, t.period, t.k, CASE WHEN w.hit IS NOT NULL THEN w.run WHEN t.ok = 1 THEN 0 ELSE w.run + 1 END,
             CASE WHEN w.hit IS NOT NULL OR t.ok = 1 THEN w.top ELSE greatest(w.top, w.run + 1) END,
             CASE WHEN w.hit IS NOT NULL THEN w.hit WHEN t.ok <> 1 AND w.run + 1 = 10 THEN t.ts END
      FROM walk w JOIN lim t ON t.address = w.address AND t.period = w.period AND t.k = w.k + 1)
SELECT address, strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(period * 900), '%Y-%m-%d %H:%M:%S') AS period_start,
       CAST(max(top) AS BIGINT) AS n, strftime(max(hit), '%Y-%m-%d %H:%M:%S') AS tenth_at
FROM walk GROUP BY address, period HAVING max(hit) IS NOT NULL
"""


@query("stream_login_blocks", _BLOCKS, builder=lambda body: sql(body).replace("WITH first_line AS", "WITH RECURSIVE first_line AS", 1))
def stream_login_blocks(spark, sf_dir):
    return S.stream_login_blocks(spark, sf_dir)
