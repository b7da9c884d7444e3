"""The FIXTURES.md ticket views as a DuckDB CTE prefix (mirror of
``helpdeck.sources.fixtures``). Oracle SQL is ``VIEWS + body``; a body may
start with ``, name AS (...)`` to add its own CTEs before its SELECT.
"""

from __future__ import annotations

_PAD6 = "CASE WHEN {k} < 1000000 THEN lpad(CAST({k} AS VARCHAR), 6, '0') ELSE CAST({k} AS VARCHAR) END"


def _role(x: str) -> str:
    return (f"CASE {x} % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'management' "
            f"WHEN 2 THEN 'teknisi' ELSE 'cs' END")


VIEWS = f"""
WITH first_line AS (
  SELECT l_orderkey, min(l_partkey) AS pk, min(l_suppkey) AS sk, max(l_linenumber) AS mx,
         min(l_shipdate) AS ship
  FROM lineitem GROUP BY l_orderkey
),
products AS (
  SELECT p_partkey AS id, 'P' || CAST(p_partkey AS VARCHAR) AS kode_barang, p_name AS nama_produk,
         p_type AS tipe, p_size AS garansi_bulan, '2000-01-01 00:00:00' AS created_at
  FROM part
),
users AS (
  SELECT s_suppkey AS id, 'u' || CAST(s_suppkey AS VARCHAR) AS username, s_name AS name,
         {_role('s_suppkey')} AS role,
         CASE s_suppkey % 5 WHEN 0 THEN '0812-' || CAST(s_suppkey AS VARCHAR)
                            WHEN 1 THEN '+62 813 ' || CAST(s_suppkey % 10 AS VARCHAR)
                            WHEN 2 THEN ''
                            WHEN 3 THEN NULL
                            ELSE '8' || CAST(s_suppkey AS VARCHAR) END AS phone,
         'u' || CAST(s_suppkey AS VARCHAR) || '@example.org' AS email,
         CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 1 END AS active,
         '2000-01-01 00:00:00' AS created_at
  FROM supplier
),
t_base AS (
  SELECT o.*, c.*, n.*, fl.*,
         o.o_orderkey AS k,
         o.o_orderdate + to_hours(CAST(o.o_orderkey % 24 AS INTEGER)) AS created_ts,
         CASE WHEN o.o_orderkey % 20 = 0 THEN NULL
              WHEN o.o_orderkey % 21 = 0 THEN -fl.pk - 1
              ELSE fl.pk END AS pid
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN first_line fl ON o.o_orderkey = fl.l_orderkey
),
t_base2 AS (
  SELECT *,
         CASE WHEN k % 6 = 4 AND k % 5 <> 0
              THEN strftime(created_ts + to_days(CAST(k % 15 AS INTEGER)), '%Y-%m-%d %H:%M:%S') END AS closed_txt,
         CASE WHEN k % 6 IN (2, 3, 4)
              THEN strftime(created_ts + to_days(1), '%Y-%m-%d %H:%M:%S') END AS approved_txt
  FROM t_base
),
tickets AS (
  SELECT k AS id,
         'SC-' || CAST(year(o_orderdate) AS VARCHAR) || '-' || {_PAD6.format(k='k')} AS ticket_no,
         k % 100 AS created_by,
         pid AS product_id,
         'P' || CAST(pid AS VARCHAR) AS kode_barang,
         strftime(o_orderdate, '%d/%m/%Y') AS tanggal_complaint,
         c_name AS customer_name,
         '0812' || CAST(c_custkey AS VARCHAR) AS customer_hp,
         CASE WHEN k % 8 <> 0 THEN 'Jl. ' || CAST(c_custkey AS VARCHAR) END AS customer_alamat,
         n_name AS customer_kota,
         CASE WHEN k % 9 = 0 THEN NULL WHEN k % 11 = 0 THEN '' ELSE c_mktsegment END AS marketplace,
         CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN NULL ELSE 'Toko ' || n_name END AS toko,
         'SN-' || CAST(k AS VARCHAR) AS serial_number,
         o_orderpriority AS keluhan,
         CASE k % 6 WHEN 0 THEN 'waiting' WHEN 1 THEN 'approval' WHEN 2 THEN 'scheduled'
                    WHEN 3 THEN 'on_progress' WHEN 4 THEN 'completed' ELSE 'rejected' END AS status,
         CASE WHEN k % 6 <> 0 THEN 'Analisa ' || CAST(k AS VARCHAR) END AS admin_analysis,
         CASE WHEN k % 6 IN (2, 3, 4) THEN 'Servis' WHEN k % 6 = 5 THEN 'reject' END AS management_decision,
         CASE WHEN k % 6 IN (2, 3, 4, 5) THEN 'ok ' || CAST(k AS VARCHAR) END AS management_comment,
         CASE WHEN k % 6 IN (2, 3, 4) THEN CAST(1 AS BIGINT) END AS approved_by,
         approved_txt AS approved_at,
         CASE WHEN closed_txt IS NOT NULL THEN CAST(1 AS BIGINT) END AS closed_by,
         closed_txt AS closed_at,
         CAST(k % 3 AS INTEGER) AS follow_up_count,
         strftime(created_ts, '%Y-%m-%d %H:%M:%S') AS created_at,
         coalesce(closed_txt, approved_txt, strftime(created_ts, '%Y-%m-%d %H:%M:%S')) AS updated_at
  FROM t_base2
),
schedules AS (
  SELECT l_orderkey AS id, l_orderkey AS ticket_id, sk - sk % 4 + 2 AS teknisi_id,
         CASE WHEN l_orderkey % 10 = 0 THEN strftime(ship, '%Y-%m-%d') ELSE strftime(ship, '%d/%m/%Y') END AS tanggal,
         lpad(CAST(8 + l_orderkey % 8 AS VARCHAR), 2, '0') || ':00' AS jam,
         CAST(NULL AS VARCHAR) AS notes, CAST(1 AS BIGINT) AS created_by,
         strftime(ship, '%Y-%m-%d %H:%M:%S') AS created_at
  FROM first_line WHERE l_orderkey % 6 IN (2, 3, 4)
  UNION ALL
  SELECT l_orderkey + 10000000, l_orderkey, CAST(2 AS BIGINT), strftime(ship, '%d/%m/%Y'), '16:00',
         CAST(NULL AS VARCHAR), CAST(1 AS BIGINT), strftime(ship, '%Y-%m-%d %H:%M:%S')
  FROM first_line WHERE l_orderkey % 60 = 4
),
visit_results AS (
  SELECT l_orderkey AS id, l_orderkey AS ticket_id, sk - sk % 4 + 2 AS teknisi_id,
         strftime(ship, '%d/%m/%Y') AS tanggal, '10:00' AS jam,
         'Cek ' || CAST(l_orderkey AS VARCHAR) AS hasil_pemeriksaan,
         CASE mx WHEN 1 THEN 'Servis' WHEN 2 THEN 'Ganti Sparepart' WHEN 3 THEN 'Ganti Unit'
                 WHEN 4 THEN 'Butuh Sparepart (Follow-up)' WHEN 5 THEN 'Ganti Baru (Follow-up)'
                 ELSE 'Tidak Bisa Diperbaiki' END AS solusi,
         CAST(NULL AS VARCHAR) AS sparepart,
         strftime(ship, '%d/%m/%Y') AS tanggal_selesai,
         CASE WHEN l_orderkey % 4 = 0 THEN 'sebelum' || CAST(l_orderkey AS VARCHAR) || '.jpg' END AS foto_sebelum_path,
         CASE WHEN l_orderkey % 5 < 2 THEN 'https://cdn.example/' || CAST(l_orderkey AS VARCHAR) || '.png' END AS foto_sesudah_path,
         CASE WHEN l_orderkey % 8 = 3 THEN 'v' || CAST(l_orderkey AS VARCHAR) || '.tar.mp4' END AS video_path,
         strftime(ship, '%Y-%m-%d %H:%M:%S') AS created_at
  FROM first_line WHERE l_orderkey % 6 = 4 OR l_orderkey % 12 = 3
),
notifications AS (
  SELECT event_id AS id,
         CASE WHEN event_id % 3 <> 0 THEN user_id % 100 END AS user_id,
         CASE WHEN event_id % 3 = 0 THEN {_role('event_id')} END AS role,
         'msg ' || event_type AS message,
         '/admin/tickets/' || CAST(event_id % 200 AS VARCHAR) AS link,
         CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS is_read,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at
  FROM events
),
approval_logs AS (
  SELECT event_id AS id, user_id AS ticket_id,
         CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'reset' END AS action,
         CASE event_type WHEN 'purchase' THEN 'Servis' WHEN 'error' THEN 'reject' END AS decision,
         'komentar ' || CAST(event_id AS VARCHAR) AS comment,
         CASE WHEN event_type = 'signup' THEN 'rejected' ELSE 'approval' END AS old_status,
         CASE event_type WHEN 'purchase' THEN 'waiting' WHEN 'error' THEN 'rejected' ELSE 'approval' END AS new_status,
         event_id % 100 AS user_id,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at
  FROM events WHERE event_type IN ('purchase', 'error', 'signup')
),
attempts AS (
  SELECT event_id AS id, ts, user_id AS address, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS ok
  FROM events WHERE event_type IN ('purchase', 'error')
),
deliveries AS (
  SELECT event_id AS id, ts,
         CASE WHEN user_id % 10 = 3 THEN 'ext ' || CAST(user_id AS VARCHAR)
              WHEN event_id % 4 < 2 THEN '0812' || CAST(user_id AS VARCHAR)
              ELSE '+62 812-' || CAST(user_id AS VARCHAR) END AS address,
         'Ticket ' || CAST(event_id % 3 AS VARCHAR) AS message,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS ok
  FROM events WHERE event_type IN ('purchase', 'error')
),
activity_log AS (
  SELECT event_id AS id, user_id AS ticket_id, event_id % 100 AS user_id, event_type AS action,
         'desc ' || CAST(event_id AS VARCHAR) AS description,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at
  FROM events
),
debug_logs AS (
  SELECT event_id AS id,
         event_type || CASE WHEN event_id % 2 = 0 THEN '_start' ELSE '_end' END AS type,
         'log ' || CAST(event_id AS VARCHAR) AS message, CASE event_id % 4 WHEN 0 THEN props
            WHEN 1 THEN '{{"body": ' || props || ', "session": ' || CAST(event_id % 100 AS VARCHAR) || '}}'
            WHEN 2 THEN 'phone=0812 error=' || CAST(event_id AS VARCHAR) END AS detail,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at
  FROM events
),
service_vouchers AS (
  SELECT t.id, 'BRC-' || {_PAD6.format(k='t.id')} AS voucher_no, t.id AS ticket_id,
         t.customer_name, t.customer_hp, t.customer_alamat, p.nama_produk AS product_name, p.tipe AS product_type,
         t.serial_number, t.keluhan, t.management_decision AS decision,
         CASE WHEN t.id % 24 = 4 THEN 'active' ELSE 'used' END AS status,
         sha256('tok' || CAST(t.id AS VARCHAR)) AS qr_token,
         CAST(1 AS BIGINT) AS created_by,
         coalesce(t.closed_at, t.created_at) AS created_at,
         strftime(CAST(substr(t.created_at, 1, 10) AS DATE) + 30, '%Y-%m-%d') AS expired_at
  FROM tickets t LEFT JOIN products p ON t.product_id = p.id
  WHERE t.id % 12 = 4
),
settings AS (
  SELECT 'kota_' || CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation
)
"""


def sql(body: str) -> str:
    """Oracle SQL: the view prefix followed by ``body``."""
    return VIEWS + body

CHANGE_VIEWS = """
, changes AS (
  SELECT event_id AS seq, CASE WHEN event_id % 17 = 0 THEN -1 - user_id ELSE user_id END AS ticket_id,
         ['analysis', 'followup', 'schedule', 'calendar_schedule', 'cancel_schedule', 'approve', 'reject',
          'reset', 'start_visit', 'visit_result', 'close'][CAST(event_id % 11 AS INTEGER) + 1] AS kind,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id % 100 AS user_id,
         CASE WHEN event_type <> 'error' THEN 'catatan ' || CAST(event_id AS VARCHAR) END AS text,
         CASE WHEN event_id % 11 = 5 THEN CASE WHEN event_type = 'view' THEN 'Lainnya'
                                              WHEN event_id % 2 = 0 THEN 'Servis' ELSE 'Ganti Unit' END
              WHEN event_id % 11 = 6 THEN 'reject' END AS decision,
         CASE WHEN event_type <> 'error' THEN user_id - user_id % 4 + 2 END AS teknisi_id,
         strftime(ts, '%d/%m/%Y') AS tanggal, strftime(ts, '%H:%M') AS jam,
         CASE WHEN event_type = 'click' THEN '' ELSE 'hasil ' || CAST(event_id AS VARCHAR) END AS findings,
         ['Servis', 'Ganti Sparepart', 'Ganti Unit', 'Butuh Sparepart (Follow-up)', 'Ganti Baru (Follow-up)',
          'Tidak Bisa Diperbaiki'][CAST(event_id % 6 AS INTEGER) + 1] AS solusi
  FROM events
),
intake_raw AS (
  SELECT c_custkey AS intake_key,
         CASE WHEN c_custkey % 13 = 0 THEN '   ' ELSE '  ' || c_name || chr(9) END AS customer_name,
         '0812' || CAST(c_custkey AS VARCHAR) AS customer_hp, n_name AS customer_kota,
         c_mktsegment AS marketplace, CAST(NULL AS VARCHAR) AS toko,
         'SN-C' || CAST(c_custkey AS VARCHAR) AS serial_number, 'Keluhan ' || c_mktsegment AS keluhan,
         CAST(NULL AS VARCHAR) AS kode_barang, CAST(NULL AS BIGINT) AS product_id, c_custkey % 100 AS created_by,
         ' Jl. ' || c_name AS customer_alamat, ' c' || CAST(c_custkey AS VARCHAR) || '@mail ' AS customer_email,
         lower(n_name) AS customer_provinsi, 'INV-' || CAST(c_custkey AS VARCHAR) AS nomor_invoice,
         CASE WHEN c_custkey % 2 = 0 THEN '/uploads/f' || CAST(c_custkey AS VARCHAR) END AS faktur_path,
         CASE WHEN c_custkey % 3 = 0 THEN '/uploads/p' || CAST(c_custkey AS VARCHAR) END AS foto_produk_path,
         CASE WHEN c_custkey % 5 = 0 THEN '/uploads/v' || CAST(c_custkey AS VARCHAR) END AS video_path,
         CASE WHEN c_custkey % 7 = 0 THEN '/uploads/k' || CAST(c_custkey AS VARCHAR) END AS foto_kerusakan_path,
         CASE WHEN c_custkey % 11 = 0 THEN 'OWN-' || CAST(c_custkey AS VARCHAR) WHEN c_custkey % 11 = 1 THEN ''
              WHEN c_custkey % 29 = 5 THEN 'SC-2001-' || lpad(CAST(c_custkey * 3 AS VARCHAR), 6, '0') WHEN c_custkey % 97 = 3 THEN 'SC-2001-none'
              WHEN c_custkey % 53 = 7 THEN 'sc-2001- +' || CAST(c_custkey AS VARCHAR) || 'x-y' WHEN c_custkey % 61 = 9 THEN 'SC-1999-000500' END AS ticket_no,
         '' AS tanggal_complaint,
         '2001-07-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS tanggal_pembelian
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
product_sheet AS (
  SELECT p_partkey + 1 AS row_no,
         CASE WHEN p_partkey % 3 = 0 THEN 'P' || CAST(p_partkey % 1500 AS VARCHAR) ELSE '' END AS "Kode Barang",
         CASE WHEN p_partkey % 3 = 1 THEN ' P' || CAST(p_partkey % 1500 AS VARCHAR) || ' '
              WHEN p_partkey % 3 = 2 THEN 'N' || CAST(p_partkey AS VARCHAR) END AS kode_barang,
         CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS "Nama Produk",
         CASE WHEN p_partkey % 14 = 0 THEN p_brand END AS "NAMA_PRODUK",
         p_type AS "Tipe", CAST(p_size AS VARCHAR) || '.5 bulan' AS "Garansi"
  FROM part
),
schedule_requests AS (
  SELECT id AS seq, ticket_id, CASE WHEN user_id % 10 <> 0 THEN user_id - user_id % 4 + 2 END AS teknisi_id,
         substr(created_at, 1, 10) AS tanggal, substr(created_at, 12, 5) AS jam, description AS notes,
         user_id, created_at AS ts
  FROM activity_log WHERE action = 'click'
),
visit_reports AS (
  SELECT id AS seq, ticket_id, user_id AS teknisi_id,
         CASE WHEN id % 5 = 0 THEN '' ELSE 'temuan ' || CAST(id AS VARCHAR) END AS findings,
         ['Servis', 'Ganti Sparepart', 'Ganti Unit', 'Butuh Sparepart (Follow-up)', 'Ganti Baru (Follow-up)',
          'Tidak Bisa Diperbaiki'][CAST(id % 6 AS INTEGER) + 1] AS solusi,
         CAST(NULL AS VARCHAR) AS sparepart,
         CASE WHEN id % 2 = 0 THEN substr(created_at, 1, 10) ELSE '' END AS tanggal_selesai,
         substr(created_at, 12, 5) AS jam,
         CASE WHEN id % 4 = 0 THEN 'rs' || CAST(id AS VARCHAR) END AS foto_sebelum_path,
         CASE WHEN id % 3 = 1 THEN 'rt' || CAST(id AS VARCHAR) END AS foto_sesudah_path,
         CASE WHEN id % 7 = 0 THEN 'rv' || CAST(id AS VARCHAR) END AS video_path
  FROM activity_log WHERE action = 'signup'
),
setting_writes AS (
  SELECT 'kota_' || CAST(r_regionkey AS VARCHAR) AS key, r_name AS value, CAST(r_regionkey AS BIGINT) AS seq
  FROM region
),
product_edits AS (SELECT pk AS id, l_orderkey AS seq, 'T' || CAST(mx AS VARCHAR) AS tipe FROM first_line),
toggle_requests AS (SELECT id AS seq, user_id FROM activity_log WHERE action = 'error'),
delete_requests AS (SELECT id AS seq, user_id FROM approval_logs WHERE action = 'reset'),
user_log AS (
  SELECT id AS seq, CASE action WHEN 'approve' THEN 'create' WHEN 'reject' THEN 'edit' ELSE 'delete' END AS kind,
         CASE WHEN id % 3 = 0 THEN (SELECT max(id) FROM users) + id % 50 ELSE id % 40 + 1 END AS user_id,
         CASE WHEN id % 23 <> 0 THEN CASE WHEN id % 2 = 0 THEN 'u' ELSE 'n' END || CAST((id // 7) % 60 AS VARCHAR) END AS username, 'p' AS password,
         CASE WHEN id % 19 <> 0 THEN 'N' || CAST(id AS VARCHAR) END AS name,
         ['admin', 'management', 'teknisi', 'cs', 'boss', 'cs', 'teknisi'][CAST(id % 7 AS INTEGER) + 1] AS role,
         CASE WHEN id % 5 <> 0 THEN '08' || CAST(id AS VARCHAR) END AS phone, CAST(NULL AS VARCHAR) AS email
  FROM approval_logs
)
"""


def sql_changes(body: str, recursive: bool = False) -> str:
    """Oracle SQL with the fixture views and the change batches."""
    text = VIEWS + CHANGE_VIEWS + body
    if recursive:
        text = text.replace("WITH first_line AS", "WITH RECURSIVE first_line AS", 1)
    return text
