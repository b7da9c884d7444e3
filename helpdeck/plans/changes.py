"""Change-application queries
with their DuckDB oracles.

The oracle for the ordered transitions is a recursive CTE that replays every
ticket's changes one at a time - the sequential definition the distributed
tree scan must equal.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from helpdeck.functions.labels import FOLLOWUP_MESSAGES
from helpdeck.operators import changes as CH
from helpdeck.operators import users as U
from helpdeck.plans.catalog import query, views
from helpdeck.plans.oracle_views import sql_changes
from helpdeck.sources.fixtures import TICKET_NOW, ChangeBatches


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _b(spark, sf_dir):
    v = views(spark, sf_dir)
    return v, ChangeBatches(v)


_KINDS = ", ".join(_q(k) for k in CH.TRANSITION_KINDS)
_FU = ", ".join(_q(k) for k in FOLLOWUP_MESSAGES)
_NEW_STATUS = ("CASE z.ekind WHEN 'analysis' THEN 'approval' WHEN 'followup' THEN 'approval' "
               "WHEN 'schedule' THEN 'scheduled' WHEN 'calendar_schedule' THEN 'scheduled' "
               "WHEN 'cancel_schedule' THEN 'waiting' WHEN 'approve' THEN 'waiting' WHEN 'reject' THEN 'rejected' "
               "WHEN 'reset' THEN 'approval' WHEN 'start_visit' THEN 'on_progress' "
               "WHEN 'visit_result' THEN 'on_progress' WHEN 'close' THEN 'completed' END")


def _replay(change_filter: str = "TRUE") -> str:
    """Recursive replay CTEs: ``cv`` (numbered, validated changes) and ``st``
    (ticket state after each change, with the change's outcome)."""
    return f"""
, cj AS (SELECT c.*, row_number() OVER (PARTITION BY c.ticket_id ORDER BY c.seq) AS n
         FROM changes c WHERE {change_filter}),
cv AS (SELECT *,
         CASE WHEN kind IN ('schedule', 'calendar_schedule')
                THEN teknisi_id IS NOT NULL AND COALESCE(tanggal <> '', false)
                     AND COALESCE(jam <> '', false)
              WHEN kind = 'approve' THEN COALESCE(decision IN ('Servis', 'Ganti Unit'), false)
              WHEN kind = 'visit_result' THEN COALESCE(findings <> '', false)
              ELSE kind IN ({_KINDS}) END AS valid,
         kind = 'followup' OR (kind = 'visit_result' AND COALESCE(solusi IN ({_FU}), false)) AS inc_kind
       FROM cj),
st AS (
  SELECT t.id AS ticket_id, CAST(0 AS BIGINT) AS n, t.status, t.admin_analysis, t.management_decision,
         t.management_comment, t.approved_by, t.approved_at, t.closed_by, t.closed_at,
         CAST(COALESCE(t.follow_up_count, 0) AS BIGINT) AS cnt, t.updated_at,
         CAST(NULL AS BOOLEAN) AS applies, CAST(NULL AS VARCHAR) AS status_before, CAST(NULL AS BIGINT) AS cnt_before
  FROM tickets t WHERE t.id IN (SELECT ticket_id FROM cj)
  UNION ALL
  SELECT z.ticket_id, z.n + 1,
    CASE WHEN z.ap THEN {_NEW_STATUS} ELSE z.status END,
    CASE WHEN z.ap AND z.ekind = 'analysis' THEN z.etext
         WHEN z.ap AND z.ekind = 'followup' THEN COALESCE(z.admin_analysis, '') || chr(10) || '[Follow-up #'
              || CAST(z.cnt + 1 AS VARCHAR) || '] ' || COALESCE(NULLIF(z.etext, ''), {_q(CH.DEFAULT_FOLLOWUP_NOTE)})
         ELSE z.admin_analysis END,
    CASE WHEN z.ap AND z.ekind = 'approve' THEN z.edec WHEN z.ap AND z.ekind = 'reject' THEN 'reject'
         WHEN z.ap AND z.ekind = 'reset' THEN NULL ELSE z.management_decision END,
    CASE WHEN z.ap AND z.ekind IN ('approve', 'reject') THEN COALESCE(z.etext, '')
         WHEN z.ap AND z.ekind = 'reset' THEN NULL ELSE z.management_comment END,
    CASE WHEN z.ap AND z.ekind = 'approve' THEN z.euser WHEN z.ap AND z.ekind = 'reset' THEN NULL ELSE z.approved_by END,
    CASE WHEN z.ap AND z.ekind = 'approve' THEN z.ets WHEN z.ap AND z.ekind = 'reset' THEN NULL ELSE z.approved_at END,
    CASE WHEN z.ap AND z.ekind = 'close' THEN z.euser ELSE z.closed_by END,
    CASE WHEN z.ap AND z.ekind = 'close' THEN z.ets ELSE z.closed_at END,
    z.cnt + CASE WHEN z.evalid AND z.inc_kind THEN 1 ELSE 0 END,
    CASE WHEN z.ap THEN z.ets ELSE z.updated_at END,
    z.ap, z.status, z.cnt
  FROM (SELECT s.*, e.kind AS ekind, e.text AS etext, e.decision AS edec, e.user_id AS euser, e.ts AS ets,
               e.valid AS evalid, e.inc_kind,
               e.valid AND CASE e.kind WHEN 'reset' THEN COALESCE(s.status IN ('waiting', 'rejected'), false)
                                       WHEN 'calendar_schedule' THEN COALESCE(s.status IN ('waiting', 'approval'), false)
                                       ELSE true END AS ap
        FROM st s JOIN cv e ON e.ticket_id = s.ticket_id AND e.n = s.n + 1) z
),
unknown AS (SELECT * FROM cv WHERE valid AND kind NOT IN ('followup', 'reset') AND ticket_id NOT IN (SELECT id FROM tickets)),
fin AS (SELECT * FROM st QUALIFY n = max(n) OVER (PARTITION BY ticket_id))
"""


_FINAL_TICKETS = """
SELECT t.* REPLACE (
  CASE WHEN f.ticket_id IS NULL THEN t.status ELSE f.status END AS status,
  CASE WHEN f.ticket_id IS NULL THEN t.admin_analysis ELSE f.admin_analysis END AS admin_analysis,
  CASE WHEN f.ticket_id IS NULL THEN t.management_decision ELSE f.management_decision END AS management_decision,
  CASE WHEN f.ticket_id IS NULL THEN t.management_comment ELSE f.management_comment END AS management_comment,
  CASE WHEN f.ticket_id IS NULL THEN t.approved_by ELSE f.approved_by END AS approved_by,
  CASE WHEN f.ticket_id IS NULL THEN t.approved_at ELSE f.approved_at END AS approved_at,
  CASE WHEN f.ticket_id IS NULL THEN t.closed_by ELSE f.closed_by END AS closed_by,
  CASE WHEN f.ticket_id IS NULL THEN t.closed_at ELSE f.closed_at END AS closed_at,
  CAST(CASE WHEN f.ticket_id IS NULL THEN t.follow_up_count ELSE f.cnt END AS INTEGER) AS follow_up_count,
  CASE WHEN f.ticket_id IS NULL THEN t.updated_at ELSE f.updated_at END AS updated_at)
FROM tickets t LEFT JOIN fin f ON f.ticket_id = t.id
"""


def _rec(body: str) -> str:
    return sql_changes(body, recursive=True)


@query("apply_transitions", _replay() + _FINAL_TICKETS, builder=_rec)
def apply_transitions(spark, sf_dir):
    v, b = _b(spark, sf_dir)
    return CH.apply_transitions(v.tickets, b.changes)


@query("followup_apply", _replay("c.kind = 'followup'") + """
SELECT f.ticket_id AS id, f.status, CAST(f.cnt AS INTEGER) AS follow_up_count, f.admin_analysis, f.updated_at
FROM fin f
""", builder=_rec)
def followup_apply(spark, sf_dir):
    v, b = _b(spark, sf_dir)
    return CH.followup_apply(v.tickets, b.changes)


_FU_CASE = " ".join(f"WHEN {_q(k)} THEN {_q(m)}" for k, m in FOLLOWUP_MESSAGES.items())


@query("emit_events", _replay() + f"""
, ev AS (SELECT s.status AS status_after, s.status_before, s.cnt_before, s.applies, e.*
         FROM st s JOIN cv e ON e.ticket_id = s.ticket_id AND e.n = s.n WHERE s.n > 0
         UNION ALL
         SELECT CASE kind WHEN 'approve' THEN 'waiting' WHEN 'reject' THEN 'rejected' END, NULL, NULL, true, unknown.* FROM unknown)
SELECT 'activity_log' AS target, seq, ticket_id, user_id,
  CASE kind WHEN 'analysis' THEN 'send_approval' WHEN 'followup' THEN 'send_approval'
            WHEN 'schedule' THEN 'schedule' WHEN 'calendar_schedule' THEN 'schedule'
            WHEN 'cancel_schedule' THEN 'schedule' WHEN 'approve' THEN 'approve' WHEN 'reject' THEN 'reject'
            WHEN 'reset' THEN 'reset_approval' WHEN 'start_visit' THEN 'start_visit'
            WHEN 'visit_result' THEN CASE WHEN COALESCE(solusi IN ({_FU}), false) THEN 'follow_up' ELSE 'visit' END
            WHEN 'close' THEN 'close' END AS action,
  CASE kind WHEN 'analysis' THEN 'Dikirim ke management untuk approval'
            WHEN 'followup' THEN 'Follow-up #' || CAST(cnt_before + 1 AS VARCHAR) || ' dikirim ke management untuk re-approval'
            WHEN 'schedule' THEN 'Dijadwalkan ke teknisi pada ' || tanggal || ' ' || jam
            WHEN 'calendar_schedule' THEN 'Dijadwalkan: ' || tanggal || ' ' || jam || ' - ' || CAST(teknisi_id AS VARCHAR)
            WHEN 'cancel_schedule' THEN 'Jadwal dibatalkan'
            WHEN 'approve' THEN 'Disetujui: ' || decision || ' - ' || COALESCE(text, '')
            WHEN 'reject' THEN 'Ditolak: ' || COALESCE(NULLIF(COALESCE(text, ''), ''), {_q(CH.NO_COMMENT)})
            WHEN 'reset' THEN 'Approval direset, perlu persetujuan ulang'
            WHEN 'start_visit' THEN 'Kunjungan dimulai'
            WHEN 'visit_result' THEN COALESCE(CASE solusi {_FU_CASE} END, 'Kunjungan dilakukan')
            WHEN 'close' THEN 'Ticket ditutup' END AS description,
  CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS VARCHAR) AS old_status, CAST(NULL AS VARCHAR) AS new_status
FROM ev WHERE applies OR (kind = 'calendar_schedule' AND valid)
UNION ALL
SELECT 'approval_logs', seq, ticket_id, user_id, kind,
  CASE WHEN kind = 'reset' THEN {_q(CH.RESET_COMMENT)} ELSE COALESCE(text, '') END,
  CASE WHEN kind = 'reset' THEN '' WHEN kind = 'reject' THEN 'reject' ELSE decision END,
  CASE WHEN kind = 'reset' THEN status_before ELSE 'approval' END,
  status_after
FROM ev WHERE applies AND kind IN ('approve', 'reject', 'reset')
""", builder=_rec)
def emit_events(spark, sf_dir):
    v, b = _b(spark, sf_dir)
    return CH.emit_events(v.tickets, b.changes)


# ------------------------------------------------------------------ numbering and intake
_TRIM_RE = "'^[\\t\\n\\x0B\\f\\r \\p{Z}\\x{FEFF}]+|[\\t\\n\\x0B\\f\\r \\p{Z}\\x{FEFF}]+$'"


def _trim(x: str, n: int) -> str:
    return f"substr(regexp_replace(COALESCE({x}, ''), {_TRIM_RE}, '', 'g'), 1, {n})"


_PADNUM = "CASE WHEN length(CAST({x} AS VARCHAR)) >= 6 THEN CAST({x} AS VARCHAR) ELSE lpad(CAST({x} AS VARCHAR), 6, '0') END"
_YEAR_SQL = f"CAST(year(TIMESTAMP '{TICKET_NOW}') AS INTEGER)"


def _walk(rows: str) -> str:
    """Recursive replay of the counter: one request a step (``n``; ``own_no`` or a generated number), with the last number of the year."""
    year = f"CAST({_YEAR_SQL} AS VARCHAR)"
    digits = "regexp_extract(split_part(w.last, '-', 3), '^\\s*\\+?([0-9]+)', 1)"
    made = (f"'SC-' || {year} || '-' || CASE WHEN w.last IS NULL THEN '000001' WHEN {digits} = '' THEN '000NaN' "
            f"ELSE {_PADNUM.format(x=f'(CAST({digits} AS BIGINT) + 1)')} END")
    return f"""
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS no,
         (SELECT max_by(ticket_no, id) FROM tickets WHERE ticket_no ILIKE 'SC-' || {year} || '-%') AS last
  UNION ALL
  SELECT n, no, CASE WHEN no ILIKE 'SC-' || {year} || '-%' THEN no ELSE last END
  FROM (SELECT r.n, COALESCE(r.own_no, {made}) AS no, w.last FROM walk w JOIN {rows} r ON r.n = w.n + 1)"""


_INTAKE = f"""
, cl AS (
  SELECT intake_key, {_trim('customer_name', 100)} AS customer_name, {_trim('customer_hp', 20)} AS customer_hp,
         {_trim('customer_kota', 100)} AS customer_kota, {_trim('toko', 100)} AS toko,
         {_trim('customer_alamat', 200)} AS customer_alamat, {_trim('customer_email', 100)} AS customer_email,
         {_trim('customer_provinsi', 100)} AS customer_provinsi, {_trim('nomor_invoice', 50)} AS nomor_invoice,
         faktur_path, foto_produk_path, video_path, foto_kerusakan_path, NULLIF(ticket_no, '') AS own_no,
         {_trim('marketplace', 100)} AS marketplace, {_trim('serial_number', 100)} AS serial_number,
         {_trim('keluhan', 1000)} AS keluhan, {_trim('kode_barang', 50)} AS kode_barang,
         COALESCE(NULLIF(tanggal_complaint, ''), strftime(TIMESTAMP '{TICKET_NOW}', '%d/%m/%Y')) AS tanggal_complaint,
         CASE WHEN tanggal_pembelian IS NULL OR tanggal_pembelian = '' THEN NULL
              WHEN len(string_split(tanggal_pembelian, '-')) = 3
                THEN split_part(tanggal_pembelian, '-', 3) || '/' || split_part(tanggal_pembelian, '-', 2) || '/'
                     || split_part(tanggal_pembelian, '-', 1)
              ELSE tanggal_pembelian END AS tanggal_pembelian,
         product_id, created_by, {_YEAR_SQL} AS year
  FROM intake_raw WHERE customer_name <> '' AND keluhan <> ''),
ok AS (SELECT * FROM cl),
inr AS (SELECT *, row_number() OVER (ORDER BY intake_key) AS n FROM ok),
walk AS ({_walk('inr')}),
numbered AS (SELECT inr.*, w.no, (SELECT COALESCE(max(id), 0) FROM tickets) + inr.n AS id FROM inr JOIN walk w USING (n))
"""


@query("ticket_numbers", f"""
, inr AS (SELECT intake_key, NULLIF(ticket_no, '') AS own_no, row_number() OVER (ORDER BY intake_key) AS n FROM intake_raw),
walk AS ({_walk('inr')})
SELECT intake_key, {_YEAR_SQL} AS year, no AS ticket_no FROM inr JOIN walk USING (n)
""", builder=lambda body: sql_changes(body, recursive=True))
def ticket_numbers(spark, sf_dir):
    v, b = _b(spark, sf_dir)
    from helpdeck.functions.dates import now_ts

    req = b.intake_raw.select("intake_key", F.year(now_ts(TICKET_NOW)).alias("year"), "ticket_no")
    return CH.ticket_numbers(v.tickets, req, ["intake_key"]).select("intake_key", "year", "ticket_no")


@query("ticket_intake", _INTAKE + f"""
SELECT id, no AS ticket_no, created_by, product_id,
       kode_barang, tanggal_complaint, customer_name, customer_alamat, customer_hp, customer_email, customer_kota,
       customer_provinsi, marketplace, nomor_invoice, toko, serial_number, faktur_path, foto_produk_path, video_path,
       foto_kerusakan_path, keluhan, tanggal_pembelian, 'waiting' AS status, 0 AS follow_up_count,
       strftime(TIMESTAMP '{TICKET_NOW}', '%Y-%m-%d %H:%M:%S') AS created_at,
       strftime(TIMESTAMP '{TICKET_NOW}', '%Y-%m-%d %H:%M:%S') AS updated_at
FROM numbered
""", builder=lambda body: sql_changes(body, recursive=True))
def ticket_intake(spark, sf_dir):
    v, b = _b(spark, sf_dir)
    return CH.ticket_intake(v.tickets, b.intake_raw, TICKET_NOW, ["intake_key"])


@query("creation_events", f"""
SELECT (SELECT COALESCE(max(id), 0) FROM tickets) + row_number() OVER (ORDER BY intake_key) AS ticket_id,
       created_by AS user_id, 'create' AS action, 'Ticket dibuat' AS description,
       '{TICKET_NOW}' AS created_at
FROM intake_raw WHERE customer_name <> '' AND keluhan <> ''
""", builder=sql_changes)
def creation_events(spark, sf_dir):
    """I12 activity rows of the tickets that the intake creates."""
    return CH.creation_events(ticket_intake(spark, sf_dir))


# ------------------------------------------------------------------ product import / upserts
_IMPORT_ROWS = f"""
, ir AS (
  SELECT row_no,
    regexp_replace(COALESCE(NULLIF("Kode Barang", ''), NULLIF(kode_barang, ''), ''), {_TRIM_RE}, '', 'g') AS kode_barang,
    regexp_replace(COALESCE(NULLIF("Nama Produk", ''), NULLIF("NAMA_PRODUK", ''), ''), {_TRIM_RE}, '', 'g') AS nama_produk,
    regexp_replace(COALESCE(NULLIF("Tipe", ''), ''), {_TRIM_RE}, '', 'g') AS tipe,
    COALESCE(TRY_CAST(regexp_replace(COALESCE(NULLIF("Garansi", ''), '0'), '[^0-9]', '', 'g') AS INTEGER), 0)
      AS garansi_bulan
  FROM product_sheet),
irv AS (SELECT *, kode_barang <> '' AND nama_produk <> '' AS valid FROM ir)
"""


@query("product_import_counts", _IMPORT_ROWS + """
SELECT CAST(count_if(valid) AS BIGINT) AS imported, CAST(count_if(NOT valid) AS BIGINT) AS skipped FROM irv
""", builder=sql_changes)
def product_import_counts(spark, sf_dir):
    return CH.product_import_counts(_b(spark, sf_dir)[1].product_sheet)


_NOW_TEXT = f"strftime(TIMESTAMP '{TICKET_NOW}', '%Y-%m-%d %H:%M:%S')"


@query("product_import", _IMPORT_ROWS + f"""
, lastr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kode_barang ORDER BY row_no DESC) AS rk,
                                  min(row_no) OVER (PARTITION BY kode_barang) AS first_no
                           FROM irv WHERE valid) WHERE rk = 1)
SELECT p.id, p.kode_barang,
       CASE WHEN l.row_no IS NOT NULL THEN l.nama_produk ELSE p.nama_produk END AS nama_produk,
       CASE WHEN l.row_no IS NOT NULL THEN l.tipe ELSE p.tipe END AS tipe,
       CASE WHEN l.row_no IS NOT NULL THEN l.garansi_bulan ELSE p.garansi_bulan END AS garansi_bulan,
       p.created_at
FROM products p LEFT JOIN lastr l ON p.kode_barang = l.kode_barang
UNION ALL
SELECT (SELECT max(id) FROM products) + row_number() OVER (ORDER BY first_no), kode_barang, nama_produk, tipe,
       garansi_bulan, {_NOW_TEXT}
FROM lastr WHERE kode_barang NOT IN (SELECT kode_barang FROM products)
""", builder=sql_changes)
def product_import(spark, sf_dir):
    v, b = _b(spark, sf_dir)
    return CH.product_import(v.products, b.product_sheet, TICKET_NOW)


@query("schedule_upsert", """
, rq AS (SELECT * REPLACE (CASE WHEN tanggal IS NULL OR tanggal = '' THEN NULL
                                WHEN len(string_split(tanggal, '-')) = 3
                                  THEN split_part(tanggal, '-', 3) || '/' || split_part(tanggal, '-', 2) || '/'
                                       || split_part(tanggal, '-', 1)
                                ELSE tanggal END AS tanggal)
         FROM schedule_requests),
lastr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY seq DESC) AS rk,
                                min(seq) OVER (PARTITION BY ticket_id) AS first_seq,
                                arg_min(user_id, seq) OVER (PARTITION BY ticket_id) AS first_user,
                                arg_min(ts, seq) OVER (PARTITION BY ticket_id) AS first_ts FROM rq
                         WHERE teknisi_id IS NOT NULL AND tanggal <> ''
                           AND jam <> '') WHERE rk = 1)
SELECT s.id, s.ticket_id,
       CASE WHEN l.seq IS NOT NULL THEN l.teknisi_id ELSE s.teknisi_id END AS teknisi_id,
       CASE WHEN l.seq IS NOT NULL THEN l.tanggal ELSE s.tanggal END AS tanggal,
       CASE WHEN l.seq IS NOT NULL THEN l.jam ELSE s.jam END AS jam,
       CASE WHEN l.seq IS NOT NULL THEN l.notes ELSE s.notes END AS notes,
       s.created_by, s.created_at
FROM schedules s LEFT JOIN lastr l ON s.ticket_id = l.ticket_id
UNION ALL
SELECT (SELECT max(id) FROM schedules) + row_number() OVER (ORDER BY first_seq), ticket_id, teknisi_id, tanggal, jam, notes,
       first_user, first_ts
FROM lastr WHERE ticket_id NOT IN (SELECT ticket_id FROM schedules)
""", builder=sql_changes)
def schedule_upsert(spark, sf_dir):
    v, b = _b(spark, sf_dir)
    return CH.schedule_upsert(v.schedules, b.schedule_requests)


_TODAY = f"strftime(TIMESTAMP '{TICKET_NOW}', '%d/%m/%Y')"


@query("visit_upsert", f"""
, lastr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY seq DESC) AS rk,
                                  min(seq) OVER (PARTITION BY ticket_id) AS first_seq,
                                  arg_min(teknisi_id, seq) OVER (PARTITION BY ticket_id) AS first_tek
                           FROM visit_reports WHERE findings <> '') WHERE rk = 1),
files AS (SELECT ticket_id AS ft, {', '.join(f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS n_{c}" for c in CH.KEEP_IF_NULL)}
          FROM visit_reports WHERE findings <> '' GROUP BY ticket_id),
vals AS (SELECT ticket_id, seq, first_seq, first_tek AS teknisi_id, {_TODAY} AS tanggal, jam,
                {_trim('findings', 2000)} AS hasil_pemeriksaan, {_trim('solusi', 1000)} AS solusi,
                {_trim('sparepart', 500)} AS sparepart,
                COALESCE(CASE WHEN NULLIF(tanggal_selesai, '') IS NULL THEN NULL
                              WHEN len(string_split(tanggal_selesai, '-')) = 3
                                THEN split_part(tanggal_selesai, '-', 3) || '/' || split_part(tanggal_selesai, '-', 2)
                                     || '/' || split_part(tanggal_selesai, '-', 1)
                              ELSE tanggal_selesai END, {_TODAY}) AS tanggal_selesai
         , files.* EXCLUDE (ft) FROM lastr JOIN files ON ft = ticket_id)
SELECT v.id, v.ticket_id, v.teknisi_id,
       CASE WHEN l.seq IS NOT NULL THEN l.tanggal ELSE v.tanggal END AS tanggal,
       CASE WHEN l.seq IS NOT NULL THEN l.jam ELSE v.jam END AS jam,
       CASE WHEN l.seq IS NOT NULL THEN l.hasil_pemeriksaan ELSE v.hasil_pemeriksaan END AS hasil_pemeriksaan,
       CASE WHEN l.seq IS NOT NULL THEN l.solusi ELSE v.solusi END AS solusi,
       CASE WHEN l.seq IS NOT NULL THEN l.sparepart ELSE v.sparepart END AS sparepart,
       CASE WHEN l.seq IS NOT NULL THEN l.tanggal_selesai ELSE v.tanggal_selesai END AS tanggal_selesai,
       {', '.join(f'COALESCE(l.n_{c}, v.{c}) AS {c}' for c in CH.KEEP_IF_NULL)},
       v.created_at
FROM visit_results v LEFT JOIN vals l ON v.ticket_id = l.ticket_id
UNION ALL
SELECT (SELECT max(id) FROM visit_results) + row_number() OVER (ORDER BY first_seq), ticket_id, teknisi_id, tanggal, jam,
       hasil_pemeriksaan, solusi, sparepart, tanggal_selesai, {', '.join(f'n_{c}' for c in CH.KEEP_IF_NULL)},
       strftime(TIMESTAMP '{TICKET_NOW}', '%Y-%m-%d %H:%M:%S')
FROM vals WHERE ticket_id NOT IN (SELECT ticket_id FROM visit_results)
""", builder=sql_changes)
def visit_upsert(spark, sf_dir):
    v, b = _b(spark, sf_dir)
    return CH.visit_upsert(v.visit_results, b.visit_reports, TICKET_NOW)


@query("settings_replace", """
SELECT key, value FROM (
  SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rk
  FROM (SELECT key, value, CAST(-1 AS BIGINT) AS seq FROM settings UNION ALL SELECT key, value, seq FROM setting_writes))
WHERE rk = 1
""", builder=sql_changes)
def settings_replace(spark, sf_dir):
    v, b = _b(spark, sf_dir)
    return CH.settings_replace(v.settings, b.setting_writes)


@query("keyed_update", """
, lastr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rk FROM product_edits)
            WHERE rk = 1)
SELECT p.* REPLACE (CASE WHEN l.id IS NOT NULL THEN l.tipe ELSE p.tipe END AS tipe)
FROM products p LEFT JOIN lastr l ON p.id = l.id
""", builder=sql_changes)
def keyed_update(spark, sf_dir):
    v, b = _b(spark, sf_dir)
    return CH.keyed_update(v.products, b.product_edits, key="id", order="seq", cols=["tipe"])


@query("toggle_active", """
, fl AS (SELECT user_id, count(*) AS flips FROM toggle_requests GROUP BY user_id)
SELECT u.* REPLACE (CASE WHEN u.role = 'teknisi' AND COALESCE(f.flips, 0) % 2 = 1
                         THEN CASE WHEN COALESCE(u.active, 0) <> 0 THEN 0 ELSE 1 END ELSE u.active END AS active)
FROM users u LEFT JOIN fl f ON f.user_id = u.id
""", builder=sql_changes)
def toggle_active(spark, sf_dir):
    v, b = _b(spark, sf_dir)
    return CH.toggle_active(v.users, b.toggle_requests)


@query("guarded_user_delete", """
, firstr AS (SELECT user_id, min(seq) AS seq FROM delete_requests GROUP BY user_id),
j AS (SELECT f.seq, f.user_id, u.role FROM firstr f LEFT JOIN users u ON u.id = f.user_id),
na AS (SELECT count(*) AS n FROM users WHERE role = 'admin'),
adm AS (SELECT j.*, row_number() OVER (ORDER BY seq) AS k FROM j WHERE role = 'admin'),
firsts AS (SELECT seq, user_id, role, k < (SELECT n FROM na) AS deleted,
       CASE WHEN k < (SELECT n FROM na) THEN 'deleted' ELSE 'cannot_delete_last_admin' END AS reason FROM adm
UNION ALL
SELECT seq, user_id, role, COALESCE(role IN ('management', 'teknisi', 'cs'), false),
       CASE WHEN role IS NULL THEN 'user_not_found' WHEN role IN ('management', 'teknisi', 'cs') THEN 'deleted'
            ELSE 'invalid_role' END
FROM j WHERE role IS NULL OR role <> 'admin')
SELECT * FROM firsts
UNION ALL
SELECT d.seq, d.user_id, CASE WHEN NOT f.deleted THEN f.role END, false, CASE WHEN f.deleted THEN 'user_not_found' ELSE f.reason END
FROM delete_requests d JOIN firsts f ON f.user_id = d.user_id WHERE d.seq <> f.seq
""", builder=sql_changes)
def guarded_user_delete(spark, sf_dir):
    v, b = _b(spark, sf_dir)
    return CH.guarded_user_delete(v.users, b.delete_requests)


_USER_WALK = """
, ulog AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM user_log),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, (SELECT list({'id': id, 'username': username, 'role': role, 'src': CAST(-1 AS BIGINT)}) FROM users) AS us,
         (SELECT max(id) FROM users) AS m, CAST(NULL AS BIGINT) AS uid, CAST(NULL AS VARCHAR) AS reason
  UNION ALL
  SELECT n, CASE reason WHEN 'user_created' THEN list_append(us, {'id': m + 1, 'username': username, 'role': role, 'src': seq})
                        WHEN 'user_updated' THEN list_append(list_filter(us, lambda x: x.id <> user_id), {'id': user_id, 'username': username, 'role': role, 'src': seq})
                        WHEN 'user_deleted' THEN list_filter(us, lambda x: x.id <> user_id) ELSE us END,
         CASE WHEN reason = 'user_created' THEN m + 1 ELSE m END,
         CASE WHEN reason = 'user_created' THEN m + 1 WHEN kind <> 'create' THEN user_id END, reason
  FROM (
    SELECT *, CASE kind
      WHEN 'create' THEN CASE WHEN COALESCE(name, '') = '' OR COALESCE(username, '') = '' OR COALESCE(role, '') = '' THEN 'missing_fields'
                              WHEN role NOT IN ('admin', 'management', 'teknisi', 'cs') THEN 'invalid_role'
                              WHEN len(held) > 0 THEN 'username_taken' ELSE 'user_created' END
      WHEN 'edit' THEN CASE WHEN len(mine) = 0 OR mine[1].role NOT IN ('admin', 'management', 'teknisi', 'cs') THEN 'nothing_updated'
                            WHEN name IS NULL OR username IS NULL OR role IS NULL THEN 'missing_fields'
                            WHEN len(held) > 0 AND held[1].id <> user_id THEN 'username_taken' ELSE 'user_updated' END
      ELSE CASE WHEN len(mine) = 0 THEN 'user_not_found' WHEN mine[1].role NOT IN ('admin', 'management', 'teknisi', 'cs') THEN 'invalid_role'
                WHEN mine[1].role = 'admin' AND admins <= 1 THEN 'cannot_delete_last_admin' ELSE 'user_deleted' END END AS reason
    FROM (SELECT l.*, w.us, w.m, list_filter(w.us, lambda x: x.id = l.user_id) AS mine, list_filter(w.us, lambda x: x.username = l.username) AS held,
                 len(list_filter(w.us, lambda x: x.role = 'admin')) AS admins
          FROM walk w JOIN ulog l ON l.n = w.n + 1)))
"""


@query("user_verdicts", _USER_WALK + """
SELECT l.seq, l.kind, w.uid AS user_id, w.reason IN ('user_created', 'user_updated', 'user_deleted') AS done, w.reason
FROM walk w JOIN ulog l USING (n)
""", builder=_rec)
def user_verdicts(spark, sf_dir):
    """D20 + I6 the outcome of every create, edit and delete of users, in order."""
    v, b = _b(spark, sf_dir)
    return U.replay_users(v.users, b.user_log, TICKET_NOW)[1]


@query("user_replay", _USER_WALK + f"""
, last AS (SELECT unnest(us) AS x FROM walk QUALIFY n = max(n) OVER ())
SELECT x.id, x.username, CASE WHEN x.src < 0 THEN u.name ELSE l.name END AS name, x.role, CASE WHEN x.src < 0 THEN u.phone ELSE COALESCE(l.phone, '') END AS phone,
       CASE WHEN x.src < 0 THEN u.email ELSE COALESCE(l.email, '') END AS email, COALESCE(u.active, 1) AS active,
       COALESCE(u.created_at, '{TICKET_NOW}') AS created_at
FROM last LEFT JOIN users u ON u.id = x.id LEFT JOIN user_log l ON l.seq = x.src
""", builder=_rec)
def user_replay(spark, sf_dir):
    """D20 + I6 the users table after that log."""
    v, b = _b(spark, sf_dir)
    return U.replay_users(v.users, b.user_log, TICKET_NOW)[0]


# ------------------------------------------------------------------ deletes, resets, backfill, vouchers
def _cascade(spark, sf_dir):
    v = views(spark, sf_dir)
    tables = {"tickets": v.tickets, "visit_results": v.visit_results, "activity_log": v.activity_log,
              "schedules": v.schedules, "notifications": v.notifications}
    ids = v.tickets.filter(F.col("status") == "rejected").select("id")
    return CH.cascade_delete(tables, ids)


_DELETED = "(SELECT id FROM tickets WHERE status = 'rejected')"


@query("cascade_delete_notifications", f"""
SELECT n.* FROM notifications n
WHERE NOT EXISTS (SELECT 1 FROM {_DELETED} d
                  WHERE contains(lower(n.link), '/admin/tickets/' || CAST(d.id AS VARCHAR)))
""")
def cascade_delete_notifications(spark, sf_dir):
    return _cascade(spark, sf_dir)["notifications"]


@query("cascade_delete_counts", f"""
SELECT 'tickets' AS table_name, count(*) AS rows_left FROM tickets WHERE id NOT IN {_DELETED}
UNION ALL SELECT 'visit_results', count(*) FROM visit_results WHERE ticket_id NOT IN {_DELETED}
UNION ALL SELECT 'activity_log', count(*) FROM activity_log WHERE ticket_id NOT IN {_DELETED}
UNION ALL SELECT 'schedules', count(*) FROM schedules WHERE ticket_id NOT IN {_DELETED}
UNION ALL SELECT 'notifications', count(*) FROM notifications n
  WHERE NOT EXISTS (SELECT 1 FROM {_DELETED} d WHERE contains(lower(n.link), '/admin/tickets/' || CAST(d.id AS VARCHAR)))
""")
def cascade_delete_counts(spark, sf_dir):
    out = _cascade(spark, sf_dir)
    parts = [out[t].agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(t).alias("table_name"), "rows_left")
             for t in ("tickets", "visit_results", "activity_log", "schedules", "notifications")]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


@query("reset_plan", """
SELECT 'visit_results' AS table_name, CAST(0 AS BIGINT) AS rows_left
UNION ALL SELECT 'activity_log', 0 UNION ALL SELECT 'notifications', 0 UNION ALL SELECT 'schedules', 0
UNION ALL SELECT 'tickets', 0 UNION ALL SELECT 'products', 0
UNION ALL SELECT 'users', count(*) FROM users WHERE role = 'admin'
UNION ALL SELECT 'settings', count(*) FROM settings
""")
def reset_plan(spark, sf_dir):
    v = views(spark, sf_dir)
    tables = {"visit_results": v.visit_results, "activity_log": v.activity_log, "notifications": v.notifications,
              "schedules": v.schedules, "tickets": v.tickets, "products": v.products, "users": v.users,
              "settings": v.settings}
    out = CH.reset_plan(tables, total=True)
    parts = [out[t].agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(t).alias("table_name"), "rows_left")
             for t in tables]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


@query("activity_backfill", """
SELECT id AS ticket_id, CAST(1 AS BIGINT) AS user_id, 'create' AS action, 'Ticket dibuat' AS description FROM tickets
UNION ALL SELECT id, 2, 'approve', 'Disetujui Management' FROM tickets WHERE status IN ('scheduled', 'on_progress', 'completed')
UNION ALL SELECT id, 1, 'close', 'Ticket ditutup' FROM tickets WHERE status = 'completed'
""")
def activity_backfill(spark, sf_dir):
    return CH.activity_backfill(views(spark, sf_dir).tickets)


@query("voucher_candidates", f"""
SELECT t.id AS ticket_id, t.customer_name, t.customer_hp, t.customer_alamat, p.nama_produk AS product_name, p.tipe AS product_type,
       t.serial_number, t.keluhan, t.management_decision AS decision, 'active' AS status,
       sha256('voucher' || CAST(t.id AS VARCHAR)) AS qr_token,
       strftime(CAST(TIMESTAMP '{TICKET_NOW}' - INTERVAL 7 HOUR AS DATE) + 30, '%Y-%m-%d') AS expired_at
FROM tickets t LEFT JOIN products p ON t.product_id = p.id
WHERE t.approved_by IS NOT NULL AND t.approved_by <> 0
  AND NOT EXISTS (SELECT 1 FROM service_vouchers v WHERE v.ticket_id = t.id)
""")
def voucher_candidates(spark, sf_dir):
    v = views(spark, sf_dir)
    return CH.voucher_candidates(v.tickets, v.products, v.service_vouchers, TICKET_NOW, salt="voucher")


@query("issue_vouchers", f"""
, c AS (SELECT t.id AS ticket_id, t.customer_name, t.customer_hp, t.customer_alamat, p.nama_produk AS product_name, p.tipe AS product_type,
       t.serial_number, t.keluhan, t.management_decision AS decision, 'active' AS status,
       sha256('voucher' || CAST(t.id AS VARCHAR)) AS qr_token,
       strftime(CAST(TIMESTAMP '{TICKET_NOW}' - INTERVAL 7 HOUR AS DATE) + 30, '%Y-%m-%d') AS expired_at,
       (SELECT COALESCE(max(id), 0) FROM service_vouchers) + row_number() OVER (ORDER BY t.id) AS id
FROM tickets t LEFT JOIN products p ON t.product_id = p.id
WHERE t.approved_by IS NOT NULL AND t.approved_by <> 0
  AND NOT EXISTS (SELECT 1 FROM service_vouchers v WHERE v.ticket_id = t.id))
SELECT c.*, CAST(1 AS BIGINT) AS created_by, strftime(TIMESTAMP '{TICKET_NOW}', '%Y-%m-%d %H:%M:%S') AS created_at,
       'BRC-' || to_base(CAST(epoch(TIMESTAMP '{TICKET_NOW}') * 1000 AS BIGINT), 36) || '-' || to_base(id, 36, 6) AS voucher_no
FROM c
""")
def issue_vouchers(spark, sf_dir):
    """I13 + H25 new vouchers with numbers."""
    v = views(spark, sf_dir)
    return CH.issue_vouchers(v.tickets, v.products, v.service_vouchers, TICKET_NOW, salt="voucher")


@query("voucher_notifications", f"""
, c AS (SELECT t.customer_name, t.created_by,
       (SELECT COALESCE(max(id), 0) FROM service_vouchers) + row_number() OVER (ORDER BY t.id) AS id
FROM tickets t WHERE t.approved_by IS NOT NULL AND t.approved_by <> 0
  AND NOT EXISTS (SELECT 1 FROM service_vouchers v WHERE v.ticket_id = t.id))
SELECT created_by AS user_id, '/admin/voucher/' || CAST(id AS VARCHAR) AS link,
       'Voucher BRC-' || to_base(CAST(epoch(TIMESTAMP '{TICKET_NOW}') * 1000 AS BIGINT), 36) || '-' || to_base(id, 36, 6)
         || ' sudah diterbitkan untuk ' || COALESCE(customer_name, 'null') AS message
FROM c WHERE created_by IS NOT NULL AND created_by <> 0
""")
def voucher_notifications(spark, sf_dir):
    """I12 notifications of the vouchers that are issued."""
    return CH.voucher_notifications(issue_vouchers(spark, sf_dir), views(spark, sf_dir).tickets)


@query("voucher_sent_events", """
SELECT r.id AS seq, r.ticket_id, r.user_id, 'voucher_wa' AS action,
       'Voucher dikirim ke WA ' || (SELECT t.customer_hp FROM tickets t WHERE t.id = r.ticket_id) AS description
FROM activity_log r
WHERE r.action = 'view' AND EXISTS (SELECT 1 FROM service_vouchers v WHERE v.ticket_id = r.ticket_id)
  AND EXISTS (SELECT 1 FROM tickets t WHERE t.id = r.ticket_id AND t.customer_hp <> '')
""")
def voucher_sent_events(spark, sf_dir):
    """I12 activity rows of voucher sendings, asked for by the 'view' activities."""
    v = views(spark, sf_dir)
    req = v.activity_log.filter(F.col("action") == "view").select(F.col("id").alias("seq"), "ticket_id", "user_id")
    return CH.voucher_sent_events(req, v.service_vouchers, v.tickets)


# the oracle numbers each ticket's cancellations and keeps the last stretch
@query("schedule_replay", """
, log AS (SELECT seq, ticket_id, kind, teknisi_id, tanggal, jam, text AS notes, user_id, ts FROM changes
          WHERE kind = 'cancel_schedule' OR (kind IN ('schedule', 'calendar_schedule') AND teknisi_id IS NOT NULL)),
cut AS (SELECT *, count(*) FILTER (WHERE kind = 'cancel_schedule') OVER (PARTITION BY ticket_id ORDER BY seq) AS nth,
               count(*) FILTER (WHERE kind = 'cancel_schedule') OVER (PARTITION BY ticket_id) AS total FROM log),
stays AS (SELECT * FROM cut WHERE nth = total AND kind <> 'cancel_schedule'),
ends AS (SELECT DISTINCT ticket_id, min(seq) OVER w AS s0, first_value(user_id) OVER w AS by0, first_value(ts) OVER w AS at0,
           last_value(teknisi_id) OVER w AS tek, last_value(tanggal) OVER w AS tgl, last_value(jam) OVER w AS j,
           last_value(notes) OVER w AS nt
         FROM stays WINDOW w AS (PARTITION BY ticket_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
old AS (SELECT * FROM schedules WHERE ticket_id NOT IN (SELECT ticket_id FROM log WHERE kind = 'cancel_schedule'))
SELECT old.id, old.ticket_id, CASE WHEN s0 IS NULL THEN old.teknisi_id ELSE tek END AS teknisi_id,
  CASE WHEN s0 IS NULL THEN old.tanggal ELSE tgl END AS tanggal, CASE WHEN s0 IS NULL THEN old.jam ELSE j END AS jam,
  CASE WHEN s0 IS NULL THEN old.notes ELSE nt END AS notes, old.created_by, old.created_at
FROM old LEFT JOIN ends USING (ticket_id)
UNION ALL
SELECT (SELECT max(id) FROM schedules) + row_number() OVER (ORDER BY s0), ticket_id, tek, tgl, j, nt, by0, at0
FROM ends WHERE ticket_id NOT IN (SELECT ticket_id FROM old)
""", builder=sql_changes)
def schedule_replay(spark, sf_dir):
    """I4 + I6 schedules after the batch's requests and cancellations."""
    v, b = _b(spark, sf_dir)
    return CH.schedule_replay(v.schedules, b.changes.withColumnRenamed("text", "notes"))


@query("product_upsert", """
, inc AS (SELECT p_partkey AS row_no, 'P' || CAST(p_partkey + 1000 AS VARCHAR) AS kode_barang,
                 upper(p_name) AS nama_produk, p_brand AS tipe, p_size AS garansi_bulan FROM part),
lastr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kode_barang ORDER BY row_no DESC) AS rk FROM inc)
          WHERE rk = 1)
SELECT p.id, p.kode_barang,
       CASE WHEN l.row_no IS NOT NULL THEN l.nama_produk ELSE p.nama_produk END AS nama_produk,
       CASE WHEN l.row_no IS NOT NULL THEN l.tipe ELSE p.tipe END AS tipe,
       CASE WHEN l.row_no IS NOT NULL THEN l.garansi_bulan ELSE p.garansi_bulan END AS garansi_bulan,
       p.created_at
FROM products p LEFT JOIN lastr l ON p.kode_barang = l.kode_barang
UNION ALL
SELECT (SELECT max(id) FROM products) + row_number() OVER (ORDER BY row_no), kode_barang, nama_produk, tipe,
       garansi_bulan, CAST(NULL AS VARCHAR)
FROM lastr WHERE kode_barang NOT IN (SELECT kode_barang FROM products)
""", builder=sql_changes)
def product_upsert(spark, sf_dir):
    """I4 upsert of a catalog feed into products by code (id kept on match, next ids for new codes)."""
    from helpdeck.sources.fixtures import incoming_catalog

    v = views(spark, sf_dir)
    return CH.upsert_by_key(v.products, incoming_catalog(v), "kode_barang", "row_no",
                            update_cols=["nama_produk", "tipe", "garansi_bulan"])


@query("cascade_delete", f"SELECT * FROM tickets WHERE id NOT IN {_DELETED}")
def cascade_delete(spark, sf_dir):
    """I8 the tickets table after deleting every rejected ticket with its children."""
    return _cascade(spark, sf_dir)["tickets"]


def _tpl_sql(tpl: str) -> str:
    """A ``{field}`` template as a SQL concatenation over the ``ea`` rows."""
    import re

    cols = {"no": "no", "id": "CAST(ticket_id AS VARCHAR)", "tanggal": "tanggal", "jam": "jam"}
    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", tpl):
        out.append(_q(tpl[pos:m.start()]))
        out.append(cols[m.group(1)])
        pos = m.end()
    out.append(_q(tpl[pos:]))
    return " || ".join(out)


def _notifications_sql() -> str:
    users = {"role": "CAST(NULL AS BIGINT)", "creator": "tcreator", "technician": "teknisi_id",
             "scheduled_technician": "sched_tek"}
    extra = {"creator": " AND tcreator IS NOT NULL AND tcreator <> 0",
             "scheduled_technician": " AND sched_tek IS NOT NULL"}
    parts = []
    for kind, rows in CH.NOTIFY_DIRECT.items():
        for target, role, msg, link in rows:
            role_sql = _q(role) if role else "CAST(NULL AS VARCHAR)"
            parts.append(f"SELECT seq, ticket_id, {users[target]} AS user_id, {role_sql} AS role, "
                         f"{_tpl_sql(msg)} AS message, {_tpl_sql(link)} AS link FROM ea "
                         f"WHERE kind = {_q(kind)}{extra.get(target, '')}")
    for (kind, role), msg in CH.NOTIFY_FANOUT.items():
        parts.append(f"SELECT f.seq, f.ticket_id, u.id, CAST(NULL AS VARCHAR), {_tpl_sql(msg)}, "
                     f"'/admin/tickets/' || CAST(f.ticket_id AS VARCHAR) "
                     f"FROM ea f JOIN users u ON u.role = {_q(role)} WHERE f.fkind = {_q(kind)}")
    return _replay() + f"""
, ev AS (SELECT s.applies, e.* FROM st s JOIN cv e ON e.ticket_id = s.ticket_id AND e.n = s.n WHERE s.n > 0
       UNION ALL SELECT true, unknown.* FROM unknown),
fs AS (SELECT ticket_id AS fs_tid, arg_min(teknisi_id, id) AS sched_tek FROM schedules GROUP BY ticket_id),
planned AS (SELECT c.ticket_id, c.seq, arg_max(CASE WHEN p.kind = 'cancel_schedule' THEN -1 ELSE p.teknisi_id END, p.seq) AS now_tek
            FROM cv c JOIN cv p ON p.ticket_id = c.ticket_id AND p.seq < c.seq
            WHERE c.kind = 'cancel_schedule' AND p.valid AND p.kind IN ('schedule', 'calendar_schedule', 'cancel_schedule') GROUP BY ALL),
ea AS (SELECT ev.*, t.created_by AS tcreator, NULLIF(COALESCE(planned.now_tek, fs.sched_tek), -1) AS sched_tek,
              COALESCE(t.ticket_no, '#' || CAST(ev.ticket_id AS VARCHAR)) AS no,
              CASE WHEN ev.kind = 'visit_result' AND COALESCE(ev.solusi IN ({_FU}), false)
                   THEN 'visit_result_followup' ELSE ev.kind END AS fkind
       FROM ev LEFT JOIN tickets t ON t.id = ev.ticket_id LEFT JOIN fs ON fs.fs_tid = ev.ticket_id
            LEFT JOIN planned ON planned.ticket_id = ev.ticket_id AND planned.seq = ev.seq
       WHERE ev.applies OR (ev.kind = 'calendar_schedule' AND ev.valid))
""" + "\nUNION ALL\n".join(parts)


@query("emit_notifications", "", builder=lambda _body: _rec(_notifications_sql()))
def emit_notifications(spark, sf_dir):
    """I12 notification rows written by the applied transitions."""
    v, b = _b(spark, sf_dir)
    return CH.emit_notifications(v.tickets, b.changes, v.users, v.schedules)
