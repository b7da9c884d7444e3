"""Filter, join, list, calendar and progress queries
with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpdeck.functions import labels as L
from helpdeck.functions import text as T
from helpdeck.functions.messages import message
from helpdeck.operators import calendar as C
from helpdeck.operators import enrich as E
from helpdeck.operators import filters as FL
from helpdeck.operators import postings as PO
from helpdeck.operators import progress as P
from helpdeck.plans.catalog import query, views
from helpdeck.session import scratch_path
from helpdeck.plans.oracle_views import sql_changes
from helpdeck.sources.fixtures import TICKET_NOW

NOW_SQL = f"TIMESTAMP '{TICKET_NOW}'"
TODAY_SQL = f"strftime({NOW_SQL}, '%d/%m/%Y')"
CAL_YEAR, CAL_MONTH = 2000, 2
def _name_of(table: str, column: str, key: str, alias: str) -> str:
    """A dimension lookup: ``column`` of the one row of ``table`` that ``key`` names, NULL without it."""
    return f"(SELECT {column} FROM {table} WHERE {table}.id = {key}) AS {alias}"


ENRICHED_SQL = f""", enriched AS (SELECT tickets.*, {_name_of('products', 'nama_produk', 'tickets.product_id', 'nama_produk')},
  {_name_of('products', 'tipe', 'tickets.product_id', 'tipe')}, {_name_of('users', 'name', 'tickets.created_by', 'created_by_name')}
  FROM tickets)
SELECT * FROM enriched"""
FIRST_CHILD = """, s1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY id) AS rn
                           FROM schedules) WHERE rn = 1),
v1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY id) AS rn
                           FROM visit_results) WHERE rn = 1),
c1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY id) AS rn
                           FROM service_vouchers) WHERE rn = 1),
tt AS (SELECT t.*, s1.id AS schedule_id, s1.tanggal AS s_tanggal, s1.jam AS s_jam,
              v1.id AS visit_id, v1.tanggal AS v_tanggal, v1.jam AS v_jam, v1.solusi AS v_solusi
       FROM tickets t LEFT JOIN s1 ON s1.ticket_id = t.id LEFT JOIN v1 ON v1.ticket_id = t.id)
"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------------ filters
@query("tickets_enriched", ENRICHED_SQL)
def tickets_enriched(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.tickets_enriched(v.tickets, v.products, v.users)


@query("tickets_filter", ENRICHED_SQL + """
WHERE lower(nama_produk) LIKE '%e_%' AND lower(marketplace) LIKE '%uil%'
  AND lower(customer_kota) LIKE '%n_1%' AND id IN (SELECT ticket_id FROM visit_results)
""")
def tickets_filter(spark, sf_dir):
    v = views(spark, sf_dir)
    enriched = E.tickets_enriched(v.tickets, v.products, v.users)
    return FL.tickets_filter(enriched, v.schedules, v.visit_results, status="all", produk="E_",
                             marketplace="uIl", kota="n_1", penanganan="sudah")


@query("tickets_filter_technician", ENRICHED_SQL + """
WHERE status = 'scheduled' AND id IN (SELECT ticket_id FROM schedules WHERE teknisi_id = 2)
  AND id NOT IN (SELECT ticket_id FROM visit_results WHERE ticket_id IS NOT NULL)
""")
def tickets_filter_technician(spark, sf_dir):
    v = views(spark, sf_dir)
    enriched = E.tickets_enriched(v.tickets, v.products, v.users)
    return FL.tickets_filter(enriched, v.schedules, v.visit_results, status="scheduled", teknisi=2,
                             penanganan="belum")


@query("tickets_filter_indexed", ENRICHED_SQL + """
WHERE nama_produk ILIKE '%e%' AND marketplace ILIKE '%uil%' AND customer_name ILIKE '%mer#00%0_1%' AND customer_kota ILIKE '%n%a%'
ORDER BY id DESC
""")
def tickets_filter_indexed(spark, sf_dir):
    """B5 + B8 through trigram postings of tickets and of products, which the query writes and reads back."""
    v = views(spark, sf_dir)
    paths = scratch_path(spark, "postings-tickets"), scratch_path(spark, "postings-products")
    PO.write_postings(PO.postings(v.tickets, ["marketplace", "customer_name", "customer_kota"]), paths[0])
    PO.write_postings(PO.postings(v.products, ["nama_produk"]), paths[1])
    tickets = PO.contains_filter(v.tickets, spark.read.parquet(paths[0]), {"marketplace": "uIl", "customer_name": "mer#00%0_1", "customer_kota": "n%a"})
    products = PO.contains_filter(v.products, spark.read.parquet(paths[1]), {"nama_produk": "E"})
    found = E.tickets_enriched(tickets.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi"), v.products, v.users)
    return found.orderBy(F.desc("id"))


@query("tickets_open", "SELECT * FROM tickets WHERE status NOT IN ('completed', 'rejected')")
def tickets_open(spark, sf_dir):
    return FL.tickets_open(views(spark, sf_dir).tickets)


@query("tickets_handled", "SELECT * FROM tickets WHERE id IN (SELECT ticket_id FROM visit_results)")
def tickets_handled(spark, sf_dir):
    v = views(spark, sf_dir)
    return FL.tickets_handled(v.tickets, v.visit_results)


@query("tickets_unhandled", """
SELECT * FROM tickets
WHERE id NOT IN (SELECT ticket_id FROM visit_results WHERE ticket_id IS NOT NULL) AND status NOT IN ('rejected')
""")
def tickets_unhandled(spark, sf_dir):
    v = views(spark, sf_dir)
    return FL.tickets_unhandled(v.tickets, v.visit_results)


@query("tickets_by_creator", """
SELECT * FROM (
  SELECT id, ticket_no, customer_name, status, created_at, created_by,
         CAST(row_number() OVER (PARTITION BY created_by ORDER BY created_at DESC, id DESC) AS INTEGER) AS rn
  FROM tickets) WHERE rn <= 20
""")
def tickets_by_creator(spark, sf_dir):
    return FL.tickets_by_creator(views(spark, sf_dir).tickets, k=20)


@query("active_technicians", "SELECT id, name FROM users WHERE role = 'teknisi' AND active = 1")
def active_technicians(spark, sf_dir):
    return FL.active_technicians(views(spark, sf_dir).users)


@query("user_directory", """
SELECT id, username, name, phone, email, role FROM users
WHERE role IN ('admin', 'management', 'teknisi', 'cs')
""")
def user_directory(spark, sf_dir):
    return FL.user_directory(views(spark, sf_dir).users)


# ------------------------------------------------------------------ joins
@query("ticket_detail", f"""
, booked AS (SELECT ticket_id, id AS schedule_id, teknisi_id, tanggal AS jadwal_tanggal, jam AS jadwal_jam,
    {_name_of('users', 'name', 'schedules.teknisi_id', 'teknisi_name')}
  FROM schedules WHERE id IN (SELECT min(id) FROM schedules GROUP BY ticket_id)),
visited AS (SELECT ticket_id, id AS visit_id, solusi AS visit_solusi
  FROM visit_results WHERE id IN (SELECT min(id) FROM visit_results GROUP BY ticket_id)),
given AS (SELECT ticket_id, id AS voucher_id, voucher_no, status AS voucher_status
  FROM service_vouchers WHERE id IN (SELECT min(id) FROM service_vouchers GROUP BY ticket_id)),
named AS (SELECT tickets.*, {_name_of('products', 'nama_produk', 'tickets.product_id', 'nama_produk')},
    {_name_of('products', 'tipe', 'tickets.product_id', 'tipe')},
    {_name_of('products', 'garansi_bulan', 'tickets.product_id', 'garansi_bulan')},
    {_name_of('users', 'name', 'tickets.created_by', 'created_by_name')},
    {_name_of('users', 'name', 'tickets.approved_by', 'approved_by_name')},
    {_name_of('users', 'name', 'tickets.closed_by', 'closed_by_name')} FROM tickets)
SELECT named.*, booked.* EXCLUDE (ticket_id), visited.* EXCLUDE (ticket_id), given.* EXCLUDE (ticket_id)
FROM named LEFT JOIN booked ON booked.ticket_id = named.id LEFT JOIN visited ON visited.ticket_id = named.id
LEFT JOIN given ON given.ticket_id = named.id
""")
def ticket_detail(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.ticket_detail(v.tickets, v.products, v.users, v.schedules, v.visit_results, v.service_vouchers)


def _plannable(statuses: str) -> str:
    """Open tickets, one row for each of their visits, and one without a visit where there is none."""
    return f"""
, visits AS (SELECT ticket_id, list(id) AS ids FROM schedules GROUP BY ticket_id)
SELECT id, ticket_no, customer_name, customer_kota, status, created_at, {_name_of('products', 'nama_produk', 'tickets.product_id', 'nama_produk')},
  unnest(COALESCE((SELECT ids FROM visits WHERE ticket_id = tickets.id), [NULL])) AS schedule_id
FROM tickets WHERE list_contains(string_split('{statuses}', ' '), status)
"""


@query("tickets_schedulable", _plannable("waiting approval"))
def tickets_schedulable(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.tickets_schedulable(v.tickets, v.products, v.schedules)


@query("tickets_schedulable_calendar", _plannable("waiting approval scheduled on_progress"))
def tickets_schedulable_calendar(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.tickets_schedulable(v.tickets, v.products, v.schedules,
                                 statuses=("waiting", "approval", "scheduled", "on_progress"))


@query("tickets_unscheduled", _plannable("waiting approval scheduled on_progress").replace(
    "SELECT id, ticket_no", "SELECT * EXCLUDE (schedule_id) FROM (SELECT id, ticket_no", 1) + ") WHERE schedule_id IS NULL")
def tickets_unscheduled(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.tickets_unscheduled(v.tickets, v.products, v.schedules)


@query("pending_approval", f"""
, queue AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM tickets WHERE status = 'approval')
SELECT id, ticket_no, customer_name, keluhan, created_at, admin_analysis,
  {_name_of('products', 'nama_produk', 'queue.product_id', 'nama_produk')}
FROM queue WHERE place <= 5
""")
def pending_approval(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.pending_approval(v.tickets, v.products, k=5)


@query("approval_queue", ENRICHED_SQL + " WHERE status = 'approval'")
def approval_queue(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.approval_queue(v.tickets, v.products, v.users)


@query("processed_approvals", f"""
, decided AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, id DESC) AS place
  FROM tickets WHERE management_decision IS NOT NULL AND (status = 'waiting' OR status = 'rejected'))
SELECT id, ticket_no, customer_name, status, management_decision, updated_at,
  {_name_of('products', 'nama_produk', 'decided.product_id', 'nama_produk')},
  {_name_of('products', 'tipe', 'decided.product_id', 'tipe')},
  {_name_of('users', 'name', 'decided.created_by', 'created_by_name')},
  {_name_of('users', 'name', 'decided.approved_by', 'approved_by_name')},
  if(status = 'rejected', 'Ditolak', 'Disetujui') AS outcome_label
FROM decided WHERE place <= 50
""")
def processed_approvals(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.processed_approvals(v.tickets, v.products, v.users)


@query("approval_history", f"""
, newest AS (FROM approval_logs QUALIFY row_number() OVER (ORDER BY created_at DESC, id DESC) <= 100),
named AS (SELECT *, {_name_of('tickets', 'ticket_no', 'newest.ticket_id', 'no')}, {_name_of('tickets', 'customer_name', 'newest.ticket_id', 'customer')},
          {_name_of('users', 'name', 'newest.user_id', 'who')} FROM newest)
SELECT id, created_at, ticket_id, COALESCE(no, printf('#%d', ticket_id)) AS ticket_label, if(customer <> '', customer, '-') AS customer_display, action,
  COALESCE(map {{'approve': 'Disetujui', 'reject': 'Ditolak', 'reset': 'Reset'}}[action], action) AS action_label,
  if(decision <> '', decision, '-') AS decision_display, if(comment <> '', left(comment, 100), '-') AS comment_display,
  if(who <> '', who, '-') AS user_display
FROM named
""")
def approval_history(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.approval_history(v.approval_logs, v.tickets, v.users)


@query("activity_timeline", """
SELECT l.id, l.ticket_id, l.created_at, l.action, l.description, COALESCE(NULLIF(u.name, ''), '-') AS user_name
FROM activity_log l LEFT JOIN users u ON l.user_id = u.id
""")
def activity_timeline(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.activity_timeline(v.activity_log, v.users)


@query("technician_today", f"""
, todays AS (SELECT * FROM schedules WHERE tanggal = {TODAY_SQL}),
desk AS (SELECT id AS ticket_id, ticket_no, customer_name, customer_kota, customer_hp, keluhan, status,
    {_name_of('products', 'nama_produk', 'tickets.product_id', 'nama_produk')},
    {_name_of('products', 'tipe', 'tickets.product_id', 'tipe')}
  FROM tickets WHERE id IN (SELECT ticket_id FROM todays)),
done AS (SELECT ticket_id, id AS visit_id FROM visit_results)
SELECT * FROM todays JOIN desk USING (ticket_id) LEFT JOIN done USING (ticket_id)
""")
def technician_today(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.technician_today(v.schedules, v.tickets, v.products, v.visit_results, TICKET_NOW)


_UPCOMING = """
, s2 AS (SELECT s.*, {key} AS sk FROM schedules s WHERE s.ticket_id IN (SELECT id FROM tickets)),
s3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY teknisi_id ORDER BY sk, jam, id) AS rn
                      FROM s2 WHERE {cond}) WHERE rn <= 10)
SELECT s3.* EXCLUDE (sk, rn), CAST(s3.rn AS INTEGER) AS rn, t.ticket_no, t.customer_name, t.customer_kota, p.nama_produk
FROM s3 JOIN tickets t ON s3.ticket_id = t.id LEFT JOIN products p ON t.product_id = p.id
"""
_REASSEMBLED = "substr(s.tanggal, 7, 4) || '-' || substr(s.tanggal, 4, 2) || '-' || substr(s.tanggal, 1, 2)"
_PARSED = ("strftime(COALESCE(try_strptime(s.tanggal, '%d/%m/%Y'), try_strptime(s.tanggal, '%Y-%m-%d')), "
           "'%Y-%m-%d')")


@query("technician_upcoming", _UPCOMING.format(key=_REASSEMBLED, cond=f"sk > strftime({NOW_SQL}, '%Y-%m-%d')"))
def technician_upcoming(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.technician_upcoming(v.schedules, v.tickets, v.products, TICKET_NOW, k=10, mode="text")


@query("technician_upcoming_dates",
       _UPCOMING.format(key=_PARSED, cond=f"sk > strftime({NOW_SQL}, '%Y-%m-%d')"))
def technician_upcoming_dates(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.technician_upcoming(v.schedules, v.tickets, v.products, TICKET_NOW, k=10, mode="date")


@query("technician_history", f"""
, visited AS (SELECT *, (SELECT product_id FROM tickets WHERE id = ticket_id) AS product_id FROM visit_results WHERE ticket_id IN (SELECT id FROM tickets))
SELECT * EXCLUDE (product_id), {', '.join(_name_of('tickets', c, 'visited.ticket_id', c) for c in ('ticket_no', 'customer_name', 'customer_kota'))},
  {_name_of('products', 'nama_produk', 'visited.product_id', 'nama_produk')}
FROM visited
""")
def technician_history(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.technician_history(v.visit_results, v.tickets, v.products)


@query("voucher_detail", f"""
SELECT *, {_name_of('tickets', 'ticket_no', 'service_vouchers.ticket_id', 'ticket_no')},
  {_name_of('tickets', 'customer_hp', 'service_vouchers.ticket_id', 'ticket_hp')}
FROM service_vouchers
""")
def voucher_detail(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.voucher_detail(v.service_vouchers, v.tickets)


@query("voucher_status", f"""
SELECT id, voucher_no, ticket_id, status, expired_at,
       CASE WHEN status = 'active' THEN 'AKTIF' ELSE 'TIDAK AKTIF' END AS state_label,
       COALESCE(NULLIF(expired_at, ''), '-') AS expired_display,
       TRY_CAST(expired_at AS DATE) < CAST({NOW_SQL} AS DATE) AS is_expired
FROM service_vouchers
""")
def voucher_status(spark, sf_dir):
    return E.voucher_status(views(spark, sf_dir).service_vouchers, TICKET_NOW)


@query("product_lookup", """
SELECT t.id, t.kode_barang, p.id AS found_id, p.nama_produk, p.tipe, p.garansi_bulan
FROM tickets t LEFT JOIN products p ON t.kode_barang = p.kode_barang
""")
def product_lookup(spark, sf_dir):
    v = views(spark, sf_dir)
    return E.product_lookup(v.products, v.tickets.select("id", "kode_barang"))


@query("products_sorted", "SELECT * FROM products")
def products_sorted(spark, sf_dir):
    return E.products_sorted(views(spark, sf_dir).products)


@query("latest_logs", """
SELECT *, CASE WHEN contains(type, 'error') THEN 'danger' WHEN contains(type, '_start') THEN 'success'
               ELSE '' END AS severity
FROM debug_logs ORDER BY id DESC LIMIT 100
""")
def latest_logs(spark, sf_dir):
    return E.latest_logs(views(spark, sf_dir).debug_logs)


# ------------------------------------------------------------------ calendar
def _cal(*more: str, where: str = "") -> str:
    """Schedules of known tickets with looked-up names."""
    own = ", ".join(_name_of("tickets", c, "schedules.ticket_id", c) for c in ("ticket_no", "customer_name", "customer_kota", *more))
    return f"""
SELECT id, ticket_id, teknisi_id, tanggal, jam, notes, {own},
  {_name_of('users', 'name', 'schedules.teknisi_id', 'teknisi_name')},
  (SELECT nama_produk FROM products JOIN tickets ON products.id = product_id WHERE tickets.id = schedules.ticket_id) AS nama_produk
FROM schedules WHERE ticket_id IN (SELECT id FROM tickets) {where}
"""


_CAL_EVENTS = _cal()
_CAL_MONTH = _cal("status", where=f"AND regexp_matches(tanggal, '/{CAL_MONTH:02d}/{CAL_YEAR}$|^{CAL_YEAR}-{CAL_MONTH:02d}-')")


@query("calendar_month", _CAL_MONTH)
def calendar_month(spark, sf_dir):
    v = views(spark, sf_dir)
    return C.calendar_month(v.schedules, v.tickets, v.users, v.products, CAL_YEAR, CAL_MONTH)


@query("calendar_events", _CAL_EVENTS)
def calendar_events(spark, sf_dir):
    v = views(spark, sf_dir)
    return C.calendar_events(v.schedules, v.tickets, v.users, v.products)


@query("calendar_events_json", f"SELECT CAST(to_json(e) AS VARCHAR) AS json FROM ({_CAL_EVENTS}) e")
def calendar_events_json(spark, sf_dir):
    v = views(spark, sf_dir)
    return C.to_json_rows(C.calendar_events(v.schedules, v.tickets, v.users, v.products))


_MONTHS = ", ".join(_q(m) for m in L.MONTH_NAMES)
_DAYS = ", ".join(_q(d) for d in L.DAY_NAMES)


@query("calendar_grid", f"""
, days AS (
  SELECT strftime(d, '%d/%m/%Y') AS tanggal, CAST(day(d) AS INTEGER) AS day,
         CAST(dayofweek(d) AS INTEGER) AS weekday, [{_DAYS}][dayofweek(d) + 1] AS weekday_name,
         CAST((day(d) + dayofweek(DATE '{CAL_YEAR}-{CAL_MONTH:02d}-01') - 1) // 7 AS INTEGER) AS week_row,
         [{_MONTHS}][{CAL_MONTH}] AS month_name
  FROM (SELECT CAST(unnest(generate_series(DATE '{CAL_YEAR}-{CAL_MONTH:02d}-01',
                                           last_day(DATE '{CAL_YEAR}-{CAL_MONTH:02d}-01'), INTERVAL 1 DAY)) AS DATE) AS d)
),
ev AS (
  SELECT CASE WHEN instr(m.tanggal, '-') > 1
              THEN split_part(m.tanggal, '-', 3) || '/' || split_part(m.tanggal, '-', 2) || '/' || split_part(m.tanggal, '-', 1)
              ELSE m.tanggal END AS tanggal,
         m.id AS schedule_id, m.jam, m.ticket_no, substr(COALESCE(m.teknisi_name, ''), 1, 6) AS teknisi_short, m.status
  FROM ({_CAL_MONTH}) m
),
ev2 AS (SELECT * FROM ev WHERE tanggal IN (SELECT tanggal FROM days)),
cnt AS (SELECT tanggal, count(*) AS n_events FROM ev2 GROUP BY tanggal)
SELECT d.*, e.schedule_id, e.jam, e.ticket_no, e.teknisi_short, e.status, c.n_events
FROM days d JOIN ev2 e ON e.tanggal = d.tanggal JOIN cnt c ON c.tanggal = d.tanggal
UNION ALL
SELECT d.*, NULL, NULL, NULL, NULL, NULL, 0 FROM days d WHERE d.tanggal NOT IN (SELECT tanggal FROM cnt)
""")
def calendar_grid(spark, sf_dir):
    v = views(spark, sf_dir)
    return C.calendar_grid(spark, v.schedules, v.tickets, v.users, v.products, CAL_YEAR, CAL_MONTH)


# ------------------------------------------------------------------ progress / labels
_STEPS = P.STEP_LABELS


@query("ticket_progress", FIRST_CHILD + f"""
SELECT id AS ticket_id, 1 AS step, {_q(_STEPS[0])} AS label, true AS done, created_at AS date FROM tt
UNION ALL SELECT id, 2, {_q(_STEPS[1])}, COALESCE(status <> 'waiting', true), approved_at FROM tt
UNION ALL SELECT id, 3, {_q(_STEPS[2])}, schedule_id IS NOT NULL, s_tanggal || ' ' || s_jam FROM tt
UNION ALL SELECT id, 4, {_q(_STEPS[3])}, visit_id IS NOT NULL, v_tanggal || ' ' || v_jam FROM tt
UNION ALL SELECT id, 5, {_q(_STEPS[4])}, COALESCE(status IN ('completed', 'rejected'), false), closed_at FROM tt
""")
def ticket_progress(spark, sf_dir):
    v = views(spark, sf_dir)
    return P.ticket_progress(v.tickets, v.schedules, v.visit_results, by="status")


@query("ticket_progress_print", FIRST_CHILD + f"""
SELECT id AS ticket_id, 1 AS step, {_q(_STEPS[0])} AS label, true AS done, created_at AS date FROM tt
UNION ALL SELECT id, 2, {_q(_STEPS[1])}, COALESCE(approved_at, '') <> '', COALESCE(NULLIF(approved_at, ''), '-') FROM tt
UNION ALL SELECT id, 3, {_q(_STEPS[2])}, schedule_id IS NOT NULL,
                 CASE WHEN schedule_id IS NOT NULL THEN s_tanggal || ' ' || s_jam ELSE '-' END FROM tt
UNION ALL SELECT id, 4, {_q(_STEPS[3])}, visit_id IS NOT NULL,
                 CASE WHEN visit_id IS NOT NULL THEN v_tanggal || ' ' || v_jam ELSE '-' END FROM tt
UNION ALL SELECT id, 5, {_q(_STEPS[4])}, COALESCE(closed_at, '') <> '', COALESCE(NULLIF(closed_at, ''), '-') FROM tt
""")
def ticket_progress_print(spark, sf_dir):
    v = views(spark, sf_dir)
    return P.ticket_progress(v.tickets, v.schedules, v.visit_results, by="timestamps")


_FOLLOW = ", ".join(_q(s) for s in L.FOLLOWUP_MESSAGES)


@query("ticket_next_action", FIRST_CHILD + f"""
SELECT id, ticket_no, status,
  COALESCE(status = 'waiting' AND NOT (admin_analysis IS NOT NULL AND admin_analysis <> ''), false) AS needs_analysis,
  COALESCE(status = 'approval', false) AS awaiting_approval,
  COALESCE(status = 'waiting' AND (admin_analysis IS NOT NULL AND admin_analysis <> '')
           AND (approved_by IS NOT NULL AND approved_by <> 0), false) AS schedulable,
  COALESCE(status = 'scheduled' AND schedule_id IS NOT NULL, false) AS scheduled,
  COALESCE(status = 'on_progress' AND COALESCE(v_solusi IN ({_FOLLOW}), false), false) AS needs_followup,
  COALESCE(status = 'on_progress', false) AS closable,
  COALESCE((management_decision IS NOT NULL AND management_decision <> '') AND management_decision <> 'reject',
           false) AS voucher_eligible
FROM tt
""")
def ticket_next_action(spark, sf_dir):
    v = views(spark, sf_dir)
    return P.ticket_next_action(v.tickets, v.schedules, v.visit_results)


_FOLLOW_CASE = " ".join(f"WHEN {_q(k)} THEN {_q(m)}" for k, m in L.FOLLOWUP_MESSAGES.items())


@query("followup_candidates", f"""
SELECT id AS visit_id, ticket_id, teknisi_id, solusi, CASE solusi {_FOLLOW_CASE} END AS message
FROM visit_results WHERE solusi IN ({_FOLLOW})
""")
def followup_candidates(spark, sf_dir):
    return P.followup_candidates(views(spark, sf_dir).visit_results)


_LABEL_MAP = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in L.STATUS_LABELS.items())


@query("ticket_labels", f"""
SELECT id, status,
  COALESCE(CASE status {_LABEL_MAP} END, 'Unknown') AS status_label,
  CASE WHEN status IN ('completed', 'on_progress') THEN 'SUDAH' WHEN status = 'rejected' THEN '-' ELSE 'BELUM' END
    AS handled_label,
  CASE WHEN marketplace IS NOT NULL AND trim(marketplace) <> '' AND toko IS NOT NULL AND trim(toko) <> ''
         THEN marketplace || ' / ' || toko
       WHEN marketplace IS NOT NULL AND trim(marketplace) <> '' THEN marketplace
       ELSE COALESCE(NULLIF(toko, ''), '-') END AS purchase_channel,
  regexp_replace(upper(status), '^([^_]*)_', '\\1 ') AS status_print,
  COALESCE(NULLIF(CAST(product_id AS VARCHAR), ''), '-') AS product_display
FROM tickets
""")
def ticket_labels(spark, sf_dir):
    t = views(spark, sf_dir).tickets
    return t.select("id", "status", L.status_label("status").alias("status_label"),
                    L.handled_label("status").alias("handled_label"),
                    L.purchase_channel("marketplace", "toko").alias("purchase_channel"),
                    T.status_upper("status").alias("status_print"),
                    T.dash_if_blank("product_id").alias("product_display"))


@query("log_severity", """
SELECT id, type, CASE WHEN contains(type, 'error') THEN 'danger' WHEN contains(type, '_start') THEN 'success'
                      ELSE '' END AS severity
FROM debug_logs
""")
def log_severity(spark, sf_dir):
    d = views(spark, sf_dir).debug_logs
    return d.select("id", "type", L.log_severity("type").alias("severity"))


_DIG = "regexp_replace(phone, '[^0-9]', '', 'g')"
_INTL = f"CASE WHEN starts_with({_DIG}, '0') THEN '62' || substr({_DIG}, 2) ELSE {_DIG} END"


@query("phone_normalized", f"""
SELECT id, phone,
       CASE WHEN phone IS NOT NULL AND phone <> '' AND starts_with({_INTL}, '62') THEN {_INTL} END AS phone_normalized
FROM users
""")
def phone_normalized(spark, sf_dir):
    u = views(spark, sf_dir).users
    return u.select("id", "phone", T.normalize_phone("phone").alias("phone_normalized"))


def _js_trim_sql(x: str) -> str:
    return "regexp_replace(" + x + ", '^" + T.WS_CLASS + "+|" + T.WS_CLASS + "+$', '', 'g')"


@query("intake_validation", f"""
SELECT id,
  substr({_js_trim_sql("COALESCE(customer_name, '')")}, 1, 100) AS customer_name_clean,
  substr({_js_trim_sql("COALESCE(keluhan, '')")}, 1, 1000) AS keluhan_clean,
  (COALESCE(customer_name, '') <> '' AND COALESCE(keluhan, '') <> '') AS valid
FROM tickets
""")
def intake_validation(spark, sf_dir):
    from helpdeck.operators.changes import INTAKE_LIMITS, given

    t = views(spark, sf_dir).tickets
    return t.select("id", *[T.trim_str(c, INTAKE_LIMITS[c]).alias(f"{c}_clean") for c in ("customer_name", "keluhan")],
                    (given("customer_name") & given("keluhan")).alias("valid"))


@query("terms_lines", f"""
SELECT doc_id, CAST(unnest(generate_series(1, len(l))) AS INTEGER) AS line_no, unnest(l) AS line
FROM (SELECT doc_id, list_filter(list_transform(string_split(COALESCE(text, ''), chr(10)),
                                                lambda x: {_js_trim_sql('x')}), lambda x: x <> '') AS l
      FROM documents)
""")
def terms_lines(spark, sf_dir):
    d = views(spark, sf_dir).table("documents")
    return (d.select("doc_id", F.posexplode(T.text_lines("text")).alias("pos", "line"))
            .select("doc_id", (F.col("pos") + 1).alias("line_no"), "line"))


def _msg_sql(template: str, **fields) -> str:
    import re

    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        out.append(_q(template[pos:m.start()]))
        out.append("'Service Desk'" if m.group(1) == "app" else f"CAST({fields[m.group(1)]} AS VARCHAR)")
        pos = m.end()
    out.append(_q(template[pos:]))
    return " || ".join(out)


def _render_messages_sql() -> str:
    from helpdeck.functions import messages as M

    base = "https://desk.example.org"
    link = lambda k: _q("\n" + base + M.LINK_PATHS[k])
    appr = _msg_sql(M.APPROVED, no="t.ticket_no") + " || " + link("approved")
    rej = _msg_sql(M.REJECTED, no="t.ticket_no") + " || " + link("rejected")
    need = _msg_sql(M.APPROVAL_NEEDED, no="t.ticket_no", customer="t.customer_name") + " || " + link("approval_needed")
    sch = _msg_sql(M.SCHEDULED, no="t.ticket_no", tanggal="s.tanggal", jam="s.jam") + " || " + link("scheduled")
    gone = _msg_sql(M.SCHEDULE_CANCELLED, no="t.ticket_no") + " || " + link("schedule_cancelled")
    voucher = _msg_sql(M.VOUCHER, brand="'Desk'", company="'Desk Ltd'", no="t.ticket_no", voucher="v.voucher_no",
                       customer="COALESCE(v.customer_name, 'null')", decision="COALESCE(v.decision, 'null')",
                       link=f"'{base}/voucher/' || v.qr_token")
    return f"""
SELECT 'approval_log' AS source, al.id AS source_id, CASE al.action WHEN 'approve' THEN 'approved' ELSE 'rejected' END AS kind,
       CASE al.action WHEN 'approve' THEN {appr} ELSE {rej} END AS text
FROM approval_logs al JOIN tickets t ON al.ticket_id = t.id WHERE al.action IN ('approve', 'reject')
UNION ALL
SELECT 'schedule', s.id, 'scheduled', {sch}
FROM schedules s JOIN tickets t ON s.ticket_id = t.id
UNION ALL
SELECT 'change', c.seq, 'approval_needed', {need}
FROM changes c JOIN tickets t ON c.ticket_id = t.id WHERE c.kind IN ('analysis', 'followup')
UNION ALL
SELECT 'change', c.seq, 'schedule_cancelled', {gone}
FROM changes c JOIN tickets t ON c.ticket_id = t.id
WHERE c.kind = 'cancel_schedule' AND EXISTS (SELECT 1 FROM schedules s WHERE s.ticket_id = c.ticket_id)
UNION ALL
SELECT 'voucher', v.id, 'voucher', {voucher}
FROM service_vouchers v JOIN tickets t ON v.ticket_id = t.id WHERE t.customer_hp <> ''
"""


@query("render_messages", "", builder=lambda _body: sql_changes(_render_messages_sql()))
def render_messages(spark, sf_dir):
    """H18 message texts with links: of every approval and rejection (a reset sends none), schedule, analysis and
    follow-up (approval needed), cancellation of a ticket with a schedule in the table as given, and voucher of a
    ticket with a phone."""
    from helpdeck.functions.messages import voucher_message
    from helpdeck.sources.fixtures import ChangeBatches

    v = views(spark, sf_dir)
    base = "https://desk.example.org/"
    no = F.col("ticket_no")
    t = v.tickets.select(F.col("id").alias("_tid"), "ticket_no", F.col("customer_name").alias("_customer"),
                         F.col("customer_hp").alias("_phone"))

    def texts(rows, source: str, source_id: str, kind, text):
        return rows.join(t, F.col("ticket_id") == F.col("_tid")).select(
            F.lit(source).alias("source"), F.col(source_id).alias("source_id"), kind.alias("kind"), text.alias("text"))

    approved = F.col("action") == "approve"
    out = texts(v.approval_logs.filter(F.col("action").isin("approve", "reject")), "approval_log", "id",
                F.when(approved, "approved").otherwise("rejected"),
                F.when(approved, message("approved", base, no=no)).otherwise(message("rejected", base, no=no)))
    changes = ChangeBatches(v).changes
    scheduled = v.schedules.select("ticket_id")
    for part in (
            texts(v.schedules, "schedule", "id", F.lit("scheduled"),
                  message("scheduled", base, no=no, tanggal=F.col("tanggal"), jam=F.col("jam"))),
            texts(changes.filter(F.col("kind").isin("analysis", "followup")), "change", "seq", F.lit("approval_needed"),
                  message("approval_needed", base, no=no, customer=F.col("_customer"))),
            texts(changes.filter(F.col("kind") == "cancel_schedule").join(scheduled, "ticket_id", "left_semi"), "change", "seq",
                  F.lit("schedule_cancelled"), message("schedule_cancelled", base, no=no)),
            texts(v.service_vouchers, "voucher", "id", F.lit("voucher"),
                  F.when(F.col("_phone") != "", voucher_message(
                      "Desk", "Desk Ltd", base, customer="customer_name", no=no, voucher="voucher_no", decision="decision",
                      token="qr_token"))).filter(F.col("text").isNotNull())):
        out = out.unionByName(part)
    return out


@query("voucher_lookup", """
SELECT t.id AS request_id, sha256('tok' || CAST(t.id AS VARCHAR)) AS token, v.id AS voucher_id, v.voucher_no,
       v.customer_name, v.product_name, v.status, v.expired_at,
       CASE WHEN v.id IS NULL THEN NULL WHEN v.status = 'active' THEN 'AKTIF' ELSE 'TIDAK AKTIF' END AS state_label
FROM tickets t LEFT JOIN service_vouchers v ON v.qr_token = sha256('tok' || CAST(t.id AS VARCHAR))
""")
def voucher_lookup(spark, sf_dir):
    """C13 voucher by token: every ticket's scanned token is looked up."""
    v = views(spark, sf_dir)
    tokens = v.tickets.select(F.col("id").alias("request_id"),
                              F.sha2(F.concat(F.lit("tok"), F.col("id").cast("string")), 256).alias("token"))
    return E.voucher_lookup(v.service_vouchers, tokens)


@query("setting_lookup", """
SELECT c.c_custkey AS request_id, 'kota_' || CAST(c.c_nationkey AS VARCHAR) AS key, COALESCE(s.value, '') AS value
FROM customer c LEFT JOIN settings s ON s.key = 'kota_' || CAST(c.c_nationkey AS VARCHAR)
""")
def setting_lookup(spark, sf_dir):
    """C13 setting by key for one request per customer."""
    v = views(spark, sf_dir)
    req = v.table("customer").select(F.col("c_custkey").alias("request_id"),
                                     F.concat(F.lit("kota_"), F.col("c_nationkey").cast("string")).alias("key"))
    return E.setting_lookup(v.settings, req)


@query("log_details", """
, j AS (SELECT id, type, CASE WHEN json_valid(detail) THEN CAST(detail AS JSON) END AS d FROM debug_logs)
SELECT id, type, CAST(len(json_keys(d)) AS INTEGER) AS detail_fields, json_extract_string(d, '$.k') AS k,
       json_extract_string(d, '$.body.k') AS body_k, json_extract_string(d, '$.session') AS session_id
FROM j
""")
def log_details(spark, sf_dir):
    return E.log_details(views(spark, sf_dir).debug_logs, {"k": "$.k", "body_k": "$.body.k", "session_id": "$.session"})


@query("visit_files", """
, files AS (UNPIVOT (SELECT id, ticket_id, foto_sebelum_path, foto_sesudah_path, video_path FROM visit_results)
            ON foto_sebelum_path, foto_sesudah_path, video_path INTO NAME field VALUE p)
SELECT id, ticket_id, field, if(starts_with(p, 'http'), p, '/uploads/' || p) AS url, '.' || list_last(string_split(p, '.')) AS extension FROM files WHERE p <> ''
""")
def visit_files(spark, sf_dir):
    return E.visit_files(views(spark, sf_dir).visit_results)


@query("user_badges", """
SELECT id, name, COALESCE(map {'admin': 'Admin', 'management': 'Management', 'teknisi': 'Teknisi', 'cs': 'CS'}[role], '?') AS role_label,
  COALESCE(map {'admin': 'primary', 'management': 'warning', 'cs': 'secondary'}[role], 'info') AS badge
FROM users
""")
def user_badges(spark, sf_dir):
    return E.user_badges(views(spark, sf_dir).users)
