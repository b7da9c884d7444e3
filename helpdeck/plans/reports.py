"""Report queries with their DuckDB oracles."""

from __future__ import annotations

from helpdeck.operators import reports as R
from helpdeck.plans.catalog import query, views
from helpdeck.sources.fixtures import TICKET_NOW

NOW_SQL = f"TIMESTAMP '{TICKET_NOW}'"
TODAY_SQL = f"strftime({NOW_SQL}, '%d/%m/%Y')"
UNKNOWN_COALESCE = "COALESCE(p.nama_produk, 'Unknown') AS nama_produk, COALESCE(p.tipe, '') AS tipe"


@query("product_complaints", f"""
SELECT t.product_id, {UNKNOWN_COALESCE}, count(*) AS total
FROM tickets t LEFT JOIN products p ON t.product_id = p.id
GROUP BY t.product_id, p.nama_produk, p.tipe
""")
def product_complaints(spark, sf_dir):
    v = views(spark, sf_dir)
    return R.product_complaints(v.tickets, v.products)


@query("status_kpis", f"""
SELECT CAST(count_if(tanggal_complaint = {TODAY_SQL}) AS BIGINT) AS complaint_hari_ini,
       CAST(count_if(status = 'approval') AS BIGINT) AS waiting_approval,
       CAST(count_if(status = 'scheduled') AS BIGINT) AS waiting_schedule,
       CAST(count_if(status = 'on_progress') AS BIGINT) AS on_progress,
       CAST(count_if(status = 'completed') AS BIGINT) AS completed,
       CAST(count_if(status = 'rejected') AS BIGINT) AS rejected
FROM tickets
""")
def status_kpis(spark, sf_dir):
    return R.status_kpis(views(spark, sf_dir).tickets, TICKET_NOW)


@query("management_kpis", f"""
SELECT CAST(count_if(status = 'approval') AS BIGINT) AS waiting,
       CAST(count_if(status = 'completed' AND substr(created_at, 6, 2) = strftime({NOW_SQL}, '%m')) AS BIGINT)
         AS completed_this_month,
       count(*) AS total
FROM tickets
""")
def management_kpis(spark, sf_dir):
    return R.management_kpis(views(spark, sf_dir).tickets, TICKET_NOW)


@query("completed_this_month", f"""
SELECT count(*) AS completed_this_month FROM tickets
WHERE status = 'completed' AND substr(created_at, 6, 2) = strftime({NOW_SQL}, '%m')
""")
def completed_this_month(spark, sf_dir):
    return R.completed_this_month(views(spark, sf_dir).tickets, TICKET_NOW)


@query("top_products", """
SELECT t.product_id, p.nama_produk, count(*) AS total
FROM tickets t JOIN products p ON t.product_id = p.id
GROUP BY t.product_id, p.nama_produk
ORDER BY total DESC, t.product_id ASC LIMIT 5
""")
def top_products(spark, sf_dir):
    v = views(spark, sf_dir)
    return R.top_products(v.tickets, v.products)


@query("top_problem_products", f"""
SELECT *, CAST(row_number() OVER (ORDER BY total DESC, product_id ASC NULLS FIRST) AS INTEGER) AS rank
FROM (
  SELECT t.product_id, {UNKNOWN_COALESCE}, count(*) AS total
  FROM tickets t LEFT JOIN products p ON t.product_id = p.id
  WHERE t.status IN ('completed', 'on_progress')
  GROUP BY t.product_id, p.nama_produk, p.tipe
  ORDER BY total DESC, t.product_id ASC NULLS FIRST LIMIT 10
)
""")
def top_problem_products(spark, sf_dir):
    v = views(spark, sf_dir)
    return R.top_problem_products(v.tickets, v.products)


@query("marketplace_complaints", """
SELECT COALESCE(m, 'Unknown') AS marketplace, total
FROM (SELECT marketplace AS m, count(*) AS total FROM tickets GROUP BY marketplace)
""")
def marketplace_complaints(spark, sf_dir):
    return R.marketplace_complaints(views(spark, sf_dir).tickets)


@query("top_issues", """
SELECT keluhan, count(*) AS total FROM tickets WHERE keluhan IS NOT NULL
GROUP BY keluhan ORDER BY total DESC, keluhan LIMIT 10
""")
def top_issues(spark, sf_dir):
    return R.top_issues(views(spark, sf_dir).tickets)


_DAYS = "(CAST(substr({a}, 1, 10) AS DATE) - CAST(substr({b}, 1, 10) AS DATE))"


@query("avg_resolution_closed", f"""
SELECT COALESCE(floor(avg({_DAYS.format(a='closed_at', b='created_at')}) * 10 + 0.5) / 10, 0.0) AS avg_hari
FROM tickets WHERE status = 'completed' AND closed_at IS NOT NULL
""")
def avg_resolution_closed(spark, sf_dir):
    return R.avg_resolution_closed(views(spark, sf_dir).tickets)


@query("avg_resolution_asof", f"""
SELECT COALESCE(floor(avg({_DAYS.format(a=f"COALESCE(closed_at, '{TICKET_NOW}')", b='created_at')}) * 10 + 0.5)
                / 10, 0.0) AS avg_hari
FROM tickets WHERE status = 'completed'
""")
def avg_resolution_asof(spark, sf_dir):
    return R.avg_resolution_asof(views(spark, sf_dir).tickets, TICKET_NOW)


@query("technician_visits", """
SELECT v.teknisi_id, u.name, count(v.id) AS total_visit
FROM visit_results v JOIN users u ON v.teknisi_id = u.id
GROUP BY v.teknisi_id, u.name
""")
def technician_visits(spark, sf_dir):
    v = views(spark, sf_dir)
    return R.technician_visits(v.visit_results, v.users)


@query("technician_stats", f"""
, a AS (SELECT teknisi_id, CAST(count_if(tanggal = {TODAY_SQL}) AS BIGINT) AS today, count(*) AS total
        FROM schedules GROUP BY teknisi_id),
b AS (SELECT s.teknisi_id, count(*) AS completed
      FROM visit_results v JOIN schedules s ON v.ticket_id = s.ticket_id GROUP BY s.teknisi_id)
SELECT a.teknisi_id, a.today, COALESCE(b.completed, 0) AS completed, a.total
FROM a LEFT JOIN b ON a.teknisi_id IS NOT DISTINCT FROM b.teknisi_id
""")
def technician_stats(spark, sf_dir):
    v = views(spark, sf_dir)
    return R.technician_stats(v.schedules, v.visit_results, TICKET_NOW)


_MONTHLY = f"""
SELECT substr(created_at, 6, 2) AS bulan, count(*) AS total,
       CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS selesai
FROM tickets WHERE substr(created_at, 1, 4) = strftime({NOW_SQL}, '%Y')
GROUP BY substr(created_at, 6, 2)
"""


@query("monthly_stats", _MONTHLY)
def monthly_stats(spark, sf_dir):
    return R.monthly_stats(views(spark, sf_dir).tickets, TICKET_NOW)


@query("chart_series", f"""
, m AS ({_MONTHLY})
SELECT CAST(to_json(list('Bulan ' || bulan ORDER BY bulan)) AS VARCHAR) AS labels,
       CAST(to_json(list(total ORDER BY bulan)) AS VARCHAR) AS data
FROM m
""")
def chart_series(spark, sf_dir):
    m = R.monthly_stats(views(spark, sf_dir).tickets, TICKET_NOW)
    return R.chart_series(m, "bulan", "total", ["bulan"], label_prefix="Bulan ")


@query("chart_products", """
, c AS (SELECT product_id, count(*) AS value, COALESCE((SELECT nama_produk FROM products WHERE id = product_id), 'Unknown') AS name FROM tickets GROUP BY product_id)
SELECT row_number() OVER (ORDER BY value DESC, product_id NULLS FIRST) AS place, replace(name, chr(39), '') AS label, value FROM c
""")
def chart_products(spark, sf_dir):
    v = views(spark, sf_dir)
    return R.product_chart(v.tickets, v.products)


@query("chart_marketplaces", """
SELECT row_number() OVER (ORDER BY count(*) DESC, marketplace NULLS FIRST) AS place, COALESCE(replace(marketplace, chr(39), ''), 'Unknown') AS label,
       count(*) AS value
FROM tickets GROUP BY marketplace
""")
def chart_marketplaces(spark, sf_dir):
    return R.marketplace_chart(views(spark, sf_dir).tickets)


@query("chart_completed", f"""
, m AS ({_MONTHLY})
SELECT row_number() OVER (ORDER BY bulan) AS place, 'Bulan ' || bulan AS label, selesai AS value FROM m
""")
def chart_completed(spark, sf_dir):
    return R.completed_chart(views(spark, sf_dir).tickets, TICKET_NOW)


@query("role_phones", """
SELECT phone, min(id) AS first_id FROM users
WHERE role = 'admin' AND phone IS NOT NULL AND phone <> ''
GROUP BY phone
""")
def role_phones(spark, sf_dir):
    return R.role_phones(views(spark, sf_dir).users, "admin")


@query("overdue_tickets", f"""
SELECT *, CAST(floor(hari + 0.5) AS BIGINT) AS hari_bulat FROM (
  SELECT id, ticket_no, customer_name, customer_hp, keluhan, created_at, status,
         (epoch({NOW_SQL}) - epoch(strptime(created_at, '%Y-%m-%d %H:%M:%S'))) / 86400.0 AS hari
  FROM tickets WHERE status NOT IN ('completed', 'rejected')
) WHERE hari > 3 ORDER BY hari DESC, id LIMIT 10
""")
def overdue_tickets(spark, sf_dir):
    return R.overdue_tickets(views(spark, sf_dir).tickets, TICKET_NOW)
