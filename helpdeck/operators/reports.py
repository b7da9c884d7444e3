"""Management and dashboard reports.

Scale notes that apply throughout:

* Counts are aggregated on the fact table *before* joining a dimension, so
  the join sees one row per key instead of one per ticket. Catalyst does not
  push aggregates below joins on its own; the partial (map-side) aggregate
  also absorbs hot keys: a product holding a third of all tickets reaches
  the shuffle as one row per map task.
* Several KPIs are one conditional aggregate = one scan (D2), not one scan
  per KPI.
* Top-k uses ``orderBy().limit(k)`` (TakeOrderedAndProject: each task keeps
  k rows) with a key as tie-break so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helpdeck.functions.dates import frac_days, now_ts, round_half_up, today_str, whole_days
from helpdeck.functions.text import strip_quotes
from helpdeck.operators.pieces import cut, running


def _counts_by(df: DataFrame, key: str, name: str = "total") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


# ---------------------------------------------------------------- D1, D2, D21
def status_kpis(tickets: DataFrame, now: str) -> DataFrame:
    """D2 admin-dashboard KPIs in one scan: today's complaints and five status counts."""
    s = F.col("status")
    return tickets.agg(
        F.count_if(F.col("tanggal_complaint") == today_str(now)).alias("complaint_hari_ini"),
        F.count_if(s == "approval").alias("waiting_approval"),
        F.count_if(s == "scheduled").alias("waiting_schedule"),
        F.count_if(s == "on_progress").alias("on_progress"),
        F.count_if(s == "completed").alias("completed"),
        F.count_if(s == "rejected").alias("rejected"))


def management_kpis(tickets: DataFrame, now: str) -> DataFrame:
    """D1 + D12 management dashboard: waiting, completed this month (month number
    only, any year, on created_at), total - one scan."""
    month = F.substring(F.date_format(now_ts(now), "yyyy-MM-dd HH:mm:ss"), 6, 2)
    return tickets.agg(
        F.count_if(F.col("status") == "approval").alias("waiting"),
        F.count_if((F.col("status") == "completed") & (F.substring("created_at", 6, 2) == month))
        .alias("completed_this_month"),
        F.count(F.lit(1)).alias("total"))


def completed_this_month(tickets: DataFrame, now: str, same_year: bool = False) -> DataFrame:
    """D12 completed tickets whose created_at month equals the clock's month.

    The reference compares the month number only, in any year; ``same_year``
    adds the year (pushed to the scan as a ``startswith`` prefix).
    """
    txt = F.date_format(now_ts(now), "yyyy-MM-dd HH:mm:ss")
    cond = (F.col("status") == "completed") & (F.substring("created_at", 6, 2) == F.substring(txt, 6, 2))
    if same_year:
        cond = cond & (F.col("created_at").startswith(F.substring(txt, 1, 4)))
    return tickets.filter(cond).agg(F.count(F.lit(1)).alias("completed_this_month"))


# ---------------------------------------------------------------- D3 - D7
def top_products(tickets: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    """C1 + D3 top products by complaint count (inner join: orphans and NULL dropped)."""
    counts = _counts_by(tickets.filter(F.col("product_id").isNotNull()), "product_id")
    p = products.select(F.col("id").alias("product_id"), "nama_produk")
    return (counts.join(p, "product_id")
            .orderBy(F.desc("total"), F.asc("product_id")).limit(k)
            .select("product_id", "nama_produk", "total"))


def product_complaints(tickets: DataFrame, products: DataFrame) -> DataFrame:
    """C2 + D4 complaints per product id (left join): NULL and orphan ids are
    their own groups labelled 'Unknown' with type ''. Grouped by id, never by label."""
    counts = _counts_by(tickets, "product_id")
    p = products.select(F.col("id").alias("product_id"), "nama_produk", "tipe")
    return (counts.join(p, "product_id", "left")
            .select("product_id",
                    F.coalesce("nama_produk", F.lit("Unknown")).alias("nama_produk"),
                    F.coalesce("tipe", F.lit("")).alias("tipe"),
                    "total")
            .orderBy(F.desc("total"), F.asc_nulls_first("product_id")))


def top_problem_products(tickets: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """D5 + E1 top products among completed/on-progress tickets, numbered 1..k."""
    top = (product_complaints(tickets.filter(F.col("status").isin("completed", "on_progress")), products)
           .limit(k))
    # row_number over the already-limited k rows: a single small partition is fine here
    w = Window.orderBy(F.desc("total"), F.asc_nulls_first("product_id"))
    return top.withColumn("rank", F.row_number().over(w))


def marketplace_complaints(tickets: DataFrame) -> DataFrame:
    """D6 complaints per *raw* marketplace value, relabelled after grouping:
    NULL -> 'Unknown' (a literal 'Unknown' stays a separate row), '' kept."""
    return (_counts_by(tickets, "marketplace")
            .orderBy(F.desc("total"), F.asc_nulls_first("marketplace"))
            .select(F.coalesce("marketplace", F.lit("Unknown")).alias("marketplace"), "total"))


def top_issues(tickets: DataFrame, k: int = 10) -> DataFrame:
    """D7 most frequent exact complaint texts."""
    return (_counts_by(tickets.filter(F.col("keluhan").isNotNull()), "keluhan")
            .orderBy(F.desc("total"), F.asc("keluhan")).limit(k))


# ---------------------------------------------------------------- D8, D9
def avg_resolution_closed(tickets: DataFrame) -> DataFrame:
    """D8 mean whole days created -> closed for completed, closed tickets;
    1 decimal, halves up; no rows -> 0."""
    days = whole_days(F.col("closed_at"), F.col("created_at"))
    return (tickets.filter((F.col("status") == "completed") & F.col("closed_at").isNotNull())
            .agg(F.avg(days).alias("a"))
            .select(F.coalesce(round_half_up(F.col("a"), 1), F.lit(0.0)).alias("avg_hari")))


def avg_resolution_asof(tickets: DataFrame, now: str) -> DataFrame:
    """D9 mean whole days for completed tickets, an open closed_at counting as ``now``."""
    closed = F.coalesce(F.col("closed_at"), F.lit(now))
    return (tickets.filter(F.col("status") == "completed")
            .agg(F.avg(whole_days(closed, F.col("created_at"))).alias("a"))
            .select(F.coalesce(round_half_up(F.col("a"), 1), F.lit(0.0)).alias("avg_hari")))


# ---------------------------------------------------------------- D10, D15
def technician_visits(visits: DataFrame, users: DataFrame) -> DataFrame:
    """D10 visits per technician (inner join to users), most first."""
    counts = visits.groupBy("teknisi_id").agg(F.count("id").alias("total_visit"))
    u = users.select(F.col("id").alias("teknisi_id"), "name")
    return counts.join(u, "teknisi_id").orderBy(F.desc("total_visit"), F.asc("teknisi_id"))


def technician_stats(schedules: DataFrame, visits: DataFrame, now: str) -> DataFrame:
    """C18 + D15 per technician: today's schedules, 'completed' and total schedules.

    'completed' follows the reference: visits joined to schedules on ticket
    and counted under the *schedule's* technician, so a ticket with n
    schedules counts each visit n times. Computed as sum over tickets of
    (#visits of ticket) per schedule row - the join happens on per-ticket
    visit counts, never on raw visit x schedule pairs.
    """
    today = today_str(now)
    visit_counts = visits.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("n_visits"))
    per_sched = schedules.join(visit_counts, "ticket_id", "left")
    return (per_sched.groupBy("teknisi_id").agg(
        F.count_if(F.col("tanggal") == today).alias("today"),
        F.coalesce(F.sum("n_visits"), F.lit(0)).cast("long").alias("completed"),
        F.count(F.lit(1)).alias("total")))


# ---------------------------------------------------------------- D11, D16
def monthly_stats(tickets: DataFrame, now: str) -> DataFrame:
    """D11 per month of the clock's year: total and completed; empty months absent."""
    year = F.date_format(now_ts(now), "yyyy")
    return (tickets.filter(F.col("created_at").startswith(year))
            .groupBy(F.substring("created_at", 6, 2).alias("bulan"))
            .agg(F.count(F.lit(1)).alias("total"),
                 F.sum(F.when(F.col("status") == "completed", 1).otherwise(0)).cast("long").alias("selesai"))
            .orderBy("bulan"))


def chart_series(df: DataFrame, label: str, value: str, order: list, label_prefix: str = "") -> DataFrame:
    """D16 ordered label/value series for a chart, as two JSON array texts.

    ``df`` is a small report result (one row per label). The series is
    built by a single aggregate; the order is restored with ``array_sort``
    on a struct of the sort keys, so no global sort is needed.
    """
    keyed = df.select(F.struct(*order).alias("k"),
                      strip_quotes(F.concat(F.lit(label_prefix), F.col(label).cast("string"))).alias("l"),
                      F.col(value).alias("v"))
    arr = F.array_sort(F.collect_list(F.struct("k", "l", "v")))
    return keyed.agg(arr.alias("a")).select(
        F.to_json(F.transform("a", lambda x: x["l"])).alias("labels"),
        F.to_json(F.transform("a", lambda x: x["v"])).alias("data"))


def chart_points(df: DataFrame, label: Column, value: str, order: list[str]) -> DataFrame:
    """D16 a chart as rows ``place, label, value``: any number of them, none gathered. ``order``: unique columns without NULL, ascending."""
    d = running(cut(df.withColumn("label", strip_quotes(label.cast("string"))), order), [], order, {"_before": ("sum", F.lit(1))})
    return d.select((F.col("_before") + 1).alias("place"), "label", F.col(value).cast("long").alias("value")).orderBy("place")


def product_chart(tickets: DataFrame, products: DataFrame) -> DataFrame:
    """D16 complaints per product, most first (equal ones by id, no product first), quotes taken out of the names."""
    d = product_complaints(tickets, products).select(
        "nama_produk", "total", (-F.col("total")).alias("_o1"), F.col("product_id").isNotNull().cast("int").alias("_o2"),
        F.coalesce("product_id", F.lit(0)).alias("_o3"))
    return chart_points(d, F.col("nama_produk"), "total", ["_o1", "_o2", "_o3"])


def marketplace_chart(tickets: DataFrame) -> DataFrame:
    """D16 complaints per marketplace as it is written, most first (equal ones by name, no marketplace first)."""
    d = _counts_by(tickets, "marketplace").select(
        F.coalesce("marketplace", F.lit("Unknown")).alias("name"), "total", (-F.col("total")).alias("_o1"),
        F.col("marketplace").isNotNull().cast("int").alias("_o2"), F.coalesce("marketplace", F.lit("")).alias("_o3"))
    return chart_points(d, F.col("name"), "total", ["_o1", "_o2", "_o3"])


def completed_chart(tickets: DataFrame, now) -> DataFrame:
    """D16 completed tickets per month of this year."""
    return chart_points(monthly_stats(tickets, now), F.concat(F.lit("Bulan "), "bulan"), "selesai", ["bulan"])


# ---------------------------------------------------------------- D14
def role_phones(users: DataFrame, role: str) -> DataFrame:
    """D14 distinct phones of a role, NULL and '' dropped, in first-seen (id) order."""
    return (users.filter((F.col("role") == role) & F.col("phone").isNotNull() & (F.col("phone") != ""))
            .groupBy("phone").agg(F.min("id").alias("first_id"))
            .orderBy("first_id"))


# ---------------------------------------------------------------- B10
def overdue_tickets(tickets: DataFrame, now: str, days: float = 3.0, k: int = 10) -> DataFrame:
    """B10 open tickets older than ``days`` (fractional), oldest first, top k;
    ``hari_bulat`` is the display rounding (halves up)."""
    hari = frac_days(F.date_format(now_ts(now), "yyyy-MM-dd HH:mm:ss"), F.col("created_at"))
    return (tickets.filter(~F.col("status").isin("completed", "rejected"))
            .select("id", "ticket_no", "customer_name", "customer_hp", "keluhan", "created_at", "status",
                    hari.alias("hari"))
            .filter(F.col("hari") > days)
            .orderBy(F.desc("hari"), F.asc("id")).limit(k)
            .withColumn("hari_bulat", F.floor(F.col("hari") + 0.5).cast("long")))

