"""Calendar views.

``calendar_grid`` never collects a day's events into one array: a busy day
at scale would become one huge row in one task. It emits one row per
(day, event) - plus one row for each empty day - and the per-day count comes
from a partial aggregate. The only broadcast side is the month's day list,
whose size is bounded by 31 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpdeck.functions.dates import month_match, text_date
from helpdeck.functions.labels import day_name, month_name
from helpdeck.operators.enrich import with_product, with_user_name

EVENT_COLS = ["id", "ticket_id", "teknisi_id", "tanggal", "jam", "notes", "ticket_no", "customer_name",
              "customer_kota", "status", "teknisi_name", "nama_produk"]


def _events(schedules: DataFrame, tickets: DataFrame, users: DataFrame, products: DataFrame,
            with_status: bool = True) -> DataFrame:
    t_cols = ["ticket_no", "customer_name", "customer_kota", "product_id"] + (["status"] if with_status else [])
    t = tickets.select(F.col("id").alias("_tid"), *t_cols)
    j = schedules.select("id", "ticket_id", "teknisi_id", "tanggal", "jam", "notes") \
        .join(t, F.col("ticket_id") == t["_tid"]).drop("_tid")
    j = with_user_name(j, users, "teknisi_id", "teknisi_name")
    return with_product(j, products, "nama_produk").drop("product_id")


def _order(df: DataFrame, order: str) -> DataFrame:
    if order == "text":  # reference parity: dd/MM/yyyy sorts by day first
        return df.orderBy("tanggal", "jam", "id")
    return df.orderBy(text_date(F.col("tanggal")), "jam", "id")


def calendar_month(schedules: DataFrame, tickets: DataFrame, users: DataFrame, products: DataFrame,
                   year: int, month: int, order: str = "text") -> DataFrame:
    """C4 + B7 schedules of one month (either text layout) with ticket,
    technician and product. The month test is a prefix/suffix match that the
    scan can evaluate before any join."""
    s = schedules.filter(month_match(F.col("tanggal"), year, month))
    return _order(_events(s, tickets, users, products), order)


def calendar_events(schedules: DataFrame, tickets: DataFrame, users: DataFrame, products: DataFrame,
                    order: str = "text") -> DataFrame:
    """C4 every schedule with ticket, technician and product, by date text then time."""
    return _order(_events(schedules, tickets, users, products, with_status=False), order)


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """A5 one JSON object text per row (NULL fields kept as null)."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def normalised_day(tanggal) -> F.Column:
    """H4 calendar key: ISO ``yyyy-MM-dd`` (dash after the first char) -> ``dd/MM/yyyy``."""
    t = F.col(tanggal) if isinstance(tanggal, str) else tanggal
    parts = F.split(t, "-")
    return F.when(F.instr(t, "-") > 1,
                  F.concat_ws("/", parts.getItem(2), parts.getItem(1), parts.getItem(0))).otherwise(t)


def month_days(spark, year: int, month: int) -> DataFrame:
    """Every day of the month as ``dd/MM/yyyy`` with weekday (Sunday 0) and grid row."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    d = spark.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("d"))
    first_dow = F.dayofweek(first) - 1
    return d.select(
        F.date_format("d", "dd/MM/yyyy").alias("tanggal"),
        F.dayofmonth("d").alias("day"),
        (F.dayofweek("d") - 1).alias("weekday"),
        day_name(F.dayofweek("d") - 1).alias("weekday_name"),
        ((F.dayofmonth("d") + first_dow - 1) / 7).cast("int").alias("week_row"),
        month_name(F.lit(month)).alias("month_name"))


def calendar_grid(spark, schedules: DataFrame, tickets: DataFrame, users: DataFrame, products: DataFrame,
                  year: int, month: int) -> DataFrame:
    """C12 + D17 the month grid: every day present, each with its events
    (one row per event, an empty day as one row with NULL event columns) and
    ``n_events`` (0 on empty days)."""
    days = month_days(spark, year, month)
    ev = calendar_month(schedules, tickets, users, products, year, month).select(
        normalised_day("tanggal").alias("tanggal"), F.col("id").alias("schedule_id"), "jam", "ticket_no",
        F.substring(F.coalesce("teknisi_name", F.lit("")), 1, 6).alias("teknisi_short"), "status")
    # Only events on a real day of the month stay in the grid (as in the template).
    ev = ev.join(F.broadcast(days.select("tanggal")), "tanggal", "left_semi")
    counts = ev.groupBy("tanggal").agg(F.count(F.lit(1)).alias("n_events"))
    with_events = ev.join(F.broadcast(days), "tanggal").join(F.broadcast(counts), "tanggal")
    empty = (days.join(counts, "tanggal", "left_anti")
             .select(*days.columns, F.lit(None).cast("long").alias("schedule_id"),
                     F.lit(None).cast("string").alias("jam"), F.lit(None).cast("string").alias("ticket_no"),
                     F.lit(None).cast("string").alias("teknisi_short"), F.lit(None).cast("string").alias("status"),
                     F.lit(0).cast("long").alias("n_events")))
    cols = days.columns + ["schedule_id", "jam", "ticket_no", "teknisi_short", "status", "n_events"]
    return with_events.select(*cols).unionByName(empty.select(*cols)).orderBy("day", "jam", "schedule_id")
