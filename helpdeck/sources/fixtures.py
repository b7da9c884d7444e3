"""Ticket-shaped views over the driver's TPC-H-ish test tables (FIXTURES.md §2).

These views only *shape* rows into the service-desk schema (SURVEY §1); they
do none of any query's work. Every operator in ``helpdeck.operators`` must be
correct on any data of this schema, and takes nothing from how the rows were
made. The same definitions exist as a DuckDB CTE prefix in
``helpdeck.plans.oracle_views`` for the correctness oracle.

Fixed clocks: tickets ``2001-08-02 12:00:00`` (just past the last order),
events ``2024-02-01 00:00:00``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helpdeck.functions.dates import DMY_FMT, ISO_FMT, TS_FMT
from helpdeck.sources.tables import read_table

TICKET_NOW = "2001-08-02 12:00:00"
EVENT_NOW = "2024-02-01 00:00:00"


def _s(c: Column) -> Column:
    return c.cast("string")


def _pad6(k: Column) -> Column:
    return F.when(k < 1000000, F.lpad(_s(k), 6, "0")).otherwise(_s(k))


def _role_of(x: Column) -> Column:
    return (F.when(x % 4 == 0, "admin").when(x % 4 == 1, "management")
            .when(x % 4 == 2, "teknisi").otherwise("cs"))


def _hours(ts: Column, n: Column) -> Column:
    return ts + F.make_interval(hours=n.cast("int"))


def _days(ts: Column, n: Column) -> Column:
    return ts + F.make_interval(days=n.cast("int"))


# -- event-derived shapes: plain selects, so they apply to batch *and* streaming reads
def shape_notifications(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    return e.select(
        i.alias("id"),
        F.when(i % 3 != 0, F.col("user_id") % 100).alias("user_id"),
        F.when(i % 3 == 0, _role_of(i)).alias("role"),
        F.concat(F.lit("msg "), F.col("event_type")).alias("message"),
        F.concat(F.lit("/admin/tickets/"), _s(i % 200)).alias("link"),
        F.when(F.col("event_type").isin("view", "click"), F.lit(1)).otherwise(F.lit(0)).alias("is_read"),
        F.date_format("ts", TS_FMT).alias("created_at"))


def shape_notification_log(e: DataFrame) -> DataFrame:
    """Each notification's creation and, where it has been read, its reading."""
    both = F.array(F.lit("created"), F.when(F.col("is_read") == 1, F.lit("read")))
    return shape_notifications(e).select("id", "user_id", "role", F.explode(F.array_compact(both)).alias("event"))


def shape_approval_logs(events: DataFrame) -> DataFrame:
    e = events.filter(F.col("event_type").isin("purchase", "error", "signup"))
    et = F.col("event_type")
    action = F.when(et == "purchase", "approve").when(et == "error", "reject").otherwise("reset")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("ticket_id"),
        action.alias("action"),
        F.when(et == "purchase", "Servis").when(et == "error", "reject").alias("decision"),
        F.concat(F.lit("komentar "), _s(F.col("event_id"))).alias("comment"),
        F.when(et == "signup", "rejected").otherwise("approval").alias("old_status"),
        F.when(et == "purchase", "waiting").when(et == "error", "rejected").otherwise("approval").alias("new_status"),
        (F.col("event_id") % 100).alias("user_id"),
        F.date_format("ts", TS_FMT).alias("created_at"))


def shape_attempts(events: DataFrame) -> DataFrame:
    e = events.filter(F.col("event_type").isin("purchase", "error"))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts"), F.col("user_id").alias("address"),
        F.when(F.col("event_type") == "purchase", F.lit(1)).otherwise(F.lit(0)).alias("ok"))


def shape_deliveries(events: DataFrame) -> DataFrame:
    """Send attempts: a few messages per phone, phones in two spellings, some that are no phone."""
    i, u = F.col("event_id"), F.col("user_id")
    phone = (F.when(u % 10 == 3, F.concat(F.lit("ext "), _s(u)))
             .when(i % 4 < 2, F.concat(F.lit("0812"), _s(u))).otherwise(F.concat(F.lit("+62 812-"), _s(u))))
    return events.filter(F.col("event_type").isin("purchase", "error")).select(
        i.alias("id"), "ts", phone.alias("address"), F.concat(F.lit("Ticket "), _s(i % 3)).alias("message"),
        F.when(F.col("event_type") == "purchase", F.lit(1)).otherwise(F.lit(0)).alias("ok"))


class TicketViews:
    """Lazily built ticket-model DataFrames for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # -- helpers -------------------------------------------------------------
    @cached_property
    def first_line(self) -> DataFrame:
        return self.table("lineitem").groupBy("l_orderkey").agg(
            F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"),
            F.max("l_linenumber").alias("mx"), F.min("l_shipdate").alias("ship"))

    # -- dimensions ----------------------------------------------------------
    @cached_property
    def products(self) -> DataFrame:
        p = self.table("part")
        return p.select(
            F.col("p_partkey").alias("id"),
            F.concat(F.lit("P"), _s(F.col("p_partkey"))).alias("kode_barang"),
            F.col("p_name").alias("nama_produk"),
            F.col("p_type").alias("tipe"),
            F.col("p_size").alias("garansi_bulan"),
            F.lit("2000-01-01 00:00:00").alias("created_at"))

    @cached_property
    def users(self) -> DataFrame:
        s = self.table("supplier")
        i = F.col("s_suppkey")
        phone = (F.when(i % 5 == 0, F.concat(F.lit("0812-"), _s(i)))
                 .when(i % 5 == 1, F.concat(F.lit("+62 813 "), _s(i % 10)))
                 .when(i % 5 == 2, F.lit(""))
                 .when(i % 5 == 3, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("8"), _s(i))))
        return s.select(
            i.alias("id"),
            F.concat(F.lit("u"), _s(i)).alias("username"),
            F.col("s_name").alias("name"),
            _role_of(i).alias("role"),
            phone.alias("phone"),
            F.concat(F.lit("u"), _s(i), F.lit("@example.org")).alias("email"),
            F.when(i % 7 == 0, F.lit(0)).otherwise(F.lit(1)).alias("active"),
            F.lit("2000-01-01 00:00:00").alias("created_at"))

    # -- tickets -------------------------------------------------------------
    @cached_property
    def tickets(self) -> DataFrame:
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        fl = self.first_line
        j = (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .join(fl, o.o_orderkey == fl.l_orderkey, "left"))
        k = F.col("o_orderkey")
        created = _hours(F.col("o_orderdate"), k % 24)
        product_id = (F.when(k % 20 == 0, F.lit(None).cast("long"))
                      .when(k % 21 == 0, -F.col("pk") - 1)
                      .otherwise(F.col("pk")))
        closed = F.when((k % 6 == 4) & (k % 5 != 0), F.date_format(_days(created, k % 15), TS_FMT))
        approved = (k % 6).isin(2, 3, 4)
        approved_at = F.when(approved, F.date_format(_days(created, F.lit(1)), TS_FMT))
        status = (F.when(k % 6 == 0, "waiting").when(k % 6 == 1, "approval").when(k % 6 == 2, "scheduled")
                  .when(k % 6 == 3, "on_progress").when(k % 6 == 4, "completed").otherwise("rejected"))
        return j.select(
            k.alias("id"),
            F.concat(F.lit("SC-"), _s(F.year("o_orderdate")), F.lit("-"), _pad6(k)).alias("ticket_no"),
            (k % 100).alias("created_by"),
            product_id.alias("product_id"),
            F.concat(F.lit("P"), _s(product_id)).alias("kode_barang"),
            F.date_format("o_orderdate", DMY_FMT).alias("tanggal_complaint"),
            F.col("c_name").alias("customer_name"),
            F.concat(F.lit("0812"), _s(F.col("c_custkey"))).alias("customer_hp"),
            F.when(k % 8 != 0, F.concat(F.lit("Jl. "), _s(F.col("c_custkey")))).alias("customer_alamat"),
            F.col("n_name").alias("customer_kota"),
            (F.when(k % 9 == 0, F.lit(None).cast("string")).when(k % 11 == 0, F.lit(""))
             .otherwise(F.col("c_mktsegment"))).alias("marketplace"),
            (F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("Toko "), F.col("n_name")))).alias("toko"),
            F.concat(F.lit("SN-"), _s(k)).alias("serial_number"),
            F.col("o_orderpriority").alias("keluhan"),
            status.alias("status"),
            F.when(k % 6 != 0, F.concat(F.lit("Analisa "), _s(k))).alias("admin_analysis"),
            (F.when(approved, F.lit("Servis")).when(k % 6 == 5, F.lit("reject"))).alias("management_decision"),
            F.when((k % 6).isin(2, 3, 4, 5), F.concat(F.lit("ok "), _s(k))).alias("management_comment"),
            F.when(approved, F.lit(1).cast("long")).alias("approved_by"),
            approved_at.alias("approved_at"),
            F.when(closed.isNotNull(), F.lit(1).cast("long")).alias("closed_by"),
            closed.alias("closed_at"),
            (k % 3).cast("int").alias("follow_up_count"),
            F.date_format(created, TS_FMT).alias("created_at"),
            F.coalesce(closed, approved_at, F.date_format(created, TS_FMT)).alias("updated_at"))

    # -- ticket children -----------------------------------------------------
    @cached_property
    def schedules(self) -> DataFrame:
        fl = self.first_line
        k = F.col("l_orderkey")
        tek = F.col("sk") - F.col("sk") % 4 + 2
        main = fl.filter((k % 6).isin(2, 3, 4)).select(
            k.alias("id"), k.alias("ticket_id"), tek.alias("teknisi_id"),
            F.when(k % 10 == 0, F.date_format("ship", ISO_FMT))
             .otherwise(F.date_format("ship", DMY_FMT)).alias("tanggal"),
            F.concat(F.lpad(_s(8 + k % 8), 2, "0"), F.lit(":00")).alias("jam"),
            F.lit(None).cast("string").alias("notes"),
            F.lit(1).cast("long").alias("created_by"),
            F.date_format("ship", TS_FMT).alias("created_at"))
        extra = fl.filter(k % 60 == 4).select(
            (k + 10000000).alias("id"), k.alias("ticket_id"), F.lit(2).cast("long").alias("teknisi_id"),
            F.date_format("ship", DMY_FMT).alias("tanggal"), F.lit("16:00").alias("jam"),
            F.lit(None).cast("string").alias("notes"),
            F.lit(1).cast("long").alias("created_by"),
            F.date_format("ship", TS_FMT).alias("created_at"))
        return main.unionByName(extra)

    @cached_property
    def visit_results(self) -> DataFrame:
        fl = self.first_line
        k = F.col("l_orderkey")
        mx = F.col("mx")
        solusi = (F.when(mx == 1, "Servis").when(mx == 2, "Ganti Sparepart").when(mx == 3, "Ganti Unit")
                  .when(mx == 4, "Butuh Sparepart (Follow-up)").when(mx == 5, "Ganti Baru (Follow-up)")
                  .otherwise("Tidak Bisa Diperbaiki"))
        return fl.filter((k % 6 == 4) | (k % 12 == 3)).select(
            k.alias("id"), k.alias("ticket_id"), (F.col("sk") - F.col("sk") % 4 + 2).alias("teknisi_id"),
            F.date_format("ship", DMY_FMT).alias("tanggal"), F.lit("10:00").alias("jam"),
            F.concat(F.lit("Cek "), _s(k)).alias("hasil_pemeriksaan"),
            solusi.alias("solusi"),
            F.lit(None).cast("string").alias("sparepart"),
            F.date_format("ship", DMY_FMT).alias("tanggal_selesai"),
            F.when(k % 4 == 0, F.concat(F.lit("sebelum"), _s(k), F.lit(".jpg"))).alias("foto_sebelum_path"),
            F.when(k % 5 < 2, F.concat(F.lit("https://cdn.example/"), _s(k), F.lit(".png"))).alias("foto_sesudah_path"),
            F.when(k % 8 == 3, F.concat(F.lit("v"), _s(k), F.lit(".tar.mp4"))).alias("video_path"),
            F.date_format("ship", TS_FMT).alias("created_at"))

    # -- event-derived logs --------------------------------------------------
    @cached_property
    def notifications(self) -> DataFrame:
        return shape_notifications(self.table("events"))

    @cached_property
    def approval_logs(self) -> DataFrame:
        return shape_approval_logs(self.table("events"))

    @cached_property
    def attempts(self) -> DataFrame:
        return shape_attempts(self.table("events"))

    @cached_property
    def deliveries(self) -> DataFrame:
        return shape_deliveries(self.table("events"))

    @cached_property
    def activity_log(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("ticket_id"),
            (F.col("event_id") % 100).alias("user_id"), F.col("event_type").alias("action"),
            F.concat(F.lit("desc "), _s(F.col("event_id"))).alias("description"),
            F.date_format("ts", TS_FMT).alias("created_at"))

    @cached_property
    def debug_logs(self) -> DataFrame:
        e = self.table("events")
        i = F.col("event_id")
        return e.select(
            i.alias("id"),
            F.concat(F.col("event_type"), F.when(i % 2 == 0, F.lit("_start")).otherwise(F.lit("_end"))).alias("type"),
            F.concat(F.lit("log "), _s(i)).alias("message"),
            F.when(i % 4 == 0, F.col("props"))
             .when(i % 4 == 1, F.concat(F.lit('{"body": '), "props", F.lit(', "session": '), _s(i % 100), F.lit("}")))
             .when(i % 4 == 2, F.concat(F.lit("phone=0812 error="), _s(i))).alias("detail"),
            F.date_format("ts", TS_FMT).alias("created_at"))

    @cached_property
    def service_vouchers(self) -> DataFrame:
        t = self.tickets.filter(F.col("id") % 12 == 4)
        p = self.products
        j = t.join(p.select(F.col("id").alias("pid"), "nama_produk", "tipe"), t.product_id == F.col("pid"), "left")
        return j.select(
            F.col("id").alias("id"),
            F.concat(F.lit("BRC-"), _pad6(F.col("id"))).alias("voucher_no"),
            F.col("id").alias("ticket_id"),
            "customer_name", "customer_hp", "customer_alamat",
            F.col("nama_produk").alias("product_name"), F.col("tipe").alias("product_type"),
            "serial_number", "keluhan",
            F.col("management_decision").alias("decision"),
            F.when(F.col("id") % 24 == 4, F.lit("active")).otherwise(F.lit("used")).alias("status"),
            F.sha2(F.concat(F.lit("tok"), _s(F.col("id"))), 256).alias("qr_token"),
            F.lit(1).cast("long").alias("created_by"),
            F.coalesce("closed_at", "created_at").alias("created_at"),
            F.date_format(F.date_add(F.to_date(F.substring("created_at", 1, 10)), 30), ISO_FMT).alias("expired_at"))

    @cached_property
    def settings(self) -> DataFrame:
        n = self.table("nation")
        return n.select(F.concat(F.lit("kota_"), _s(F.col("n_nationkey"))).alias("key"),
                        F.col("n_name").alias("value"))


class ChangeBatches:
    """Change batches shaped from the test tables (FIXTURES.md §2 style).

    They only put rows into the request schemas the change operators take;
    the operators never rely on how these rows were made.
    """

    KINDS = ["analysis", "followup", "schedule", "calendar_schedule", "cancel_schedule",
             "approve", "reject", "reset", "start_visit", "visit_result", "close"]
    SOLUSI = ["Servis", "Ganti Sparepart", "Ganti Unit", "Butuh Sparepart (Follow-up)",
              "Ganti Baru (Follow-up)", "Tidak Bisa Diperbaiki"]

    def __init__(self, v: TicketViews):
        self.v = v

    @cached_property
    def changes(self) -> DataFrame:
        """Ticket transitions: one per event, ticket = the event's user id, or an id that no ticket has."""
        e = self.v.table("events")
        i, et, uid = F.col("event_id"), F.col("event_type"), F.col("user_id")
        kind = F.element_at(F.array(*[F.lit(k) for k in self.KINDS]), (i % 11 + 1).cast("int"))
        return e.select(
            i.alias("seq"), F.when(i % 17 == 0, -1 - uid).otherwise(uid).alias("ticket_id"), kind.alias("kind"),
            F.date_format("ts", TS_FMT).alias("ts"), (i % 100).alias("user_id"),
            F.when(et != "error", F.concat(F.lit("catatan "), _s(i))).alias("text"),
            F.when(kind == "approve", F.when(et == "view", F.lit("Lainnya"))
                   .when(i % 2 == 0, F.lit("Servis")).otherwise(F.lit("Ganti Unit")))
             .when(kind == "reject", F.lit("reject")).alias("decision"),
            F.when(et != "error", uid - uid % 4 + 2).alias("teknisi_id"),
            F.date_format("ts", DMY_FMT).alias("tanggal"), F.date_format("ts", "HH:mm").alias("jam"),
            F.when(et == "click", F.lit("")).otherwise(F.concat(F.lit("hasil "), _s(i))).alias("findings"),
            F.element_at(F.array(*[F.lit(x) for x in self.SOLUSI]), (i % 6 + 1).cast("int")).alias("solusi"))

    @cached_property
    def intake_raw(self) -> DataFrame:
        """Complaint form rows: one per customer."""
        c, n = self.v.table("customer"), self.v.table("nation")
        k = F.col("c_custkey")
        j = c.join(n, c.c_nationkey == n.n_nationkey)
        return j.select(
            k.alias("intake_key"),
            F.when(k % 13 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit("\t")))
             .alias("customer_name"),
            F.concat(F.lit("0812"), _s(k)).alias("customer_hp"), F.col("n_name").alias("customer_kota"),
            F.col("c_mktsegment").alias("marketplace"), F.lit(None).cast("string").alias("toko"),
            F.concat(F.lit("SN-C"), _s(k)).alias("serial_number"),
            F.concat(F.lit("Keluhan "), F.col("c_mktsegment")).alias("keluhan"),
            F.lit(None).cast("string").alias("kode_barang"), F.lit(None).cast("long").alias("product_id"),
            F.concat(F.lit(" Jl. "), "c_name").alias("customer_alamat"), F.concat(F.lit(" c"), _s(k), F.lit("@mail ")).alias("customer_email"),
            F.lower("n_name").alias("customer_provinsi"), F.concat(F.lit("INV-"), _s(k)).alias("nomor_invoice"),
            F.when(k % 2 == 0, F.concat(F.lit("/uploads/f"), _s(k))).alias("faktur_path"),
            F.when(k % 3 == 0, F.concat(F.lit("/uploads/p"), _s(k))).alias("foto_produk_path"),
            F.when(k % 5 == 0, F.concat(F.lit("/uploads/v"), _s(k))).alias("video_path"),
            F.when(k % 7 == 0, F.concat(F.lit("/uploads/k"), _s(k))).alias("foto_kerusakan_path"),
            F.when(k % 11 == 0, F.concat(F.lit("OWN-"), _s(k))).when(k % 11 == 1, F.lit(""))
             .when(k % 29 == 5, F.concat(F.lit("SC-2001-"), F.lpad(_s(k * 3), 6, "0"))).when(k % 97 == 3, F.lit("SC-2001-none"))
             .when(k % 53 == 7, F.concat(F.lit("sc-2001- +"), _s(k), F.lit("x-y"))).when(k % 61 == 9, F.lit("SC-1999-000500")).alias("ticket_no"),
            (k % 100).alias("created_by"), F.lit("").alias("tanggal_complaint"),
            F.concat(F.lit("2001-07-"), F.lpad(_s(k % 28 + 1), 2, "0")).alias("tanggal_pembelian"))

    @cached_property
    def product_sheet(self) -> DataFrame:
        """A product import sheet with mixed header aliases and repeated codes."""
        p = self.v.table("part")
        k = F.col("p_partkey")
        return p.select(
            (k + 1).alias("row_no"),
            F.when(k % 3 == 0, F.concat(F.lit("P"), _s(k % 1500))).otherwise(F.lit("")).alias("Kode Barang"),
            F.when(k % 3 == 1, F.concat(F.lit(" P"), _s(k % 1500), F.lit(" ")))
             .when(k % 3 == 2, F.concat(F.lit("N"), _s(k))).alias("kode_barang"),
            F.when(k % 7 == 0, F.lit("")).otherwise(F.col("p_name")).alias("Nama Produk"),
            F.when(k % 14 == 0, F.col("p_brand")).alias("NAMA_PRODUK"),
            F.col("p_type").alias("Tipe"),
            F.concat(_s(F.col("p_size")), F.lit(".5 bulan")).alias("Garansi"))

    @cached_property
    def schedule_requests(self) -> DataFrame:
        """Calendar schedule requests: one per 'click' activity."""
        a = self.v.activity_log.filter(F.col("action") == "click")
        u = F.col("user_id")
        return a.select(
            F.col("id").alias("seq"), "ticket_id",
            F.when(u % 10 != 0, u - u % 4 + 2).alias("teknisi_id"),
            F.substring("created_at", 1, 10).alias("tanggal"), F.substring("created_at", 12, 5).alias("jam"),
            F.col("description").alias("notes"), "user_id", F.col("created_at").alias("ts"))

    @cached_property
    def visit_reports(self) -> DataFrame:
        """Visit reports: one per 'signup' activity."""
        a = self.v.activity_log.filter(F.col("action") == "signup")
        i = F.col("id")
        return a.select(
            i.alias("seq"), "ticket_id", F.col("user_id").alias("teknisi_id"),
            F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("temuan "), _s(i))).alias("findings"),
            F.element_at(F.array(*[F.lit(x) for x in self.SOLUSI]), (i % 6 + 1).cast("int")).alias("solusi"),
            F.lit(None).cast("string").alias("sparepart"),
            F.when(i % 2 == 0, F.substring("created_at", 1, 10)).otherwise(F.lit("")).alias("tanggal_selesai"),
            F.substring("created_at", 12, 5).alias("jam"),
            F.when(i % 4 == 0, F.concat(F.lit("rs"), _s(i))).alias("foto_sebelum_path"),
            F.when(i % 3 == 1, F.concat(F.lit("rt"), _s(i))).alias("foto_sesudah_path"),
            F.when(i % 7 == 0, F.concat(F.lit("rv"), _s(i))).alias("video_path"))

    @cached_property
    def setting_writes(self) -> DataFrame:
        r = self.v.table("region")
        return r.select(F.concat(F.lit("kota_"), _s(F.col("r_regionkey"))).alias("key"),
                        F.col("r_name").alias("value"), F.col("r_regionkey").cast("long").alias("seq"))

    @cached_property
    def product_edits(self) -> DataFrame:
        fl = self.v.first_line
        return fl.select(F.col("pk").alias("id"), F.col("l_orderkey").alias("seq"),
                         F.concat(F.lit("T"), _s(F.col("mx"))).alias("tipe"))

    @cached_property
    def toggle_requests(self) -> DataFrame:
        a = self.v.activity_log.filter(F.col("action") == "error")
        return a.select(F.col("id").alias("seq"), "user_id")

    @cached_property
    def delete_requests(self) -> DataFrame:
        al = self.v.approval_logs.filter(F.col("action") == "reset")
        return al.select(F.col("id").alias("seq"), "user_id")

    @cached_property
    def user_log(self) -> DataFrame:
        """Creates, edits and deletes of users: names that are taken, free or freed, unknown roles, missing fields, ids of users made on the way."""
        al, i = self.v.approval_logs, F.col("id")
        users = self.v.users.agg(F.max("id")).scalar()
        return al.select(
            i.alias("seq"), F.when(F.col("action") == "approve", "create").when(F.col("action") == "reject", "edit").otherwise("delete").alias("kind"),
            F.when(i % 3 == 0, users + i % 50).otherwise(i % 40 + 1).alias("user_id"),
            F.when(i % 23 != 0, F.concat(F.when(i % 2 == 0, F.lit("u")).otherwise(F.lit("n")), _s(F.floor(i / 7) % 60))).alias("username"), F.lit("p").alias("password"),
            F.when(i % 19 != 0, F.concat(F.lit("N"), _s(i))).alias("name"),
            F.element_at(F.array(*[F.lit(r) for r in ("admin", "management", "teknisi", "cs", "boss", "cs", "teknisi")]), (i % 7 + 1).cast("int")).alias("role"),
            F.when(i % 5 != 0, F.concat(F.lit("08"), _s(i))).alias("phone"), F.lit(None).cast("string").alias("email"))


def incoming_catalog(v: TicketViews) -> DataFrame:
    """A supplier catalog feed keyed by product code (half known codes, half new)."""
    p = v.table("part")
    k = F.col("p_partkey")
    return p.select(k.alias("row_no"), F.concat(F.lit("P"), _s(k + 1000)).alias("kode_barang"),
                    F.upper(F.col("p_name")).alias("nama_produk"), F.col("p_brand").alias("tipe"),
                    F.col("p_size").alias("garansi_bulan"))
