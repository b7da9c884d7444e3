"""Enrichment joins and list views.

Join strategy is left to Catalyst + AQE: dimensions (products, users) are
broadcast at runtime when AQE measures them under
``spark.sql.autoBroadcastJoinThreshold`` - a size check done by Spark on the
real data - and sort-merge joined otherwise. AQE's skew-join split handles
hot keys (including the NULL product id) on the fact side.

Where a list is capped (top-k), the cap is applied *before* left joins that
cannot drop or duplicate rows, so the joins see k rows, not the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helpdeck.functions.dates import now_ts, today_str
from helpdeck.functions.labels import approval_action_label, approval_outcome_label, role_badge, role_label, voucher_state
from helpdeck.functions.text import dash_if_blank, file_extension, public_path, truncate


def _products(products: DataFrame, *cols: str) -> DataFrame:
    return products.select(F.col("id").alias("_pid"), *cols)


def _user_names(users: DataFrame, alias: str, key: str = "_uid") -> DataFrame:
    return users.select(F.col("id").alias(key), F.col("name").alias(alias))


def with_product(df: DataFrame, products: DataFrame, *cols: str, key: str = "product_id") -> DataFrame:
    """Left-join product columns on ``df[key] = products.id``."""
    p = _products(products, *cols)
    return df.join(p, df[key] == p["_pid"], "left").drop("_pid")


def with_user_name(df: DataFrame, users: DataFrame, key: str, alias: str) -> DataFrame:
    """Left-join ``users.name AS alias`` on ``df[key] = users.id``."""
    u = _user_names(users, alias, key=f"_u_{alias}")
    return df.join(u, df[key] == u[f"_u_{alias}"], "left").drop(f"_u_{alias}")


def first_per_key(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """E4 first child row per key (lowest ``order``), as ``min_by`` - a partial
    aggregate, so hot keys collapse map-side."""
    return (df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
            .select(key, "_r.*"))


# ------------------------------------------------------------------ C1 - C3
def tickets_enriched(tickets: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """C2 tickets with product name/type and creator name (two left joins)."""
    t = with_product(tickets, products, "nama_produk", "tipe")
    return with_user_name(t, users, "created_by", "created_by_name")


def ticket_detail(tickets: DataFrame, products: DataFrame, users: DataFrame, schedules: DataFrame,
                  visits: DataFrame, vouchers: DataFrame) -> DataFrame:
    """C3 + E4 ticket detail for every ticket: product, creator/approver/closer
    names, and the first schedule (with technician name), visit and voucher.

    The first-child lookups are per-ticket aggregates, each hash-partitioned
    by ticket id, so the ticket side is shuffled once for all three joins.
    """
    t = with_product(tickets, products, "nama_produk", "tipe", "garansi_bulan")
    for key, alias in (("created_by", "created_by_name"), ("approved_by", "approved_by_name"),
                       ("closed_by", "closed_by_name")):
        t = with_user_name(t, users, key, alias)
    s = first_per_key(schedules.withColumnRenamed("id", "schedule_id"), "ticket_id", "schedule_id",
                      ["schedule_id", "teknisi_id", F.col("tanggal").alias("jadwal_tanggal"),
                       F.col("jam").alias("jadwal_jam")])
    s = with_user_name(s, users, "teknisi_id", "teknisi_name")
    v = first_per_key(visits.withColumnRenamed("id", "visit_id"), "ticket_id", "visit_id",
                      ["visit_id", F.col("solusi").alias("visit_solusi")])
    vc = first_per_key(vouchers.withColumnRenamed("id", "voucher_id"), "ticket_id", "voucher_id",
                       ["voucher_id", "voucher_no", F.col("status").alias("voucher_status")])
    for child in (s, v, vc):
        child = child.withColumnRenamed("ticket_id", "_tid")
        t = t.join(child, t["id"] == child["_tid"], "left").drop("_tid")
    return t


# ------------------------------------------------------------------ C4, C5, B21
def tickets_schedulable(tickets: DataFrame, products: DataFrame, schedules: DataFrame,
                        statuses=("waiting", "approval")) -> DataFrame:
    """C5 tickets in the given statuses with product and *every* schedule row
    (a ticket repeats per schedule, as in the reference), newest first."""
    t = tickets.filter(F.col("status").isin(*statuses)).select(
        "id", "ticket_no", "customer_name", "customer_kota", "status", "product_id", "created_at")
    t = with_product(t, products, "nama_produk")
    s = schedules.select(F.col("ticket_id").alias("_tid"), F.col("id").alias("schedule_id"))
    return (t.join(s, t["id"] == s["_tid"], "left").drop("_tid", "product_id")
            .orderBy(F.desc("created_at"), F.desc("id")))


def tickets_unscheduled(tickets: DataFrame, products: DataFrame, schedules: DataFrame,
                        statuses=("waiting", "approval", "scheduled", "on_progress")) -> DataFrame:
    """B21 calendar tickets with no schedule row (anti join, not a null test after fan-out)."""
    t = tickets.filter(F.col("status").isin(*statuses)).select(
        "id", "ticket_no", "customer_name", "customer_kota", "status", "product_id", "created_at")
    t = t.join(schedules.select(F.col("ticket_id").alias("id")), "id", "left_anti")
    return with_product(t, products, "nama_produk").drop("product_id").orderBy(F.desc("created_at"), F.desc("id"))


# ------------------------------------------------------------------ C8, C9, C14
def technician_today(schedules: DataFrame, tickets: DataFrame, products: DataFrame, visits: DataFrame,
                     now: str, teknisi_id=None) -> DataFrame:
    """C8 today's schedules per technician with ticket, product and visit id;
    ``visit_id`` NULL means the visit has not started."""
    s = schedules.filter(F.col("tanggal") == today_str(now))
    if teknisi_id is not None:
        s = s.filter(F.col("teknisi_id") == F.lit(teknisi_id))
    t = tickets.select(F.col("id").alias("_tid"), "ticket_no", "customer_name", "customer_kota", "customer_hp",
                       "keluhan", "status", "product_id")
    j = s.join(t, s["ticket_id"] == t["_tid"]).drop("_tid")
    j = with_product(j, products, "nama_produk", "tipe").drop("product_id")
    v = visits.select(F.col("ticket_id").alias("_vt"), F.col("id").alias("visit_id"))
    return (j.join(v, j["ticket_id"] == v["_vt"], "left").drop("_vt")
            .orderBy("teknisi_id", "jam", "id"))


def technician_upcoming(schedules: DataFrame, tickets: DataFrame, products: DataFrame, now: str,
                        k: int = 10, mode: str = "text") -> DataFrame:
    """C9 + B11 + F4 each technician's next k schedules after today, by date then time.

    The inner join to tickets only drops orphan schedules, so it runs first as
    a semi join; the per-technician top-k (WindowGroupLimit) then runs on
    schedules alone and only k rows per technician are enriched.
    """
    today_iso = F.date_format(now_ts(now), "yyyy-MM-dd")
    from helpdeck.functions.dates import reassembled_iso, text_date

    s = schedules.join(tickets.select(F.col("id").alias("ticket_id")), "ticket_id", "left_semi")
    if mode == "text":
        s = s.filter(reassembled_iso(F.col("tanggal")) > today_iso).withColumn("_sk", reassembled_iso(F.col("tanggal")))
    else:
        s = s.filter(text_date(F.col("tanggal")) > F.to_date(now_ts(now))) \
             .withColumn("_sk", F.date_format(text_date(F.col("tanggal")), "yyyy-MM-dd"))
    w = Window.partitionBy("teknisi_id").orderBy("_sk", "jam", "id")
    top = s.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("_sk")
    t = tickets.select(F.col("id").alias("_tid"), "ticket_no", "customer_name", "customer_kota", "product_id")
    j = top.join(t, top["ticket_id"] == t["_tid"]).drop("_tid")
    return with_product(j, products, "nama_produk").drop("product_id")


def technician_history(visits: DataFrame, tickets: DataFrame, products: DataFrame) -> DataFrame:
    """C14 visits with ticket and product, per technician newest first."""
    t = tickets.select(F.col("id").alias("_tid"), "ticket_no", "customer_name", "customer_kota", "product_id")
    j = visits.join(t, visits["ticket_id"] == t["_tid"]).drop("_tid")
    return (with_product(j, products, "nama_produk").drop("product_id")
            .orderBy("teknisi_id", F.desc("created_at"), F.desc("id")))


# ------------------------------------------------------------------ F5
def pending_approval(tickets: DataFrame, products: DataFrame, k: int | None = 5) -> DataFrame:
    """F5 tickets awaiting approval, newest first (top k, or all when k is None)."""
    t = tickets.filter(F.col("status") == "approval").select(
        "id", "ticket_no", "customer_name", "keluhan", "created_at", "admin_analysis", "product_id")
    newest = [F.desc("created_at"), F.desc("id")]
    if k is not None:
        t = t.orderBy(*newest).limit(k)
    # the joins after the cap do not keep its order
    return with_product(t, products, "nama_produk").drop("product_id").orderBy(*newest)


def approval_queue(tickets: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """F5 + C2 the full approval queue with product and creator, newest first."""
    t = tickets.filter(F.col("status") == "approval")
    t = with_user_name(with_product(t, products, "nama_produk", "tipe"), users, "created_by", "created_by_name")
    return t.orderBy(F.desc("created_at"), F.desc("id"))


def processed_approvals(tickets: DataFrame, products: DataFrame, users: DataFrame, k: int = 50) -> DataFrame:
    """F5 + C3 decided tickets now waiting/rejected, by updated_at, top k, with
    product, creator and approver names and the outcome badge (B19)."""
    t = (tickets.filter(F.col("status").isin("waiting", "rejected") & F.col("management_decision").isNotNull())
         .select("id", "ticket_no", "customer_name", "status", "management_decision", "updated_at",
                 "product_id", "created_by", "approved_by")
         .orderBy(F.desc("updated_at"), F.desc("id")).limit(k))
    t = with_product(t, products, "nama_produk", "tipe")
    t = with_user_name(t, users, "created_by", "created_by_name")
    t = with_user_name(t, users, "approved_by", "approved_by_name")
    return t.drop("product_id", "created_by", "approved_by") \
            .withColumn("outcome_label", approval_outcome_label(F.col("status"))) \
            .orderBy(F.desc("updated_at"), F.desc("id"))


# ------------------------------------------------------------------ C15 - C17, F3
def approval_history(approval_logs: DataFrame, tickets: DataFrame, users: DataFrame, k: int = 100) -> DataFrame:
    """C15 + B19 newest k approval-log rows with ticket and user; a missing
    ticket shows as '#id'."""
    top = approval_logs.orderBy(F.desc("created_at"), F.desc("id")).limit(k)
    t = tickets.select(F.col("id").alias("_tid"), "ticket_no", "customer_name")
    j = top.join(t, top["ticket_id"] == t["_tid"], "left").drop("_tid")
    j = with_user_name(j, users, "user_id", "user_name")
    return j.select(
        "id", "created_at", "ticket_id",
        F.coalesce(F.col("ticket_no"), F.concat(F.lit("#"), F.col("ticket_id").cast("string"))).alias("ticket_label"),
        dash_if_blank("customer_name").alias("customer_display"),
        "action", approval_action_label("action").alias("action_label"),
        dash_if_blank("decision").alias("decision_display"),
        F.when(F.coalesce(F.col("comment"), F.lit("")) != "", truncate("comment", 100))
         .otherwise(F.lit("-")).alias("comment_display"),
        dash_if_blank("user_name").alias("user_display")).orderBy(F.desc("created_at"), F.desc("id"))


def activity_timeline(activity_log: DataFrame, users: DataFrame) -> DataFrame:
    """C17 activity per ticket, oldest first; missing user shows '-'."""
    j = with_user_name(activity_log, users, "user_id", "user_name")
    return (j.select("id", "ticket_id", "created_at", "action", "description",
                     dash_if_blank("user_name").alias("user_name"))
            .orderBy("ticket_id", "created_at", "id"))


def latest_logs(debug_logs: DataFrame, k: int = 100) -> DataFrame:
    """F3 + B16 newest k debug-log rows by id, with the row severity class."""
    from helpdeck.functions.labels import log_severity

    return debug_logs.orderBy(F.desc("id")).limit(k).withColumn("severity", log_severity("type"))


# ------------------------------------------------------------------ C13, C16, A3
def products_sorted(products: DataFrame) -> DataFrame:
    """A3 products by name (id as tie-break)."""
    return products.orderBy("nama_produk", "id")


def product_lookup(products: DataFrame, requests: DataFrame, code_col: str = "kode_barang") -> DataFrame:
    """C13 (batch) product lookup by code: every request row gets the matching
    product or NULLs."""
    p = products.select(F.col("kode_barang").alias("_code"), F.col("id").alias("found_id"),
                        "nama_produk", "tipe", "garansi_bulan")
    return requests.join(p, requests[code_col] == p["_code"], "left").drop("_code")


def voucher_detail(vouchers: DataFrame, tickets: DataFrame) -> DataFrame:
    """C16 vouchers with ticket number and the ticket's phone."""
    t = tickets.select(F.col("id").alias("_tid"), "ticket_no", F.col("customer_hp").alias("ticket_hp"))
    return vouchers.join(t, vouchers["ticket_id"] == t["_tid"], "left").drop("_tid")


def voucher_status(vouchers: DataFrame, now: str) -> DataFrame:
    """B20 voucher state label from ``status`` only, plus a separate
    ``is_expired`` (expiry date before the clock's date; NULL when unparseable)."""
    exp = F.try_to_date(F.col("expired_at"), "yyyy-MM-dd")
    return vouchers.select("id", "voucher_no", "ticket_id", "status", "expired_at",
                           voucher_state("status").alias("state_label"),
                           dash_if_blank("expired_at").alias("expired_display"),
                           (exp < F.to_date(now_ts(now))).alias("is_expired"))


def voucher_lookup(vouchers: DataFrame, tokens: DataFrame) -> DataFrame:
    """C13 + B20 public voucher check for a batch of scanned tokens: each
    token gets its voucher (or NULLs) and the state label."""
    v = vouchers.select(F.col("qr_token").alias("_tok"), F.col("id").alias("voucher_id"), "voucher_no",
                        "customer_name", "product_name", "status", "expired_at")
    j = tokens.join(v, tokens["token"] == v["_tok"], "left").drop("_tok")
    return j.withColumn("state_label", F.when(F.col("voucher_id").isNull(), F.lit(None).cast("string"))
                        .otherwise(voucher_state(F.col("status"))))


def setting_lookup(settings: DataFrame, requests: DataFrame) -> DataFrame:
    """C13 setting by key for a batch of requests ('' when the key is absent,
    as the reference shows)."""
    s = settings.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    j = requests.join(s, requests["key"] == s["_key"], "left").drop("_key")
    return j.withColumn("value", F.coalesce(F.col("_value"), F.lit(""))).drop("_value")


def log_details(debug_logs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """H33 JSON text in: of each debug log's ``detail`` the number of members
    (NULL where it is no JSON object) and the values at the given JSON paths
    (``fields``: column -> path) as text, NULL where absent."""
    return debug_logs.select(
        "id", "type", F.size(F.json_object_keys("detail")).alias("detail_fields"),
        *[F.get_json_object("detail", path).alias(c) for c, path in fields.items()])


FILE_COLUMNS = ("foto_sebelum_path", "foto_sesudah_path", "video_path")


def visit_files(visits: DataFrame) -> DataFrame:
    """H32 one row per file of a visit: where it is served and its extension (no file, no row)."""
    files = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(F.lit(c).alias("field"), F.col(c).alias("p")))
                                      for c in FILE_COLUMNS]))
    return visits.select("id", "ticket_id", F.explode(files).alias("f")).select(
        "id", "ticket_id", "f.field", public_path(F.col("f.p")).alias("url"), file_extension(F.col("f.p")).alias("extension"))


def user_badges(users: DataFrame) -> DataFrame:
    """H28 users as the side bar shows them: name, role label and its colour."""
    return users.select("id", "name", role_label("role").alias("role_label"), role_badge("role").alias("badge"))
