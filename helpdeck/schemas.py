"""Explicit schemas of the service-desk model, for reads that
must not infer and for hand-made rows. Dates and times stay text at the edge
(two layouts); operators derive DATE/TIMESTAMP with ``try_`` parses.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S = T.LongType(), T.IntegerType(), T.StringType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


USERS = _st(("id", L), ("username", S), ("name", S), ("role", S), ("phone", S), ("email", S), ("active", I),
            ("created_at", S))
PRODUCTS = _st(("id", L), ("kode_barang", S), ("nama_produk", S), ("tipe", S), ("garansi_bulan", I),
               ("created_at", S))
TICKETS = _st(("id", L), ("ticket_no", S), ("created_by", L), ("product_id", L), ("kode_barang", S),
              ("tanggal_complaint", S), ("customer_name", S), ("customer_hp", S), ("customer_alamat", S), ("customer_kota", S),
              ("marketplace", S), ("toko", S), ("serial_number", S), ("keluhan", S), ("status", S),
              ("admin_analysis", S), ("management_decision", S), ("management_comment", S), ("approved_by", L),
              ("approved_at", S), ("closed_by", L), ("closed_at", S), ("follow_up_count", I), ("created_at", S),
              ("updated_at", S))
SCHEDULES = _st(("id", L), ("ticket_id", L), ("teknisi_id", L), ("tanggal", S), ("jam", S), ("notes", S),
                ("created_by", L), ("created_at", S))
VISIT_RESULTS = _st(("id", L), ("ticket_id", L), ("teknisi_id", L), ("tanggal", S), ("jam", S),
                    ("hasil_pemeriksaan", S), ("solusi", S), ("sparepart", S), ("tanggal_selesai", S),
                    ("foto_sebelum_path", S), ("foto_sesudah_path", S), ("video_path", S), ("created_at", S))
NOTIFICATIONS = _st(("id", L), ("user_id", L), ("role", S), ("message", S), ("link", S), ("is_read", I),
                    ("created_at", S))
ACTIVITY_LOG = _st(("id", L), ("ticket_id", L), ("user_id", L), ("action", S), ("description", S),
                   ("created_at", S))
APPROVAL_LOGS = _st(("id", L), ("ticket_id", L), ("action", S), ("decision", S), ("comment", S),
                    ("old_status", S), ("new_status", S), ("user_id", L), ("created_at", S))
SERVICE_VOUCHERS = _st(("id", L), ("voucher_no", S), ("ticket_id", L), ("customer_name", S), ("customer_hp", S), ("customer_alamat", S),
                       ("product_name", S), ("product_type", S), ("serial_number", S), ("keluhan", S),
                       ("decision", S), ("status", S), ("qr_token", S), ("created_by", L), ("created_at", S),
                       ("expired_at", S))
SETTINGS = _st(("key", S), ("value", S))
DEBUG_LOGS = _st(("id", L), ("type", S), ("message", S), ("detail", S), ("created_at", S))
ATTEMPTS = _st(("id", L), ("ts", T.TimestampType()), ("address", L), ("ok", I))
CHANGES = _st(("seq", L), ("ticket_id", L), ("kind", S), ("ts", S), ("user_id", L), ("text", S), ("decision", S),
              ("teknisi_id", L), ("tanggal", S), ("jam", S), ("findings", S), ("solusi", S))

ALL = {"users": USERS, "products": PRODUCTS, "tickets": TICKETS, "schedules": SCHEDULES,
       "visit_results": VISIT_RESULTS, "notifications": NOTIFICATIONS, "activity_log": ACTIVITY_LOG,
       "approval_logs": APPROVAL_LOGS, "service_vouchers": SERVICE_VOUCHERS, "settings": SETTINGS,
       "debug_logs": DEBUG_LOGS}


def rows(spark, schema: T.StructType, data: list[dict]):
    """Hand-made rows as a DataFrame; missing fields are NULL."""
    return spark.createDataFrame([tuple(d.get(f.name) for f in schema.fields) for d in data], schema)
